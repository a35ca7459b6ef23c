"""Sources and sinks."""

from .files import (coerce_numeric_columns, load_lookups, lookup_counts, sample_capped_per_group, scan_head,
                    scan_multi_file_union, scan_pruned_columns, scan_random_cap)
from .sinks import write_model_report, write_table
