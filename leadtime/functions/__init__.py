"""Scalar column expressions."""

from .dates import (calendar_features, completion_dates, cyclical_encoding, fiscal_year_of_date,
                    lead_time_days, parse_dates_coerce, with_lead_days)
from .flags import (advice_tags, approval_denial_flags, binary_flags, case_number_numeric,
                    complexity_score, decode_onehot, deviation_from_office, peak_season_flag,
                    peak_season_static, prediction_interval, speed_category)
from .keys import hash_bucket, hash_order, split_label
