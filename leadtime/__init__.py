"""leadtime: lead-time analytics on case-processing tables, built on Spark SQL and Spark ML."""

__version__ = "0.1.0"
