"""Operators for preparing training text: scans, near-duplicate search, tokenising, web records.

Nothing else in the library imports this subpackage.  ``catalog`` holds the registered queries.
"""
