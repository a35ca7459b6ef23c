"""Deterministic row keys: hash buckets for split / sample / cap, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_bucket(key, buckets: int = 100, salt: str = "") -> Column:
    """Stable bucket 0..buckets-1 from the first 32 bits of md5(key || salt).

    Same value in DuckDB: ('0x' || substr(md5(key || salt), 1, 8))::BIGINT % buckets.  A null key
    hashes as the empty string.
    """
    k = F.coalesce(_col(key).cast("string"), F.lit(""))
    if salt:
        k = F.concat(k, F.lit(salt))
    h = F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(buckets))


def hash_order(key, salt: str = "") -> Column:
    """Stable pseudo-random order value (32-bit md5 prefix) for hash-ordered samples.  A null key
    hashes as the empty string, so it takes part like any other."""
    k = F.coalesce(_col(key).cast("string"), F.lit(""))
    if salt:
        k = F.concat(k, F.lit(salt))
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long")


def split_label(key, train_pct: int = 80, salt: str = "") -> Column:
    """'train' when the hash bucket is below train_pct, else 'test' (80/20 by default)."""
    return F.when(hash_bucket(key, 100, salt) < F.lit(train_pct), F.lit("train")).otherwise(F.lit("test"))
