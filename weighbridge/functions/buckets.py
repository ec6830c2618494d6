"""Range buckets with a declared order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket names with inclusive lower bounds.
OPTION_BUCKETS = (("2", 2), ("3-4", 3), ("5-8", 5), ("9-24", 9), ("25-52", 25), (">52", 53))
STATE_BUCKETS = (("<500", 0), ("500-2k", 500), ("2k-8k", 2000), (">8k", 8000))


def _bucket(value: Column, table) -> Column:
    out = None
    for name, low in reversed(table):
        out = F.when(value >= low, F.lit(name)) if out is None else out.when(value >= low, F.lit(name))
    return out


def option_bucket(n: Column) -> Column:
    return _bucket(n, OPTION_BUCKETS)


def state_bucket(chars: Column) -> Column:
    return _bucket(chars, STATE_BUCKETS)


def bucket_order(name: Column, table) -> Column:
    """Position of a bucket in its declared order, from 0."""
    return (F.array_position(F.array(*[F.lit(n) for n, _ in table]), name) - 1).cast("int")
