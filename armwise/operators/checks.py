"""Parity, checksum and contract checks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.functions.values import array_sum, l1_distance


def array_checksum(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(array_sum(F.col(column))), F.lit(0.0)).alias("checksum"))


def scalar_checksum(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.coalesce(F.col(column).cast("double"), F.lit(0.0))), F.lit(0.0)).alias("checksum"))


def mismatches(pairs: DataFrame, a: str, b: str, tolerance: float = 1e-9) -> DataFrame:
    """How many rows' arrays differ by more than the tolerance."""
    apart = F.coalesce(l1_distance(F.col(a), F.col(b)) > tolerance, F.lit(True))
    return pairs.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(apart).alias("mismatches"))


def paired(tables: dict[str, DataFrame], keys: list[str], column: str) -> DataFrame:
    """A row per key: the keys, each table's ``column`` under the table's name, and ``n_<name>``, its rows with the key.

    One shuffle for any number of tables, and partial counts before it: keys that repeat, null ones too, are one
    row with their numbers, never all pairs. Where a table has a key more than once, ``column`` is any of them.
    """
    every = None
    for k, t in enumerate(tables.values()):
        part = t.select(*keys, F.lit(k).alias("__table"), F.col(column).alias("__value"))
        every = part if every is None else every.unionByName(part)
    mine = lambda k: F.col("__table") == k
    counts = [F.count_if(mine(k)).alias(f"n_{name}") for k, name in enumerate(tables)]
    return every.groupBy(*keys).agg(*[F.any_value(F.when(mine(k), F.col("__value")), True).alias(name) for k, name in enumerate(tables)], *counts)


def parity(tables: dict[str, DataFrame], keys: list[str], column: str = "scores", tolerance: float = 1e-9) -> DataFrame:
    """(n_rows, unpaired, repeated, <first>_<other>...): keys, those that a table lacks, those that a table has more than once,
    and pairs whose arrays differ from the first's. Repeated keys name no row, so they are counted but not compared.
    """
    first, *others = tables
    rows = paired(tables, keys, column)
    each = lambda test: F.array(*[test(F.col(f"n_{t}")) for t in tables])
    lacking, more = F.exists(each(lambda n: n == 0), lambda x: x), F.exists(each(lambda n: n > 1), lambda x: x)
    apart = lambda t: F.count_if(~lacking & ~more & F.coalesce(l1_distance(F.col(first), F.col(t)) > tolerance, F.lit(True)))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(lacking).alias("unpaired"), F.count_if(more).alias("repeated"), *[apart(t).alias(f"{first}_{t}") for t in others])


def contract(df: DataFrame, column: str, n_arms: int) -> DataFrame:
    """How many rows have no score, or one of another length."""
    return df.agg(F.count_if(F.col(column).isNull() | (F.size(column) != n_arms)).alias("violations"))


def run_summary(df: DataFrame, mode: str, seconds: str) -> DataFrame:
    return df.groupBy(mode).agg(F.avg(seconds).alias("avg_value"), F.min(seconds).alias("min_value"), F.max(seconds).alias("max_value"))
