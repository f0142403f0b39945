"""Thresholds of features: quantiles, equal width, explicit lists."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armwise.functions.values import bin_of, is_missing, number


def clean(values: Iterable) -> list[float]:
    """Finite thresholds, each once, in ascending order; others than numbers are an error."""
    out = set()
    for v in values:
        if v is None:
            continue
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise ValueError(f"a threshold must be a number: {v!r}")
        if math.isfinite(v):
            out.add(float(v))
    return sorted(out)


def padded(cuts: list[float]) -> list[float]:
    return [-math.inf, *cuts, math.inf]


def quantiles(df: DataFrame, features: list[str], n: int = 16, relative_error: float = 0.01) -> dict[str, list[float]]:
    """Cuts at i/n of each feature's present values, all features in one job of mergeable sketches."""
    if n < 1 or not 0 <= relative_error <= 1:
        raise ValueError("n >= 1 and 0 <= relative_error <= 1 are asked for")
    if n == 1:
        return {f: [] for f in features}
    rows = df.select(*[F.when(~is_missing(number(f)), number(f)).alias(f) for f in features])
    found = rows.approxQuantile(features, [i / n for i in range(1, n)], relative_error)
    return {f: clean(values) for f, values in zip(features, found, strict=True)}


#: Cells of the value axis for each power of two.
CELLS = 4096


def _cell(x: Column) -> Column:
    """A whole number that never falls as x rises: CELLS for each power of two, mirrored at 0."""
    size = F.abs(x)
    power = F.greatest(F.floor(F.log2(size)), F.lit(-1000))
    up = (power + 1100) * CELLS + F.floor((size * F.pow(F.lit(2.0), -power) - 1) * CELLS) + 1
    far = F.lit(1 << 40)
    return F.when(x == 0, F.lit(0)).when(size == math.inf, far * F.signum(x)).otherwise(up * F.signum(x)).cast("bigint")


def exact_quantiles(df: DataFrame, features: list[str], n: int = 16) -> DataFrame:
    """(feature, cut): the distinct values at rank ceil(i * rows / n) of each feature's present values, i = 1..n-1.

    Two passes. The first counts the cells of the value axis (partial counts; a feature's cells are bounded by the
    number format, not by its values) and finds by a window over them those that hold a wanted rank: n - 1 a feature
    at most, so they are broadcast. In the second only values of these cells travel, equal ones as one with their
    number. No value passes through the driver. A feature without values gives no row.
    """
    if n < 1:
        raise ValueError("n >= 1 is asked for")
    each = F.array(*[F.struct(F.lit(f).alias("feature"), number(f).alias("x")) for f in features])
    rows = df.select(F.explode(each).alias("v")).select("v.feature", "v.x").where(~is_missing(F.col("x"))).withColumn("cell", _cell(F.col("x")))
    own = Window.partitionBy("feature")
    before = own.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("feature", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("feature", "cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(own).alias("all"))
    ranks = F.transform(F.sequence(F.lit(1), F.lit(max(n - 1, 1))), lambda i: F.ceil(i * F.col("all") / n))
    met = lambda upto: F.exists(ranks, lambda r: (r <= upto) & (r > upto - F.col("n"))) & F.lit(n > 1)
    wanted = cells.where(met(F.col("before") + F.col("n"))).select("feature", "cell", "before", "all")

    counts = rows.join(F.broadcast(wanted), ["feature", "cell"]).groupBy("feature", "cell", "before", "all", "x").agg(F.count(F.lit(1)).alias("n"))
    inner = Window.partitionBy("feature", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(inner) + F.col("before"))
    return upto.where(met(F.col("upto"))).select("feature", F.col("x").alias("cut"))


def rank_errors(df: DataFrame, cuts: dict[str, list[float]], n: int = 16) -> DataFrame:
    """(feature, quantile, error): for each i of n quantiles, how far the nearest cut's ranks are from i / n, as a share.

    One scan: rows are counted by bins between each cut and the next double after it, which tell how many values
    are below a cut and how many not above it; a row for each feature and bin moves. A feature without values has no
    error (null), one without cuts is off by the whole; an empty table gives no row.
    """
    fine = {f: sorted({x for c in own for x in (c, math.nextafter(c, math.inf))}) for f, own in cuts.items()}
    places = [(f, [fine[f].index(c) for c in own], [fine[f].index(math.nextafter(c, math.inf)) for c in own], len(fine[f])) for f, own in cuts.items()]
    spec = df.sparkSession.createDataFrame(places, "feature string, below array<int>, upto array<int>, last int")
    each = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(number(f), own).alias("bin")) for f, own in fine.items()])
    counts = df.select(F.explode(each).alias("v")).groupBy("v.feature", "v.bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("have"))  # a feature's bins
    own = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.coalesce(F.try_element_at("have", k), F.lit(0).cast("bigint")))
    sums = F.aggregate("own", F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    rows = counts.join(F.broadcast(spec), "feature").withColumn("own", own).withColumn("sums", sums).withColumn("size", F.element_at("sums", -1))
    rows = rows.select("feature", "below", "upto", "sums", "size", F.explode(F.sequence(F.lit(1), F.lit(max(1, n - 1)))).alias("quantile")).where(F.lit(n > 1))
    rank = F.ceil(F.col("quantile") * F.col("size") / n)
    gap = F.zip_with("below", "upto", lambda lo, hi: F.greatest(F.get("sums", lo + 1) + 1 - rank, rank - F.get("sums", hi + 1), F.lit(0).cast("bigint")))
    return rows.select("feature", "quantile", F.when(F.col("size") > 0, F.coalesce(F.array_min(gap) / F.col("size"), F.lit(1.0))).alias("error"))


def equal_width(low: float, high: float, n: int) -> list[float]:
    return clean(low + (high - low) * i / n for i in range(1, n))


def bins_table(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """(feature, bin_id, bin_boundary, is_missing_bin); the boundary is a bin's upper edge. Size: the cuts'."""
    rows = []
    for feature, own in cuts.items():
        rows += [(feature, i, b, False) for i, b in enumerate([*own, math.inf])] + [(feature, len(own) + 1, None, True)]
    return df.sparkSession.createDataFrame(rows, "feature string, bin_id int, bin_boundary double, is_missing_bin boolean")


def boundaries(prefix: DataFrame) -> DataFrame:
    """The cuts that prefix sums were built with."""
    return prefix.where("bin_boundary is not null").select("feature", "bin_boundary").distinct()
