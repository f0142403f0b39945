"""From observations to prefix sums: one scan, then tables of the size features * bins * arms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armwise.functions.values import LIMB, LIMBS, bin_of, is_missing, limbs, limbs_total, missing_as_nan, number
from armwise.operators.thresholds import bins_table
from armwise.sources.views import require


def observations(df: DataFrame, features: list[str], treatment: str = "treatment", outcome: str = "outcome", on_null_treatment: str = "drop") -> DataFrame:
    """The features as doubles (missing is NaN), treatment and outcome. A null or NaN outcome adds 0 to its
    row only; rows without a treatment are dropped, or an error with ``on_null_treatment="error"``."""
    if on_null_treatment not in ("drop", "error"):
        raise ValueError("on_null_treatment must be drop or error")
    require(df, *features, treatment, outcome)
    arm = F.col(treatment).cast("string")
    if on_null_treatment == "error":
        arm = F.coalesce(arm, F.raise_error(F.lit("null treatment")).cast("string"))
    else:
        df = df.where(F.col(treatment).isNotNull())
    y = number(outcome)
    return df.select(*[missing_as_nan(number(f)).alias(f) for f in features], arm.alias("treatment"), F.when(is_missing(y), 0.0).otherwise(y).alias("outcome"))


def binned(obs: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """(feature, bin_id, treatment, outcome): a row for each feature of each observation."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(F.col(f), own).alias("bin_id")) for f, own in cuts.items()])
    return obs.select(F.explode(each).alias("b"), "treatment", "outcome").select("b.*", "treatment", "outcome")


#: Features from which on tasks tally their batches in arrays: one expression for so many bins is not compiled any more.
WIDE = 24


def _whole_parts(x: np.ndarray) -> list[np.ndarray]:
    """The limbs of ``functions.values.limbs``, of an array."""
    if (np.abs(x) >= 2.0**47).any():
        raise ValueError("an outcome of 2^47 or more has no exact sum")
    out, rest = [], np.abs(x) * 2.0**-LIMB
    for k in range(LIMBS):
        whole = np.floor(rest) if k < LIMBS - 1 else np.rint(rest)
        out.append(whole * np.sign(x))
        rest = (rest - whole) * 2.0**LIMB
    return out


def _tallied(cuts: dict[str, list[float]], exact: bool):
    """A task's tallies of all features: batches are searched in the cuts and counted by (feature, bin, arm).

    Sums of the outcome are doubles, or with ``exact`` those of its limbs, which are whole numbers.
    """
    names = list(cuts)
    edges = [np.array(cuts[f], float) for f in names]
    first = np.concatenate([[0], np.cumsum([len(e) + 2 for e in edges])])
    parts = [f"s{k}" for k in range(LIMBS)] if exact else ["accepts"]

    def run(batches):
        arms: dict[str, int] = {}
        count, totals = np.zeros((0, first[-1]), np.int64), [np.zeros((0, first[-1]), np.int64 if exact else float) for _ in parts]
        for batch in batches:
            coded = batch.column("treatment").dictionary_encode()
            arm = np.array([arms.setdefault(a, len(arms)) for a in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            if len(arms) > len(count):
                grown = ((0, len(arms) - len(count)), (0, 0))
                count, totals = np.pad(count, grown), [np.pad(t, grown) for t in totals]
            outcome = batch.column("outcome").to_numpy(zero_copy_only=False)
            weights = _whole_parts(outcome) if exact else [outcome]
            for k, f in enumerate(names):
                x = batch.column(f).to_numpy(zero_copy_only=False)
                bins = np.where(np.isnan(x), len(edges[k]) + 1, np.searchsorted(edges[k], x, side="right"))
                at, width = arm * (len(edges[k]) + 2) + bins, len(edges[k]) + 2
                part = slice(first[k], first[k + 1])
                count[:, part] += np.bincount(at, minlength=len(arms) * width).reshape(-1, width)
                for total, w in zip(totals, weights, strict=True):
                    total[:, part] += np.bincount(at, weights=w, minlength=len(arms) * width).reshape(-1, width).astype(total.dtype)
        labels = np.array(list(arms), object)
        owner = np.repeat(np.arange(len(names)), np.diff(first))
        for k in range(len(arms)):  # a batch for each arm: features * bins rows
            at = np.flatnonzero(count[k])
            feature = pa.DictionaryArray.from_arrays(pa.array(owner[at].astype(np.int32)), pa.array(names)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [feature, pa.array((at - first[owner[at]]).astype(np.int32)), pa.array([labels[k]] * len(at), pa.string()), pa.array(count[k][at]), *[pa.array(t[k][at]) for t in totals]],
                names=["feature", "bin_id", "treatment", "opps", *parts],
            )

    return run


def counted(rows: DataFrame, *more: str, exact: bool = False) -> DataFrame:
    """Rows and sums of the outcome by (feature, bin_id, treatment), of ``binned`` rows.

    With ``exact`` the sum is that of whole numbers, rounded once at the end: the same for any order of the rows.
    """
    keys = ["feature", "bin_id", "treatment", *more]
    if not exact:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("opps"), F.sum("outcome").alias("accepts"))
    whole = rows.select(*keys, *[c.alias(f"s{k}") for k, c in enumerate(limbs(F.col("outcome")))])
    return _exact_sums(whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("opps"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(LIMBS)]), keys)


def _exact_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(*keys, "opps", limbs_total([F.col(f"s{k}") for k in range(LIMBS)]).alias("accepts"))


def tally(obs: DataFrame, cuts: dict[str, list[float]], exact: bool = False) -> DataFrame:
    """(feature, bin_id, bin_boundary, is_missing_bin, treatment, opps, accepts) of the bins that have rows.

    Tasks send partial sums only, so arms and bins of any skew cost the same. Few features are binned by
    compiled expressions; from WIDE on, Arrow batches are searched and counted in arrays, and no row is
    made for each feature of each observation. With ``exact``, sums of real outcomes do not depend on how rows
    are dealt out (multiples of 2^-48 below 2^47); else they are sums of doubles in whatever order rows come.
    """
    keys = ["feature", "bin_id", "treatment"]
    if len(cuts) < WIDE:
        sums = counted(binned(obs, cuts), exact=exact)
    else:
        numbers = [f"s{k}" for k in range(LIMBS)] if exact else ["accepts"]
        kinds = "feature string, bin_id int, treatment string, opps bigint, " + ", ".join(f"{n} {'bigint' if exact else 'double'}" for n in numbers)
        parts = obs.select(*[F.col(f"`{f}`") for f in cuts], "treatment", "outcome").mapInArrow(_tallied(cuts, exact), kinds)
        sums = parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("opps", *numbers)])
        sums = _exact_sums(sums, keys) if exact else sums
    return bounded(sums, cuts)


def bounded(sums: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Tallies with the bins' boundaries; bins and cuts are a configuration, small enough for any task."""
    bins = F.broadcast(bins_table(sums, cuts))
    return sums.join(bins, ["feature", "bin_id"]).select("feature", "bin_id", "bin_boundary", "is_missing_bin", "treatment", "opps", "accepts")


def densify(tallies: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """A row for every bin and arm of a feature; absent ones are 0.

    Every feature sees every observation, so a feature's own tallies name all arms: one row per feature holds
    them (bins * arms entries), and the grid unfolds from it without another look at the observations.
    """
    each = tallies.groupBy("feature").agg(
        F.sort_array(F.collect_set("treatment")).alias("arms"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("bin_id", "treatment").alias("key"), F.struct("opps", "accepts").alias("value")))).alias("have"),
    )
    grid = F.broadcast(bins_table(tallies, cuts)).join(each, "feature").select("*", F.explode("arms").alias("treatment"))
    found = F.try_element_at("have", F.struct("bin_id", "treatment"))
    return grid.withColumn("v", found).select(
        "feature", "bin_id", "bin_boundary", "is_missing_bin", "treatment",
        F.coalesce("v.opps", F.lit(0).cast("bigint")).alias("opps"), F.coalesce("v.accepts", F.lit(0.0)).alias("accepts"),
    )


def prefix_sums(dense: DataFrame) -> DataFrame:
    """Left and right counts and sums of each candidate bin and arm, and what is missing.

    One window over (feature, arm): the missing bin's tally is spread in it, so no join is needed. Sums are made
    in the order of the bins, so equal tallies give equal bits.
    """
    ordered = Window.partitionBy("feature", "treatment").orderBy("bin_id")
    own, up = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), ordered.rowsBetween(Window.unboundedPreceding, 0)
    regular = lambda c: F.when(~F.col("is_missing_bin"), F.col(c))
    gap = lambda c: F.coalesce(F.sum(F.when(F.col("is_missing_bin"), F.col(c))).over(own), F.lit(0))
    rows = dense.withColumns({
        "left_count_base": F.sum("opps").over(up), "left_sum_base": F.sum("accepts").over(up),
        "all_count": F.sum(regular("opps")).over(own), "all_sum": F.sum(regular("accepts")).over(own),
        "missing_count": gap("opps"), "missing_sum": gap("accepts").cast("double"),
    }).where("not is_missing_bin and bin_boundary < double('infinity')")
    return rows.select(
        "feature", F.col("bin_id").alias("candidate_bin"), "bin_boundary", "treatment", "left_count_base", "left_sum_base",
        (F.col("all_count") - F.col("left_count_base")).alias("right_count_base"), (F.col("all_sum") - F.col("left_sum_base")).alias("right_sum_base"), "missing_count", "missing_sum",
    )
