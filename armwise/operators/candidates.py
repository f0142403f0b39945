"""Scoring of candidate splits and the choice among them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armwise.functions.values import rate
from armwise.sources import sinks
from armwise.sources.views import require

PREFIX_COLUMNS = ["feature", "candidate_bin", "bin_boundary", "treatment", "left_count_base", "left_sum_base", "right_count_base", "right_sum_base", "missing_count", "missing_sum"]
KEYS = ["feature", "candidate_bin", "bin_boundary", "nan_direction"]
SCORED = "feature string, candidate_bin int, bin_boundary double, nan_direction string, left_count bigint, left_sum double, right_count bigint, right_sum double, score double, is_valid boolean, tie_break_rank int"


def expand(prefix: DataFrame) -> DataFrame:
    """Each candidate twice: its missing values on the left, and on the right."""
    rows = require(prefix, *PREFIX_COLUMNS).withColumn("nan_direction", F.explode(F.array(F.lit("left"), F.lit("right"))))
    side = lambda name, base, gap: (F.col(base) + F.when(F.col("nan_direction") == name, F.col(gap)).otherwise(0)).alias
    return rows.select(
        *KEYS, "treatment", side("left", "left_count_base", "missing_count")("left_count"), side("left", "left_sum_base", "missing_sum")("left_sum"),
        side("right", "right_count_base", "missing_count")("right_count"), side("right", "right_sum_base", "missing_sum")("right_sum"),
    )


def _control_rank() -> Column:
    """The least of these structs holds the control arm; null for no arm."""
    rank = F.when(F.lower("treatment") == "control", 0).when(F.col("treatment") == "0", 1).otherwise(2)
    return F.when(F.col("treatment").isNotNull(), F.struct(rank.alias("rank"), "treatment"))


def control_arm(rows: DataFrame) -> DataFrame:
    """One row (treatment): 'control' in any case, else '0', else the lowest name; one for all features."""
    best = F.min(_control_rank()).alias("best")
    return rows.where("treatment is not null").agg(best).select(F.col("best.treatment").alias("treatment"))


def arm_rates(expanded: DataFrame, control: Column) -> DataFrame:
    """Response rates of both sides, and their uplift over the control arm of the same candidate."""
    rows = expanded.withColumns({"left_rate": rate(F.col("left_sum"), F.col("left_count")), "right_rate": rate(F.col("right_sum"), F.col("right_count")), "is_control": F.col("treatment") == control})
    own = Window.partitionBy("feature", "candidate_bin", "nan_direction")
    up = lambda s: F.when(~F.col("is_control"), F.col(f"{s}_rate") - F.max(F.when(F.col("is_control"), F.col(f"{s}_rate"))).over(own)).alias(f"{s}_uplift")
    return rows.select(*KEYS, "treatment", "left_rate", "right_rate", up("left"), up("right"))


def score(prefix: DataFrame, *, min_leaf_size: int = 1, min_uplift: float = 0.0, metric: str = "ddp_max", evaluation_mode: str = "sql", prefer_nan_direction_on_tie: str = "right") -> DataFrame:
    """All candidates with their score, the greatest difference of uplifts between the sides.

    Valid are those with rows of every arm on both sides, min_leaf_size rows on each side, a control and
    another arm, and a score of min_uplift or more. The score is null where an arm is empty.

    The prefix sums (features * bins * arms rows) are written first, so the observations behind them are read once:
    for the control arm, one for all features, and for the candidates. With ``pandas``, candidates are dealt by
    their hash, so one feature's go to many tasks, and whole ones are scored in batches.
    """
    if metric != "ddp_max":
        raise ValueError("metric must be ddp_max")
    if evaluation_mode not in ("sql", "pandas"):
        raise ValueError("evaluation_mode must be sql or pandas")
    if prefer_nan_direction_on_tie not in ("left", "right"):
        raise ValueError("prefer_nan_direction_on_tie must be left or right")
    if min_leaf_size < 1:
        raise ValueError("min_leaf_size must be 1 or more")
    prefix = sinks.kept(require(prefix, *PREFIX_COLUMNS).select(*PREFIX_COLUMNS), "prefix")
    rows, control = expand(prefix), control_arm(prefix).scalar()
    if evaluation_mode == "pandas":
        marked = rows.withColumn("is_control", F.coalesce(F.col("treatment") == control, F.lit(False)))
        n = int(prefix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = marked.repartition(n, "feature", "candidate_bin", "nan_direction").sortWithinPartitions("feature", "candidate_bin", "nan_direction", "treatment")
        return dealt.mapInPandas(_score_batches(min_leaf_size, min_uplift, prefer_nan_direction_on_tie), SCORED)
    arm = F.struct("treatment", rate(F.col("left_sum"), F.col("left_count")).alias("left"), rate(F.col("right_sum"), F.col("right_count")).alias("right"))
    per = rows.groupBy(*KEYS).agg(
        F.sum("left_count").alias("left_count"), F.sum("left_sum").alias("left_sum"), F.sum("right_count").alias("right_count"), F.sum("right_sum").alias("right_sum"),
        F.min(F.least("left_count", "right_count")).alias("least"), F.collect_list(arm).alias("arms"),
    )
    per = per.withColumn("control", control)
    mine = lambda a: F.coalesce(a["treatment"] == F.col("control"), F.lit(False))
    per = per.withColumns({"base": F.get(F.filter("arms", mine), 0), "others": F.filter("arms", lambda a: ~mine(a))})
    high = lambda side: F.array_max(F.transform("others", lambda a: a[side])) - F.col(f"base.{side}")
    low = lambda side: F.array_min(F.transform("others", lambda a: a[side])) - F.col(f"base.{side}")
    full = F.col("least") > 0
    value = F.when(full, F.greatest(high("right") - low("left"), high("left") - low("right")))
    rank = F.when(F.col("nan_direction") == prefer_nan_direction_on_tie, 0).otherwise(1)
    per = per.withColumns({"score": value, "tie_break_rank": rank})
    fits = full & (F.least("left_count", "right_count") >= min_leaf_size) & F.col("base").isNotNull() & (F.size("others") >= 1)
    good = F.coalesce(~F.isnan("score") & (F.col("score") >= min_uplift), F.lit(False))
    return per.select(*KEYS, "left_count", "left_sum", "right_count", "right_sum", "score", (fits & good).alias("is_valid"), "tie_break_rank")


def _score_batches(min_leaf_size: int, min_uplift: float, prefer: str):
    """The same in arrays: rows come sorted by candidate; one that a batch cuts off waits for the next."""
    keys = ["feature", "candidate_bin", "nan_direction"]

    def scored(frame: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        lc, ls, rc, rs = (frame[c].to_numpy(dtype=float) for c in ("left_count", "left_sum", "right_count", "right_sum"))
        control = frame["is_control"].to_numpy(dtype=bool)
        sums = [np.add.reduceat(x, heads) for x in (lc, ls, rc, rs)]
        full = np.minimum.reduceat(np.minimum(lc, rc), heads) > 0
        fits = full & np.logical_or.reduceat(control, heads) & np.logical_or.reduceat(~control, heads)
        ends = []
        for total, count in ((ls, lc), (rs, rc)):
            with np.errstate(divide="ignore", invalid="ignore"):
                own = total / count
            base = np.zeros(len(heads))
            base[group[control]] = own[control]
            up = own - base[group]
            ends.append((np.maximum.reduceat(np.where(control, -np.inf, up), heads), np.minimum.reduceat(np.where(control, np.inf, up), heads)))
        (left_high, left_low), (right_high, right_low) = ends
        with np.errstate(invalid="ignore"):
            value = np.where(fits, np.maximum(right_high - left_low, left_high - right_low), np.nan)
        out = frame.iloc[heads][KEYS].reset_index(drop=True)
        out["left_count"], out["left_sum"], out["right_count"], out["right_sum"] = sums[0].astype("int64"), sums[1], sums[2].astype("int64"), sums[3]
        out["score"] = pd.Series(value).astype(object).where(~np.isnan(value), None)
        out["is_valid"] = fits & (out["left_count"] >= min_leaf_size) & (out["right_count"] >= min_leaf_size) & (value >= min_uplift)
        out["tie_break_rank"] = np.where(out["nan_direction"] == prefer, 0, 1).astype("int32")
        return out

    def run(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
            last = np.flatnonzero(new)[-1]
            rest = frame.iloc[last:]
            if last:
                yield scored(frame.iloc[:last], new[:last])
        if rest is not None and len(rest):
            yield scored(rest, np.arange(len(rest)) == 0)

    return run


def _ranking() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("bin_boundary"), F.asc("candidate_bin"), F.asc("tie_break_rank"), F.asc("feature")]


def best_split(scored: DataFrame) -> DataFrame:
    """The best valid candidate of all features: a row, or none."""
    return scored.where("is_valid").orderBy(*_ranking()).limit(1)


def best_split_per_feature(scored: DataFrame) -> DataFrame:
    own = Window.partitionBy("feature").orderBy(*_ranking())
    return scored.where("is_valid").withColumn("at", F.row_number().over(own)).where("at = 1").drop("at")


def choose(scored: DataFrame) -> dict:
    """The best split as a dictionary; an error where no candidate is valid."""
    found = best_split(scored).first()
    if found is None:
        raise ValueError("no valid split")
    return found.asDict()
