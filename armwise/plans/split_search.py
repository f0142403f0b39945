"""The composed jobs of split search: one scan of the observations for any number of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwise.functions.values import bin_of, is_missing, missing_as_nan, number
from armwise.operators import candidates, tallies, thresholds


def build_prefix_sums(
    df: DataFrame, *, feature_cols: list[str], treatment_col: str = "treatment", outcome_col: str = "outcome",
    splits: dict[str, list[float]] | None = None, num_quantile_splits: int | None = None, quantile_relative_error: float = 0.01,
    on_null_treatment: str = "drop", exact_sums: bool = False, check_quantiles: bool = False,
) -> DataFrame:
    """Prefix sums of all features; thresholds are given, or quantiles (16 by default).

    Quantiles come from mergeable sketches of all features in one job; with ``check_quantiles`` their ranks are counted
    in another scan, and one further off than ``quantile_relative_error`` is a ValueError. With ``exact_sums``, sums of real outcomes are the same for any partitions of the rows (see ``tallies.tally``).

    One scan of the observations for any number of features; nothing is cached. A caller that uses the
    result several times writes or caches it: it has features * bins * arms rows.
    """
    if splits is not None and num_quantile_splits is not None:
        raise ValueError("give splits or num_quantile_splits")
    obs = tallies.observations(df, feature_cols, treatment_col, outcome_col, on_null_treatment)
    if splits is not None:
        cuts = {f: thresholds.clean(splits[f]) for f in feature_cols}
    else:
        n = 16 if num_quantile_splits is None else num_quantile_splits
        cuts = thresholds.quantiles(obs, feature_cols, n, quantile_relative_error)
        if check_quantiles and n > 1:
            off = thresholds.rank_errors(obs, cuts, n).where(F.col("error") > quantile_relative_error).collect()  # n - 1 rows a feature
            if off:
                raise ValueError(f"quantiles beyond the asked error: {[tuple(r) for r in off]}")
    return tallies.prefix_sums(tallies.densify(tallies.tally(obs, cuts, exact_sums), cuts))


def sweep(df: DataFrame, feature: str, configs: dict[int, list[float]], **options) -> DataFrame:
    """The best split under several threshold lists, all tallied in one scan: (config, best split)."""
    names = {f"{feature}#{k}": cuts for k, cuts in configs.items()}
    wide = df.select(*[F.col(feature).alias(n) for n in names], "treatment", "outcome")
    scored = candidates.score(build_prefix_sums(wide, feature_cols=list(names), splits=names), **options)
    return _configured(candidates.best_split_per_feature(scored), feature)


def sweep_arms(df: DataFrame, feature: str, cuts: list[float], arms: dict[int, Column], outcome: str = "outcome", **options) -> DataFrame:
    """The best split under several divisions into arms, all tallied in one scan: (config, best split).

    ``arms`` gives for each configuration the column of a row's arm. All configurations have one control arm
    in common, as their candidates are scored together. Rows without an arm are dropped from a configuration.
    """
    names = {n: f"{feature}#{n}" for n in arms}
    own = thresholds.clean(cuts)
    each = F.array(*[F.struct(F.lit(names[n]).alias("feature"), arm.cast("string").alias("treatment")) for n, arm in arms.items()])
    rows = df.withColumn("__arms", each).withColumnsRenamed({feature: "__x", outcome: "__y"})
    rows = rows.select(missing_as_nan(number("__x")).alias("x"), number("__y").alias("y"), F.explode("__arms").alias("arm")).where("arm.treatment is not null")
    rows = rows.select("arm.feature", bin_of(F.col("x"), own).alias("bin_id"), "arm.treatment", F.when(is_missing(F.col("y")), 0.0).otherwise(F.col("y")).alias("outcome"))
    every = dict.fromkeys(names.values(), own)
    prefix = tallies.prefix_sums(tallies.densify(tallies.bounded(tallies.counted(rows), every), every))
    return _configured(candidates.best_split_per_feature(candidates.score(prefix, **options)), feature)


def _configured(best: DataFrame, feature: str) -> DataFrame:
    return best.withColumns({"config": F.element_at(F.split("feature", "#"), -1).cast("int"), "feature": F.lit(feature)})


def same_choice(runs: list[DataFrame]) -> DataFrame:
    """(distinct_choices) over the best splits of repeated runs: 1 if they agree."""
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return every.distinct().agg(F.count(F.lit(1)).alias("distinct_choices"))
