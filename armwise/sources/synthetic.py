"""Synthetic features, observations and forests. A value depends on its row, its use and the seed, on no partitioning."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the described distributions: rates of the outcome (base, rise with the arm, rise with x0, least,
# greatest), shares of the three arms and their outcome rate, range of thresholds, number of categories.
BASE, PER_ARM, PER_X, LEAST, GREATEST = 0.10, 0.10, 0.20, 0.01, 0.95
SHARES, RATE = {"control": 0.50, "t1": 0.25, "t2": 0.25}, 0.3
THRESHOLD, CATEGORIES = 1.0, 4


def _stream(seed: int, *use: object) -> int:
    """The seed of one random column, by what it is used for."""
    return zlib.crc32("/".join(map(str, (seed, *use))).encode())


def _uniform(seed: int, *use: object) -> Column:
    """Counter-based: 53 bits of the hash of the row's number and the stream, as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64("id", F.lit(_stream(seed, *use))), 11) * F.lit(2.0**-53)


def _normal(seed: int, *use: object) -> Column:
    """Standard normal, from two uniform numbers (Box and Muller)."""
    size = F.sqrt(F.log(1.0 - _uniform(seed, *use, "size")) * -2.0)
    return size * F.cos(_uniform(seed, *use, "angle") * (2 * math.pi))


def _gappy(values: Column, rate: float, seed: int, name: str) -> Column:
    """``values``, null with ``rate``."""
    return (F.when(_uniform(seed, name, "present") >= rate, values) if rate else values).alias(name)


def _checked(n_rows: int, n_features: int, missing_rate: float) -> None:
    if n_rows < 0 or n_features < 1 or not 0 <= missing_rate <= 1:
        raise ValueError("n_rows >= 0, n_features >= 1 and 0 <= missing_rate <= 1 are asked for")


def features(
    spark: SparkSession, n_rows: int, n_features: int, missing_rate: float = 0.0, *, seed: int = 7, partitions: int | None = None
) -> DataFrame:
    """f0, f1, ...: standard normal, null with ``missing_rate``."""
    _checked(n_rows, n_features, missing_rate)
    names = [f"f{i}" for i in range(n_features)]
    return spark.range(0, n_rows, 1, partitions).select(*[_gappy(_normal(seed, f, "value"), missing_rate, seed, f) for f in names])


def observations(
    spark: SparkSession, n_rows: int, n_features: int = 1, arms: int = 4, missing_rate: float = 0.0, *, seed: int = 7, partitions: int | None = None
) -> DataFrame:
    """Uniform features x0, x1, ...; arms '0', '1', ...; an outcome whose chance rises with the arm and x0."""
    _checked(n_rows, n_features, missing_rate)
    names = [f"x{i}" for i in range(n_features)]
    drawn = spark.range(0, n_rows, 1, partitions).select(
        *[_gappy(_uniform(seed, x, "value"), missing_rate, seed, x) for x in names],
        (_uniform(seed, "arm") * arms).cast("int").alias("arm"),
        _uniform(seed, "outcome").alias("luck"),
    )
    chance = BASE + PER_ARM * F.col("arm") / arms + PER_X * F.coalesce("x0", F.lit(0.5))
    won = F.col("luck") < F.greatest(F.least(chance, F.lit(GREATEST)), F.lit(LEAST))
    return drawn.select(*names, F.col("arm").cast("string").alias("treatment"), won.cast("double").alias("outcome"))


def three_arms(spark: SparkSession, n_rows: int, missing_rate: float = 0.0, nan_rate: float = 0.0, *, seed: int = 7) -> DataFrame:
    """A normal feature with nulls and NaNs, arms of SHARES, and an outcome that is 1 with RATE."""
    _checked(n_rows, 1, missing_rate + nan_rate)
    drawn = spark.range(n_rows).select(*[_uniform(seed, c).alias(c) for c in ("gap", "arm", "luck")], _normal(seed, "x").alias("x"))
    value = F.when(F.col("gap") >= missing_rate + nan_rate, F.col("x")).when(F.col("gap") >= missing_rate, F.lit(float("nan")))
    arm, upto = F.lit(None).cast("string"), 1.0
    for name, share in reversed(SHARES.items()):  # the last arm first: each earlier one takes its part from below
        upto -= share
        arm = F.when(F.col("arm") >= upto, F.coalesce(arm, F.lit(name))) if upto > 0 else F.coalesce(arm, F.lit(name))
    return drawn.select(value.alias("feature"), arm.alias("treatment"), (F.col("luck") < RATE).cast("double").alias("outcome"))


def _tree(rng: np.random.Generator, depth: int, arms: int, n_features: int, routing: str) -> dict:
    """A complete tree, nodes by level; even inner nodes test a value, odd ones a category; leaves have rates."""
    inner = 2**depth - 1
    node = np.arange(2 * inner + 1)
    at = node < inner
    drawn = lambda values: np.where(at, values, 0)
    ways = {"left": np.ones(len(node), bool), "right": np.zeros(len(node), bool)}
    return {
        "node_type": drawn(1 + node % 2).astype(np.int8), "feature_idx": drawn(rng.integers(0, n_features, len(node))), "thresholds": drawn(rng.uniform(-THRESHOLD, THRESHOLD, len(node))),
        "cat_value": drawn(rng.integers(0, CATEGORIES, len(node)).astype(float)), "left_child": np.where(at, 2 * node + 1, node), "right_child": np.where(at, 2 * node + 2, node),
        "leaf_response_rates": np.where(at[:, None], 0.0, rng.random((len(node), arms))), "nan_goes_left": ways[routing] if routing in ways else rng.integers(0, 2, len(node)).astype(bool),
    }


def forest(depth: int, n_treatments: int, n_trees: int, *, n_features: int = 16, missing_routing: str = "random", seed: int = 13) -> list[dict]:
    """Complete trees with random tests and rates; missing values go left, right, or at random."""
    if missing_routing not in ("left", "right", "random") or min(depth + 1, n_treatments, n_trees, n_features) < 1:
        raise ValueError("depth >= 0, positive sizes and missing_routing left, right or random are asked for")
    return [_tree(np.random.default_rng([seed, k]), depth, n_treatments, n_features, missing_routing) for k in range(n_trees)]
