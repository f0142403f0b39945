"""Forests of array-encoded uplift trees: schema, JSON, checks and node tables."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armwise.sources import sinks

# The fields of a tree and the JSON schema of a forest.
FIELDS = ["node_type", "feature_idx", "thresholds", "cat_value", "left_child", "right_child", "nan_goes_left", "leaf_response_rates"]
JSON_SCHEMA = (
    "array<struct<node_type array<bigint>, feature_idx array<bigint>, thresholds array<double>, cat_value array<double>, left_child array<bigint>, right_child array<bigint>, "
    "nan_goes_left array<boolean>, leaf_response_rates array<array<double>>>>"
)
LEAF, CONTINUOUS, CATEGORICAL = 0, 1, 2


def as_arrays(tree: dict) -> dict[str, np.ndarray]:
    kinds = {"node_type": np.int8, "feature_idx": np.int64, "thresholds": np.float64, "left_child": np.int64, "right_child": np.int64, "nan_goes_left": bool, "leaf_response_rates": np.float64}
    missing = [f for f in FIELDS if f not in tree]
    if missing:
        raise ValueError(f"tree lacks {', '.join(missing)}")
    return {f: np.asarray(tree[f], dtype=kinds.get(f)) for f in FIELDS}


def validate(forest: list[dict], n_features: int) -> list[dict[str, np.ndarray]]:
    """The trees as arrays; ValueError for one that cannot be walked. Runs before anything is shipped."""
    trees = [as_arrays(t) for t in forest]
    if not trees:
        raise ValueError("a forest has one tree or more")
    widths = set()
    for k, t in enumerate(trees):
        n, rates = len(t["node_type"]), t["leaf_response_rates"]
        if n < 1 or any(t[f].ndim != 1 or len(t[f]) != n for f in FIELDS[:-1]) or rates.ndim != 2 or len(rates) != n or rates.shape[1] < 1:
            raise ValueError(f"tree {k}: its arrays differ in length or are empty")
        if not np.isin(t["node_type"], (LEAF, CONTINUOUS, CATEGORICAL)).all():
            raise ValueError(f"tree {k}: unknown node type")
        inner = t["node_type"] != LEAF
        if ((t["feature_idx"][inner] < 0) | (t["feature_idx"][inner] >= n_features)).any():
            raise ValueError(f"tree {k}: feature index outside the {n_features} features")
        children = np.concatenate([t["left_child"][inner], t["right_child"][inner]])
        if ((children < 0) | (children >= n)).any():
            raise ValueError(f"tree {k}: child outside the tree")
        front = {0}
        for _ in range(n):
            front = {int(c) for i in front if inner[i] for c in (t["left_child"][i], t["right_child"][i])}
        if front:
            raise ValueError(f"tree {k}: a walk does not end")
        widths.add(rates.shape[1])
    if len(widths) > 1:
        raise ValueError("trees differ in their number of arms")
    return trees


def to_json(forest: list[dict]) -> str:
    return json.dumps([{f: np.asarray(t[f]).tolist() for f in FIELDS} for t in forest])


def nodes(spark: SparkSession, text: str) -> DataFrame:
    """One row per node of a forest in JSON: tree, node and the tree's fields at that node."""
    one = spark.range(1).select(F.posexplode(F.from_json(F.lit(text), JSON_SCHEMA)).alias("tree", "t"))
    zipped = F.arrays_zip(*[F.col(f"t.{f}").alias(f) for f in FIELDS])
    return one.select("tree", F.posexplode(zipped).alias("node", "n")).select("tree", "node", "n.*")


def invalid_nodes(table: DataFrame, n_features: int) -> DataFrame:
    """Rows of a node table that break a rule: type, feature, children, width of the leaf vector."""
    sizes = table.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    width = table.agg(F.max(F.size("leaf_response_rates"))).scalar()
    inner = F.col("node_type") != LEAF
    outside = lambda c, top: (F.col(c) < 0) | (F.col(c) >= top)
    bad = ~F.col("node_type").isin(LEAF, CONTINUOUS, CATEGORICAL) | (inner & (outside("feature_idx", n_features) | outside("left_child", F.col("size")) | outside("right_child", F.col("size")))) | (F.size("leaf_response_rates") != width)
    return table.join(sizes, "tree").where(bad).drop("size")


def tree_table(spark: SparkSession, forest: list[dict]) -> DataFrame:
    """(tree, text): a row for each tree, as JSON; for forests that no driver holds, such a table is made by Spark."""
    return spark.createDataFrame([(k, to_json([t])) for k, t in enumerate(forest)], "tree int, text string")


def checked(trees: DataFrame, n_features: int) -> DataFrame:
    """A table of trees as it is; a tree that cannot be walked fails the job that reads it."""

    def run(batches):
        for batch in batches:
            for tree, text in zip(batch.column("tree").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    validate(json.loads(text), n_features)
                except ValueError as e:
                    raise ValueError(f"row {tree}: {e}") from e
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("text")], names=["tree", "text"])

    return trees.select("tree", "text").mapInArrow(run, "tree int, text string")


def node_faults(table: DataFrame, max_depth: int) -> DataFrame:
    """(tree, node, fault) of a table of nodes (tree, node, node_type, left_child, right_child), however large its trees.

    ``child_outside``: an inner node with a child that the tree lacks; ``root_has_parent``; ``two_parents``: more
    than one link leads to the node; ``cycle``: the way up, by the least parent, never ends; ``unreachable``: it
    ends elsewhere than at node 0; ``too_deep``: it has more than ``max_depth`` steps. A node may have several
    faults; a sound forest, and an empty one, have none.

    The ways up are found by pointer jumping: each round doubles all open ones by a join on the node they have
    reached. Those that have ended leave the join, so the root, where most end, is never looked up. All joins are
    merged: node tables are so alike that millions of rows are a file of a few MB, which Spark would broadcast.
    """
    nodes = sinks.kept(table.select("tree", "node", "node_type", "left_child", "right_child"), "nodes")
    links = nodes.where(F.col("node_type") != LEAF).select("tree", F.col("node").alias("parent"), F.explode(F.array("left_child", "right_child")).alias("node"))
    links = links.select("tree", "parent", F.col("node").cast(dict(nodes.dtypes)["node"]).alias("node"))
    met = links.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("links"), F.min("parent").alias("parent"))
    rows = nodes.select("tree", "node").distinct().join(met.hint("merge"), ["tree", "node"], "left")
    parent = F.when(F.col("node") != 0, F.col("parent"))
    rows = sinks.kept(rows.select("tree", "node", "links", F.coalesce(parent, "node").alias("top"), parent.isNotNull().cast("bigint").alias("steps"), parent.isNotNull().alias("open")), "ways")

    most, reach = rows.groupBy("tree").count().agg(F.max("count")).first()[0] or 0, 1
    while reach <= most and not rows.where("open").isEmpty():
        ahead = rows.select("tree", F.col("node").alias("top"), F.col("top").alias("far"), F.col("steps").alias("more"), F.col("open").alias("on"))
        gone = rows.where("open").join(ahead.hint("merge"), ["tree", "top"])
        gone = gone.select("tree", "node", "links", F.col("far").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("on").alias("open"))
        rows, reach = sinks.kept(rows.where("not open").unionByName(gone), "ways"), 2 * reach

    when = lambda test, fault: F.when(test, F.lit(fault))
    n_links = F.coalesce("links", F.lit(0))
    faults = F.array(
        when((F.col("node") == 0) & (n_links > 0), "root_has_parent"), when(n_links > 1, "two_parents"), when(F.col("open"), "cycle"),
        when(~F.col("open") & (F.col("top") != 0), "unreachable"), when(~F.col("open") & (F.col("top") == 0) & (F.col("steps") > max_depth), "too_deep"),
    )
    found = rows.select("tree", "node", F.explode(F.array_compact(faults)).alias("fault"))
    lost = links.join(nodes.select("tree", "node").hint("merge"), ["tree", "node"], "left_anti").select("tree", F.col("parent").alias("node"), F.lit("child_outside").alias("fault")).distinct()
    return found.unionByName(lost)
