"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm import common as C


def _forest(batches):
    """Each task's edges as stars: to the smallest node that the task connects them with."""
    pairs = [(np.asarray(b.column("a"), np.int64), np.asarray(b.column("b"), np.int64)) for b in batches]
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[root[keep]]), pa.array(nodes[keep])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b bigint); the component is its smallest node.

    Each round hangs every neighbour of a node that is larger than it on its smallest neighbour, then
    every smaller one. Rounds go on until nothing changes, which takes about log(n)**2 of them at most.
    """
    kind = "a bigint, b bigint"
    now = C.written(edges.select("a", "b").where("a <> b").mapInArrow(_forest, kind).distinct(), "edges")
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("a"), "b").union(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b")
        small = small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = C.written(small, "edges")
        facts = [t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")) for t in (now, new)]
        before, after = (f.first() for f in facts)
        now = new
        if tuple(before) == tuple(after):
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a")).distinct()


def absorbed(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``known`` (node, component) after more links (a, b).

    Only links between different components are contracted, as links of the components' names; nodes that are
    not in ``known`` are components of their own. A component of very many nodes is one hot key of the last
    join, whose other side has a row for each merged component: Spark broadcasts it, or splits the hot key.
    """
    one = known.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    across = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(across.where("a <> b").distinct())
    name = merged.select(F.col("node").alias("component"), F.col("component").alias("merged"))
    moved = known.join(name, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    return C.written(moved.union(merged.join(known, "node", "left_anti").select("node", "component")), "components")
