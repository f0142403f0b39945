"""Scoring tables with a forest: Arrow batches, pandas batches, blocks of trees, or plain column expressions."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armwise.functions.values import imputed, is_missing
from armwise.operators import forest as forests
from armwise.operators import ordinals
from armwise.operators.forest import CATEGORICAL, CONTINUOUS, LEAF, as_arrays, validate
from armwise.sources import sinks
from armwise.sources.views import require


#: Places (rows times trees) that go down together: what they read and write fits the processor's caches.
PLACES = 1 << 17


class Packed:
    """All trees of a forest in flat arrays, one row a node; a leaf is its own child."""

    def __init__(self, trees: list[dict]) -> None:
        sizes = np.array([len(t["node_type"]) for t in trees])
        first = np.concatenate([[0], np.cumsum(sizes)])
        join = lambda f: np.concatenate([t[f] for t in trees])
        kind, self.roots = join("node_type"), first[:-1].astype(np.int32)
        shift, own = np.repeat(first[:-1], sizes), np.arange(first[-1])
        inner = self.inner = kind != LEAF
        self.feature = np.where(inner, join("feature_idx"), 0).astype(np.int32)
        self.equal = kind == CATEGORICAL
        category = np.concatenate([t["cat_value"].astype(float) if (t["node_type"] == CATEGORICAL).any() else np.zeros(len(t["node_type"])) for t in trees])
        self.test = np.where(self.equal, category, join("thresholds"))
        self.missing_left = join("nan_goes_left")
        sides = [np.where(inner, join(f) + shift, own) for f in ("right_child", "left_child")]
        self.child = np.stack(sides, axis=1).astype(np.int32).ravel()
        self.rates = np.concatenate([t["leaf_response_rates"] for t in trees])

    def add(self, x: np.ndarray, total: np.ndarray) -> None:
        """Adds each tree's rates to ``total`` (rows, arms), in the trees' order; ``x`` is (features, rows)."""
        step = max(1, PLACES // len(self.roots))
        for lo in range(0, x.shape[1], step):
            part = np.ascontiguousarray(x[:, lo : lo + step])
            own = total[lo : lo + step]
            for at in self._leaves(part):
                own += self.rates[at]

    def _leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: all places go down a level at a time, with one gather an array."""
        n, values, gaps, any_equal = x.shape[1], x.ravel(), bool(np.isnan(x).any()), bool(self.equal.any())
        at = np.repeat(self.roots, n)
        live, node = None, at  # places that are not at a leaf yet; None for all
        row = np.tile(np.arange(n, dtype=np.int32), len(self.roots))
        while len(node):
            v, test = values[self.feature[node] * n + row], self.test[node]
            left = v <= test
            if any_equal:
                left = np.where(self.equal[node], v == test, left)
            if gaps:
                left |= np.isnan(v) & self.missing_left[node]
            node = self.child[2 * node + left]
            if live is None:
                at = node
            else:
                at[live] = node
            going = self.inner[node]
            if not going.all():
                live = np.flatnonzero(going) if live is None else live[going]
                node, row = node[going], row[going]
        return at.reshape(-1, n)


def _scores(model: Packed, x: list[np.ndarray]) -> np.ndarray:
    total = np.zeros((len(x[0]), model.rates.shape[1]))
    model.add(np.array(x, dtype=float), total)
    return total / len(model.roots)


def _numbers(df: DataFrame, features: list[str]) -> None:
    """Trees compare numbers: a feature of another type (text, dates) is an error before anything runs."""
    require(df, *features)
    if not features:
        raise ValueError("one feature or more is asked for")
    for f in features:
        if not isinstance(df.schema[f].dataType, (T.NumericType, T.BooleanType, T.NullType)):
            raise ValueError(f"feature {f} is {df.schema[f].dataType.simpleString()}, not a number: cast it first")


def _prepared(df: DataFrame, forest: list[dict], features: list[str], out: str):
    _numbers(df, features)
    trees = Packed(validate(forest, len(features)))
    return df.sparkSession.sparkContext.broadcast(trees), _with_scores(df, out)


def _with_scores(df: DataFrame, out: str) -> T.StructType:
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    return T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType(), False), False)])


def _values(batch: pa.RecordBatch, features: list[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]


def _vectors(scores: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel()))


def score_arrow(df: DataFrame, forest: list[dict], features: list[str], out: str = "scores") -> DataFrame:
    """``df`` and the forest's mean response rate of each arm; no shuffle, the forest is broadcast after its checks.

    A forest that a worker cannot hold goes through ``score_blocks``.
    """
    trees, schema = _prepared(df, forest, features, out)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _vectors(_scores(trees.value, _values(batch, features)))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def score_pandas(df: DataFrame, forest: list[dict], features: list[str], out: str = "scores") -> DataFrame:
    trees, schema = _prepared(df, forest, features, out)

    def run(frames):
        for frame in frames:
            yield frame.assign(**{out: list(_scores(trees.value, [frame[f].to_numpy(dtype=float) for f in features]))})

    return df.mapInPandas(run, schema)


def score_blocks(df: DataFrame, trees: DataFrame, features: list[str], out: str = "scores", block: int = 64, chunk: int = 1 << 18) -> DataFrame:
    """The scores of ``score_arrow`` for a forest of any size, a table of trees (tree, text) in the order of ``tree``.

    Rows are dealt into chunks of ``chunk`` by their ordinal, trees into blocks of ``block``. A task reads the rows
    of a chunk, then the blocks one after another, each of which adds its trees to the chunk's totals in order and
    is let go: it holds a chunk and a block, never the forest. Rows move once; a block moves once for each chunk, so
    larger chunks move less. Trees that repeat a number are all counted; a forest without trees is an error.
    """
    _numbers(df, features)
    schema = _with_scores(df, out)
    trees = sinks.kept(forests.checked(trees, len(features)), "trees")
    n_trees = trees.count()
    if not n_trees:
        raise ValueError("a forest has one tree or more")
    place, names = sinks.unused(df, "place"), df.columns
    rows = ordinals.with_ordinal(df, place)
    chunks = max(1, -(-rows.count() // chunk))
    blocks = trees.groupBy((F.floor(F.col("tree") / block) + 1).cast("int").alias("turn")).agg(F.sort_array(F.collect_list(F.struct("tree", "text"))).alias("texts"))
    held = rows.select(F.expr(f"`{place}` div {chunk}").alias("chunk"), F.lit(0).alias("turn"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.lit(None).cast("array<string>").alias("texts"))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))
    blocks = blocks.select(F.explode(every).alias("chunk"), "turn", F.lit(None).cast(held.schema["row"].dataType).alias("row"), F.col("texts.text").alias("texts"))
    dealt = held.unionByName(blocks).repartition(chunks, "chunk").sortWithinPartitions("chunk", "turn")

    def run(batches):
        now, parts, x, total = None, [], None, None

        def scored():
            low = 0
            for part in parts:
                yield pa.RecordBatch.from_arrays([*part.flatten(), _vectors(total[low : low + len(part)] / n_trees)], names=[*names, out])
                low += len(part)

        for batch in batches:
            owner, turn = batch.column("chunk").to_numpy(), batch.column("turn").to_numpy()
            edges = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(turn != 0, prepend=False)).tolist()
            for lo, hi in zip(edges or [0], [*edges[1:], len(owner)], strict=True):
                if now is not None and owner[lo] != now:
                    yield from scored()
                    parts, x, total = [], None, None
                now = owner[lo]
                if turn[lo] == 0:
                    parts.append(batch.column("row").slice(lo, hi - lo))
                    continue
                if not parts:
                    continue
                if x is None:
                    tables = [pa.RecordBatch.from_arrays(p.flatten(), names=names) for p in parts]
                    x = np.concatenate([np.array(_values(t, features), dtype=float) for t in tables], axis=1)
                for texts in batch.column("texts").slice(lo, hi - lo).to_pylist():
                    model = Packed([as_arrays(json.loads(t)[0]) for t in texts])
                    total = np.zeros((x.shape[1], model.rates.shape[1])) if total is None else total
                    model.add(x, total)
        if now is not None and parts:
            yield from scored()

    return dealt.mapInArrow(run, schema)


#: Inner nodes of a forest up to which it is scored by expressions: more would not be compiled any more.
NATIVE_NODES = 256


def score_native(df: DataFrame, forest: list[dict], features: list[str], out: str = "scores") -> DataFrame:
    """The same by nested conditions, for small forests: no Python on the executors.

    Each tree's conditions are evaluated once a row, to its leaf; the leaf's rates are looked up for all arms.
    """
    require(df, *features)
    trees = validate(forest, len(features))
    inner = sum(int((t["node_type"] != LEAF).sum()) for t in trees)
    if inner > NATIVE_NODES:
        raise ValueError(f"{inner} inner nodes are more than {NATIVE_NODES}: use score_arrow")

    def walk(t: dict, i: int) -> Column:
        if t["node_type"][i] == LEAF:
            return F.lit(i)
        x = F.col(features[t["feature_idx"][i]]).cast("double")
        test = x <= F.lit(float(t["thresholds"][i])) if t["node_type"][i] == CONTINUOUS else x == F.lit(float(t["cat_value"][i]))
        go = F.when(is_missing(x), F.lit(bool(t["nan_goes_left"][i]))).otherwise(test)
        return F.when(go, walk(t, int(t["left_child"][i]))).otherwise(walk(t, int(t["right_child"][i])))

    rates = [F.lit(t["leaf_response_rates"].tolist()) for t in trees]
    leaves = df.withColumns({f"__leaf{k}": walk(t, 0) for k, t in enumerate(trees)})
    found = [F.get(r, F.col(f"__leaf{k}")) for k, r in enumerate(rates)]
    total = found[0]
    for more in found[1:]:
        total = F.zip_with(total, more, lambda a, b: a + b)
    mean = F.transform(total, lambda x: x / F.lit(float(len(trees))))
    return leaves.withColumn(out, mean).drop(*[f"__leaf{k}" for k in range(len(trees))])


def mllib_tree(df: DataFrame, features: list[str], label_of: str, out: str = "score") -> DataFrame:
    """A fitted MLlib decision tree's predictions, for comparison: missing values as 0, label ``label_of > 0``."""
    require(df, *features, label_of)
    rows = df.select("*", *[imputed(F.col(f).cast("double")).alias(f"__{f}") for f in features]).withColumn("__label", F.when(F.col(f"__{label_of}") > 0, 1.0).otherwise(0.0))
    tree = DecisionTreeClassifier(featuresCol="__features", labelCol="__label", predictionCol="__prediction", probabilityCol="__probability", rawPredictionCol="__raw", maxDepth=7, maxBins=64, seed=11)
    model = Pipeline(stages=[VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="__features"), tree]).fit(rows)
    return model.transform(rows).select(*df.columns, F.col("__prediction").cast("double").alias(out))
