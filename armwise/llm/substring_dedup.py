"""Removal of long repeated passages: word k-mers as De Bruijn edges, compacted paths, checked at their coordinates.

Every run of ``width`` words is an edge between the nodes of ``width - 1`` words at its ends. Consecutive
edges that share their smallest inner n-gram (the anchor) travel as one record, and records are dealt out
by anchor: all copies of an edge meet in one bucket. There, every occurrence but the earliest becomes a
piece: where it is, and the source coordinates (document and start) of the earliest one. Pieces of one
document that follow each other compact into a path while their sources follow each other as well, that
is up to the node at which copy and source branch, whichever buckets the pieces come from. Paths then join
the texts, in both of their places; digests of the words there are compared, and only equal words go.

Paths are compacted for each copy beside its source. The graph has no other unitigs: nodes are never
stored, and their degrees over the whole corpus not counted, as the rows to give do not depend on them.

Hot passages: each task sends one record for an edge that it meets many times, the earliest one, and
turns the others into pieces itself, so a passage in a third of all rows reaches a bucket once per task.
Hot anchors: the windows of each anchor are counted first, and an anchor with more than a bucket's share
is dealt out by whole edges; there are no more such anchors than buckets.

An edge is known by 64 bits of its anchor and ``edge_bits`` of its own hash. Different windows that agree in
all these bits show in the digests: their path is then taken apart and each window compared by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armwise.llm import common as C

ANCHOR = 8
#: Bytes of text that a task holds at once.
HELD = 6 << 20
#: Windows up to which an anchor stays whole, whatever the bucket's share.
WHOLE = 4096
_SENT = (
    "bucket int, doc array<bigint>, start array<int>, n array<int>, anchor array<bigint>, edge array<int>, edge_high array<smallint>,"
    "source array<bigint>, source_start array<int>"
)
_PIECE = "doc bigint, start int, n int, source bigint, source_start int"


def _later(anchor, edge, doc, start):
    """Indices of the occurrences of an edge that are not its earliest, and those of the earliest ones."""
    order = np.argsort(C.mix(anchor + edge * np.uint64(0x9E3779B97F4A7C15)))
    a, e = anchor[order], edge[order]
    new, size = _runs(np.concatenate([[True], (a[1:] != a[:-1]) | (e[1:] != e[:-1])]) if len(order) else np.zeros(0, bool))
    group = np.repeat(np.arange(len(new)), size)
    many = (size > 1)[group]
    hit, group = order[many], group[many]
    by = np.lexsort((start[hit], doc[hit], group))
    hit, group = hit[by], group[by]
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(hit) else np.zeros(0, bool)
    lead = hit[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]
    return hit[~first], lead[~first]


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(breaks)
    return at, np.diff(np.append(at, len(breaks)))


def _pieces(doc, start, source, source_start):
    """Columns of pieces: runs of edges that follow each other both in their document and in their source."""
    by = np.lexsort((start, doc))
    doc, start, source, source_start = doc[by], start[by], source[by], source_start[by]
    steps = (start[1:] != start[:-1] + 1) | (source_start[1:] != source_start[:-1] + 1)
    at, n = _runs(np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | steps]) if len(doc) else np.zeros(0, bool))
    return doc[at], start[at], n, source[at], source_start[at]


def _windows(batches, width: int, id_col: str, text_col: str):
    """For each group of texts: anchor, edge, document and start of the windows to send, and the pieces found in the group."""
    for ids, texts in C.text_chunks(batches, [id_col, text_col], text_col, HELD):
        words, counts = C.hash_words(texts)
        ok = C.inside(counts, width)
        if not ok.any():
            continue
        edge = C.window_hashes(words, width)[ok]
        anchor = C.sliding_min(C.window_hashes(words, ANCHOR), width - ANCHOR + 1)[ok]
        at = np.flatnonzero(ok)
        row = np.repeat(np.arange(len(counts)), counts)[at]
        start = (at - (np.cumsum(counts) - counts)[row]).astype(np.int32)
        doc = C.id_array(ids)[row]
        later, lead = _later(anchor, edge, doc, start)
        found = _pieces(doc[later], start[later], doc[lead], start[lead])
        sent = np.ones(len(edge), bool)
        sent[later] = False
        yield anchor[sent], edge[sent], doc[sent], start[sent], found


def _shares(n_buckets: int, width: int, id_col: str, text_col: str):
    """Anchors that have more than a bucket's share of a group's windows, and (without anchor) the number of all."""

    def run(batches):
        for anchor, *_ in _windows(batches, width, id_col, text_col):
            values, n = np.unique(anchor, return_counts=True)
            hot = n * n_buckets > len(anchor)
            rows = [None, *values[hot].view(np.int64).tolist()], [len(anchor), *n[hot].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64())], names=["anchor", "n"])

    return run


def hot_anchors(docs: DataFrame, n_buckets: int, width: int, id_col: str, text_col: str) -> np.ndarray:
    """Anchors with more than a bucket's share of all windows; there are fewer than ``n_buckets``.

    An anchor that stays below the share in every group of texts is below it in all; one that is left out
    has less than twice the share.
    """
    counts = docs.select(id_col, text_col).mapInArrow(_shares(n_buckets, width, id_col, text_col), "anchor bigint, n bigint")
    top = counts.groupBy("anchor").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.col("anchor").asc_nulls_first()).limit(n_buckets + 1).collect()
    total = sum(r.n for r in top if r.anchor is None)
    hot = [r.anchor for r in top if r.anchor is not None and r.n > max(WHOLE, total / n_buckets)]
    return np.array(hot, np.int64).view(np.uint64)


def _edges(n_buckets: int, width: int, id_col: str, text_col: str, hot: np.ndarray, edge_bits: int):
    low = np.uint64((1 << edge_bits) - 1)

    def run(batches):
        for anchor, edge, doc, start, found in _windows(batches, width, id_col, text_col):
            if len(found[0]):  # already known to repeat: passed on as pieces, without edges
                d, s, n, source, source_start = found
                yield _records(C.bucket_of(C.mix(d.view(np.uint64)), n_buckets), d, s, n, source=source, source_start=source_start)
            spread = np.isin(anchor, hot)
            steps = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | spread[1:]
            at, n = _runs(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | steps]))
            key = np.where(spread[at], C.mix(anchor[at]) ^ edge[at] & low, anchor[at])
            yield _records(C.bucket_of(C.mix(key), n_buckets), doc[at], start[at], n, anchor=anchor[at], edge=edge & low)

    return run


def _records(bucket, doc, start, n, anchor=None, edge=None, source=None, source_start=None):
    """One row for each bucket: runs of edges, or pieces (which have a source in the place of edges)."""
    order = np.argsort(bucket, kind="stable")
    at, _ = _runs(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
    off = np.append(at, len(bucket))
    none, edge_off = np.zeros(len(off), np.int64), np.zeros(len(off), np.int64)
    if edge is not None:
        first, m = np.cumsum(n) - n, n[order]
        edge = edge[np.repeat(first[order] - (np.cumsum(m) - m), m) + np.arange(len(edge))]
        edge_off = np.concatenate([[0], np.cumsum(m)])[off]
    else:
        edge = np.zeros(0, np.uint64)

    def column(values, kind):
        return C.lists(np.zeros(0, np.int64) if values is None else C.signed(values[order]), none if values is None else off, kind)

    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[order][at]),
            column(doc, pa.int64()),
            column(start, pa.int32()),
            column(n.astype(np.int32), pa.int32()),
            column(anchor, pa.int64()),
            C.lists(edge.astype(np.uint32).view(np.int32), edge_off, pa.int32()),
            C.lists((edge >> np.uint64(32)).astype(np.uint16).view(np.int16), edge_off, pa.int16()),
            column(source, pa.int64()),
            column(source_start, pa.int32()),
        ],
        names=["bucket", "doc", "start", "n", "anchor", "edge", "edge_high", "source", "source_start"],
    )


def _repeats(table: pa.Table) -> pa.Table:
    """The pieces of one bucket: edges that occur earlier elsewhere, and pieces that tasks found themselves."""
    doc, start, n = (C.flat(table[c]) for c in ("doc", "start", "n"))
    known = np.repeat(C.sizes(table["source"]) > 0, C.sizes(table["doc"]))
    out = [(doc[known], start[known], n[known], C.flat(table["source"]), C.flat(table["source_start"]))]
    m = n[~known]
    inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    docs, starts = np.repeat(doc[~known], m), (np.repeat(start[~known], m) + inner).astype(np.int32)
    edge = C.flat(table["edge"]).astype(np.int32).view(np.uint32).astype(np.uint64)
    edge |= C.flat(table["edge_high"]).astype(np.int16).view(np.uint16).astype(np.uint64) << np.uint64(32)
    later, lead = _later(np.repeat(C.unsigned(C.flat(table["anchor"])), m), edge, docs, starts)
    out.append(_pieces(docs[later], starts[later], docs[lead], starts[lead]))
    kinds = (np.int64, np.int32, np.int32, np.int64, np.int32)
    return pa.table([np.concatenate(x).astype(k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc", "start", "n", "source", "source_start"])


def repeated_paths(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", edge_bits: int = 48) -> DataFrame:
    """Rows (doc, start, n, source, source_start): n windows of ``width`` words from ``start`` on that repeat, by
    their hashes, the windows from ``source_start`` on in the document ``source``, which come earlier.

    Every window that is not the first of its kind is in one path. A source may repeat a still earlier one.
    Null texts have no words. Ids are integers, one for each row, and their order is that of the documents
    (``C.keyed`` makes such a column of any ids). An empty table gives no rows.
    """
    n = C.buckets(docs.sparkSession)
    hot = hot_anchors(docs, n, width, id_col, text_col)
    sent = docs.select(id_col, text_col).mapInArrow(_edges(n, width, id_col, text_col, hot, edge_bits), _SENT)
    pieces = sent.groupBy("bucket").applyInArrow(_repeats, _PIECE)
    along = Window.partitionBy("doc").orderBy("start")
    goes_on = (
        (F.lag(F.col("start") + F.col("n")).over(along) == F.col("start"))
        & (F.lag("source").over(along) == F.col("source"))
        & (F.lag(F.col("source_start") + F.col("n")).over(along) == F.col("source_start"))
    )
    pieces = pieces.withColumn("opens", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("opens").over(along))
    first = [F.min(c).alias(c) for c in ("source", "source_start")]
    return pieces.groupBy("doc", "path").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), *first).drop("path")


def _cut(width: int, id_col: str, text_col: str, texts_out: bool, kind: str):
    """Removes the words of a document's paths; ``checks`` has a digest of the words of each path, by its source."""

    def run(batches):
        for batch in batches:
            asks = batch.column("asks")
            size = np.asarray(pc.fill_null(pc.list_value_length(asks), 0)).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(size)])
            flat = asks.flatten()
            start, n, source, source_start = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "source", "source_start"))
            rows, digests = [], []
            for i, (doc, text) in enumerate(zip(batch.column("doc").to_pylist(), batch.column(text_col).to_pylist(), strict=True)):
                words = (text or "").encode().split()
                own = slice(off[i], off[i + 1])
                from_, to = start[own], start[own] + n[own] + (width - 1)
                for x, y in zip(from_.tolist(), to.tolist(), strict=True):
                    digests.append(hashlib.blake2b(b" ".join(words[x:y]), digest_size=16).digest())
                repeats = (source[own] != doc) | (source_start[own] != from_)  # a path that is its own source stays
                kept = words
                if repeats.any():
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, from_[repeats], 1)
                    np.add.at(change, to[repeats], -1)
                    kept = [words[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), joined.decode() if texts_out else None, hashlib.sha256(joined).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            checks = pa.StructArray.from_arrays(
                [pa.array(source, pa.int64()), pa.array(source_start, pa.int32()), pa.array(n, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                names=["source", "source_start", "n", "a", "b"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array(cols[0], pa.int64()),
                    pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.string()),
                    pa.array(cols[3], pa.string()),
                    pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), checks),
                ],
                names=[id_col, "n_words", "n_removed", "kept", "kept_sha256", "checks"],
            )

    return run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string, checks array<struct<source bigint, source_start int, n int, a bigint, b bigint>>"


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = True, edge_bits: int = 48) -> DataFrame:
    """One row per document: n_words, n_removed, kept (the words that stay, joined by one space) and its SHA-256.

    Texts meet their paths once and are written cut, with the digests; where a path's words differ from its
    source's, they are cut again without it. Rows that share an id are documents of their own; rows without
    an id come last. Null texts have no words; other columns are not read; an empty table gives an empty result.
    """
    rows, _ = C.keyed(docs, id_col)
    paths = C.written(repeated_paths(rows, width, C.KEY, text_col, edge_bits), "paths")
    rows = rows.select(F.col(id_col), F.col(text_col), F.col(C.KEY).alias("doc"))
    cut, out = _cut(width, id_col, text_col, texts_out, dict(docs.dtypes)[id_col])
    place = ["source", "source_start", "n"]
    while True:
        sources = paths.select(*place).distinct().select(F.col("source").alias("doc"), F.col("source_start").alias("start"), "n", "source", "source_start")
        asks = paths.unionByName(sources).groupBy("doc").agg(F.collect_list(F.struct("start", "n", "source", "source_start")).alias("asks"))
        done = C.written(rows.join(asks, "doc", "left").mapInArrow(cut, out), "cut")
        ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "ab"]
        unlike = done.select(F.inline("checks")).groupBy(*place).agg(*ends).where("min_a <> max_a or min_b <> max_b").select(*place)
        unlike = C.written(unlike, "unlike")
        if unlike.isEmpty():
            return done.drop("checks")
        apart = paths.join(unlike, place, "left_semi").where("n > 1").withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
        apart = apart.select("doc", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("n"), "source", (F.col("source_start") + F.col("i")).alias("source_start"))
        paths = C.written(paths.join(unlike, place, "left_anti").unionByName(apart), "paths")
