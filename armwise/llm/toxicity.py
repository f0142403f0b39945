"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine over a block-max inverted index.

Every term of the examples counts, with the weight (1 + ln tf) * idf, and a text's neighbours are the examples of
greatest cosine. The index keeps each term's examples in ascending order, cut into runs by block of examples, and
the greatest weight of each run (terms that more than one in COMMON examples have: a row of weights for each
example, and of maxima for each block). A search adds a text's weights times these maxima to an upper bound of
every block's cosines. The blocks of highest bound are opened first; then all whose bound reaches the k-th best
cosine so far. The others cannot hold a nearer example, so the result is that of comparing all examples.

A neighbour's vote is its cosine times what the two texts share of terms that go with the label: the cosine of
the same weights times relevance, the term's chi-square share (how much of the label's variance its presence
explains). Votes stand against a prior of the label's share. A monotone map, fitted on scores of examples that
leave their own vote out, turns the votes' share into the rate of the label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm import common as C

#: Labelled rows that the model is fitted on, at most (all of them up to that number), and of these the rows
#: that the calibration is fitted on.
MOST_EXAMPLES, CALIBRATION = 3_000, 2_000
NEIGHBOURS, PRIOR_WEIGHT, BLOCK, FIRST_BLOCKS, COMMON = 100, 0.25, 32, 8, 16
#: Least number of scores in a step of the calibration.
STEP = 40
#: Characters and texts that are searched in one product.
HELD, TOGETHER = 1 << 20, 128
_U = np.uint64
#: Bytes of terms: ASCII letters and all bytes of letters beyond ASCII; the others separate terms.
_TERMS = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))


def term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term, count) of the distinct terms of each text, by text and term; terms as 64-bit hashes."""
    words, n = C.hash_words([(t or "").lower().encode("utf-8", "replace").translate(_TERMS) for t in texts])
    row = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((words, row))
    row, words = row[order], words[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (words[1:] != words[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], words[new], np.diff(np.append(new, len(row)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each size, joined."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _unit(row: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Weights of n texts scaled to length 1 in each."""
    return w / np.maximum(np.sqrt(np.bincount(row, weights=w * w, minlength=n)), 1e-300)[row]


@dataclass
class Index:
    terms: np.ndarray
    relevance: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    #: Postings by term, from ``posting_of`` on: examples in ascending order and their weights.
    posting_of: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    #: What turns an example's weights times relevance into its weights as evidence.
    scale: np.ndarray
    #: Steps of the calibration: votes' shares and rates of the label.
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        n, df = len(self.ids), np.diff(self.posting_of)
        self.prior = float(self.labels.sum()) / n if n else 0.0
        self.idf = np.log((n + 1) / np.maximum(df, 1))
        #: Blocks opened, and all blocks, of the searches so far.
        self.opened = self.searched = 0
        #: Column of each term in ``common`` (examples by common terms) and ``common_max`` (blocks by them), or -1.
        often = df * COMMON > n
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        term = np.repeat(np.arange(len(df)), df)
        evidence, dense = self.weights * self.relevance[term] * self.scale[self.examples], often[term]
        self.common, self.common_evidence = np.zeros((2, n, int(often.sum())))
        cells = self.examples[dense], self.column[term[dense]]
        self.common[cells], self.common_evidence[cells] = self.weights[dense], evidence[dense]
        self.common_max = np.maximum.reduceat(self.common, np.arange(0, n, BLOCK)) if n else self.common
        #: Postings of the other terms; runs of a term in a block of examples (``run_of`` gives each term's first
        #: run): block, greatest weight, and where its postings begin.
        term, self.rare, self.rare_weights, self.rare_evidence = term[~dense], self.examples[~dense], self.weights[~dense], evidence[~dense]
        block = self.rare // BLOCK
        new = np.flatnonzero(_changes(term, block))
        self.run_of, self.run_block = np.searchsorted(term[new], np.arange(len(df) + 1)), block[new]
        self.run_max = np.maximum.reduceat(self.rare_weights, new) if len(new) else np.zeros(0)
        self.run_begin = np.append(new, len(term))

    def __reduce__(self):
        """Travels as its postings; what is derived from them is made anew where it arrives."""
        return Index, tuple(getattr(self, f.name) for f in fields(self))

    def weigh(self, row: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Of n texts, by text: the known terms' text, place, weight, and weight as evidence (each of length 1 a text)."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        row, at = row[known], at[known]
        w = (1 + np.log(counts[known])) * self.idf[at]
        return row, at, _unit(row, w, n), _unit(row, w * self.relevance[at], n)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Places of some examples."""
        order = np.argsort(self.ids, kind="stable")
        return order[np.searchsorted(self.ids, ids, sorter=order)]

    def search(self, row: np.ndarray, at: np.ndarray, w: np.ndarray, evidence: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, ...]]:
        """For each of n texts, the k examples of greatest cosine above 0 (ties: smaller place), the cosines, and
        the cosines of the weights as evidence."""
        size, blocks = len(self.ids), len(self.common_max)
        column = self.column[at]
        often = column >= 0
        dense, dense_evidence = np.zeros((2, n, self.common.shape[1]))
        dense[row[often], column[often]], dense_evidence[row[often], column[often]] = w[often], evidence[often]
        rare = at[~often]
        n_runs = self.run_of[rare + 1] - self.run_of[rare]
        runs, text = _ranges(self.run_of[rare], n_runs), np.repeat(row[~often], n_runs)
        heavy, telling = np.repeat(w[~often], n_runs), np.repeat(evidence[~often], n_runs)
        block = self.run_block[runs]
        bound = dense @ self.common_max.T + np.bincount(text * blocks + block, weights=heavy * self.run_max[runs], minlength=n * blocks).reshape(n, blocks)
        cosines, shared, opened = np.zeros((n, size)), np.zeros((n, size)), np.zeros((n, blocks), bool)

        def open_blocks(new: np.ndarray) -> np.ndarray:
            """The cosines of these blocks' examples; each text's k-th best so far, or what counts as above 0."""
            some = np.flatnonzero(new[text, block])
            first = self.run_begin[runs[some]]
            length = self.run_begin[runs[some] + 1] - first
            place = _ranges(first, length)
            cell = np.repeat(text[some] * size, length) + self.rare[place]
            cosines.reshape(-1)[:] += np.bincount(cell, weights=self.rare_weights[place] * np.repeat(heavy[some], length), minlength=n * size)
            shared.reshape(-1)[:] += np.bincount(cell, weights=self.rare_evidence[place] * np.repeat(telling[some], length), minlength=n * size)
            for b in np.flatnonzero(new.any(axis=0)):
                texts, part = np.flatnonzero(new[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                cosines[texts, part] += dense[texts] @ self.common[part].T
                shared[texts, part] += dense_evidence[texts] @ self.common_evidence[part].T
            opened[new] = True
            best = np.partition(cosines, size - k, axis=1)[:, size - k] if size >= k else np.zeros(n)
            return np.maximum(best - 1e-9, 1e-12)

        leading = np.zeros((n, blocks), bool)
        np.put_along_axis(leading, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        least = open_blocks(leading)
        least = open_blocks(~opened & (bound >= least[:, None]))
        self.opened, self.searched = self.opened + int(opened.sum()), self.searched + opened.size
        out = []
        for i, cosine in enumerate(cosines):
            found = np.flatnonzero(cosine >= least[i])
            best = found[np.lexsort((found, -np.round(cosine[found], 12)))[:k]]
            out.append((best, cosine[best], shared[i, best]))
        return out

    def shares(self, row: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, without: list[int] | None = None) -> list[tuple[float, np.ndarray]]:
        """For each of n texts, the votes' share for the label, and the examples that vote, greatest vote first.

        The examples ``without`` have no vote.
        """
        none, out = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)), []
        found = self.search(*self.weigh(row, terms, counts, n), n, NEIGHBOURS + (without is not None)) if len(self.ids) else [none] * n
        for (places, cosines, shared), own in zip(found, without or [-1] * n, strict=True):
            votes = np.where(places == own, 0.0, np.round(cosines * shared, 12))
            share = float(votes @ self.labels[places] + PRIOR_WEIGHT * self.prior) / float(votes.sum() + PRIOR_WEIGHT)
            out.append((share, places[np.lexsort((places, -votes))][: np.count_nonzero(votes)]))
        return out

    def calibrated(self, share: float) -> float:
        return float(np.interp(share, self.steps, self.rates)) if len(self.steps) else share

    def score(self, texts: list[str | None]) -> tuple[list[float], list[list[int]]]:
        """Scores of the texts, and the ids of the three neighbours of each that have the greatest votes."""
        found = self.shares(*term_counts(texts), len(texts))
        return [self.calibrated(s) for s, _ in found], [self.ids[p[:3]].tolist() for _, p in found]


def build(ids: np.ndarray, labels: np.ndarray, row: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> Index:
    """From the examples' ids and labels and their distinct terms (example, term, count), by example."""
    n, positive = len(ids), float(labels.sum())
    names, at = np.unique(terms, return_inverse=True)
    df = np.bincount(at, minlength=len(names)).astype(float)
    pos = np.bincount(at, weights=labels[row], minlength=len(names))
    margins = df * (n - df) * positive * (n - positive)
    with np.errstate(divide="ignore", invalid="ignore"):
        relevance = np.where(margins > 0, (pos * n - df * positive) ** 2 / margins, 0.0)
    idf = np.log((n + 1) / np.maximum(df, 1))
    w = (1 + np.log(counts)) * idf[at]
    w = _unit(row, w, n)
    scale = 1 / np.maximum(np.sqrt(np.bincount(row, weights=(w * relevance[at]) ** 2, minlength=n)), 1e-300)
    # Examples that have their heaviest term in common become neighbours, so that blocks differ in their maxima.
    heaviest = np.full(n, -1)
    by = np.lexsort((w, row))
    heaviest[row[by]] = at[by]
    order = np.lexsort((ids, heaviest))
    ids, labels = ids[order], labels[order]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    row = place[row].astype(np.int32)
    by = np.lexsort((row, at))
    return Index(names, relevance, ids, labels, np.append(0, np.cumsum(df.astype(np.int64))), row[by], w[by], scale[order])


def _changes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.ones(len(a), bool)
    out[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return out


def calibrate(shares: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising map from votes' shares to rates of the label: steps of at least STEP scores, pooled until they rise."""
    order = np.argsort(shares, kind="stable")
    shares, labels = shares[order], labels[order]
    pools: list[list[float]] = []  # sum of labels, number, sum of shares
    start = 0
    while start < len(shares):
        stop = max(start + STEP, int(np.searchsorted(shares, shares[min(start + STEP, len(shares)) - 1], side="right")))
        stop = len(shares) if len(shares) - stop < STEP else stop
        pools.append([labels[start:stop].sum(), stop - start, shares[start:stop].sum()])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        start = stop
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


_COUNTED = "id bigint, label int, terms array<bigint>, counts array<int>"


def _pieces(texts: list[str | None]):
    """Bounds of runs of up to TOGETHER texts with up to HELD characters, or of one longer text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text or "") > HELD or i - start >= TOGETHER):
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def _counted(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for start, stop in _pieces(texts):
            row, terms, counts = term_counts(texts[start:stop])
            off = np.searchsorted(row, np.arange(stop - start + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(start, stop - start) for c in ("id", "label")] + [C.lists(terms.view(np.int64), off, pa.int64()), C.lists(counts.astype(np.int32), off, pa.int32())],
                names=["id", "label", "terms", "counts"],
            )


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """Index over about ``most`` labelled rows of ``docs``, chosen by a hash of the id.

    A document with several labels counts as the greatest of them; null labels and ids are left out; rows
    that share an id are one example each. Ids are integers. The driver gets the chosen examples' distinct
    terms, and in a second job CALIBRATION scores of theirs.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(marks, "id")
    n = docs.select(F.col(id_col).cast("bigint").alias("id")).join(marks, "id").count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    examples = C.written(known.mapInArrow(_counted, _COUNTED), "examples")
    table = examples.toArrow().sort_by("id")
    sizes = C.sizes(table["terms"])
    row = np.repeat(np.arange(len(table)), sizes)
    marked = np.asarray(table["label"]).astype(float)
    index = build(np.asarray(table["id"]).astype(np.int64), marked, row, C.unsigned(C.flat(table["terms"])), C.flat(table["counts"]).astype(np.int64))
    if 0 < marked.sum() < len(marked):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def left_out(batches):
            model = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, TOGETHER):
                    batch = whole.slice(start, TOGETHER)
                    row, own = np.repeat(np.arange(batch.num_rows), C.sizes(batch.column("terms"))), model.places(batch.column("id").to_numpy())
                    terms, counts = C.unsigned(C.flat(batch.column("terms"))), C.flat(batch.column("counts")).astype(np.int64)
                    found = [share for share, _ in model.shares(row, terms, counts, batch.num_rows, own.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("label")], names=["share", "label"])

        some = examples.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < int(min(1.0, CALIBRATION / len(marked)) * (1 << 20)))
        # Dealt out anew: a bounded table has few files, and its texts' searches are the work.
        scores = some.repartition(C.buckets(docs.sparkSession, 1)).mapInArrow(left_out, "share double, label int").toArrow()
        index.steps, index.rates = calibrate(np.asarray(scores["share"]), np.asarray(scores["label"]).astype(float))
    return index


def score_texts(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1) and evidence, the ids of the up to three neighbours
    that have the greatest votes (ties: smaller place in the index).

    Null and empty texts, and texts without a known term, get the prior's rate. Rows that repeat are scored
    each; an empty table gives an empty result; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            scores, near = [], []
            for start, stop in _pieces(texts):
                some = model.score(texts[start:stop])
                scores, near = scores + some[0], near + some[1]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64()))], names=[id_col, "score", "evidence"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, evidence array<bigint>")
