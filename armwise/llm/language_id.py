"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. An n-gram is the product of its letters' vectors,
each rolled by its place; a text is the sum of its n-grams; a language's prototype is the sum of the
unit vectors of its labelled texts. A text gets the language whose prototype has the greatest cosine.
What all prototypes have in common (their mean) is taken out of both sides first.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm import common as C

DIMENSIONS, GRAM, SEED = 512, 3, 20240607
#: n-grams whose vectors a task remembers.
CACHE = 60_000
#: Weight of an n-gram that a text holds once; that of n is STEPS * sqrt(n), rounded.
STEPS = 16
#: Texts and characters that are bundled in one product, and n-grams in it.
TOGETHER, HELD, SLICE = 64, 1 << 20, 1 << 14
#: Distance of cosines, in units of which a language loses a factor e of the score.
SHARP = 0.02


class Profiler:
    def __init__(self):
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, DIMENSIONS), np.float32)
        self.letters: dict[int, np.ndarray] = {}
        self.kind = np.array([chr(c).isalpha() for c in range(0x110000)])

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = C.mix(np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(code * 1009 + SEED))
            self.letters[code] = np.unpackbits(bits.view(np.uint8)).astype(np.int8) * 2 - 1
        return self.letters[code]

    def add(self, new: np.ndarray) -> None:
        product = np.ones((len(new), DIMENSIONS), np.int8)
        for place in range(GRAM):
            codes, where = np.unique((new >> np.uint64(21 * place)) & np.uint64(0x1FFFFF), return_inverse=True)
            product *= np.roll(np.stack([self.letter(int(c)) for c in codes]), place, axis=1)[where]
        if len(self.keys) + len(new) > CACHE:
            self.keys, self.rows = self.keys[:0], self.rows[:0]
        keys = np.concatenate([self.keys, new])
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], np.concatenate([self.rows, product.astype(np.float32)])[order]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams of letters and word breaks, and their numbers; None without letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(self.kind[np.minimum(codes, 0x10FFFF)], codes, 0)
        if not codes.any():
            return None
        codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        keys = np.zeros(len(codes) - GRAM + 1, np.uint64)
        for place in range(GRAM):
            keys |= codes[place : len(codes) - GRAM + 1 + place] << np.uint64(21 * place)
        return np.unique(keys, return_counts=True)

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of sorted distinct n-grams."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        missing = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if missing.any():
            new = keys[missing]
            self.add(new if len(self.keys) + len(new) <= CACHE else keys)
            at = np.searchsorted(self.keys, keys)
        return self.rows[at]

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The bundles of the texts that have letters, scaled to length 1, and the places of these texts.

        Texts are bundled together: their n-grams' weights, a row each, times the n-grams' vectors. Weights
        are whole numbers, so that the sums are exact and do not depend on which texts share a product.
        """
        found = [self.grams(t) if t else None for t in texts]
        places = np.array([i for i, f in enumerate(found) if f is not None], np.int64)
        if not len(places):
            return np.zeros((0, DIMENSIONS)), places
        keys, at = np.unique(np.concatenate([found[i][0] for i in places]), return_inverse=True)
        weights = np.rint(STEPS * np.sqrt(np.concatenate([found[i][1] for i in places]))).astype(np.float32)
        row = np.repeat(np.arange(len(places)), [len(found[i][0]) for i in places])
        total = np.zeros((len(places), DIMENSIONS))
        for lo in range(0, len(keys), SLICE):
            some = keys[lo : lo + SLICE]
            inside = slice(None) if len(keys) <= SLICE else (at >= lo) & (at < lo + SLICE)
            table = np.zeros((len(places), len(some)), np.float32)
            table[row[inside], at[inside] - lo] = weights[inside]
            total += table @ self.rows_of(some)
        return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9), places


@functools.cache
def _profiler() -> Profiler:
    """One for each Python worker: what it remembers serves the next tasks too."""
    return Profiler()


def _groups(texts: list[str | None]):
    """Slices of up to TOGETHER texts and, but for longer ones, about HELD characters."""
    start = size = 0
    for i, text in enumerate(texts):
        if i - start == TOGETHER or size + len(text or "") > HELD and i > start:
            yield slice(start, i)
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def _bundles(text_col: str, lang_col: str):
    def run(batches):
        profiler, sums = _profiler(), {}
        for batch in batches:
            texts, langs = batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist()
            for part in _groups(texts):
                vectors, places = profiler.vectors(texts[part])
                # In whole numbers, so that sums do not depend on their order.
                for vector, place in zip(np.rint(vectors * 2**20).astype(np.int64), places, strict=True):
                    lang = langs[part][place]
                    sums[lang] = sums.get(lang, 0) + vector
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])

    return run


def prototypes(examples: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A vector of length 1 for each language of ``examples``; rows without text or language are left out.

    Fitted on all other rows. The driver gets one vector per language.
    """
    rows = examples.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    parts = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(_bundles("text", "lang"), "lang string, bundle array<bigint>")
    sums = parts.select("lang", F.posexplode("bundle").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("bundle"))
    vectors = {r["lang"]: np.array(r["bundle"], dtype=np.float64) for r in found.orderBy("lang").collect()}
    return {k: (v / np.linalg.norm(v)) for k, v in vectors.items() if v.any()}


#: Cells of the cosine's range that rows are counted in, the rows' share below the least one, and the part of it that is asked for.
FLOOR_CELLS, FLOOR_SHARE, FLOOR_PART = 1 << 14, 0.01, 0.5


def least_cosine(found: DataFrame) -> float:
    """A cosine that nearly all texts in a known language pass, from the rows that ``identify`` gave for all labelled ones.

    FLOOR_PART of what at least 1 - FLOOR_SHARE of these rows reach: the greatest multiple of 1 / FLOOR_CELLS with no more rows
    below. All rows are counted, those without letters left out; 0 without rows. The driver gets the counts of the cells.
    """
    cell = F.floor(F.col("cosine") * FLOOR_CELLS).alias("cell")
    rows = found.where("lang_pred <> 'und'").groupBy(cell).agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    upto = np.cumsum([r["n"] for r in rows])
    least = rows[int(np.searchsorted(upto, FLOOR_SHARE * upto[-1], "right"))]["cell"] if rows else 0
    return max(0.0, FLOOR_PART * least / FLOOR_CELLS)


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """The rows' id and the columns ``also``, with lang_pred, score and cosine.

    ``und`` with score 0 where the text is null, has no letter or no language is known. Ties go to the
    first language in order. score is the share of the best among exp(cosine / SHARP). Rows that repeat
    are scored each; other columns are not read; an empty table gives an empty result.
    """
    names = sorted(known)
    matrix = np.array([known[k] for k in names], dtype=np.float64).reshape(len(names), DIMENSIONS)
    centre = matrix.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    turned = matrix - centre
    turned = turned / np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-9)
    own = [id_col, *also]
    kinds = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in own)

    def run(batches):
        profiler = _profiler()
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            best, share, cosine = np.full(len(texts), len(names)), np.zeros(len(texts)), np.zeros(len(texts))
            for part in _groups(texts) if names else ():
                vectors, places = profiler.vectors(texts[part])
                at = places + part.start
                rest = vectors - centre
                cosines = np.einsum("nd,ld->nl", rest, turned) / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-9)
                best[at], cosine[at] = np.argmax(cosines, axis=1), cosines.max(axis=1)
                share[at] = 1.0 / np.exp((cosines - cosine[at, None]) / SHARP).sum(axis=1)
            found = pa.array([*names, "und"], pa.string()).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), found, pa.array(share), pa.array(cosine)], names=[*own, "lang_pred", "score", "cosine"])

    return docs.select(*own, text_col).mapInArrow(run, f"{kinds}, lang_pred string, score double, cosine double")
