"""Exact self-join of documents by the Jaccard similarity of their word shingles, with parity sketches.

1. Documents of equal sets become one class; the smallest id represents it.
2. Shingles are counted over the corpus by a bucketed exchange, and those that several documents hold go back
   to the buckets of their documents. Both ways, rows are packets of a task's shingles for a bucket. One that a single document holds is part
   of the symmetric difference with any partner. At similarity 0.75 a partner holds three quarters of a
   set, so a class with more than a quarter of its shingles to itself has no partner and is done. This
   also settles documents that merely share a popular passage.
3. The others' remaining shingles are thrown into as many parts as the size band's lower end; a part's
   sketch word is the XOR of the hashes in it. One shingle changes one word, so the number of unlike words
   (the sketches' Hamming distance) is a lower bound of the symmetric difference, and the band bounds that
   difference by D. Of any D + 1 non-empty words one must agree with the partner's (pigeonhole). A class
   sends its first D + 1 words in the order of the parts: of two partners, the one whose last word comes
   first has an agreeing word among its own, and the other sends that part too. Where a set has too few
   non-empty parts for this, its band takes each shingle as a part of its own, which never are too few.
4. Classes that share a word are candidates. First each meets at most two of the classes that come first
   in its words; these pairs are verified on the shingles and joined to components. Then rounds over some
   of the words verify, for each word, the pairs of its best connected class. At last, of all that share
   any word, the pairs across components remain, and all of those that the Hamming distance of a bit
   sketch allows are verified. Pairs inside a component cannot change the result, so a group of thousands
   of near copies costs its size and not its square. A word of more than BLOCK classes is compared in blocks
   of BLOCK by BLOCK of them, each a group of its own, so no task ever holds a whole hot word.

Joins on a class that many pairs name (verification) or on a set that many copies have are sort-merge joins,
which Spark splits at hot keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm import common as C
from armwise.llm.components import absorbed, components

WIDTH = 5
#: Bytes of text that a task holds at once.
HELD = 3 << 20
#: 64-bit words of the bit sketch that prunes residual candidates.
SKETCH = 16
#: Rows of open words in a bucket.
GROUP_ROWS = 1 << 15
#: Classes of a word in a group; more are compared in blocks.
BLOCK = 1 << 13
#: Merging rounds look at one word in so many, and end when a round finds fewer links than this.
MERGE_WORDS, MERGE_LEAST = 8, 200
#: Below this size a band takes every shingle as a part.
SMALL = 32
_U = np.uint64


def _sets(texts: list[bytes], width: int):
    """Distinct shingles of each text: (hashes, text numbers), by ascending hash."""
    words, counts = C.hash_words(texts, lower=True)
    ok = C.inside(counts, width)
    at = np.flatnonzero(ok)
    row = np.repeat(np.arange(len(counts)), counts)
    hashes, rows = C.window_hashes(words, width)[ok], row[at] if len(at) else np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    extra, extra_rows = [], []
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        extra.append(C.mix(C.window_hashes(words[ends[i] - counts[i] : ends[i]], int(counts[i])) + _U(counts[i]))[0])
        extra_rows.append(i)
    if extra:
        hashes, rows = np.concatenate([hashes, np.array(extra, _U)]), np.concatenate([rows, extra_rows])
    order = np.lexsort((rows, hashes))
    hashes, rows = hashes[order], rows[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(order) else np.zeros(0, bool)
    return hashes[new], rows[new]


def _digest(width: int, id_col: str, text_col: str):
    def run(batches):
        for ids, texts in C.text_chunks(batches, [id_col, text_col], text_col, HELD):
            hashes, rows = _sets(texts, width)
            n = np.bincount(rows, minlength=len(ids)).astype(np.int64)
            total, other = np.zeros(len(ids), _U), np.zeros(len(ids), _U)
            np.add.at(total, rows, hashes)
            np.add.at(other, rows, C.mix(hashes + _U(WIDTH)))
            yield pa.RecordBatch.from_arrays([pa.array(C.id_array(ids)), pa.array(n), pa.array(total.view(np.int64)), pa.array(other.view(np.int64))], names=["doc", "n", "h1", "h2"])

    return run


_DEALT = "bucket int, known boolean, doc array<bigint>, m array<int>, low array<int>, high array<smallint>"
#: Stands for "documents of one task", which know by themselves that they share the shingle.
_SEVERAL = -(2**63)


def _dealt(bucket: np.ndarray, doc: np.ndarray, key: np.ndarray, known: bool) -> pa.RecordBatch:
    """Rows (bucket, known, documents, keys of each, low and high part of the keys); 48 bits of the keys."""
    order = np.lexsort((doc, bucket))
    bucket, doc, key = bucket[order], doc[order], key[order]
    at = np.flatnonzero(_starts(bucket, doc))
    m = np.diff(np.append(at, len(key)))
    heads = np.flatnonzero(_starts(bucket[at]))
    off, koff = np.append(heads, len(at)), np.append(at[heads], len(key))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[at][heads].astype(np.int32)),
            pa.array([known] * len(heads), pa.bool_()),
            C.lists(doc[at], off, pa.int64()),
            C.lists(m.astype(np.int32), off, pa.int32()),
            C.lists((key & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32), koff, pa.int32()),
            C.lists(((key >> _U(32)) & _U(0xFFFF)).astype(np.uint16).view(np.int16), koff, pa.int16()),
        ],
        names=["bucket", "known", "doc", "m", "low", "high"],
    )


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before, in any of the columns."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _undealt(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = C.flat(table["low"]).astype(np.int32).view(np.uint32).astype(_U)
    high = C.flat(table["high"]).astype(np.int16).view(np.uint16).astype(_U)
    known = np.repeat(np.asarray(table["known"]).astype(bool), C.sizes(table["low"]))
    return np.repeat(C.flat(table["doc"]), C.flat(table["m"])), low | high << _U(32), known


def _whole(key: np.ndarray, bucket) -> np.ndarray:
    """48 bits that take in the bucket too: a document's shingles come from all buckets."""
    return C.mix((key & _U(0xFFFFFFFFFFFF)) + (np.asarray(bucket).astype(_U) << _U(48))) >> _U(16)


def _shingles(n_buckets: int, width: int, id_col: str, text_col: str):
    def run(batches):
        for ids, texts in C.text_chunks(batches, [id_col, text_col], text_col, HELD):
            hashes, rows = _sets(texts, width)
            if not len(hashes):
                continue
            bucket, docs, new = C.bucket_of(hashes, n_buckets), C.id_array(ids)[rows], _starts(hashes)
            known = ~new | np.append(~new[1:], False)
            if known.any():  # by document, however many share it
                d = docs[known]
                yield _dealt(C.bucket_of(C.mix(d.view(_U)), n_buckets), d, _whole(hashes[known], bucket[known]), True)
            yield _dealt(bucket[new], np.where(known, _SEVERAL, docs)[new], hashes[new], False)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket, the shingles that two or more documents hold, in packets for the documents' buckets."""
    doc, key, known = _undealt(table)
    bucket, n_buckets = table["bucket"][0].as_py(), table["of"][0].as_py()
    done_doc, done_key = doc[known], key[known]
    doc, key = doc[~known], key[~known]
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    same = ~_starts(key)
    many = (same | np.append(same[1:], False)) & (doc != _SEVERAL)
    doc = np.concatenate([done_doc, doc[many]])
    key = np.concatenate([done_key, _whole(key[many], bucket)])
    return pa.Table.from_batches([_dealt(C.bucket_of(C.mix(doc.view(_U)), n_buckets), doc, key, True)])


def _gathered(table: pa.Table) -> pa.Table:
    """(doc, shingles) of one bucket of documents."""
    doc, key, _ = _undealt(table)
    order = np.argsort(doc, kind="stable")
    key, doc = key[order], doc[order]
    at = np.flatnonzero(_starts(doc))
    return pa.table([pa.array(doc[at]), C.lists(key.view(np.int64), np.append(at, len(doc)), pa.int64())], names=["doc", "shingles"])


def _bands(n: int) -> list[int]:
    """Lower ends of the size bands [s, 2s), each open upwards to partners of their sizes, that a set is in."""
    low = 1 << (n.bit_length() - 1)
    return [low] + ([low // 2] if low > 1 and 3 * n < 4 * low else [])


def _bound(n: int, u: int, low: int) -> int:
    """Greatest symmetric difference of the shared shingles with a partner in the band."""
    return (n + min(4 * n // 3, 8 * low // 3)) // 7 - u


def _words(shingles: np.ndarray, low: int, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty parts in order, and their sketch words."""
    if single:
        out = np.sort(C.mix(shingles + _U(low)))
        return out, out
    part = (C.mix(shingles + _U(low)) % _U(low)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return part[at].astype(_U), np.bitwise_xor.reduceat(C.mix(shingles[order]), at)


def _weak(batches):
    """Bands in which a set has too few non-empty parts."""
    for batch in batches:
        found = set()
        for n, shingles in zip(batch.column("n").to_pylist(), batch.column("shingles"), strict=True):
            values = C.unsigned(shingles.values.to_numpy(zero_copy_only=False))
            for low in _bands(n):
                if low >= SMALL and low not in found and len(_words(values, low, False)[0]) <= _bound(n, n - len(values), low):
                    found.add(low)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["low"])


def _sent(n: int, values: np.ndarray, weak: set[int]) -> np.ndarray:
    """The sketch words that a set sends, of all its bands."""
    keys = [np.zeros(0, _U)]
    for low in _bands(n):
        bound = _bound(n, n - len(values), low)
        if bound >= 0:
            part, word = _words(values, low, low < SMALL or low in weak)
            keys.append(C.mix(word[: bound + 1] ^ C.mix(part[: bound + 1] * _U(0x9E3779B1) + _U(low))))
    return np.concatenate(keys)


def _stars(key: np.ndarray, doc: np.ndarray):
    """Word groups in order of (key, document): the first of each, and (first, other, words) of the rest."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = _starts(key)
    lead = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else doc
    a, b = lead[~new], doc[~new]
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    at = np.flatnonzero(_starts(a, b))
    return (key[new], doc[new]), (a[at], b[at], np.diff(np.append(at, len(a))))


_MET = "bucket int, key array<bigint>, doc array<bigint>, a array<bigint>, b array<bigint>, words array<bigint>"


def _met(bucket, keys, docs, stars) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, keys, docs = bucket[order], keys[order], docs[order]
    at = np.flatnonzero(_starts(bucket))
    off, none = np.append(at, len(bucket)), np.zeros(len(at) + 1, np.int64)
    empties = [C.lists(np.zeros(0, np.int64), none, pa.int64())] * 3
    rows = pa.RecordBatch.from_arrays(
        [pa.array(bucket[at].astype(np.int32)), C.lists(keys.view(np.int64), off, pa.int64()), C.lists(docs, off, pa.int64()), *empties],
        names=["bucket", "key", "doc", "a", "b", "words"],
    )
    one = np.array([0, len(stars[0])])
    empty = C.lists(np.zeros(0, np.int64), np.zeros(2, np.int64), pa.int64())
    found = [C.lists(np.asarray(x, np.int64), one, pa.int64()) for x in stars]
    pairs = pa.RecordBatch.from_arrays([pa.array([int(bucket[0])], pa.int32()), empty, empty, *found], names=rows.schema.names)
    return pa.concat_batches([rows, pairs])


def _meeting(n_buckets: int, weak: set[int]):
    """Each task's own stars, and for each word the first class that holds it."""

    def run(batches):
        for batch in batches:
            docs, keys = [], []
            for doc, n, shingles in zip(batch.column("doc").to_pylist(), batch.column("n").to_pylist(), batch.column("shingles"), strict=True):
                keys.append(_sent(n, C.unsigned(shingles.values.to_numpy(zero_copy_only=False)), weak))
                docs.append(np.full(len(keys[-1]), doc, np.int64))
            if sum(map(len, keys)):
                (key, first), stars = _stars(np.concatenate(keys), np.concatenate(docs))
                yield _met(C.bucket_of(key, n_buckets), key, first, stars)

    return run


def _leads(table: pa.Table) -> pa.Table:
    """(a, b, words): the classes a and b share so many words, in all of which a is the first."""
    _, (a, b, words) = _stars(C.unsigned(C.flat(table["key"])), C.flat(table["doc"]))
    cols = [np.concatenate([x, C.flat(table[c])]) for x, c in ((a, "a"), (b, "b"), (words, "words"))]
    return pa.table([pa.array(np.asarray(x, np.int64)) for x in cols], names=["a", "b", "words"])


def _all_words(weak: set[int]):
    def run(batches):
        for batch in batches:
            keys = [_sent(n, C.unsigned(x.values.to_numpy(zero_copy_only=False)), weak) for n, x in zip(batch.column("n").to_pylist(), batch.column("shingles"), strict=True)]
            off = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), C.lists(np.concatenate([np.zeros(0, _U), *keys]).view(np.int64), off, pa.int64())], names=["doc", "keys"])

    return run


def _sketches(batches):
    """The parity bits of each set's shared shingles."""
    for batch in batches:
        bits = []
        for shingles in batch.column("shingles"):
            place = C.mix(C.unsigned(shingles.values.to_numpy(zero_copy_only=False)) ^ _U(0xABCDEF)) % _U(64 * SKETCH)
            bits.append(np.packbits((np.bincount(place.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).tobytes())
        n, k = np.asarray(batch.column("n"), np.int64), C.sizes(batch.column("shingles"))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n"), pa.array(n - k), pa.array(bits, pa.binary())], names=["doc", "n", "u", "bits"])


class _Groups:
    """Rows of one bucket: for each group the classes that share a word with a class of another component."""

    def __init__(self, table: pa.Table):
        self.key, self.doc, self.comp, self.n, self.u, self.side = (np.asarray(table[c], np.int64) for c in ("key", "doc", "comp", "n", "u", "side"))
        self.bits = np.frombuffer(b"".join(table["bits"].to_pylist()), _U).reshape(len(self.key), SKETCH)
        order = np.argsort(self.key, kind="stable")
        self.groups = np.split(order, np.flatnonzero(_starts(self.key[order]))[1:])

    def outside(self, group: np.ndarray) -> np.ndarray:
        """Members outside the largest component: of any pair across components, one is among them."""
        names, counts = np.unique(self.comp[group], return_counts=True)
        return group[self.comp[group] != names[np.argmax(counts)]]

    def allowed(self, x: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of other components that sizes and bit sketches allow to be similar to x, and their distance.

        Where a group holds two different slices of a word, partners are of the other slice.
        """
        n, u = self.n, self.u
        near = (self.comp[group] != self.comp[x]) & (3 * n[group] <= 4 * n[x]) & (3 * n[x] <= 4 * n[group])
        rest = group[near & ((self.side[group] != self.side[x]) | (self.side[x] == 0))]
        apart = np.bitwise_count(self.bits[rest] ^ self.bits[x]).sum(axis=1)
        fit = apart <= (n[rest] + n[x]) // 7 - u[rest] - u[x]
        return rest[fit], apart[fit]

    def pairs(self, found: list[tuple[int, np.ndarray]]) -> pa.Table:
        a = np.concatenate([np.full(len(y), self.doc[x]) for x, y in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([self.doc[y] for _, y in found]) if found else np.zeros(0, np.int64)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(both[0].astype(np.int64)), pa.array(both[1].astype(np.int64))], names=["a", "b"])


def _hubs(table: pa.Table) -> pa.Table:
    """For each word, pairs of the member with most partners and these, and of each other with its nearest."""
    g, found = _Groups(table), []
    for group in g.groups:
        each = {int(x): g.allowed(x, group) for x in g.outside(group)}
        each = {x: v for x, v in each.items() if len(v[0])}
        if not each:
            continue
        met, times = np.unique(np.concatenate([v[0] for v in each.values()]), return_counts=True)
        hub = int(met[np.lexsort((g.doc[met], -times))[0]])
        star = g.allowed(hub, group)[0]
        found.append((hub, star))
        covered = {hub, *star.tolist()}
        found += [(x, y[np.lexsort((g.doc[y], apart))[:1]]) for x, (y, apart) in each.items() if x not in covered]
    return g.pairs(found)


def _crossing(table: pa.Table) -> pa.Table:
    """All pairs of different components that share a word and may be similar."""
    g = _Groups(table)
    return g.pairs([(x, g.allowed(x, group)[0]) for group in g.groups for x in g.outside(group)])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= 75 * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _classes(rows: DataFrame, width: int, text_col: str) -> DataFrame:
    """(doc, n, component) of every row of ``rows``, which has KEY: all three in terms of it."""
    spark = rows.sparkSession
    n_buckets = C.buckets(spark, 2)
    rows = rows.select(C.KEY, text_col)
    digest = C.written(rows.mapInArrow(_digest(width, C.KEY, text_col), "doc bigint, n bigint, h1 bigint, h2 bigint"), "digest")
    classes = digest.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep"))
    reps = classes.groupBy(F.col("rep").alias("doc")).agg(F.max("n").alias("n"))
    sent = rows.mapInArrow(_shingles(n_buckets, width, C.KEY, text_col), _DEALT)
    met = sent.withColumn("of", F.lit(n_buckets)).groupBy("bucket").applyInArrow(_shared, _DEALT)
    shared = met.groupBy("bucket").applyInArrow(_gathered, "doc bigint, shingles array<bigint>")
    sets = C.written(shared.join(reps, "doc").where("4 * size(shingles) >= 3 * n").select("doc", "n", "shingles"), "sets")

    weak = {r["low"] for r in sets.mapInArrow(_weak, "low bigint").distinct().collect()}  # at most 64 powers of two
    leads = sets.mapInArrow(_meeting(n_buckets, weak), _MET).groupBy("bucket").applyInArrow(_leads, "a bigint, b bigint, words bigint")
    leads = leads.groupBy("a", "b").agg(F.sum("words").alias("words"))
    leads = leads.groupBy("b").agg(F.min("a").alias("one"), F.max_by("a", F.struct("words", -F.col("a"))).alias("two"))
    first = _verified(leads.select(F.explode(F.array_distinct(F.array("one", "two"))).alias("a"), "b"), sets)
    comps = C.written(components(first), "components")

    words = C.written(sets.mapInArrow(_all_words(weak), "doc bigint, keys array<bigint>").select("doc", F.explode("keys").alias("key")), "words")
    sketches = C.written(sets.mapInArrow(_sketches, "doc bigint, n bigint, u bigint, bits binary"), "sketches")

    def pairs_of(words: DataFrame, find, whole: bool) -> DataFrame:
        """Verified pairs of classes of different components that share a word; ``whole``: all of them."""
        known = words.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
        mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("slices"))
        rows = C.written(known.join(mixed.where("lo <> hi").select("key", "slices"), "key"), "open")
        mine = F.pmod(F.xxhash64("doc"), F.col("slices"))
        others = F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1) if whole else F.array(mine)
        rows = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
        # Slices meet in pairs: of the two a row is on the side 1 or 2, or on 0 where a slice meets itself.
        side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
        part = F.when(F.col("slices") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
        rows = rows.select(part.alias("key"), "doc", "comp", side.cast("bigint").alias("side"))
        dealt = rows.join(sketches, "doc").withColumn("bucket", F.pmod("key", F.lit(max(1, rows.count() // GROUP_ROWS))))
        return _verified(dealt.groupBy("bucket").applyInArrow(find, "a bigint, b bigint").distinct(), sets)

    some = words.where(f"pmod(key, {MERGE_WORDS}) = 0")
    while True:  # any pairs will do here; what they join is left out of the last step, which looks at all words
        new = C.written(pairs_of(some, _hubs, False), "links")
        comps = absorbed(comps, new)
        if new.count() < MERGE_LEAST:
            break
    comps = absorbed(comps, pairs_of(words, _crossing, True))
    # Copies of a set have the component of its representative: no links, and no rounds over them.
    own = digest.join(classes, ["h1", "h2", "n"], "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep"))
    names = classes.join(comps, F.col("rep") == F.col("node")).select("rep", "component")
    return own.join(names, "rep", "left").select("doc", "n", F.coalesce("component", "rep").alias("component"))


def similar_groups(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles and component_id, the smallest id reachable by links.

    Documents link at a Jaccard similarity of 0.75 or more of their sets of ``width``-word shingles
    (A-Z lower-cased; shorter texts are one shingle). Null and blank texts have none and link with nothing.
    Rows that share an id are documents of their own, and so are rows without one; component_id is null only
    where no row of the component has an id. Ids are integers. Other columns are not read; an empty table
    gives an empty result. Sets are compared by hashes of 48 bits and the bucket's.
    """
    kind = dict(docs.dtypes)[id_col]
    rows, unique = C.keyed(docs, id_col)
    found = _classes(rows, width, text_col)
    if unique:
        return found.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"))
    names = rows.select(C.KEY, F.col(id_col).alias("id"))
    found = found.join(names.toDF("doc", "id"), "doc").join(names.toDF("component", "first"), "component")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))


@C.shielded
def keep_one(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first in their group by id: one document of each group stays.

    Nulls, blanks, repeated ids and empty tables as in ``similar_groups``; columns are unchanged.
    """
    rows, _ = C.keyed(docs, id_col)
    others = _classes(rows, width, text_col).where("doc <> component").select("doc")
    return C.without(rows, others, C.KEY).drop(C.KEY)
