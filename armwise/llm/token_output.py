"""Token ids in directly addressable codes.

An id is split into chunks of ``CHUNK`` bits, lowest first. Level k holds the k-th chunks of all ids that
have one; a bitmap beside it says which of them go on, and a rank directory counts the set bits before
every ``STRIDE``-th position. Token i is found by its chunk at level 0, then, while its bit is set, by the
rank of its position at the next level: no block is decoded to reach it.

Documents are range-partitioned by id and each task writes segments of whole documents, as rows of a
Parquet table (so that any store that Spark writes to will do, with Spark's commit of finished tasks):

    shard int, segment int, base bigint    place in the order; ids before it in its shard
    n bigint, docs array<bigint>, lens array<bigint>   ids, documents, ids of each document
    levels array<struct<chunks binary, more binary, ranks array<int>>>

Shards are in ascending order of id, segments in ascending order in a shard. The first columns are the
index: they alone are read to find the segment of a token. A segment's codes are one cell in a page of its
own, neither compressed nor encoded; in it, chunks, bitmap and ranks lead to the token, and nothing else of
the segment is decoded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armwise.llm import common as C

CHUNK, STRIDE = 8, 512
#: Ids in a segment at least, but for the last of a shard; bytes of a page, so that a segment fills one.
SEGMENT, PAGE = 1 << 16, 1 << 16
#: Bytes of text that a task encodes at once.
HELD = 2 << 20
#: Pieces of text that a worker remembers.
CACHE = 2_000_000
_LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.list_(pa.int32()))])
_SEGMENTS = "shard int, segment int, base bigint, n bigint, docs array<bigint>, lens array<bigint>, levels array<struct<chunks binary, more binary, ranks array<int>>>"


def encode_levels(ids: np.ndarray) -> list[dict]:
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        high = rest >> CHUNK
        more = high > 0
        counts = np.add.reduceat(more.astype(np.int32), np.arange(0, len(more), STRIDE))
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "more": np.packbits(more).tobytes(), "ranks": np.cumsum(counts, dtype=np.int32) - counts.astype(np.int32)})
        rest = high[more]
    return levels


def decode_levels(levels: list[dict], n: int) -> np.ndarray:
    """All ids of a segment."""
    out, at = np.zeros(n, np.uint32), np.arange(n)
    for k, level in enumerate(levels):
        out[at] |= np.frombuffer(level["chunks"], np.uint8).astype(np.uint32) << np.uint32(CHUNK * k)
        at = at[np.unpackbits(np.frombuffer(level["more"], np.uint8), count=len(at)).astype(bool)]
    return out


def access(levels: list[dict], i: int) -> int:
    """Id ``i`` of a segment, by ranks alone."""
    out = 0
    for k, level in enumerate(levels):
        out |= level["chunks"][i] << (CHUNK * k)
        more = level["more"]
        if not more[i >> 3] >> (7 - (i & 7)) & 1:
            break
        block = i // STRIDE
        lead = int.from_bytes(more[block * STRIDE // 8 : (i >> 3) + 1], "big") >> (8 - (i & 7) - 1)
        i = int(level["ranks"][block]) + lead.bit_count() - 1
    return out


class Encoder:
    """A byte-level BPE of ``tokenizers`` behind a memory of pieces, kept in arrays.

    A cut before a single space between two characters that are not white space is a cut between tokens
    for a byte-level BPE: its words take at most the one space before them. Pieces between such cuts, known
    by 64-bit hashes of their bytes, are encoded once while remembered. New pieces go to the tokenizer
    joined, as they stood in the texts; the tokens' lengths in bytes tell them apart again. Texts that hold
    one of the tokenizer's added tokens are left to it whole, as it was loaded.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.together = 512 if not any(b" " in t for t in self.added) else 1  # joined pieces must not make an added token
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a byte-level token is a byte
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), [np.zeros(0, np.uint32)]

    def learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces, in the order of their keys."""
        if len(self.keys) + len(keys) > CACHE:
            self.forget()
        alone = [i for i, p in enumerate(pieces) if p[:1] != b" "]
        joined = [i for i, p in enumerate(pieces) if p[:1] == b" "]
        runs = [[i] for i in alone] + [joined[k : k + self.together] for k in range(0, len(joined), self.together)]
        found = self.tokenizer.encode_batch_fast([b"".join(pieces[i] for i in run).decode() for run in runs], add_special_tokens=False)
        ids = [np.array(f.ids, np.uint32) for f in found]
        order = np.array([i for run in runs for i in run], np.int64)
        pool = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        ends = np.cumsum(np.array([len(pieces[i]) for i in order], np.int64))
        reached = np.cumsum(self.bytes[pool])
        last = np.searchsorted(reached, ends)
        if len(ends) and not (reached[last] == ends).all():
            raise ValueError("not a byte-level BPE whose words start at a space")
        size = np.diff(last + 1, prepend=0)
        base = len(self.pool[0])
        first = base + last + 1 - size
        at = np.searchsorted(self.keys, keys[order])
        by = np.argsort(keys[order], kind="stable")
        at, order = at[by], order[by]
        self.keys, self.first, self.size = np.insert(self.keys, at, keys[order]), np.insert(self.first, at, first[by]), np.insert(self.size, at, size[by].astype(np.int32))
        self.pool = [np.concatenate([self.pool[0], pool])]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and their number for each text."""
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return self.encode_pieces(texts)
        rest = list(texts)
        for i in whole:
            rest[i] = b""
        ids, n = self.encode_pieces(rest)
        found = [np.array(f.ids, np.uint32) for f in self.tokenizer.encode_batch_fast([texts[i].decode() for i in whole], add_special_tokens=False)]
        sizes = np.array([len(f) for f in found], np.int64)
        ids = np.insert(ids, np.repeat((np.cumsum(n) - n)[whole], sizes), np.concatenate(found))
        n[whole] = sizes
        return ids, n

    def encode_pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts without added tokens."""
        lens = np.array([len(t) for t in texts], np.int64)
        data = b"".join(texts)
        starts = _cuts(np.frombuffer(data, np.uint8), np.cumsum(lens) - lens)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.append(starts[1:], len(data))
        sums, (_, down) = C.prefix_hash(C.BYTES[np.frombuffer(data, np.uint8)]), C.powers(len(data))
        keys, where, at = np.unique(C.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self.forget()
        spot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[spot] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self.learn(keys[new], [data[a:e] for a, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            spot = np.searchsorted(self.keys, keys)
        size, first = self.size[spot][at].astype(np.int64), self.first[spot][at]
        total = np.cumsum(size)
        ids = self.pool[0][np.repeat(first - (total - size), size) + np.arange(total[-1])]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, np.cumsum(lens))]
        return ids, np.diff(upto, prepend=0)


def _cuts(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Starts of the pieces: of the non-empty texts, and single spaces between characters that are surely
    not white space (of those beyond ASCII, all whose UTF-8 may be white space are left uncut)."""
    n = len(data)
    at = np.flatnonzero(data == 32)
    at = at[(at > 2) & (at < n - 1)]
    after, one, two, three = data[at + 1], data[at - 1], data[at - 2], data[at - 3]
    safe = ~_MAYBE_SPACE[after] & ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3)) & ~_MAYBE_SPACE[one] & ((one < 0x80) | ((two != 0xC2) & ~np.isin(three, (0xE1, 0xE2, 0xE3))))
    marks = np.zeros(n + 1, bool)
    marks[at[safe]] = True
    marks[heads] = True
    return np.flatnonzero(marks[:n])


_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder: Python workers serve one task after another, and keep what they know."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _segments(path: str, end_id: int, id_col: str, text_col: str):
    def run(batches):
        from pyspark import TaskContext

        encoder, shard = _encoder(path), TaskContext.get().partitionId()
        docs, lens, parts, total, base, segment = [], [], [], 0, 0, 0

        def flushed(least: int):
            """Segments of ``least`` ids or more from what is held; the rest stays."""
            nonlocal docs, lens, parts, total, base, segment
            if total < least:
                return
            ids, ends = np.concatenate(parts), np.cumsum(lens)
            done = start = 0
            while total - start >= least:
                upto = min(int(np.searchsorted(ends, start + SEGMENT)) + 1, len(docs))
                stop = int(ends[upto - 1])
                row = [shard, segment, base, stop - start, docs[done:upto], lens[done:upto], encode_levels(ids[start:stop])]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(_LEVEL)]
                base, segment = base + stop - start, segment + 1
                done, start = upto, stop
                names = ["shard", "segment", "base", "n", "docs", "lens", "levels"]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
            docs, lens, parts, total = docs[done:], lens[done:], [ids[start:]], total - start

        for ids, texts in C.text_chunks(batches, [id_col, text_col], text_col, HELD):
            found, n = encoder.encode(texts)
            docs += ids
            lens += (n + 1).tolist()
            parts.append(np.insert(found, np.cumsum(n), end_id))
            total += len(parts[-1])
            yield from flushed(SEGMENT)
        yield from flushed(1)

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document, append ``end_id`` and write the segments to ``path`` in ascending order of id.

    Null texts count as empty; null ids come first; rows that share an id stand side by side, by the hash
    of their text. An empty table writes an empty table. Other columns are not read.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(text_col)
    rows = docs.select(id_col, text_col, tie.alias("__tie")).repartitionByRange(n, F.col(id_col).asc_nulls_first(), "__tie")
    rows = rows.sortWithinPartitions(F.col(id_col).asc_nulls_first(), "__tie").select(F.col(id_col).cast("bigint").alias(id_col), text_col)
    coded = rows.mapInArrow(_segments(tokenizer, end_id, id_col, text_col), _SEGMENTS)
    plain = {"compression": "none", "parquet.page.size": str(PAGE), "parquet.enable.dictionary": "false"}
    coded.write.options(**plain).parquet(path)


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            levels = row["levels"]
            ids = decode_levels(levels, row["n"]).astype("<u4")
            lens = np.array(row["lens"], np.int64)
            starts = np.cumsum(lens) - lens
            heads = [access(levels, i) for i in starts.tolist()]
            if (ids[starts] != heads).any():
                raise ValueError(f"ranks of shard {row['shard']}, segment {row['segment']} do not lead to its ids")
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(starts.tolist(), lens.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], pa.int64()), pa.array(row["first"] + starts, pa.int64()), pa.array(lens), pa.array(crc, pa.int64()), pa.array(heads, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "first_id"],
            )


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments, with ``first``: the ids of all segments before."""
    table = spark.read.schema(_SEGMENTS).parquet(path)
    shards = table.groupBy("shard").agg(F.sum("n").alias("ids"))  # one row per task that wrote
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.withColumn("before", before).drop("ids")
    return table.join(F.broadcast(starts), "shard").withColumn("first", F.col("before") + F.col("base")).drop("before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, first_id) of each document, decoded from the files at ``path``.

    Each document's first id is also read by its place, through the ranks, and must be the decoded one.
    """
    rows = segments(spark, path).select("shard", "segment", "docs", "lens", "levels", "n", "first")
    return rows.mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, first_id bigint")


def read_token(spark: SparkSession, path: str, i: int) -> int:
    """The id at place ``i`` of all ids: from the index, then one segment's codes by their ranks; IndexError beyond."""
    at = segments(spark, path).where(F.lit(i).between(F.col("first"), F.col("first") + F.col("n") - 1)).select("shard", "segment", "first").first()
    if at is None:
        raise IndexError(i)
    row = spark.read.schema(_SEGMENTS).parquet(path).where(f"shard = {at.shard} and segment = {at.segment}").select("levels").first()
    return access([level.asDict() for level in row.levels], i - at.first)


def _accessed(batches):
    for batch in batches:
        for row in batch.to_pylist():
            found = [access(row["levels"], i - row["first"]) for i in row["at"]]
            yield pa.RecordBatch.from_arrays([pa.array(row["at"], pa.int64()), pa.array(found, pa.int64())], names=["at", "id"])


def read_tokens(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(at, id) for the distinct places in the one column of ``places``; places beyond the ids give no row.

    Places meet the index by ranges of SEGMENT ids, and only the segments that they lie in are read.
    """
    index = segments(spark, path).select("shard", "segment", "first", "n")
    cell = lambda x: F.floor(x / SEGMENT)
    cells = index.withColumn("cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("first") + F.col("n") - 1))))
    asked = places.select(F.col(places.columns[0]).cast("bigint").alias("at")).distinct().withColumn("cell", cell(F.col("at")))
    met = asked.join(cells, "cell").where("at >= first and at < first + n")
    lists = met.groupBy("shard", "segment", "first").agg(F.collect_list("at").alias("at"))  # no more than a segment has ids
    rows = lists.join(spark.read.schema(_SEGMENTS).parquet(path).select("shard", "segment", "levels"), ["shard", "segment"])
    return rows.select("at", "first", "levels").mapInArrow(_accessed, "at bigint, id bigint")
