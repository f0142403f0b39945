"""What the corpus operators share: tables on shared storage, word hashing in numpy, bucketed exchange."""

from __future__ import annotations

import functools
import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and \t \n \v \f \r, which is also what ``bytes.split()`` cuts at.
SPACES = " \t\n\x0b\x0c\r"
LAST_ID = 2**63 - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the cluster's ``spark.checkpoint.dir``; it goes when the application ends.

    Where none is set, a temporary folder serves a local master (tests); a cluster has to name one.
    """
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(place)
    own = f"{place.rstrip('/')}/armwise-{sc.applicationId}"
    if own not in _marked:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(sc._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _marked.add(own)
    return own


_marked: set[str] = set()


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written; DataFrames over them can then not be read any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    _marked.discard(shared_dir(spark))


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    With ``batch``, Arrow batches that Python gets for it end at about that many bytes, not only at Spark's number of
    rows: rows that hold whole chunks of texts are few and large.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    usual = spark.conf.get(_BATCH, None)
    try:
        if batch:
            spark.conf.set(_BATCH, batch)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch:
            spark.conf.set(_BATCH, usual) if usual else spark.conf.unset(_BATCH)
    return spark.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


#: The column that ``keyed`` adds.
KEY = "__key"


def shielded(operator):
    """For operators that return their input's columns: the user's own that begin like internal ones (``__``) get
    other names meanwhile, so that none is overwritten, dropped or ambiguous."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        aside = {}
        for c in [c for c in docs.columns if c.startswith("__")]:
            name = f"own{c}"
            while name in docs.columns or name in aside.values():
                name += "_"
            aside[c] = name
        if not aside:
            return operator(docs, *args, **options)
        named = lambda v: aside.get(v, v) if isinstance(v, str) else v
        out = operator(docs.withColumnsRenamed(aside), *map(named, args), **{k: named(v) for k, v in options.items()})
        return out.withColumnsRenamed({v: k for k, v in aside.items()})

    return run


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with KEY, a bigint that is each row's own and in the order of the ids (null last).

    Where no id is null or repeats (told by one count of the ids) it is the id; the second result is then True.
    Otherwise rows are range-partitioned and sorted by id, numbered, and written once with their numbers, so
    that all later scans agree on them.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"))
    if ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty():
        return docs.withColumn(KEY, F.col(id_col).cast("bigint")), True
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])  # deals out one id that many rows have
    rows = docs.withColumns({"__salt": salt, KEY: F.col(id_col).cast("bigint")})
    order = [F.col(KEY).asc_nulls_last(), F.col("__salt")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__salt")
    return written(rows.withColumn(KEY, F.monotonically_increasing_id()), "keyed"), False


#: Ids up to which a list of rejected documents is broadcast; longer ones join by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, rejected: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``rejected``; a null id is in no list.

    The list is written and counted first: a short one is broadcast, so that the texts stay where they are.
    """
    ids = written(rejected.select(F.col(rejected.columns[0]).alias("__rejected")).where("__rejected is not null").distinct(), "rejected")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, docs[id_col] == F.col("__rejected"), "left_anti")


def buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """Buckets of a bucketed exchange; they follow ``spark.sql.shuffle.partitions``, the cluster's own lever."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: str, parts: int, rest: int) -> Column:
    """True where crc32(id as text) mod ``parts`` is ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == rest


def words_of(text: str | Column) -> Column:
    """Array of the words of a text column; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


# ---- numpy: hashing the words of many texts at once -------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix64); a new array."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = BYTES.copy()
_LOWER[65:91] = BYTES[97:123]
_LOW_BYTE = np.arange(256, dtype=np.uint8)
_LOW_BYTE[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _powers = 0xD6E8FEB86659FD93, {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 20, 1 << int(n).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64; slices of them hash runs of values."""
    up, _ = powers(len(values))
    return np.concatenate([np.zeros(1, _U), np.cumsum(values * up, dtype=_U)])


#: Bytes whose prefix sums are held at once while words are hashed (or those of one longer word).
HASHED = 1 << 19


def hash_words(texts: list[bytes], lower: bool = False, tails: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words of ``texts`` in order, and the number of words of each text; with ``tails``,
    also the last two bytes of each word as a number (words of one byte: that byte)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _IS_SPACE[joined]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    if len(edge) % 2:
        edge = np.append(edge, len(joined))
    starts, ends = edge[::2], edge[1::2]
    hashes, lo = np.empty(len(starts), _U), 0
    while lo < len(starts):  # a word's hash does not depend on where the sums begin
        from_ = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, from_ + HASHED, "right")))
        first, last = starts[lo:hi] - from_, ends[lo:hi] - from_
        sums = prefix_hash((_LOWER if lower else BYTES)[joined[from_ : ends[hi - 1]]])
        _, down = powers(int(last[-1]))
        hashes[lo:hi] = mix((sums[last] - sums[first]) * down[first])
        lo = hi
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not tails:
        return hashes, counts
    last = _LOW_BYTE[joined] if lower else joined
    return hashes, counts, last[ends - 1].astype(np.uint32) | np.where(ends - starts > 1, last[ends - 2].astype(np.uint32) << np.uint32(8), np.uint32(0))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (order counts)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    sums, (_, down) = prefix_hash(words), powers(len(words))
    return mix((sums[width:] - sums[:n]) * down[:n])


def inside(counts: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows over the concatenated words lie in one text."""
    total = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return (left >= width)[: max(0, total - width + 1)]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0], have * 2
    gap = width - have
    return np.minimum(out[: len(out) - gap], out[gap:]) if gap and len(out) > gap else out[:0] if gap else out


#: Rows of a batch that are Python objects at once.
LISTED = 256


def text_chunks(batches, columns: list[str], text: str, limit: int):
    """Groups of rows with up to ``limit`` bytes of text (or one longer text): lists of the columns, texts as bytes."""
    held, size = [[] for _ in columns], 0
    at = columns.index(text)
    plain = lambda c, k: pc.cast(pc.fill_null(c, ""), pa.binary()) if k == at else c  # noqa: E731  a copy, so of few rows
    for batch in batches:
        cols = [batch.column(c) for c in columns]
        parts = (zip(*(plain(c.slice(lo, LISTED), k).to_pylist() for k, c in enumerate(cols)), strict=True) for lo in range(0, batch.num_rows, LISTED))
        for row in itertools.chain.from_iterable(parts):
            if size and size + len(row[at]) > limit:
                yield held
                held, size = [[] for _ in columns], 0
            for store, value in zip(held, row, strict=True):
                store.append(value)
            size += len(row[at]) + 1
    if held[at]:
        yield held


# ---- bucketed exchange: rows (bucket, arrays) through Spark's shuffle --------------------------------


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def flat(column) -> np.ndarray:
    """All values of a list column, joined."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def sizes(column) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.asarray(pc.list_value_length(c)) for c in chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(n) >> _U(32)).astype(np.int32)


def id_array(values: list) -> np.ndarray:
    """Ids as int64; a null id sorts after all others."""
    return np.array([LAST_ID if v is None else v for v in values], dtype=np.int64)
