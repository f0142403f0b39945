"""Prefix trie of conversations: a z-fast trie, grown in batches by Spark joins.

A conversation is the sequence of its turns' digests; its prefix of d turns is known by a chained 128-bit
digest, so equal digests are equal prefixes. Equal conversations are one sequence with their number.

A node of the compacted trie stands for depths lo + 1 to hi with the same members. Its handle is the prefix at
the depth in that range that the largest power of two divides (the two-fattest). A table of handles finds the
node at which a sequence leaves the trie by fat binary search: about log2(turns) joins by the handle's digest,
each of which halves the range of depths, and one by the first turn of an edge.

Insertion goes in batches. All sequences that leave at one place by one turn wait for one of them, the longest,
whose rest becomes a new edge; edges are cut where sequences leave or end. The others start the next batch
where they left, so each batch does one branching level and a sequence moves only while its place is unknown.
A turn, or a conversation, that a third of all share is one key of a left join, which Spark splits, and one
group of an aggregate with partial results; no group is gathered.

Sums over subtrees take log2(height) rounds of pointer jumping. At last edges unfold to one row per depth.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwise.llm import common as C

#: The prefix of no turns.
ROOT = bytes(16)
_TRIE = "lo int, hi int, parent binary, id binary, edge array<binary>, upto array<bigint>, base bigint, name binary, handle binary"


def turn_digests(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): each conversation's (digest of role and text, code points of the text), in order.

    Turns are ordered by number (null first), then digest; null role or text counts as empty; rows without a
    conversation are dropped. What a task holds of a conversation is some fifty bytes a turn, no text.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("bigint").alias("size"))
    return rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))), lambda t: F.struct(F.unhex(t["digest"]).alias("digest"), t["size"].alias("size"))).alias("turns"))


def forked(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation id - id % ``every``, then the own ones after the first h.

    h is the crc32 of the decimal id modulo ``most``. At most ``every`` conversations share one beginning.
    """
    own = turns.withColumns({"head": (F.crc32(F.col("id").cast("string").cast("binary")) % most).cast("int"), "base": F.col("id") - F.col("id") % every})
    bases = turns.where(F.col("id") % every == 0).select(F.col("id").alias("base"), F.slice("turns", 1, most).alias("first"))
    rest = F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0)))
    begun = F.coalesce(F.slice("first", F.lit(1), F.col("head")), F.array().cast("array<struct<digest:binary,size:bigint>>"))
    return own.join(bases, "base", "left").select("id", F.concat(begun, rest).alias("turns"))


def _chained(batches):
    """Each conversation's prefix digests at depths 1, 2, ..., and the code points up to there."""
    for batch in batches:
        keys, sums, last = [], [], []
        for turns in batch.column("turns").to_pylist():
            now, total, own, upto = ROOT, 0, [], []
            for t in turns:
                now, total = hashlib.md5(now + t["digest"]).digest(), total + t["size"]
                own.append(now)
                upto.append(total)
            keys.append(own)
            sums.append(upto)
            last.append(now)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64())), pa.array(last, pa.binary())], names=["id", "keys", "sums", "seq"])


def fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the largest power of two divides: b without the bits below the highest in which they differ."""
    step = F.pow(F.lit(2.0), F.length(F.bin(a.cast("bigint").bitwiseXOR(b.cast("bigint")))) - 1).cast("bigint")
    return (b - b % step).cast("int")


def _handles(nodes: DataFrame) -> DataFrame:
    """Nodes (lo, hi, parent, edge, upto, base) with their id, the first digest of their edge and their handle."""
    handle = F.element_at("edge", fattest(F.col("lo"), F.col("hi")) - F.col("lo"))
    return nodes.withColumns({"id": F.element_at("edge", -1), "name": F.element_at("edge", 1), "handle": handle}).select(*[c.split()[0] for c in _TRIE.split(", ")])


def _met(node: str = "n.") -> Column:
    """Depth up to which a sequence and a node's edge agree: equal digests are equal prefixes."""
    edge, lo = F.col(f"{node}edge"), F.col(f"{node}lo")
    same = F.zip_with(edge, F.slice("keys", lo + 1, F.size(edge)), lambda x, y: x.eqNullSafe(y))
    return lo + F.size(F.filter(same, lambda x: x))


def located(waiting: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """``waiting`` (seq, keys, sums, at) with the depth ``at`` where each leaves the trie, and the node to ``cut`` there.

    Fat binary search over the depths from ``at``, the extent of a node that is known to be on the way.
    """
    rows = waiting.withColumns({"b": F.size("keys"), "cut": F.lit(None).cast("binary"), "left": F.lit(False)})
    trie = trie.select(F.struct("lo", "hi", "id", "edge").alias("n"), "handle", "name")
    at, b = F.col("at"), F.col("b")
    for key in [*["handle"] * longest.bit_length(), "name"]:  # at last: an edge that is left before its handle
        by_handle = key == "handle"
        open_ = ~F.col("left") & (at < (b if by_handle else F.size("keys")))
        depth = fattest(at, b) if by_handle else at + 1
        rows = rows.withColumns({"open": open_, "ask": F.when(open_, F.get("keys", depth - 1)).otherwise(F.col("seq")), "depth": depth})
        rows = rows.join(trie.select("n", F.col(key).alias("ask")), "ask", "left")
        rows = rows.withColumn("met", F.when(F.col("open") & F.col("n.lo").isNotNull(), _met()))
        inside = F.coalesce(F.col("met") < F.col("n.hi"), F.lit(False))
        missed = F.col("open") & F.col("met").isNull() & F.lit(by_handle)
        rows = rows.select(
            "seq", "keys", "sums", F.coalesce("met", "at").alias("at"), F.when(missed, F.col("depth") - 1).otherwise(b).alias("b"),
            F.when(inside, F.col("n.id")).otherwise(F.col("cut")).alias("cut"), (F.col("left") | inside).alias("left"),
        )
    return rows.drop("b", "left")


def _cut(trie: DataFrame, cuts: DataFrame) -> DataFrame:
    """The nodes, split at the depths of ``cuts`` (id, depths)."""
    rows = trie.select("lo", "hi", "parent", "edge", "upto", "base", "id").join(cuts, "id", "left")
    ends = F.concat(F.array("lo"), F.coalesce(F.sort_array("depths"), F.array().cast("array<int>")), F.array("hi"))
    rows = rows.withColumn("ends", ends).select("*", F.posexplode(F.slice("ends", 1, F.size("ends") - 1)).alias("k", "from"))
    to = F.get("ends", F.col("k") + 1)
    part = lambda c: F.slice(c, F.col("from") - F.col("lo") + 1, to - F.col("from"))
    before = lambda c, top: F.when(F.col("k") == 0, F.col(top)).otherwise(F.get(c, F.col("from") - F.col("lo") - 1))
    return rows.select(F.col("from").alias("lo"), to.alias("hi"), before("edge", "parent").alias("parent"), part("edge").alias("edge"), part("upto").alias("upto"), before("upto", "base").alias("base"))


def build(sequences: DataFrame) -> DataFrame:
    """The compacted trie of ``sequences`` (seq, keys, sums): a table of nodes, the root left out."""
    spark = sequences.sparkSession
    longest = sequences.agg(F.max(F.size("keys"))).first()[0] or 0
    waiting = sequences.where("size(keys) > 0").select("seq", "keys", "sums", F.lit(0).alias("at"))
    trie = spark.createDataFrame([], _TRIE)
    while longest:
        waiting = C.written(located(waiting, trie, longest), "located")
        cuts = waiting.where("cut is not null").select(F.col("cut").alias("id"), F.col("at")).distinct().groupBy("id").agg(F.collect_set("at").alias("depths"))
        left = waiting.where(F.col("at") < F.size("keys")).withColumn("branch", F.get("keys", F.col("at")))
        first = C.written(left.groupBy("branch").agg(F.max_by(F.struct("seq", "keys", "sums", "at"), F.struct(F.size("keys").alias("n"), "seq")).alias("r")).select("branch", "r.*"), "batch")
        if first.isEmpty() and cuts.isEmpty():
            break
        at = F.col("at")
        new = first.select(
            at.alias("lo"), F.size("keys").alias("hi"), F.when(at == 0, F.lit(ROOT)).otherwise(F.get("keys", at - 1)).alias("parent"),
            F.slice("keys", at + 1, F.size("keys") - at).alias("edge"), F.slice("sums", at + 1, F.size("keys") - at).alias("upto"), F.when(at == 0, F.lit(0).cast("bigint")).otherwise(F.get("sums", at - 1)).alias("base"),
        )
        trie = C.written(_handles(_cut(trie, cuts).unionByName(new)), "trie")
        waiting = left.drop("branch", "cut").join(first.select("seq"), "seq", "left_anti")
        if waiting.isEmpty():
            break
    return trie


def summed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, parent, first, and numbers) with ``first`` the least and the numbers summed over each subtree.

    Round k adds what hangs 2^k levels below, then doubles the pointers; the root is nobody's child.
    """
    numbers = [c for c in nodes.columns if c not in ("id", "parent", "first")]
    rows = C.written(nodes, "sums")
    while not rows.where("parent is not null").isEmpty():
        below = rows.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.min("first").alias("f"), *[F.sum(c).alias(f"s_{c}") for c in numbers])
        added = [(F.col(c) + F.coalesce(f"s_{c}", F.lit(0).cast("bigint"))).alias(c) for c in numbers]
        more = rows.join(below, "id", "left").select("id", "parent", F.least("first", "f").alias("first"), *added)
        far = more.where(F.col("parent").isNotNull() & (F.col("parent") != F.lit(ROOT)))
        jump = far.join(rows.select(F.col("id").alias("parent"), F.col("parent").alias("far")), "parent", "left").withColumn("parent", F.col("far")).drop("far")
        top = more.where(F.col("parent").isNull() | (F.col("parent") == F.lit(ROOT))).withColumn("parent", F.lit(None).cast("binary"))
        rows = C.written(jump.unionByName(top), "sums")
    return rows.drop("parent")


#: Bytes of ids in a piece of a list.
PIECE = 1 << 20


def _pieces(batches):
    """Runs of a sequence's ids, in order, as comma-joined text of up to PIECE bytes."""
    seq, first, held, size = None, None, [], 0
    for batch in batches:
        rows = []
        for s, i in zip(batch.column("seq").to_pylist(), batch.column("id").to_pylist(), strict=True):
            if held and (s != seq or size >= PIECE):
                rows.append((seq, first, ",".join(held)))
                held, size = [], 0
            if not held:
                seq, first = s, i
            held.append(str(i))
            size += len(held[-1]) + 1
        if rows:
            yield _texts(rows)
    if held:
        yield _texts([(seq, first, ",".join(held))])


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], names=["seq", "first", "ids"])


def _hashed(batches):
    """The hash of each sequence's pieces, joined as they come."""
    seq, now, out = None, None, []
    for batch in batches:
        for s, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if s == seq:
                now.update(b"," + ids.encode())
                continue
            if now:
                out.append((seq, now.hexdigest()))
            seq, now = s, hashlib.sha256(ids.encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.binary()), pa.array([h for _, h in out])], names=["seq", "ends"])
            out = []
    if now:
        out.append((seq, now.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.binary()), pa.array([h for _, h in out])], names=["seq", "ends"])


def id_hashes(rows: DataFrame) -> DataFrame:
    """(seq, ends): SHA-256 of each sequence's ids, ascending and comma-joined.

    Ids are range-partitioned, so those of one sequence may lie in many tasks; each packs its part into pieces
    of PIECE bytes, and only the pieces of a sequence meet, as a stream that is hashed without being held.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.select("seq", "id").repartitionByRange(n, "seq", "id").sortWithinPartitions("seq", "id").mapInArrow(_pieces, "seq binary, first bigint, ids string")
    return packed.repartition(n, "seq").sortWithinPartitions("seq", "first").mapInArrow(_hashed, "seq binary, ends string")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations ``conversations`` (id, turns): all bigint but the hash.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    (childless nodes of the subtree), saved_tokens (over the subtree, members but one times the code points of the
    node's last text) and ends_sha256 (of the ids that end at the node, ascending, comma-joined). Conversations
    without turns end at the root. No conversation gives no row.
    """
    rows = C.written(conversations.mapInArrow(_chained, "id bigint, keys array<binary>, sums array<bigint>, seq binary"), "chains")
    sequences = C.written(rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.first("keys").alias("keys"), F.first("sums").alias("sums")), "sequences")
    trie = build(sequences)
    ended = sequences.select(F.col("seq").alias("id"), "n", "first", F.coalesce(F.element_at(F.when(F.size("sums") > 0, F.col("sums")), -1), F.lit(0)).cast("bigint").alias("text"))

    edges = trie.select("id", "parent", "lo", "hi", "upto", "base")
    root = sequences.limit(1).select(F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(-1).alias("lo"), F.lit(0).alias("hi"), F.array(F.lit(0).cast("bigint")).alias("upto"), F.lit(0).cast("bigint").alias("base"))
    edges = edges.unionByName(root)
    children = trie.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    edges = edges.join(children, "id", "left").join(ended, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    edges = C.written(edges.select("*", (F.element_at("upto", -1) - F.col("base")).alias("own")), "edges")
    sums = summed(edges.select("id", "parent", "first", zero(F.col("n")).alias("all"), F.col("children").isNull().cast("bigint").alias("leaves"), zero(F.col("n") * F.col("text")).alias("texts"), F.col("own").alias("owns")))
    found = C.written(edges.select("id", "parent", "lo", "upto", "base", "own", "children", F.col("n").alias("ended")).join(sums, "id"), "nodes")

    lists = id_hashes(rows.join(sequences.where("n > 1").select("seq"), "seq", "left_semi")).withColumnRenamed("seq", "id")
    found = found.join(found.select(F.col("id").alias("parent"), F.col("first").alias("above")), "parent", "left").join(lists, "id", "left")
    alone = ended.where("n = 1").select("id", F.sha2(F.col("first").cast("string").cast("binary"), 256).alias("one"))
    found = found.join(alone, "id", "left")
    each = found.select("*", F.posexplode("upto").alias("k", "total"))
    last, before = F.col("k") == F.size("upto") - 1, F.when(F.col("k") == 0, F.col("base")).otherwise(F.get("upto", F.col("k") - 1))
    below = F.col("texts") - F.col("all") * before - (F.col("owns") - F.col("own") + F.element_at("upto", -1) - before)
    return each.select(
        F.col("first").alias("conv_id"), (F.col("lo") + 1 + F.col("k")).cast("bigint").alias("depth"), F.when(F.col("k") == 0, F.col("above")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("all").alias("n_convs"),
        zero(F.when(last, F.col("children")).otherwise(1)).alias("n_children"), F.col("leaves").alias("n_leaves"), below.alias("saved_tokens"), F.when(last, F.coalesce("ends", "one")).otherwise(F.lit(None)).alias("ends_sha256"),
    ).fillna({"ends_sha256": hashlib.sha256(b"").hexdigest()})
