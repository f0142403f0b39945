"""Exact deduplication with a two-pass Bloom filter, in DataFrame operations only.

Pass one counts the filter's slots, one short key per row (partial counts on the map side), and keeps those
that two or more rows hit. Pass two tests each row's slot: only rows whose slot is set travel on to the
shuffle on the whole hash, all others are known to be alone and pass straight through.

The filter has SLOTS slots for each row, so that at any size about one lone row in SLOTS takes the shuffle
too. It is a table of blocks (ranges of slots) with their bits. Up to MOST_BLOCKS blocks it is broadcast;
a larger one is dealt out by slot range, and rows without text or id meet it by a join on the block.

Hot groups: a group's winner is an aggregate with partial results. Groups with more than one row in HEAVY
are fewer than HEAVY; their winners are broadcast, so their rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm import common as C

#: Slots of the filter for each row, and least slots.
SLOTS, LEAST_SLOTS = 32, 1 << 16
#: Longs in a block, and blocks that are broadcast at most: 64 MB.
BLOCK, MOST_BLOCKS = 128, 1 << 16
#: A group is heavy with more than one in so many rows.
HEAVY = 1000


def _slots(n_rows: int) -> int:
    """A power of two that grows with the rows."""
    return 1 << (max(LEAST_SLOTS, SLOTS * n_rows) - 1).bit_length()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the text without white space).

    Of equal texts the one with most code points stays, then the smallest id; null texts count as empty,
    null ids come last, and of rows alike in all this exactly one is kept. Other columns are not read.
    An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.translate(text, C.SPACES, "").cast("binary"), 256)
    columns = [F.col(id_col).alias("id"), digest.alias("text_sha256"), F.char_length(text).alias("n")]
    base = C.written(docs.select(*columns, F.monotonically_increasing_id().alias("row")), "exact")
    n_rows = base.count()
    slots, wide = _slots(n_rows), BLOCK * 64
    slot = F.pmod(F.xxhash64("text_sha256"), F.lit(slots))

    # Pass one: the slots that two or more rows hit, as bits of blocks.
    hit = base.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    word, bit = F.expr(f"cast((slot % {wide}) div 64 as int)"), F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = hit.groupBy(F.expr(f"slot div {wide}").alias("block"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    listed = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.try_element_at("words", i), F.lit(0).cast("bigint")))
    blocks = listed.select("block", every.alias("bits"))
    blocks = F.broadcast(blocks) if slots <= MOST_BLOCKS * wide else blocks

    # Pass two: rows whose slot is set may be repeated.
    tested = base.withColumn("slot", slot).withColumn("block", F.expr(f"slot div {wide}")).join(blocks, "block", "left")
    again = F.expr(f"coalesce(getbit(bits[cast((slot % {wide}) div 64 as int)], cast(slot % 64 as int)) = 1, false)")
    tested = tested.select("id", "text_sha256", "n", "row", again.alias("again"))
    single = [F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept")]
    alone = tested.where(~F.col("again")).select("id", *single, "text_sha256")
    rows = tested.where("again").drop("again")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    winners = C.written(rows.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size")), "winners")
    heavy = F.broadcast(winners.where(F.col("group_size") > n_rows // HEAVY)) if n_rows else F.broadcast(winners.limit(0))
    light = rows.join(heavy.select("text_sha256"), "text_sha256", "left_anti")
    met = rows.join(heavy, "text_sha256").unionByName(light.join(winners, "text_sha256"))
    kept = (F.col("row") == F.col("best.row")).alias("kept")
    met = met.select("id", F.col("best.id").alias("keep_id"), "group_size", kept, "text_sha256")
    return alone.unionByName(met).withColumnRenamed("id", id_col)


@C.shielded
def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps: one of each text, whatever ids are null or repeat.

    Columns are unchanged; an empty table stays empty.
    """
    rows, _ = C.keyed(docs, id_col)
    return C.without(rows, exact_groups(rows, C.KEY, text_col).where("not kept").select(C.KEY), C.KEY).drop(C.KEY)
