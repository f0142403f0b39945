"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents, in a pseudo-random order, form a stream of words that is cut into blocks of
equal length. Golden-ratio points fall into the sources' shares of the unit interval and so deal slots
to sources evenly at every prefix. Shares go by the slots that a source needs for its target, and SPARE
more; of its slots it uses as many as it needs, evenly spaced. The used slots of a source are ranked, and
slot r takes block r modulo the number of blocks: a source below its target is read again from its
start. Every source, however small, fills its target, which its last slot meets to the word.

Prefix sums over a hot source never run in one task: rows are dealt to groups by their random order, the
groups are summed first, and ranks and offsets inside a group are added to those sums. There are as many
groups as a group has rows, so both sums stay at the square root of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armwise.llm import common as C

#: A source gives at most so many times its size.
MOST = 3
#: Words of a block: a share of all words within these bounds. Sources of fewer words are one short block.
LEAST_BLOCK, MOST_BLOCK = 64, 4096
#: Blocks into which a small corpus is cut.
BLOCKS = 4096
#: Slots of a source beyond those it needs: more than golden-ratio points may stray from any share.
SPARE = 32


def _golden(i: Column) -> Column:
    """frac(i * golden ratio), in two parts so that large i keep their precision."""
    g = (math.sqrt(5) - 1) / 2
    high, low = F.shiftright(i, 20), i.bitwiseAND(F.lit((1 << 20) - 1))
    x = high * F.lit(math.fmod(g * (1 << 20), 1.0)) - F.floor(high * F.lit(math.fmod(g * (1 << 20), 1.0))) + low * F.lit(g)
    return x - F.floor(x)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight, source_size, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A
    target stops at MOST times its source's size and the excess goes to the others by weight: with the
    level L solving sum(min(MOST * size, L * weight)) = total, targets are min(MOST * size, L * weight).
    The window runs over one row per source, after aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", turn.cast("bigint")).withColumn("most", F.lit(MOST) * F.col("source_size"))
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    below = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(whole),
        "full": F.coalesce(F.sum("most").over(below), F.lit(0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0)),
    })
    # The level if exactly the sources before this one are full; the first that isn't full itself decides.
    level = (F.col("total") - F.col("full")) / F.col("open")
    decides = F.when(level * F.col("weight") <= F.col("most"), F.struct(F.row_number().over(rising).alias("at"), level.alias("level")))
    per = per.withColumn("level", F.min(decides).over(whole)["level"])
    return per.select("source", "weight", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, row_col: str | None) -> DataFrame:
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    size = F.size(C.words_of(text_col)).cast("bigint")
    # The text parts rows without an id, or with one that repeats.
    order = F.shiftrightunsigned(F.xxhash64(id_col, F.xxhash64(text_col), F.lit(seed)), 1)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), row.alias("row"), order.alias("order"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix's slots, and what it takes of each document.

    slots: (slot, source, block, pass, row, id, first, words): slot takes ``words`` words of a document
    from its word ``first`` on. taken: (id, source, size, source_size, target, taken), one row per input
    row. Null texts have no words and are taken 0 times; null sources are a source of their own, last in
    order; rows that repeat an id count as rows of their own. Documents stand in the order of a hash of id and
    text; where both repeat, reruns agree for one table as laid out. An empty table gives empty results.
    """
    spark = docs.sparkSession
    rows = C.written(_sized(docs, seed, id_col, text_col, source_col, row_col), "sizes")
    goal = C.written(targets(rows.select("source", "size"), weights).withColumn("key", F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")))), "targets")
    total, sources = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    block = min(MOST_BLOCK, max(LEAST_BLOCK, total // BLOCKS))
    groups = max(1, math.isqrt(rows.count()))

    # Stream positions: documents in hash order; groups are slices of that order.
    source_key = F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    placed = rows.where("size > 0").withColumn("key", source_key).withColumn("group", F.floor(F.col("order") / F.lit(2.0**63) * groups).cast("bigint"))
    sums = placed.groupBy("key", "group").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    inner = Window.partitionBy("key", "group").orderBy("order", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    stream = placed.withColumn("offset", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["key", "group"])
    stream = stream.withColumn("at", F.col("base") + F.col("offset")).select("key", "row", "id", "size", "at")
    pieces = stream.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))

    # Slots: points of the schedule, through the sources' cumulative shares, by cells of the unit interval.
    shares = goal.where("target > 0").withColumns({"quota": F.round("target").cast("bigint")}).where("quota > 0")
    n_blocks = F.ceil(F.col("source_size") / block)
    shares = shares.withColumn("need", F.expr("quota div source_size") * n_blocks + F.ceil(F.pmod("quota", "source_size") / block))
    shares = shares.withColumn("high", F.sum(F.col("need") + SPARE).over(Window.orderBy("key"))).withColumn("all", F.sum(F.col("need") + SPARE).over(Window.partitionBy()))
    slots_n = int(shares.agg(F.max("all")).first()[0] or 0)
    shares = shares.select("key", "source", "source_size", "quota", "need", ((F.col("high") - F.col("need") - SPARE) / F.col("all")).alias("lo"), (F.col("high") / F.col("all")).alias("hi"))
    # As many cells as sources at least: a point meets two sources on average, however many there are.
    cells = max(1024, sources)
    table = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    points = spark.range(slots_n).withColumn("u", _golden(F.col("id"))).withColumn("cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)))
    dealt = points.join(table, "cell").where("u >= lo and u < hi").select(F.col("id").alias("slot"), "key", "source_size", "quota", "need", F.shiftright(F.col("id"), 16).alias("part"))
    counts = dealt.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("dealt", F.sum("n").over(Window.partitionBy("key"))).drop("n")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("key", "part").orderBy("slot")) - 1).join(counts, ["key", "part"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    # Of its dealt slots a source uses those at which the whole part of rank * need / dealt goes up.
    used = F.expr("(rank * need) div dealt")
    ranked = ranked.where(F.expr("((rank + 1) * need) div dealt") > used).withColumn("rank", used)
    ranked = ranked.withColumns({"block": F.pmod("rank", n_blocks), "pass": F.floor(F.col("rank") / n_blocks)})
    # What is left of the quota when the slot's turn comes: a pass takes the whole source.
    ranked = ranked.withColumn("left", F.col("quota") - F.col("pass") * F.col("source_size") - F.col("block") * block).where("left > 0")
    ranked = ranked.select("slot", "key", "block", "pass", "left")

    first = F.greatest(F.col("at"), F.col("block") * block)
    last = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.least(F.col("left"), F.lit(block)))
    slots = ranked.join(pieces, ["key", "block"]).withColumns({"first": first - F.col("at"), "words": last - first}).where("words > 0")
    slots = slots.select("slot", "key", "block", "pass", "row", "id", "first", "words")
    taken = slots.groupBy("row").agg(F.sum("words").alias("taken"))
    goal = goal.select("key", "source_size", "target")
    result = rows.withColumn("key", source_key).join(goal, "key").join(taken, "row", "left")
    return slots, result.select("row", "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


@C.shielded
def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each pass over a document, in which the
    words taken in that pass stand; a pass that takes a document whole leaves its text unchanged."""
    text = options.get("text_col", "text")
    rows = C.written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    slots, _ = mix(rows, row_col="__row", **options)
    spans = slots.groupBy(F.col("row").alias("__row"), "pass").agg(F.min("first").alias("__first"), F.sum("words").alias("__words")).drop("pass")
    words = C.words_of(text)
    part = F.array_join(F.slice(words, (F.col("__first") + 1).cast("int"), F.col("__words").cast("int")), " ")
    cut = F.when(F.col("__words") == F.size(words), F.col(text)).otherwise(part)
    return rows.join(spans, "__row").select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
