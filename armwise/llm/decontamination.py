"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

A seed is the hash of the words that a fixed mask selects from a window; the words at its other places
may differ. Seeds of the benchmark set the bits of a Bloom filter that is sized by their number. Each
document tests its own seeds against it, so only the few that may match leave the row, each with the words
around it; these join the benchmark's seeds, and the aligned words around a hit decide.

Whatever agrees enough is seeded: 10 to MOST aligned words of which 80 % or more agree hold four words in
a row that agree or, where replacements leave three at most, the second mask; longer passages have a part
of LEAST to MOST words that agrees as much. REACH words around a seed hold all windows of MOST words with it.

The benchmark is the small side: up to BROADCAST_SEEDS seeds are counted and broadcast, so that documents
never shuffle, however many share a passage. Beyond that the hits join by a shuffle, which Spark splits at
hot seeds; beyond FILTER_SEEDS no filter is made and all seeds of the documents take the join.

A seed of more than HOT places of the benchmark is a stock phrase: its hits would meet all of them. There
each distinct stretch of a document around the hit first counts, for each of its words, the places that
have the word at the same distance from the seed. A window that may differ at k places agrees at one of any
k + 1, so a place is only compared if it agrees at one of the k + 1 rarest of some window. A document that
has nothing but the phrase meets no place, however many there are; what agrees enough is met as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwise.llm import common as C

# The masks of the seeds.
SEEDS = ("1111", "111001")
#: Share of aligned words that must agree, in per cent; how many words are compared at least, but for shorter
#: items, and at most.
AGREE, LEAST, MOST = 80, 13, 25
#: Words on either side of a seed in which windows are sought.
REACH = MOST - 4
#: Words below which an item is matched only whole and exactly.
EXACT = 10
#: Bits of the filter for each seed; seeds up to which a filter is made (256 KB), and up to which they are broadcast.
BITS, FILTER_SEEDS, BROADCAST_SEEDS = 16, 1 << 17, 1 << 20
#: Places of one seed in the benchmark beyond which its hits are compared by rarer words around them.
HOT = 32
#: Words are runs of other characters than these, in lower case.
SEPARATORS = r"\x20\x09-\x0D.,;:!?\"'()\[\]{}<>|*_#`~-"


def word_hashes(text: str) -> Column:
    """Hashes of a text's words: lower case, without punctuation. Null and blank texts have none."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"[{SEPARATORS}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(words: str, mask: str) -> Column:
    """Seeds at all places of a mask; empty for shorter texts. Runs of equal places are hashed pairwise."""
    places, whole, n = [k for k, c in enumerate(mask) if c == "1"], F.col(words), F.size(words)
    shifted = lambda a, k: F.slice(a, k + 1, F.greatest(n - len(mask) + 1, F.lit(0))) if k else F.slice(a, 1, F.greatest(n - len(mask) + 1, F.lit(0)))
    out = F.transform(shifted(whole, 0), lambda x: F.xxhash64(x)) if len(places) == 1 else shifted(whole, places[0])
    for k in places[1:]:
        out = F.zip_with(out, shifted(whole, k), lambda x, y: F.xxhash64(x, y))
    return out


def _ones(same: Column) -> Column:
    return F.aggregate(same, F.lit(0), lambda a, x: a + x)


def _span() -> Column:
    """The best window of the compared words, (agreeing, -compared); null if none agrees enough."""
    least = F.least(F.lit(LEAST), F.col("length"))
    sums = F.aggregate("same", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def window(upto: Column, i: Column, j: Column) -> Column:
        agreeing, compared = F.get(upto, j) - F.get(upto, i), j - i
        enough = F.when(F.col("length") < EXACT, agreeing == compared).otherwise(100 * agreeing >= AGREE * compared)
        return F.when(enough, F.struct(agreeing.alias("agreeing"), (-compared).alias("c")))

    ends = lambda i: F.sequence(i + least, F.least(i + MOST, F.size("same")))
    windows = lambda upto, i: F.array_max(F.transform(ends(i), lambda j: window(upto, i, j)))
    best = lambda upto: F.array_max(F.transform(F.sequence(F.lit(0), F.size("same") - least), lambda i: windows(upto, i)))
    return F.get(F.transform(F.array(sums), best), 0)  # the sums are made once a row


def _bits(seeds: DataFrame, longs: int) -> Column:
    """The filter: an array of so many longs, as a scalar."""
    spots = seeds.select(F.pmod("seed", F.lit(longs * 64)).alias("spot"))
    bit = F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bit")
    bits = spots.select(F.shiftright("spot", 6).cast("int").alias("word"), bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = seeds.sparkSession.range(longs).select(F.col("id").cast("int").alias("word")).join(bits, "word", "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"])
    return every.agg(ordered.alias("bits")).scalar()


def _may(seed: Column, longs: int) -> Column:
    """Whether a seed is in the filter of the column ``seen``."""
    spot = F.pmod(seed, F.lit(longs * 64))
    return F.getbit(F.get("seen", F.shiftright(spot, 6).cast("int")), spot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _span_of(masks: list[str]) -> Column:
    """The length of the row's mask."""
    return F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1)


def _compared(met: DataFrame, masks: list[str], *ids: str) -> DataFrame:
    """(ids, item, length, same) of hits beside places: 1 and 0 for aligned words; those that may agree enough, once each."""
    lead, span = F.least("before", "q"), _span_of(masks)
    ours = F.slice("near", F.col("before") - lead + 1, lead + span + REACH)
    theirs = F.slice("words", F.col("q") - lead + 1, lead + span + REACH)
    same = F.zip_with(ours, theirs, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1).otherwise(0)))
    met = met.select(*ids, "item", F.size("words").alias("length"), F.filter(same, lambda x: x.isNotNull()).alias("same"))
    least = F.least(F.lit(LEAST), F.col("length"))
    return met.where((F.size("same") >= least) & (100 * _ones(F.col("same")) >= AGREE * least)).distinct()


def _rarest(span: Column) -> Column:
    """Of ``around`` (n, d, word), by place, what to look up: of each window around the seed that may differ at k
    places, the k + 1 words of fewest places. Words of no place are left out."""
    none, size = F.array().cast("array<int>"), F.size("around")
    most = F.when(F.col("class") < LEAST, F.col("class")).otherwise(MOST)

    def starts(n: Column) -> Column:
        first, last = F.greatest(F.lit(0), F.col("before") + span - n), F.least(F.col("before"), size - n)
        return F.when(first <= last, F.sequence(first, last)).otherwise(none)

    def of_length(n: Column) -> Column:
        slack = F.when(n < EXACT, 0).otherwise(F.floor(n * (100 - AGREE) / 100)).cast("int")
        return F.flatten(F.transform(starts(n), lambda i: F.slice(F.sort_array(F.slice("around", i + 1, n)), F.lit(1), slack + 1)))

    found = F.flatten(F.transform(F.sequence(F.col("class"), most), of_length))
    return F.filter(F.array_distinct(found), lambda x: x["n"] > 0)


def _hot_hits(near: DataFrame, places: DataFrame, masks: list[str]) -> DataFrame:
    """(id, item, length, same) of the hits ``near`` on stock phrases, whose ``places`` are rows of the seeds."""
    group, at, span = ["mask", "seed", "class"], ["mask", "seed", "before", "near"], _span_of(masks)
    lead = F.least("q", F.lit(REACH))
    words = places.select(*group, "item", "q", "words", lead.alias("lead"), F.posexplode(F.slice("words", F.col("q") - lead + 1, lead + span + REACH)).alias("pos", "word"))
    words = C.written(words.select(*group, "item", "q", "words", (F.col("pos") - F.col("lead")).alias("d"), "word"), "places")
    keys = C.written(words.groupBy(*group, "d", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_SEEDS else keys

    stretches = C.written(near.select(*at).distinct().withColumn("stretch", F.monotonically_increasing_id()), "stretches")
    classes = places.select(*group).distinct()
    ours = stretches.join(classes, ["mask", "seed"]).select("stretch", *group, "before", F.posexplode("near").alias("pos", "word"))
    ours = ours.withColumn("d", F.col("pos") - F.col("before")).join(keys, [*group, "d", "word"], "left")
    placed = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), "d", "word")))
    around = F.transform(placed, lambda x: F.struct(x["n"].alias("n"), x["d"].alias("d"), x["word"].alias("word")))
    around = ours.groupBy("stretch", *group, "before").agg(around.alias("around"), F.count("n").alias("known"))
    around = C.written(around.where(100 * F.col("known") >= AGREE * F.col("class")), "around")  # a phrase alone ends here
    asked = around.select("stretch", *group, F.explode(_rarest(span)).alias("x")).select("stretch", *group, "x.d", "x.word")
    pairs = asked.join(words, [*group, "d", "word"]).select("stretch", "item", "q", "words").distinct()
    agreed = C.written(_compared(pairs.join(stretches, "stretch"), masks, *at), "agreed")
    return near.join(agreed, at).select("id", "item", "length", "same")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, compared, agreeing): documents that contain a passage of a benchmark item, and the best match.

    A passage is LEAST or more consecutive words of an item, or a whole shorter item, of which at least AGREE
    per cent agree with the words at the same places of a stretch of the document: words are replaced, not
    inserted or left out. Items of fewer than EXACT words must be there whole and unchanged; items without
    words match nothing. All passages are found. The best match is, of all windows of LEAST to MOST aligned
    words (shorter items: of the item) that agree enough, the one with most agreeing words, then the shortest.
    Null texts have no words; null ids are kept and match like others; rows that repeat an id count as one;
    other columns are not read; empty tables give an empty result.
    """
    items = C.written(benchmark.select(F.col(item_col).alias("item"), word_hashes(item_text).alias("words")).where("size(words) > 0"), "items")
    short = {r.n for r in items.select(F.size("words").alias("n")).where(f"n < {len(SEEDS[0])}").distinct().collect()}  # three numbers at most
    masks = [*SEEDS, *("1" * n for n in sorted(short))]
    seeds = None
    for m, mask in enumerate(masks):
        some = items.where(f"size(words) {'=' if m >= len(SEEDS) else '>='} {len(mask)}")
        part = some.select("item", "words", F.lit(m).alias("mask"), F.posexplode(_seeds("words", mask)).alias("q", "seed"))
        seeds = part if seeds is None else seeds.unionByName(part)
    seeds = C.written(seeds.withColumn("class", F.least(F.size("words"), F.lit(LEAST))), "seeds")
    n_seeds = seeds.count()
    longs = 1 << max(6, (BITS * n_seeds // 64).bit_length())
    may = (lambda seed: _may(seed, longs)) if n_seeds <= FILTER_SEEDS else (lambda seed: F.lit(True))
    seen = _bits(seeds, longs) if n_seeds <= FILTER_SEEDS else F.lit(None)

    text = docs.select(F.col(id_col).alias("id"), word_hashes(text_col).alias("words"), seen.alias("seen"))
    before = lambda p: F.least(p, F.lit(REACH))

    def hits_of(m: int, mask: str) -> Column:
        near = lambda p: F.slice("words", p - before(p) + 1, before(p) + len(mask) + REACH)
        found = F.transform(_seeds("words", mask), lambda s, i: F.when(may(s), F.struct(s.alias("seed"), i.alias("p"))))
        found = F.filter(found, lambda x: x.isNotNull())
        around = lambda x: [before(x["p"]).alias("before"), near(x["p"]).alias("near")]
        return F.transform(found, lambda x: F.struct(F.lit(m).alias("mask"), x["seed"].alias("seed"), *around(x)))

    hits = [hits_of(m, mask) for m, mask in enumerate(masks)]
    rows = text.select("id", F.explode(F.concat(*hits)).alias("h")).select("id", "h.*")
    small = n_seeds <= BROADCAST_SEEDS
    hot = C.written(seeds.groupBy("mask", "seed", "class").count().where(F.col("count") > HOT).drop("count"), "hot")
    if hot.isEmpty():
        met = _compared(rows.join(F.broadcast(seeds) if small else seeds, ["mask", "seed"]), masks, "id")
    else:
        rows, cold = C.written(rows, "near"), seeds.join(hot, ["mask", "seed", "class"], "left_anti")
        places, phrases = seeds.join(hot, ["mask", "seed", "class"]), hot.select("mask", "seed").distinct()
        met = _compared(rows.join(F.broadcast(cold) if small else cold, ["mask", "seed"]), masks, "id")
        near = rows.join(F.broadcast(phrases) if small else phrases, ["mask", "seed"], "left_semi")
        met = met.unionByName(_hot_hits(near, places, masks))
    met = C.written(met, "hits")
    best = met.select("id", "item", _span().alias("match")).where("match is not null").groupBy("id", "item").agg(F.max("match").alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("best.c")).cast("bigint").alias("compared"), F.col("best.agreeing").cast("bigint").alias("agreeing"))


@C.shielded
def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark, columns unchanged; each row is judged by itself."""
    rows, _ = C.keyed(docs, id_col)
    return C.without(rows, overlaps(rows, benchmark, C.KEY, text_col).select(C.KEY), C.KEY).drop(C.KEY)
