"""Block and allow lists for URLs: a blocked Bloom filter, then an exact hash join. DataFrame operations only.

Entries of the lists are rules (a host with its subdomains, and a prefix of the path) and canonical URLs. A
page's URL has a few candidates: its canonical form, and each suffix of its host with each prefix of its path
that is as long as some rule's. All are tested in the row against the filter; only those that may be listed
leave it, for a join on the whole strings that removes false positives. Other rows pass straight through.

A key's bits lie in one block of LONGS longs, one bit in each, so a test reads neighbouring words. The filter
takes BITS bits a key and is cut into slices of up to MOST_BLOCKS blocks (16 MB); a list of any size is tested
slice by slice over the URLs (never the pages' text), so no more than a slice is held at a time.

Hot keys: a rule that a third of the pages meet is one key of the join. Up to BROADCAST_ROWS and BROADCAST_BYTES
the entries are broadcast after they are counted; beyond, the distinct candidates meet the entries first, and
the pages then join what was found, which Spark splits at hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwise.llm import common as C

#: Bits of the filter for each key, longs of a block (one bit of a key in each), blocks of a slice.
BITS, LONGS, MOST_BLOCKS = 16, 8, 1 << 18
#: Entries that are broadcast at most, and the characters in them.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Query parameters that say where a visitor came from: not part of a canonical URL.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> list[Column]:
    """host (A-Z lower-cased), path and query of a URL; empty for null and for text without ``://``.

    The host ends at the first of ``/ ? #``, the path at the first of ``? #``, the query at ``#``.
    """
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    found = lambda pattern: F.regexp_extract(rest, f"(?s)^([^/?#]*){pattern}", 2)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return [host.alias("host"), found("([^?#]*)").alias("path"), found("[^?#]*(?:[?]([^#]*))?").alias("query")]


def canonical(host: Column, path: Column, query: Column) -> Column:
    """One spelling of a URL: no scheme, ``www.``, usual port, slash at the end, tracking parameter or fragment."""
    plain = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    asked = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.concat(plain, F.regexp_replace(path, "/+$", ""), F.when(asked == "", F.lit("")).otherwise(F.concat(F.lit("?"), asked)))


def listed_by_words(pages: DataFrame, words: list[str], url_col: str = "url") -> DataFrame:
    """(url): the canonical URLs of pages whose host has one of the words between dots and hyphens."""
    rows = pages.select(*parts(F.col(url_col)))
    told = F.arrays_overlap(F.split("host", "[.:-]"), F.lit(words))
    return rows.where(told).select(canonical(F.col("host"), F.col("path"), F.col("query")).alias("url")).distinct()


def _entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(host, path, verdict) of the rules, the smallest verdict of equal ones, and (url as path, null host) of the list."""
    ruled = rules.where("host <> '' and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    urls = listed.where("url is not null").select(F.lit(None).cast("string").alias("host"), F.col("url").alias("path"), F.lit(None).cast("string").alias("verdict"))
    return ruled.unionByName(urls.distinct())


def _key(host: Column, path: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(host, F.lit("\n")), path)


def _filter(keys: DataFrame, blocks: int) -> Column:
    """The filter of one slice's (block, bits): an array of LONGS longs for each block, as a scalar."""
    bit = lambda j: F.expr(f"shiftleft(1L, cast(shiftright(bits, {6 * j}) & 63 as int))")
    each = keys.groupBy("block").agg(*[F.bit_or(bit(j)).alias(f"b{j}") for j in range(LONGS)])
    every = keys.sparkSession.range(blocks).select(F.col("id").alias("block")).join(each, "block", "left")
    longs = F.array(*[F.coalesce(f"b{j}", F.lit(0).cast("bigint")) for j in range(LONGS)])
    ordered = F.sort_array(F.collect_list(F.struct("block", longs.alias("longs"))))
    return every.agg(F.flatten(F.transform(ordered, lambda x: x["longs"])).alias("longs")).scalar()


def _may(seen: Column, block: Column, bits: Column) -> Column:
    """Whether all bits of a key are set."""
    test = lambda j: F.getbit(F.get(seen, (block * LONGS + j).cast("int")), F.shiftright(bits, 6 * j).bitwiseAND(F.lit(63)).cast("int")) == 1
    out = test(0)
    for j in range(1, LONGS):
        out = out & test(j)
    return out


def _candidates(lengths: list[int]) -> Column:
    """(host, path) of every entry that may fit a row: the canonical URL, and suffixes of the host by prefixes of the path."""
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    url = F.struct(F.lit(None).cast("string").alias("host"), F.col("canonical").alias("path"))
    fits = F.filter(F.lit(lengths), lambda n: n <= F.char_length("path")) if lengths else F.array().cast("array<int>")
    ruled = F.flatten(F.transform(suffixes, lambda h: F.transform(fits, lambda n: F.struct(h.alias("host"), F.substr("path", F.lit(1), n).alias("path")))))
    return F.when(F.col("host") != "", F.concat(F.array(url), F.filter(ruled, lambda r: r["host"] != "")))


def possible_hits(rows: DataFrame, entries: DataFrame, n_entries: int) -> DataFrame:
    """``rows`` (host, path, canonical, ...) with ``hits``: the candidates that the filter passes."""
    lengths = sorted(r[0] for r in entries.where("host is not null").select(F.char_length("path")).distinct().collect())  # no more than the longest path
    slices = max(1, -(-n_entries * BITS // (64 * LONGS * MOST_BLOCKS)))
    blocks = max(1, min(MOST_BLOCKS, -(-n_entries * BITS // (64 * LONGS * slices))))
    spot = lambda h, p: F.pmod(_key(h, p, 1), F.lit(blocks * slices))
    kind = "array<struct<host:string,path:string>>"
    rows = rows.withColumn("hits", F.array().cast(kind))
    keys = C.written(entries.select(spot(F.col("host"), F.col("path")).alias("spot"), _key(F.col("host"), F.col("path"), 2).alias("bits")), "keys")
    for s in range(slices):
        mine = keys.where(F.col("spot") % slices == s).select(F.expr(f"spot div {slices}").alias("block"), "bits")
        seen = _filter(mine, blocks)
        test = lambda c: (spot(c["host"], c["path"]) % slices == s) & _may(F.col("seen"), F.floor(spot(c["host"], c["path"]) / slices), _key(c["host"], c["path"], 2))  # noqa: E731, B023
        passed = F.coalesce(F.filter(_candidates(lengths), test), F.array().cast(kind))
        rows = rows.withColumn("seen", seen).withColumn("hits", F.concat("hits", passed)).drop("seen")
        rows = C.written(rows, "hits")
    return rows


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, listed (whether the canonical URL is in the list).

    ``rules`` are (host, path, verdict): a rule fits its host and all subdomains where the URL's path starts with
    its own; the longest wins (host and path together, then the longer host), and of equal rules the smallest
    verdict. Without a rule a listed URL is blocked, others are allowed. Rules without a host and null entries
    fit nothing; entries may repeat. Null URLs and those without ``://`` have an empty host and path, and are
    allowed. Rows that repeat an id, or have none, are judged each; other columns are not read; an empty table
    gives an empty result.
    """
    url = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), *url).withColumn("canonical", canonical(F.col("host"), F.col("path"), F.col("query"))).drop("query")
    rows = C.written(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    entries = C.written(_entries(rules, listed), "entries")
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("path") + F.coalesce(F.char_length("host"), F.lit(0))), F.lit(0)).alias("chars")).first()
    rows = possible_hits(rows, entries, size.n)

    hits = rows.where("size(hits) > 0").select("row", "id", "host", "path", F.explode("hits").alias("h"))
    exact = entries.select(F.struct("host", "path").alias("h"), F.xxhash64("host", "path").alias("hash"), F.lit(True).alias("found"), "verdict")
    hits = hits.withColumn("hash", F.xxhash64("h.host", "h.path"))
    if size.n > BROADCAST_ROWS or size.chars > BROADCAST_BYTES:
        asked = hits.select("hash", "h").distinct()
        exact = C.written(asked.join(exact, ["hash"]).where(asked["h"].eqNullSafe(exact["h"])).select(exact["h"], "hash", "found", "verdict"), "met")
    else:
        exact = F.broadcast(exact)
    exact = exact.withColumnsRenamed({"h": "e", "hash": "e_hash"})
    met = hits.join(exact, (F.col("hash") == F.col("e_hash")) & F.col("h").eqNullSafe(F.col("e")), "left")
    rule = F.when(F.col("found") & F.col("e.host").isNotNull(), F.struct((F.char_length("e.host") + F.char_length("e.path")).alias("all"), F.char_length("e.host").alias("own"), F.col("e").alias("rule"), "verdict"))
    best = met.groupBy("row").agg(F.max(rule).alias("best"), F.coalesce(F.bool_or(F.col("found") & F.col("e.host").isNull()), F.lit(False)).alias("listed"), *[F.first(c).alias(c) for c in ("id", "host", "path")])
    other = rows.where("size(hits) = 0").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    judged = best.select("id", "host", "path", F.concat("best.rule.host", "best.rule.path").alias("rule"), verdict.alias("verdict"), "listed")
    return judged.unionByName(other).withColumnRenamed("id", id_col)
