"""Secret scanning with corpus-wide ownership frequency.

Patterns find candidates in every text. Hashes of all candidates are counted over the corpus by distinct
owners and repositories: a value that many owners carry is a copied example, one that a single owner
carries looks live. The three base kinds are reported as they are, each with that verdict; opaque tokens
that no base pattern covers are too common to report, and become spans only if one owner alone has them.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.llm import common as C

# Patterns of the base kinds, in their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "owned")
#: Owners from which on a value counts as a copied example.
EXAMPLE_OWNERS = 3
_SPAN = "array<struct<start:int,rank:int,`end`:int,hash:bigint>>"


def scanner():
    """text -> [(start, rank, end, value)]; starts and ends in code points."""
    assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
    # Maximal runs of one class: asking for the least length in the pattern finds the same spans.
    access, digits = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
    opaque = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

    def scan(text: str) -> list[tuple[int, int, int, str]]:
        out = [(m.start(), 0, m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end(), m[0]) for m in access.finditer(text)] if "AKIA" in text else []
        out += [(m.start(), 2, m.end(), m[0]) for m in digits.finditer(text)]
        base = sorted((a, b) for a, _, b, _ in out)
        for m in opaque.finditer(text):
            value = m[0]
            if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 8 and not any(a < m.end() and m.start() < b for a, b in base):
                out.append((m.start(), 3, m.end(), value))
        return sorted(out, key=lambda s: s[:3])

    return scan


def _scan(id_col: str, text_col: str):
    def run(batches):
        scan = scanner()
        for batch in batches:
            spans, digests = [], []
            for text in batch.column(text_col).to_pylist():
                found = scan(text or "")
                spans.append([{"start": a, "rank": k, "end": b, "hash": int.from_bytes(hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)} for a, k, b, v in found])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found if k < 3).encode()).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("__source"), pa.array(spans, kind), pa.array(digests, pa.string())],
                names=["id", "source", "found", "base_sha256"],
            )

    return run


#: A value is heavy if it has more than one in so many of all spans.
HEAVY = 1000


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_examples.

    spans joins kind:start:end by start, then kind. The repository is the source and the owner is its part
    before the first "/"; a null source is an owner of its own. n_live counts the spans whose value one
    owner has, n_examples those whose value EXAMPLE_OWNERS or more have. Null texts count as empty; rows
    that repeat are scanned each; an empty table gives an empty result; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(id_col, text_col, F.col(source_col).cast("string").alias("__source"))
    rows = rows.mapInArrow(_scan(id_col, text_col), f"id {kind}, source string, found {_SPAN}, base_sha256 string")
    rows = C.written(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    owner = F.coalesce(F.substring_index("source", "/", 1), F.lit(""))
    repository = [owner.alias("owner"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("repository")]
    each = rows.select("row", *repository, F.explode("found").alias("s"))
    each = each.select("row", "owner", "none", "repository", F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"), F.col("s.hash").alias("hash"))
    # Distinct first, with partial aggregation, so that a value in very many documents shrinks to its owners.
    pairs = each.groupBy("hash", "owner", "none", "repository").agg(F.count(F.lit(1)).alias("spans"))
    pairs = pairs.groupBy("hash", "owner", "none").agg(F.count(F.lit(1)).alias("repositories"), F.sum("spans").alias("spans"))
    owners = pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("spans").alias("spans"))
    owners = C.written(owners, "owners")
    # A heavy value's spans stay where they are: such values are fewer than HEAVY, and broadcast.
    all_spans = owners.agg(F.coalesce(F.sum("spans"), F.lit(0))).first()[0]
    heavy = F.broadcast(owners.where(F.col("spans") > all_spans // HEAVY).drop("spans"))
    light = each.join(heavy.select("hash"), "hash", "left_anti").join(owners.drop("spans"), "hash")
    judged = each.join(heavy, "hash").unionByName(light).where("rank < 3 or owners = 1")
    spans = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("all"),
        F.count_if(F.col("owners") == 1).alias("n_live"),
        F.count_if(F.col("owners") >= EXAMPLE_OWNERS).alias("n_examples"),
        F.max("repositories").alias("most_repositories"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")
    counted = lambda k: F.size(F.filter("all", lambda s: s["rank"] == k)).cast("bigint")
    spans = spans.select("row", text.alias("spans"), *[counted(k).alias(f"n_{KINDS[k]}") for k in range(4)], "n_live", "n_examples", "most_repositories")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = rows.join(spans, "row", "left")
    return out.select(F.col("id").alias(id_col), zero("n_assign"), zero("n_access"), zero("n_hex"), "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), zero("n_owned"), zero("n_live"), zero("n_examples"), zero("most_repositories"))
