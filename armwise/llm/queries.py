"""The corpus operators as queries over whole tables; their SQL is in ``oracles``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armwise.llm import class_lm, decontamination, exact_dedup, jaccard_join, language_id, mixing, prefix_trie, secret_scan, substring_dedup, token_alignment, token_output, toxicity, url_filter
from armwise.llm import common as C
from armwise.llm.oracles import ORACLES as ORACLES


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(C.documents(spark, sf_dir), texts_out=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(C.documents(spark, sf_dir))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(C.documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    known = language_id.prototypes(docs.where(~C.fold("doc_id", 4, 2)))
    found = language_id.identify(docs, known)
    return found.select("doc_id", C.fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "cosine")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{C.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    token_output.write_ids(C.documents(spark, sf_dir), path, byte_bpe())
    return token_output.read_documents(spark, path)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, taken = mixing.mix(C.documents(spark, sf_dir))
    return taken.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(C.documents(spark, sf_dir))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(C.documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = toxicity.fit(docs.where(~C.fold("doc_id", 4, 2)), labels)
    found = toxicity.score_texts(docs, index)
    return found.select("doc_id", C.fold("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "evidence")


#: The rules of op11 (fixed values), and the words of a host whose captured URLs make the list.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED_WORDS = ["casino", "pills", "bets", "adult", "spam", "ads"]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules, url_filter.listed_by_words(pages, LISTED_WORDS))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.written(prefix_trie.turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefix_trie.prefix_nodes(prefix_trie.forked(turns))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(C.documents(spark, sf_dir), byte_bpe(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_jaccard_join, op4_language_id, op5_token_output, op6_source_mixing, op7_decontamination, op8_exact_dedup, op9_class_lm, op10_toxicity, op11_url_filter, op12_prefix_trie, op13_token_alignment)}
