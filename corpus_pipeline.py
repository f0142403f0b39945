"""A training corpus from raw documents, in five stages; each stage's result is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armwise.llm import common as C
from armwise.llm import decontamination, jaccard_join, language_id, mixing, token_output
from armwise.llm.queries import byte_bpe


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows know.

    Rejected are texts without letters (null and blank ones too) and texts that are less like the language
    predicted for them than labelled texts ever are: in another language or script. Each row is judged by
    itself, also without an id or with one that repeats. With no labelled row all go; an empty table stays empty.
    Languages and what is least like them come from all labelled rows that are not held out.
    """
    return _in_known_languages(docs)


@C.shielded
def _in_known_languages(docs: DataFrame) -> DataFrame:
    rows, _ = C.keyed(docs, "doc_id")
    learned = ~C.fold("doc_id", 4, 2)
    known = language_id.prototypes(docs.where(learned))
    marked = rows.withColumn("__labelled", learned & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = C.written(language_id.identify(marked, known, C.KEY, also=("__labelled",)).drop("score"), "languages")
    least = language_id.least_cosine(found.where("__labelled"))
    rejected = found.where((F.col("lang_pred") == "und") | (F.col("cosine") < least))
    return C.without(rows, rejected.select(C.KEY), C.KEY).drop(C.KEY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the first by id (rows without an id come last).

    Documents without words are like no other and stay; rows that share an id are documents of their own.
    """
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts and an empty benchmark have none."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, with the words that the pass takes.

    A null source is a source of its own; documents without words give no row.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids; what each row's ids are, read back from the files.

    Null texts are one end id; rows without an id come first, rows that share one stand side by side.
    """
    path = f"{C.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    token_output.write_ids(docs, path, byte_bpe())
    return token_output.read_documents(spark, path)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Languages, ids and codes of a trained model and a tokenizer: SQL cannot express the first and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
