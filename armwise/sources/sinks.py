"""Results to files: rows as CSV, JSON or Parquet, and the metadata of a run beside them."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("csv", "json", "parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's ``spark.checkpoint.dir``; in a temporary folder for a local master without one.

    It is deleted when the application ends.
    """
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(place or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own, read again: later uses do not compute it anew, and agree on its rows."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def fingerprint(rows: DataFrame) -> list:
    """Aggregates that tell a table of rows in any order and partitions: number, XOR and sum of the rows' hashes."""
    row = F.xxhash64(F.lit(len(rows.columns)), *[F.col(f"`{c}`") for c in rows.columns])
    whole = F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("string")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"), whole.alias("sum")]


def write_rows(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", manifest: bool = False) -> str:
    """Result rows as a folder of files, written by the tasks that hold them; nested columns need JSON or Parquet.

    With ``manifest``, the number, fingerprint and schema of the rows are taken while they are written, and put
    beside the folder (``<path>.manifest``) for ``read_rows`` to check.
    """
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {', '.join(FORMATS)}")
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    writer = (rows.observe(seen, *fingerprint(rows)) if manifest else rows).write.mode(mode)
    (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).format(kind).save(path)
    if manifest:
        write_metadata(rows.sparkSession, {"kind": kind, "schema": rows.schema.jsonValue(), **seen.get}, f"{path}.manifest", mode)
    return path


def read_rows(spark: SparkSession, path: str, schema=None, kind: str = "parquet", verify: bool = False) -> DataFrame:
    """What ``write_rows`` wrote, under the schema of the rows (or the manifest's).

    With ``verify``, the rows are read once to be compared with the manifest: lost, added, repeated or changed rows
    are a ValueError.
    """
    facts = read_metadata(spark, f"{path}.manifest") if verify or schema is None else {}
    reader = spark.read.schema(StructType.fromJson(facts["schema"]) if schema is None else schema)
    rows = (reader.option("header", True).option("escape", '"') if kind == "csv" else reader).format(kind).load(path)
    if verify:
        found = rows.agg(*fingerprint(rows)).first().asDict()
        off = {k: (facts[k], v) for k, v in found.items() if facts[k] != v}
        if off:
            raise ValueError(f"{path} is not what its manifest tells: {off}")
    return rows


def write_metadata(spark: SparkSession, facts: dict, path: str, mode: str = "errorifexists") -> str:
    """The facts of a run (names, sizes, settings) as one JSON line, by way of Spark's file systems."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode(mode).text(path)
    return path


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
