"""Decision logs as JSON lines, CSV or parquet, appended by batch and replayed in order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORMATS = ("json", "csv", "parquet")
#: Values come back as they were, white space, quotes and line ends included.
CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def append(df: DataFrame, path: str, kind: str = "json") -> None:
    """Adds a batch; the file commit makes it whole or absent."""
    if kind not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    w = df.write.mode("append")
    (w.options(**CSV) if kind == "csv" else w).format(kind).save(path)


def replay(spark: SparkSession, path: str, schema, kind: str = "json", order: list[str] | None = None) -> DataFrame:
    """The records; malformed lines are errors, blank ones are skipped. order: columns that fix the sequence, as files have none."""
    r = spark.read.schema(schema)
    if kind != "parquet":
        r = r.option("mode", "FAILFAST")
    df = (r.options(**CSV) if kind == "csv" else r).format(kind).load(path)
    return df.orderBy(*order) if order else df


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; a local session without one uses its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tessera-stores"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def roundtrip(df: DataFrame, kind: str) -> DataFrame:
    path = scratch(df.sparkSession)
    append(df, path, kind)
    return replay(df.sparkSession, path, df.schema, kind)


def decision_record(df: DataFrame, typed: list[str]) -> DataFrame:
    """The typed columns, and all others as one JSON object by name."""
    rest = sorted(set(df.columns) - set(typed))
    return df.select(*typed, F.to_json(F.struct(*rest)).alias("metadata"))


def settle(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: what several steps read is made once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def decision_lines(df: DataFrame, now: Column | None = None) -> DataFrame:
    """(value): each row as one line of JSON with a UTC time stamp and its keys in order; missing values are written as null."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp() if now is None else now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    stamped = df if "timestamp" in df.columns else df.withColumn("timestamp", stamp)
    return stamped.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(stamped.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def append_decisions(df: DataFrame, path: str, now: Column | None = None) -> None:
    """Adds a batch of decisions to a log of lines."""
    decision_lines(df, now).write.mode("append").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value, problem): the lines of a log that are not blank, numbered from 1 in their file as they stand there; problem says which are no
    JSON or no object. Lines of a file are numbered on their own, so that files may be many."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value")
    lines = raw.select("file", F.row_number().over(W.partitionBy("file").orderBy("at")).cast("long").alias("line"), "value").filter(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    problem = F.when(parsed.isNull(), "malformed").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
    return lines.withColumn("problem", problem)


def replay_decisions(spark: SparkSession, path: str, schema) -> DataFrame:
    """The records of a log of lines with their file and line; a line that is no JSON object ends the job with an error that names it."""
    lines = read_lines(spark, path)
    where = F.concat(F.col("problem"), F.lit(" decision at "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    value = F.when(F.col("problem").isNull(), F.col("value")).otherwise(F.raise_error(where))
    return lines.select("file", "line", F.from_json(value, schema).alias("r")).select("file", "line", "r.*")
