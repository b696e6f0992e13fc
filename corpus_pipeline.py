"""A corpus from raw documents to packed sequences: each stage is one of the operators in tessera.llm.

Every stage takes a table with the columns of documents, whatever their order and whatever columns it has besides, and keeps them. Rows with null
or repeated ids stay rows of their own, null texts count as empty, whole texts are read however long, and no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, minhash, packing, quality, secrets
from tessera.llm.common import mark, release, settle, table
from tessera.llm.queries import tokenizer


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is trained on the labelled ones among those given and on a bounded number of others. Without
    labels of both classes all stay. Equal rows share their fate; a null or empty text is judged like any other."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that which comes first. Rows get numbers of their own, so that null or repeated ids are no matter and of
    equal rows one stays; texts without words, null or empty, are near no other and stay."""
    own = "_row"
    while own in docs.columns:
        own += "_"
    rows = settle(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    gone = minhash.near_duplicates(rows.select(F.col(own).alias("doc_id"), "text")).filter("not kept").select(F.col("doc_id").alias(own))
    return rows.join(gone, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, each judged by its own text; null and empty texts hold none."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret that the scan's ledger holds for a text replaced in it by a mark that no rule matches; n_chars follows where a text changes. Null
    and empty texts stay as they are."""
    findings, _ = secrets.scan(docs)
    return secrets.redact_found(docs, findings)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences; a null or empty text is the end id alone, equal rows are packed each."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("near-duplicates", distinct),
    ("decontamination", clean),
    ("secrets", safe),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each one's rows written to the shared folder and read again; what a stage wrote on its way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = mark()
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        release(before - (i > 0))  # with the stage's input, which is the last table before
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizer ids, a trained model and edit distances are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
