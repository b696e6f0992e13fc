"""One query an operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, licenses, minhash, oracles, packing, quality, secrets, substrings, tokencount, topk, warc
from tessera.llm.common import table


def tokenizer(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op2_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))


def op3_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf, "documents"))


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf, "documents"))


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf, "labels")))


def op7_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op8_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


def op9_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf, "documents"), tokencount.zipf_model(tokenizer("piece_bpe_32k.model")))


def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf, "documents"))[0])


def secrets_by_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger of the base rules first, to which the other rules are added: only their pairs are scanned, and the rows equal op10's."""
    docs = table(spark, sf, "documents")
    _, ledger = secrets.scan(docs, versions={k: secrets.VERSIONS[k] for k in secrets.BASE})
    return secrets.digest(secrets.scan(docs, ledger)[0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_pack, op3_licenses, op4_warc, op5_substrings, op6_quality, op7_topk, op8_minhash, op9_tokens, op10_secrets, secrets_by_versions)}

def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": oracles.op3(), "op4_warc": oracles.OP4, "op5_substrings": oracles.OP5, "op7_topk": oracles.OP7, "op8_minhash": oracles.OP8, "op10_secrets": oracles.op10(), "secrets_by_versions": oracles.op10()}
