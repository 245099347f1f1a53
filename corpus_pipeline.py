"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept, written as Parquet and read again:
language ID drops texts without a language and names that of all others, SimHash keeps one document of each
group of near-duplicates, decontamination drops documents with a passage of
the benchmark, secrets are masked in the texts, and byte-level BPE encodes the
texts and checks the decoding.

Every stage takes an empty table (and gives one), texts of any length, and extra columns of any name, which
all stages but the last hand on as they are. Each docstring says what becomes of nulls and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import bpe, decontaminate, language, secrets, simhash
from chronolith.llm.common import crc_mod, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from three quarters of the labelled documents, labels all by their text, and drops those without a language; ``lang`` becomes what was found.

    Null and empty texts, and those without a letter, go. Rows without an id are judged but not learnt from; each of
    several equal rows is judged alike. Nothing to learn from: all rows go, as no language is known.
    """
    model = language.train(docs.where(crc_mod("doc_id", 4) != 2))
    return language.assign(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of its smallest id; a group without any id keeps one row.

    Null and empty texts share the fingerprint of no words, so they are one group. Of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows with a passage of the benchmark; null and empty texts have none and stay as they are, as do repeated rows and rows without an id."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets become a mark; n_chars follows the text. All rows stay; a null text stays null, and has a null n_chars."""
    masked = secrets.redact(docs, keep=tuple(docs.columns))
    masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of tokens, and digests of the ids and of the text decoded from them; a row for each row, null texts as empty ones."""
    keep = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mask_secrets", mask_secrets),
    ("encode", encode),
]

#: A conditional random field can't be fitted in SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
