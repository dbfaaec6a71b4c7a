"""A training corpus from ``documents``: toxic documents and near copies go, personal data is masked, sources are mixed,
and what is left is encoded. Each stage's rows are written as Parquet and read again as the next one's docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, common, mixing, pii, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the threshold. The classifier is fitted on labelled rows of docs that aren't held out.

    Null texts are scored as empty ones. Rows with a null id, and repeated rows, are scored like any other. Without usable
    labels nothing goes; an empty table gives none.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="score__").where(F.col("score__") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest (id, fingerprint). Null and empty texts are one group;
    rows with a null id stay; rows that share an id count each in its own group; an empty table gives none."""
    return simhash.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data and secrets in the text replaced by their kind, and n_chars as the text is then. Null
    texts stay null; repeated rows and null ids keep a row each; an empty table gives none."""
    masked = pii.redacted(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. A null source is a source of its own; texts without words take nothing and
    stay as often as their source is certain; repeated rows are told apart by their places; an empty table gives none."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row: counts and digests of ids and decoded bytes. Null and empty texts have no tokens; repeated rows and
    null ids keep a row each; an empty table gives none."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: SQL can't express fitted scores, near-duplicate components or BPE; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: (doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of the mix."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
