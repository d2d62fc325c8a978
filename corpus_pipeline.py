"""The corpus pipeline: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Between stages the documents are
written as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, ngram_join, piece_codec, pseudonyms, quality_rules
from weftline.llm.common import fresh_name, read_table, remove, remove_at_exit, shared_folder
from weftline.llm.queries import KEY, PIECES


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, public_tokenizers.path(PIECES))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return ngram_join.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars, where there is one, follows the new text."""
    hidden = pseudonyms.pseudonymise(docs, KEY, count_col=None)
    if "n_chars" not in docs.columns:
        return hidden
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they give the text back; a name that a column has already gets an underscore."""
    ids, n, back, decoded = (fresh_name(docs, c) for c in ("ids", "n_tokens", "round_trip", "decoded"))
    coded = piece_codec.round_trip(docs, public_tokenizers.path(PIECES), ids_col=ids, decoded_col=decoded)
    return coded.select(*docs.columns, ids, F.size(ids).cast("long").alias(n), (F.col(decoded) == F.coalesce("text", F.lit(""))).alias(back))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_first),
    ("benchmark decontamination", drop_leaks),
    ("PII", hide_private),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can't express the tokeniser and the keyed permutations; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    Null and empty texts fail the quality rules, so later stages never see
    them; rows that repeat an id and a text pass together; no documents give no
    rows. Other columns pass through, whatever their names.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:  # no later step reads what the stage before left
                remove(spark, f"{folder}/{k - 1}")
    remove_at_exit(spark, folder)
    return docs
