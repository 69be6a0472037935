"""Corpus preparation in five stages: toxicity, near-duplicates, secrets, mixing, tokens.

Each stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.llm import bpe, mixing, secret_scan, simhash
from caselake.llm import toxicity as toxic
from caselake.llm.common import delete_folder, shared_folder, table, text_of
from caselake.llm.queries import BYTE_BPE, held_out, token_digest

#: What every stage needs; further columns are carried along. A stage's own columns can't clash with them, because the row is
#: carried as one struct.
NEEDED = ["doc_id", "text", "source"]


def rows(docs: DataFrame) -> DataFrame:
    return docs.select(*NEEDED, F.struct("*").alias("_row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; labels of held-out ids teach nothing.

    Null and empty texts count as texts without words, which are not toxic. Null ids have no labels. Repeated rows get the same
    score, so all of them stay or go. Very long texts are scored whole. An empty table gives an empty one. All columns stay.
    """
    return toxic.toxicity(rows(docs), table(spark, sf_dir, "labels"), held_out(5, 0)).where("predicted = 0").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id.

    Of repeated rows one stays. All texts without words (null, empty) are one group. A null id stays only where a group has no
    other. An empty table gives an empty one. All columns stay.
    """
    return simhash.keep_one(rows(docs)).select("_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the text, and ``n_chars`` follows; all documents stay, repeated ones too.

    A null text stays null (and its ``n_chars`` as it was), an empty one empty. A null source is no owner. An empty table gives
    an empty one. All columns stay.
    """
    clean = secret_scan.redact(rows(docs))
    chars = F.coalesce(F.length("text").cast("long"), F.col("_row.n_chars"))
    return clean.select(*(F.col("text") if c == "text" else chars.alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number: not at all, once or twice.

    Texts stay whole. A text without words costs nothing and stays once. Rows that repeat id, text and source share what the mix
    takes of them. Null ids and sources are values like others. An empty table gives an empty one. All columns stay.
    """
    key = ["_no_id", "_id", "_key", "_no_source", "_source"]
    of = lambda d, text_key: d.withColumns(dict(zip(key, (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), text_key, F.col("source").isNull(), F.coalesce("source", F.lit(""))), strict=True)))
    share = F.when(F.sum("size") == 0, F.lit(1)).otherwise(F.floor(mixing.ROUNDS * F.sum("taken") / F.sum("size") + 0.5).cast("int"))  # each row is there once a round
    taken = of(mixing.mix(docs), F.col("text_key")).groupBy(*key).agg(share.alias("_copies")).where("_copies > 0")
    joined = of(rows(docs), F.xxhash64(text_of())).join(taken, key)
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document, checked by decoding the ids.

    Null and empty texts have no ids. Repeated rows come back each; an empty table gives an empty one.
    """
    encoded = bpe.encode(docs.select("doc_id", "text"), BYTE_BPE, public_tokenizers.PATTERN).select("doc_id", "ids")
    return token_digest(bpe.decode(encoded, BYTE_BPE, public_tokenizers.PATTERN)).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixture), ("tokens", tokens)]

#: Character models, hashes with a seed and byte-pair merges can't be said in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again.

    A stage's rows are deleted once its successor's are written. Those of the last stay, as the result is read from them.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
