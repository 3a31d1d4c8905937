"""A training corpus from `documents`: quality, exact and near duplicates, mixing, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import exact_dedup, mixing, packing, quality, simhash
from nearfield.llm.common import BATCH_SETTING, lower_ascii, shared_folder, small_batches, table
from nearfield.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels that are not held out."""
    small_batches(spark)
    return quality.keep_good(docs, quality.learn_quality(docs, table(spark, sf_dir, "labels")))


def _text_key() -> Column:
    return F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256)


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of docs for each of chosen (doc_id, text_key, rows; one row per id and key), whose id may be null. Texts
    move on only for keys that several rows share, each task sending one of them at most."""
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("text_key").alias("chosen_key"), "rows")
    keyed = docs.withColumn("text_key", _text_key())
    found = keyed.join(chosen, keyed.doc_id.eqNullSafe(F.col("chosen_id")) & (keyed.text_key == F.col("chosen_key")))
    several = found.where("rows > 1").dropDuplicates(["doc_id", "text_key"])
    return found.where("rows = 1").select(*docs.columns).unionByName(several.select(*docs.columns))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest id stays, of those without any id one row."""
    found = exact_dedup.exact_duplicates(docs).where("kept")
    return _only(docs, found.groupBy("doc_id", F.col("text_sha256").alias("text_key")).agg(F.count("*").alias("rows")))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies, one row with the smallest id stays, of those without any id one row. Near copies are texts whose
    sets of five-word shingles have a Jaccard similarity of at least 0.8, and what such links tie together."""
    small_batches(spark)
    found = simhash.similar_documents(docs.withColumn("text_key", _text_key()), similarity=0.8, width=5, carry=("text_key",))
    texts = found.groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    first = texts.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "rows")).alias("first"))
    return _only(docs, first.groupBy("first.doc_id", "first.text_key").agg(F.max("first.rows").alias("rows")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come nearer to equal weights: each document stays, those of small sources are read up to twice."""
    small_batches(spark)
    return mixing.mixed_documents(docs, mixing.Target(max_repeats=2.0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Classifier and tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what each returns is written as Parquet to the shared folder and read again. The session's size of
    batches for Python is as before then."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    batch = spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(BATCH_SETTING, batch)
    return docs
