"""A corpus pipeline over ``documents``: five stages, each one operator of ``pitwall.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.llm import common, exact_dedup, jaccard, langid, mixing, packing, suffix_dedup
from pitwall.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; ``lang`` becomes the language found."""
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Rows without an id stay. A document is an id and its text: unlike texts under one id are documents
    of their own, rows that repeat both are one."""
    text = F.col("row.text").cast("string")
    rows = docs.filter("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    # ids with unlike texts get a key a text (from 2**62 on); all others are their own key
    shared = common.stored(rows.select("id", F.xxhash64(text).alias("h")).groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi")
                           .select(F.col("id").alias("many")), "shared-ids")
    own = F.xxhash64("id", text).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    rows = rows.join(shared, F.col("id") == F.col("many"), "left").select("row", "id", F.when(F.col("many").isNotNull(), own).otherwise(F.col("id")).alias("key"))
    texts = rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))
    found = common.stored_alone(lambda: jaccard.jaccard_components(texts).select(F.col("doc_id").alias("key"), "component_id").distinct(), "components")
    # of each group: the key that stays, and whether that is all it has
    groups = (rows.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")).join(found, "key")
              .groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"), F.sum("n").alias("n")).select("component_id", F.col("first.key").alias("cell"), (F.col("n") == 1).alias("alone")))
    groups = common.stored(groups, "near-groups")
    shared_by = found.join(groups.filter("not alone").select("component_id"), "component_id").select(F.col("key").alias("cell"))
    # bitmaps tell rows that surely go, and rows that surely are alone; only the others, about a row a group, shuffle
    rows = exact_dedup.sifted(rows, "key", exact_dedup.sieve(groups.select("cell")), "first").filter("first")
    rows = exact_dedup.sifted(rows, "key", exact_dedup.sieve(shared_by, most=found.count()), "shared")
    kept = rows.filter("shared").join(groups, F.col("key") == F.col("cell"), "left_semi").withColumn("text", F.sha2(text, 256)).dropDuplicates(["key", "id", "text"])
    return rows.filter("not shared").unionByName(kept.select(rows.columns)).select("row.*").unionByName(docs.filter("doc_id is null"))


#: Bytes and words of a repeated passage: 51 words have well over 220 bytes, and shorter repeats stay.
PASSAGE = suffix_dedup.Params(length=220, gram=56)
PASSAGE_WORDS = 51


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of over 50 words are cut; the first stays. Texts with nothing left go."""
    cut = suffix_dedup.dedup_text(docs, "first", PASSAGE, PASSAGE_WORDS, with_bytes=False).filter("n_removed = 0 or n_removed < n_bytes")
    kind = docs.schema["n_chars"].dataType
    chars = F.when(F.col("n_removed") > 0, F.length("row.text")).otherwise(F.col("row.n_chars")).cast(kind)
    return cut.select(*(chars.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents resampled so that expected tokens by domain match the target weights."""
    return mixing.resample(docs, common.table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2,048 words: one row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mix),
    ("pack", pack),
]

#: Rolling hashes, learned classifiers and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "llm", f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
