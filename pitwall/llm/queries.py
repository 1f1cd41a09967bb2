"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.llm import ann, common, exact_dedup, jaccard, langid, mixing, packing, phrases, prefix_trie, quality, suffix_dedup, token_count, token_output, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_text(_docs(spark, sf_dir).select("doc_id", "text"), keep="none")
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("sha256").alias("kept_sha256"), F.col("row.text").alias("text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_count.token_counts(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    root = token_output.write_tokens(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_tokens(spark, root)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(_docs(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_docs(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_docs(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_docs(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(common.table(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_collocations(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_token_output, op4_nearest_neighbours, op5_mixing, op6_packing,
                                   op7_jaccard_join, op8_toxicity, op9_quality_rules, op10_language_id, op11_exact_dedup, op12_prefix_trie, op13_phrases)}
ORACLE: dict[str, str] = {"op11_exact_dedup": exact_dedup.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_phrases": phrases.SQL}
