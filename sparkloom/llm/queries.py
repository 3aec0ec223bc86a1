"""The registered queries of the numbered problems. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knn, langid, leakage, neardup, oracles, packing, spans, textform, tokens
from .common import stage, table

Query = Callable[[SparkSession, str], DataFrame]
ANSWERS = ["question", "ground_truth_answer"]


def _first_of_each(chunks: DataFrame) -> DataFrame:
    """The record of each chunk_id with the smallest id (others were ingested again)."""
    return chunks.join(chunks.groupBy("chunk_id").agg(F.min("id").alias("id")).select("id"), "id")


def _label(c: str) -> Column:
    return F.coalesce(langid.label_of(F.col(c)), F.lit("unknown"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "source_registry").groupBy(F.col("document_name").alias("source")).agg(F.min(F.lower(F.trim("organization"))).alias("domain"))
    chunks = _first_of_each(table(spark, sf_dir, "chunks").select("id", "chunk_id", "document_name", "language", F.col("original_text").alias("text")))
    chunks = chunks.select(F.lit("chunks").alias("collection"), F.col("chunk_id").alias("name"), "text", F.regexp_replace("document_name", r"(?i)\.(pdf|docx?|html?|txt)$", "").alias("source"), _label("language").alias("language"))
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("collection"), F.col("doc_id").cast("string").alias("name"), "text", "source", _label("lang").alias("language"), F.lower(F.trim("domain")).alias("domain")
    )
    return chunks.join(registry, "source", "left").select(docs.columns).unionByName(docs)


def p1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_budget(_records(spark, sf_dir))


def p1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_records(spark, sf_dir)).select("collection", "name", "source", "language", "domain", "n_chars", "n_tokens")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.similar_pairs(knn.most_similar(table(spark, sf_dir, "chunk_vectors"), k=5)).select("vec_a", "vec_b")


def p2_most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar of every vector whose id is divisible by 20."""
    return knn.most_similar(table(spark, sf_dir, "chunk_vectors"), k=10).where(F.col("id") % 20 == 0).select(F.col("id").alias("vec_id"), "rank", F.col("other").alias("neighbour_id"), "cosine")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.near_duplicates(table(spark, sf_dir, "chunks"), "id", "chunk_id", "original_text", size=3, threshold=0.5, least=10)
    return neardup.record_pairs(members, links)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk: its group at five words and 0.8, and its number of linked classes."""
    chunks = table(spark, sf_dir, "chunks")
    members, links = neardup.near_duplicates(chunks, "id", "chunk_id", "original_text")
    short = neardup.short_members(chunks, members, "id", "chunk_id", "original_text")
    return neardup.record_groups(members.unionByName(short), links).select(F.col("name").alias("chunk_id"), F.col("rep").alias("class_id"), "group_id", "n_links", "group_size")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.regexp_replace("normalized_text", r"[\s\p{Z}]+", "") != "", F.col("normalized_text")).otherwise(F.col("original_text"))
    return table(spark, sf_dir, "chunks").select("id", text.alias("text"), F.col("language").alias("label"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return langid.wrong_labels(rows, langid.trained(rows)).select("id", F.explode("languages").alias("language"))


def p4_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return langid.language_parts(rows, langid.trained(rows))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = textform.look_alike_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "original_text")
    return pairs.select(F.col("name_a").alias("chunk_a"), F.col("name_b").alias("chunk_b"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").select("id", "original_text", "normalized_text")
    return textform.with_forms(rows, {"original_text": "original_form", "normalized_text": "normalized_form"}).select("id", "original_form", "normalized_form")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return stage(tokens.counted(docs), "sizes")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(_sizes(spark, sf_dir), 2048)
    return rows.select(F.col("key").alias("doc_id"), "part", "token_start", "n_tokens", F.col("container").alias("container_id"))


def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill of refined and of plain Harmonic packing."""
    sizes = _sizes(spark, sf_dir)
    refined, plain = packing.packed(sizes, 2048), packing.packed(sizes, 2048, grain=None)
    return packing.fill_report(refined, 2048).withColumn("method", F.lit("refined harmonic")).unionByName(packing.fill_report(plain, 2048).withColumn("method", F.lit("harmonic")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "id", ANSWERS)
    return found.select(F.col("key").alias("doc_id"), "item_id").distinct()


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "id", ANSWERS)
    return found.withColumnRenamed("key", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents")).select("doc_id", "span_start", "span_end")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    named = [
        p1_token_budget, p1_token_counts, p2_found, p2_most_similar, p3_found, p3_groups, p4_found, p4_parts,
        p5_found, p5_forms, p6_containers, p6_fill_report, p7_found, p7_passages, p8_found, p8_coverage,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """Brute force in SQL for the queries it can express (see ``oracles``). Tests hold the others
    against brute force, exact round trips or held-out accuracy."""
    return oracles.oracle_sql()
