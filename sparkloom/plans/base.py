"""What the registered queries share: the registry, base relations, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread
from ..sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the DuckDB SQL it must equal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """For work that is heavy per row: the table's columns over all cores, see ``spread``."""
    return spread(table(spark, sf_dir, name).select(*columns))


def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, id): the smallest id of each chunk_id."""
    return table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.min("id").alias("id"))


def first_chunks(spark: SparkSession, sf_dir: str, *columns: str, heavy: bool = False) -> DataFrame:
    """One row per chunk_id, that of the smallest id, with the content to show and to search. Only
    ids are aggregated; texts move at most once, and not where the ids can be broadcast. ``heavy``:
    for work that is heavy per row, see ``spread``."""
    rows = table(spark, sf_dir, "chunks")
    if columns:
        rows = rows.select("id", "chunk_id", *columns)
    if heavy:
        rows = spread(rows)
    return rows.join(first_ids(spark, sf_dir).select("id"), "id", "left_semi")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged retrievals: rows logged twice dropped, ``run_id`` the smallest hit of a retrieval."""
    same = Window.partitionBy("query_id", "retrieved_at", "rank_no").orderBy("hit_id")
    hits = table(spark, sf_dir, "retrieved_hits").withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    run = Window.partitionBy("query_id", "retrieved_at")
    return hits.withColumn("run_id", F.min("hit_id").over(run)).withColumnRenamed("rank_no", "rank")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the question and the ground truth of their evaluation item."""
    items = table(spark, sf_dir, "eval_items").select(
        F.col("id").alias("query_id"), "category", "difficulty", F.col("question").alias("query"), "expected_verdict",
        F.array_distinct(F.transform(F.coalesce("ground_truth_sources", F.array()), F.lower)).alias("ground_truth"),
    )
    return runs(spark, sf_dir).join(items, "query_id")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged runs with the content of each hit; hits whose chunk is gone are out."""
    text = first_chunks(spark, sf_dir, "original_text").select("chunk_id", F.col("original_text").alias("content"))
    return judged(spark, sf_dir).join(text, "chunk_id")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_registry")


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def tokset(x: str) -> str:
    return f"list_distinct({tok(x)})"


SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?]){SPACE}', '\1' || chr(1), 'g'), chr(1))"


FIRST_CHUNKS = "first_chunks AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY id) = 1)"
RUNS = """runs AS (SELECT *, rank_no AS rank, min(hit_id) OVER (PARTITION BY query_id, retrieved_at) AS run_id FROM (
  SELECT * FROM retrieved_hits QUALIFY row_number() OVER (PARTITION BY query_id, retrieved_at, rank_no ORDER BY hit_id) = 1))"""
JUDGED = f"""{RUNS}, judged AS (SELECT r.*, e.category, e.difficulty, e.question AS query, e.expected_verdict,
  list_distinct(list_transform(coalesce(e.ground_truth_sources, []), lambda x: lower(x))) AS ground_truth
  FROM runs r JOIN eval_items e ON e.id = r.query_id)"""
EVIDENCE = f"{FIRST_CHUNKS}, {JUDGED}, evidence AS (SELECT j.*, c.original_text AS content FROM judged j JOIN first_chunks c USING (chunk_id))"

__all__ = [n for n in dir() if not n.startswith("_")] + ["S"]
