"""Sources, sinks and table maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "document_name string, page_number string, section_title string, chunk_id string, original_text string, text string, "
    "normalized_text string, language string, source_url string, authority_tier int"
)
EVAL_SCHEMA = (
    "id string, category string, difficulty string, question string, ground_truth_answer string, ground_truth_sources array<string>, "
    "ground_truth_sections array<string>, expected_verdict string, oos_reason string, adversarial_nature string"
)
ENTRY = "struct<title:string,organization:string,year:int,url:string,source_url:string,authority_tier:int>"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of chunks, in one file or many."""
    return spark.read.schema(CHUNK_SCHEMA).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry as one JSON object keyed by document name, or a list of objects with
    ``document_name``; one row a document."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<document_name:string,{ENTRY[7:]}>")
    keyed = F.from_json("value", f"map<string,{ENTRY}>")
    is_list = F.col("value").rlike(r"^\s*\[")
    a = raw.where(is_list).select(F.explode(listed).alias("e")).select("e.*")
    b = raw.where(~is_list).select(F.explode(keyed).alias("document_name", "e")).select("document_name", "e.*")
    return a.unionByName(b).withColumn("url", F.coalesce("source_url", "url")).drop("source_url")


def read_eval_items(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Evaluation items; ``oos`` is another name of the category ``out_of_scope``."""
    df = spark.read.schema(EVAL_SCHEMA).json(path, multiLine=True)
    return df.where(F.col("category") == {"oos": "out_of_scope"}.get(category, category)) if category else df


def read_vectors(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """The vector table joined to its chunks by id; vectors without a chunk are left out."""
    return spark.read.parquet(path).join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def binary_documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]], schema: str, pattern: str = "*.pdf") -> DataFrame:
    """Rows (path, status, *schema) parsed from binary files on the workers. ``parse`` gives the
    rows of one file; a file it fails on gives one row with the error as status."""
    fields = [f.split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [{"path": name, "status": "ok", **r} for r in parse(bytes(content))]
                except Exception as e:  # one bad file must not end the job
                    rows.append({"path": name, "status": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", "status", *fields]).astype(object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, f"path string, status string, {schema}")


def registry_key(name: Column) -> Column:
    """A document name without a file ending."""
    return F.regexp_replace(name, r"(?i)\.(pdf|docx?)$", "")


def enrich(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks with the registry's url and tier; missing ones are '' and null. The registry is
    one row a document name: of several the first by title."""
    one = Window.partitionBy("document_name").orderBy("title", "url")
    known = registry.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(
        F.col("document_name").alias("_key"), F.coalesce(F.col("url"), F.lit("")).alias("registry_url"), F.col("authority_tier").alias("registry_tier")
    )
    joined = chunks.withColumn("_key", registry_key(F.col("document_name"))).join(known, "_key", "left").drop("_key")
    return joined.withColumn("registry_url", F.coalesce("registry_url", F.lit("")))


def backfill(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Blank urls and null tiers filled from the registry; ``updated`` marks changed rows."""
    rows = enrich(chunks, registry)
    blank = F.coalesce("source_url", F.lit("")) == ""
    url = F.when(blank & (F.col("registry_url") != ""), F.col("registry_url")).otherwise(F.col("source_url"))
    tier = F.coalesce("authority_tier", "registry_tier")
    changed = (blank & (F.col("registry_url") != "")) | (F.col("authority_tier").isNull() & F.col("registry_tier").isNotNull())
    return rows.withColumn("updated", changed).withColumn("source_url", url).withColumn("authority_tier", tier).drop("registry_url", "registry_tier")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    last = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """``old`` with the keys of ``new`` replaced by the last row of ``new``."""
    fresh = latest(new, key, *order)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def deploy(spark: SparkSession, name: str, columns: str) -> bool:
    """Create the table when missing and say whether the catalog lists it."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    return spark.catalog.tableExists(name)
