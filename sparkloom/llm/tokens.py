"""Token counts under an existing tokenizer, and token budgets by slice (problem 1).

Whole texts are hashed; each distinct text is tokenized once; its exact count is joined back and
totals count every record with its multiplicity. The vocabulary is a file of the driver, whose
path is a parameter; Spark sends it to every worker once.

Edge cases: null and empty texts have 0 tokens and count as records; missing labels and names
are the slice ``unknown``; records are counted once per name, taken from their smallest id.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pre-tokenization pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    if not text:
        return 0
    return len(encoder(vocabulary).encode_ordinary(text))


def counted(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) for rows (key, text)."""
    kind = rows.schema["key"].dataType.simpleString()
    rows.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64())], ["key", "n_tokens"])

    return rows.select("key", "text").mapInArrow(run, f"key {kind}, n_tokens long")


def token_counts(records: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``records`` (with a column ``text``) without their text, with ``n_chars`` and
    ``n_tokens``. Each distinct text is tokenized once."""
    keyed = records.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    distinct = keyed.select(F.col("_key").alias("key"), "text").dropDuplicates(["key"])
    counts = counted(distinct, vocabulary)
    light = keyed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).drop("text")
    return light.join(counts.withColumnRenamed("key", "_key"), "_key").drop("_key")


def token_budget(records: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(collection, level, slice, records, distinct_texts, n_chars, tokens) for records
    (collection, text, source, language, domain): totals by each of the three levels."""
    keyed = records.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    counts = counted(keyed.select(F.col("_key").alias("key"), "text").dropDuplicates(["key"]), vocabulary)
    named = [F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown")).alias(c) for c in ("source", "language", "domain")]
    copies = keyed.select("collection", *named, "_key", F.coalesce(F.length("text"), F.lit(0)).alias("n")).groupBy("collection", "source", "language", "domain", "_key").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("n").alias("n_chars")
    )
    joined = copies.join(counts.withColumnRenamed("key", "_key"), "_key")
    slices = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("slice")) for x in ("source", "language", "domain")])).alias("x")
    by = ["collection", "level", "slice"]
    # A text once in each slice first, so that no slice, however large, is one task's work.
    once = joined.select("collection", "_key", "copies", "n_chars", "n_tokens", slices).select("collection", "x.level", "x.slice", "_key", "copies", "n_chars", "n_tokens").groupBy(*by, "_key").agg(
        F.sum("copies").alias("copies"), F.sum("n_chars").alias("n_chars"), F.first("n_tokens").alias("n_tokens")
    )
    return once.groupBy(*by).agg(
        F.sum("copies").alias("records"), F.count(F.lit(1)).alias("distinct_texts"), F.sum("n_chars").alias("n_chars"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"),
    )
