"""Inverted index and vector table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each row counted where they lie together."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            terms = part.column("terms")
            many = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = terms.flatten().dictionary_encode()
            width, begin = max(1, len(flat.dictionary)), np.cumsum(many) - many
            found, first, tf = np.unique(np.repeat(np.arange(len(many)), many) * width + flat.indices.to_numpy(), return_index=True, return_counts=True)
            row = found // width
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(row)), part.column("weight").take(pa.array(row)), flat.dictionary.take(pa.array(found % width)), pa.array(tf, pa.int64()), pa.array(first - begin[row], pa.int32())],
                ["id", "weight", "term", "tf", "first_position"],
            )


def postings(rows: DataFrame, id_col: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, weight, term, tf, first_position) for the (column, weight) ``fields``: for each row of
    ``rows`` one row per term of a field. Null and blank fields post nothing. Nothing is shuffled."""
    parts = F.array(*[F.struct(F.lit(w).alias("weight"), F.coalesce(T.tokens(F.col(c)), F.array()).alias("terms")) for c, w in fields])
    spread = rows.select(F.col(id_col).alias("id"), F.explode(parts).alias("part")).select("id", "part.weight", "part.terms").where(F.size("terms") > 0)
    kind = spread.schema["id"].dataType.simpleString()
    return spread.mapInArrow(_counted, f"id {kind}, weight string, term string, tf long, first_position int")


def term_statistics(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, document_frequency, collection_frequency)."""
    one = postings(rows, id_col, [(text_col, "C")])
    return one.groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"), F.sum("tf").alias("collection_frequency"))
