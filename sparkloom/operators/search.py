"""Vector and lexical search of a stated query set against all rows.

Both score Arrow batches of rows against a block of queries and keep the best k of each query inside
a task (see ``batch``), so a task sends k rows a query, not a row a pair. One block of queries
goes to the tasks with the code. More vectors are laid out with the rows in a grid of cells by
shuffle and never pass through the driver; more terms meet the rows' terms in an equi-join, where
they are broadcast within the measured bound of ``bounds``, or joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions import vectors as V
from . import batch, fusion
from .bounds import bounded, dimension, fits

CELL = 20_000  # rows of a cell of the grid of vector search (64 floats each: 5 MB)


def top_ranked(rows: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """``rank`` 1..k by score, ties to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cosines(matrix: np.ndarray):
    """Cosines in millionths of unit queries and the vectors of a batch."""

    def score(part: pa.RecordBatch) -> np.ndarray:
        rows = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
        return batch.units(matrix @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T)

    return score


def _cell(k: int, query_type: str, id_type: str):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        key_kind, id_kind = batch.KINDS[query_type], batch.KINDS[id_type]
        queries = asked.column("query_id").to_pylist()
        best = batch.Best(len(queries), k)
        if asked.num_rows and rows.num_rows:
            matrix = asked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(asked.num_rows, -1)
            score = _cosines(matrix / np.linalg.norm(matrix, axis=1, keepdims=True))
            for part in rows.combine_chunks().to_batches(max_chunksize=4096):
                ids = part.column("id")
                best.add(score(part), np.array(ids.to_pylist(), object) if id_type == "string" else ids.to_numpy(zero_copy_only=False))
        if best.ids is None:
            return pa.table([pa.array([], t) for t in (key_kind, id_kind, pa.float64())], ["query_id", "id", "score"])
        return pa.Table.from_batches([best.batch(queries, key_kind, id_kind)])

    return run


def vector_topk(queries: DataFrame, rows: DataFrame, k: int, dim: int, block: int = 1000, cell: int = CELL) -> DataFrame:
    """(query_id, id, score, rank): the k rows of highest cosine (double precision, rounded to 6
    decimals, ties to the smaller id) for each query of ``queries`` (query_id, v) in ``rows`` (id,
    v). Up to ``block`` queries are held against the rows where these lie. More are cut into
    blocks, the rows into groups of about ``cell``; each pair of a block and a group is one task's
    work and sends at most k rows a query on. Vectors that are null, of another length, with NaN
    or infinite entries or all zero neither ask nor answer. A query whose id equals a row's is
    answered by that row too."""
    key, name = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    asked, known = queries.where(V.usable(F.col("v"), dim)).select("query_id", "v"), rows.where(V.usable(F.col("v"), dim) & F.col("id").isNotNull()).select("id", "v")
    schema = f"query_id {key}, id {name}, score double"
    first = asked.limit(block + 1).collect()  # at most block + 1 rows
    if not first:
        return top_ranked(rows.sparkSession.createDataFrame([], schema), k)
    if len(first) <= block:
        matrix = np.array([r["v"] for r in first], np.float64)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        return top_ranked(batch.best_rows(known, [r["query_id"] for r in first], key, k, _cosines(matrix), 4096), k)
    blocks, groups = -(-asked.count() // block), max(1, -(-known.count() // cell))
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    left = asked.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block"), every(groups, "_group"))
    right = known.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("_group"), every(blocks, "_block"))
    at = ["_block", "_group"]
    return top_ranked(left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_cell(k, key, name), schema), k)


def above(hits: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    return hits.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def query_terms(queries: DataFrame, expanded: bool = False) -> DataFrame:
    """(query_id, term, n_terms), one row per distinct term of each query (query_id, text)."""
    terms = T.expand_synonyms(F.col("text")) if expanded else T.token_set(F.col("text"))
    return queries.select("query_id", terms.alias("terms")).select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def matched_terms(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, id, n_terms, matched) for ``rows`` (id, text): how many of a query's terms a
    row holds. Only terms that some query asks for are exploded out of a row."""
    return _terms_by_row(rows).join(bounded(asked), "term").groupBy("query_id", "id").agg(F.first("n_terms").alias("n_terms"), F.count(F.lit(1)).alias("matched"))


def _terms_by_row(rows: DataFrame) -> DataFrame:
    """(id, term) laid out by id: the texts are shuffled once, and what is grouped by query and
    id afterwards needs no further shuffle. Without it the pairs of queries and rows would be."""
    return rows.select("id", "text").repartition("id").select("id", F.explode(T.token_set(F.col("text"))).alias("term"))


def match_all(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, id) of the rows that hold every term of the query."""
    return matched_terms(query_terms(queries), rows).where("matched = n_terms").select("query_id", "id")


def token_rows(rows: DataFrame, *more: str) -> DataFrame:
    """(id, terms, ...) of ``rows`` (id, text, ...)."""
    return rows.select("id", F.coalesce(T.tokens(F.col("text")), F.array()).alias("terms"), *more)


def weighted_match(queries: DataFrame, rows: DataFrame, k: int, weights: tuple[float, float, float] = (1.0, 0.4, 0.2)) -> DataFrame:
    """Top k of ``rows`` (id, a, b, c: texts) that hold every term of the query in some field, by the mean
    over the terms of the largest ``weights`` of a field that holds it (section, name, content)."""
    a, b, c = (F.coalesce(T.token_set(F.col(x)), F.array()) for x in "abc")
    once = (a, F.array_except(b, a), F.array_except(F.array_except(c, a), b))
    weighted = lambda x, w: F.transform(x, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    terms = F.concat(*[weighted(x, w) for x, w in zip(once, weights)])
    held = rows.select("id", F.explode(terms).alias("x")).select("id", "x.term", "x.w")
    got = held.join(bounded(query_terms(queries)), "term").groupBy("query_id", "id").agg(F.first("n_terms").alias("n"), F.count(F.lit(1)).alias("m"), F.sum("w").alias("w"))
    return top_ranked(got.where("m = n").select("query_id", "id", F.round(F.col("w") / F.col("n"), 6).alias("score")), k)


def fallback(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, rank): what is left when scoring is not to be had. Rows (id, text,
    document_name, language) with every term of the query, under its optional filters ``document``
    and ``language`` (null: none), the k smallest ids, similarity 0."""
    terms = query_terms(queries).join(queries.select("query_id", "document", "language"), "query_id")
    asked = terms.select("query_id", "n_terms", "term", F.col("document").alias("_d"), F.col("language").alias("_l"))
    held = rows.select("id", "document_name", "language", F.explode(T.token_set(F.col("text"))).alias("term"))
    met = held.join(bounded(asked), "term").where("(_d is null or _d = document_name) and (_l is null or _l = language)")
    got = met.groupBy("query_id", "id").agg(F.first("n_terms").alias("n"), F.count(F.lit(1)).alias("m")).where("m = n")
    return top_ranked(got.select("query_id", "id", F.lit(0.0).alias("similarity")), k, score="similarity")


def coverage(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Top k by the share of the query's terms a row holds."""
    asked = batch.stated_terms(queries)
    if asked:
        return top_ranked(batch.best_rows(token_rows(rows), asked.ids, asked.kind, k, batch.coverage_score(asked)), k)
    got = matched_terms(query_terms(queries), rows)
    return top_ranked(got.select("query_id", "id", F.round(F.col("matched") / F.col("n_terms"), 6).alias("score")), k)


def expanded_coverage(queries: DataFrame, rows: DataFrame, weight: float = 0.7) -> DataFrame:
    """(query_id, id, score): the larger of the coverage of the query's own terms and ``weight``
    times that of the terms with their synonyms; rows without any are out."""
    own = query_terms(queries).select("query_id", "term", "n_terms", F.lit(1).alias("own"))
    wide = query_terms(queries, expanded=True).select("query_id", "term", F.col("n_terms").alias("n_wide"))
    sizes = own.groupBy("query_id").agg(F.first("n_terms").alias("n_own"))
    asked = wide.join(own.select("query_id", "term", "own"), ["query_id", "term"], "left").join(sizes, "query_id").select("query_id", "term", "n_wide", "n_own", F.coalesce("own", F.lit(0)).alias("own"))
    got = _terms_by_row(rows).join(bounded(asked), "term").groupBy("query_id", "id").agg(F.sum("own").alias("a"), F.count(F.lit(1)).alias("b"), F.first("n_own").alias("na"), F.first("n_wide").alias("nb"))
    return got.select("query_id", "id", F.greatest(F.col("a") / F.col("na"), weight * F.col("b") / F.col("nb")).alias("score"))


def profile(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Top k of ``rows`` (id, text, name, section: lower-cased, phrases: a mask) by the local lexical
    leg: expanded coverage x name boost x phrase boost. ``queries`` have (query_id, text, phrases)."""
    asked = batch.stated_terms(queries.select("query_id", "text"), queries.select("query_id", "phrases"))
    if asked:
        return top_ranked(batch.best_rows(token_rows(rows, "name", "section", "phrases"), asked.ids, asked.kind, k, batch.profile_score(asked)), k)
    base = expanded_coverage(queries.select("query_id", "text"), rows.select("id", "text"))
    side = queries.select("query_id", T.token_set(F.col("text")).alias("terms"), F.col("phrases").alias("asked_phrases"))
    joined = base.join(bounded(side), "query_id").join(rows.drop("text"), "id")
    boost = fusion.name_boost(F.col("terms"), F.col("name"), F.col("section")) * fusion.phrase_boost(F.col("asked_phrases"), F.col("phrases"))
    return top_ranked(joined.select("query_id", "id", F.round(F.col("score") * boost, 6).alias("score")), k)


def bm25(queries: DataFrame, rows: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top k by Okapi BM25 (an extension: saturated term frequency, length norm, idf)."""
    known = rows.where("text is not null").select("id", "text")
    asked = batch.stated_terms(queries)
    if asked:
        held = token_rows(known)
        return top_ranked(batch.best_rows(held, asked.ids, asked.kind, k, batch.bm25_score(asked, *batch.term_weights(asked, held), k1, b)), k)
    n, mean = known.agg(F.count(F.lit(1)), F.avg(F.size(T.tokens(F.col("text"))))).first()  # one row
    terms = query_terms(queries).select("query_id", "term")
    marked = F.broadcast if fits(terms) else lambda df: df  # the terms and their weights are no more than these
    held = known.repartition("id").select("id", T.tokens(F.col("text")).alias("terms")).select("id", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    tf = held.join(marked(terms.select("term").distinct()), "term").groupBy("id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean or 1.0)))
    scored = tf.join(marked(idf), "term").join(marked(terms), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return top_ranked(scored, k)


def _covers(batch_terms: list[list[int]]) -> list[tuple[int, int]]:
    """Minimal covers: stretches that hold every term and no shorter stretch inside that does."""
    events = sorted((p, t) for t, places in enumerate(batch_terms) for p in places)
    need, last, out = len(batch_terms), {}, []
    for p, t in events:
        last[t] = p
        if len(last) == need:
            start = min(last.values())
            if out and out[-1][0] == start:
                continue
            out.append((start, p))
    return out


@F.pandas_udf(DoubleType())
def _cover_density(places: pd.Series) -> pd.Series:
    """From the positions of each term in a text, for a batch of texts."""
    return pd.Series([float(sum(len(t) / max(len(t), q - p + 1) for p, q in _covers(t))) for t in places])


def cover_density(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Top k by cover density: over the minimal stretches of a text that hold all the query's
    terms, the sum of (number of terms / length of the stretch). Texts without all terms are
    out. This is the published cover-density idea, not one database's exact weighting."""
    asked = query_terms(queries)
    held = rows.select("id", "text").repartition("id").select("id", F.posexplode(T.tokens(F.col("text"))).alias("position", "term"))
    places = held.join(bounded(asked), "term").groupBy("query_id", "id", "term", "n_terms").agg(F.collect_list("position").alias("places"))
    grouped = places.groupBy("query_id", "id", "n_terms").agg(F.collect_list("places").alias("terms")).where(F.size("terms") == F.col("n_terms"))
    return top_ranked(grouped.select("query_id", "id", F.round(_cover_density("terms"), 6).alias("score")), k)


def expand_queries(queries: DataFrame, translations: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, text, expanded): Arabic queries become their known translation (text,
    translation), or else get, in brackets, the expansions of the first ``most`` entities
    (ordinal, term, expansion) they contain, each once; others stay as they are. Both tables are
    dimensions, one row a phrase; entities over the bound of a broadcast are an error."""
    known = translations.select(F.trim("text").alias("_t"), "translation").dropDuplicates(["_t"])
    rows = queries.join(known, F.trim("text") == F.col("_t"), "left").withColumn("arabic", T.detect_language(F.col("text")) == "ar")
    hit = queries.join(dimension(entities, "entities"), F.contains("text", "term")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "expansion"))).alias("found"))
    added = F.array_join(F.array_distinct(F.transform(F.slice("found", 1, most), lambda x: x["expansion"])), " ")
    rows = rows.join(hit, "query_id", "left")
    return rows.select(
        "query_id", "text",
        F.when(~F.col("arabic"), F.col("text")).when(F.col("translation").isNotNull(), F.col("translation")).when(F.col("found").isNotNull(), F.concat("text", F.lit(" ["), added, F.lit("]"))).otherwise(F.col("text")).alias("expanded"),
    )
