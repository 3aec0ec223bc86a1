"""Reciprocal rank fusion, boosts and diversification of ranked candidates.

Three named profiles hold the constants in which the reference's retrieval paths differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.models import with_retry
from .bounds import dimension


@dataclass(frozen=True)
class Profile:
    """``absent`` is the rank of a row that a leg lacks (None: the leg adds nothing)."""

    name: str
    rrf_k: int
    fetch: int  # candidates a leg, per result asked for
    absent: bool
    lexical_weight: float  # for queries with a keyword term
    org_factor: float
    section_least: float
    section_factor: float
    max_per_doc: int
    stop_words: tuple[str, ...]


SERVER = Profile("server", 60, 3, False, 1.0, 1.30, 0.30, 1.35, 2, tuple(L.STOP_WORDS))
DEMO = Profile("demo", 30, 8, True, 1.5, 1.50, 0.20, 1.25, 3, tuple(L.MORE_STOP_WORDS))
OFFLINE = Profile("offline", 30, 8, True, 1.5, 1.50, 0.20, 1.25, 3, tuple(L.STOP_WORDS))


def fuse(semantic: DataFrame, lexical: DataFrame, profile: Profile, top: int, weight: Column | float = 1.0) -> DataFrame:
    """(query_id, id, semantic_rank, lexical_rank, score) from two ranked legs (query_id, id,
    rank), each cut at ``profile.fetch * top``. ``weight`` multiplies the lexical leg."""
    n = profile.fetch * top
    a = semantic.where(F.col("rank") <= n).select("query_id", "id", F.col("rank").alias("semantic_rank"))
    b = lexical.where(F.col("rank") <= n).select("query_id", "id", F.col("rank").alias("lexical_rank"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    w = weight if isinstance(weight, Column) else F.lit(float(weight))

    def part(rank: str) -> Column:
        one = 1.0 / (profile.rrf_k + F.col(rank))
        return F.coalesce(one, F.lit(1.0 / (profile.rrf_k + n + 1) if profile.absent else 0.0))

    return both.withColumn("score", part("semantic_rank") + w * part("lexical_rank"))


def keyword_weight(query: Column, weight: float, terms: Sequence[str] = L.KEYWORD_TERMS) -> Column:
    return F.when(T.contains_any(F.lower(query), terms), weight).otherwise(1.0)


def name_boost(query_terms: Column, name: Column, section: Column) -> Column:
    """1 + 0.3 for each query term inside the lower-cased document name + 0.15 for each inside
    the lower-cased section title."""
    hits = lambda text: F.size(F.filter(query_terms, lambda t: F.contains(text, t)))
    return 1.0 + 0.3 * hits(name) + 0.15 * hits(section)


def phrase_mask(text: Column, phrases: Sequence[str] = L.PHRASES) -> Column:
    """One bit for each phrase the text holds, case aside."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(0)
    for i, p in enumerate(phrases):
        out = out + F.when(low.contains(p), 1 << i).otherwise(0)
    return out


def phrase_boost(query_mask: Column, text_mask: Column) -> Column:
    """1 + 0.3 for each phrase that both hold."""
    return 1.0 + 0.3 * F.bit_count(query_mask.bitwiseAND(text_mask))


def own_words(text: Column, stop_words: Sequence[str]) -> Column:
    """The distinct words of a text but for the stop words."""
    return F.array_except(T.token_set(text), F.array(*map(F.lit, stop_words)))


def section_overlap(query_words: Column, section: Column, profile: Profile) -> Column:
    """The section factor when enough of the query's words are in the section title."""
    q, s = query_words, own_words(F.coalesce(section, F.lit("")), profile.stop_words)
    share = F.size(F.array_intersect(q, s)) / F.greatest(F.size(q), F.lit(1))
    return F.when((F.size(q) > 0) & (F.size(s) > 0) & (share >= profile.section_least), profile.section_factor).otherwise(1.0)


def section_keywords(section: Column, table: Sequence[tuple[str, float]] = L.SECTION_KEYWORDS) -> Column:
    low, out = F.lower(F.coalesce(section, F.lit(""))), F.lit(1.0)
    for keyword, factor in reversed(table):
        out = F.when(low.contains(keyword), factor).otherwise(out)
    return out


def content_overlap(query_words: Column, content: Column, least: int = 3, factor: float = 1.15) -> Column:
    """A factor for contents that hold at least ``least`` of the query's words, case aside."""
    begin = F.struct(F.lower(F.coalesce(content, F.lit(""))).alias("low"), F.lit(0).alias("n"))  # lower-cased once, not for each word
    met = F.aggregate(query_words, begin, lambda acc, w: F.struct(acc["low"].alias("low"), (acc["n"] + F.contains(acc["low"], w).cast("int")).alias("n")), lambda acc: acc["n"])
    return F.when(met >= least, factor).otherwise(1.0)


def rule_factors(rows: DataFrame, rules: DataFrame, factor: float, asked: DataFrame, query: str = "query", name: str = "document_name") -> DataFrame:
    """``rows`` with ``rule_factor``: ``factor`` when some rule (term, pattern) has its term in
    the query and its pattern in the document name, else 1. ``asked`` holds the stated queries in
    the column ``query``; they meet the rules (a dimension: over the bound of a broadcast they are an error) before the
    rows do, so the rows are neither paired with rules nor computed twice."""
    met = asked.select(query).distinct().join(dimension(rules, "rules"), F.lower(query).contains(F.lower("term")))
    patterns = met.groupBy(query).agg(F.collect_set(F.lower("pattern")).alias("_patterns"))
    hit = F.exists("_patterns", lambda p: F.contains(F.lower(F.coalesce(name, F.lit(""))), p))
    return rows.join(patterns, query, "left").withColumn("rule_factor", F.when(hit, factor).otherwise(1.0)).drop("_patterns")


def deduplicate(ranked: DataFrame, top: int, max_per_doc: int, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The greedy pass in rank order (at most ``max_per_doc`` rows a document, one a section) as
    two windows: only the first row of a section can be taken, then the first rows of a document."""
    section = Window.partitionBy(by, "document_name", "section_title").orderBy(rank)
    doc = Window.partitionBy(by, "document_name").orderBy(rank)
    first = ranked.withColumn("_n", F.row_number().over(section)).where("_n = 1")
    few = first.withColumn("_n", F.row_number().over(doc)).where(F.col("_n") <= max_per_doc)
    order = Window.partitionBy(by).orderBy(rank)
    return few.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top).drop("_n")


def mmr(rows: DataFrame, top: int, trade: float = 0.85, by: str = "query_id") -> DataFrame:
    """(by, id, position): maximal marginal relevance over the candidates of a query (by, id,
    relevance, text), at most a few dozen each. Sequential by nature, so one Arrow group per
    query; similarity is the Jaccard index of white-space words; ties go to the smaller id."""
    kind = f"{by} {rows.schema[by].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, position int"

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["relevance", "id"], ascending=[False, True])
        words = [set((t or "").lower().split()) for t in group["text"]]
        relevance, ids = group["relevance"].fillna(0.0).tolist(), group["id"].tolist()
        left, taken, near = list(range(len(ids))), [], [0.0] * len(ids)
        while left and len(taken) < top:
            best = max(left, key=lambda i: (trade * relevance[i] - (1 - trade) * near[i], -i))
            taken.append(best)
            left.remove(best)
            for i in left:
                if words[i] and words[best]:
                    near[i] = max(near[i], len(words[i] & words[best]) / len(words[i] | words[best]))
        return pd.DataFrame({by: group[by].iloc[0], "id": [ids[i] for i in taken], "position": range(1, len(taken) + 1)})

    return rows.select(by, "id", "relevance", "text").groupBy(by).applyInPandas(pick, kind)


def rerank(rows: DataFrame, top: int, score: Column | None = None, threshold: float | None = None, by: str = "query_id") -> DataFrame:
    """Rows with content scored against their query, best ``top`` kept. ``score`` stands for a
    cross-encoder; the offline one is the token F1 of query and content."""
    scored = rows.where(F.length(F.trim("content")) > 0)
    value = score if score is not None else T.token_f1(T.token_set(F.col("query")), T.token_set(F.col("content")))
    scored = scored.withColumn("rerank_score", F.round(value, 6))
    if threshold is not None:
        scored = scored.where(F.col("rerank_score") >= threshold)
    order = Window.partitionBy(by).orderBy(F.desc("rerank_score"), "id")
    return scored.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= top)


def rerank_by(rows: DataFrame, top: int, client, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """As ``rerank``, with a cross-encoder client over Arrow batches (queries, contents) -> scores.
    Where it fails after retries, or gives no score, the first ``top`` rows with content keep
    their order and their similarity is their score."""
    call = with_retry(lambda both: client(*both))

    @F.pandas_udf("double")
    def scored(queries: pd.Series, contents: pd.Series) -> pd.Series:
        try:
            return pd.Series(call((queries, contents)), dtype="float64")
        except Exception:
            return pd.Series([None] * len(queries), dtype="float64")

    valid = rows.where(F.length(F.trim("content")) > 0).withColumn("_score", scored(F.col("query"), F.col("content")))
    failed = F.max(F.col("_score").isNull()).over(Window.partitionBy(by))
    valid = valid.withColumn("_failed", failed).withColumn("rerank_score", F.round(F.when(F.col("_failed"), F.coalesce("similarity", F.lit(0.0))).otherwise(F.col("_score")), 6))
    order = Window.partitionBy(by).orderBy(F.when(F.col("_failed"), F.col(rank)), F.desc("rerank_score"), "id")
    return valid.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= top).drop("_score", "_failed")
