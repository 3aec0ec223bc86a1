"""Evidence gates, verdicts and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


def similarity_gate(hits: DataFrame, least: float = 0.20) -> DataFrame:
    """(run_id, top_similarity, verdict): INSUFFICIENT when the best similarity is under
    ``least``. Null similarities count as 0."""
    top = hits.groupBy("run_id").agg(F.max(F.coalesce("similarity", F.lit(0.0))).alias("top_similarity"))
    return top.withColumn("verdict", F.when(F.col("top_similarity") < least, "INSUFFICIENT").otherwise("SUFFICIENT"))


def scope(text: Column, blocked: Sequence[str]) -> Column:
    """REFUSE when the text holds a blocked term, case aside; blank or null text is refused too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when((F.trim(low) == "") | T.contains_any(low, blocked), "REFUSE").otherwise("ALLOWED")


def critic(scored: DataFrame, least_mean: float = 6.0, least_count: int = 2) -> DataFrame:
    """(run_id, mean_relevance, relevant_count, verdict) from per-chunk ``score`` 0 to 10."""
    out = scored.groupBy("run_id").agg(F.round(F.avg("score"), 6).alias("mean_relevance"), F.count_if(F.col("score") >= 6).alias("relevant_count"))
    ok = (F.col("mean_relevance") >= least_mean) & (F.col("relevant_count") >= least_count)
    return out.withColumn("verdict", F.when(ok, "SUFFICIENT").otherwise("INSUFFICIENT"))


def confidence(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """(run_id, top_similarity, median_similarity, documents, citations, confidence). Points for
    the best and the median similarity, the number of citations and of cited and retrieved
    documents; 7 is HIGH, 4 MEDIUM, 2 LOW. ``cited`` (run_id, citations, cited_documents)."""
    similarity = F.coalesce("similarity", F.lit(0.0))
    rows = hits.groupBy("run_id").agg(F.max(similarity).alias("top_similarity"), F.round(F.median(similarity), 6).alias("median_similarity"), F.countDistinct(F.coalesce("document_name", F.lit(""))).alias("documents"))
    rows = rows.join(cited, "run_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("citations", "cited_documents")})
    top, mid, n = F.col("top_similarity"), F.col("median_similarity"), F.col("citations")
    points = (
        F.when(top >= 0.55, 3).when(top >= 0.45, 2).when(top >= 0.35, 1).otherwise(0) + F.when(mid >= 0.45, 1).otherwise(0)
        + F.when(n >= 2, 2).when(n >= 1, 1).otherwise(0) + F.when(F.col("cited_documents") >= 2, 1).otherwise(0) + F.when(F.col("documents") >= 2, 1).otherwise(0)
    )
    return rows.withColumn("confidence", F.when(points >= 7, "HIGH").when(points >= 4, "MEDIUM").when(points >= 2, "LOW").otherwise("INSUFFICIENT"))


def _json(payload: Column, schema: str) -> Column:
    return F.from_json(T.strip_thinking(payload), schema)


def parsed_scope(payload: Column) -> Column:
    """The ``scope_level`` of a model's JSON answer, failing closed: what does not parse, is missing or
    is no level is REFUSE."""
    level = F.upper(_json(payload, "scope_level string")["scope_level"])
    return F.when(level.isin(L.SCOPE_LEVELS), level).otherwise("REFUSE")


def parsed_scores(payload: Column) -> Column:
    """The ``scores`` of a critic's JSON answer as array<struct<chunk_idx, score, reasoning>>; what does
    not parse has none. Scores outside 0 to 10 make the whole answer invalid."""
    scores = F.coalesce(_json(payload, "scores array<struct<chunk_idx:int,score:int,reasoning:string>>")["scores"], F.array())
    valid = F.forall(scores, lambda x: F.coalesce(x["score"].between(0, 10), F.lit(False)))
    return F.when(valid, scores).otherwise(F.slice(scores, 1, 0))


def critic_report(scores: Column, least_mean: float = 6.0, least_count: int = 2) -> Column:
    """struct<verdict, mean_relevance, relevant_count> of such scores; none is INSUFFICIENT."""
    total = F.aggregate(scores, F.lit(0), lambda a, x: a + x["score"])
    mean = F.when(F.size(scores) > 0, F.round(total / F.size(scores), 6)).otherwise(F.lit(0.0))
    count = F.size(F.filter(scores, lambda x: x["score"] >= 6))
    return F.struct(F.when((mean >= least_mean) & (count >= least_count), "SUFFICIENT").otherwise("INSUFFICIENT").alias("verdict"), mean.alias("mean_relevance"), count.alias("relevant_count"))
