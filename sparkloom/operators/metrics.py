"""Retrieval metrics, failure modes and reports over runs: (run_id, rank, document_name,
section_title, ground_truth) rows, where ``ground_truth`` is an array of document names.

The relevance predicate is containment of names either way, case aside; an empty name is
related to nothing. A run without ground truth has metric 0 and no failure mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def relevant(name: Column, truth: Column) -> Column:
    return F.coalesce(F.exists(truth, lambda g: T.related(F.coalesce(name, F.lit("")), F.coalesce(g, F.lit("")))), F.lit(False))


def ideal_dcg(n: Column, k: int) -> Column:
    """Sum of 1 / log2(i + 1) for i = 1 .. min(n, k)."""
    out = F.lit(0.0)
    for i in range(1, k + 1):
        out = out + F.when(n >= i, 1.0 / F.log2(F.lit(i + 1.0))).otherwise(0.0)
    return out


def run_metrics(hits: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row a run: precision at 3 and 5 (divided by k, not by what was returned), recall at
    10 (share of ground truth found), hit ratio at 10 (relevant rows over ground truth, can
    exceed 1; 1 without ground truth), nDCG at 5 (chunk gains over document ideal, can exceed
    1), and coverage of the ground truth by the whole run."""
    hits = hits.withColumn("rel", relevant(F.col("document_name"), F.col("ground_truth")).cast("double"))
    found = lambda k: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= k, F.filter("ground_truth", lambda g: T.related(F.coalesce(F.col("document_name"), F.lit("")), F.coalesce(g, F.lit(""))))))))
    n = F.coalesce(F.size(F.first("ground_truth")), F.lit(0))
    upto = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0.0))
    dcg = F.sum(F.when(F.col("rank") <= 5, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    rows = hits.groupBy("run_id").agg(
        *[F.first(c).alias(c) for c in keep], F.greatest(n, F.lit(0)).alias("n_truth"), upto(3).alias("r3"), upto(5).alias("r5"), upto(10).alias("r10"),
        dcg.alias("dcg"), F.size(found(10)).alias("f10"), F.size(found(1 << 30)).alias("fall"),
    )
    share = lambda a: F.when(F.col("n_truth") > 0, F.col(a) / F.col("n_truth")).otherwise(0.0)
    return rows.select(
        "run_id", *keep, "n_truth", F.round(F.col("r3") / 3, 6).alias("precision_at_3"), F.round(F.col("r5") / 5, 6).alias("precision_at_5"),
        F.round(share("f10"), 6).alias("recall_at_10"),
        F.round(F.when(F.col("n_truth") > 0, F.col("r10") / F.col("n_truth")).otherwise(1.0), 6).alias("hit_ratio_at_10"),
        F.round(F.when(F.col("n_truth") > 0, F.col("dcg") / ideal_dcg(F.col("n_truth"), 5)).otherwise(0.0), 6).alias("ndcg_at_5"),
        F.round(share("fall"), 6).alias("citation_coverage"),
    )


def document_ndcg(hits: DataFrame, k: int = 5) -> DataFrame:
    """(run_id, ndcg): nDCG at ``k`` in which each document of the ground truth gains once, at
    its first rank; names that match several documents at once are cut off at 1, so it never
    exceeds 1. 0 without ground truth."""
    named = F.coalesce("document_name", F.lit(""))
    found = hits.where(F.col("rank") <= k).select("run_id", "rank", F.explode(F.filter("ground_truth", lambda g: T.related(named, F.coalesce(g, F.lit(""))))).alias("g"))
    gains = found.groupBy("run_id", "g").agg(F.min("rank").alias("rank")).groupBy("run_id").agg(F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    sizes = hits.groupBy("run_id").agg(F.max(F.coalesce(F.size("ground_truth"), F.lit(0))).alias("n"))
    score = F.least(F.lit(1.0), F.coalesce("dcg", F.lit(0.0)) / ideal_dcg(F.col("n"), k))
    return sizes.join(gains, "run_id", "left").select("run_id", F.round(F.when(F.col("n") > 0, score).otherwise(0.0), 6).alias("ndcg"))


def failure_modes(hits: DataFrame, same_doc: int = 4) -> DataFrame:
    """(run_id, failure_mode, detail): null without ground truth; DUPLICATE_CHUNKS when one
    document fills ``same_doc`` of the top 5 (detail: that document); MISSING_SOURCE when none
    is relevant (detail: the top document); WRONG_TOPIC_SECTION under precision 0.4 (detail: the
    top section); else null. NO_RESULTS belongs to runs without rows: see ``empty_runs``."""
    top = hits.where(F.col("rank") <= 5).withColumn("rel", relevant(F.col("document_name"), F.col("ground_truth")).cast("double"))
    per_doc = top.groupBy("run_id", F.coalesce("document_name", F.lit("")).alias("doc")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("at"))
    most = per_doc.groupBy("run_id").agg(F.max(F.struct("n", (-F.col("at")).alias("first"), "doc")).alias("m"))
    one = top.groupBy("run_id").agg(
        F.max(F.coalesce(F.size("ground_truth"), F.lit(0))).alias("n_truth"), F.sum("rel").alias("rel"), F.min_by("document_name", "rank").alias("doc"), F.min_by("section_title", "rank").alias("section")
    )
    rows = one.join(most, "run_id")
    none = F.col("n_truth") <= 0
    dup, miss, wrong = F.col("m.n") >= same_doc, F.col("rel") == 0, F.col("rel") / 5 < 0.4
    return rows.select(
        "run_id",
        F.when(none, None).when(dup, "DUPLICATE_CHUNKS").when(miss, "MISSING_SOURCE").when(wrong, "WRONG_TOPIC_SECTION").alias("failure_mode"),
        F.when(none, None).when(dup, F.col("m.doc")).when(miss, F.col("doc")).when(wrong, F.col("section")).alias("detail"),
    )


def empty_runs(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries (query_id, ...) with no row in ``hits`` (query_id, ...): the NO_RESULTS rows."""
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").withColumn("failure_mode", F.lit("NO_RESULTS"))


def report(metrics: DataFrame) -> DataFrame:
    """Overall, by category and by difficulty in one grouping-sets aggregate: (level, slice,
    runs, mean metrics, failures)."""
    level = F.when(F.grouping("category") == 0, "category").when(F.grouping("difficulty") == 0, "difficulty").otherwise("overall")
    names = ["precision_at_3", "precision_at_5", "recall_at_10", "ndcg_at_5", "citation_coverage"]
    return metrics.groupingSets([["category"], ["difficulty"], []], "category", "difficulty").agg(
        level.alias("level"), F.count(F.lit(1)).alias("runs"), *[F.round(F.avg(c), 6).alias(c) for c in names], F.count("failure_mode").alias("failures"),
    ).select("level", F.coalesce("category", "difficulty", F.lit("all")).alias("slice"), "runs", *names, "failures")
