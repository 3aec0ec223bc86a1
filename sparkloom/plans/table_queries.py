"""Sources, table maintenance, layout, and event-time statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from ..streaming import usage
from .base import S, query, registry, spread_table, table

KEY = r"regexp_replace(document_name, '(?i)\.(pdf|docx?)$', '')"
ONE = "one AS (SELECT * FROM source_registry QUALIFY row_number() OVER (PARTITION BY document_name ORDER BY title, url) = 1)"


@query(f"WITH {ONE} SELECT c.id, coalesce(r.url, '') AS registry_url, r.authority_tier AS registry_tier FROM chunks c LEFT JOIN one r ON r.document_name = {KEY.replace('document_name', 'c.document_name')}")
def registry_enrich(spark, d):
    return S.enrich(table(spark, d, "chunks").select("id", "document_name"), registry(spark, d)).select("id", "registry_url", "registry_tier")


_URL = "coalesce(c.source_url, '') = '' AND coalesce(r.url, '') <> ''"


@query(f"""WITH {ONE} SELECT c.id, CASE WHEN {_URL} THEN r.url ELSE c.source_url END AS source_url, coalesce(c.authority_tier, r.authority_tier) AS authority_tier,
  ({_URL}) OR (c.authority_tier IS NULL AND r.authority_tier IS NOT NULL) AS updated FROM chunks c LEFT JOIN one r ON r.document_name = {KEY.replace('document_name', 'c.document_name')}""")
def registry_backfill(spark, d):
    rows = table(spark, d, "chunks").select("id", "document_name", "source_url", "authority_tier")
    return S.backfill(rows, registry(spark, d)).select("id", "source_url", "authority_tier", "updated")


@query("SELECT chunk_id, id, language FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1")
def upsert_latest(spark, d):
    return S.latest(table(spark, d, "chunks").select("chunk_id", "id", "language", "created_at"), "chunk_id", "created_at", "id").drop("created_at")


_LAST = "SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY id DESC) = 1"


@query(f"""WITH o AS (SELECT chunk_id, id, language FROM chunks WHERE id % 2 = 0), n AS (SELECT chunk_id, id, language FROM chunks WHERE id % 2 = 1), f AS ({_LAST.format(t='n')})
SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM f) UNION ALL SELECT * FROM f""")
def upsert_batches(spark, d):
    """The rows of odd id arrive as a batch on top of those of even id."""
    rows = table(spark, d, "chunks").select("chunk_id", "id", "language")
    return S.upsert(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "chunk_id", "id")


@query("SELECT count(*) AS chunks, count(DISTINCT chunk_id) AS chunk_ids, count(DISTINCT document_name) AS documents, count(DISTINCT section_title) AS sections FROM chunks")
def corpus_stats(spark, d):
    return table(spark, d, "chunks").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("chunk_id").alias("chunk_ids"), F.countDistinct("document_name").alias("documents"), F.countDistinct("section_title").alias("sections"))


@query("SELECT document_name, string_agg(DISTINCT page_number, '-' ORDER BY page_number) AS pages FROM chunks WHERE page_number IS NOT NULL GROUP BY 1")
def page_sets(spark, d):
    """The pages of a document as one string, in the order of strings."""
    rows = table(spark, d, "chunks").where("page_number is not null")
    return rows.groupBy("document_name").agg(F.array_join(F.array_sort(F.collect_set("page_number")), "-").alias("pages"))


# Documents as layout: a line is a block; short lines without an end mark stand for large type.
_SHORT = r"length(line) BETWEEN 3 AND 80 AND NOT regexp_matches(line, '[.!?؟:;]$') AND NOT regexp_matches(line, '^[-*•]')"
LINES = f"""lines AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS position FROM documents WHERE text IS NOT NULL),
sized AS (SELECT *, CASE WHEN {_SHORT} THEN 14.0 ELSE 10.0 + (doc_id % 3) * 0.5 END::DOUBLE AS size FROM lines WHERE line <> ''),
bodies AS (SELECT doc_id, coalesce(median(size) FILTER (length(line) >= 20), 10.0)::DOUBLE AS body FROM sized GROUP BY 1),
heads AS (SELECT *, ((size >= body * 1.25 AND size BETWEEN 9 AND 30) OR (position % 5 = 2 AND abs(size - body) <= 1.0 AND length(line) > 5 AND length(line) < 120) OR (upper(line) = line AND regexp_matches(line, '\\p{{Lu}}') AND abs(size - body) <= 1.5 AND length(line) > 4 AND length(line) < 60)) AND length(line) <= 120 AS header FROM sized JOIN bodies USING (doc_id))"""


def _lines(spark, d) -> DataFrame:
    rows = spread_table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line")).withColumn("line", F.trim("line")).where("line != ''")
    short = F.length("line").between(3, 80) & ~F.col("line").rlike(r"[.!?؟:;]$") & ~F.col("line").rlike(r"^[-*•]")
    return rows.withColumn("size", F.when(short, 14.0).otherwise(10.0 + (F.col("doc_id") % 3) * 0.5))


def _as_spans(spark, d) -> DataFrame:
    return _lines(spark, d).select(
        F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.col("position").alias("block_no"), F.lit(0).alias("line_no"), F.lit(0).alias("span_no"),
        F.lit(300.0).alias("y0"), F.lit(320.0).alias("y1"), F.lit(800.0).alias("page_height"), F.when(F.col("position") % 5 == 2, "Sans-Bold").otherwise("Plain").alias("font"), "size", F.col("line").alias("text"),
    )


@query(f"""WITH {LINES}, placed AS (SELECT doc_id, position, floor(position / 40)::INT + 1 AS page, 20.0 * (position % 40) AS y0, 20.0 * (position % 40) + 18.0 AS y1 FROM sized)
SELECT doc_id, page, count(*) AS kept, min(position) AS first_line, max(position) AS last_line FROM placed WHERE NOT (y1 < 64.0 OR y0 > 736.0) GROUP BY doc_id, page""")
def margin_filter(spark, d):
    """Lines laid on pages of forty, those in the top and bottom margins dropped."""
    y0 = 20.0 * (F.col("position") % 40)
    spans = _lines(spark, d).select("doc_id", "position", (F.floor(F.col("position") / 40) + 1).cast("int").alias("page"), y0.alias("y0"), (y0 + 18.0).alias("y1"), F.lit(800.0).alias("page_height"))
    return layout.without_margins(spans).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("kept"), F.min("position").alias("first_line"), F.max("position").alias("last_line"))


@query(f"WITH {LINES} SELECT doc_id, body FROM bodies")
def body_size_median(spark, d):
    return layout.body_size(_as_spans(spark, d)).select(F.col("doc").alias("doc_id"), "body")


def _heads(spark, d) -> DataFrame:
    spans = _as_spans(spark, d)
    marked = spans.join(layout.body_size(spans), "doc")
    return marked.select(F.col("doc").alias("doc_id"), F.col("block_no").alias("position"), "text", layout.is_header(F.col("size"), F.col("font"), F.col("text"), F.col("body")).alias("header"))


@query(f"WITH {LINES} SELECT doc_id, position, header FROM heads")
def header_classify(spark, d):
    return _heads(spark, d).select("doc_id", "position", "header")


@query(f"WITH {LINES} SELECT doc_id, position, coalesce(last_value(CASE WHEN header THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING), 'General Overview') AS section FROM heads")
def section_carry_forward(spark, d):
    return layout.carry_sections(_heads(spark, d), "doc_id", ["position"], F.col("header"), F.col("text")).select("doc_id", "position", "section")


@query()
def chunker_greedy(spark, d):
    """Section-aware chunks of every document; sequential, tested against brute force."""
    rows = layout.chunks(layout.blocks(_as_spans(spark, d)), 60, 140, 10)
    return rows.select(F.col("doc").alias("doc_id"), "chunk_no", "section", "pages", F.length("text").alias("n_chars"))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM
  (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1) GROUP BY 1, 2""")
def usage_windows(spark, d):
    return usage.tumbling(table(spark, d, "events"))


@query("""WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1), w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - unnest([0, 1, 2, 3]) * INTERVAL 15 MINUTE AS window_start, value FROM e)
SELECT window_start::TIMESTAMP AS window_start, count(*) AS events, round(avg(value), 4) AS mean_value FROM w GROUP BY 1""")
def usage_sliding(spark, d):
    return usage.sliding(table(spark, d, "events"))


@query("""WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1), m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT user_id, min(ts)::TIMESTAMP AS session_start, count(*) AS events FROM s GROUP BY user_id, n""")
def usage_sessions(spark, d):
    return usage.sessions(table(spark, d, "events"))


@query(r"SELECT c_mktsegment AS segment, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def relational_join_report(spark, d):
    """Generic relational work over the star schema: pushed filter, two equi-joins, one aggregate."""
    items = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")).select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    segments = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    revenue: Column = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per_order = items.groupBy("l_orderkey").agg(F.sum(revenue).alias("revenue"))
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(segments, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("revenue"), 2).alias("revenue"))


