"""Evaluation metrics, evidence gates, answers and their citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import agents, cite, guard, metrics
from .base import EVIDENCE, JUDGED, RUNS, evidence, judged, query, runs, sentences, squeeze, table, tokset

_RELATED = "(g <> '' AND lower(coalesce(document_name, '')) <> '' AND (contains(lower(coalesce(document_name, '')), g) OR contains(g, lower(coalesce(document_name, '')))))"
_IDCG = "CASE " + " ".join(f"WHEN n_truth >= {n} THEN {' + '.join(f'1.0 / log2({i + 1}.0)' for i in range(1, n + 1))}" for n in range(5, 0, -1)) + " ELSE 0.0 END"
METRICS = f"""{JUDGED}, rel AS (SELECT *, CASE WHEN len(list_filter(ground_truth, lambda g: {_RELATED})) > 0 THEN 1.0 ELSE 0.0 END AS rel,
  list_filter(ground_truth, lambda g: {_RELATED}) AS found FROM judged),
sums AS (SELECT run_id, any_value(query_id) AS query_id, any_value(category) AS category, any_value(difficulty) AS difficulty, max(len(ground_truth)) AS n_truth,
  sum(rel) FILTER (rank <= 3) AS r3, sum(rel) FILTER (rank <= 5) AS r5, sum(rel) FILTER (rank <= 10) AS r10, sum(rel / log2(rank + 1.0)) FILTER (rank <= 5) AS dcg,
  len(list_distinct(flatten(list(found) FILTER (rank <= 10)))) AS f10, len(list_distinct(flatten(list(found)))) AS fall FROM rel GROUP BY run_id),
metrics AS (SELECT run_id, query_id, category, difficulty, n_truth, round(coalesce(r3, 0) / 3, 6) AS precision_at_3, round(coalesce(r5, 0) / 5, 6) AS precision_at_5,
  round(CASE WHEN n_truth > 0 THEN coalesce(f10, 0) / n_truth ELSE 0.0 END, 6) AS recall_at_10, round(CASE WHEN n_truth > 0 THEN coalesce(r10, 0) / n_truth ELSE 1.0 END, 6) AS hit_ratio_at_10,
  round(CASE WHEN n_truth > 0 THEN coalesce(dcg, 0) / ({_IDCG}) ELSE 0.0 END, 6) AS ndcg_at_5, round(CASE WHEN n_truth > 0 THEN coalesce(fall, 0) / n_truth ELSE 0.0 END, 6) AS citation_coverage FROM sums)"""
FAILURES = """top AS (SELECT * FROM rel WHERE rank <= 5), per_doc AS (SELECT run_id, coalesce(document_name, '') AS doc, count(*) AS n, min(rank) AS position FROM top GROUP BY 1, 2),
most AS (SELECT run_id, arg_max(doc, (n, -position, doc)) AS doc, max(n) AS n FROM per_doc GROUP BY 1),
one AS (SELECT run_id, max(len(ground_truth)) AS n_truth, sum(rel) AS rel, arg_min(document_name, rank) AS doc, arg_min(section_title, rank) AS section FROM top GROUP BY 1),
failures AS (SELECT one.run_id, CASE WHEN n_truth = 0 THEN NULL WHEN most.n >= {same} THEN 'DUPLICATE_CHUNKS' WHEN rel = 0 THEN 'MISSING_SOURCE' WHEN rel / 5 < 0.4 THEN 'WRONG_TOPIC_SECTION' END AS failure_mode,
  CASE WHEN n_truth = 0 THEN NULL WHEN most.n >= {same} THEN most.doc WHEN rel = 0 THEN one.doc WHEN rel / 5 < 0.4 THEN section END AS detail FROM one JOIN most USING (run_id))"""


def _metrics(spark, d):
    return metrics.run_metrics(judged(spark, d), ["query_id", "category", "difficulty"])


@query(f"WITH {METRICS} SELECT run_id, precision_at_3, precision_at_5 FROM metrics")
def precision_at_k(spark, d):
    return _metrics(spark, d).select("run_id", "precision_at_3", "precision_at_5")


@query(f"WITH {METRICS} SELECT run_id, recall_at_10 FROM metrics")
def recall_at_k(spark, d):
    return _metrics(spark, d).select("run_id", "recall_at_10")


@query(f"WITH {METRICS} SELECT run_id, ndcg_at_5 FROM metrics")
def ndcg_at_k(spark, d):
    return _metrics(spark, d).select("run_id", "ndcg_at_5")


@query(f"""WITH {METRICS}, g AS (SELECT run_id, unnest(found) AS g, rank FROM rel WHERE rank <= 5), f AS (SELECT run_id, g, min(rank) AS rank FROM g GROUP BY 1, 2),
d AS (SELECT run_id, sum(1.0::DOUBLE / log2(rank + 1.0)) AS once FROM f GROUP BY 1)
SELECT run_id, round(CASE WHEN n_truth > 0 THEN least(1.0, coalesce(once, 0) / ({_IDCG})) ELSE 0.0 END, 6) AS ndcg FROM sums LEFT JOIN d USING (run_id)""")
def ndcg_document_at_k(spark, d):
    """One gain for each document of the ground truth, so at most 1."""
    return metrics.document_ndcg(judged(spark, d))


@query(f"WITH {METRICS} SELECT run_id, hit_ratio_at_10 FROM metrics")
def hit_ratio_at_k(spark, d):
    return _metrics(spark, d).select("run_id", "hit_ratio_at_10")


@query(f"WITH {METRICS} SELECT run_id, citation_coverage FROM metrics")
def citation_coverage(spark, d):
    return _metrics(spark, d).select("run_id", "citation_coverage")


@query(f"WITH {METRICS}, {FAILURES.format(same=4)} SELECT run_id, failure_mode, detail FROM failures")
def failure_mode(spark, d):
    return metrics.failure_modes(judged(spark, d))


@query(f"WITH {METRICS}, {FAILURES.format(same=3)} SELECT run_id, failure_mode, detail FROM failures")
def failure_mode_strict(spark, d):
    return metrics.failure_modes(judged(spark, d), same_doc=3)


@query(f"WITH {METRICS}, {FAILURES.format(same=4)} SELECT failure_mode, count(*) AS runs FROM failures WHERE failure_mode IS NOT NULL GROUP BY 1")
def failure_listing(spark, d):
    return metrics.failure_modes(judged(spark, d)).where("failure_mode is not null").groupBy("failure_mode").agg(F.count(F.lit(1)).alias("runs"))


_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("precision_at_3", "precision_at_5", "recall_at_10", "ndcg_at_5", "citation_coverage"))


@query(f"""WITH {METRICS}, {FAILURES.format(same=4)}, both_ AS (SELECT * FROM metrics LEFT JOIN failures USING (run_id))
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS level, coalesce(category, difficulty, 'all') AS slice,
  count(*) AS runs, {_MEANS}, count(failure_mode) AS failures FROM both_ GROUP BY GROUPING SETS ((category), (difficulty), ())""")
def eval_report_grouping_sets(spark, d):
    rows = _metrics(spark, d).join(metrics.failure_modes(judged(spark, d)), "run_id", "left")
    return metrics.report(rows)


@query(f"""WITH {METRICS}, levels AS (SELECT unnest(['easy', 'medium', 'hard']) AS difficulty)
SELECT l.difficulty, count(m.run_id) AS runs, round(coalesce(avg(precision_at_5), 0.0), 6) AS precision_at_5 FROM levels l LEFT JOIN metrics m USING (difficulty) GROUP BY 1""")
def report_by_difficulty(spark, d):
    """A fixed domain: levels without runs are kept."""
    levels = spark.createDataFrame([("easy",), ("medium",), ("hard",)], "difficulty string")
    rows = levels.join(_metrics(spark, d).select("run_id", "difficulty", "precision_at_5"), "difficulty", "left")
    return rows.groupBy("difficulty").agg(F.count("run_id").alias("runs"), F.round(F.coalesce(F.avg("precision_at_5"), F.lit(0.0)), 6).alias("precision_at_5"))


_EMPTY = """empty AS (SELECT id AS query_id, category, difficulty, len(coalesce(ground_truth_sources, [])) > 0 AS truth FROM eval_items WHERE id NOT IN (SELECT query_id FROM judged))"""
_ITEM_FAILURES = """all_failures AS (SELECT m.query_id, f.run_id, failure_mode, detail FROM failures f JOIN metrics m USING (run_id)
UNION ALL SELECT query_id, NULL::BIGINT, CASE WHEN truth THEN 'NO_RESULTS' END, NULL FROM empty)"""
_NAMES = ["precision_at_3", "precision_at_5", "recall_at_10", "ndcg_at_5", "citation_coverage"]
_ITEM_METRICS = f"""all_metrics AS (SELECT query_id, run_id, category, difficulty, {', '.join(_NAMES)} FROM metrics
UNION ALL SELECT query_id, NULL::BIGINT, category, difficulty, {', '.join(['0.0'] * len(_NAMES))} FROM empty)"""


def _empty(spark, d):
    """Evaluation items without any hit: NO_RESULTS where they have a ground truth."""
    items = table(spark, d, "eval_items").select(F.col("id").alias("query_id"), "category", "difficulty", (F.coalesce(F.size("ground_truth_sources"), F.lit(0)) > 0).alias("truth"))
    rows = metrics.empty_runs(items, runs(spark, d))
    return rows.withColumn("failure_mode", F.when(F.col("truth"), F.col("failure_mode"))).withColumn("run_id", F.lit(None).cast("long")).withColumn("detail", F.lit(None).cast("string"))


def _item_failures(spark, d, same_doc: int = 4):
    names = ["query_id", "run_id", "failure_mode", "detail"]
    rows = judged(spark, d)
    logged = metrics.failure_modes(rows, same_doc).join(rows.select("run_id", "query_id").distinct(), "run_id")
    return logged.select(names).unionByName(_empty(spark, d).select(names))


def _item_metrics(spark, d):
    names = ["query_id", "run_id", "category", "difficulty"]
    none = _empty(spark, d).select(*names, *[F.lit(0.0).alias(c) for c in _NAMES])
    return _metrics(spark, d).select(*names, *_NAMES).unionByName(none)


@query(f"WITH {METRICS}, {FAILURES.format(same=4)}, {_EMPTY}, {_ITEM_FAILURES} SELECT query_id, run_id, failure_mode, detail FROM all_failures")
def failure_mode_all_items(spark, d):
    """As ``failure_mode``, with the evaluation items that have no run."""
    return _item_failures(spark, d)


@query(f"WITH {METRICS}, {FAILURES.format(same=3)}, {_EMPTY}, {_ITEM_FAILURES} SELECT query_id, run_id, failure_mode, detail FROM all_failures")
def failure_mode_strict_all_items(spark, d):
    return _item_failures(spark, d, same_doc=3)


@query(f"WITH {METRICS}, {FAILURES.format(same=4)}, {_EMPTY}, {_ITEM_FAILURES} SELECT failure_mode, count(*) AS runs FROM all_failures WHERE failure_mode IS NOT NULL GROUP BY 1")
def failure_listing_all_items(spark, d):
    return _item_failures(spark, d).where("failure_mode is not null").groupBy("failure_mode").agg(F.count(F.lit(1)).alias("runs"))


@query(f"""WITH {METRICS}, {FAILURES.format(same=4)}, {_EMPTY}, {_ITEM_FAILURES}, {_ITEM_METRICS},
both_ AS (SELECT m.*, f.failure_mode FROM all_metrics m LEFT JOIN all_failures f ON f.query_id = m.query_id AND f.run_id IS NOT DISTINCT FROM m.run_id)
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS level, coalesce(category, difficulty, 'all') AS slice,
  count(*) AS runs, {_MEANS}, count(failure_mode) AS failures FROM both_ GROUP BY GROUPING SETS ((category), (difficulty), ())""")
def eval_report_all_items(spark, d):
    """As ``eval_report_grouping_sets``; an item without hits counts as one run with metrics 0."""
    a, b = _item_metrics(spark, d).alias("a"), _item_failures(spark, d).alias("b")
    return metrics.report(a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & F.col("a.run_id").eqNullSafe(F.col("b.run_id")), "left").select("a.*", "b.failure_mode"))


@query(f"""WITH {METRICS}, {_EMPTY}, {_ITEM_METRICS}, levels AS (SELECT unnest(['easy', 'medium', 'hard']) AS difficulty)
SELECT l.difficulty, count(m.query_id) AS runs, round(coalesce(avg(precision_at_5), 0.0), 6) AS precision_at_5 FROM levels l LEFT JOIN all_metrics m USING (difficulty) GROUP BY 1""")
def report_by_difficulty_all_items(spark, d):
    levels = spark.createDataFrame([("easy",), ("medium",), ("hard",)], "difficulty string")
    rows = levels.join(_item_metrics(spark, d), "difficulty", "left")
    return rows.groupBy("difficulty").agg(F.count("query_id").alias("runs"), F.round(F.coalesce(F.avg("precision_at_5"), F.lit(0.0)), 6).alias("precision_at_5"))


_GATE = "CASE WHEN top_similarity < 0.70 THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END"


@query(f"WITH {RUNS} SELECT run_id, max(coalesce(similarity, 0.0)) AS top_similarity, CASE WHEN max(coalesce(similarity, 0.0)) < 0.20 THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS verdict FROM runs GROUP BY 1")
def similarity_gate(spark, d):
    return guard.similarity_gate(runs(spark, d))


@query(f"""WITH {JUDGED}, gated AS (SELECT run_id, any_value(category) AS category, any_value(expected_verdict) AS expected, max(coalesce(similarity, 0.0)) AS top_similarity FROM judged GROUP BY run_id),
said AS (SELECT *, {_GATE} AS verdict FROM gated)
SELECT count(*) AS runs, round(avg((verdict = CASE WHEN expected IN ('SUFFICIENT', 'ALLOWED', 'NEEDS_CAUTION') THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END)::INT), 6) AS verdict_accuracy,
  round(avg((verdict = 'INSUFFICIENT')::INT) FILTER (category IN ('out_of_scope', 'adversarial')), 6) AS safe_failure_rate FROM said WHERE coalesce(expected, '') <> ''""")
def verdict_accuracy(spark, d):
    rows = judged(spark, d)
    gate = guard.similarity_gate(rows, 0.70)
    said = rows.groupBy("run_id").agg(F.first("category").alias("category"), F.first("expected_verdict").alias("expected")).join(gate, "run_id").where(F.coalesce("expected", F.lit("")) != "")
    want = F.when(F.col("expected").isin("SUFFICIENT", "ALLOWED", "NEEDS_CAUTION"), "SUFFICIENT").otherwise("INSUFFICIENT")
    return said.agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg((F.col("verdict") == want).cast("int")), 6).alias("verdict_accuracy"),
        F.round(F.avg(F.when(F.col("category").isin("out_of_scope", "adversarial"), (F.col("verdict") == "INSUFFICIENT").cast("int"))), 6).alias("safe_failure_rate"),
    )


def _any(x: str, words) -> str:
    return " OR ".join(f"contains(lower(coalesce({x}, '')), '{w}')" for w in words)


@query(f"SELECT id, CASE WHEN trim(coalesce(question, '')) = '' OR {_any('question', L.OFF_TOPIC)} THEN 'REFUSE' ELSE 'ALLOWED' END AS scope, CASE WHEN trim(coalesce(question, '')) = '' OR {_any('question', L.MORE_OFF_TOPIC)} THEN 'REFUSE' ELSE 'ALLOWED' END AS streamed_scope FROM eval_items")
def scope_keyword_gate(spark, d):
    return table(spark, d, "eval_items").select("id", guard.scope(F.col("question"), L.OFF_TOPIC).alias("scope"), guard.scope(F.col("question"), L.MORE_OFF_TOPIC).alias("streamed_scope"))


@query(f"SELECT doc_id, CASE WHEN trim(coalesce(title, '')) = '' OR {_any('title', L.OFF_TOPIC)} THEN 'REFUSE' WHEN {_any('title', L.KEYWORD_TERMS)} THEN 'NEEDS_CAUTION' ELSE 'ALLOWED' END AS scope FROM documents")
def scope_classifier(spark, d):
    """The pluggable scope checker with its offline rules, on every title: batch, JSON, parse."""
    return agents.with_scope(table(spark, d, "documents").select("doc_id", "title"), "title").select("doc_id", "scope")


_F1 = f"CASE WHEN len(q) > 0 AND len(c) > 0 THEN floor(10 * (2.0::DOUBLE * len(list_intersect(q, c)) / (len(q) + len(c))) + 0.5) ELSE 0 END"


@query(f"""WITH {EVIDENCE}, s AS (SELECT run_id, {tokset('query')} AS q, {tokset("substring(coalesce(content, ''), 1, 500)")} AS c FROM evidence WHERE rank <= 5), r AS (SELECT run_id, {_F1} AS score FROM s),
m AS (SELECT run_id, round(avg(score), 6) AS mean_relevance, (count(*) FILTER (score >= 6))::INT AS relevant_count FROM r GROUP BY 1)
SELECT run_id, CASE WHEN mean_relevance >= 6 AND relevant_count >= 2 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS verdict, mean_relevance, relevant_count FROM m""")
def context_evaluation(spark, d):
    """The pluggable critic with its offline score, on the evidence of every run: batch, JSON, parse, verdict."""
    return agents.evaluate(evidence(spark, d))


@query(f"WITH {RUNS}, s AS (SELECT run_id, round(10 * coalesce(rerank_score, similarity, 0.0)) AS score FROM runs), c AS (SELECT run_id, round(avg(score), 6) AS mean_relevance, count(*) FILTER (score >= 6) AS relevant_count FROM s GROUP BY 1) SELECT *, CASE WHEN mean_relevance >= 6 AND relevant_count >= 2 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS verdict FROM c")
def critic_verdict(spark, d):
    scored = runs(spark, d).select("run_id", F.round(10 * F.coalesce("rerank_score", "similarity", F.lit(0.0))).alias("score"))
    return guard.critic(scored)


ANSWERS = rf"""{EVIDENCE}, spread AS (SELECT run_id, rank, {tokset('query')} AS q, unnest({sentences('content')}) AS sentence, generate_subscripts({sentences('content')}, 1) AS position FROM evidence WHERE rank <= 3 AND content IS NOT NULL),
best AS (SELECT run_id, rank, arg_max(sentence, (len(list_intersect(q, {tokset('sentence')})), -position)) AS sentence FROM spread WHERE trim(sentence) <> '' GROUP BY 1, 2),
answers AS (SELECT run_id, string_agg(trim(sentence) || ' 【Source ' || rank || '】', ' ' ORDER BY rank) AS answer FROM best GROUP BY 1)"""


def _answers(spark, d):
    return cite.extractive_answers(evidence(spark, d))


@query(f"WITH {ANSWERS} SELECT run_id, answer FROM answers")
def extractive_answers(spark, d):
    return _answers(spark, d)


CITED = rf"""cited AS (SELECT run_id, 'name' AS kind, trim(unnest(regexp_extract_all(answer, '\[SOURCE:\s*([^\]]+)\]', 1))) AS citation FROM answers
  UNION ALL SELECT run_id, 'number', unnest(regexp_extract_all(answer, '【Source (\d+)】', 1)) FROM answers)"""


@query(f"WITH {ANSWERS}, {CITED} SELECT run_id, kind, citation FROM cited")
def citation_extract(spark, d):
    return cite.citations(_answers(spark, d))


BOUND = f"{CITED}, bound AS (SELECT c.*, EXISTS (SELECT 1 FROM evidence e WHERE e.run_id = c.run_id AND CAST(e.rank AS VARCHAR) = c.citation) AS valid FROM cited c)"


@query(f"WITH {ANSWERS}, {BOUND} SELECT run_id, kind, citation, valid FROM bound")
def citation_bind(spark, d):
    return cite.bind(cite.citations(_answers(spark, d)), evidence(spark, d))


def _blank(x: str) -> str:
    return f"list_filter(list_distinct(string_split({squeeze(f'lower({x})')}, ' ')), lambda x: x <> '')"


_FREE = r"regexp_matches(sentence, '^\[SOURCE:.*\]$') OR regexp_matches(sentence, '^【Source \d+】') OR " + " OR ".join(f"contains(lower(sentence), '{m}')" for m in L.DISCLAIMER_MARKS)
GROUNDED = f"""said AS (SELECT run_id, trim(unnest({sentences('answer')})) AS sentence, generate_subscripts({sentences('answer')}, 1)::INT - 1 AS position FROM answers),
sv AS (SELECT *, {_blank('sentence')} AS v FROM said WHERE length(sentence) > 20), ev AS (SELECT run_id, {_blank('content')} AS w FROM evidence),
grounded AS (SELECT run_id, position, sentence, round(max(CASE WHEN len(v) > 0 AND len(w) > 0 THEN 2.0 * len(list_intersect(v, w)) / (len(v) + len(w)) ELSE 0.0 END), 6) AS best FROM sv JOIN ev USING (run_id) GROUP BY 1, 2, 3)"""


@query(f"WITH {ANSWERS}, {GROUNDED} SELECT run_id, position, sentence, best, ({_FREE}) OR best >= 0.15 AS grounded FROM grounded")
def claim_grounding(spark, d):
    return cite.grounding(_answers(spark, d), evidence(spark, d))


@query(f"""WITH {ANSWERS}, {BOUND}, {GROUNDED}, b AS (SELECT run_id, count(*) AS total, count(*) FILTER (valid) AS ok FROM bound GROUP BY 1),
g AS (SELECT run_id, count(*) AS total, count(*) FILTER (({_FREE}) OR best >= 0.15) AS ok FROM grounded GROUP BY 1),
m AS (SELECT run_id, len(regexp_extract_all(answer, '(?:\\[SOURCE|【Source)[^\\]】]*[\\]】]')) AS marks FROM answers)
SELECT run_id, coalesce(b.total, 0) AS total_citations, coalesce(b.ok, 0) AS valid_citations, coalesce(b.total, 0) - coalesce(b.ok, 0) AS hallucinated_citations, greatest(marks - coalesce(b.total, 0), 0) AS malformed_citations,
  round(CASE WHEN coalesce(b.total, 0) > 0 THEN b.ok / b.total ELSE 1.0 END, 6) AS citation_accuracy, coalesce(g.total, 0) AS total_sentences, coalesce(g.ok, 0) AS grounded_sentences,
  round(CASE WHEN coalesce(g.total, 0) > 0 THEN g.ok / g.total ELSE 1.0 END, 6) AS faithfulness FROM m LEFT JOIN b USING (run_id) LEFT JOIN g USING (run_id)""")
def citation_verify(spark, d):
    return cite.verify(_answers(spark, d), evidence(spark, d))


def _terms(x: str, n: int) -> str:
    return f"list_filter({tokset(x)}, lambda w: regexp_full_match(w, '[a-z]{{{n},}}'))"


_PLAIN = "plain AS (SELECT run_id, regexp_replace(answer, ' 【Source \\d+】', '', 'g') AS answer FROM answers)"
_CLAIM_MARKS = " AND ".join(f"NOT contains(lower(sentence), '{m}')" for m in L.CLAIM_DISCLAIMER_MARKS)


def _plain(spark, d):
    """The answers with their marks taken out: material for claim checks and injection."""
    return _answers(spark, d).select("run_id", F.regexp_replace("answer", r" 【Source \d+】", "").alias("answer"))


def _truth(spark, d):
    """The ground truth of each run's item as its answer: its claims need not be in the evidence."""
    items = table(spark, d, "eval_items").where("ground_truth_answer is not null").select(F.col("id").alias("query_id"), F.col("ground_truth_answer").alias("answer"))
    return runs(spark, d).select("run_id", "query_id").distinct().join(items, "query_id").select("run_id", "answer")


_CLAIMS = f"""truth AS (SELECT DISTINCT run_id, ground_truth_answer AS answer FROM judged j JOIN eval_items e ON e.id = j.query_id WHERE ground_truth_answer IS NOT NULL),
s AS (SELECT run_id, trim(unnest({sentences('answer')})) AS sentence, generate_subscripts({sentences('answer')}, 1)::INT - 1 AS position FROM truth),
c AS (SELECT *, {_terms('sentence', 4)} AS terms FROM s WHERE length(sentence) >= 20 AND NOT contains(sentence, '[SOURCE:') AND NOT contains(sentence, '【Source') AND {_CLAIM_MARKS}),
h AS (SELECT run_id, list_distinct(flatten(list({_terms('content', 4)}))) AS held FROM evidence GROUP BY 1),
bad AS (SELECT c.run_id, position, substring(sentence, 1, 120) AS claim FROM c LEFT JOIN h USING (run_id) WHERE coalesce(len(list_intersect(terms, held)), 0) / greatest(len(terms), 1) < 0.3)"""


@query(f"WITH {EVIDENCE}, {_CLAIMS} SELECT run_id, position, claim FROM bad")
def unsupported_claims(spark, d):
    """Claims of the ground truth that the hits of the run do not bear out."""
    return cite.unsupported_claims(_truth(spark, d), evidence(spark, d))


@query(f"""WITH {EVIDENCE}, {_CLAIMS}, n AS (SELECT run_id, greatest(len({sentences('answer')}), 1)::INT AS sentences FROM truth), b AS (SELECT run_id, count(*) AS unsupported FROM bad GROUP BY 1)
SELECT run_id, sentences, coalesce(unsupported, 0) AS unsupported, round(1.0 - coalesce(unsupported, 0) / sentences, 6) AS faithfulness FROM n LEFT JOIN b USING (run_id)""")
def claim_faithfulness(spark, d):
    return cite.claim_faithfulness(_truth(spark, d), evidence(spark, d))


@query(f"WITH {METRICS}, {FAILURES.format(same=4)} SELECT category, count(*) AS runs, count(failure_mode) AS refused, round(count(failure_mode) / count(*), 6) AS refusal_rate FROM metrics LEFT JOIN failures USING (run_id) GROUP BY category")
def refusal_rate(spark, d):
    """The share of runs with a failure mode: for questions out of scope, the refusal rate."""
    rows = _metrics(spark, d).join(metrics.failure_modes(judged(spark, d)), "run_id", "left")
    refused = F.count("failure_mode")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("runs"), refused.alias("refused"), F.round(refused / F.count(F.lit(1)), 6).alias("refusal_rate"))


@query(f"WITH {RUNS} SELECT run_id, max(coalesce(similarity, 0.0)) AS top_similarity, round(avg(coalesce(similarity, 0.0)), 6) AS mean_similarity FROM runs GROUP BY 1")
def similarity_summary(spark, d):
    similarity = F.coalesce("similarity", F.lit(0.0))
    return runs(spark, d).groupBy("run_id").agg(F.max(similarity).alias("top_similarity"), F.round(F.avg(similarity), 6).alias("mean_similarity"))


_STOP = [*L.MORE_STOP_WORDS, "that", "this", "has", "have"]


@query(f"""WITH {ANSWERS}, {_PLAIN}, s AS (SELECT run_id, unnest({sentences('answer')}) AS sentence, generate_subscripts({sentences('answer')}, 1) - 1 AS position FROM plain),
sv AS (SELECT *, {_terms('sentence', 3)} AS v FROM s), ev AS (SELECT run_id, rank, document_name, section_title, page_number, list_filter({_terms('content', 3)}, lambda w: NOT list_contains({_STOP!r}, w)) AS w FROM evidence),
p AS (SELECT run_id, position, any_value(sentence) AS sentence, max(len(list_intersect(v, w))) AS shared, arg_max((document_name, section_title, page_number), (len(list_intersect(v, w)), -rank)) AS b FROM sv JOIN ev USING (run_id) GROUP BY 1, 2)
SELECT run_id, string_agg(CASE WHEN NOT contains(sentence, '[SOURCE:') AND shared >= 2 THEN rtrim(sentence) || ' [SOURCE: ' || coalesce(b[1], '') || ', ' || coalesce(b[2], '') || ', page ' || coalesce(b[3], '') || ']' ELSE sentence END, ' ' ORDER BY position) AS answer FROM p GROUP BY 1""")
def citation_inject(spark, d):
    return cite.inject_citations(_plain(spark, d), evidence(spark, d))


@query(f"WITH {EVIDENCE} SELECT run_id, string_agg('[EVIDENCE ' || rank || '] ' || substring(coalesce(content, ''), 1, 600), chr(10) || chr(10) ORDER BY rank) AS context FROM evidence WHERE rank <= 5 GROUP BY 1")
def context_assembly(spark, d):
    return cite.context(evidence(spark, d))


@query(f"""WITH {ANSWERS}, {CITED}, n AS (SELECT run_id, count(*) AS citations, count(DISTINCT citation) AS cited_documents FROM cited GROUP BY 1),
h AS (SELECT run_id, max(coalesce(similarity, 0.0)) AS top_similarity, round(median(coalesce(similarity, 0.0)), 6) AS median_similarity, count(DISTINCT coalesce(document_name, '')) AS documents FROM judged GROUP BY 1),
a AS (SELECT h.*, coalesce(citations, 0) AS citations, coalesce(cited_documents, 0) AS cited_documents FROM h LEFT JOIN n USING (run_id)),
p AS (SELECT *, CASE WHEN top_similarity >= 0.55 THEN 3 WHEN top_similarity >= 0.45 THEN 2 WHEN top_similarity >= 0.35 THEN 1 ELSE 0 END + CASE WHEN median_similarity >= 0.45 THEN 1 ELSE 0 END
  + CASE WHEN citations >= 2 THEN 2 WHEN citations >= 1 THEN 1 ELSE 0 END + CASE WHEN cited_documents >= 2 THEN 1 ELSE 0 END + CASE WHEN documents >= 2 THEN 1 ELSE 0 END AS points FROM a)
SELECT * EXCLUDE (points), CASE WHEN points >= 7 THEN 'HIGH' WHEN points >= 4 THEN 'MEDIUM' WHEN points >= 2 THEN 'LOW' ELSE 'INSUFFICIENT' END AS confidence FROM p""")
def confidence_estimate(spark, d):
    cited = cite.citations(_answers(spark, d)).groupBy("run_id").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("citation").alias("cited_documents"))
    return guard.confidence(judged(spark, d), cited)


# A model's answer to each evaluation item, as raw text: after its thoughts, cut off, or no JSON.
_RAW = """raws AS (SELECT id, CASE difficulty WHEN 'hard' THEN '<think>{"scope_level": "REFUSE"}</think> ' ELSE '' END ||
  CASE category WHEN 'adversarial' THEN '{"scope_level": "' || coalesce(expected_verdict, '') WHEN 'inferential' THEN 'No answer.' ELSE '{"scope_level": "' || lower(coalesce(expected_verdict, '')) || '", "reason": 1}' END AS raw FROM eval_items)"""


def _raw(spark, d):
    verdict = F.coalesce("expected_verdict", F.lit(""))
    thoughts = F.when(F.col("difficulty") == "hard", '<think>{"scope_level": "REFUSE"}</think> ').otherwise("")
    said = F.when(F.col("category") == "adversarial", F.concat(F.lit('{"scope_level": "'), verdict)).when(F.col("category") == "inferential", "No answer.")
    return table(spark, d, "eval_items").select("id", F.concat(thoughts, said.otherwise(F.concat(F.lit('{"scope_level": "'), F.lower(verdict), F.lit('", "reason": 1}')))).alias("raw"))


@query(f"""WITH {_RAW}, plain AS (SELECT id, trim(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g')) AS raw FROM raws), level AS (SELECT id, CASE WHEN json_valid(raw) THEN upper(json_extract_string(raw, '$.scope_level')) END AS x FROM plain)
SELECT id, CASE WHEN x IN ('ALLOWED', 'NEEDS_CAUTION', 'REFUSE') THEN x ELSE 'REFUSE' END AS scope FROM level""")
def json_scope_parse(spark, d):
    """Raw scope answers parsed, failing closed."""
    return _raw(spark, d).select("id", guard.parsed_scope(F.col("raw")).alias("scope"))


@query(f"""WITH {RUNS}, s AS (SELECT run_id, rank - 1 AS i, (round(10 * coalesce(rerank_score, similarity, 0.0)))::INT AS score FROM runs WHERE rank <= 5),
m AS (SELECT run_id, round(avg(score), 6) AS mean_relevance, (count(*) FILTER (score >= 6))::INT AS relevant_count, count(*) AS n, bool_and(score BETWEEN 0 AND 10) AS valid FROM s GROUP BY 1),
v AS (SELECT run_id, valid AND n <> 4 AS ok, mean_relevance, relevant_count FROM m)
SELECT run_id, CASE WHEN ok AND mean_relevance >= 6 AND relevant_count >= 2 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS verdict, CASE WHEN ok THEN mean_relevance ELSE 0.0 END AS mean_relevance, CASE WHEN ok THEN relevant_count ELSE 0 END AS relevant_count FROM v""")
def json_critic_parse(spark, d):
    """Raw critic answers, written from the logged scores and cut off where a run has four hits, parsed:
    what does not parse is INSUFFICIENT."""
    score = F.round(10 * F.coalesce("rerank_score", "similarity", F.lit(0.0))).cast("int")
    rows = runs(spark, d).where("rank <= 5").groupBy("run_id").agg(F.collect_list(F.struct((F.col("rank") - 1).alias("chunk_idx"), score.alias("score"))).alias("scores"))
    raw = F.to_json(F.struct("scores"))
    rows = rows.select("run_id", F.when(F.size("scores") == 4, F.expr("substring(x, 1, length(x) - 9)".replace("x", "to_json(struct(scores))"))).otherwise(raw).alias("raw"))
    return rows.select("run_id", guard.critic_report(guard.parsed_scores(F.col("raw"))).alias("r")).select("run_id", "r.verdict", "r.mean_relevance", "r.relevant_count")


@query(f"WITH {JUDGED}, cited AS (SELECT run_id, document_name || '|' || coalesce(section_title, '') AS key, min(rank) AS first_rank FROM judged GROUP BY 1, 2) SELECT run_id, key, first_rank FROM cited")
def distinct_citation_keys(spark, d):
    """Each source of a run once, at its first rank."""
    rows = judged(spark, d).select("run_id", F.concat("document_name", F.lit("|"), F.coalesce("section_title", F.lit(""))).alias("key"), "rank")
    return rows.groupBy("run_id", "key").agg(F.min("rank").alias("first_rank"))




NOTE = "This output does not replace the judgement of a clinician."


@query(rf"""WITH {ANSWERS}, shown AS (SELECT run_id, '📋 **Answer**' || chr(10) || answer || chr(10) || chr(10) || '🎯 **Confidence**: LOW' || chr(10) || chr(10) || '⚕️ {NOTE}' AS text FROM answers)
SELECT run_id, trim(regexp_replace(regexp_replace(text, '(?s)🎯.*$', ''), '^📋 \*\*Answer\*\*\n', ''), ' ' || chr(10)) AS answer, len(regexp_extract_all(text, '【Source \d+】'))::INT AS evidence,
  regexp_extract(text, 'Confidence\*\*: ([A-Z]+)', 1) AS confidence, '{NOTE}' AS disclaimer FROM shown""")
def answer_parse(spark, d):
    """Formatted answers taken apart again."""
    shown = _answers(spark, d).select("run_id", F.concat(F.lit("📋 **Answer**\n"), "answer", F.lit(f"\n\n🎯 **Confidence**: LOW\n\n⚕️ {NOTE}")).alias("text"))
    parts = shown.select("run_id", cite.answer_sections(F.col("text")).alias("s"))
    return parts.select("run_id", F.trim(F.regexp_replace("s.answer", r"\s+$", "")).alias("answer"), F.size("s.evidence").alias("evidence"), "s.confidence", "s.disclaimer")


@query(f"""WITH {ANSWERS}, shown AS (SELECT DISTINCT a.run_id, coalesce(expected_verdict, '') AS verdict, answer || chr(10) || 'Confidence: HIGH' AS answer FROM answers a JOIN judged j USING (run_id))
SELECT run_id, verdict, CASE WHEN verdict = 'NEEDS_CAUTION' THEN replace(answer, 'Confidence: HIGH', 'Confidence: MEDIUM') || chr(10) || chr(10) || '{NOTE}' ELSE answer END AS answer FROM shown""")
def disclaimer_cap(spark, d):
    """Answers that need caution get the disclaimer and lose their high confidence."""
    verdicts = judged(spark, d).select("run_id", F.coalesce("expected_verdict", F.lit("")).alias("verdict")).distinct()
    rows = _answers(spark, d).join(verdicts, "run_id").withColumn("answer", F.concat("answer", F.lit("\nConfidence: HIGH")))
    return rows.select("run_id", "verdict", cite.with_disclaimer(F.col("answer"), F.col("verdict"), NOTE).alias("answer"))
