"""Vector, lexical and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import vectors as V
from ..operators import fusion, metrics, search
from ..operators.fusion import DEMO, OFFLINE, SERVER, Profile
from .base import FIRST_CHUNKS, first_chunks, first_ids, query, registry, runs, RUNS, spread_table, table, tok, tokset

DIM = 64
USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
VECTORS = f"vectors AS (SELECT vec_id, chunk_id, embedding::DOUBLE[] AS v FROM chunk_vectors WHERE {USABLE})"
COSINE = "round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"
NEAR = f"""{VECTORS}, near AS (SELECT q.vec_id AS query_id, r.vec_id AS id, {COSINE.format(a='q.v', b='r.v')} AS score
  FROM vectors q, vectors r WHERE q.vec_id % 20 = 0)"""


def _near(spark, d, k: int) -> DataFrame:
    rows = spread_table(spark, d, "chunk_vectors", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.vector_topk(rows.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "v"), rows, k, DIM)


def _top(k: int, source: str = "near", tie: str = "id", by: str = "query_id") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {tie}) AS rank FROM {source} QUALIFY rank <= {k})"


@query(f"WITH {NEAR} SELECT query_id, id, score, rank::INT AS rank FROM {_top(10)}")
def knn_cosine_topk(spark, d):
    return _near(spark, d, 10)


@query(f"WITH {NEAR} SELECT query_id, id, score FROM {_top(20)} WHERE score > 0.85")
def knn_threshold_strict(spark, d):
    return search.above(_near(spark, d, 20), 0.85).select("query_id", "id", "score")


@query(f"WITH {NEAR} SELECT query_id, id, score FROM {_top(20)} WHERE score >= 0.5")
def knn_threshold_inclusive(spark, d):
    return search.above(_near(spark, d, 20), 0.5, strict=False).select("query_id", "id", "score")


@query(f"""WITH {NEAR}, {FIRST_CHUNKS}, kept AS (SELECT t.query_id, t.id, t.score FROM {_top(15)} t JOIN chunk_vectors v ON v.vec_id = t.id
  JOIN first_chunks c ON c.chunk_id = v.chunk_id WHERE t.score >= 0.3 AND c.language = 'en') SELECT query_id, id, score, rank::INT AS rank FROM {_top(5, 'kept')}""")
def knn_overfetch_filter(spark, d):
    """Three times k fetched, then threshold and language, then k: fewer may remain."""
    lang = table(spark, d, "chunk_vectors").select(F.col("vec_id").alias("id"), "chunk_id").join(first_chunks(spark, d, "language").select("chunk_id", "language"), "chunk_id")
    kept = search.above(_near(spark, d, 15), 0.3, strict=False).drop("rank").join(lang.where("language = 'en'").select("id"), "id")
    return search.top_ranked(kept.select("query_id", "id", "score"), 5)


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(list_slice(embedding::DOUBLE[], 1, 48), lambda x: x * x))), 6) AS norm_48, len(embedding) AS dim FROM chunk_vectors WHERE {USABLE}")
def vector_dim_guard(spark, d):
    rows = table(spark, d, "chunk_vectors").where(V.usable(F.col("embedding"), DIM))
    return rows.select("vec_id", F.round(V.norm(V.fit(V.fit(F.col("embedding"), 48), 96)), 6).alias("norm_48"), F.size("embedding").alias("dim"))


@query(f"SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-8), 6) AS first_entry FROM chunk_vectors WHERE {USABLE}")
def vector_l2_normalize(spark, d):
    rows = table(spark, d, "chunk_vectors").where(V.usable(F.col("embedding"), DIM))
    return rows.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.l2_normalize(F.col("embedding"))[0], 6).alias("first_entry"))


# --- lexical ------------------------------------------------------------------------------

TERMS = f"q AS (SELECT id AS query_id, question AS text FROM eval_items), qt AS (SELECT query_id, len({tokset('text')}) AS n_terms, unnest({tokset('text')}) AS term FROM q)"
HELD = f"held AS (SELECT id, unnest({tokset('original_text')}) AS term FROM chunks)"


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("id").alias("query_id"), F.col("question").alias("text"))


def _asked(spark, d) -> DataFrame:
    return _questions(spark, d).select(F.col("text").alias("query"))


def _texts(spark, d) -> DataFrame:
    return spread_table(spark, d, "chunks", "id", "original_text").withColumnRenamed("original_text", "text")


@query(f"""WITH {TERMS}, {HELD}, m AS (SELECT query_id, id, round(count(*) / max(n_terms), 6) AS score FROM held JOIN qt USING (term) GROUP BY 1, 2)
SELECT query_id, id, score, rank::INT AS rank FROM {_top(10, 'm')}""")
def lexical_coverage_score(spark, d):
    return search.coverage(_questions(spark, d), _texts(spark, d), 10)


@query(f"""WITH q AS (SELECT DISTINCT section_title AS query_id FROM chunks WHERE section_title IS NOT NULL), qt AS (SELECT query_id, len({tokset('query_id')}) AS n, unnest({tokset('query_id')}) AS term FROM q),
{HELD}, m AS (SELECT query_id, id FROM held JOIN qt USING (term) GROUP BY query_id, id HAVING count(*) = max(n)) SELECT query_id AS section_title, count(*) AS matches, min(id) AS first_id FROM m GROUP BY 1""")
def lexical_and_match(spark, d):
    """Chunks that hold every word of a section title, for every section title of the table."""
    titles = table(spark, d, "chunks").where("section_title is not null").select(F.col("section_title").alias("query_id")).distinct()
    got = search.match_all(titles.withColumn("text", F.col("query_id")), _texts(spark, d))
    return got.groupBy(F.col("query_id").alias("section_title")).agg(F.count(F.lit(1)).alias("matches"), F.min("id").alias("first_id"))


@query(f"""WITH q AS (SELECT id AS query_id, question AS text FROM eval_items), qt AS (SELECT DISTINCT query_id, unnest({tok('text')}) AS term FROM q),
c AS (SELECT id, len({tok('original_text')}) AS len, {tok('original_text')} AS terms FROM chunks WHERE original_text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len) AS mean FROM c),
tf AS (SELECT id, any_value(len) AS len, term, count(*) AS tf FROM (SELECT id, len, unnest(terms) AS term FROM c) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
m AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), s GROUP BY 1, 2)
SELECT query_id, id, score, rank::INT AS rank FROM {_top(10, 'm')}""")
def bm25_okapi(spark, d):
    return search.bm25(_questions(spark, d), _texts(spark, d), 10)


@query()
def fts_cover_density(spark, d):
    """Section titles as queries, as in lexical_and_match; tested against brute force."""
    titles = table(spark, d, "chunks").where("section_title is not null").select(F.col("section_title").alias("query_id")).distinct()
    return search.cover_density(titles.withColumn("text", F.col("query_id")), _texts(spark, d), 10)


_WIDE = f"list_distinct(flatten([{tok('text')}, " + ", ".join(f"CASE WHEN contains(lower(text), '{p}') THEN {s.split()!r} ELSE []::VARCHAR[] END" for p, s in L.SYNONYMS) + "]))"
_PHRASE = "1.0 + " + " + ".join(f"CASE WHEN contains(lower(text), '{p}') AND contains(lower(original_text), '{p}') THEN 0.3 ELSE 0.0 END" for p in L.PHRASES)


def _profile_sql(k: int) -> str:
    return f"""q AS (SELECT id AS query_id, question AS text, {tokset('question')} AS own FROM eval_items), wide AS (SELECT query_id, {_WIDE} AS terms FROM q),
wt AS (SELECT query_id, len(terms) AS nb, unnest(terms) AS term FROM wide), ot AS (SELECT query_id, len(own) AS na, unnest(own) AS term FROM q),
c AS (SELECT * FROM first_chunks), held AS (SELECT id, unnest({tokset('original_text')}) AS term FROM c),
base AS (SELECT query_id, id, greatest(count(ot.term) / any_value(x.na), 0.7 * count(*) / any_value(nb)) AS base FROM held JOIN wt USING (term) LEFT JOIN ot USING (query_id, term) JOIN (SELECT DISTINCT query_id, na FROM ot) x USING (query_id) GROUP BY 1, 2),
lex AS (SELECT query_id, id, round(base * (1.0 + 0.3 * len(list_filter(own, lambda t: contains(lower(coalesce(document_name, '')), t))) + 0.15 * len(list_filter(own, lambda t: contains(lower(coalesce(section_title, '')), t)))) * ({_PHRASE}), 6) AS score
  FROM base JOIN q USING (query_id) JOIN c USING (id)), lexical AS (SELECT query_id, id, score, rank FROM {_top(k, 'lex')})"""


def _lexical(spark, d, k: int) -> DataFrame:
    """The local lexical leg: expanded coverage x name boost x phrase boost. What depends on the
    query or the chunk alone is computed before they meet."""
    chunks, low = first_chunks(spark, d, "original_text", "document_name", "section_title", heavy=True), lambda c: F.lower(F.coalesce(c, F.lit("")))
    rows = chunks.select("id", F.col("original_text").alias("text"), low("document_name").alias("name"), low("section_title").alias("section"), fusion.phrase_mask(F.col("original_text")).alias("phrases"))
    return search.profile(_questions(spark, d).withColumn("phrases", fusion.phrase_mask(F.col("text"))), rows, k)


@query(f"WITH {FIRST_CHUNKS}, {_profile_sql(10)} SELECT query_id, id, score, rank::INT AS rank FROM lexical")
def lexical_profile_score(spark, d):
    return _lexical(spark, d, 10)


# --- legs, fusion, boosts -----------------------------------------------------------------

QUERY_VECTORS = f"""{RUNS}, {VECTORS}, cv AS (SELECT chunk_id, min(vec_id) AS vec_id FROM vectors GROUP BY 1), cvv AS (SELECT cv.chunk_id, c.id, v FROM cv JOIN vectors USING (vec_id) JOIN first_chunks c ON c.chunk_id = cv.chunk_id),
qv AS (SELECT query_id, arg_min(v, (rank, hit_id)) AS v FROM runs JOIN cvv USING (chunk_id) GROUP BY 1),
semn AS (SELECT query_id, id, {COSINE.format(a='qv.v', b='cvv.v')} AS score FROM qv, cvv)"""


def chunk_vectors(spark, d) -> DataFrame:
    """(id, chunk_id, v): one usable vector, that of the smallest id, for each chunk."""
    rows = spread_table(spark, d, "chunk_vectors", "vec_id", "chunk_id", "embedding").where(V.usable(F.col("embedding"), DIM))
    first = Window.partitionBy("chunk_id").orderBy("vec_id")
    one = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("chunk_id", F.col("embedding").alias("v"))
    return one.join(first_ids(spark, d), "chunk_id").select("id", "chunk_id", "v")


def query_vectors(spark, d) -> DataFrame:
    """(query_id, v): the vector of the best-ranked logged hit stands for a question's embedding
    (the embedding client is pluggable; tables hold no question vectors)."""
    hits = runs(spark, d).join(chunk_vectors(spark, d), "chunk_id")
    return hits.groupBy("query_id").agg(F.min_by("v", F.struct("rank", "hit_id")).alias("v"))


def _semantic(spark, d, k: int, least: float | None = None) -> DataFrame:
    got = search.vector_topk(query_vectors(spark, d), chunk_vectors(spark, d).select("id", "v"), k, DIM)
    return got if least is None else search.above(got, least, strict=False)


def _fused(spark, d, profile: Profile, top: int, least: float | None = None) -> DataFrame:
    """Candidates with fused score and all that the boosts need."""
    n = profile.fetch * top
    weights = _questions(spark, d).select("query_id", F.col("text").alias("query"), fusion.own_words(F.col("text"), profile.stop_words).alias("words"), fusion.keyword_weight(F.col("text"), profile.lexical_weight).alias("w"))
    fused = fusion.fuse(_semantic(spark, d, n, least), _lexical(spark, d, n), profile, top, F.lit(1.0)).drop("score").join(search.bounded(weights), "query_id")
    fused = fusion_score(fused, profile, n)
    # The candidates' ids are those of first chunks, so only their rows are fetched.
    return fused.join(table(spark, d, "chunks").select("id", "document_name", "section_title", "original_text"), "id")


def fusion_score(rows: DataFrame, profile: Profile, n: int) -> DataFrame:
    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (profile.rrf_k + F.col(rank)), F.lit(1.0 / (profile.rrf_k + n + 1) if profile.absent else 0.0))

    return rows.withColumn("score", part("semantic_rank") + F.col("w") * part("lexical_rank"))


def _fused_sql(profile: Profile, top: int, least: float = -2.0) -> str:
    n = profile.fetch * top
    absent = 1.0 / (profile.rrf_k + n + 1) if profile.absent else 0.0
    keyword = " OR ".join(f"contains(lower(text), '{t}')" for t in L.KEYWORD_TERMS)
    return f"""{FIRST_CHUNKS}, {_profile_sql(n)}, {QUERY_VECTORS}, semantic AS (SELECT query_id, id, rank FROM {_top(n, 'semn')} WHERE score >= {least}),
fused AS (SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.id, l.id) AS id, s.rank AS semantic_rank, l.rank AS lexical_rank FROM semantic s FULL OUTER JOIN lexical l ON s.query_id = l.query_id AND s.id = l.id),
scored AS (SELECT f.*, q.text AS query, document_name, section_title, original_text, coalesce(1.0::DOUBLE / ({profile.rrf_k} + semantic_rank), {absent!r}::DOUBLE) + (CASE WHEN {keyword} THEN {profile.lexical_weight} ELSE 1.0 END)::DOUBLE * coalesce(1.0::DOUBLE / ({profile.rrf_k} + lexical_rank), {absent!r}::DOUBLE) AS score
  FROM fused f JOIN q USING (query_id) JOIN first_chunks c ON c.id = f.id)"""


@query(f"WITH {_fused_sql(SERVER, 10)} SELECT query_id, id, semantic_rank::INT AS semantic_rank, lexical_rank::INT AS lexical_rank, round(score, 9) AS score FROM scored")
def rrf_server(spark, d):
    return _fused(spark, d, SERVER, 10).select("query_id", "id", "semantic_rank", "lexical_rank", F.round("score", 9).alias("score"))


@query(f"WITH {_fused_sql(DEMO, 5)} SELECT query_id, id, semantic_rank::INT AS semantic_rank, lexical_rank::INT AS lexical_rank, round(score, 9) AS score FROM scored")
def rrf_weighted(spark, d):
    return _fused(spark, d, DEMO, 5).select("query_id", "id", "semantic_rank", "lexical_rank", F.round("score", 9).alias("score"))


def _org_rules(spark, d) -> DataFrame:
    """Rules as data: the first word of a registered organisation, and the names it publishes."""
    return registry(spark, d).where("organization is not null").select(F.split(F.trim("organization"), " ")[0].alias("term"), F.col("document_name").alias("pattern")).distinct()


RULES = "rules AS (SELECT DISTINCT string_split(trim(organization), ' ')[1] AS term, document_name AS pattern FROM source_registry WHERE organization IS NOT NULL)"


def _org_sql(factor: float) -> str:
    return f"CASE WHEN EXISTS (SELECT 1 FROM rules r WHERE contains(lower(query), lower(r.term)) AND contains(lower(document_name), lower(r.pattern))) THEN {factor} ELSE 1.0 END"


def _words_sql(x: str, stop) -> str:
    return f"list_filter({tokset(x)}, lambda w: NOT list_contains({list(stop)!r}, w))"


def _section_sql(p: Profile) -> str:
    q, s = _words_sql("query", p.stop_words), _words_sql("coalesce(section_title, '')", p.stop_words)
    return f"CASE WHEN len({q}) > 0 AND len({s}) > 0 AND len(list_intersect({q}, {s})) / len({q}) >= {p.section_least} THEN {p.section_factor} ELSE 1.0 END"


_KEYWORD_SQL = "CASE " + " ".join(f"WHEN contains(lower(coalesce(section_title, '')), '{k}') THEN {f}" for k, f in L.SECTION_KEYWORDS) + " ELSE 1.0 END"


def _content_sql(stop) -> str:
    return f"CASE WHEN len(list_filter({_words_sql('query', stop)}, lambda w: contains(lower(coalesce(original_text, '')), w))) >= 3 THEN 1.15 ELSE 1.0 END"


HITS = f"{FIRST_CHUNKS}, {RUNS}, hits AS (SELECT hit_id, e.question AS query, r.document_name, r.section_title, c.original_text FROM runs r JOIN eval_items e ON e.id = r.query_id JOIN first_chunks c USING (chunk_id))"


def _hits(spark, d) -> DataFrame:
    text = first_chunks(spark, d, "original_text").select("chunk_id", "original_text")
    asked = _questions(spark, d).withColumnRenamed("text", "query")
    return runs(spark, d).select("hit_id", "query_id", "chunk_id", "document_name", "section_title").join(asked, "query_id").join(text, "chunk_id")


@query(f"WITH {RULES}, {HITS} SELECT hit_id, ({_org_sql(1.5)})::DOUBLE AS factor FROM hits")
def org_boost(spark, d):
    return fusion.rule_factors(_hits(spark, d), _org_rules(spark, d), 1.5, _asked(spark, d)).select("hit_id", F.col("rule_factor").alias("factor"))


@query(f"WITH {HITS} SELECT hit_id, ({_section_sql(SERVER)})::DOUBLE AS server_factor, ({_section_sql(DEMO)})::DOUBLE AS demo_factor FROM hits")
def section_overlap_boost(spark, d):
    s, words = F.col("section_title"), lambda p: fusion.own_words(F.col("query"), p.stop_words)
    return _hits(spark, d).select("hit_id", fusion.section_overlap(words(SERVER), s, SERVER).alias("server_factor"), fusion.section_overlap(words(DEMO), s, DEMO).alias("demo_factor"))


@query(f"SELECT id, ({_KEYWORD_SQL})::DOUBLE AS factor FROM chunks")
def section_keyword_boost(spark, d):
    return table(spark, d, "chunks").select("id", fusion.section_keywords(F.col("section_title")).alias("factor"))


@query(f"WITH {HITS} SELECT hit_id, ({_content_sql(L.MORE_STOP_WORDS)})::DOUBLE AS factor FROM hits")
def content_boost(spark, d):
    return _hits(spark, d).select("hit_id", fusion.content_overlap(fusion.own_words(F.col("query"), L.MORE_STOP_WORDS), F.col("original_text")).alias("factor"))


@query(f"WITH {HITS} SELECT hit_id, round({_PHRASE.replace('lower(text)', 'lower(query)')}, 6)::DOUBLE AS factor FROM hits")
def phrase_boost(spark, d):
    return _hits(spark, d).select("hit_id", F.round(fusion.phrase_boost(fusion.phrase_mask(F.col("query")), fusion.phrase_mask(F.col("original_text"))), 6).alias("factor"))


def _dedup_sql(source: str, top: int, most: int, by: str = "query_id") -> str:
    return f"""a_{most} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {by}, document_name, section_title ORDER BY rank) = 1),
b_{most} AS (SELECT * FROM a_{most} QUALIFY row_number() OVER (PARTITION BY {by}, document_name ORDER BY rank) <= {most}),
final_{most} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY rank) AS position FROM b_{most} QUALIFY position <= {top})"""


@query(f"WITH {RUNS}, {_dedup_sql('runs', 5, 2, 'run_id')} SELECT run_id, hit_id, position::INT AS position FROM final_2")
def dedup_max_per_doc(spark, d):
    return fusion.deduplicate(runs(spark, d), 5, 2, by="run_id").select("run_id", "hit_id", "position")


def hybrid(spark, d, profile: Profile, top: int = 5, least: float | None = None) -> DataFrame:
    """Both legs, fusion, boosts, order and deduplication for every question at once."""
    rows = _fused(spark, d, profile, top, least)
    rows = fusion.rule_factors(rows, _org_rules(spark, d), profile.org_factor, _asked(spark, d))
    boosts = F.col("rule_factor") * fusion.section_overlap(F.col("words"), F.col("section_title"), profile)
    if profile is not SERVER:
        boosts = boosts * fusion.section_keywords(F.col("section_title")) * fusion.content_overlap(F.col("words"), F.col("original_text"))
    ranked = rows.withColumn("score", F.round(F.col("score") * boosts, 9))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return fusion.deduplicate(ranked, top, profile.max_per_doc).select("query_id", "position", "id", "document_name", "section_title", "score")


def _hybrid_sql(profile: Profile, top: int = 5, least: float = -2.0) -> str:
    boosts = f"({_org_sql(profile.org_factor)})::DOUBLE * ({_section_sql(profile)})::DOUBLE"
    if profile is not SERVER:
        boosts += f" * ({_KEYWORD_SQL})::DOUBLE * ({_content_sql(profile.stop_words)})::DOUBLE"
    return f"""WITH {RULES}, {_fused_sql(profile, top, least)}, boosted AS (SELECT * EXCLUDE (score), round(score * ({boosts}), 9) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM boosted), {_dedup_sql('ranked', top, profile.max_per_doc)}
SELECT query_id, position::INT AS position, id, document_name, section_title, score FROM final_{profile.max_per_doc}"""


@query(_hybrid_sql(DEMO))
def hybrid_retrieve(spark, d):
    return hybrid(spark, d, DEMO)


@query(_hybrid_sql(SERVER))
def hybrid_retrieve_server(spark, d):
    return hybrid(spark, d, SERVER)


@query(_hybrid_sql(OFFLINE))
def hybrid_retrieve_offline(spark, d):
    return hybrid(spark, d, OFFLINE)


def retrieve(spark, d, mode: str, top: int = 5, least: float = 0.15) -> DataFrame:
    """(query_id, id, rank) by one of the search modes; another name is an error."""
    if mode == "semantic":
        return _semantic(spark, d, top, least).select("query_id", "id", "rank")
    if mode == "bm25":
        return _lexical(spark, d, top).select("query_id", "id", "rank")
    if mode == "hybrid":
        return hybrid(spark, d, DEMO, top, least).select("query_id", "id", F.col("position").alias("rank"))
    raise ValueError(f"unknown search mode {mode!r}: semantic, bm25 or hybrid")


_MODES = f"""{_hybrid_sql(DEMO, 5, 0.15).partition('SELECT query_id, position::INT')[0].rstrip()},
modes AS (SELECT 'semantic' AS mode, query_id, id, rank FROM semantic WHERE rank <= 5 UNION ALL SELECT 'bm25', query_id, id, rank FROM lexical WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, id, position FROM final_3),
named AS (SELECT mode, query_id, rank, c.document_name, list_distinct(list_transform(coalesce(ground_truth_sources, []), lambda x: lower(x))) AS truth FROM modes JOIN chunks c USING (id) JOIN eval_items e ON e.id = query_id),
hit AS (SELECT *, len(list_filter(truth, lambda g: g <> '' AND lower(coalesce(document_name, '')) <> '' AND (contains(lower(coalesce(document_name, '')), g) OR contains(g, lower(coalesce(document_name, '')))))) > 0 AS ok FROM named),
per AS (SELECT mode, query_id, count(*) AS n, count(*) FILTER (ok) / 5 AS p FROM hit GROUP BY 1, 2)"""


@query(f"""{_MODES}, docs AS (SELECT mode, count(DISTINCT document_name) AS documents FROM named GROUP BY 1)
SELECT mode, sum(n)::BIGINT AS rows, count(*) AS queries, any_value(documents) AS documents, round(avg(p), 6) AS precision_at_5 FROM per JOIN docs USING (mode) GROUP BY mode""")
def mode_comparison(spark, d):
    """The three modes on every question: five results each, a threshold on similarity, and precision."""
    rows = None
    for mode in ("semantic", "bm25", "hybrid"):
        part = retrieve(spark, d, mode).withColumn("mode", F.lit(mode))
        rows = part if rows is None else rows.unionByName(part)
    truth = F.array_distinct(F.transform(F.coalesce("ground_truth_sources", F.array()), F.lower))
    items = table(spark, d, "eval_items").select(F.col("id").alias("query_id"), truth.alias("ground_truth"))
    names = table(spark, d, "chunks").select("id", "document_name")
    found = rows.join(items, "query_id").join(names, "id").withColumn("section_title", F.lit(None).cast("string")).withColumn("run_id", F.concat_ws("|", "mode", "query_id"))
    precision = metrics.run_metrics(found, ["mode"]).groupBy("mode").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("precision_at_5"), 6).alias("precision_at_5"))
    return found.groupBy("mode").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("document_name").alias("documents")).join(precision, "mode").select("mode", "rows", "queries", "documents", "precision_at_5")


_TITLES = f"""titles AS (SELECT DISTINCT section_title AS query_id FROM chunks WHERE section_title IS NOT NULL), qt AS (SELECT query_id, len({tokset('query_id')}) AS n, unnest({tokset('query_id')}) AS term FROM titles)"""


def _titles(spark, d) -> DataFrame:
    return table(spark, d, "chunks").where("section_title is not null").select(F.col("section_title").alias("query_id")).distinct().withColumn("text", F.col("query_id"))


@query(f"""WITH {_TITLES}, held AS (SELECT id, term, max(w) AS w FROM (SELECT id, unnest({tokset('section_title')}) AS term, 1.0::DOUBLE AS w FROM chunks UNION ALL SELECT id, unnest({tokset('document_name')}), 0.4 FROM chunks
  UNION ALL SELECT id, unnest({tokset('coalesce(normalized_text, original_text)')}), 0.2 FROM chunks) GROUP BY 1, 2),
m AS (SELECT query_id, id, round(sum(w) / max(n), 6) AS score FROM held JOIN qt USING (term) GROUP BY 1, 2 HAVING count(*) = max(n)) SELECT query_id AS section_title, id, score, rank::INT AS rank FROM {_top(10, 'm')}""")
def fts_weighted(spark, d):
    """Full-text search with weighted fields: section A, name B, content C; section titles as queries."""
    rows = spread_table(spark, d, "chunks", "id", "section_title", "document_name", "normalized_text", "original_text")
    rows = rows.select("id", F.col("section_title").alias("a"), F.col("document_name").alias("b"), F.coalesce("normalized_text", "original_text").alias("c"))
    return search.weighted_match(_titles(spark, d), rows, 10).withColumnRenamed("query_id", "section_title")


@query(f"""WITH {_TITLES}, langs AS (SELECT section_title AS query_id, max(language) AS lang FROM chunks WHERE section_title IS NOT NULL GROUP BY 1), held AS (SELECT id, language, unnest({tokset('original_text')}) AS term FROM chunks),
m AS (SELECT query_id, id, 0.0::DOUBLE AS similarity FROM held JOIN qt USING (term) JOIN langs USING (query_id) WHERE lang IS NULL OR lang = language GROUP BY query_id, id HAVING count(*) = max(n))
SELECT query_id AS section_title, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY id)::INT AS rank FROM m QUALIFY rank <= 5""")
def fts_fallback(spark, d):
    """Plain matching without a score, under a language filter, for every section title."""
    asked = table(spark, d, "chunks").where("section_title is not null").groupBy(F.col("section_title").alias("query_id")).agg(F.max("language").alias("language"))
    asked = asked.select("query_id", F.col("query_id").alias("text"), F.lit(None).cast("string").alias("document"), "language")
    rows = spread_table(spark, d, "chunks", "id", "original_text", "document_name", "language").withColumnRenamed("original_text", "text")
    return search.fallback(asked, rows, 5).select(F.col("query_id").alias("section_title"), "id", "similarity", "rank")


_ARABIC_ITEM = "len(regexp_extract_all(question, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}]')) / greatest(len(regexp_extract_all(question, '\\p{L}')), 1) >= 0.40"


@query(f"""WITH e AS (SELECT DISTINCT section_title AS term FROM chunks WHERE length(section_title) > 3), names AS (SELECT section_title AS term, min(document_name) AS expansion FROM chunks WHERE section_title IS NOT NULL GROUP BY 1),
hit AS (SELECT i.id, n.term, n.expansion FROM eval_items i JOIN (SELECT * FROM names JOIN e USING (term)) n ON contains(i.question, n.term)), t AS (SELECT trim(question) AS q, min(category) AS translation FROM eval_items WHERE difficulty = 'easy' GROUP BY 1),
first AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY term, expansion) <= 5), once AS (SELECT id, expansion, min(term) AS term FROM first GROUP BY 1, 2), added AS (SELECT id, string_agg(expansion, ' ' ORDER BY term) AS x FROM once GROUP BY 1)
SELECT i.id AS query_id, CASE WHEN NOT ({_ARABIC_ITEM}) THEN question WHEN translation IS NOT NULL THEN translation WHEN x IS NOT NULL THEN question || ' [' || x || ']' ELSE question END AS expanded
FROM eval_items i LEFT JOIN t ON t.q = trim(question) LEFT JOIN added USING (id)""")
def arabic_query_expansion(spark, d):
    """Arabic questions expanded from tables: the categories of easy items stand for translations,
    section titles and the documents they are in for entities."""
    chunks, items = table(spark, d, "chunks"), table(spark, d, "eval_items")
    entities = chunks.where("length(section_title) > 3").groupBy(F.col("section_title").alias("term")).agg(F.min("document_name").alias("expansion")).withColumn("ordinal", F.col("term"))
    known = items.where("difficulty = 'easy'").groupBy(F.trim("question").alias("text")).agg(F.min("category").alias("translation"))
    return search.expand_queries(_questions(spark, d), known, entities).select("query_id", "expanded")


@query(f"""WITH {HITS}, s AS (SELECT r.run_id, r.hit_id AS id, round(CASE WHEN len({tokset('h.query')}) > 0 AND len({tokset('h.original_text')}) > 0 THEN 2.0 * len(list_intersect({tokset('h.query')}, {tokset('h.original_text')})) / (len({tokset('h.query')}) + len({tokset('h.original_text')})) ELSE 0.0 END, 6) AS score
  FROM runs r JOIN hits h USING (hit_id) WHERE trim(h.original_text) <> '') SELECT run_id, id AS hit_id, score AS rerank_score, rank::INT AS rerank_rank FROM {_top(5, '(SELECT * FROM s WHERE score >= 0.1)', by='run_id')}""")
def rerank_threshold(spark, d):
    """Reranked hits under a least score."""
    rows = _hits(spark, d).join(runs(spark, d).select("hit_id", "run_id"), "hit_id").select("run_id", F.col("hit_id").alias("id"), "query", F.col("original_text").alias("content"))
    return fusion.rerank(rows, 5, threshold=0.1, by="run_id").select("run_id", F.col("id").alias("hit_id"), "rerank_score", "rerank_rank")


@query()
def mmr_select(spark, d):
    """Diversified order of the hits of every retrieval; sequential, tested against brute force."""
    text = first_chunks(spark, d, "original_text").select("chunk_id", F.col("original_text").alias("text"))
    rows = runs(spark, d).join(text, "chunk_id").select("run_id", F.col("hit_id").alias("id"), F.coalesce("rerank_score", "similarity", F.lit(0.0)).alias("relevance"), "text")
    return fusion.mmr(rows, 5, by="run_id").withColumnRenamed("id", "hit_id")


def _f1_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0.0 END"


@query(f"""WITH {HITS}, s AS (SELECT r.run_id, r.hit_id AS id, round({_f1_sql(tokset('h.query'), tokset('h.original_text'))}, 6) AS score FROM runs r JOIN hits h USING (hit_id) WHERE trim(h.original_text) <> '')
SELECT run_id, id AS hit_id, score AS rerank_score, rank::INT AS rerank_rank FROM {_top(5, 's', by='run_id')}""")
def rerank_token_f1(spark, d):
    rows = _hits(spark, d).join(runs(spark, d).select("hit_id", "run_id"), "hit_id").select("run_id", F.col("hit_id").alias("id"), "query", F.col("original_text").alias("content"))
    return fusion.rerank(rows, 5, by="run_id").select("run_id", F.col("id").alias("hit_id"), "rerank_score", "rerank_rank")


@query("SELECT id, document_name, language FROM chunks WHERE document_name = 'adult-pathway-2013' AND language = 'en'")
def document_language_filter(spark, d):
    """Independent optional filters; both are pushed to the scan."""
    return table(spark, d, "chunks").where((F.col("document_name") == "adult-pathway-2013") & (F.col("language") == "en")).select("id", "document_name", "language")


@query("""SELECT document_name, language, (grouping(document_name) = 0)::INT AS by_document, (grouping(language) = 0)::INT AS by_language, count(*) AS rows
FROM chunks GROUP BY GROUPING SETS ((document_name, language), (document_name), (language), ())""")
def document_language_counts(spark, d):
    """Rows that each choice of the two filters keeps, over the whole table: both, either one alone, none."""
    rows = table(spark, d, "chunks").groupingSets([["document_name", "language"], ["document_name"], ["language"], []], "document_name", "language")
    by = lambda c: (F.grouping(c) == 0).cast("int").alias(f"by_{c.split('_')[0]}")
    return rows.agg(by("document_name"), by("language"), F.count(F.lit(1)).alias("rows"))
