"""Scalar text functions over whole tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import index
from .base import FIRST_CHUNKS, JUDGED, RUNS, first_chunks, judged, query, runs, sentences, spread_table, squeeze, strip, table, tok, tokset

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def _re2(ranges: list[str]) -> str:
    return "[" + "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in ranges) + "]"


def _latin(x: str) -> str:
    return f"trim(regexp_replace({squeeze(x)}, '{CONTROL}', '', 'g'))"


def _arabic(x: str) -> str:
    x = rf"regexp_replace({x}, '\x{{0640}}|{_re2(L.TASHKEEL)}', '', 'g')"
    x = f"translate({x}, '{L.ARABIC_FROM}', '{L.ARABIC_TO}')"
    return squeeze(rf"regexp_replace({x}, '[\x{{00A0}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', ' ', 'g')")


def _language(x: str) -> str:
    letters, arabic = rf"len(regexp_extract_all({x}, '\p{{L}}'))", f"len(regexp_extract_all({x}, '{_re2(L.ARABIC_BLOCKS)}'))"
    return f"CASE WHEN {x} IS NULL OR {letters} = 0 THEN 'unknown' WHEN {arabic} / {letters} >= 0.40 THEN 'ar' WHEN {arabic} / {letters} <= 0.05 THEN 'en' ELSE 'mixed' END"


@query(f"SELECT doc_id, {_latin('text')} AS normalized FROM documents")
def normalize_english(spark, d):
    return spread_table(spark, d, "documents", "doc_id", "text").select("doc_id", T.normalize_latin(F.col("text")).alias("normalized"))


@query(f"SELECT id, {_arabic('original_text')} AS normalized FROM chunks")
def normalize_arabic(spark, d):
    return spread_table(spark, d, "chunks", "id", "original_text").select("id", T.normalize_arabic(F.col("original_text")).alias("normalized"))


@query(f"SELECT id, CASE WHEN {_language('original_text')} IN ('ar', 'mixed') THEN {_arabic('original_text')} ELSE {_latin('original_text')} END AS normalized FROM chunks")
def normalize_by_language(spark, d):
    return spread_table(spark, d, "chunks", "id", "original_text").select("id", T.normalize(F.col("original_text")).alias("normalized"))


def _compatible() -> str:
    """Rows (c, p): every character whose compatibility form differs, and that form, by Unicode's rule.
    Composing what a text becomes character by character is its compatibility composition."""
    form = lambda kind, ch: unicodedata.normalize(kind, ch)
    every = (ch for ch in map(chr, range(0x110000)) if not 0xD800 <= ord(ch) <= 0xDFFF and form("NFKC", ch) != form("NFC", ch))
    return ", ".join("('{}', '{}')".format(ch, form("NFKC", ch).replace("'", "''")) for ch in every)


def _composed(source: str, key: str, column: str) -> str:
    """``composed`` (key, t): the texts of a table in compatibility composition."""
    return f"""compat(c, p) AS (VALUES {_compatible()}), ch AS (SELECT {key}, unnest(regexp_extract_all({column}, '(?s).')) AS c, generate_subscripts(regexp_extract_all({column}, '(?s).'), 1) AS i FROM {source}),
composed AS (SELECT {key}, nfc_normalize(string_agg(coalesce(p, c), '' ORDER BY i)) AS t FROM ch LEFT JOIN compat USING (c) GROUP BY {key}),
texts AS (SELECT {key}, CASE WHEN {column} = '' THEN '' ELSE t END AS t FROM {source} LEFT JOIN composed USING ({key}))"""


@query(f"WITH {_composed('chunks', 'id', 'original_text')} SELECT id, CASE WHEN {_language('original_text')} IN ('ar', 'mixed') THEN {_arabic('t')} ELSE {_latin('t')} END AS normalized FROM texts JOIN chunks USING (id)")
def normalize_composed(spark, d):
    """With compatibility composition, as the reference always does."""
    return spread_table(spark, d, "chunks", "id", "original_text").select("id", T.normalize(F.col("original_text"), compose=True).alias("normalized"))


@query(f"WITH {_composed('documents', 'doc_id', 'text')} SELECT doc_id, {_latin('t')} AS english, {_arabic('t')} AS arabic FROM texts")
def pipelines_composed(spark, d):
    """The whole English and Arabic pipelines, composition first."""
    text = F.col("text")
    return spread_table(spark, d, "documents", "doc_id", "text").select("doc_id", T.normalize_latin(text, True).alias("english"), T.normalize_arabic(text, True).alias("arabic"))


_LEGACY = rf"translate(regexp_replace(t, '\x{{0640}}|{_re2([*L.MORE_TASHKEEL, *L.TASHKEEL])}', '', 'g'), '{L.LEGACY_FROM}', '{L.LEGACY_TO}')"


@query(f"WITH {_composed('chunks', 'id', 'original_text')} SELECT id, {squeeze(_LEGACY)} AS normalized FROM texts")
def legacy_arabic(spark, d):
    return spread_table(spark, d, "chunks", "id", "original_text").select("id", T.legacy_arabic(F.col("original_text")).alias("normalized"))


@query(f"SELECT id, {squeeze('x')} AS normalized FROM (SELECT id, translate({_arabic('original_text')}, 'ة', 'ه') AS x FROM chunks)")
def normalize_ta_marbuta(spark, d):
    return spread_table(spark, d, "chunks", "id", "original_text").select("id", T.normalize_arabic(F.col("original_text"), ta_marbuta=True).alias("normalized"))


_HAS = lambda terms: " OR ".join(f"contains(lower(coalesce(document_name, '')), '{t}')" for t in terms)


@query(f"SELECT CASE WHEN {_HAS(L.OFFICIAL)} THEN 'official' WHEN {_HAS(L.PEER_REVIEWED)} THEN 'peer-reviewed' ELSE 'toolkit' END AS badge, count(*) AS chunks, count(DISTINCT document_name) AS documents FROM chunks GROUP BY 1")
def authority_badges(spark, d):
    rows = table(spark, d, "chunks").groupBy(T.authority_badge(F.col("document_name")).alias("badge"))
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("document_name").alias("documents"))


@query(rf"SELECT doc_id, trim(regexp_replace({squeeze('text')}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{ff}}]', '', 'g')) AS cleaned FROM documents")
def legacy_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_latin1(F.col("text")).alias("cleaned"))


@query(f"SELECT id, {_language('original_text')} AS detected FROM chunks")
def detect_language(spark, d):
    return spread_table(spark, d, "chunks", "id", "original_text").select("id", T.detect_language(F.col("original_text")).alias("detected"))


@query(f"SELECT {_language('original_text')} AS detected, count(*) AS chunks FROM chunks GROUP BY 1")
def language_histogram(spark, d):
    return spread_table(spark, d, "chunks", "original_text").groupBy(T.detect_language(F.col("original_text")).alias("detected")).agg(F.count(F.lit(1)).alias("chunks"))


@query(f"SELECT doc_id, CASE WHEN {_language('title')} = 'ar' THEN 'searchify: ' ELSE 'Represent this sentence for searching relevant passages: ' END || title AS prefixed FROM documents")
def query_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", T.query_prefix(F.col("title"), T.detect_language(F.col("title"))).alias("prefixed"))


@query(f"SELECT id, len({tok('original_text')}) AS tokens, len({tokset('original_text')}) AS distinct_tokens FROM chunks")
def tokenize_terms(spark, d):
    t = T.tokens(F.col("original_text"))
    return table(spark, d, "chunks").select("id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


@query(f"SELECT term, count(DISTINCT id) AS document_frequency, count(*) AS collection_frequency FROM (SELECT id, unnest({tok('original_text')}) AS term FROM chunks) GROUP BY term")
def term_frequency(spark, d):
    return index.term_statistics(spread_table(spark, d, "chunks", "id", "original_text"), "id", "original_text")


def _posted(column: str, weight: str) -> str:
    return f"SELECT id, '{weight}' AS weight, unnest({tok(column)}) AS term, generate_subscripts({tok(column)}, 1) - 1 AS position FROM chunks"


@query(f"""SELECT id, weight, term, count(*) AS tf, min(position)::INT AS first_position FROM ({_posted('section_title', 'A')}
  UNION ALL {_posted('document_name', 'B')} UNION ALL {_posted('coalesce(normalized_text, original_text)', 'C')}) GROUP BY id, weight, term""")
def inverted_index_postings(spark, d):
    rows = spread_table(spark, d, "chunks", "id", "section_title", "document_name", "normalized_text", "original_text").select("id", "section_title", "document_name", F.coalesce("normalized_text", "original_text").alias("content"))
    return index.postings(rows, "id", [("section_title", "A"), ("document_name", "B"), ("content", "C")])


def _acronyms(x: str) -> str:
    for a, b in L.ACRONYMS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"SELECT doc_id, {_acronyms('text')} AS expanded FROM documents")
def acronym_expansion(spark, d):
    return table(spark, d, "documents").select("doc_id", T.expand_acronyms(F.col("text")).alias("expanded"))


_BAGS = ", ".join(f"CASE WHEN contains(lower(text), '{p}') THEN {s.split()!r} ELSE []::VARCHAR[] END" for p, s in L.SYNONYMS)


@query(f"SELECT doc_id, list_aggregate(list_sort(list_distinct(flatten([{tok('text')}, {_BAGS}]))), 'string_agg', ' ') AS expanded FROM documents WHERE text IS NOT NULL AND len(list_distinct(flatten([{tok('text')}, {_BAGS}]))) > 0")
def synonym_expansion(spark, d):
    terms = T.expand_synonyms(F.col("text"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", terms.alias("t")).where(F.size("t") > 0)
    return rows.select("doc_id", F.array_join(F.array_sort("t"), " ").alias("expanded"))


@query(f"SELECT doc_id, unnest({sentences('text')}) AS sentence, generate_subscripts({sentences('text')}, 1)::INT - 1 AS position FROM documents WHERE text IS NOT NULL")
def sentence_split(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


def _f1(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0.0 END"


@query(f"WITH {FIRST_CHUNKS}, {JUDGED} SELECT hit_id, round({_f1(tokset('query'), tokset('c.original_text'))}, 6) AS f1 FROM judged JOIN first_chunks c USING (chunk_id)")
def token_f1_pairs(spark, d):
    text = first_chunks(spark, d, "original_text").select("chunk_id", T.token_set(F.col("original_text")).alias("b"))
    rows = judged(spark, d).select("hit_id", "chunk_id", T.token_set(F.col("query")).alias("a")).join(text, "chunk_id")
    return rows.select("hit_id", F.round(T.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query(f"""WITH {FIRST_CHUNKS}, {RUNS}, w AS (SELECT run_id, rank, list_filter(list_distinct(string_split(trim(regexp_replace(lower(original_text), '[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]+', ' ', 'g')), ' ')), lambda x: x <> '') AS s
  FROM runs JOIN first_chunks USING (chunk_id))
SELECT a.run_id, a.rank AS rank_a, b.rank AS rank_b, round(CASE WHEN len(a.s) > 0 AND len(b.s) > 0 THEN len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) ELSE 0.0 END, 6) AS jaccard
FROM w a JOIN w b ON a.run_id = b.run_id AND a.rank < b.rank""")
def jaccard_pairs(spark, d):
    """Pairs of hits within one retrieval (at most 10 hits each)."""
    text = first_chunks(spark, d, "original_text").select("chunk_id", T.blank_set(F.col("original_text")).alias("s"))
    w = runs(spark, d).select("run_id", "rank", "chunk_id").join(text, "chunk_id")
    a, b = w.select("run_id", F.col("rank").alias("rank_a"), F.col("s").alias("x")), w.select("run_id", F.col("rank").alias("rank_b"), F.col("s").alias("y"))
    return a.join(b, "run_id").where("rank_a < rank_b").select("run_id", "rank_a", "rank_b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


_SANE = "text"
for _p in (r"!\[.*?\]\([^)]*\)", r"(?i)image\.png|image\.jpg|image\.jpeg|figure\.png|fig\.png", r"(?i)<img[^>]*>", r"(?i)ERROR:\s*Cannot read.*?Inform the user\.\s*"):
    _SANE = f"regexp_replace({_SANE}, '{_p}', '', 'g')"


@query("SELECT doc_id, " + strip(f"regexp_replace({strip(_SANE)}, '(?s)<think>.*?</think>', '', 'g')") + " AS clean FROM documents")
def sanitize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_thinking(T.sanitize_chunk(F.col("text"))).alias("clean"))


_ANSWER = "text"
for _p in (
    r'(?i)ERROR:\s*Cannot read ".*?"\s*\(.*?model does not support image input.*?\)[^\n]*',
    r"(?i)[^\n]*Cannot read[^\n]*image[^\n]*\n?", r"(?i)[^\n]*This model does not support image input[^\n]*\n?", r"(?i)Inform the user\.[^\n]*",
):
    _ANSWER = f"regexp_replace({_ANSWER}, '{_p}', '', 'g')"


@query("SELECT doc_id, " + strip(rf"regexp_replace({_ANSWER}, '\n{{3,}}', chr(10) || chr(10), 'g')") + " AS clean FROM documents")
def sanitize_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sanitize_answer(F.col("text")).alias("clean"))


@query(rf"SELECT id, {squeeze(r'''regexp_replace(regexp_replace(replace(document_name, '_', ' '), '\.(pdf|docx)', '', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')''')} AS display_name FROM chunks")
def pretty_names(spark, d):
    return table(spark, d, "chunks").select("id", T.pretty_name(F.col("document_name")).alias("display_name"))


@query("SELECT hit_id, CASE WHEN similarity >= 0.55 THEN 'high' WHEN similarity >= 0.40 THEN 'medium' ELSE 'low' END AS score_class FROM retrieved_hits")
def score_classes(spark, d):
    return table(spark, d, "retrieved_hits").select("hit_id", T.score_class(F.col("similarity")).alias("score_class"))
