"""SQL that gives the rows of the queries that SQL can express, by brute force over whole tables.

The consistent form is Unicode's rule once more, but applied by joins and aggregates: every
character meets the table of characters that change, and the text is put together and composed.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from . import textform as T


@cache
def _changing() -> str:
    """Rows (c, p): every character that becomes something else on its own, and what it becomes."""
    rows = []
    for ch in map(chr, range(0x110000)):
        if not 0xD800 <= ord(ch) <= 0xDFFF:
            to = unicodedata.normalize("NFC", "".join(T.plain(x) for x in unicodedata.normalize("NFKD", ch)))
            if to != ch:
                rows.append("(chr({}), {})".format(ord(ch), " || ".join(f"chr({ord(x)})" for x in to) or "''"))
    return ", ".join(rows)


def _forms(source: str, key: str, column: str) -> str:
    """``forms`` (key, form): the consistent form of a text column of a table with unique keys."""
    marks = f"[{T.ARABIC_MARKS}{T.TATWEEL}]+"
    points = f"regexp_extract_all({column}, '(?s).')"
    return f"""changing(c, p) AS (VALUES {_changing()}),
points AS (SELECT {key}, unnest({points}) AS c, generate_subscripts({points}, 1) AS i FROM {source} WHERE {column} IS NOT NULL),
composed AS (SELECT {key}, nfc_normalize(string_agg(coalesce(p, c), '' ORDER BY i)) AS t FROM points LEFT JOIN changing USING (c) GROUP BY {key}),
forms AS (SELECT {key}, trim(regexp_replace(translate(nfc_normalize(regexp_replace(t, '{marks}', '', 'g')), '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\\t-\\r\\x1c-\\x20]+', ' ', 'g')) AS form FROM composed)"""


def _words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def _runs(words: str, size: int) -> str:
    return f"unnest(list_transform(range(1, len({words}) - {size - 2}), lambda i: array_to_string(list_slice({words}, i, i + {size - 1}), ' ')))"


_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_COSINE = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"


_SPANS = """WITH w AS (SELECT doc_id, unnest(range(0, length(text) - 199)) AS i, text FROM documents WHERE length(text) >= 200), h AS (SELECT doc_id, i, md5(substring(text, i + 1, 200)) AS h FROM w),
shared AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)), s AS (SELECT doc_id, i FROM h JOIN shared USING (h)),
m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM m),
spans AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM g GROUP BY doc_id, g)"""


def oracle_sql() -> dict[str, str]:
    firsts = "firsts AS (SELECT chunk_id, original_text FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY id) = 1)"
    return {
        "p2_found": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM chunk_vectors WHERE {_USABLE}), s AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COSINE} AS cosine FROM v a, v b WHERE a.vec_id <> b.vec_id),
top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) <= 5) SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM top WHERE cosine >= 0.85""",
        "p3_found": f"""WITH {firsts}, {_forms('firsts', 'chunk_id', 'original_text')}, w AS (SELECT chunk_id, {_words('form')} AS w FROM forms), sh AS (SELECT DISTINCT chunk_id, {_runs('w', 3)} AS s FROM w),
n AS (SELECT chunk_id, count(*) AS n FROM sh GROUP BY 1 HAVING count(*) >= 10), kept AS (SELECT sh.*, n FROM sh JOIN n USING (chunk_id)),
pairs AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS total FROM kept a JOIN kept b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT chunk_a, chunk_b FROM pairs WHERE 2 * shared >= total - shared""",
        "p5_found": f"""WITH {firsts}, {_forms('firsts', 'chunk_id', 'original_text')}, t AS (SELECT chunk_id, original_text AS text, form FROM firsts JOIN forms USING (chunk_id) WHERE regexp_matches(original_text, '\\p{{L}}'))
SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b FROM t a JOIN t b ON a.form = b.form AND a.text <> b.text AND a.chunk_id < b.chunk_id""",
        "p7_found": f"""WITH items AS (SELECT id || '|q' AS k, id, question AS text FROM eval_items UNION ALL SELECT id || '|a', id, ground_truth_answer FROM eval_items),
both_ AS (SELECT 'i' || k AS k, text FROM items UNION ALL SELECT 'd' || doc_id, text FROM documents), {_forms('both_', 'k', 'text')}, w AS (SELECT k, {_words('form')} AS w FROM forms),
r AS (SELECT DISTINCT k, {_runs('w', 10)} AS s FROM w WHERE len(w) >= 10)
SELECT DISTINCT substring(d.k, 2)::BIGINT AS doc_id, i.id AS item_id FROM r d JOIN r x ON d.s = x.s JOIN items i ON x.k = 'i' || i.k WHERE d.k[1] = 'd' AND x.k[1] = 'i'""",
        "p5_forms": f"""WITH texts AS (SELECT 'o' || id AS k, original_text AS text FROM chunks UNION ALL SELECT 'n' || id, normalized_text FROM chunks), {_forms('texts', 'k', 'text')}
SELECT id, CASE WHEN original_text IS NOT NULL THEN coalesce(o.form, '') END AS original_form, CASE WHEN normalized_text IS NOT NULL THEN coalesce(n.form, '') END AS normalized_form
FROM chunks LEFT JOIN forms o ON o.k = 'o' || id LEFT JOIN forms n ON n.k = 'n' || id""",
        "p8_found": f"{_SPANS} SELECT doc_id, span_start, span_end FROM spans",
        "p8_coverage": f"""{_SPANS} SELECT doc_id, count(*) AS n_spans, sum(span_end - span_start)::BIGINT AS shared_chars, any_value(length(text)) AS n_chars, round(sum(span_end - span_start) / any_value(length(text)), 6) AS shared_share
FROM spans JOIN documents USING (doc_id) GROUP BY doc_id""",
    }
