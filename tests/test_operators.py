import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import models
from sparkloom.functions import vectors as V
from sparkloom.operators import agents, bounds, cite, fusion, guard, layout, metrics, search
from sparkloom.plans import search_queries
from sparkloom.sources import tables as S


def hits(spark, docs, truth, sections=None, run=1):
    rows = [(run, i + 1, d, (sections or ["s"] * len(docs))[i], truth) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "run_id int, rank int, document_name string, section_title string, ground_truth array<string>")


@pytest.mark.parametrize("docs, truth, want", [(["a", "a1", "xa"], ["a"], 1.0), (["b", "c"], ["z"], 0.0), (["a", "b", "c"], ["a"], round(1 / 3, 6)), (["a"], [], 0.0), (["", None, "q"], ["a"], 0.0)])
def test_precision_at_3(spark, docs, truth, want):
    assert metrics.run_metrics(hits(spark, docs, truth)).first()["precision_at_3"] == want


def test_other_metrics(spark):
    r = metrics.run_metrics(hits(spark, ["doc a", "x", "doc a", "doc b"], ["doc a", "doc b", "doc c"])).first()
    assert (r["recall_at_10"], r["hit_ratio_at_10"], r["citation_coverage"]) == (0.666667, 1.0, 0.666667)
    ideal = sum(1 / math.log2(i + 2) for i in range(3))
    assert r["ndcg_at_5"] == round((1 + 1 / math.log2(4) + 1 / math.log2(5)) / ideal, 6)


@pytest.mark.parametrize(
    "docs, truth, want",
    [(["d"] * 4 + ["e"], ["z"], "DUPLICATE_CHUNKS"), (["a", "b", "c"], ["z"], "MISSING_SOURCE"), (["a", "b", "c", "d", "e"], ["a"], "WRONG_TOPIC_SECTION"), (["a", "a", "b"], ["a"], None), (["a"], [], None)],
)
def test_failure_modes(spark, docs, truth, want):
    assert metrics.failure_modes(hits(spark, docs, truth)).first()["failure_mode"] == want


def test_empty_runs_are_no_results(spark):
    q = spark.createDataFrame([("a",), ("b",)], "query_id string")
    assert [r["query_id"] for r in metrics.empty_runs(q, q.where("query_id = 'a'")).collect()] == ["b"]


def test_dedup_windows_equal_the_greedy_pass(spark):
    rng = random.Random(1)
    rows = [(q, i, f"d{rng.randint(0, 3)}", f"s{rng.randint(0, 2)}") for q in range(60) for i in range(1, rng.randint(2, 15))]
    df = spark.createDataFrame(rows, "query_id int, rank int, document_name string, section_title string")
    for most in (1, 2, 3):
        got = {(r["query_id"], r["rank"]) for r in fusion.deduplicate(df, 5, most).collect()}
        want = set()
        for q in range(60):
            n, seen, taken = {}, set(), 0
            for _, i, d, s in sorted(r for r in rows if r[0] == q):
                if (d, s) in seen or n.get(d, 0) >= most or taken >= 5:
                    continue
                seen.add((d, s))
                n[d] = n.get(d, 0) + 1
                taken += 1
                want.add((q, i))
        assert got == want


def test_fuse_is_symmetric_and_fills_missing_ranks(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, id int, rank int")
    one = {r["id"]: r["score"] for r in fusion.fuse(a, b, fusion.DEMO, 1).collect()}
    two = {r["id"]: r["score"] for r in fusion.fuse(b, a, fusion.DEMO, 1).collect()}
    assert one == pytest.approx(two)
    assert one[10] == pytest.approx(1 / 31 + 1 / 39)
    server = {r["id"]: r["score"] for r in fusion.fuse(a, b, fusion.SERVER, 1).collect()}
    assert server[10] == pytest.approx(1 / 61)


def test_mmr_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.random(), " ".join(rng.choice("abcdefgh") for _ in range(5))) for i in range(12)] + [(2, 1, None, None), (2, 2, 0.5, "")]
    got = {(r["query_id"], r["position"]): r["id"] for r in fusion.mmr(spark.createDataFrame(rows, "query_id int, id int, relevance double, text string"), 5).collect()}

    def jac(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b)

    left, taken = [r for r in rows if r[0] == 1], []
    while len(taken) < 5:
        best = max(left, key=lambda r: (0.85 * r[2] - 0.15 * max((jac(r[3], t[3]) for t in taken), default=0), -r[1]))
        taken.append(best)
        left.remove(best)
    assert [got[1, i + 1] for i in range(5)] == [t[1] for t in taken]
    assert [got[2, 1], got[2, 2]] == [2, 1]


def test_rerank_drops_blank_and_orders(spark):
    rows = [(1, i, "a b", " ".join(["a", "b", "c", "d"][: i + 1])) for i in range(4)] + [(1, 9, "a b", "  ")]
    got = fusion.rerank(spark.createDataFrame(rows, "query_id int, id int, query string, content string"), 3).orderBy("rerank_rank").collect()
    assert len(got) == 3 and got[0]["id"] == 1
    assert [r["rerank_score"] for r in got] == sorted((r["rerank_score"] for r in got), reverse=True)


def test_boosts(spark):
    df = spark.createDataFrame([("early screening for autism", "Screening and early signs", "early screening autism x")], "q string, s string, c string")
    r = df.select(
        fusion.section_overlap(fusion.own_words(F.col("q"), fusion.SERVER.stop_words), F.col("s"), fusion.SERVER).alias("a"), fusion.section_keywords(F.col("s")).alias("b"), fusion.content_overlap(fusion.own_words(F.col("q"), ["for"]), F.col("c")).alias("c"),
        fusion.phrase_boost(fusion.phrase_mask(F.col("q")), fusion.phrase_mask(F.col("c"))).alias("d"), fusion.section_overlap(fusion.own_words(F.col("q"), fusion.SERVER.stop_words), F.lit(None).cast("string"), fusion.SERVER).alias("e"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (1.35, 1.2, 1.15, 1.3, 1.0)


def test_vector_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[7] = m[8]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    asked = df.where("id < 20 or id >= 900").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in search.vector_topk(asked, df, 5, 8).collect()}
    grid = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in search.vector_topk(asked, df, 5, 8, block=7, cell=50).collect()}
    assert grid == got
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(20):
        s = np.round(u @ u[q], 6)
        want = sorted(range(300), key=lambda i: (-s[i], i))[:5]
        assert [got[q, r + 1][0] for r in range(5)] == want
    assert not any(q >= 900 for q, _ in got)


def test_lexical_search_is_the_same_when_terms_are_too_many_to_broadcast(spark, monkeypatch):
    q = spark.createDataFrame([(1, "red fox"), (2, "a red hen"), (3, ""), (4, None)], "query_id int, text string")
    rows = spark.createDataFrame([(1, "Red fox and red hen"), (2, "hen"), (3, None), (4, "a fox a"), (5, "")], "id int, text string")
    every = lambda: [sorted(map(tuple, f(q, rows, 3).collect())) for f in (search.coverage, search.bm25, search.cover_density)] + [sorted(map(tuple, f(q, rows).collect())) for f in (search.match_all, search.expanded_coverage)]
    few = every()
    monkeypatch.setattr(bounds, "SMALL", 0)
    monkeypatch.setattr(search.batch, "stated_terms", lambda *a, **k: None)
    assert every() == few and all(few)
    assert search.bm25(q, rows.where("id < 0"), 3).count() == 0


def test_document_ndcg_is_at_most_one(spark):
    assert metrics.document_ndcg(hits(spark, ["a", "a", "a"], ["a"])).first()["ndcg"] == 1.0
    assert metrics.document_ndcg(hits(spark, ["x", "a", "b", "a"], ["a", "b", "c"])).first()["ndcg"] == round((1 / math.log2(3) + 0.5) / sum(1 / math.log2(i + 2) for i in range(3)), 6)
    assert metrics.document_ndcg(hits(spark, ["x"], [])).first()["ndcg"] == 0.0
    assert metrics.document_ndcg(hits(spark, ["", None], ["a"])).first()["ndcg"] == 0.0


def test_vector_topk_without_queries_or_rows(spark):
    none = spark.createDataFrame([], "id long, v array<float>")
    assert search.vector_topk(none.withColumnRenamed("id", "query_id"), none, 5, 8).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<float>")
    assert search.vector_topk(one, none, 5, 2).count() == 0


def test_vector_functions(spark):
    r = spark.createDataFrame([([3.0, 4.0],)], "v array<float>").select(V.norm(F.col("v")), V.l2_normalize(F.col("v")), V.fit(F.col("v"), 3), V.fit(F.col("v"), 1), V.cosine(F.col("v"), F.col("v"))).first()
    assert list(r) == [5.0, [0.6, 0.8], [3.0, 4.0, 0.0], [3.0], 1.0]


def test_cover_density_against_brute_force(spark):
    texts = [(1, "a x b y a b"), (2, "a a a"), (3, "b a"), (4, None), (5, "")]
    q = spark.createDataFrame([("q", "a b")], "query_id string, text string")
    got = {r["id"]: r["score"] for r in search.cover_density(q, spark.createDataFrame(texts, "id int, text string"), 10).collect()}

    def brute(words):
        spans = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if {"a", "b"} <= set(words[i : j + 1])]
        least = [s for s in spans if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in spans)]
        return sum(2 / max(2, j - i + 1) for i, j in least)

    assert got == {i: pytest.approx(brute(t.split()), abs=1e-6) for i, t in texts if t and {"a", "b"} <= set(t.split())}


def test_chunker_keeps_all_text_and_bounds(spark):
    rng = random.Random(5)
    rows = [(d, 1 + b // 4, b, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([3, 12, 40, 90]))), f"s{b // 5}") for d in range(6) for b in range(20)]
    df = spark.createDataFrame(rows, "doc int, page int, block_no int, text string, section string")
    got = layout.chunks(df, 20, 50, 0).collect()
    for d in range(6):
        mine = [r["text"] for r in sorted((r for r in got if r["doc"] == d), key=lambda r: r["chunk_no"])]
        assert " ".join(mine).split() == " ".join(r[3] for r in rows if r[0] == d).split()
        assert all(layout.count_words(t) <= 50 for t in mine)


def test_layout_headers_sections_and_margins(spark):
    span = "doc string, page int, block_no int, line_no int, span_no int, y0 double, y1 double, page_height double, font string, size double, text string"
    body = "this is body text of some length"
    rows = [
        ("d", 1, 0, 0, 0, 5.0, 20.0, 800.0, "F", 10.0, "running head"), ("d", 1, 1, 0, 0, 100.0, 120.0, 800.0, "F", 10.0, body), ("d", 1, 2, 0, 0, 130.0, 150.0, 800.0, "F", 16.0, "Big title"),
        ("d", 1, 3, 0, 0, 160.0, 180.0, 800.0, "F", 10.0, body), ("d", 2, 4, 0, 0, 100.0, 120.0, 800.0, "F-Bold", 10.0, "Bold title"), ("d", 2, 5, 0, 0, 130.0, 150.0, 800.0, "F", 10.0, "CAPITALS"), ("d", 2, 6, 0, 0, 160.0, 180.0, 800.0, "F", 10.0, body),
    ]
    got = [(r["block_no"], r["section"]) for r in layout.blocks(spark.createDataFrame(rows, span)).orderBy("page", "block_no").collect()]
    assert got == [(1, "General Overview"), (2, "Big title"), (3, "Big title"), (4, "Bold title"), (5, "CAPITALS"), (6, "CAPITALS")]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "Waiting times are too long here. [SOURCE: Doc A, p 1] Second sentence of the answer 【Source 1】 【Source 9】 [SOURCE broken]"), (2, "")], "run_id int, answer string")
    rows = spark.createDataFrame([(1, 1, "doc a", "sec", "1", "waiting times are too long here"), (2, 1, "d", "s", "2", None)], "run_id int, rank int, document_name string, section_title string, page_number string, content string")
    r = {x["run_id"]: x for x in cite.verify(answers, rows).collect()}
    assert (r[1]["total_citations"], r[1]["valid_citations"], r[1]["malformed_citations"]) == (3, 2, 1)
    assert (r[2]["total_citations"], r[2]["citation_accuracy"], r[2]["faithfulness"]) == (0, 1.0, 1.0)
    said = spark.createDataFrame([(1, "Waiting times are too long here. Bananas grow wherever yellow sunshine exists.")], "run_id int, answer string")
    assert [x["claim"] for x in cite.unsupported_claims(said, rows).collect()] == ["Bananas grow wherever yellow sunshine exists."]
    assert cite.inject_citations(said, rows).first()["answer"].startswith("Waiting times are too long here. [SOURCE: doc a, sec, page 1] Bananas")


def test_guards(spark):
    r = spark.createDataFrame([(1, 8.0), (1, 7.0), (1, 3.0), (2, 9.0)], "run_id int, score double")
    assert {x["run_id"]: x["verdict"] for x in guard.critic(r).collect()} == {1: "SUFFICIENT", 2: "INSUFFICIENT"}
    raw = ['{"scope_level": "allowed"}', '<think>{"scope_level": "REFUSE"}</think> {"scope_level": "NEEDS_CAUTION"}', '{"scope_level": "MAYBE"}', "{}", "no json", None]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, j string").select("i", guard.parsed_scope(F.col("j"))).collect()
    assert [x[1] for x in sorted(p)] == ["ALLOWED", "NEEDS_CAUTION", "REFUSE", "REFUSE", "REFUSE", "REFUSE"]
    raw = ['{"scores": [{"chunk_idx": 0, "score": 9}, {"chunk_idx": 1, "score": 6}]}', '{"scores": [{"chunk_idx": 0, "score": 9}]}', '{"scores": [{"chunk_idx": 0, "score": 11}, {"chunk_idx": 1, "score": 9}]}', '{"scores": []}', "{", None]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, j string").select("i", guard.critic_report(guard.parsed_scores(F.col("j"))).alias("r")).collect()
    assert [tuple(x["r"]) for x in sorted(p, key=lambda x: x["i"])] == [("SUFFICIENT", 7.5, 2), ("INSUFFICIENT", 9.0, 1), *[("INSUFFICIENT", 0.0, 0)] * 4]
    g = guard.similarity_gate(spark.createDataFrame([(1, 0.1), (1, None), (2, 0.9)], "run_id int, similarity double"))
    assert {x["run_id"]: x["verdict"] for x in g.collect()} == {1: "INSUFFICIENT", 2: "SUFFICIENT"}


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"a": {"title": "A", "url": "u", "authority_tier": 1}}))
    (tmp_path / "l.json").write_text(json.dumps([{"document_name": "b", "source_url": "v"}]))
    reg = S.read_registry(spark, str(tmp_path))
    assert {(r["document_name"], r["url"]) for r in reg.collect()} == {("a", "u"), ("b", "v")}
    chunks = spark.createDataFrame([("a.pdf", "", None), ("z", None, 2), (None, "k", 1)], "document_name string, source_url string, authority_tier int")
    got = {r["document_name"]: (r["source_url"], r["authority_tier"], r["updated"]) for r in S.backfill(chunks, reg).collect()}
    assert got == {"a.pdf": ("u", 1, True), "z": (None, 2, False), None: ("k", 1, False)}
    (tmp_path / "e").mkdir()
    (tmp_path / "e/x.json").write_text(json.dumps([{"id": "1", "category": "out_of_scope"}, {"id": "2", "category": "factual"}]))
    assert [r["id"] for r in S.read_eval_items(spark, str(tmp_path / "e"), "oos").collect()] == ["1"]


def test_binary_documents_skip_bad_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x y")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def parse(content):
        if content == b"bad":
            raise ValueError("bad")
        return [{"word": w} for w in content.decode().split()]

    rows = S.binary_documents(spark, str(tmp_path), parse, "word string").collect()
    assert sorted((r["status"], r["word"]) for r in rows if r["word"]) == [("ok", "x"), ("ok", "y")]
    assert sum(r["status"].startswith("ValueError") for r in rows) == 1


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    new = spark.createDataFrame([("b", 3), ("b", 5), ("c", 4)], "k string, n int")
    once = S.upsert(old, new, "k", "n")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 5), ("c", 4)] == sorted(map(tuple, S.upsert(once, new, "k", "n").collect()))


def test_models(spark):
    v = spark.createDataFrame([("a b",), ("",), (None,)], "x string").select(models.embed(F.col("x")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-6 and not any(v[1]["v"]) and not any(v[2]["v"])



def test_agents(spark):
    """Pluggable clients: a failing one is passed over, what does not parse fails closed."""
    def broken(*columns):
        raise OSError

    said = agents.first_answer(broken, lambda texts: texts.map(lambda t: '{"scope_level": "allowed"}' if t == "a" else ""), lambda texts: texts + " is no JSON")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, text string").withColumn("scope", F.lit("clash"))
    assert {r["id"]: r["level"] for r in agents.with_scope(rows, "text", said, "level").collect()} == {1: "ALLOWED", 2: "REFUSE", 3: "REFUSE"}
    assert {r["id"]: r["level"] for r in agents.with_scope(rows, "text", name="level").collect()} == {1: "ALLOWED", 2: "ALLOWED", 3: "REFUSE"}
    assert agents.with_scope(rows.limit(0), "text").count() == 0
    hits = spark.createDataFrame([(1, 1, "red fox", "red fox"), (1, 2, "red fox", "fox red"), (1, 3, "red fox", None), (2, 1, "x", ""), (3, 1, None, "x")], "run_id int, rank int, query string, content string")
    got = {r["run_id"]: (r["verdict"], r["mean_relevance"], r["relevant_count"]) for r in agents.evaluate(hits).collect()}
    assert got == {1: ("SUFFICIENT", 6.666667, 2), 2: ("INSUFFICIENT", 0.0, 0), 3: ("INSUFFICIENT", 0.0, 0)}
    assert all(r["verdict"] == "INSUFFICIENT" for r in agents.evaluate(hits, lambda q, c: q.map(lambda x: "?")).collect())
    told = agents.generate(hits, lambda queries, contexts: queries + ": " + contexts)
    assert {r["run_id"]: r["answer"] for r in told.collect()}[2] == "x: [EVIDENCE 1] "
    assert agents.generate(hits).where("run_id = 1").first()["answer"] == "red fox 【Source 1】 fox red 【Source 2】"


def test_rerank_by_a_client(spark):
    rows = spark.createDataFrame([(1, 10, 1, "q", "aa", 0.3), (1, 11, 2, "q", "a", 0.2), (1, 12, 3, "q", " ", 0.9), (2, 13, 1, "q", "fail", 0.1), (2, 14, 2, "q", "aaaa", None)], "query_id int, id int, rank int, query string, content string, similarity double")
    lengths = lambda q, c: c.map(lambda x: None if x == "fail" else -float(len(x)))
    got = [tuple(r) for r in fusion.rerank_by(rows, 5, lengths).select("query_id", "id", "rerank_score", "rerank_rank").orderBy("query_id", "rerank_rank").collect()]
    assert got == [(1, 11, -1.0, 1), (1, 10, -2.0, 2), (2, 13, 0.1, 1), (2, 14, 0.0, 2)]


def test_search_modes(spark, data):
    with pytest.raises(ValueError, match="unknown search mode"):
        search_queries.retrieve(spark, data, "fuzzy")
    assert search_queries.retrieve(spark, data, "bm25", 2).groupBy("query_id").count().agg(F.max("count")).first()[0] == 2


@pytest.mark.parametrize("small", [True, False])
def test_lexical_scores_in_batches_and_by_joins(spark, monkeypatch, small):
    """The two ways agree, with nulls, blanks, ties, empty tables and unknown words."""
    if not small:
        monkeypatch.setattr(search.batch, "stated_terms", lambda *a, **k: None)
    queries = spark.createDataFrame([("q1", "screening of red foxes"), ("q2", "zzz"), ("q3", None), ("q4", "red")], "query_id string, text string").withColumn("phrases", F.lit(3))
    rows = spark.createDataFrame([(i, t, n, s, p) for i, (t, n, s, p) in enumerate([("red foxes", "fox red", "", 1), ("red foxes", "", "of", 3), (None, "", "", 0), ("", "", "", 0), ("detection of birds", "", "", 0), ("red red red", "red", "red", 2)])], "id long, text string, name string, section string, phrases int")
    pick = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert pick(search.coverage(queries, rows, 2)) == [("q1", 1, 0, 0.5), ("q1", 2, 1, 0.5), ("q4", 1, 0, 1.0), ("q4", 2, 1, 1.0)]
    assert pick(search.profile(queries, rows, 2)) == [("q1", 1, 1, 0.92), ("q1", 2, 0, 0.845), ("q4", 1, 5, 1.885), ("q4", 2, 0, 1.69)]
    best = pick(search.bm25(queries, rows, 1))
    assert [x[:3] for x in best] == [("q1", 1, 0), ("q4", 1, 5)] and all(x[3] > 0 for x in best)
    assert search.coverage(queries, rows.limit(0), 2).count() == 0 and search.coverage(queries.limit(0), rows, 2).count() == 0 and search.bm25(queries, rows.limit(0), 2).count() == 0


def test_dimensions_over_the_bound_are_an_error(spark, monkeypatch):
    rules, asked = spark.createDataFrame([("a", "b")], "term string, pattern string"), spark.createDataFrame([("a x",)], "query string")
    rows = spark.createDataFrame([("a x", "doc b"), ("a x", None)], "query string, document_name string")
    assert sorted(r["rule_factor"] for r in fusion.rule_factors(rows, rules, 2.0, asked).collect()) == [1.0, 2.0]
    monkeypatch.setattr(bounds, "SMALL", 0)
    with pytest.raises(ValueError, match="rules"):
        fusion.rule_factors(rows, rules, 2.0, asked)


def test_blank_citations_bind_to_nothing(spark):
    said = spark.createDataFrame([(1, "x [SOURCE:  ] y [SOURCE: C-7] z [SOURCE: doc a, p. 3]")], "run_id int, answer string")
    hits = spark.createDataFrame([(1, 1, "Doc A", "s", "c-7")], "run_id int, rank int, document_name string, section_title string, chunk_id string")
    got = {r["citation"]: r["valid"] for r in cite.bind(cite.citations(said), hits).collect()}
    assert got == {"": False, "C-7": True, "doc a, p. 3": True} or got == {"C-7": True, "doc a, p. 3": True}


def test_answer_sections(spark):
    text = "📋 **Answer**\nUse it. 【Source 2】\n\n📚 **Supporting Evidence**\n【Source 2】 first part\n\n🎯 **Confidence**: high\n\n⚕️ Not a substitute for professional advice."
    rows = spark.createDataFrame([(text,), ("plain",), (None,)], "t string").select(cite.answer_sections(F.col("t")).alias("s")).collect()
    a, b, c = (r["s"] for r in rows)
    assert (a["answer"], a["confidence"], a["disclaimer"]) == ("Use it. 【Source 2】", "HIGH", "Not a substitute for professional advice.")
    assert [tuple(e) for e in a["evidence"]] == [(2, "📚 **Supporting Evidence**"), (2, "first part")]  # a mark without text takes what follows
    assert (b["answer"], b["confidence"], b["evidence"], b["disclaimer"]) == ("plain", "MEDIUM", [], "")
    assert c["answer"] is None and c["confidence"] == "MEDIUM"


def test_expand_queries(spark):
    q = spark.createDataFrame([(1, " فحص التوحد "), (2, "علاج الأعراض والأدوية"), (3, "English علاج"), (4, "كتاب"), (5, None)], "query_id int, text string")
    known = spark.createDataFrame([("فحص التوحد", "screening")], "text string, translation string")
    entities = spark.createDataFrame([(2, "الأعراض", "symptoms"), (1, "علاج", "treatment"), (3, "الأدوية", "treatment")], "ordinal int, term string, expansion string")
    got = {r["query_id"]: r["expanded"] for r in search.expand_queries(q, known, entities).collect()}
    assert got == {1: "screening", 2: "علاج الأعراض والأدوية [treatment symptoms]", 3: "English علاج", 4: "كتاب", 5: None}
