"""Every registered query runs on the smallest tables; the found queries hold against brute force."""

import numpy as np
import pytest

from sparkloom.llm import queries as Q
from sparkloom.llm.textform import consistent_form

COLUMNS = {
    "p2_found": ["vec_a", "vec_b"], "p3_found": ["chunk_a", "chunk_b"], "p4_found": ["id", "language"], "p5_found": ["chunk_a", "chunk_b"],
    "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "span_start", "span_end"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs(spark, data, name):
    df = Q.queries()[name](spark, data)
    assert df.count() > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()


def test_similar_pairs(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/chunk_vectors.parquet").collect()]
    rows = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and len(v) == 64 and np.isfinite(np.array(v, float)).all() and any(v)]
    ids = np.array([i for i, _ in rows])
    u = np.array([v / np.linalg.norm(v) for _, v in rows])
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = set()
    for a in range(len(ids)):
        for b in sorted(range(len(ids)), key=lambda b: (-s[a, b], ids[b]))[:5]:
            if s[a, b] >= 0.85:
                want.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
    assert {tuple(r) for r in Q.p2_found(spark, data).collect()} == want


def test_look_alikes(spark, data):
    by = {}
    for r in spark.read.parquet(f"{data}/chunks.parquet").select("chunk_id", "original_text").collect():
        if any(c.isalpha() for c in r[1] or ""):
            by.setdefault(consistent_form(r[1]), set()).add(tuple(r))
    want = {(min(a, b), max(a, b)) for v in by.values() for a, t in v for b, u in v if a != b and t != u}
    assert {tuple(r) for r in Q.p5_found(spark, data).collect()} == want


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_brute_force_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("chunks", "chunk_vectors", "documents", "eval_items"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    r = c.execute(Q.oracle_sql()[name])
    names, want = [x[0] for x in r.description], sorted(r.fetchall())
    assert want and sorted(tuple(x[n] for n in names) for x in Q.queries()[name](spark, data).collect()) == want
