"""Sliding windows against their SQL where sums, copies and missing times matter. The SQL runs in one
thread: with more it adds up in changing orders, and differs from itself."""

import pytest

from sparkloom.plans import catalogue


def _differ(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("set threads = 1")
    c.sql(f"create view events as select * from '{folder}/events.parquet'")
    want = c.execute(catalogue.oracle_sql()["usage_sliding"]).fetchall()
    got = [tuple(r) for r in catalogue.queries()["usage_sliding"](spark, str(folder)).collect()]
    assert len(got) == len(want)
    return set(got) ^ set(want)


def test_means_at_a_half(spark):
    assert not _differ(spark, "/root/testdata/sf0.01")


def test_copies_and_missing_times(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [f"({i}, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {minute} MINUTE, {value}::DOUBLE)" for i in range(200) for minute, value in ((i * 7 + 90, 1000 + i), (i * 7, i / 8))]
    rows += ["(900, NULL, 5.0)", "(901, NULL, NULL)", "(902, TIMESTAMP '1969-12-31 23:59:59.999999', NULL)", "(903, TIMESTAMP '2030-01-01 00:00:00', 1e306)", "(904, NULL, 2.0)", "(904, TIMESTAMP '2031-01-01 00:15:00', 3.0)"]
    duckdb.sql(f"copy (select * from (values {', '.join(rows)}) t(event_id, ts, value) order by hash(event_id, value)) to '{tmp_path}/events.parquet'")
    assert not _differ(spark, tmp_path)
