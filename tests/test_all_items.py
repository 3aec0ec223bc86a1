"""Evaluation items without hits are counted too."""

from sparkloom.plans import catalogue


def test_items_without_hits(spark, data):
    q = catalogue.queries()
    items = {r["id"]: bool(r["ground_truth_sources"]) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()}
    logged = {r[0] for r in spark.read.parquet(f"{data}/retrieved_hits.parquet").select("query_id").collect()}
    rows = q["failure_mode_all_items"](spark, data).collect()
    assert {r["query_id"] for r in rows} == set(items)
    none = {r["query_id"] for r in rows if r["failure_mode"] == "NO_RESULTS"}
    assert none and none == {i for i, truth in items.items() if truth and i not in logged}
    report = {r["slice"]: r["runs"] for r in q["eval_report_all_items"](spark, data).collect() if r["level"] == "overall"}
    assert report["all"] == q["precision_at_k"](spark, data).count() + len(set(items) - logged)
