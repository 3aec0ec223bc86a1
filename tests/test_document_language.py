"""The document and language filters, each alone and both, cover the whole table."""

from sparkloom.plans import catalogue


def test_filters_cover_the_table(spark, data):
    total = spark.read.parquet(f"{data}/chunks.parquet").count()
    kept = {}
    for r in catalogue.queries()["document_language_counts"](spark, data).collect():
        key = (r["by_document"], r["by_language"])
        kept[key] = kept.get(key, 0) + r["rows"]
    assert kept == {(a, b): total for a in (0, 1) for b in (0, 1)}
