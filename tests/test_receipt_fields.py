"""Field extraction sees every rendered receipt."""

from slipmill import catalog
from slipmill.functions import patterns as P
from slipmill.plans import text_queries


def test_every_receipt_is_extracted(spark, monkeypatch):
    seen = []
    extract = text_queries.pipeline.text_documents
    monkeypatch.setattr(text_queries.pipeline, "text_documents", lambda docs, *a, **k: seen.append(docs.count()) or extract(docs, *a, **k))
    at = "/root/testdata/sf0.001"
    total = spark.read.parquet(f"{at}/orders.parquet").count()
    for name in ("vat_fields", "train_fields", "flight_fields", "receipt_fields"):
        out = catalog.QUERIES[name](spark, at)
    assert seen == [total] * 4
    assert {r.kind for r in out.select("kind").distinct().collect()} == {P.VAT, P.TRAIN, P.FLIGHT}
