"""Round trips, records split anywhere, and magic lines inside payloads."""

import base64
import hashlib

from slipmill.llm import warc as W

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t in rows:
        t, f = t or "", first.get(t or "")
        again = f is not None and i != f
        out.append((i, len(t.encode()), digest(t), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


ROWS = [(5, "<p>é</p>"), (3, "<p>é</p>"), (None, "<p>é</p>"), (7, None), (8, ""), (9, FAKE), (10, FAKE * 3 + "tail"), (11, "WARC/1.1\r\nx"), (12, "a\r\n\r\nb\r\n"),
        (13, "x" * 50_000 + FAKE), (14, "HTTP/1.1 200 OK\r\n\r\nbody"), (3, "<p>é</p>"), (15, FAKE + "y" * 3000 + FAKE), (None, "alone"), (16, "\r\n"), (17, "日本" * 500)]


def pages(spark):
    return spark.createDataFrame([(i, f"http://x/{k} y\n", t, k) for k, (i, t) in enumerate(ROWS)], "page_id long, url string, html string, sha int")


def test_round_trip(spark):
    assert rows_of(W.round_trip(pages(spark))) == expected(ROWS)


def test_shuffled_digests(spark, monkeypatch):
    monkeypatch.setattr(W, "SMALL", -1)
    assert rows_of(W.round_trip(pages(spark))) == expected(ROWS)


def test_records_over_many_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        W.write(pages(spark).coalesce(1), str(tmp_path / "a"))
        records = W.read(spark, str(tmp_path / "a"))
        assert rows_of(W.resolved(records)) == expected(ROWS)
        assert spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_least(spark, tmp_path):
    W.write(pages(spark), str(tmp_path / "b"), least=20)
    small = [r for r in W.read(spark, str(tmp_path / "b")).collect() if r.record_type == "response" and r.payload_bytes == 9 + 1]
    assert len([r for r in small if r.payload_digest == digest("<p>é</p>")]) == 0
    assert sum(r.payload_digest == digest("<p>é</p>") for r in W.read(spark, str(tmp_path / "b")).collect()) == 4


def test_empty(spark):
    assert W.round_trip(pages(spark).limit(0)).collect() == []
