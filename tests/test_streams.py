"""A stream of texts and a stream of payloads that come early, late, too late, twice or never, against the batch result."""

import json

import pytest

from slipmill.plans import pipeline
from slipmill.streaming import documents as streams

TEXT, RAW = "发票代码：011002200111\n发票号码：{}", "01,10,011002200111,{},1.50,20240102,1"
NO = "0000000{}"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))


def text(k, at="2024-01-01 10:00:00"):
    return {"doc_id": f"d{k}", "text": TEXT.format(NO.format(k)), "at": at}


def payload(k, at, no=None):
    return {"doc_id": f"d{k}", "raw": RAW.format(NO.format(k if no is None else no)), "at": at}


@pytest.mark.parametrize("order", ["texts first", "payloads first"])
def test_payloads_early_late_repeated_and_missing(spark, tmp_path, order):
    texts, payloads, out = tmp_path / "texts", tmp_path / "payloads", str(tmp_path / "out")
    first = [text(k) for k in (1, 2, 3, 4, 6)] + [{"doc_id": "d5", "text": " ", "at": "2024-01-01 10:00:00"}]
    second = [payload(1, "2024-01-01 09:30:00"), payload(2, "2024-01-01 10:45:00", no=9), payload(3, "2024-01-01 11:30:00"), payload(6, "2024-01-01 10:05:00"), payload(9, "2024-01-01 10:00:00")]
    again = [payload(1, "2024-01-01 09:31:00", no=8), payload(6, "2024-01-01 10:06:00", no=8)]
    far = [text(7, "2024-01-01 20:00:00")], [payload(8, "2024-01-01 20:00:00")]
    for folder in (texts, payloads):
        folder.mkdir()

    def run():
        read = lambda at, schema: spark.readStream.schema(schema).json(str(at))
        checked = streams.verified_stream(read(texts, "doc_id string, text string, at timestamp"), read(payloads, "doc_id string, raw string, at timestamp"))
        checked.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for step, rows in enumerate([(texts, first), (payloads, second)][:: 1 if order == "texts first" else -1]):
        put(rows[0], f"{step}.json", rows[1])
        run()
    put(payloads, "again.json", again)
    run()
    put(texts, "far.json", far[0])
    put(payloads, "far.json", far[1])
    run()
    put(texts, "farther.json", [text(7, "2024-01-02 20:00:00")])
    put(payloads, "farther.json", [payload(8, "2024-01-02 20:00:00")])
    run()
    got = {(r.doc_id, r.at.day, r.at.hour): r for r in spark.read.parquet(out).collect()}
    assert sorted(k[0] for k in got if k[1:] == (1, 10)) == ["d1", "d2", "d3", "d4", "d5", "d6"]
    near = [r for r in second if r["doc_id"] != "d3"]  # an hour and a half late
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in first], "doc_id string, text string")
    batch = pipeline.verified(pipeline.text_documents(docs), spark.createDataFrame([(r["doc_id"], r["raw"]) for r in near], "doc_id string, raw string"))
    for want in batch.collect():
        assert got[want.doc_id, 1, 10].asDict(True) | {"at": None} == want.asDict(True) | {"at": None}
    assert {k[0]: r.verification.status for k, r in got.items() if k[1:] == (1, 10)} == {"d1": "Verified", "d2": "Mismatch", "d3": "NotScanned", "d4": "NotScanned", "d5": "NotScanned", "d6": "Verified"}
