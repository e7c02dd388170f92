"""Every registered operator query: its contract's columns and rows on the smallest tables, and none on empty ones."""

import zlib
from pathlib import Path

import pytest

from slipmill.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")

DOCUMENT = {"doc_id": "bigint"}
SCORED = DOCUMENT | {"held_out": "boolean", "score": "double", "predicted": "int"}
COLUMNS = {
    "op1_simhash": DOCUMENT | {"fingerprint": "string", "component_id": "bigint"},
    "op2_quality": SCORED,
    "op3_toxicity": SCORED,
    "op4_quality_rules": DOCUMENT | dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint") | dict.fromkeys(("base_failed", "kept"), "boolean"),
    "op5_secrets": DOCUMENT | dict.fromkeys(("n_assign", "n_access", "n_hex"), "bigint") | dict.fromkeys(("base_sha256", "spans"), "string"),
    "op6_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7_packing": DOCUMENT | {"n_tokens": "bigint", "bucket": "bigint", "batch": "bigint"},
    "op8_licenses": DOCUMENT,
    "op9_decontamination": DOCUMENT | {"contaminated": "boolean"},
    "op10_chat": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op11_resampling": DOCUMENT | dict.fromkeys(("n_features", "weight", "score", "rank"), "bigint"),
    "op12_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op13_collocations": {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint"),
}
FOLDS = {"op2_quality": lambda n: n % 3 == 1, "op3_toxicity": lambda n: n % 5 == 0}


def source(name):
    return {"op6_warc": ("pages", "page_id"), "op10_chat": ("conversations", "conv_id"), "op12_extraction": ("pages", "page_id")}.get(name, ("documents", "doc_id"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for table in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(f"{at}/{table}.parquet")
    return at


def test_every_query_is_tested():
    assert set(COLUMNS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract(spark, name):
    table, key = source(name)
    out = queries.QUERIES[name](spark, str(DATA))
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    if name == "op13_collocations":  # no row a document
        return
    ids = [r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()]
    rows = out.collect()
    assert sorted(r[key] for r in rows) == (sorted({*ids, -7}) if name == "op10_chat" else sorted(ids))
    if name in FOLDS:
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == FOLDS[name](zlib.crc32(str(r.doc_id).encode())) for r in rows)
    if name == "op1_simhash":
        assert all(len(r.fingerprint) == 16 and r.component_id <= r.doc_id for r in rows)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_tables(spark, empty, name):
    rows = queries.QUERIES[name](spark, empty).collect()
    assert [r.conv_id for r in rows] == [-7] if name == "op10_chat" else rows == []
