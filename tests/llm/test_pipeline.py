"""Every stage on planted rows: columns stay, decisions take effect, clean rows stay."""

import random

import pytest

import corpus_pipeline
from slipmill.llm import secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, prose(80)) for i in range(60)]
    toxic = [(100 + i, prose(20) + " you worthless idiot " + prose(20) + " stupid clown " + prose(20)) for i in range(40)]
    passage = prose(30)
    docs += [*toxic, (200, docs[7][1]), (201, docs[8][1]), (202, docs[8][1]), (210, prose(30) + " " + passage + " " + prose(30)),
             (220, prose(30) + ' token = "0123456789abcdef0123456789abcdef" ' + prose(30)), (230, None), (231, ""), (None, prose(50)), (240, prose(30_000))]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in docs[:100]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, dict(docs)


def test_stages(spark, planted):
    at, docs = planted
    table = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, at)
        assert out.columns == table.columns, name
        out.write.parquet(f"{at}/{name}")
        table = spark.read.parquet(f"{at}/{name}")
        kept[name] = {r.doc_id: r.text for r in table.collect()}
    assert set(kept["toxicity"]) == {i for i in docs if i is None or not 100 <= i < 200}
    assert set(kept["near_dedup"]) == set(kept["toxicity"]) - {200, 201, 202, 231}
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {210}
    assert set(kept["secrets"]) == set(kept["decontamination"]) and secrets.MASK in kept["secrets"][220] and "0123456789abcdef" not in kept["secrets"][220]
    assert all(t == docs[i] for i, t in kept["secrets"].items() if i != 220)
    assert all(r.n_chars == len(r.text or "") or r.text is None for r in table.collect())
    assert len(corpus_pipeline.STAGES[-1][1](spark, table, at).collect()) == len(kept["secrets"])


def test_run(spark, planted):
    assert corpus_pipeline.run(spark, planted[0]).count() == len(planted[1]) - 40 - 4 - 1


def test_empty_tables_and_other_columns(spark, planted, tmp_path):
    at, _ = planted
    none = str(tmp_path)
    for name, kind in (("documents", COLUMNS + ", _gone_id int, bucket string"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{none}/{name}.parquet")
    table = spark.read.parquet(f"{none}/documents.parquet")
    more = spark.read.parquet(f"{at}/documents.parquet").limit(5).selectExpr("*", "1 as _gone_id", "'b' as bucket")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, none).count() == 0, name
        out = stage(spark, more, none)
        assert out.count() == 5 and (name == "packing" or out.columns == more.columns)
    assert corpus_pipeline.run(spark, none).count() == 0
