"""Fields by one pass over a text are those that each pattern finds by itself; long texts need no deep stack."""

import random

import pytest
from pyspark.sql import functions as F

from slipmill.functions import patterns as P
from slipmill.functions import receipts
from slipmill.functions.dialect import blank, rx, trim_u

PARTS = ["发票代码：", "发票 代弋码 ", "发票\n号码：", "0110020022", "12345678", "开票日期：", "开票目 期", "2024年1月2日", "2024-01-02", "名称：", "项目名称：", "名 称:", "\n称：甲乙\n", "称：", "某某公司", "甲\u0001乙",
         "纳税人识别号：", "统一社会信用代码", "91320594MA0000001A", "9132/0594丨MA000000-1B", "91..//,,--\\\\||1234", "价税合计", "价\n税合\n计", "合　计：", "合计金额", "¥", "1,234.56", "100", "税额：", "税 额", "小写", "（小 写）", "壹佰元整",
         "叁拾圆伍角", "车次", "G123", "票价：", "姓名：", "张三", "110101199001011234", "二等座", "北京南站", "站", " → ", "上海虹桥站", "航班号：CA1234", "客票号：9990012345678", "燃油附加费：", "机场建设费：", "民航发展基金", "-", "，", ";", " ", "\n", "　", "x", "😀"]


@pytest.mark.parametrize(("kind", "values", "listed"), [(P.VAT, receipts.vat_values, receipts.vat_list), (P.TRAIN, receipts.train_values, receipts.train_list), (P.FLIGHT, receipts.flight_values, receipts.flight_list)])
def test_one_pass_gives_what_each_pattern_gives(spark, kind, values, listed):
    rng = random.Random(8)
    texts = ["".join(rng.choices(PARTS, k=rng.choice([1, 5, 20, 60]))) for _ in range(300)] + ["", "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(4)
    each = values(F.col("t"))
    apart = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, each)), F.array(*(trim_u(c) for c in each.values()))), lambda k, v: F.coalesce(v, F.lit("")) != "")
    found = 0
    for r in df.select("t", apart.alias("a"), listed(F.col("t")).alias("b")).collect():
        assert r.a == {f.key: f.value for f in r.b} and [f.ord for f in r.b] == sorted(f.ord for f in r.b), r.t
        found += len(r.b)
    assert found > 300


def test_one_pass_over_long_texts(spark):
    df = spark.createDataFrame([(x * 20_000,) for x in ("名", "1", "石", "税", "G", "x\n")], "t string")
    assert [len(r[0]) + len(r[1]) for r in df.select(receipts.vat_list(F.col("t")), receipts.train_list(F.col("t"))).collect()] == [0, 1, 0, 0, 0, 0]


def test_a_text_is_passed_once_for_all_fields(spark):
    """Before, the plan held one search a field and more: 40 of them."""
    df = spark.createDataFrame([("发票代码：123456",)], "t string").select(receipts.vat_list(F.col("t")))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(t#") <= 2


def test_blank(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", " \n　 ", "​", " a ")], "t string")
    assert all(r[0] == r[1] for r in df.select(blank(F.col("t")), ~F.coalesce("t", F.lit("")).rlike(rx(r"\S"))).collect())


def test_equal_values_and_dates_in_few_searches(spark):
    """Before, a date was searched four times and each comparison brought both sides to normal form."""
    from slipmill.functions.qr import compact_date
    from slipmill.operators import verify

    values = ["2024年1月2日", " 20240102 ", "x 2024-1-2 y 2025-3-4", "2024", "", "a\nb", "\n", "1.50", "1,50", "٢٠٢٤-١-٢"]
    df = spark.createDataFrame([(a, b) for a in values for b in [*values, None]], "a string, b string").coalesce(1)
    y, m, d = (F.regexp_extract(trim_u(F.col("a")), rx(P.LOOSE_DATE), k) for k in (1, 2, 3))
    plain = F.when(y != "", F.concat(y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(trim_u(F.col("a")))
    assert all(r[0] == r[1] for r in df.select(compact_date(F.col("a")), plain).collect())
    for key in ("invoice_date", "total_tax", "invoice_no"):
        k = F.lit(key)
        assert all(r[0] == r[1] for r in df.select(verify.same(k, F.col("a"), F.col("b")), verify.normal(k, F.col("a")) == verify.normal(k, F.col("b"))).collect())
    plan = df.select(compact_date(F.col("a")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 0


def test_fields_that_no_payload_can_hold_are_not_moved(spark):
    from slipmill.functions import qr
    from slipmill.operators import verify

    fields = spark.createDataFrame([("a", k, "1") for _, names in P.FIELDS.items() for k, _ in names] + [("a", "invoice_type", "10"), ("b", "invoice_no", " ")], "doc_id string, key string, value string")
    payloads = spark.createDataFrame([("a", i, k, "1") for i, k in enumerate(qr.KEYS)] + [("b", 0, "invoice_no", "1")], "doc_id string, ord int, key string, value string")
    got, want = (sorted(verify.compare(fields, payloads, keys).collect()) for keys in (qr.KEYS, None))
    assert got == want and len(got) == 5
