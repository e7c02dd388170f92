"""Receipt functions on written cases: dialect, kinds, fields, amounts, payloads, comparison."""

import pytest
from pyspark.sql import functions as F

from slipmill.functions import patterns as P
from slipmill.functions.qr import compact_date, plain_amount, qr_fields
from slipmill.functions.receipts import clean_tax_no, cn_amount, cn_integer, fields_of, flight_values, kind_of
from slipmill.operators.verify import verification


def apply(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def fields(spark, text):
    out = apply(spark, [text], lambda c: fields_of(kind_of(c), c))[0]
    return {f.key: f.value for f in out}


def test_kinds(spark):
    cases = {"发票号码：12345678": P.VAT, "价税合计 1 税额 2": P.VAT, "价税合计 1": P.UNKNOWN, "入口站 a 出口站 b\nK737": P.VAT, "车辆通行费": P.VAT, "a\nG1024\nb": P.TRAIN, "a\r\n　G 12　\nb": P.TRAIN,
             "aG1024": P.UNKNOWN, "乘车日期 x": P.TRAIN, "电子行程单 航班号": P.FLIGHT, "客票号": P.FLIGHT, "发票弋码": P.UNKNOWN, "hello": P.UNKNOWN, "": P.UNKNOWN, None: P.UNKNOWN}
    assert apply(spark, list(cases), kind_of) == list(cases.values())


def test_vat_with_noise(spark):
    text = ("发票弋码：011002200111\n发票号码 12345678\n开票目期：2024 年 05月 20 日\n项目名称：茶叶\n名　称：甲公司，x\n统一社会信用代码/纳税人识别号：9132/0594MAINGJLK6N\n名称:乙公司\n"
            "纳税人识别号：91110000MA1111111B\n合\n计：88.50\n税\n额：11.50\n价税合计（大写）壹佰元整（小 写）¥100.00")
    assert fields(spark, text) == {
        "invoice_code": "011002200111", "invoice_no": "12345678", "invoice_date": "2024年05月20日", "buyer_name": "甲公司", "seller_name": "乙公司", "buyer_tax_no": "91320594MA1NGJLK6N",
        "seller_tax_no": "91110000MA1111111B", "total_amount": "88.50", "total_tax": "11.50", "total_amount_with_tax": "100.00"}


def test_vat_words_when_figures_are_missing(spark):
    assert fields(spark, "发票代码：011002200111\n价税合计 叁佰圆整")["total_amount_with_tax"] == "300.00"
    assert fields(spark, "发票代码：011002200111\n(小写)\n201 注 100,00\n100.00")["total_amount_with_tax"] == "100.00"
    assert "seller_name" not in fields(spark, "发票代码：011002200111\n称：甲甲\n称：乙乙\n")


def test_train(spark):
    text = "G1024\n北京南站 → 上海虹桥站\n2024年5月20日\n高级软卧\n票价：¥553.00\n姓名：张三\n11010119900101123x"
    assert fields(spark, text) == {"train_no": "G1024", "travel_date": "2024年5月20日", "price": "553.00", "passenger_name": "张三", "passenger_id_no": "11010119900101123x",
                                   "seat_class": "高级软卧", "from_station": "北京南站", "to_station": "上海虹桥站"}


def test_flight_routes(spark):
    assert "departure" not in fields(spark, "电子客票行程单\n航班号：CA1234\n北京 → 上海")
    start = fields(spark, "北京 → 上海\n航班号 CA1234")
    assert (start["departure"], start["arrival"]) == ("北京", "上")
    lone = apply(spark, ["A京B沪C"], lambda c: F.struct(flight_values(c)["departure"], flight_values(c)["arrival"]))[0]
    assert tuple(lone) == ("京", "沪")
    fixed = apply(spark, ["行程单\n北京 → 上海"], lambda c: F.struct(flight_values(c, "fixed")["departure"], flight_values(c, "fixed")["arrival"]))[0]
    assert [x.strip() for x in fixed] == ["北京", "上海"]


def test_numerals(spark):
    cases = {"壹佰零拾伍": 115, "壹佰零伍": 105, "壹万贰仟叁佰肆拾伍": 12345, "一二": 2, "十万": 100_000, "万": 0, "拾": 10, "叁亿": 300_000_000, "x": 0}
    assert apply(spark, list(cases), cn_integer) == list(cases.values())
    assert apply(spark, ["壹万贰仟叁佰肆拾伍元陆角柒分", "叁佰圆整", "北京三元桥", "none", None], cn_amount) == ["12345.67", "300.00", "3.00", None, None]
    assert apply(spark, ["91i/o丨2"], clean_tax_no) == ["91102"]


def test_values_are_normalised(spark):
    amounts = {"1,234": "1.23", "1,234.56": "1234.56", "1,234,567": "1,234,567", "100,00": "100.00", "300": "300.00", "¥100.00": "100.00", "1.005": "1.01", " none ": "none"}
    assert apply(spark, list(amounts), plain_amount) == list(amounts.values())
    assert apply(spark, [" 2024年5月20日", "2024520", "20240520", "x"], compact_date) == ["20240520", "20245200", "20240520", "x"]


def test_payloads(spark):
    cases = {
        "https://inv-veri.chinatax.gov.cn/a?lx=10&fphm=123&kprq=2024-05-20&jshj=1%2B2&x=%ZZ": [("invoice_type", "10"), ("invoice_no", "123"), ("invoice_date", "20240520"), ("total_amount_with_tax", "1+2")],
        "https://veri.chinatax.gov.cn/?fphm=1&FPHM=2&jshj=1+2": [("invoice_no", "2"), ("total_amount_with_tax", "1+2")],
        "https://veri.chinatax.gov.cn/?fphm=1&fphm=%20": [],
        "https://other.example/?fphm=12345678": [],
        "01,011002200111,12345678,100.00,20240520": [("invoice_no", "12345678"), ("total_amount_with_tax", "100.00"), ("invoice_date", "20240520"), ("invoice_code", "011002200111")],
        "01,32,,30410099887766554433,41.50,20230309,,a1c4": [("invoice_no", "30410099887766554433"), ("total_amount_with_tax", "41.50"), ("invoice_date", "20230309")],
        "01,10,033001904222,70415926,7.3,20191124,12121314151617181920": [("invoice_no", "70415926"), ("total_amount_with_tax", "7.3"), ("invoice_date", "20191124"), ("invoice_code", "033001904222")],
        "shop 12345678 20240520": [],
        "发票号码：12345678 发票代码：011002200111": [("invoice_no", "12345678"), ("invoice_code", "011002200111")],
    }
    got = apply(spark, list(cases), qr_fields)
    for (raw, want), found in zip(cases.items(), got):
        assert [(f.key, f.value) for f in found] == want, raw
        assert [f.ord for f in found] == list(range(len(found)))


@pytest.mark.parametrize("qr,status,matched", [
    ([("invoice_no", "1"), ("invoice_date", "20240520"), ("total_amount_with_tax", "¥100.00")], "Verified", 3), ([("invoice_no", "2"), ("invoice_date", "20240520")], "Mismatch", 1),
    ([("invoice_code", "9")], "NotScanned", 0), ([], "NotScanned", 0)])
def test_verification(spark, qr, status, matched):
    ocr = [("invoice_no", "1"), ("invoice_date", "2024年5月20日"), ("total_amount_with_tax", "100,00"), ("buyer_name", " ")]
    kind = "fields array<struct<key:string,value:string>>, qr array<struct<key:string,value:string>>, raw string"
    v = spark.createDataFrame([(ocr, qr, "x")], kind).select(verification(F.col("fields"), F.col("qr"), F.col("raw")).alias("v")).first().v
    assert (v.status, len(v.matched)) == (status, matched)
    none = spark.createDataFrame([(ocr, qr, None)], kind).select(verification(F.col("fields"), F.col("qr"), F.col("raw")).alias("v")).first().v
    assert (none.status, none.raw_content) == ("NotScanned", None) or qr
