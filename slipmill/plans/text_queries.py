"""Registered queries of the text operators over rendered receipts, and the SQL that gives the same rows from the source columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmill.functions import patterns as P
from slipmill.functions import qr
from slipmill.functions.dialect import settled
from slipmill.functions.qr import compact_date, plain_amount, qr_fields
from slipmill.functions.receipts import clean_tax_no, cn_amount, cn_integer, kind_of, vat_names, vat_values
from slipmill.operators import verify
from slipmill.plans import pipeline, render, sql_access

ORDERS = """
with r as (select cast(o_orderkey as varchar) as doc_id, o_orderkey as k, lpad(cast(o_orderkey as varchar), 8, '0') as no,
  '0110' || lpad(cast(o_orderkey % 1000 as varchar), 8, '0') as code, cast(cast(o_totalprice as decimal(18,2)) as varchar) as amount,
  cast(year(o_orderdate) as varchar) as y, cast(month(o_orderdate) as varchar) as m, cast(day(o_orderdate) as varchar) as d,
  strftime(o_orderdate, '%Y%m%d') as ymd, c_name as buyer, s_name as seller
  from orders join customer on c_custkey = o_custkey join supplier on s_suppkey = o_orderkey % 10)
"""
DAY = "y || '年' || m || '月' || d || '日'"


def _long_sql(kind: str, values: dict[str, str], where: str) -> str:
    rows = [f"select doc_id, {i} as ord, '{key}' as key, '{label}' as label, {values[key]} as value, cast(0.8 as float) as confidence from r where {where}"
            for i, (key, label) in enumerate(P.FIELDS[kind]) if key in values]
    return ORDERS + " union all ".join(rows)


def _extracted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Fields of all receipts whose text is of the kind; toll receipts are of kind VAT."""
    return pipeline.long_fields(pipeline.text_documents(render.documents(spark, sf_dir), kinds=(kind,)).where(F.col("kind") == kind))


def classify_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.documents(spark, sf_dir).select("doc_id", kind_of(F.col("text")).alias("kind"))


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.table(spark, sf_dir, "documents").select("doc_id", kind_of(F.col("text")).alias("kind"))


def classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_receipts(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def vat_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, P.VAT)


def vat_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.orders(spark, sf_dir).withColumn("text", settled(render.vat_text()))
    return pipeline.wide_fields(pipeline.text_documents(docs, kinds=(P.VAT,)), P.VAT)


def train_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, P.TRAIN)


def flight_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, P.FLIGHT)


def receipt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every receipt, toll and unknown ones too, with the kind that was found."""
    documents = pipeline.text_documents(render.documents(spark, sf_dir))
    return documents.select("kind", "doc_id", F.inline_outer("fields")).where("ord is not null")


def vat_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with noisy signs: 目 for 日, dots, dashes and slashes for 年 and 月."""
    c, form = F.col, F.col("k") % 4
    text = (F.when(form == 0, render.line("开票日期:", c("y"), " 年 ", c("m"), "月", c("d"), "日")).when(form == 1, render.line("开票目期 ", c("y"), ".", c("m"), ".", c("d")))
            .when(form == 2, render.line("开票 日 期：", c("y"), "-", c("m"), "-", c("d"), "目")).otherwise(render.line("日期 ", c("y"), "年", c("m"), "月", c("d"), "日")))
    return render.orders(spark, sf_dir).select("doc_id", vat_values(text)["invoice_date"].alias("invoice_date"))


def vat_names_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cut in two: apart, next to each other (only the first is seen), and beside one whole label."""
    form, name = F.col("k") % 3, lambda c: render.line("称：", F.col(c))
    text = (F.when(form == 0, render.lines(F.lit("名"), name("buyer"), F.lit("名"), name("seller"), F.lit("x")))
            .when(form == 1, render.lines(F.lit("x"), name("buyer"), name("seller"), F.lit("x"))).otherwise(render.lines(render.line("名称：", F.col("seller")), name("buyer"), F.lit("x"))))
    return render.orders(spark, sf_dir).select("doc_id", F.get(vat_names(text), 0).alias("buyer_name"), F.get(vat_names(text), 1).alias("seller_name"))


def vat_tax_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax numbers with noise between digits and letters that stand for digits."""
    no = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    noisy = render.line("9132/0594丨MA", F.translate(no, "01", "OI"), "-X")
    text = render.line("统一社会信用代码/纳税人识别号：", noisy)
    c = render.table(spark, sf_dir, "customer")
    return c.select("c_custkey", clean_tax_no(noisy).alias("clean"), vat_values(text)["buyer_tax_no"].alias("buyer_tax_no"))


def vat_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums with decoys and lines split inside labels; figures absent for odd keys, so words count there."""
    c = F.col
    text = render.lines(render.line("价税合计 ¥", c("amount")), render.line("合\n计：", c("amount")), render.line("税\n额：", (c("k") % 100).cast("string"), ".50"),
                        F.lit("叁佰圆整"), F.when(c("k") % 2 == 0, render.line("(小 写) ¥", c("amount"))).otherwise(F.lit("-")))
    v = vat_values(text)
    return render.orders(spark, sf_dir).select("doc_id", *(v[k].alias(k) for k in ("total_amount", "total_tax", "total_amount_with_tax")))


def cn_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in words, every digit printed with its unit, zeros too."""
    o = render.spread(render.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).select("o_orderkey", F.floor("o_totalprice").cast("long").alias("n"))
    sign = lambda p: F.substring(F.lit(P.DIGITS[0]), (F.floor(F.col("n") / p) % 10 + 1).cast("int"), F.lit(1))
    words = F.concat(sign(10_000_000), F.lit("仟"), sign(1_000_000), F.lit("佰"), sign(100_000), F.lit("拾"), sign(10_000), F.lit("万"), sign(1000), F.lit("仟"),
                     sign(100), F.lit("佰"), sign(10), F.lit("拾"), sign(1))
    return o.withColumn("words", words).select("o_orderkey", cn_integer(F.col("words")).alias("value"), cn_amount(F.concat("words", F.lit("元伍角陆分"))).alias("amount"))


def qr_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.inlined(render.orders(spark, sf_dir), qr_fields(render.qr_payload()))


def normal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, form = F.col, F.col("k") % 4
    value = (F.when(form == 0, render.line(" ", c("y"), "年", c("m"), "月", c("d"), "日 ")).when(form == 1, F.concat_ws("-", c("y"), F.lpad("m", 2, "0"), F.lpad("d", 2, "0")))
             .when(form == 2, F.concat(c("y"), F.lpad("m", 2, "0"), F.lpad("d", 2, "0"))).otherwise(render.line(" none ", c("m"))))
    return render.orders(spark, sf_dir).select("doc_id", compact_date(value).alias("date"))


def normal_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, form = F.col("amount"), F.col("k") % 6
    whole = F.substring_index(c, ".", 1)
    value = (F.when(form == 0, render.line("¥", c)).when(form == 1, F.translate(c, ".", ",")).when(form == 2, whole)
             .when(form == 3, render.line("1,", F.lpad(whole, 9, "0"), ".25")).when(form == 4, F.lit(" 1,234,567 ")).otherwise(F.lit("none")))
    return render.orders(spark, sf_dir).select("doc_id", plain_amount(value).alias("amount"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with payloads: a wrong number for keys divisible by 7, none at all for 10 of 11."""
    wrong = F.when(F.col("k") % 7 == 0, F.lpad((F.col("k") + 1).cast("string"), 8, "0")).otherwise(F.col("no"))
    return render.orders(spark, sf_dir).withColumns({"text": settled(render.vat_text()), "raw": settled(F.when(F.col("k") % 11 != 10, render.qr_payload(wrong)))})


def verify_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checked(spark, sf_dir)
    fields = pipeline.text_documents(rows.select(F.struct("doc_id", "raw").alias("row"), "text"), id_col="row", kinds=(P.VAT,))  # text and payload stay in one row
    checked = pipeline.with_verification(fields.select("doc_id.doc_id", "doc_id.raw", "kind", "fields"), "raw")
    v = checked.select("doc_id", "kind", F.size("fields").alias("n_fields"), "verification.*")
    return v.select("doc_id", "kind", "n_fields", "status", F.size("matched").alias("n_matched"), F.size("conflicts").alias("n_conflicts"),
                    F.get("conflicts", 0)["qr_value"].alias("qr_value"), F.get("conflicts", 0)["ocr_value"].alias("ocr_value"))


def verify_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checked(spark, sf_dir)
    fields = pipeline.long_fields(pipeline.text_documents(rows, kinds=(P.VAT,)))
    return verify.statuses(rows, fields, pipeline.inlined(rows, qr_fields(F.col("raw"))), qr.KEYS)


def verify_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checked(spark, sf_dir)
    fields = pipeline.long_fields(pipeline.text_documents(rows, kinds=(P.VAT,)))
    return verify.compare(fields, pipeline.inlined(rows, qr_fields(F.col("raw"))), qr.KEYS).where("not same").drop("same")


def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_receipts(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("n_conflicts").cast("long").alias("conflicts"))


def text_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = render.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), "text")
    return pipeline.box_text(boxes)


def sql_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of train receipts, asked for in SQL."""
    render.documents(spark, sf_dir).select("doc_id", "text").createOrReplaceTempView("receipts")
    sql_access.fields_view(spark, "receipts", "receipt_fields")
    sql_access.records_view(spark, "receipts", "receipt_records")
    return spark.sql(f"select r.kind, f.key, count(*) as n, count(distinct f.value) as n_values from receipt_fields f join receipt_records r on f.doc_id = r.doc_id where r.kind = '{P.TRAIN}' group by r.kind, f.key")


def _memo(text: str) -> list[tuple[str, str, str]]:
    """A user's parser: the number of a memo."""
    return [("memo_no", "memo", text[5:])] if text.startswith("memo ") else []


def sql_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's parser finds, as a table function in SQL."""
    render.documents(spark, sf_dir).select("doc_id", "text").createOrReplaceTempView("receipts")
    sql_access.parser_function(spark, "memo_fields", _memo)
    return spark.sql("select d.doc_id, f.* from receipts d, lateral memo_fields(d.text) f")


QUERIES = {f.__name__: f for f in (
    sql_fields, sql_parser, classify_receipts, classify_documents, classify_counts, vat_fields, vat_wide, train_fields, flight_fields, receipt_fields, vat_dates, vat_names_fallback, vat_tax_numbers, vat_totals,
    cn_amounts, qr_long, normal_dates, normal_amounts, verify_receipts, verify_join, verify_conflicts, verify_summary, text_of_boxes)}

_KIND = f"case k % 5 when 0 then '{P.VAT}' when 1 then '{P.VAT}' when 2 then '{P.TRAIN}' when 3 then '{P.FLIGHT}' else '{P.UNKNOWN}' end"
_TRAIN_VALUES = {
    "train_no": "'G' || cast(k % 9000 + 1 as varchar)", "travel_date": DAY, "price": "amount", "passenger_name": "'张三'", "passenger_id_no": "'1101011990' || no",
    "seat_class": "'二等座'", "from_station": "'北京南站'", "to_station": "'上海虹桥站'"}
_VAT_VALUES = {
    "invoice_code": "code", "invoice_no": "no", "invoice_date": DAY, "buyer_name": "buyer", "seller_name": "seller",
    "buyer_tax_no": "'91320594MA' || lpad(cast(k as varchar), 7, '0') || 'A'", "seller_tax_no": "'91320594MA' || lpad(cast(k as varchar), 7, '0') || 'B'",
    "total_amount": "amount", "total_tax": "'0.00'", "total_amount_with_tax": "amount"}
_WRONG = "case when k % 7 = 0 then lpad(cast(k + 1 as varchar), 8, '0') else no end"
_SEEN = ORDERS + f""", s as (select *, {_WRONG} as qr_no, k % 11 <> 10 as read, case k % 5 when 0 then 3 when 1 then 4 when 2 then 4 when 3 then 2 else 0 end as keys from r),
v as (select *, case when read then keys - case when k % 7 = 0 and keys > 0 then 1 else 0 end else 0 end as mm, case when read and keys > 0 and k % 7 = 0 then 1 else 0 end as cc from s),
z as (select *, case when cc > 0 then 'Mismatch' when mm > 0 then 'Verified' else 'NotScanned' end as status from v)
"""
_DIGIT = "(n // {p}) % 10"
_ONE = "case when (n // {p}) % 10 = 0 then 1 else (n // {p}) % 10 end"
_CN = f"""((({_ONE.format(p=10_000_000)}) * 1000 + ({_ONE.format(p=1_000_000)}) * 100 + ({_ONE.format(p=100_000)}) * 10 + {_DIGIT.format(p=10_000)}) * 10000
 + ({_ONE.format(p=1000)}) * 1000 + ({_ONE.format(p=100)}) * 100 + ({_ONE.format(p=10)}) * 10 + n % 10)"""
_SPACE = r"[\s\p{Z}]"

ORACLE_SQL = {
    "classify_receipts": ORDERS + f"select doc_id, {_KIND} as kind from r",
    "classify_counts": ORDERS + f"select {_KIND} as kind, count(*) as n from r group by 1",
    "classify_documents": f"""select doc_id, case
        when contains(text, '{P.TOLL_TITLE}') or (contains(text, '{P.TOLL_ENTRY}') and contains(text, '{P.TOLL_EXIT}')) then '{P.VAT}'
        when contains(text, '发票代码') or contains(text, '发票号码') or (contains(text, '价税合计') and contains(text, '税额')) then '{P.VAT}'
        when contains(text, '车次') or contains(text, '乘车日期') or regexp_matches(text, '(?m)^{_SPACE}*[GCDZYKL]{_SPACE}*[0-9]{{1,4}}{_SPACE}*$') then '{P.TRAIN}'
        when regexp_matches(text, '{"|".join(P.FLIGHT_WORDS)}') then '{P.FLIGHT}' else '{P.UNKNOWN}' end as kind from documents""",
    "sql_fields": "with f as (" + _long_sql(P.TRAIN, _TRAIN_VALUES, "k % 5 = 2") + f") select '{P.TRAIN}' as kind, key, count(*) as n, count(distinct value) as n_values from f group by key",
    "sql_parser": ORDERS + "select doc_id, 0 as ord, 'memo_no' as key, 'memo' as label, no as value from r where k % 5 = 4",
    "vat_fields": _long_sql(P.VAT, _VAT_VALUES, "k % 5 = 1"),
    "vat_wide": ORDERS + "select doc_id, " + ", ".join(f"{v} as {k}" for k, v in _VAT_VALUES.items()) + " from r",
    "train_fields": _long_sql(P.TRAIN, _TRAIN_VALUES, "k % 5 = 2"),
    "flight_fields": _long_sql(P.FLIGHT, {
        "flight_no": "'CA' || lpad(cast(k % 10000 as varchar), 4, '0')", "flight_date": DAY, "passenger_name": "'李四'", "ticket_no": "'99900' || no", "price": "amount",
        "fuel_surcharge": "'40.00'", "airport_fee": "'50.00'"}, "k % 5 = 3"),
    "vat_dates": ORDERS + f"select doc_id, case when k % 4 < 3 then {DAY} end as invoice_date from r",
    "vat_names_fallback": ORDERS + "select doc_id, case when k % 3 = 2 then seller else buyer end as buyer_name, case k % 3 when 0 then seller when 2 then buyer end as seller_name from r",
    "vat_tax_numbers": "with t as (select c_custkey, '91320594MA' || lpad(cast(c_custkey as varchar), 8, '0') || 'X' as n from customer) select c_custkey, n as clean, n as buyer_tax_no from t",
    "vat_totals": ORDERS + "select doc_id, amount as total_amount, cast(k % 100 as varchar) || '.50' as total_tax, case when k % 2 = 0 then amount else '300.00' end as total_amount_with_tax from r",
    "cn_amounts": f"""with o as (select o_orderkey, cast(floor(o_totalprice) as bigint) as n from orders), v as (select o_orderkey, {_CN} as value from o)
        select o_orderkey, cast(value as bigint) as value, cast(value as varchar) || '.56' as amount from v""",
    "qr_long": ORDERS + """, l as (
        select doc_id, 0 as ord, 'invoice_type' as key, '10' as value from r where k % 5 = 0 union all select doc_id, 1, 'invoice_no', no from r where k % 5 = 0
        union all select doc_id, 2, 'invoice_date', ymd from r where k % 5 = 0 union all select doc_id, 3, 'total_amount_with_tax', amount from r where k % 5 = 0
        union all select doc_id, 0, 'invoice_no', no from r where k % 5 in (1, 2, 3) union all select doc_id, 1, 'total_amount_with_tax', amount from r where k % 5 in (1, 2)
        union all select doc_id, 2, 'invoice_date', ymd from r where k % 5 in (1, 2) union all select doc_id, 3, 'invoice_code', code from r where k % 5 in (1, 2)
        union all select doc_id, 1, 'invoice_code', code from r where k % 5 = 3) select * from l""",
    "normal_dates": ORDERS + "select doc_id, case when k % 4 = 3 then 'none ' || m else ymd end as date from r",
    "normal_amounts": ORDERS + """select doc_id, case k % 6 when 2 then split_part(amount, '.', 1) || '.00' when 3 then cast(1000000000 + cast(split_part(amount, '.', 1) as bigint) as varchar) || '.25'
        when 4 then '1,234,567' when 5 then 'none' else amount end as amount from r""",
    "verify_receipts": _SEEN + f"""select doc_id, '{P.VAT}' as kind, 10 as n_fields, status, mm as n_matched, cc as n_conflicts, case when cc > 0 then qr_no end as qr_value, case when cc > 0 then no end as ocr_value from z""",
    "verify_join": _SEEN + "select doc_id, status, mm as n_matched, cc as n_conflicts from z",
    "verify_conflicts": _SEEN + "select doc_id, case when k % 5 = 0 then 1 else 0 end as ord, 'invoice_no' as key, qr_no as qr_value, no as ocr_value from z where cc > 0",
    "verify_summary": _SEEN + "select status, count(*) as n, cast(sum(cc) as bigint) as conflicts from z group by status",
    "text_of_boxes": f"""with t as (select conv_id, turn, regexp_replace(coalesce(text, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') as x from conversations)
        select conv_id as doc_id, coalesce(string_agg(x, chr(10) order by turn, x) filter (where x <> ''), '') as raw_text from t group by conv_id""",
}
ORACLE_SQL["receipt_fields"] = " union all ".join(
    f"select '{kind}' as kind, * from ({ORACLE_SQL[name]})" for kind, name in ((P.VAT, "vat_fields"), (P.TRAIN, "train_fields"), (P.FLIGHT, "flight_fields")))
