"""Registered queries of the image path: receipts drawn from customers, found, straightened, read and checked, with SQL from the source columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmill.operators import glyphs, recognition
from slipmill.operators.engine import Settings
from slipmill.plans import pipeline, render
from slipmill.plans.text_queries import DAY

#: Lines are up to 20 characters long, which is wider than the usual limit.
SETTINGS = Settings(line_width=1280)
#: Partitions of images for each core: an image is some 10 ms of work, so cores that end early get more of them.
PARTS = 4


def _receipt() -> Column:
    """A tax invoice of five lines."""
    c = F.col
    return render.lines(render.line("发票代码：", c("code")), render.line("发票号码：", c("no")), render.line("开票日期：", c("y"), "年", c("m"), "月", c("d"), "日"),
                        render.line("名称：", c("buyer")), render.line("价税合计（小写）¥", c("amount")))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and image of a receipt of every customer: a line of each sixth stands on its head, every fifth has no code, each hundred and first is broken (no pixels)."""
    k = F.col("k")
    c = render.spread(render.table(spark, sf_dir, "customer"), PARTS).select(
        F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_custkey").alias("k"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("no"), F.concat(F.lit("0110"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 8, "0")).alias("code"),
        F.abs(F.col("c_acctbal").cast("decimal(18,2)")).cast("string").alias("amount"), (F.col("c_custkey") % 30 + 1990).cast("string").alias("y"), (F.col("c_custkey") % 12 + 1).cast("string").alias("m"), (F.col("c_custkey") % 28 + 1).cast("string").alias("d"), F.col("c_name").alias("buyer"))
    payload = F.when(k % 5 != 4, render.line("01,10,", F.col("code"), ",", F.when(k % 7 == 0, F.lit("99999999")).otherwise(F.col("no")), ",", F.col("amount"), ",", F.col("y"), F.lpad("m", 2, "0"), F.lpad("d", 2, "0"), ",1"))
    turned = F.when(k % 6 == 0, F.array(k % 5)).otherwise(F.array().cast("array<bigint>"))
    return c.select("doc_id", glyphs.drawn(F.when(k % 101 != 0, _receipt()), payload, turned).alias("image"))


def _records(spark: SparkSession, sf_dir: str, settings: Settings = SETTINGS) -> DataFrame:
    read = recognition.page_reader(lambda: glyphs.detector(again=True), glyphs.reader(again=True), glyphs.ALPHABET, orient=lambda: glyphs.orienter(), decode=lambda: glyphs.decoder(), settings=settings)
    return pipeline.read_documents(pictures(spark, sf_dir), read)


def image_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of receipts that are read from images, and their check against the code in the image; images that cannot be read are error rows."""
    r = _records(spark, sf_dir)
    value = lambda key: F.get(F.filter("fields", lambda f: f["key"] == key), 0)["value"].alias(key)
    return r.select("doc_id", "kind", *(value(k) for k in ("invoice_code", "invoice_no", "invoice_date", "buyer_name", "total_amount_with_tax")), "error_kind", F.col("verification.status").alias("status"),
                    F.size("verification.matched").alias("n_matched"), F.size("verification.conflicts").alias("n_conflicts"))


def image_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the lines of all images, read in batches of like width over documents."""
    read = recognition.recognise(pictures(spark, sf_dir), lambda: glyphs.detector(again=True), glyphs.reader(again=True), glyphs.ALPHABET, lambda: glyphs.orienter(), Settings(batched=True))
    return read.select("doc_id", "text", F.round(F.col("confidence").cast("double"), 3).alias("confidence"))


QUERIES = {f.__name__: f for f in (image_fields, image_lines)}

_CUSTOMERS = """with r as (select cast(c_custkey as varchar) as doc_id, c_custkey as k, lpad(cast(c_custkey as varchar), 8, '0') as no, '0110' || lpad(cast(c_custkey % 1000 as varchar), 8, '0') as code,
  cast(abs(cast(c_acctbal as decimal(18,2))) as varchar) as amount, cast(c_custkey % 30 + 1990 as varchar) as y, cast(c_custkey % 12 + 1 as varchar) as m, cast(c_custkey % 28 + 1 as varchar) as d, c_name as buyer from customer) """
_DATE = f"case when k % 101 <> 0 then {DAY} end"
ORACLE_SQL = {
    "image_fields": _CUSTOMERS + f"""select doc_id, case when k % 101 <> 0 then 'vat_invoice' end as kind, case when k % 101 <> 0 then code end as invoice_code, case when k % 101 <> 0 then no end as invoice_no,
        {_DATE} as invoice_date, case when k % 101 <> 0 then buyer end as buyer_name, case when k % 101 <> 0 then amount end as total_amount_with_tax, case when k % 101 = 0 then 'Decode' end as error_kind,
        case when k % 101 = 0 or k % 5 = 4 then 'NotScanned' when k % 7 = 0 then 'Mismatch' else 'Verified' end as status,
        case when k % 101 = 0 or k % 5 = 4 then 0 when k % 7 = 0 then 3 else 4 end as n_matched, case when k % 101 = 0 or k % 5 = 4 or k % 7 <> 0 then 0 else 1 end as n_conflicts from r""",
    "image_lines": _CUSTOMERS + f""" select doc_id, unnest(['发票代码：' || code, '发票号码：' || no, '开票日期：' || {DAY}, '名称：' || buyer, '价税合计（小写）¥' || amount]) as text, 0.8::double as confidence from r where k % 101 <> 0""",
}
