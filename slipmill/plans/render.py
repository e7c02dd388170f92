"""Receipts and QR payloads rendered from order tables, for queries and tests: known values in, text out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmill.functions.dialect import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, parts: int = 1) -> DataFrame:
    """A scan of fewer partitions than parts for each core of the session, dealt to so many: text work costs more than the move. Larger
    scans stay as they are."""
    least = df.sparkSession.sparkContext.defaultParallelism * parts
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order with the values that receipts show: k (the key), no, code, amount (two decimals), y, m, d, buyer, seller."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    o = o.withColumn("s_suppkey", F.col("o_orderkey") % 10)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("buyer"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey < 10").select("s_suppkey", F.col("s_name").alias("seller"))
    date = F.to_date("o_orderdate")
    return o.join(c, "o_custkey").join(F.broadcast(s), "s_suppkey").select(
        F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("k"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("no"),
        F.concat(F.lit("0110"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 8, "0")).alias("code"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"), F.year(date).cast("string").alias("y"), F.month(date).cast("string").alias("m"),
        F.dayofmonth(date).cast("string").alias("d"), "buyer", "seller")


def lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def line(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def vat_text() -> Column:
    """A tax invoice with decoys: a goods name label, an ideographic space, the sum with tax before its figures."""
    c = F.col
    tax = lambda digit: line("91320594MA", F.lpad(F.col("k").cast("string"), 7, "0"), digit)
    return lines(
        line("发票代码：", c("code")), line("发票号码：", c("no")), line("开票日期：", c("y"), "年", c("m"), "月", c("d"), "日"), F.lit("项目名称：货物甲"),
        line("名 称：", c("buyer")), line("纳税人识别号：", tax("A")), line("名 称：", c("seller")), line("统一社会信用代码：", tax("B")),
        line("合　计：¥", c("amount")), F.lit("税 额：¥0.00"), line("价税合计（大写）壹佰元整（小写）¥", c("amount")))


def train_text() -> Column:
    c = F.col
    return lines(line("G", (c("k") % 9000 + 1).cast("string")), F.lit("北京南站 → 上海虹桥站"), line(c("y"), "年", c("m"), "月", c("d"), "日"), F.lit("二等座"),
                 line("票价：¥", c("amount")), F.lit("姓名：张三"), line("1101011990", c("no")))


def flight_text() -> Column:
    c = F.col
    return lines(F.lit("航空运输电子客票行程单"), line("航班号：CA", F.lpad((c("k") % 10000).cast("string"), 4, "0")), F.lit("北京首都T3 → 上海虹桥T2"),
                 line(c("y"), "年", c("m"), "月", c("d"), "日"), F.lit("姓名：李四"), line("客票号：99900", c("no")), line("票价：", c("amount")),
                 F.lit("燃油附加费：40.00"), F.lit("机场建设费：50.00"))


def toll_text() -> Column:
    return lines(F.lit("入口站 甲"), F.lit("出口站 乙"), line("K", (F.col("k") % 1000).cast("string")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of five kinds by the key's remainder: toll, tax invoice, train, flight, none."""
    kind = F.col("k") % 5
    text = F.when(kind == 0, toll_text()).when(kind == 1, vat_text()).when(kind == 2, train_text()).when(kind == 3, flight_text()).otherwise(line("memo ", F.col("no")))
    return orders(spark, sf_dir).withColumn("text", settled(text))


def qr_payload(number: Column | None = None) -> Column:
    """The payload of a tax invoice in five forms by the key's remainder: URL, two comma layouts, anchors, none of these."""
    c, form = F.col, F.col("k") % 5
    no = F.col("no") if number is None else number
    date = F.concat(c("y"), F.lpad("m", 2, "0"), F.lpad("d", 2, "0"))
    url = line("https://inv-veri.chinatax.gov.cn/v?lx=10&fphm=", no, "&kprq=", c("y"), "-", F.lpad("m", 2, "0"), "-", F.lpad("d", 2, "0"), "&jshj=", c("amount"))
    return (F.when(form == 0, url).when(form == 1, line("01,10,", c("code"), ",", no, ",", c("amount"), ",", date, ",12345"))
            .when(form == 2, line("01,", c("code"), ",", no, ",", c("amount"), ",", date)).when(form == 3, line("发票号码：", no, " 发票代码：", c("code")))
            .otherwise(line("receipt ", no)))
