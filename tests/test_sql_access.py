"""Receipts from SQL: views and user parsers against the DataFrame forms."""

from slipmill.plans import pipeline, sql_access

ROWS = [("a", "发票代码：011002200111\n发票号码：00000001", 1), ("b", None, 2), ("c", "memo 7", 3), ("d", "", 4), ("a", "发票代码：011002200111\n发票号码：00000001", 5)]


def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id string, text string, kind int")
    df.createOrReplaceTempView("sql_docs")
    return df


def test_views_are_the_columns(spark):
    df = docs(spark)
    sql_access.fields_view(spark, "sql_docs", "sql_docs_fields")
    sql_access.records_view(spark, "sql_docs", "sql_docs_records")
    assert sorted(spark.sql("select * from sql_docs_fields").collect()) == sorted(pipeline.long_fields(pipeline.text_documents(df)).collect())
    assert {(r.doc_id, r.kind, r.error_kind) for r in spark.sql("select * from sql_docs_records").collect()} == {
        ("a", "vat_invoice", None), ("b", None, "EmptyInput"), ("c", "unknown", None), ("d", None, "EmptyInput")}
    plan = spark.sql("select value from sql_docs_fields where key = 'invoice_no'")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_user_parsers(spark):
    def parse(text):
        if text == "":
            raise ValueError("no text")
        return [("words", "Words", str(len(text.split()))), ("blank", "Blank", " ")]

    docs(spark)
    sql_access.parser_function(spark, "count_words", parse)
    got = spark.sql("select d.doc_id, f.* from sql_docs d, lateral count_words(d.text) f").collect()
    assert sorted(tuple(r) for r in got) == [("a", 0, "words", "Words", "2"), ("a", 0, "words", "Words", "2"), ("c", 0, "words", "Words", "2"), ("d", 0, "error", "ValueError", "no text")]
