"""Cross-check of extracted fields and QR fields: inside a row without a shuffle, or as a join of two long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.functions.dialect import blank, let
from slipmill.functions.qr import normal

NOT_SCANNED, VERIFIED, MISMATCH = "NotScanned", "Verified", "Mismatch"


def _status(matched: Column, conflicts: Column) -> Column:
    return F.when(conflicts > 0, MISMATCH).when(matched > 0, VERIFIED).otherwise(NOT_SCANNED)


def same(key: Column, a: Column, b: Column) -> Column:
    """Whether two values are equal in normal form; equal values are, without it."""
    return F.when(a == b, True).otherwise(normal(key, a) == normal(key, b))


def verification(fields: Column, qr: Column, raw: Column) -> Column:
    """struct(status, raw_content, matched, conflicts) of a row's field list and QR field list, in the order of the latter.

    A null payload is not scanned; so is one that shares no key with the fields. Values are compared in normal form and
    reported as they stand.
    """
    def value(key: Column) -> Column:
        """The first value of a key that is not blank. Only fields of the key are looked at."""
        return F.get(F.filter(fields, lambda f: F.when(f["key"] == key, ~blank(f["value"]))), 0)["value"]

    def side_by_side(pairs: Column) -> Column:
        return F.transform(F.filter(pairs, lambda p: p["ocr_value"].isNotNull()), lambda p: F.struct(p.alias("pair"), same(p["key"], p["qr_value"], p["ocr_value"]).alias("same")))

    def parted(pairs: Column) -> Column:
        chosen = lambda equal: F.transform(F.filter(pairs, lambda p: p["same"] == equal), lambda p: p["pair"])
        return F.struct(chosen(True).alias("matched"), chosen(False).alias("conflicts"))

    none = F.array().cast("array<struct<key:string,qr_value:string,ocr_value:string>>")
    pairs = F.transform(qr, lambda q: F.struct(q["key"].alias("key"), q["value"].alias("qr_value"), value(q["key"]).alias("ocr_value")))
    return let(let(let(pairs, side_by_side), parted), lambda v: F.struct(
        F.when(raw.isNull(), NOT_SCANNED).otherwise(_status(F.size(v["matched"]), F.size(v["conflicts"]))).alias("status"), raw.alias("raw_content"),
        F.coalesce(v["matched"], none).alias("matched"), F.coalesce(v["conflicts"], none).alias("conflicts")))


def compare(fields: DataFrame, qr: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, ord (of the QR side), key, qr_value, ocr_value and same, for every key that both long tables have.

    fields: doc_id, key, value and, if they have one, ord; qr: doc_id, ord, key, value. Both sides hash on (doc_id, key), a document's rows stay
    few. keys: all keys that qr can hold, if they are known, so that other fields are not moved. Of fields that repeat a key the first counts (by ord, else the smallest value), as in verification().
    """
    left = qr.select("doc_id", "ord", "key", F.col("value").alias("qr_value"))
    fields = fields if keys is None else fields.where(F.col("key").isin(*keys))
    order = F.col("ord") if "ord" in fields.columns else F.col("value")
    right = fields.where(~blank(F.col("value"))).groupBy("doc_id", "key").agg(F.min_by("value", order).alias("ocr_value"))
    joined = left.join(right, ["doc_id", "key"])
    return joined.select("doc_id", "ord", "key", "qr_value", "ocr_value", same(F.col("key"), F.col("qr_value"), F.col("ocr_value")).alias("same"))


def statuses(documents: DataFrame, fields: DataFrame, qr: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, status, n_matched and n_conflicts of every document of documents (doc_id). keys: as in compare()."""
    counted = compare(fields, qr, keys).groupBy("doc_id").agg(F.count_if("same").alias("m"), F.count_if(~F.col("same")).alias("c"))
    m, c = F.coalesce("m", F.lit(0)), F.coalesce("c", F.lit(0))
    return documents.select("doc_id").join(counted, "doc_id", "left").select("doc_id", _status(m, c).alias("status"), m.alias("n_matched"), c.alias("n_conflicts"))
