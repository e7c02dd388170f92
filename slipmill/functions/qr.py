"""QR payloads and the comparison of values, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmill.functions import patterns as P
from slipmill.functions.dialect import first, groups, let, rx, trim_u

#: All keys that qr_fields() can give.
KEYS = (*P.QR_PARAMETERS.values(), "invoice_code")
QR_FIELD = "array<struct<ord:int,key:string,value:string>>"


def compact_date(c: Column) -> Column:
    """yyyyMMdd of the first three numbers that look like a date; else the value, trimmed."""
    t = trim_u(c)
    # A trimmed value starts with no line feed, so one at the start tells that there was a date.
    marked = F.regexp_replace(t, rx(rf"\A(?s:.*?){P.LOOSE_DATE}(?s:.*)"), "\n$1\n$2\n$3")
    date = let(F.split(marked, "\n"), lambda p: F.concat(F.get(p, 1), F.lpad(F.get(p, 2), 2, "0"), F.lpad(F.get(p, 3), 2, "0")))
    return F.when(F.startswith(marked, F.lit("\n")), date).otherwise(t)


def plain_amount(c: Column) -> Column:
    """An amount with two decimals; commas without a dot are decimal points; what is no amount stays, trimmed."""
    t = trim_u(c)
    v = F.regexp_replace(t, "[^0-9.,]", "")
    comma, dot = F.contains(v, F.lit(",")), F.contains(v, F.lit("."))
    v = F.when(comma & ~dot, F.translate(v, ",", ".")).when(comma, F.translate(v, ",", "")).otherwise(v)
    number = F.when(v.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), v.try_cast("decimal(38,10)"))
    return F.coalesce(F.round(number, 2).cast("decimal(38,2)").cast("string"), t)


def normal(key: Column, value: Column) -> Column:
    """A value in the form that is compared: dates compact, amounts plain, all else trimmed."""
    return (F.when(key == "invoice_date", compact_date(value)).when(key.isin(*P.AMOUNT_KEYS), plain_amount(value)).otherwise(trim_u(value)))


def unescaped(c: Column) -> Column:
    """Percent-decoded; plus signs and broken escapes stay."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _numbered(pairs: Column) -> Column:
    """Pairs with a value, numbered from 0."""
    kept = F.filter(pairs, lambda p: trim_u(F.coalesce(p["value"], F.lit(""))) != "")
    return F.transform(kept, lambda p, i: F.struct(i.alias("ord"), p["key"].alias("key"), p["value"].alias("value")))


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def verification_url(raw: Column) -> Column:
    """The first URL of the payload if it is one of the tax bureau with a query, else null."""
    # What is looked for in the address must stand in the payload: a plain search keeps most payloads from the pattern.
    url = F.when(F.contains(raw, F.lit("?")) & F.contains(F.lower(raw), F.lit(P.QR_DOMAIN)), first(raw, P.QR_URL, 0))
    return let(url, lambda url: F.when(F.contains(url, F.lit("?")) & F.contains(F.lower(url), F.lit(P.QR_DOMAIN)), url))


def _url_pairs(url: Column) -> Column:
    """Parameters in order of their first place; of repeated ones the last value; known ones under their field's key."""
    query = F.substring(url, F.instr(url, F.lit("?")) + 1, F.length(url))
    split = F.filter(F.split(query, "&"), lambda p: F.instr(p, F.lit("=")) > 1)
    named = F.transform(split, lambda p: F.struct(
        F.lower(unescaped(F.substring(p, F.lit(1), F.instr(p, F.lit("=")) - 1))).alias("key"),
        unescaped(F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p))).alias("value")))
    named = F.filter(named, lambda p: p["key"].isin(*P.QR_PARAMETERS))
    last = lambda k: F.try_element_at(F.filter(named, lambda p: p["key"] == k), F.lit(-1))["value"]
    keys = F.array_distinct(F.transform(named, lambda p: p["key"]))

    def value(k: Column) -> Column:
        return F.when(k == "kprq", compact_date(last(k))).otherwise(last(k))

    def field(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, key in P.QR_PARAMETERS.items():
            out = F.when(k == name, F.lit(key)).otherwise(out)
        return out

    return F.transform(keys, lambda k: F.struct(field(k).alias("key"), value(k).alias("value")))


def qr_fields(raw: Column) -> Column:
    """Fields of a payload in order: of a tax bureau's URL, else of the comma-separated layouts, else what has an anchor."""
    def listed(x: Column) -> Column:
        return F.array(_pair("invoice_no", F.get(x, 1)), _pair("total_amount_with_tax", F.get(x, 2)), _pair("invoice_date", compact_date(F.get(x, 3))), _pair("invoice_code", F.get(x, 0)))

    def read(t: Column) -> Column:
        anchored = F.array(_pair("invoice_no", first(t, P.QR_NO)), _pair("invoice_code", first(t, P.QR_CODE)))
        forms = F.struct(verification_url(t).alias("url"), F.coalesce(groups(t, P.QR_WITH_KIND, 4), groups(t, P.QR_WITHOUT_KIND, 4)).alias("listed"))
        return let(forms, lambda f: F.when(f["url"].isNotNull(), _url_pairs(f["url"])).when(f["listed"].isNotNull(), listed(f["listed"])).otherwise(anchored))

    return F.coalesce(_numbered(let(trim_u(raw), read)), F.array().cast(QR_FIELD))
