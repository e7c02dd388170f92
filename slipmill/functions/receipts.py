"""Receipt functions as native columns: kind of a document, its fields by kind, amounts in words.

Values are strings as they stand in the text; a field that is not found is not in the list. All of it is expressions, so it
composes with filters, joins and SQL, and runs where the text is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmill.functions import patterns as P
from slipmill.functions.dialect import FAR, every, first, groups, has, let, rx, searched, some, trim_u

FIELD = "array<struct<ord:int,key:string,label:string,value:string,confidence:float>>"


def kind_of(text: Column) -> Column:
    """The kind of a document: the first rule that holds; null text is unknown."""
    t = F.coalesce(text, F.lit(""))
    toll = has(t, P.TOLL_TITLE) | (has(t, P.TOLL_ENTRY) & has(t, P.TOLL_EXIT))
    vat = has(t, *P.VAT_WORDS) | (has(t, P.VAT_TOTAL) & has(t, P.VAT_TAX))
    train = has(t, *P.TRAIN_WORDS) | t.rlike(rx(P.TRAIN_LINE, "m"))
    return F.when(toll | vat, P.VAT).when(train, P.TRAIN).when(has(t, *P.FLIGHT_WORDS), P.FLIGHT).otherwise(P.UNKNOWN)


#: Signs by number: digits 0 to 9 in either script as their figures, then the units.
_SMALL = [u for u, v in P.UNITS.items() if v < 10_000]
_FIGURES = "0123456789"


def cn_integer(c: Column) -> Column:
    """A number in Chinese numerals as a long; a unit without a digit before it counts once, a second digit replaces the first."""
    plain = F.translate(c, "".join(P.DIGITS), _FIGURES * len(P.DIGITS))
    long = lambda x: x.cast("long")
    state = F.struct(long(F.lit(0)).alias("total"), long(F.lit(0)).alias("section"), long(F.lit(0)).alias("num"))

    def make(total: Column, section: Column, num: Column) -> Column:
        return F.struct(long(total).alias("total"), long(section).alias("section"), long(num).alias("num"))

    def step(s: Column, ch: Column) -> Column:
        unit, zero = F.lit(10), F.lit(0)
        for sign in _SMALL:
            unit = F.when(ch == sign, F.lit(P.UNITS[sign])).otherwise(unit) if P.UNITS[sign] != 10 else unit
        all_ = F.try_add(F.try_add(s["total"], s["section"]), s["num"])
        return (F.when(ch.between("0", "9"), make(s["total"], s["section"], F.ascii(ch) - 48))
                .when(ch.isin(*_SMALL), make(s["total"], F.try_add(s["section"], F.try_multiply(F.greatest(s["num"], long(F.lit(1))), long(unit))), zero))
                .when(ch == "万", make(s["total"], F.try_multiply(F.try_add(s["section"], s["num"]), long(F.lit(10_000))), zero))
                .when(ch == "亿", make(F.try_multiply(all_, long(F.lit(100_000_000))), zero, zero))
                .otherwise(s))

    return F.aggregate(F.split(plain, ""), state, step, lambda s: F.try_add(F.try_add(s["total"], s["section"]), s["num"]))


def cn_amount(text: Column) -> Column:
    """The first amount in words as a string with two decimals, or null."""
    digit = lambda c: F.coalesce(some(F.translate(c, "".join(P.DIGITS), _FIGURES * len(P.DIGITS))), F.lit("0"))
    whole = lambda g: cn_integer(F.get(g, 0)).cast("string")
    return let(groups(text, P.CN_AMOUNT, 3), lambda g: F.concat(whole(g), F.lit("."), digit(F.get(g, 1)), digit(F.get(g, 2))))


def clean_tax_no(c: Column) -> Column:
    return trim_u(F.translate(F.upper(F.translate(c, P.TAX_NO_NOISE, "")), "IO", "10"))


def _dated(text: Column, pattern: str) -> Column:
    return let(groups(text, pattern, 3), _date)


def _date(g: Column, at: int = 0) -> Column:
    return F.concat(some(F.get(g, at)), F.lit("年"), F.get(g, at + 1), F.lit("月"), F.get(g, at + 2), F.lit("日"))


def _listed(kind: str, values: dict[str, Column]) -> Column:
    """The values of a kind in order, without those that are null or empty. Values that may have white space at their ends come trimmed."""
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), F.lit(label).alias("label"), values[key].alias("value"),
                              F.lit(P.CONFIDENCE).cast("float").alias("confidence")) for i, (key, label) in enumerate(P.FIELDS[kind])))
    return F.filter(rows, lambda r: F.coalesce(r["value"], F.lit("")) != "")


def vat_names(text: Column) -> Column:
    """Names in order: those after a whole label; if these are fewer than two, then those after a label cut in two."""
    names = F.transform(every(text, P.VAT_NAME), trim_u)
    cut = F.array_distinct(F.transform(every(text, P.VAT_NAME_SPLIT), trim_u))
    return let(names, lambda n: F.when(F.size(n) < 2, F.concat(n, F.filter(cut, lambda x: ~F.array_contains(n, x)))).otherwise(n))


def _sum(text: Column) -> Column:
    sums = F.filter(every(text, P.VAT_SUM, 0), lambda x: ~F.startswith(x, F.lit("价")))
    return first(F.get(sums, 0), P.VAT_SUM)


def _tax_numbers(found: Column) -> Column:
    return F.filter(F.transform(found, clean_tax_no), lambda x: F.length(x) >= 15)


def vat_values(text: Column) -> dict[str, Column]:
    names = vat_names(text)
    tax = _tax_numbers(every(text, P.VAT_TAX_NO))
    figures = F.regexp_extract(F.regexp_extract(text, rx(P.FIGURES), 1), rx(P.AMOUNT_WITH_DECIMALS), 1)
    return {
        "invoice_code": first(text, P.VAT_CODE), "invoice_no": first(text, P.VAT_NO), "invoice_date": _dated(text, P.VAT_DATE),
        "buyer_name": F.get(names, 0), "seller_name": F.get(names, 1), "buyer_tax_no": F.get(tax, 0), "seller_tax_no": F.get(tax, 1),
        "total_amount": _sum(text), "total_tax": first(text, P.VAT_TAX_SUM),
        "total_amount_with_tax": F.coalesce(some(figures), cn_amount(text)),
    }


def vat_list(text: Column) -> Column:
    """vat_values() as a list of fields, by one pass over the text. Where the first two names, tax numbers or sums do not settle a value, all of them are looked for."""
    name, tax = P.VAT_NAME, f"(?=[纳统]){P.VAT_TAX_NO}"
    patterns = [P.VAT_CODE, P.VAT_NO, P.VAT_DATE, f"{name}(?:{FAR}{name})?", f"{tax}(?:{FAR}{tax})?", rf"(?=[价合])(?:(价)\s*税)?{P.VAT_SUM_END}", P.VAT_TAX_SUM, P.FIGURES]

    def more(v: Column) -> Column:
        at = lambda k: F.get(v, k)
        # Names hold no white space, so they need no trimming.
        names = F.when(at(6) != "", F.array(at(5), at(6))).otherwise(vat_names(text))
        clean = F.array(at(7), at(8))
        settled_ = (at(8) == "") | ((F.length(clean_tax_no(at(7))) >= 15) & (F.length(clean_tax_no(at(8))) >= 15))
        return F.struct(v.alias("v"), names.alias("names"), F.when(settled_, _tax_numbers(clean)).otherwise(_tax_numbers(every(text, P.VAT_TAX_NO))).alias("tax"),
                        some(F.regexp_extract(at(12), rx(P.AMOUNT_WITH_DECIMALS), 1)).alias("figures"))

    def listed(f: Column) -> Column:
        v = f["v"]
        return _listed(P.VAT, {
            "invoice_code": F.get(v, 0), "invoice_no": F.get(v, 1), "invoice_date": _date(v, 2), "buyer_name": F.get(f["names"], 0), "seller_name": F.get(f["names"], 1),
            "buyer_tax_no": F.get(f["tax"], 0), "seller_tax_no": F.get(f["tax"], 1), "total_amount": F.when(F.get(v, 9) == "", F.get(v, 10)).otherwise(_sum(text)),
            "total_tax": F.get(v, 11), "total_amount_with_tax": F.coalesce(f["figures"], cn_amount(text))})

    return let(let(searched(text, patterns, 13), more), listed)


def train_values(text: Column) -> dict[str, Column]:
    stations = F.filter(every(text, P.RUN, 0), lambda r: F.endswith(r, F.lit(P.STATION_END)))
    return {
        "train_no": F.concat(first(text, P.TRAIN_NO, 1), first(text, P.TRAIN_NO, 2)), "travel_date": _dated(text, P.DATE), "price": first(text, P.PRICE),
        "passenger_name": first(text, P.PERSON), "passenger_id_no": first(text, P.ID_NO), "seat_class": first(text, P.SEAT),
        "from_station": F.get(stations, 0), "to_station": F.get(stations, 1),
    }


def train_list(text: Column) -> Column:
    """train_values() as a list of fields, by one pass over the text."""
    station = f"(?<![一-龥])([一-龥]*{P.STATION_END})(?![一-龥])"
    patterns = [P.TRAIN_NO, P.DATE, P.PRICE, P.PERSON, P.ID_NO, P.SEAT, f"{station}(?:{FAR}{station})?"]

    def listed(v: Column) -> Column:
        at = lambda k: F.get(v, k)
        return _listed(P.TRAIN, {"train_no": F.concat(at(0), at(1)), "travel_date": _date(v, 2), "price": at(5), "passenger_name": at(6), "passenger_id_no": at(7), "seat_class": at(8),
                                 "from_station": at(9), "to_station": at(10)})

    return let(searched(text, patterns, 11), listed)


def flight_list(text: Column) -> Column:
    """flight_values() of the compatible route as a list of fields, by one pass over the text."""
    patterns = [P.FLIGHT_NO, P.DATE, P.PERSON, P.TICKET_NO, P.PRICE, P.FUEL, P.AIRPORT_FEE, f"({P.ROUTE})"]

    def more(v: Column) -> Column:
        route = F.get(v, 9)
        return F.struct(v.alias("v"), F.when(route == "", every(text, P.RUN, 0)).when(route.rlike(P.ARROWS), F.split(route, P.ARROWS)).alias("ends"))

    def listed(f: Column) -> Column:
        at, end = (lambda k: F.get(f["v"], k)), (lambda k: trim_u(F.get(f["ends"], k)))
        return _listed(P.FLIGHT, {"flight_no": at(0), "departure": end(0), "arrival": end(1), "flight_date": _date(f["v"], 1), "passenger_name": at(4), "ticket_no": at(5), "price": at(6),
                                  "fuel_surcharge": at(7), "airport_fee": at(8)})

    return let(let(searched(text, patterns, 10), more), listed)


def flight_values(text: Column, route: str = "compat") -> dict[str, Column]:
    """route: 'compat' reads the first two neighbouring ideographs as a route, as documents of this kind have always been
    read; 'fixed' takes the first route that has an arrow."""
    runs = every(text, P.RUN, 0)
    if route == "fixed":
        found = first(text, P.ROUTE.replace("(?:[→\\-—>]\\s*)?[一-龥]", "[→\\-—>]\\s*[一-龥]+"), 0)
        ends = F.when(found.isNotNull(), F.split(found, P.ARROWS)).otherwise(runs)
    else:
        found = first(text, P.ROUTE, 0)
        ends = F.when(found.isNull(), runs).when(found.rlike(P.ARROWS), F.split(found, P.ARROWS))
    return {
        "flight_no": first(text, P.FLIGHT_NO), "departure": F.get(ends, 0), "arrival": F.get(ends, 1), "flight_date": _dated(text, P.DATE),
        "passenger_name": first(text, P.PERSON), "ticket_no": first(text, P.TICKET_NO), "price": first(text, P.PRICE),
        "fuel_surcharge": first(text, P.FUEL), "airport_fee": first(text, P.AIRPORT_FEE),
    }


#: kind -> function of a text column that gives its fields; users may add kinds of their own.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {}


def register(kind: str, extract: Callable[[Column], Column]) -> None:
    """Adds or replaces the fields function of a kind; it must return FIELD."""
    EXTRACTORS[kind] = extract


register(P.VAT, vat_list)
register(P.TRAIN, train_list)
register(P.FLIGHT, flight_list)


def fields_of(kind: Column, text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Fields in order; only the branch of the row's kind is evaluated. Other kinds have none, nor have those not among kinds, if given."""
    out = F.array().cast(FIELD)
    for name, extract in EXTRACTORS.items():
        if kinds is not None and name not in kinds:
            continue
        out = F.when(kind == name, extract(text).cast(FIELD)).otherwise(out)
    return out
