"""The registered queries of the corpus operators, op1 to op13, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmill.llm import chat, collocations, decontamination, extraction, licenses, packing, quality_knn, quality_rules, resampling, secrets, simhash, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_knn.train(docs, _read(spark, sf_dir, "labels"), _fold(3) != 1)
    return quality_knn.score(docs, model).select(
        "doc_id", (F.coalesce(_fold(3), F.lit(-1)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), _fold(5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (F.coalesce(_fold(5), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_read(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(_read(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.sort_array(F.array_distinct("leaks.item_id")).alias("item_ids"),
                        F.transform("leaks", lambda x: F.concat_ws(":", x["item_id"], x["start"], x["end"])).alias("leaks"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    signs = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", signs), (-7, 1, "assistant", signs)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(chat.log_of(table.union(planted)))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_quality, op3_toxicity, op4_quality_rules, op5_secrets, op6_warc, op7_packing, op8_licenses, op9_decontamination, op10_chat, op11_resampling, op12_extraction, op13_collocations)}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_WARC_SQL = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, octet_length(encode(body)) as n, sha1(body) as sha from p),
g as (select *, min(page_id) over (partition by sha) as first from h)
select page_id, n::bigint as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + (
           (('0x' || substr(sha, (5 * (i // 4) + 1)::bigint, 5))::bigint >> (5 * (3 - i % 4))::bigint) & 31)::bigint, 1)), '') as payload_digest,
       case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when first is null or page_id is not distinct from first then null else first end as refers_to
from g
"""


def _chat_sql() -> str:
    marks = "".join(f" when '{role}' then {len(a) + len(b)}" for role, (a, b) in chat.MARKS.items())
    signs = "|".join(re.escape(c).replace("/", "/") for c in chat.CONTROL)
    count = lambda x: f"len(regexp_extract_all({x}, '{signs}')) + len({x}) - len(replace({x}, chr(92), ''))"
    other = sum(map(len, chat.OTHER))
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as r, role, coalesce(text, '') as x from conversations
           union all select -7, 0, 'user', 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', 'assistant', '</s>[INST] ok [/INST]'),
m as (select *, len(x) + {count('x')} as body,
      case r{marks} else {other} + len(r) + {count('r')} + len(r) - len(replace(r, ' ', '')) end as frame from t)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, role nulls first, x)) as turns_sha256,
       coalesce(sum(len(x)) filter (where r = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(x, '' order by turn, x) filter (where r = 'assistant'), '')) as loss_sha256, sum(body + frame)::bigint as formatted_chars
from m group by conv_id
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 over the bytes of each distinct word, by a table that is made from the polynomial.
_RESAMPLING_SQL = rf"""
with crc as (select list(c order by k) as tab from (
       select k, list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, b: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c from range(256) t(k))),
split as (select 0 as src, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
          union all select 1, null, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
w as (select src, doc_id, unnest(ws) as word from split),
ids as (select word, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(word)) + 1),
            lambda i: ('0x' || substr(hex(encode(word)), (2 * i - 1)::bigint, 2))::bigint)), lambda c, b: xor(c >> 8, tab[(1 + (xor(c, b) & 255))::bigint]))) % 10000 as bucket
        from (select distinct word from w) cross join crc),
n as (select bucket, count(*) filter (where src = 0) as s, count(*) filter (where src = 1) as t from w join ids using (word) group by bucket),
total as (select sum(s) as s, sum(t) as t from n),
gain as (select bucket, floor(1000 * ln((n.t + 1)::double * (total.s + 10000)::double / ((n.s + 1)::double * (total.t + 10000)::double)))::bigint as gain from n cross join total),
sums as (select doc_id, count(*) as n, sum(gain) as g from w join ids using (word) join gain using (bucket) where src = 0 group by doc_id),
scored as (select d.doc_id, coalesce(n, 0)::bigint as n_features, coalesce(floor(g::double / n), 0)::bigint as weight,
                  ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint as h from documents d left join sums using (doc_id)),
final as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from scored),
able as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from final where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from final left join able using (doc_id)
"""


_COLLOCATION_SQL = rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as phrase from w cross join range(1, 6) t(k) where len(ws) >= k),
f as (select lang, phrase, k, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select *, string_split(phrase, ' ') as ws from f where k > 1 and f >= 100),
cuts as (select c.lang, c.phrase, c.k, c.f as a, cut, x.f as l, y.f as r, n.n, (1000::hugeint * c.f * n.n) // (x.f::hugeint * y.f) as score
         from c cross join range(1, 5) t(cut) join f x on x.lang = c.lang and x.phrase = array_to_string(ws[1 : cut], ' ')
         join f y on y.lang = c.lang and y.phrase = array_to_string(ws[cut + 1 : c.k], ' ') join n on n.lang = c.lang where cut < c.k),
least as (select lang, phrase, a, n, min(struct_pack(score := score, cut := cut, l := l, r := r)) as b from cuts group by lang, phrase, a, n),
best as (select lang, phrase, a, n, b.score as score, b.l as l, b.r as r from least),
inner_ as (select lang, array_to_string(ws[s : s + m - 1], ' ') as phrase, f from c cross join range(2, 5) t(m) cross join range(1, 5) u(s) where m < k and s + m - 1 <= k),
covered as (select lang, phrase, max(f) as f from inner_ group by all),
kept as (select best.* from best left join covered using (lang, phrase) where covered.f is null or 100 * covered.f < 100 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""


# The tables' pages have one article element each, with headings and paragraphs only, and three named references.
_EXTRACTION_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as body from pages),
b as (select page_id, url, regexp_split_to_array(body, '</?(?:h1|p)>') as blocks from a),
d as (select page_id, url, list_transform(blocks, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) as blocks from b),
t as (select page_id, url, array_to_string(list_filter(list_transform(blocks, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from d)
select page_id, url, text, len(text)::bigint as n_chars from t
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": _WARC_SQL, "op10_chat": _chat_sql(), "op11_resampling": _RESAMPLING_SQL, "op12_extraction": _EXTRACTION_SQL, "op13_collocations": _COLLOCATION_SQL}


def __getattr__(name: str):
    if name == "ORACLE_SQL":
        return oracle_sql()
    raise AttributeError(name)
