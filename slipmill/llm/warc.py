"""WARC archives: written with revisit records for equal payloads, and read back by boundary-chain verification.

Writing. The SHA-1 of each payload is grouped to the smallest id; that record is the response, the others refer to it.
Only repeated
digests are kept; up to a checked number they are broadcast, beyond it payloads cross one shuffle, compressed. Spark's text writer commits the files, with the blank lines that end a record
as its line separator, so a lost executor leaves no half record.

Reading. Files are split anywhere. Spark's text reader cuts each split at the magic line ``WARC/1.1``; a piece between
two magic lines is a candidate record, its header names the offset of its successor. A task works out for each candidate
of its split where the chain that starts there leaves the split. Over the splits of a file, pointer jumping (the jump
table is squared each round) marks what the chain from the file's start enters; within each split the chain from there
is followed. A magic line inside a payload is never entered, so it is rejected, and the pieces of such a payload are put
together again. What is not reachable from the start of a file is not returned.

Defined cases: null payloads are empty; payloads shorter than ``least`` bytes are all responses; null ids are written
without an id, never referred to, and are responses if they have no smaller id to refer to; rows that repeat an id with the
same payload are responses alike; control characters in uris are percent-encoded; other columns do not matter; an empty
table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slipmill.llm._shared import cut, map_rows, shared_dir

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Time stamp of written records; archives of equal pages are equal.
DATE = "1970-01-01T00:00:00Z"
#: Most repeated digests that are broadcast (about 100 bytes each); with more of them payloads are shuffled to the digests.
SMALL = 500_000
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: str, digest: str, refers_to: int | None) -> str:
    """A record without the blank lines at its end."""
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url:
        head.append(f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    return "\r\n".join([*head, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block.encode())}", "", block])


def write(pages: DataFrame, path: str, least: int = 0, records: int = 20_000) -> None:
    """Archives of pages (page_id, url, html) under path; at most ``records`` records a file."""
    html = F.coalesce(F.col("html"), F.lit(""))
    marked = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    firsts = pages.select("page_id", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n")).where(F.col("n") >= least)
    firsts = firsts.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1").select("sha", "first")
    firsts = cut(firsts)
    if firsts.count() <= SMALL:  # no payload is shuffled then
        firsts = F.broadcast(firsts)

    def pack(batch: dict) -> dict:
        return {k: batch[k] for k in ("page_id", "url", "sha")} | {"body": [zlib.compress(t.encode(), 1) for t in batch["html"]]}

    def build(batch: dict) -> dict:
        out = []
        for i, url, body, sha, first in zip(*(batch[k] for k in ("page_id", "url", "body", "sha", "first")), strict=True):
            out.append(record(i, url, zlib.decompress(body).decode(), sha, None if first is None or i == first else first))
        return {"value": out}

    packed = map_rows(marked, pack, "page_id long, url string, sha string, body binary", ["page_id", "url", "html", "sha"])
    joined = packed.join(firsts, "sha", "left")
    map_rows(joined, build, "value string", ["page_id", "url", "body", "sha", "first"]).write.option("lineSep", END.decode()).option(
        "maxRecordsPerFile", records).text(path)


def header(piece: bytes) -> tuple[dict, int] | None:
    """Fields (lower-cased names) of the record that starts with a piece and where its block starts; None if it is none."""
    end = piece.find(END)
    if end < 0:
        return None
    fields = dict(x.split(b":", 1) for x in piece[:end].split(b"\r\n") if b":" in x)
    fields = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in fields.items()}
    return (fields, end + len(END)) if fields.get("content-length", "").isdecimal() and "warc-type" in fields else None


def _payload(block: bytes) -> bytes:
    """An HTTP block's body."""
    at = block.find(END)
    return block[at + len(END) :] if block.startswith(b"HTTP/") and at >= 0 else block


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, offset of the piece's magic line from where the split's pieces start, piece) in the order of the split."""
    place, at = None, 0
    for batch in batches:
        for file, block, value in zip(*(batch.column(i) for i in range(3)), strict=True):
            file, block, piece = file.as_py(), block.as_py(), value.as_py()
            if (file, block) != place:
                place, at = (file, block), 0
            yield file, block, at - len(MAGIC), piece
            at += len(piece) + len(MAGIC)


_FIELDS = ("record_id", "record_type", "uri", "refers_to", "stated_digest")
_SCHEMA = f"file string, block long, rel long, size long, next long, leaves long, whole boolean, {', '.join(f'{f} string' for f in _FIELDS)}, payload_bytes long, payload_digest string"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []

    def ended() -> pa.RecordBatch:
        leaves: dict[int, int] = {}
        for r in reversed(rows):
            if r["next"] is not None:
                r["leaves"] = leaves[r["rel"]] = leaves.get(r["next"], r["next"])
        out = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        rows.clear()
        return out

    for file, block, rel, piece in _placed(batches):
        if rows and (rows[0]["file"], rows[0]["block"]) != (file, block):
            yield ended()
        row = {"file": file, "block": block, "rel": rel, "size": len(piece), "next": None, "leaves": None, "whole": False}
        if found := header(piece):
            fields, start = found
            n = int(fields["content-length"])
            row["next"] = rel + len(MAGIC) + start + n + len(END)
            row |= {"record_id": fields.get("warc-record-id"), "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"),
                    "refers_to": fields.get("warc-refers-to"), "stated_digest": fields.get("warc-payload-digest")}
            if start + n <= len(piece):
                payload = _payload(piece[start : start + n])
                row |= {"whole": True, "payload_bytes": len(payload), "payload_digest": _digest(payload)}
        rows.append(row)
    if rows:
        yield ended()


_ARROW = pa.schema([(x.rsplit(" ", 1)[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.rsplit(" ", 1)[1]]) for x in _SCHEMA.split(", ")])


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one split, reached: on the chain from where the split is entered."""
    after = dict(zip(pdf["rel"], pdf["next"], strict=True))
    at, chain = pdf["entry"].iloc[0], set()
    while not pd.isna(at) and at in after and not pd.isna(after[at]):
        chain.add(at)
        at = after[at]
    return pdf.assign(reached=pdf["rel"].isin(chain)).drop(columns=["next", "leaves", "entry"]).astype({"payload_bytes": "Int64"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, record_id, record_type, uri, refers_to, stated_digest, payload_bytes and payload_digest of every record."""
    found = cut(_pieces(spark, path).mapInArrow(_candidates, _SCHEMA))
    totals = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    base = cut(totals.select("file", "block", F.coalesce(F.sum("total").over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    placed = found.join(base, ["file", "block"])

    starts = base.select("file").distinct().select("file", F.lit(0).cast("long").alias("at"))
    targets = placed.where("leaves is not null").select("file", (F.col("base") + F.col("leaves")).alias("at")).union(starts).distinct()
    jump = cut(placed.where("leaves is not null").select("file", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("leaves")).alias("to")).join(targets, ["file", "at"]))
    reach, size = cut(starts), -1
    while (now := reach.count()) != size:
        size = now
        reach = cut(reach.union(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
        jump = cut(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "at", F.col("far").alias("to")))
    entries = placed.select("file", "block", "rel", (F.col("base") + F.col("rel")).alias("at")).join(reach, ["file", "at"]).groupBy("file", "block").agg(F.min("rel").alias("entry"))

    kept = ", ".join(x for x in _SCHEMA.split(", ") if x not in ("next long", "leaves long"))
    followed = found.join(entries, ["file", "block"], "left").groupBy("file", "block").applyInPandas(_follow, f"{kept}, reached boolean")
    known = cut(followed.join(base, ["file", "block"]).withColumn("offset", F.col("base") + F.col("rel")).drop("base"))
    records = known.where("reached")
    out = ["file", "offset", *_FIELDS, "payload_bytes", "payload_digest"]
    broken = records.where("not whole")
    if broken.limit(1).count():
        return records.where("whole").select(out).unionByName(_mended(spark, path, known).select(out))
    return records.select(out)


def _mended(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """The records whose payloads hold magic lines: their pieces are read again, alone, and joined in order."""
    some = known.where("not reached or not whole").select("file", "block", "rel", "offset", "reached")
    owner = F.last(F.when(F.col("reached"), F.col("offset")), ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))
    parts = cut(some.withColumn("owner", owner).where("owner is not null").select("file", "block", "rel", "offset", "owner"))
    parts = F.broadcast(parts) if parts.count() <= 100_000 else parts

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "rel", "piece"]
        for file, block, rel, piece in _placed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([rel], pa.int64()), pa.array([piece], pa.binary())], names=names)

    def mend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        data = MAGIC.join(pdf["piece"])
        fields, start = header(data)
        n = int(fields["content-length"])
        if start + n > len(data):
            raise ValueError(f"{pdf['file'].iloc[0]}: the record at {pdf['owner'].iloc[0]} is cut off")
        payload = _payload(data[start : start + n])
        return pd.DataFrame({"file": pdf["file"].iloc[:1], "offset": pdf["owner"].iloc[0], "payload_bytes": len(payload), "payload_digest": _digest(payload)})

    pieces = _pieces(spark, path).mapInArrow(again, "file string, block long, rel long, piece binary").join(parts, ["file", "block", "rel"])
    mended = pieces.groupBy("file", "owner").applyInPandas(mend, "file string, offset long, payload_bytes long, payload_digest string")
    return known.where("reached and not whole").drop("payload_bytes", "payload_digest").join(mended, ["file", "offset"])


def resolved(records: DataFrame) -> DataFrame:
    """read()'s records with page_id and refers_to as numbers; revisits get size and digest of the payload they refer to."""
    number = lambda c: F.regexp_extract(F.col(c), r"^<urn:page:(-?\d+)>$", 1)
    rows = cut(records.select(F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"), "record_type", F.nullif(number("refers_to"), F.lit("")).cast("long").alias("refers_to"),
                              F.regexp_replace("stated_digest", "^sha1:", "").alias("stated"), "payload_bytes", "payload_digest"))
    first = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated")).agg(F.max("payload_bytes").alias("n"))
    again = rows.where("record_type = 'revisit'").join(first, ["refers_to", "stated"], "left").select(
        "page_id", F.col("n").alias("payload_bytes"), F.when(F.col("n").isNotNull(), F.col("stated")).alias("payload_digest"), "record_type", "refers_to")
    return rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").union(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of pages to the shared folder, reads them and returns resolved()'s rows."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return resolved(read(spark, path))
