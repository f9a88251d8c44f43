"""Operator 9: WARC records, and not-modified revisits resolved by an as-of join.

A revisit (304) stands for the latest earlier full response of the same canonical
url: of the one that a revisit refers to, where it names it.  The join is by url and time
slot: each (url, slot) keeps its last response by a map-side maximum, a window over a
url's slots (MOST_SLOTS at most, as many as there are SLOT_ROWS records) carries it forward, and only revisits and responses of one
slot meet row by row.  Slots hold equal parts of all records (approximate quantiles of
the times), so that one url with a third of all records is spread over them, and a few
odd times don't bring all others into one.

Defined results: a url that is null or has no `://` is canonically empty and never
joined, nor are null times (state `missing`); very long urls and header values are taken
whole; other columns of the table are neither read nor returned; repeated revisits each
get their row; only responses of status 200 are full; of responses of one time the
greatest record_id is the latest; a response of the revisit's own time isn't earlier; of header fields
whose names differ in case alone the one whose name is last in code-point order counts (lower case before upper).
States: `resolved` (entity tags agree, or without them the modification dates),
`unverified` (no validator on both sides), `mismatch`, `missing`.  Headers are merged
where resolved or unverified: those a 304 may carry replace the stored ones."""

from __future__ import annotations

import io
import itertools
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.common import lower_ascii, require

#: Records of a slot, and slots at most: a url with all of them has a share of this many rows to a task.
SLOT_ROWS, MOST_SLOTS = 200_000, 10_000
#: The header fields that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't name content.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)="


def canonical_url(url: Column) -> Column:
    """Scheme, `www.`, fragment, default port, tracking parameters and a final slash go; parameters are sorted."""
    u = F.coalesce(url, F.lit(""))
    h = lower_ascii(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))
    h = F.regexp_replace(F.regexp_replace(h, r"^www\.", ""), r":(80|443)$", "")
    p = F.regexp_replace(F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), r"/+$", "")
    q = F.regexp_extract(u, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(q, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(h, p, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _slot(ts: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are ts or less, by halving; null times are in slot 0."""
    if not cuts:
        return F.lit(0)
    at, start = F.lit(cuts), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(x: Column, _: Column) -> Column:
        mid = F.floor((x["lo"] + x["hi"]) / 2).cast("int")
        left = (x["lo"] < x["hi"]) & (ts < F.get(at, mid))
        return F.struct(F.when(left | (x["lo"] >= x["hi"]), x["lo"]).otherwise(mid + 1).alias("lo"), F.when(left, mid).otherwise(x["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.when(ts.isNull(), 0).otherwise(F.aggregate(steps, start, halve, lambda x: x["lo"]))


def _head(headers: Column) -> Column:
    """Header fields by lower-cased name, one value a name."""
    each = F.array_sort(F.map_entries(headers))
    names = F.array_sort(F.array_distinct(F.transform(each, lambda e: F.lower(e["key"]))))
    one = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(each, lambda e: F.lower(e["key"]) == n), -1)["value"].alias("value")))
    return F.coalesce(one, F.array().cast("array<struct<key:string,value:string>>"))


def resolve_revisits(records: DataFrame, slots: int | None = None) -> DataFrame:
    """records: record_id, url, ts (long), kind (`response` or `revisit`), status, etag, last_modified,
    headers map<string,string>, and refers_url, if there is such a column.  One row per revisit: record_id, canonical, state, response_id, headers."""
    require(records, "record_id", "url", "ts", "kind", "status", "etag", "last_modified", "headers")
    url = F.col("url")
    if "refers_url" in records.columns:
        url = F.coalesce(F.when(F.col("kind") == "revisit", F.col("refers_url")), url)
    r = records.select("record_id", canonical_url(url).alias("canonical"), F.col("ts").cast("long").alias("ts"), "kind", "status", "etag", "last_modified", _head(F.col("headers")).alias("head"))
    slots = slots or min(MOST_SLOTS, records.count() // SLOT_ROWS + 1)
    cuts = records.agg(F.percentile_approx(F.col("ts").cast("long"), [i / slots for i in range(1, slots)], max(10_000, 4 * slots))).first()[0] if slots > 1 else None
    r = r.withColumn("slot", _slot(F.col("ts"), sorted(set(cuts or []))))
    full = F.when((F.col("canonical") != "") & (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "head"))
    r = r.withColumn("full", full).where(F.col("full").isNotNull() | (F.col("kind") == "revisit"))
    last = r.groupBy("canonical", "slot").agg(F.max("full").alias("last"))
    carry = last.withColumn("carried", F.max("last").over(Window.partitionBy("canonical").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    near = F.max("full").over(Window.partitionBy("canonical", "slot").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1))
    rev = r.withColumn("near", near).where("kind = 'revisit'").drop("full")
    got = F.when(F.col("ts").isNotNull(), F.coalesce("near", "carried"))
    m = rev.join(carry, ["canonical", "slot"], "left").withColumn("got", got)
    tags = F.col("etag").isNotNull() & F.col("got.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("got.last_modified").isNotNull()
    agree = F.when(tags, _weak(F.col("etag")) == _weak(F.col("got.etag"))).when(dates, F.col("last_modified") == F.col("got.last_modified"))
    state = F.when(F.col("got").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    update = F.filter("head", lambda e: e["key"].isin(*PERMITTED))
    stored = F.filter("got.head", lambda e: ~F.array_contains(F.transform(update, lambda u: u["key"]), e["key"]))
    merged = F.when(F.col("state").isin("resolved", "unverified"), F.array_sort(F.concat(stored, update)))
    return m.withColumn("state", state).select("record_id", "canonical", "state", F.col("got.record_id").alias("response_id"), F.map_from_entries(merged).alias("headers"))


def captures(pages: DataFrame, later: int = 500) -> DataFrame:
    """The pages as a crawl: page p is fetched in full at second p (record 2p) and asked for again
    `later` seconds on, when the server answers 304 with that page's entity tag (record 2p + 1)."""
    require(pages, "page_id", "url", "html")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    p = pages.select("page_id", "url", tag.alias("etag"), F.coalesce(F.length("html"), F.lit(0)).alias("n"))
    rows = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") + later).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status")),
    )
    p = p.select("url", "etag", "n", F.explode(rows).alias("r")).select("r.*", "url", "etag", "n")
    own = F.when(F.col("kind") == "response", F.map_from_arrays(F.array(F.lit("Content-Type"), F.lit("Content-Length")), F.array(F.lit("text/html"), F.col("n").cast("string"))))
    own = F.coalesce(own, F.map_from_arrays(F.array(F.lit("Content-Length"), F.lit("Cache-Control")), F.array(F.lit("0"), F.lit("max-age=60"))))
    stamp = F.map_from_arrays(F.array(F.lit("Date")), F.array(F.col("ts").cast("string")))
    return p.select("record_id", "url", "ts", "kind", "status", "etag", F.lit(None).cast("string").alias("last_modified"), F.map_concat(own, stamp).alias("headers"))


class _Members(io.RawIOBase):
    """The content of gzip members one after the other, some at a time; it ends where one is broken."""

    def __init__(self, data: bytes):
        self.rest, self.z = memoryview(data), zlib.decompressobj(31)
        self.held = b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.held and len(self.rest):
            try:
                step = bytes(self.rest[: 1 << 16])
                self.held = self.z.decompress(step, 1 << 20)
            except zlib.error:
                self.rest = self.rest[:0]
                break
            left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.rest = self.rest[len(step) - len(left) :]
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            elif not len(self.rest) and not self.held:
                break
        n = min(len(out), len(self.held))
        out[:n] = self.held[:n]
        self.held = self.held[n:]
        return n


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, gzip members or plain; broken tails end the iteration."""
    f = io.BufferedReader(_Members(data), 1 << 16) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        n = head.get("content-length", "")
        body = f.read(int(n) if n.isdigit() else 0)
        http, sep, rest = body.partition(b"\r\n\r\n")
        lines = http.decode("utf-8", "replace").split("\r\n") if sep and http.startswith(b"HTTP/") else []
        status = lines[0].split(" ")[1] if lines and len(lines[0].split(" ")) > 1 else ""
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        yield {
            "record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"), "refers_url": head.get("warc-refers-to-target-uri"), "date": head.get("warc-date"), "kind": head.get("warc-type"),
            "status": int(status) if status.isdigit() else None, "etag": fields.get("etag"), "last_modified": fields.get("last-modified"), "headers": fields, "payload": rest if lines else body,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under path, read by Spark. A file as it is stored is held in one task's memory (they are 1 GB by
    custom, and Spark reads none over 2 GB); its content is unpacked some at a time."""
    kinds = "record_id string, url string, refers_url string, date string, kind string, status int, etag string, last_modified string, headers map<string,string>, payload binary"

    def run(frames):
        for f in frames:
            for data in f["content"]:
                for rows in _grouped(parse_warc(data), 256):
                    yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, kinds)


def _grouped(it: Iterator[dict], n: int) -> Iterator[list[dict]]:
    while rows := list(itertools.islice(it, n)):
        yield rows


def write_record(kind: str, record_id: str, url: str, date: str, status: int, headers: dict[str, str], payload: bytes) -> bytes:
    """One WARC record as bytes."""
    http = f"HTTP/1.1 {status} {'OK' if status == 200 else 'Not Modified'}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    body = http.encode() + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"
