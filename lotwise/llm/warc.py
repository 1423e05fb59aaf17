"""WARC archives of captures in which equal payloads are stored once.

Headers are shuffled by payload digest; of equal payloads one capture stays a response and the others become revisits of
it, with fresh headers.  Only responses carry their payload, so texts are shuffled once, to meet their header.  Archives
are written by Spark's own text sink (one record a row), which commits whole tasks and writes to any file system that
Spark knows; they are read back as whole files whose records are cut by their stated lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import nonempty, written

END = "\r\n"
#: Between records; Spark's sink puts it after every row.
BETWEEN = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Named fields of a capture that WARC doesn't have.
PAGE_FIELD = "X-Page-Id"
#: Digits of base 32.
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Parts into which captures of one payload, or revisits of one response, are dealt.
PARTS = 256

RECORD = "record_id string, record_type string, uri string, date string, page_id string, digest string, refers_to string, payload_bytes long, payload binary"


def base32(digest: Column) -> Column:
    """40 hexadecimal digits in base 32: every five of them are four digits of it."""
    fives = F.array(*(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 10).cast("int") for k in range(8)))
    digit = lambda v, s: F.substring(F.lit(_DIGITS), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(fives, lambda v: F.concat(*(digit(v, s) for s in (15, 10, 5, 0)))), "")


def met(rows: DataFrame, found: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """``rows`` left-joined with ``found``, which has ``key`` once; rows of one key, however many, are dealt to ``PARTS`` tasks by ``spread``."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(PARTS)).cast("int"))
    placed = dealt.select(key, "_part").distinct().join(found, key)
    return dealt.join(placed, [key, "_part"], "left").drop("_part")


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, copies): captures by what sets them apart, rows equal in all three counted."""
    return pages.select("page_id", "url", "payload_bytes", "digest").groupBy("page_id", "url", "digest", "payload_bytes").agg(F.count("*").alias("copies"))


def decided(heads: DataFrame, least: int) -> DataFrame:
    """Headers with ``original``, the (page_id, url) of the capture that holds the payload; null for payloads under ``least`` bytes."""
    one = F.max(F.struct("page_id", "url")).alias("original")
    shared = heads.where(F.col("payload_bytes") >= least)
    by_part = shared.groupBy("digest", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).alias("some")).agg(one)
    return met(heads, by_part.groupBy("digest").agg(F.max("original").alias("original")), "digest", ["page_id", "url"])


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, none for null; line ends within the value are percent-encoded."""
    text = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), text)


def _records(rows: DataFrame, kind: str, date: str) -> DataFrame:
    """Records as they stand in an archive (one string a row), of rows with page_id, url, digest, payload_bytes, copy, original and payload (responses only)."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    fields = [
        F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.lit(kind), F.col("copy"))), F.lit(f"WARC-Date: {date}"),
        _field("WARC-Target-URI", F.col("url")), _field(PAGE_FIELD, F.col("page_id")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
    ]
    if kind == "revisit":
        of = F.col("original")
        fields += [F.lit(f"WARC-Profile: {PROFILE}"), _field("WARC-Refers-To", _record_id(of["page_id"], of["url"], F.col("digest"), F.lit("response"), F.lit(1))), _field("WARC-Refers-To-Target-URI", of["url"]), F.lit(f"WARC-Refers-To-Date: {date}")]
    block = F.octet_length(http) + (F.octet_length("payload") if kind == "response" else 0)
    fields += [F.lit("Content-Type: application/http;msgtype=response"), _field("Content-Length", block)]
    whole = [F.concat_ws(END, *fields).cast("binary"), F.lit(END + END).cast("binary"), http.cast("binary"), *([F.col("payload")] if kind == "response" else [])]
    return rows.select(F.concat(*whole).cast("string").alias("value"))


def _copies(rows: DataFrame, start: int) -> DataFrame:
    """A row for each copy from number ``start`` on; copies of one row are dealt out by thousands."""
    thousands = rows.withColumn("_from", F.explode(F.sequence(F.lit(start).cast("long"), F.col("copies"), F.lit(1000).cast("long"))))
    dealt = thousands.repartition("page_id", "digest", "_from")
    return dealt.withColumn("copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + 999, F.col("copies"))))).drop("_from")


def archive(pages: DataFrame, path: str, least: int = 0, payload: str = "html", date: str | None = None, compression: str = "gzip", per_file: int = 20_000) -> None:
    """Write a record per row of ``pages`` (page_id, url and the ``payload`` column, text or bytes) to archives under ``path``.

    Of rows with equal payloads of ``least`` bytes or more that of the largest page_id (then url; null is the smallest)
    is a response, the others revisit it; smaller payloads are all responses.  A null payload is empty.  Rows equal in
    page_id, url and payload have a record each: one holds the payload, the others revisit it too.  A null page_id or url has no field; line
    ends in a url are written as %0D and %0A.  Other columns are not read, whatever their names.  Without rows there is
    a folder without records.  A file has at most ``per_file`` records.
    """
    held = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", held.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = written(decided(written(headers(rows), "captures"), least), "headers")
    here = F.struct("page_id", "url")
    alone = F.col("original").isNull()
    owner = alone | F.col("original").eqNullSafe(here)
    keys = ("page_id", "url", "digest")

    def payloads(of: DataFrame) -> DataFrame:
        right = of.select(*(F.col(k).alias(f"_{k}") for k in keys), "copies", "original")
        return rows.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))

    responses = payloads(heads.where(owner & (F.col("copies") == 1))).withColumn("copy", F.lit(1))
    revisits = heads.where(~owner & (F.col("copies") == 1)).withColumn("copy", F.lit(1))
    again = heads.where("copies > 1")
    if not again.isEmpty():  # rows that are repeated in full
        one = payloads(again.where(owner)).groupBy(*keys, "payload_bytes", "copies", "original").agg(F.first("payload").alias("payload"))
        responses = responses.unionByName(one.where(~alone).withColumn("copy", F.lit(1))).unionByName(_copies(one.where(alone), 1), allowMissingColumns=True)
        revisits = revisits.unionByName(_copies(again.where(~owner), 1)).unionByName(_copies(again.where(owner & ~alone), 2))
    both = _records(responses, "response", date).unionByName(_records(revisits, "revisit", date))
    both.write.option("lineSep", BETWEEN).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


_HEADER_END = re.compile(rb"\r\n\r\n")


class _Reader:
    """Records of one archive, plain or gzipped (as a whole or record by record), cut by their stated lengths."""

    def __init__(self, content: pa.Scalar):
        self.raw, self.at, self.buffer, self.pos = memoryview(content.as_buffer()), 0, bytearray(), 0
        self.packed = zlib.decompressobj(31) if bytes(self.raw[:2]) == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Take in another piece of the file; False at its end."""
        if self.at >= len(self.raw) and not (self.packed and self.packed.unused_data):
            return False
        if self.packed is None:
            self.buffer += self.raw[self.at : self.at + (1 << 20)]
            self.at += 1 << 20
            return True
        if self.packed.eof:  # the next gzip member
            left, self.packed = self.packed.unused_data, zlib.decompressobj(31)
            if left:
                self.buffer += self.packed.decompress(left)
                return True
        self.buffer += self.packed.decompress(self.raw[self.at : self.at + (1 << 18)])
        self.at += 1 << 18
        return True

    def line_end(self) -> int:
        """Where the header that begins at ``pos`` ends; -1 at the end of the file."""
        begun = self.pos
        while True:
            at = self.buffer.find(b"\r\n\r\n", begun)
            if at >= 0:
                return at
            begun = max(self.pos, len(self.buffer) - 3)
            if not self.more():
                return -1

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            if self.pos > 1 << 20:
                del self.buffer[: self.pos]
                self.pos = 0
            while len(self.buffer) - self.pos < 4 and self.more():
                pass
            if len(self.buffer) <= self.pos:
                return
            at = self.line_end()
            lines = self.buffer[self.pos : max(at, self.pos)].decode("utf-8", "replace").split(END)
            if at < 0 or not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {bytes(self.buffer[self.pos : self.pos + 40])!r}")
            fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
            start = at + 4
            stop = start + int(fields["content-length"])
            while len(self.buffer) < stop + 4 and self.more():
                pass
            if len(self.buffer) < stop:
                raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
            yield fields, bytes(self.buffer[start:stop])
            self.pos = stop + 4


def _told(fields: dict[str, str], block: bytes, whole: bool) -> tuple:
    """The row of :data:`RECORD`; raises if a response's payload hasn't the digest that its header states."""
    kind, payload = fields.get("warc-type"), block
    stated = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    if fields.get("content-type", "").startswith("application/http"):
        payload = block[_HEADER_END.search(block).end() :]
    held = kind != "revisit"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if held else stated
    if kind == "response" and stated and stated != digest:
        raise ValueError(f"record {fields.get('warc-record-id')} has digest {digest}, its header says {stated}")
    return (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), fields.get(PAGE_FIELD.lower()), digest, fields.get("warc-refers-to"), len(payload) if held else None, payload if held and whole else None)


def records(spark: SparkSession, path: str, payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of the archives under ``path``, in the columns of :data:`RECORD`; payloads only if asked for.

    A revisit has no payload of its own: see :func:`resolved`.  A damaged archive raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("page_id", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in nonempty(batches):
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in _Reader(content):
                    rows.append(_told(fields, block, payload))
                    size += len(block) if payload else 200
                    if size > batch_bytes:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def resolved(found: DataFrame) -> DataFrame:
    """Records with ``of_page`` and, for revisits, the digest, length and payload of the response that they refer to.

    A revisit whose response isn't there keeps its stated digest, with null length, payload and ``of_page``.
    """
    answers = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of_page"), F.struct("digest", "payload_bytes", "payload").alias("full"))
    revisits = met(found.where("record_type = 'revisit'"), answers, "refers_to", ["record_id"])
    full = [F.coalesce(F.col("full")[c], F.col(c)).alias(c) for c in ("digest", "payload_bytes", "payload")]
    rest = [c for c in found.columns if c not in ("digest", "payload_bytes", "payload")]
    return revisits.select(*rest, *full, "of_page").unionByName(found.where("record_type IS NULL OR record_type <> 'revisit'").withColumn("of_page", F.lit(None).cast("string")))
