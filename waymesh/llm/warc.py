"""WARC archives: writing records with revisits, and a reader whose tasks each scan a byte range.

An archive is a sequence of gzip members, one a record. Spark's text source splits files by size and
hands each task the pieces of its byte range that stand between occurrences of the gzip magic; a
piece belongs to the range in which its magic starts, and reaches beyond the range's end if need be.
A piece continues the member before it while that has not ended (the magic then stood inside
compressed data); at the start of a range, where no member is open, a piece is a member only if its
header decodes and its first inflated bytes are a WARC version line. What continues a member of the
range before, and members that are still open at the end of a range, are stitched per file
afterwards. All access is by Spark's readers and writers, so any store that Spark knows will do.

Members are written by the same source: its line separator, one zero byte, is the last byte of a
member (the top of its length), so nothing stands between members. Only a record of 16 MiB or more
has another last byte there; a zero byte of padding, which gzip allows, then follows it."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_dir, written

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/"
LEAST_REVISIT, LEVEL, DATE = 1000, 3, "2000-01-01T00:00:00Z"
RECORD = "kind string, file string, start long, seq long, raw binary, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to: of equal payloads of at least `least` bytes the one with the largest page_id is the response, the others revisit it.

    A null html is an empty payload. Rows that share the largest id are all responses, and so are
    all rows of a group without any id."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = (F.col("payload_bytes") >= least) & F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return rows.join(groups, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last_id")).alias("refers_to")
    )


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    """A gzip member, less its last byte where the separator will stand for it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = packer.compress(record) + packer.flush()
    return whole[:-1] if whole[-1] == 0 else whole


def _page_record(page_id: int | None, url: str | None, html: str, digest: str, kind: str, refers_to: int | None) -> bytes:
    payload = html.encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, http if kind == "revisit" else http + payload)


def write_warc(records: DataFrame, path: str, level: int = LEVEL) -> None:
    """One archive for each partition of what with_revisits() gives; each begins with a warcinfo record."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            out = [_member(_record([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level)] if first else []
            first = False
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to")]
            out += [_member(_page_record(*row), level) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = records.mapInArrow(packed, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}


def _page_id(urn: bytes | None) -> int | None:
    number = (urn or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(number) if number.lstrip(b"-").isdigit() else None


def decoded(data: bytes, payloads: bool) -> Iterator[dict]:
    """The response and revisit records of an inflated member. A digest that does not fit its payload is an error."""
    at = 0
    while data.startswith(VERSION, at):
        end = data.index(b"\r\n\r\n", at)
        fields = _fields(data[at:end])
        block = data[end + 4 : end + 4 + int(fields[b"content-length"])]
        at = end + 8 + len(block)
        kind = fields[b"warc-type"].decode()
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = base64.b32decode(fields[b"warc-payload-digest"].removeprefix(b"sha1:")).hex()
        size = int(_fields(http).get(b"content-length", b"0"))
        if kind == "response":
            size = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields[b'warc-record-id']!r} does not have its digest")
        url = fields.get(b"warc-target-uri")
        yield {
            "page_id": _page_id(fields.get(b"warc-record-id")), "url": url and url.decode().replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "record_type": kind, "refers_to": _page_id(fields.get(b"warc-refers-to")),
            "payload_bytes": size, "payload_digest": digest, "payload": payload if payloads and kind == "response" else None,
        }


class _Scan:
    """The members of one run of pieces that follow each other in a file."""

    def __init__(self, sure: bool) -> None:
        #: Whether the first piece is known to be a member's start (a file's beginning).
        self.sure, self.pieces, self.loose = sure, [], []
        self.inflater, self.out = None, bytearray()

    def _starts(self, piece: bytes) -> bool:
        try:
            return VERSION.startswith(zlib.decompressobj(31).decompress(piece, len(VERSION))[: len(VERSION)])
        except zlib.error:
            return False

    def add(self, piece: bytes) -> list[bytes]:
        """The inflated members that end with this piece."""
        found, queue = [], [piece]
        while queue:
            piece = queue.pop(0)
            if self.inflater is None:
                if not self.sure and not self._starts(piece):
                    self.loose.append(piece)
                    continue
                self.inflater, self.out, self.pieces = zlib.decompressobj(31), bytearray(), []
            self.pieces.append(piece)
            try:
                self.out += self.inflater.decompress(piece)
                if not VERSION.startswith(bytes(self.out[: len(VERSION)])):
                    raise zlib.error
            except zlib.error:  # no member after all, or a damaged one: what follows its first piece is looked at again
                self.inflater, self.sure = None, False
                self.loose.append(self.pieces[0])
                queue = self.pieces[1:] + queue
                continue
            if self.inflater.eof:
                found.append(bytes(self.out))
                self.inflater, self.sure = None, True
        return found

    def rest(self) -> bytes:
        """What continues the range before, and a member that has not ended."""
        return b"".join(self.loose + (self.pieces if self.inflater is not None else []))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)


def _scanned(payloads: bool):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, here = _Scan(True), None

        def left() -> list[dict]:
            return [{"kind": "part", "file": here[0], "start": here[1], "seq": i, "raw": x} for i, x in enumerate([scan.rest()]) if x]

        for batch in batches:
            rows = []
            for value, file, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if here != (file, start):
                    rows += left()
                    scan, here = _Scan(start == 0), (file, start)
                    if start == 0 and not value:
                        continue  # before the first magic
                for member in scan.add(MAGIC + value):
                    rows += [{"kind": "record", **r} for r in decoded(member, payloads)]
            yield _batch(rows)
        if here:
            yield _batch(left())

    return members


def _stitched(payloads: bool):
    def members(parts):
        parts, scan, rows = parts.sort_values("start"), _Scan(False), []
        for piece in (MAGIC + x for x in b"".join(parts["raw"]).split(MAGIC)[1:]):
            for member in scan.add(piece):
                rows += [{"kind": "record", **r} for r in decoded(member, payloads)]
        return _batch(rows).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return members


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and (null for revisits, and for all without `payloads`) payload of every record.

    Size and digest of a response are those of its payload as read; a revisit carries them in its headers."""
    separator = {"lineSep": MAGIC.decode("latin-1"), "encoding": "ISO-8859-1"}
    pieces = spark.read.options(**separator).text(path).select(F.col("value").cast("binary"), "_metadata.file_path", "_metadata.file_block_start")
    found = written(pieces.mapInArrow(_scanned(payloads), RECORD), "warc")
    mended = found.where("kind = 'part'").groupBy("file").applyInPandas(_stitched(payloads), RECORD)
    every = found.where("kind = 'record'").unionByName(mended)
    return every.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of all pages, and what reading them back gives: one row per page; an empty table gives none. Other columns are not read."""
    spark = pages.sparkSession
    path = fresh_dir(spark, "archive")
    write_warc(with_revisits(pages), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
