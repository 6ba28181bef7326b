"""Legacy archives (ARC) and their conversion to WARC.

An ARC file begins with a version block whose first number says how its header lines are laid out: five fields in version 1,
ten in version 2. Each record is a header line and as many bytes as the line's last field declares. Conversion gives
every record what WARC asks for: an identifier derived from its content and place, an ISO timestamp, a type, and digests.
Of records with equal payloads the first is a response and the others are revisits that refer to it.

Archives are written and read by Spark's own writers and readers, in whatever file system the shared folder is: a record is
one value of a text file whose line separator is the bytes that end a record. Payloads are kept as bytes throughout.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_map, fresh_path, stash

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
#: Bytes of decoded records that a worker hands on at a time.
BATCH_BYTES = 4_000_000
#: How archives are written. The fastest level makes markup a tenth larger than the default and takes less than half the time.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}

# Layouts of the two versions' header lines, as their version blocks state them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ORIGIN = "inkwell"
DATE = "20240101000000"


class ArchiveError(ValueError):
    """An archive that does not follow its format."""


class Inflated:
    """Sequential reads of a gzip file (of one or many members) or a plain one, without inflating it at once."""

    def __init__(self, data: bytes):
        self.gz = data[:2] == b"\x1f\x8b"
        self.data, self.at = data, 0 if self.gz else len(data)
        self.buffer, self.start = b"" if self.gz else data, 0
        self.engine = zlib.decompressobj(31) if self.gz else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        if self.engine.eof:
            self.engine = zlib.decompressobj(31)
        piece = self.data[self.at : self.at + (1 << 17)]
        self.buffer, self.start = self.buffer[self.start :] + self.engine.decompress(piece), 0
        self.at += len(piece) - len(self.engine.unused_data)
        return True

    def line(self) -> bytes | None:
        """Up to the next newline, without it; None at the end."""
        while (end := self.buffer.find(b"\n", self.start)) < 0:
            if not self.more():
                rest, self.start = self.buffer[self.start :], len(self.buffer)
                return rest or None
        found, self.start = self.buffer[self.start : end], end + 1
        return found

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.start < n:
            if not self.more():
                raise ArchiveError(f"{n} bytes declared, {len(self.buffer) - self.start} left")
        found, self.start = self.buffer[self.start : self.start + n], self.start + n
        return found


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, either version: header fields by name in lower case, `payload`, `offset` (of the record, by count)."""
    source, fields, n = Inflated(data), None, 0
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        if parts[0].startswith("filedesc://"):
            block = source.take(int(parts[-1])).split(b"\n")
            version = int(block[0].split(b" ")[0])
            if version not in ARC_FIELDS:
                raise ArchiveError(f"version {version}")
            fields = [f.lower() for f in (block[1].decode().split(" ") if len(block) > 1 and block[1] else ARC_FIELDS[version].split(" "))]
            continue
        if fields is None:
            raise ArchiveError("no version block")
        # A URL with spaces makes a line longer than its version's; the other fields have none.
        extra = len(parts) - len(fields)
        if extra < 0:
            raise ArchiveError(f"header line of {len(parts)} fields")
        parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
        record = dict(zip(fields, parts))
        record["payload"] = source.take(int(record["archive-length"]))
        record["offset"] = n
        n += 1
        yield record


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file: headers by name in lower case, and the block."""
    source = Inflated(data)
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"record begins {line[:20]!r}")
        headers = {}
        while (line := source.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, source.take(int(headers["content-length"]))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def iso_date(arc_date: str) -> str:
    """14 digits (fewer: filled up) to a WARC date."""
    d = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(re.sub(r"\D", "", arc_date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, place: str) -> str:
    """An identifier that the same record of the same archive always gets."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join((url, date, digest, place)))}"


def _url(url: Column, tag: Column) -> Column:
    """No white space, as a header line needs; the page's id stays with it as a fragment."""
    return F.concat(F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\x00-\x20]", "%20"), F.lit("#page="), F.coalesce(tag.cast("string"), F.lit("")))


def write_arc(pages: DataFrame, path: str) -> None:
    """pages (page_id, url, html) as ARC files, gzipped, one per partition; even ones version 2, odd ones version 1. A null html is empty."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    length = F.octet_length(payload).cast("string")
    url = _url(F.col("url"), F.col("page_id"))
    part = F.spark_partition_id()
    header = F.when(part % 2 == 1, F.concat_ws(" ", url, F.lit("0.0.0.0"), F.lit(DATE), F.lit("text/html"), length)).otherwise(
        F.concat_ws(" ", url, F.lit("0.0.0.0"), F.lit(DATE), F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("page.arc"), length)
    )
    blocks = {v: f"{v} 0 {ORIGIN}\n{fields}\n" for v, fields in ARC_FIELDS.items()}
    start = {v: f"filedesc://page.arc 0.0.0.0 {DATE} text/plain {'200 - - 0 page.arc ' if v == 2 else ''}{len(b)}\n{b}\n" for v, b in blocks.items()}
    # The first row of a partition is the first of its file, and brings the version block.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    block = F.when(first, F.when(part % 2 == 1, F.lit(start[1])).otherwise(F.lit(start[2]))).otherwise(F.lit(""))
    record = F.concat(F.concat(block, header, F.lit("\n")).cast("binary"), payload)
    pages.select(record.cast("string").alias("value")).write.options(**GZIP).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """name, content of each archive, a file to a partition as far as the session's limit on partitions' bytes says."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _batched(rows: Iterator[tuple], sizes: int, names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    """rows in batches of about BATCH_BYTES of what their column number `sizes` holds."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sizes] or b"") + 200
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _page_id(url: str) -> int | None:
    tag = url.rpartition("#page=")[2]
    return int(tag) if re.fullmatch(r"-?\d+", tag) else None


ARC_ROWS = "record_id string, page_id long, url string, date string, mime string, digest string, length long, name string, place long, payload binary"
_ARC_NAMES = [c.split()[0] for c in ARC_ROWS.split(", ")]
_ARC_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def synthesised(name: str, content: bytes) -> Iterator[tuple]:
    """The records of an ARC file as ARC_ROWS: with identifiers, ISO timestamps and digests that ARC has not."""
    for r in read_arc(content):
        digest, date = base32_sha1(r["payload"]), iso_date(r["archive-date"])
        place = r["offset"]
        yield record_id(r["url"], date, digest, f"{name}/{place}"), _page_id(r["url"]), r["url"], date, r["content-type"], digest, len(r["payload"]), name, place, r["payload"]


def arc_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all ARC files of a folder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                for r in synthesised(name, content.as_py()):
                    yield r if with_payload else (*r[:-1], None)

    return arrow_map(_files(spark, path), lambda batches: _batched(rows(batches), 9, _ARC_NAMES, _ARC_TYPES), ARC_ROWS)


def typed(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """records with refers_to (the response's page_id), refers_id and refers_url: null for responses.

    Of records with equal payloads of at least `least` bytes the one with the smallest page_id (null last, then by record_id) is the response.
    """
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url")
    firsts = records.where(F.col("length") >= least).groupBy("digest", "length").agg(F.min(rank).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    firsts = firsts.select(F.col("digest").alias("_digest"), F.col("length").alias("_length"), "_first")
    joined = records.join(firsts, (records["digest"] == firsts["_digest"]) & (records["length"] == firsts["_length"]), "left")
    other = F.col("_first").isNotNull() & (F.col("_first.record_id") != F.col("record_id"))
    return joined.select(
        *records.columns,
        F.when(other, F.col("_first.page_id")).alias("refers_to"),
        F.when(other, F.col("_first.record_id")).alias("refers_id"),
        F.when(other, F.col("_first.url")).alias("refers_url"),
    )


def warc_record(row: tuple, refers: tuple[str, str] | None) -> bytes:
    """An ARC_ROWS row as a WARC record, without the line breaks that end it; refers: identifier and URL of the response that it repeats."""
    identifier, _, url, date, mime, digest, length, _, _, payload = row
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", f"<{identifier}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Identified-Payload-Type", mime),
        ("X-Payload-Length", str(length)),
    ]
    if refers:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields += [("WARC-Profile", profile), ("WARC-Refers-To", f"<{refers[0]}>"), ("WARC-Refers-To-Target-URI", refers[1])]
    fields += [("Content-Type", "message/http" if refers else mime), ("Content-Length", "0" if refers else str(length))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + (b"" if refers else payload)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_REVISIT) -> None:
    """Convert a folder of ARC files to one of WARC files, gzipped, a file for a file.

    The first of two passes over the archives writes what decides a record's type, not payloads. What is decided is written and goes to the files by
    name: by broadcast if what was written is below Spark's limit for that, so that files stay where they are, else by a
    join that moves compressed files. A file's decisions are as many as its records.
    """
    records = stash(arc_records(spark, arc_path, with_payload=False), "records")
    revisits = typed(records, least).where("refers_id is not null")
    decided = stash(revisits.groupBy(F.col("name").alias("_name")).agg(F.collect_list(F.struct("place", "refers_id", "refers_url")).alias("decided")), "decided")
    files = _files(spark, arc_path)
    joined = files.join(decided, files["name"] == decided["_name"], "left").select("name", "content", "decided")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for name, content, known in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                refers = {d["place"]: (d["refers_id"], d["refers_url"]) for d in known or ()}
                for r in synthesised(name, content.as_py()):
                    yield (warc_record(r, refers.get(r[8])),)

    records = arrow_map(joined, lambda batches: _batched(rows(batches), 0, ["record"], [pa.binary()]), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.options(**GZIP).option("lineSep", "\r\n\r\n").text(warc_path)


WARC_ROWS = "page_id long, record_id string, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_WARC_NAMES = [c.split()[0] for c in WARC_ROWS.split(", ")]
_WARC_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def warc_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all WARC files of a folder; a response's digest and length are those of the bytes read, and must be what its header says."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for content in b.column(1):
                for h, block in read_warc(content.as_py()):
                    url, kind = h["warc-target-uri"], h["warc-type"]
                    said, length = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                    if kind == "response" and (base32_sha1(block) != said or len(block) != length):
                        raise ArchiveError(f"digest of {h['warc-record-id']}")
                    refers = _page_id(h["warc-refers-to-target-uri"]) if kind == "revisit" else None
                    yield _page_id(url), h["warc-record-id"].strip("<>"), url, h["warc-date"], length, said, kind, refers, block if with_payload else None

    return arrow_map(_files(spark, path), lambda batches: _batched(rows(batches), 8, _WARC_NAMES, _WARC_TYPES), WARC_ROWS)


def archived(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) through ARC files, the converter and WARC files in the shared folder, read back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload, a null or
    odd url is made one without white space; repeated rows are records of their own, of which one is the response; no pages, no rows.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least)
    return warc_records(spark, warc, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
