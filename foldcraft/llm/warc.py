"""Legacy archives to WARC.

ARC files hold records of a header line and as many bytes as it declares; the
fields of the line depend on the version that the file's version block
("filedesc://") names: 1 has URL, IP, date, type and length, 2 adds result
code, checksum, location, offset and file name.  Each record becomes a WARC
record: the identifier is a UUID derived from the record, the date is the ARC
date in ISO form, the payload digest is the base32 SHA-1, and the type is
response, or revisit where another record has the same payload.

Of records with equal payloads of at least ``min_revisit`` bytes the one with
the largest record key (op3: page_id) is the response and the others refer to
it and carry no payload; smaller ones all are responses.

Distribution.  Archives are rows (name, content), as Spark's binaryFile
reader gives them; one task parses one archive at a time.  Which record is the
response is decided on (digest, key), with map-side aggregation; payloads are
shuffled once, to meet the decision of their digest, in a join whose hot keys
adaptive execution splits (both sides are read from a shuffle).  WARC files
are written into the shared folder, every record as a gzip member, a file of
about FILE_BYTES whatever the pages' sizes; the files that count stand in a
manifest that Spark commits.  They are read back member by member, so a task
holds a record at a time.

Defined results: a null payload is empty; null keys lose against any other
key, and a group with null keys alone has them all as responses; records
equal in key and payload (repeated rows) are all responses; a url may be null
or hold blanks or line ends (they are percent-encoded in the header line); a
payload may hold anything, header lines included, as lengths rule; a broken or
truncated record is an error that names the archive; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: header fields of the versions of the format
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
#: bytes of payload in one archive, about
ARCHIVE_BYTES = 4 << 20
#: bytes of one WARC file, about; payload and rows that a reader passes on at a time
FILE_BYTES = 64 << 20
BATCH_BYTES, BATCH_ROWS = 16 << 20, 2000
MIN_REVISIT = 0
VERSION = "WARC/1.1"


# ARC -----------------------------------------------------------------------

def _url(url: str | None) -> str:
    return re.sub(r"[\s%]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def arc_archive(name: str, version: int, date: str, records: list[tuple[str | None, bytes]]) -> bytes:
    """An archive of (url, payload) in the given version."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length",
             2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    block = f"{version} 0 foldcraft\n{names[version]}\n".encode()
    tail = {1: "", 2: "200 - - 0 - "}[version]

    def head(url, kind, body, extra):
        return f"{url} 0.0.0.0 {date} {kind} {extra}{len(body)}\n".encode()

    # the version block itself is a record of the short form
    out = [head(f"filedesc://{name}", "text/plain", block, tail), block, b"\n"]
    for url, payload in records:
        out += [head(_url(url), "text/html", payload, tail), payload, b"\n"]
    return b"".join(out)


def read_arc(name: str, data: bytes):
    """Yields (fields, payload) of an archive's records but version blocks."""
    version, at = None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at:end].decode("utf-8") if end >= 0 else None
        if line is not None and line.startswith("filedesc://"):
            # which version it is stands in the block that the line declares
            n = int(line.rsplit(" ", 1)[1])
            block = data[end + 1:end + 1 + n]
            version = int(block.split(b" ", 1)[0])
        values = line.split(" ") if line is not None else []
        if version not in FIELDS or len(values) != len(FIELDS[version]) or not values[-1].isdigit():
            raise ValueError(f"{name}: no ARC header at byte {at}")
        n = int(values[-1])
        payload = data[end + 1:end + 1 + n]
        if len(payload) < n or data[end + 1 + n:end + 2 + n] != b"\n":
            raise ValueError(f"{name}: the record at byte {at} is shorter than it declares")
        at = end + 2 + n
        if not line.startswith("filedesc://"):
            yield dict(zip(FIELDS[version], values)), payload


RECORD = ("archive string, place bigint, key bigint, url string, date string, type string, payload binary, "
          "digest string")


def arc_records(archives: DataFrame) -> DataFrame:
    """Rows RECORD of archives (name, content, keys): keys are the caller's
    numbers of the records of each archive, as the format has no place for
    them; it may be null."""
    def run(batches):
        for b in batches:
            for name, content, keys in zip(*(b.column(c).to_pylist() for c in ("name", "content", "keys"))):
                rows = [(name, i, keys[i] if keys else None, f["url"], f["date"], f["type"], payload,
                         base64.b32encode(hashlib.sha1(payload).digest()).decode())
                        for i, (f, payload) in enumerate(read_arc(name, content))]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (
                            pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(),
                            pa.string()))],
                        names=[x.split()[0] for x in RECORD.split(", ")])
    return archives.select("name", "content", "keys").mapInArrow(run, RECORD)


# WARC ----------------------------------------------------------------------

def convert(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """WARC fields of rows RECORD: adds
    record_id, warc_date, record_type, refers_to (a key) and refers_to_id;
    a revisit's payload is empty, payload_bytes stays."""
    big = F.octet_length("payload") >= min_revisit
    # repeated rows have places of their own
    here = F.md5(F.concat_ws(":", "archive", F.col("place").cast("string"), F.col("key").cast("string"), "digest"))
    records = records.withColumn("_id", here)
    best = records.filter(big).groupBy("digest").agg(F.max(F.struct("key", "_id")).alias("b")).select(
        F.col("digest").alias("b_digest"), F.col("b.key").alias("best"), F.col("b._id").alias("best_id"))
    j = records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).join(
        best.repartition("b_digest").hint("merge"), F.col("digest") == F.col("b_digest"), "left")
    again = (F.col("payload_bytes") >= min_revisit) & F.col("best").isNotNull() & ~F.col("key").eqNullSafe(F.col("best"))

    def record_id(h):
        # the record's identity in 128 bits, written as a UUID
        return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-8$3-8$4-$5"))

    d = F.col("date")
    iso = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2), F.lit("T"),
                   F.substring(d, 9, 2), F.lit(":"), F.substring(d, 11, 2), F.lit(":"), F.substring(d, 13, 2), F.lit("Z"))
    return j.select(
        "key", "url", "type", "digest", "payload_bytes", record_id(F.col("_id")).alias("record_id"), iso.alias("warc_date"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("best")).alias("refers_to"), F.when(again, record_id(F.col("best_id"))).alias("refers_to_id"),
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes rows of convert() as WARC files into the folder, every record a
    gzip member of its own, a file of about ``file_bytes`` (one record more at
    most).  Returns the manifest (file, n_records, n_bytes), which is stored in
    the folder: a file that isn't in it is what a lost task left behind."""
    def field(name, value):
        return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))

    head = F.concat(
        F.lit(f"{VERSION}\r\n"), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        field("WARC-Date", F.col("warc_date")), field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_id", F.lit(">"))),
        field("WARC-Profile", F.when(F.col("record_type") == "revisit",
                                     "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        field("X-Key", F.col("key")), field("X-Refers-To-Key", F.col("refers_to")),
        field("X-Payload-Length", F.col("payload_bytes")), field("Content-Type", F.col("type")),
        field("Content-Length", F.octet_length("payload")), F.lit("\r\n"))

    def run(batches):
        files, base = pafs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        out = name = None
        n = size = 0
        for b in batches:
            for head, payload in zip(b.column("head").to_pylist(), b.column("payload").to_pylist()):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = files.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                member = gzip.compress(b"".join((head.encode(), payload, b"\r\n\r\n")), 6, mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "n_records": [n], "n_bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "n_records": [n], "n_bytes": [size]})

    rows = records.select(head.alias("head"), "payload").mapInArrow(run, "file string, n_records bigint, n_bytes bigint")
    rows.write.mode("overwrite").parquet(f"{path}/manifest")
    return records.sparkSession.read.parquet(f"{path}/manifest")


def members(source, chunk: int = 1 << 20):
    """The gzip members of a file, one at a time."""
    left = b""
    while left or (left := source.read(chunk)):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if not left and not (left := source.read(chunk)):
                raise ValueError("a gzip member is cut off")
            parts.append(one.decompress(left))
            left = one.unused_data
        yield b"".join(parts)


def parse_warc(name: str, data: bytes):
    """Yields (header fields, content) of the records of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no WARC header at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        at = end + 4 + n
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: a record is shorter than it declares before byte {at}")
        yield fields, data[end + 4:at]
        at += 4


READ = {"key": "X-Key", "url": "WARC-Target-URI", "record_id": "WARC-Record-ID", "warc_date": "WARC-Date",
        "record_type": "WARC-Type", "digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length",
        "refers_to": "X-Refers-To-Key", "refers_to_id": "WARC-Refers-To"}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The header fields (strings) and payload of the records in a folder of
    write_warc(); a task holds one record at a time, and a response's payload
    is held against its digest."""
    names = [*READ, "payload"]

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary() if n == "payload" else pa.string()) for n, c in zip(names, zip(*rows))], names=names)

    def run(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                files, at = pafs.FileSystem.from_uri(name)
                rows, size = [], 0
                with files.open_input_stream(at, compression=None) as source:
                    for data in members(source):
                        for fields, payload in parse_warc(name, data):
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if fields["WARC-Type"] == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                                raise ValueError(f"{name}: a payload does not have its digest")
                            row = [fields.get(f) for f in READ.values()]
                            row[names.index("digest")] = digest
                            rows.append((*row, payload))
                            size += len(payload)
                        if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.parquet(f"{path}/manifest").select("file")
    n = min(files.count(), 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = files.repartition(max(1, n), "file")
    return files.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'payload' else 'string'}" for n in names))


# pages ---------------------------------------------------------------------

def pages_as_arcs(pages: DataFrame) -> DataFrame:
    """Archives (name, keys, content) of rows (page_id, url, html), of either
    version; keys lists the page_id of each record."""
    date = datetime(2026, 1, 1, tzinfo=timezone.utc).strftime("%Y%m%d%H%M%S")
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce("html", F.lit("")).alias("html"))

    def run(batches):
        for b in batches:
            held, size = [], 0
            rows = list(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))))
            for k, (page, url, html) in enumerate(rows):
                held.append((page, url, html.encode()))
                size += len(held[-1][2])
                if size >= ARCHIVE_BYTES or k == len(rows) - 1:
                    name = f"pages-{uuid.uuid5(uuid.NAMESPACE_URL, repr([x[:2] for x in held]))}.arc"
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([[x[0] for x in held]], pa.list_(pa.int64())),
                         pa.array([arc_archive(name, 1 + len(held) % 2, date, [x[1:] for x in held])], pa.binary())],
                        names=["name", "keys", "content"])
                    held, size = [], 0
    return p.mapInArrow(run, "name string, keys array<bigint>, content binary")


def op3_warc(spark, sf_dir):
    """op3: pages archived as ARC, converted, written as WARC and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_warc(convert(arc_records(pages_as_arcs(pages))), path)
    return read_warc(spark, path).select(
        F.col("key").cast("long").alias("page_id"), F.col("payload_bytes").cast("long").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS h FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((('0x' || substr(h, CAST(5 * k // 4 + 1 AS INT), 2))::INT >> CAST(3 - (5 * k) % 4 AS INT)) & 31) + 1 AS INT), 1)),
      '') AS payload_digest,
    max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""
