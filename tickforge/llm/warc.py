"""WARC archives: capture, normalising of monolithic gzip files, revisits, and reading by an offset index.

A monolithic archive is one gzip stream over all its records, so that no record can be read alone. normalise() inflates
such a stream once, front to back, rewrites every record as a gzip member of its own, and writes a sidecar index of the
members' offsets. Archives are files in the shared folder, written under a task's own name and then renamed, so a task
that runs again replaces its file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, new_path, rows_of, texts_of

#: An archive ends at so many bytes before compression, or so many records.
ARCHIVE_BYTES, ARCHIVE_RECORDS, CHUNK = 64 << 20, 50_000, 1 << 20
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _fs(path: str):
    return pa.fs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{archive}#{ordinal}')}>"


def header_value(x: str) -> str:
    """A value without characters that would end its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {header_value(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names in lower case), the HTTP head and the payload of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


class Writer:
    """A file under a name of its own until close(), which gives it its name."""

    def __init__(self, path: str):
        self.fs, self.to = _fs(path)
        self.fs.create_dir(self.to.rpartition("/")[0], recursive=True)
        self.own = f"{self.to}.{uuid.uuid4().hex}.part"
        self.file, self.size = self.fs.open_output_stream(self.own), 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.own, self.to)


CAPTURED = "archive string, ordinal int, page_id long, digest string, payload_bytes long"


def capture(df: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Writes (page_id, url, html) as response records into monolithic archives under root; a row for each record."""

    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        out = squeeze = None
        name, ordinal, raw = "", 0, 0

        def finish():
            out.write(squeeze.flush())
            out.close()

        for b in rows_of(batches, "html"):
            rows = []
            for page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                if out is None:
                    name, ordinal, raw = f"{part:06d}-{count:04d}", 0, 0
                    out, squeeze, count = Writer(f"{root}/{name}.warc.gz"), zlib.compressobj(4, zlib.DEFLATED, 31), count + 1
                payload = html or b""
                digest = payload_digest(payload)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                headers = [("WARC-Record-ID", record_id(name, ordinal)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url or "about:blank"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if page is not None:
                    headers.append(("X-Page-ID", str(page)))
                data = record("response", headers, http + payload)
                out.write(squeeze.compress(data))
                rows.append((name, ordinal, page, digest, len(payload)))
                ordinal, raw = ordinal + 1, raw + len(data)
                if raw >= archive_bytes or ordinal >= archive_records:
                    finish()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["archive", "ordinal", "page_id", "digest", "payload_bytes"])
        if out is not None:
            finish()

    return df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, CAPTURED)


def revisits(captured: DataFrame, least: int = 0) -> DataFrame:
    """captured with refers_to, refers_archive, refers_ordinal: of records with equal payloads of at least `least` bytes,
    all but that of the largest page_id (null: smallest; of equal ids the last captured) refer to it."""
    place = F.struct("page_id", "archive", "ordinal")
    best = captured.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max(place).alias("best"), F.count("*").alias("times")).filter("times > 1").drop("times")
    met = captured.join(best, "digest", "left")
    other = F.col("best").isNotNull() & (F.col("payload_bytes") >= least) & ~((F.col("best.archive") == F.col("archive")) & (F.col("best.ordinal") == F.col("ordinal")))
    return met.select(*captured.columns, *(F.when(other, F.col(f"best.{x}")).alias(y) for x, y in (("page_id", "refers_to"), ("archive", "refers_archive"), ("ordinal", "refers_ordinal"))), other.alias("revisit"))


def records_of(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of a compressed file, inflated once from front to back whether it is one stream or many members."""
    inflate, held, more = zlib.decompressobj(31), bytearray(), True
    while more:
        data = stream.read(chunk)
        more = bool(data)
        while data:
            held += inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", held[at:end])
            if not m:
                raise ValueError("a record without a length")
            stop = end + 4 + int(m[1]) + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends within a record")


INDEX = "archive string, byte_start long, byte_size long, record_type string, page_id long, digest string"


def normalise(table: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each archive that table (from revisits()) has rows of: a member for each record, revisits without their
    payload, and a sidecar index beside the archive. Returns the index."""

    def run(key, t):
        name = key[0].as_py()
        row = {r["ordinal"]: r for r in t.to_pylist()}
        fs, path = _fs(f"{source}/{name}.warc.gz")
        out, side = Writer(f"{target}/{name}.warc.gz"), Writer(f"{target}/{name}.cdxj")
        index = []
        with fs.open_input_stream(path, compression=None) as stream:
            for k, data in enumerate(records_of(stream)):
                r = row[k]
                if r["revisit"]:
                    headers, http, _ = parse(data)
                    keep = [("WARC-Record-ID", headers["warc-record-id"]), ("WARC-Date", headers["warc-date"]), ("WARC-Target-URI", headers["warc-target-uri"]), ("Content-Type", headers["content-type"]), ("WARC-Payload-Digest", headers["warc-payload-digest"])]
                    keep += [("X-Page-ID", headers["x-page-id"])] if "x-page-id" in headers else []
                    keep += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(r["refers_archive"], r["refers_ordinal"]))]
                    keep += [("X-Refers-To-Page-ID", str(r["refers_to"]))] if r["refers_to"] is not None else []
                    data = record("revisit", keep, http + b"\r\n\r\n")
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(data) + squeeze.flush()
                entry = {"archive": name, "byte_start": out.size, "byte_size": len(member), "record_type": "revisit" if r["revisit"] else "response", "page_id": r["page_id"], "digest": r["digest"]}
                index.append(entry)
                out.write(member)
                side.write(json.dumps(entry).encode() + b"\n")
        if len(index) != len(row):
            raise ValueError(f"{name} has {len(index)} records, not {len(row)}")
        out.close()
        side.close()
        return pa.Table.from_pylist(index, schema=pa.schema([("archive", pa.string()), ("byte_start", pa.int64()), ("byte_size", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("digest", pa.string())]))

    archives = max(1, table.select("archive").distinct().count())
    return table.repartition(archives, "archive").groupBy("archive").applyInArrow(run, INDEX)  # as many tasks as archives, whatever the size of these rows


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def read_records(index: DataFrame, root: str) -> DataFrame:
    """Reads each indexed member by its byte range. Length and digest are those of the full payload: computed for
    responses, the ones that the record carries for revisits."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def run(batches):
        for b in batches:
            rows, name, file = [], None, None
            for archive, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != name:
                    if file:
                        file.close()
                    fs, path = _fs(f"{root}/{archive}.warc.gz")
                    name, file = archive, fs.open_input_file(path)
                headers, http, payload = parse(zlib.decompress(file.read_at(size, start), 31))
                number = lambda k, h=headers: int(h[k]) if k in h else None
                if headers["warc-type"] == "revisit":
                    n, digest = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1]), headers["warc-payload-digest"].removeprefix("sha1:")
                else:
                    n, digest = len(payload), payload_digest(payload)
                rows.append((number("x-page-id"), n, digest, headers["warc-type"], number("x-refers-to-page-id"), headers["warc-target-uri"]))
            if file:
                file.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)

    archives = max(1, index.select("archive").distinct().count())
    places = index.select("archive", "byte_start", "byte_size").repartition(archives, "archive").sortWithinPartitions("archive", "byte_start")
    return places.mapInArrow(run, READ)


def archive_pages(df: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """Captures (page_id, url, html), normalises the archives, and returns the index and the archives' folder. A null html
    is an empty payload; a repeated row is another record; an empty table gives no archive."""
    spark = df.sparkSession
    source, target = new_path(spark, "monolithic"), new_path(spark, "archives")
    captured, captured_at = materialize(capture(df, source, archive_bytes), "captured")
    marked, marked_at = materialize(revisits(captured, least), "marked")
    index, _ = materialize(normalise(marked, source, target), "index")
    discard(spark, source, captured_at, marked_at)
    return index, target
