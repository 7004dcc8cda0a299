"""WARC archives, index first.

1. Digests. SHA-1 of every payload; the smallest id of each digest is taken
   before any payload moves, so thousands of equal pages are one row per task.
2. Layout. Records are dealt to archives by a hash of their id; each task
   writes whole archives into the shared folder through pyarrow's file-system
   layer and returns one index row per record: archive, offset, length, URL,
   digest. A file gets its final name only when complete, and the names that
   count are those in the index, so a task that runs twice does no harm.
3. Reading. Index rows of the selected records are sorted by archive and
   offset, neighbouring ranges are joined into one read, and records are parsed
   out of it.

Each record is a gzip member of its own. A revisit record keeps the HTTP
header, with the length of the payload it stands for, but no payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: Bytes and records that an archive should hold, bytes that one read and its gaps may span, and bytes that a reading task should read.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 256 << 20, 100_000
READ_BYTES, READ_GAP, TASK_BYTES = 1 << 20, 64 << 10, 32 << 20
INDEX = "page_id bigint, url string, digest string, payload_bytes bigint, record_type string, refers_to bigint, archive string, offset bigint, length bigint"
_INDEX_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
DATE = "2024-01-01T00:00:00Z"


def _one_line(value: str) -> str:
    """A header value: control characters are percent-encoded, as they would end the header."""
    if value.isprintable():
        return value
    return "".join(ch if ch.isprintable() else "".join(f"%{b:02X}" for b in ch.encode("utf-8", "replace")) for ch in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, level: int = 1) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> dict:
    """A record's headers, and its payload (empty for a revisit); checks the digest of a response."""
    raw = zlib.decompress(data, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: None if x is None or x == "<urn:page:none>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload}


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        index: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            """Complete the archive; only then its index rows are given out."""
            out.close()
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            for lo in range(0, len(index), 10_000):
                cols = list(zip(*index[lo : lo + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, _INDEX_KINDS)], names=_INDEX_NAMES)
            index.clear()

        for batch in batches:
            payloads, lo = batch.column(2), 0
            while lo < batch.num_rows:
                part = batch.slice(lo, 64)
                lo += 64
                raw, offsets = c.utf8(part.column(2))
                for i, (page, url, first, many) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist())):
                    payload = raw[offsets[i] : offsets[i + 1]].tobytes()
                    if out is not None and (at >= ARCHIVE_BYTES or len(index) >= ARCHIVE_RECORDS):
                        yield from close()
                        out = None
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}.part", compression=None)
                    revisit = bool(many) and page != first
                    data = record(page, url, payload, digest := sha1(payload), first if revisit else None, revisit)
                    out.write(data)
                    index.append((page, url, digest, len(payload), "revisit" if revisit else "response", first if revisit else None, name, at, len(data)))
                    at += len(data)
            del payloads
        if out is not None:
            yield from close()

    return run


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        opened, name = None, None
        for batch in batches:
            rows = batch.to_pydict()
            todo = list(zip(rows["archive"], rows["offset"], rows["length"]))
            i, found = 0, []
            while i < len(todo):
                archive, start, length = todo[i]
                end, j = start + length, i + 1
                while j < len(todo) and todo[j][0] == archive and end <= todo[j][1] <= end + READ_GAP and todo[j][1] + todo[j][2] - start <= READ_BYTES:
                    end, j = todo[j][1] + todo[j][2], j + 1
                if archive != name:
                    opened, name = store.open_input_file(f"{base}/{archive}"), archive
                data = opened.read_at(end - start, start)
                found += [parse(data[o - start : o - start + n]) for _, o, n in todo[i:j]]
                i = j
                if len(found) >= 256 or i == len(todo):
                    yield _records(found, payloads)
                    found = []

    return run


def _records(found: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if payloads:
        kinds["payload"] = pa.binary()
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in kinds.items()], names=list(kinds))


def first_pages(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """(id, key, first): for pages whose payload of `smallest` bytes or more a page with a smaller id has too."""
    body = F.coalesce("html", F.lit(""))
    marked = pages.select(F.col("page_id").alias("id"), F.xxhash64(body).alias("key"), F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("n")).where(F.col("n") >= smallest)
    least = marked.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1 and first is not null")
    return marked.join(least, "sha").where("id is null or id > first").select("id", "key", "first").distinct()


def write_archives(pages: DataFrame, folder: str, smallest: int = 0) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) under folder; returns the index.

    A null html is an empty payload; a null url leaves out the target header; a
    null id never is the first of a group. Rows that share the smallest id of
    their payload are all responses; repeated rows get a record each. Other
    columns are ignored, and an empty table gives an empty index.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    # written first, its size is known: Spark broadcasts it where that is small, so that payloads need not move
    first = c.spool(first_pages(pages, smallest), "first-pages")
    pages = pages.withColumn("_key", F.xxhash64(F.coalesce("html", F.lit(""))))
    joined = pages.join(first, pages["page_id"].eqNullSafe(first["id"]) & (pages["_key"] == first["key"]), "left")
    joined = joined.select("page_id", "url", "html", "first", F.col("first").isNotNull().alias("again"))
    index = c.spool(joined.mapInArrow(_write(folder), INDEX), "warc-index")
    c.drop_spool(first)
    return index


def read_archives(spark, index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read the records that the index rows name: sorted byte ranges, neighbours in one read.

    Tasks are as many as the bytes to be read ask for, not those of the index.
    """
    index = index.select("archive", "offset", "length")
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    dealt = index.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    return dealt.mapInArrow(_read(folder, payloads), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """The op9 query: all pages to archives and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = c.scratch(spark, "warc")
    index = write_archives(pages, folder)
    return read_archives(spark, index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32(hex_digits: str) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = f"('0x' || substr({hex_digits}, 5 * k + 1, 5))::bigint"
    return "array_to_string(list_transform(range(8), lambda k: " + " || ".join(f"substr('{letters}', (({five} >> {s}) & 31)::int + 1, 1)" for s in (15, 10, 5, 0)) + "), '')"


OP9_SQL = f"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as s from pages),
 f as (select *, min(page_id) over (partition by s) as first from p)
select page_id, payload_bytes, {_base32('s')} as payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to from f
"""
