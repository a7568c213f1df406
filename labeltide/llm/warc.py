"""Operator 2: web archives, written with an index first and read back by coalesced byte ranges.

Each task writes its pages to gzip-per-record WARC files of its own in the
shared folder and emits an index row per record (page id, URL, file, offset,
length, payload digest, type).  Spark commits the index as a table, so it names
only files of attempts that succeeded.  Reading starts from the index: the rows
of interest are sorted by file and offset, ranges that touch or nearly touch
are merged into one read, and every record is parsed, checked against its
digest and returned.

Records whose payloads are equal and of at least ``min_revisit`` bytes become
one response (the largest page id) and revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltide.llm.common import Stage, open_store

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL_SAFE = "!#$%&'()*+,/:;=?@[]~"
MIN_REVISIT = 1000
INDEX = "page_id {kind}, url string, file string, offset long, length long, payload_digest string, record_type string"
RECORD = "page_id {kind}, url string, record_type string, refers_to {kind}, payload_bytes long, payload_digest string"


def _urn(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def build_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header (with the payload's length) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URL_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, page ids, payload length and digest, and the payload (None for a revisit) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
            "payload_bytes": length, "payload_digest": digest, "payload": None if revisit else payload}


def _writer(folder: str, date: str, level: int, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        sink, name, at = None, None, 0
        for batch in batches:
            files, offsets, lengths = [], [], []
            for page_id, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None or at > roll_bytes:
                    if sink is not None:
                        sink.close()
                    store.create_dir(base, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                record = build_record(page_id, url, (html or "").encode(), digest, refers_to, revisit, date)
                data = packer.compress(record) + packer.flush()
                sink.write(data)
                files.append(name)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            kinds = pa.compute.if_else(batch.column("revisit"), "revisit", "response")
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(files, pa.string()), pa.array(offsets, pa.int64()),
                pa.array(lengths, pa.int64()), batch.column("digest"), kinds],
                names=["page_id", "url", "file", "offset", "length", "payload_digest", "record_type"])
        if sink is not None:
            sink.close()
    return run


def merge_ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, start, end, row numbers) of reads that cover ``rows`` (file, offset, length), sorted; a single record may exceed ``most``."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][:2])
    group: tuple[str, int, int, list[int]] | None = None
    for i in order:
        file, offset, length = rows[i]
        if group and file == group[0] and offset <= group[2] + gap and offset + length - group[1] <= most:
            group = (file, group[1], max(group[2], offset + length), [*group[3], i])
        else:
            if group:
                yield group
            group = (file, offset, offset + length, [i])
    if group:
        yield group


def _reader(folder: str, schema: pa.Schema, gap: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for path, start, end, members in merge_ranges(rows, gap, most):
                if path != name:
                    name, file = path, store.open_input_file(f"{base}/{path}")
                data = memoryview(file.read_at(end - start, start))
                found = []
                for i in members:
                    _, offset, length = rows[i]
                    found.append(parse_record(zlib.decompress(data[offset - start:offset - start + length], 31)))
                yield pa.RecordBatch.from_pylist(found, schema=schema)
    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z", level: int = 1,
                   roll_bytes: int = 1 << 30) -> tuple[str, DataFrame]:
    """Write the archives; their folder and the index table.

    A null html is an empty payload, a null URL leaves out the target header.  Rows that
    repeat the largest page id of a payload are all responses; rows with a null id refer to
    the largest id of their payload, or are responses where no row has one.  An empty
    table gives no file and an empty index.
    """
    stage = Stage(pages.sparkSession, "warc")
    keyed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keyed = keyed.withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    groups = (keyed.where(size >= min_revisit).groupBy("digest")
              .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "head"))
    groups = stage.put(groups, "groups")
    rows = keyed.join(groups, "digest", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("head")) & F.col("head").isNotNull(), F.lit(False))
    rows = rows.select("page_id", "url", "html", "digest", F.when(revisit, F.col("head")).alias("refers_to"), revisit.alias("revisit"))
    kind = keyed.schema["page_id"].dataType.simpleString()
    index = rows.mapInArrow(_writer(stage.path("archives"), date, level, roll_bytes), INDEX.format(kind=kind))
    return stage.path("archives"), stage.put(index, "index")


def read_archives(folder: str, index: DataFrame, payload: bool = True, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """The records that ``index`` selects: RECORD's columns and, if asked for, the payload (null for a revisit)."""
    kind = index.schema["page_id"].dataType.simpleString()
    ddl = RECORD.format(kind=kind) + (", payload binary" if payload else "")
    integer = pa.int32() if kind == "int" else pa.int64()
    fields = [("page_id", integer), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", integer),
              ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + ([("payload", pa.binary())] if payload else [])
    ranges = index.select("file", "offset", "length").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_reader(folder, pa.schema(fields), gap, most), ddl)


def archive_digests(pages: DataFrame, **options) -> DataFrame:
    """Write all pages and read every record back, without its payload."""
    folder, index = write_archives(pages, **options)
    return read_archives(folder, index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
