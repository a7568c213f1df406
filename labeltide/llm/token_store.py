"""Operator 5: token ids in a binary file format of shuffled planes.

File format (little endian).  ``LTPLANE1``, then one entry per chunk, then the
chunk index, then the index's offset (8 bytes) and ``LTPLANE1`` again.  A chunk
is a fixed number of ids (the last may hold fewer), seen as 32-bit words and
transposed: byte planes (``plane_bits`` 8, four planes) or bit planes (1, 32
planes), each compressed with zstandard; a plane of zeros takes no bytes.  The
index has, per chunk: offset (uint64), ids (uint32) and each plane's length
(uint32); it begins with the number of chunks, the ids per full chunk and the
bits per plane (uint32 each).

Documents are range-partitioned by id; each task encodes its range and streams
it to a file of its own in the shared folder.  Only the committed attempt's file
is named by the index table that Spark writes, so retries and lost executors
leave nothing but an unused file.  Positions in the whole sequence come from
one total per file.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeltide.llm.common import Stage, open_store

MAGIC = b"LTPLANE1"
CHUNK_IDS = 1 << 16
#: Chunks of text whose ids a worker remembers, at about 200 bytes each.
CACHE_ENTRIES = 500_000
_PLAIN_TAIL = ".,;:!?"


class TextEncoder:
    """Ids of texts as little-endian 32-bit words, equal to the library's ``encode``.

    White space always ends a token, so a text's ids are those of its blank-separated
    parts in turn, and each part is encoded once per worker.  A part that is a plain Latin
    word, or one with stops after it, goes straight to the library's BPE model; anything
    else through the whole tokenizer.  ``words`` says whether the tokenizer is of that kind
    (letters lowered, runs of letters and of other signs apart); if not, every text is
    encoded whole.
    """

    def __init__(self, path: str, words: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.model = self.tokenizer.model
        # One cache per worker process, however many tasks it runs.
        self.cache = sys.__dict__.setdefault("_labeltide_token_parts", {}).setdefault(path, {})
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.byte_signs = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}

    def _model_ids(self, part: str) -> list[int]:
        signs = part.lower().encode().decode("latin-1").translate(self.byte_signs)
        return [t.id for t in self.model.tokenize(signs)]

    def part(self, part: str) -> bytes:
        word = part.rstrip(_PLAIN_TAIL)
        if word.isalpha() and max(word) < "İ":
            tail = part[len(word):]
            ids = self._model_ids(word) + (self._model_ids(tail) if tail else [])
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        out = np.array(ids, dtype="<u4").tobytes()
        if len(self.cache) < CACHE_ENTRIES:
            self.cache[part] = out
        return out

    def text(self, text: str) -> bytes:
        if not self.words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        known, part = self.cache.get, self.part
        return b"".join([known(p) or part(p) for p in text.replace("\n", " ").split(" ") if p])


class PlaneWriter:
    def __init__(self, sink, chunk_ids: int, plane_bits: int, level: int):
        self.sink, self.chunk_ids, self.bits = sink, chunk_ids, plane_bits
        self.pack = zstandard.ZstdCompressor(level=level)
        self.index, self.pending, self.held = [], [], 0
        sink.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, ids: bytes) -> None:
        self.pending.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.chunk_ids:
            joined = np.frombuffer(b"".join(self.pending), dtype="<u4")
            full = len(joined) // self.chunk_ids * self.chunk_ids
            for k in range(0, full, self.chunk_ids):
                self._chunk(joined[k:k + self.chunk_ids])
            self.pending, self.held = [joined[full:].tobytes()], len(joined) - full

    def _chunk(self, ids: np.ndarray) -> None:
        lengths, offset = [], self.at
        for plane in to_planes(ids, self.bits):
            data = self.pack.compress(plane.tobytes()) if plane.any() else b""
            self.sink.write(data)
            self.at += len(data)
            lengths.append(len(data))
        self.index.append((offset, len(ids), lengths))

    def close(self) -> None:
        if self.held:
            self._chunk(np.frombuffer(b"".join(self.pending), dtype="<u4"))
        head = struct.pack("<III", len(self.index), self.chunk_ids, self.bits)
        rows = [struct.pack(f"<QI{len(n)}I", offset, ids, *n) for offset, ids, n in self.index]
        self.sink.write(head + b"".join(rows) + struct.pack("<Q", self.at) + MAGIC)


def to_planes(ids: np.ndarray, bits: int) -> np.ndarray:
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return np.ascontiguousarray(octets.T)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1)


def from_planes(planes: list[np.ndarray], n: int, bits: int) -> np.ndarray:
    stacked = np.stack(planes)
    if bits == 8:
        octets = stacked.T
    else:
        octets = np.packbits(np.unpackbits(stacked, axis=1, count=n).T, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


class PlaneReader:
    """Reads ranges of ids of one file, decoding each chunk it needs once in a row."""

    def __init__(self, filesystem, path: str):
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        at, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{path} is no plane file")
        index = self.file.read_at(size - 16 - at, at)
        n, self.chunk_ids, self.bits = struct.unpack_from("<III", index)
        row = struct.Struct(f"<QI{32 // self.bits}I")
        self.index = [row.unpack_from(index, 12 + k * row.size) for k in range(n)]
        self.unpack, self.have = zstandard.ZstdDecompressor(), (-1, None)

    def chunk(self, k: int) -> np.ndarray:
        if self.have[0] != k:
            offset, n, *lengths = self.index[k]
            data, planes, at = self.file.read_at(sum(lengths), offset), [], 0
            width = n if self.bits == 8 else (n + 7) // 8
            for length in lengths:
                raw = self.unpack.decompress(data[at:at + length], max_output_size=width) if length else bytes(width)
                planes.append(np.frombuffer(raw, dtype=np.uint8))
                at += length
            self.have = (k, from_planes(planes, n, self.bits))
        return self.have[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        parts, end = [], start + n
        while start < end:
            k, inside = divmod(start, self.chunk_ids)
            parts.append(self.chunk(k)[inside:inside + end - start])
            start += len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


def _writer(folder: str, tokenizer: str, words: bool, end_id: int, chunk_ids: int, bits: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        part, name, writer, at = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.planes", None, 0
        encoder, end = TextEncoder(tokenizer, words), struct.pack("<I", end_id)
        for batch in batches:
            if writer is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}")
                writer = PlaneWriter(sink, chunk_ids, bits, level)
            starts, counts = [], []
            for text in batch.column(1):
                ids = encoder.text(text.as_py() or "") + end
                writer.add(ids)
                starts.append(at)
                counts.append(len(ids) // 4)
                at += counts[-1]
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([part] * rows, pa.int32()), pa.array([name] * rows, pa.string()),
                pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                names=["id", "part", "file", "local_start", "n_tokens"])
        if writer is not None:
            writer.close()
            sink.close()
    return run


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name, reader = None, None
        for batch in batches:
            sums = []
            for file, start, n in zip(*(batch.column(c).to_pylist() for c in ("file", "local_start", "n_tokens"))):
                if file != name:
                    name, reader = file, PlaneReader(store, f"{base}/{file}")
                sums.append(zlib.crc32(reader.ids(start, n).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "part", "local_start", "n_tokens")), pa.array(sums, pa.int64())],
                names=["id", "part", "local_start", "n_tokens", "ids_crc32"])
    return run


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                 words: bool = False, chunk_ids: int = CHUNK_IDS, plane_bits: int = 8, level: int = 1) -> tuple[str, DataFrame]:
    """Write the files; their folder, and the index table (id, part, file, local_start, n_tokens).

    ``docs`` is written in ascending id order (nulls first, equal ids by text).  A null text
    is empty and gives the end id alone.  An empty table gives no file and an empty index.
    ``words`` is faster, and right only for the tokenizers that :class:`TextEncoder` names.
    """
    stage = Stage(docs.sparkSession, "tokens")
    key = F.col("id").asc_nulls_first()
    ordered = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
               .repartitionByRange(key).sortWithinPartitions(key, "text"))
    kind = docs.schema[id_col].dataType.simpleString()
    index = ordered.mapInArrow(
        _writer(stage.path("files"), tokenizer, words, end_id, chunk_ids, plane_bits, level),
        f"id {kind}, part int, file string, local_start long, n_tokens long")
    return stage.path("files"), stage.put(index, "index")


def read_tokens(folder: str, index: DataFrame) -> DataFrame:
    """Per document: id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("words"))
    bases = sizes.select("part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    kind = index.schema["id"].dataType.simpleString()
    found = index.mapInArrow(_reader(folder), f"id {kind}, part int, local_start long, n_tokens long, ids_crc32 long")
    return found.join(bases, "part").select("id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write and read back: ``id_col``, start, n_tokens, ids_crc32, one row per row of ``docs``."""
    folder, index = write_tokens(docs, tokenizer, id_col, text_col, **options)
    return read_tokens(folder, index).withColumnRenamed("id", id_col)
