"""Token files: independent zstandard frames, a document table and a trailing seek table.

Layout of a file: data frames, each the ids of some whole documents as
little-endian unsigned integers of 2 bytes (4, if an id needs it); a skippable
frame with the document table (ids, lengths and frame numbers, compressed); and the
seek table of the zstandard seekable format, a skippable frame that ends the file
and has each frame's sizes and a checksum (the low 32 bits of XXH64 of its content).
A reader takes the tables from the end and decompresses only frames it needs.

Documents lie in ascending doc_id order within and across files. A task begins a new file
beyond FILE_BYTES of ids or FILE_DOCS documents, so a writer holds a bounded table, and a
reader yields frame by frame.

Defined results
- null text counts as empty and gives the end id alone; null ids come first; rows that share a doc_id are in the order of their texts' hash, then texts.
- texts may have any length: a long one has a frame of its own; an empty table gives no files; other columns do not matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm import bpe, files
from bramble.llm.common import fresh_dir, materialize, partitions

#: Bytes of ids in a frame, unless one document has more; bytes of ids and documents beyond which a new file begins.
FRAME_BYTES, FILE_BYTES, FILE_DOCS = 262_144, 256_000_000, 1_000_000
# Fixed values of the seekable format.
_SKIPPABLE_DOCS, _SKIPPABLE_SEEK, _SEEK_MAGIC, _HAS_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_TABLE_HEAD = struct.Struct("<4sIQ")  # magic, bytes of an id, documents
_COLUMNS = 4  # of the document table: doc_id, whether it is null, length, frame


class Writer:
    """Writes one file; documents must come in order."""

    def __init__(self, out, width: int = 2, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES, file_docs: int = FILE_DOCS):
        self.out, self.dtype = out, np.dtype(f"<u{width}")
        self.frame_bytes, self.file_bytes, self.file_docs = frame_bytes, file_bytes, file_docs
        self.held: list[np.ndarray] = []
        self.size = self.written = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.pack = zstandard.ZstdCompressor(level=3)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids), len(self.frames)))
        self.held.append(ids)
        self.size += len(ids) * self.dtype.itemsize
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = np.concatenate(self.held).astype(self.dtype).tobytes()
            frame = self.pack.compress(raw)
            self.out.write(frame)
            self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.written += self.size
            self.held, self.size = [], 0

    @property
    def full(self) -> bool:
        return self.written >= self.file_bytes or len(self.docs) >= self.file_docs

    def close(self) -> None:
        self._flush()
        table = np.array(self.docs, dtype="<i8").reshape(-1, _COLUMNS).T
        body = _TABLE_HEAD.pack(b"docs", self.dtype.itemsize, len(self.docs)) + self.pack.compress(table.tobytes())
        self.out.write(struct.pack("<II", _SKIPPABLE_DOCS, len(body)) + body)
        frames = [*self.frames, (len(body) + 8, 0, 0)]  # the document table is a frame without content
        seek = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), _HAS_CHECKSUM, _SEEK_MAGIC)
        self.out.write(struct.pack("<II", _SKIPPABLE_SEEK, len(seek)) + seek)
        self.out.close()


class Reader:
    """Reads one file, given as an object with size(), read_at(n, at) and close()."""

    def __init__(self, f):
        self.f = f
        end = f.size()
        count, flags, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
        if magic != _SEEK_MAGIC or not flags & _HAS_CHECKSUM:
            raise ValueError("no seek table")
        self.frames = np.frombuffer(f.read_at(12 * count, end - 9 - 12 * count), dtype="<u4").reshape(count, 3).astype(np.int64)
        self.at = np.append(0, np.cumsum(self.frames[:, 0]))
        body = f.read_at(int(self.frames[-1, 0]), int(self.at[-2]))[8:]
        _, width, n = _TABLE_HEAD.unpack(body[: _TABLE_HEAD.size])
        self.dtype = np.dtype(f"<u{width}")
        self.unpack = zstandard.ZstdDecompressor()
        self.doc_ids, self.is_null, self.lengths, self.frame_of = np.frombuffer(self.unpack.decompress(body[_TABLE_HEAD.size :]), dtype="<i8").reshape(_COLUMNS, n)
        self.first = np.searchsorted(self.frame_of, np.arange(len(self.frames)))  # the first document of each frame; the last frame is the table's
        self.decompressed = 0

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self.frames[k]
        raw = self.unpack.decompress(self.f.read_at(int(packed), int(self.at[k])), max_output_size=int(size))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        self.decompressed += 1
        return np.frombuffer(raw, dtype=self.dtype)

    def read(self, places: Sequence[int]) -> Iterator[np.ndarray]:
        """The ids of the documents at these places; neighbours in a frame share its decompression."""
        k, ids, ends = -1, np.empty(0), np.empty(0)
        for p in places:
            if self.frame_of[p] != k:
                k = int(self.frame_of[p])
                ids = self.frame(k)
                ends = np.cumsum(self.lengths[self.first[k] : self.first[k + 1]])
            i = p - self.first[k]
            yield ids[ends[i] - self.lengths[p] : ends[i]]


INDEX = "part int, piece int, path string, n_docs long, n_tokens long"


def write(docs: DataFrame, path: str, end_id: int, text: str = "text", directory: str | None = None, **limits: int) -> DataFrame:
    """Encodes and writes all documents; returns the index of files: part and piece (their order), path, n_docs, n_tokens. limits: as Writer takes them."""
    spark = docs.sparkSession
    folder = directory or fresh_dir(spark, "tokens")
    spec = spark.sparkContext.broadcast(bpe.read_spec(path))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(spec.value)
        width = 2 if max(len(codec.bytes_of) - 1, end_id) < 1 << 16 else 4
        part, piece, writer, where, n_tokens = TaskContext.get().partitionId(), 0, None, "", 0

        def closed() -> pa.RecordBatch:
            writer.close()
            row = {"part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "path": [where], "n_docs": [len(writer.docs)], "n_tokens": [n_tokens]}
            return pa.RecordBatch.from_pydict(row)

        for table, texts in bpe.stretches(batches, "text"):
            flat, ends = codec.encode_all(texts)
            for doc_id, a, b in zip(table.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if writer is not None and writer.full:
                    yield closed()
                    writer, piece, n_tokens = None, piece + 1, 0
                if writer is None:
                    where = files.new_name(folder, part, ".tok")
                    writer = Writer(files.open_new(where), width, **limits)
                writer.add(doc_id, np.append(flat[a:b], end_id))
                n_tokens += b - a + 1
        if writer is not None:
            yield closed()

    return materialize(ordered.mapInArrow(run, INDEX), "token-index")


def read(index: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, from the decompressed ids."""
    spark = index.sparkSession
    # One row for each file of up to FILE_BYTES.
    parts = index.orderBy("part", "piece").collect()
    base = np.append(0, np.cumsum([r["n_tokens"] for r in parts])).tolist()
    listed = spark.createDataFrame([(r["path"], b) for r, b in zip(parts, base, strict=False)], "path string, base long")
    listed = listed.repartition(max(1, len(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with files.open_old(path) as f:
                    r = Reader(f)
                    for a, b in zip(r.first[:-1].tolist(), r.first[1:].tolist(), strict=True):
                        crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in r.read(range(a, b))]
                        n = r.lengths[a:b].astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r.doc_ids[a:b].astype(np.int64), mask=r.is_null[a:b] > 0), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        start += int(n.sum())

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
