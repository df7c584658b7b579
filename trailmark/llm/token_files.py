"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds: frames of token ids (little-endian uint32; frame_bytes of ids each, the last shorter),
one skippable frame with the documents' index (id and token count, in file order) and the seek table
of the zstandard seekable format: sizes and a checksum (low half of XXH64) for each frame. A reader
fetches the end of the file, then only the frames that hold the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packed import blocks, utf8
from .shared import shared_path
from .tokens import encoder

# Fixed values of the public seekable zstandard format.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
NO_ID = -(1 << 63)  # stands for a null id in a file's index


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file; nothing is seen under its name until close()."""

    def __init__(self, uri: str, frame_bytes: int = 1 << 18, level: int = 1):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.frame_bytes, self.zip = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.rest, self.table, self.ids, self.counts = bytearray(), [], [], []

    def _frame(self, data: bytes) -> None:
        packed = self.zip.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids) // 4)
        self.rest += ids
        while len(self.rest) >= self.frame_bytes:
            self._frame(bytes(self.rest[: self.frame_bytes]))
            del self.rest[: self.frame_bytes]

    def close(self) -> None:
        if self.rest:
            self._frame(bytes(self.rest))
        index = self.zip.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.table.append((len(index) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))  # a skippable frame holds no data: its checksum is of the packed index
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


class FrameReader:
    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{uri}: no seek table")
        self.table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        ends = np.cumsum(self.table[:, 0])
        self.at, self.raw_end = ends - self.table[:, 0], np.cumsum(self.table[:, 1])
        self.unzip = zstandard.ZstdDecompressor()
        head = self.file.read_at(int(self.table[-1, 0]) - 8, int(self.at[-1]) + 8)
        if xxhash.xxh64_intdigest(head) & 0xFFFFFFFF != self.table[-1, 2]:
            raise ValueError(f"{uri}: checksum of the document index differs")
        index = self.unzip.decompress(head)
        docs = len(index) // 16
        self.ids, self.counts = np.frombuffer(index[: 8 * docs], "<i8"), np.frombuffer(index[8 * docs :], "<u8").astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.kept: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        """Frame k, checked against its checksum; the last one read is kept."""
        if self.kept[0] != k:
            data = self.unzip.decompress(self.file.read_at(int(self.table[k, 0]), int(self.at[k])), max_output_size=int(self.table[k, 1]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"{self.path}: checksum of frame {k} differs")
            self.kept = (k, data)
        return self.kept[1]

    def document(self, row: int) -> bytes:
        """Ids of the document at this row of the index; decompresses only the frames it lies in."""
        end = int(self.ends[row]) * 4
        start = end - int(self.counts[row]) * 4
        out, k = [], int(np.searchsorted(self.raw_end, start, side="right"))
        while start < end:
            stop = min(end, int(self.raw_end[k]))
            low = int(self.raw_end[k] - self.table[k, 1])
            out.append(self.frame(k)[start - low : stop - low])
            start, k = stop, k + 1
        return b"".join(out)

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 2, rows_per_file: int = 20_000, min_files: int = 48, frame_bytes: int = 1 << 18) -> DataFrame:
    """Encode docs(doc_id, text), in ascending doc_id order, to files under path; return their manifest.

    A null text is an empty one and holds the end id only; null doc_ids come first; equal ids stay
    beside each other in order of their text's hash; an empty table gives no file. Other columns are
    not read. Manifest: file (long, in order of ids), uri, n_docs, n_tokens, before (tokens in earlier files).
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    files = max(min_files, -(-rows.count() // rows_per_file))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, k, out, tokens = encoder(tokenizer_path, keep_space=True), TaskContext.get().partitionId(), None, 0
        uri = f"{path}/ids-{k:06d}.zst"
        for b in batches:
            buf, off = utf8(b.column(1))
            for i, j in blocks(off):
                out = out or FrameWriter(uri, frame_bytes)
                ids, at = enc.encode(buf, off[i : j + 1], end_id)
                data, at = ids.tobytes(), (4 * at).tolist()
                for d, lo, hi in zip(b.column(0).slice(i, j - i).to_pylist(), at, at[1:], strict=False):
                    out.add(d, data[lo:hi])
        if out:
            out.close()
            tokens, n = sum(out.counts), len(out.counts)
            yield pa.RecordBatch.from_pylist([{"file": k, "uri": uri, "n_docs": n, "n_tokens": tokens}], schema=pa.schema([("file", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    made = rows.mapInArrow(write, "file long, uri string, n_docs long, n_tokens long").toPandas().sort_values("file")  # a row for each file
    made["before"] = made["n_tokens"].cumsum() - made["n_tokens"]
    return spark.createDataFrame(made.astype({"file": "int64", "n_docs": "int64", "n_tokens": "int64", "before": "int64"}), "file long, uri string, n_docs long, n_tokens long, before long") if len(made) else spark.createDataFrame([], "file long, uri string, n_docs long, n_tokens long, before long")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read whole files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary)."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, before in zip(b.column("uri").to_pylist(), b.column("before").to_pylist(), strict=True):
                f = FrameReader(uri)
                for at in range(0, len(f.ids), 2000):
                    rows = [(f.document(r), int(f.ids[r]), before + int(f.ends[r] - f.counts[r]), int(f.counts[r])) for r in range(at, min(at + 2000, len(f.ids)))]
                    cols = [[None if d == NO_ID else d for _, d, _, _ in rows], [s for _, _, s, _ in rows], [n for _, _, _, n in rows], [zlib.crc32(x) for x, _, _, _ in rows]] + [[x for x, _, _, _ in rows]] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                f.close()

    files = manifest.count()
    return manifest.repartition(max(1, files), "file").mapInArrow(read, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def fetch_documents(spark: SparkSession, manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """ids of the documents asked for; each task opens one file and decompresses only their frames."""
    wanted = doc_ids.select("doc_id").distinct()

    def where(batches):
        for b in batches:
            for uri in b.column("uri").to_pylist():
                f = FrameReader(uri)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(f.ids)), pa.array([None if d == NO_ID else int(d) for d in f.ids], pa.int64()), pa.array(np.arange(len(f.ids)), pa.int64())], names=["uri", "doc_id", "row"])
                f.close()

    def fetch(batches):
        for b in batches:
            for uri in dict.fromkeys(b.column("uri").to_pylist()):
                f = FrameReader(uri)
                rows = [(d, f.document(r)) for u, d, r in zip(*(b.column(c).to_pylist() for c in ("uri", "doc_id", "row")), strict=True) if u == uri]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["doc_id", "ids"])
                f.close()

    places = manifest.mapInArrow(where, "uri string, doc_id long, row long").join(wanted, "doc_id")
    return places.select("uri", "doc_id", "row").repartition("uri").sortWithinPartitions("uri", "row").mapInArrow(fetch, "doc_id long, ids binary")
