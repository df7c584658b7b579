"""Byte payloads as Netpbm and BMP images: lossless storing, decoding, area-resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import blocks, utf8
from .shared import renamed_aside, written

PNM_HEAD = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary greymap of a (height, width) uint8 array."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed BMP: 8-bit grey with a palette for (h, w), 24-bit for (h, w, 3)."""
    h, w = samples.shape[:2]
    bits = 8 if samples.ndim == 2 else 24
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256)) if bits == 8 else b""
    row = -(-w * bits // 32) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * bits // 8] = samples[::-1].reshape(h, -1) if bits == 8 else samples[::-1, :, ::-1].reshape(h, -1)
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, body.size, 2835, 2835, 256 * (bits == 8), 0) + palette + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) uint8 array of a P5, P6 or uncompressed BMP image; ValueError for others."""
    if m := PNM_HEAD.match(data):
        kind, w, h, top = (int(x) for x in m.groups())
        if not 0 < top < 256:
            raise ValueError("only 8-bit samples")
        shape = (h, w) if kind == 5 else (h, w, 3)
        if len(data) - m.end() < int(np.prod(shape)):
            raise ValueError("image is cut short")
        return np.frombuffer(data, np.uint8, int(np.prod(shape)), m.end()).reshape(shape)
    if data[:2] == b"BM" and len(data) >= 54:
        at, head, w, h = struct.unpack_from("<IIii", data, 10)
        bits, packing = struct.unpack_from("<HI", data, 28)
        if bits not in (8, 24) or packing:
            raise ValueError("only uncompressed 8 or 24-bit BMP")
        row = -(-w * bits // 32) * 4
        if len(data) < at + row * abs(h):
            raise ValueError("image is cut short")
        body = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * bits // 8]
        body = body[::-1] if h > 0 else body
        if bits == 24:
            return body.reshape(abs(h), w, 3)[:, :, ::-1]
        colours = np.frombuffer(data, np.uint8, at - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1]
        if (colours == np.arange(len(colours), dtype=np.uint8)[:, None]).all():
            return body
        return colours[body]
    raise ValueError("neither Netpbm nor BMP")


def integral(image: np.ndarray) -> np.ndarray:
    """Sums of the grey image above and left of each corner, (h + 1, w + 1) float64."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
    return table


def area_means(table: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area (cells may cut pixels), from an integral image; float64 (height, width)."""
    h, w = table.shape[0] - 1, table.shape[1] - 1

    def along(t: np.ndarray, n: int, size: int) -> np.ndarray:
        edge = np.linspace(0, size, n + 1)
        low = np.minimum(edge.astype(np.int64), size - 1)
        part = (edge - low).reshape(-1, *[1] * (t.ndim - 1))
        return t[low] * (1 - part) + t[low + 1] * part

    cut = along(along(table, height, h).T, width, w).T
    return np.diff(np.diff(cut, axis=0), axis=1) * (height * width / (h * w))


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_means(integral(image), height, width)


def hash_of(table: np.ndarray, size: int = 8) -> str:
    """size*size bits in hex: whether each cell of an area-resized image is brighter than its right neighbour; from the integral image."""
    small = np.round(area_means(table, size, size + 1), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    return hash_of(integral(image), size)


def npy(samples: np.ndarray) -> bytes:
    """An NPY file."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(samples), allow_pickle=False)
    return out.getvalue()


def tile_of(table: np.ndarray, size: int = 16) -> bytes:
    """The image area-resized to size x size 8-bit samples, as an NPY file; from the integral image."""
    return npy(np.clip(np.rint(np.round(area_means(table, size, size), 6)), 0, 255).astype(np.uint8))


def payload_of(text: bytes, unit: int = 64) -> bytes:
    """The bytes with 0 bytes up to a positive multiple of unit."""
    return text + bytes(-len(text) % unit if text else unit)


def form_of(payload: bytes, form: str) -> str:
    """pgm or bmp; both: by the payload's checksum, so equal payloads have one form."""
    return ("pgm", "bmp")[zlib.crc32(payload) & 1] if form == "both" else form


def store_texts(docs: DataFrame, width: int = 64, form: str = "both") -> DataFrame:
    """Media column of docs(doc_id, text): the UTF-8 bytes as an image of width 8-bit samples a row.

    Adds n_bytes and media (binary; form pgm, bmp or both). A null text is an empty one (one
    row of zeros); a text of any length is one image; repeated rows are repeated; an empty table gives no rows. Other columns stay,
    with the suffix _in where a name clashes.
    """
    docs = renamed_aside(docs, ("doc_id", "text"), ("n_bytes", "media", "tile"))
    kept = [c for c in docs.columns if c != "text"]
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = utf8(b.column("text"))
            for i, j in blocks(off):
                media = []
                for k in range(i, j):
                    payload = payload_of(buf[off[k] : off[k + 1]].tobytes(), width)
                    media.append(encode[form_of(payload, form)](np.frombuffer(payload, np.uint8).reshape(-1, width)))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(np.diff(off[i : j + 1])), pa.array(media, pa.binary())], names=[*kept, "n_bytes", "media"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(store, f"{kinds}, n_bytes long, media binary")


def written_media(docs: DataFrame, **options) -> DataFrame:
    """store_texts, written as a table in the shared folder and read back."""
    return written(store_texts(docs, **options), "media")


def media_features(stored: DataFrame, hash_size: int = 8, tile: int = 16) -> DataFrame:
    """Decode stored(doc_id, n_bytes, media) and describe it.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (difference hash), tile (binary: NPY of tile x tile samples), both from one integral image. A medium that can't be decoded
    has null payload columns, feature and tile, a null one null media columns too; no rows, no rows.
    """
    kinds = [("doc_id", "long"), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("tile", "binary")]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in kinds])

    def one(doc_id, n, media):
        if media is None:
            return (doc_id, n, None, None, None, None, None, None, None)
        own = (len(media), hashlib.sha256(media).hexdigest())
        try:
            image = decode(media)
        except ValueError:
            return (doc_id, n, None, None, None, *own, None, None)
        payload = image.tobytes()
        table = integral(image) if image.size else None
        return (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, *((None, None) if table is None else (hash_of(table, hash_size), tile_of(table, tile))))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                p = b.slice(i, 500)
                rows = [one(*(x.as_py() for x in r)) for r in zip(*(p.column(c) for c in ("doc_id", "n_bytes", "media")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(describe, ", ".join(f"{n} {k}" for n, k in kinds))


def written_features(stored: DataFrame, **options) -> DataFrame:
    """media_features, its NPY tiles and hashes written as a table in the shared folder and read back."""
    return written(media_features(stored, **options), "tiles")


def write_tiles(described: DataFrame, path: str) -> DataFrame:
    """Write each partition's tiles as one NPY stack (n, size, size) under path; return file, doc_id and place."""
    from .token_files import filesystem

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(path)
        fs.create_dir(top, recursive=True)
        for k, b in enumerate(batches):
            ids = b.column("doc_id").to_pylist()
            stack = [np.load(io.BytesIO(x), allow_pickle=False) for x in b.column("tile").to_pylist()]
            if not stack:
                continue
            out = io.BytesIO()
            np.save(out, np.stack(stack), allow_pickle=False)
            name = f"{top}/tiles-{TaskContext.get().partitionId():06d}-{k:05d}.npy"
            temp = f"{name}.{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(temp) as f:
                f.write(out.getvalue())
            fs.move(temp, name)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array(range(len(ids)), pa.int64())], names=["file", "doc_id", "place"])

    return described.where(F.col("tile").isNotNull()).select("doc_id", "tile").mapInArrow(write, "file string, doc_id long, place long")
