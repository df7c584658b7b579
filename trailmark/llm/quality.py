"""Byte-level convolutional quality classifier in numpy.

Filters of 6 bytes slide over every byte of a document; segments of 64 bytes are max-pooled, and
overlapping chunks of segments again; the mean and the maximum over all chunks are combined into one
probability. Each filter is a sum of one weight for each byte and tap, learned end to end by Adam.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import blocks, utf8
from .shared import renamed_aside, written
from .tokens import release
from .workers import give_back, gives_back

TAPS, SEGMENT, CHUNK, STRIDE = 6, 64, 4, 3  # bytes, bytes, segments in a chunk, segments from chunk to chunk
FAR = np.float32(-1e9)


class Layout:
    """A block of texts laid out in whole segments with zero bytes between, and its chunks."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, i: int, j: int):
        size = np.diff(off[i : j + 1])
        self.segments = (size + TAPS - 1) // SEGMENT + 1
        begin = np.append(0, np.cumsum(self.segments))[:-1] * SEGMENT
        n = int(self.segments.sum()) * SEGMENT
        self.bytes = np.zeros(n + TAPS, np.uint8)
        rel = off[i : j + 1] - off[i]
        self.bytes[np.arange(rel[-1]) + np.repeat(begin - rel[:-1], size)] = buf[off[i] : off[j]]
        pad = np.ones(n, bool)
        pad[np.arange(rel[-1]) + np.repeat(begin - rel[:-1], size)] = False
        self.pad = np.flatnonzero(pad)
        self.pad = self.pad[~np.isin(self.pad, begin)]  # an empty text keeps one window
        self.chunks = np.maximum(1, -(-(self.segments - CHUNK) // STRIDE) + 1)
        first = np.append(0, np.cumsum(self.segments))[:-1]
        nth = np.arange(self.chunks.sum()) - np.repeat(np.append(0, np.cumsum(self.chunks))[:-1], self.chunks)
        low = np.repeat(first, self.chunks) + nth * STRIDE
        top = np.repeat(first + self.segments, self.chunks) - 1
        self.parts = np.minimum(low[:, None] + np.arange(CHUNK), top[:, None])  # (chunks, CHUNK) segments
        self.starts = np.append(0, np.cumsum(self.chunks))[:-1]


class ByteConv:
    def __init__(self, filters: int = 16, seed: int = 7, prior: float = 0.5):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.3, (TAPS, 256, filters)).astype(np.float32)
        self.w[:, 0] = 0
        self.b = np.zeros(filters, np.float32)
        self.v = rng.normal(0, 0.1, 2 * filters).astype(np.float32)
        self.c = np.float32(np.log(prior / (1 - prior)))

    def tables(self) -> list[np.ndarray]:
        return [(self.w[k][:, None, :] + self.w[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, TAPS, 2)]

    def windows(self, x: Layout, tables: list[np.ndarray]) -> np.ndarray:
        """(bytes, filters): each filter at each byte."""
        n = len(x.bytes) - TAPS
        pairs = x.bytes[:-1].astype(np.uint16) << 8 | x.bytes[1:]
        out = tables[0].take(pairs[:n], axis=0)
        for k, t in enumerate(tables[1:], 1):
            out += t.take(pairs[2 * k : 2 * k + n], axis=0)
        out[x.pad] = FAR
        return out

    def pooled(self, x: Layout, tables: list[np.ndarray]) -> np.ndarray:
        """(documents, 2 * filters)."""
        seg = self.windows(x, tables).reshape(-1, SEGMENT, len(self.b)).max(axis=1)
        chunk = np.maximum(seg[x.parts].max(axis=1) + self.b, 0)
        return np.hstack([np.add.reduceat(chunk, x.starts, axis=0) / x.chunks[:, None], np.maximum.reduceat(chunk, x.starts, axis=0)]).astype(np.float32)

    def scores(self, buf: np.ndarray, off: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        out = [self.pooled(Layout(buf, off, i, j), tables) @ self.v + self.c for i, j in blocks(off, 1 << 19)]
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def gradients(self, x: Layout, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss; only the byte that a pool chose passes a gradient on."""
        f = len(self.b)
        win = self.windows(x, self.tables()).reshape(-1, SEGMENT, f)
        at_seg = win.argmax(axis=1)
        seg = np.take_along_axis(win, at_seg[:, None], axis=1)[:, 0]
        parts = seg[x.parts]
        at_part = parts.argmax(axis=1)
        raw = np.take_along_axis(parts, at_part[:, None], axis=1)[:, 0] + self.b
        chunk = np.maximum(raw, 0)
        mean, top = np.add.reduceat(chunk, x.starts, axis=0) / x.chunks[:, None], np.maximum.reduceat(chunk, x.starts, axis=0)
        pool = np.hstack([mean, top])
        z = pool @ self.v + self.c
        dz = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)).astype(np.float32)
        doc = np.repeat(np.arange(len(y)), x.chunks)
        is_top = chunk == top[doc]
        d = dz[doc, None] * (self.v[:f] / x.chunks[doc, None] + self.v[f:] * is_top) * (raw > 0)
        where = np.take_along_axis(x.parts, at_part, axis=1)
        place = where * SEGMENT + at_seg[where, np.arange(f)]
        gw = np.zeros_like(self.w)
        for k in range(TAPS):
            code = x.bytes[place + k].astype(np.int64) * f + np.arange(f)
            gw[k] = np.bincount(code.ravel(), weights=d.ravel(), minlength=256 * f).reshape(256, f)
        gw[:, 0] = 0
        return [gw, d.sum(axis=0), (pool * dz[:, None]).sum(axis=0), dz.sum()]

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.02, seed: int = 7) -> ByteConv:
        rng = np.random.default_rng(seed)
        m = [0.0] * 4
        s = [0.0] * 4
        step, total = 0, steps
        while step < steps:
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch)[: steps - step]:
                own = order[k : k + batch]
                buf = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
                off = np.append(0, np.cumsum([len(texts[i]) for i in own]))
                step += 1
                for i, (name, g) in enumerate(zip("wbvc", self.gradients(Layout(buf, off, 0, len(own)), y[own]), strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.99 * s[i] + 0.01 * g * g
                    move = rate * (1 - step / (total + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-6)
                    setattr(self, name, (getattr(self, name) - move).astype(np.float32))
        return self


def held_out(doc_id, folds: int = 5):
    """Column: crc32 of the id as text leaves remainder 0 (a null id is held out)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, max_bytes: int = 24 << 20, filters: int = 16, steps: int = 500) -> ByteConv:
    """Fit on a bounded sample of labelled rows that are not held out.

    The sample is the first max_rows by a hash of the id, less texts that would take the sum of whole texts
    above max_bytes; lengths alone decide, before texts are fetched. Null labels and ids teach nothing; an id with several labels or texts counts as so
    many rows. Without rows of both labels the model gives the smoothed share of label 1; where texts left out are the cause, or most are left out, a warning says so.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # ids alone are shuffled
    chosen = there.withColumn("h", F.xxhash64(F.lit(11), "doc_id")).orderBy("h", "doc_id", "y").limit(max_rows)
    labelled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows at most
    sample = written(labelled.select("h", "doc_id", "y", "text", F.xxhash64("text").alias("t")), "labelled")  # one scan of all texts
    sized = sample.groupBy("h", "doc_id", "y", "t").agg(F.first(F.octet_length("text")).alias("size"), F.count("*").alias("n"))
    picked, total, left_out = [], 0, Counter()
    for r in sorted(sized.collect()):
        fit = min(r["n"], (max_bytes - total) // r["size"]) if r["size"] else r["n"]
        total += fit * r["size"]
        left_out[r["y"]] += r["n"] - fit
        if fit:
            picked.append((r["doc_id"], r["t"], r["y"], fit))
    wanted = docs.sparkSession.createDataFrame([x[:2] for x in picked], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long").distinct()  # max_bytes of texts at most
    found = {(r["doc_id"], r["t"]): r["text"].encode() for r in sample.select("doc_id", "t", "text").join(F.broadcast(wanted), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).collect()} if picked else {}
    texts = [found[i, t] for i, t, _, n in picked for _ in range(n)]
    y = [label_of for _, _, label_of, n in picked for _ in range(n)]
    if sum(left_out.values()) > len(y) or set(left_out) != set(y):
        warnings.warn(f"quality sample: {len(y)} rows with labels {sorted(set(y))}; texts of {sum(left_out.values())} rows did not fit in {max_bytes} bytes", stacklevel=2)
    prior = (sum(y) + 1) / (len(y) + 2)
    model = ByteConv(filters, prior=prior)
    if len(set(y)) < 2:
        model.v[:] = 0
        return model
    return model.fit(texts, np.array(y, np.float32), steps)


def score_quality(docs: DataFrame, model: ByteConv) -> DataFrame:
    """Add score (0 to 1) to docs, from each whole text alone. A null text is an empty one; clashing columns get the suffix _in."""
    docs = renamed_aside(docs, ("doc_id", "text"), ("score",))
    give_back()  # what training has freed would stay with the driver
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    names = docs.columns

    @gives_back
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # chunks kept by an earlier stage's encoder
        m = held.value
        tables = m.tables()
        for b in batches:
            buf, off = utf8(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.scores(buf, off, tables), pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double")


def crc_fold(doc_id: int, folds: int = 5) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
