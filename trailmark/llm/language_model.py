"""Prediction by partial matching over bytes, pretrained on the corpus, and a base score of tokens.

The byte-context trie holds the counts of each byte after every context of up to six bytes, over all
training texts. Escapes follow method D (half a count for each distinct symbol), and a
shorter context excludes the symbols that the longer one has seen. In a static trie those excluded at a
context are the symbols of the context one byte longer, so the probability of a byte after six bytes depends
on these seven bytes alone: it is worked out once for each seven bytes that occur, and a document's code length is
a sum over its bytes.

Neither token counts nor the trie have a bound, so neither is broadcast: documents are dealt into units
of bounded size; each unit's distinct tokens and seven-byte codes are packed by where they are counted (a code by
the three bytes before its last, so that all contexts of three to six bytes meet there), meet their counts in a
shuffle, and the results go back to the unit. Only the trie's top (two bytes of context, at most 2^24 counts) is sent to all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import LOWER, SPACE, blocks, mix, span_hashes, spaced, utf8, word_spans
from .shared import written

TOKEN, TRIE, TOP = 0, 1, 2  # kinds of counts
ORDER, LEAST = 6, 3  # bytes of context: the most, and the least that is counted by place


def is_held_out(doc_id, folds: int = 5, fold: int = 1):
    """Column: crc32 of the id as text leaves the remainder `fold` (a null id is held out)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(True))


def byte_block(buf: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts i to j in lower case (A-Z), each followed by one end byte 0; and where each begins."""
    b, begin = spaced(buf, off, i, j, fill=0)
    return LOWER[b], begin


def trie_codes(b: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each byte, the six before it in its own text (0 before the start), the nearest first, and itself, as one number."""
    code = b.astype(np.uint64)
    place = np.arange(len(b)) - np.repeat(begin[:-1], np.diff(begin))
    for k in range(1, ORDER + 1):
        back = np.zeros(len(b), np.uint64)
        back[k:] = b[: max(0, len(b) - k)]
        back[place < k] = 0
        code |= back << np.uint64(8 * (ORDER + 1 - k))
    return code


def shorter(code: np.ndarray, order: int, to: int) -> np.ndarray:
    """Codes of `order` bytes of context with only the nearest `to` of them."""
    return (code >> np.uint64(8 * (order + 1 - to))) << np.uint64(8) | (code & np.uint64(255))


def top_index(code: np.ndarray, order: int) -> np.ndarray:
    """Index of a code's last two bytes of context and symbol in the top's tables."""
    c = shorter(code, order, 2).astype(np.int64)  # nearest, second, symbol
    return ((c >> 8) & 255) << 16 | (c >> 16) << 8 | (c & 255)


def chance(n, total, kinds, lower):
    """Method D: a symbol has (n - 1/2) / total, an escape (kinds / 2) / total and then lower; nothing counted: lower."""
    some = np.maximum(total, 1)
    return np.where(n > 0, (n - 0.5) / some, np.where(total > 0, kinds / 2 / some, 1.0) * lower)


class Top:
    """Dense tables of the trie's top, by the code of two bytes and a symbol: counts, and the probability

    of the symbol after the two bytes (full) and after an escape from them (below)."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        n3 = np.zeros(1 << 24)  # exact to 2^53: sums of the same counts are subtracted from its sums
        n3[codes] = counts
        self.n3 = n3
        cube = n3.reshape(256, 256, 256)  # two before, one before, symbol
        n2 = cube.sum(axis=0)
        n1 = n2.sum(axis=0)
        self.total, self.kinds = cube.sum(axis=2).ravel(), (cube > 0).sum(axis=2).ravel()
        seen1, seen2 = n1 > 0, n2 > 0
        unseen = 1.0 / max(1, 256 - int(seen1.sum()))

        def step(n: np.ndarray, excluded: np.ndarray, lower: np.ndarray) -> np.ndarray:
            """Probabilities at one order: n over what is not excluded, escapes to lower."""
            left = np.where(excluded, 0.0, n)
            return chance(left, left.sum(axis=-1, keepdims=True), (left > 0).sum(axis=-1, keepdims=True), lower)

        base = step(n1[None], np.zeros((1, 256), bool), np.full((1, 256), unseen))
        after1 = step(np.broadcast_to(n1, (256, 256)), seen2, np.full((256, 256), unseen))  # after an escape from one byte
        self.full, self.below = np.empty((256, 256, 256), np.float32), np.empty((256, 256, 256), np.float32)
        for two in range(256):
            own = cube[two]
            seen3 = own > 0
            below = np.where(seen2.any(axis=1, keepdims=True), step(n2, seen3, after1), base)
            self.below[two] = below
            self.full[two] = step(own, np.zeros_like(seen3), below)
        self.full, self.below = self.full.reshape(-1), self.below.reshape(-1)


def code_scores(top: Top, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of each distinct code's last byte after its first six, from the counts of all codes with the same last three bytes of context."""
    levels = [(code, n.astype(np.int64), np.arange(len(code)))]  # codes of an order, their counts, and where each code of one byte more is among them
    for order in range(ORDER, LEAST, -1):
        key, parent = np.unique(shorter(levels[-1][0], order, order - 1), return_inverse=True)
        levels.append((key, np.bincount(parent, weights=levels[-1][1], minlength=len(key)).astype(np.int64), parent))
    after = full = None  # after an escape from one byte more; without
    longer: tuple = ()
    for order in range(LEAST, ORDER + 1):
        key, count, _ = levels[ORDER - order]
        context = np.cumsum(np.append(0, np.diff(key >> np.uint64(8)) != 0))
        total = np.bincount(context, weights=count)
        kinds = np.bincount(context, weights=count > 0)
        if order == LEAST:
            at = top_index(key, order)
            pair = at >> 8
            below = top.n3[at]
            upper_total, upper_kinds, up_after, up_full = top.total[pair], top.kinds[pair], top.below[at], top.full[at]
        else:
            parent = levels[ORDER - order + 1][2]
            below = longer[1][parent]
            upper_total, upper_kinds, up_after, up_full = longer[2][parent], longer[3][parent], after[parent], full[parent]
        seen = np.bincount(context, weights=np.where(count > 0, below, 0))  # what the shorter context has of the symbols seen here
        escaped = chance(below, upper_total - seen[context], upper_kinds - kinds[context], up_after)
        after, full = escaped, np.where(total[context] > 0, chance(count, total[context], kinds[context], escaped), up_full)
        longer = (key, count, total[context], kinds[context])
    return np.log10(np.maximum(full, 1e-300))


def packed_numbers(x: np.ndarray) -> bytes:
    """Fixed-width numbers, compressed byte by byte."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def numbers(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def packed_keys(x: np.ndarray) -> bytes:
    """Sorted uint64 keys by their differences."""
    return packed_numbers(np.diff(x, prepend=np.uint64(0)))


def keys_of(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data, np.uint64), dtype=np.uint64)


def dealt(docs: DataFrame, unit_bytes: int) -> tuple[DataFrame, int]:
    """docs(doc_id, text) with held_out and a unit, about unit_bytes of text each: a hash of id, text and row number, so that repeated rows are dealt out too.

    The rows are stored with their units, as a number given anew would differ where the input is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    units = max(16, math.ceil(total / unit_bytes))
    unit = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.monotonically_increasing_id()), F.lit(units)).cast("int")
    return written(rows.withColumn("held_out", is_held_out(F.col("doc_id"))).withColumn("unit", unit), "units"), units


PACKED = pa.schema([("unit", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary())])


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    distinct, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return distinct, np.bincount(inverse, weights=np.concatenate([np.zeros(0, np.int64), *counts]), minlength=len(distinct)).astype(np.int64)


def unit_counts(rows: DataFrame, units: int) -> DataFrame:
    """(unit, kind, part, keys, numbers): each unit's distinct tokens and codes by the part that counts them; counts of training documents only."""

    def count(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: tuple[list, list] = ([], [])
        codes: tuple[list, list] = ([], [])
        unit = None
        for batch in group:
            unit = batch.column("unit")[0].as_py() if batch.num_rows else unit
            learn = ~np.asarray(batch.column("held_out").cast(pa.int8()), bool)
            buf, off = utf8(batch.column("text"))
            for i, j in blocks(off):
                b, begin = byte_block(buf, off, i, j)
                text = b.copy()
                text[begin[1:] - 1] = 32
                start, end = word_spans(text)
                own = learn[i:j]
                for (keys, sums), key, weight in ((tokens, span_hashes(text, start, end), own[np.searchsorted(begin, start, side="right") - 1]), (codes, trie_codes(b, begin), np.repeat(own, np.diff(begin)))):
                    learned, n = np.unique(key[weight], return_counts=True)
                    rest = np.setdiff1d(key[~weight], learned)
                    keys += [learned, rest]
                    sums += [n, np.zeros(len(rest), np.int64)]
        if unit is None:
            return
        key, n = merged(*tokens)
        code, m = merged(*codes)
        three, k = np.unique(shorter(code, ORDER, 2), return_inverse=True)
        out = [(TOP, 0, packed_keys(three), packed_numbers(np.bincount(k, weights=m, minlength=len(three)).astype(np.int64)))]
        for kind, x, c, part in ((TOKEN, key, n, key % np.uint64(units)), (TRIE, code, m, mix(code >> np.uint64(8 * (ORDER + 1 - LEAST))) % np.uint64(units))):
            order = np.argsort(part, kind="stable")
            x, c, part = x[order], c[order], part[order]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            out += [(kind, int(part[lo]), packed_keys(x[lo:hi]), packed_numbers(c[lo:hi])) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo]
        for at in range(0, len(out), 256):
            kinds, parts, keys, sums = zip(*out[at : at + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([unit] * len(kinds), pa.int32()), pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(keys, pa.binary()), pa.array(sums, pa.binary())], schema=PACKED)

    return rows.repartitionById(units, "unit").mapInArrow(per_unit(count), "unit int, kind int, part int, keys binary, numbers binary")


def per_unit(function):
    """Turn a function of one unit's batches into one of a partition's, whose rows of a unit stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            ids = np.asarray(b.column("unit"))
            cuts = np.append(0, np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids)))
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and ids[lo] != now:
                    yield from function(iter(held))
                    held = []
                now = ids[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from function(iter(held))

    return run


def top_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes with two bytes of context and their counts over all units: 2^24 at most."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sums = merged([keys_of(x) for x in b.column("keys").to_pylist()], [numbers(x, np.int64) for x in b.column("numbers").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], names=["key", "n"])

    found = counts.where(F.col("kind") == TOP).select("keys", "numbers").mapInArrow(plain, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").toPandas()
    return found["key"].to_numpy(np.uint64), found["n"].to_numpy(np.int64)


def counted(counts: DataFrame, units: int) -> DataFrame:
    """The packed rows of tokens and codes again, with the tokens' counts over all units and the codes' scores as numbers.

    A row of unit -1 for each part holds its distinct tokens in training and the sum of their counts.
    """
    spark = counts.sparkSession
    held = spark.sparkContext.broadcast(top_counts(counts))
    tables: list[Top] = []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[list, list, list]] = {TOKEN: ([], [], []), TRIE: ([], [], [])}
        part = None
        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            for unit, kind, keys, sums in zip(*(b.column(c).to_pylist() for c in ("unit", "kind", "keys", "numbers")), strict=True):
                for to, x in zip(kept[kind], (unit, keys, sums), strict=True):
                    to.append(x)
        if part is None:
            return
        if not tables:
            three, n = held.value
            tables.append(Top(top_index(three, 2), n))
        for kind, (own, packed, sums) in kept.items():
            each = [keys_of(x) for x in packed]
            key, n = merged(each, [numbers(x, np.int64) for x in sums])
            worth = n if kind == TOKEN else code_scores(tables[0], key, n) if len(key) else np.zeros(0)
            if kind == TOKEN:
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([b""], pa.binary()), pa.array([np.array([(n > 0).sum(), n.sum()], np.int64).tobytes()], pa.binary())], schema=PACKED)
            for at in range(0, len(own), 64):
                back = [packed_numbers(worth[np.searchsorted(key, x)].astype(np.int64 if kind == TOKEN else np.float32)) for x in each[at : at + 64]]
                yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 64], pa.int32()), pa.array([kind] * len(back), pa.int32()), pa.array([part] * len(back), pa.int32()), pa.array(packed[at : at + 64], pa.binary()), pa.array(back, pa.binary())], schema=PACKED)

    rows = counts.where(F.col("kind") != TOP).repartitionById(units, "part")
    return rows.mapInArrow(score, "unit int, kind int, part int, keys binary, numbers binary")


def score_texts(docs: DataFrame, unit_bytes: int = 24 << 20) -> DataFrame:
    """Score every whole text of docs(doc_id, text); learn from those that are not held out.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are words in lower
    case (A-Z) and one end; base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))); score is the model's log10
    probability of the bytes (lower case, then an end byte 0; a byte 0 in a text counts as an end). A null text is an empty one; a
    null id is held out; repeated rows count as often as they occur; nothing to learn from gives
    uniform bytes and c = N = V = 0. Other columns are not read.
    """
    rows, units = dealt(docs, unit_bytes)
    worth = written(counted(written(unit_counts(rows, units), "unit_counts"), units), "unit_scores")
    n_train = rows.where(~F.col("held_out")).count()
    sums = [np.frombuffer(r["numbers"], np.int64) for r in worth.where("unit < 0").select("numbers").toLocalIterator()]  # two numbers a part
    distinct, total = np.sum([np.zeros(2, np.int64), *sums], axis=0).tolist()
    train_tokens, distinct = total + n_train, distinct + (n_train > 0)
    floor = train_tokens + 0.5 * (distinct + 1)
    end_score = math.log10((n_train + 0.5) / floor)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: Iterator[pa.RecordBatch], right: pa.Table) -> Iterator[pa.RecordBatch]:
        found = []
        for kind, number in ((TOKEN, np.int64), (TRIE, np.float32)):
            own = right.filter(pa.compute.equal(right.column("kind"), kind))
            key = np.concatenate([np.zeros(0, np.uint64), *(keys_of(x) for x in own.column("keys").to_pylist())])
            value = np.concatenate([np.zeros(0, number), *(numbers(x, number) for x in own.column("numbers").to_pylist())])
            order = np.argsort(key)
            found += [key[order], value[order]]
        key, c, code, value = found
        worth = np.log10((c + 0.5) / floor)
        for batch in left:
            buf, off = utf8(batch.column("text"))
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for i, j in blocks(off):
                b, begin = byte_block(buf, off, i, j)
                each, inverse = np.unique(trie_codes(b, begin), return_inverse=True)
                ppm = np.add.reduceat(value[np.searchsorted(code, each)].astype(np.float64)[inverse], begin[:-1])
                b[begin[1:] - 1] = 32
                start, end = word_spans(b)
                at = np.searchsorted(key, span_hashes(b, start, end))
                doc = np.searchsorted(begin, start, side="right") - 1
                n = np.bincount(doc, minlength=j - i)
                for col, x in zip(cols, (n + 1, np.bincount(doc, weights=c[at] > 0, minlength=j - i) + (n_train > 0), np.bincount(doc, weights=worth[at], minlength=j - i) + end_score, ppm), strict=True):
                    col.append(x)
            n, k, base, ppm = (np.concatenate(x) for x in cols)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64)), pa.array(k.astype(np.int64)), pa.array(np.full(len(n), train_tokens, np.int64)), pa.array(base), pa.array(ppm)], schema=schema)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(score(iter(left.combine_chunks().to_batches()), right)), schema=schema)

    own = rows.repartitionById(units, "unit").groupBy("unit")
    back = worth.where("unit >= 0").select("unit", "kind", "keys", "numbers").repartitionById(units, "unit").groupBy("unit")
    return own.cogroup(back).applyInArrow(joined, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
