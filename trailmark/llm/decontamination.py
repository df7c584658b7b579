"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A passage of m characters that occurs with at most k edits shares m - q + 1 - k*q q-grams with the
place where it occurs, on diagonals no more than k apart. Shared q-grams are counted in overlapping
bands of diagonals; a band that reaches the bound is a candidate region, and a banded alignment there
finds the least number of edits. Short items are searched unchanged, as whole words. Documents are
never shuffled; the benchmark goes out in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import mix
from .workers import gives_back

BITS = 22
SHARED = 2_000_000
GAP = "\x00"


def normal(text: str) -> str:
    """Lower case (a character that would become several stays), white-space runs as one space, trimmed."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return " ".join(low.replace(GAP, " ").split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(a: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram."""
    h = np.zeros(max(0, len(a) - q + 1), np.uint64)
    for k in range(q):
        h = h * np.uint64(0x100000001B3) + a[k : k + len(h)]
    return mix(h)


class Patterns:
    """A block of benchmark items, their q-grams and bounds."""

    def __init__(self, items: list[tuple[int | None, str]], edit_rate: float, q: int, min_chars: int):
        texts = [(i, normal(t)) for i, t in items]
        whole = [(i, t) for i, t in texts if len(t) >= max(min_chars, q)]
        short = [(i, t) for i, t in texts if 0 < len(t) < max(min_chars, q)]
        self.q, self.ids, self.texts = q, [i for i, _ in whole + short], [t for _, t in whole + short]
        self.arrays = [codes(t) for _, t in whole]  # short items come after these
        m = np.array([len(t) for _, t in whole], np.int64)
        self.k = np.minimum((edit_rate * m).astype(np.int64), (m - q) // q)
        self.need = m - q + 1 - self.k * q
        self.fewest = int(np.maximum(self.need, 1).min(initial=1 << 60))
        self.width = int(max(self.k.max(initial=1), 16))
        self.longest = int(m.max(initial=0))
        hashes = [grams(a, q) for a in self.arrays]
        own = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(own, kind="stable")
        own, self.item, self.at = own[order], item[order], at[order]
        self.keys, self.first = np.unique(own, return_index=True)
        self.last = np.append(self.first[1:], len(own))
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def regions(self, a: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to): where an occurrence may begin, by bands of diagonals, each twice the width, half overlapping."""
        if not len(self.keys):
            return []
        h = grams(a, self.q)
        pos = np.flatnonzero(self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(pos):
            return []
        k = np.searchsorted(self.keys, h[pos])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == h[pos]
        pos, k = pos[same], k[same]
        n = self.last[k] - self.first[k]
        if int(n.sum()) < self.fewest:  # no band can reach its bound
            return []
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        bands = (len(a) + self.longest) // self.width + 3
        ends = np.cumsum(n)
        lo = 0
        while lo < len(n):  # a part of the places at a time, about SHARED shared q-grams
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SHARED, side="right")))
            own, size = n[lo:hi], int(n[lo:hi].sum())
            use = np.repeat(self.first[k[lo:hi]] - (np.cumsum(own) - own), own) + np.arange(size)
            diagonal = np.repeat(pos[lo:hi], own) - self.at[use] + self.longest
            each, inverse = np.unique(np.concatenate([keys, self.item[use] * bands + diagonal // self.width + 1]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.append(counts, np.ones(size)), minlength=len(each)).astype(np.int64)
            keys, lo = each, hi
        start = np.union1d(keys, keys - 1)  # a band is two halves; it is told by its first

        def of(half: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, half), len(keys) - 1)
            return np.where(keys[at] == half, counts[at], 0)

        start = start[of(start) + of(start + 1) >= np.maximum(self.need, 1)[(start + 1) // bands]]
        found: list[tuple[int, int, int]] = []
        for i, b in zip(((start + 1) // bands).tolist(), (start - (start + 1) // bands * bands - 1).tolist(), strict=True):
            lo, hi = b * self.width - self.longest, (b + 2) * self.width - self.longest
            if found and found[-1][0] == i and lo <= found[-1][2]:
                found[-1] = (i, found[-1][1], hi)
            else:
                found.append((i, lo, hi))
        return found

    def short_finder(self) -> ahocorasick.Automaton | None:
        """Automaton of the short items; equal ones share an entry. It is built where it is used, not sent."""
        uses: dict[str, list[int]] = {}
        for i in range(len(self.arrays), len(self.ids)):
            uses.setdefault(self.texts[i], []).append(i)
        if not uses:
            return None
        finder = ahocorasick.Automaton()
        for t, items in uses.items():
            finder.add_word(t, (len(t), items))
        finder.make_automaton()
        return finder


def align(pattern: np.ndarray, text: np.ndarray, k: int, low: int = 0, high: int | None = None) -> tuple[int, int, int] | None:
    """Least edits of the pattern against a part of text that begins at low to high, at most k: (edits, from, to).

    Only the diagonals of the band, and k on each side of it, are kept: a row of cells for each character of the pattern.
    """
    n, m = len(text), len(pattern)
    d = np.arange(low - k, (n if high is None else high) + k + 1)
    far = 1 << 20
    cost, origin = np.where((d >= 0) & (d <= n), 0, far), d.copy()
    padded = np.full(len(d) + m, 0xFFFFFFFF, np.uint32)  # the text's character on each diagonal of each row, none outside the text
    lo, hi = max(0, int(d[0])), min(n, int(d[0]) + len(padded))
    if lo < hi:
        padded[lo - d[0] : hi - d[0]] = text[lo:hi]
    steps = np.arange(len(d))
    for i, c in enumerate(pattern):
        same = cost + (padded[i : i + len(d)] != c) + np.where(d + i >= n, far, 0)
        skip = np.append(cost[1:] + 1, far)  # a character of the pattern that the text lacks
        best = np.minimum(same, skip)
        start = np.where(same <= skip, origin, np.append(origin[1:], 0))
        level = (best - steps) * (len(d) + 1) - steps  # characters that the text has too many: a chain from the left
        source = -np.minimum.accumulate(level) % (len(d) + 1)
        cost, origin = best[source] + steps - source, start[source]
        if cost.min() > k:
            return None
    cost = np.where((d + m >= 0) & (d + m <= n), cost, far)
    at = int(np.argmin(cost))
    return (int(cost[at]), int(origin[at]), int(d[at]) + m) if cost[at] <= k else None


def search(patterns: Patterns, text: str, short: ahocorasick.Automaton | None = None, any_one: bool = False) -> list[tuple[int, int, int, int]]:
    """(item, edits, from, to) of each item's best occurrence in a normalised text; short ones by their automaton. any_one: the first found will do."""
    best: dict[int, tuple[int, int, int]] = {}
    for end, (m, items) in short.iter(text) if short is not None else ():
        lo, hi = end - m + 1, end + 1
        inside = (lo > 0 and text[lo - 1].isalnum() and text[lo].isalnum()) or (hi < len(text) and text[hi].isalnum() and text[end].isalnum())
        if not inside:
            for i in items:
                best.setdefault(i, (0, lo, hi))
            if any_one:
                break
    a = codes(text)
    for i, lo, hi in patterns.regions(a) if not (best and any_one) else ():
        k, m = int(patterns.k[i]), len(patterns.texts[i])
        at = text.find(patterns.texts[i], max(0, lo - k), min(len(text), hi + m + k))
        hit = (0, at, at + m) if at >= 0 else None
        if hit is None and best.get(i, (k + 1,))[0] > 0:
            hit = align(patterns.arrays[i], a, k, lo, hi)
        if hit and hit < best.get(i, (k + 1, 0, 0)):
            best[i] = hit
            if any_one:
                break
    return [(i, *x) for i, x in sorted(best.items())]


def pattern_blocks(benchmark: DataFrame, edit_rate: float, q: int, min_chars: int, block_chars: int) -> Iterator[Patterns]:
    """The benchmark's items, about block_chars characters at a time; a block is what the driver and a task hold at once."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_chars))
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        patterns = Patterns([tuple(r) for r in part.collect()], edit_rate, q, min_chars)
        if patterns.ids:
            yield patterns


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_rate: float = 0.1, q: int = 8, min_chars: int = 40, block_chars: int = 1_000_000) -> DataFrame:
    """Occurrences of benchmark(item_id, text) in whole texts of docs(doc_id, text).

    One row for each document row and item found: doc_id, item_id, edits, n_chars of the item, and
    start, end in the normalised text (lower case, single spaces) of the item's best occurrence. An occurrence has at most
    edit_rate edits a character; items shorter than min_chars must occur unchanged and not within a longer word. Empty
    or null items are not searched; null or empty texts hold nothing; repeated rows give repeated rows; of equally good
    occurrences the first counts; an empty table on either side, no rows. Documents are read once for each block_chars
    characters of benchmark (about 50 bytes a character are held), so what a task holds has a bound.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = ["doc_id", "item_id", "edits", "n_chars", "start", "end"]
    kinds = ", ".join(f"`{n}` long" for n in names)
    out = None
    for patterns in pattern_blocks(benchmark, edit_rate, q, min_chars, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(patterns)

        @gives_back
        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            p = held.value
            short = p.short_finder()
            for b in batches:
                found = []
                for at in range(0, b.num_rows, 500):
                    part = b.slice(at, 500)
                    for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        found += [(d, p.ids[i], e, len(p.texts[i]), lo, hi) for i, e, lo, hi in search(p, normal(t), short)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 6)], names=names)

        one = rows.mapInArrow(scan, kinds)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], kinds)


def decontaminate(docs: DataFrame, benchmark: DataFrame, edit_rate: float = 0.1, q: int = 8, min_chars: int = 40, block_chars: int = 1_000_000) -> DataFrame:
    """docs(text, ...) without the rows that hold a benchmark item, by the rules of find_leaks.

    Each row is judged by its own text, so null and repeated ids, repeated rows and further columns of any name stay as
    they are; null and empty texts stay. Nothing is shuffled.
    """
    out = docs
    for patterns in pattern_blocks(benchmark, edit_rate, q, min_chars, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(patterns)

        @gives_back
        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            p = held.value
            short = p.short_finder()
            for b in batches:
                yield b.filter(pa.array([not search(p, normal(t.as_py() or ""), short, any_one=True) for t in b.column("text")], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
