"""Cross-tokenizer alignment: tokens of two tokenizers linked by their bytes, and counts of linked id pairs over the corpus.

Both tokenizers encode space + text; where the bytes of both agree with it, each token is a range of bytes. A block
of documents is merged in lockstep: a numpy state vector holds a pointer into the A tokens and one into the
B tokens of every document; a step links the two tokens under the pointers, moves the one that ends first (both where they
end together, which is a cut), and documents that are through leave the vector. Long documents stand in the vector as several lanes that
begin at common ends.

Counts of pairs have no proven bound, so they aren't broadcast: each block's distinct pairs go to the part of their B
id, packed; there they are summed and the highest count of each B id is found; the counts go back to the blocks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import LONG, blocks, same_spans, span_hashes, utf8
from .language_model import numbers, packed_numbers
from .shared import written
from .tokens import ChunkCache, encoder

PARTS = 128  # of the pair counts, by B id; fixed, so rows grow with the number of blocks only
CACHE = 400_000  # chunks kept for each tokenizer in a worker
LANE = 512  # A tokens in a lane, about
JOINED = 1000  # chunks encoded in one string
DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
DOC_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 bytes themselves, the others from U+0100 on in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id, one after another, and their lengths."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.size = np.array([len(x) for x in entries], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def vocabulary_a(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    to = byte_values()
    found = {i: bytes(to[c] for c in t) if all(c in to for c in t) else t.encode() for t, i in data["model"]["vocab"].items()}
    for t in data.get("added_tokens", ()):
        found[t["id"]] = t["content"].encode()
    return Vocabulary([found.get(k, b"") for k in range(max(found) + 1)])


class PieceEncoder:
    """B ids of space + text by a sentencepiece model whose pieces hold the space sign at their start only.

    So no merge crosses a place where a space follows another character: a text is cut there, and each distinct chunk is
    encoded once, found by a hash and told apart by its bytes. The model's own leading space is the chunk's first one.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space within")
        self.words = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        self.cache, self.lone = ChunkCache(cache_chunks, np.uint16), self.model.piece_to_id("▁")

    def _encode(self, chunks: list[bytes], wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has; many chunks in one string, apart where its pieces have other bytes."""
        flat, sizes = [], []
        for k in range(0, len(chunks), JOINED):
            own = chunks[k : k + JOINED]
            ids = np.array(self.model.encode(b"".join(own)[1:].decode(), num_threads=1), np.uint16)
            ends, bounds = np.append(0, np.cumsum(self.words.size[ids])), np.append(0, np.cumsum(wide[k : k + JOINED]))
            at = np.searchsorted(ends, bounds)
            if len(own[0]) == 1 or ends[-1] != bounds[-1] or (ends[at] != bounds).any():
                each = [self.model.encode(c[1:].decode(), num_threads=1) if len(c) > 1 else [self.lone] for c in own]
                ids, at = np.array([x for m in each for x in m], np.uint16), np.append(0, np.cumsum([len(m) for m in each]))
            flat.append(ids)
            sizes.append(np.diff(at))
        return np.concatenate(flat), np.concatenate(sizes)

    def encode(self, b: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts at begin in b, each with its leading space, and where each text's ids begin."""
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = (b[1:] == 32) & (b[:-1] != 32)
        cut[begin] = True
        start = np.flatnonzero(cut[:-1])
        size = np.diff(np.append(start, len(b)))
        keys, first, inverse = np.unique(span_hashes(b, start, start + size), return_index=True, return_inverse=True)
        like = first[inverse]
        other = np.flatnonzero((size != size[like]) | ~same_spans(b, start, b, start[like], np.minimum(size, size[like])))
        if len(self.cache) > self.cache.limit:
            self.cache.clear()
        place, length = self.cache.find(keys, b, start[first], size[first])
        known = len(keys)
        inverse[other] = known + np.arange(len(other))
        first, place, length = np.append(first, other), np.append(place, np.zeros(len(other), np.int64)), np.append(length, np.full(len(other), -1))
        ids = self.cache.ids.data
        new = np.flatnonzero(length < 0)
        if len(new):
            lo, wide = start[first[new]], size[first[new]]
            flat, sizes = self._encode([b[s : s + n].tobytes() for s, n in zip(lo.tolist(), wide.tolist(), strict=True)], wide)
            short = (wide <= LONG) & (new < known)
            short[short] &= ~self.cache.holds(keys[new[short]])
            length[new] = sizes
            of, w = np.repeat(short, sizes), wide[short]
            raw = b[np.repeat(lo[short] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))]
            place[new[short]] = self.cache.put(keys[new[short]], flat[of], sizes[short], raw, w)
            ids = self.cache.ids.data
            if not short.all():
                place[new[~short]] = self.cache.ids.used + np.cumsum(sizes[~short]) - sizes[~short]
                ids = np.concatenate([ids[: self.cache.ids.used], flat[~of]])
        n, at = length[inverse], place[inverse]
        out = ids[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        counts = np.bincount(np.searchsorted(begin[1:], start, side="right"), weights=n, minlength=len(begin) - 1).astype(np.int64)
        return out.astype(np.int64), np.append(0, np.cumsum(counts))


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token, in any order) and a mark on each A token that ends where a B token does.

    a_end, b_end: byte offset at which each token ends, of all documents one after another. a_at, b_at: bounds of the lanes' tokens;
    both token runs of a lane end at the same byte. Every lane's pointers move in one vector; lanes that are through leave it.
    """
    cut = np.zeros(len(a_end), bool)
    pa_, pb = a_at[:-1].copy(), b_at[:-1].copy()
    stop = a_at[1:]
    live = np.flatnonzero(pa_ < stop)
    pa_, pb, stop = pa_[live], pb[live], stop[live]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    while len(pa_):
        ea, eb = a_end[pa_], b_end[pb]
        left.append(pa_)
        right.append(pb)
        together = ea == eb
        cut[pa_[together]] = True
        pa_ = pa_ + (ea <= eb)
        pb = pb + (eb <= ea)
        going = pa_ < stop
        if not going.all():
            pa_, pb, stop = pa_[going], pb[going], stop[going]
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty), cut


def lanes(a_end: np.ndarray, b_end: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of lanes: those of the documents and, in long ones, common ends about every LANE A tokens (where there is one)."""
    tries = np.arange(LANE - 1, len(a_end), LANE // 2)
    at = np.searchsorted(b_end, a_end[tries])
    same = (at < len(b_end)) & (b_end[np.minimum(at, len(b_end) - 1)] == a_end[tries])
    a_cut, b_cut = np.concatenate([a_at, tries[same] + 1]), np.concatenate([b_at, at[same] + 1])
    order = np.unique(a_cut, return_index=True)[1]
    return a_cut[order], b_cut[order]


_DIGITS: list[tuple[np.ndarray, np.ndarray]] = []


def digits(ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of each id (16 bits) with a sign after it, one after another, and how many bytes each has."""
    if not _DIGITS:
        every = np.array([f"{k:<6}" for k in range(1 << 16)], "S6").view(np.uint8).reshape(-1, 6)
        _DIGITS.append((every, np.array([len(str(k)) for k in range(1 << 16)], np.int64)))
    table, n = _DIGITS[0][0][ids], _DIGITS[0][1][ids]
    table[np.arange(len(ids)), n] = signs
    return table[np.arange(6, dtype=np.int8) <= n.astype(np.int8)[:, None]], n + 1


def aligned(enc_a, words_a: Vocabulary, enc_b: PieceEncoder, buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray | list[str]]:
    """Counts, group digests and links of the texts at off in buf: n_a, n_b, n_groups, n_links, sha, and pair (A id << 16 | B id) of each link, document by document."""
    n = len(off) - 1
    size = np.diff(off)
    begin = off - off[0] + np.arange(n + 1)  # each text gets a leading space
    b = np.full(int(begin[-1]), 32, np.uint8)
    b[np.arange(off[-1] - off[0]) + np.repeat(np.arange(1, n + 1), size)] = buf[off[0] : off[-1]]
    a_ids, a_at = enc_a.encode(b, begin)
    a_ids = a_ids.astype(np.int64)
    b_ids, b_at = enc_b.encode(b, begin)
    good = size > 0
    for ids, at, words in ((a_ids, a_at, words_a), (b_ids, b_at, enc_b.words)):
        ends = np.append(0, np.cumsum(words.size[ids]))[at]
        data = words.joined(ids)
        lengths = np.diff(ends)
        good &= lengths == np.diff(begin)
        if len(data) == len(b) and good.all():
            wrong = np.flatnonzero(data != b)
            good[np.searchsorted(begin, wrong, side="right") - 1] = False
        else:
            for d in np.flatnonzero(good).tolist():
                good[d] = np.array_equal(data[ends[d] : ends[d + 1]], b[begin[d] : begin[d + 1]])
    if not good.all():
        for_a, for_b = np.repeat(good, np.diff(a_at)), np.repeat(good, np.diff(b_at))
        a_ids, b_ids = a_ids[for_a], b_ids[for_b]
        a_at, b_at = (np.append(0, np.cumsum(np.where(good, np.diff(at), 0))) for at in (a_at, b_at))
    out = {"n_a": np.diff(a_at), "n_b": np.diff(b_at)}
    a_end, b_end = np.cumsum(words_a.size[a_ids]), np.cumsum(enc_b.words.size[b_ids])
    a_lane, b_lane = lanes(a_end, b_end, a_at, b_at) if len(a_ids) else (a_at[:1], b_at[:1])
    link_a, link_b, cut = lockstep(a_end, b_end, a_lane, b_lane)
    doc = np.searchsorted(a_at[1:], link_a, side="right")
    order = np.argsort(doc, kind="stable")
    out["n_links"] = np.bincount(doc, minlength=n)
    out["pair"] = (a_ids[link_a] << 16 | b_ids[link_b])[order].astype(np.uint32)
    # groups: how many cuts stand before each token
    a_group = np.cumsum(cut) - cut
    b_cut = np.zeros(len(b_ids), bool)
    b_cut[np.searchsorted(b_end, a_end[cut])] = True
    b_group = np.cumsum(b_cut) - b_cut
    groups = int(cut.sum())
    out["n_groups"] = np.diff(np.append(0, np.cumsum(cut))[a_at])
    first_a, first_b = np.searchsorted(a_group, np.arange(groups + 1)), np.searchsorted(b_group, np.arange(groups + 1))
    ids, signs = np.empty(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), 44, np.uint8)
    at_a, at_b = np.arange(len(a_ids)) + first_b[a_group], np.arange(len(b_ids)) + first_a[b_group + 1]
    ids[at_a], ids[at_b] = a_ids, b_ids
    signs[at_a[cut]], signs[at_b[b_cut]] = 124, 59
    data, wide = digits(ids, signs)
    ends = np.append(0, np.cumsum(wide))[a_at + b_at]
    raw = memoryview(data)
    out["sha"] = [hashlib.sha256(raw[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


STORED = "block long, part int, keys binary, counts binary, docs binary"
STORED_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())])


def pair_part(keys: np.ndarray) -> np.ndarray:
    """The part of a pair, by its B id alone."""
    return ((keys & np.uint32(0xFFFF)) * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(PARTS)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(np.concatenate([np.zeros(0, np.uint32), *keys]), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, np.concatenate([np.zeros(0, np.int64), *counts]))
    return distinct, total


def stored_alignments(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = 6 << 20) -> DataFrame:
    """Align docs(doc_id, text) and store, for each block of about block_bytes, its documents with their links (part -1) and its distinct pairs by part."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc_a, words_a, enc_b = encoder(path_a, True, CACHE, True), vocabulary_a(path_a), piece_encoder(path_b)
        task, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate([x["pair"] for _, x in held])
            keys, code, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            often = np.argsort(-counts, kind="stable")  # links as ranks by frequency: small numbers are the most
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often))
            table = pa.table({"doc_id": pa.concat_arrays([i for i, _ in held]), **{c: np.concatenate([x[c] for _, x in held]).astype(np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}, "sha": [s for _, x in held for s in x["sha"]]})
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            number = (task << 24) + block
            rows = [(number, -1, packed_numbers(keys[often]), packed_numbers(rank[code]), out.getvalue().to_pybytes())]
            part = pair_part(keys)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(PARTS + 1))
            for p in range(PARTS):
                own = order[bounds[p] : bounds[p + 1]]
                if len(own):
                    rows.append((number, p, packed_numbers(keys[own]), packed_numbers(counts[own].astype(np.int64)), None))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STORED_ARROW, strict=True)], schema=STORED_ARROW)

        for b in batches:
            buf, off = utf8(b.column(1))
            for i, j in blocks(off):
                held.append((b.column(0).slice(i, j - i), aligned(enc_a, words_a, enc_b, buf, off[i : j + 1])))
                size += int(off[j] - off[i])
                if size >= block_bytes:
                    yield flush()
                    block, held, size = block + 1, [], 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return written(rows.mapInArrow(align, STORED), "alignments")


_PIECES: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _PIECES:
        _PIECES[path] = PieceEncoder(path)
    return _PIECES[path]


def runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], function) -> Iterator[pa.RecordBatch]:
    """Apply function to a list of rows (dicts) for each run of equal values in the columns."""
    now, held = None, []
    for b in batches:
        for row in b.to_pylist():
            key = tuple(row[c] for c in columns)
            if held and key != now:
                yield from function(held)
                held = []
            now = key
            held.append(row)
    if held:
        yield from function(held)


def pair_counts(stored: DataFrame, fan: int = 256) -> DataFrame:
    """(part, keys, counts): each distinct pair's count over the corpus, one row a part. Blocks are summed `fan` at a time, so no task reads a part's rows of all blocks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            keys, counts = summed([numbers(r["keys"], np.uint32) for r in rows], [numbers(r["counts"], np.int64) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["part"]], pa.int32()), pa.array([rows[0]["salt"]], pa.int64()), pa.array([packed_numbers(keys)], pa.binary()), pa.array([packed_numbers(counts)], pa.binary())], names=["part", "salt", "keys", "counts"])

        yield from runs(batches, ("part", "salt"), one)

    rows, left = stored.where("part >= 0").select("part", F.col("block").alias("salt"), "keys", "counts"), stored.where("part < 0").count()
    while True:
        salts = max(1, -(-left // fan))
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("salt"), F.lit(salts))).repartition(min(PARTS * salts, 20_000) if salts > 1 else 32, "part", "salt").sortWithinPartitions("part", "salt")
        rows = written(dealt.mapInArrow(add, "part int, salt long, keys binary, counts binary"), "pair_sums")
        if salts == 1:
            return rows.drop("salt")
        left = salts


def highest(b_id: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair's count is its B id's highest."""
    top = np.zeros(1 << 16, np.int64)
    np.maximum.at(top, b_id, counts)
    return counts == top[b_id]


def counts_for_blocks(stored: DataFrame, totals: DataFrame, blocks_at_once: int = 256) -> DataFrame:
    """(block, part, keys, worth): the counts over the corpus of each block's pairs; worth is 2 * count, and 1 more where it is the B id's highest."""
    n = stored.where("part < 0").count()
    salts = max(1, -(-n // blocks_at_once))
    asked = stored.where("part >= 0").select("part", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), "block", "keys", F.lit(None).cast("binary").alias("counts"))
    known = totals.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(-1).cast("long").alias("block"), "keys", "counts")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = worth = np.zeros(0, np.int64)
        for b in batches:
            out = []
            for row in b.to_pylist():
                keys = numbers(row["keys"], np.uint32)
                if row["block"] < 0:
                    counts = numbers(row["counts"], np.int64)
                    key, worth = keys, 2 * counts + highest(keys & np.uint32(0xFFFF), counts)
                else:
                    out.append((row["block"], row["part"], row["keys"], packed_numbers(worth[np.searchsorted(key, keys)])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "part", "keys", "worth"])

    rows = known.unionByName(asked).repartition(min(PARTS * salts, 20_000) if salts > 1 else 32, "part", "salt").sortWithinPartitions("part", "salt", "block")
    return rows.mapInArrow(answer, "block long, part int, keys binary, worth binary")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = 6 << 20) -> DataFrame:
    """Alignment of the tokens of byte-level path_a and sentencepiece path_b in each whole text of docs(doc_id, text).

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count over the corpus is its B id's highest, ties
    included), count_sum (of the links' pairs) and groups_sha256 (of `a1,a2|b1;a3|b2`). A null or empty text, and one whose
    tokens' bytes differ from space + text (U+2581 in it), has no tokens: zeros and ''. Repeated rows and null ids are
    documents of their own and count as often; other columns are not read; no rows, no rows. Texts are aligned once; the
    links wait in a stored table for the counts.
    """
    stored = stored_alignments(docs, path_a, path_b, block_bytes)
    back = counts_for_blocks(stored, pair_counts(stored))
    whole = stored.where("part < 0").select("block", "part", "keys", F.lit(None).cast("binary").alias("worth"), "counts", "docs")
    every = whole.unionByName(back, allowMissingColumns=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            (own,) = (r for r in rows if r["part"] < 0)
            keys = np.concatenate([np.zeros(0, np.uint32), *(numbers(r["keys"], np.uint32) for r in rows if r["part"] >= 0)])
            worth = np.concatenate([np.zeros(0, np.int64), *(numbers(r["worth"], np.int64) for r in rows if r["part"] >= 0)])
            order = np.argsort(keys)
            ranked = worth[order][np.searchsorted(keys[order], numbers(own["keys"], np.uint32))]
            links = ranked[numbers(own["counts"], np.uint32)]
            del keys, worth, order
            t = pa.ipc.open_stream(own["docs"]).read_all()
            at = np.append(0, np.cumsum(np.asarray(t.column("n_links"))))
            best, total = np.append(0, np.cumsum(links & 1))[at], np.append(0, np.cumsum(links >> 1))[at]
            made = pa.table([*(t.column(c).cast(pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(np.diff(best)), pa.array(np.diff(total)), t.column("sha")], schema=pa.schema(DOC))
            yield from made.combine_chunks().to_batches(max_chunksize=10_000)

        yield from runs(batches, ("block",), one)

    n = stored.where("part < 0").count()
    dealt = every.repartition(max(1, min(n, 100_000)), "block").sortWithinPartitions("block", "part")
    return dealt.mapInArrow(finish, DOC_SQL)


def pair_table(stored: DataFrame) -> DataFrame:
    """(a_id, b_id, n) of every linked id pair, from stored_alignments()."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                k = numbers(keys, np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array((k >> 16).astype(np.int32)), pa.array((k & 0xFFFF).astype(np.int32)), pa.array(numbers(counts, np.int64))], names=["a_id", "b_id", "n"])

    return pair_counts(stored).select("keys", "counts").mapInArrow(plain, "a_id int, b_id int, n long")
