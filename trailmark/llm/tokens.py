"""Token ids of whole texts by a public tokenizer file, a block of texts at a time, with a compact cache of chunks."""

from __future__ import annotations

import gc
import re

import numpy as np

from .packed import LONG, LOWER, same_spans, span_hashes
from .workers import give_back

CACHE_CHUNKS = 4_000_000  # per Python worker, about 45 bytes each (results don't depend on it); chunks over LONG bytes are not kept
JOINED = 64  # plain chunks encoded in one string, parted by a sign that stays a token of its own
ODD_SPACE = re.compile(r" (?=\s|$)")
NEAR_LINE_END = re.compile(r"\n\s|\s\n")
PLAIN = re.compile(r"[^\s\x00]+").fullmatch

LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
SIGN[33:48] = SIGN[58:65] = SIGN[91:97] = SIGN[123:127] = True
SIGN[[39, 124]] = False  # an apostrophe may belong to the letters after it, a bar to a special token
MAY_BE_SPACE = np.zeros(256, bool)  # first bytes of white-space characters
MAY_BE_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def letter_mask(b: np.ndarray) -> np.ndarray:
    """Bytes of letters, as far as they are told by ASCII and by the first page of two-byte letters."""
    out = LETTER[b]
    lead = np.flatnonzero(b[:-1] == 0xC3)
    lead = lead[(b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


class Store:
    """An array that grows; put() gives the place of what it adds."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def put(self, x: np.ndarray) -> int:
        if self.used + len(x) + 8 > len(self.data):  # eight are always spare
            grown = np.zeros(max(self.used + len(x) + 8, len(self.data) * 3 // 2), self.data.dtype)
            grown[: self.used] = self.data[: self.used]
            self.data = grown
        self.data[self.used : self.used + len(x)] = x
        self.used += len(x)
        return self.used - len(x)


class ChunkCache:
    """Ids and bytes of chunks by their 64-bit hash: sorted keys beside places and lengths in two stores. What is found has the same bytes, not only the hash."""

    def __init__(self, limit: int, kind=np.uint16):
        self.limit, self.kind = limit, kind
        self.clear()

    def clear(self) -> None:
        self.ids, self.raw = Store(self.kind), Store(np.uint8)
        self.levels = [(np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)) for _ in range(2)]  # old ones, recent ones; place and length of ids and of bytes

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def find(self, keys: np.ndarray, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of the ids of each of the chunks b[start : start + size], by their sorted keys; the length of an unknown one is -1."""
        place, length = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for have, at in self.levels:
            if len(have):
                k = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = np.flatnonzero((have[k] == keys) & (at[k, 3] == size))
                found = at[k[hit]]
                same = same_spans(b, start[hit], self.raw.data, found[:, 2], found[:, 3], spare=True)
                place[hit[same]], length[hit[same]] = found[same, 0], found[same, 1]
        return place, length

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether some chunk is kept under each key (one of other bytes, where find() found none)."""
        out = np.zeros(len(keys), bool)
        for have, _ in self.levels:
            if len(have):
                out |= have[np.minimum(np.searchsorted(have, keys), len(have) - 1)] == keys
        return out

    def put(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, raw_sizes: np.ndarray) -> np.ndarray:
        """Keep ids and bytes (one chunk's after another's, sizes of them for each sorted key); return the places of the ids."""
        at = self.ids.put(ids) + np.cumsum(sizes) - sizes
        self.levels[1] = self._merged(self.levels[1], (keys, np.column_stack([at, sizes, self.raw.put(raw) + np.cumsum(raw_sizes) - raw_sizes, raw_sizes])))
        if len(self.levels[1][0]) > max(100_000, len(self.levels[0][0]) // 8):
            self.levels[0] = self._merged(*self.levels)
            self.levels[1] = tuple(x[:0] for x in self.levels[0])
        return at

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]


class ChunkEncoder:
    """Ids equal to the tokenizer's own on each whole text.

    Both vocabularies split a text before each single space that a visible character follows, at a line end
    between visible characters, and between a letter and a sign (other than an apostrophe, which may begin a
    contraction, and a bar, which stands in special tokens), and no merge crosses such a place. So a text is cut
    there and each distinct chunk is encoded once, found by a 64-bit hash and told apart by its bytes.
    keep_space: the space belongs to the chunk after it (byte-level); else white space is dropped and A-Z are lower case.
    A text with other runs of white space is encoded whole where the space is kept.
    plain_specials: strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, keep_space: bool, cache_chunks: int = CACHE_CHUNKS, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep_space = Tokenizer.from_file(path), keep_space
        self.tokenizer.encode_special_tokens = plain_specials
        self.cache = ChunkCache(cache_chunks, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.sign = "\n" if keep_space else " \x00 "
        (self.sign_id,) = self.tokenizer.encode(self.sign.strip(" "), add_special_tokens=False).ids

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has."""
        plain = [k for k, c in enumerate(chunks) if PLAIN(c[1:] if c[:1] == " " and self.keep_space else c) and "<|" not in c]
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        found: list[np.ndarray | None] = [None] * len(chunks)
        if groups:
            for own, e in zip(groups, self.tokenizer.encode_batch_fast([self.sign.join([chunks[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                cuts = np.flatnonzero(ids == self.sign_id)
                if len(cuts) != len(own) - 1:  # a sign within a chunk
                    for k in own:
                        found[k] = self._whole(chunks[k])
                    continue
                for k, lo, hi in zip(own, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                    found[k] = ids[lo:hi]
        for k, x in enumerate(found):
            if x is None:
                found[k] = self._whole(chunks[k])
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def whole(self, text: str) -> bytes:
        """Ids of a text by the tokenizer itself, as little-endian uint32."""
        return self._whole(text).astype("<u4").tobytes()

    def _spans(self, b: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to look at, and starts and ends of the chunks of texts that stand at begin in b."""
        n = len(b)
        letter, sign = letter_mask(b), SIGN[b]
        cut = np.zeros(n + 1, bool)
        cut[1:n] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        if not self.keep_space:
            special = np.flatnonzero((b[:-1] == 60) & (b[1:] == 124))
            low = LOWER[b]
            for d in np.unique(np.searchsorted(begin, special, side="right") - 1).tolist():
                low[begin[d] : begin[d + 1]] = b[begin[d] : begin[d + 1]]  # a special token is told by its case
            space = np.ones(n + 2, bool)
            space[1:-1] = (b == 32) | (b == 10)
            cut[begin] = True
            start = np.flatnonzero(~space[1:-1] & (space[:-2] | cut[:-1]))
            end = np.flatnonzero(~space[1:-1] & (space[2:] | cut[1:])) + 1
            return low, start, end
        spaces, lines = np.flatnonzero(b == 32), np.flatnonzero(b == 10)
        text_of = lambda at: np.searchsorted(begin, at, side="right") - 1
        after = np.append(b, 32)
        last = np.isin(spaces + 1, begin)
        odd = np.unique(text_of(spaces[last | MAY_BE_SPACE[after[spaces + 1]]]))
        odd = [d for d in odd.tolist() if ODD_SPACE.search(b[begin[d] : begin[d + 1]].tobytes().decode())]
        before = np.append(np.uint8(32), b)
        near = np.unique(text_of(lines[MAY_BE_SPACE[after[lines + 1]] | MAY_BE_SPACE[before[lines]] | (before[lines] > 127)]))
        near = [d for d in near.tolist() if NEAR_LINE_END.search(b[begin[d] : begin[d + 1]].tobytes().decode())]
        if near:
            lines = lines[~np.isin(text_of(lines), near)]
        cut[spaces] = True
        cut[lines] = cut[lines + 1] = True
        for d in odd:
            cut[begin[d] : begin[d + 1]] = False
        cut[begin] = True
        cut[n] = True
        start = np.flatnonzero(cut[:n])
        return b, start, np.append(start[1:], n) if n else start

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of the texts at off in buf, each with end_id after it, and where each text's ids begin (with the end as last)."""
        begin, docs = off - off[0], len(off) - 1
        b, start, end = self._spans(buf[off[0] : off[-1]], begin)
        size = end - start
        keys, first, inverse = np.unique(span_hashes(b, start, end), return_index=True, return_inverse=True)
        again = np.flatnonzero(first[inverse] != np.arange(len(start)))
        like = first[inverse[again]]
        other = again[(size[again] != size[like]) | ~same_spans(b, start[again], b, start[like], np.minimum(size[again], size[like]))]
        if len(self.cache) > self.cache.limit:
            self.cache.clear()
        place, length = self.cache.find(keys, b, start[first], size[first])
        known = len(keys)
        if len(other):  # other bytes with the hash of the first: chunks of their own
            inverse[other] = known + np.arange(len(other))
            first, place, length = np.append(first, other), np.append(place, np.zeros(len(other), np.int64)), np.append(length, np.full(len(other), -1))
        ids = self.cache.ids.data
        new = np.flatnonzero(length < 0)
        if len(new):
            lo, hi = start[first[new]], end[first[new]]
            made, sizes = self._encode([b[s:e].tobytes().decode() for s, e in zip(lo.tolist(), hi.tolist(), strict=True)])
            short = (hi - lo <= LONG) & (new < known)
            short[short] &= ~self.cache.holds(keys[new[short]])
            length[new] = sizes
            of = np.repeat(short, sizes)
            wide = (hi - lo)[short]
            raw = b[np.repeat(lo[short] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))]
            place[new[short]] = self.cache.put(keys[new[short]], made[of], sizes[short], raw, wide)
            ids = self.cache.ids.data
            if not short.all():
                place[new[~short]] = self.cache.ids.used + np.cumsum(sizes[~short]) - sizes[~short]
                ids = np.concatenate([ids[: self.cache.ids.used], made[~of].astype(ids.dtype)])
        n, at = length[inverse].astype(np.int64), place[inverse]
        total = int(n.sum())
        token = np.arange(total)
        out = ids[np.repeat(at - (np.cumsum(n) - n), n) + token]
        doc = np.searchsorted(begin[1:], start, side="right")
        counts = np.bincount(doc, weights=n, minlength=docs).astype(np.int64) if len(start) else np.zeros(docs, np.int64)
        if end_id is None:
            return out.astype("<u4"), np.append(0, np.cumsum(counts))
        ends = np.append(0, np.cumsum(counts + 1))
        whole = np.full(total + docs, end_id, "<u4")
        whole[token + np.repeat(np.arange(docs), counts)] = out
        return whole, ends

    def ids(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        ids, at = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64))
        return [ids[lo:hi].tobytes() for lo, hi in zip(at, at[1:], strict=False)]


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, keep_space: bool, cache_chunks: int = CACHE_CHUNKS, plain_specials: bool = False) -> ChunkEncoder:
    """The worker's own encoder for this file."""
    key = (path, keep_space, plain_specials)
    if key not in _ENCODERS:
        gc.set_threshold(50_000, 20, 100)
        _ENCODERS[key] = ChunkEncoder(path, keep_space, cache_chunks, plain_specials)
    return _ENCODERS[key]


def release() -> None:
    """Let go of the chunks that this worker has kept, in tasks of a stage that encodes nothing."""
    for e in _ENCODERS.values():
        e.cache.clear()
    give_back()
