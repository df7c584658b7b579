"""License scans: exact phrases by place, and short notices with a few edits.

Fuzzy search: a notice with an error budget of k is split into k+1 pieces; by the pigeonhole principle
an occurrence with at most k edits holds one piece unchanged. Exact search for the pieces (seeds) finds
candidate windows; the regex library's bounded-error matching verifies the edits there and gives spans.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and the labels of their exact occurrences.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Short notices of public licences, searched with edits, and their labels. Words in braces tell one licence from another and must stand unchanged.
NOTICES = (
    ("licensed under the {apache} license", "apache"),
    ("{apache} license version 2 0", "apache"),
    ("permission is hereby granted free of charge", "mit"),
    ("released under the {mit} license", "mit"),
    ("licensed under the {mit} license", "mit"),
    ("{mit} license", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("released under the {bsd} license", "bsd"),
    ("licensed under the {bsd} license", "bsd"),
    ("{bsd} license", "bsd"),
    ("permission to use copy modify and or distribute", "isc"),
    ("licensed under the {isc} license", "isc"),
    ("{isc} license", "isc"),
    ("released under the {gpl} license", "gpl-notice"),
    ("licensed under {gpl}", "gpl-notice"),
    ("licensed under the {gpl}", "gpl-notice"),
    ("{gnu general} public license", "gpl-notice"),
    ("gnu {lesser general} public license", "lgpl"),
    ("gnu {affero general} public license", "agpl"),
    ("{mozilla} public license", "mpl"),
    ("released under the {mpl} license", "mpl"),
    ("{eclipse} public license", "epl"),
    ("{common development} and distribution license", "cddl"),
    ("{boost} software license", "bsl"),
    ("{academic} free license", "afl"),
    ("{sil} open font license", "ofl"),
    ("this is free and unencumbered software", "unlicense"),
    ("released into the {public domain}", "public-domain"),
    ("this work is licensed under a {creative commons}", "cc"),
    ("licensed under {cc by}", "cc"),
    ("all rights {reserved}", "reserved-notice"),
    ("copyright all rights reserved", "reserved-notice"),
)
# Bytes that are no word bytes become a space, A-Z lower case: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
FOLD = bytes(k if k > 127 or 48 <= k < 58 or 97 <= k < 123 else k + 32 if 65 <= k < 91 else 32 for k in range(256))


def folded(text: str) -> str:
    """Lower-case words with one space between, before and after."""
    return f" {b' '.join(text.encode().translate(FOLD).split()).decode()} "


def exact_places(folded_text: str, phrase: str) -> list[int]:
    """Offsets (of the space before) of each place where the phrase's words stand one after another."""
    found, at = [], folded_text.find(f" {phrase} ")
    while at >= 0:
        found.append(at)
        at = folded_text.find(f" {phrase} ", at + 1)
    return found


class Notice:
    """A notice with at most max(1, edit_rate * its characters) edits, none of them in its key words."""

    def __init__(self, written: str, label: str, edit_rate: float):
        before, _, rest = written.partition("{")
        key, _, after = rest.partition("}")
        self.text, self.label, self.key = before + key + after, label, f" {key} " if key else ""
        self.edits = max(1, int(edit_rate * len(self.text)))
        fuzzy = lambda t: f"(?:{regex.escape(t, literal_spaces=True)}){{e<={self.edits}}}" if t else ""
        whole = f"(?<![^ ]){regex.escape(key, literal_spaces=True)}(?![^ ])" if key else ""
        self.pattern = regex.compile(fuzzy(before) + whole + fuzzy(after), regex.BESTMATCH)

    def best(self, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(edits, from, to) of the best match in text[lo:hi]."""
        m = self.pattern.search(text, lo, hi)
        return (sum(m.fuzzy_counts), m.start(), m.end()) if m and sum(m.fuzzy_counts) <= self.edits else None


class Scanner:
    def __init__(self, notices=NOTICES, edit_rate: float = 0.1):
        self.notices, self.seeds = [Notice(*n, edit_rate) for n in notices], ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            cuts = [round(i * len(notice.text) / (notice.edits + 1)) for i in range(notice.edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(notice.text[a:b], []).append((n, a))
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def candidates(self, text: str) -> list[set[int]]:
        """For each notice, where an occurrence may begin: by a seed's place in it."""
        starts: list[set[int]] = [set() for _ in self.notices]
        for end, (size, uses) in self.seeds.iter(text):
            for n, at in uses:
                starts[n].add(end - size + 1 - at)
        return starts

    def scan(self, text: str) -> list[tuple[str, str, int, int, int]]:
        """(label, notice, from, to, edits) of verified occurrences in a folded text; those of one notice don't overlap, the one with fewer edits stays."""
        found = []
        for notice, starts in zip(self.notices, self.candidates(text), strict=True):
            if not starts or notice.key not in text:
                continue
            k, size = notice.edits, len(notice.text)
            windows: list[list[int]] = []  # first and last start; those of one occurrence lie within its edits
            for at in sorted(starts):
                if windows and at <= windows[-1][0] + 2 * k:
                    windows[-1][1] = at
                else:
                    windows.append([at, at])
            hits = {hit for a, b in windows if (hit := notice.best(text, max(0, a - k), min(len(text), b + size + k)))}
            taken: list[tuple[int, int]] = []
            for edits, lo, hi in sorted(hits):
                at = bisect.bisect(taken, (lo, hi))
                if (at and taken[at - 1][1] > lo) or (at < len(taken) and taken[at][0] < hi):
                    continue
                taken.insert(at, (lo, hi))
                found.append((notice.label, notice.text, lo, hi, edits))
        return found


def one_a_place(found: list[tuple[str, str, int, int, int]]) -> list[tuple[str, str, int, int, int]]:
    """Of one label's occurrences that overlap, the one with the fewest edits a character (then the longer, then the earlier), in order of place."""
    kept: list[tuple[str, str, int, int, int]] = []
    taken: dict[str, list[tuple[int, int]]] = {}
    for hit in sorted(found, key=lambda x: (x[4] / len(x[1]), x[2] - x[3], x[2])):
        own = taken.setdefault(hit[0], [])
        at = bisect.bisect(own, hit[2:4])
        if not ((at and own[at - 1][1] > hit[2]) or (at < len(own) and own[at][0] < hit[3])):
            own.insert(at, hit[2:4])
            kept.append(hit)
    return sorted(kept, key=lambda x: (x[2:4], x[0]))


RESULT = [("doc_id", "long"), ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("n_notices", "long"), ("spans", "string")]


def scan_text(scanner: Scanner, doc_id: int | None, text: str) -> tuple:
    t = folded(text)
    places = [(at, label) for phrase, label in BASE for at in exact_places(t, phrase)]
    notices = one_a_place(scanner.scan(t))
    spaces = np.flatnonzero(np.frombuffer(t.encode("utf-32-le"), np.uint32) == 32) if places or notices else np.zeros(0, np.int64)
    word = lambda at: int(np.searchsorted(spaces, at, side="left"))  # noqa: E731  of the word after the space at `at`
    base = sorted({label for _, label in places})
    best = max([1.0 - e / len(notice) for _, notice, _, _, e in notices] + [1.0] * bool(places), default=0.0)
    words = [word(at) for at, _ in places]
    spans = ",".join(f"{label}:{max(0, word(lo + (t[lo] == ' ')) - 1)}-{max(0, word(hi - (t[hi - 1] == ' ')) - 1)}:{e}" for label, _, lo, hi, e in notices)
    return (doc_id, t.count(" ") - 1 if len(t) > 2 else 0, len(places), min(words, default=None), max(words, default=None), ",".join(base), ",".join(sorted({*base, *(x[0] for x in notices)})), best, len(notices), spans)


def scan_licences(docs: DataFrame, edit_rate: float = 0.1) -> DataFrame:
    """Phrases and fuzzy notices in every whole text of docs(doc_id, text).

    One row for each input row: n_words, n_base (places of base phrases), first_word, last_word (null
    if none), base_labels, labels (with those of fuzzy notices), score (best match: 1 less its edits
    per character; 0 if none), n_notices, spans (label:first word-last word:edits, in order of place; one where several
    notices of a label stand in one place). A null text is an empty one;
    repeated rows are repeated; an empty table gives no rows; other columns are not read. Work is linear in a text's length and its seeds.
    """
    schema = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[k]) for n, k in RESULT])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(edit_rate=edit_rate)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                rows = [scan_text(scanner, d, t) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, ", ".join(f"{n} {k}" for n, k in RESULT))
