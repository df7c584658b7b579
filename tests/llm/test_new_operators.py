"""Mixing, alignment, collocations, and exact chunks against brute force, and their defined results for odd input."""

import bisect
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailmark.llm import alignment, collocations, html_text, mixing, ngram_join, packed, packed_sums, tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- chunks told apart by bytes
def regular(n, swap=False):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s.translate({97: 98, 98: 97}) if swap else s


@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_that_share_a_polynomial_hash(name, keep):
    texts = [regular(n, s) for n in (512, 1024, 2048, 4096) for s in (False, True)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    e = tokens.ChunkEncoder(public_tokenizers.path(name), keep)
    assert e.ids(texts) == want and [e.ids([x])[0] for x in texts] == want
    b = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    h = packed.span_hashes(b, ends - [len(x) for x in texts], ends)
    assert len(set(h.tolist())) == len(texts)


def test_clashing_hashes_give_right_ids(monkeypatch):
    real = tokens.span_hashes
    monkeypatch.setattr(tokens, "span_hashes", lambda b, s, e: real(b, s, e) % np.uint64(5))
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(50)) for _ in range(8)]
    t, e = Tokenizer.from_file(A), tokens.ChunkEncoder(A, True)
    for _ in range(2):
        assert e.ids(texts) == [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


def test_join_over_repeated_rows_without_ids(spark):
    base = " ".join(f"word{i}" for i in range(140))
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(base).alias("text")).unionByName(spark.createDataFrame([(7, base.replace("word70", "other"))], "doc_id long, text string"))
    got = {tuple(r) for r in ngram_join.jaccard_classes(docs).groupBy("doc_id", "class_id", "n_links", "n_copies").count().collect()}
    assert got == {(None, 7, 1, 3000, 3000), (7, 7, 1, 1, 1)}


# ---------------------------------------------------------------- 8
def test_bare_pages_are_articles():
    m = html_text.Boosted(trees=1)
    m.fit(np.zeros((4, html_text.FEATURES), np.float32), np.array([0, 0, 0, 1.0]))  # a model that finds nothing
    pages = ["<p>a &lt;b&gt; bare</p>", "only text", "<xmp>x <b> & y</xmp>", "<nav>menu</nav><footer>f</footer>", "", "<div class=comments><p>hi</p></div>", "<p hidden>no</p>"]
    assert html_text.extract_texts(m, pages) == ["a <b> bare", "only text", "x <b> & y", "", "", "", ""]


# ---------------------------------------------------------------- 11
def mixed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, q double, digest string, taken int")
    return mixing.mix(df.repartition(3), quality_col="q", key_col="digest", rows_per_range=10, **options)


def test_mix_meets_targets_and_reruns_agree(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["a", "b", "b", "c", "c", "c", None]), r.randint(0, 60), r.choice([0.5, 1.0, 2.0]), str(k), 0) for k in range(600)]
    rows += [(None, "hot", 10, None, "same", 0)] * 5000 + [(900, "d", None, -1.0, "x", 0), (901, "e", 40, 1.0, "y", 0)]
    got = [x.asDict() for x in mixed(spark, rows).collect()]
    assert len(got) == len(rows) and all(g["taken"] == g["copies"] * g["size"] and g["copies"] <= 3 for g in got)
    size, taken, target = Counter(), Counter(), {}
    for g in got:
        size[g["source"]] += g["size"]
        taken[g["source"]] += g["taken"]
        target[g["source"]] = g["target"]
        assert g["source_size"] == sum(x[2] or 0 for x in rows if x[1] == g["source"])
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(total)
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free = set(size)
    while True:  # water-filling by the book
        left = total - sum(3 * size[s] for s in set(size) - free)
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}
        if not over:
            break
        free -= over
    for s in size:
        want = left * weight[s] / sum(weight[x] for x in free) if s in free else 3 * size[s]
        assert target[s] == pytest.approx(want) and abs(taken[s] - want) <= 5
        copies = {g["copies"] for g in got if g["source"] == s and g["size"]}
        assert not copies or max(copies) - min(copies) <= 1  # complete epochs come first
    again = [x.asDict() for x in mixed(spark, rows[::-1], ).collect()]
    key = lambda g: str(sorted(g.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_prefers_good_documents_and_writes_texts(spark):
    rows = [(k, "a" if k < 2000 else "z", 10, 4.0 if k % 2 else 0.5, str(k), 0) for k in range(2200)]
    got = [g for g in mixed(spark, rows).collect() if g["source"] == "a" and g["source_size"]]
    share = lambda odd: np.mean([g["copies"] for g in got if g["id"] % 2 == odd])
    assert share(1) > share(0)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
    docs = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (2, "b", None), (3, "b", "z")], "doc_id long, source string, text string")
    taken = mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.text_digest(F.col("text")).alias("digest")), key_col="digest")
    out = mixing.mixed_texts(docs, taken)
    assert out.where("text is not null").agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken.agg(F.sum("taken")).first()[0]


# ---------------------------------------------------------------- 12
def brute_alignment(rows):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp, to, name = sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_values(), {i: s for s, i in Tokenizer.from_file(A).get_vocab().items()}
    out, links = [], []
    for d, x in rows:
        x = x or ""
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        ab, bb = [bytes(to[c] for c in name[i]) for i in a], [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ab) != (" " + x).encode() or b"".join(bb) != (" " + x).encode():
            a, b, ab, bb = [], [], [], []
        ea, eb = np.cumsum([len(y) for y in ab]).tolist(), np.cumsum([len(y) for y in bb]).tolist()
        cuts = sorted(set(ea) & set(eb))
        pairs = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(ab[i]), eb[j] - len(bb[j])) < min(ea[i], eb[j])]
        groups = [([], []) for _ in cuts]
        for side, ends, ids in ((0, ea, a), (1, eb, b)):
            for e, i in zip(ends, ids, strict=True):
                groups[bisect.bisect_left(cuts, e)][side].append(str(i))
        s = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        out.append((d, len(a), len(b), len(cuts), len(pairs), hashlib.sha256(s.encode()).hexdigest() if a else ""))
        links.append(pairs)
    n = Counter(p for x in links for p in x)
    top = defaultdict(int)
    for (_, b), c in n.items():
        top[b] = max(top[b], c)
    return sorted(((*o[:5], sum(n[p] == top[p[1]] for p in x), sum(n[p] for p in x), o[5]) for o, x in zip(out, links, strict=True)), key=str)


def test_alignment_matches_brute_force(spark, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé日 \n") for _ in range(r.randint(1, 8))) for _ in range(60)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for k in range(40)]
    rows += [(None, None), (100, ""), (101, " "), (102, "   "), (103, "a▁b"), (104, " lead  two   three "), (105, "x" * 300), (106, "<|endoftext|> <s> </s>\n\n \t z"), (107, "①ﬁ\x00🙂"), (0, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_a int").repartition(3)
    want = brute_alignment(rows)
    assert sorted((tuple(x) for x in alignment.align_tokenizers(df, A, B, 2000).collect()), key=str) == want
    assert alignment.align_tokenizers(df.where("doc_id = -1"), A, B).count() == 0
    stored = alignment.stored_alignments(df, A, B, 2000)
    assert alignment.pair_counts(stored, fan=2).count() == alignment.pair_counts(stored).count()
    sums = alignment.pair_table(stored).agg(F.sum("n")).first()[0]
    assert sums == sum(w[4] for w in want)
    assert sorted(map(str, alignment.counts_for_blocks(stored, alignment.pair_counts(stored, 2), 2).drop("keys").collect())) == sorted(map(str, alignment.counts_for_blocks(stored, alignment.pair_counts(stored)).drop("keys").collect()))


def test_a_long_text_is_aligned_in_lanes():
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(20_000))
    buf = np.frombuffer(text.encode(), np.uint8)
    enc = tokens.ChunkEncoder(A, True, plain_specials=True)
    got = alignment.aligned(enc, alignment.vocabulary_a(A), alignment.PieceEncoder(B), buf, np.array([0, len(buf)]))
    assert got["n_links"][0] == got["n_a"][0] + got["n_b"][0] - got["n_groups"][0]  # each step that is no cut moves one pointer


# ---------------------------------------------------------------- 13
def brute_collocations(rows, least, inside=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for m in (1, 2, 3, 4):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in some.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in some.items():
            if 100 * longer[p] >= inside * a:
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("limit", [500_000, 7])
def test_collocations_match_brute_force(spark, limit):
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["É", "don't", "日本", "a\x01"]
    rows = [(r.choice(["en", "de", None]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(200))) for _ in range(60)]
    rows += [("en", "New York City hall " * 40), ("en", "a a a a a a"), ("xx", None), ("en", ""), ("de", "x" * 100_000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "lang string, text string, rank int").repartition(3)
    got = sorted(tuple(x) for x in collocations.collocations(df, least=6, top=50, limit=limit).collect())
    assert got == brute_collocations(rows, 6, top=50)
    if limit > 7:
        assert collocations.collocations(df.where("lang = 'none'")).count() == 0


def test_trie_accepts_its_phrases_only():
    r = np.random.default_rng(1)
    two, three = np.unique(r.integers(0, 3000, (5000, 2)), axis=0), np.unique(r.integers(0, 50, (3000, 3)), axis=0)
    t = collocations.Trie([two, three])
    for k, p in enumerate(two[:300]):
        assert t.accept[collocations.last_state(t, p, 2)[0]] == k
    codes = r.integers(-1, 50, 4000)
    known = {tuple(p): len(two) + k for k, p in enumerate(three.tolist())}
    s = collocations.last_state(t, codes, 3)
    got = [int(t.accept[x]) if x >= 0 else -1 for x in s]
    assert got == [known.get(tuple(codes[i : i + 3].tolist()), -1) if i + 3 <= len(codes) else -1 for i in range(len(codes))]


def test_packed_sums_over_levels(spark):
    r = np.random.default_rng(2)
    want, rows = Counter(), []
    for block in range(40):
        keys, n = np.unique(r.integers(0, 1 << 63, 1, dtype=np.uint64) * 0 + r.integers(0, 500, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_counts=True)
        want.update(dict(zip(keys.view(np.int64).tolist(), n.tolist(), strict=True)))
        rows += packed_sums.part_rows(block, keys, n).to_pylist()
    df = spark.createDataFrame([tuple(x.values()) for x in rows], packed_sums.ROWS_SQL)
    for fan in (3, 1000):
        assert {k: n for k, n in packed_sums.sum_packed(df, 40, fan=fan).collect()} == dict(want)
    assert all(n >= 20 for _, n in packed_sums.sum_packed(df, 40, 20).collect()) and math.isfinite(sum(want.values()))


def test_licence_headers_people_write(spark):
    from trailmark.llm import licences

    data = [(1, "Apache License, Version 2.0 (the text)"), (2, "This is licensed under GPL v3."), (3, "see the MIT License"), (4, "Licensed under the terms of the MIT license"), (5, "released under the BSD license, released under the BSD license"), (6, "a limit licence; submit licenses")]
    got = {r["doc_id"]: (r["labels"], r["n_notices"], r["spans"]) for r in licences.scan_licences(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: ("apache", 1, "apache:0-4:0"), 2: ("gpl-notice", 1, "gpl-notice:2-4:0"), 3: ("mit", 1, "mit:2-3:0"), 4: ("mit", 1, "mit:6-7:0"), 5: ("bsd", 2, "bsd:0-4:0,bsd:5-9:0"), 6: ("", 0, "")}
    hits = [("a", "x" * 10, 0, 10, 1), ("a", "x" * 5, 3, 8, 0), ("a", "x" * 5, 8, 13, 0), ("b", "x" * 10, 0, 10, 1)]
    assert licences.one_a_place(hits) == [hits[3], hits[1], hits[2]]


def test_frequent_words_have_small_numbers(spark):
    """op13's disk: a word of twice the count and more comes before, and numbers have no gaps."""
    from trailmark.llm import collocations

    df = spark.createDataFrame([("en", f"w{k}", 30 + k * k) for k in range(300)], "lang string, word string, n long")
    got = sorted((r.number, r.n) for r in collocations.numbered(df, "lang", "word", buckets=8, often="n").collect())
    assert [k for k, _ in got] == list(range(300))
    assert all(b < 2 * a for (_, a), (_, b) in zip(got, got[1:], strict=False))
