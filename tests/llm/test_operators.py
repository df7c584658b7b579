"""Operators against brute force, and their defined results for odd input."""

import bisect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailmark.llm import components, decontamination, html_text, language_model, licences, media, ngram_join, packing, quality, queries, sharding, token_files, tokens
from trailmark.llm.shared import written

DOCS = "doc_id long, text string, shard string, score double, _id long"
R = random.Random(4)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(300)]
ODD = [None, "", " ", "one two", "É ß <|endoftext|> a  b \n c ", "x" * 70_000]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, text(40 + k, k)) for k in range(30)]
    base = text(200, 999).split()
    for k in range(12):  # near copies of one text
        w = list(base)
        for j in range(k % 4):
            w[(37 * (j + 1) + k) % 200] = "changed"
        out.append((200 + k, " ".join(w)))
    out += [(300 + k, text(40, 0)) for k in range(5)] + [(105, text(45, 5)), (None, "no id at all here"), (None, None), (400, "One TWO")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1.0, 7) for i, t in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- 1
def brute_classes(rows, threshold=0.8):
    ids = defaultdict(list)
    for i, t in rows:
        if t is not None:
            ids[t].append(i)
    texts = list(ids)
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links, root = Counter(), list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    group = defaultdict(list)
    for a, t in enumerate(texts):
        group[find(a)] += [i for i in ids[t] if i is not None]
    out = Counter()
    for a, t in enumerate(texts):
        for i in ids[t]:
            out[i, min(group[find(a)], default=None), links[a], len(ids[t])] += 1
    for i, t in rows:
        if t is None:
            out[i, i, 0, 1] += 1
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_classes_equal_brute_force(docs, rows, block):
    got = ngram_join.jaccard_classes(docs, block=block)
    assert Counter(map(tuple, got.select("doc_id", "class_id", "n_links", "n_copies").collect())) == brute_classes(rows)
    assert "shard" in got.columns and "_id_in" in got.columns


def test_one_of_each_class(docs, rows):
    kept = ngram_join.one_of_each_class(docs.where("doc_id is not null"))
    want = {c for i, c, _, _ in brute_classes([r for r in rows if r[0] is not None])}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_null_and_repeated_ids_join_no_classes(spark):
    a, b, c, d = (text(40, 500 + k) for k in range(4))
    near = a.split()
    near[-1] = "changed"
    data = [(None, a), (None, a), (None, " ".join(near)), (None, b), (7, c), (7, d), (7, c), (9, d), (None, None), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    keys = {r["text"]: r["class_key"] for r in ngram_join.jaccard_classes(docs).where("text is not null").collect()}
    assert keys[a] == keys[" ".join(near)] and len(set(keys.values())) == 4
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each_class(docs).collect()]
    first = [x for x in kept if x[1] in (a, " ".join(near))]
    assert len(first) == 1 and Counter(kept) == Counter([*first, (None, b), (7, c), (7, d), (None, None), (None, None)])


def test_jaccard_of_nothing(empty):
    assert ngram_join.jaccard_classes(empty).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert least == sorted(least) and 0 < least[0] < 0.8 * 32


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(500, 500)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 500: 500}


# ---------------------------------------------------------------- 2
def test_shards_hold_every_row_evenly(spark, docs, rows):
    out = sharding.read_shards(spark, sharding.write_shuffled_shards(docs, n_shards=7, bucket_bytes=20_000, min_buckets=3))
    got = out.select("doc_id", "text", F.col("shard").cast("int"), "slot").collect()
    assert Counter((r[0], r[1]) for r in got) == Counter(rows)
    by = defaultdict(list)
    for r in got:
        by[r[2]].append(r[3])
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert "shard_in" in out.columns


def test_shuffle_moves_rows_and_repeats_itself(spark):
    df = written(spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")), "to_shard")
    runs = [sharding.read_shards(spark, sharding.write_shuffled_shards(df, n_shards=1, min_buckets=4, stored=True)).orderBy("slot").select("doc_id").toPandas()["doc_id"].to_numpy() for _ in range(2)]
    assert (runs[0] == runs[1]).all()
    assert abs(np.corrcoef(runs[0], np.arange(2000))[0, 1]) < 0.1


def test_shards_do_not_depend_on_the_session(spark, rows):
    stored = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "shard_input")
    runs = []
    for n in ("4", "211"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            out = sharding.read_shards(spark, sharding.write_shuffled_shards(stored, n_shards=3, min_buckets=5, stored=True))
            runs.append(Counter(map(tuple, out.select("doc_id", "text", F.col("shard").cast("int"), "slot").collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == runs[1]


def test_equal_and_null_ids_are_dealt_out(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    sizes = [r["count"] for r in sharding.scatter(df, 10, 1).groupBy("_bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 450
    out = sharding.read_shards(spark, sharding.write_shuffled_shards(df, n_shards=7, min_buckets=10))
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [428] * 3 + [429] * 4


def test_shards_of_nothing(spark, empty):
    path = sharding.write_shuffled_shards(empty)
    assert sharding.read_shards(spark, path, "doc_id long").count() == 0


def test_the_sharding_query_on_odd_tables(spark, tmp_path):
    """The query itself against its law, worked out by plain Python, on an empty table, nulls alone and equal ids."""
    for k, data in enumerate(([], [(None, None)] * 5, [(3, "aé")] * 40, [(1, None), (1, ""), (None, "b"), (2, "x" * 5000)])):
        sf = f"{tmp_path}/{k}"
        spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
        got = queries.op2_sharding(spark, sf).collect()
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(16))
        if data:
            counts = [len(by[s]) for s in range(16)]
            assert max(counts) - min(counts) <= 1


# ---------------------------------------------------------------- 3
def test_classifier_learns_and_scores_everything(spark):
    junk = lambda k: " ".join(w + R.choice(["***", "$$$", "!!"]) for w in text(30, k).split())
    data = [(k, junk(k) if k % 3 == 0 else text(30, k)) for k in range(300)] + [(900, ""), (901, None), (902, "y" * 5000)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in data], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.train(docs, labels, steps=150)).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert min(got[k] for k in held if k % 3) > max(got[k] for k in held if k % 3 == 0)


def test_one_long_text_does_not_end_the_sample(spark):
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    order = [r["doc_id"] for r in spark.createDataFrame([(k,) for k in ids], "doc_id long").orderBy(F.xxhash64(F.lit(11), "doc_id")).collect()]
    docs = spark.createDataFrame([(k, "z" * 5000 if n == 1 else f"{'good' if k % 2 else '$$$'} " * 5) for n, k in enumerate(order)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    sizes = []

    class Seen(quality.ByteConv):
        def fit(self, texts, y, steps):
            sizes.extend(map(len, texts))
            return self

    plain, quality.ByteConv = quality.ByteConv, Seen
    try:
        quality.train(docs, labels, max_bytes=4000)
    finally:
        quality.ByteConv = plain
    assert len(sizes) == len(ids) - 1 and sum(sizes) <= 4000
    with pytest.warns(UserWarning, match="did not fit"):
        quality.train(docs, labels, max_bytes=10)


def test_classifier_windows_match_brute_force():
    m, raw = quality.ByteConv(filters=3), [b"hello world", b"", b"z" * 300]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    got = m.pooled(quality.Layout(buf, off, 0, 3), m.tables())
    for k, r in enumerate(raw):
        padded = np.frombuffer(r + bytes(quality.TAPS), np.uint8)
        win = np.array([sum(m.w[t, padded[p + t]] for t in range(quality.TAPS)) for p in range(max(1, len(r)))])
        assert np.allclose(got[k, 3:], np.maximum(win.max(0) + m.b, 0), atol=1e-5)


def test_classifier_without_labels_gives_the_prior(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality.score_quality(docs, quality.train(docs, labels)).first()["score"] == pytest.approx(0.5)
    assert quality.score_quality(empty, quality.train(empty, labels)).count() == 0


# ---------------------------------------------------------------- 4
def check_packing(got, capacity):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_round_trip(docs, rows):
    path, cap = public_tokenizers.path("word_bpe_49k.json"), 256
    packed = packing.pack_documents(docs, path, cap, with_ids=True)
    got = packed.collect()
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for n, a in enumerate(range(0, len(ids), cap)):
            want[i, n, a, len(ids[a : a + cap]), zlib.crc32(np.array(ids[a : a + cap], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    n = check_packing(got, cap)
    assert n <= 1.05 * sum(r["length"] for r in got) / cap + 1
    seqs = packing.sequences(packed).collect()
    assert len(seqs) == n and all(len(s["ids"]) == 4 * s["n_tokens"] for s in seqs)


def best_fit(lengths, capacity):
    """Plain best fit, longest first: the number of sequences."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            gap, n = capacity, n + 1
        bisect.insort(gaps, gap - x)
    return n


@pytest.mark.parametrize("name,rows_per_bucket", [("one", 9), ("equal", 50), ("mixed", 100), ("small", 300)])
def test_rounds_place_each_once_and_come_near_best_fit(spark, name, rows_per_bucket):
    rng = np.random.default_rng(0)
    length = {"one": [1], "equal": [33] * 200, "mixed": rng.integers(1, 65, 3000).tolist(), "small": rng.integers(1, 5, 2000).tolist(), "wide": np.minimum(64, rng.lognormal(2, 1, 3000).astype(int) + 1).tolist()}[name]
    data = written(spark.createDataFrame([(k, int(x)) for k, x in enumerate(length)], "id long, size long"), "lengths")
    got = packing.placed(data, 64, rows_per_bucket).collect()
    assert sorted(r["id"] for r in got) == list(range(len(length)))
    n = check_packing([{"sequence_id": r["sequence_id"], "offset": r["offset"], "length": length[r["id"]]} for r in got], 64)
    assert n <= 1.02 * best_fit(length, 64) + 2


def test_a_round_gives_each_piece_the_smallest_free_gap(spark):
    """Against a loop over pieces, longest first, on one round's gaps."""
    r = random.Random(8)
    for _ in range(3):
        rooms, sizes = [r.randint(1, 30) for _ in range(60)], [r.randint(1, 30) for _ in range(80)]
        seats = spark.createDataFrame([(0, k, x, x) for k, x in enumerate(rooms)], "kind int, id long, room long, size long")
        pieces = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
        out = packing.sweep(seats, pieces, packing.depths(Counter(rooms), Counter(sizes)), 3).collect()
        got = Counter((x["size"], rooms[x["partner"]] if x["partner"] is not None else None) for x in out if x["kind"] == packing.PIECE)
        free, want = sorted(rooms), Counter()
        for x in sorted(sizes, reverse=True):
            at = bisect.bisect_left(free, x)
            want[x, free.pop(at) if at < len(free) else None] += 1
        assert got == want
        pairs = {(x["partner"], x["id"]) for x in out if x["kind"] == packing.PIECE and x["partner"] is not None}
        assert pairs == {(x["id"], x["partner"]) for x in out if x["kind"] == packing.GAP and x["partner"] is not None}


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# ---------------------------------------------------------------- 5
@pytest.mark.parametrize("file,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunk_encoder_equals_the_tokenizer(file, keep):
    enc = tokens.ChunkEncoder(public_tokenizers.path(file), keep, cache_chunks=50)
    odd = [t for t in ODD if t is not None] + [" lead", "end ", "a\n\n b  c", "a\n b", "\x00 z\x00", "tab\tx", "日本語 テキスト。", "don't I'll 12 345", " x y \x1cz", "<|startoftext|>q"]
    for t in odd + [text(100, k) for k in range(20)]:
        assert enc.ids([t])[0] == enc.whole(t), repr(t[:40])


def test_token_files_round_trip(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_token_files(docs, path, min_files=3, frame_bytes=4096)
    got = token_files.read_token_files(manifest, with_ids=True).collect()
    t = Tokenizer.from_file(path)
    want = Counter((i, np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, x in rows)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)
    some = token_files.fetch_documents(spark, manifest, spark.createDataFrame([(200,), (3,)], "doc_id long"))
    assert {r["doc_id"] for r in some.collect()} == {200, 3}


def test_a_spoilt_frame_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, text(3000, 1))], "doc_id long, text string")
    uri = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/t", min_files=1).first()["uri"]
    r = token_files.FrameReader(uri)
    file = uri.removeprefix("file://")
    data = bytearray(open(file, "rb").read())
    data[40] ^= 255
    open(file, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017  either zstandard's error or the checksum's
        token_files.FrameReader(uri).document(0)
    r.close()


def test_token_files_of_nothing(empty):
    m = token_files.write_token_files(empty, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(m).count() == 0


# ---------------------------------------------------------------- 6
def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_scores_equal_brute_force(docs, rows):
    got = defaultdict(list)
    for r in language_model.score_texts(docs, unit_bytes=50_000).collect():
        got[r["doc_id"]].append(r)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t))
    train = [t for i, t in rows if not held(i)]
    c = Counter(w for t in train for w in words(t))
    n_train, total = len(train), sum(c.values()) + len(train)
    v = len(c) + 1
    order = [defaultdict(Counter) for _ in range(language_model.ORDER + 1)]
    pad = bytes(language_model.ORDER)
    for t in train:
        b = pad + low(t).encode() + b"\0"
        for k in range(language_model.ORDER, len(b)):
            for o in range(language_model.ORDER + 1):
                order[o][b[k - o : k]][b[k]] += 1

    def p(context, s):
        out, excluded = 1.0, set()
        for o in range(language_model.ORDER, -1, -1):
            seen = order[o].get(context[len(context) - o :])
            if not seen:
                continue
            left = {a: n for a, n in seen.items() if a not in excluded}
            t = sum(left.values())
            if s in left:
                return out * (left[s] - 0.5) / t
            if left:
                out *= len(left) / 2 / t
            excluded |= set(seen)
        return out / max(1, 256 - len(excluded))

    for i, t in rows:
        if t and len(t) > 5000:
            continue
        w = words(t)
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w) + math.log10((n_train + 0.5) / (total + 0.5 * (v + 1)))
        b = pad + low(t).encode() + b"\0"
        score = sum(math.log10(p(b[k - language_model.ORDER : k], b[k])) for k in range(language_model.ORDER, len(b)))
        assert any(r["n_tokens"] == len(w) + 1 and r["n_known"] == sum(c[x] > 0 for x in w) + 1 and r["train_tokens"] == total and r["held_out"] == held(i) and r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-4) for r in got[i]), (i, t and t[:30])


def test_counts_above_2_24_stay_exact():
    big, few = 200_000_003, 5
    top = language_model.Top(np.array([0x616263, 0x616264]), np.array([big, few], np.int64))
    # after "xab" c occurred 3 times, d never: escape 1 / 2 of 3, then d alone is left after "ab": (5 - 1 / 2) / 5
    code = np.array([0x62_61_78_00_00_00_63, 0x62_61_78_00_00_00_64], np.uint64)
    got = language_model.code_scores(top, code, np.array([3, 0]))
    assert got[1] == pytest.approx(math.log10(0.5 / 3 * (few - 0.5) / few), rel=1e-9)


def test_scores_of_nothing_to_learn(spark, empty):
    assert language_model.score_texts(empty).count() == 0
    one = spark.createDataFrame([(None, "ab")], "doc_id long, text string")
    r = language_model.score_texts(one).first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == pytest.approx(3 * math.log10(1 / 256), rel=1e-5)


# ---------------------------------------------------------------- 7
def test_leaks_with_edits_are_found_and_clean_texts_stay(spark):
    item = text(30, 77)
    edited = list(item)
    for k in range(len(item) // 12):
        edited[k * 11 + 3] = "z"
    data = [(1, f"{text(200, 1)} {item.upper()} {text(50, 2)}"), (2, f"{text(20, 3)}  {''.join(edited)}\n{text(5, 4)}"), (3, text(400, 5)), (4, None), (5, ""), (6, item), (6, item), (7, item[: len(item) // 2])]
    docs = spark.createDataFrame([(i, t, 9) for i, t in data], "doc_id long, text string, edits int")
    bench = spark.createDataFrame([(10, item), (11, "short"), (12, None), (13, "")], "item_id long, text string")
    got = decontamination.find_leaks(docs, bench, block_chars=100).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 10), (2, 10), (6, 10), (6, 10)]
    assert {r["doc_id"]: r["edits"] for r in got}[2] > 0
    kept = decontamination.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7] and kept.columns == docs.columns


def test_short_items_are_found_as_whole_words(spark):
    data = [(1, "Say: Open, SESAME."), (2, "reopen sesame"), (3, "open sesames"), (4, "x to-do y"), (5, "ab open sesame"), (6, "abc")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame([(20, "open sesame"), (21, "to-do"), (22, "Open,  sesame"), (23, ""), (24, "open sesame"), (25, "ab")], "item_id long, text string")
    got = decontamination.find_leaks(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"], r["start"]) for r in got) == [(1, 22, 0, 5), (4, 21, 0, 2), (5, 20, 0, 3), (5, 24, 0, 3), (5, 25, 0, 0)]
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()) == [2, 3, 6]


def plain_alignment(p, t):
    """Least edits of p against any part of t."""
    prev = [0] * (len(t) + 1)
    for ch in p:
        cur = [prev[0] + 1]
        for j, x in enumerate(t):
            cur.append(min(prev[j] + (x != ch), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_alignment_equals_plain_dynamic_programming():
    r = random.Random(2)
    for _ in range(30):
        p, t = "".join(r.choice("abc") for _ in range(15)), "".join(r.choice("abc") for _ in range(40))
        k, lo, hi = decontamination.align(decontamination.codes(p), decontamination.codes(t), 99)
        assert k == plain_alignment(p, t) and 0 <= lo <= hi <= len(t)
        assert plain_alignment(p, t[lo:hi]) == k
        band = decontamination.align(decontamination.codes(p), decontamination.codes(t), 15, lo, lo)
        assert band[0] == k


def test_the_search_equals_brute_force(spark):
    """Every item in every document by plain alignment, with edits of all kinds, short items, two blocks of benchmark."""
    r = random.Random(12)
    items = [(k, text(r.randint(8, 16), 700 + k)) for k in range(9)] + [(50, "ab cd"), (51, "hef"), (52, text(9, 700))]
    data = []
    for d in range(60):
        t = list(text(r.randint(0, 30), 800 + d))
        if d % 2:
            i, item = items[d % len(items)]
            x = list(decontamination.normal(item))
            for _ in range(r.randint(0, max(1, len(x) // 7))):
                at = r.randrange(len(x))
                x[at] = r.choice(["", "q", x[at] + "z"])
            t = [*t, " ", *x, " ", *text(r.randint(0, 9), 900 + d)]
        data.append((d, "".join(t)))
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in data:
        n = decontamination.normal(t)
        for i, item in items:
            p = decontamination.normal(item)
            if len(p) < 40:
                if re.search(rf"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])", n):
                    want.add((d, i, 0))
            elif (e := plain_alignment(p, n)) <= min(int(0.1 * len(p)), (len(p) - 8) // 8):
                want.add((d, i, e))
    for size in (1_000_000, 300):
        got = decontamination.find_leaks(docs, bench, block_chars=size).collect()
        assert {(x["doc_id"], x["item_id"], x["edits"]) for x in got} == want and len(got) == len(want)
        assert sorted(x["doc_id"] for x in decontamination.decontaminate(docs, bench, block_chars=size).collect()) == sorted(set(range(60)) - {d for d, _, _ in want})


def test_a_very_long_text_is_searched_whole(spark):
    item = text(40, 77)
    data = [(1, text(700_000, 1) + " " + item), (2, "z" * 5_000_000)]
    got = decontamination.find_leaks(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, " ".join(str(k * k) for k in range(30_000)))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(1, 1, 0)]


def test_leaks_of_nothing(spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(empty, none).count() == 0
    assert decontamination.find_leaks(empty, spark.createDataFrame([(1, text(30, 1))], "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- 8
PAGE = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li><li><a href="/y">News</a></li></ul></nav><div class="ad">Buy now</div><article><h1>Big  &amp; bold</h1><p>First paragraph of <b>some</b> length, with words.<p>Second<br>one &copy; here.<section class="comments"><p>I like this</p></section></article><footer>Imprint</footer></body></html>'


def test_article_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", PAGE[: PAGE.index("Second") + 3] + "<p cla", "x"), (5, "u", "<p>", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(pages, html_text.train(pages, practice=200)).orderBy("page_id").collect()
    want = "Big & bold First paragraph of some length, with words. Second one © here."
    assert [r["text"] for r in got] == [want, want, "", "", want[: want.index("Second") + 3], ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and got[0]["text_in"] == "x"


def test_held_out_layouts():
    rng = np.random.default_rng(11)
    xs, ys = zip(*(html_text.practice_nodes(html_text.practice_page(rng, WORDS)) for _ in range(300)), strict=True)
    model = html_text.Boosted().fit(np.concatenate(xs[:200]), np.concatenate(ys[:200]))
    right = (model.decide(np.concatenate(xs[200:])) > 0) == (np.concatenate(ys[200:]) > 0)
    assert right.mean() > 0.95


def test_no_choice_contradicts_its_ancestors():
    nodes, _ = html_text.parse(PAGE)
    rng = np.random.default_rng(1)
    for _ in range(50):
        inside = html_text.decode(nodes, rng.normal(0, 4, len(nodes)))
        for k, a in enumerate(nodes):
            if k and inside[k]:
                chain, p = [], a.parent
                while p > 0:
                    chain.append(inside[p])
                    p = nodes[p].parent
                assert chain == sorted(chain, reverse=True)


def test_pages_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_pages(none, html_text.train(none, practice=20)).count() == 0


def test_short_and_bare_articles_are_whole(spark):
    pages = {
        "<article><p>Words about the sea and more of it.</p><p>End of it all, dear reader.</p></article>": "Words about the sea and more of it. End of it all, dear reader.",
        "<article><p>One paragraph only here.</p></article>": "One paragraph only here.",
        "<html><body><p>No article element, just a paragraph of words.</p><p>And another.</p></body></html>": "No article element, just a paragraph of words. And another.",
        "<main><h1>Title</h1><p>Short.</p></main>": "Title Short.",
        "<body><nav><a href=/>Home</a></nav><article><p>Brief news, told once.</p></article><footer>Imprint</footer></body>": "Brief news, told once.",
    }
    model = html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert html_text.extract_texts(model, list(pages)) == list(pages.values())


# ---------------------------------------------------------------- 9
def test_licences(spark):
    data = [(1, "Cc - BY cc by; General   PUBLIC license."), (2, "released undr the mit licence"), (3, None), (4, ""), (5, "ccby occ by"), (6, "All rights\nreserved"), (6, "All rights\nreserved")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in licences.scan_licences(docs).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (7, 3, 0, 4, "cc-by,gpl")
    assert got[2]["n_base"] == 0 and got[2]["labels"] == "mit" and 0.85 < got[2]["score"] < 1
    assert (got[3]["n_words"], got[3]["labels"], got[3]["first_word"]) == (0, "", None) and got[4]["score"] == 0
    assert got[5]["n_base"] == 0 and got[6]["base_labels"] == "reserved"


def fewest_edits(written_notice, edits, t):
    """Least edits of a notice anywhere in t with its key words unchanged and whole, by plain dynamic programming; None above the budget."""
    def ends(p, x):  # least edits of p against a part of x that ends at each place
        prev = [0] * (len(x) + 1)
        for ch in p:
            cur = [prev[0] + 1]
            for j, c in enumerate(x):
                cur.append(min(prev[j] + (c != ch), prev[j + 1] + 1, cur[j] + 1))
            prev = cur
        return prev

    before, _, rest = written_notice.partition("{")
    key, _, after = rest.partition("}")
    if not key:
        best = min(ends(before, t))
    else:
        left, right = ends(before, t), ends(after[::-1], t[::-1])[::-1]
        best = min((left[m.start()] + right[m.end()] for m in re.finditer(rf"(?<![^ ])(?={re.escape(key)}(?![^ ]))", t) for m in [re.compile(re.escape(key)).match(t, m.start())]), default=99)
    return best if best <= edits else None


def test_the_scan_equals_brute_force():
    s, r = licences.Scanner(), random.Random(3)
    every = [w for w, _ in licences.NOTICES]
    for _ in range(120):
        parts = []
        for _ in range(r.randint(1, 3)):
            x = list(r.choice(every).replace("{", "").replace("}", ""))
            for _ in range(r.randint(0, 5)):
                at = r.randrange(len(x))
                x[at] = r.choice(["", "q", x[at] + "z", " "])
            parts += ["".join(x), text(r.randint(0, 4), r.randint(0, 99))]
        t = licences.folded(" ".join(parts))
        got = {}
        for _, notice, lo, hi, e in s.scan(t):
            got[notice] = min(e, got.get(notice, 99))
        want = {n.text: e for n, w in zip(s.notices, every, strict=True) if (e := fewest_edits(w, n.edits, t)) is not None}
        assert got == want, t


def test_one_word_tells_licences_apart(spark):
    data = [(1, "released under the BSD license"), (2, "released under the GPL license."), (3, "the general public license"), (4, "all rights reservd all rights reserved  all rites reserved"), (5, "Mozzila public license; mozilla pubic license")]
    got = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in (1, 2, 3)] == ["bsd", "gpl-notice", "gpl"]
    assert got[4]["labels"] == "reserved,reserved-notice" and "reserved-notice:3-5:0" in got[4]["spans"]
    assert got[5]["labels"] == "mpl" and got[5]["spans"] == "mpl:3-5:1"


def test_licences_of_nothing_and_of_a_text_full_of_notices(spark, empty):
    assert licences.scan_licences(empty).count() == 0
    r = licences.scan_licences(spark.createDataFrame([(1, "all rights reserved " * 20_000)], "doc_id long, text string")).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["n_words"]) == (20_000, 0, 59_997, 60_000)


# ---------------------------------------------------------------- 10
@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_media_round_trip(docs, rows, form):
    import hashlib

    got = defaultdict(list)
    for r in media.media_features(media.store_texts(docs, form=form)).collect():
        got[r["doc_id"]].append(r)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert any(r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:]) for r in got[i])


def test_area_resize_equals_brute_force():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (7, 10)).astype(np.uint8)
    fine = np.kron(image, np.ones((9, 8)))  # 63 x 80 cells: each of 9 x 8 target cells is 7 x 10 of them
    want = fine.reshape(9, 7, 8, 10).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 9, 8), want)


def test_images_are_read_back():
    rng = np.random.default_rng(1)
    for shape in ((3, 5), (1, 1), (4, 7, 3)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(b"P6 # note\n2 1 255\n" + bytes(range(6))) == np.arange(6).reshape(1, 2, 3)).all()
    with pytest.raises(ValueError):
        media.decode(b"P5\n9 9\n255\n123")


def test_the_media_query_equals_brute_force(spark, tmp_path, rows):
    """Stored and read back: each figure, the difference hash and the tile by plain loops."""
    import hashlib

    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, queries.op10_media_columns(spark, str(tmp_path)).collect()))

    def means(image, height, width):
        h, w = image.shape
        out = np.zeros((height, width))
        for y in range(height):
            for x in range(width):
                y0, y1, x0, x1 = y * h / height, (y + 1) * h / height, x * w / width, (x + 1) * w / width
                part = image[int(y0) : math.ceil(y1), int(x0) : math.ceil(x1)]
                wy = np.array([min(y1, k + 1) - max(y0, k) for k in range(int(y0), int(y0) + part.shape[0])])
                wx = np.array([min(x1, k + 1) - max(x0, k) for k in range(int(x0), int(x0) + part.shape[1])])
                out[y, x] = wy @ part @ wx / ((y1 - y0) * (x1 - x0))
        return out

    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        medium = media.encode_bmp(image) if zlib.crc32(payload) & 1 else media.encode_pgm(image)
        small = np.round(means(image.astype(float), 8, 9), 6)
        bits = "".join("1" if a > b else "0" for row in small for a, b in zip(row, row[1:], strict=False))
        tile = media.npy(np.rint(np.round(means(image.astype(float), 16, 16), 6)).astype(np.uint8))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(medium), hashlib.sha256(medium).hexdigest(), f"{int(bits, 2):016x}", zlib.crc32(tile)] += 1
    assert got == want


def test_tiles_are_written(spark, docs, tmp_path):
    described = media.media_features(media.store_texts(docs))
    files = media.write_tiles(described, f"file://{tmp_path}/tiles").collect()
    assert len(files) == docs.count() and np.load(files[0]["file"]).shape[1:] == (16, 16)


def test_media_of_nothing(empty):
    assert media.media_features(media.store_texts(empty)).count() == 0


def test_repeated_rows_are_dealt_to_many_units(spark):
    text = "the same words in every row of one id " * 20
    docs = spark.range(3_000).select(F.when(F.col("id") < 2_900, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") < 2_900, text).otherwise(F.concat(F.lit("row "), F.col("id").cast("string"))).alias("text"))
    rows, units = language_model.dealt(docs, 100_000)
    sizes = rows.groupBy("unit").count().agg({"count": "max"}).first()[0]
    assert units >= 16 and rows.count() == 3_000 and sizes < 3 * 3_000 / units
    got = language_model.score_texts(docs, unit_bytes=100_000)
    assert got.count() == 3_000
    hot = got.where("doc_id = 7").select("n_tokens", "n_known", "base_score", "score").distinct().collect()
    assert len(hot) == 1 and hot[0]["n_tokens"] == 9 * 20 + 1
    whole = language_model.score_texts(docs.where("doc_id <> 7").unionByName(docs.where("doc_id = 7")), unit_bytes=10_000_000)
    key = lambda df: sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in df.collect())
    assert key(got) == key(whole)
