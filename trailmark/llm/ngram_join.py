"""N-gram Jaccard join: MinHash, Bayesian candidate pruning, exact verification.

Texts are sets of five-word shingles. Equal texts are one node. Texts that share a MinHash band are
tied to the band's least node, and tied texts make a candidate group (a component of these ties, so the
number of rows stays linear in the number of texts). Within a group, MinHash values are compared a few at a time; a
pair is dropped once the posterior probability that its similarity reaches the threshold falls below a tolerance; the rest
are verified on their whole shingle sets. A group of more than `block` texts is dealt into blocks, and each pair of
blocks is a task of its own. Tasks give a count of links and one root for each text, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import connected_components, dealt_anew
from .packed import LOWER, blocks, mix, span_hashes, spaced, utf8, word_spans
from .shared import renamed_aside, written
from .workers import gives_back

N = 5  # words in a shingle
HASHES, BAND, STEP = 128, 4, 32
ADDED = ("class_id", "class_key", "n_links", "n_copies", "_id", "_class")


def shingles(buf: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts i to j, text by text, and how many each text has.

    Words are runs without ASCII white space, in lower case (A-Z). A text of 1 to 4 words has one shingle of them all.
    """
    b, begin = spaced(buf, off, i, j)
    b = LOWER[b]
    start, end = word_spans(b)
    words = span_hashes(b, start, end)
    doc = np.searchsorted(begin, start, side="right") - 1
    n = np.bincount(doc, minlength=j - i)
    k = np.uint64(0x9FB21C651E98DF25)
    h = np.zeros(max(0, len(words) - N + 1), np.uint64)
    for t in range(N):
        h = h * k + words[t : t + len(h)]
    whole = doc[: len(h)] == doc[N - 1 :] if len(h) else np.zeros(0, bool)
    h, owner = mix(h[whole]), doc[: len(whole)][whole]
    short = np.flatnonzero((n > 0) & (n < N))
    if len(short):
        first = np.append(0, np.cumsum(n))
        extra = []
        for d in short.tolist():
            x = np.uint64(0)
            for w in words[first[d] : first[d + 1]]:
                x = np.uint64((int(x) * int(k) + int(w)) & (1 << 64) - 1)
            extra.append(x + np.uint64(n[d]))
        h, owner = np.append(h, mix(np.array(extra, np.uint64))), np.append(owner, short)
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, np.bincount(owner, minlength=j - i)


def minhash(h: np.ndarray, n: np.ndarray, seed: int = 5) -> np.ndarray:
    """(texts with shingles, HASHES) uint64 values: the least of each multiplied hash, mixed."""
    a = np.random.default_rng(seed).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    some = n[n > 0]
    at = np.append(0, np.cumsum(some))[:-1]
    out = np.empty((len(some), HASHES), np.uint64)
    if len(some):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(h * a[k], at)
    return mix(out)


def signatures(texts: DataFrame) -> DataFrame:
    """(id, doc_id, sig, bands) of texts(id, doc_id, text) that have shingles; sig holds 16 bits of each value."""

    @gives_back
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.array([0xC2B2AE3D27D4EB4F ** (k + 1) & (1 << 64) - 1 for k in range(BAND)], np.uint64)
        for b in batches:
            buf, off = utf8(b.column("text"))
            for i, j in blocks(off):
                h, n = shingles(buf, off, i, j)
                values = minhash(h, n)
                keys = (values.reshape(len(values), HASHES // BAND, BAND) * weight).sum(axis=2, dtype=np.uint64) + np.arange(HASHES // BAND, dtype=np.uint64)
                own = pa.array(np.flatnonzero(n > 0) + i)
                sig = values.astype("<u2")
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * (HASHES // BAND), pa.int32()), pa.array(mix(keys).view(np.int64).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("id").take(own), b.column("doc_id").take(own), pa.array([s.tobytes() for s in sig], pa.binary()), bands], names=["id", "doc_id", "sig", "bands"])

    return texts.select("id", "doc_id", "text").mapInArrow(sign, "id long, doc_id long, sig binary, bands array<long>")


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 32, 64, .. values compared: matches below which a pair is dropped (uniform prior, so a Beta posterior)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:  # P(J >= threshold | m of n) = P(Binomial(n + 1, threshold) <= m)
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of a with b; a before b where they are the same rows) that no comparison drops."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    same = a is b
    for lo in range(0, len(a), 64):
        rows = a[lo : lo + 64]
        m = (sig[rows][:, None, :STEP] == sig[b][None, :, :STEP]).sum(axis=2)
        x, y = np.nonzero(m >= least[0])
        keep = (y > x + lo) if same else np.ones(len(x), bool)
        x, y = x[keep], y[keep]
        m, x, y = m[x, y], rows[x], b[y]
        for k in range(1, len(least)):
            m = m + (sig[x, k * STEP : (k + 1) * STEP] == sig[y, k * STEP : (k + 1) * STEP]).sum(axis=1)
            keep = m >= least[k]
            m, x, y = m[keep], x[keep], y[keep]
        left.append(x)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, width: int = 4096) -> np.ndarray:
    """Size of the intersection of sets x[i] and y[i], by products of incidence blocks."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[code] > 1
    owner, code = owner[keep], shared[code[keep]]
    columns = int(shared[-1]) + 1 if len(value) else 0
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for lo in range(0, columns, width):
        s = slice(np.searchsorted(code, lo), np.searchsorted(code, lo + width))
        m = np.zeros((len(sets), min(width, columns - lo)), np.float32)
        m[owner[s], code[s] - lo] = 1
        total += m @ m.T
    return total[x, y].astype(np.int64)


def linked(ids: np.ndarray, block: np.ndarray, sig: np.ndarray, texts: list[bytes], pair: tuple[int, int], least: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, root) of the texts with links in one pair of blocks."""
    a, b = np.flatnonzero(block == pair[0]), np.flatnonzero(block == pair[1])
    x, y = survivors(sig, a, a if pair[0] == pair[1] else b, least)
    if not len(x):
        return ids[:0], ids[:0], ids[:0]
    used, inverse = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = inverse[: len(x)], inverse[len(x) :]
    raw = [texts[k] for k in used.tolist()]
    h, n = shingles(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw])), 0, len(raw))
    sets = [np.unique(s) for s in np.split(h, np.cumsum(n)[:-1])]
    size = np.array([len(s) for s in sets])
    both = intersections(sets, x, y)
    union = size[x] + size[y] - both
    good = both >= threshold * union - 1e-9
    x, y = x[good], y[good]
    links = np.bincount(x, minlength=len(used)) + np.bincount(y, minlength=len(used))
    own = ids[used]
    root = own.copy()
    while len(x):
        low = np.minimum(root[x], root[y])
        if (low == root[x]).all() and (low == root[y]).all():
            break
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
    some = links > 0
    return own[some], links[some], root[some]


def class_table(texts: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 512) -> DataFrame:
    """(id, least_doc, n_copies, n_links, class) of each different text in texts(id, doc_id, text)."""
    each = signatures(texts).groupBy("id")  # one row of each text from here on, however often it is repeated
    signed = written(each.agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "signatures")
    copies = texts.groupBy("id").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("n_copies"))
    banded = signed.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high")
    ties = banded.join(dealt_anew(shared, "band"), "band").where("id != low").select(F.col("id").alias("u"), F.col("low").alias("v")).distinct()
    groups = written(connected_components(ties), "candidate_groups")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = groups.join(dealt_anew(sizes, "component"), "component").join(signed.select("id", "doc_id", "sig"), "id")
    chosen = members.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("blocks")).cast("int"))
    found = chosen.alias("m").join(texts.alias("t"), (F.col("m.id") == F.col("t.id")) & F.col("m.doc_id").eqNullSafe(F.col("t.doc_id")))
    own = ["component", "blocks", "block", "sig"]
    full = found.select("m.id", "m.doc_id", *[f"m.{c}" for c in own], "t.text").groupBy("id", "doc_id").agg(*[F.first(c).alias(c) for c in (*own, "text")])  # repeated rows have one id and doc_id
    spread = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "blocks", "sig", "text")
    least = least_matches(threshold, tolerance)

    @gives_back
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            ids, first = np.unique(np.asarray(t.column("id")), return_index=True)
            sig = np.frombuffer(b"".join(t.column("sig").take(pa.array(first)).to_pylist()), "<u2").reshape(len(ids), HASHES)
            text = [x.encode() for x in t.column("text").take(pa.array(first)).to_pylist()]
            pair = (t.column("i")[0].as_py(), t.column("j")[0].as_py())
            own, links, root = linked(ids, np.asarray(t.column("block"))[first], sig, text, pair, least, threshold)
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64()), pa.array(np.full(len(own), t.column("blocks")[0].as_py() > 1))], names=["id", "links", "root", "split"])

        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            key = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("component", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and tuple(key[lo]) != now:
                    yield one(held)
                    held = []
                now = tuple(key[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield one(held)

    tasks = spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id")
    found = written(tasks.mapInArrow(verify, "id long, links long, root long, split boolean"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    split = connected_components(found.where("split").select(F.col("id").alias("u"), F.col("root").alias("v")))
    classes = found.where("not split").select("id", F.col("root").alias("class")).unionByName(split.select("id", F.col("component").alias("class")))
    table = copies.join(links, "id", "left").join(classes, "id", "left")
    return table.select("id", "least_doc", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class", "id").alias("class"))


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 512) -> DataFrame:
    """docs(doc_id, text, ...) with class_id, class_key, n_links and n_copies.

    class_id: the least doc_id of all texts that links join, directly or by way of others; class_key: the class's own
    key, a hash of one of its texts (null for a null text), which tells classes apart where ids are null or repeated; n_links: how many
    different texts have a similarity of at least threshold to this one; n_copies: rows with this very text.
    Equal texts share a class, the empty text too, though it has no shingles and no links. A null text is
    alone in its class (n_copies 1). An empty table gives no rows; repeated rows are repeated. Clashing columns get the suffix _in. Texts are told apart by a
    64-bit hash. A pair at exactly 0.8 is missed with a probability of about 5e-8 by the bands and 1e-6 by the tolerance.
    """
    docs = renamed_aside(docs, ("doc_id", "text"), ADDED)
    rows = docs.withColumn("_id", F.xxhash64("text"))
    texts = rows.where(F.col("text").isNotNull()).select(F.col("_id").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = written(class_table(texts, threshold, tolerance, block), "classes")
    names = table.groupBy("class").agg(F.min("least_doc").alias("class_id"))
    known = table.join(dealt_anew(names, "class"), "class").select(F.col("id").alias("_id"), "class_id", F.col("class").alias("class_key"), "n_links", "n_copies")
    whole = rows.where(F.col("text").isNotNull()).join(known, "_id").select(*docs.columns, "class_id", "class_key", "n_links", "n_copies")
    alone = rows.where(F.col("text").isNull()).select(*docs.columns, F.col("doc_id").cast("long").alias("class_id"), F.lit(None).cast("long").alias("class_key"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return whole.unionByName(alone)


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: the one with the class's least doc_id (a null one where it has no other). Rows with a null text stay."""
    kept = jaccard_classes(docs, **options).where(F.col("doc_id").cast("long").eqNullSafe(F.col("class_id")))
    whole = kept.where(F.col("text").isNotNull())
    again = W.partitionBy("class_key").orderBy(F.xxhash64("text"))  # only repeats of one doc_id in one class are left here
    return whole.withColumn("_n", F.row_number().over(again)).where("_n = 1").drop("_n").unionByName(kept.where(F.col("text").isNull())).drop("class_id", "class_key", "n_links", "n_copies")
