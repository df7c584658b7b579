"""Phrase collocation mining: phrases of 2 to 4 words that occur often, by levels of tries.

Texts become blocks of word numbers. Words that occur often enough get a number each (words and numbers stay in
tables, joined by word). Level by level, a double-array trie of the frequent phrases found so far goes to all tasks; numpy advances the states of
all text positions at once, one digit of the next word's number after another. A position whose phrase and whose next
position's phrase are both accepted may begin a longer frequent phrase (every part of a frequent phrase is frequent): these are the
next level's candidates, counted by block and summed. Accepting states are counted by bincount, and the shards' counts are
summed: these are the phrases' counts. A trie holds a bounded number of phrases; more phrases make more tries, dealt by their first word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .language_model import numbers, packed_numbers
from .packed_sums import ROWS_SQL, part_rows, sum_packed
from .shared import written

LEAST, LONGEST, INSIDE = 30, 4, 80  # occurrences of a candidate; words; percent of a phrase within a longer one
TRIE_PHRASES = 500_000  # in one trie, at most: about 60 MB
COUNT, MOST = np.uint64(1 << 63), np.uint64((1 << 31) - 1)  # marks a phrase's own count among keys; the greatest number of a word
BREAKS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def number_words(docs: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """(block, lang, codes, words, counts) of docs(lang, text): a block's words by their place in its list of distinct words; -1 between pieces."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            own, codes, _ = held.pop(lang)
            codes = np.array(codes, np.int32)
            counts = np.bincount(codes[codes >= 0], minlength=len(own))
            out = pa.RecordBatch.from_arrays([pa.array([(task << 24) + made]), pa.array([lang]), pa.array([packed_numbers(codes)], pa.binary()), pa.array([[w.decode() for w in own]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], schema=BLOCK)
            made += 1
            return out

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = ({}, [], 0)
                own, codes, size = held[lang]
                for piece in BREAKS.split(text.encode().lower().replace(b"\t", b" ")):  # of bytes: A-Z only
                    codes.extend([own.setdefault(w, len(own)) for w in piece.split(b" ") if w])
                    codes.append(-1)
                held[lang] = (own, codes, size + len(text))
                if size + len(text) >= block_bytes:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return written(rows.mapInArrow(read, "block long, lang string, codes binary, words array<string>, counts array<long>"), "numbered")


def numbered(rows: DataFrame, *order: str, buckets: int = 4096, often: str | None = None) -> DataFrame:
    """rows with a number (0.. without gaps, below 2^31) each: by hash bucket, then by order; no task sorts all rows.

    often: a count by whose powers of two rows come first, the greatest first: frequent words have small numbers, which pack into fewer bytes.
    """
    hashed = F.pmod(F.xxhash64(*order), F.lit(buckets))
    level = F.lit(0) if often is None else (F.lit(63) - F.floor(F.log2(often))) * buckets
    rows = rows.withColumn("_b", (level + hashed).cast("int"))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # `buckets` rows (for each power of two)
    counts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = rows.withColumn("_i", F.row_number().over(W.partitionBy("_b").orderBy(*order)))
    return own.join(F.broadcast(counts), "_b").withColumn("number", (F.col("_before") + F.col("_i") - 1).cast("int")).drop("_b", "_i", "_before")


def with_numbers(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(block, codes): the blocks' words by their numbers over the corpus; -1 between pieces and for rare words. words: (lang, word, number)."""
    each = blocks.select("block", "lang", F.posexplode("words").alias("k", "word"))
    known = each.join(dealt_anew_on(words.select("lang", "word", "number")), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("k", "number")).alias("known"))  # a block's distinct words

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, codes, known in zip(*(b.column(c) for c in ("block", "codes", "known")), strict=True):
                codes = numbers(codes.as_py(), np.int32)
                to = np.full(int(codes.max(initial=-1)) + 2, -1, np.int32)  # the last one for -1
                if known.is_valid:
                    to[np.asarray(known.values.field("k"))] = np.asarray(known.values.field("number"))
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([packed_numbers(to[codes])], pa.binary())], names=["block", "codes"])

    return written(blocks.select("block", "codes").join(known, "block", "left").mapInArrow(put, "block long, codes binary"), "coded")


def dealt_anew_on(words: DataFrame) -> DataFrame:
    """words with lang as a computed column, so that a join on it shuffles this side itself (see dealt_anew)."""
    return words.withColumn("lang", F.concat("lang", F.lit("")))


class Trie:
    """Double array over phrases of word numbers, each word as its four bytes.

    A state is a slot; base[s] + byte is the slot of the child, which holds check[slot] = s. accept[s]: number of the phrase that
    ends there, or -1. Built level by level: nodes with many children get slots of their own, the others are tried at random bases,
    all at once, until each stands free of the others.
    """

    def __init__(self, phrases: list[np.ndarray], seed: int = 1):
        """phrases: matrices (phrases, words), one for each length; numbers go through them in order."""
        rng = np.random.default_rng(seed)
        keys = [np.ascontiguousarray(p.astype(">u4")).view(np.uint8).reshape(len(p), 4 * p.shape[1]) for p in phrases]
        first_number = np.cumsum([0, *(len(k) for k in keys)])
        state = [np.zeros(len(k), np.int64) for k in keys]
        bases, checks, ends, used = [], [], [], 1  # slots below `used` are given; 0 is the root
        for depth in range(max((k.shape[1] for k in keys if len(k)), default=0)):
            live = [i for i, k in enumerate(keys) if k.shape[1] > depth and len(k)]
            edges, inverse = np.unique(np.concatenate([state[i] << 8 | keys[i][:, depth] for i in live]), return_inverse=True)
            node, byte = edges >> 8, edges & 255
            nodes, own, count = np.unique(node, return_inverse=True, return_counts=True)
            base, small = np.zeros(len(nodes), np.int64), count <= 6
            base[~small] = used + 256 * np.arange(int((~small).sum()))  # slots of their own
            low = used + 256 * int((~small).sum())
            high = low + 256 + 3 * int(count[small].sum())  # a third full in the end
            taken, todo = np.zeros(high - low, bool), small.copy()
            while todo.any():
                base[todo] = rng.integers(low, high - 255, int(todo.sum()))
                mine = np.flatnonzero(todo[own])
                want = base[own[mine]] + byte[mine] - low
                lost = taken[want]
                once = np.zeros(len(mine), bool)
                once[np.unique(want, return_index=True)[1]] = True
                fails = np.zeros(len(nodes), bool)
                fails[own[mine[lost | ~once]]] = True
                taken[want[~fails[own[mine]]]] = True
                todo &= fails
            slot = base[own] + byte
            bases.append((nodes, base))
            checks.append((slot, node))
            used, at = high, 0
            for i in live:
                state[i] = slot[inverse[at : at + len(keys[i])]]
                at += len(keys[i])
                if keys[i].shape[1] == depth + 1:
                    ends.append((state[i], np.arange(first_number[i], first_number[i + 1])))
        self.base, self.check, self.accept = np.zeros(used + 256, np.int32), np.full(used + 256, -1, np.int32), np.full(used + 256, -1, np.int32)
        for array, parts in ((self.base, bases), (self.check, checks), (self.accept, ends)):
            for at, value in parts:
                array[at] = value

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word (-1: no phrase goes on so); word -1 goes nowhere."""
        out = np.where(word < 0, -1, state)
        live = np.flatnonzero(out >= 0)
        s, w = out[live], word[live]
        for shift in (24, 16, 8, 0):
            to = self.base[s] + ((w >> shift) & 255)
            ok = self.check[to] == s
            if not ok.all():
                out[live[~ok]] = -1
                live, w, to = live[ok], w[ok], to[ok]
            s = to
        out[live] = s
        return out


def last_state(trie: Trie, codes: np.ndarray, words: int) -> np.ndarray:
    """The state after that many words from each position."""
    state = np.zeros(len(codes), np.int64)
    for k in range(words):
        state = trie.step(state, np.append(codes[k:], np.full(k, -1))[: len(codes)])
    return state


def found_pairs(coded: DataFrame, least: int) -> DataFrame:
    """(words, n) of the pairs of numbered words that occur often enough."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("codes").to_pylist(), strict=True):
                c = numbers(data, np.int32).astype(np.uint64)
                both = np.flatnonzero((c[:-1] <= MOST) & (c[1:] <= MOST))
                yield part_rows(block, *np.unique(c[both] << np.uint64(32) | c[both + 1], return_counts=True))

    sums = sum_packed(coded.mapInArrow(pairs, ROWS_SQL), coded.count(), least)
    return sums.select(F.array(F.shiftright("key", 32).cast("int"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("words"), "n")


def tries(phrases: DataFrame, limit: int = TRIE_PHRASES) -> Iterator[tuple[Trie, DataFrame, bool]]:
    """Tries of phrases(words), all of one length, dealt by first word, each with its numbered phrases; and whether it is the only one.

    One trie at a time comes to the driver, of about `limit` phrases.
    """
    shares = max(1, -(-phrases.count() // limit))
    for k in range(shares):
        own = phrases.where(F.pmod(F.xxhash64(F.col("words")[0]), F.lit(shares)) == k) if shares > 1 else phrases
        own = written(numbered(own.select("words"), "words"), "trie")
        found = own.toArrow().combine_chunks()
        words = found.column("words").combine_chunks()
        matrix = np.asarray(words.values).reshape(len(words), -1) if len(words) else np.zeros((0, 1), np.int64)
        ordered = np.empty_like(matrix)
        ordered[np.asarray(found.column("number"))] = matrix
        yield Trie([ordered]), own, shares == 1


def next_level(spark: SparkSession, coded: DataFrame, phrases: DataFrame, words: int, least: int, last: bool, limit: int = TRIE_PHRASES) -> tuple[DataFrame, DataFrame | None]:
    """Counts of phrases(words), all of `words` words, by the bincount of accepting states; and the frequent phrases one word longer."""
    totals, longer = [], []
    for trie, names, alone in tries(phrases, limit):
        held = spark.sparkContext.broadcast(trie)

        def advance(batches: Iterator[pa.RecordBatch], held=held, alone=alone) -> Iterator[pa.RecordBatch]:
            trie = held.value
            sums = np.zeros(int(trie.accept.max(initial=-1)) + 1, np.int64)
            task = TaskContext.get().partitionId()
            for b in batches:
                for block, data in zip(b.column("block").to_pylist(), b.column("codes").to_pylist(), strict=True):
                    c = numbers(data, np.int32).astype(np.int64)
                    state = last_state(trie, c, words)
                    hit = np.flatnonzero(state >= 0)
                    number = np.full(len(c) + 1, -1, np.int64)
                    number[hit] = trie.accept[state[hit]]
                    sums += np.bincount(number[hit], minlength=len(sums))
                    if last:
                        continue
                    then = np.append(c[words:], np.full(words + 1, -1))[: len(c)]
                    go = hit[then[hit] >= 0]
                    if alone:  # the phrase at the next position is in this trie too, if it is frequent
                        go = go[number[go + 1] >= 0]
                    yield part_rows(block, *np.unique((number[go] << 32 | then[go]).astype(np.uint64), return_counts=True))
            some = np.flatnonzero(sums).astype(np.uint64)
            yield part_rows(-1 - task, some | COUNT, sums[some])

        n = coded.count()
        made = written(sum_packed(coded.mapInArrow(advance, ROWS_SQL), 2 * n), "level")  # a task's counts are one more block
        names = names.select(F.col("number").cast("long").alias("number"), "words")
        totals.append(made.where("key < 0").join(names, F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("number")).select("words", "n"))
        longer.append(made.where("key >= 0").where(F.col("n") >= least).join(names, F.shiftright("key", 32) == F.col("number")).select(F.concat("words", F.array(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))).alias("words"), "n"))
    return written(reduce(DataFrame.unionByName, totals), f"phrases_{words}"), None if last else written(reduce(DataFrame.unionByName, longer), f"candidates_{words + 1}")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = TRIE_PHRASES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs(lang, text): (lang, word, n, number) of frequent words, (words, n) of frequent phrases of 1 to `longest` words, (lang, n) of all words."""
    spark = docs.sparkSession
    blocks = number_words(docs)
    words = written(blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary = written(numbered(words.where(F.col("n") >= least), "lang", "word", buckets=512, often="n"), "vocabulary")
    coded = with_numbers(blocks, vocabulary)
    phrases = vocabulary.select(F.array("number").alias("words"), "n")
    level = written(found_pairs(coded, least), "candidates_2")
    for k in range(2, longest + 1):
        counted, level = next_level(spark, coded, level, k, least, k == longest, limit)
        phrases = phrases.unionByName(counted)
    return vocabulary, written(phrases, "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int | None = 2000, limit: int = TRIE_PHRASES) -> DataFrame:
    """The phrases of docs(lang, text) that hold together: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are cut at . , ; : ! ? and line ends into pieces, and these at spaces and tabs into words. Candidates are
    phrases of 2 to `longest` words that occur at least `least` times (a) within pieces of a lang (null: und), overlaps
    counted. Each cut into two parts with l and r occurrences scores floor(2000000 a / (l + r)); the lowest counts, the
    shortest first part on ties. A candidate within a longer one that has `inside` percent of its occurrences or more goes.
    Ranked by score, a (both from high to low) and phrase (by UTF-8 bytes); the first `top` of each lang (None: all). n: all words of the lang.
    Null texts are empty; repeated rows count as often as they occur; no rows, no rows; other columns are not read.
    """
    vocabulary, phrases, totals = frequent_phrases(docs, least, longest, limit)
    some = phrases.where(F.size("words") > 1)
    cut = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.select("words", F.col("n").alias("a"), "k", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    part = lambda name, n: phrases.select(F.concat("words", F.array().cast("array<int>")).alias(name), F.col("n").alias(n))  # noqa: E731  a computed key, as in dealt_anew
    cut = cut.join(part("head", "l"), "head").join(part("tail", "r"), "tail")
    cut = cut.withColumn("score", F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (l + r) as long)"))
    scored = cut.groupBy("words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s"))
    wide = some.where(F.size("words") > 2).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).withColumn("m", F.explode(F.sequence(F.lit(2), F.size("words") - 1))).where("i + m - 1 <= size(words)")
    within = wide.select(F.slice("words", F.col("i"), F.col("m")).alias("words"), "n").groupBy("words").agg(F.max("n").alias("longer"))
    kept = scored.join(within, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("s.a")))
    spelt = kept.select("words", F.posexplode("words").alias("i", "number")).join(vocabulary.select(F.col("number").bitwiseXOR(F.lit(0)).alias("number"), "lang", "word"), "number")
    spelt = spelt.groupBy("words").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = kept.join(spelt, "words").select("lang", "phrase", *[F.col(f"s.{c}").alias(c) for c in ("a", "l", "r", "score")])
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked  # each task keeps its own first `top` of a lang
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
