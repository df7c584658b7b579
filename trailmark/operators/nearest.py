"""Exact top-k cosine of sparse unit vectors by inverted lists with upper bounds.

Vectors are dealt into blocks by their leading category. Per category a block has its greatest weight; the sum of products of
these over the inverted lists bounds the cosine of any query in a chunk with any user in a block. A first pass compares each chunk
of queries with the blocks of its greatest bounds, which gives every query a floor (its k-th best so far); the second pass takes
only blocks whose bound reaches the chunk's lowest floor, and within a block only queries whose own bound (weights times the
block's greatest weights) reaches their floor. Each pass keeps k rows a query. No category is a key of user rows, so none is hot.

A user is sent to every chunk that its block may be near to. Chunks grow with the queries and their number is that of the tasks, so what is sent grows with the
users and not with users times queries; only past MOST queries a chunk, which bounds a task's memory, there are more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import tasks, written

FOUND = "query string, user_key string, sim double"
LEAST, MOST, SLICE = 512, 32_768, 4_096  # queries in a chunk, and in a product with a block


def packed(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, v, lead): a row for each vector, v: array of (category, w), lead: the category of the greatest weight."""
    return vectors.groupBy(*keys).agg(F.collect_list(F.struct("category", "w")).alias("v"), F.max_by("category", F.struct("w", "category")).alias("lead"))


def in_blocks(rows: DataFrame, key: Column, size: int, name: str) -> DataFrame:
    """rows(lead, ..) with a block of about `size` rows of one leading category, by a hash of the key."""
    counts = rows.groupBy("lead").agg(F.ceil(F.count("*") / size).alias("_n"))
    dealt = rows.join(counts.select(F.concat("lead", F.lit("")).alias("lead"), "_n"), "lead")  # a plain shuffle, so a leading category of many rows can be split
    return dealt.withColumn(name, F.xxhash64("lead", F.pmod(F.xxhash64(key), F.col("_n")))).drop("_n", "lead")


def greatest_weights(rows: DataFrame, block: str) -> DataFrame:
    """(block, category, top) of rows(block, v)."""
    return rows.select(block, F.explode("v").alias("x")).groupBy(block, F.col("x.category").alias("category")).agg(F.max("x.w").alias("top"))


def block_bounds(queries: DataFrame, users: DataFrame) -> DataFrame:
    """(chunk, block, bound) of the chunks and blocks that share a category, from their greatest weights' inverted lists."""
    a, b = greatest_weights(queries, "chunk"), greatest_weights(users, "block").withColumnRenamed("top", "own")
    return a.join(b, "category").groupBy("chunk", "block").agg(F.sum(F.col("top") * F.col("own")).alias("bound"))


def compare(queries: DataFrame, users: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query, user_key, sim): the k best of each query(query, self, v, chunk, floor) among the users(user_key, v, block) of its chunk's pairs(chunk, block, bound).

    A task holds one chunk of queries and one block of users at a time.
    """
    cols = ["chunk", "rank", "block", "key", "self", F.col("v.category").alias("category"), F.col("v.w").alias("w"), "floor"]  # two plain arrays are half the bytes of one of pairs
    asked = queries.withColumn("rank", F.lit(float("-inf"))).withColumn("block", F.lit(0).cast("long")).withColumn("key", F.col("query")).select(cols)
    near = pairs.join(users, "block").withColumn("rank", -F.col("bound")).withColumn("key", F.col("user_key")).withColumn("self", F.lit(None).cast("string")).withColumn("floor", F.lit(None).cast("double")).select(cols)
    rows = asked.unionByName(near).repartition(tasks(users.sparkSession), "chunk").sortWithinPartitions("chunk", "rank", "block", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        chunk: Chunk | None = None
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held = []
            if now[1]:
                chunk.meet(*sparse(t), t.column("key").to_pylist())
            else:
                chunk = Chunk(t, k)

        for b in batches:
            ids = np.asarray(b.column("chunk"))
            block = np.asarray(b.column("block"))
            user = np.asarray(b.column("rank")) > -np.inf
            change = np.flatnonzero((np.diff(ids) != 0) | (np.diff(block) != 0) | (np.diff(user.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(ids)], strict=True):
                key = (ids[lo], bool(user[lo]), block[lo])
                if key != now:
                    yield from done() or ()
                    if now is not None and key[0] != now[0]:
                        yield chunk.best()
                    now = key
                held.append(b.slice(lo, hi - lo))
        if now is not None:
            yield from done() or ()
            yield chunk.best()

    return rows.mapInArrow(run, FOUND)


def sparse(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, category and weight of each entry of column v, or of columns category and w."""

    def flat(name: str) -> tuple[np.ndarray, pa.Array]:
        v = t.column(name).combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        return np.repeat(np.arange(len(v)), np.diff(np.asarray(v.offsets))), v.flatten()

    if "v" in t.column_names:
        row, v = flat("v")
        category, w = v.field("category"), v.field("w")
    else:
        (row, category), (_, w) = flat("category"), flat("w")
    return row, category.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False)


class Chunk:
    """Some queries with their best users so far."""

    def __init__(self, t: pa.Table, k: int):
        row, category, w = sparse(t)
        self.k = k
        self.names, code = np.unique(category, return_inverse=True)
        self.keys, own = t.column("key").to_pylist(), t.column("self").to_pylist()
        self.own, self.has_own = np.array([x if x is not None else "" for x in own], dtype=object), np.array([x is not None for x in own])
        self.m = np.zeros((len(self.keys), len(self.names)))
        np.add.at(self.m, (row, code), w)
        self.rough = self.m.astype(np.float32)
        self.floor = np.nan_to_num(t.column("floor").to_numpy(zero_copy_only=False).astype(float), nan=0.0)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, similarity, user
        self.fresh = 0

    def meet(self, row: np.ndarray, category: np.ndarray, w: np.ndarray, users: list[str]) -> None:
        """Compare with one block of users, in order of their keys; queries whose bound is below their floor are left out.

        Single precision tells which pairs can reach a floor, and only these are worked out in double.
        """
        if not len(self.names):
            return
        code = np.minimum(np.searchsorted(self.names, category), len(self.names) - 1)
        known = self.names[code] == category
        u = np.zeros((len(users), self.m.shape[1]))
        np.add.at(u, (row[known], code[known]), w[known])
        rough, names = u.astype(np.float32).T, np.array(users, dtype=object)
        may = np.flatnonzero(self.m @ u.max(axis=0, initial=0.0) >= self.floor - 1e-9)
        for at in range(0, len(may), SLICE):
            q = may[at : at + SLICE]
            new = self.floor[q] <= 0  # without a floor: a block's first k and one more, for oneself
            a, b = np.nonzero(self.rough[q] @ rough >= (self.floor[q] - 1e-5).astype(np.float32)[:, None]) if not new.all() else (np.zeros(0, int), np.zeros(0, int))
            a, b = a[~new[a]], b[~new[a]]
            if new.any():
                first = np.argsort(-np.round(self.m[q[new]] @ u.T, 9), axis=1, kind="stable")[:, : self.k + 1]
                a, b = np.concatenate([a, np.repeat(np.flatnonzero(new), first.shape[1])]), np.concatenate([b, first.ravel()])
            a = q[a]
            s = np.round(np.einsum("ij,ij->i", self.m[a], u[b]), 12)
            good = (s > 0) & (np.round(s, 9) >= self.floor[a]) & ~(self.has_own[a] & (self.own[a] == names[b]))
            if good.any():
                self.kept.append((a[good], s[good], names[b[good]]))
                self.fresh += int(good.sum())
        if self.fresh > len(self.keys) * self.k // 2:
            self.cut()

    def cut(self) -> None:
        """Keep each query's k best and raise the floors; in order of queries and ranks."""
        if not self.fresh:
            return
        q, s, user = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((np.unique(user, return_inverse=True)[1], -np.round(s, 9), q))
        q, s, user = q[order], s[order], user[order]
        start = np.searchsorted(q, q)
        best = np.arange(len(q)) - start < self.k
        last = np.flatnonzero(np.arange(len(q)) - start == self.k - 1)
        self.floor[q[last]] = np.maximum(self.floor[q[last]], np.round(s[last], 9))
        self.kept, self.fresh = [(q[best], s[best], user[best])], 0

    @property
    def found(self) -> list[list[tuple[float, str, float]]]:
        """Of each query its best (-similarity to nine places, user, similarity)."""
        self.cut()
        out: list[list[tuple[float, str, float]]] = [[] for _ in self.keys]
        for part in self.kept:
            for q, s, user in zip(*part, strict=True):
                out[q].append((-round(float(s), 9), user, float(s)))
        return out

    def best(self) -> pa.RecordBatch:
        self.cut()
        q, s, user = self.kept[0] if self.kept else (np.zeros(0, int), np.zeros(0), np.zeros(0, object))
        return pa.RecordBatch.from_arrays([pa.array([self.keys[i] for i in q.tolist()], pa.string()), pa.array(user.tolist(), pa.string()), pa.array(s, pa.float64())], names=["query", "user_key", "sim"])


def coded(vectors: DataFrame, categories: DataFrame) -> DataFrame:
    """vectors(.., category, w) with the numbers of categories(category, code) instead of their names; others, which no user has, are left out."""
    return vectors.join(categories, "category").withColumn("category", F.col("code")).drop("code")


def nearest_users(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 512, chunk: int | None = None) -> DataFrame:
    """(query, user_key, sim, rank): the k users of the greatest cosine above 0, oneself excluded; ties by user_key.

    queries: (query, self, category, w), vectors: (user_key, category, w), both of length 1 by key and not negative. block and chunk: rows in a block of
    users and in a chunk of queries, about; without chunk a task's share of the queries. Null keys are left out; no rows, no rows.
    """
    vectors, queries = vectors.where("user_key is not null and category is not null"), queries.where("query is not null and category is not null")
    names = vectors.select("category").distinct()  # a catalogue's, so they are few
    names = written(names.select("category", F.row_number().over(W.orderBy("category")).alias("code")), "category_codes")
    users = written(in_blocks(packed(coded(vectors, names), "user_key"), F.col("user_key"), block, "block"), "user_blocks")
    asked = written(packed(coded(queries, names), "query", "self"), "query_vectors")
    chunk = chunk or max(LEAST, min(MOST, -(-asked.count() // tasks(queries.sparkSession))))
    asked = written(in_blocks(asked, F.col("query"), chunk, "chunk"), "query_chunks")
    bounds = written(block_bounds(asked, users), "block_bounds")
    first = bounds.withColumn("_r", F.row_number().over(W.partitionBy("chunk").orderBy(F.desc("bound"), "block"))).where("_r <= 2").drop("_r")
    best = written(compare(asked.withColumn("floor", F.lit(0.0)), users, first, k), "nearest_first")
    floors = best.groupBy("query").agg(F.when(F.count("*") >= k, F.min(F.round("sim", 9))).otherwise(0.0).alias("floor"))
    asked = asked.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    low = asked.groupBy("chunk").agg(F.min("floor").alias("low"))
    rest = bounds.join(first.select("chunk", "block"), ["chunk", "block"], "left_anti").join(low, "chunk").where(F.col("bound") >= F.col("low") - 1e-9).drop("low")
    found = best.unionByName(compare(asked, users, rest, k))
    w = W.partitionBy("query").orderBy(F.desc(F.round("sim", 9)), "user_key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
