"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous rounds.

Pieces of documents are taken in bands of lengths, each band half as long as the one before. A round sorts
the band's pieces and the gaps of all open sequences into ranges by size, from large to small, with a carry of
counts from size to size. Read in this order a gap is an opening bracket and a piece a closing one: the
bracket that a piece closes is its successor, the smallest free gap that holds it, and where several pieces
have the same successor the longer one has it by its rank and the others get the next. The bracket depth
is the carry (counts by size, at most capacity numbers) plus a rank; pieces and gaps of one depth meet in one
sweep (a window), so a round is two or three shuffles of narrow rows. Then the gaps are updated and rounds repeat; what fits nowhere opens sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .packed import blocks, utf8
from .shared import renamed_aside, written
from .tokens import encoder
from .workers import gives_back

PIECE_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
GAP, PIECE = 0, 1  # kinds of rows in a round; at equal sizes the gap comes first


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Ids of each docs(doc_id, text) with an end id, cut into pieces of at most capacity ids.

    doc_id, piece (from 0), start, length, ids_crc32 and, if asked for, ids (binary, little-endian
    uint32). A null text is an empty one: one piece that is the end id. Repeated rows and null ids
    are documents of their own; other columns are not read.
    """
    schema = pa.schema(PIECE_FIELDS + [("ids", pa.binary())] * with_ids)

    @gives_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, keep_space=False)
        for b in batches:
            buf, off = utf8(b.column(1))
            for i, j in blocks(off):
                ids, at = enc.encode(buf, off[i : j + 1], end_id)
                size = np.diff(at)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                data = ids.view(np.uint8)
                lo = (at[:-1][doc] + start) * 4
                parts = [data[a : a + w] for a, w in zip(lo.tolist(), (4 * length).tolist(), strict=True)]
                cols = [b.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([x.tobytes() for x in parts], pa.binary())] * with_ids, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def seats_in(room: int, longest: int, shortest: int, most: int) -> int:
    """How many pieces of shortest to longest ids a gap takes part with: none, one, or several where it holds the longest twice (`most` at most)."""
    return 0 if room < shortest else min(max(1, room // longest), most)


def seats_of(open_sequences: DataFrame, longest: int, shortest: int, most: int) -> DataFrame:
    """(kind, id, room, size) of the seats in open_sequences(id, room), by the rule of seats_in; a gap without one stays, with the size null."""
    seats = F.when(F.col("room") < shortest, 0).otherwise(F.least(F.greatest(F.lit(1), F.floor(F.col("room") / longest)), F.lit(most))).cast("int")
    each = F.explode(F.when(seats == 0, F.array(F.lit(None).cast("long"))).otherwise(F.array_repeat(F.floor(F.col("room") / seats), seats)))
    return open_sequences.select(F.lit(GAP).alias("kind"), "id", "room", each.alias("size"))


def depths(seats: Counter, pieces: Counter) -> list[tuple[int, int, int]]:
    """(size, kind, depth): the carry before each size, from counts by size of seats and pieces.

    Brackets open so far, less pieces that found none to close; sizes from large to small, gaps before pieces.
    """
    out, open_now = [], 0
    for size in sorted({*seats, *pieces}, reverse=True):
        for kind, n in ((GAP, seats[size]), (PIECE, pieces[size])):
            if n:
                out.append((size, kind, open_now))
                open_now = max(0, open_now + (n if kind == GAP else -n))
    return out


def ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """rows(id, size, kind) with their rank (from 1) among those of equal size and kind; one size's rows are dealt into buckets."""
    if buckets == 1:
        return rows.withColumn("rank", F.row_number().over(W.partitionBy("size", "kind").orderBy("id")))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    counts = rows.groupBy("size", "kind", "b").agg(F.count("*").alias("n"))
    before = W.partitionBy("size", "kind").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("size", "kind", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("size", "kind", "b").orderBy("id"))
    return rows.withColumn("own", own).join(counts, ["size", "kind", "b"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "b")


def sweep(seats: DataFrame, pieces: DataFrame, carry: list[tuple[int, int, int]], buckets: int = 1, tasks: int = 4) -> DataFrame:
    """One round: (kind, id, room, size, partner, partner_size) of seats(kind, id, room, size) and pieces(id, size).

    partner: the sequence a piece has got (null: none), the piece a seat has got. carry: depths() of their counts.
    Rows are narrow and a round may have few, so its stages have as many tasks as the rows ask for.
    """
    rows = seats.unionByName(pieces.select(F.lit(PIECE).alias("kind"), "id", F.lit(None).cast("long").alias("room"), "size"))
    level = F.broadcast(rows.sparkSession.createDataFrame(carry, "size long, kind int, depth long"))  # 2 * capacity rows at most
    seated = ranked(rows.where("size is not null"), buckets).coalesce(tasks).join(level, ["size", "kind"])
    is_gap = F.col("kind") == GAP
    seated = seated.withColumn("at", F.when(is_gap, F.col("depth") + F.col("rank")).otherwise(F.col("depth") - F.col("rank") + 1))
    depth = W.partitionBy("at").orderBy(F.desc("size"), "kind")
    # pieces without a bracket to close and gaps without a seat stand alone, each on a depth of its own below 0
    seated = seated.select("kind", "id", "room", "size", "at").unionByName(rows.where("size is null").select("kind", "id", "room", "size", (-1 - F.col("id")).alias("at")))
    partner = F.when(is_gap, F.lead("id").over(depth)).otherwise(F.lag("id").over(depth))
    return seated.select("kind", "id", "room", "size", F.when(F.col("at") > 0, partner).alias("partner"), F.when((F.col("at") > 0) & is_gap, F.lead("size").over(depth)).alias("partner_size")).coalesce(tasks)


def open_after(swept: DataFrame, capacity: int, tasks: int = 4) -> DataFrame:
    """(id, room) of the sequences with room left after a round; those opened in vain go."""
    gaps = swept.where(F.col("kind") == GAP).groupBy("id").agg((F.first("room") - F.coalesce(F.sum("partner_size"), F.lit(0))).alias("room"))
    return gaps.where((F.col("room") > 0) & (F.col("room") < capacity)).coalesce(tasks)


def by_size(rows: DataFrame, column: str) -> Counter:
    """Counts by a column that has at most capacity values."""
    return Counter({r[0]: r[1] for r in rows.groupBy(column).count().coalesce(1).collect()})


def placed(lengths: DataFrame, capacity: int, rows_per_bucket: int = 200_000, rows_per_task: int = 30_000) -> DataFrame:
    """(id, sequence_id, offset) of lengths(id, size), a stored table with unique ids and sizes of 1 to capacity.

    A band's rounds: one on the open sequences, one that opens as many sequences as the rest would fill, then
    rounds that open as many as the rest needs.
    """
    spark = lengths.sparkSession
    count = by_size(lengths, "size")
    if count and not 1 <= min(count) <= max(count) <= capacity:
        raise ValueError(f"length must be 1 to {capacity}")
    gaps, rooms, opened, done, high = spark.createDataFrame([], "id long, room long"), Counter(), 0, [], capacity
    while high >= 1:
        low = high // 2 + 1 if high > max(1, capacity // 256) else 1
        left = Counter({k: n for k, n in count.items() if low <= k <= high})
        pieces, tries = lengths.where(F.col("size").between(low, high)), 0
        while left:
            n, longest, shortest = left.total(), max(left), min(left)
            usable = sum(k for r, k in rooms.items() if r >= shortest)
            tries = tries or int(not usable)
            most = 1 + 2 * n // max(1, usable)
            seats, sized = seats_of(gaps, longest, shortest, most), Counter()
            for room, k in rooms.items():
                if m := seats_in(room, longest, shortest, most):
                    sized[room // m] += k * m
            if tries:
                per = capacity // longest
                new = -(-n // per) if tries > 1 else max(1, min(-(-n // per), sum(s * k for s, k in left.items()) // capacity))
                room = F.lit(capacity).cast("long")  # their seats count as the largest, so they are taken last
                seats = seats.unionByName(spark.range(opened, opened + new).select(F.lit(GAP).alias("kind"), "id", room.alias("room"), F.explode(F.array_repeat(room, per)).alias("size")))
                sized[capacity] += new * per
                opened += new
            rows = n + sized.total() + rooms.total()
            buckets, tasks = -(-rows // rows_per_bucket), max(4, -(-rows // rows_per_task))
            swept = written(sweep(seats, pieces, depths(sized, left), buckets, tasks), "sweep")
            done.append(swept.where((F.col("kind") == PIECE) & F.col("partner").isNotNull()).select("id", F.col("partner").alias("sequence_id"), "size"))
            gaps, pieces = open_after(swept, capacity, tasks), swept.where((F.col("kind") == PIECE) & F.col("partner").isNull()).select("id", "size")
            rooms, left, tries = by_size(gaps, "room"), by_size(pieces, "size"), tries + 1
        high = low - 1
    if not done:
        return spark.createDataFrame([], "id long, sequence_id long, offset long")
    inside = W.partitionBy("sequence_id").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    return reduce(DataFrame.unionByName, done).select("id", "sequence_id", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("offset"))


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces(doc_id, piece, length, ...); length is 1 to capacity.

    Places within a sequence have no gaps. Every row is a piece of its own, repeated rows and null ids too, and ties
    (equal lengths) are ranked by hash bucket and the row's number in the stored table. Columns that clash with the new ones
    get the suffix _in; no rows, no result. The driver sees counts by length (capacity of them at most), never rows.
    """
    pieces = renamed_aside(pieces, ("length",), ("sequence_id", "offset", "_row"))
    held = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    at = placed(held.select(F.col("_row").alias("id"), F.col("length").cast("long").alias("size")), capacity)
    return held.join(at.withColumnRenamed("id", "_row"), "_row").select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs(doc_id, text) with their sequence_id and offset."""
    return pack(document_pieces(docs, tokenizer_path, capacity, end_id, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (binary) of each sequence, from packed pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
