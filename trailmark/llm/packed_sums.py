"""Sums of counts by key over many blocks, with keys and counts packed: few rows however many keys.

A block deals its distinct keys by six bits of their hash into 64 parts, a row each. Rows of one part are merged `fan` blocks at a time; where
that leaves more than one group of a part, the merged keys are dealt by the next six bits and merged again. So rows stay
in proportion to the blocks at each level, and a task's keys to `fan` blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_model import keys_of, numbers, packed_keys, packed_numbers
from .packed import mix
from .shared import written

PARTS, FAN = 64, 128
ROWS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ROWS_SQL = "part long, block long, keys binary, counts binary"


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys (uint64) and the exact sums of their counts."""
    key, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first)


def part_rows(block: int, keys: np.ndarray, counts: np.ndarray, level: int = 0, part: int = 0) -> pa.RecordBatch:
    """Rows of one block's distinct sorted keys."""
    own = (mix(keys) >> np.uint64(58 - 6 * level)) & np.uint64(PARTS - 1)
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.arange(PARTS + 1))
    some = [p for p in range(PARTS) if bounds[p] < bounds[p + 1]]
    each = [order[bounds[p] : bounds[p + 1]] for p in some]
    return pa.RecordBatch.from_arrays([pa.array([part * PARTS + p for p in some], pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array([packed_keys(keys[k]) for k in each], pa.binary()), pa.array([packed_numbers(counts[k].astype(np.int64)) for k in each], pa.binary())], schema=ROWS)


def sum_packed(rows: DataFrame, blocks: int, least: int = 1, fan: int = FAN) -> DataFrame:
    """(key, n) of the keys whose sum is at least `least`; rows: as part_rows() makes them, of about `blocks` blocks."""
    level = 0
    while True:
        salts = max(1, -(-blocks // fan))
        last = salts == 1

        def merge(batches: Iterator[pa.RecordBatch], last=last, level=level) -> Iterator[pa.RecordBatch]:
            def one(part: int, salt: int, keys: list, counts: list) -> pa.RecordBatch:
                key, n = summed([keys_of(x) for x in keys], [numbers(x, np.int64) for x in counts])
                if not last:
                    return part_rows(salt, key, n, level + 1, part)
                often = n >= least
                return pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often])], names=["key", "n"])

            now, keys, counts = None, [], []
            for b in batches:
                for part, salt, k, c in zip(*(b.column(x).to_pylist() for x in ("part", "salt", "keys", "counts")), strict=True):
                    if now is not None and now != (part, salt):
                        yield one(*now, keys, counts)
                        keys, counts = [], []
                    now = (part, salt)
                    keys.append(k)
                    counts.append(c)
            if now is not None:
                yield one(*now, keys, counts)

        dealt = rows.select("part", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("long").alias("salt"), "keys", "counts").repartition(min(PARTS * salts, 20_000), "part", "salt").sortWithinPartitions("part", "salt")
        if last:
            return dealt.mapInArrow(merge, "key long, n long")
        rows, blocks, level = written(dealt.mapInArrow(merge, ROWS_SQL), "packed_sums"), salts, level + 1
