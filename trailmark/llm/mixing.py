"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Sources share all words by their weights; none may give more than a stated number of times its own words, and
what that leaves over is shared again (water-filling). A source whose target is e times its size and a rest gives e complete
epochs of all its documents first; the rest is a weighted sample without replacement: each document draws the
exponential key -ln(u) / quality weight, and documents are taken in the order of their keys as long as the sum of their
sizes stays within the rest. The order is worked out in two levels: sums by ranges of keys tell in which
range the rest ends, and only that range's rows are sorted, so a hot source is never one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import written

WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
CHUNK = 4096  # copies of one row that are dealt out together


def word_count(text: Column) -> Column:
    """Runs of characters other than space and ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) of sizes(source, source_size), one row a source.

    Sources in code-point order, null last, bear the weights in turn. The targets add up to all sizes (as far as `most` times each
    allows, which it always does for most >= 1). Each round caps the sources whose share passes their bound and shares the rest
    anew, until none does; a round gives the driver two sums, and one with no new cap is the last.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    given = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    held = written(sizes.select("source", "source_size").withColumn("weight", given.cast("double")), "sources")
    bound = most * F.col("source_size").cast("double")
    total = held.agg(F.sum("source_size")).first()[0] or 0
    left, share = float(total), None  # words to share, and weights that share them
    while True:
        free = F.lit(True) if share is None else F.lit(left) * F.col("weight") / F.lit(share) <= bound
        capped, rest = held.agg(F.sum(F.when(~free, bound)), F.sum(F.when(free, F.col("weight")))).first()
        now = (float(total) - (capped or 0.0), rest or 1.0)
        if now == (left, share):
            break
        left, share = now
    return held.withColumn("target", F.least(F.lit(left) * F.col("weight") / F.lit(share), bound))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", quality_col: str | None = None, key_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix", rows_per_range: int = 100_000) -> DataFrame:
    """How often the mix takes each row: (id, source, size, quality, digest, source_size, target, copies, taken).

    docs has an id, a source, a size (long, null: 0) and, if named, a quality weight (above 0; null or less: 1) and a digest
    (string) that tells rows of one id apart. Other columns are not read. taken = copies * size; copies is at most
    `most`. Complete epochs come first, then the sample; the last place of a source goes to that document of those left whose size
    comes nearest to what is missing (if any brings the sum nearer). Ties of keys are broken by digest, id and number.

    A key's u comes from a hash of seed, id, digest and the row's number among equal rows, so reruns agree, whatever the partitions. Equal rows
    are counted first and dealt out again, so they may be very many; null ids and sources are values like others; documents of size 0
    are taken as often as their source's epochs allow; a source of size 0 has the target 0; no rows, no rows.
    """
    quality = F.coalesce(F.when(F.col(quality_col) > 0, F.col(quality_col).cast("double")), F.lit(1.0)) if quality_col else F.lit(1.0)
    digest = F.coalesce(F.col(key_col).cast("string"), F.lit("")) if key_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"), quality.alias("quality"), digest.alias("digest"))
    counted = written(rows.groupBy("id", "source", "size", "quality", "digest").agg(F.count("*").alias("n")), "mix_rows")
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = written(source_targets(sizes, weights, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix_targets")
    n_rows, n_sources = counted.agg(F.sum("n")).first()[0] or 0, targets.count()
    small = (lambda x: F.broadcast(x)) if n_sources <= 200_000 else (lambda x: x)  # a few numbers a source
    mean = counted.agg(F.sum(F.col("quality") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    ranges = max(64, math.ceil(n_rows / rows_per_range))

    own = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    own = own.withColumn("no", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n") - 1, F.col("chunk") * CHUNK + CHUNK - 1)))).drop("chunk", "n")
    bits = F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("-")), "digest", F.col("no").cast("string")), "UTF-8")), 1, 13), 16, 10).cast("long")
    key = -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / F.col("quality")
    scaled = F.col("key") * F.lit(float(mean))  # between 0 and 1 as x / (1 + x): about as many rows in each range
    keyed = own.withColumn("key", key).withColumn("range", F.floor(scaled / (1 + scaled) * ranges).cast("int"))
    keyed = written(keyed, "mix_keys")

    same = F.col("x.source").eqNullSafe(F.col("y.source"))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("s"))
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0)  # one row a range
    sums = sums.withColumn("after", F.sum("s").over(upto)).alias("x").join(small(targets).alias("y"), same).select("x.*", "y.rest")
    ends = sums.groupBy("source").agg(F.min(F.when(F.col("after") > F.col("rest"), F.struct("range", (F.col("after") - F.col("s")).alias("before")))).alias("end"))
    plan = written(targets.alias("x").join(small(ends).alias("y"), same, "left").select("x.*", F.col("y.end.range").alias("end"), F.coalesce("y.end.before", "x.source_size").alias("before")), "mix_plan")
    joined = keyed.alias("x").join(small(plan).alias("y"), same).select("x.*", "y.source_size", "y.target", "y.epochs", "y.rest", "y.end", "y.before")
    order = ("key", "digest", "id", "no")
    upto = W.partitionBy("source").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)  # one range of each source
    last = joined.where("range = end").withColumn("_sum", F.col("before") + F.sum("size").over(upto)).withColumn("picked", (F.col("_sum") <= F.col("rest")).cast("int")).drop("_sum")
    others = joined.where("end is null or range != end").withColumn("picked", (F.col("end").isNull() | (F.col("range") < F.col("end"))).cast("int"))
    picked = written(others.unionByName(last), "mix_picked")

    gap = picked.groupBy("source").agg((F.first("rest") - F.sum(F.col("picked") * F.col("size"))).alias("gap")).where("gap > 0")
    near = picked.where("picked = 0 and size > 0").alias("x").join(small(gap).alias("y"), same).where("abs(y.gap - x.size) < y.gap")
    best = near.groupBy("x.source").agg(F.min(F.struct(F.abs(F.col("y.gap") - F.col("x.size")).alias("d"), *[F.col(f"x.{c}").alias(c) for c in order])).alias("b"))
    final = picked.alias("x").join(small(best).alias("y"), same, "left")
    extra = F.coalesce((F.col("y.b.key") == F.col("x.key")) & F.col("y.b.id").eqNullSafe(F.col("x.id")) & (F.col("y.b.digest") == F.col("x.digest")) & (F.col("y.b.no") == F.col("x.no")), F.lit(False))
    copies = F.col("x.epochs") + F.col("x.picked") + extra.cast("int")
    return final.select("x.id", "x.source", "x.size", "x.quality", "x.digest", "x.source_size", "x.target", copies.alias("copies"), (copies * F.col("x.size")).alias("taken"))


def mixed_texts(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each text of docs as often as `taken` (of mix(), whose digest is text_digest() of the text) says; (doc_id, source, text, copy).

    Equal rows are one text with the sum of their copies; copy counts from 0.
    """
    total = taken.groupBy("id", "source", "digest").agg(F.sum("copies").alias("copies")).where("copies > 0")
    texts = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).withColumn("digest", text_digest(F.col("text"))).groupBy("id", "source", "digest").agg(F.first("text").alias("text"))
    both = texts.alias("x").join(total.alias("y"), F.col("x.id").eqNullSafe(F.col("y.id")) & F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.digest") == F.col("y.digest")))
    return both.select(F.col("x.id").alias("doc_id"), "x.source", "x.text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("y.copies") - 1)).alias("copy"))


def text_digest(text: Column) -> Column:
    """A null text has a digest of its own."""
    return F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("null"))
