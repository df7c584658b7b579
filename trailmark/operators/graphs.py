"""Behaviour graphs as edge tables (src, dst, weight), and trending scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import min_max
from ..sources.shared import tasks, written


def jaccard_pairs(df: DataFrame, basket: str, item: str, catalogue: DataFrame | None = None, max_items: int | None = None, block: int = 500) -> DataFrame:
    """B1, B2: Jaccard of the basket sets of each two items that share a basket; both directions, no diagonal.

    Pairs are made distinct first and larger baskets than max_items (a stated limit, off by default) left out. A basket of more than
    `block` items is dealt into blocks of about so many, and each pair of its blocks is a join key of its own: an item goes to every pair that its block
    is in, so a basket of n items is n * n / block rows over as many tasks, and no task has more than two blocks of it.
    """
    pairs = df.select(F.col(basket).alias("b"), F.col(item).alias("i")).where("b is not null and i is not null").distinct()
    if catalogue is not None:
        pairs = pairs.join(catalogue.select(F.col(item).alias("i")).distinct(), "i", "left_semi")
    pairs = written(pairs, "basket_items")
    sizes = pairs.groupBy("b").agg(F.count("*").alias("_n"))
    if max_items is not None:
        pairs = pairs.join(sizes.where(F.col("_n") <= max_items).select("b"), "b", "left_semi")
    n = pairs.groupBy("i").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("_n") > block).select("b", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    own = pairs.join(large, "b", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("g", F.pmod(F.xxhash64("i"), F.col("_blocks")).cast("int"))
    dealt = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("b", "i", "g", F.least("g", "_o").alias("p"), F.greatest("g", "_o").alias("q"))
    x, y = dealt.alias("x"), dealt.alias("y")
    meet = (F.col("x.b") == F.col("y.b")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q")) & (F.col("x.i") < F.col("y.i")) & ((F.col("x.p") == F.col("x.q")) | (F.col("x.g") != F.col("y.g")))
    both = x.join(y, meet).groupBy(F.col("x.i").alias("src"), F.col("y.i").alias("dst")).agg(F.count("*").alias("n_both"))
    j = both.join(n.select(F.col("i").alias("src"), F.col("n").alias("n_src")), "src").join(n.select(F.col("i").alias("dst"), F.col("n").alias("n_dst")), "dst")
    half = j.select("src", "dst", (F.col("n_both") / (F.col("n_src") + F.col("n_dst") - F.col("n_both"))).alias("weight"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def transitions(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Probability of the next place after another; weighted by kind of event, no self loops, catalogue only."""
    kind = F.when(F.col("event_name") == "map-user-action", 1.5).when(F.col("event_name") == "scroll", 0.3).otherwise(1.0)
    known = catalogue.select("location_id").distinct()
    moves = events.where("previous_location_id is not null and location_id is not null and previous_location_id != location_id")
    moves = moves.join(known, "location_id", "left_semi").join(known.withColumnRenamed("location_id", "previous_location_id"), "previous_location_id", "left_semi")
    w = moves.groupBy(F.col("previous_location_id").alias("src"), F.col("location_id").alias("dst")).agg(F.sum(kind).alias("w"))
    return w.select("src", "dst", (F.col("w") / F.sum("w").over(W.partitionBy("src"))).alias("weight"))


def edge_scores(seeds: DataFrame, edges: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(request_id, location_id, score): mean edge weight over the request's seeds in the catalogue; repeated seeds count twice."""
    matched = seeds.join(catalogue.select("location_id"), "location_id", "left_semi")
    n = matched.groupBy("request_id").agg(F.count("*").alias("_n"))
    s = matched.join(edges, matched.location_id == edges.src).groupBy("request_id", F.col("dst").alias("location_id")).agg(F.sum("weight").alias("_w"))
    return s.join(n, "request_id").select("request_id", "location_id", (F.col("_w") / F.col("_n")).alias("score"))


def joint_edge_scores(seeds: DataFrame, kinds: dict[str, DataFrame], catalogue: DataFrame, few: int = 1_000_000) -> dict[str, DataFrame]:
    """B5 over several kinds of edges at once: the edge_scores of each.

    Edges of the same two places are one row, so seeds meet them once and not once a kind. A seed meets all edges of its place, far more than the bytes it starts from
    tell: seeds are dealt to all cores by request, and up to `few` edges sent to all tasks, so what they meet is summed where it is and not shuffled; more edges are dealt by place.
    """
    n = tasks(seeds.sparkSession)
    each = [e.select("src", "dst", *[(F.col("weight") if k == kind else F.lit(None).cast("double")).alias(k) for k in kinds]) for kind, e in kinds.items()]
    edges = written(reduce(DataFrame.unionByName, each).groupBy("src", "dst").agg(*[F.max(k).alias(k) for k in kinds]), "edges")
    matched = seeds.join(catalogue.select("location_id"), "location_id", "left_semi").select("request_id", F.col("location_id").alias("src"))
    matched = written(matched, "matched_seeds")
    sizes = matched.groupBy("request_id").agg(F.count("*").alias("_n"))
    met = matched.repartition(n, "request_id").join(F.broadcast(edges), "src") if edges.count() <= few else matched.repartition(n, "src").join(edges.repartition(n, "src"), "src")
    sums = met.groupBy("request_id", F.col("dst").alias("location_id")).agg(*[F.sum(k).alias(k) for k in kinds])
    sums = written(sums.join(sizes, "request_id"), "edge_sums")
    return {k: sums.where(F.col(k).isNotNull()).select("request_id", "location_id", (F.col(k) / F.col("_n")).alias("score")) for k in kinds}


def divide_by_max(scores: DataFrame, column: str = "score") -> DataFrame:
    """By the request's greatest score if that is above 0."""
    top = F.max(column).over(W.partitionBy("request_id"))
    return scores.withColumn(column, F.when(top > 0, F.col(column) / top).otherwise(F.col(column)))


def session_blend(session: DataFrame, moves: DataFrame, share: float = 0.6) -> DataFrame:
    """0.6 session Jaccard and 0.4 transition, each divided by its max."""
    a = divide_by_max(session).select("request_id", "location_id", (share * F.col("score")).alias("score"))
    b = divide_by_max(moves).select("request_id", "location_id", ((1 - share) * F.col("score")).alias("score"))
    return a.unionByName(b).groupBy("request_id", "location_id").agg(F.sum("score").alias("score"))


def exact_median(df: DataFrame, column: str, buckets: int = 16_384) -> float | None:
    """The median of a long column (nulls left out), the mean of the two middle values where their number is even; None without values.

    Distributed selection: a histogram of equal widths tells in which bucket the lower middle value lies, and the next one divides that bucket, until
    its width is 1 (three rounds for times of a month in microseconds). Each round is a small aggregate of at most `buckets` counts; no rows are sorted and none goes to one task.
    """
    v = df.select(F.col(column).cast("long").alias("v")).where("v is not null")
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank = before = (n - 1) // 2  # values before the lower middle one in all, and then in the bucket
    while high > low:
        width = -(-(high - low + 1) // buckets)
        part = v.where(F.col("v").between(low, high)).groupBy(F.expr(f"(v - {low}L) div {width}L").alias("k")).count()
        for k, count in sorted(part.collect()):
            if before < count:
                low, high = low + k * width, min(high, low + k * width + width - 1)
                break
            before -= count
    if n % 2:
        return float(low)
    upto, above = v.agg(F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v")))).first()
    return float(low) if upto > rank + 1 else (low + above) / 2


def trending(events: DataFrame, weight: str | None = "quality_weight", least: int = 3) -> DataFrame:
    """Log of late over early weight around the median event time, scaled; 0 for places with fewer than `least` events."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.5)) if weight else F.lit(1.0)
    e = written(events.where("location_id is not null and event_time is not null").select("location_id", F.unix_micros(F.col("event_time").cast("timestamp")).alias("t"), w.alias("w")), "event_times")
    cut = exact_median(e, "t")
    late = F.col("t") >= F.lit(cut)
    sums = e.groupBy("location_id").agg(F.sum(F.when(~late, F.col("w")).otherwise(0.0)).alias("early"), F.sum(F.when(late, F.col("w")).otherwise(0.0)).alias("late"), F.count("*").alias("n_events"))
    some = sums.where(F.col("n_events") >= least).withColumn("raw", F.log1p((F.col("late") + 1) / (F.col("early") + 1)))
    scaled = min_max(some, "raw", "trending_score")
    return scaled.select("location_id", "n_events", "early", "late", "trending_score").unionByName(sums.where(F.col("n_events") < least).select("location_id", "n_events", "early", "late", F.lit(0.0).alias("trending_score")))


def top_trending(scores: DataFrame, names: DataFrame, n: int = 10) -> DataFrame:
    """A top-n report of places with a score above 0."""
    return scores.where("trending_score > 0").join(names, "location_id").orderBy(F.desc(F.round("trending_score", 6)), "location_id").limit(n)
