"""Descriptive reports and offline evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .rank import by_interests


def daily_active(events: DataFrame) -> DataFrame:
    """E1"""
    return events.groupBy(F.to_date("event_time").alias("day")).agg(F.count_distinct("user_key").alias("users"), F.count("*").alias("events"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Share of rows by value."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))


def top_places(events: DataFrame, n: int = 10) -> DataFrame:
    """A top-n report by clicks."""
    own = events.groupBy("location_id").agg(F.count("*").alias("clicks"), F.count_distinct("user_key").alias("users"))
    return own.withColumn("per_user", F.col("clicks") / F.col("users")).orderBy(F.desc("clicks"), "location_id").limit(n)


def depth(events: DataFrame) -> DataFrame:
    """Sessions by number of different places."""
    return events.groupBy("session_key").agg(F.count_distinct("location_id").alias("places")).groupBy("places").agg(F.count("*").alias("sessions"))


def funnel(events: DataFrame, stages: dict[str, str]) -> DataFrame:
    """Users with at least one event of each stage."""
    per = events.groupBy("user_key").agg(*[F.max(F.col("event_name") == v).alias(k) for k, v in stages.items()])
    return per.agg(*[F.count_if(k).alias(k) for k in stages]).unpivot([], list(stages), "stage", "users")


def entry_points(events: DataFrame) -> DataFrame:
    """E5: first place of each session, counted."""
    return events.groupBy("session_key").agg(F.min_by("location_id", F.struct("event_time", "event_id")).alias("location_id")).groupBy("location_id").agg(F.count("*").alias("sessions"))


def heat_map(events: DataFrame) -> DataFrame:
    """E6"""
    return events.groupBy(F.dayofweek("event_time").alias("weekday"), F.hour("event_time").alias("hour")).agg(F.count("*").alias("events"))


def leave_last(events: DataFrame, n: int = 2) -> DataFrame:
    """(user_key, location_id, held_out): the last n different places of each user are held out."""
    last = events.groupBy("user_key", "location_id").agg(F.max(F.struct("event_time", "event_id")).alias("t"))
    return last.withColumn("_r", F.row_number().over(W.partitionBy("user_key").orderBy(F.desc("t")))).select("user_key", "location_id", (F.col("_r") <= n).alias("held_out"))


def ranking_metrics(lists: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Precision, recall, hit rate, NDCG and MAP at each k, averaged over users with something held out. lists: (user_key, location_id, place)."""
    n = truth.groupBy("user_key").agg(F.count("*").alias("n_true"))
    hits = lists.join(truth.select("user_key", "location_id").distinct(), ["user_key", "location_id"]).withColumn("nth", F.row_number().over(W.partitionBy("user_key").orderBy("place")))
    out = None
    for k in ks:
        h = hits.where(F.col("place") <= k).groupBy("user_key").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("place") + 1)).alias("dcg"), F.sum(F.col("nth") / F.col("place")).alias("ap"))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_true"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        j = n.join(h, "user_key", "left").fillna(0, ["hits", "dcg", "ap"])
        row = j.agg(F.avg(F.col("hits") / k).alias("precision"), F.avg(F.col("hits") / F.col("n_true")).alias("recall"), F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"), F.avg(F.col("dcg") / ideal).alias("ndcg"), F.avg(F.col("ap") / F.least(F.col("n_true"), F.lit(k))).alias("map")).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out


def list_quality(lists: DataFrame, popularity: DataFrame, categories: DataFrame, n_places: int) -> DataFrame:
    """Coverage of the catalogue, mean novelty (-log2 popularity share) and entropy of categories over all lists."""
    pop = popularity.select("location_id", F.log2("share").alias("_p"))
    cover = lists.agg((F.count_distinct("location_id") / n_places).alias("coverage"))
    novel = lists.join(pop, "location_id").agg(F.avg(-F.col("_p")).alias("novelty"))
    c = shares(lists.join(categories.select("location_id", F.explode("categories").alias("category")), "location_id"), "category")
    return cover.crossJoin(novel).crossJoin(c.agg(F.sum(-F.col("share") * F.log2("share")).alias("entropy")))


def intra_list_diversity(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """1 less the mean cosine of two places of a list, by request."""
    v = lists.join(vectors, "location_id").select("request_id", "location_id", "token", "w")
    s = v.groupBy("request_id", "token").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))  # sum over pairs = (|sum|^2 - sum |v|^2) / 2
    n = lists.groupBy("request_id").agg(F.count("*").alias("n"))
    both = s.groupBy("request_id").agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("dots"))
    return n.join(both, "request_id").where("n > 1").select("request_id", (1 - F.col("dots") / (F.col("n") * (F.col("n") - 1) / 2)).alias("diversity"))


def baseline_popular(users: DataFrame, places: DataFrame, k: int = 10) -> DataFrame:
    """The k most popular places for everyone."""
    top = places.orderBy(F.desc(F.round("popularity_raw", 6)), "location_id").limit(k).select("location_id", F.row_number().over(W.orderBy(F.desc(F.round("popularity_raw", 6)), "location_id")).alias("place"))
    return users.crossJoin(F.broadcast(top))


def baseline_random(requests: DataFrame, places: DataFrame, k: int = 10, seed: str = "7", draws: int = 16) -> DataFrame:
    """K places of the request's interests (all places without any) in the order of a seeded hash.

    A request takes one of `draws` orders of the catalogue, each the order of a hash of seed, draw and place; so requests meet lists of k
    places a category and draw, never the whole catalogue.
    """
    drawn = requests.select("request_id", "interests", (F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", F.lit(seed), "request_id"), "UTF-8")), 1, 7), 16, 10).cast("long") % draws).cast("int").alias("draw"))
    every = places.select("location_id", "categories", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    order = [F.md5(F.encode(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"), "location_id"), "UTF-8")), F.col("location_id")]
    return by_interests(drawn, every, order, k).withColumnRenamed("rank", "place")
