"""Logical tables (events, locations, baskets, requests, clicks) as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EVENT_NAMES = {"click": "map-user-action", "purchase": "detail_cta", "view": "page_view", "error": "scroll", "signup": "session_start"}
MARK = "utm_source=site_recommender"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_events: one row for each event of the site."""
    return events_of(table(spark, sf_dir, "events"))


def events_of(raw: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv])
    e = raw.select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_key"),
        F.concat(F.lit("L"), F.get_json_object("props", "$.k")).alias("location_id"),
        names[F.col("event_type")].alias("event_name"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.when(F.col("event_id") % 5 != 0, 0.5 + (F.col("event_id") % 4) * 0.5).cast("double").alias("interaction_weight"),
        (F.col("value") * 20).alias("engagement_time_msec_capped"),
        F.when(F.col("event_id") % 97 == 0, f"https://site.example/?{MARK}").otherwise("https://site.example/").alias("page_location"),
    )
    return e.withColumn("session_key", F.concat("user_key", F.lit("-"), F.date_format("event_time", "yyyyMMdd")))


def with_previous(df: DataFrame) -> DataFrame:
    """The location before in the same session, where the column is absent."""
    w = W.partitionBy("session_key").orderBy("event_time", "event_id")
    return df.withColumn("previous_location_id", F.lag("location_id").over(w))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_locations: the official catalogue."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    shown = k % 23 != 0
    return p.select(
        F.concat(F.lit("L"), k.cast("string")).alias("location_id"),
        F.col("p_name").alias("location_name"),
        F.concat("p_type", F.lit("; "), "p_brand").alias("location_category_name"),
        F.col("p_type").alias("primary_category"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_size") % 10 == 0, 1).otherwise(0).alias("is_hot_spot_location"),
        F.when(F.col("p_size") % 7 == 0, 1).otherwise(0).alias("is_favorite_location"),
        F.when(shown, F.lit(41.64) + (k * 37 % 440) / 1000.0).alias("lat"),
        F.when(shown, F.lit(-87.95) + (k * 61 % 430) / 1000.0).alias("lon"),
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_baskets: orders as sessions over all parts."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("user_key"), F.col("l_orderkey").alias("session_key"), F.col("l_partkey").alias("location_id"), F.col("l_linenumber").alias("position"), F.col("o_orderdate").alias("event_time"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_clicks: the map clicks as outbound ones, time as ISO text, a third of them missing."""
    return clicks_of(events(spark, sf_dir))


def clicks_of(events_: DataFrame) -> DataFrame:
    e = events_.where("event_name = 'map-user-action'")
    return e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"), "location_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_requests: one for each user, of three kinds of preferences in turn; those of the third kind come as new visitors."""
    u = F.col("user_id")
    r = table(spark, sf_dir, "events").select("user_id").distinct().select(u, (u % 3).alias("v"))
    return r.select(
        F.concat(F.lit("r"), u.cast("string"), F.lit("-"), F.col("v").cast("string")).alias("request_id"),
        F.when(F.col("v") < 2, F.concat(F.lit("u"), u.cast("string"))).alias("user_key"),
        F.when(F.col("v") == 0, F.array().cast("array<string>")).when(F.col("v") == 1, F.array(F.lit("ECONOMY"), F.lit("PROMO"))).otherwise(F.array(F.lit("STANDARD"))).alias("interests"),
        F.when(F.col("v") == 1, F.array(F.lit("Brand#11"))).otherwise(F.array().cast("array<string>")).alias("avoid_categories"),
        (u % 7 + 1).cast("int").alias("trip_days"),
        F.lit(20).alias("top_k"),
        F.element_at(F.array(F.lit("chill"), F.lit("foodie"), F.lit("nightlife")), (u % 3 + 1).cast("int")).alias("vibe"),
        F.when(u % 2 == 1, "family").otherwise("solo").alias("traveler_type"),
        F.when(F.col("v") == 2, "Art and deep dish").alias("free_text"),
    )
