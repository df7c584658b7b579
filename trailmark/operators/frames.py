"""Interactions, places and users from events or from a wide feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import category_union, clean_id, min_max
from ..sources.shared import written

PRIORS = ("total_location_interactions_all_users", "distinct_users_interacted_location", "distinct_sessions_interacted_location", "total_location_score_all_users", "total_marker_clicks_all_users", "total_detail_cta_all_users")


def event_weight(df: DataFrame) -> Column:
    """Null or absent is 0.5 here (unlike the quality weight)."""
    return F.coalesce(F.col("interaction_weight").cast("double"), F.lit(0.5)) if "interaction_weight" in df.columns else F.lit(0.5)


def interactions_from_features(features: DataFrame, order: list[str]) -> DataFrame:
    """Rows with both keys; of repeats the last in the given order."""
    w = W.partitionBy("user_key", "location_id").orderBy(*[F.col(c).desc() for c in order])
    own = features.withColumn("user_key", clean_id(F.col("user_key"))).withColumn("location_id", clean_id(F.col("location_id"))).where("user_key is not null and location_id is not null")
    return own.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def interactions_from_events(events: DataFrame) -> DataFrame:
    """I2"""
    w = event_weight(events)
    return events.where("user_key is not null and location_id is not null").groupBy("user_key", "location_id").agg(
        F.count("*").alias("total_interactions_with_location"), F.sum(w).alias("total_interaction_score"), F.avg(w).alias("avg_interaction_score"),
        F.sum(F.coalesce("engagement_time_msec_capped", F.lit(0.0))).alias("total_location_engagement_msec_capped"),
        F.min("event_time").alias("first_interaction_time"), F.max("event_time").alias("last_interaction_time"))


def locations_from_features(features: DataFrame) -> DataFrame:
    """L1: one row for each place: first names, greatest priors, popularity and engagement scaled."""
    own = features.where("location_id is not null").groupBy("location_id").agg(
        F.min_by("location_name", F.struct("user_key")).alias("location_name"), F.min_by("primary_category", F.struct("user_key")).alias("primary_category"),
        *[F.max(c).alias(c) for c in PRIORS if c in features.columns], F.max("avg_location_engagement_all_users_msec_capped").alias("avg_location_engagement_all_users_msec_capped"))
    scaled = min_max(own.withColumn("popularity_raw", F.coalesce("total_location_score_all_users", F.lit(0.0))), "popularity_raw", "popularity_norm")
    return min_max(scaled.withColumn("_e", F.coalesce("avg_location_engagement_all_users_msec_capped", F.lit(0.0))), "_e", "engagement_norm").drop("_e")


def locations_from_events(events: DataFrame, approximate: bool = False, popularity_basis: str = "score") -> DataFrame:
    """L2: priors of each place. approximate: sketches of distinct users and sessions (one pass, no expansion)."""
    distinct = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.count_distinct(c))
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    w, name = event_weight(events), F.col("event_name")
    own = events.where("location_id is not null").groupBy("location_id").agg(
        F.count("*").alias("total_location_interactions_all_users"), distinct(filled("user_key")).alias("distinct_users_interacted_location"),
        distinct(filled("session_key")).alias("distinct_sessions_interacted_location"), F.sum(w).alias("total_location_score_all_users"), F.avg(w).alias("avg_location_score_all_users"),
        F.count_if(name == "map-user-action").alias("total_marker_clicks_all_users"), F.count_if(name.contains("detail") | name.contains("cta")).alias("total_detail_cta_all_users"),
        F.avg(F.coalesce("engagement_time_msec_capped", F.lit(0.0))).alias("avg_location_engagement_all_users_msec_capped"))
    own = written(own, "place_sums")  # scaling reads them several times
    raw = "distinct_users_interacted_location" if popularity_basis == "distinct_users" else "total_location_score_all_users"
    scaled = min_max(own.withColumn("popularity_raw", F.col(raw).cast("double")), "popularity_raw", "popularity_norm")
    return min_max(scaled, "avg_location_engagement_all_users_msec_capped", "engagement_norm")


def locations_from_dim(dim: DataFrame) -> DataFrame:
    """L3: neutral rows for places of which nothing is known."""
    return dim.select("location_id", "location_name", F.lit("Attractions").alias("primary_category"), *[F.lit(0.0).alias(c) for c in (*PRIORS, "popularity_raw", "popularity_norm", "engagement_norm")])


def expand_universe(dim: DataFrame, observed: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """L4: every official place, with what was observed or neutral zeros, and coordinates."""
    known = observed.drop("location_name").withColumn("_seen", F.lit(True))
    out = dim.join(known, "location_id", "left").withColumn("observed", F.coalesce("_seen", F.lit(False))).drop("_seen").withColumn("source", F.lit("official"))
    zeros = [c for c, k in observed.dtypes if k in ("double", "bigint", "int")]
    out = out.fillna(0, subset=zeros)
    return out if geo is None else out.join(geo, "location_id", "left")


def users_from_features(features: DataFrame) -> DataFrame:
    """U1"""
    return features.groupBy("user_key").agg(F.max("total_user_interactions").alias("total_user_interactions"), F.min("first_seen_time").alias("first_seen_time"), F.max("last_seen_time").alias("last_seen_time"), F.min_by("city", F.when(F.col("city").isNotNull(), F.struct("location_id"))).alias("city"))


def users_from_interactions(interactions: DataFrame) -> DataFrame:
    """U2"""
    return interactions.groupBy("user_key").agg(F.sum("total_interactions_with_location").alias("total_user_interactions"), F.count_distinct("location_id").alias("distinct_locations_interacted"), F.sum("total_interaction_score").alias("total_user_interaction_score"), F.avg("avg_interaction_score").alias("avg_user_interaction_score"), F.min("first_interaction_time").alias("first_seen_time"), F.max("last_interaction_time").alias("last_seen_time"))


def place_categories(df: DataFrame, order: list[str]) -> DataFrame:
    """Ordered categories of each place."""
    return category_union(df, ["location_id"], "location_category_name", "primary_category", order)


def distinct_categories(categories: DataFrame) -> DataFrame:
    """A1"""
    return categories.select(F.explode("categories").alias("category")).distinct().orderBy("category")


def observed_counts(universe: DataFrame) -> DataFrame:
    """A2"""
    return universe.agg(F.count("*").alias("n_official"), F.count_if("observed").alias("n_observed"))


def reconcile(raw: DataFrame, clean: DataFrame, min_count: int = 5, min_diff: float = 0.5) -> DataFrame:
    """A3: event counts of each place before and after cleaning; warn where both size and difference are large."""
    a = raw.groupBy("location_id").agg(F.count("*").alias("raw_events"), F.count_distinct("user_key").alias("raw_users"))
    b = clean.groupBy("location_id").agg(F.count("*").alias("clean_events"), F.count_distinct("user_key").alias("clean_users"))
    j = a.join(b, "location_id", "full_outer").fillna(0)
    top = F.greatest("raw_events", "clean_events")
    rel = F.abs(F.col("raw_events") - F.col("clean_events")) / F.greatest(top, F.lit(1))
    return j.withColumn("rel_diff", rel).withColumn("warn", (top >= min_count) & (rel >= min_diff))


def health(metrics: dict[str, DataFrame]) -> DataFrame:
    """A4: row counts as (metric, value)."""
    out = None
    for name, df in metrics.items():
        row = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def user_labels(interactions: DataFrame, categories: DataFrame, top: int = 3) -> DataFrame:
    """A5: each user's top categories by number of places, number of places and label, by total score."""
    j = interactions.join(categories, "location_id")
    n = j.select("user_key", F.explode("categories").alias("category")).groupBy("user_key", "category").agg(F.count("*").alias("n"))
    w = W.partitionBy("user_key").orderBy(F.desc("n"), "category")
    tops = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy("user_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "category"))), lambda x: x["category"]).alias("top_categories"))
    per = interactions.groupBy("user_key").agg(F.count("*").alias("n_locations"), F.sum("total_interaction_score").alias("total_score"))
    return per.join(tops, "user_key").withColumn("label", F.concat("user_key", F.lit(" ("), F.array_join("top_categories", ", "), F.lit(", "), F.col("n_locations").cast("string"), F.lit(" places)")))
