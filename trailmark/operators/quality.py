"""Engagement quality: from raw events to qualified events and user-place scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Kinds of actions and their weights.
STRONG = ("map-user-action", "detail_cta")
NOISE = ("scroll",)
NAVIGATION = ("map-search", "view_search_results", "session_start")
WEAK = ("page_view",)
TYPE_WEIGHTS = {"map-user-action": 1.5, "page_view": 1.0, "scroll": 0.3}
SOURCE_COLUMNS = ("traffic_source", "traffic_medium", "traffic_campaign", "collected_manual_source", "collected_manual_medium", "collected_manual_campaign", "page_location", "page_referrer")


@dataclass(frozen=True)
class Policy:
    name: str = "balanced"
    min_dwell: float = 1000
    min_pair_score: float = 1.5
    min_places_returning: int = 2
    max_session_events: int = 200
    markers: tuple[str, ...] = ("site_recommender", "rec_surface=")


def from_recommender(df: DataFrame, markers: tuple[str, ...]) -> Column:
    """Q1: whether any source column holds any marker, whatever its case."""
    hits = [F.coalesce(F.lower(F.col(c)).contains(m), F.lit(False)) for c in SOURCE_COLUMNS if c in df.columns for m in markers]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def drop_long_sessions(events: DataFrame, most: int = 200) -> DataFrame:
    """Q2: events of sessions of at most `most` events; events without a session go. The sizes are pre-aggregated."""
    sizes = events.where("session_key is not null").groupBy("session_key").agg(F.count("*").alias("_n")).where(F.col("_n") <= most)
    return events.join(sizes.select("session_key"), "session_key", "left_semi")


def dwell_used(df: DataFrame) -> Column:
    """Q3: capped dwell, else raw, else 0; never negative."""
    for c in ("engagement_time_msec_capped", "engagement_time_msec"):
        if c in df.columns:
            return F.greatest(F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0)), F.lit(0.0))
    return F.lit(0.0)


def classify(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Q3-Q5: dwell_used, is_qualified, qualify_reason, quality_weight."""
    e = events.withColumn("dwell_used", dwell_used(events))
    name, d = F.trim("event_name"), F.col("dwell_used")
    strong, noise = name.isin(*STRONG), name.isin(*NOISE, *NAVIGATION)
    soft = ~noise & ~strong
    least = {"permissive": 500, "balanced": 500, "strict": 2000}[policy.name]
    ok = (strong & (d >= 500) if policy.name == "strict" else strong) | (soft & (d >= least))
    why = F.when(strong, "strong").when(name.isin(*NOISE), "scroll_noise").when(noise, "nav_noise")
    if policy.name == "balanced":
        why = why.when(d >= policy.min_dwell, "dwell").when(d >= 500, "dwell_soft")
    elif policy.name == "permissive":
        why = why.when(d >= 500, "dwell_soft")
    else:
        why = why.when(d >= 2000, "dwell")
    weight = F.coalesce(F.col("interaction_weight").cast("double"), F.lit(0.5)) if "interaction_weight" in e.columns else F.lit(1.0)
    kinds = F.lit(1.0)
    for k, v in TYPE_WEIGHTS.items():
        kinds = F.when(name == k, v).otherwise(kinds)
    short = F.when(name.isin(*WEAK) & (d < 1000), F.least(F.greatest((d - 500) / 500, F.lit(0.2)), F.lit(1.0))).otherwise(1.0)
    ok = F.coalesce(ok, F.lit(False))
    return e.withColumn("is_qualified", ok).withColumn("qualify_reason", why.otherwise("reject")).withColumn("quality_weight", F.when(ok, weight * kinds * short).otherwise(0.0))


def enrich(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Q1-Q5 in order."""
    clean = events.where(~from_recommender(events, policy.markers))
    return classify(drop_long_sessions(clean, policy.max_session_events), policy)


def effective_scores(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Q6: strongest event of each user, place and session, summed over sessions."""
    best = events.where("user_key is not null and location_id is not null").groupBy("user_key", "location_id", "session_key").agg(F.max("quality_weight").alias("_m"))
    out = best.groupBy("user_key", "location_id").agg(F.sum("_m").alias("effective_score"), F.count_if(F.col("_m") > 0).alias("n_qualified_events"))
    return out.withColumn("is_qualified", F.col("effective_score") >= policy.min_pair_score)


def qualify_interactions(interactions: DataFrame, scores: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Q7: scores joined on; without a score, dwell or total score decide; profile_weight."""
    own = scores.select("user_key", "location_id", "effective_score")
    j = interactions.join(own, ["user_key", "location_id"], "left")
    total = F.coalesce(F.col("total_interaction_score"), F.lit(0.0))
    fallback = (F.coalesce(F.col("total_location_engagement_msec_capped"), F.lit(0.0)) >= 1000) | (total >= 3.0)
    ok = F.when(F.col("effective_score").isNotNull(), F.col("effective_score") >= policy.min_pair_score).otherwise(fallback)
    weight = F.coalesce("effective_score", "total_interaction_score", F.lit(1.0))
    return j.withColumn("is_qualified", ok).withColumn("profile_weight", F.when(F.col("is_qualified"), weight).otherwise(0.0))


def returning_users(qualified: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Q8: users with enough qualified places."""
    return qualified.where("is_qualified").groupBy("user_key").agg(F.count("*").alias("n_places")).where(F.col("n_places") >= policy.min_places_returning)


def modelling_events(events: DataFrame) -> DataFrame:
    """Q9"""
    return events.where("quality_weight > 0")


def cap_daily(events: DataFrame, most: int = 10) -> DataFrame:
    """Q10 (off by default): at most so many events of a user at a place each day, earliest first."""
    w = W.partitionBy("user_key", "location_id", F.to_date("event_time")).orderBy("event_time", "event_id")
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def report(raw: DataFrame, events: DataFrame, scores: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Q11: (metric, value) rows."""
    raw_n = raw.agg(F.count("*").cast("double").alias("raw_events"))
    e = events.agg(F.count("*").cast("double").alias("kept_events"), F.count_if("is_qualified").cast("double").alias("qualified_events"))
    users = scores.groupBy("user_key").agg(F.count_if("is_qualified").alias("n"))
    u = users.agg(F.count_if(F.col("n") >= policy.min_places_returning).cast("double").alias("returning_users"), F.count_if(F.col("n") == 0).cast("double").alias("users_without"))
    wide = raw_n.crossJoin(e).crossJoin(u).withColumn("qualified_percent", F.col("qualified_events") / F.col("raw_events") * 100)
    flat = wide.unpivot([], wide.columns, "metric", "value")
    reasons = events.groupBy(F.concat(F.lit("reason:"), F.col("qualify_reason")).alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return flat.unionByName(reasons)


def compare_policies(events: DataFrame, names: tuple[str, ...] = ("permissive", "balanced", "strict")) -> DataFrame:
    """Q12: qualified events, pairs and users under each policy, and pairs whose flag differs from balanced."""
    per = {n: effective_scores(enrich(events, Policy(n)), Policy(n)) for n in names}
    base = per["balanced"].select("user_key", "location_id", F.col("is_qualified").alias("_base"))
    out = None
    for n, s in per.items():
        j = s.join(base, ["user_key", "location_id"], "full_outer")
        own, ref = F.coalesce("is_qualified", F.lit(False)), F.coalesce("_base", F.lit(False))
        row = j.agg(F.count_if(own).alias("qualified_pairs"), F.count_distinct(F.when(own, F.col("user_key"))).alias("qualified_users"), F.count_if(own != ref).alias("flag_flips"), F.round(F.count_if(own & ref) / F.greatest(F.count_if(own | ref), F.lit(1)), 6).alias("pair_jaccard")).withColumn("policy", F.lit(n))
        out = row if out is None else out.unionByName(row)
    return out


def top_overlap(events: DataFrame, names: tuple[str, ...] = ("permissive", "strict"), n: int = 10) -> DataFrame:
    """Q12: for each user and policy, how many of the top n places it shares with balanced, and their Jaccard."""

    def tops(name: str) -> DataFrame:
        s = effective_scores(enrich(events, Policy(name)), Policy(name)).where("is_qualified")
        w = W.partitionBy("user_key").orderBy(F.desc(F.round("effective_score", 6)), "location_id")
        return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("user_key", "location_id")

    base, out = tops("balanced").withColumn("_a", F.lit(1)), None
    for name in names:
        j = base.join(tops(name).withColumn("_b", F.lit(1)), ["user_key", "location_id"], "full_outer")
        both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        row = j.groupBy("user_key").agg(both.alias("overlap"), (both / F.count("*")).alias("jaccard")).withColumn("policy", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def graph_sizes(events: DataFrame, names: tuple[str, ...] = ("permissive", "balanced", "strict")) -> DataFrame:
    """Q12: places and edges of the session graph under each policy."""
    from .graphs import jaccard_pairs

    out = None
    for name in names:
        edges = jaccard_pairs(modelling_events(enrich(events, Policy(name))), "session_key", "location_id")
        row = edges.agg(F.count_distinct("src").alias("places"), F.count("*").alias("edges")).withColumn("policy", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def qualified_rows(interactions: DataFrame, applied: bool = True) -> DataFrame:
    """Q13: rows for profiles, seeds and exclusion; all of them where no policy was applied."""
    return interactions.where("is_qualified") if applied else interactions
