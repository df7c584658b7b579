"""Queries: sources and sinks (S) and streams (T, run over all available input and equal to their batch forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames
from ..sources import fixtures as fx
from ..sources import io
from ..sources import sql as q
from ..sources.shared import working_folder
from ..streaming import streams
from .base import micros, query, r6
from .core import INTER


@query("s01_load_features", f"WITH {q.EVENTS}, {INTER} SELECT user_key, location_id, p_name AS location_name, n FROM inter JOIN part ON location_id='L'||p_partkey")
def s01(spark, d):
    """Features written as CSV and loaded again with their required columns."""
    i = frames.interactions_from_events(fx.events(spark, d)).join(fx.table(spark, d, "part").select(F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("location_id"), F.col("p_name").alias("location_name")), "location_id")
    path = working_folder(spark, "features")
    i.select("user_key", "location_id", "location_name", F.col("total_interactions_with_location").alias("n")).write.option("header", True).csv(path)
    return io.load_features(spark, path).select("user_key", "location_id", "location_name", F.col("n").cast("long").alias("n"))


WAREHOUSE = f"""WITH {q.EVENTS}, {q.LOCATIONS}, {INTER}, ft AS (SELECT i.*, p_name, p_type FROM inter i JOIN part ON location_id='L'||p_partkey),
g AS (SELECT location_id, max(score) AS pop FROM ft GROUP BY 1), sc AS (SELECT location_id, CASE WHEN max(pop) OVER ()-min(pop) OVER ()<1e-9 THEN 0.0 ELSE (pop-min(pop) OVER ())/(max(pop) OVER ()-min(pop) OVER ()) END AS pop FROM g)
SELECT 'interaction' AS frame, user_key||' '||location_id AS key, p_type AS label, round(score,6) AS value, epoch_us(t1) AS at FROM ft
UNION ALL SELECT 'place', l.location_id, l.location_name||' | '||CASE WHEN sc.location_id IS NULL THEN '' ELSE l.primary_category||','||l.brand END||' | '||coalesce(round(lat,3)::VARCHAR,'-'), round(coalesce(pop,0.0),6), CASE WHEN sc.location_id IS NULL THEN 0 ELSE 1 END FROM fx_locations l LEFT JOIN sc USING (location_id)
UNION ALL SELECT 'user', user_key, NULL, max(n)::DOUBLE, epoch_us(max(t1)) FROM ft GROUP BY user_key
UNION ALL SELECT 'event', event_id::VARCHAR, event_name, coalesce(interaction_weight,0.5), epoch_us(event_time) FROM fx_events"""


@query("s01_warehouse", WAREHOUSE)
def s01_warehouse(spark, d):
    """The four files written as CSV and loaded as frames; a row for each row of them."""
    e, loc = fx.events(spark, d), fx.locations(spark, d)
    i = frames.interactions_from_events(e).join(loc.select("location_id", "location_name", "location_category_name", "primary_category"), "location_id")
    n, t0, t1 = "total_interactions_with_location", "first_interaction_time", "last_interaction_time"
    feats = i.select(F.concat(F.lit(" "), "user_key").alias("user_key"), "location_id", "location_name", "location_category_name", "primary_category", n, F.col(n).alias("total_user_interactions"), "total_interaction_score", F.col("total_interaction_score").alias("total_location_score_all_users"), t0, t1, F.col(t0).alias("first_seen_time"), F.col(t1).alias("last_seen_time"))
    path = working_folder(spark, "warehouse")
    for name, df in (("features", feats.unionByName(feats)), ("dim", loc.select("location_id", "location_name")), ("geo", loc.select("location_id", "lat", "lon")), ("events", e)):
        df.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{path}/{name}")
    w = io.load_warehouse(spark, *[f"{path}/{x}" for x in ("features", "dim", "events", "geo")])
    label = F.concat_ws(" | ", "location_name", F.array_join("categories", ","), F.coalesce(F.round("lat", 3).cast("string"), F.lit("-")))
    rows = [w.interactions.select(F.lit("interaction").alias("frame"), F.concat_ws(" ", "user_key", "location_id").alias("key"), F.col("primary_category").alias("label"), r6("total_interaction_score").alias("value"), micros(t1).alias("at"))]
    rows.append(w.locations.select(F.lit("place"), "location_id", label, r6("popularity_norm"), F.col("observed").cast("long")))
    rows.append(w.users.select(F.lit("user"), "user_key", F.lit(None).cast("string"), F.col("total_user_interactions").cast("double"), micros("last_seen_time")))
    rows.append(w.events.select(F.lit("event"), "event_id", "event_name", F.coalesce(F.col("interaction_weight").cast("double"), F.lit(0.5)), micros("event_time")))
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("s02_load_table", "SELECT * FROM nation")
def s02(spark, d):
    return io.load_table(spark, f"{d}/nation.parquet")


@query("s03_frames_from_events", f"WITH {q.EVENTS} SELECT (SELECT count(DISTINCT location_id) FROM fx_events) AS locations, (SELECT count(*) FROM (SELECT DISTINCT user_key, location_id FROM fx_events)) AS interactions, (SELECT count(DISTINCT user_key) FROM fx_events) AS users")
def s03(spark, d):
    e = fx.events(spark, d)
    i = frames.interactions_from_events(e)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(frames.locations_from_events(e), "locations").crossJoin(n(i, "interactions")).crossJoin(n(frames.users_from_interactions(i), "users"))


@query("s04_snapshot", f"WITH {q.EVENTS} SELECT 'events' AS \"table\", count(*) AS rows FROM fx_events UNION ALL SELECT 'interactions', count(*) FROM (SELECT DISTINCT user_key, location_id FROM fx_events)")
def s04(spark, d):
    e = fx.events(spark, d)
    return io.export_snapshot({"events": e, "interactions": frames.interactions_from_events(e)}, working_folder(spark, "snapshot"))


def click_lines(spark, d):
    """The click log as JSON lines, every 7th malformed."""
    c = fx.clicks(spark, d).withColumn("surface", F.lit("top")).withColumn("rank", (F.col("event_id") % 9).cast("int"))
    line = F.to_json(F.struct("ts", "location_id", "surface", "rank"))
    return c.select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value"))


def click_log(spark, d):
    path = working_folder(spark, "clicks")
    click_lines(spark, d).select("value").write.text(path)
    return path


CLK = "clk AS (SELECT event_id, CASE WHEN event_id%3<>0 THEN event_time END AS t, location_id, CAST(event_id%9 AS INTEGER) AS rank FROM fx_events WHERE event_name='map-user-action' AND event_id%7<>0 AND location_id IN (SELECT location_id FROM fx_locations))"


@query("s05_append_clicks", f"WITH {q.EVENTS}, {q.LOCATIONS} SELECT location_id, 2*count(*) AS n FROM fx_events WHERE event_name='map-user-action' AND location_id IN (SELECT location_id FROM fx_locations) GROUP BY 1")
def s05(spark, d):
    path = working_folder(spark, "appended")
    for _ in range(2):
        io.append_clicks(fx.clicks(spark, d).drop("event_id"), path)
    return io.read_clicks(spark, path, fx.locations(spark, d)).groupBy("location_id").agg(F.count("*").alias("n"))


@query("s06_read_clicks", f"WITH {q.EVENTS}, {q.LOCATIONS}, {CLK} SELECT location_id, rank, strftime(t,'%Y-%m-%dT%H:%M:%SZ') AS ts FROM clk")
def s06(spark, d):
    return io.read_clicks(spark, click_log(spark, d), fx.locations(spark, d)).select("location_id", "rank", "ts")


@query("s07_normalise_events", "SELECT event_id, CASE event_id%4 WHEN 0 THEN epoch_us(date_trunc('second',ts)) WHEN 1 THEN epoch_us(ts) ELSE epoch_us(date_trunc('second',ts)) END AS t FROM events WHERE event_id%4<>3")
def s07(spark, d):
    e, k = fx.table(spark, d, "events"), F.col("event_id") % 4
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    raw = e.select("event_id", F.when((k == 0) | (k == 2), text).when(k == 3, "never").alias("event_time"), F.when(k == 1, F.unix_micros(F.col("ts").cast("timestamp"))).alias("event_timestamp"))
    return io.normalise_events(raw).select("event_id", micros("event_time").alias("t"))


def event_stream(spark, d):
    raw = fx.table(spark, d, "events")
    return fx.events_of(spark.readStream.schema(raw.schema).parquet(f"{d}/events.parquet*"))


@query("t01_hourly_clicks", f"WITH {q.EVENTS}, {q.LOCATIONS}, {CLK} SELECT epoch_us(date_trunc('hour',t)) AS hour, location_id, count(*) AS clicks FROM (SELECT DISTINCT date_trunc('second',t) AS t, location_id, rank FROM clk WHERE t IS NOT NULL) GROUP BY 1,2")
def t01(spark, d):
    """All hours: each micro-batch tells those it changes (update mode), the last word on an hour counts; hours that the watermark has passed leave the state."""
    s, path = streams.hourly_clicks(streams.click_stream(spark, click_log(spark, d), fx.locations(spark, d))), working_folder(spark, "hours")
    streams.run_updates(s, path, working_folder(spark, "state"))
    return streams.newest(spark, path, ["hour", "location_id"]).select(micros("hour").alias("hour"), "location_id", "clicks")


def last_version(spark, stream):
    """A stream's complete result over all available input, written version by version."""
    path = working_folder(spark, "versions")

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch:06d}")

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", working_folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(path)
    return every.join(F.broadcast(every.agg(F.max("version").alias("version"))), "version", "left_semi").drop("version")


@query("t02_qualified_stream", f"WITH {q.EVENTS}, dwelt AS (SELECT *, greatest(coalesce(engagement_time_msec_capped,0),0) AS dwell_used FROM fx_events WHERE NOT contains(page_location,'site_recommender')), {q.classified()} SELECT event_id, is_qualified, qualify_reason, round(quality_weight,6) AS quality_weight FROM classed")
def t02(spark, d):
    s = streams.qualified_stream(event_stream(spark, d)).select("event_id", "is_qualified", "qualify_reason", r6("quality_weight").alias("quality_weight"))
    return streams.run_to_table(s, working_folder(spark, "qualified"), working_folder(spark, "state"))


SESSION = "gs AS (SELECT user_key, event_time, CASE WHEN lag(event_time) OVER w IS NULL OR event_time>=lag(event_time) OVER w+INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM fx_events WINDOW w AS (PARTITION BY user_key ORDER BY event_time)), gn AS (SELECT user_key, event_time, sum(fresh) OVER (PARTITION BY user_key ORDER BY event_time) AS n FROM gs)"


@query("t03_gap_sessions", f"WITH {q.EVENTS}, {SESSION} SELECT user_key, epoch_us(min(event_time)) AS t0, epoch_us(max(event_time)+INTERVAL 30 MINUTE) AS t1, count(*) AS events FROM gn GROUP BY user_key, n")
def t03(spark, d):
    """All sessions: those that the watermark has closed on the way, and at the end of the input those still open."""
    s = streams.run_to_end(event_stream(spark, d), streams.gap_sessions, "event_time", working_folder(spark, "marks"), working_folder(spark, "sessions"), working_folder(spark, "state"))
    return s.select("user_key", micros("start").alias("t0"), micros("end").alias("t1"), "events")


@query("t04_running_priors", f"WITH {q.EVENTS} SELECT location_id, count(*) AS interactions, round(sum(coalesce(interaction_weight,0.5)),6) AS score FROM fx_events GROUP BY 1")
def t04(spark, d):
    return last_version(spark, streams.running_priors(event_stream(spark, d))).select("location_id", "interactions", r6("score").alias("score"))


@query("t05_window_trending", f"WITH {q.EVENTS}, dwelt AS (SELECT *, greatest(coalesce(engagement_time_msec_capped,0),0) AS dwell_used FROM fx_events WHERE NOT contains(page_location,'site_recommender')), {q.classified()} SELECT epoch_us(time_bucket(INTERVAL 7 DAY, event_time, TIMESTAMP '1970-01-01')) AS start, location_id, count(*) AS events, round(sum(quality_weight),6) AS weight FROM classed GROUP BY 1,2")
def t05(spark, d):
    s = streams.window_trending(streams.qualified_stream(event_stream(spark, d)), late="3650 days")
    return last_version(spark, s).select(micros("start").alias("start"), "location_id", "events", r6("weight").alias("weight"))


@query("t06_rebuild", f"WITH {q.EVENTS} SELECT user_key, location_id, count(*) AS n FROM fx_events GROUP BY 1,2")
def t06(spark, d):
    path = working_folder(spark, "model")
    streams.rebuild_on_batches(event_stream(spark, d), frames.interactions_from_events, path, working_folder(spark, "state")).awaitTermination()
    return spark.read.parquet(path).groupBy("user_key", "location_id").agg(F.sum("total_interactions_with_location").alias("n"))
