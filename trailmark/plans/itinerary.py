"""Day plans for all requests: candidates, schedule, entity resolution, assembly, legs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import canonical_name
from ..operators import geo

EXCLUDED = ("hotels", "neighborhood organizations", "favorites")  # fixed values
MIN_STOPS, MAX_STOPS, EXTRA_STOPS, MAX_OUTSIDE, NEAR_KM, FAR_KM = 3, 5, 4, 2, 4.0, 7.0


def candidate_pool(ranked: DataFrame, pool_ids: DataFrame | None = None) -> DataFrame:
    """Places for the planner: given ids in given order (if there are any), one of each name, no excluded category, at most max(18, 10 * days).

    ranked: (request_id, place, location_id, location_name, primary_category, trip_days, ...); pool_ids: (request_id, pool_ids array). Adds rank.
    """
    r = ranked.withColumn("_at", F.col("place").cast("long"))
    if pool_ids is not None:
        at = pool_ids.select("request_id", F.posexplode("pool_ids").alias("_p", "location_id")).groupBy("request_id", "location_id").agg(F.min("_p").alias("_p"))
        asked = pool_ids.where(F.size("pool_ids") > 0).select("request_id", F.lit(True).alias("_asked"))
        r = r.join(asked, "request_id", "left").join(at, ["request_id", "location_id"], "left").where("_asked is null or _p is not null").withColumn("_at", F.coalesce(F.col("_p").cast("long"), F.col("_at")))
    key = canonical_name(F.col("location_name"))
    name = W.partitionBy("request_id", F.when(key == "", F.concat(F.lit("#"), "location_id")).otherwise(key)).orderBy("_at")
    one = r.withColumn("_n", F.row_number().over(name)).where("_n = 1").where(~F.lower(F.trim(F.coalesce("primary_category", F.lit("")))).isin(*EXCLUDED))
    out = one.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy("_at")))
    return out.where(F.col("rank") <= F.greatest(F.lit(18), 10 * F.col("trip_days"))).select(*[c for c in ranked.columns if c != "rank"], "rank")


def split_days(pool: DataFrame) -> DataFrame:
    """Day and pos of each candidate: per day clamp(ceil(pool / days), 3, 5), days up to the trip's length."""
    n = F.count("*").over(W.partitionBy("request_id"))
    per = F.least(F.greatest(F.ceil(n / F.col("trip_days")), F.lit(MIN_STOPS)), F.lit(MAX_STOPS))
    out = pool.withColumn("_per", per).withColumn("day", (F.floor((F.col("rank") - 1) / F.col("_per")) + 1).cast("int")).withColumn("pos", ((F.col("rank") - 1) % F.col("_per") + 1).cast("int"))
    return out.where(F.col("day") <= F.col("trip_days")).drop("_per")


def schedule_slots(days: DataFrame) -> DataFrame:
    """A slot for each stop, first suitable one not yet used that day, else the next of the day's cycle; a fold over at most five stops."""
    stop = F.struct("pos", "location_id", geo.suitable_slots(F.concat(F.array("primary_category"), F.col("categories"))).alias("slots"))
    rows = days.groupBy("request_id", "day").agg(F.array_sort(F.collect_list(stop)).alias("p"))
    cycle = F.array(*map(F.lit, ("morning", "lunch", "afternoon", "dinner", "evening", "drinks", "breakfast")))
    zero = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<pos:int,location_id:string,slot:string>>").alias("o"))

    def step(acc, x):
        slot = F.coalesce(F.try_element_at(F.array_except(x["slots"], acc["used"]), F.lit(1)), F.try_element_at(F.array_except(cycle, acc["used"]), F.lit(1)), F.lit("afternoon"))
        return F.struct(F.concat(acc["used"], F.array(slot)).alias("used"), F.concat(acc["o"], F.array(F.struct(x["pos"].alias("pos"), x["location_id"].alias("location_id"), slot.alias("slot")))).alias("o"))

    return rows.select("request_id", "day", F.explode(F.aggregate("p", zero, step)["o"]).alias("o")).select("request_id", "day", "o.pos", "o.location_id", "o.slot")


def resolve_stops(proposed: DataFrame, pool: DataFrame, places: DataFrame) -> DataFrame:
    """resolved_id of proposed(request_id, location_id, location_name, ...): id in the request's pool, id in the catalogue, then canonical name (least id)."""
    key = canonical_name(F.col("location_name"))
    by_name = places.withColumn("_k", key).where("_k != ''").groupBy("_k").agg(F.min("location_id").alias("_name_id"))
    own = pool.select("request_id", "location_id", F.col("location_id").alias("_pool_id")).distinct()
    known = places.select("location_id", F.col("location_id").alias("_any_id"))
    j = proposed.withColumn("_k", key).join(own, ["request_id", "location_id"], "left").join(known, "location_id", "left").join(by_name, "_k", "left")
    return j.withColumn("resolved_id", F.coalesce("_pool_id", "_any_id", "_name_id")).withColumn("how", F.when(F.col("_pool_id").isNotNull(), "pool").when(F.col("_any_id").isNotNull(), "catalogue").when(F.col("_name_id").isNotNull(), "name").otherwise("outside")).drop("_k", "_pool_id", "_any_id", "_name_id")


def _km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = np.radians(a), np.radians(b)
    h = np.sin((q[..., 0] - p[..., 0]) / 2) ** 2 + np.cos(p[..., 0]) * np.cos(q[..., 0]) * np.sin((q[..., 1] - p[..., 1]) / 2) ** 2
    return 2 * geo.RADIUS_KM * np.arcsin(np.sqrt(np.minimum(h, 1)))


def assemble(proposed: DataFrame, pool: DataFrame) -> DataFrame:
    """A request's whole plan in one pass over its bounded rows (each step depends on the one before).

    proposed: (request_id, trip_days, day, pos, location_id, location_name, slot, slots, lat, lon, source), source is pool,
    catalogue or outside; pool: (request_id, trip_days, rank, location_id, location_name, slots, lat, lon). At most five stops a day, no id or name
    twice in a plan, two outside stops a day, compact days, three stops where the pool allows, extra days of four up to the trip's length; nearest-neighbour order of
    morning and afternoon stops. Returns (request_id, day, pos, location_id, location_name, slot, source, lat, lon).
    """
    name = canonical_name(F.col("location_name"))
    cols = ["request_id", "trip_days", "kind", "day", "pos", "location_id", "location_name", "nkey", "slot", "slots", "lat", "lon", "source"]
    a = proposed.withColumn("kind", F.lit(0)).withColumn("nkey", name).select(cols)
    b = pool.withColumn("kind", F.lit(1)).withColumn("nkey", name).withColumn("day", F.lit(0)).withColumn("pos", F.col("rank").cast("int")).withColumn("slot", F.lit("")).withColumn("source", F.lit("pool")).select(cols)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["kind", "day", "pos", "location_id"], kind="stable").to_dict("records")
        wanted = int(pdf["trip_days"].iloc[0])
        extras = [r for r in rows if r["kind"] == 1]
        used: set[str] = set()
        at = lambda r: np.array([r["lat"], r["lon"]], float)
        placed = lambda r: r["lat"] is not None and r["lat"] == r["lat"]

        def medoid(stops):
            own = [s for s in stops if placed(s)]
            if not own:
                return None
            c = np.array([at(s) for s in own])
            return c[int(np.argmin(np.round(_km(c[:, None], c[None]).sum(1), 9)))]

        def fresh(r):
            return r["location_id"] not in used and (not r["nkey"] or r["nkey"] not in used)

        def take(stops, r, slot):
            stops.append({**r, "slot": slot})
            used.update(x for x in (r["location_id"], r["nkey"]) if x)

        def fill(stops, target):
            while len(stops) < target:
                taken, centre = {s["slot"] for s in stops}, medoid(stops)
                open_ = [(r, next(iter(s for s in r["slots"] if s not in taken), None)) for r in extras if fresh(r)]
                open_ = [(r, s, float(_km(centre, at(r))) if centre is not None and placed(r) else None) for r, s in open_ if s]
                if not open_:
                    return
                near = [x for x in open_ if x[2] is not None and x[2] <= NEAR_KM]
                some = [x for x in open_ if x[2] is not None]
                r, s, _ = near[0] if near else min(some, key=lambda x: round(x[2], 9)) if some else open_[0]
                take(stops, r, s)

        def route(stops):
            stops.sort(key=lambda s: geo.DAY.index(s["slot"]) if s["slot"] in geo.DAY else 99)
            idx = [i for i, s in enumerate(stops) if s["slot"] in ("morning", "afternoon")]
            own = [stops[i] for i in idx]
            left = [s for s in own if placed(s)]
            if len(left) >= 2:
                order = [left.pop(0)]
                while left:
                    d = [round(float(_km(at(order[-1]), at(s))), 9) for s in left]
                    order.append(left.pop(int(np.argmin(d))))
                for i, s in zip(idx, order + [s for s in own if not placed(s)], strict=True):
                    stops[i] = s
            return stops

        days = []
        for day in sorted({r["day"] for r in rows if r["kind"] == 0}):
            if len(days) >= wanted:
                break
            stops, outside = [], 0
            for r in (r for r in rows if r["kind"] == 0 and r["day"] == day):
                if len(stops) >= MAX_STOPS:
                    break
                far_in = r["source"] == "outside"
                if not fresh(r) or far_in and (outside >= MAX_OUTSIDE or not r["nkey"]):
                    continue
                outside += far_in
                take(stops, r, r["slot"])
            centre = medoid(stops)
            if sum(map(placed, stops)) >= 3:
                core = [s for s in stops if not placed(s) or float(_km(centre, at(s))) <= FAR_KM]
                if sum(map(placed, core)) >= 2:
                    stops = core
            fill(stops, MIN_STOPS)
            if stops:
                days.append(route(stops))
        while len(days) < wanted:
            stops = []
            fill(stops, EXTRA_STOPS)
            if len(stops) < 2:
                break
            days.append(route(stops))
        out = [(s["request_id"], d, p, s["location_id"], s["location_name"], s["slot"], s["source"], s["lat"], s["lon"]) for d, stops in enumerate(days, 1) for p, s in enumerate(stops, 1)]
        return pd.DataFrame(out, columns=["request_id", "day", "pos", "location_id", "location_name", "slot", "source", "lat", "lon"])

    return a.unionByName(b).groupBy("request_id").applyInPandas(plan, "request_id string, day int, pos int, location_id string, location_name string, slot string, source string, lat double, lon double")


STOP = "array<struct<pos:int,location_id:string,nkey:string,slot:string,lat:double,lon:double,source:string>>"


def _stop(x, slot, pos, source: str):
    return F.struct(pos.cast("int").alias("pos"), x["location_id"].alias("location_id"), x["nkey"].alias("nkey"), slot.alias("slot"), x["lat"].alias("lat"), x["lon"].alias("lon"), F.lit(source).alias("source"))


def _let(value, f):
    """f(value), where value is worked out once however often f uses it (an expression within lambdas is not shared by Spark)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _centre(stops):
    """The first located stop with the least sum of distances to the day's located ones, or null."""
    far = lambda own, x: F.round(F.aggregate(own, F.lit(0.0), lambda a, y: a + geo.haversine(x["lat"], x["lon"], y["lat"], y["lon"])), 9)
    return _let(F.filter(stops, lambda x: x["lat"].isNotNull() & x["lon"].isNotNull()), lambda own: F.array_min(F.transform(own, lambda x, i: F.struct(F.when(F.size(own) > 1, far(own, x)).otherwise(0.0).alias("s"), i.alias("i"), x["lat"].alias("lat"), x["lon"].alias("lon")))))


def backfill(days: DataFrame, pool: DataFrame, target: int = MIN_STOPS) -> DataFrame:
    """Thin days filled up to `target` stops from the request's pool, day after day; (request_id, day, pos, location_id, slot, source).

    days: (request_id, day, pos, location_id, location_name, slot, lat, lon), pool: (request_id, rank, location_id, location_name, slots, lat, lon), both bounded for a
    request. A pick is new to the plan by id and name and has a suitable slot that the day has not used. Of these the first by one
    key is taken: within NEAR_KM of the day's medoid by rank, then the nearest, then those without a distance by rank; the medoid moves with each pick.
    A fold over the request's days that stays in the JVM; what a pick uses several times (centre, slots, distance) is worked out once (`_let`). A day that nothing fits stays short; a request without a pool keeps its days.
    """
    key = canonical_name(F.col("location_name"))
    own = days.groupBy("request_id", "day").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "location_id", key.alias("nkey"), "slot", "lat", "lon", F.lit("plan").alias("source")))).cast(STOP).alias("stops"))
    own = own.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("day", "stops"))).alias("days"))
    picks = pool.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "location_id", key.alias("nkey"), "slots", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")))).alias("picks"))
    rows = own.join(picks, "request_id", "left")
    names = lambda stops: F.filter(F.concat(F.transform(stops, lambda x: x["location_id"]), F.transform(stops, lambda x: x["nkey"])), lambda x: x != "")

    def pick(stops, used):
        order = lambda x, slot, km, tier: F.struct(tier.alias("tier"), F.when(tier == 1, km).otherwise(0.0).alias("km"), x["rank"].alias("rank"), _stop(x, slot, F.size(stops) + 1, "backfill").alias("stop"))
        tiered = lambda x, slot, km: _let(F.when(km <= NEAR_KM, 0).when(km.isNotNull(), 1).otherwise(2), lambda tier: order(x, slot, km, tier))
        measured = lambda x, slot, centre: _let(F.round(geo.haversine(centre["lat"], centre["lon"], x["lat"], x["lon"]), 9), lambda km: tiered(x, slot, km))
        offer = lambda x, slots, centre: _let(F.try_element_at(F.array_except(x["slots"], slots), F.lit(1)), lambda slot: F.when(slot.isNotNull(), measured(x, slot, centre)))
        fresh = F.filter(F.col("picks"), lambda x: ~F.array_contains(used, x["location_id"]) & ~F.array_contains(used, x["nkey"]))
        offers = lambda slots, centre: F.array_min(F.transform(fresh, lambda x: offer(x, slots, centre)))  # noqa: E731  (no slot: null, which array_min leaves out)
        return _let(F.transform(stops, lambda x: x["slot"]), lambda slots: _let(_centre(stops), lambda centre: offers(slots, centre)))

    def fill(acc, _):
        taken = lambda x: F.array(x["stop"]).cast(STOP)
        grown = lambda x: F.struct(F.concat(acc["stops"], taken(x)).alias("stops"), F.concat(acc["used"], names(taken(x))).alias("used"))
        return F.when(F.size(acc["stops"]) >= target, acc).otherwise(_let(pick(acc["stops"], acc["used"]), lambda x: F.when(x.isNull(), acc).otherwise(grown(x))))

    def day_after_day(acc, day):
        start = F.struct(day["stops"].alias("stops"), acc["used"].alias("used"))
        filled = F.aggregate(F.sequence(F.lit(1), F.lit(target)), start, fill)
        return _let(filled, lambda done: F.struct(F.concat(acc["days"], F.array(F.struct(day["day"].alias("day"), done["stops"].alias("stops")))).alias("days"), done["used"].alias("used")))

    given = names(F.flatten(F.transform("days", lambda d: d["stops"])))
    zero = F.struct(F.array().cast(f"array<struct<day:int,stops:{STOP}>>").alias("days"), given.alias("used"))
    out = rows.withColumn("picks", F.coalesce("picks", F.array().cast(picks.schema["picks"].dataType)))
    out = out.select("request_id", F.explode(F.aggregate("days", zero, day_after_day)["days"]).alias("d")).select("request_id", "d.day", F.explode("d.stops").alias("x"))
    return out.select("request_id", "day", "x.pos", "x.location_id", "x.slot", "x.source")


def route_order(stops: DataFrame) -> DataFrame:
    """stops(request_id, day, pos, location_id, slot, lat, lon) in the day's order of slots, morning and afternoon ones from the first on to the nearest next; pos anew from 1.

    Stops of other slots keep their places; unlocated ones come after the located; ties by the order before. One fold over a day's few stops, in the JVM.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, geo.DAY)), F.col("slot")), F.lit(0)), F.lit(99)).cast("int")
    one = F.struct(place.alias("s"), F.col("pos").cast("int").alias("pos"), "location_id", "slot", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    rows = stops.groupBy("request_id", "day").agg(F.array_sort(F.collect_list(one)).alias("p"))
    kind = "array<struct<s:int,pos:int,location_id:string,slot:string,lat:double,lon:double>>"
    visit = lambda x: x["slot"].isin("morning", "afternoon")
    located = lambda x: x["lat"].isNotNull() & x["lon"].isNotNull()
    rows = rows.withColumn("own", F.filter("p", visit).cast(kind)).withColumn("some", F.filter("own", located))

    def nearest_next(acc, _):
        last = F.element_at(acc["order"], -1)
        best = F.array_min(F.transform(acc["left"], lambda x, i: F.struct(F.round(geo.haversine(last["lat"], last["lon"], x["lat"], x["lon"]), 9).alias("d"), i.alias("i"), x.alias("x"))))
        return F.struct(F.concat(acc["order"], F.array(best["x"]).cast(kind)).alias("order"), F.filter(acc["left"], lambda x, i: i != best["i"]).alias("left"))

    n = F.size("some")
    steps = F.when(n >= 2, F.sequence(F.lit(2), F.greatest(n, F.lit(2)))).otherwise(F.array().cast("array<int>"))
    walked = F.aggregate(steps, F.struct(F.slice("some", 1, 1).alias("order"), F.slice("some", F.lit(2), F.greatest(n, F.lit(1))).alias("left")), nearest_next)["order"]
    rows = rows.withColumn("walk", F.when(n >= 2, F.concat(walked, F.filter("own", lambda x: ~located(x)))).otherwise(F.col("own")))
    ordered = F.transform("p", lambda x, i: F.when(visit(x), F.get("walk", F.size(F.filter(F.slice("p", F.lit(1), i), visit)))).otherwise(x))
    out = rows.select("request_id", "day", F.posexplode(ordered).alias("i", "x"))
    return out.select("request_id", "day", (F.col("i") + 1).alias("pos"), "x.location_id", "x.slot")


def stop_links(stops: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Link of each stop: its page, else its official site, else none."""
    j = stops.join(pages.select("location_id", "page_url"), "location_id", "left").join(sites.select("location_id", "official_site"), "location_id", "left")
    return j.withColumn("link", F.coalesce("page_url", "official_site")).withColumn("link_type", F.when(F.col("page_url").isNotNull(), "page").when(F.col("official_site").isNotNull(), "official").otherwise("none")).drop("page_url", "official_site")
