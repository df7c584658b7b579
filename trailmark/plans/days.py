"""Queries: geography and day plans (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo
from ..sources import fixtures as fx
from ..sources import sql as q
from . import itinerary as it
from .base import query, r6, six, step
from .ranking import DEDUP, FULL, slate

KM = "2*6371.0088*asin(sqrt(least(1.0, pow(sin((radians({b}.lat)-radians({a}.lat))/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2))))"
MODE = "CASE WHEN km<=1.2 THEN 'walk' WHEN km<=8 THEN 'transit' WHEN km IS NOT NULL THEN 'drive' ELSE 'unknown' END"
MINUTES = "CAST(greatest(1,round_even(km*1.3/(CASE WHEN km<=1.2 THEN 5.0::DOUBLE WHEN km<=8 THEN 18.0::DOUBLE ELSE 25.0::DOUBLE END)*60,0)) AS INTEGER)"
PAIRS = f"pairs AS (SELECT a.location_id AS a, b.location_id AS b, {KM.format(a='a', b='b')} AS km FROM fx_locations a JOIN fx_locations b ON a.location_id<>b.location_id WHERE CAST(substr(a.location_id,2) AS BIGINT)%50=0 AND a.lat IS NOT NULL AND b.lat IS NOT NULL)"


def pairs(spark, d, told):
    """From every place whose number is divisible by 50 (the query set) to all others: what is told of their distance."""
    places = fx.locations(spark, d).where("lat is not null").select("location_id", "lat", "lon")
    return geo.haversine_pairs(places.where(F.substring("location_id", 2, 18).cast("long") % 50 == 0), places, told)


@query("g01_haversine", f"WITH {q.LOCATIONS}, {PAIRS} SELECT a, b, round(km,6) AS km FROM pairs")
def g01(spark, d):
    return pairs(spark, d, lambda km: [six(km).alias("km")])


@query("g02_travel", f"WITH {q.LOCATIONS}, {PAIRS} SELECT a, b, {MODE} AS mode, {MINUTES} AS minutes FROM pairs")
def g02(spark, d):
    return pairs(spark, d, lambda km: [geo.travel_mode(km).alias("mode"), geo.travel_minutes(km).alias("minutes")])


@query("g03_coordinate_index", f"WITH {q.LOCATIONS} SELECT location_id, round(lat,6) AS lat, round(lon,6) AS lon FROM fx_locations WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def g03(spark, d):
    return geo.coordinate_index(fx.locations(spark, d)).select("location_id", r6("lat").alias("lat"), r6("lon").alias("lon"))


def attached(spark, d):
    """Places by name; many bear the same one."""
    places = fx.locations(spark, d).withColumn("location_name", F.concat(F.lit(" "), F.upper("location_name"), F.lit(" ")))
    index = fx.locations(spark, d).where("lat is not null").select("location_id", F.lower("location_name").alias("location_name"), "lat", "lon")
    return geo.attach_geo(places, index, (41.88, -87.63))


ATT = "gix AS (SELECT lower(location_name) AS k, min_by(lat, location_id) AS lat, min_by(lon, location_id) AS lon FROM fx_locations WHERE lat IS NOT NULL GROUP BY 1), att AS (SELECT location_id, coalesce(g.lat,41.88) AS lat, coalesce(g.lon,-87.63) AS lon, CASE WHEN g.lat IS NULL THEN 'fallback' ELSE 'index' END AS geo_source FROM fx_locations l LEFT JOIN gix g ON g.k=lower(l.location_name))"


@query("g04_attach_geo", f"WITH {q.LOCATIONS}, {ATT} SELECT location_id, round(lat,6) AS lat, round(lon,6) AS lon, geo_source FROM att")
def g04(spark, d):
    return attached(spark, d).select("location_id", r6("lat").alias("lat"), r6("lon").alias("lon"), "geo_source")


@query("g05_needs_enrichment", f"WITH {q.LOCATIONS}, {ATT} SELECT location_id FROM att WHERE geo_source='fallback' OR (abs(lat-41.88)<0.1 AND abs(lon-(-87.63))<0.1)")
def g05(spark, d):
    return geo.needs_enrichment(attached(spark, d), (41.88, -87.63), 0.1).select("location_id")


CATS = "[['Restaurants','Bars'],['Bars'],['Museums ','Zoo'],['hot spots','Bars'],['Zoo']][p_partkey%5+1]"
SLOTS = "[['breakfast','lunch','dinner','drinks','evening'],['drinks','evening'],['morning','afternoon'],['morning','afternoon','evening','drinks'],['morning','afternoon']][p_partkey%5+1]"


def kinds():
    k = F.col("p_partkey") % 5
    arr = lambda *x: F.array(*map(F.lit, x))
    return F.when(k == 0, arr("Restaurants", "Bars")).when(k == 1, arr("Bars")).when(k == 2, arr("Museums ", "Zoo")).when(k == 3, arr("hot spots", "Bars")).otherwise(arr("Zoo"))


@query("g06_suitable_slots", f"SELECT p_partkey, array_to_string({SLOTS},'|') AS slots FROM part")
def g06(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", F.array_join(geo.suitable_slots(kinds()), "|").alias("slots"))


@query("g07_correct_slot", f"WITH t AS (SELECT p_partkey, p_partkey%5 AS c, ['Lunch','breakfast','drinks','noon','evening','',' dinner '][p_size%7+1] AS s0 FROM part), u AS (SELECT *, lower(trim(CASE WHEN s0='' THEN 'afternoon' ELSE s0 END)) AS s, c=0 AS food, c IN (0,1,3) AS drink FROM t) SELECT p_partkey, CASE WHEN s IN ('breakfast','lunch','dinner') AND NOT food THEN CASE WHEN drink THEN 'drinks' WHEN s='breakfast' THEN 'morning' ELSE 'afternoon' END WHEN s='drinks' AND NOT drink AND NOT food THEN 'evening' WHEN s NOT IN ('breakfast','morning','lunch','afternoon','dinner','evening','drinks') THEN 'afternoon' ELSE s END AS slot FROM u")
def g07(spark, d):
    s = F.element_at(F.array(*map(F.lit, ("Lunch", "breakfast", "drinks", "noon", "evening", "", " dinner "))), (F.col("p_size") % 7 + 1).cast("int"))
    return fx.table(spark, d, "part").select("p_partkey", geo.correct_slot(s, kinds()).alias("slot"))


@step
def pool(spark, d):
    return it.candidate_pool(slate(spark, d).select("request_id", "place", "location_id", "location_name", "primary_category", "categories", "trip_days", "lat", "lon"))


@query("g08_area_groups")
def g08(spark, d):
    return geo.area_groups(pool(spark, d))


GPOOL = f"{FULL}, {DEDUP}, gp AS (SELECT request_id, location_id, trip_days, place, place AS rank FROM slate WHERE place<=greatest(18,10*trip_days))"


@query("g09_candidate_pool", f"{GPOOL} SELECT request_id, location_id, rank FROM gp")
def g09(spark, d):
    return pool(spark, d).select("request_id", "location_id", F.col("rank").cast("long").alias("rank"))


@query("g09_given_pool", "WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), p AS (SELECT o_custkey, max(o_orderkey) AS a, min(o_orderkey) AS b FROM orders GROUP BY 1) SELECT 'c'||t.o_custkey AS request_id, 'o'||o_orderkey AS location_id, CASE WHEN a<>b AND o_orderkey=b THEN 2 ELSE 1 END AS rank FROM t JOIN p USING (o_custkey) WHERE o_orderkey IN (a,b)")
def g09_given(spark, d):
    from pyspark.sql import Window as W

    o = fx.table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("request_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("location_id"), F.col("o_orderkey").alias("k"))
    ranked = o.withColumn("place", F.row_number().over(W.partitionBy("request_id").orderBy("k"))).withColumn("location_name", F.col("location_id")).withColumn("primary_category", F.lit("x")).withColumn("trip_days", F.lit(1))
    ids = o.groupBy("request_id").agg(F.array(F.max_by("location_id", "k"), F.min_by("location_id", "k")).alias("pool_ids"))
    return it.candidate_pool(ranked, ids).select("request_id", "location_id", F.col("rank").cast("long").alias("rank"))


DAYS = "gd AS (SELECT request_id, location_id, CAST(floor((rank-1)/per)+1 AS INTEGER) AS day, CAST((rank-1)%per+1 AS INTEGER) AS pos FROM (SELECT *, CAST(least(greatest(ceil(count(*) OVER (PARTITION BY request_id)/trip_days),3),5) AS BIGINT) AS per FROM gp) WHERE floor((rank-1)/per)+1<=trip_days)"


@step
def days(spark, d):
    return it.split_days(pool(spark, d))


@query("g10_split_days", f"{GPOOL}, {DAYS} SELECT request_id, location_id, day, pos FROM gd")
def g10(spark, d):
    return days(spark, d).select("request_id", "location_id", "day", "pos")


@query("g10_slots")
def g10_slots(spark, d):
    return it.schedule_slots(days(spark, d))


def proposed(spark, d):
    """A stand-in for proposed stops: events as (request, day, pos) with an id, a name or neither."""
    e = fx.events(spark, d).where("user_key is not null").join(fx.requests(spark, d).where("user_key is not null").select("request_id", "user_key", "trip_days"), "user_key")
    names = fx.locations(spark, d).select("location_id", F.col("location_name").alias("_n"))
    k = F.col("event_id") % 4
    j = e.join(names, "location_id", "left")
    return j.select("request_id", "trip_days", "event_id", (k + 1).cast("int").alias("day"), F.when(k == 1, "").when(k == 3, "X").otherwise(F.col("location_id")).alias("location_id"), F.when(k == 1, F.upper(F.col("_n"))).otherwise(F.concat(F.lit("Spot "), F.col("location_id"))).alias("location_name"))


@query("g11_resolve_stops", f"{GPOOL}, prn AS (SELECT r.request_id, r.trip_days, e.event_id, CASE e.event_id%4 WHEN 1 THEN '' WHEN 3 THEN 'X' ELSE e.location_id END AS lid, CASE WHEN e.event_id%4=1 THEN upper(l.location_name) ELSE 'Spot '||e.location_id END AS nm FROM fx_events e JOIN req r USING (user_key) LEFT JOIN fx_locations l ON l.location_id=e.location_id), byn AS (SELECT trim(regexp_replace(lower(location_name),'[^a-z0-9]+',' ','g')) AS k, min(location_id) AS id FROM fx_locations GROUP BY 1) SELECT p.request_id, event_id, coalesce(g.location_id, a.location_id, b.id) AS resolved_id, CASE WHEN g.location_id IS NOT NULL THEN 'pool' WHEN a.location_id IS NOT NULL THEN 'catalogue' WHEN b.id IS NOT NULL THEN 'name' ELSE 'outside' END AS how FROM prn p LEFT JOIN gp g ON g.request_id=p.request_id AND g.location_id=lid LEFT JOIN fx_locations a ON a.location_id=lid LEFT JOIN byn b ON b.k=trim(regexp_replace(lower(nm),'[^a-z0-9]+',' ','g'))")
def g11(spark, d):
    return it.resolve_stops(proposed(spark, d), pool(spark, d), fx.locations(spark, d)).select("request_id", "event_id", "resolved_id", "how")


@query("g12_plan")
def g12(spark, d):
    """G12, G14, G15 over the deterministic schedule."""
    p = pool(spark, d)
    slots = geo.suitable_slots(F.concat(F.array("primary_category"), F.col("categories")))
    stops = days(spark, d).withColumn("slots", slots).withColumn("slot", F.element_at("slots", 1)).withColumn("source", F.lit("pool"))
    return it.assemble(stops, p.withColumn("slots", slots))


BASKET = "bd AS (SELECT 'b'||l_orderkey AS request_id, 1 AS day, l_linenumber AS pos, l_linenumber||'-'||l_partkey AS location_id, 41.64+CAST(l_partkey*37%440 AS DOUBLE)/1000 AS lat, CASE WHEN l_partkey%23<>0 THEN -87.95+CAST(l_partkey*61%430 AS DOUBLE)/1000 END AS lon FROM lineitem)"


def stops(spark, d):
    li, k = fx.table(spark, d, "lineitem"), F.col("l_partkey")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select(F.concat(F.lit("b"), F.col("l_orderkey").cast("string")).alias("request_id"), F.lit(1).alias("day"), F.col("l_linenumber").alias("pos"), F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), k.cast("string")).alias("location_id"), (F.lit(41.64) + (k * 37 % 440) / 1000.0).alias("lat"), F.when(k % 23 != 0, F.lit(-87.95) + (k * 61 % 430) / 1000.0).alias("lon"))


ONE = BASKET.replace("FROM lineitem)", "FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL))")


@query("g13_day_core", f"WITH {ONE}, ok AS (SELECT * FROM bd WHERE lat IS NOT NULL AND lon IS NOT NULL), pr AS (SELECT a.request_id, a.pos AS ap, b.pos AS bp, {KM.format(a='a', b='b')} AS d FROM ok a JOIN ok b ON a.request_id=b.request_id), sm AS (SELECT request_id, ap, sum(d) AS s, count(*) AS n, count_if(d<=7) AS near FROM pr GROUP BY ALL), md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(s,6), ap) AS r FROM sm) WHERE r=1 AND n>=3 AND near>=2), cut AS (SELECT pr.request_id, bp FROM pr JOIN md ON md.request_id=pr.request_id AND md.ap=pr.ap WHERE d>7) SELECT request_id, pos FROM bd ANTI JOIN cut ON cut.request_id=bd.request_id AND cut.bp=bd.pos")
def g13(spark, d):
    return geo.day_core(stops(spark, d)).select("request_id", "pos")


PART_SLOTS = SLOTS.replace("p_partkey", "CAST(split_part(location_id,'-',2) AS BIGINT)")
TIER = "CASE WHEN km<=4 THEN 0 WHEN km IS NOT NULL THEN 1 ELSE 2 END"
FILL = f"""sl AS (SELECT *, {PART_SLOTS} AS slots FROM bd), a0 AS (SELECT request_id, location_id, slots[1] AS slot, lat, lon FROM sl WHERE pos=1),
e1 AS (SELECT b.*, list_filter(b.slots, lambda x: x<>a.slot)[1] AS slot, round({KM.format(a='a', b='b')},9) AS km FROM sl b JOIN a0 a USING (request_id) WHERE b.pos>1),
a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {TIER}, CASE WHEN km>4 THEN km ELSE 0 END, pos) AS r FROM e1 WHERE slot IS NOT NULL) WHERE r=1),
m1 AS (SELECT request_id, p.location_id AS taken, a.slot AS s0, p.slot AS s1, CASE WHEN a.lat IS NOT NULL AND a.lon IS NOT NULL THEN a.lat ELSE p.lat END AS lat, CASE WHEN a.lat IS NOT NULL AND a.lon IS NOT NULL THEN a.lon ELSE p.lon END AS lon FROM a0 a JOIN a1 p USING (request_id)),
e2 AS (SELECT b.*, list_filter(b.slots, lambda x: x<>a.s0 AND x<>a.s1)[1] AS slot, round({KM.format(a='a', b='b')},9) AS km FROM sl b JOIN m1 a USING (request_id) WHERE b.pos>1 AND b.location_id<>a.taken),
a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {TIER}, CASE WHEN km>4 THEN km ELSE 0 END, pos) AS r FROM e2 WHERE slot IS NOT NULL) WHERE r=1)"""


def slotted(spark, d):
    """The basket stops with the slots that suit their part."""
    k = F.split_part("location_id", F.lit("-"), F.lit(2)).cast("long")
    return stops(spark, d).withColumn("p_partkey", k).withColumn("slots", geo.suitable_slots(kinds())).withColumn("location_name", F.col("location_id"))


@query("g14_backfill", f"WITH {ONE}, {FILL} SELECT request_id, 1 AS pos, location_id, slot, 'plan' AS source FROM a0 UNION ALL SELECT request_id, 2, location_id, slot, 'backfill' FROM a1 UNION ALL SELECT request_id, 3, location_id, slot, 'backfill' FROM a2")
def g14(spark, d):
    """Each basket's first line is a day of one stop, its other lines are the pool."""
    s = slotted(spark, d)
    thin = s.where("pos = 1").withColumn("slot", F.element_at("slots", 1))
    return it.backfill(thin, s.where("pos > 1").withColumn("rank", F.col("pos"))).drop("day")


ROUTE = f"""st AS (SELECT *, ['morning','afternoon','lunch','morning','afternoon','evening','morning'][(pos-1)%7+1] AS slot FROM bd),
sq AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY list_position(['breakfast','morning','lunch','afternoon','dinner','evening','drinks'], slot), pos) AS i, slot IN ('morning','afternoon') AS own, lat IS NOT NULL AND lon IS NOT NULL AS ok FROM st),
pl AS (SELECT *, count(*) FILTER (own AND ok) OVER (PARTITION BY request_id) AS n, row_number() OVER (PARTITION BY request_id, own ORDER BY i) AS w, row_number() OVER (PARTITION BY request_id, own, ok ORDER BY i) AS v FROM sq),
walk AS (SELECT request_id, i, lat, lon, [i] AS seen, 1 AS k FROM pl WHERE own AND ok AND v=1 AND n>=2 UNION ALL SELECT * FROM (SELECT a.request_id, b.i, b.lat, b.lon, list_append(a.seen, b.i) AS seen, a.k+1 AS k FROM walk a JOIN pl b ON b.request_id=a.request_id AND b.own AND b.ok AND NOT list_contains(a.seen, b.i) QUALIFY row_number() OVER (PARTITION BY a.request_id ORDER BY round({KM.format(a='a', b='b')},9), b.i)=1)),
sn AS (SELECT pl.*, CASE WHEN n<2 THEN w WHEN ok THEN walk.k ELSE n+v END AS nth FROM pl LEFT JOIN walk ON own AND walk.request_id=pl.request_id AND walk.i=pl.i)"""


@query("g15_route_order", f"WITH RECURSIVE {ONE}, {ROUTE} SELECT a.request_id, CAST(b.i AS INTEGER) AS pos, a.location_id, a.slot FROM sn a JOIN sn b ON a.own AND b.own AND b.request_id=a.request_id AND b.w=a.nth UNION ALL SELECT request_id, CAST(i AS INTEGER), location_id, slot FROM sn WHERE NOT own")
def g15(spark, d):
    slot = F.element_at(F.array(*map(F.lit, ("morning", "afternoon", "lunch", "morning", "afternoon", "evening", "morning"))), ((F.col("pos") - 1) % 7 + 1).cast("int"))
    return it.route_order(stops(spark, d).withColumn("slot", slot)).drop("day")


@query("g16_legs", f"WITH {ONE}, nx AS (SELECT *, lead(location_id) OVER w AS to_id, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM bd WINDOW w AS (PARTITION BY request_id ORDER BY pos)), kk AS (SELECT a.request_id, a.pos, a.location_id AS from_id, a.to_id, {KM.format(a='a', b='b')} AS km FROM nx a, LATERAL (SELECT a.lat2 AS lat, a.lon2 AS lon) b WHERE a.to_id IS NOT NULL) SELECT request_id, pos, from_id, to_id, round(km,2) AS km, {MODE} AS mode, CASE WHEN km IS NULL THEN 1 ELSE {MINUTES} END AS minutes FROM kk")
def g16(spark, d):
    return geo.legs(stops(spark, d)).drop("day")


@query("g17_stop_links", f"WITH {q.LOCATIONS} SELECT location_id, CASE WHEN n%3=0 THEN 'https://map.example/'||location_id WHEN n%2=0 THEN 'https://site.example/'||location_id END AS link, CASE WHEN n%3=0 THEN 'page' WHEN n%2=0 THEN 'official' ELSE 'none' END AS link_type FROM (SELECT location_id, CAST(substr(location_id,2) AS INTEGER) AS n FROM fx_locations)")
def g17(spark, d):
    loc = fx.locations(spark, d).select("location_id", F.substring("location_id", 2, 9).cast("int").alias("n"))
    page = loc.where("n % 3 = 0").select("location_id", F.concat(F.lit("https://map.example/"), "location_id").alias("page_url"))
    site = loc.where("n % 2 = 0").select("location_id", F.concat(F.lit("https://site.example/"), "location_id").alias("official_site"))
    return it.stop_links(loc.select("location_id"), page, site)
