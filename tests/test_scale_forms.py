"""Forms that split hot keys, against plain ones; streams that evict, refuse late rows and go on from a checkpoint."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import geo, graphs, media, nearest, rank, reports, users
from trailmark.plans import itinerary
from trailmark.streaming import streams


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_nearest_users_match_all_pairs(spark, monkeypatch):
    r = random.Random(1)
    vec = {}
    for u in range(300):
        w = {f"c{r.randint(0, 3) + 4 * (u % 5)}": r.choice([1.0, 2.0, 3.0]) for _ in range(3)}  # five kinds of users that share nothing
        n = sum(x * x for x in w.values()) ** 0.5
        vec[f"u{u:03d}"] = {c: x / n for c, x in w.items()}
    df = spark.createDataFrame([(u, c, x) for u, w in vec.items() for c, x in w.items()] + [(None, "c0", 1.0), ("u000", None, 1.0)], "user_key string, category string, w double")
    q = df.where("user_key is not null").select(F.col("user_key").alias("query"), F.col("user_key").alias("self"), "category", "w")
    got = rows(nearest.nearest_users(q, df, 4, block=20, chunk=30), "query", "rank", "user_key")
    want = []
    for a, x in vec.items():
        sims = sorted((-round(s, 9), b) for b, y in vec.items() if b != a and (s := sum(w * y.get(c, 0) for c, w in x.items())) > 0)
        want += [(a, k, b) for k, (_, b) in enumerate(sims[:4], 1)]
    assert got == sorted(want)
    users_ = nearest.in_blocks(nearest.packed(df.where("user_key is not null and category is not null"), "user_key"), F.col("user_key"), 20, "block")
    chunks = nearest.in_blocks(nearest.packed(q.where("category is not null"), "query", "self"), F.col("query"), 30, "chunk")
    met = nearest.block_bounds(chunks, users_).count()
    assert met < 0.5 * users_.select("block").distinct().count() * chunks.select("chunk").distinct().count()  # others share no category
    assert nearest.nearest_users(q.where("query = 'x'"), df).count() == 0


def test_a_chunk_leaves_out_blocks_below_its_floor():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("category", pa.string()), ("w", pa.float64())]))
    t = pa.table({"key": ["q"], "self": pa.array([None], pa.string()), "floor": [0.9], "v": pa.array([[{"category": "a", "w": 1.0}]], kind)})
    c = nearest.Chunk(t, 1)
    c.meet(np.array([0]), np.array(["a"], object), np.array([0.5]), ["far"])
    assert c.found == [[]]
    c.meet(np.array([0]), np.array(["a"], object), np.array([0.95]), ["near"])
    assert c.best().to_pylist() == [{"query": "q", "user_key": "near", "sim": 0.95}]


def test_large_baskets_are_split(spark):
    r = random.Random(2)
    baskets = [("big", i) for i in range(120)] + [(f"b{k}", r.randint(0, 150)) for k in range(80) for _ in range(4)]
    df = spark.createDataFrame(baskets, "b string, i int")
    assert rows(graphs.jaccard_pairs(df, "b", "i", block=10)) == rows(graphs.jaccard_pairs(df, "b", "i", block=1000))


@pytest.mark.parametrize("values", [[5], [1, 2], [7, 7, 7, 7], [3, 1, 2], [-9, 4, 10**15, 4], list(range(0, 1000, 7)) + [3] * 50, [0, 10**12]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(3)
    assert graphs.exact_median(df, "v", buckets=8) == graphs.exact_median(df, "v") == statistics.median(values)
    assert graphs.exact_median(df.where("v is null"), "v") is None


def test_keep_first_is_the_fold_in_order(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(4)]
    items, want = [], []
    for g in range(3):
        kept = []
        for pos in range(60):
            h = r.choice(base)
            for _ in range(r.randint(0, 9)):
                h ^= 1 << r.randint(0, 63)
            items.append((g, pos, h - (1 << 64) if h >= 1 << 63 else h))
            if all((h ^ k).bit_count() > 6 for k in kept):
                kept.append(h)
                want.append((g, pos))
    df = spark.createDataFrame(items, "group int, pos long, h long").repartition(4)
    assert rows(media.keep_first_similar(df), "group", "pos") == sorted(want)
    assert media.keep_first_similar(df.where("pos < 0")).count() == 0


def test_interest_lists_equal_the_cross_join(spark):
    r = random.Random(4)
    places = spark.createDataFrame([(f"L{k}", [f"C{r.randint(0, 5)}", f"c{r.randint(0, 5)}"], float(r.randint(0, 9))) for k in range(60)], "location_id string, categories array<string>, popularity_raw double")
    req = spark.createDataFrame([("a", []), ("b", ["c1", "C1"]), ("c", ["C2", "c3"]), ("d", ["none"])], "request_id string, interests array<string>")
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    every = req.crossJoin(places).where((F.size("interests") == 0) | F.arrays_overlap(low("interests"), low("categories"))).collect()
    want = []
    for q in "abc":
        own = sorted((-x["popularity_raw"], x["location_id"]) for x in every if x["request_id"] == q)[:5]
        want += [(q, i, k) for k, (_, i) in enumerate(own, 1)]
    assert rows(rank.fallback_seeds(req, places), "request_id", "location_id", "rank") == sorted(want)
    random_ones = reports.baseline_random(req, places, 5)
    assert {x["request_id"] for x in random_ones.collect()} == set("abc") and rows(random_ones) == rows(reports.baseline_random(req, places.repartition(3), 5))


def test_new_visitors_get_their_archetypes_seeds(spark):
    labels = spark.createDataFrame([("u1", 0), ("u2", 1)], "user_key string, cluster int")
    centres = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0)], "cluster int, category string, w double")
    inter = spark.createDataFrame([("u1", "x", 2.0), ("u2", "y", 1.0)], "user_key string, location_id string, s double")
    req = spark.createDataFrame([("r1", ["a", "a"]), ("r2", ["b", "zz"]), ("r3", ["zz"]), ("r4", [])], "request_id string, interests array<string>")
    assert rows(users.archetype_seeds(req, labels, centres, inter, "s"), "request_id", "location_id") == [("r1", "x"), ("r2", "y")]


def test_least_id_names_the_coordinate(spark):
    p = spark.createDataFrame([("p", "Inn", None, None)], "location_id string, location_name string, lat double, lon double")
    g = spark.createDataFrame([("b", " inn", 2.0, 2.0), ("a", "INN", None, None), ("c", "inn", 3.0, 3.0)], "location_id string, location_name string, lat double, lon double")
    assert rows(geo.attach_geo(p, g, (0.0, 0.0)), "lat", "lon", "geo_source") == [(2.0, 2.0, "index")]


STOPS = "request_id string, day int, pos int, location_id string, location_name string, slot string, lat double, lon double"
POOL = "request_id string, rank int, location_id string, location_name string, slots array<string>, lat double, lon double"


def test_backfill_takes_near_ones_by_rank_then_the_nearest(spark):
    days = spark.createDataFrame([("r", 1, 1, "s", "Start", "morning", 41.90, -87.60), ("r", 2, 1, "t", "Other", "morning", 41.90, -87.60), ("q", 1, 1, "z", "Alone", "lunch", None, None)], STOPS)
    pool = spark.createDataFrame([("r", 1, "far", "Far", ["lunch"], 42.50, -87.60), ("r", 2, "near2", "start", ["lunch"], 41.90, -87.60), ("r", 3, "near3", "Near", ["morning", "afternoon"], 41.91, -87.60), ("r", 4, "near4", "Nearer", ["afternoon", "evening"], 41.90, -87.60)], POOL)
    got = rows(itinerary.backfill(days, pool), "request_id", "day", "pos", "location_id", "slot")
    assert got == [("q", 1, 1, "z", "lunch"), ("r", 1, 1, "s", "morning"), ("r", 1, 2, "near3", "afternoon"), ("r", 1, 3, "near4", "evening"), ("r", 2, 1, "t", "morning"), ("r", 2, 2, "far", "lunch")]


def test_route_goes_to_the_nearest_next(spark):
    s = spark.createDataFrame([("r", 1, 1, "a", "", "afternoon", 0.0, 3.0), ("r", 1, 2, "b", "", "morning", 0.0, 0.0), ("r", 1, 3, "c", "", "lunch", 0.0, 9.0), ("r", 1, 4, "d", "", "morning", 0.0, 5.0), ("r", 1, 5, "e", "", "morning", None, None)], STOPS)
    assert [x["location_id"] for x in itinerary.route_order(s).orderBy("pos").collect()] == ["b", "a", "d", "c", "e"]


def test_stream_refuses_late_rows_and_lets_state_go(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    at = lambda *t: spark.createDataFrame([("u", x) for x in t], "user_key string, x string").select("user_key", F.to_timestamp("x").alias("event_time"))
    schema = at("2024-01-01 10:00:00").schema

    def run(*times):
        at(*times).coalesce(1).write.mode("append").parquet(src)
        s = streams.gap_sessions(spark.readStream.schema(schema).parquet(src))
        q = s.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        states = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
        return rows(spark.read.schema(s.schema).parquet(out), "events"), states[-1]["numRowsTotal"], sum(p["numRowsDroppedByWatermark"] for p in states)

    assert run("2024-01-01 10:00:00", "2024-01-01 10:10:00") == ([], 1, 0)
    told, left, late = run("2024-01-01 14:00:00")  # goes on from the checkpoint: the first session closes and leaves the state
    assert (told, left, late) == ([(2,)], 1, 0)
    told, left, late = run("2024-01-01 10:20:00", "2024-01-01 14:05:00")  # the first is too late
    assert (told, left, late) == ([(2,)], 1, 1)


def test_the_end_of_a_stream_closes_open_sessions(spark, tmp_path):
    src, marks, out, state = (str(tmp_path / x) for x in ("in", "marks", "out", "state"))
    times = [("u", "2024-01-01 10:00:00"), ("u", "2024-01-01 10:10:00"), ("u", "2024-01-01 14:00:00"), ("v", "2024-01-01 13:59:00"), (None, "2024-01-01 14:00:00")]
    df = spark.createDataFrame(times, "user_key string, x string").select("user_key", F.to_timestamp("x").alias("event_time"))
    df.write.parquet(src)
    s = streams.run_to_end(spark.readStream.schema(df.schema).parquet(src), streams.gap_sessions, "event_time", marks, out, state)
    assert sorted((x["user_key"] or "", x["events"]) for x in s.collect()) == [("", 1), ("u", 1), ("u", 2), ("v", 1)]


def test_hourly_clicks_and_sessions_are_whole(spark):
    from trailmark.queries import QUERIES
    from trailmark.sources import fixtures as fx

    d = "/root/testdata/sf0.001"
    assert QUERIES["t03_gap_sessions"](spark, d).agg(F.sum("events")).first()[0] == fx.events(spark, d).count()
    known = fx.clicks(spark, d).where("event_id % 7 != 0 and ts is not null").withColumn("rank", F.col("event_id") % 9).join(fx.locations(spark, d), "location_id", "left_semi")
    assert QUERIES["t01_hourly_clicks"](spark, d).agg(F.sum("clicks")).first()[0] == known.select("ts", "location_id", "rank").distinct().count()


def test_updates_keep_the_last_word(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    one = lambda t, w: spark.createDataFrame([("L", t, w)], "location_id string, x string, quality_weight double").select("location_id", F.to_timestamp("x").alias("event_time"), "quality_weight")
    for t, w in (("2024-01-04 01:00:00", 1.0), ("2024-01-05 01:00:00", 2.0), ("2024-02-05 01:00:00", 4.0), ("2024-01-05 02:00:00", 8.0)):
        df = one(t, w)
        df.coalesce(1).write.mode("append").parquet(src)
        streams.run_updates(streams.window_trending(spark.readStream.schema(df.schema).parquet(src)), out, state)
    assert rows(streams.newest(spark, out, ["start", "location_id"]), "events", "weight") == [(1, 4.0), (2, 3.0)]  # the last row came a month late


def test_title_match_meets_all_pairs_that_match(spark):
    r = random.Random(7)
    words = ["park", "the", "inn", "art", "museum", "of", "old", "town", "xa", "b", "grand", "hotel", "pier"]
    text = lambda most: r.choice([" ", "-", ", "]).join(r.choice(words) for _ in range(r.randint(1, most)))
    names = [(k, text(5)) for k in range(150)] + [(900, "a-b"), (901, "b"), (902, ""), (903, None), (904, "the of"), (905, "Town Inn")]
    titles = [(k, text(8)) for k in range(200)] + [(900, "xa-b"), (901, "Oldtown innkeeper town"), (902, None), (903, "park"), (904, "town inn")]
    toks = lambda s: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split()} - set(media.STOP_WORDS)
    want = []
    for i, n in names:
        for j, t in titles:
            if not n or not t:
                continue
            size, hits = len(toks(n)), len(toks(n) & toks(t))
            need = size if size <= 2 else max(2, (3 * size + 4) // 5)
            if hits and (n.lower() in t.lower() or t.lower() in n.lower() or hits >= need):
                want.append((i, j, hits))
    n, t = spark.createDataFrame(names, "name_id int, name string"), spark.createDataFrame(titles, "title_id int, title string")
    for q in (3, 5):
        assert rows(media.title_match(n, t, q)) == sorted(want)
    assert media.title_match(n.limit(0), t).count() == 0 and media.title_match(n, t.limit(0)).count() == 0


def test_addresses_by_points_then_form(spark):
    df = spark.createDataFrame([(1, "See 5 S. Main Ave, or 12 Lake\nStreet. Tickets at 9 Way"), (2, None), (3, "no number here"), (4, "1 Oak Rd 1 Oak Rd; 40 pier springfield, il 60601")], "k int, t string")
    assert rows(media.addresses(df, "t", "k", "Springfield", "IL", "Main"), "k", "r", "address") == [
        (1, 1, "5 S. Main Ave, Springfield, IL"), (1, 2, "12 Lake Street, Springfield, IL"), (4, 1, "1 Oak Rd, Springfield, IL"), (4, 2, "40 pier springfield, il 60601")]


def test_refined_clusters_are_steps_of_nearest_and_mean(spark):
    r = np.random.default_rng(3)
    x = r.random((80, 3)) * (r.random((80, 3)) < 0.7)
    x = x[x.sum(1) > 0]
    df = spark.createDataFrame([(f"u{i:03d}", f"c{j}", float(x[i, j])) for i in range(len(x)) for j in range(3) if x[i, j]], "user_key string, category string, w double")
    c = np.array([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0], [9.0, 9.0, 9.0]])  # the last one is nearest to nobody
    start = spark.createDataFrame([(k, f"c{j}", float(c[k, j])) for k in range(4) for j in range(3) if c[k, j]], "cluster int, category string, w double")
    labels, centres = users.refined_clusters(df, start, 4)
    near = lambda: ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    for _ in range(4):
        own = near()
        c = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(4)])
    assert rows(labels) == [(f"u{i:03d}", int(k)) for i, k in enumerate(near())]
    got = {(a, b): w for a, b, w in rows(centres)}
    assert all(abs(got.get((k, f"c{j}"), 0.0) - c[k, j]) < 1e-9 for k in range(4) for j in range(3)) and got[(3, "c0")] == 9.0


def broadcasts(df):
    """Number of broadcast joins in a plan as it stands before it runs."""
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_near_pairs_are_not_broadcast(spark):
    df = spark.range(50).select(F.col("id"), F.xxhash64("id").alias("h"), (F.col("id") % 3).alias("group"), F.col("id").alias("pos"))
    assert broadcasts(media.near_pairs(df)) == 0
    assert broadcasts(media.keep_first_similar(df.drop("id"))) == 0


def test_titles_are_not_broadcast(spark):
    n = spark.range(20).select(F.col("id").alias("name_id"), F.concat(F.lit("old inn "), F.col("id").cast("string")).alias("name"))
    t = spark.range(50).select(F.col("id").alias("title_id"), F.concat(F.lit("the old inn "), F.col("id").cast("string")).alias("title"))
    assert broadcasts(media.title_match(n, t)) == 0


def test_backfill_works_out_distances_once(spark):
    days, pool = spark.createDataFrame([("r", 1, 1, "s", "Start", "morning", 41.90, -87.60)], STOPS), spark.createDataFrame([("r", 1, "x", "X", ["lunch"], 41.9, -87.6)], POOL)
    plan = itinerary.backfill(days, pool)._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("ASIN(") <= 2  # one for the medoid, one for a candidate


def test_products_are_dealt_to_all_cores(spark):
    p = spark.createDataFrame([(f"L{k}", 41.6 + k / 100, -87.9 + k * 7 % 20 / 100) for k in range(60)], "location_id string, lat double, lon double").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    km = geo.haversine_pairs(p.where("location_id = 'L0'"), p)
    assert km.rdd.getNumPartitions() >= cores
    plain = p.alias("x").where("x.location_id = 'L0'").join(p.alias("y"), F.col("x.location_id") != F.col("y.location_id"))
    want = plain.select("x.location_id", F.col("y.location_id").alias("b"), geo.haversine(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon")).alias("km"))
    got = {(a, b): x for a, b, x in rows(km)}
    assert len(got) == 59 and all(abs(got[(a, b)] - x) < 1e-9 for a, b, x in rows(want))
    every = rank.expand_candidates(p.select(F.col("location_id").alias("request_id")), p.select("location_id"))
    assert every.rdd.getNumPartitions() >= cores and every.distinct().count() == 3600


def test_six_places_by_arithmetic(spark):
    from trailmark.plans.base import r6, six

    df = spark.createDataFrame([(x,) for x in (0.0, -0.0, None, 1 / 128, -1 / 128, 1 / 3, -2 / 3, 12345.6789015, 20015.1, 4e-7, -4e-7)], "x double")
    assert [repr(x["a"]) for x in df.select(six("x").alias("a")).collect()] == [repr(x["a"]) for x in df.select(r6("x").alias("a")).collect()]


def test_candidates_and_scores_by_classes_equal_all_pairs(spark):
    r = random.Random(11)
    cats = [["a", "x"], ["b", "x"], ["A", "y"], ["c"]]
    kind = [r.randint(0, 3) for _ in range(700)]  # classes of more than one block of places remain to be met
    places = spark.createDataFrame([(f"L{k}", cats[c], r.random(), r.choice([None, 0.3]), int(r.random() < 0.2), 0, r.choice([None, 0.5])) for k, c in enumerate(kind)], "location_id string, categories array<string>, popularity double, trending double, is_hot_spot_location int, is_favorite_location int, feedback_penalty double")
    req = [(f"r{k}", f"u{k}", k % 3 == 0, r.choice([[], ["A"], ["a", "c"]]), r.choice([[], ["Y"]])) for k in range(9)]
    requests = spark.createDataFrame(req, "request_id string, user_key string, is_returning boolean, interests array<string>, avoid_categories array<string>")
    gone = spark.createDataFrame([(f"r{k}", f"L{i}") for k in (0, 3) for i in r.sample(range(700), 50)], "request_id string, location_id string")
    every = requests.crossJoin(places)
    want = every.where(rank.category_mask())
    assert rows(rank.candidates(requests, places)) == rows(want, "request_id", "location_id")
    assert rows(rank.candidates(requests, places, gone)) == rows(want.join(gone, ["request_id", "location_id"], "left_anti"), "request_id", "location_id")
    s = {(k, c): r.random() for k in range(9) for c in range(3)}  # the fourth class shares nothing with anybody
    sim = spark.createDataFrame([(f"r{k}", f"L{i}", s[k, kind[i]]) for k in range(9) for i in range(700) if kind[i] < 3], "request_id string, location_id string, sim double")
    terms = spark.createDataFrame([(f"r{k}", f"L{i}", r.random(), r.choice([None, 0.4]), r.random()) for k in range(9) for i in r.sample(range(90), 40)], "request_id string, location_id string, item_collab double, session double, user_collab double")
    all_ = every.join(sim, ["request_id", "location_id"], "left").join(terms, ["request_id", "location_id"], "left").withColumn("user_collab", F.when(F.col("is_returning"), F.col("user_collab")))
    first = rank.classes(places).select(F.col("class").alias("location_id"))
    got = rank.score_all(requests, places, sim.join(first, "location_id", "left_semi"), terms)
    cols = ["request_id", "location_id", *[F.coalesce(c, F.lit(0.0)) for c in rank.TERMS], "final_score"]
    assert rows(got, *cols) == rows(all_.withColumn("final_score", rank.final_score()), *cols)


def test_joint_edge_scores(spark):
    """several kinds of edges met at once give what each gives by itself, sent to all tasks or dealt by place."""
    from trailmark.operators import graphs

    seeds = spark.createDataFrame([(f"r{k % 7}", f"L{k % 5}") for k in range(40)] + [("r9", "none")], "request_id string, location_id string")
    places = spark.createDataFrame([(f"L{k}",) for k in range(5)], "location_id string")
    edges = lambda m: spark.createDataFrame([(f"L{a}", f"L{b}", 1 / (1 + a + m * b)) for a in range(5) for b in range(8) if a != b and (a + b) % m == 0], "src string, dst string, weight double")
    kinds = {"one": edges(1), "two": edges(2), "three": edges(3)}
    rows = lambda df: sorted((r.request_id, r.location_id, round(r.score, 12)) for r in df.collect())
    for few in (1_000_000, 0):
        got = graphs.joint_edge_scores(seeds, kinds, places, few)
        assert all(rows(got[k]) == rows(graphs.edge_scores(seeds, e, places)) for k, e in kinds.items())
        assert len(rows(got["two"])) > 10


def test_events_are_parsed_once_by_all_cores(spark):
    """the ranking chain reads stored events in many parts, not the one part of a small file."""
    from trailmark.plans import base
    from trailmark.sources.shared import tasks

    before = base._STEPS
    base._STEPS = {}
    try:
        e = base.parsed_events(spark, "/root/testdata/sf0.001")
        assert e is base.parsed_events(spark, "/root/testdata/sf0.001")
        assert len(e.inputFiles()) == tasks(spark)
        assert e.exceptAll(base.fx.events(spark, "/root/testdata/sf0.001")).count() == 0
    finally:
        base._STEPS = before


def product_tables(spark):
    r = random.Random(12)
    kind = [r.randint(0, 2) for _ in range(60)]
    places = spark.createDataFrame([(f"L{k}", [["a"], ["b"], ["a", "b"]][c], r.random(), r.choice([None, 1 / 3]), int(r.random() < 0.2), 0, r.choice([None, 0.5])) for k, c in enumerate(kind)], "location_id string, categories array<string>, popularity double, trending double, is_hot_spot_location int, is_favorite_location int, feedback_penalty double")
    requests = spark.createDataFrame([(f"r{k}", f"u{k}", k % 2 == 0, [], []) for k in range(6)], "request_id string, user_key string, is_returning boolean, interests array<string>, avoid_categories array<string>")
    first = [x["class"] for x in rank.classes(places).orderBy("class").collect()]
    sim = spark.createDataFrame([(f"r{k}", c, r.random()) for k in range(6) for c in first[1:]], "request_id string, location_id string, sim double")
    terms = spark.createDataFrame([(f"r{k}", f"L{i}", r.choice([None, 2 / 3]), r.random(), r.random()) for k in range(6) for i in range(60) if r.random() < 0.5], "request_id string, location_id string, item_collab double, session double, user_collab double")
    return requests, places, sim, terms


def test_the_product_is_not_dealt_by_request_and_place(spark):
    """rows with terms of their own, or seen, come to a request and a class; before, the product was shuffled for every place that anybody has terms with."""
    requests, places, sim, terms = product_tables(spark)
    for df in (rank.score_all(requests, places, sim, terms), rank.candidates(requests, places, terms.select("request_id", "location_id"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "request_id" in plan and not any("hashpartitioning(request_id" in x and "location_id" in x for x in plan.splitlines())


def test_scored_pairs_are_streamed_and_shown_rounded(spark, monkeypatch):
    """r03 and e10 don't store the product, and a term's rounded value is what rounding each row gives."""
    from trailmark.plans import base, ranking, reporting  # noqa: F401

    tables, stored, folder = product_tables(spark), [], base.working_folder
    monkeypatch.setattr(ranking, "scoring", lambda *_: tables)
    monkeypatch.setattr(ranking, "seeds_of_requests", lambda *_: None)
    monkeypatch.setattr(base, "working_folder", lambda s, name: stored.append(name) or folder(s, name))
    got = base.QUERIES["r03_final_score"](spark, "")
    plain = rank.score_all(*tables).select("request_id", "location_id", *[base.six(F.coalesce(c, F.lit(0.0))).alias(c) for c in (*rank.TERMS, "final_score")])
    assert got.columns == plain.columns and rows(got) == rows(plain) and got.count() == 360
    assert base.QUERIES["e10_ablations"](spark, "").count() == 360 and not stored


def test_distances_are_worked_out_once_for_two_coordinates(spark):
    """places of the same coordinates share one distance, in lists of bounded length; every pair is told, of two places in one spot too."""
    from trailmark.plans.base import six

    at = [(f"L{k}", *([(41.7, -87.6)] * 300 + [(41.8, -87.7), (None, -87.7), (41.9, -87.9)])[k % 303]) for k in range(606)]
    p = spark.createDataFrame(at, "location_id string, lat double, lon double")
    lists = geo.by_coordinates(p, "x").select(F.size("x").alias("n")).collect()
    assert sum(x.n for x in lists) == 606 and len(lists) < 30 and max(x.n for x in lists) < 200
    few = p.where("location_id in ('L0', 'L300', 'L301', 'L302')")
    plain = few.alias("x").join(p.alias("y"), F.col("x.location_id") != F.col("y.location_id"))
    km = six(geo.haversine(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon")))
    want = plain.select("x.location_id", F.col("y.location_id").alias("b"), km.alias("km"))
    tell = lambda df: sorted((r[0], r[1], -1.0 if r[2] is None else r[2]) for r in df.collect())
    got = geo.haversine_pairs(few, p, lambda x: [six(x).alias("km")])
    assert got.columns == ["a", "b", "km"] and tell(got) == tell(want) and len(tell(got)) == 4 * 605


def test_a_place_meets_requests_one_after_another(spark):
    """within a stored part a place's rows stand together; before, every request had the whole catalogue in turn."""
    req, places = spark.range(70).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id")), spark.range(90).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("location_id"))
    every = rank.expand_candidates(req, places, 2)
    parts = [[r.location_id for r in p] for p in every.rdd.glom().collect()]
    runs = sum(sum(a != b for a, b in zip(p, p[1:])) + 1 for p in parts if p)
    assert runs == 2 * 90 and every.distinct().count() == every.count() == 70 * 90


def test_users_are_sent_to_as_many_chunks_as_there_are_tasks(spark, monkeypatch):
    """chunks grow with the queries (before, 512 queries each, so users were sent queries / 512 times), up to what a task may hold; the result doesn't depend on it."""
    r, made, keep = random.Random(13), {}, nearest.written
    rows_ = []
    for u in range(240):
        w = [5.0, float(r.randint(0, 2)), float(r.randint(0, 2))]  # one leading category and many ties
        n = sum(x * x for x in w) ** 0.5
        rows_ += [(f"u{u:03d}", f"c{k}", x / n) for k, x in enumerate(w) if x]
    df = spark.createDataFrame(rows_, "user_key string, category string, w double")
    q = df.select(F.col("user_key").alias("query"), F.col("user_key").alias("self"), "category", "w").unionByName(spark.createDataFrame([("x", None, "nobody's", 1.0), ("x", None, "c2", 1.0)], "query string, self string, category string, w double"))
    want = rows(nearest.nearest_users(q, df, 3, block=9, chunk=10), "query", "rank", "user_key")
    assert len(want) == 3 * 241
    monkeypatch.setattr(nearest, "written", lambda x, name: made.setdefault(name, keep(x, name)))
    monkeypatch.setattr(nearest, "tasks", lambda _: 2)
    monkeypatch.setattr(nearest, "SLICE", 7)
    for least, most, n in ((1, 10_000, 2), (1, 40, 6), (500, 10_000, 1)):
        made.clear()
        monkeypatch.setattr(nearest, "LEAST", least)
        monkeypatch.setattr(nearest, "MOST", most)
        assert rows(nearest.nearest_users(q, df, 3), "query", "rank", "user_key") == want
        chunks = made["query_chunks"].where("self is not null").select("chunk").distinct().count()
        assert n <= chunks <= n + 1


def test_list_rows_of_a_pool_are_shuffled_less_often(spark):
    """Rows taken from the lists bear their terms already; where no table is small enough to be sent to all, they were shuffled nine times up to the pool."""
    requests, places, sim, terms = product_tables(spark)
    seen = spark.createDataFrame([("u1", "L1")], "user_key string, location_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rank.best_places(requests.withColumn("top_k", F.lit(2)), places, sim, terms, seen)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda x: len(x) - len(x.lstrip(" :|+-*("))
    at = next(i for i, x in enumerate(plan) if "class_heads" in x and "static" in x and "FileScan" in x)
    level, n = depth(plan[at]), 0
    for x in reversed(plan[:at]):
        if depth(x) < level:
            level, n = depth(x), n + ("Exchange hash" in x)
    assert 0 < n <= 7
