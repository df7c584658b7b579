import pytest
from pyspark.sql import functions as F

from trailmark.operators import graphs, media, rank, reports, users, vectors
from trailmark.plans import itinerary


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_jaccard_by_hand_and_symmetric(spark):
    df = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u1", "b"), ("u2", "a"), ("u2", "c"), ("u3", None)], "u string, i string")
    got = {(a, b): w for a, b, w in rows(graphs.jaccard_pairs(df, "u", "i"), "src", "dst", "weight")}
    assert got == {("a", "b"): 0.5, ("b", "a"): 0.5, ("a", "c"): 0.5, ("c", "a"): 0.5}


def test_transitions_sum_to_one(spark):
    e = spark.createDataFrame([("a", "b", "page_view"), ("a", "c", "scroll"), ("a", "a", "scroll"), (None, "a", "scroll")], "previous_location_id string, location_id string, event_name string")
    cat = spark.createDataFrame([("a",), ("b",), ("c",)], "location_id string")
    got = {(a, b): round(w, 6) for a, b, w in rows(graphs.transitions(e, cat), "src", "dst", "weight")}
    assert got == {("a", "b"): round(1 / 1.3, 6), ("a", "c"): round(0.3 / 1.3, 6)}


def test_seeds_count_twice_and_unmatched_do_not(spark):
    seeds = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "zz")], "request_id string, location_id string")
    edges = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, weight double")
    cat = spark.createDataFrame([("a",), ("b",)], "location_id string")
    assert rows(graphs.edge_scores(seeds, edges, cat), "location_id", "score") == [("b", 0.5)]


def test_tfidf_of_two_places(spark):
    df = spark.createDataFrame([("x", ["A"]), ("y", ["A", "B"])], "location_id string, categories array<string>")
    got = {(i, t): w for i, t, w in rows(vectors.tfidf(df), "location_id", "token", "w")}
    import math

    b = math.log(3 / 2) + 1
    assert got["x", "a"] == pytest.approx(1.0)
    assert got["y", "b"] == pytest.approx(b / math.hypot(1, b))


def test_names_are_shown_once(spark):
    df = spark.createDataFrame([("r", 0, "i0", "G"), ("r", 1, "i1", "G"), ("r", 2, "i2", "C"), ("r", 3, "i3", "S")], "request_id string, pos int, location_id string, location_name string")
    assert [r["pos"] for r in rank.unique_names(df, "pos", F.lit(3)).orderBy("pos").collect()] == [0, 2, 3]


def test_mmr_prefers_other_kinds(spark):
    pool = spark.createDataFrame([("r", "a", 3, 1.0), ("r", "b", 3, 0.99), ("r", "c", 3, 0.6)], "request_id string, location_id string, target int, final_score double")
    vec = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("c", "y", 1.0)], "location_id string, token string, w double")
    assert [r["location_id"] for r in rank.mmr(pool, vec).orderBy("mmr_rank").collect()] == ["a", "c", "b"]


def test_pool_keeps_given_order_and_one_name(spark):
    df = spark.createDataFrame([("r", 1, "a", "N", "x", 1), ("r", 2, "b", "N", "x", 1), ("r", 3, "c", "M", "x", 1), ("r", 4, "h", "H", "Hotels", 1)], "request_id string, place int, location_id string, location_name string, primary_category string, trip_days int")
    assert [r["location_id"] for r in itinerary.candidate_pool(df).orderBy("rank").collect()] == ["a", "c"]


def test_plan_shows_a_name_once_over_days(spark):
    cols = "request_id string, trip_days int, day int, pos int, location_id string, location_name string, slot string, slots array<string>, lat double, lon double, source string"
    prop = spark.createDataFrame([("r", 2, 1, 1, "a", "Same", "morning", ["morning"], 41.9, -87.6, "pool"), ("r", 2, 2, 1, "b", "same", "morning", ["morning"], 41.9, -87.6, "pool"), ("r", 2, 2, 2, "c", "Other", "morning", ["morning"], 41.9, -87.6, "pool")], cols)
    pool = spark.createDataFrame([], "request_id string, trip_days int, rank int, location_id string, location_name string, slots array<string>, lat double, lon double")
    names = [r["location_name"].lower() for r in itinerary.assemble(prop, pool).collect()]
    assert sorted(names) == ["other", "same"]


def items(spark, data):
    return spark.createDataFrame(data, "location_id string, pos int, source string, url string")


def test_only_safe_sources_where_there_are_any(spark):
    df = items(spark, [("p", 1, "yelp", "https://y.example/1.jpg"), ("p", 2, "openverse", "https://o.example/2.jpg"), ("p", 3, "official", "https://f.example/3.jpg")])
    assert rows(media.with_fallback(df), "pos") == [(3,)]
    assert [r["pos"] for r in media.with_fallback(df.where("pos < 3")).orderBy("place").collect()] == [1, 2]


def test_same_content_once_and_similar_hash_once(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "pos int, c string")
    assert rows(media.first_of(df, F.col("c"), ["pos"]), "pos") == [(1,), (3,)]
    h = spark.createDataFrame([("g", 1, 0), ("g", 2, 63), ("g", 3, 127)], "group string, pos bigint, h bigint")
    assert rows(media.keep_first_similar(h), "pos") == [(1,), (3,)]


def test_safe_video_keeps_its_url(spark):
    df = spark.createDataFrame([("p", 1, "video", "https://www.youtube.com/watch?v=abcdefgh")], "location_id string, pos int, type string, url string")
    assert rows(media.display_order(df), "kind", "shown") == [("video", "https://www.youtube.com/watch?v=abcdefgh")]


def test_near_pairs_match_all_pairs(spark):
    import random

    r = random.Random(1)
    hs = [(i, r.getrandbits(63)) for i in range(60)]
    hs += [(100 + i, h ^ sum(1 << b for b in r.sample(range(64), i % 9)) if i % 9 else h) for i, h in hs]
    hs = [(i, h - (1 << 64) if h >> 63 else h) for i, h in hs]
    want = sorted((a, b) for a, x in hs for b, y in hs if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= 6)
    assert rows(media.near_pairs(spark.createDataFrame(hs, "id long, h long")), "a", "b") == want


def test_metrics_by_hand(spark):
    lists = spark.createDataFrame([("u", "a", 1), ("u", "b", 2)], "user_key string, location_id string, place int")
    truth = spark.createDataFrame([("u", "b"), ("u", "z")], "user_key string, location_id string")
    m = reports.ranking_metrics(lists, truth, (2,)).first()
    assert (m["precision"], m["recall"], m["hit_rate"], m["map"]) == (0.5, 0.5, 1.0, 0.25)


def test_nearest_users_leave_oneself_out(spark):
    v = spark.createDataFrame([("u", "c", 1.0), ("w", "c", 1.0)], "user_key string, category string, w double")
    q = v.select(F.col("user_key").alias("query"), F.col("user_key").alias("self"), "category", "w")
    assert rows(users.nearest_users(q, v), "query", "user_key") == [("u", "w"), ("w", "u")]


def test_best_places_equal_the_pool_of_all_pairs(spark):
    import random

    r = random.Random(5)
    cats = [["a", "x"], ["b", "x"], ["A", "y"], ["c"]]
    vec = {0: {"a": 0.8, "x": 0.6}, 1: {"b": 0.6, "x": 0.8}, 2: {"a": 0.8, "y": 0.6}, 3: {"c": 1.0}}
    kind = [r.randint(0, 3) for _ in range(400)]
    places = [(f"L{k}", cats[c], r.choice([0.0, 0.0, 0.1, 0.100001, 0.1000004]), r.choice([0.0, 0.3]), int(r.random() < 0.2), int(r.random() < 0.2), r.choice([None, 0.5])) for k, c in enumerate(kind)]
    places = spark.createDataFrame(places, "location_id string, categories array<string>, popularity double, trending double, is_hot_spot_location int, is_favorite_location int, feedback_penalty double")
    req = [(f"r{k}", None if k % 3 == 2 else f"u{k}", k % 3 == 0, r.choice([[], ["A"], ["a", "c"], ["x"]]), r.choice([[], ["Y"]]), r.choice([1, 5, 20])) for k in range(12)]
    requests = spark.createDataFrame(req, "request_id string, user_key string, is_returning boolean, interests array<string>, avoid_categories array<string>, top_k int")
    sims = [(f"r{k}", c, s) for k in range(12) for c in vec if (s := r.choice([0.0, 0.2, 0.2000001, 0.9]))]
    sim = spark.createDataFrame([(k, f"L{i}", s) for k, c, s in sims for i in range(400) if kind[i] == c], "request_id string, location_id string, sim double")
    terms = spark.createDataFrame([(f"r{k}", f"L{i}", r.random() / 3, r.choice([None, 0.4]), r.random() / 3) for k in range(12) for i in r.sample(range(400), 40)], "request_id string, location_id string, item_collab double, session double, user_collab double")
    seen = spark.createDataFrame([(f"u{k}", f"L{i}") for k in range(0, 12, 3) for i in r.sample(range(400), 50)], "user_key string, location_id string")
    every = requests.crossJoin(places).join(sim, ["request_id", "location_id"], "left").join(terms, ["request_id", "location_id"], "left").withColumn("user_collab", F.when(F.col("is_returning"), F.col("user_collab")))
    every = every.withColumn("final_score", rank.final_score()).where(rank.category_mask()).join(seen, ["user_key", "location_id"], "left_anti")
    cols = ("request_id", "pool_rank", "location_id", "target")
    want = sorted(tuple(x) for x in rank.top_pool(every).select(*cols).collect())
    first = rank.classes(places).select(F.col("class").alias("location_id"))
    got = rank.best_places(requests, places, sim.join(first, "location_id", "left_semi"), terms, seen)
    assert sorted(tuple(x) for x in got.select(*cols).collect()) == want and len(want) > 600
    assert rank.best_places(requests.limit(0), places, sim, terms, seen).count() == 0
