"""Hand-made cases of the page guard, map links and the deny list."""

from pyspark.sql import functions as F

from trailmark.operators import media as m


def test_page_guard(spark):
    rows = [
        ("Welcome to Blue Door - Lakeview, Springfield", "Blue Door - Old Town", True),  # before the dash
        ("Blue Door", "Blue Door", False),  # no city
        ("The door of springfield", "Door Restaurant", False),  # one token is not enough
        ("A door, all blue, in springfield", "Blue Door Hotel", True),  # both tokens, general word left out
        ("alpha beta gamma in springfield", "Alpha Beta Gamma Delta", True),  # three of four
        ("alpha beta in springfield", "Alpha Beta Gamma Delta", False),
        ("springfield lantern", "Lantern near the lake", True),
        ("springfield abc", "abc", False),  # a phrase of three characters
    ]
    df = spark.createDataFrame(rows, "text string, name string, want boolean")
    got = df.select("want", m.identifies(F.col("text"), F.col("name"), "springfield").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    by_url = df.limit(1).select(m.identifies(F.lit("Blue Door"), F.lit("Blue Door"), "springfield", F.lit("https://springfield.example/x")).alias("got"))
    assert by_url.first()["got"]


def test_map_links(spark):
    df = spark.createDataFrame([("@41.9,-87.7",), ("x @10.12345,20.12345 @41.91234,-87.71234",), ("!3d41.8123!4d-87.6123",), (None,), ("",)], "body string")
    got = [r["c"] for r in df.select(m.coordinates(F.col("body"), (41.5, 42.2), (-88.1, -87.3)).alias("c")).collect()]
    assert [g and (g["lat"], g["lon"]) for g in got] == [None, (41.91234, -87.71234), (41.8123, -87.6123), None, None]


def test_denied(spark):
    df = spark.createDataFrame([("https://maps.googleapis.com/a.png", True), ("https://a.example/logo.png", False), ("https://A.example/WEBGL_LOGO.png", True)], "url string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", m.denied_url(F.col("url")).alias("got")).collect())


def test_audit(spark):
    good = [("image", "official", f"g{k}.jpg", "u") for k in range(3)]
    clip = ("video", "official", "v.mp4", "u")
    cards = [
        ("whole", [*good, clip], "g0.jpg", "u", "official", None, None),
        ("thin", good[:2], None, None, "official", None, None),
        ("tried", good[:2], None, None, "official", True, 0),
        ("again", good[:2], None, None, "official", True, 2),
        ("empty", [], None, None, None, None, None),
        ("null", None, None, None, "none", None, None),
        ("bare", [*good, ("image", "official", "", "u")], None, None, "official", None, None),
        ("other", [("image", "yelp", "g0.jpg", "u"), *good], None, None, "yelp", None, None),
        ("single", [good[0], ("image", None, "g1.jpg", None)], None, None, "official", None, None),
        ("lost", [("image", "official", "gone.jpg", "u"), *good], None, None, "official", None, None),
        ("small", [("image", "official", "small.jpg", "u"), *good], None, None, "official", None, None),
        ("narrow", [("image", "official", "narrow.jpg", "u"), *good], None, None, "official", None, None),
        ("unread", [("image", "official", "unread.jpg", "u"), *good], None, None, "official", None, None),
        ("film", [*good, ("video", "official", "long.mp4", "u")], None, None, "official", None, None),
        ("linked", [*good, ("video", "official", None, "u")], None, None, "official", None, None),
        ("url", good, None, "u", "official", None, None),
    ]
    media = "array<struct<type:string,source:string,file:string,url:string>>"
    df = spark.createDataFrame(cards, f"location_id string, media {media}, image_file string, image_url string, media_source string, augmentation_attempted boolean, augmentation_added int")
    files = [*[(f"g{k}.jpg", 20_000, 400, 300) for k in range(3)], ("g0.jpg", 10, 1, 1), ("v.mp4", 24_999_999, None, None), ("long.mp4", 25_000_000, None, None), ("small.jpg", 11_999, None, 300), ("narrow.jpg", 20_000, 900, 219), ("unread.jpg", None, 400, 300)]
    store = spark.createDataFrame(files, "file string, bytes long, width int, height int")
    got = {r["location_id"]: (r["needs_refresh"], r["low_quality"], r["needs_augmentation"]) for r in m.audit(df, store).collect()}
    assert len(got) == len(cards)
    assert {k for k, v in got.items() if v[0]} == {"empty", "null", "bare", "other", "single", "url"}
    assert {k for k, v in got.items() if v[1]} == {"empty", "null", "lost", "small", "narrow", "unread", "film"}
    assert {k for k, v in got.items() if v[2]} == {"thin", "again", "single"}
    assert m.audit(df.limit(0), store).count() == 0
    assert m.audit(df, store.limit(0)).where("low_quality").count() == len(cards)
