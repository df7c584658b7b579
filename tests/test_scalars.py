from pyspark.sql import functions as F

from trailmark.functions import scalars as s


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text_functions(spark):
    assert one(spark, s.split_categories(F.lit(" A ;; B;"))) == ["A", "B"]
    assert one(spark, s.split_categories(F.lit(None).cast("string"))) == []
    assert one(spark, s.category_token(F.lit("HOT Spots!"))) == "hot_spots"
    assert one(spark, s.category_token(F.lit("!!"))) == "unknown"
    assert one(spark, s.canonical_name(F.lit(" Café A&B "))) == "caf a and b"
    assert one(spark, s.canonical_name(F.lit(None).cast("string"))) == ""
    assert one(spark, s.optional_text(F.lit(" NaN "))) is None
    assert one(spark, s.truncate(F.lit("x" * 130), 120)) == "x" * 117 + "..."
    assert one(spark, s.number(F.lit("nope"), 2.0)) == 2.0
    assert one(spark, s.number(F.lit(float("nan")))) == 0.0
    assert one(spark, s.deep_link(F.lit("0" * 36), "b/")) is None


def test_min_max_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, v double")
    assert {r[0] for r in s.min_max(df, "v", "n").select("n").collect()} == {0.0}


def test_category_union_keeps_first_mention(spark):
    df = spark.createDataFrame([("p", 2, "B; C", "D"), ("p", 1, "A;B", "A")], "k string, o int, joined string, primary string")
    assert s.category_union(df, ["k"], "joined", "primary", ["o"]).first()["categories"] == ["A", "B", "C", "D"]


def test_most_common_breaks_ties_by_string(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", ""), ("k", None)], "k string, v string")
    assert s.most_common(df, ["k"], "v", "out").first()["out"] == "a"
