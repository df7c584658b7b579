"""Content vectors and profiles as long tables (id, token, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import category_token

# Category weights of moods and of kinds of travellers, and categories hinted at by words.
VIBES = {
    "chill": {"Parks": 1.0, "Attractions": 0.5, "Shops": 0.3},
    "adventurous": {"Attractions": 1.0, "Tours": 0.8, "HOT SPOTS": 0.6, "Parks": 0.3},
    "foodie": {"Restaurants": 1.0, "Bars": 0.5, "HOT SPOTS": 0.3},
    "nightlife": {"Bars": 1.0, "Restaurants": 0.6, "HOT SPOTS": 0.7},
    "cultural": {"Museums": 1.0, "Attractions": 0.7, "Tours": 0.4},
    "outdoorsy": {"Parks": 1.0, "Attractions": 0.5, "Tours": 0.3},
}
TRAVELERS = {
    "solo": {"Attractions": 0.5, "Bars": 0.4, "Museums": 0.4},
    "couple": {"Restaurants": 0.6, "Bars": 0.5, "Attractions": 0.5},
    "family": {"Parks": 1.0, "Attractions": 0.7, "Museums": 0.5},
    "group": {"Bars": 0.7, "Restaurants": 0.7, "Attractions": 0.5, "HOT SPOTS": 0.5},
    "business": {"Restaurants": 0.5, "Bars": 0.4, "Hotels": 0.6},
}
HINTS = {
    "park": ("Parks",), "outdoor": ("Parks",), "garden": ("Parks", "Attractions"), "museum": ("Museums",), "art": ("Museums", "Attractions"),
    "history": ("Museums", "Attractions"), "food": ("Restaurants",), "dinner": ("Restaurants",), "lunch": ("Restaurants",), "pizza": ("Restaurants",),
    "deep dish": ("Restaurants",), "bar": ("Bars",), "cocktail": ("Bars",), "beer": ("Bars",), "jazz": ("Bars", "HOT SPOTS"),
    "music": ("Bars", "HOT SPOTS", "Attractions"), "tour": ("Tours", "Attractions"), "bus": ("Tours",), "shopping": ("Shops",), "shop": ("Shops",),
    "hotel": ("Hotels",), "stay": ("Hotels",), "hot spot": ("HOT SPOTS",), "trendy": ("HOT SPOTS",), "instagram": ("HOT SPOTS", "Attractions"),
}


def tokens(categories: DataFrame, key: str = "location_id") -> DataFrame:
    """(key, token, tf) from an array column categories."""
    return categories.select(key, F.explode("categories").alias("c")).select(key, category_token(F.col("c")).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def idf(tf: DataFrame, key: str = "location_id", all_rows: DataFrame | None = None) -> DataFrame:
    """V1: (token, idf): ln((1 + n) / (1 + df)) + 1."""
    n = (tf if all_rows is None else all_rows).agg(F.count_distinct(key).alias("n"))
    df = tf.groupBy("token").agg(F.count_distinct(key).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def unit(df: DataFrame, key: str, w: str = "w") -> DataFrame:
    """L2-normalised rows of (key, token, w); a zero row stays zero."""
    norm = F.sqrt(F.sum(F.col(w) * F.col(w)).over(W.partitionBy(key)))
    return df.withColumn(w, F.when(norm < 1e-12, F.col(w)).otherwise(F.col(w) / norm))


def tfidf(categories: DataFrame, key: str = "location_id") -> DataFrame:
    """V1"""
    tf = tokens(categories, key)
    return unit(tf.join(idf(tf, key), "token").select(key, "token", (F.col("tf") * F.col("idf")).alias("w")), key)


def behaviour_profiles(seen: DataFrame, vectors: DataFrame, weight: str = "effective_score") -> DataFrame:
    """V2: (user_key, token, w): weighted mean of the vectors of a user's qualified places, L2."""
    known = seen.join(vectors.select("location_id").distinct(), "location_id", "left_semi")
    share = F.greatest(F.col(weight), F.lit(0.1))
    parts = known.withColumn("s", share / F.sum(share).over(W.partitionBy("user_key")))
    return unit(parts.join(vectors, "location_id").groupBy("user_key", "token").agg(F.sum(F.col("s") * F.col("w")).alias("w")), "user_key")


def _pairs(table: dict[str, dict[str, float]]):
    return F.create_map(*[x for k, cats in table.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(c).alias("category"), F.lit(v).alias("w")) for c, v in cats.items()]))])


def form_weights(requests: DataFrame) -> DataFrame:
    """V3: (request_id, category, w, ord) from interests, vibe, traveler_type and free_text; ord: first mention."""
    none = F.array().cast("array<struct<category:string,w:double>>")
    wish = F.transform("interests", lambda c: F.struct(c.alias("category"), F.lit(1.0).alias("w")))
    text = F.lower(F.coalesce("free_text", F.lit("")))
    hints = F.flatten(F.array(*[F.when(text.contains(k), F.array(*[F.struct(F.lit(c).alias("category"), F.lit(0.5).alias("w")) for c in cats])).otherwise(none) for k, cats in HINTS.items()]))
    parts = F.concat(F.coalesce(wish, none), F.coalesce(_pairs(VIBES)[F.lower("vibe")], none), F.coalesce(_pairs(TRAVELERS)[F.lower("traveler_type")], none), hints)
    rows = requests.select("request_id", F.posexplode(parts).alias("i", "p")).select("request_id", "i", "p.category", "p.w")
    return rows.groupBy("request_id", "category").agg(F.sum("w").alias("w"), F.min("i").alias("ord"))


def form_profiles(requests: DataFrame, idf_table: DataFrame) -> DataFrame:
    """V3: (request_id, token, w): each category's token max(round half even(3w), 1) times, by idf, L2; unknown tokens are ignored."""
    n = F.greatest(F.bround(F.round(F.col("w") * 3, 9), 0), F.lit(1.0))
    tf = form_weights(requests).select("request_id", category_token(F.col("category")).alias("token"), n.alias("n")).groupBy("request_id", "token").agg(F.sum("n").alias("tf"))
    return unit(tf.join(idf_table, "token").select("request_id", "token", (F.col("tf") * F.col("idf")).alias("w")), "request_id")


def inferred_interests(requests: DataFrame) -> DataFrame:
    """V4: categories by weight, ties in order of first mention."""
    w = form_weights(requests)
    return w.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("w", 9)).alias("n"), "ord", "category"))), lambda x: x["category"]).alias("inferred"))


def with_tag_signal(requests: DataFrame) -> DataFrame:
    """V7: requests whose form says something by itself."""
    return requests.where((F.size("interests") > 0) | (F.trim(F.coalesce("free_text", F.lit(""))) != ""))


def blend_profiles(behaviour: DataFrame, form: DataFrame, share: float = 0.6) -> DataFrame:
    """V5: of (request_id, token, w) tables: 0.6 and 0.4, L2; a request with one side keeps it as it is."""
    a = behaviour.select("request_id", "token", (share * F.col("w")).alias("w"))
    b = form.select("request_id", "token", ((1 - share) * F.col("w")).alias("w"))
    return unit(a.unionByName(b).groupBy("request_id", "token").agg(F.sum("w").alias("w")), "request_id")


def similarities(profiles: DataFrame, vectors: DataFrame) -> DataFrame:
    """V6: (request_id, location_id, sim) by a sparse dot product; pairs without a common token are 0 and left out."""
    return profiles.join(vectors.withColumnRenamed("w", "v"), "token").groupBy("request_id", "location_id").agg(F.sum(F.col("w") * F.col("v")).alias("sim"))


def parse_intent(texts: DataFrame, categories: list[str], key: str) -> DataFrame:
    """V8: categories, first traveller kind and first vibe named in the text (as substrings, whatever they are part of)."""
    text = F.lower(F.coalesce("text", F.lit("")))
    hit = lambda names: F.array_compact(F.array(*[F.when(text.contains(n.lower()), n) for n in names]))
    return texts.select(key, hit(categories).alias("interests"), F.try_element_at(hit(list(TRAVELERS)), F.lit(1)).alias("traveler_type"), F.try_element_at(hit(list(VIBES)), F.lit(1)).alias("vibe"))


def merge_delta(requests: DataFrame, deltas: DataFrame) -> DataFrame:
    """V9: requests changed by deltas(request_id, add, remove, avoid_add, avoid_remove, vibe)."""
    none = F.array().cast("array<string>")
    get = lambda c: F.coalesce(c, none)
    j = requests.join(deltas.withColumnRenamed("vibe", "new_vibe"), "request_id", "left")
    wish = F.array_except(F.array_distinct(F.concat("interests", get("add"))), get("remove"))
    avoid = F.array_except(F.array_distinct(F.concat("avoid_categories", get("avoid_add"))), get("avoid_remove"))
    return j.select("request_id", wish.alias("interests"), avoid.alias("avoid_categories"), F.coalesce("new_vibe", "vibe").alias("vibe"))
