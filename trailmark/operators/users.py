"""Users: category vectors, neighbours, archetypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written
from .nearest import nearest_users  # noqa: F401  N2, N3
from .vectors import unit

# Names of archetypes by leading category.
ARCHETYPES = {"Attractions": "Sightseeing Explorer", "Parks": "Outdoor Wanderer", "Museums": "Cultural Enthusiast", "Bars": "Nightlife Seeker", "Restaurants": "Foodie Wanderer", "Hotels": "Comfort Traveler", "Shops": "Retail Hunter", "Tours": "Tour-First Visitor", "HOT SPOTS": "Trend Hunter", "Favorites": "Loyal Fan"}


def category_vectors(interactions: DataFrame, categories: DataFrame, score: str) -> DataFrame:
    """(user_key, category, w): each place's score spread over its categories, summed, L2."""
    j = interactions.join(categories, "location_id")
    per = F.col(score) / F.greatest(F.size("categories"), F.lit(1))
    return unit(j.select("user_key", F.explode("categories").alias("category"), per.alias("w")).groupBy("user_key", "category").agg(F.sum("w").alias("w")), "user_key")


def neighbour_scores(neighbours: DataFrame, interactions: DataFrame, score: str) -> DataFrame:
    """(query, location_id, score): sum of sim times score over neighbours, over the query's greatest."""
    s = neighbours.join(interactions, "user_key").groupBy("query", "location_id").agg(F.sum(F.col("sim") * F.col(score)).alias("score"))
    top = F.max("score").over(W.partitionBy("query"))
    return s.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")))


def user_slate(pool: DataFrame, k: int = 6, most: int = 2) -> DataFrame:
    """Diverse similar users from pool(query, user_key, sim, archetype, n_locations, tops): no twins, one of each archetype first, at most two of each."""
    twin = W.partitionBy("query", "archetype", "n_locations", "tops").orderBy(F.desc(F.round("sim", 9)), "user_key")
    kind = W.partitionBy("query", "archetype").orderBy(F.desc(F.round("sim", 9)), "user_key")
    final = W.partitionBy("query").orderBy("round", F.desc(F.round("sim", 9)), "user_key")
    own = pool.withColumn("_t", F.row_number().over(twin)).where("_t = 1").drop("_t").withColumn("round", F.row_number().over(kind)).where(F.col("round") <= most)
    return own.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k)


def cluster(vectors: DataFrame, k: int = 6, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """KMeans of users over categories; k is at most a fifth of the users. Returns (user_key, cluster), (cluster, category, w).

    The number of categories is a catalogue's, so the vocabulary is a short list; rows without weight are left out.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    names = [r[0] for r in vectors.select("category").distinct().orderBy("category").collect()]
    wide = vectors.groupBy("user_key").agg(F.map_from_entries(F.collect_list(F.struct("category", "w"))).alias("m"), F.sum("w").alias("s")).where("s > 1e-12")
    rows = wide.select("user_key", array_to_vector(F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) for c in names])).alias("features"))
    n = rows.count()
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "user_key string, cluster int"), spark.createDataFrame([], "cluster int, category string, w double")
    if min(k, n // 5) < 2:  # too few users for more than one cluster, whose centre is the mean
        centre = vectors.join(wide.select("user_key"), "user_key", "left_semi").groupBy("category").agg((F.sum("w") / n).alias("w"))
        return wide.select("user_key", F.lit(0).alias("cluster")), centre.select(F.lit(0).alias("cluster"), "category", "w")
    model = KMeans(k=min(k, n // 5), seed=seed).fit(rows)
    centres = [(i, c, float(x)) for i, v in enumerate(model.clusterCenters()) for c, x in zip(names, v, strict=True)]
    return model.transform(rows).select("user_key", F.col("prediction").alias("cluster")), spark.createDataFrame(centres, "cluster int, category string, w double")


def cluster_meta(labels: DataFrame, centres: DataFrame, interactions: DataFrame, score: str, top: int = 5) -> DataFrame:
    """Size, top categories, name and seed places of each cluster."""
    size = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    wc = W.partitionBy("cluster").orderBy(F.desc(F.round("w", 9)), "category")
    cats = centres.where("w > 1e-6").withColumn("r", F.row_number().over(wc)).where(F.col("r") <= top)
    named = F.create_map(*[F.lit(x) for kv in ARCHETYPES.items() for x in kv])
    tops = cats.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "category"))), lambda x: x["category"]).alias("top_categories"), F.min_by(named[F.col("category")], F.when(named[F.col("category")].isNotNull(), F.col("r"))).alias("archetype"))
    pop = interactions.join(labels, "user_key").groupBy("cluster", "location_id").agg(F.sum(score).alias("s"))
    wp = W.partitionBy("cluster").orderBy(F.desc(F.round("s", 6)), "location_id")
    seeds = pop.withColumn("r", F.row_number().over(wp)).where(F.col("r") <= top).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "location_id"))), lambda x: x["location_id"]).alias("seeds"))
    return size.join(tops, "cluster", "left").join(seeds, "cluster", "left").withColumn("archetype", F.coalesce("archetype", F.lit("Curious Explorer")))


def assign_nearest(vectors: DataFrame, centres: DataFrame, key: str = "user_key") -> DataFrame:
    """(key, cluster, confidence): nearest centre by squared distance; confidence is the clipped cosine. Centres are few and broadcast."""
    norms = centres.groupBy("cluster").agg(F.sum(F.col("w") * F.col("w")).alias("cc"))
    own = vectors.groupBy(key).agg(F.sum(F.col("w") * F.col("w")).alias("vv"))
    dots = vectors.withColumnRenamed("w", "v").join(F.broadcast(centres), "category").groupBy(key, "cluster").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    every = own.crossJoin(F.broadcast(norms)).join(dots, [key, "cluster"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))
    dist = F.round(F.col("vv") - 2 * F.col("dot") + F.col("cc"), 9)
    best = every.groupBy(key).agg(F.min_by(F.struct("cluster", "dot", "vv", "cc"), F.struct(dist, F.col("cluster"))).alias("b"))
    conf = F.when(F.sqrt(F.col("b.cc") * F.col("b.vv")) > 1e-12, F.col("b.dot") / F.sqrt(F.col("b.cc") * F.col("b.vv"))).otherwise(0.0)
    return best.select(key, "b.cluster", F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def refined_clusters(vectors: DataFrame, centres: DataFrame, steps: int) -> tuple[DataFrame, DataFrame]:
    """C1 from given centres: so many steps of nearest centre and mean. Returns (user_key, cluster) and (cluster, category, w).

    Equally near centres (to nine places): the lower cluster. A cluster that loses all users keeps its centre. Each step is
    one join and an aggregate with partial sums, stored before the next.
    """
    for _ in range(steps):
        labels = written(assign_nearest(vectors, centres).select("user_key", "cluster"), "labels")
        n = labels.groupBy("cluster").agg(F.count("*").alias("n"))
        moved = vectors.join(labels, "user_key").groupBy("cluster", "category").agg(F.sum("w").alias("w")).join(n, "cluster").select("cluster", "category", (F.col("w") / F.col("n")).alias("w"))
        centres = written(moved.unionByName(centres.join(n, "cluster", "left_anti").select("cluster", "category", "w")), "centres")
    return assign_nearest(vectors, centres).select("user_key", "cluster"), centres


def interest_vectors(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """(request_id, category, w): unit vectors of the requests' interests, as far as they are categories(category) of the users' vectors; a repeated interest counts once."""
    own = requests.select("request_id", F.explode(F.array_distinct("interests")).alias("category")).join(categories.select("category").distinct(), "category", "left_semi")
    return unit(own.withColumn("w", F.lit(1.0)), "request_id").select("request_id", "category", "w")


def archetype_seeds(requests: DataFrame, labels: DataFrame, centres: DataFrame, interactions: DataFrame, score: str) -> DataFrame:
    """R2 (second source): (request_id, location_id) of the seed places of the archetype nearest to a request's interests.

    Requests without a known interest have none.
    """
    near = assign_nearest(interest_vectors(requests, centres), centres, "request_id")
    seeds = cluster_meta(labels, centres, interactions, score).select("cluster", F.explode("seeds").alias("location_id"))
    return near.join(F.broadcast(seeds), "cluster").select("request_id", "location_id")  # five places a cluster
