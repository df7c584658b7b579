"""Queries: vectors (V), users (N, C), ranking (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, graphs, quality, rank, users, vectors
from ..sources import fixtures as fx
from ..sources import sql as q
from ..sources.shared import written
from .base import effective, parsed_events, query, r6, seen_places, site_events, six, step
from .core import INTER, MOVES, PRIORS, TREND, categories, jaccard_sql, trend


@step
def place_categories(spark, d):
    """Categories of the places, stored: vectors, universe and users read them several times."""
    return categories(spark, d)


@step
def vecs(spark, d):
    return vectors.tfidf(place_categories(spark, d))


def idf(spark, d):
    return vectors.idf(vectors.tokens(place_categories(spark, d)))


def behaviour(spark, d):
    return vectors.behaviour_profiles(seen_places(spark, d), vecs(spark, d))


@step
def profiles(spark, d):
    r = fx.requests(spark, d)
    own = r.join(behaviour(spark, d), "user_key").select("request_id", "token", "w")
    return vectors.blend_profiles(own, vectors.form_profiles(vectors.with_tag_signal(r), idf(spark, d)))


VEC = f"WITH {q.QUALIFIED}, {q.SEEN}, {q.REQUESTS}, {q.TFIDF}, {q.BEHAVIOUR}, {q.form()}, {q.PROFILE}"


@query("v01_tfidf", f"{VEC} SELECT location_id, token, round(w,6) AS w FROM vec")
def v01(spark, d):
    return vecs(spark, d).withColumn("w", r6("w"))


@query("v02_behaviour_profiles", f"{VEC} SELECT user_key, token, round(w,6) AS w FROM beh")
def v02(spark, d):
    return behaviour(spark, d).withColumn("w", r6("w"))


@query("v03_form_profiles", f"{VEC} SELECT request_id, token, round(w,6) AS w FROM form")
def v03(spark, d):
    return vectors.form_profiles(fx.requests(spark, d), idf(spark, d)).withColumn("w", r6("w"))


@query("v04_inferred_interests", f"{VEC} SELECT request_id, string_agg(category,'|' ORDER BY round(w,9) DESC, o) AS inferred FROM fw GROUP BY 1")
def v04(spark, d):
    return vectors.inferred_interests(fx.requests(spark, d)).withColumn("inferred", F.array_join("inferred", "|"))


@query("v05_blended_profiles", f"{VEC} SELECT request_id, token, round(w,6) AS w FROM prof")
def v05(spark, d):
    return profiles(spark, d).withColumn("w", r6("w"))


@query("v06_similarities", f"{VEC} SELECT request_id, location_id, round(sim,6) AS sim FROM simt")
def v06(spark, d):
    places = rank.classed(categories(spark, d).select("location_id", "categories"))
    first = places.select(F.col("class").alias("location_id")).distinct()
    sim = written(vectors.similarities(profiles(spark, d), vecs(spark, d).join(first, "location_id", "left_semi")).withColumn("sim", r6("sim")), "class_similarities")
    return rank.with_places(sim.withColumnRenamed("location_id", "class"), places.select("location_id", "class")).select("request_id", "location_id", "sim")


@query("v07_tag_signal", f"WITH {q.REQUESTS} SELECT request_id FROM req WHERE len(interests)>0 OR trim(coalesce(free_text,''))<>''")
def v07(spark, d):
    return vectors.with_tag_signal(fx.requests(spark, d)).select("request_id")


NAMES = ["The", "Art", "Bar", "Des", "Que"]


@query("v08_intent", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text),'{n.lower()}') THEN '{n}' END" for n in NAMES) + "], lambda x: x IS NOT NULL),'|') AS interests, list_filter([" + ", ".join(f"CASE WHEN contains(lower(text),'{n}') THEN '{n}' END" for n in vectors.TRAVELERS) + "], lambda x: x IS NOT NULL)[1] AS traveler_type, list_filter([" + ", ".join(f"CASE WHEN contains(lower(text),'{n}') THEN '{n}' END" for n in vectors.VIBES) + "], lambda x: x IS NOT NULL)[1] AS vibe FROM documents")
def v08(spark, d):
    return vectors.parse_intent(fx.table(spark, d, "documents"), NAMES, "doc_id").withColumn("interests", F.array_join("interests", "|"))


ONCE = "list_filter(list_filter({l}, lambda x, i: list_position({l}, x)=i), lambda x: NOT list_contains({out}, x))"  # distinct in order, without some


@query("v09_merge_delta", f"WITH {q.REQUESTS}, dl AS (SELECT request_id, ['SMALL','PROMO'] AS add, ['ECONOMY'] AS rem, ['Brand#2'] AS avoid, CASE WHEN user_key IS NULL THEN 'chill' END AS nv FROM req WHERE trip_days%2=0), j AS (SELECT request_id, interests || coalesce(add, []) AS l, coalesce(rem, []) AS rem, avoid_categories || coalesce(avoid, []) AS a, coalesce(nv, vibe) AS vibe FROM req LEFT JOIN dl USING (request_id)) SELECT request_id, array_to_string({ONCE.format(l='l', out='rem')},'|') AS interests, array_to_string({ONCE.format(l='a', out='[]::VARCHAR[]')},'|') AS avoid_categories, vibe FROM j")
def v09(spark, d):
    r = fx.requests(spark, d)
    arr = lambda *x: F.array(*map(F.lit, x))
    deltas = r.where("trip_days % 2 = 0").select("request_id", arr("SMALL", "PROMO").alias("add"), arr("ECONOMY").alias("remove"), arr("Brand#2").alias("avoid_add"), F.array().cast("array<string>").alias("avoid_remove"), F.when(F.col("user_key").isNull(), "chill").alias("vibe"))
    out = vectors.merge_delta(r, deltas)
    return out.withColumn("interests", F.array_join("interests", "|")).withColumn("avoid_categories", F.array_join("avoid_categories", "|"))


# ---------------------------------------------------------------- users
NVEC = f"{INTER}, ucr AS (SELECT user_key, category, sum(score/2) AS w FROM inter JOIN cats USING (location_id) GROUP BY ALL), ucv AS (SELECT user_key, category, w/sqrt(sum(w*w) OVER (PARTITION BY user_key)) AS w FROM ucr)"
KNN = "dots AS (SELECT a.user_key AS query, b.user_key, sum(a.w*b.w) AS sim FROM ucv a JOIN ucv b ON a.category=b.category AND a.user_key<>b.user_key WHERE a.user_key IN (SELECT user_key FROM req) GROUP BY ALL), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim,9) DESC, user_key) AS rank FROM dots WHERE sim>0) WHERE rank<=5), nsc0 AS (SELECT query, location_id, sum(sim*score) AS s FROM knn JOIN inter USING (user_key) GROUP BY ALL), nsc AS (SELECT query, location_id, s/max(s) OVER (PARTITION BY query) AS score FROM nsc0)"
USERS = f"{VEC}, {NVEC}, {KNN}"


@step
def interactions(spark, d):
    return frames.interactions_from_events(parsed_events(spark, d))


@step
def user_vectors(spark, d):
    return users.category_vectors(interactions(spark, d), place_categories(spark, d), "total_interaction_score")


@step
def neighbours(spark, d):
    v = user_vectors(spark, d)
    own = v.join(fx.requests(spark, d).select("user_key").distinct(), "user_key", "left_semi")
    return users.nearest_users(own.select(F.col("user_key").alias("query"), F.col("user_key").alias("self"), "category", "w"), v)


@query("n01_user_vectors", f"{USERS} SELECT user_key, category, round(w,6) AS w FROM ucv")
def n01(spark, d):
    return user_vectors(spark, d).withColumn("w", r6("w"))


@query("n02_neighbours", f"{USERS} SELECT query, user_key, round(sim,6) AS sim, rank FROM knn")
def n02(spark, d):
    return neighbours(spark, d).select("query", "user_key", r6("sim").alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("n03_interest_neighbours", f"{USERS}, iq AS (SELECT request_id AS query, unnest(interests) AS category, 1/sqrt(len(interests)) AS w FROM req WHERE len(interests)>0), idot AS (SELECT query, b.user_key, sum(a.w*b.w) AS sim FROM iq a JOIN ucv b USING (category) GROUP BY ALL) SELECT query, user_key, round(sim,6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim,9) DESC, user_key) AS rank FROM idot WHERE sim>0) WHERE rank<=5")
def n03(spark, d):
    r = fx.requests(spark, d).where("size(interests) > 0")
    own = vectors.unit(r.select(F.col("request_id").alias("query"), F.explode("interests").alias("category"), F.lit(1.0).alias("w")), "query").withColumn("self", F.lit(None).cast("string"))
    return users.nearest_users(own, user_vectors(spark, d)).select("query", "user_key", r6("sim").alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("n04_neighbour_scores", f"{USERS} SELECT query, location_id, round(score,6) AS score FROM nsc")
def n04(spark, d):
    return users.neighbour_scores(neighbours(spark, d), interactions(spark, d), "total_interaction_score").withColumn("score", r6("score"))


POOL = "pool0 AS (SELECT query, k.user_key, sim, arch AS archetype, n_locations, tops FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim,9) DESC, user_key) AS rank FROM dots WHERE sim>0) WHERE rank<=36) k JOIN ulab USING (user_key))"
ULAB = "ucn AS (SELECT user_key, category, count(*) AS n FROM inter JOIN cats USING (location_id) GROUP BY ALL), ulab AS (SELECT user_key, string_agg(category,'|' ORDER BY r) AS tops, min_by(category,r) AS arch, any_value(nl) AS n_locations FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY n DESC, category) AS r FROM ucn) JOIN (SELECT user_key, count(*) AS nl FROM inter GROUP BY 1) USING (user_key) WHERE r<=3 GROUP BY 1)"


@query("n05_user_slate", f"{USERS}, {ULAB}, {POOL}, p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, archetype, n_locations, tops ORDER BY round(sim,9) DESC, user_key) AS t FROM pool0) WHERE t=1), p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, archetype ORDER BY round(sim,9) DESC, user_key) AS rd FROM p1) WHERE rd<=2), p3 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rd, round(sim,9) DESC, user_key) AS place FROM p2) SELECT query, user_key, place FROM p3 WHERE place<=6")
def n05(spark, d):
    v = user_vectors(spark, d)
    own = v.join(fx.requests(spark, d).select("user_key").distinct(), "user_key", "left_semi").select(F.col("user_key").alias("query"), F.col("user_key").alias("self"), "category", "w")
    labels = frames.user_labels(interactions(spark, d), categories(spark, d)).select("user_key", "n_locations", F.array_join("top_categories", "|").alias("tops"), F.element_at("top_categories", 1).alias("archetype"))
    pool = users.nearest_users(own, v, 36).join(labels, "user_key")
    return users.user_slate(pool).select("query", "user_key", F.col("place").cast("long").alias("place"))


@query("c01_archetypes")
def c01(spark, d):
    labels, _ = users.cluster(user_vectors(spark, d))
    return labels


def _refined(steps: int) -> str:
    """CTEs lab0, cen0 (users by number modulo 4) to lab{steps}, cen{steps}, and the last labels."""
    mean = "cen{0} AS MATERIALIZED (SELECT cluster, category, sum(w)/max(n) AS w FROM ucv JOIN lab{0} USING (user_key) JOIN (SELECT cluster, count(*) AS n FROM lab{0} GROUP BY 1) USING (cluster) GROUP BY ALL{1})"
    near = "lab{0} AS MATERIALIZED (SELECT user_key, cluster FROM (SELECT v.user_key, c.cluster, row_number() OVER (PARTITION BY v.user_key ORDER BY round(vv-2*coalesce(dot,0)+cc,9), c.cluster) AS r FROM (SELECT user_key, sum(w*w) AS vv FROM ucv GROUP BY 1) v CROSS JOIN (SELECT cluster, sum(w*w) AS cc FROM cen{1} GROUP BY 1) c LEFT JOIN (SELECT user_key, cluster, sum(ucv.w*cen{1}.w) AS dot FROM ucv JOIN cen{1} USING (category) GROUP BY ALL) e ON e.user_key=v.user_key AND e.cluster=c.cluster) WHERE r=1)"
    own = ["lab0 AS (SELECT user_key, CAST(CAST(substr(user_key,2) AS INTEGER)%4 AS INTEGER) AS cluster FROM (SELECT DISTINCT user_key FROM ucv))", mean.format(0, "")]
    for k in range(1, steps + 1):
        own += [near.format(k, k - 1), mean.format(k, f" UNION ALL SELECT * FROM cen{k - 1} ANTI JOIN lab{k} USING (cluster)")]
    return ", ".join([*own, near.format(steps + 1, steps)])


@query("c01_refined_archetypes", f"{USERS}, {_refined(3)} SELECT user_key, cluster FROM lab4")
def c01_refined(spark, d):
    return users.refined_clusters(user_vectors(spark, d), fixed_archetypes(spark, d)[1], 3)[0]


@query("c02_archetype_meta")
def c02(spark, d):
    v = user_vectors(spark, d)
    labels, centres = users.cluster(v)
    return users.cluster_meta(labels, centres, interactions(spark, d), "total_interaction_score")


@query("c02_fixed_archetype_meta", f"{USERS}, lab AS (SELECT user_key, CAST(CAST(substr(user_key,2) AS INTEGER)%4 AS INTEGER) AS cluster FROM (SELECT DISTINCT user_key FROM ucv)), cen AS (SELECT cluster, category, sum(w)/max(n) AS w FROM ucv JOIN lab USING (user_key) JOIN (SELECT cluster, count(*) AS n FROM lab GROUP BY 1) USING (cluster) GROUP BY ALL), tp AS (SELECT cluster, string_agg(category,'|' ORDER BY r) AS tops FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(w,9) DESC, category) AS r FROM cen WHERE w>1e-6) WHERE r<=5 GROUP BY 1), pp AS (SELECT cluster, location_id, sum(score) AS s FROM inter JOIN lab USING (user_key) GROUP BY ALL), sd AS (SELECT cluster, string_agg(location_id,'|' ORDER BY r) AS seeds FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(s,6) DESC, location_id) AS r FROM pp) WHERE r<=5 GROUP BY 1) SELECT cluster, (SELECT count(*) FROM lab l WHERE l.cluster=tp.cluster) AS size, tops, seeds FROM tp JOIN sd USING (cluster)")
def c02_fixed(spark, d):
    m = users.cluster_meta(*fixed_archetypes(spark, d), interactions(spark, d), "total_interaction_score")
    return m.select("cluster", "size", F.array_join("top_categories", "|").alias("tops"), F.array_join("seeds", "|").alias("seeds"))


def fixed_archetypes(spark, d):
    """Labels (the user's number modulo 4) and centres (the means of their vectors)."""
    v = user_vectors(spark, d)
    labels = v.select("user_key").distinct().withColumn("cluster", (F.substring("user_key", 2, 9).cast("int") % 4).cast("int"))
    n = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    return labels, v.join(labels, "user_key").join(n, "cluster").groupBy("cluster", "category").agg((F.sum("w") / F.max("n")).alias("w"))


FIXED = "cen(cluster,category,w) AS (VALUES (0,'ECONOMY',0.8::DOUBLE),(0,'PROMO',0.3::DOUBLE),(1,'STANDARD',0.9::DOUBLE),(2,'LARGE',0.5::DOUBLE),(2,'SMALL',0.6::DOUBLE),(3,'MEDIUM',0.7::DOUBLE))"


@query("c03_nearest_archetype", f"{USERS}, {FIXED}, cc AS (SELECT cluster, sum(w*w) AS cc FROM cen GROUP BY 1), vv AS (SELECT user_key, sum(w*w) AS vv FROM ucv GROUP BY 1), dd AS (SELECT user_key, cluster, vv, cc, coalesce((SELECT sum(u.w*c.w) FROM ucv u JOIN cen c USING (category) WHERE u.user_key=vv.user_key AND c.cluster=cc.cluster),0) AS dot FROM vv, cc) SELECT user_key, cluster, round(least(greatest(dot/sqrt(cc*vv),0),1),6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY round(vv-2*dot+cc,9), cluster) AS r FROM dd) WHERE r=1")
def c03(spark, d):
    centres = spark.createDataFrame([(0, "ECONOMY", 0.8), (0, "PROMO", 0.3), (1, "STANDARD", 0.9), (2, "LARGE", 0.5), (2, "SMALL", 0.6), (3, "MEDIUM", 0.7)], "cluster int, category string, w double")
    return users.assign_nearest(user_vectors(spark, d), centres).select("user_key", "cluster", r6("confidence").alias("confidence"))


# ---------------------------------------------------------------- ranking
RET = "ret AS (SELECT user_key FROM effective WHERE is_qualified GROUP BY 1 HAVING count(*)>=14)"
POLICY = quality.Policy(min_places_returning=14)
PENALTY = "clk AS (SELECT event_id, CASE WHEN event_id%3<>0 THEN event_time END AS ts, location_id FROM fx_events WHERE event_name='map-user-action'), pn AS (SELECT location_id, count(*) AS n FROM clk WHERE (ts IS NULL OR ts>=TIMESTAMP '2024-01-31 00:00:00'-INTERVAL 30 DAY) AND location_id IN (SELECT location_id FROM fx_locations) GROUP BY 1), pen AS (SELECT location_id, n, ln(1+n)/(SELECT max(ln(1+n)) FROM pn) AS feedback_penalty FROM pn)"
UNIV = "univ AS (SELECT l.*, [primary_category, brand] AS categories, coalesce(score,0.0) AS popularity_raw, coalesce(pop,0.0) AS popularity FROM fx_locations l LEFT JOIN scaled USING (location_id))"
FALL = "fb AS (SELECT request_id, location_id, rank FROM (SELECT request_id, location_id, row_number() OVER (PARTITION BY request_id ORDER BY round(popularity_raw,6) DESC, location_id) AS rank FROM req, univ WHERE len(interests)=0 OR list_has_any(list_transform(interests, lambda x: lower(x)), list_transform(categories, lambda x: lower(x)))) WHERE rank<=5)"
ARCH = """lab AS (SELECT user_key, CAST(CAST(substr(user_key,2) AS INTEGER)%4 AS INTEGER) AS cluster FROM (SELECT DISTINCT user_key FROM ucv)),
cen AS (SELECT cluster, category, sum(w)/max(n) AS w FROM ucv JOIN lab USING (user_key) JOIN (SELECT cluster, count(*) AS n FROM lab GROUP BY 1) USING (cluster) GROUP BY ALL),
asd AS (SELECT cluster, location_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(s,6) DESC, location_id) AS r FROM (SELECT cluster, location_id, sum(score) AS s FROM inter JOIN lab USING (user_key) GROUP BY ALL)) WHERE r<=5),
ccn AS (SELECT cluster, sum(w*w) AS cc FROM cen GROUP BY 1), inl AS (SELECT DISTINCT request_id, category FROM (SELECT request_id, unnest(interests) AS category FROM req) WHERE category IN (SELECT category FROM cen)),
inv AS (SELECT request_id, category, 1/sqrt(count(*) OVER (PARTITION BY request_id)) AS w FROM inl), idt AS (SELECT request_id, cluster, sum(inv.w*cen.w) AS dot FROM inv JOIN cen USING (category) GROUP BY ALL),
ian AS (SELECT request_id, cluster FROM (SELECT r.request_id, ccn.cluster, row_number() OVER (PARTITION BY r.request_id ORDER BY round(vv-2*coalesce(dot,0)+cc,9), ccn.cluster) AS k FROM (SELECT request_id, sum(w*w) AS vv FROM inv GROUP BY 1) r CROSS JOIN ccn LEFT JOIN idt ON idt.request_id=r.request_id AND idt.cluster=ccn.cluster) WHERE k=1),
ars AS (SELECT request_id, location_id FROM ian JOIN asd USING (cluster))"""
SEEDS = f"{ARCH}, nwr AS (SELECT request_id FROM req WHERE user_key IS NULL OR user_key NOT IN (SELECT user_key FROM ret)), sds AS (SELECT request_id, s.location_id, 'own' AS source FROM req JOIN ret USING (user_key) JOIN seen s USING (user_key) UNION ALL SELECT request_id, location_id, 'archetype' FROM ars SEMI JOIN nwr USING (request_id) UNION ALL SELECT request_id, location_id, 'popular' FROM fb SEMI JOIN nwr USING (request_id) WHERE request_id NOT IN (SELECT request_id FROM ars))"
ITEM = jaccard_sql("SELECT DISTINCT user_key AS b, location_id AS i FROM seen", "ij")
SESS = jaccard_sql("SELECT DISTINCT session_key AS b, location_id AS i FROM classed WHERE quality_weight>0 AND location_id IN (SELECT location_id FROM fx_locations)", "sj")


def _edge(out: str, edges: str) -> str:
    return f"{out}0 AS (SELECT s.request_id, dst AS location_id, sum(weight)/max(n) AS v FROM sds s JOIN {edges} ON src=location_id JOIN sn USING (request_id) GROUP BY 1,2), {out} AS (SELECT request_id, location_id, v/max(v) OVER (PARTITION BY request_id) AS v FROM {out}0)"


TERMS = f"sn AS (SELECT request_id, count(*) AS n FROM sds GROUP BY 1), {_edge('e_item', 'ij')}, {_edge('e_sess', 'sj')}, {_edge('e_tran', 'trans')}"
SCORED = """scored AS (SELECT r.request_id, r.user_key, u.location_id, u.location_name, u.categories, r.interests, r.avoid_categories, r.top_k, r.trip_days, rt.user_key IS NOT NULL AS is_returning, coalesce(sim,0) AS sim, u.popularity, coalesce(i.v,0) AS item_collab, CASE WHEN rt.user_key IS NOT NULL THEN coalesce(k.score,0) ELSE 0 END AS user_collab, coalesce(trending_score,0) AS trending, 0.6*coalesce(s.v,0)+0.4*coalesce(t.v,0) AS session, coalesce(feedback_penalty,0) AS pen, is_hot_spot_location AS hot, is_favorite_location AS fav
 FROM req r CROSS JOIN univ u LEFT JOIN ret rt ON rt.user_key=r.user_key LEFT JOIN simt m ON m.request_id=r.request_id AND m.location_id=u.location_id LEFT JOIN e_item i ON i.request_id=r.request_id AND i.location_id=u.location_id LEFT JOIN e_sess s ON s.request_id=r.request_id AND s.location_id=u.location_id LEFT JOIN e_tran t ON t.request_id=r.request_id AND t.location_id=u.location_id LEFT JOIN nsc k ON k.query=r.user_key AND k.location_id=u.location_id LEFT JOIN trend d ON d.location_id=u.location_id LEFT JOIN pen p ON p.location_id=u.location_id),
fin AS (SELECT *, CASE WHEN is_returning THEN .22*sim+.15*popularity+.18*item_collab+.20*user_collab+.05*trending+.20*session ELSE .40*sim+.20*popularity+.10*item_collab+.10*trending+.20*session END+.05*hot+.03*fav-.08*pen AS final_score FROM scored),
msk AS (SELECT * FROM fin WHERE NOT list_has_any(list_transform(categories, lambda x: lower(x)), list_transform(avoid_categories, lambda x: lower(x))) AND (len(interests)=0 OR list_has_any(list_transform(categories, lambda x: lower(x)), list_transform(interests, lambda x: lower(x)))) AND NOT (is_returning AND EXISTS (SELECT 1 FROM seen s WHERE s.user_key=fin.user_key AND s.location_id=fin.location_id)))"""
FULL = f"{USERS}, {PRIORS}, {RET}, {PENALTY}, {UNIV}, {FALL}, {SEEDS}, {ITEM}, {SESS}, {MOVES}, {TREND}, {TERMS}, {SCORED}"


@step
def universe(spark, d):
    loc = fx.locations(spark, d)
    priors = frames.locations_from_events(parsed_events(spark, d)).withColumn("location_name", F.lit(""))
    return frames.expand_universe(loc, priors).join(place_categories(spark, d), "location_id").withColumn("popularity", F.col("popularity_norm"))


@step
def returning(spark, d):
    return quality.returning_users(effective(spark, d), POLICY)


@step(write=False)
def penalty(spark, d):
    return rank.feedback_penalty(fx.clicks_of(parsed_events(spark, d)), fx.locations(spark, d), "2024-01-31 00:00:00")


@step
def fixed_seeds(spark, d):
    """Seeds of archetypes with given labels (the user's number modulo 4), which SQL can follow."""
    return users.archetype_seeds(fx.requests(spark, d), *fixed_archetypes(spark, d), interactions(spark, d), "total_interaction_score")


@step
def learned_seeds(spark, d):
    """Seeds of the learned archetypes."""
    return users.archetype_seeds(fx.requests(spark, d), *users.cluster(user_vectors(spark, d)), interactions(spark, d), "total_interaction_score")


def request_seeds(spark, d, archetypes):
    r, places = fx.requests(spark, d), universe(spark, d)
    return rank.collect_seeds(r, seen_places(spark, d), returning(spark, d), archetypes, rank.fallback_seeds(r, places))


@step
def seeds_of_requests(spark, d):
    return request_seeds(spark, d, fixed_seeds(spark, d))


@step
def seeds_by_archetypes(spark, d):
    return request_seeds(spark, d, learned_seeds(spark, d))


def scored(spark, d, show=None):
    """Every request with every place and its terms. Not stored: it is the product, and a query reads it once."""
    return rank.score_all(*scoring(spark, d, seeds_of_requests(spark, d)), show)


def own_terms(spark, d, own):
    """The sparse terms: item_collab and session of (request_id, location_id), user_collab of (user_key, location_id). own: the requests' seeds."""
    e, loc = site_events(spark, d), fx.locations(spark, d)
    kinds = {"item": graphs.jaccard_pairs(seen_places(spark, d), "user_key", "location_id"), "session": graphs.jaccard_pairs(quality.modelling_events(e), "session_key", "location_id", loc), "moves": graphs.transitions(fx.with_previous(e), loc)}
    score = graphs.joint_edge_scores(own, kinds, loc)
    item = graphs.divide_by_max(score["item"]).withColumnRenamed("score", "item_collab")
    session = graphs.session_blend(score["session"], score["moves"]).withColumnRenamed("score", "session")
    near = users.neighbour_scores(neighbours(spark, d), interactions(spark, d), "total_interaction_score").select(F.col("query").alias("user_key"), "location_id", F.col("score").alias("user_collab"))
    return item, session, near


def asked(spark, d):
    """Requests, marked whether their user is a returning one."""
    ret = returning(spark, d).select("user_key", F.lit(True).alias("is_returning"))
    return fx.requests(spark, d).join(ret, "user_key", "left").withColumn("is_returning", F.coalesce("is_returning", F.lit(False)))


def placed(spark, d):
    """Places with the terms that hold for all requests."""
    out = universe(spark, d).select("location_id", "location_name", "categories", "primary_category", "popularity", "is_hot_spot_location", "is_favorite_location", "lat", "lon")
    return out.join(trend(spark, d).select("location_id", F.col("trending_score").alias("trending")), "location_id", "left").join(penalty(spark, d).select("location_id", "feedback_penalty"), "location_id", "left")


def scoring(spark, d, own):
    """Requests, places, similarities to the classes of places, and sparse terms by request and place."""
    item, session, near = own_terms(spark, d, own)
    r, places = asked(spark, d), placed(spark, d)
    mine = near.join(r.where("is_returning").select("user_key", "request_id"), "user_key").drop("user_key")
    first = rank.classes(places).select(F.col("class").alias("location_id"))
    sim = vectors.similarities(profiles(spark, d), vecs(spark, d).join(first, "location_id", "left_semi"))
    return r, places, sim, item.unionByName(session, True).unionByName(mine, True)


def pool_with(spark, d, own):
    """The top pool of each request, from classes of places instead of all pairs. own: the requests' seeds."""
    return rank.best_places(*scoring(spark, d, own), seen_places(spark, d).join(returning(spark, d).select("user_key"), "user_key", "left_semi"))


@step
def top_pool(spark, d):
    return pool_with(spark, d, seeds_of_requests(spark, d))


def masked(spark, d):
    """The pairs that a request may be answered with; they don't depend on scores."""
    r = fx.requests(spark, d)
    seen = seen_places(spark, d).join(returning(spark, d).select("user_key"), "user_key", "left_semi")
    gone = written(r.join(seen, "user_key").select("request_id", "location_id"), "seen_by_requests")
    return rank.candidates(r, universe(spark, d).select("location_id", "categories"), gone)


@query("r01_candidates", f"WITH {q.REQUESTS}, {q.LOCATIONS} SELECT request_id, location_id FROM req, fx_locations")
def r01(spark, d):
    return rank.expand_candidates(fx.requests(spark, d).select("request_id"), fx.locations(spark, d).select("location_id"))


@query("r02_seeds", f"{FULL} SELECT request_id, location_id, source FROM sds")
def r02(spark, d):
    return seeds_of_requests(spark, d)


SCORE_COLS = "request_id, location_id, round(sim,6) AS sim, round(popularity,6) AS popularity, round(item_collab,6) AS item_collab, round(user_collab,6) AS user_collab, round(trending,6) AS trending, round(session,6) AS session, round(final_score,6) AS final_score"


@query("r03_final_score", f"{FULL} SELECT {SCORE_COLS} FROM fin")
def r03(spark, d):
    return scored(spark, d, six).select("request_id", "location_id", *rank.TERMS, six("final_score").alias("final_score"))


@query("r04_feedback_penalty", f"WITH {q.EVENTS}, {q.LOCATIONS}, {PENALTY} SELECT location_id, n, round(feedback_penalty,6) AS feedback_penalty FROM pen")
def r04(spark, d):
    return penalty(spark, d).withColumn("feedback_penalty", r6("feedback_penalty"))


@query("r05_category_mask", f"WITH {q.REQUESTS}, {q.LOCATIONS} SELECT request_id, location_id FROM req, fx_locations WHERE NOT list_has_any([primary_category, brand], avoid_categories) AND (len(interests)=0 OR list_has_any([primary_category, brand], interests))")
def r05(spark, d):
    return rank.candidates(fx.requests(spark, d), categories(spark, d))


@query("r06_unseen", f"{FULL} SELECT request_id, location_id FROM msk")
def r06(spark, d):
    return masked(spark, d).select("request_id", "location_id")


POOLED = "pl AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS nm, row_number() OVER (PARTITION BY request_id ORDER BY round(final_score,6) DESC, location_id) AS pool_rank FROM msk)"


@query("r07_top_pool", f"{FULL}, {POOLED} SELECT request_id, location_id, pool_rank FROM pl WHERE pool_rank<=greatest(60,2*least(nm,greatest(4*top_k,top_k+20)))")
def r07(spark, d):
    return top_pool(spark, d).select("request_id", "location_id", F.col("pool_rank").cast("long").alias("pool_rank"))


DOT = "coalesce(list_sum(list_transform(vs, lambda x: coalesce(list_sum(list_transform(list_filter(pv, lambda y: y.token=x.token), lambda y: x.w*y.w)), 0))), 0)"
MMR = f"""{POOLED}, vl AS (SELECT location_id, list({{'token': token, 'w': w}}) AS vs FROM vec GROUP BY 1),
mp AS (SELECT request_id, pl.location_id, round(final_score,6) AS s, least(nm,greatest(4*top_k,top_k+20)) AS target, vs FROM pl JOIN vl ON vl.location_id=pl.location_id WHERE pool_rank<=greatest(60,2*least(nm,greatest(4*top_k,top_k+20)))),
walk AS (SELECT request_id, location_id, s, target, vs, 0::DOUBLE AS near, NULL::BIGINT AS mmr_rank, 0::BIGINT AS n FROM mp UNION ALL SELECT request_id, location_id, s, target, vs, greatest(near, {DOT}) AS near, CASE WHEN location_id=p THEN n+1 ELSE mmr_rank END AS mmr_rank, n+1 AS n FROM (SELECT *, first_value(location_id) OVER w AS p, first_value(vs) OVER w AS pv FROM walk WHERE n<target WINDOW w AS (PARTITION BY request_id ORDER BY mmr_rank IS NOT NULL, round(0.7*s-0.3*near,9) DESC, s DESC, location_id)))"""


@query("r08_mmr", f"{FULL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {MMR} SELECT request_id, location_id, max(mmr_rank) AS mmr_rank FROM walk WHERE mmr_rank IS NOT NULL GROUP BY 1,2")
def r08(spark, d):
    return rank.mmr(top_pool(spark, d), vecs(spark, d))


DEDUP = f"{POOLED}, nk AS (SELECT *, trim(regexp_replace(replace(lower(location_name),'&',' and '),'[^a-z0-9]+',' ','g')) AS nkey FROM pl), d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, nkey ORDER BY pool_rank) AS n1 FROM nk) WHERE n1=1), slate AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pool_rank) AS place FROM d1) WHERE place<=top_k)"


@step
def slate(spark, d):
    """Ranked slate without MMR (the SQL-checkable chain)."""
    pool = top_pool(spark, d)
    first = rank.unique_names(pool.select("request_id", "location_id", "location_name", "pool_rank", "top_k"), "pool_rank", F.col("top_k"))
    return pool.join(first.select("request_id", "location_id", "place"), ["request_id", "location_id"])  # a pool has a place once


@query("r09_unique_names", f"{FULL}, {DEDUP} SELECT request_id, location_id, location_name, place FROM slate")
def r09(spark, d):
    return slate(spark, d).select("request_id", "location_id", "location_name", F.col("place").cast("long").alias("place"))


@query("r10_recommend")
def r10(spark, d):
    """End to end: all terms, masks, MMR, unique names, evidence."""
    from ..functions import scalars as s

    pool = written(pool_with(spark, d, seeds_by_archetypes(spark, d)), "pool")
    picked = pool.join(rank.mmr(pool, vecs(spark, d)), ["request_id", "location_id"])
    inferred = vectors.inferred_interests(vectors.with_tag_signal(fx.requests(spark, d)))
    out = rank.unique_names(picked, "mmr_rank", F.col("top_k")).join(inferred, "request_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    reason = s.reason_sentence(F.col("categories"), F.col("primary_category"), F.coalesce("inferred", F.array().cast("array<string>")), zero("item_collab"), zero("popularity"), zero("trending"), F.col("is_hot_spot_location"))
    return out.select("request_id", F.col("place").cast("long").alias("place"), "location_id", "location_name", *[r6(zero(c)).alias(c) for c in (*rank.TERMS, "final_score")], reason.alias("reason"))


@query("r11_popular", f"{FULL} SELECT request_id, location_id, rank FROM fb")
def r11(spark, d):
    return rank.fallback_seeds(fx.requests(spark, d), universe(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("r12_look_up", f"WITH {q.EVENTS}, {q.LOCATIONS} SELECT e.event_id, e.location_id, location_name FROM (SELECT event_id, CASE WHEN event_id%9=0 THEN 'none' ELSE location_id END AS location_id FROM fx_events) e LEFT JOIN fx_locations l USING (location_id)")
def r12(spark, d):
    ids = fx.events(spark, d).select("event_id", F.when(F.col("event_id") % 9 == 0, "none").otherwise(F.col("location_id")).alias("location_id"))
    return rank.look_up(ids, fx.locations(spark, d).select("location_id", "location_name"))
