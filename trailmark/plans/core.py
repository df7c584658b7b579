"""Queries: scalars (P), quality (Q), frames (I, L, U, A), graphs (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import frames, graphs, quality
from ..sources import fixtures as fx
from ..sources import sql as q
from .base import effective, enriched, micros, query, r6, seen_places, site_events, step

ARRAY = "array_to_string({}, '|')"


# ---------------------------------------------------------------- scalars
@query("p01_split_categories", f"WITH {q.LOCATIONS} SELECT location_id, array_to_string(list_filter(list_transform(string_split(location_category_name,';'), lambda x: trim(x)), lambda x: x<>''),'|') AS parts, len(list_filter(list_transform(string_split(location_category_name,';'), lambda x: trim(x)), lambda x: x<>'')) AS n FROM fx_locations")
def p01(spark, d):
    parts = s.split_categories(F.col("location_category_name"))
    return fx.locations(spark, d).select("location_id", F.array_join(parts, "|").alias("parts"), F.size(parts).cast("long").alias("n"))


@query("p02_clean_ids", "SELECT page_id, nullif(trim(CAST(page_id AS VARCHAR)),'') AS id_text, nullif(trim(substr(url,1,page_id%9)),'') AS cut FROM pages")
def p02(spark, d):
    return fx.table(spark, d, "pages").select("page_id", s.clean_id(F.col("page_id")).alias("id_text"), s.clean_id(F.substring("url", F.lit(1), (F.col("page_id") % 9).cast("int"))).alias("cut"))


@query("p03_clean_strings_numbers", "SELECT event_id, coalesce(trim(props),'') AS props, coalesce(TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE),0.0) AS k, coalesce(TRY_CAST(event_type AS DOUBLE),-1.0) AS bad FROM events")
def p03(spark, d):
    return fx.table(spark, d, "events").select("event_id", s.clean_string(F.col("props")).alias("props"), s.number(F.get_json_object("props", "$.k")).alias("k"), s.number(F.col("event_type"), -1.0).alias("bad"))


@query("p04_first_non_empty", "SELECT p_brand, coalesce(min_by(trim(p_name), p_partkey) FILTER (p_size%3=0 AND trim(p_name)<>''),'') AS first_name FROM part GROUP BY 1")
def p04(spark, d):
    p = fx.table(spark, d, "part").withColumn("n", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(""))
    return s.first_non_empty(p, ["p_brand"], "n", ["p_partkey"], "first_name")


@query("p05_most_common", "WITH n AS (SELECT p_brand, trim(p_type) AS common_type, count(*) AS c FROM part WHERE trim(p_type)<>'' GROUP BY ALL) SELECT p_brand, common_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, common_type) AS r FROM n) WHERE r=1")
def p05(spark, d):
    return s.most_common(fx.table(spark, d, "part"), ["p_brand"], "p_type", "common_type")


@query("p06_category_union", """WITH x AS (SELECT p_name, p_partkey, p_type, p_brand FROM part), e AS (
 SELECT p_name, 0 AS k, p_partkey AS o, 0 AS i, p_type AS c FROM x UNION ALL SELECT p_name, 0, p_partkey, 1, p_brand FROM x UNION ALL SELECT p_name, 1, p_partkey, 0, 'size'||(p_partkey%3) FROM x),
 f AS (SELECT p_name, c, min(struct_pack(k:=k,o:=o,i:=i)) AS a FROM e GROUP BY ALL) SELECT p_name, string_agg(c,'|' ORDER BY a) AS categories FROM f GROUP BY 1""")
def p06(spark, d):
    p = fx.table(spark, d, "part").select("p_name", "p_partkey", F.concat("p_type", F.lit("; "), "p_brand").alias("joined"), F.concat(F.lit("size"), (F.col("p_partkey") % 3).cast("string")).alias("primary"))
    return s.category_union(p, ["p_name"], "joined", "primary", ["p_partkey"]).select("p_name", F.array_join("categories", "|").alias("categories"))


@query("p07_min_max", "WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, round(CASE WHEN hi-lo<1e-9 THEN 0.0 ELSE (p_retailprice-lo)/(hi-lo) END,6) AS scaled, round(coalesce((p_size-min(p_size) OVER b)/nullif(max(p_size) OVER b-min(p_size) OVER b,0),0.0),6) AS by_brand FROM part, m WINDOW b AS (PARTITION BY p_brand)")
def p07(spark, d):
    p = s.min_max(s.min_max(fx.table(spark, d, "part"), "p_retailprice", "scaled"), "p_size", "by_brand", ["p_brand"])
    return p.select("p_partkey", r6("scaled").alias("scaled"), r6("by_brand").alias("by_brand"))


@query("p08_clip_flag", "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity,10.0),40.0) AS clipped, CASE WHEN l_discount>0 THEN 1 ELSE 0 END AS flag FROM lineitem")
def p08(spark, d):
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.clip(F.col("l_quantity"), 10.0, 40.0).alias("clipped"), s.flag(F.col("l_discount")).alias("flag"))


TOKEN = "CASE WHEN trim(regexp_replace(lower({0}),'[^a-z0-9]+','_','g'),'_')='' THEN 'unknown' ELSE trim(regexp_replace(lower({0}),'[^a-z0-9]+','_','g'),'_') END"
NAME = "trim(regexp_replace(replace(lower(coalesce({0},'')),'&',' and '),'[^a-z0-9]+',' ','g'))"


@query("p09_category_token", f"SELECT p_partkey, {TOKEN.format('p_brand')} AS brand_token, {TOKEN.format('p_name')} AS name_token FROM part")
def p09(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", s.category_token(F.col("p_brand")).alias("brand_token"), s.category_token(F.col("p_name")).alias("name_token"))


@query("p10_canonical_name", f"SELECT s_suppkey, {NAME.format('s_name')} AS key, {NAME.format(chr(39) + 'A&B ' + chr(39) + '||s_name')} AS joined FROM supplier")
def p10(spark, d):
    return fx.table(spark, d, "supplier").select("s_suppkey", s.canonical_name(F.col("s_name")).alias("key"), s.canonical_name(F.concat(F.lit("A&B "), "s_name")).alias("joined"))


@query("p11_geocode_key", "SELECT c_custkey, translate(trim(lower(' ‘'||c_name||'” ')),'‘’“”','''''''''') AS key FROM customer")
def p11(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", s.geocode_key(F.concat(F.lit(" ‘"), "c_name", F.lit("” "))).alias("key"))


@query("p12_optional_text", "WITH t AS (SELECT event_id, CASE event_id%6 WHEN 0 THEN ' nan ' WHEN 1 THEN '' WHEN 2 THEN 'N/A' WHEN 3 THEN ' Unknown' ELSE event_type END AS x FROM events) SELECT event_id, CASE WHEN trim(x)='' OR lower(trim(x))='nan' THEN NULL ELSE trim(x) END AS opt, CASE WHEN trim(x)='' OR lower(trim(x)) IN ('null','none','unknown','n/a') THEN NULL ELSE trim(x) END AS nul FROM t")
def p12(spark, d):
    k = F.col("event_id") % 6
    x = F.when(k == 0, " nan ").when(k == 1, "").when(k == 2, "N/A").when(k == 3, " Unknown").otherwise(F.col("event_type"))
    return fx.table(spark, d, "events").select("event_id", s.optional_text(x).alias("opt"), s.nullish(x).alias("nul"))


@query("p13_http_only", "WITH t AS (SELECT page_id, CASE WHEN page_id%3=0 THEN 'ftp://x' ELSE ' '||url END AS u FROM pages) SELECT page_id, CASE WHEN regexp_matches(lower(trim(u)),'^https?://') THEN trim(u) END AS url FROM t")
def p13(spark, d):
    return fx.table(spark, d, "pages").select("page_id", s.http_only(F.when(F.col("page_id") % 3 == 0, "ftp://x").otherwise(F.concat(F.lit(" "), "url"))).alias("url"))


@query("p14_deep_links", "WITH t AS (SELECT doc_id, md5(text) AS m FROM documents), u AS (SELECT doc_id, CASE WHEN doc_id%2=0 THEN m ELSE substr(m,1,8)||'-'||substr(m,9,4)||'-'||substr(m,13,4)||'-'||substr(m,17,4)||'-'||substr(m,21,12) END AS id FROM t) SELECT doc_id, CASE WHEN regexp_matches(id,'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN 'https://map.example/location/'||id END AS link FROM u")
def p14(spark, d):
    m = F.md5("text")
    cut = F.concat_ws("-", m.substr(1, 8), m.substr(9, 4), m.substr(13, 4), m.substr(17, 4), m.substr(21, 12))
    return fx.table(spark, d, "documents").select("doc_id", s.deep_link(F.when(F.col("doc_id") % 2 == 0, m).otherwise(cut), "https://map.example/location/").alias("link"))


@query("p15_pick_clamp", "SELECT o_orderkey, CASE WHEN lower(trim(o_orderpriority)) IN ('1-urgent','2-high') THEN lower(trim(o_orderpriority)) END AS picked, least(greatest(coalesce(TRY_CAST(substr(o_orderpriority,1,1) AS INTEGER),2),2),4) AS clamped, least(greatest(coalesce(TRY_CAST(o_orderstatus AS INTEGER),9),1),7) AS defaulted FROM orders")
def p15(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", s.pick(F.col("o_orderpriority"), ["1-urgent", "2-high"]).alias("picked"), s.clamp_int(F.substring("o_orderpriority", 1, 1), 2, 4, 2).alias("clamped"), s.clamp_int(F.col("o_orderstatus"), 1, 7, 9).alias("defaulted"))


@query("p16_map_search_url", f"WITH {q.LOCATIONS} SELECT location_id, 'https://www.google.com/maps/search/?api=1&query='||replace(replace(replace(location_name||', Springfield, IL',',','%2C'),'#','%23'),' ','+') AS url FROM fx_locations")
def p16(spark, d):
    return fx.locations(spark, d).select("location_id", s.map_search_url(F.col("location_name"), "Springfield, IL").alias("url"))


@query("p17_tagged_urls", "SELECT page_id, split_part(url,'#',1)||CASE WHEN contains(split_part(url,'#',1),'?') THEN '&' ELSE '?' END||'utm_source=trailmark&utm_medium=referral&rec_surface=top+picks&rec_rank='||(page_id%40)||CASE WHEN split_part(url,'#',2)<>'' THEN '#'||split_part(url,'#',2) ELSE '' END AS url FROM pages")
def p17(spark, d):
    return fx.table(spark, d, "pages").select("page_id", s.tagged_url(F.col("url"), "trailmark", F.lit("top picks"), F.col("page_id") % 40).alias("url"))


@query("p18_box_check", f"WITH {q.LOCATIONS} SELECT location_id, coalesce(lat BETWEEN 41.7 AND 42.0 AND lon BETWEEN -87.9 AND -87.6,false) AS inside, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180,false) AS valid FROM fx_locations")
def p18(spark, d):
    box = lambda a, b: s.in_box(F.col("lat"), F.col("lon"), a, b)
    return fx.locations(spark, d).select("location_id", box((41.7, 42.0), (-87.9, -87.6)).alias("inside"), box((-90.0, 90.0), (-180.0, 180.0)).alias("valid"))


KINDS = "CASE p_size%6 WHEN 0 THEN 'Bars' WHEN 1 THEN ' parks' WHEN 2 THEN 'Museums' WHEN 3 THEN 'Restaurants' WHEN 4 THEN 'Hot Spots' ELSE 'Zoo' END"


def kind():
    k = F.col("p_size") % 6
    return F.when(k == 0, "Bars").when(k == 1, " parks").when(k == 2, "Museums").when(k == 3, "Restaurants").when(k == 4, "Hot Spots").otherwise("Zoo")


@query("p19_blurbs", f"SELECT p_partkey, CASE lower(trim({KINDS})) WHEN 'bars' THEN 'A go-to spot for drinks and a night out.' WHEN 'parks' THEN 'Green space for a walk, views, or downtime.' WHEN 'museums' THEN 'A museum worth a couple of hours.' WHEN 'restaurants' THEN 'A local dining pick.' WHEN 'hot spots' THEN 'A high-energy spot trending with visitors.' ELSE 'A noteworthy stop.' END AS blurb FROM part")
def p19(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", s.blurb(kind()).alias("blurb"))


@query("p20_evidence", "SELECT p_partkey, (CASE WHEN p_partkey%4=0 THEN 'No prior engagement, content match only.' ELSE (p_partkey%4)||CASE WHEN p_partkey%4=1 THEN ' user' ELSE ' users' END||' engaged here; '||p_size||' interactions; ~'||printf('%.1f',round_even(p_retailprice/1000,1))||'s avg dwell' END)||CASE WHEN p_size>=30 THEN '; trending' ELSE '' END AS summary FROM part")
def p20(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", s.evidence_summary(F.col("p_partkey") % 4, F.col("p_size"), F.col("p_retailprice"), F.col("p_size") / 50).alias("summary"))


@query("p21_reasons", """WITH t AS (SELECT p_partkey, p_type, p_brand, p_size, [p_type,p_brand] AS cats, CASE p_partkey%3 WHEN 0 THEN [lower(p_brand)] WHEN 1 THEN [p_type] ELSE [] END AS inf, (p_partkey%10)/10.0 AS c, (p_partkey%7)/7.0 AS pop, (p_partkey%5)/5.0 AS tr FROM part)
 SELECT p_partkey, CASE WHEN b='' THEN 'good content-based match' ELSE b END AS reason FROM (SELECT p_partkey, concat_ws('; ', CASE p_partkey%3 WHEN 0 THEN 'also covers your interest in '||p_brand WHEN 1 THEN 'matches your selected interests' END, CASE WHEN c>0.4 THEN 'co-visited with your seed locations by other users' END, CASE WHEN tr>=0.6 THEN 'engagement rising in the recent window' END, CASE WHEN p_size%10=0 AND tr<0.6 THEN 'currently a HOT SPOT' END, CASE WHEN pop>0.6 THEN 'popular with other users' END) AS b FROM t)""")
def p21(spark, d):
    k = F.col("p_partkey")
    inferred = F.when(k % 3 == 0, F.array(F.lower("p_brand"))).when(k % 3 == 1, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    return fx.table(spark, d, "part").select(k, s.reason_sentence(F.array("p_type", "p_brand"), F.col("p_type"), inferred, (k % 10) / 10, (k % 7) / 7, (k % 5) / 5, (F.col("p_size") % 10 == 0).cast("int")).alias("reason"))


@query("p22_rationale", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey%3=0 THEN 'It matches your '||p_type||' picks.' WHEN p_partkey%3=1 THEN 'Popular.' ELSE 'It scored highly against your profile and similar travelers.' END, CASE WHEN p_partkey%10 BETWEEN 1 AND 5 THEN 'Ranked #'||(p_partkey%10)||' in your list for this trip.' END, CASE WHEN p_size>30 THEN 'It''s trending on the map right now.' WHEN p_partkey%10 NOT BETWEEN 1 AND 5 THEN p_brand||'.' END], lambda x: x IS NOT NULL)[1:2],' ') AS why FROM part""")
def p22(spark, d):
    k = F.col("p_partkey")
    return fx.table(spark, d, "part").select(k, s.rationale(F.array("p_type"), F.when(k % 3 == 0, F.array("p_type")).otherwise(F.array(F.lit("x"))), k % 10, F.when(k % 3 == 1, "Popular"), F.col("p_brand"), F.col("p_size") > 30).alias("why"))


@query("p23_descriptions", f"""WITH t AS (SELECT p_partkey, {KINDS} AS c, p_size*2 AS u, p_partkey%2 AS h FROM part) SELECT p_partkey, array_to_string(list_filter(['Listed as '||c||'.', CASE WHEN h>0 THEN 'Marked as a hot spot.' END, CASE WHEN u>=50 THEN 'Strong community signal: '||u||'+ distinct visitors explored it.' END], lambda x: x IS NOT NULL),'|') AS highlights,
 array_to_string(list_filter(['Pair with other '||lower(c)||' stops nearby.','Confirm hours and tickets before you go.', CASE WHEN lower(c)='bars' THEN 'Best as an evening stop.' END, CASE WHEN lower(c)='parks' THEN 'Morning works well for photos and walks.' END, CASE WHEN lower(c)='museums' THEN 'Budget at least 90 minutes.' END], lambda x: x IS NOT NULL),'|') AS tips FROM t""")
def p23(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", F.array_join(s.highlights(kind(), F.col("p_size") * 2, F.col("p_partkey") % 2), "|").alias("highlights"), F.array_join(s.tips(kind()), "|").alias("tips"))


@query("p24_truncate", "SELECT doc_id, CASE WHEN length(text)>120 THEN left(text,117)||'...' ELSE text END AS t120, CASE WHEN length(text)>90 THEN left(text,87)||'...' ELSE text END AS t90 FROM documents")
def p24(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", s.truncate(F.col("text"), 120).alias("t120"), s.truncate(F.col("text"), 90).alias("t90"))


@query("p25_engagement_context", f"WITH {q.EVENTS}, {q.LOCATIONS}, a AS (SELECT location_id, count(DISTINCT user_key) AS users, count(*) AS interactions, count(DISTINCT session_key) AS sessions, avg(coalesce(engagement_time_msec_capped,0)) AS m FROM fx_events GROUP BY 1) SELECT location_id, users, interactions, sessions, is_hot_spot_location>0 AS hot, round_even(m/1000,1) AS dwell_sec FROM a JOIN fx_locations USING (location_id)")
def p25(spark, d):
    e = fx.events(spark, d).groupBy("location_id").agg(F.count_distinct("user_key").alias("distinct_users"), F.count("*").alias("interactions"), F.count_distinct("session_key").alias("sessions"), F.avg(F.coalesce("engagement_time_msec_capped", F.lit(0.0))).alias("avg_dwell_msec"))
    return s.engagement_context(e.join(fx.locations(spark, d), "location_id"))


# ---------------------------------------------------------------- quality
@query("q01_recommender_traffic", f"WITH {q.EVENTS} SELECT contains(lower(page_location),'utm_source=site_recommender') AS dropped, count(*) AS n FROM fx_events GROUP BY 1")
def q01(spark, d):
    e = fx.events(spark, d)
    return e.groupBy(quality.from_recommender(e, quality.Policy().markers).alias("dropped")).agg(F.count("*").alias("n"))


@query("q02_long_sessions", f"WITH {q.EVENTS} SELECT event_id, session_key FROM fx_events WHERE session_key IN (SELECT session_key FROM fx_events GROUP BY 1 HAVING count(*)<=6)")
def q02(spark, d):
    return quality.drop_long_sessions(fx.events(spark, d), 6).select("event_id", "session_key")


@query("q03_dwell", f"WITH {q.EVENTS} SELECT event_id, round(greatest(coalesce(engagement_time_msec_capped,0),0),6) AS dwell FROM fx_events")
def q03(spark, d):
    e = fx.events(spark, d)
    return e.select("event_id", r6(quality.dwell_used(e)).alias("dwell"))


def _classified(policy):
    def run(spark, d):
        return quality.enrich(fx.events(spark, d), quality.Policy(policy)).select("event_id", "is_qualified", "qualify_reason", r6("quality_weight").alias("quality_weight"))

    return run


for _name, _policy in (("q04_classify_events", "balanced"), ("q04_classify_permissive", "permissive"), ("q04_classify_strict", "strict")):
    query(_name, f"WITH {q.EVENTS}, {q.KEPT}, {q.classified(_policy)} SELECT event_id, is_qualified, qualify_reason, round(quality_weight,6) AS quality_weight FROM classed")(_classified(_policy))


@query("q05_quality_weight", f"WITH {q.EVENTS}, {q.KEPT}, {q.classified()} SELECT event_name, qualify_reason, count(*) AS n, round(sum(quality_weight),6) AS total FROM classed GROUP BY 1,2")
def q05(spark, d):
    return enriched(spark, d).groupBy("event_name", "qualify_reason").agg(F.count("*").alias("n"), r6(F.sum("quality_weight")).alias("total"))


@query("q06_effective_scores", f"WITH {q.QUALIFIED} SELECT user_key, location_id, round(effective_score,6) AS effective_score, n_qualified_events, is_qualified FROM effective")
def q06(spark, d):
    return effective(spark, d).select("user_key", "location_id", r6("effective_score").alias("effective_score"), "n_qualified_events", "is_qualified")


INTER = "inter AS (SELECT user_key, location_id, count(*) AS n, sum(coalesce(interaction_weight,0.5)) AS score, avg(coalesce(interaction_weight,0.5)) AS avg_score, sum(coalesce(engagement_time_msec_capped,0)) AS dwell, min(event_time) AS t0, max(event_time) AS t1 FROM fx_events GROUP BY ALL)"


@query("q07_qualified_interactions", f"WITH {q.QUALIFIED}, {INTER}, j AS (SELECT i.user_key, i.location_id, score, dwell, CASE WHEN hash_part THEN NULL ELSE effective_score END AS es FROM (SELECT *, CAST(substr(location_id,2) AS INTEGER)%10=0 AS hash_part FROM inter) i LEFT JOIN effective e USING (user_key, location_id)), k AS (SELECT *, CASE WHEN es IS NOT NULL THEN es>=1.5 ELSE dwell>=1000 OR score>=3 END AS is_qualified FROM j) SELECT user_key, location_id, is_qualified, round(CASE WHEN is_qualified THEN coalesce(es,score,1.0) ELSE 0.0 END,6) AS profile_weight FROM k")
def q07(spark, d):
    scores = effective(spark, d).where("cast(substr(location_id, 2) as int) % 10 != 0")
    return quality.qualify_interactions(frames.interactions_from_events(fx.events(spark, d)), scores).select("user_key", "location_id", "is_qualified", r6("profile_weight").alias("profile_weight"))


@query("q08_returning_users", f"WITH {q.QUALIFIED} SELECT user_key, count(*) AS n_places FROM effective WHERE is_qualified GROUP BY 1 HAVING count(*)>=14")
def q08(spark, d):
    return quality.returning_users(effective(spark, d), quality.Policy(min_places_returning=14))


@query("q09_modelling_events", f"WITH {q.EVENTS}, {q.KEPT}, {q.classified()} SELECT event_id, user_key, location_id FROM classed WHERE quality_weight>0")
def q09(spark, d):
    return quality.modelling_events(enriched(spark, d)).select("event_id", "user_key", "location_id")


@query("q10_daily_cap", f"WITH {q.EVENTS} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_key, event_name, CAST(event_time AS DATE) ORDER BY event_time, event_id) AS r FROM fx_events) WHERE r<=1")
def q10(spark, d):
    return quality.cap_daily(fx.events(spark, d).withColumn("location_id", F.col("event_name")), 1).select("event_id")


@query("q11_engagement_report", f"WITH {q.QUALIFIED}, u AS (SELECT user_key, count_if(is_qualified) AS n FROM effective GROUP BY 1) SELECT 'raw_events' AS metric, CAST(count(*) AS DOUBLE) AS value FROM fx_events UNION ALL SELECT 'kept_events', count(*) FROM classed UNION ALL SELECT 'qualified_events', count_if(is_qualified) FROM classed UNION ALL SELECT 'returning_users', count_if(n>=2) FROM u UNION ALL SELECT 'users_without', count_if(n=0) FROM u UNION ALL SELECT 'qualified_percent', round((SELECT count_if(is_qualified) FROM classed)/(SELECT count(*) FROM fx_events)*100,6) UNION ALL SELECT 'reason:'||qualify_reason, count(*) FROM classed GROUP BY qualify_reason")
def q11(spark, d):
    e = enriched(spark, d)
    return quality.report(fx.events(spark, d), e, quality.effective_scores(e)).select("metric", r6("value").alias("value"))


def _policy_sql():
    parts = []
    for p in ("permissive", "balanced", "strict"):
        parts.append(q.classified(p, f"c_{p}"))
        parts.append(f"e_{p} AS (SELECT user_key, location_id, sum(m)>=1.5 AS ok FROM (SELECT user_key, location_id, session_key, max(quality_weight) AS m FROM c_{p} GROUP BY ALL) GROUP BY ALL)")
    rows = [f"SELECT '{p}' AS policy, count_if(coalesce(x.ok,false)) AS qualified_pairs, count(DISTINCT CASE WHEN x.ok THEN x.user_key END) AS qualified_users, count_if(coalesce(x.ok,false)<>coalesce(b.ok,false)) AS flag_flips, round(count_if(coalesce(x.ok,false) AND coalesce(b.ok,false))/greatest(count_if(coalesce(x.ok,false) OR coalesce(b.ok,false)),1),6) AS pair_jaccard FROM e_{p} x FULL JOIN e_balanced b ON x.user_key=b.user_key AND x.location_id=b.location_id" for p in ("permissive", "balanced", "strict")]
    return f"WITH {q.EVENTS}, {q.KEPT}, " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


@query("q12_policy_comparison", _policy_sql())
def q12(spark, d):
    return quality.compare_policies(fx.events(spark, d))


def _top_sql(policies):
    parts = [q.EVENTS, q.KEPT]
    for p in ("balanced", *policies):
        parts.append(q.classified(p, f"c_{p}"))
        parts.append(f"t_{p} AS (SELECT user_key, location_id FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY round(s,6) DESC, location_id) AS r FROM (SELECT user_key, location_id, sum(m) AS s FROM (SELECT user_key, location_id, session_key, max(quality_weight) AS m FROM c_{p} GROUP BY ALL) GROUP BY ALL) WHERE s>=1.5) WHERE r<=10)")
    rows = [f"SELECT '{p}' AS policy, coalesce(a.user_key,b.user_key) AS user_key, count_if(a.user_key IS NOT NULL AND b.user_key IS NOT NULL) AS overlap, round(count_if(a.user_key IS NOT NULL AND b.user_key IS NOT NULL)/count(*),6) AS jaccard FROM t_balanced a FULL JOIN t_{p} b ON a.user_key=b.user_key AND a.location_id=b.location_id GROUP BY 2" for p in policies]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


@query("q12_top10_overlap", _top_sql(("permissive", "strict")))
def q12_top(spark, d):
    return quality.top_overlap(fx.events(spark, d)).withColumn("jaccard", r6("jaccard"))


def _size_sql(policies):
    parts = [q.EVENTS, q.KEPT]
    for p in policies:
        parts.append(q.classified(p, f"c_{p}"))
        parts.append(f"p_{p} AS (SELECT DISTINCT session_key, location_id FROM c_{p} WHERE quality_weight>0), g_{p} AS (SELECT DISTINCT x.location_id AS src, y.location_id AS dst FROM p_{p} x JOIN p_{p} y ON x.session_key=y.session_key AND x.location_id<>y.location_id)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT '{p}' AS policy, count(DISTINCT src) AS places, count(*) AS edges FROM g_{p}" for p in policies)


@query("q12_graph_sizes", _size_sql(("permissive", "balanced", "strict")))
def q12_sizes(spark, d):
    return quality.graph_sizes(fx.events(spark, d))


@query("q13_qualified_rows", f"WITH {q.QUALIFIED}, {INTER} SELECT user_key, location_id, n FROM inter SEMI JOIN (SELECT * FROM effective WHERE is_qualified) e USING (user_key, location_id)")
def q13(spark, d):
    i = quality.qualify_interactions(frames.interactions_from_events(fx.events(spark, d)), effective(spark, d))
    return quality.qualified_rows(i.where("effective_score is not null")).select("user_key", "location_id", F.col("total_interactions_with_location").alias("n"))


# ---------------------------------------------------------------- frames
@query("i01_interactions_latest", f"WITH {q.EVENTS} SELECT user_key, location_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_key, location_id ORDER BY event_time DESC, event_id DESC) AS r FROM fx_events) WHERE r=1")
def i01(spark, d):
    return frames.interactions_from_features(fx.events(spark, d), ["event_time", "event_id"]).select("user_key", "location_id", "event_id")


@query("i02_interactions", f"WITH {q.EVENTS}, {INTER} SELECT user_key, location_id, n, round(score,6) AS score, round(avg_score,6) AS avg_score, round(dwell,4) AS dwell, epoch_us(t0) AS t0, epoch_us(t1) AS t1 FROM inter")
def i02(spark, d):
    i = frames.interactions_from_events(fx.events(spark, d))
    return i.select("user_key", "location_id", F.col("total_interactions_with_location").alias("n"), r6("total_interaction_score").alias("score"), r6("avg_interaction_score").alias("avg_score"), F.round("total_location_engagement_msec_capped", 4).alias("dwell"), micros("first_interaction_time").alias("t0"), micros("last_interaction_time").alias("t1"))


FEATURES = f"{q.EVENTS}, {INTER}, feats AS (SELECT user_key, location_id, score AS total_location_score_all_users, dwell AS eng, n FROM inter)"


def _features(spark, d):
    i = frames.interactions_from_events(fx.events(spark, d))
    names = fx.table(spark, d, "part").select(F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("location_id"), F.col("p_name").alias("location_name"), F.col("p_type").alias("primary_category"))
    i = i.join(names, "location_id")
    return i.select("user_key", "location_id", "location_name", "primary_category", F.col("total_interaction_score").alias("total_location_score_all_users"), F.col("total_location_engagement_msec_capped").alias("avg_location_engagement_all_users_msec_capped"), F.col("total_interactions_with_location").alias("total_user_interactions"), F.col("first_interaction_time").alias("first_seen_time"), F.col("last_interaction_time").alias("last_seen_time"), F.when(F.col("total_interactions_with_location") > 1, F.col("primary_category")).alias("city"))


@query("l01_locations_from_features", f"WITH {FEATURES}, g AS (SELECT location_id, max(total_location_score_all_users) AS pop, max(eng) AS eng FROM feats GROUP BY 1), m AS (SELECT min(pop) AS a, max(pop) AS b, min(eng) AS c, max(eng) AS e FROM g WHERE location_id IN (SELECT 'L'||p_partkey FROM part)) SELECT location_id, p_name AS location_name, p_type AS primary_category, round(pop,6) AS popularity_raw, round(CASE WHEN b-a<1e-9 THEN 0.0 ELSE (pop-a)/(b-a) END,6) AS popularity_norm, round(CASE WHEN e-c<1e-9 THEN 0.0 ELSE (eng-c)/(e-c) END,6) AS engagement_norm FROM g JOIN part ON location_id='L'||p_partkey, m")
def l01(spark, d):
    return frames.locations_from_features(_features(spark, d)).select("location_id", "location_name", "primary_category", r6("popularity_raw").alias("popularity_raw"), r6("popularity_norm").alias("popularity_norm"), r6("engagement_norm").alias("engagement_norm"))


PRIORS = "priors AS (SELECT location_id, count(*) AS interactions, count(DISTINCT user_key) AS users, count(DISTINCT session_key) AS sessions, sum(coalesce(interaction_weight,0.5)) AS score, avg(coalesce(interaction_weight,0.5)) AS avg_score, count_if(event_name='map-user-action') AS markers, count_if(contains(event_name,'detail') OR contains(event_name,'cta')) AS ctas, avg(coalesce(engagement_time_msec_capped,0)) AS eng FROM fx_events GROUP BY 1), scaled AS (SELECT *, CASE WHEN max(score) OVER ()-min(score) OVER ()<1e-9 THEN 0.0 ELSE (score-min(score) OVER ())/(max(score) OVER ()-min(score) OVER ()) END AS pop, CASE WHEN max(eng) OVER ()-min(eng) OVER ()<1e-9 THEN 0.0 ELSE (eng-min(eng) OVER ())/(max(eng) OVER ()-min(eng) OVER ()) END AS engn FROM priors)"


def _priors(df):
    return df.select("location_id", F.col("total_location_interactions_all_users").cast("long").alias("interactions"), F.col("distinct_users_interacted_location").cast("long").alias("users"), F.col("distinct_sessions_interacted_location").cast("long").alias("sessions"), r6("total_location_score_all_users").alias("score"), F.col("total_marker_clicks_all_users").cast("long").alias("markers"), F.col("total_detail_cta_all_users").cast("long").alias("ctas"), r6("popularity_norm").alias("pop"), r6("engagement_norm").alias("engn"))


PRIOR_COLS = "interactions, users, sessions, round(score,6) AS score, markers, ctas, round(pop,6) AS pop, round(engn,6) AS engn"


@query("l02_location_priors", f"WITH {q.EVENTS}, {PRIORS} SELECT location_id, {PRIOR_COLS} FROM scaled")
def l02(spark, d):
    return _priors(frames.locations_from_events(fx.events(spark, d)))


@query("l03_locations_from_dim", f"WITH {q.LOCATIONS} SELECT location_id, location_name, 'Attractions' AS primary_category, 0.0::DOUBLE AS popularity_norm FROM fx_locations")
def l03(spark, d):
    return frames.locations_from_dim(fx.locations(spark, d)).select("location_id", "location_name", "primary_category", "popularity_norm")


@query("l04_universe", f"WITH {q.EVENTS}, {q.LOCATIONS}, {PRIORS} SELECT l.location_id, l.location_name, coalesce(interactions,0) AS interactions, coalesce(users,0) AS users, coalesce(sessions,0) AS sessions, round(coalesce(score,0.0),6) AS score, coalesce(markers,0) AS markers, coalesce(ctas,0) AS ctas, round(coalesce(pop,0.0),6) AS pop, round(coalesce(engn,0.0),6) AS engn, s.location_id IS NOT NULL AS observed, 'official' AS source, round(lat,6) AS lat, round(lon,6) AS lon FROM fx_locations l LEFT JOIN scaled s USING (location_id)")
def l04(spark, d):
    loc = fx.locations(spark, d)
    u = frames.expand_universe(loc.select("location_id", "location_name"), frames.locations_from_events(fx.events(spark, d)).withColumn("location_name", F.lit("")), loc.select("location_id", "lat", "lon"))
    keep = u.select("location_id", "location_name", "observed", "source", r6("lat").alias("lat"), r6("lon").alias("lon"))
    return _priors(u).join(keep, "location_id")


@query("u01_users_from_features", f"WITH {FEATURES} SELECT user_key, max(n) AS total_user_interactions, epoch_us(min(t0)) AS first_seen, epoch_us(max(t1)) AS last_seen, min_by(p_type, location_id) FILTER (n>1) AS city FROM inter JOIN part ON location_id='L'||p_partkey GROUP BY 1")
def u01(spark, d):
    return frames.users_from_features(_features(spark, d)).select("user_key", "total_user_interactions", micros("first_seen_time").alias("first_seen"), micros("last_seen_time").alias("last_seen"), "city")


@query("u02_users", f"WITH {q.EVENTS}, {INTER} SELECT user_key, CAST(sum(n) AS BIGINT) AS total_user_interactions, count(DISTINCT location_id) AS distinct_locations_interacted, round(sum(score),6) AS score, round(avg(avg_score),6) AS avg_score FROM inter GROUP BY 1")
def u02(spark, d):
    return frames.users_from_interactions(frames.interactions_from_events(fx.events(spark, d))).select("user_key", "total_user_interactions", "distinct_locations_interacted", r6("total_user_interaction_score").alias("score"), r6("avg_user_interaction_score").alias("avg_score"))


@step(write=False)
def categories(spark, d):
    return frames.place_categories(fx.locations(spark, d), ["location_id"])


@query("a01_categories", f"WITH {q.LOCATIONS} SELECT primary_category AS category FROM fx_locations UNION SELECT brand FROM fx_locations")
def a01(spark, d):
    return frames.distinct_categories(categories(spark, d))


@query("a02_observed_counts", f"WITH {q.EVENTS}, {q.LOCATIONS} SELECT count(*) AS n_official, count_if(location_id IN (SELECT location_id FROM fx_events)) AS n_observed FROM fx_locations")
def a02(spark, d):
    return frames.observed_counts(frames.expand_universe(fx.locations(spark, d).select("location_id", "location_name"), frames.locations_from_events(fx.events(spark, d)).withColumn("location_name", F.lit(""))))


@query("a03_reconciliation", f"WITH {q.QUALIFIED}, a AS (SELECT location_id, count(*) AS raw_events, count(DISTINCT user_key) AS raw_users FROM fx_events GROUP BY 1), b AS (SELECT location_id, count(*) AS clean_events, count(DISTINCT user_key) AS clean_users FROM classed WHERE quality_weight>0 GROUP BY 1) SELECT coalesce(a.location_id,b.location_id) AS location_id, coalesce(raw_events,0) AS raw_events, coalesce(raw_users,0) AS raw_users, coalesce(clean_events,0) AS clean_events, coalesce(clean_users,0) AS clean_users, round(abs(coalesce(raw_events,0)-coalesce(clean_events,0))/greatest(coalesce(raw_events,0),coalesce(clean_events,0),1),6) AS rel_diff, greatest(coalesce(raw_events,0),coalesce(clean_events,0))>=5 AND abs(coalesce(raw_events,0)-coalesce(clean_events,0))/greatest(coalesce(raw_events,0),coalesce(clean_events,0),1)>=0.5 AS warn FROM a FULL JOIN b ON a.location_id=b.location_id")
def a03(spark, d):
    r = frames.reconcile(fx.events(spark, d), quality.modelling_events(enriched(spark, d)))
    return r.withColumn("rel_diff", r6("rel_diff"))


@query("a04_health", f"WITH {q.QUALIFIED} SELECT 'events' AS metric, count(*) AS value FROM fx_events UNION ALL SELECT 'users', count(DISTINCT user_key) FROM fx_events UNION ALL SELECT 'locations', count(*) FROM fx_locations UNION ALL SELECT 'qualified_pairs', count_if(is_qualified) FROM effective")
def a04(spark, d):
    e = fx.events(spark, d)
    return frames.health({"events": e, "users": e.select("user_key").distinct(), "locations": fx.locations(spark, d), "qualified_pairs": effective(spark, d).where("is_qualified")})


@query("a05_user_labels", f"WITH {q.EVENTS}, {q.LOCATIONS}, {INTER}, c AS (SELECT user_key, location_id, unnest([primary_category, brand]) AS category FROM inter JOIN fx_locations USING (location_id)), n AS (SELECT user_key, category, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT user_key, string_agg(category,', ' ORDER BY r) AS tops FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY n DESC, category) AS r FROM n) WHERE r<=3 GROUP BY 1), p AS (SELECT user_key, count(*) AS n_locations, sum(score) AS total_score FROM inter GROUP BY 1) SELECT user_key, n_locations, round(total_score,6) AS total_score, user_key||' ('||tops||', '||n_locations||' places)' AS label FROM p JOIN t USING (user_key)")
def a05(spark, d):
    return frames.user_labels(frames.interactions_from_events(fx.events(spark, d)), categories(spark, d)).select("user_key", "n_locations", r6("total_score").alias("total_score"), "label")


# ---------------------------------------------------------------- graphs
def jaccard_sql(pairs: str, out: str = "jac") -> str:
    return f"{out}_p AS ({pairs}), {out}_n AS (SELECT i, count(*) AS n FROM {out}_p GROUP BY 1), {out}_b AS (SELECT x.i AS src, y.i AS dst, count(*) AS nb FROM {out}_p x JOIN {out}_p y ON x.b=y.b AND x.i<>y.i GROUP BY ALL), {out} AS (SELECT src, dst, nb/(s.n+t.n-nb) AS weight FROM {out}_b JOIN {out}_n s ON s.i=src JOIN {out}_n t ON t.i=dst)"


ITEM = jaccard_sql("SELECT DISTINCT user_key AS b, location_id AS i FROM seen")
SESSION = jaccard_sql("SELECT DISTINCT session_key AS b, location_id AS i FROM classed WHERE quality_weight>0 AND location_id IN (SELECT location_id FROM fx_locations)")
EDGE = "src, dst, round(weight,6) AS weight"


@query("b01_item_jaccard", f"WITH {q.QUALIFIED}, {q.SEEN}, {ITEM} SELECT {EDGE} FROM jac")
def b01(spark, d):
    return graphs.jaccard_pairs(seen_places(spark, d), "user_key", "location_id").withColumn("weight", r6("weight"))


@query("b01_basket_jaccard", f"WITH {q.BASKETS}, {jaccard_sql('SELECT DISTINCT session_key AS b, location_id AS i FROM fx_baskets')} SELECT {EDGE} FROM jac")
def b01_baskets(spark, d):
    return graphs.jaccard_pairs(fx.baskets(spark, d), "session_key", "location_id").withColumn("weight", r6("weight"))


@query("b02_session_jaccard", f"WITH {q.QUALIFIED}, {SESSION} SELECT {EDGE} FROM jac")
def b02(spark, d):
    e = quality.drop_long_sessions(quality.modelling_events(enriched(spark, d)))
    return graphs.jaccard_pairs(e, "session_key", "location_id", fx.locations(spark, d)).withColumn("weight", r6("weight"))


MOVES = "moved AS (SELECT *, lag(location_id) OVER (PARTITION BY session_key ORDER BY event_time, event_id) AS prev FROM classed), mw AS (SELECT prev AS src, location_id AS dst, sum(CASE event_name WHEN 'map-user-action' THEN 1.5 WHEN 'scroll' THEN 0.3 ELSE 1.0 END)::DOUBLE AS w FROM moved WHERE prev IS NOT NULL AND prev<>location_id AND prev IN (SELECT location_id FROM fx_locations) AND location_id IN (SELECT location_id FROM fx_locations) GROUP BY ALL), trans AS (SELECT src, dst, w/sum(w) OVER (PARTITION BY src) AS weight FROM mw)"


@query("b03_transitions", f"WITH {q.QUALIFIED}, {MOVES} SELECT {EDGE} FROM trans")
def b03(spark, d):
    return graphs.transitions(fx.with_previous(enriched(spark, d)), fx.locations(spark, d)).withColumn("weight", r6("weight"))


@query("b04_previous_location", f"WITH {q.EVENTS} SELECT event_id, lag(location_id) OVER (PARTITION BY session_key ORDER BY event_time, event_id) AS previous_location_id FROM fx_events")
def b04(spark, d):
    return fx.with_previous(fx.events(spark, d)).select("event_id", "previous_location_id")


SEEDS = "seeds AS (SELECT user_key AS request_id, location_id FROM seen)"


def seeds(spark, d):
    return seen_places(spark, d).select(F.col("user_key").alias("request_id"), "location_id")


@query("b05_edge_scores", f"WITH {q.QUALIFIED}, {q.SEEN}, {ITEM}, {SEEDS}, ns AS (SELECT request_id, count(*) AS n FROM seeds GROUP BY 1) SELECT s.request_id, dst AS location_id, round(sum(weight)/max(n),6) AS score FROM seeds s JOIN jac ON src=location_id JOIN ns USING (request_id) GROUP BY 1,2")
def b05(spark, d):
    edges = graphs.jaccard_pairs(seen_places(spark, d), "user_key", "location_id")
    return graphs.edge_scores(seeds(spark, d), edges, fx.locations(spark, d)).withColumn("score", r6("score"))


@query("b06_session_blend", f"WITH {q.QUALIFIED}, {q.SEEN}, {SESSION}, {MOVES}, {SEEDS}, ns AS (SELECT request_id, count(*) AS n FROM seeds GROUP BY 1), a AS (SELECT s.request_id, dst AS location_id, sum(weight)/max(n) AS v FROM seeds s JOIN jac ON src=location_id JOIN ns USING (request_id) GROUP BY 1,2), b AS (SELECT s.request_id, dst AS location_id, sum(weight)/max(n) AS v FROM seeds s JOIN trans ON src=location_id JOIN ns USING (request_id) GROUP BY 1,2), u AS (SELECT request_id, location_id, 0.6*v/max(v) OVER (PARTITION BY request_id) AS v FROM a UNION ALL SELECT request_id, location_id, 0.4*v/max(v) OVER (PARTITION BY request_id) FROM b) SELECT request_id, location_id, round(sum(v),6) AS score FROM u GROUP BY 1,2")
def b06(spark, d):
    loc, e = fx.locations(spark, d), enriched(spark, d)
    jac = graphs.jaccard_pairs(quality.drop_long_sessions(quality.modelling_events(e)), "session_key", "location_id", loc)
    moves = graphs.transitions(fx.with_previous(e), loc)
    own = seeds(spark, d)
    return graphs.session_blend(graphs.edge_scores(own, jac, loc), graphs.edge_scores(own, moves, loc)).withColumn("score", r6("score"))


TREND = "ev AS (SELECT location_id, epoch_us(event_time)::DOUBLE AS t, quality_weight AS w FROM classed WHERE quality_weight>0), tc AS (SELECT median(t) AS cut FROM ev), ts AS (SELECT location_id, count(*) AS n_events, sum(CASE WHEN t<cut THEN w ELSE 0 END) AS early, sum(CASE WHEN t>=cut THEN w ELSE 0 END) AS late FROM ev, tc GROUP BY 1), tr AS (SELECT *, ln(1+(late+1)/(early+1)) AS raw FROM ts WHERE n_events>=3), trend AS (SELECT location_id, n_events, early, late, CASE WHEN max(raw) OVER ()-min(raw) OVER ()<1e-9 THEN 0.0 ELSE (raw-min(raw) OVER ())/(max(raw) OVER ()-min(raw) OVER ()) END AS trending_score FROM tr UNION ALL SELECT location_id, n_events, early, late, 0.0 FROM ts WHERE n_events<3)"


@step
def trend(spark, d):
    return graphs.trending(quality.modelling_events(site_events(spark, d)))


@query("b07_trending", f"WITH {q.QUALIFIED}, {TREND} SELECT location_id, n_events, round(early,6) AS early, round(late,6) AS late, round(trending_score,6) AS trending_score FROM trend")
def b07(spark, d):
    return trend(spark, d).select("location_id", "n_events", r6("early").alias("early"), r6("late").alias("late"), r6("trending_score").alias("trending_score"))


@query("b08_top_trending", f"WITH {q.QUALIFIED}, {TREND} SELECT location_id, location_name, round(trending_score,6) AS trending_score FROM trend JOIN fx_locations USING (location_id) WHERE trending_score>0 ORDER BY 3 DESC, 1 LIMIT 10")
def b08(spark, d):
    names = fx.locations(spark, d).select("location_id", "location_name")
    return graphs.top_trending(trend(spark, d), names, 10).select("location_id", "location_name", r6("trending_score").alias("trending_score"))
