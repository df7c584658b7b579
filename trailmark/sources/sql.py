"""SQL of the logical tables, as WITH clauses for the twins."""

from __future__ import annotations

EVENTS = """fx_events AS (SELECT event_id, 'u'||user_id AS user_key, 'L'||json_extract_string(props,'$.k') AS location_id,
 CASE event_type WHEN 'click' THEN 'map-user-action' WHEN 'purchase' THEN 'detail_cta' WHEN 'view' THEN 'page_view' WHEN 'error' THEN 'scroll' WHEN 'signup' THEN 'session_start' END AS event_name,
 ts AS event_time, CASE WHEN event_id%5<>0 THEN CAST(0.5+(event_id%4)*0.5 AS DOUBLE) END AS interaction_weight, value*20 AS engagement_time_msec_capped,
 CASE WHEN event_id%97=0 THEN 'https://site.example/?utm_source=site_recommender' ELSE 'https://site.example/' END AS page_location,
 'u'||user_id||'-'||strftime(ts,'%Y%m%d') AS session_key FROM events)"""
LOCATIONS = """fx_locations AS (SELECT 'L'||p_partkey AS location_id, p_name AS location_name, p_type||'; '||p_brand AS location_category_name, p_type AS primary_category, p_brand AS brand,
 CASE WHEN p_size%10=0 THEN 1 ELSE 0 END AS is_hot_spot_location, CASE WHEN p_size%7=0 THEN 1 ELSE 0 END AS is_favorite_location,
 CASE WHEN p_partkey%23<>0 THEN CAST(41.64 AS DOUBLE)+CAST(p_partkey*37%440 AS DOUBLE)/1000 END AS lat, CASE WHEN p_partkey%23<>0 THEN CAST(-87.95 AS DOUBLE)+CAST(p_partkey*61%430 AS DOUBLE)/1000 END AS lon
 FROM part)"""
BASKETS = """fx_baskets AS (SELECT o_custkey AS user_key, l_orderkey AS session_key, l_partkey AS location_id, l_linenumber AS position, o_orderdate AS event_time FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""
KEPT = """kept AS (SELECT * FROM fx_events WHERE NOT contains(lower(page_location),'utm_source=site_recommender') AND session_key IS NOT NULL AND session_key IN (SELECT session_key FROM fx_events WHERE NOT contains(lower(page_location),'utm_source=site_recommender') GROUP BY 1 HAVING count(*)<=200)),
dwelt AS (SELECT *, greatest(coalesce(engagement_time_msec_capped,0),0) AS dwell_used FROM kept)"""


def classified(policy: str = "balanced", name: str = "classed") -> str:
    """Q4 and Q5 under a policy."""
    strong, noise = "event_name IN ('map-user-action','detail_cta')", "event_name IN ('scroll','map-search','view_search_results','session_start')"
    soft = f"(NOT {noise} AND NOT {strong})"
    ok = {"balanced": f"({strong} OR ({soft} AND dwell_used>=500))", "permissive": f"({strong} OR ({soft} AND dwell_used>=500))", "strict": f"(({strong} AND dwell_used>=500) OR ({soft} AND dwell_used>=2000))"}[policy]
    dwell = {"balanced": "WHEN dwell_used>=1000 THEN 'dwell' WHEN dwell_used>=500 THEN 'dwell_soft'", "permissive": "WHEN dwell_used>=500 THEN 'dwell_soft'", "strict": "WHEN dwell_used>=2000 THEN 'dwell'"}[policy]
    why = f"CASE WHEN {strong} THEN 'strong' WHEN event_name='scroll' THEN 'scroll_noise' WHEN {noise} THEN 'nav_noise' {dwell} ELSE 'reject' END"
    weight = "coalesce(interaction_weight,0.5)*(CASE event_name WHEN 'map-user-action' THEN 1.5 WHEN 'scroll' THEN 0.3 ELSE 1.0 END)*(CASE WHEN event_name='page_view' AND dwell_used<1000 THEN least(greatest((dwell_used-500)/500,0.2),1.0) ELSE 1.0 END)"
    return f"{name} AS (SELECT *, {ok} AS is_qualified, {why} AS qualify_reason, CASE WHEN {ok} THEN CAST({weight} AS DOUBLE) ELSE 0.0 END AS quality_weight FROM dwelt)"


EFFECTIVE = """per_session AS (SELECT user_key, location_id, session_key, max(quality_weight) AS m FROM classed GROUP BY ALL),
effective AS (SELECT user_key, location_id, sum(m) AS effective_score, count_if(m>0) AS n_qualified_events, sum(m)>=1.5 AS is_qualified FROM per_session GROUP BY ALL)"""
QUALIFIED = ",\n".join([EVENTS, LOCATIONS, KEPT, classified(), EFFECTIVE])
SEEN = "seen AS (SELECT user_key, location_id, effective_score FROM effective WHERE is_qualified AND location_id IN (SELECT location_id FROM fx_locations))"
REQUESTS = """req AS (SELECT 'r'||user_id||'-'||v AS request_id, CASE WHEN v<2 THEN 'u'||user_id END AS user_key, CASE v WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['ECONOMY','PROMO'] ELSE ['STANDARD'] END AS interests, CASE WHEN v=1 THEN ['Brand#11'] ELSE []::VARCHAR[] END AS avoid_categories, CAST(user_id%7+1 AS INTEGER) AS trip_days, 20 AS top_k,
 ['chill','foodie','nightlife'][user_id%3+1] AS vibe, CASE WHEN user_id%2=1 THEN 'family' ELSE 'solo' END AS traveler_type, CASE WHEN v=2 THEN 'Art and deep dish' END AS free_text FROM (SELECT DISTINCT user_id, user_id%3 AS v FROM events))"""
TFIDF = """cats AS (SELECT location_id, unnest([primary_category, brand]) AS category FROM fx_locations),
tok AS (SELECT location_id, trim(regexp_replace(lower(category),'[^a-z0-9]+','_','g'),'_') AS token, count(*) AS tf FROM cats GROUP BY ALL),
idf AS (SELECT token, ln((1+(SELECT count(DISTINCT location_id) FROM tok))/(1+count(DISTINCT location_id)))+1 AS idf FROM tok GROUP BY 1),
raww AS (SELECT location_id, token, tf*idf AS w FROM tok JOIN idf USING (token)),
vec AS (SELECT location_id, token, w/sqrt(sum(w*w) OVER (PARTITION BY location_id)) AS w FROM raww)"""
BEHAVIOUR = """bsh AS (SELECT user_key, location_id, greatest(effective_score,0.1)/sum(greatest(effective_score,0.1)) OVER (PARTITION BY user_key) AS s FROM seen),
braw AS (SELECT user_key, token, sum(s*w) AS w FROM bsh JOIN vec USING (location_id) GROUP BY ALL), beh AS (SELECT user_key, token, w/sqrt(sum(w*w) OVER (PARTITION BY user_key)) AS w FROM braw)"""


def form() -> str:
    """V3 over req."""
    from ..operators.vectors import HINTS, TRAVELERS, VIBES

    quoted = lambda t: "'" + t + "'"
    table = lambda d: ", ".join(f"({quoted(k)},{i},{quoted(c)},{w})" for k, cats in d.items() for i, (c, w) in enumerate(cats.items()))
    hints = ", ".join(f"({quoted(k)},{n * 10 + i},{quoted(c)})" for n, (k, cats) in enumerate(HINTS.items()) for i, c in enumerate(cats))
    return f"""vt(k,o,c,w) AS (VALUES {table(VIBES)}), tt(k,o,c,w) AS (VALUES {table(TRAVELERS)}), ht(k,o,c) AS (VALUES {hints}),
fw0 AS (SELECT request_id, generate_subscripts(interests,1) AS o, unnest(interests) AS category, 1.0::DOUBLE AS w FROM req UNION ALL SELECT request_id, 100+o, c, w::DOUBLE FROM req JOIN vt ON lower(vibe)=k UNION ALL SELECT request_id, 200+o, c, w::DOUBLE FROM req JOIN tt ON lower(traveler_type)=k UNION ALL SELECT request_id, 300+o, c, 0.5::DOUBLE FROM req JOIN ht ON contains(lower(coalesce(free_text,'')),k)),
fw AS (SELECT request_id, category, sum(w) AS w, min(o) AS o FROM fw0 GROUP BY ALL),
ftf AS (SELECT request_id, trim(regexp_replace(lower(category),'[^a-z0-9]+','_','g'),'_') AS token, sum(greatest(round_even(round(w*3,9),0),1)) AS tf FROM fw GROUP BY ALL),
fraw AS (SELECT request_id, token, tf*idf AS w FROM ftf JOIN idf USING (token)), form AS (SELECT request_id, token, w/sqrt(sum(w*w) OVER (PARTITION BY request_id)) AS w FROM fraw)"""


PROFILE = """asked AS (SELECT request_id FROM req WHERE len(interests)>0 OR trim(coalesce(free_text,''))<>''),
pu AS (SELECT request_id, token, 0.6*w AS w FROM req JOIN beh USING (user_key) UNION ALL SELECT request_id, token, 0.4*w FROM form SEMI JOIN asked USING (request_id)),
pr0 AS (SELECT request_id, token, sum(w) AS w FROM pu GROUP BY ALL), prof AS (SELECT request_id, token, w/sqrt(sum(w*w) OVER (PARTITION BY request_id)) AS w FROM pr0),
simt AS (SELECT request_id, location_id, sum(p.w*v.w) AS sim FROM prof p JOIN vec v USING (token) GROUP BY ALL)"""
