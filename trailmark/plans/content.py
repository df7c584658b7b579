"""Queries: media and page text (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media as m
from ..sources import fixtures as fx
from .base import query

K = "p_partkey"
SRC = "['site','Wiki','yelp','web','openverse','other','official','tripadvisor'][p_partkey%8+1]"
ITEM_URL = "CASE WHEN p_partkey%8=5 AND p_partkey%3=0 THEN 'https://www.youtube.com/watch?v=abc'||p_partkey||'defgh' WHEN p_partkey%5=0 THEN 'https://upload.wikimedia.org/'||p_partkey||'.jpg' ELSE 'HTTPS://Img.Example.com/p'||(p_partkey%40)||'.jpg?x='||p_partkey END"
TYPE = "CASE WHEN p_partkey%8=5 AND p_partkey%3=0 THEN 'video' ELSE 'image' END"
ITEMS = f"items AS (SELECT 'L'||(p_partkey%97) AS location_id, p_partkey AS pos, {SRC} AS source, {ITEM_URL} AS url, {TYPE} AS type, p_brand AS attribution FROM part)"
CLASS = "CASE WHEN s IN ('yelp','tripadvisor','openverse') THEN 'fallback' WHEN s IN ('web','llm') THEN 'denied' WHEN s IN ('site','official','wikipedia','wikimedia','youtube') THEN 'safe' WHEN contains(url,'.wikimedia.org/') OR contains(url,'youtube') THEN 'safe' ELSE 'denied' END"
CLASSED = f"{ITEMS}, named AS (SELECT *, CASE WHEN lower(source)='wiki' THEN 'wikipedia' ELSE lower(source) END AS s FROM items), clsd AS (SELECT *, {CLASS} AS k FROM named)"
KEY = "lower(regexp_replace(regexp_replace(url,'#.*$',''),'\\?.*$',''))"


def items(spark, d):
    k = F.col(K)
    src = F.element_at(F.array(*map(F.lit, ("site", "Wiki", "yelp", "web", "openverse", "other", "official", "tripadvisor"))), (k % 8 + 1).cast("int"))
    video = (k % 8 == 5) & (k % 3 == 0)
    s = k.cast("string")
    url = F.when(video, F.concat(F.lit("https://www.youtube.com/watch?v=abc"), s, F.lit("defgh"))).when(k % 5 == 0, F.concat(F.lit("https://upload.wikimedia.org/"), s, F.lit(".jpg"))).otherwise(F.concat(F.lit("HTTPS://Img.Example.com/p"), (k % 40).cast("string"), F.lit(".jpg?x="), s))
    return fx.table(spark, d, "part").select(F.concat(F.lit("L"), (k % 97).cast("string")).alias("location_id"), k.alias("pos"), src.alias("source"), url.alias("url"), F.when(video, "video").otherwise("image").alias("type"), F.col("p_brand").alias("attribution"))


@query("m01_source_policy", f"WITH {CLASSED} SELECT pos, s AS source, k AS class FROM clsd")
def m01(spark, d):
    return items(spark, d).select("pos", m.source_name(F.col("source")).alias("source"), m.source_class(F.col("source"), F.col("url")).alias("class"))


@query("m02_fallback_media", f"WITH {CLASSED}, o AS (SELECT *, bool_or(k='safe') OVER (PARTITION BY location_id) AS anysafe, CASE WHEN k='safe' THEN 0 WHEN s='yelp' THEN 1 WHEN s='tripadvisor' THEN 2 ELSE 3 END AS pr FROM clsd WHERE k<>'denied') SELECT location_id, pos, row_number() OVER (PARTITION BY location_id ORDER BY pr, pos) AS place FROM o WHERE k='safe' OR NOT anysafe")
def m02(spark, d):
    return m.with_fallback(items(spark, d)).select("location_id", "pos", F.col("place").cast("long").alias("place"))


@query("m03_url_keys", "SELECT key, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, " + KEY + " AS key FROM pages) GROUP BY 1")
def m03(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", m.url_key(F.col("url")).alias("key"))
    n = p.groupBy("key").agg(F.count("*").alias("n"))
    return m.first_of(p, F.col("key"), ["page_id"]).join(n, "key")


@query("m04_exact_content", "SELECT min(doc_id) AS doc_id, sha1(text) AS digest FROM documents GROUP BY 2")
def m04(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("digest"))
    return m.first_of(docs, F.col("digest"), ["doc_id"])


AHASH = "ah AS (SELECT vec_id, label, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda x: CASE WHEN x::DOUBLE>=mu THEN 1::HUGEINT ELSE 0::HUGEINT END)), lambda a, b: a*2+b) AS hu FROM (SELECT *, list_sum(list_transform(embedding, lambda x: x::DOUBLE))/64 AS mu FROM embeddings)), hs AS (SELECT vec_id, label, CASE WHEN hu>=9223372036854775808 THEN (hu-18446744073709551616)::BIGINT ELSE hu::BIGINT END AS h FROM ah)"


def hashes(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", "label", m.average_hash(F.col("embedding")).alias("h"))


@query("m05_average_hash", f"WITH {AHASH} SELECT vec_id, h FROM hs")
def m05(spark, d):
    return hashes(spark, d).select("vec_id", "h")


NEARSQL = f"WITH {AHASH}, cp AS (SELECT vec_id AS id, h FROM hs UNION ALL SELECT vec_id+1000000, xor(h, (1::BIGINT << (vec_id%60)::INTEGER) | (vec_id%8)) FROM hs) SELECT a.id AS a, b.id AS b, bit_count(xor(a.h,b.h))::INTEGER AS distance FROM cp a JOIN cp b ON a.id<b.id AND bit_count(xor(a.h,b.h))<=6"


def copies(spark, d):
    """Hashes and slightly changed copies of them."""
    h = hashes(spark, d)
    moved = h.select((F.col("vec_id") + 1000000).alias("id"), F.expr("h ^ (shiftleft(1L, cast(vec_id % 60 as int)) | (vec_id % 8))").alias("h"))
    return h.select(F.col("vec_id").alias("id"), "h").unionByName(moved)


@query("m06_near_pairs", NEARSQL)
def m06(spark, d):
    return m.near_pairs(copies(spark, d))


KEEPSQL = f"""WITH RECURSIVE {AHASH}, cp AS (SELECT vec_id AS id, h FROM hs UNION ALL SELECT vec_id+1000000, xor(h, (1::BIGINT << (vec_id%60)::INTEGER) | (vec_id%8)) FROM hs),
it AS (SELECT id%50 AS grp, id, h, row_number() OVER (PARTITION BY id%50 ORDER BY id) AS n FROM cp),
fold AS (SELECT DISTINCT grp, 0::BIGINT AS n, []::STRUCT(id BIGINT, h BIGINT)[] AS kept FROM it UNION ALL SELECT f.grp, f.n+1, CASE WHEN len(list_filter(f.kept, lambda y: bit_count(xor(y.h, it.h))<=6))>0 THEN f.kept ELSE list_append(f.kept, {{'id': it.id, 'h': it.h}}) END FROM fold f JOIN it ON it.grp=f.grp AND it.n=f.n+1)
SELECT grp AS "group", k.id AS pos, k.h AS h FROM (SELECT grp, unnest(kept) AS k FROM (SELECT grp, max_by(kept, n) AS kept FROM fold GROUP BY grp))"""


@query("m06_keep_first", KEEPSQL)
def m06_keep(spark, d):
    return m.keep_first_similar(copies(spark, d).select((F.col("id") % 50).alias("group"), F.col("id").alias("pos"), "h"))


@query("m07_primary_media", f"WITH {ITEMS} SELECT location_id, min_by(url,pos) FILTER (type='image') AS image_url, min_by(url,pos) FILTER (type='video') AS video_url, coalesce(min_by(attribution,pos) FILTER (type='video'), min_by(attribution,pos) FILTER (type='image')) AS attribution FROM items GROUP BY 1")
def m07(spark, d):
    return m.primary_media(items(spark, d))


TEXTS = f"txt AS (SELECT location_id, 'see '||string_agg(url,' and ' ORDER BY pos)||' twice '||min_by(url,pos) AS body FROM (SELECT * FROM ({ITEMS[len('items AS ('):-1]})) GROUP BY 1)"


def texts(spark, d):
    own = items(spark, d).groupBy("location_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("p"))
    return own.select("location_id", F.concat(F.lit("see "), F.array_join(F.transform("p", lambda x: x["url"]), " and "), F.lit(" twice "), F.element_at("p", 1)["url"]).alias("body"))


@query("m08_media_urls", f"WITH {TEXTS}, u AS (SELECT location_id, 'image' AS type, unnest(list_distinct(regexp_extract_all(body,'https?://[^\\s\"''<>)]+\\.(?:jpe?g|png|webp|gif)'))) AS url FROM txt UNION ALL SELECT location_id, 'video', unnest(list_distinct(regexp_extract_all(body,'https?://(?:www\\.)?(?:youtube\\.com/watch\\?v=|youtu\\.be/)[A-Za-z0-9_-]{{6,}}'))) FROM txt) SELECT * FROM u")
def m08(spark, d):
    return m.media_urls(texts(spark, d), "body", "location_id").select("location_id", "type", "url")


@query("m09_video_links", f"WITH {ITEMS} SELECT pos, 'https://img.youtube.com/vi/'||nullif(regexp_extract(url,'(?:v=|youtu\\.be/|embed/)([A-Za-z0-9_-]{{6,}})',1),'')||'/hqdefault.jpg' AS thumbnail, 'https://www.youtube.com/watch?v='||nullif(regexp_extract(url,'(?:v=|youtu\\.be/|embed/)([A-Za-z0-9_-]{{6,}})',1),'') AS watch FROM items WHERE type='video'")
def m09(spark, d):
    thumb, watch = m.video_links(F.col("url"))
    return items(spark, d).where("type = 'video'").select("pos", thumb.alias("thumbnail"), watch.alias("watch"))


MAPS = "mp AS (SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN 'go https://m.example/@41.'||(p_partkey%900+100)||'25,-87.'||(p_partkey%700+100)||'75,15z' WHEN 1 THEN 'x!3d41.'||(p_partkey%900+100)||'25!4d-87.'||(p_partkey%700+100)||'75' ELSE 'at @41.9,-87.7 only' END AS body FROM part)"


@query("m10_coordinates", f"WITH {MAPS}, c AS (SELECT p_partkey, TRY_CAST(coalesce(nullif(regexp_extract(body,'@(-?\\d{{1,3}}\\.\\d{{4,}}),(-?\\d{{1,3}}\\.\\d{{4,}})',1),''),nullif(regexp_extract(body,'!3d(-?\\d{{1,3}}\\.\\d{{4,}})!4d(-?\\d{{1,3}}\\.\\d{{4,}})',1),'')) AS DOUBLE) AS lat, TRY_CAST(coalesce(nullif(regexp_extract(body,'@(-?\\d{{1,3}}\\.\\d{{4,}}),(-?\\d{{1,3}}\\.\\d{{4,}})',2),''),nullif(regexp_extract(body,'!3d(-?\\d{{1,3}}\\.\\d{{4,}})!4d(-?\\d{{1,3}}\\.\\d{{4,}})',2),'')) AS DOUBLE) AS lon FROM mp) SELECT p_partkey, CASE WHEN lat BETWEEN 41.5 AND 42.2 AND lon BETWEEN -88.1 AND -87.3 THEN lat END AS lat, CASE WHEN lat BETWEEN 41.5 AND 42.2 AND lon BETWEEN -88.1 AND -87.3 THEN lon END AS lon FROM c")
def m10(spark, d):
    k, s = F.col(K), lambda n: (F.col(K) % n + 100).cast("string")
    body = F.when(k % 3 == 0, F.concat(F.lit("go https://m.example/@41."), s(900), F.lit("25,-87."), s(700), F.lit("75,15z"))).when(k % 3 == 1, F.concat(F.lit("x!3d41."), s(900), F.lit("25!4d-87."), s(700), F.lit("75"))).otherwise("at @41.9,-87.7 only")
    c = m.coordinates(body, (41.5, 42.2), (-88.1, -87.3))
    return fx.table(spark, d, "part").select(k, c["lat"].alias("lat"), c["lon"].alias("lon"))


ADDR = "ad AS (SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN 'Meet at '||(c_custkey%900+1)||' N. Clark St or 12  S Lake Ave., not '||c_name||'; again 12 S Lake Ave' WHEN 1 THEN 'Address: '||(c_custkey%900+1)||' East Grand Avenue, Springfield, IL 60601. More: 7 w. hill rd, '||c_mktsegment WHEN 2 THEN (c_custkey%900+1)||' n main ave. and then 30 tickets at 40 Plaza; it is at 9 N. Main' ELSE (c_custkey%900+1)||' navy pier springfield il, floor 3 is 400 feet above 5 lake st' END AS body FROM customer)"
PLACE = ("Springfield", "IL", "Main")
FOUR = " || ".join("regexp_extract_all(body,'" + p.replace("'", "''") + "',1,'i')" for p in m.address_forms(*PLACE))
BARRED = " AND ".join(f"NOT contains(lower(a),'{w}')" for w in m.NO_ADDRESS)


@query("m11_addresses", f"WITH {ADDR}, t AS (SELECT c_custkey, regexp_replace(body,'\\s+',' ','g') AS body FROM ad), l AS (SELECT c_custkey, {FOUR} AS l FROM t), e AS (SELECT c_custkey, rtrim(trim(unnest(l)),'.,;') AS a, generate_subscripts(l,1) AS pos FROM l), u AS (SELECT c_custkey, a, min(pos) AS pos FROM e WHERE length(a) BETWEEN 1 AND 70 AND {BARRED} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN regexp_matches(a,'\\b[NSEW]\\.','i') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(a,'{m.STREET_KINDS}','i') THEN 2 ELSE 0 END + CASE WHEN contains(lower(a),'main') THEN 1 ELSE 0 END + CASE WHEN contains(lower(a),'springfield') THEN 1 ELSE 0 END DESC, pos) AS r FROM u) SELECT c_custkey, CASE WHEN contains(lower(a),'springfield') THEN a ELSE a||', Springfield, IL' END AS address, r FROM r WHERE r<=5")
def m11(spark, d):
    k = F.col("c_custkey")
    n = (k % 900 + 1).cast("string")
    body = F.when(k % 4 == 0, F.concat(F.lit("Meet at "), n, F.lit(" N. Clark St or 12  S Lake Ave., not "), F.col("c_name"), F.lit("; again 12 S Lake Ave")))
    body = body.when(k % 4 == 1, F.concat(F.lit("Address: "), n, F.lit(" East Grand Avenue, Springfield, IL 60601. More: 7 w. hill rd, "), F.col("c_mktsegment")))
    body = body.when(k % 4 == 2, F.concat(n, F.lit(" n main ave. and then 30 tickets at 40 Plaza; it is at 9 N. Main"))).otherwise(F.concat(n, F.lit(" navy pier springfield il, floor 3 is 400 feet above 5 lake st")))
    return m.addresses(fx.table(spark, d, "customer").select(k, body.alias("body")), "body", "c_custkey", *PLACE).withColumn("r", F.col("r").cast("long"))


TOKS = "list_filter(list_distinct(regexp_split_to_array(lower({0}),'[^a-z0-9]+')), lambda x: x<>'' AND x NOT IN ('the','of','and','at','in','a','an','to','for'))"


@query("m12_title_match", f"WITH nm AS (SELECT n_nationkey AS name_id, lower(p_name||' '||n_name) AS name, {TOKS.format(chr(34) + 'x' + chr(34))} AS nt FROM (SELECT n_nationkey, n_name, p_name, p_name||' '||n_name AS x FROM nation JOIN part ON p_partkey=n_nationkey+1)), tt AS (SELECT p_partkey AS title_id, lower(p_name||' '||p_brand) AS title, {TOKS.format(chr(34) + 'y' + chr(34))} AS tk FROM (SELECT *, p_name||' '||p_brand AS y FROM part)), j AS (SELECT name_id, title_id, name, title, len(nt) AS n, len(list_intersect(nt,tk)) AS hits FROM nm, tt) SELECT name_id, title_id, hits FROM j WHERE hits>0 AND (contains(title,name) OR contains(name,title) OR hits>=CASE WHEN n<=2 THEN n ELSE greatest(2,floor((3*n+4)/5)) END)")
def m12(spark, d):
    part = fx.table(spark, d, "part")
    n = fx.table(spark, d, "nation").join(part, F.col("p_partkey") == F.col("n_nationkey") + 1).select(F.col("n_nationkey").alias("name_id"), F.concat("p_name", F.lit(" "), "n_name").alias("name"))
    return m.title_match(n, part.select(F.col(K).alias("title_id"), F.concat("p_name", F.lit(" "), "p_brand").alias("title")))


@query("m13_page_identifies", "WITH b AS (SELECT item_id, 'the and of in' AS name FROM benchmark), d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, contains(t,'the big of') OR (contains(t,'big') AND contains(t,'thin')) AS named, CASE doc_id%3 WHEN 0 THEN contains(t,'the thin big') OR (contains(t,'thin') AND contains(t,'big')) WHEN 1 THEN contains(t,'thin big') OR (contains(t,'thin') AND contains(t,'big') AND contains(t,'old')) ELSE contains(t,'open') END AND contains(t,'with') AS identified FROM d")
def m13(spark, d):
    docs = fx.table(spark, d, "documents")
    low = F.lower("text")
    named = low.contains("the big of") | (low.contains("big") & low.contains("thin"))
    name = F.when(F.col("doc_id") % 3 == 0, "The Thin Big").when(F.col("doc_id") % 3 == 1, "Thin Big - Restaurant of Old").otherwise("Open near Water")
    return docs.select("doc_id", named.alias("named"), m.identifies(F.col("text"), name, "with").alias("identified"))


CARDS = "cards AS (SELECT location_id, list({'type':type,'source':source,'file':CASE WHEN pos%2=0 THEN 'f'||pos END,'url':url} ORDER BY pos) AS media FROM items GROUP BY 1)"


def cards(spark, d):
    own = items(spark, d).withColumn("file", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("f"), F.col("pos").cast("string"))))
    return own.groupBy("location_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("type", "source", "file", "url").alias("m")))), lambda x: x["m"]).alias("media"))


AUDIT = f"""WITH {ITEMS}, st AS (SELECT 'f'||p_partkey AS file, CASE WHEN p_partkey%8=5 AND p_partkey%3=0 THEN p_size*600000 WHEN p_partkey%22<>0 THEN p_size*1000 END AS bytes, CASE WHEN p_partkey%9<>0 THEN p_size*20 END AS width, 100+p_size*10 AS height FROM part WHERE p_partkey%11<>0),
it AS (SELECT *, CASE WHEN pos%2=1 OR pos%97%2=1 THEN 'f'||pos END AS file, substr(location_id,2)::INTEGER AS n, CASE WHEN lower(source)='wiki' THEN 'wikipedia' ELSE lower(source) END AS s FROM items),
g AS (SELECT location_id, any_value(n) AS n, count_if(type='image') AS imgs, count_if(type='image' AND file IS NOT NULL) AS filed, count_if(type='image' AND file IS NULL) AS bare, count_if(type='video') AS vids, count_if(s='official') AS own, count_if(s='official' AND type='video') AS ownv, min_by(file,pos) FILTER (type='image' AND file IS NOT NULL) AS ff, min_by(url,pos) FILTER (type='image') AS first_url FROM it GROUP BY 1),
c AS (SELECT *, CASE WHEN n%5=0 THEN 'f'||n END AS image_file, CASE WHEN n%4=0 THEN first_url END AS image_url, CASE WHEN n%7=0 THEN 'none' ELSE 'Official' END AS src, n%6=0 AS tried, CASE WHEN n%12=0 THEN n%24 WHEN n%9=0 THEN 0 END AS added FROM g),
bv AS (SELECT DISTINCT location_id FROM it LEFT JOIN st USING (file) WHERE type='video' AND file IS NOT NULL AND coalesce(bytes>=25000000,true))
SELECT location_id, (filed=0 AND image_file IS NULL) OR bare>0 OR (coalesce(image_url,'')<>'' AND image_file IS NULL) OR src='none' OR (own<=1 AND ownv=0) AS needs_refresh,
coalesce(st.bytes,0)<12000 OR coalesce(width*height<90000 OR least(width,height)<220, false) AND width IS NOT NULL OR bv.location_id IS NOT NULL OR src='none' AS low_quality,
NOT ((tried OR added IS NOT NULL) AND coalesce(added,0)=0) AND (filed>0 OR image_file IS NOT NULL) AND imgs<21 AND vids=0 AS needs_augmentation
FROM c LEFT JOIN st ON st.file=coalesce(ff,image_file) LEFT JOIN bv USING (location_id)"""


@query("m14_card_audit", AUDIT)
def m14(spark, d):
    """Cards of all items, most of them stored, and a store that lacks some files and cannot read others."""
    k, n = F.col(K), F.substring("location_id", 2, 9).cast("int")
    own = items(spark, d).withColumn("file", F.when((F.col("pos") % 2 == 1) | (F.col("pos") % 97 % 2 == 1), F.concat(F.lit("f"), F.col("pos").cast("string"))))
    media = own.groupBy("location_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("type", "source", "file", "url").alias("m")))), lambda x: x["m"]).alias("media"))
    first_url = F.try_element_at(F.filter("media", lambda x: x["type"] == "image"), F.lit(1))["url"]
    cards = media.select("location_id", "media", F.when(n % 5 == 0, F.concat(F.lit("f"), n.cast("string"))).alias("image_file"), F.when(n % 4 == 0, first_url).alias("image_url"), F.when(n % 7 == 0, "none").otherwise("Official").alias("media_source"), (n % 6 == 0).alias("augmentation_attempted"), F.when(n % 12 == 0, n % 24).when(n % 9 == 0, 0).alias("augmentation_added"))
    size = F.when((k % 8 == 5) & (k % 3 == 0), F.col("p_size") * 600000).when(k % 22 != 0, F.col("p_size") * 1000)
    store = fx.table(spark, d, "part").where(k % 11 != 0).select(F.concat(F.lit("f"), k.cast("string")).alias("file"), size.alias("bytes"), F.when(k % 9 != 0, F.col("p_size") * 20).alias("width"), (100 + F.col("p_size") * 10).alias("height"))
    return m.audit(cards, store, target=21)


@query("m15_denied_urls", "SELECT page_id, contains(lower(url),'casino') OR contains(lower(url),'blog') AS denied FROM pages")
def m15(spark, d):
    return fx.table(spark, d, "pages").select("page_id", m.denied_url(F.col("url"), ("casino", "blog")).alias("denied"))


@query("m16_search_url", "SELECT c_nationkey AS location_id, c_custkey AS pos FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_custkey%3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, c_custkey) AS r FROM customer) WHERE r=1")
def m16(spark, d):
    k = F.col("c_custkey")
    rows = fx.table(spark, d, "customer").select(F.col("c_nationkey").alias("location_id"), k.alias("pos"), F.when(k % 3 == 1, "site").when(k % 3 == 2, "map").otherwise("other").alias("kind"))
    return m.choose_search_url(rows).select("location_id", "pos")


MERGE = f"WITH {ITEMS}, kn AS (SELECT location_id, lower(split_part(url,'?',1)) AS key FROM items WHERE pos%7=0 AND type='image'), src AS (SELECT location_id, pos, url, pos%2 AS pr, lower(split_part(url,'?',1)) AS key FROM items WHERE type='image' AND pos%7<>0), fr AS (SELECT * FROM src ANTI JOIN kn USING (location_id, key)), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_id, key ORDER BY pr, pos) AS q FROM fr) WHERE q=1), rk AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY pr, pos) AS r FROM one) SELECT location_id, url, r FROM rk LEFT JOIN (SELECT location_id, count(*) AS have FROM kn GROUP BY 1) h USING (location_id) WHERE r<=least(3,3-coalesce(have,0))"


@query("m17_merge_candidates", MERGE)
def m17(spark, d):
    own = items(spark, d).where("type = 'image'")
    rest = own.where("pos % 7 != 0")
    return m.merge_candidates(own.where("pos % 7 = 0"), [rest.where("pos % 2 = 0"), rest.where("pos % 2 = 1")]).select("location_id", "url", F.col("r").cast("long").alias("r"))


@query("m18_attribution", f"WITH {CLASSED} SELECT pos, CASE s WHEN 'wikipedia' THEN 'Photo: Wikimedia Commons, '||attribution WHEN 'official' THEN 'Courtesy of '||attribution ELSE 'Via '||s END AS line FROM clsd")
def m18(spark, d):
    return items(spark, d).select("pos", m.attribution(F.col("source"), F.col("attribution")).alias("line"))


@query("m19_display_order", f"WITH {ITEMS}, one AS (SELECT *, CASE WHEN type='video' THEN url ELSE split_part(url,'?',1) END AS key FROM items), o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_id, type, key ORDER BY pos) AS q FROM one) WHERE q=1) SELECT location_id, type AS kind, url AS shown, row_number() OVER (PARTITION BY location_id ORDER BY CASE WHEN type='video' THEN 0 ELSE 1 END, pos) AS place FROM o1")
def m19(spark, d):
    return m.display_order(items(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("m20_localised_media", f"WITH {ITEMS}, {CARDS}, k AS (SELECT location_id, list_filter(media, lambda x: CASE WHEN x.type='image' THEN coalesce(x.file,'')<>'' ELSE coalesce(x.file,'')<>'' OR coalesce(x.url,'')<>'' END) AS media FROM cards) SELECT location_id, len(media)::INTEGER AS n_media, list_filter(media, lambda x: x.type='image')[1].file AS image_file, coalesce(list_filter(media, lambda x: x.type='video')[1].file, list_filter(media, lambda x: x.type='video')[1].url) AS video FROM k")
def m20(spark, d):
    return m.localised(cards(spark, d))
