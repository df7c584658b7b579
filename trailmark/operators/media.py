"""Media items and page text: source policy, de-duplication, extraction, matching, audits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written

# Kinds of sources.
SAFE = ("site", "official", "wikipedia", "wikimedia", "youtube")
FALLBACK = ("yelp", "tripadvisor", "openverse")
DENIED = ("web", "llm")
IMAGE_URL = r"https?://[^\s\"'<>)]+\.(?:jpe?g|png|webp|gif)"
VIDEO_URL = r"https?://(?:www\.)?(?:youtube\.com/watch\?v=|youtu\.be/)[A-Za-z0-9_-]{6,}"
VIDEO_ID = r"(?:v=|youtu\.be/|embed/)([A-Za-z0-9_-]{6,})"
STREET_KINDS = r"Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Road|Rd\.?|Drive|Dr\.?|Way|Place|Plaza|Court|Ct\.?|Lane|Ln\.?|Highway|Hwy\.?"
NO_ADDRESS = ("more info", " is ", "ticket", "tilt", "optional", "last entry", "feet above")
# fixed values: words that tell no place apart, parts of urls that are maps or page furniture
GENERAL_WORDS = ("the", "a", "an", "and", "or", "of", "at", "in", "on", "for", "by", "hotel", "hotels", "restaurant", "restaurants", "illinois", "il", "usa", "co", "company", "llc", "inc")
DENIED_PARTS = ("story/images/basemap", "maps.googleapis.com", "maps.gstatic.com", "google.com/maps", "webgl_logo")
# fixed values: least area, shorter side and bytes of an image, greatest bytes of a video
IMAGE_AREA, IMAGE_SIDE, IMAGE_BYTES, VIDEO_BYTES = 90_000, 220, 12_000, 25_000_000
STOP_WORDS = ("the", "of", "and", "at", "in", "a", "an", "to", "for")


def source_name(c: Column) -> Column:
    """M1"""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("wiki", "wikimedia commons"), "wikipedia").otherwise(t)


def source_class(source: Column, url: Column) -> Column:
    """M1: safe, fallback or denied; unknown sources by the url's host."""
    s, host = source_name(source), F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.when(s.isin(*FALLBACK), "fallback").when(s.isin(*DENIED), "denied").when(s.isin(*SAFE), "safe").when(host.endswith(".wikimedia.org") | host.contains("youtube") | (host == "youtu.be"), "safe").otherwise("denied")


def with_fallback(items: DataFrame) -> DataFrame:
    """M2: safe items; where a place has none, its fallback items by priority. items: (location_id, pos, source, url)."""
    k = source_class(F.col("source"), F.col("url"))
    own = items.withColumn("_k", k).where("_k != 'denied'").withColumn("_any", F.max(F.col("_k") == "safe").over(W.partitionBy("location_id")))
    order = F.when(F.col("_k") == "safe", 0).otherwise(reduce(lambda acc, x: F.when(source_name(F.col("source")) == x[1], x[0]).otherwise(acc), enumerate(FALLBACK, 1), F.lit(9)))
    kept = own.where((F.col("_k") == "safe") | ~F.col("_any")).withColumn("priority", order)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("location_id").orderBy("priority", "pos"))).drop("_k", "_any", "priority")


def url_key(url: Column) -> Column:
    """M3: scheme and host in lower case and path; no query, no fragment."""
    u = F.trim(url)
    host = F.try_parse_url(u, F.lit("HOST"))
    return F.lower(F.when(host.isNotNull(), F.concat(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("://"), host, F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")))).otherwise(u))


def first_of(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """M3, M4: first row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def average_hash(values: Column) -> Column:
    """M5: 64 bits, first value highest: value at least the mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x.cast("double") >= mean, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    """M6"""
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(hashes: DataFrame, most: int = 6, bands: int = 9, group: str | None = None) -> DataFrame:
    """M6: pairs (a, b, distance) of hashes(id, h) within `most` bits, of one group if a group column is named.

    Of `bands` parts of 64 bits at least bands - most are equal in such a pair, so it meets under every combination of so many parts that agree
    (9 parts, 3 at a time: 84 keys of 21 bits, each far rarer than one part of 7). A pair is told under the first combination only.
    Both sides are sorted and merged: Spark takes the 84-fold rows for as few as there were before and would send them all through the driver.
    """
    take = bands - most
    assert take >= 1
    lows = [64 * k // bands for k in range(bands + 1)]
    parts = lambda h: F.array(*[F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(lows, lows[1:], strict=False)])
    every = F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(bands), take)])
    own = hashes.select("id", "h", (F.col(group) if group else F.lit(0)).alias("g"), parts(F.col("h")).alias("p"), F.explode(every).alias("c"))
    own = own.select("id", "h", "g", "c", F.xxhash64("g", "c", F.transform("c", lambda i: F.get("p", i))).alias("key"))
    a, b = own.alias("a"), own.alias("b")
    hit = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.id") < F.col("b.id")))
    d = hamming(F.col("a.h"), F.col("b.h"))
    agree = F.filter(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.get(parts(F.col("a.h")), i) == F.get(parts(F.col("b.h")), i))
    return hit.where(d <= most).where(F.slice(agree, 1, take) == F.col("a.c")).where(F.col("a.c") == F.col("b.c")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.alias("distance"))


def keep_first_similar(items: DataFrame, most: int = 6) -> DataFrame:
    """M6: of each group's items in order (group, pos, h) those within `most` bits of a kept one before them go.

    A fixed point over the near pairs: in each round items without an undecided near one before them are kept and those near
    to them go, until all are decided. Of equal hashes in a group only the first can stay, so they are folded first. No group is one task's,
    and no list of items is broadcast.
    """
    first = written(items.groupBy("group", "h").agg(F.min("pos").alias("pos")).withColumn("id", F.struct("group", "pos")), "first_items")
    edges = written(near_pairs(first, most, group="group").select("a", "b"), "near_edges")
    gone = [edges.select(F.col("b").alias("id")).where("false")]
    while not edges.isEmpty():
        kept = edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")).hint("merge"), "id", "left_anti")
        out = written(edges.join(kept.withColumnRenamed("id", "a").hint("merge"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "near_dropped")
        gone.append(out)
        done = kept.unionByName(out)
        left = edges.join(done.withColumnRenamed("id", "a").hint("merge"), "a", "left_anti").join(out.withColumnRenamed("id", "b").hint("merge"), "b", "left_anti")
        edges = written(left.select("a", "b"), "near_edges")
    return first.join(reduce(DataFrame.unionByName, gone).hint("merge"), "id", "left_anti").select("group", "pos", "h")


def primary_media(items: DataFrame) -> DataFrame:
    """First image and first video of each place; attribution of the video, else the image."""
    of = lambda c, kind: F.min_by(c, F.when(F.col("type") == kind, F.col("pos")))
    only = lambda c, kind: F.when(F.count_if(F.col("type") == kind) > 0, of(c, kind))
    return items.groupBy("location_id").agg(only("url", "image").alias("image_url"), only("url", "video").alias("video_url"), F.coalesce(only("attribution", "video"), only("attribution", "image")).alias("attribution"))


def media_urls(pages: DataFrame, text: str, key: str) -> DataFrame:
    """M8: (key, type, pos, url): ordered distinct image and video urls of a text."""
    urls = lambda p: F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)))
    both = pages.select(key, F.posexplode(urls(IMAGE_URL)).alias("pos", "url")).withColumn("type", F.lit("image"))
    return both.unionByName(pages.select(key, F.posexplode(urls(VIDEO_URL)).alias("pos", "url")).withColumn("type", F.lit("video")))


def video_links(url: Column) -> tuple[Column, Column]:
    """M9: thumbnail and watch url."""
    v = F.nullif(F.regexp_extract(url, VIDEO_ID, 1), F.lit(""))
    return F.concat(F.lit("https://img.youtube.com/vi/"), v, F.lit("/hqdefault.jpg")), F.concat(F.lit("https://www.youtube.com/watch?v="), v)


def coordinates(text: Column, lats: tuple[float, float], lons: tuple[float, float]) -> Column:
    """First pair in the box from map links: @lat,lon or !3dlat!4dlon, with four decimals or more (fewer tell no place)."""
    at = lambda p, g: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda x: x.cast("double"))
    pairs = F.concat(*[F.arrays_zip(at(p, 1).alias("lat"), at(p, 2).alias("lon")) for p in (r"@(-?\d{1,3}\.\d{4,}),(-?\d{1,3}\.\d{4,})", r"!3d(-?\d{1,3}\.\d{4,})!4d(-?\d{1,3}\.\d{4,})")])
    return F.try_element_at(F.filter(pairs, lambda x: x["lat"].between(*lats) & x["lon"].between(*lons)), F.lit(1))


def address_forms(city: str, state: str, avenue: str) -> tuple[str, ...]:
    """M11, fixed values: patterns (group 1, any case) of addresses on the main avenue, with a direction, of any street, and before the city's name."""
    number, side, words, town = r"\d{1,5}\s+", r"[NSEW]\.?\s+", r"[\w\s\.'\-]", rf"{city},?\s*{state}(?:\s+\d{{5}})?"
    return (
        rf"({number}{side}{avenue}(?:\s+Ave(?:nue)?\.?)?)",
        rf"({number}{side}{words}{{2,40}}?(?:{STREET_KINDS})\.?)",
        rf"(?:Located at|Address[:\s]+|at\s+)?({number}(?:{side})?{words}+?(?:{STREET_KINDS})(?:\s*,?\s*{town})?)",
        rf"({number}{words}+?,?\s*{town})",
    )


def addresses(pages: DataFrame, text: str, key: str, city: str, state: str, avenue: str, top: int = 5) -> DataFrame:
    """(key, address, r): valid street addresses of a text, best first, then by form and place; the city is added where it isn't named.

    Points: 3 a direction with a dot, 2 a kind of street, 1 the avenue, 1 the city. Valid ones have at most 70 characters and no words of
    NO_ADDRESS. A text without any (or null) gives no row. All within a row: no shuffle.
    """
    body, low = F.regexp_replace(F.col(text), r"\s+", " "), F.lower
    valid = lambda x: reduce(lambda a, w: a & ~low(x).contains(w), NO_ADDRESS, (F.length(x) <= 70) & (F.length(x) > 0))
    every = F.concat(*[F.transform(F.regexp_extract_all(body, F.lit(f"(?i){p}"), F.lit(1)), lambda x: F.rtrim(F.trim(x), F.lit(".,;"))) for p in address_forms(city, state, avenue)])
    point = lambda c, n: F.when(c, n).otherwise(0)
    points = lambda x: point(x.rlike(r"(?i)\b[NSEW]\."), 3) + point(x.rlike(f"(?i){STREET_KINDS}"), 2) + point(low(x).contains(avenue.lower()), 1) + point(low(x).contains(city.lower()), 1)
    ranked = F.array_sort(F.transform(F.array_distinct(F.filter(every, valid)), lambda x, i: F.struct((-points(x)).alias("p"), i.alias("i"), x.alias("a"))))
    named = F.transform(F.slice(ranked, 1, top), lambda x: F.when(low(x["a"]).contains(city.lower()), x["a"]).otherwise(F.concat(x["a"], F.lit(f", {city}, {state}"))))
    return pages.select(key, F.posexplode(named).alias("r", "address")).select(key, "address", (F.col("r") + 1).alias("r"))


def name_tokens(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")), F.array(*map(F.lit, STOP_WORDS)))


def by_rarity(side: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, size, at, tok): a row's tokens, the rarest of seen(tok, df) first; tokens that weren't seen come before all."""
    own = side.select("id", F.explode("toks").alias("tok")).join(seen.hint("merge"), "tok", "left")
    order = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tok"))).alias("o"))
    return order.select("id", F.size("o").alias("size"), F.posexplode("o").alias("at", "o")).select("id", "size", "at", "o.tok")


def overlap_need(n: Column) -> Column:
    """Tokens that must agree: all of up to two, else max(2, floor((3n + 4) / 5))."""
    return F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.floor((3 * n + 4) / 5).cast("int")))


def containing(inner: DataFrame, outer: DataFrame, q: int) -> DataFrame:
    """(inner, outer): ids of pairs that may hold inner's string within outer's and share a token: met under inner's rarest run of q characters.

    Strings under q characters have a token or two, and meet under these. Runs and tokens are many more than rows, which Spark does not see
    when it plans, so all joins are merges (`title_match` too).
    """
    runs = lambda side: side.where(F.length("s") >= q).select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - q + 1), lambda i: F.substr("s", i, F.lit(q))))).alias("run"))
    all_runs = runs(outer)
    df = all_runs.groupBy("run").agg(F.count("*").alias("df"))
    rarest = runs(inner).join(df.hint("merge"), "run", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "run")).alias("k")).where("k.df > 0").select(F.col("id").alias("inner"), F.col("k.run").alias("run"))
    short = inner.where(F.length("s") < q).select(F.col("id").alias("inner"), F.explode("toks").alias("tok")).join(outer.select(F.col("id").alias("outer"), F.explode("toks").alias("tok")).hint("merge"), "tok")
    return rarest.join(all_runs.withColumnRenamed("id", "outer").hint("merge"), "run").select("inner", "outer").unionByName(short.select("inner", "outer"))


def title_match(names: DataFrame, titles: DataFrame, q: int = 5) -> DataFrame:
    """(name_id, title_id, hits) with a token in common where one string contains the other, or enough tokens agree (overlap_need).

    Prefix filter: a pair with enough in common shares one of the name's n - need + 1 rarest tokens, which is among the title's
    m - need + 1 rarest, so a token that many titles have is no join key unless the titles have little else; titles with fewer
    than `need` tokens are left out. Strings that hold one another meet under a rare run of q characters. Ids are unique; rows
    without tokens or text match nothing.
    """
    side = lambda df, key, c: df.select(F.col(key).alias("id"), F.lower(c).alias("s"), name_tokens(F.col(c)).alias("toks")).where(F.size("toks") > 0)
    n, t = side(names, "name_id", "name"), side(titles, "title_id", "title")
    seen = t.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    a, b = by_rarity(n, seen).withColumn("need", overlap_need(F.col("size"))).where("at <= size - need").alias("a"), by_rarity(t, seen).alias("b")
    enough = a.join(b.hint("merge"), (F.col("a.tok") == F.col("b.tok")) & (F.col("b.at") <= F.col("b.size") - F.col("a.need"))).select(F.col("a.id").alias("name_id"), F.col("b.id").alias("title_id"))
    within = containing(n, t, q).toDF("name_id", "title_id").unionByName(containing(t, n, q).toDF("title_id", "name_id"))
    full = enough.unionByName(within).distinct().join(n.toDF("name_id", "name", "nt").hint("merge"), "name_id").join(t.toDF("title_id", "title", "tt").hint("merge"), "title_id")
    hits = full.withColumn("hits", F.size(F.array_intersect("nt", "tt")).cast("long")).where("hits > 0")
    return hits.where(F.col("title").contains(F.col("name")) | F.col("name").contains(F.col("title")) | (F.col("hits") >= overlap_need(F.size("nt")))).select("name_id", "title_id", "hits")


def name_variants(name: Column) -> Column:
    """Lower-case forms of a place's name: the whole, and what stands before " - ", " near ", "/" or " | "."""
    base = F.lower(F.trim(name))
    near = F.when(base.contains(" near "), F.element_at(F.split(base, r"\s+near\s+"), 1)).otherwise(base)
    return F.transform(F.array(base, near, *[F.split_part(base, F.lit(x), F.lit(1)) for x in (" - ", "/", " | ")]), F.trim)


def identifies(text: Column, name: Column, city: str, url: Column | None = None) -> Column:
    """The page (text and url) names the city and the place.

    The place is named by a variant of its name (of four characters or more), or by its tokens without general words and
    the city: all of two or three, else max(3, floor((3n + 3) / 4)); one token alone is not enough.
    """
    low = F.lower(text if url is None else F.concat_ws("\n", text, url))
    toks = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(*GENERAL_WORDS, city))
    n = F.size(toks)
    hits = F.size(F.filter(toks, lambda x: low.contains(x)))
    need = F.when(n <= 3, n).otherwise(F.greatest(F.lit(3), F.floor((3 * n + 3) / 4).cast("int")))
    phrase = F.exists(name_variants(name), lambda v: (F.length(v) >= 4) & low.contains(v))
    return (phrase | ((n >= 2) & (hits >= need))) & low.contains(city)


def audit(cards: DataFrame, files: DataFrame, primary: str = "official", target: int = 3) -> DataFrame:
    """What each card needs: its media fetched again, better files, or more images.

    cards: one row for each location_id, with media (array<struct<type,source,file,url>>), image_file, image_url, media_source,
    augmentation_attempted and augmentation_added; files: what is stored (file, bytes, width, height; null bytes: unreadable, null
    sizes: unknown; of repeated names the largest counts). needs_refresh: no media, no stored image, an image (or image_url) without a file, not from the primary
    source, or one item of it at most and no video among them. low_quality: the first image is missing, unreadable or small, a stored video
    is missing or too large, or media_source is 'none'; such a card without any media and fields is low in quality too.
    needs_augmentation: it has a stored image, fewer than target images and no video, unless the last attempt added nothing.
    """
    m = F.coalesce(F.col("media"), F.array().cast("array<struct<type:string,source:string,file:string,url:string>>"))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    image, video = (lambda x: F.coalesce(x["type"] == "image", F.lit(False))), (lambda x: F.coalesce(x["type"] == "video", F.lit(False)))
    stored_image = given(F.col("image_file")) | F.exists(m, lambda x: image(x) & given(x["file"]))
    own_source = F.filter(m, lambda x: source_name(x["source"]) == primary)
    refresh = (F.size(m) == 0) | ~stored_image | F.exists(m, lambda x: image(x) & ~given(x["file"])) | (given(F.col("image_url")) & ~given(F.col("image_file")))
    refresh = refresh | (source_name(F.col("media_source")) != primary) | ((F.size(own_source) <= 1) & ~F.exists(own_source, video))
    idle = (F.coalesce("augmentation_attempted", F.lit(False)) | F.col("augmentation_added").isNotNull()) & (F.coalesce("augmentation_added", F.lit(0)) == 0)
    few = F.size(F.filter(m, lambda x: image(x) & (given(x["file"]) | given(x["url"])))) < target
    first = F.coalesce(F.try_element_at(F.filter(m, lambda x: image(x) & given(x["file"])), F.lit(1))["file"], F.col("image_file"))
    flagged = cards.select("location_id", m.alias("_m"), first.alias("_first"), (F.col("media_source") == "none").alias("_none"), refresh.alias("needs_refresh"), (~idle & stored_image & few & ~F.exists(m, video)).alias("needs_augmentation"))
    store = files.groupBy("file").agg(F.max_by(F.struct("bytes", "width", "height"), F.coalesce("bytes", F.lit(-1))).alias("_f"))
    small = (F.col("_f.width") * F.col("_f.height") < IMAGE_AREA) | (F.least("_f.width", "_f.height") < IMAGE_SIDE)
    sized = F.col("_f.width").isNotNull() & F.col("_f.height").isNotNull()
    bad_image = store.select(F.col("file").alias("_first"), (F.coalesce(F.col("_f.bytes") < IMAGE_BYTES, F.lit(True)) | (sized & F.coalesce(small, F.lit(False)))).alias("_bad"))
    videos = flagged.select("location_id", F.explode(F.filter("_m", lambda x: video(x) & given(x["file"]))).alias("_v")).select("location_id", F.col("_v.file").alias("file"))
    bad_video = videos.join(store, "file", "left").where(F.coalesce(F.col("_f.bytes") >= VIDEO_BYTES, F.lit(True))).select("location_id").distinct().withColumn("_bad_video", F.lit(True))
    every = flagged.join(bad_image, "_first", "left").join(bad_video, "location_id", "left")
    low = F.coalesce("_bad", F.lit(True)) | F.coalesce("_bad_video", F.lit(False)) | F.coalesce("_none", F.lit(False))
    return every.select("location_id", F.coalesce("needs_refresh", F.lit(True)).alias("needs_refresh"), low.alias("low_quality"), "needs_augmentation")


def denied_url(url: Column, words: tuple[str, ...] = DENIED_PARTS) -> Column:
    """Whether a url has one of the words in it."""
    return reduce(lambda a, w: a | F.lower(url).contains(w), words, F.lit(False))


def choose_search_url(rows: DataFrame) -> DataFrame:
    """One url for each place: its site, else a map link, else any; earlier first."""
    p = F.when(F.col("kind") == "site", 0).when(F.col("kind") == "map", 1).otherwise(2)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("location_id").orderBy(p, "pos"))).where("_r = 1").drop("_r")


def merge_candidates(known: DataFrame, sources: list[DataFrame], target: int = 3, most: int = 3) -> DataFrame:
    """New media from (location_id, pos, url) sources in order of priority: not known, not denied, no repeats; up to the target and at most `most`."""
    every = reduce(lambda a, b: a.unionByName(b), [s.select("location_id", "pos", "url").withColumn("priority", F.lit(k)) for k, s in enumerate(sources)])
    fresh = every.where(~denied_url(F.col("url"))).withColumn("key", url_key(F.col("url"))).join(known.select("location_id", url_key(F.col("url")).alias("key")), ["location_id", "key"], "left_anti")
    one = first_of(fresh, F.struct("location_id", "key"), ["priority", "pos"])
    have = known.groupBy("location_id").agg(F.count("*").alias("have"))
    ranked = one.join(have, "location_id", "left").withColumn("r", F.row_number().over(W.partitionBy("location_id").orderBy("priority", "pos", "url")))
    return ranked.where(F.col("r") <= F.least(F.lit(most), F.lit(target) - F.coalesce("have", F.lit(0)))).select("location_id", "url", "priority", "r")


def attribution(source: Column, name: Column) -> Column:
    """M18"""
    s = source_name(source)
    return F.when(s == "wikipedia", F.concat(F.lit("Photo: Wikimedia Commons, "), name)).when(s == "youtube", F.concat(F.lit("Video: YouTube, "), name)).when(s == "official", F.concat(F.lit("Courtesy of "), name)).otherwise(F.concat(F.lit("Via "), s))


def display_order(items: DataFrame) -> DataFrame:
    """Playable videos first, then images; a video that can't be played shows its thumbnail as an image; no repeats by kind and url without query."""
    thumb, _ = video_links(F.col("url"))
    playable = F.col("url").rlike(VIDEO_URL)
    shown = items.withColumn("kind", F.when((F.col("type") == "video") & ~playable, "image").otherwise(F.col("type"))).withColumn("shown", F.when((F.col("type") == "video") & ~playable, thumb).otherwise(F.col("url"))).where("shown is not null")
    key = F.when(F.col("kind") == "video", F.col("shown")).otherwise(F.split_part("shown", F.lit("?"), F.lit(1)))
    one = shown.withColumn("_r", F.row_number().over(W.partitionBy("location_id", "kind", key).orderBy("pos"))).where("_r = 1")
    order = W.partitionBy("location_id").orderBy(F.when(F.col("kind") == "video", 0).otherwise(1), "pos")
    return one.withColumn("place", F.row_number().over(order)).select("location_id", "kind", "shown", "place")


def localised(cards: DataFrame) -> DataFrame:
    """Cards with media that can be shown: images with a file, videos with a file or url; first of each."""
    keep = F.filter("media", lambda x: F.when(x["type"] == "image", F.coalesce(x["file"], F.lit("")) != "").otherwise((F.coalesce(x["file"], F.lit("")) != "") | (F.coalesce(x["url"], F.lit("")) != "")))
    own = cards.withColumn("media", keep)
    pick = lambda kind: F.try_element_at(F.filter("media", lambda x: x["type"] == kind), F.lit(1))
    return own.select("location_id", F.size("media").alias("n_media"), pick("image")["file"].alias("image_file"), F.coalesce(pick("video")["file"], pick("video")["url"]).alias("video"))
