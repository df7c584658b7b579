"""Scalar cleaning and text functions: Column in, Column out, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NULLISH = ("null", "none", "unknown", "n/a")  # fixed values
# One sentence for a place's category.
BLURBS = {
    "restaurants": "A local dining pick.",
    "bars": "A go-to spot for drinks and a night out.",
    "museums": "A museum worth a couple of hours.",
    "parks": "Green space for a walk, views, or downtime.",
    "attractions": "A popular attraction visitors love.",
    "shops": "A spot for browsing and local finds.",
    "murals": "Public art and a great photo stop.",
    "theaters and music venues": "Live performance and music.",
    "sports venues": "Catch a game or tour a sports venue.",
    "hot spots": "A high-energy spot trending with visitors.",
}
DEFAULT_BLURB = "A noteworthy stop."
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def split_categories(c: Column) -> Column:
    """Parts of "A; B", trimmed, empties dropped; null gives []."""
    return F.coalesce(F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def clean_id(c: Column) -> Column:
    """Trimmed string; blank is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def clean_string(c: Column) -> Column:
    """Trimmed string, null is ''."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def number(c: Column, default: float = 0.0) -> Column:
    """Double, or the default where it can't be one or is NaN."""
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def clip(c: Column, low: float, high: float) -> Column:
    """P8"""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def flag(c: Column) -> Column:
    """1 if the value is above 0, else 0."""
    return F.when(number(c) > 0, 1).otherwise(0)


def category_token(c: Column) -> Column:
    """Lower case, other characters as _, 'unknown' if nothing is left."""
    t = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when((t == "") | t.isNull(), "unknown").otherwise(t)


def canonical_name(c: Column) -> Column:
    """P10: key of a visible place name."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def geocode_key(c: Column) -> Column:
    """Trimmed lower case with straight quotes."""
    return F.translate(F.trim(F.lower(c)), "‘’“”", "''''")


def optional_text(c: Column) -> Column:
    """Trimmed; blank and 'nan' are null."""
    t = F.trim(c)
    return F.when((t == "") | (F.lower(t) == "nan"), F.lit(None)).otherwise(t)


def nullish(c: Column) -> Column:
    """As optional_text, and the usual words for nothing are null."""
    t = F.trim(c)
    return F.when((t == "") | F.lower(t).isin(*NULLISH), F.lit(None)).otherwise(t)


def http_only(c: Column) -> Column:
    """P13"""
    t = F.trim(c)
    return F.when(F.lower(t).rlike("^https?://"), t)


def deep_link(c: Column, base: str) -> Column:
    """Base plus the id if it has the shape of a UUID."""
    t = F.trim(c)
    return F.when(t.rlike(UUID), F.concat(F.lit(base), t))


def pick(c: Column, allowed: list[str]) -> Column:
    """The allowed value equal to it without case, else null."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(*allowed), t)


def clamp_int(c: Column, low: int, high: int, default: int) -> Column:
    """P15"""
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def map_search_url(name: Column, place: str, base: str = "https://www.google.com/maps/search/?api=1&query=") -> Column:
    """P16"""
    return F.concat(F.lit(base), F.url_encode(F.concat(name, F.lit(f", {place}"))))


def tagged_url(url: Column, source: str, surface: Column, rank: Column) -> Column:
    """The link with campaign and recommendation parameters; a fragment stays last."""
    base, fragment = F.split_part(url, F.lit("#"), F.lit(1)), F.split_part(url, F.lit("#"), F.lit(2))
    extra = F.concat_ws("&", F.lit(f"utm_source={source}"), F.lit("utm_medium=referral"), F.concat(F.lit("rec_surface="), F.url_encode(surface)), F.concat(F.lit("rec_rank="), rank.cast("string")))
    return F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), extra, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def in_box(lat: Column, lon: Column, lats: tuple[float, float], lons: tuple[float, float]) -> Column:
    """False for missing coordinates."""
    return F.coalesce(lat.between(*lats) & lon.between(*lons), F.lit(False))


def blurb(category: Column) -> Column:
    """P19"""
    table = F.create_map(*[F.lit(x) for kv in BLURBS.items() for x in kv])
    return F.coalesce(table[F.lower(F.trim(category))], F.lit(DEFAULT_BLURB))


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the last three as dots if it was longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def evidence_summary(users: Column, interactions: Column, dwell_msec: Column, trending: Column, threshold: float = 0.6) -> Column:
    """P20"""
    base = F.when(users == 0, "No prior engagement, content match only.").otherwise(F.concat(users.cast("string"), F.when(users == 1, " user").otherwise(" users"), F.lit(" engaged here; "), interactions.cast("string"), F.lit(" interactions; ~"), F.format_string("%.1f", F.bround(dwell_msec / 1000, 1)), F.lit("s avg dwell")))
    return F.concat(base, F.when(trending >= threshold, "; trending").otherwise(""))


def reason_sentence(categories: Column, primary: Column, inferred: Column, collab: Column, popularity: Column, trending: Column, hot: Column) -> Column:
    """Why a place is recommended, from its scores. The phrases are fixed values."""
    low = F.transform(inferred, lambda x: F.lower(x))
    overlap = F.filter(categories, lambda x: F.array_contains(low, F.lower(x)))
    other = F.filter(overlap, lambda x: x != F.coalesce(primary, F.lit("")))
    rising = trending >= 0.6
    bits = F.concat_ws(
        "; ",
        F.when(F.size(other) > 0, F.concat(F.lit("also covers your interest in "), F.try_element_at(other, F.lit(1)))).when(F.size(overlap) > 0, "matches your selected interests"),
        F.when(collab > 0.4, "co-visited with your seed locations by other users"),
        F.when(rising, "engagement rising in the recent window"),
        F.when((hot > 0) & ~rising, "currently a HOT SPOT"),
        F.when(popularity > 0.6, "popular with other users"),
    )
    return F.when(bits == "", "good content-based match").otherwise(bits)


def rationale(categories: Column, interests: Column, rank: Column, reason: Column, evidence: Column, trending: Column) -> Column:
    """The first two of overlap or reason, rank, and trend or evidence. The phrases are fixed values."""
    overlap = F.array_intersect(categories, interests)
    stop = lambda c: F.concat(F.rtrim(F.trim(c), F.lit(".")), F.lit("."))
    first = F.when(F.size(overlap) > 0, F.concat(F.lit("It matches your "), F.array_join(F.slice(overlap, 1, 2), ", "), F.lit(" picks."))).when(F.coalesce(reason, F.lit("")) != "", stop(reason)).otherwise("It scored highly against your profile and similar travelers.")
    second = F.when((rank > 0) & (rank <= 5), F.concat(F.lit("Ranked #"), rank.cast("string"), F.lit(" in your list for this trip.")))
    told = F.coalesce(F.lower(evidence).contains("trending"), F.lit(False))
    third = F.when(trending & ~told, "It's trending on the map right now.").when(F.coalesce(evidence, F.lit("")) != "", F.when(second.isNull(), stop(evidence)))
    return F.array_join(F.slice(F.array_compact(F.array(first, second, third)), 1, 2), " ")


def highlights(category: Column, users: Column, hot: Column) -> Column:
    """P23"""
    return F.array_compact(F.array(F.concat(F.lit("Listed as "), category, F.lit(".")), F.when(hot > 0, "Marked as a hot spot."), F.when(users >= 50, F.concat(F.lit("Strong community signal: "), users.cast("string"), F.lit("+ distinct visitors explored it.")))))


def tips(category: Column) -> Column:
    """P23"""
    low = F.lower(category)
    return F.array_compact(F.array(F.concat(F.lit("Pair with other "), low, F.lit(" stops nearby.")), F.lit("Confirm hours and tickets before you go."), F.when(low == "bars", "Best as an evening stop."), F.when(low == "parks", "Morning works well for photos and walks."), F.when(low == "museums", "Budget at least 90 minutes.")))


def engagement_context(df: DataFrame) -> DataFrame:
    """P25: short numbers about each place."""
    return df.select("location_id", F.col("distinct_users").alias("users"), "interactions", "sessions", (F.col("is_hot_spot_location") > 0).alias("hot"), F.bround(F.col("avg_dwell_msec") / 1000, 1).alias("dwell_sec"))


def min_max(df: DataFrame, column: str, out: str, partition: list[str] | None = None) -> DataFrame:
    """Scaled to 0..1; 0 where high - low < 1e-9. Without a partition a one-row aggregate is broadcast."""
    if partition:
        w = W.partitionBy(*partition)
        low, high = F.min(column).over(w), F.max(column).over(w)
        return df.withColumn(out, F.when(high - low < 1e-9, 0.0).otherwise((F.col(column) - low) / (high - low)))
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    scaled = F.when(F.col("_high") - F.col("_low") < 1e-9, 0.0).otherwise((F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("_low", "_high")


def first_non_empty(df: DataFrame, keys: list[str], column: str, order: list[str], out: str) -> DataFrame:
    """First non-empty string of each group in an explicit order."""
    text = F.when(clean_string(F.col(column)) != "", F.trim(column))
    return df.groupBy(*keys).agg(F.coalesce(F.min_by(text, F.when(text.isNotNull(), F.struct(*order))), F.lit("")).alias(out))


def most_common(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """P5: most common non-empty string of each group; ties by the string."""
    n = df.where(clean_string(F.col(column)) != "").groupBy(*keys, F.trim(column).alias(out)).agg(F.count("*").alias("_n"))
    best = n.groupBy(*keys).agg(F.max_by(F.col(out), F.struct("_n")).alias("_any"), F.max("_n").alias("_n")).drop("_any")
    return n.join(best, [*keys, "_n"]).groupBy(*keys).agg(F.min(out).alias(out))


def category_union(df: DataFrame, keys: list[str], joined: str, primary: str, order: list[str]) -> DataFrame:
    """Ordered distinct categories of each group: all joined parts, then the primary ones."""
    own = df.select(*keys, F.struct(*order).alias("_o"), split_categories(F.col(joined)).alias("_parts"), F.nullif(clean_string(F.col(primary)), F.lit("")).alias("_p"))
    rows = own.select(*keys, "_o", F.posexplode("_parts").alias("_i", "_c")).select(*keys, F.lit(0).alias("_k"), "_o", "_i", "_c").unionByName(own.where("_p is not null").select(*keys, F.lit(1).alias("_k"), "_o", F.lit(0).alias("_i"), F.col("_p").alias("_c")))
    first = rows.groupBy(*keys, "_c").agg(F.min(F.struct("_k", "_o", "_i")).alias("_at"))  # distinct before collecting
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_c"))), lambda x: x["_c"]).alias("categories"))
