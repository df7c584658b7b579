"""Sources and sinks: warehouse tables, features, events, snapshots, click log."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import frames

CLICK_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("event_type", T.StringType()), ("ts", T.StringType()), ("location_id", T.StringType()), ("location_name", T.StringType()), ("surface", T.StringType()), ("rank", T.IntegerType()), ("link_type", T.StringType()), ("href", T.StringType()))] + [T.StructField("_corrupt_record", T.StringType())])
REQUIRED_FEATURES = ("user_key", "location_id", "location_name")


def ensure_columns(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Add missing optional columns as typed nulls, so that later steps need not ask whether they are there."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in spec.items() if c not in df.columns})


def load_table(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | None = None, limit: int | None = None, **options) -> DataFrame:
    """A table in any of Spark's formats; limit is the caller's own wish."""
    reader = spark.read.format(form).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df if limit is None else df.limit(limit)


def load_features(spark: SparkSession, path: str, form: str = "csv", **options) -> DataFrame:
    """The feature table, with a check of its required columns."""
    df = load_table(spark, path, form, **({"header": True} | options if form == "csv" else options))
    if missing := [c for c in REQUIRED_FEATURES if c not in df.columns]:
        raise ValueError(f"features lack {', '.join(missing)}")
    return df


# columns of the feature table that are not text
FEATURE_TYPES = {
    "total_interactions_with_location": "long", "total_user_interactions": "long", "total_interaction_score": "double", "avg_interaction_score": "double",
    "total_location_engagement_msec_capped": "double", "avg_location_engagement_all_users_msec_capped": "double", "first_interaction_time": "timestamp",
    "last_interaction_time": "timestamp", "first_seen_time": "timestamp", "last_seen_time": "timestamp", **{c: "double" for c in frames.PRIORS},
}
FEATURE_TEXTS = ("location_category_name", "primary_category", "city")


@dataclass(frozen=True)
class Warehouse:
    """The frames that recommendations start from; events is None where no event table was given."""

    interactions: DataFrame
    locations: DataFrame
    users: DataFrame
    events: DataFrame | None = None

    def categories(self) -> DataFrame:
        return frames.distinct_categories(self.locations)

    def observed_counts(self) -> DataFrame:
        return frames.observed_counts(self.locations)


def optional_table(spark: SparkSession, path: str | None, form: str, what: str) -> DataFrame | None:
    """A table that may be absent: None without a path, and with a warning where nothing is at the path."""
    if path is None:
        return None
    try:
        return load_table(spark, path, form, **({"header": True} if form == "csv" else {}))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"{what} not found at {path}; left out", stacklevel=3)
        return None


def load_warehouse(spark: SparkSession, features: str, dim: str | None = None, events: str | None = None, geo: str | None = None, form: str = "csv") -> Warehouse:
    """Interactions, places and users from the feature table; the official places, coordinates and events where given.

    Features need user_key, location_id and location_name, dim location_id and location_name (else ValueError); other columns are added as
    nulls if absent, and what cannot be read as a number or time is null. Keys are trimmed; rows without both keys are in no frame.
    Repeated pairs keep the last by last_interaction_time (null first), then the greatest score, then all other columns. Repeated places of dim and of geo keep the
    least name and the least coordinates. Without dim the observed places are the universe (observed is true). geo counts with dim alone.
    """
    raw = load_features(spark, features, form)
    typed = ensure_columns(raw, FEATURE_TYPES | dict.fromkeys(FEATURE_TEXTS, "string")).withColumns({c: F.col(c).try_cast(k) for c, k in FEATURE_TYPES.items() if c in raw.columns})
    own = typed.withColumns({c: frames.clean_id(F.col(c)) for c in ("user_key", "location_id")}).where("user_key is not null and location_id is not null")
    pairs = frames.interactions_from_features(own, ["last_interaction_time", "total_interaction_score", *sorted(set(own.columns) - {"last_interaction_time", "total_interaction_score"})])
    parts = frames.place_categories(own, ["user_key"])
    places = frames.locations_from_features(own).join(parts, "location_id", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    official = optional_table(spark, dim, form, "dim")
    if official is None:
        places = places.withColumn("observed", F.lit(True))
    else:
        if missing := [c for c in ("location_id", "location_name") if c not in official.columns]:
            raise ValueError(f"dim lacks {', '.join(missing)}")
        known = official.select(frames.clean_id(F.col("location_id")).alias("location_id"), F.trim("location_name").alias("location_name")).where("location_id is not null").groupBy("location_id").agg(F.min("location_name").alias("location_name"))
        at = optional_table(spark, geo, form, "geo")
        if at is not None:
            point = F.struct(F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"))
            at = at.groupBy(frames.clean_id(F.col("location_id")).alias("location_id")).agg(F.min(F.when(point["lat"].isNotNull() & point["lon"].isNotNull(), point)).alias("_at")).select("location_id", "_at.lat", "_at.lon")
        places = frames.expand_universe(known, places, at).withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    log = optional_table(spark, events, form, "events")
    return Warehouse(pairs, places, frames.users_from_features(own), None if log is None else normalise_events(log))


def normalise_events(df: DataFrame) -> DataFrame:
    """event_time from text or timestamp, else from microseconds in event_timestamp; rows without a readable time go."""
    parts = []
    if "event_time" in df.columns:
        parts.append(F.try_to_timestamp(F.col("event_time").cast("string")))
    if "event_timestamp" in df.columns:
        parts.append(F.timestamp_micros(F.col("event_timestamp").try_cast("long")))
    return df.withColumn("event_time", F.coalesce(*parts)).where("event_time is not null")


def export_snapshot(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> DataFrame:
    """Write each table under path and return (table, rows) of what was written."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")
        row = spark.read.schema(df.schema).format(form).load(f"{path}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def append_clicks(clicks: DataFrame, path: str) -> None:
    """One JSON line for each click, appended; kept apart from engagement events."""
    clicks.write.mode("append").json(path)


def read_clicks(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """Clicks of known places; malformed lines are skipped."""
    return clean_clicks(spark.read.schema(CLICK_SCHEMA).json(path), places)


def clean_clicks(raw: DataFrame, places: DataFrame) -> DataFrame:
    return raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record").join(places.select("location_id"), "location_id", "left_semi")


def parse_clicks(lines: DataFrame, places: DataFrame, column: str = "value") -> DataFrame:
    """S6 for lines that are already a column (a stream, or a table of text)."""
    body = T.StructType(CLICK_SCHEMA.fields[:-1])
    parsed = lines.withColumn("_c", F.from_json(column, body)).where(F.col("_c.location_id").isNotNull())
    return parsed.select("*", "_c.*").drop("_c", column).join(places.select("location_id"), "location_id", "left_semi")
