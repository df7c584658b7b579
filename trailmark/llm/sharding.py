"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash. Pass two shuffles
each bucket (Fisher-Yates, Spark's shuffle(), seeded by the bucket's number) and writes it. The buckets in order make one global
random order; shards are equal runs of it, so their row counts are at most one apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import renamed_aside, shared_path, written

ADDED = ("shard", "slot")


def scatter(df: DataFrame, n_buckets: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """Add _bucket: a seeded hash of the id and of the row's number in the table, so that equal and null ids are dealt out too."""
    return df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id()), F.lit(n_buckets)).cast("int"))


def bucket_offsets(scattered: DataFrame, fan: int = 4096) -> DataFrame:
    """(_bucket, _before): rows in all earlier buckets. Two levels, so no task sorts all buckets."""
    counts = scattered.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_group", F.floor(F.col("_bucket") / fan))
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_gn"))
    before = W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)  # one row for each 4096 buckets
    groups = groups.select("_group", F.coalesce(F.sum("_gn").over(before), F.lit(0)).alias("_gbefore"))
    inner = W.partitionBy("_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_inner", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(groups, "_group").select("_bucket", (F.col("_gbefore") + F.col("_inner")).alias("_before"))


def write_shuffled_shards(docs: DataFrame, path: str | None = None, n_shards: int = 16, seed: int = 20240, bucket_bytes: int = 8 << 20, min_buckets: int = 64, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> str:
    """Shuffle all rows into n_shards shards, write them as Parquet (partitioned by shard) and return the path.

    Adds shard (0 to n_shards-1; row counts at most one apart) and slot (0.. without gaps in a shard).
    Null ids and null texts are kept; rows of equal or null ids are dealt out like others; repeated rows stay repeated; an empty
    table gives an empty dataset (read_shards needs the schema then); input columns named shard, slot, or _bucket and the like get the
    suffix _in; columns must be of kinds that can be sorted (no maps). A bucket holds about bucket_bytes of text: their number
    follows the input. Each bucket is a partition of its own, whose number seeds its shuffle, so the shards don't depend on the
    shuffle partitions and a task that runs again gives the same rows. Rows are dealt by their number in a stored
    table, which follows its file splits (other splits, another lawful result): docs is written as one first, unless stored says that it is one (columns of files, nothing shuffled).
    """
    docs = renamed_aside(docs, (id_col, text_col), (*ADDED, "_bucket", "_before", "_rows", "_i", "_row", "_pos", "_k1", "_k2"))
    docs = docs if stored else written(docs, "to_shard")
    path = path or shared_path(docs.sparkSession, "shards")
    total, n_rows = docs.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    n_buckets = max(min_buckets, math.ceil((total or 0) / bucket_bytes), math.ceil(n_rows / 1_000_000))
    scattered = scatter(docs, n_buckets, seed, id_col)
    offsets = bucket_offsets(scattered.select("_bucket"))
    offsets = F.broadcast(offsets) if n_buckets <= 500_000 else offsets  # 16 bytes a bucket
    record = F.struct(F.col(id_col).alias("_k1"), F.xxhash64(text_col).alias("_k2"), *[F.col(f"`{c}`") for c in docs.columns])
    buckets = scattered.repartitionById(n_buckets, "_bucket").groupBy("_bucket").agg(F.array_sort(F.collect_list(record)).alias("_rows"))
    shuffled = buckets.select("_bucket", F.shuffle("_rows", F.lit(seed)).alias("_rows")).join(offsets, "_bucket")
    shuffled = shuffled.select("_before", F.posexplode("_rows").alias("_i", "_row")).withColumn("_pos", F.col("_before") + F.col("_i"))
    q, r = divmod(n_rows, n_shards)
    long_part = r * (q + 1)  # the first r shards have one row more
    shard = F.when(F.col("_pos") < long_part, F.floor(F.col("_pos") / (q + 1))).otherwise(r + F.floor((F.col("_pos") - long_part) / max(q, 1)))
    slot = F.when(F.col("_pos") < long_part, F.col("_pos") % (q + 1)).otherwise((F.col("_pos") - long_part) % max(q, 1))
    out = shuffled.select(*[F.col("_row")[c].alias(c) for c in docs.columns], shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    if not n_rows:
        out = out.limit(0)
    out.write.partitionBy("shard").option("maxRecordsPerFile", 5_000_000).parquet(path)
    return path


def read_shards(spark, path: str, schema=None) -> DataFrame:
    """The rows of a dataset of shards; schema (of all columns with shard and slot) is needed where it may be empty."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
