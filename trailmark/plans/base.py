"""Registry of queries and their SQL twins, and shared steps of the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..sources import fixtures as fx
from ..sources.shared import tasks, working_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function as a query, with its twin if SQL can express it."""

    def add(f):
        QUERIES[name] = lambda spark, d: _run(f, spark, d)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


_STEPS: dict[tuple, DataFrame] | None = None  # steps of the query that is being built


def _run(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build a query; a step that several of its parts use is worked out once."""
    global _STEPS
    if _STEPS is not None:
        return f(spark, sf_dir)
    _STEPS = {}
    try:
        return f(spark, sf_dir)
    finally:
        _STEPS = None


def step(f=None, *, write: bool = True):
    """Mark a function of (spark, sf_dir) as a step of queries.

    Within one query its frame is built once; write: it is stored in the shared folder too, so that what
    follows starts from a table and not from the whole plan again.
    """
    if f is None:
        return lambda g: step(g, write=write)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if _STEPS is None:
            return f(spark, sf_dir)
        key = (f.__module__, f.__name__, sf_dir)
        if key not in _STEPS:
            df = f(spark, sf_dir)
            if write:
                path = working_folder(spark, f.__name__)
                df.write.parquet(path)
                df = spark.read.schema(df.schema).parquet(path)
            _STEPS[key] = df
        return _STEPS[key]

    return run


def r6(c):
    """Six decimals; -0.0 becomes 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def six(c):
    """Six decimals of finite values by arithmetic; for products of tables, where F.round's BigDecimals take longer than the join."""
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * (F.floor(F.abs(c) * 1e6 + 0.5) / F.lit(1e6)) + F.lit(0.0)


def micros(c):
    return F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_micros(c.cast("timestamp"))


@step(write=False)
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.enrich(fx.events(spark, sf_dir))


@step
def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, stored in as many parts as there are tasks: what reads them parses no JSON again, and a small file isn't one task's work."""
    return fx.events_of(fx.table(spark, sf_dir, "events").repartition(tasks(spark)))


@step
def site_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched events, stored: scores, graphs and trends read them several times."""
    return quality.enrich(parsed_events(spark, sf_dir))


@step
def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.effective_scores(site_events(spark, sf_dir))


@step
def seen_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified user-place pairs within the catalogue."""
    return effective(spark, sf_dir).where("is_qualified").join(fx.locations(spark, sf_dir).select("location_id"), "location_id", "left_semi").select("user_key", "location_id", "effective_score")
