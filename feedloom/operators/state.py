"""Changes of stored rows as new snapshots: closing, runs, single rows, source settings, backfills and score updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.places import country_of

Transform = Callable[[DataFrame], DataFrame]


def closed(gone: DataFrame, keys: list[str], as_of: Column) -> Transform:
    """Stored rows; those whose key is in gone (one row for each) get as_of as closed_at."""
    marked = gone.select(*keys).withColumn("_gone", F.lit(True))
    return lambda stored: stored.join(marked, keys, "left").withColumn("closed_at", F.when(F.col("_gone"), as_of).otherwise(F.col("closed_at"))).drop("_gone")


def run_started(run_id: Column, as_of: Column) -> Transform:
    """The runs and one more that begins now; its other columns are null."""
    return lambda runs: runs.unionByName(runs.sparkSession.range(1).select(run_id.alias("id"), as_of.alias("started_at")), allowMissingColumns=True)


def run_completed(run_ids: DataFrame, as_of: Column) -> Transform:
    """The runs; those named (one row for each id) are complete now."""
    named = run_ids.select("id").withColumn("_done", F.lit(True))
    return lambda runs: runs.join(named, "id", "left").withColumn("completed_at", F.when(F.col("_done"), as_of).otherwise(F.col("completed_at"))).drop("_done")


def seeded(catalog: DataFrame) -> Transform:
    """The settings; if there are none, every open source of the catalog, enabled."""

    def run(settings: DataFrame) -> DataFrame:
        none = settings.limit(1).agg(F.count("*").alias("_n")).filter("_n = 0")
        fresh = catalog.filter("type = 'open'").crossJoin(F.broadcast(none)).select("name", "display_name", "type", F.lit(True).alias("is_enabled"))
        return settings.unionByName(fresh, allowMissingColumns=True)

    return run


def singleton(row: DataFrame, as_of: Column, kept: list[str] = ("id", "created_at")) -> Transform:
    """The one row of a table after an upsert: what is kept comes from the stored row if there is one, the rest from row."""

    def run(stored: DataFrame) -> DataFrame:
        old = stored.limit(1).select(*(F.col(c).alias(f"_{c}") for c in kept))
        joined = row.join(old, F.lit(True), "left")
        return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in kept} | {"updated_at": as_of}).drop(*(f"_{c}" for c in kept))

    return run


def reparsed(parsed: DataFrame, as_of: Column) -> Transform:
    """The stored resume with what parsing gave anew, and without the profile extracted from the old text."""
    columns = parsed.columns

    def run(stored: DataFrame) -> DataFrame:
        new = parsed.select(*(F.col(c).alias(f"_{c}") for c in columns))
        out = stored.crossJoin(F.broadcast(new)).withColumns({c: F.col(f"_{c}") for c in columns} | {"extracted_profile": F.lit(None).cast(stored.schema["extracted_profile"].dataType), "updated_at": as_of})
        return out.select(*stored.columns)

    return run


def with_singleton(single: DataFrame, columns: list[str]) -> Transform:
    """Each row with columns of the one row of a table; null where it has none."""
    one = single.agg(*(F.first(c).alias(c) for c in columns))
    return lambda df: df.crossJoin(F.broadcast(one))


def configured(delta: DataFrame, catalog: DataFrame, as_of: Column) -> Transform:
    """The settings with new configs (name, config; one row for each name). A known source changes its config alone; an
    unknown one takes its display name and type from the catalog, else its own name and key_required."""
    named = catalog.select("name", F.col("display_name").alias("_display"), F.col("type").alias("_type"))

    def run(settings: DataFrame) -> DataFrame:
        new = delta.select("name", F.col("config").alias("_config"), F.lit(True).alias("_new"))
        joined = settings.withColumn("_old", F.lit(True)).join(new, "name", "full_outer").join(named, "name", "left")
        fresh = F.col("_old").isNull()
        filled = {"display_name": F.when(fresh, F.coalesce("_display", "name")).otherwise(F.col("display_name")), "type": F.when(fresh, F.coalesce("_type", F.lit("key_required"))).otherwise(F.col("type"))}
        filled |= {"config": F.when(F.col("_new"), F.col("_config")).otherwise(F.col("config")), "updated_at": F.when(F.col("_new"), as_of).otherwise(F.col("updated_at"))}
        return joined.withColumns(filled).select(*settings.columns)

    return run


def scores_updated(scores: DataFrame, keys: list[str], columns: list[str]) -> Transform:
    """Stored rows; those with a row in scores (one for each key) take its columns, nulls included only where all are."""
    new = scores.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return lambda stored: stored.join(new, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def country_backfilled(df: DataFrame) -> DataFrame:
    """Null countries from the location; others stay."""
    return df.withColumn("country", F.coalesce("country", country_of(F.coalesce("location", F.lit("")))))


def vectors_backfilled(text: Column, embed: Callable[[Column], Column], vector: str = "embedding") -> Transform:
    """Null vectors from an embedder of texts; one that is null, or holds NaN or an infinity, counts as an error and
    stays null. _backfilled: null (had one), updated or error."""

    def run(df: DataFrame) -> DataFrame:
        made = df.withColumn("_made", F.when(F.col(vector).isNull(), embed(text)))
        fine = F.coalesce(F.forall("_made", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        told = F.when(F.col(vector).isNull(), F.when(fine, "updated").otherwise("error"))
        return made.withColumn("_backfilled", told).withColumn(vector, F.coalesce(vector, F.when(fine, F.col("_made")))).drop("_made")

    return run


def backfill_counts(df: DataFrame) -> DataFrame:
    """One row of what vectors_backfilled() did: total, updated, errors."""
    kind = F.col("_backfilled")
    return df.agg(F.count(kind).alias("total"), F.count_if(kind == "updated").alias("updated"), F.count_if(kind == "error").alias("errors"))


def partial_inserts(stored: DataFrame, keys: list[str], position: str) -> Transform:
    """Listings as partial rows that are inserted: the first of each key that stored lacks. Their count is that of real
    inserts."""
    from feedloom.operators.merging import keep_first

    return lambda df: df.join(stored.select(*keys), keys, "left_anti").transform(keep_first(keys, position)).withColumn("partial", F.lit(True))


def nearest_few(key: str, order: list[str], most: int = 50) -> Transform:
    """The first rows of each key by an order, `most` of them; a window-group limit drops the rest before its shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return lambda df: df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")
