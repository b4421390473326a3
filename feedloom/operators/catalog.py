"""The catalog of sources: which ones a request may use, and what their failures were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]
CATALOG = "name string, display_name string, type string, mode string, regions array<string>"


def of_type(kind: str) -> Transform:
    """open or key_required."""
    return lambda catalog: catalog.filter(F.col("type") == kind)


def of_mode(mode: str) -> Transform:
    """feed or search."""
    return lambda catalog: catalog.filter(F.col("mode") == mode)


def in_region(region: str) -> Transform:
    """Sources that name the region or '*'; null regions name none."""
    return lambda catalog: catalog.filter(F.array_contains("regions", region) | F.array_contains("regions", "*"))


def eligible(settings: DataFrame, requested: list[str] | None = None, mode: str = "feed") -> Transform:
    """Catalog sources of the mode that are enabled in settings (name, is_enabled) and, with a list, requested."""
    enabled = settings.filter(F.col("is_enabled")).select("name")

    def run(catalog: DataFrame) -> DataFrame:
        found = catalog.transform(of_mode(mode)).join(enabled, "name", "left_semi")
        return found if requested is None else found.filter(F.col("name").isin(requested))

    return run


def with_settings(settings: DataFrame) -> Transform:
    """The catalog with is_configured and is_active: sources that no setting names are not configured, and active only
    if open. settings: (name, is_enabled)."""
    known = settings.select("name", "is_enabled")

    def run(catalog: DataFrame) -> DataFrame:
        joined = catalog.join(known.withColumn("_known", F.lit(True)), "name", "left")
        configured = F.coalesce("_known", F.lit(False))
        return joined.withColumns({"is_configured": configured, "is_active": F.coalesce("is_enabled", F.col("type") == "open")}).drop("_known", "is_enabled")

    return run


def error_type(name: Column, message: Column, status: Column) -> Column:
    """parse_error, timeout, rate_limit, auth_error or unknown, from an error's name, message and HTTP status, in the
    order of how sure each sign is. Nulls say nothing."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda word: F.contains(text, F.lit(word))
    return (
        F.when((name == "SyntaxError") | has("unexpected token"), "parse_error")
        .when(name.isin("AbortError", "TimeoutError") | has("timeout") | has("timed out"), "timeout")
        .when(status == 429, "rate_limit")
        .when(status.isin(401, 403), "auth_error")
        .when(has("json") | has("parse"), "parse_error")
        .otherwise("unknown")
    )


def retry_at(kind: Column, at: Column, seconds: int = 60) -> Column:
    """When a limited source may be asked again; null for other errors."""
    return F.when(kind == "rate_limit", at + F.make_dt_interval(secs=F.lit(seconds)))
