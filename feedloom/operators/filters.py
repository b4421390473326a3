"""Row filters of the feed and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]
DEFAULT_COUNTRIES = "US,Unknown"
LONGEST_QUERY = 200


def not_dismissed(df: DataFrame, flag: str = "is_dismissed") -> DataFrame:
    """Rows whose flag is false; null drops out."""
    return df.filter(~F.col(flag))


def in_countries(wanted: str | None, column: str = "country", default: str = DEFAULT_COUNTRIES) -> Transform:
    """A comma-separated list; blank takes the default, 'all' in any case filters nothing. Null countries drop out
    whenever the filter is active."""
    text = (wanted or "").strip() or default
    parts = [p.strip() for p in text.split(",") if p.strip()]
    return lambda df: df if text.lower() == "all" or not parts else df.filter(F.col(column).isin(parts))


def contains_text(query: str | None, columns: list[str], escape: bool = False) -> Transform:
    """Case-insensitive match of any column; % and _ of the query stay wildcards unless escaped. A blank query or one
    of more than LONGEST_QUERY characters filters nothing."""
    text = (query or "").strip()
    if not text or len(text) > LONGEST_QUERY:
        return lambda df: df
    if escape:
        text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return lambda df: df.filter(_any([F.col(c).ilike(f"%{text}%") for c in columns]))


def at_least(column: str, threshold: Column | float) -> Transform:
    return lambda df: df.filter(F.col(column) >= threshold)


def title_has_any(targets: list[str], column: str = "title") -> Transform:
    """Case-insensitive substring of any target; no targets filter nothing."""
    if not targets:
        return lambda df: df
    return lambda df: df.filter(_any([F.contains(F.lower(F.col(column)), F.lit(t.lower())) for t in targets]))


def finite_vector(vector: str) -> Column:
    """The vector, or null if any component is NaN or infinite."""
    fine = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.col(vector))


def title_only(description: Column, title: Column) -> Column:
    """No description of its own: empty, the title itself, or under 50 characters and containing the title."""
    d, t = F.lower(F.trim(F.coalesce(description, F.lit("")))), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (d == "") | (d == t) | ((F.length(d) < 50) & F.contains(d, t))


def is_due(as_of: Column, cooldown_seconds: int = 3600) -> Column:
    """A partial row never tried, or not within the cooldown."""
    waited = F.col("enrichment_attempted_at").isNull() | (as_of.cast("double") - F.col("enrichment_attempted_at").cast("timestamp").cast("double") >= cooldown_seconds)
    return F.col("partial") & waited


def due_for_enrichment(as_of: Column, cooldown_seconds: int = 3600) -> Transform:
    """Due rows that have a title or a company."""
    named = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("company", F.lit("")) != "")
    return lambda df: df.filter(is_due(as_of, cooldown_seconds) & named)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
