"""Titles of feed items and search results, split into a job's title, its company and its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import trim_all

UNKNOWN = "Unknown"
#: Labels that are no company before a colon, and levels that are none after a dash.
LABELS = "location|salary|type|category|remote|date|posted|deadline"
LEVELS = "Senior|Junior|Mid|Lead|Staff|Entry|Remote|Full"
#: Sites whose names end a search result's title.
SITES = r"LinkedIn|Indeed|Glassdoor|ZipRecruiter|Dice|BuiltIn\w*"

#: The forms of a feed item's title, and of a search result's.
HIRING, COLON, AT, DASH, PIPE = r"(?i)^(.+?)\s+is\s+hiring\s+(.+)$", r"^(.+?):\s+(.+)$", r"(?i)^(.+?)\s+(?:at|@)\s+(.+)$", r"^(.+?)\s+-\s+(.+)$", r"^(.+?)\s*\|\s*(.+)$"
HIRING_IN, HIRES, CAREERS = r"(?i)^(.+?)\s+hiring\s+(.+?)\s+in\s+(.+)$", r"(?i)^(.+?)\s+hiring\s+(.+)$", r"(?i)^(.+?)\s*[-–—]\s*(?:Jobs\s*[-–—]\s*)?Careers\s+at\s+(.+)$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return trim_all(F.regexp_extract(text, pattern, group))


def _split(title: Column, company: Column, place: Column | None = None) -> Column:
    return F.struct(title.alias("title"), company.alias("company"), (F.lit(None).cast("string") if place is None else place).alias("location"))


def split_feed_title(text: Column) -> Column:
    """struct<title,company,location>: 'C is hiring T', 'C: T' (unless C is a label), 'T at C' or 'T @ C', 'T - C' (if C
    starts with a capital and is no level), 'T | C', in this order; else the whole text and Unknown."""
    named = ~_part(text, COLON, 1).rlike(f"(?i)^(?:{LABELS})")
    behind = _part(text, DASH, 2)
    firm = behind.rlike("^[A-Z]") & ~behind.rlike(f"(?i)^(?:{LEVELS})")
    return (
        F.when(text.rlike(HIRING), _split(_part(text, HIRING, 2), _part(text, HIRING, 1)))
        .when(text.rlike(COLON) & named, _split(_part(text, COLON, 2), _part(text, COLON, 1)))
        .when(text.rlike(AT), _split(_part(text, AT, 1), _part(text, AT, 2)))
        .when(text.rlike(DASH) & firm, _split(_part(text, DASH, 1), behind))
        .when(text.rlike(PIPE), _split(_part(text, PIPE, 1), _part(text, PIPE, 2)))
        .otherwise(_split(text, F.lit(UNKNOWN)))
    )


def split_search_title(raw: Column) -> Column:
    """struct<title,company,location> without the site's name: 'C hiring T in P', 'C hiring T', 'T - Careers at C', else
    as a feed title."""
    text = trim_all(F.regexp_replace(raw, rf"(?i)\s*[|–—-]\s*(?:{SITES})\s*$", ""))
    return (
        F.when(text.rlike(HIRING_IN), _split(_part(text, HIRING_IN, 2), _part(text, HIRING_IN, 1), _part(text, HIRING_IN, 3)))
        .when(text.rlike(HIRES), _split(_part(text, HIRES, 2), _part(text, HIRES, 1)))
        .when(text.rlike(CAREERS), _split(_part(text, CAREERS, 1), _part(text, CAREERS, 2)))
        .otherwise(split_feed_title(text))
    )
