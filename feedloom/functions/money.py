"""Salary parsing, overlap, scoring and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of pay: a range and one amount without spaces, a range after a label, one in a board's summary,
#: one in a snippet, an hourly rate, and a range in a feed item.
_RANGE = r"(?i)\$?([\d.]+)(k)?(?:[-–—]|to)\$?([\d.]+)(k)?"
_ONE = r"(?i)\$?([\d.]+)(k)?"
LABELLED_RANGE = r"(?i)(?:salary|compensation|pay)\s*(?:range)?[:\s]*\$?([\d,]+(?:\.\d+)?)\s*(?:k)?\s*[-–—to]+\s*\$?([\d,]+(?:\.\d+)?)\s*(?:k)?"
SUMMARY_RANGE = r"(?i)\$?([\d,]+(?:\.\d+)?)\s*(?:k)?\s*[-–—to]+\s*\$?([\d,]+(?:\.\d+)?)\s*(?:k)?"
SNIPPET_RANGE = r"(?i)\$(\d{2,3}(?:,\d{3})*(?:\.\d+)?)(k)?\s*[-–—]+\s*\$(\d{2,3}(?:,\d{3})*(?:\.\d+)?)(k)?"
HOURLY = r"(?i)\$(\d+(?:\.\d+)?)\s*(?:an?\s+hour|/\s*hr|/\s*hour)"
ITEM_RANGE = r"\$[\d,.]+[kK]?\s*[-–—to]+\s*\$[\d,.]+[kK]?"
#: Hours of a full-time year.
YEAR_HOURS = 2080


def half_up(c: Column) -> Column:
    """Rounds half towards plus infinity."""
    return F.floor(c + 0.5)


def leading_number(c: Column) -> Column:
    """The number at a text's start; null without one."""
    return F.regexp_extract(c, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")


def _amount(text: Column, pattern: str, group: int) -> Column:
    """The number of a group, times 1000 if the next group, a k, is there."""
    number = leading_number(F.regexp_extract(text, pattern, group))
    return F.when(F.regexp_extract(text, pattern, group + 1) != "", number * 1000).otherwise(number)


def parse_salary(c: Column) -> Column:
    """struct<min,max> of a salary text: a range with a k on either side, else its first number as min. Null if none."""
    text = F.regexp_replace(c, r"(?U)[,\s]", "")
    ranged = F.regexp_like(text, F.lit(_RANGE))
    low = F.when(ranged, _amount(text, _RANGE, 1)).otherwise(_amount(text, _ONE, 1))
    high = F.when(ranged, _amount(text, _RANGE, 3))
    return F.when(low.isNotNull(), F.struct(low.alias("min"), high.alias("max")))


def shown_range(text: Column) -> Column:
    """struct<min,max> of the first '$a - $b' in a feed item's text; null if none."""
    return F.get(F.transform(F.array(F.nullif(F.regexp_extract(text, ITEM_RANGE, 0), F.lit(""))), parse_salary), F.lit(0))


def labelled_range(text: Column) -> Column:
    """struct<min,max> of a range after salary, compensation or pay; a k after either number is not read."""
    # One search finds the range; the patterns that read it see that part alone.
    found = F.regexp_extract(text, LABELLED_RANGE, 0)
    part = lambda c, group: F.regexp_extract(c, LABELLED_RANGE, group)
    return F.get(F.transform(F.array(found), lambda c: parse_salary(F.when(c != "", F.concat(part(c, 1), F.lit("-"), part(c, 2))))), F.lit(0))


def summary_range(summary: Column) -> Column:
    """struct<min,max> of a compensation summary: a number under 1000 counts thousands if a k is anywhere in it."""

    def amount(group: int) -> Column:
        n = leading_number(F.regexp_replace(F.regexp_extract(summary, SUMMARY_RANGE, group), ",", ""))
        return F.when((n < 1000) & F.contains(F.lower(summary), F.lit("k")), n * 1000).otherwise(n)

    return F.when(F.regexp_like(summary, F.lit(SUMMARY_RANGE)), F.struct(amount(1).alias("min"), amount(2).alias("max")))


def snippet_salary(text: Column) -> Column:
    """struct<min,max> of a search snippet: an hourly rate as a year's minimum, else '$a - $b' of two or three leading
    digits; null if neither."""
    hourly = F.regexp_extract(text, HOURLY, 1).try_cast("double")

    def amount(group: int) -> Column:
        n = F.regexp_replace(F.regexp_extract(text, SNIPPET_RANGE, group), ",", "").try_cast("double")
        return F.when(F.regexp_extract(text, SNIPPET_RANGE, group + 1) != "", n * 1000).otherwise(n)

    yearly = F.struct(half_up(hourly * YEAR_HOURS).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    return F.when(hourly.isNotNull(), yearly).when(F.regexp_like(text, F.lit(SNIPPET_RANGE)), F.struct(amount(1).alias("min"), amount(3).alias("max")))


def cap(c: Column, most: float) -> Column:
    """Null above the cap; the cap itself stays."""
    return F.when(c <= most, c)


def overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Intersection over union of two salary ranges; a missing max is the min; null without a min."""
    a_top, b_top = F.coalesce(a_max, a_min), F.coalesce(b_max, b_min)
    low, high = F.greatest(a_min, b_min), F.least(a_top, b_top)
    union = F.greatest(a_top, b_top) - F.least(a_min, b_min)
    return F.when(a_min.isNull() | b_min.isNull(), F.lit(None)).when(high < low, F.lit(0.0)).when(union == 0, F.lit(1.0)).otherwise((high - low) / union)


def salary_axis(target: Column, low: Column, high: Column) -> Column:
    """struct<score,label> of an offer against a target: 50 if either is unset (0 counts as unset), 100 inside the range.
    Outside, 100 falls by twice the gap relative to the offer's low end (target below it) or to the target (above)."""
    lo, hi = F.when(low > 0, low), F.when(high > 0, high)
    bottom, top = F.coalesce(lo, hi), F.coalesce(hi, lo)
    inside = target.between(bottom, top)
    gap = F.when(target < bottom, (bottom - target) / bottom).otherwise((target - top) / target)
    score = F.when(inside, F.lit(100)).otherwise(F.greatest(F.lit(0), half_up((1 - gap * 2) * 100))).cast("int")
    label = F.when(inside, "in range").when(target < bottom, "target below").otherwise("target above")
    none = target.isNull() | (target == 0)
    return F.struct(F.when(none | top.isNull(), F.lit(50)).otherwise(score).alias("score"), F.when(none, "no target").when(top.isNull(), "not posted").otherwise(label).alias("label"))


def format_salary(low: Column, high: Column) -> Column:
    """'$120k – $150k', '$120k+', 'Up to $150k', or empty; amounts of 0 count as unset."""
    k = lambda c: F.concat(F.lit("$"), half_up(c / 1000).cast("string"), F.lit("k"))
    lo, hi = F.when(low > 0, low), F.when(high > 0, high)
    return F.when(lo.isNotNull() & hi.isNotNull(), F.concat(k(lo), F.lit(" – "), k(hi))).when(lo.isNotNull(), F.concat(k(lo), F.lit("+"))).when(hi.isNotNull(), F.concat(F.lit("Up to "), k(hi))).otherwise("")
