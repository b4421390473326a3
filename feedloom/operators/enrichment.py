"""Filling listings known by title alone: details from search results or pages, and the state that follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import money
from feedloom.functions import text as X
from feedloom.operators.filters import is_due

Transform = Callable[[DataFrame], DataFrame]
FIRST_RESULTS, LEAST_DETAIL = 10, 200
#: What marks a snippet as noise.
NOISE = (
    r"sign\s+(?:up|in)\s+(?:to|for)", r"join\s+to\s+apply", r"create\s+(?:a\s+)?(?:free\s+)?account", r"cookie|privacy\s+policy", r"earn\s+.*points.*purchase",
    r"log\s*in\s+to\s+view", r"프로모션|소니코리아|뉴스룸", r"索尼|本站致力",
)


def relevant(snippet: Column, title: Column, company: Column) -> Column:
    """At least 40 characters, at most 30 % outside ASCII, no noise, and a word of over two characters each of the
    company and of the title."""
    text = F.lower(snippet)

    def named(c: Column) -> Column:
        return F.exists(F.split(F.lower(c), r"\s+"), lambda w: (F.length(w) > 2) & F.contains(text, w))

    foreign = F.length(F.regexp_replace(snippet, r"[\x00-\x7F]", ""))
    fine = (F.length(snippet) >= 40) & (foreign <= F.length(snippet) * 0.3) & ~snippet.rlike("(?i)" + "|".join(f"(?:{n})" for n in NOISE))
    return F.coalesce(fine & named(company) & named(title), F.lit(False))


def details_of(results: DataFrame, key: str = "id", rank: str = "rank") -> DataFrame:
    """(key, description_text, description_html, salary_min, salary_max) from search results (key, rank, title, company,
    content) of listings. Of the first ten results the relevant ones count, each once by its first 80 characters; the
    first salary counts; keys with less than 200 characters in all are left out."""
    snippet = X.trim_all(F.col("content"))
    fine = results.filter(F.col(rank) <= FIRST_RESULTS).withColumn("_s", snippet).filter(relevant(F.col("_s"), F.col("title"), F.col("company")))
    said = fine.withColumn("_head", F.lower(F.substring("_s", 1, 80))).withColumn("_pay", money.snippet_salary(F.col("_s")))
    once = said.groupBy(key, "_head").agg(F.min(F.struct(rank, "_s")).alias("_first"), F.min(F.when(F.col("_pay").isNotNull(), F.struct(rank, "_pay"))).alias("_pay"))
    gathered = once.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("_first")), lambda x: x["_s"]).alias("_all"), F.min("_pay").alias("_pay"))
    text = F.array_join("_all", "\n\n")
    marked = lambda s: F.concat(F.lit("<p>"), _escaped(s), F.lit("</p>"))
    made = gathered.select(key, text.alias("description_text"), F.array_join(F.transform("_all", marked), "\n").alias("description_html"), F.col("_pay._pay.min").alias("salary_min"), F.col("_pay._pay.max").alias("salary_max"))
    return made.filter(F.length("description_text") >= LEAST_DETAIL)


def _escaped(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def page_description(html: Column) -> Column:
    """The description in a job page: the markup block up to its closing div, else a meta description of over 50
    characters, else the largest section of over 100; null without any."""
    return F.coalesce(_markup_block(html), _meta_description(html), _largest_section(html))


def _markup_block(html: Column) -> Column:
    """The text after the block's opening tag up to the div end at which no div is open; null if there is none."""
    tail = F.regexp_extract(html, r'(?is)class="show-more-less-html__markup[^"]*"[^>]*>(.*)$', 1)
    pieces = F.split(tail, "<div|</div>")
    tags = F.regexp_extract_all(tail, F.lit("<div|</div>"), F.lit(0))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(False).alias("found"))

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["piece"])
        depth = state["depth"] + F.when(x["tag"] == "<div", 1).otherwise(-1)
        ends = ~state["found"] & (depth == 0)
        return F.struct(depth.alias("depth"), (at + F.length(x["tag"])).alias("at"), F.when(ends, at).otherwise(state["end"]).alias("end"), (state["found"] | ends).alias("found"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(tags)), tags, lambda p, t: F.struct(p.alias("piece"), t.alias("tag")))
    last = F.aggregate(pairs, start, step)
    return F.when(last["found"], X.trim_all(F.substring(tail, F.lit(1), last["end"])))


def _meta_description(html: Column) -> Column:
    content = X.trim_all(F.regexp_extract(html, r'(?i)<meta\s+name="description"\s+content="([^"]*?)"\s*/?>', 1))
    return F.when(F.length(content) > 50, content)


def _largest_section(html: Column) -> Column:
    """The first of the longest."""
    all_of = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<section[^>]*>(.*?)</section>"), F.lit(1)), X.trim_all)
    most = F.array_max(F.transform(all_of, lambda x: F.length(x)))
    return F.when(most > 100, F.get(F.filter(all_of, lambda x: F.length(x) == most), F.lit(0)))


def enriched(details: DataFrame, scores: DataFrame, as_of: Column, cooldown_seconds: int = 3600, key: str = "id") -> Transform:
    """Listings after one round. Due ones (partial, not tried within the cooldown) are stamped; those with a title or a
    company are no longer partial, found or not. A detail replaces both descriptions and fills salaries that are null or
    0; a score (key, match_score) counts only where there is a detail. Other rows stay as they are.

    details: as details_of() gives them; one row for each key at most in details and in scores."""
    found = details.select(key, *(F.col(c).alias(f"_{c}") for c in ("description_text", "description_html", "salary_min", "salary_max")))
    scored = scores.select(key, F.col("match_score").alias("_score"))

    def run(df: DataFrame) -> DataFrame:
        due = is_due(as_of, cooldown_seconds)
        named = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("company", F.lit("")) != "")
        joined = df.withColumn("_due", F.coalesce(due, F.lit(False))).withColumn("_tried", F.col("_due") & named).join(found, key, "left").join(scored, key, "left")
        got = F.col("_tried") & F.col("_description_text").isNotNull()
        filled = {c: F.when(got, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("description_text", "description_html")}
        filled |= {c: F.when(got & (F.col(f"_{c}") != 0) & (F.coalesce(c, F.lit(0)) == 0), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("salary_min", "salary_max")}
        filled["match_score"] = F.when(got, F.coalesce("_score", "match_score")).otherwise(F.col("match_score"))
        filled["partial"] = F.when(F.col("_tried"), False).otherwise(F.col("partial"))
        filled["enrichment_attempted_at"] = F.when(F.col("_due"), as_of).otherwise(F.col("enrichment_attempted_at"))
        return joined.withColumns(filled).select(*df.columns)

    return run
