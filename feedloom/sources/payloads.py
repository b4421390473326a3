"""Parsers of listing payloads: a DataFrame with a payload column of JSON or XML text to rows of one listing schema.

Fetching is not part of this library; payloads come from files or tables. Each parser is one from_json or from_xml with
a fixed schema and one explode, all inside the JVM. A payload that does not parse gives no rows; count these with
parse_failures(). Rows that lack a required field are marked by is_valid(), not dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import money, places, titles
from feedloom.functions import text as X
from feedloom.sources.urls import is_job_page

Parser = Callable[[DataFrame], DataFrame]
FIELDS = ["source_name", "external_id", "title", "company", "source_url", "apply_url", "description_text", "description_html", "salary_min", "salary_max", "location", "is_remote"]
TEXTS, NUMBERS = {*FIELDS[:8], "location"}, {"salary_min", "salary_max"}


def _some(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def _has(location: Column, *words: str) -> Column:
    out = F.contains(F.lower(location), F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(F.lower(location), F.lit(w))
    return out


def _listing(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The listing schema from some of its columns; the rest are null, the text comes from the HTML if need be."""
    html = columns.get("description_html")
    columns.setdefault("description_text", X.strip_html(html) if html is not None else F.lit(None))
    columns["source_name"] = F.lit(source)
    kind = lambda f: "string" if f in TEXTS else "double" if f in NUMBERS else "boolean"
    return df.select(*(columns.get(f, F.lit(None)).cast(kind(f)).alias(f) for f in FIELDS))


def _rows(df: DataFrame, schema: str, path: str | None, payload: str) -> DataFrame:
    parsed = F.from_json(payload, schema)
    return df.select(F.explode(parsed[path] if path else parsed).alias("r"))


def _id(prefix: str, *columns: Column) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(*columns, F.lit("")))


def remoteok(payload: str = "payload") -> Parser:
    """A top-level array whose first element is a notice."""

    def run(df: DataFrame) -> DataFrame:
        all_rows = F.from_json(payload, "array<struct<id string, slug string, company string, position string, description string, location string, salary_min double, salary_max double, url string, apply_url string>>")
        r = df.select(F.explode(F.slice(all_rows, 2, 1 << 30)).alias("r"))
        return _listing(r, "remoteok", external_id=_id("remoteok-", F.col("r.id")), title=F.col("r.position"), company=F.col("r.company"), source_url=F.col("r.url"), apply_url=F.col("r.apply_url"), description_html=F.nullif("r.description", F.lit("")), salary_min=F.col("r.salary_min"), salary_max=F.col("r.salary_max"), location=F.col("r.location"), is_remote=X.infer_remote(F.col("r.location")))

    return run


def jobicy(payload: str = "payload") -> Parser:
    """HTML description before the excerpt; remote if the location is 'anywhere' or holds 'remote', null without one."""

    def run(df: DataFrame) -> DataFrame:
        r = _rows(df, "struct<jobs array<struct<id string, url string, jobTitle string, companyName string, jobGeo string, jobExcerpt string, jobDescription string, annualSalaryMin double, annualSalaryMax double>>>", "jobs", payload)
        html = F.nullif("r.jobDescription", F.lit(""))
        remote = (F.lower("r.jobGeo") == "anywhere") | _has(F.col("r.jobGeo"), "remote")
        return _listing(r, "jobicy", external_id=_id("jobicy-", F.col("r.id")), title=F.col("r.jobTitle"), company=F.col("r.companyName"), source_url=F.col("r.url"), description_html=html, description_text=F.coalesce(X.strip_html(html), "r.jobExcerpt"), salary_min=F.col("r.annualSalaryMin"), salary_max=F.col("r.annualSalaryMax"), location=F.col("r.jobGeo"), is_remote=remote)

    return run


def himalayas(payload: str = "payload") -> Parser:
    """Numeric salaries; the salary text only if both are missing; the first location restriction; guid before id."""

    def run(df: DataFrame) -> DataFrame:
        r = _rows(df, "struct<jobs array<struct<id string, guid string, title string, companyName string, description string, applicationLink string, minSalary double, maxSalary double, salary string, locationRestrictions array<string>>>>", "jobs", payload)
        said = money.parse_salary(F.col("r.salary"))
        none = F.col("r.minSalary").isNull() & F.col("r.maxSalary").isNull()
        place = F.get("r.locationRestrictions", F.lit(0))
        return _listing(r, "himalayas", external_id=_id("himalayas-", F.col("r.guid"), F.col("r.id")), title=F.col("r.title"), company=F.col("r.companyName"), source_url=F.col("r.applicationLink"), apply_url=F.col("r.applicationLink"), description_html=F.nullif("r.description", F.lit("")), salary_min=F.when(none, said["min"]).otherwise(F.col("r.minSalary")), salary_max=F.when(none, said["max"]).otherwise(F.col("r.maxSalary")), location=place, is_remote=X.infer_remote(place))

    return run


def themuse(payload: str = "payload") -> Parser:
    """Nested company and locations; remote if any location says so, null without locations; an address is made from the
    id if missing."""

    def run(df: DataFrame) -> DataFrame:
        r = _rows(df, "struct<results array<struct<id string, name string, company struct<name string>, contents string, locations array<struct<name string>>, refs struct<landing_page string>>>>", "results", payload)
        remote = F.when(F.size("r.locations") > 0, F.exists("r.locations", lambda x: F.coalesce(_has(x["name"], "remote", "flexible"), F.lit(False))))
        return _listing(r, "themuse", external_id=_id("themuse-", F.col("r.id")), title=F.col("r.name"), company=F.col("r.company.name"), source_url=F.coalesce("r.refs.landing_page", _id("https://www.themuse.com/jobs/", F.col("r.id"))), description_html=F.nullif("r.contents", F.lit("")), location=F.get("r.locations.name", F.lit(0)), is_remote=remote)

    return run


def serply(payload: str = "payload") -> Parser:
    """The snippet where there is no description; detected salary numbers, else the detected text."""

    def run(df: DataFrame) -> DataFrame:
        r = _rows(df, "struct<jobs array<struct<job_id string, title string, company_name string, description string, snippet string, location string, link string, apply_link string, detected_extensions struct<salary string, salary_min double, salary_max double>>>>", "jobs", payload)
        d = F.col("r.detected_extensions")
        said = money.parse_salary(d["salary"])
        none = d["salary_min"].isNull() & d["salary_max"].isNull()
        return _listing(r, "serply", external_id=_id("serply-", F.col("r.job_id")), title=F.col("r.title"), company=F.col("r.company_name"), source_url=F.col("r.link"), apply_url=F.col("r.apply_link"), description_html=_some(F.col("r.description"), F.col("r.snippet")), salary_min=F.when(none, said["min"]).otherwise(d["salary_min"]), salary_max=F.when(none, said["max"]).otherwise(d["salary_max"]), location=F.col("r.location"), is_remote=X.infer_remote(F.col("r.location")))

    return run


def greenhouse(slug: str, company: str, payload: str = "payload") -> Parser:
    """A company's board; the location's name, else the first office's location or name; remote by the location's name
    alone; the description falls back to the title."""

    def run(df: DataFrame) -> DataFrame:
        r = _rows(df, "struct<jobs array<struct<id string, title string, content string, absolute_url string, location struct<name string>, offices array<struct<name string, location string>>>>>", "jobs", payload)
        office = F.get("r.offices", F.lit(0))
        # The text is a column of its own, so that it is made once for all that is read from it.
        r = r.withColumn("text", X.strip_html(F.col("r.content")))
        r = r.withColumn("said", money.labelled_range(F.col("text")))
        text, said = F.col("text"), F.col("said")
        return _listing(r, "greenhouse", external_id=_id(f"gh-{slug}-", F.col("r.id")), title=F.col("r.title"), company=F.lit(company), source_url=F.col("r.absolute_url"), apply_url=F.col("r.absolute_url"), description_html=F.nullif("r.content", F.lit("")), description_text=_some(text, F.col("r.title")), salary_min=said["min"], salary_max=said["max"], location=_some(F.col("r.location.name"), office["location"], office["name"]), is_remote=X.infer_remote(F.col("r.location.name")))

    return run


def lever(slug: str, company: str, payload: str = "payload") -> Parser:
    """Plain description and additional text, else those of the HTML, joined by a space; structured salary range; remote
    by workplace type or place, null if neither is known."""

    def run(df: DataFrame) -> DataFrame:
        r = _rows(df, "array<struct<id string, text string, description string, descriptionPlain string, additional string, additionalPlain string, hostedUrl string, applyUrl string, workplaceType string, categories struct<location string>, salaryRange struct<min double, max double>>>", None, payload)
        place = F.nullif("r.categories.location", F.lit(""))
        said = [F.nullif(F.coalesce(f"r.{n}Plain", X.strip_html(F.col(f"r.{n}"))), F.lit("")) for n in ("description", "additional")]
        remote = F.when(F.col("r.workplaceType") == "remote", True).otherwise(X.infer_remote(place))
        return _listing(r, "lever", external_id=_id(f"lever-{slug}-", F.col("r.id")), title=F.col("r.text"), company=F.lit(company), source_url=F.col("r.hostedUrl"), apply_url=F.col("r.applyUrl"), description_html=F.nullif("r.description", F.lit("")), description_text=_some(F.concat_ws(" ", *said), F.col("r.text")), salary_min=F.col("r.salaryRange.min"), salary_max=F.col("r.salaryRange.max"), location=place, is_remote=remote)

    return run


def ashby(slug: str, company: str, payload: str = "payload") -> Parser:
    """Plain description before the HTML's; salaries from the compensation summary; remote as said, else by place."""

    def run(df: DataFrame) -> DataFrame:
        r = _rows(df, "struct<jobs array<struct<id string, title string, descriptionHtml string, descriptionPlain string, jobUrl string, location string, isRemote boolean, compensationTierSummary string>>>", "jobs", payload)
        said = money.summary_range(F.col("r.compensationTierSummary"))
        text = F.coalesce("r.descriptionPlain", X.strip_html(F.col("r.descriptionHtml")))
        return _listing(r, "ashby", external_id=_id(f"ashby-{slug}-", F.col("r.id")), title=F.col("r.title"), company=F.lit(company), source_url=F.col("r.jobUrl"), apply_url=F.col("r.jobUrl"), description_html=F.nullif("r.descriptionHtml", F.lit("")), description_text=_some(text, F.col("r.title")), salary_min=said["min"], salary_max=said["max"], location=F.nullif("r.location", F.lit("")), is_remote=F.coalesce("r.isRemote", X.infer_remote(F.col("r.location"))))

    return run


def smartrecruiters(slug: str, company: str, payload: str = "payload") -> Parser:
    """Pages of postings, one payload each; city, region, and the country only without a region; the title as text."""

    def run(df: DataFrame) -> DataFrame:
        r = _rows(df, "struct<content array<struct<id string, uuid string, name string, location struct<city string, region string, country string, remote boolean>>>>", "content", payload)
        region = F.nullif("r.location.region", F.lit(""))
        place = F.nullif(F.concat_ws(", ", F.nullif("r.location.city", F.lit("")), region, F.when(region.isNull(), F.nullif("r.location.country", F.lit("")))), F.lit(""))
        url = _id(f"https://jobs.smartrecruiters.com/{slug}/", F.col("r.id"))
        return _listing(r, "smartrecruiters", external_id=_id(f"sr-{slug}-", F.col("r.uuid")), title=F.col("r.name"), company=F.lit(company), source_url=url, apply_url=url, description_text=F.col("r.name"), location=place, is_remote=F.coalesce("r.location.remote", X.infer_remote(place)))

    return run


def _feed_items(items: DataFrame) -> DataFrame:
    """(title, link, html, key) of feed items to listings; items without a title or link are dropped. The id is rss- and
    the first 20 characters of base64url of the key's SHA-256."""
    r = items.filter(_some(X.trim_all(F.col("title"))).isNotNull() & _some(F.col("link")).isNotNull())
    # The text, and what is read from it, are columns of their own, so that each is made once.
    r = r.withColumns({"_named": titles.split_feed_title(X.trim_all(F.col("title"))), "_text": F.coalesce(X.strip_html(F.col("html")), F.lit(""))})
    r = r.withColumns({"_said": money.shown_range(F.col("_text")), "_place": places.place_in_text(F.col("_text"))})
    named, text, said, place = (F.col(c) for c in ("_named", "_text", "_said", "_place"))
    key = F.substring(F.translate(F.base64(F.unhex(F.sha2(_some(F.col("key"), F.col("link")), 256))), "+/", "-_"), 1, 20)
    return _listing(r, "rss", external_id=F.concat(F.lit("rss-"), key), title=named["title"], company=named["company"], source_url=F.col("link"), apply_url=F.col("link"), description_html=F.nullif("html", F.lit("")), description_text=_some(text, named["title"]), salary_min=said["min"], salary_max=said["max"], location=place, is_remote=X.infer_remote(F.coalesce(place, text)))


def rss(payload: str = "payload") -> Parser:
    """RSS 2.0: full content before the description; the key is the guid, else the link."""

    def run(df: DataFrame) -> DataFrame:
        schema = "channel struct<item array<struct<title string, link string, description string, encoded string, guid struct<_VALUE string, _isPermaLink string>>>>"
        plain = F.regexp_replace(F.regexp_replace(payload, "content:encoded", "encoded"), r"<guid>", '<guid isPermaLink="true">')
        r = df.select(F.explode(F.from_xml(plain, schema)["channel"]["item"]).alias("r"))
        return _feed_items(r.select("r.title", "r.link", F.coalesce("r.encoded", "r.description").alias("html"), F.col("r.guid._VALUE").alias("key")))

    return run


def atom(payload: str = "payload") -> Parser:
    """Atom: the first link's address, else its text; the summary before the content; the entry's id as key."""

    def run(df: DataFrame) -> DataFrame:
        schema = "entry array<struct<title string, id string, summary string, content string, link array<struct<_href string, _VALUE string>>>>"
        # A text node beside attributes is only read as such if the element has one.
        plain = F.regexp_replace(F.regexp_replace(payload, r"<(title|summary|content)\s[^>]*[^/>]>", "<$1>"), r"<link>", '<link rel="alternate">')
        r = df.select(F.explode(F.from_xml(plain, schema)["entry"]).alias("r"))
        link = F.get("r.link", F.lit(0))
        return _feed_items(r.select("r.title", F.coalesce(link["_href"], link["_VALUE"]).alias("link"), F.coalesce("r.summary", "r.content").alias("html"), F.col("r.id").alias("key")))

    return run


def web_search(payload: str = "payload", page: str = "page", query: str = "") -> Parser:
    """Search results: pages of one job, the first of each id by page and place. The place is the title's, the snippet's
    or the address's; the query stands in for a missing title."""

    def run(df: DataFrame) -> DataFrame:
        from feedloom.operators.merging import keep_first

        rows = df.select(page, F.posexplode(F.from_json(payload, "struct<results array<struct<title string, url string, content string>>>")["results"]).alias("place", "r"))
        jobs = rows.filter(is_job_page(F.col("r.url")))
        made = jobs.withColumn("external_id", X.url_id(F.col("r.url"))).withColumn("_at", F.struct(page, "place")).transform(keep_first(["external_id"], "_at"))
        named = titles.split_search_title(F.col("r.title"))
        place = F.coalesce(named["location"], places.place_in_snippet(F.col("r.content")), places.place_in_slug(F.col("r.url")))
        title = _some(named["title"], F.lit(query))
        out = _listing(made.withColumn("_id", F.col("external_id")), "web", external_id=F.col("_id"), title=title, company=_some(named["company"], F.lit("Unknown")), source_url=F.col("r.url"), apply_url=F.col("r.url"), description_text=_some(F.col("r.content"), title), location=place, is_remote=X.infer_remote(F.coalesce(place, F.col("r.content"))))
        return out.withColumn("source_name", X.source_of(F.col("source_url")))

    return run


def is_valid() -> Column:
    """Required texts not empty, addresses with a scheme and host, salaries not negative, location null or not empty."""
    full = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    url = lambda c: F.col(c).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+")
    fine = full("source_name") & full("external_id") & full("title") & full("company") & full("description_text") & F.coalesce(url("source_url"), F.lit(False))
    fine = fine & (F.col("apply_url").isNull() | url("apply_url"))
    for c in ("salary_min", "salary_max"):
        fine = fine & F.coalesce(F.col(c) >= 0, F.lit(True))
    return fine & (F.col("location").isNull() | full("location"))


def parse_failures(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row: payloads, and those that are not JSON."""
    return df.agg(F.count("*").alias("payloads"), F.count_if(F.try_parse_json(payload).isNull()).alias("failed"))


def normalized(df: DataFrame, position: str | None = None) -> DataFrame:
    """Valid listings with cleaned texts, capped salaries, remote inference, country, benefits, search text and
    fingerprint; with a position column, the first row of each fingerprint of a source."""
    from feedloom.operators.merging import keep_first

    out = df.filter(is_valid()).withColumns(
        {"title": X.title_case(X.trim_all(F.col("title"))), "company": X.trim_all(F.col("company")), "location": X.trim_all(F.col("location")), "description_text": X.sanitize_text(F.col("description_text")), "salary_min": money.cap(F.col("salary_min"), 500_000), "salary_max": money.cap(F.col("salary_max"), 1_000_000), "is_remote": F.coalesce("is_remote", X.infer_remote(F.col("location")))}
    )
    out = out.withColumns({"country": places.country_of(F.col("location")), "benefits": X.benefits_section(F.col("description_html"), F.col("description_text")), "search_text": F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("title", "company", "description_text"))), "fingerprint": X.fingerprint(F.col("title"), F.col("company"), F.col("location"))})
    return out.transform(keep_first(["source_name", "fingerprint"], position)) if position else out


def restored(df: DataFrame) -> DataFrame:
    """Stored rows as normalised listings: nulls of texts become empty, of country Unknown; fingerprint and search text
    are made again, title and company as they are."""
    empty = F.lit("")
    out = df.withColumns({c: F.coalesce(c, empty) for c in ("title", "company", "description_text", "source_url") if c in df.columns} | {"country": F.coalesce("country", F.lit("Unknown"))})
    return out.withColumns({"search_text": F.concat_ws(" ", *(F.nullif(c, empty) for c in ("title", "company", "description_text"))), "fingerprint": X.fingerprint(F.col("title"), F.col("company"), F.col("location"))})


def normalized_counts(df: DataFrame) -> DataFrame:
    """One row: listings, those that are not valid, and valid ones that repeat a fingerprint of their source. Counted by
    fingerprint first, so a common one is a single row."""
    title, company, location = (X.trim_all(F.col(c)) for c in ("title", "company", "location"))
    rows = df.select("source_name", F.when(is_valid(), X.fingerprint(X.title_case(title), company, location)).alias("_f"))
    kinds = rows.groupBy("source_name", "_f").agg(F.count("*").alias("_n"))
    known = F.col("_f").isNotNull()
    return kinds.agg(F.sum("_n").alias("listings"), F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("invalid"), F.coalesce(F.sum(F.when(known, F.col("_n") - 1)), F.lit(0)).alias("repeated"))
