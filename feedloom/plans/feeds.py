"""Queries on source payloads: each makes a payload of every document and parses it; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import money, places, titles
from feedloom.functions import text as X
from feedloom.operators import enrichment
from feedloom.plans.stored import table
from feedloom.sources import payloads


def key() -> Column:
    """The number of a document."""
    return F.col("doc_id")


def _s(*parts: Column | str) -> Column:
    """Parts as one text; strings are constants."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def place_of_key() -> Column:
    """Where a job is, by the document's number: a word for remote, a city, anywhere, an empty text, or nothing."""
    return F.when(key() % 5 == 0, "Remote, US").when(key() % 5 == 1, "Berlin, Germany").when(key() % 5 == 2, "Anywhere").when(key() % 5 == 3, "")


def html_of_key() -> Column:
    """A description as markup, or an empty one."""
    return F.when(key() % 3 > 0, _s("<p>", F.col("text"), "</p><br/>a &amp; b")).otherwise("")


def low_pay() -> Column:
    """The lower pay, if stated."""
    return F.when(key() % 4 > 0, key() + 50_000)


def high_pay() -> Column:
    """The higher pay, if stated."""
    return F.when(key() % 4 > 1, key() + 60_000)


PLACE_SQL = "CASE k % 5 WHEN 0 THEN 'Remote, US' WHEN 1 THEN 'Berlin, Germany' WHEN 2 THEN 'Anywhere' WHEN 3 THEN '' END"
REMOTE_SQL = "CASE k % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE END"
PAY_SQL = "CASE WHEN k % 4 > 0 THEN k + 50000.0::DOUBLE END AS salary_min, CASE WHEN k % 4 > 1 THEN k + 60000.0::DOUBLE END AS salary_max"


def _strip(x: str) -> str:
    return rf"trim(regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '[\s\x{{00A0}}]+', ' ', 'g'))"


HTML_SQL = _strip("'<p>' || text || '</p><br/>a &amp; b'")
DOCS = "(SELECT doc_id AS k, text, lang, source FROM documents)"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _payload(*fields: Column, path: str | None = None, before: Column | None = None) -> Column:
    """JSON text of an array with one record, below a field if there is a path."""
    rows = F.array(*([before] if before is not None else []), F.struct(*fields))
    return F.to_json(F.struct(rows.alias(path)) if path else rows).alias("payload")


def _shown(listings: DataFrame) -> DataFrame:
    return listings.select("external_id", "title", "company", "source_url", "apply_url", "salary_min", "salary_max", "location", "is_remote", F.col("description_html").isNotNull().alias("has_html"), F.sha2("description_text", 256).alias("digest"))


def _sql(prefix: str, title: str, company: str, url: str, apply_url: str, pay: str, place: str, remote: str, html: str, text: str, where: str = "TRUE") -> str:
    return f"SELECT {prefix} AS external_id, {title} AS title, {company} AS company, {url} AS source_url, {apply_url} AS apply_url, {pay}, {place} AS location, {remote} AS is_remote, {html} AS has_html, sha256({text}) AS digest FROM {DOCS} WHERE {where}"


def payload_remoteok(spark, sf_dir):
    """The first record is a notice; every seventh has no title."""
    job = [_s(key()).alias("id"), F.when(key() % 7 > 0, _s("Role ", key())).alias("position"), F.col("source").alias("company"), html_of_key().alias("description"), place_of_key().alias("location"), low_pay().alias("salary_min"), high_pay().alias("salary_max"), _s("https://r.example/", key()).alias("url"), F.when(key() % 2 == 0, _s("https://a.example/", key())).alias("apply_url")]
    empty = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in [("id", "string"), ("position", "string"), ("company", "string"), ("description", "string"), ("location", "string"), ("salary_min", "bigint"), ("salary_max", "bigint"), ("url", "string"), ("apply_url", "string")]))
    return _shown(_docs(spark, sf_dir).select(_payload(*job, before=empty)).transform(payloads.remoteok()))


def payload_jobicy(spark, sf_dir):
    job = [key().alias("id"), _s("https://j.example/", key()).alias("url"), _s("Role ", key()).alias("jobTitle"), F.col("source").alias("companyName"), place_of_key().alias("jobGeo"), _s("In short: ", F.col("lang")).alias("jobExcerpt"), html_of_key().alias("jobDescription"), low_pay().alias("annualSalaryMin"), high_pay().alias("annualSalaryMax")]
    return _shown(_docs(spark, sf_dir).select(_payload(*job, path="jobs")).transform(payloads.jobicy()))


def payload_himalayas(spark, sf_dir):
    """A guid for every second, numbers for some, a salary text for all, and two places for every third."""
    said = F.when(key() % 3 == 0, _s("$", key() % 90 + 100, "k - $", key() % 90 + 130, "k")).when(key() % 3 == 1, _s("$", key() + 100_000, " - $", key() + 120_000)).otherwise("Competitive")
    where = F.when(key() % 3 == 0, F.array(F.lit("Germany"), F.lit("Remote"))).when(key() % 3 == 1, F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>"))
    job = [_s("i", key()).alias("id"), F.when(key() % 2 == 0, _s("g", key())).alias("guid"), _s("Role ", key()).alias("title"), F.col("source").alias("companyName"), html_of_key().alias("description"), _s("https://h.example/", key()).alias("applicationLink"), F.when(key() % 4 == 3, key() + 50_000).alias("minSalary"), F.when(key() % 4 > 1, key() + 60_000).alias("maxSalary"), said.alias("salary"), where.alias("locationRestrictions")]
    return _shown(_docs(spark, sf_dir).select(_payload(*job, path="jobs")).transform(payloads.himalayas()))


def payload_themuse(spark, sf_dir):
    name = lambda x: F.struct(F.lit(x).alias("name"))
    where = F.when(key() % 4 == 0, F.array(name("Paris"), name("Flexible / Remote"))).when(key() % 4 == 1, F.array(name("Oslo"))).otherwise(F.slice(F.array(name("x")), 1, 0))
    page = F.struct(F.when(key() % 2 == 0, _s("https://m.example/", key())).alias("landing_page"))
    job = [key().alias("id"), _s("Role ", key()).alias("name"), F.struct(F.col("source").alias("name")).alias("company"), html_of_key().alias("contents"), where.alias("locations"), page.alias("refs")]
    return _shown(_docs(spark, sf_dir).select(_payload(*job, path="results")).transform(payloads.themuse()))


def payload_serply(spark, sf_dir):
    found = F.struct(F.when(key() % 2 == 0, _s("$", key() % 50 + 70, "k to $", key() % 50 + 90, "k")).otherwise("Competitive").alias("salary"), F.when(key() % 4 == 3, key() + 50_000).alias("salary_min"), F.when(key() % 4 > 1, key() + 60_000).alias("salary_max"))
    job = [_s(key()).alias("job_id"), _s("Role ", key()).alias("title"), F.col("source").alias("company_name"), html_of_key().alias("description"), F.when(key() % 2 == 0, _s("A snippet of ", F.col("source"))).alias("snippet"), place_of_key().alias("location"), _s("https://s.example/", key()).alias("link"), F.when(key() % 2 == 0, _s("https://a.example/", key())).alias("apply_link"), found.alias("detected_extensions")]
    return _shown(_docs(spark, sf_dir).select(_payload(*job, path="jobs")).transform(payloads.serply()))


def payload_greenhouse(spark, sf_dir):
    """A pay range in the text of some; places by name, else by the first office."""
    html = F.when(key() % 3 > 0, _s("<p>", F.col("text"), "</p> Salary range: $", key() % 80 + 100, ",000 - $", key() % 80 + 120, ",000")).otherwise("")
    office = F.array(F.struct(F.lit("HQ").alias("name"), F.when(key() % 4 == 1, "Remote, Spain").otherwise("").alias("location")))
    job = [key().alias("id"), _s("Role ", key()).alias("title"), html.alias("content"), _s("https://g.example/", key()).alias("absolute_url"), F.struct(F.when(key() % 2 == 0, "Remote - US").when(key() % 4 == 1, "").alias("name")).alias("location"), office.alias("offices")]
    return _shown(_docs(spark, sf_dir).select(_payload(*job, path="jobs")).transform(payloads.greenhouse("acme", "Acme")))


def payload_lever(spark, sf_dir):
    pay = F.when(key() % 4 > 1, F.struct((key() + 50_000).alias("min"), F.when(key() % 4 == 3, key() + 60_000).alias("max")))
    job = [_s(key()).alias("id"), _s("Role ", key()).alias("text"), html_of_key().alias("description"), F.when(key() % 2 == 0, _s("plain ", F.col("source"))).alias("descriptionPlain"), F.when(key() % 4 == 0, "<b>more</b>").alias("additional"), F.when(key() % 8 == 4, "and more").alias("additionalPlain"), _s("https://l.example/", key()).alias("hostedUrl"), _s("https://l.example/apply/", key()).alias("applyUrl"), F.when(key() % 6 == 1, "remote").otherwise("on-site").alias("workplaceType"), F.struct(place_of_key().alias("location")).alias("categories"), pay.alias("salaryRange")]
    return _shown(_docs(spark, sf_dir).select(_payload(*job)).transform(payloads.lever("acme", "Acme")))


def payload_ashby(spark, sf_dir):
    """Summaries with a k, without one, and without a range."""
    said = F.when(key() % 4 == 0, _s("$", key() % 80 + 100, "K - $", key() % 80 + 120, "K USD")).when(key() % 4 == 1, _s("$", key() % 80 + 100, ",000 to $", key() % 80 + 120, ",500")).when(key() % 4 == 2, _s("$", key() % 80 + 100, " - $", key() % 80 + 120))
    job = [_s(key()).alias("id"), _s("Role ", key()).alias("title"), html_of_key().alias("descriptionHtml"), F.when(key() % 2 == 0, F.when(key() % 6 == 0, "").otherwise(_s("plain ", F.col("source")))).alias("descriptionPlain"), _s("https://b.example/", key()).alias("jobUrl"), place_of_key().alias("location"), F.when(key() % 7 == 0, True).when(key() % 7 == 1, False).alias("isRemote"), said.alias("compensationTierSummary")]
    return _shown(_docs(spark, sf_dir).select(_payload(*job, path="jobs")).transform(payloads.ashby("acme", "Acme")))


def payload_smartrecruiters(spark, sf_dir):
    place = F.struct(F.when(key() % 2 == 0, "Madrid").otherwise("").alias("city"), F.when(key() % 3 == 0, "MD").alias("region"), F.when(key() % 5 > 0, "es").alias("country"), F.when(key() % 7 == 0, True).alias("remote"))
    job = [_s(key()).alias("id"), _s("u", key()).alias("uuid"), _s("Role ", key()).alias("name"), place.alias("location")]
    return _shown(_docs(spark, sf_dir).select(_payload(*job, path="content")).transform(payloads.smartrecruiters("acme", "Acme")))


def _plain(c: Column) -> Column:
    """Text that may stand in XML."""
    return F.regexp_replace(c, r"[^A-Za-z0-9 .,\n]", "")


def item_title() -> Column:
    """Forms of an item's title, by the document's number."""
    return F.when(key() % 4 == 0, _s("Acme ", key(), " is hiring Dev")).when(key() % 4 == 1, _s("Dev at Acme ", key())).when(key() % 4 == 2, _s("Dev - Acme ", key())).otherwise(_s("Dev ", key()))


def item_said() -> Column:
    """What an item's text says of place and pay, by the document's number."""
    return F.when(key() % 3 == 0, _s(" based in Salt Lake City, UT. Pay $", key() % 50 + 100, "k - $", key() % 50 + 120, "k")).when(key() % 3 == 1, " remote").otherwise("")


def payload_rss(spark, sf_dir):
    """Content before the description; a guid with and without an attribute, or none; every eleventh has no link."""
    tag = lambda name, c: _s(f"<{name}>", c, f"</{name}>")
    guid = F.when(key() % 3 == 0, _s("<guid>g", key(), "</guid>")).when(key() % 3 == 1, _s('<guid isPermaLink="false">p', key(), "</guid>")).otherwise("")
    body = F.concat(_plain(F.col("text")), item_said())
    item = F.concat(F.lit("<item>"), tag("title", item_title()), F.when(key() % 11 > 0, tag("link", _s("https://f.example/", key()))).otherwise(""), tag("description", F.when(key() % 2 == 0, "short").otherwise(body)), F.when(key() % 2 == 0, tag("content:encoded", body)).otherwise(""), guid, F.lit("</item>"))
    return _shown(_docs(spark, sf_dir).select(F.concat(F.lit('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'), item, F.lit("</channel></rss>")).alias("payload")).transform(payloads.rss()))


def payload_atom(spark, sf_dir):
    """A link by attribute or as text, titles with a type, the summary before the content."""
    body = F.concat(_plain(F.col("text")), item_said())
    link = F.when(key() % 2 == 0, _s('<link rel="alternate" href="https://f.example/', key(), '"/>')).otherwise(_s("<link>https://f.example/", key(), "</link>"))
    text = F.when(key() % 5 == 0, _s('<content type="text">', body, "</content>")).otherwise(_s("<summary>", body, "</summary><content>other</content>"))
    entry = F.concat(F.lit("<entry>"), F.when(key() % 3 == 0, F.lit('<title type="text">')).otherwise("<title>"), item_title(), F.lit("</title>"), link, _s("<id>e", key(), "</id>"), text, F.lit("</entry>"))
    return _shown(_docs(spark, sf_dir).select(F.concat(F.lit("<feed>"), entry, F.lit("</feed>")).alias("payload")).transform(payloads.atom()))


def payload_web_search(spark, sf_dir):
    """Two results a page: one on a board, which the next page repeats, and one that is no job page."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id")
    result = lambda title, url, content: F.struct(title.alias("title"), url.alias("url"), content.alias("content"))
    title = F.when(k % 3 == 0, _s("Acme hiring Dev ", k, " in Austin, TX | LinkedIn")).when(k % 3 == 1, _s("Dev ", k, " at Acme - Indeed")).otherwise("")
    board = lambda n: _s("https://www.linkedin.com/jobs/view/dev-", n + 10_000)
    both = F.array(result(title, board(F.floor(k / 2)), F.when(k % 4 == 0, "Works in Reno, NV 89501 on site").when(k % 4 == 1, "fully remote").otherwise("x")), result(F.lit("A wiki"), _s("https://en.wikipedia.org/wiki/", k), F.lit("y")))
    rows = p.select(F.to_json(F.struct(both.alias("results"))).alias("payload"), k.alias("page"))
    found = rows.transform(payloads.web_search(query="the query"))
    return found.select("external_id", "source_name", "title", "company", "source_url", "location", "is_remote", "description_text")


def listing_validity(spark, sf_dir):
    """How many listings are valid; every few lack something."""
    rows = _docs(spark, sf_dir).select(F.when(key() % 13 > 0, F.col("source")).alias("source_name"), _s(key()).alias("external_id"), F.when(key() % 11 > 0, "t").otherwise("").alias("title"), F.lit("c").alias("company"), F.col("text").alias("description_text"), F.when(key() % 7 > 0, "https://x.example/a").otherwise("no address").alias("source_url"), F.when(key() % 5 == 0, "ftp://y.example").when(key() % 5 == 1, "y.example").alias("apply_url"), (key() % 17 - 1).cast("double").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"), F.when(key() % 19 == 0, "").when(key() % 19 == 1, "Rome").alias("location"))
    return rows.select(payloads.is_valid().alias("valid")).groupBy("valid").agg(F.count("*").alias("n"))


def _raw(spark, sf_dir) -> DataFrame:
    """Documents as raw listings: titles that differ in case and space only every three rows of a source."""
    d = _docs(spark, sf_dir)
    shown = F.when(key() % 2 == 0, _s("  senior dev ", F.floor(key() / 3))).otherwise(_s("SENIOR\tDEV ", F.floor(key() / 3)))
    return d.select(key().alias("position"), F.lit("feed").alias("source_name"), _s(key()).alias("external_id"), shown.alias("title"), F.lit(" Acme ").alias("company"), _s("https://x.example/", key()).alias("source_url"), F.lit(None).cast("string").alias("apply_url"), F.when(key() % 23 > 0, F.col("text")).otherwise("").alias("description_text"), F.lit(None).cast("string").alias("description_html"), (key() * 1000.0).alias("salary_min"), (key() * 2000.0).alias("salary_max"), F.when(key() % 3 == 0, "Remote").when(key() % 3 == 1, "Berlin, Germany ").otherwise("Remote").alias("location"), F.when(key() % 5 == 0, False).alias("is_remote"))


def normalised(spark, sf_dir):
    found = payloads.normalized(_raw(spark, sf_dir), "position")
    return found.select("external_id", "title", "company", "location", "salary_min", "salary_max", "is_remote", "country", "fingerprint", F.sha2("search_text", 256).alias("digest"))


def normalised_counts(spark, sf_dir):
    return payloads.normalized_counts(_raw(spark, sf_dir))


def shown_ranges(spark, sf_dir):
    """Pay in texts: '$a - $b' of feed items, labelled ranges, and rates or ranges of snippets."""
    said = F.when(key() % 5 == 0, _s("Pay $", key() % 90 + 100, "k - $", key() % 90 + 130, "k a year")).when(key() % 5 == 1, _s("at $", key() % 60 + 20, ".50 an hour")).when(key() % 5 == 2, _s("Compensation: ", key() % 90 + 100, ",000 to ", key() % 90 + 130, ",000")).when(key() % 5 == 3, _s("from $", key() % 90 + 100, ",000 – $", key() % 90 + 130, ",500"))
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("A job. "), said, F.lit(". Apply.")).alias("said"))
    pair = lambda c, name: [c["min"].alias(f"{name}_min"), c["max"].alias(f"{name}_max")]
    c = F.col("said")
    return d.select("doc_id", *pair(money.shown_range(c), "item"), *pair(money.labelled_range(c), "label"), *pair(money.snippet_salary(c), "snippet"))


def search_titles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = F.col("s_suppkey")
    forms = F.when(k % 5 == 0, _s(F.col("s_name"), " hiring Dev ", k, " in Lyon | LinkedIn")).when(k % 5 == 1, _s(F.col("s_name"), " Hiring Dev ", k)).when(k % 5 == 2, _s("Dev ", k, " - Jobs - Careers at ", F.col("s_name"))).when(k % 5 == 3, _s("Dev ", k, " @ ", F.col("s_name"), " – Glassdoor")).otherwise(_s("Dev ", k))
    return s.select("s_suppkey", titles.split_search_title(forms).alias("t")).select("s_suppkey", "t.*")


def place_sources(spark, sf_dir):
    """Places in texts, snippets and slugs, aliases, broadening, and remote by place, of customers in 12 shapes."""
    k = F.col("c_custkey")
    city = lambda *names: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", _s("Dev. ", city("Based in Salt Lake City, UT", "Location: Reno, NV", "we are in Rome, IT", "located in New Haven, CT"), " now").alias("said"),
        city("Works in Reno, NV 89501", "Rome, IT today", "St. Paul, MN", "nowhere").alias("snippet"), _s("https://www.linkedin.com/jobs/view/dev-", city("austin-tx", "rome-it", "reno-nv"), "-", k + 10_000).alias("url"),
        city("NYC", " sf ", "Boston", "dc", "Remote").alias("place"), city("Newark, NJ", "Paris, France", "TX", "Reno", "Austin, tx").alias("wide"))
    return c.select("c_custkey", places.place_in_text(F.col("said")).alias("from_text"), places.place_in_snippet(F.col("snippet")).alias("from_snippet"), places.place_in_slug(F.col("url")).alias("from_slug"), places.normal_place(F.col("place")).alias("usual"), X.infer_remote(F.col("place")).alias("remote"), places.broadened(F.col("wide")).alias("broad"))


def page_blocks(spark, sf_dir):
    """Descriptions of pages made of documents: a block with nested ones, a meta element, or two sections."""
    plain = F.regexp_replace("text", '[<>"]', "")
    block = F.concat(F.lit('<div><div class="show-more-less-html__markup a" id="b"> '), plain, F.lit("<div>in<div></div></div> tail </div>rest</div></div>"))
    meta = F.concat(F.lit('<head><META name="description" content=" '), plain, F.lit('"/></head>'))
    parts = F.concat(F.lit('<section class="a">'), plain, F.lit("</section>x<SECTION>"), plain, F.lit(" more </SECTION><section>"), plain, F.lit(" last</section>"))
    html = F.when(key() % 3 == 0, block).when(key() % 3 == 1, meta).otherwise(parts)
    d = table(spark, sf_dir, "documents").select("doc_id", enrichment.page_description(html).alias("d"))
    return d.select("doc_id", F.length("d").alias("chars"), F.sha2("d", 256).alias("digest"))


def entity_texts(spark, sf_dir):
    """Documents escaped, in lines of markup with numeric entities, and back."""
    plain = F.regexp_replace("text", r"[&\s]+", " ")
    html = F.concat(F.lit("<div>"), X.escape_html(plain), F.lit("</div><p class='x'>&#233;&#x41; &amp; more<br/>end</p>"))
    d = table(spark, sf_dir, "documents").select("doc_id", X.strip_html_lines(html).alias("d"))
    return d.select("doc_id", F.sha2("d", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (payload_remoteok, payload_jobicy, payload_himalayas, payload_themuse, payload_serply, payload_greenhouse, payload_lever, payload_ashby, payload_smartrecruiters, payload_rss, payload_atom, payload_web_search, listing_validity, normalised, normalised_counts, shown_ranges, search_titles, place_sources, page_blocks, entity_texts)}

_NO_PAY = "CAST(NULL AS DOUBLE) AS salary_min, CAST(NULL AS DOUBLE) AS salary_max"
_ITEM_TITLE = "CASE k % 4 WHEN 3 THEN 'Dev ' || k ELSE 'Dev' END"
_ITEM_COMPANY = "CASE k % 4 WHEN 3 THEN 'Unknown' ELSE 'Acme ' || k END"
_BODY = r"""trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 .,\n]', '', 'g') || CASE k % 3 WHEN 0 THEN ' based in Salt Lake City, UT. Pay $' || (k % 50 + 100) || 'k - $' || (k % 50 + 120) || 'k' WHEN 1 THEN ' remote' ELSE '' END, '\s+', ' ', 'g'))"""
_ITEM_PAY = "CASE WHEN k % 3 = 0 THEN (k % 50 + 100) * 1000.0::DOUBLE END AS salary_min, CASE WHEN k % 3 = 0 THEN (k % 50 + 120) * 1000.0::DOUBLE END AS salary_max"
_ITEM_PLACE = "CASE WHEN k % 3 = 0 THEN 'Salt Lake City, UT' END"
_ITEM_REMOTE = f"CASE WHEN k % 3 = 0 THEN FALSE WHEN {_BODY} <> '' THEN contains(lower({_BODY}), 'remote') END"


def _hash20(x: str) -> str:
    """The first 20 characters of base64url of a SHA-256."""
    return f"'rss-' || substr(replace(replace(base64(unhex(sha256({x}))), '+', '-'), '/', '_'), 1, 20)"


SQL = {
    "payload_remoteok": _sql("'remoteok-' || k", "CASE WHEN k % 7 > 0 THEN 'Role ' || k END", "source", "'https://r.example/' || k", "CASE WHEN k % 2 = 0 THEN 'https://a.example/' || k END", PAY_SQL, PLACE_SQL, REMOTE_SQL, "k % 3 > 0", f"CASE WHEN k % 3 > 0 THEN {HTML_SQL} END"),
    "payload_jobicy": _sql("'jobicy-' || k", "'Role ' || k", "source", "'https://j.example/' || k", "CAST(NULL AS VARCHAR)", PAY_SQL, PLACE_SQL, "CASE k % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE END", "k % 3 > 0", f"CASE WHEN k % 3 > 0 THEN {HTML_SQL} ELSE 'In short: ' || lang END"),
    "payload_himalayas": _sql("'himalayas-' || CASE WHEN k % 2 = 0 THEN 'g' ELSE 'i' END || k", "'Role ' || k", "source", "'https://h.example/' || k", "'https://h.example/' || k",
        "CASE WHEN k % 4 = 3 THEN k + 50000.0::DOUBLE WHEN k % 4 < 2 AND k % 3 = 0 THEN (k % 90 + 100) * 1000.0::DOUBLE WHEN k % 4 < 2 AND k % 3 = 1 THEN k + 100000.0::DOUBLE END AS salary_min, CASE WHEN k % 4 > 1 THEN k + 60000.0::DOUBLE WHEN k % 3 = 0 THEN (k % 90 + 130) * 1000.0::DOUBLE WHEN k % 3 = 1 THEN k + 120000.0::DOUBLE END AS salary_max",
        "CASE k % 3 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Remote' END", "CASE k % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END", "k % 3 > 0", f"CASE WHEN k % 3 > 0 THEN {HTML_SQL} END"),
    "payload_themuse": _sql("'themuse-' || k", "'Role ' || k", "source", "CASE WHEN k % 2 = 0 THEN 'https://m.example/' ELSE 'https://www.themuse.com/jobs/' END || k", "CAST(NULL AS VARCHAR)", _NO_PAY, "CASE k % 4 WHEN 0 THEN 'Paris' WHEN 1 THEN 'Oslo' END", "CASE k % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END", "k % 3 > 0", f"CASE WHEN k % 3 > 0 THEN {HTML_SQL} END"),
    "payload_serply": _sql("'serply-' || k", "'Role ' || k", "source", "'https://s.example/' || k", "CASE WHEN k % 2 = 0 THEN 'https://a.example/' || k END",
        "CASE WHEN k % 4 = 3 THEN k + 50000.0::DOUBLE WHEN k % 4 = 0 THEN (k % 50 + 70) * 1000.0::DOUBLE END AS salary_min, CASE WHEN k % 4 > 1 THEN k + 60000.0::DOUBLE WHEN k % 4 = 0 THEN (k % 50 + 90) * 1000.0::DOUBLE END AS salary_max",
        PLACE_SQL, REMOTE_SQL, "k % 3 > 0 OR k % 2 = 0", f"CASE WHEN k % 3 > 0 THEN {HTML_SQL} WHEN k % 2 = 0 THEN 'A snippet of ' || source END"),
    "payload_greenhouse": _sql("'gh-acme-' || k", "'Role ' || k", "'Acme'", "'https://g.example/' || k", "'https://g.example/' || k",
        "CASE WHEN k % 3 > 0 THEN (k % 80 + 100) * 1000.0::DOUBLE END AS salary_min, CASE WHEN k % 3 > 0 THEN (k % 80 + 120) * 1000.0::DOUBLE END AS salary_max",
        "CASE WHEN k % 2 = 0 THEN 'Remote - US' WHEN k % 4 = 1 THEN 'Remote, Spain' ELSE 'HQ' END", "CASE WHEN k % 2 = 0 THEN TRUE END", "k % 3 > 0",
        "CASE WHEN k % 3 > 0 THEN " + _strip("'<p>' || text || '</p> Salary range: $' || (k % 80 + 100) || ',000 - $' || (k % 80 + 120) || ',000'") + " ELSE 'Role ' || k END"),
    "payload_lever": f"""WITH d AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'plain ' || source WHEN k % 3 > 0 THEN {HTML_SQL} ELSE '' END AS a, CASE WHEN k % 8 = 4 THEN 'and more' WHEN k % 4 = 0 THEN 'more' ELSE '' END AS b FROM {DOCS})
 SELECT 'lever-acme-' || k AS external_id, 'Role ' || k AS title, 'Acme' AS company, 'https://l.example/' || k AS source_url, 'https://l.example/apply/' || k AS apply_url, CASE WHEN k % 4 > 1 THEN k + 50000.0::DOUBLE END AS salary_min, CASE WHEN k % 4 = 3 THEN k + 60000.0::DOUBLE END AS salary_max,
 nullif({PLACE_SQL}, '') AS location, CASE WHEN k % 6 = 1 THEN TRUE ELSE {REMOTE_SQL} END AS is_remote, k % 3 > 0 AS has_html, sha256(CASE WHEN a || b = '' THEN 'Role ' || k WHEN a = '' OR b = '' THEN a || b ELSE a || ' ' || b END) AS digest FROM d""",
    "payload_ashby": _sql("'ashby-acme-' || k", "'Role ' || k", "'Acme'", "'https://b.example/' || k", "'https://b.example/' || k",
        "CASE k % 4 WHEN 0 THEN (k % 80 + 100) * 1000.0::DOUBLE WHEN 1 THEN (k % 80 + 100) * 1000.0::DOUBLE WHEN 2 THEN (k % 80 + 100)::DOUBLE END AS salary_min, CASE k % 4 WHEN 0 THEN (k % 80 + 120) * 1000.0::DOUBLE WHEN 1 THEN (k % 80 + 120) * 1000.0::DOUBLE + 500 WHEN 2 THEN (k % 80 + 120)::DOUBLE END AS salary_max",
        f"nullif({PLACE_SQL}, '')", f"CASE k % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE {REMOTE_SQL} END", "k % 3 > 0", f"CASE WHEN k % 2 = 0 AND k % 6 > 0 THEN 'plain ' || source WHEN k % 2 = 1 AND k % 3 > 0 THEN {HTML_SQL} ELSE 'Role ' || k END"),
    "payload_smartrecruiters": """WITH p AS (SELECT doc_id AS k, concat_ws(', ', CASE WHEN doc_id % 2 = 0 THEN 'Madrid' END, CASE WHEN doc_id % 3 = 0 THEN 'MD' WHEN doc_id % 5 > 0 THEN 'es' END) AS p FROM documents)
 SELECT 'sr-acme-u' || k AS external_id, 'Role ' || k AS title, 'Acme' AS company, 'https://jobs.smartrecruiters.com/acme/' || k AS source_url, 'https://jobs.smartrecruiters.com/acme/' || k AS apply_url, CAST(NULL AS DOUBLE) AS salary_min, CAST(NULL AS DOUBLE) AS salary_max, nullif(p, '') AS location, CASE WHEN k % 7 = 0 THEN TRUE WHEN p <> '' THEN FALSE END AS is_remote, FALSE AS has_html, sha256('Role ' || k) AS digest FROM p""",
    "payload_rss": _sql(_hash20("CASE k % 3 WHEN 0 THEN 'g' || k WHEN 1 THEN 'p' || k ELSE 'https://f.example/' || k END"), _ITEM_TITLE, _ITEM_COMPANY, "'https://f.example/' || k", "'https://f.example/' || k", _ITEM_PAY, _ITEM_PLACE, _ITEM_REMOTE, f"{_BODY} <> ''", f"CASE WHEN {_BODY} = '' THEN {_ITEM_TITLE} ELSE {_BODY} END", "k % 11 > 0"),
    "payload_atom": _sql(_hash20("'e' || k"), _ITEM_TITLE, _ITEM_COMPANY, "'https://f.example/' || k", "'https://f.example/' || k", _ITEM_PAY, _ITEM_PLACE, _ITEM_REMOTE, f"{_BODY} <> ''", f"CASE WHEN {_BODY} = '' THEN {_ITEM_TITLE} ELSE {_BODY} END"),
    "payload_web_search": """WITH p AS (SELECT min(page_id) AS k, page_id // 2 AS n FROM pages GROUP BY 2),
 r AS (SELECT *, CASE k % 3 WHEN 0 THEN 'Austin, TX' END AS said, CASE k % 4 WHEN 0 THEN 'Works in Reno, NV 89501 on site' WHEN 1 THEN 'fully remote' ELSE 'x' END AS content FROM p),
 l AS (SELECT *, coalesce(said, CASE WHEN k % 4 = 0 THEN 'Works in Reno, NV' END) AS place FROM r)
 SELECT 'searxng-li-' || (n + 10000) AS external_id, 'linkedin' AS source_name, CASE k % 3 WHEN 2 THEN 'the query' ELSE 'Dev ' || k END AS title, CASE k % 3 WHEN 2 THEN 'Unknown' ELSE 'Acme' END AS company, 'https://www.linkedin.com/jobs/view/dev-' || (n + 10000) AS source_url, place AS location,
 contains(lower(coalesce(place, content)), 'remote') AS is_remote, content AS description_text FROM l""",
    "listing_validity": """SELECT doc_id % 13 > 0 AND doc_id % 11 > 0 AND text <> '' AND doc_id % 7 > 0 AND doc_id % 5 <> 1 AND doc_id % 17 > 0 AND doc_id % 19 > 0 AS valid, count(*) AS n FROM documents GROUP BY 1""",
    "normalised": r"""WITH r AS (SELECT doc_id AS k, regexp_replace(text, '(?is)<script\b.*?</script>', '', 'g') AS text FROM documents WHERE doc_id % 23 > 0 AND text <> ''),
 t AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'Senior Dev ' ELSE 'Senior' || chr(9) || 'Dev ' END || (k // 3) AS title, CASE WHEN k % 3 = 1 THEN 'Berlin, Germany' ELSE 'Remote' END AS location,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)on\w+\s*=\s*["''][^"'']*["'']', '', 'g'), '(?i)on\w+\s*=\s*\S+', '', 'g'), '(?i)javascript:', '', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS d FROM r),
 f AS (SELECT *, substr(sha256('seniordev' || (k // 3) || 'acme' || CASE WHEN k % 3 = 1 THEN 'berlingermany' ELSE 'remote' END), 1, 16) AS fingerprint FROM t)
 SELECT CAST(k AS VARCHAR) AS external_id, title, 'Acme' AS company, location, CASE WHEN k * 1000.0::DOUBLE <= 500000 THEN k * 1000.0::DOUBLE END AS salary_min, CASE WHEN k * 2000.0::DOUBLE <= 1000000 THEN k * 2000.0::DOUBLE END AS salary_max, CASE WHEN k % 5 = 0 THEN FALSE ELSE k % 3 <> 1 END AS is_remote, CASE WHEN k % 3 = 1 THEN 'DE' ELSE 'US' END AS country, fingerprint,
 sha256(concat_ws(' ', title, 'Acme', nullif(d, ''))) AS digest FROM f QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY k) = 1""",
    "normalised_counts": """WITH v AS (SELECT doc_id AS k, doc_id % 23 > 0 AND text <> '' AS fine FROM documents)
 SELECT count(*) AS listings, count(*) FILTER (WHERE NOT fine) AS invalid, count(*) FILTER (WHERE fine) - count(DISTINCT CASE WHEN fine THEN (k // 3) * 2 + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END END) AS repeated FROM v""",
    "shown_ranges": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN (doc_id % 90 + 100) * 1000.0::DOUBLE WHEN 3 THEN (doc_id % 90 + 100) * 1000.0::DOUBLE END AS item_min, CASE doc_id % 5 WHEN 0 THEN (doc_id % 90 + 130) * 1000.0::DOUBLE WHEN 3 THEN (doc_id % 90 + 130) * 1000.0::DOUBLE + 500 END AS item_max,
 CASE doc_id % 5 WHEN 0 THEN (doc_id % 90 + 100)::DOUBLE WHEN 2 THEN (doc_id % 90 + 100) * 1000.0::DOUBLE END AS label_min, CASE doc_id % 5 WHEN 0 THEN (doc_id % 90 + 130)::DOUBLE WHEN 2 THEN (doc_id % 90 + 130) * 1000.0::DOUBLE END AS label_max,
 CASE doc_id % 5 WHEN 0 THEN (doc_id % 90 + 100) * 1000.0::DOUBLE WHEN 1 THEN (doc_id % 60 + 20.5::DOUBLE) * 2080 WHEN 3 THEN (doc_id % 90 + 100) * 1000.0::DOUBLE END AS snippet_min, CASE doc_id % 5 WHEN 0 THEN (doc_id % 90 + 130) * 1000.0::DOUBLE WHEN 3 THEN (doc_id % 90 + 130) * 1000.0::DOUBLE + 500 END AS snippet_max FROM documents""",
    "search_titles": """SELECT s_suppkey, 'Dev ' || s_suppkey AS title, CASE s_suppkey % 5 WHEN 4 THEN 'Unknown' ELSE s_name END AS company, CASE s_suppkey % 5 WHEN 0 THEN 'Lyon' END AS location FROM supplier""",
    "place_sources": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Salt Lake City, UT' WHEN 1 THEN 'Reno, NV' WHEN 3 THEN 'New Haven, CT' END AS from_text, CASE c_custkey % 4 WHEN 0 THEN 'Works in Reno, NV' WHEN 2 THEN 'St. Paul, MN' END AS from_snippet,
 CASE c_custkey % 3 WHEN 0 THEN 'Austin, TX' WHEN 2 THEN 'Reno, NV' END AS from_slug, CASE c_custkey % 5 WHEN 0 THEN 'New York, NY' WHEN 1 THEN 'San Francisco, CA' WHEN 2 THEN 'Boston' WHEN 3 THEN 'Washington, DC' ELSE 'Remote' END AS usual,
 c_custkey % 5 = 4 AS remote, CASE c_custkey % 5 WHEN 0 THEN 'New York' WHEN 1 THEN 'Paris' WHEN 2 THEN 'Texas' WHEN 3 THEN 'Reno' ELSE 'Texas' END AS broad FROM customer""",
}
_EDGE = r"regexp_replace({}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
SQL["page_blocks"] = f"""WITH t AS (SELECT doc_id, regexp_replace(text, '[<>"]', '', 'g') AS t FROM documents),
 d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_EDGE.format("t || '<div>in<div></div></div> tail'")} WHEN 1 THEN CASE WHEN len({_EDGE.format('t')}) > 50 THEN {_EDGE.format('t')} END ELSE CASE WHEN len({_EDGE.format("t || ' more'")}) > 100 THEN {_EDGE.format("t || ' more'")} END END AS d FROM t)
 SELECT doc_id, CAST(len(d) AS INT) AS chars, sha256(d) AS digest FROM d"""
SQL["entity_texts"] = f"""WITH t AS (SELECT doc_id, regexp_replace(text, '[&\\s]+', ' ', 'g') AS t FROM documents) SELECT doc_id, sha256({_EDGE.format("t || chr(10) || chr(10) || 'éA & more' || chr(10) || 'end'")}) AS digest FROM t"""
