"""Queries on titles, sections, company facts, job pages, the catalog and enrichment over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import companies, scores, titles
from feedloom.functions import text as X
from feedloom.operators import catalog, enrichment, merging
from feedloom.plans.stored import table
from feedloom.sources import urls

AS_OF = "2024-02-01 00:00:00"


def _as_of():
    return F.to_timestamp(F.lit(AS_OF))


def feed_titles(spark, sf_dir):
    """Suppliers as companies in the five forms of feed titles, and one without a company."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    forms = [("", " is hiring Dev"), ("", ": Dev"), ("Dev at ", ""), ("Dev - ", ""), ("Dev | ", "")]
    k, title = F.col("s_suppkey") % 6, F.when(F.lit(False), "")
    for i, (before, after) in enumerate(forms):
        title = title.when(k == i, F.concat(F.lit(before), F.col("s_name"), F.lit(after)))
    return s.select("s_suppkey", titles.split_feed_title(title.otherwise("Dev - Senior")).alias("t")).select("s_suppkey", "t.title", "t.company")


def boilerplate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.strip_boilerplate(F.col("text")), 256).alias("digest"))


def benefit_lines(spark, sf_dir):
    """Each text's lines as a list below a header. No SQL: compared with a plain version in the tests."""
    html = F.concat(F.lit("<h2>Benefits</h2><ul><li>"), F.replace("text", F.lit("\n"), F.lit("</li><li>")), F.lit("</li></ul>"))
    return table(spark, sf_dir, "documents").select("doc_id", X.benefits_section(html, F.col("text")).alias("items"))


def company_facts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.floor("s_acctbal").cast("string").alias("b"))
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.col("s_name"), F.lit(" is a data/ai platform with "), key, F.lit("0 employees. It raised $"), key, F.lit(" million. Rated 4.2 out of 5. Revenue of $"), key, F.lit("M."))
    return s.select("s_suppkey", companies.facts(F.when(F.col("s_suppkey") % 3 > 0, text).otherwise(F.col("b"))).alias("f")).select("s_suppkey", "f.*")


#: Sentences that state a fact in each of its forms, K a number, and what must be read from them.
FACT_FORMS = [
    ("funding", "It has total funding of $K.5B over 7 rounds.", "$K.5B (7 rounds)"),
    ("funding", "Funding $KM so far.", "$KM"),
    ("funding", "A Series B funding round of $K million closed.", "Series B ($KM)"),
    ("funding", "They raised $K billion.", "$KB raised"),
    ("funding", "The firm K is publicly traded.", "Public"),
    ("growth", "Revenue grew from $KM to $9M last year.", "$KM to $9M"),
    ("growth", "Its $KM revenue is up from $3M. More.", "$KM revenue is up from $3M"),
    ("growth", "An ARR of $KM was told. More.", "ARR of $KM was told"),
    ("growth", "They doubled headcount in K months. More.", "doubled headcount in K months"),
    ("growth", "Saw K% YoY. More.", "K% YoY"),
    ("news", "Investors are valuing the company at $K billion. More.", "valuing the company at $K billion"),
    ("news", "Last week it acquired the firm number K. More.", "acquired the firm number K"),
    ("industry", "K is a leading cloud storage/backup provider.", "Cloud Storage/Backup"),
    ("industry", "K, the payments industry leader.", "Payments"),
    ("industry", "K specializes in robot arms.", "Robot Arms"),
    ("size", "About K-9,000 employees.", "K-9,000 employees"),
    ("size", "Some K people work there.", "K employees"),
    ("size", "It has K staff.", "K employees"),
    ("rating", "An overall rating is 3.9 by K.", "3.9 / 5.0"),
    ("rating", "Nothing is said of K.", "Unknown"),
]


def company_fact_forms(spark, sf_dir):
    """Each supplier with a sentence in one of the forms."""
    k = F.col("s_suppkey")
    form = F.get(F.array(*(F.struct(F.lit(f).alias("fact"), F.lit(t).alias("text")) for f, t, _ in FACT_FORMS)), (k % len(FACT_FORMS)).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(k, form["fact"].alias("fact"), F.replace(form["text"], F.lit("K"), k.cast("string")).alias("text")).withColumn("f", companies.facts(F.col("text")))
    value = F.coalesce(*(F.when(F.col("fact") == f, F.col("f")[f]) for f in companies.FACTS))
    return rows.select("s_suppkey", "fact", value.alias("value"))


def job_pages(spark, sf_dir):
    """Pages' addresses as they are, and as those of two boards."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.linkedin.com/jobs/view/dev-"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.concat(F.col("url"), F.lit("/jobs/12345"))).otherwise(F.col("url"))
    return p.select("page_id", urls.is_job_page(url).alias("is_job"))


def page_descriptions(spark, sf_dir):
    """The description in each page, as text. No SQL: a scan of nested blocks; tests hold it to a plain version."""
    found = X.strip_html_lines(enrichment.page_description(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(found).cast("long").alias("chars"), F.sha2(found, 256).alias("digest"))


def _catalog(spark, sf_dir):
    """Nations as sources: regions by name, every fourth for search, every fifth with a key."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(F.col("n_name").alias("name"), F.when(k % 5 == 0, "key_required").otherwise("open").alias("type"), F.when(k % 4 == 0, "search").otherwise("feed").alias("mode"), F.array(F.when(k % 3 == 0, "*").otherwise(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))).alias("regions"))


def _settings(spark, sf_dir):
    """Nations with customers, on or off by the parity of their number."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.count("*") % 2 == 0).alias("is_enabled"))
    n = table(spark, sf_dir, "nation").filter("n_regionkey > 0")
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "is_enabled")


def catalog_sources(spark, sf_dir):
    return _catalog(spark, sf_dir).transform(catalog.in_region("R1")).transform(catalog.with_settings(_settings(spark, sf_dir))).select("name", "type", "mode", "is_configured", "is_active")


def eligible_sources(spark, sf_dir):
    return _catalog(spark, sf_dir).transform(catalog.eligible(_settings(spark, sf_dir))).select("name")


def error_types(spark, sf_dir):
    """Events as errors of seven kinds."""
    k = F.col("event_id") % 7
    kind = catalog.error_type(F.when(k == 0, "SyntaxError").when(k == 1, "AbortError").otherwise("Error"), F.when(k == 2, "Request TIMED OUT").when(k == 3, "bad JSON").when(k == 6, F.lit(None)).otherwise("no"), F.when(k == 4, 429).when(k == 5, 403))
    e = table(spark, sf_dir, "events").select("event_id", "ts", kind.alias("error_type"))
    return e.withColumn("retry_at", catalog.retry_at(F.col("error_type"), F.col("ts"))).groupBy("error_type").agg(F.count("*").alias("n"), F.count("retry_at").alias("retries"))


def relative_dates(spark, sf_dir):
    shown = X.relative_date(F.when(F.col("event_id") % 10 > 0, F.col("ts")), _as_of())
    return table(spark, sf_dir, "events").select(shown.alias("shown")).groupBy("shown").agg(F.count("*").alias("n"))


def partial_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", scores.partial_score(F.col("o_orderkey") % 97 / 96.0 - 0.1).alias("b"))
    return o.select("o_orderkey", "b.*")


def enrich_round(spark, sf_dir):
    """Documents as listings: two of three partial, some tried of late, some without a name; details for every second."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        k.alias("id"), F.when(k % 7 > 0, F.col("source")).alias("title"), F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("description_text"), F.lit(None).cast("string").alias("description_html"), F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 9.0).alias("salary_min"), F.lit(None).cast("double").alias("salary_max"),
        (k % 100).cast("int").alias("match_score"), (k % 3 > 0).alias("partial"), F.when(k % 5 == 0, _as_of() - F.expr("interval 10 minutes")).when(k % 5 == 1, _as_of() - F.expr("interval 2 hours")).alias("enrichment_attempted_at"))
    details = table(spark, sf_dir, "documents").filter(k % 2 == 0).select(k.alias("id"), F.col("text").alias("description_text"), F.col("text").alias("description_html"), F.lit(5.0).alias("salary_min"), F.when(k % 8 > 0, 7.0).alias("salary_max"))
    scored = details.select("id", F.lit(77).alias("match_score"))
    out = docs.transform(enrichment.enriched(details, scored, _as_of()))
    return out.select("id", F.sha2("description_text", 256).alias("digest"), "salary_min", "salary_max", "match_score", "partial", (F.col("enrichment_attempted_at") == _as_of()).alias("stamped"))


def refreshed_listings(spark, sf_dir):
    """Orders as stored listings, line items as what their source says anew."""
    o = table(spark, sf_dir, "orders").select(F.lit("s").alias("source_name"), F.col("o_orderkey").alias("external_id"), F.when(F.col("o_orderkey") % 3 == 0, F.round("o_totalprice", 2)).alias("salary_min"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("closed_at"), F.when(F.col("o_orderkey") % 5 > 0, 1).alias("match_score"))
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.lit("s").alias("source_name"), F.col("l_orderkey").alias("external_id"), F.when(F.col("l_linenumber") > 1, F.round("l_extendedprice", 2)).alias("salary_min"), F.struct("l_linenumber", "l_extendedprice").alias("position"))
    out = merging.refreshed(o, line, "position", columns=["salary_min"])
    return out.select("external_id", "salary_min", F.col("closed_at").isNull().alias("is_open"), F.col("_needs_score").alias("needs_score"))


def reopened_listings(spark, sf_dir):
    """Stored documents of which every third is said anew by its own source: closed ones reopen, missing pay is taken, and
    the source's attribution is added where others have it only."""
    k = F.col("doc_id")
    entry = lambda name, number: F.struct(name.alias("name"), number.alias("external_id"))
    own, other = entry(F.col("source"), k.cast("string")), entry(F.lit("x"), F.col("source"))
    d = table(spark, sf_dir, "documents")
    sources = F.when(k % 5 == 0, F.array(own, other)).when(k % 5 < 4, F.array(other))
    stored = d.select(k.alias("id"), F.col("source").alias("source_name"), k.cast("string").alias("external_id"), F.when(k % 2 == 0, F.col("n_chars")).alias("salary_min"), F.when(k % 4 == 0, F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("closed_at"), F.when(k % 7 > 0, 1).alias("match_score"), sources.alias("sources"))
    incoming = d.filter("doc_id % 3 = 0").select(F.col("source").alias("source_name"), k.cast("string").alias("external_id"), (-F.col("n_chars")).alias("salary_min"), k.alias("position"))
    out = merging.refreshed(stored, incoming, "position", columns=["salary_min"])
    said = F.array_join(F.transform("sources", lambda x: F.concat(x["name"], F.lit(":"), x["external_id"])), ",")
    return out.select("id", "salary_min", F.col("closed_at").isNull().alias("is_open"), said.alias("sources"), F.col("_needs_score").alias("needs_score"))


QUERIES = {f.__name__: f for f in (feed_titles, boilerplate, benefit_lines, company_facts, company_fact_forms, job_pages, page_descriptions, catalog_sources, eligible_sources, error_types, relative_dates, partial_scores, enrich_round, refreshed_listings, reopened_listings)}


def _matches(patterns: tuple[str, ...]) -> str:
    return f"regexp_matches(u, '{'|'.join(patterns)}')"


def _header(patterns: str) -> str:
    """The place of a section header, 0 without one."""
    found = f"regexp_extract(text, '(?i)(?:{patterns})')".replace("y'?", "y''?").replace("u'?", "u''?").replace("e'?", "e''?")
    return f"CASE WHEN {found} = '' THEN 0 ELSE strpos(text, {found}) END"


_TRIMMED = r"regexp_replace({}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
_JUNK = "|".join(f"(?:{j})" for j in X.JUNK).replace("'", "''")
_NATIONS = """WITH c AS (SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'key_required' ELSE 'open' END AS type, CASE WHEN n_nationkey % 4 = 0 THEN 'search' ELSE 'feed' END AS mode,
 n_nationkey % 3 = 0 OR n_regionkey = 1 AS near, n_nationkey, n_regionkey FROM nation),
 s AS (SELECT c_nationkey, count(*) % 2 = 0 AS is_enabled FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0) GROUP BY 1)"""
SQL = {
    "feed_titles": "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 5 THEN 'Dev - Senior' ELSE 'Dev' END AS title, CASE WHEN s_suppkey % 6 = 5 THEN 'Unknown' ELSE s_name END AS company FROM supplier",
    "boilerplate": f"""WITH h AS (SELECT doc_id, text, len(text) * 0.7 AS most, {', '.join(f'{_header(p)} AS h{i}' for i, p in enumerate(X.SECTIONS))} FROM documents),
 a AS (SELECT doc_id, text, CASE {' '.join(f'WHEN h{i} > 0 AND h{i} - 1 < most THEN h{i}' for i in range(len(X.SECTIONS)))} END AS pos FROM h),
 s AS (SELECT doc_id, text, pos, string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), ':\\s+([A-Z])', ':' || chr(1) || '\\1', 'g'), chr(1)) AS parts FROM a)
 SELECT doc_id, sha256(CASE WHEN pos IS NOT NULL THEN {_TRIMMED.format('substr(text, pos)')} ELSE {_TRIMMED.format("array_to_string(list_filter(parts, lambda x: " + _TRIMMED.format('x') + " <> '' AND NOT regexp_matches(" + _TRIMMED.format('x') + ", '(?i)" + _JUNK + "')), ' ')")} END) AS digest FROM s""",
    "company_facts": """SELECT s_suppkey, CASE WHEN k THEN '4.2 / 5.0' ELSE 'Unknown' END AS rating, CASE WHEN k THEN s_suppkey || '0 employees' ELSE 'Unknown' END AS size, CASE WHEN k THEN '$' || s_suppkey || 'M raised' ELSE 'Unknown' END AS funding,
 CASE WHEN k THEN 'Revenue of $' || s_suppkey || 'M' ELSE 'Unknown' END AS growth, CASE WHEN k THEN 'raised $' || s_suppkey || ' million' ELSE 'Unknown' END AS news, CASE WHEN k THEN 'Data/Ai' ELSE 'Unknown' END AS industry FROM (SELECT s_suppkey, s_suppkey % 3 > 0 AS k FROM supplier)""",
    "company_fact_forms": "SELECT s_suppkey, " + ", ".join(f"CASE s_suppkey % {len(FACT_FORMS)} {' '.join(f'WHEN {i} THEN ' + repr(form[c]) for i, form in enumerate(FACT_FORMS))} END" for c in (0, 2)).replace(" END, CASE", " END AS fact, replace(CASE") + ", 'K', CAST(s_suppkey AS VARCHAR)) AS value FROM supplier",
    "job_pages": f"""SELECT page_id, NOT {_matches(urls.NOISE_PAGES)} AND NOT {_matches(urls.SEARCH_PAGES)} AND {_matches(urls.JOB_PAGES)} AS is_job
 FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/dev-' || page_id WHEN 1 THEN url || '/jobs/12345' ELSE url END AS u FROM pages)""",
    "catalog_sources": f"{_NATIONS} SELECT name, type, mode, c_nationkey IS NOT NULL AS is_configured, coalesce(is_enabled, type = 'open') AS is_active FROM c LEFT JOIN s ON c_nationkey = n_nationkey WHERE near",
    "eligible_sources": f"{_NATIONS} SELECT name FROM c JOIN s ON c_nationkey = n_nationkey WHERE is_enabled AND mode = 'feed'",
    "error_types": """SELECT CASE WHEN event_id % 7 IN (0, 3) THEN 'parse_error' WHEN event_id % 7 IN (1, 2) THEN 'timeout' WHEN event_id % 7 = 4 THEN 'rate_limit' WHEN event_id % 7 = 5 THEN 'auth_error' ELSE 'unknown' END AS error_type,
 count(*) AS n, count(*) FILTER (WHERE event_id % 7 = 4) AS retries FROM events GROUP BY 1""",
    "relative_dates": f"""WITH d AS (SELECT event_id, ts, CAST(floor(epoch(TIMESTAMP '{AS_OF}' - ts) / 86400) AS BIGINT) AS days FROM events)
 SELECT CASE WHEN event_id % 10 = 0 THEN '—' WHEN days = 0 THEN 'Today' WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN days || 'd ago' ELSE strftime(ts, '%b %-d') END AS shown, count(*) AS n FROM d GROUP BY 1""",
    "partial_scores": """WITH v AS (SELECT o_orderkey, greatest(0, (o_orderkey % 97)::DOUBLE / 96 - 0.1::DOUBLE) AS s FROM orders),
 x AS (SELECT o_orderkey, CAST(floor(greatest(0, least(1, (s - 0.25) / 0.5)) * 100 + 0.5) AS INT) AS experience, CAST(floor(greatest(0, least(1, (s - 0.30::DOUBLE) / (0.85::DOUBLE - 0.30::DOUBLE))) * 100 + 0.5) AS INT) AS domain FROM v)
 SELECT *, CAST(least(100, floor(experience * 0.30::DOUBLE * (domain::DOUBLE / 100) + 0.5)) AS INT) AS score FROM x""",
    "enrich_round": """WITH d AS (SELECT doc_id AS id, text, doc_id % 3 > 0 AS partial, doc_id % 5 <> 0 AND doc_id % 3 > 0 AS due, CASE doc_id % 4 WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 9::DOUBLE END AS low FROM documents),
 t AS (SELECT *, due AND id % 7 > 0 AS tried, due AND id % 7 > 0 AND id % 2 = 0 AS got FROM d)
 SELECT id, CASE WHEN got THEN sha256(text) END AS digest, CASE WHEN got AND coalesce(low, 0) = 0 THEN 5 ELSE low END AS salary_min, CASE WHEN got AND id % 8 > 0 THEN 7::DOUBLE END AS salary_max,
 CAST(CASE WHEN got THEN 77 ELSE id % 100 END AS INT) AS match_score, partial AND NOT tried AS partial, CASE WHEN due THEN TRUE WHEN id % 5 < 2 THEN FALSE END AS stamped FROM t""",
    "reopened_listings": """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN n_chars WHEN doc_id % 3 = 0 THEN -n_chars END AS salary_min, doc_id % 4 > 0 OR doc_id % 3 = 0 AS is_open,
 CASE WHEN doc_id % 5 = 0 THEN source || ':' || doc_id || ',x:' || source WHEN doc_id % 5 < 4 THEN 'x:' || source || CASE WHEN doc_id % 3 = 0 THEN ',' || source || ':' || doc_id ELSE '' END WHEN doc_id % 3 = 0 THEN source || ':' || doc_id END AS sources, doc_id % 3 = 0 AND doc_id % 7 = 0 AS needs_score FROM documents""",
    "refreshed_listings": """WITH l AS (SELECT l_orderkey, first(round(l_extendedprice, 2) ORDER BY l_linenumber, l_extendedprice) FILTER (WHERE l_linenumber > 1) AS low FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
 SELECT o_orderkey AS external_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice, 2) END, low) AS salary_min, l_orderkey IS NOT NULL OR o_orderkey % 2 <> 0 OR o_orderdate IS NULL AS is_open, l_orderkey IS NOT NULL AND o_orderkey % 5 = 0 AS needs_score
 FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
}
