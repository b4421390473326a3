"""Queries on text, money and score expressions over whole tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from feedloom.functions import money, scores
from feedloom.functions import text as X
from feedloom.operators import filters, skills
from feedloom.plans.stored import table


def fingerprints(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", X.fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("fingerprint"))


def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.strip_html(F.col("html")), 256).alias("digest"))


def html_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.sanitize_text(F.col("html")), 256).alias("digest"))


def host_source(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.source_of(F.col("url")).alias("source"))


def url_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_id(F.col("url")).alias("external_id"))


def salary_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice")).cast("long").alias("p"))
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("$"), F.floor(F.col("p") / 1000).cast("string"), F.lit("k - $"), F.floor(F.col("p") / 500).cast("string"), F.lit("k"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("USD "), F.col("p").cast("string"))).when(F.col("o_orderkey") % 4 == 2, "Competitive")
    got = o.select("o_orderkey", money.parse_salary(shown).alias("s"))
    return got.select("o_orderkey", F.col("s.min").alias("salary_min"), F.col("s.max").alias("salary_max"))


def salary_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"), (F.col("o_orderkey") % 300 * 1000.0).alias("b"))
    return o.select("o_orderkey", F.round(money.overlap(F.col("a"), F.col("a") * 1.2, F.nullif("b", F.lit(0.0)), F.col("b") * 1.5), 6).alias("overlap"))


def salary_axis(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("low"), (F.col("o_orderkey") % 7 * 50000).alias("target"))
    got = o.select("o_orderkey", money.salary_axis(F.col("target"), F.when(F.col("o_orderkey") % 5 > 0, F.col("low")), F.when(F.col("o_orderkey") % 5 > 1, F.col("low") + 20000)).alias("s"))
    return got.select("o_orderkey", F.col("s.score").alias("score"), F.col("s.label").alias("label"))


def score_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 97 / 96.0).alias("s"), (F.col("o_custkey") % 89 / 88.0).alias("t"), F.when(F.col("o_orderkey") % 3 == 0, 100).otherwise(50).alias("salary"))
    return o.select("o_orderkey", scores.breakdown(F.col("s"), F.col("t"), F.col("salary")).alias("b")).select("o_orderkey", "b.*")


def skill_match(spark, sf_dir):
    got = table(spark, sf_dir, "documents").select("doc_id", X.named_skills(F.col("text"), ["the", "of", "tion", "C++", "que", "Th", "und", "%%%"]).alias("m"))
    return got.select("doc_id", F.size("m").alias("n"), F.array_join("m", ",").alias("skills"))


def title_only(spark, sf_dir):
    """Each text with its first line as title; every third has only the title for text."""
    title = F.get(F.split("text", "\n"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", title.alias("t"))
    return docs.select("doc_id", filters.title_only(F.when(F.col("doc_id") % 3 == 0, F.col("t")).otherwise(F.col("text")), F.col("t")).alias("title_only"))


def benefit_tags(spark, sf_dir):
    words = F.array(*map(F.lit, ["401k match", "Dental and vision", "Remote first", "Free snacks", "Annual bonus"]))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(words, (F.col("doc_id") % 5).cast("int")).alias("benefit"))
    return rows.withColumn("category", X.benefit_category(F.col("benefit"))).filter("category is not null").groupBy("category").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def salary_clean(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(money.cap(F.col("o_totalprice"), 300000), 2).alias("salary_min"))


def salary_shown(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("p"))
    return o.select("o_orderkey", money.format_salary(F.when(F.col("o_orderkey") % 3 > 0, F.col("p")), F.when(F.col("o_orderkey") % 3 != 1, F.col("p") + 1000)).alias("shown"))


def title_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    return part.transform(filters.title_has_any(["Red", "blue", "1"]))


def finite_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")).alias("v"))
    return e.select("vec_id", filters.finite_vector("v").isNotNull().alias("usable"))


def skill_column(spark, sf_dir):
    """Each document against a list of its own: words of it, changed in case or cut, with marks, and of other texts."""
    w = F.split("text", r"\s+")
    at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    own = F.array(at(0), F.translate(at(1), ascii_lowercase, ascii_uppercase), F.substring(at(2), 1, 2), F.concat(F.lit(" "), F.lower(at(3))), F.lit("of"), F.lit("Und"), F.lit("C++"), F.when(F.col("doc_id") % 7 > 0, F.substring(at(4), 2, 9)), F.lit("the"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", own.alias("skills"))
    return skills.with_named(rows, "text", "skills", "named").select("doc_id", F.size("named").alias("n"), F.array_join("named", "|").alias("named"))


QUERIES = {f.__name__: f for f in (fingerprints, html_strip, html_sanitize, host_source, url_ids, salary_parse, salary_overlap, salary_axis, score_rows, skill_match, skill_column, title_only, benefit_tags, salary_clean, salary_shown, title_filter, finite_vectors)}

_K = "CAST(floor({} / 1000.0 + 0.5) AS BIGINT)"
SQL = {
    "fingerprints": "SELECT p_partkey, substr(sha256(regexp_replace(lower(p_name || p_brand || p_type), '[^a-z0-9]', '', 'g')), 1, 16) AS fingerprint FROM part",
    "html_strip": r"""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '[\s\x{00A0}]+', ' ', 'g'))) AS digest FROM pages""",
    "html_sanitize": r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?i)on\w+\s*=\s*["''][^"'']*["'']', '', 'g'), '(?i)on\w+\s*=\s*\S+', '', 'g'), '(?i)javascript:', '', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g'))) AS digest FROM pages""",
    "host_source": """WITH h AS (SELECT page_id, replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), 'www.', '') AS h FROM pages)
 SELECT page_id, CASE WHEN h = '' THEN 'web' WHEN h LIKE '%linkedin.com%' THEN 'linkedin' WHEN h LIKE '%indeed.com%' THEN 'indeed' WHEN h LIKE '%glassdoor.com%' THEN 'glassdoor'
 WHEN h LIKE '%ziprecruiter.com%' THEN 'ziprecruiter' WHEN h LIKE '%builtin%' THEN 'builtin' WHEN split_part(h, '.', 1) IN ('jobs', 'careers') THEN split_part(h, '.', 2) ELSE split_part(h, '.', 1) END AS source FROM h""",
    "salary_parse": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(p / 1000.0) * 1000 WHEN 1 THEN p::DOUBLE END AS salary_min,
 CASE WHEN o_orderkey % 4 = 0 THEN floor(p / 500.0) * 1000 END AS salary_max FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)""",
    "salary_overlap": """WITH v AS (SELECT o_orderkey, o_totalprice AS a, o_totalprice * 1.2::DOUBLE AS a_top, nullif(o_orderkey % 300 * 1000.0::DOUBLE, 0) AS b, o_orderkey % 300 * 1000.0::DOUBLE * 1.5::DOUBLE AS b_top FROM orders)
 SELECT o_orderkey, round(CASE WHEN b IS NULL THEN NULL WHEN least(a_top, b_top) < greatest(a, b) THEN 0 WHEN greatest(a_top, b_top) = least(a, b) THEN 1 ELSE (least(a_top, b_top) - greatest(a, b)) / (greatest(a_top, b_top) - least(a, b)) END, 6) AS overlap FROM v""",
    "salary_axis": """WITH v AS (SELECT o_orderkey, CAST(o_orderkey % 7 * 50000 AS DOUBLE) AS t, CASE WHEN o_orderkey % 5 > 0 THEN floor(o_totalprice) END AS lo, CASE WHEN o_orderkey % 5 > 1 THEN floor(o_totalprice) + 20000 END AS hi FROM orders),
 w AS (SELECT o_orderkey, t, lo, coalesce(hi, lo) AS hi FROM v)
 SELECT o_orderkey, CAST(CASE WHEN t = 0 OR lo IS NULL THEN 50 WHEN t > hi THEN greatest(0, floor((1 - (t - hi) / t * 2) * 100 + 0.5)) WHEN t < lo THEN greatest(0, floor((1 - (lo - t) / lo * 2) * 100 + 0.5)) ELSE 100 END AS INT) AS score,
 CASE WHEN t = 0 THEN 'no target' WHEN lo IS NULL THEN 'not posted' WHEN t > hi THEN 'target above' WHEN t < lo THEN 'target below' ELSE 'in range' END AS label FROM w""",
    "score_rows": """WITH v AS (SELECT o_orderkey, (o_orderkey % 97)::DOUBLE / 96 AS s, (o_custkey % 89)::DOUBLE / 88 AS t, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 50 END AS INT) AS salary FROM orders),
 x AS (SELECT *, CAST(floor(greatest(0, least(1, (s - 0.25) / 0.5)) * 100 + 0.5) AS INT) AS skills, CAST(floor(greatest(0, least(1, (t - 0.25) / 0.5)) * 100 + 0.5) AS INT) AS experience, CAST(floor(greatest(0, least(1, (s - 0.30::DOUBLE) / (0.85::DOUBLE - 0.30::DOUBLE))) * 100 + 0.5) AS INT) AS domain FROM v)
 SELECT o_orderkey, skills, experience, salary, domain, CAST(least(100, floor((0.4::DOUBLE * skills + 0.3::DOUBLE * experience + 0.3::DOUBLE * salary) * CASE WHEN salary = 100 THEN 1.15::DOUBLE ELSE 1 END * domain / 100 + 0.5)) AS INT) AS score FROM x""",
    "skill_column": r"""WITH w AS (SELECT doc_id, text, string_split_regex(text, '\s+') AS w FROM documents),
 l AS (SELECT doc_id, text, list_filter([coalesce(w[1], ''), translate(coalesce(w[2], ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), substr(coalesce(w[3], ''), 1, 2), ' ' || lower(coalesce(w[4], '')), 'of', 'Und', 'C++', CASE WHEN doc_id % 7 > 0 THEN substr(coalesce(w[5], ''), 2, 9) END, 'the', ''], lambda s: s IS NOT NULL AND trim(s) <> '') AS own FROM w),
 m AS (SELECT doc_id, list_filter(own, lambda s: CASE WHEN regexp_matches(lower(trim(s)), '[^a-z0-9\s]') THEN contains(lower(text), lower(trim(s)))
  ELSE regexp_matches(text, CASE WHEN length(trim(s)) > 3 THEN '(?i)' ELSE '' END || '(^|[^A-Za-z0-9_])' || CASE WHEN regexp_matches(lower(trim(s)), '[^a-z0-9\s]') THEN 'x' ELSE trim(s) END || '($|[^A-Za-z0-9_])') END) AS named FROM l)
 SELECT doc_id, CAST(len(named) AS INT) AS n, array_to_string(named, '|') AS named FROM m""",
    "skill_match": r"""SELECT doc_id, CAST(len(m) AS INT) AS n, array_to_string(m, ',') AS skills FROM (SELECT doc_id, list_filter(['the', 'of', 'tion', 'C++', 'que', 'Th', 'und', '%%%'], lambda s:
 CASE WHEN regexp_matches(s, '[^A-Za-z0-9\s]') THEN contains(lower(text), lower(s)) WHEN len(s) <= 3 THEN regexp_matches(text, '(^|[^A-Za-z0-9_])' || s || '($|[^A-Za-z0-9_])') ELSE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])' || s || '($|[^A-Za-z0-9_])') END) AS m FROM documents)""",
    "title_only": """WITH w AS (SELECT doc_id, lower(trim(split_part(text, chr(10), 1))) AS t, lower(trim(CASE doc_id % 3 WHEN 0 THEN split_part(text, chr(10), 1) ELSE text END)) AS d FROM documents)
 SELECT doc_id, d = '' OR d = t OR (len(d) < 50 AND contains(d, t)) AS title_only FROM w""",
    "benefit_tags": """SELECT CASE doc_id % 5 WHEN 0 THEN '401k' WHEN 1 THEN 'Health' ELSE 'Bonus' END AS category, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE doc_id % 5 NOT IN (2, 3) GROUP BY 1""",
    "salary_clean": "SELECT o_orderkey, round(CASE WHEN o_totalprice <= 300000 THEN o_totalprice END, 2) AS salary_min FROM orders",
    "salary_shown": f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN '$' || {_K.format('p')} || 'k+' WHEN 2 THEN '$' || {_K.format('p')} || 'k – $' || {_K.format('(p + 1000)')} || 'k' ELSE 'Up to $' || {_K.format('(p + 1000)')} || 'k' END AS shown FROM (SELECT o_orderkey, floor(o_totalprice) AS p FROM orders)",
    "title_filter": "SELECT p_partkey, p_name AS title FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') OR contains(p_name, '1')",
    "finite_vectors": "SELECT vec_id, vec_id % 10 <> 0 AS usable FROM embeddings",
}


def country_extract(spark, sf_dir):
    """The location of each customer, as text of their nation or a stated place by key."""
    from feedloom.functions import places

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    place = F.when(F.col("c_custkey") % 4 == 0, "Berlin, DE").when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("Somewhere, "), F.col("n_name"))).when(F.col("c_custkey") % 4 == 2, "Remote - EMEA")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", places.country_of(place).alias("country"))


QUERIES["country_extract"] = country_extract
SQL["country_extract"] = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'US' WHEN 2 THEN 'INTL' WHEN 3 THEN 'Unknown' ELSE coalesce(map {'united states': 'US', 'united kingdom': 'GB', 'canada': 'CA', 'germany': 'DE', 'france': 'FR', 'india': 'IN', 'china': 'CN', 'japan': 'JP', 'brazil': 'BR', 'argentina': 'AR', 'egypt': 'EG', 'indonesia': 'ID', 'kenya': 'KE', 'peru': 'PE', 'romania': 'RO', 'saudi arabia': 'SA', 'vietnam': 'VN', 'russia': 'RU'}[lower(n_name)], 'Unknown') END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey"""

SQL["url_ids"] = r"""WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^(.*?)https?://', '\1'), '(?s)[?#].*', '') AS p, regexp_extract(url, 'linkedin\.com/jobs/view/(?:.*[-/])?(\d{5,})', 1) AS li, regexp_extract(url, 'jobs\.apple\.com/.+/details/(\d+)', 1) AS ap FROM pages),
 h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM u)
 SELECT page_id, CASE WHEN li <> '' THEN 'searxng-li-' || li WHEN ap <> '' THEN 'searxng-apple-' || ap ELSE 'searxng-' || lower(to_base(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END), 36)) END AS external_id FROM h"""
