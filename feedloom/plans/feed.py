"""The ranked feed: filters, a dynamic score threshold from one aggregate pass, and the top of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import filters, ranking, score_counts, search
from feedloom.operators.shared import shared_path


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as stored listings: a score of 0-100 where labelled, else null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    joined = docs.join(labels, "doc_id", "left")
    score = F.when(F.col("quality").isNotNull(), (F.col("quality") * 50 + F.col("n_chars") % 51).cast("int"))
    return joined.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_name"), "text", F.col("lang").alias("country"), score.alias("match_score"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_dismissed")
    )


LISTINGS_SQL = """SELECT d.doc_id AS id, d.source AS source_name, d.text, d.lang AS country,
 CASE WHEN l.quality IS NOT NULL THEN CAST(l.quality * 50 + d.n_chars % 51 AS INT) END AS match_score,
 coalesce(l.toxic = 1, FALSE) AS is_dismissed
 FROM documents d LEFT JOIN labels l USING (doc_id)"""


def feed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listings(spark, sf_dir).transform(filters.not_dismissed).transform(filters.in_countries("en,fr")).transform(filters.contains_text("the", ["text"]))
    return found.transform(ranking.feed(limit=100, offset=0, score="match_score", tie="id")).select("id", "source_name", "country", "match_score", "threshold", "total")


def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the feed in its own columns; nested ones as JSON."""
    d = listings(spark, sf_dir).withColumn("partial", F.col("id") % 9 == 0)
    entry = F.array(F.struct(F.col("source_name").alias("name"), F.col("id").cast("string").alias("external_id")))
    stored = d.withColumns({"title": F.col("source_name"), "company": F.col("country"), "salary_min": F.col("id") * 10, "salary_max": F.when(F.col("id") % 2 == 0, F.col("id") * 20), "location": F.lit(None).cast("string"), "is_remote": F.col("id") % 3 == 0, "source_url": F.concat(F.lit("https://x.example/"), F.col("id").cast("string")), "sources": entry, "dedup_confidence": F.lit(None).cast("double"), "match_breakdown": F.struct(F.col("match_score").alias("score")), "pipeline_stage": F.lit("discovered"), "discovered_at": F.to_timestamp(F.lit("2024-01-01 00:00:00")), "benefits": F.array().cast("array<string>")})
    page = stored.transform(filters.not_dismissed).transform(filters.in_countries("all")).transform(ranking.feed_columns).transform(ranking.feed(limit=500, offset=10))
    return page.withColumns({c: F.to_json(c) for c in ("sources", "match_breakdown", "benefits")})


def feed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.floor(F.col("o_totalprice") / 1000) % 101).cast("int").alias("match_score"))
    return orders.transform(ranking.threshold_of("match_score"))


def country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.nullif("n_name", F.lit("CANADA")).alias("country"))
    return named.transform(ranking.group_counts("country"))


def threshold_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds and totals of three choices of countries, from counts that inserts, new scores and dismissals kept up to date."""
    rows = listings(spark, sf_dir).select("id", "country", F.col("match_score").alias("score"), "is_dismissed")
    kept = score_counts.ScoreCounts(spark, shared_path(spark, "score-counts"))
    first, later = rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 0")
    kept.apply(score_counts.inserted(first), 0)
    kept.apply(score_counts.inserted(later), 1)
    scored = rows.filter("id % 5 = 0").withColumn("score", (F.coalesce("score", F.lit(3)) * 7 % 101).cast("int"))
    kept.apply(score_counts.changed(rows, scored, "id"), 2)
    stored = rows.withColumn("score", F.when(F.col("id") % 5 == 0, (F.coalesce("score", F.lit(3)) * 7 % 101).cast("int")).otherwise(F.col("score")))
    kept.apply(score_counts.changed(stored, stored.filter("id % 11 = 0").withColumn("is_dismissed", F.lit(True)), "id"), 3)
    found = [kept.threshold(c, version=4).select(F.lit(c).alias("countries"), "p75", "above", "threshold", "total") for c in ("all", "en,fr", "de")]
    return found[0].unionByName(found[1]).unionByName(found[2])


#: Searches: parts of words, wildcards of users, three columns, no such text, and one too short for the index.
SEARCHES = ["erinan", "THE %nd of", "t_e tion", "src1", "und der", "no such text", "q"]


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose title, company or description hold a text, for several texts, by an index that is built in two steps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("company"), F.col("text").alias("description_text"))
    index = search.TrigramIndex(spark, shared_path(spark, "trigrams"), ["title", "company", "description_text"])
    for part in ("id % 3 = 0", "id % 3 <> 0"):
        index.add(docs.filter(part))
    found = [index.search(docs, q).select(F.lit(q).alias("query"), "id") for q in SEARCHES]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


QUERIES = {"text_search": text_search, "threshold_kept": threshold_kept, "feed_topk": feed_topk, "feed_page": feed_page, "feed_threshold": feed_threshold, "country_counts": country_counts}

THRESHOLD_SQL = "coalesce(round_even(quantile_cont(match_score, 0.75) FILTER (WHERE match_score >= 1), 0), 0)"
_KEPT = """SELECT '{0}' AS countries, max(p75) AS p75, count(*) FILTER (WHERE s >= p75) AS above, CASE WHEN max(p75) > 0 AND count(*) FILTER (WHERE s >= p75) >= 20 THEN max(p75) END AS threshold,
 CASE WHEN max(p75) > 0 AND count(*) FILTER (WHERE s >= p75) >= 20 THEN count(*) FILTER (WHERE s >= p75) ELSE count(*) END AS total FROM k, (SELECT CAST(coalesce(round_even(quantile_cont(s, 0.75) FILTER (WHERE s >= 1), 0), 0) AS INT) AS p75 FROM k WHERE {1}) WHERE {1}"""
SQL = {
    "threshold_kept": f"WITH k AS (SELECT country, CASE WHEN id % 5 = 0 THEN coalesce(match_score, 3) * 7 % 101 ELSE match_score END AS s FROM ({LISTINGS_SQL}) WHERE NOT is_dismissed AND id % 11 <> 0) " + " UNION ALL ".join(_KEPT.format(*x) for x in (("all", "TRUE"), ("en,fr", "country IN ('en', 'fr')"), ("de", "country = 'de'"))),
    "text_search": " UNION ALL ".join(f"SELECT '{q}' AS query, doc_id AS id FROM documents WHERE source ILIKE '%{q}%' OR lang ILIKE '%{q}%' OR text ILIKE '%{q}%'" for q in SEARCHES),
    "feed_topk": f"""WITH f AS (SELECT * FROM ({LISTINGS_SQL}) WHERE NOT is_dismissed AND country IN ('en', 'fr') AND text ILIKE '%the%'),
 p AS (SELECT CAST({THRESHOLD_SQL} AS INT) AS p75 FROM f),
 t AS (SELECT CASE WHEN max(p75) > 0 AND count(*) FILTER (WHERE match_score >= p75) >= 20 THEN max(p75) END AS threshold FROM f, p),
 k AS (SELECT f.*, threshold FROM f, t WHERE threshold IS NULL OR match_score >= threshold)
 SELECT id, source_name, country, match_score, threshold, (SELECT count(*) FROM k) AS total FROM k ORDER BY match_score DESC NULLS FIRST, id LIMIT 100""",
    "feed_page": f"""WITH f AS (SELECT * FROM ({LISTINGS_SQL}) WHERE NOT is_dismissed), p AS (SELECT CAST({THRESHOLD_SQL} AS INT) AS p75 FROM f),
 t AS (SELECT CASE WHEN max(p75) > 0 AND count(*) FILTER (WHERE match_score >= p75) >= 20 THEN max(p75) END AS threshold FROM f, p), k AS (SELECT f.*, threshold FROM f, t WHERE threshold IS NULL OR match_score >= threshold)
 SELECT id, source_name AS title, country AS company, id * 10 AS salary_min, CASE WHEN id % 2 = 0 THEN id * 20 END AS salary_max, CAST(NULL AS VARCHAR) AS location, id % 3 = 0 AS is_remote, 'https://x.example/' || id AS source_url, source_name, '[{{"name":"' || source_name || '","external_id":"' || id || '"}}]' AS sources, CAST(NULL AS DOUBLE) AS dedup_confidence, match_score,
 CASE WHEN match_score IS NULL THEN '{{}}' ELSE '{{"score":' || match_score || '}}' END AS match_breakdown, 'discovered' AS pipeline_stage, country, id % 9 = 0 AS partial, TIMESTAMP '2024-01-01 00:00:00' AS discovered_at, '[]' AS benefits, threshold, (SELECT count(*) FROM k) AS total FROM k ORDER BY match_score DESC NULLS FIRST, id LIMIT 200 OFFSET 10""",
    "feed_threshold": f"""WITH s AS (SELECT CAST(floor(o_totalprice / 1000) % 101 AS INT) AS match_score FROM orders),
 p AS (SELECT CAST({THRESHOLD_SQL} AS INT) AS p75 FROM s)
 SELECT max(p75) AS p75, count(*) FILTER (WHERE match_score >= p75) AS above,
 CASE WHEN max(p75) > 0 AND count(*) FILTER (WHERE match_score >= p75) >= 20 THEN max(p75) END AS threshold FROM s, p""",
    "country_counts": """SELECT nullif(n_name, 'CANADA') AS country, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
 GROUP BY 1 HAVING nullif(n_name, 'CANADA') IS NOT NULL ORDER BY n DESC, country""",
}
