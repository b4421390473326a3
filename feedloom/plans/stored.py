"""Queries on stored rows: known and closed listings, candidates, runs, merging and backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import similarity as sim
from feedloom.functions import text as X
from feedloom.operators import merging, neighbours, ranking, runs
from feedloom.operators.shared import shared_path
from feedloom.streaming import health


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known_anti(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(None).cast("timestamp").alias("closed_at"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").transform(merging.unknown_listings(lines, ["o_orderkey"]))


def closed_anti(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").select(F.col("source").alias("source_name"), F.col("doc_id").alias("external_id"), F.lit(None).cast("timestamp").alias("closed_at"))
    fresh = stored.filter("external_id % 3 <> 0 and source_name <> 'src2'").select("source_name", "external_id")
    complete = stored.filter("source_name in ('src0', 'src1', 'src2')").select("source_name").distinct()
    return stored.transform(merging.to_close(fresh, complete)).select("source_name", "external_id")


def batch_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.lower("text"), 256).alias("fp"))
    return docs.transform(merging.keep_first(["source", "fp"], "doc_id"))


def insert_new(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))
    stored = orders.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.min("price").alias("price"))
    return merging.insert_absent(stored, orders.filter("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


def upserted(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return merging.upsert(c, c.filter("c_custkey % 5 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit(99).cast(c.schema["c_nationkey"].dataType).alias("c_nationkey")), ["c_custkey"])


def or_candidates(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("in_id"), "s_nationkey", F.lower("s_name").alias("s"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cand_id"), "n_regionkey", F.lower("n_name").alias("n"))
    return merging.or_candidates(a, b, [(F.col("s_nationkey"), F.col("cand_id")), (F.col("s_nationkey"), F.col("n_regionkey"))], "in_id", "cand_id")


def merge_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    entry = lambda n, i: F.struct(n.alias("name"), i.alias("external_id"))
    own = F.array(entry(F.col("source"), F.col("doc_id")))
    new = F.array(entry(F.col("source"), F.col("doc_id")), entry(F.col("lang"), F.col("doc_id")), entry(F.col("source"), F.col("doc_id") + 1))
    merged = docs.select("doc_id", merging.merge_attributions(own, new).alias("m"))
    return merged.select("doc_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["name"], x["external_id"].cast("string"))), ",").alias("sources"))


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


KINDS = ["click", "view", "purchase", "signup", "error"]


def counters_fold(spark, sf_dir):
    return events(spark, sf_dir).transform(runs.counters("user_id", "event_type", KINDS))


def run_status(spark, sf_dir):
    """Each user's events as a run: it began with the first, views are sources that succeeded, errors those that failed."""
    kind = lambda *names: F.count_if(F.col("event_type").isin(*names))
    folded = events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("completed_at"), kind("view", "error", "signup").alias("sources_attempted"), F.nullif(kind("view"), F.lit(0)).alias("sources_succeeded"), kind("error").alias("sources_failed"))
    return folded.transform(runs.status(F.to_timestamp(F.lit("2024-01-20 00:00:00")), stale_seconds=15 * 86400)).select("user_id", "status", "sources_completed", "sources_total")


def source_health(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("failed", F.pmod(F.col("event_id") * 7, F.lit(5)) < 2)
    return rows.transform(runs.health("user_id", ["ts", "event_id"], "failed"))


def health_of_stream(spark, sf_dir):
    """Counters and health of users by a stream over files of about two days, in which rows come up to an hour late."""
    folder = shared_path(spark, "health-stream")
    made = events(spark, sf_dir).select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.pmod(F.col("event_id") * 7, F.lit(5)) < 2).alias("failed"))
    late = F.unix_seconds("ts") + F.col("id") * 7919 % 3600
    made.withColumn("part", F.floor(late / 172800)).repartition("part").write.partitionBy("part").parquet(f"{folder}/events")
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 6).parquet(f"{folder}/events")
    # Files come in no order, so the delay is that of the whole table; streaming/health.py's tests have late rows and small delays.
    health.health_stream(stream, f"{folder}/state", f"{folder}/checkpoint", KINDS, "60 days").awaitTermination()
    return health.current(spark, f"{folder}/state", "bigint", KINDS).withColumnRenamed("source", "user_id")


def errors_append(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("item", F.when(F.col("event_id") % 4 == 0, F.col("event_id")))
    out = rows.transform(runs.appended("user_id", ["ts", "event_id"], "item", "items"))
    return out.select("user_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


def active_run(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("completed_at"))
    return rows.transform(ranking.latest_incomplete(F.to_timestamp(F.lit("2024-01-31 00:00:00")), 40 * 86400)).select("id")


def scored_in_run(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.filter((F.col("ts") >= F.to_timestamp(F.lit("2024-01-15 00:00:00"))) & (F.col("value") >= 0)).agg(F.count("*").alias("n"))


def vector_radius(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.within(rows.filter("vec_id % 50 = 0"), rows, 0.8)


def rrf(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100 / 100.0).alias("s1"), F.nullif(F.col("o_custkey") % 50 / 50.0, F.lit(0.0)).alias("s2"))
    r1, r2 = sim.to_rank(F.col("s1")), sim.to_rank(F.col("s2"))
    return v.select("o_orderkey", r1.alias("r1"), r2.alias("r2"), F.round(sim.fuse([r1, r2]), 6).alias("confidence"))


def company_join(spark, sf_dir):
    """Listings to company rows by normalised name; the names of either side differ in case and spaces."""
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("  "), F.upper("s_name")).alias("company"))
    b = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("intel"), X.normalize_company(F.col("s_name")).alias("key"))
    return a.join(b, X.normalize_company(F.col("company")) == F.col("key"), "left").select("s_suppkey", "intel")


def _listings(spark, sf_dir):
    """Documents as listings: source and language as title and company, three places, and pay by length."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(k.alias("id"), "source", F.col("source").alias("title"), F.col("lang").alias("company"), F.when(k % 3 == 0, "Rome").when(k % 3 == 1, "Oslo").alias("location"), F.when(k % 4 > 0, F.col("n_chars") % 40 * 1000).alias("salary_min"), F.when(k % 8 > 3, F.col("n_chars") % 40 * 1000 + 20000).alias("salary_max"))
    return rows.withColumn("fingerprint", X.fingerprint(F.col("title"), F.col("company"), F.col("location")))


def dedup_disposition(spark, sf_dir):
    """Documents of odd ids against those of even ids."""
    rows = _listings(spark, sf_dir)
    found = merging.fingerprint_merges(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"))
    return found.select("in_id", "cand_id", F.round("confidence", 9).alias("confidence"), "disposition")


#: Places of similar names.
PLACES = ["Berlin", "Bern", "Bremen", "Breda", "Murcia", "Munich", "Lund"]


def dedup_names(spark, sf_dir):
    """Documents of odd ids against those of even ids, with the first words of a text as the company, one of several places,
    and pay by length; candidates share a title by number, so names of all kinds are compared."""
    k = F.col("doc_id")
    words = F.split("text", r"[ .,\n]+")
    company = F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    d = table(spark, sf_dir, "documents").select(k, company.alias("company"), "n_chars")
    place = F.get(F.array(*map(F.lit, PLACES)), (k % 8).cast("int"))
    rows = d.select(k.alias("id"), F.concat(F.lit("Role "), F.floor(k / 64).cast("string")).alias("title"), F.when(k % 11 > 0, F.col("company")).alias("company"), place.alias("location"), F.when(k % 4 > 0, F.col("n_chars") % 40 * 1000).alias("salary_min"), F.when(k % 8 > 3, F.col("n_chars") % 40 * 1000 + 20000).alias("salary_max"))
    rows = rows.withColumn("fingerprint", X.fingerprint(F.col("title"), F.col("company"), F.col("location")))
    found = merging.fingerprint_merges(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"))
    return found.select("in_id", "cand_id", F.round("confidence", 9).alias("confidence"), "disposition")


def dedup_vectors(spark, sf_dir):
    """Vectors of odd ids against those of even ids, as listings with a company by label and pay by number."""
    k = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(k.alias("id"), "embedding", F.lit("t").alias("title"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("company"), F.lit(None).cast("string").alias("location"), (k % 7 * 1000).alias("salary_min"), F.when(k % 3 > 0, k % 7 * 1000 + 3000).alias("salary_max"), F.concat(F.lit("f"), F.floor(k / 4).cast("string")).alias("fingerprint"))
    found = merging.fingerprint_merges(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"), distance=0.9)
    return found.select("in_id", "cand_id", F.round("confidence", 9).alias("confidence"), "disposition")


def merged_listings(spark, sf_dir):
    """Stored documents after merging others into them: every third into the one before that it follows by three."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    k = F.col("doc_id")
    sources = F.array(F.struct(F.col("source").alias("name"), k.cast("string").alias("external_id")))
    stored = d.filter("doc_id % 3 = 0").select(k.alias("id"), F.when(k % 2 == 0, F.col("n_chars")).alias("salary_min"), F.lit(None).cast("string").alias("location"), sources.alias("sources"), F.lit(None).cast("double").alias("dedup_confidence"), F.when(k % 5 > 0, 1).alias("match_score"))
    into = F.floor(k / 9) * 9
    incoming = d.filter("doc_id % 3 > 0").select(k.alias("id"), k.alias("position"), (-F.col("n_chars")).alias("salary_min"), F.when(k % 4 > 0, F.col("lang")).alias("location"), F.concat(sources, F.array(F.struct(F.lit("x").alias("name"), F.lit("1").alias("external_id")))).alias("sources"))
    found = d.filter("doc_id % 3 > 0").select(k.alias("in_id"), into.alias("cand_id"), (k % 10 / 1000.0 + 0.9).alias("confidence"), F.when(k % 7 > 0, "merged").otherwise("similar").alias("disposition"))
    out = merging.merged(stored, incoming, found, "position", ["salary_min", "location"])
    return out.select("id", "salary_min", "location", F.array_join(F.transform("sources", lambda x: F.concat(x["name"], F.lit(":"), x["external_id"])), ",").alias("sources"), F.round("dedup_confidence", 6).alias("dedup_confidence"), F.col("_needs_score").alias("needs_score"))


QUERIES = {f.__name__: f for f in (known_anti, closed_anti, batch_keep_first, insert_new, upserted, or_candidates, merge_sources, counters_fold, run_status, source_health, health_of_stream, errors_append, active_run, scored_in_run, vector_radius, rrf, company_join, dedup_disposition, dedup_names, dedup_vectors, merged_listings)}

SQL = {
    "known_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = o_orderkey)",
    "closed_anti": "SELECT source AS source_name, doc_id AS external_id FROM documents WHERE source IN ('src0', 'src1') AND doc_id % 3 = 0 AND source IN (SELECT source FROM documents WHERE doc_id % 3 <> 0)",
    "batch_keep_first": "SELECT doc_id, source, fp FROM (SELECT doc_id, source, sha256(lower(text)) AS fp FROM documents) QUALIFY row_number() OVER (PARTITION BY source, fp ORDER BY doc_id) = 1",
    "insert_new": """WITH o AS (SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM orders),
 s AS (SELECT o_custkey, min(price) AS price FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1)
 SELECT * FROM s UNION ALL SELECT o_custkey, arg_min(price, o_orderkey) FROM o WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM s) GROUP BY 1""",
    "upserted": """WITH d AS (SELECT c_custkey * 2 AS c_custkey, 99 AS c_nationkey FROM customer WHERE c_custkey % 5 = 0)
 SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM d) UNION ALL SELECT * FROM d""",
    "or_candidates": "SELECT DISTINCT s_suppkey AS in_id, n_nationkey AS cand_id FROM supplier, nation WHERE s_nationkey = n_nationkey OR s_nationkey = n_regionkey",
    "merge_sources": "SELECT doc_id, CAST(3 AS INT) AS n, source || ':' || doc_id || ',' || lang || ':' || doc_id || ',' || source || ':' || (doc_id + 1) AS sources FROM documents",
    "counters_fold": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1",
    "run_status": """WITH r AS (SELECT user_id, min(ts) AS started, max(ts) FILTER (WHERE event_type = 'purchase') AS ended, count(*) FILTER (WHERE event_type IN ('view', 'error', 'signup')) AS total,
 count(*) FILTER (WHERE event_type = 'view') AS good, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1)
 SELECT user_id, CASE WHEN ended IS NULL AND TIMESTAMP '2024-01-20 00:00:00' - started > INTERVAL 15 DAY THEN CASE WHEN good > 0 THEN 'completed' ELSE 'failed' END
 WHEN ended IS NULL AND total > 0 AND good + bad >= total THEN 'scoring' WHEN ended IS NULL THEN 'fetching' WHEN good = 0 AND bad > 0 THEN 'failed' ELSE 'completed' END AS status,
 good + bad AS sources_completed, total AS sources_total FROM r""",
    "source_health": """WITH e AS (SELECT user_id, ts, event_id, (event_id * 7) % 5 < 2 AS failed FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
 l AS (SELECT user_id, coalesce(max(k) FILTER (WHERE NOT failed), 0) AS ok, count(*) FILTER (WHERE failed) AS error_count FROM r GROUP BY 1)
 SELECT l.user_id, max(error_count) AS error_count, count(*) FILTER (WHERE k > ok) AS consecutive_errors, CASE WHEN count(*) FILTER (WHERE k > ok) > 0 THEN 'error' ELSE 'healthy' END AS health_status FROM l JOIN r USING (user_id) GROUP BY 1""",
    "errors_append": "SELECT user_id, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (WHERE event_id % 4 = 0), '') AS items FROM events GROUP BY 1",
    "active_run": "SELECT event_id AS id FROM (SELECT * FROM events WHERE event_id % 3 = 0 ORDER BY ts DESC LIMIT 1) WHERE TIMESTAMP '2024-01-31 00:00:00' - ts <= INTERVAL 40 DAY",
    "scored_in_run": "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND value >= 0",
    "vector_radius": """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
 FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0 AND round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) < 0.8""",
    "rrf": """WITH v AS (SELECT o_orderkey, o_orderkey % 100 / 100.0 AS s1, nullif(o_custkey % 50 / 50.0, 0.0) AS s2 FROM orders),
 r AS (SELECT o_orderkey, CAST(greatest(1, floor((1 - s1::DOUBLE) * 100 + 0.5)) AS INT) AS r1, CASE WHEN s2 IS NOT NULL THEN CAST(greatest(1, floor((1 - s2::DOUBLE) * 100 + 0.5)) AS INT) END AS r2 FROM v)
 SELECT o_orderkey, r1, r2, round(CASE WHEN r2 IS NULL THEN 61.0::DOUBLE / (60 + r1) ELSE (61.0::DOUBLE / (60 + r1) + 61.0::DOUBLE / (60 + r2)) / 2 END, 6) AS confidence FROM r""",
    "company_join": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS intel FROM supplier",
}

#: The parts of a confidence: ranks of similarities, salary overlap, and the fused ranks of a pair (null ranks are left out).
_RANK = "greatest(1, floor((1 - ({})) * 100 + 0.5))"
_OVER = """CASE WHEN a.low IS NULL OR b.low IS NULL THEN NULL WHEN least(a.high, b.high) < greatest(a.low, b.low) THEN 0.0::DOUBLE WHEN greatest(a.high, b.high) = least(a.low, b.low) THEN 1.0::DOUBLE ELSE (least(a.high, b.high) - greatest(a.low, b.low))::DOUBLE / (greatest(a.high, b.high) - least(a.low, b.low)) END"""


def _fused(names: str) -> str:
    parts = names.split()
    return "(" + " + ".join(f"coalesce(61.0::DOUBLE / (60 + {n}), 0)" for n in parts) + ") / (" + " + ".join(f"({n} IS NOT NULL)::INT" for n in parts) + ")"


_BEST = """ SELECT l.id AS in_id, cand_id, round(confidence, 9) AS confidence, CASE WHEN confidence > 0.9 THEN 'merged' WHEN confidence >= 0.7 THEN 'similar' ELSE 'new' END AS disposition FROM l LEFT JOIN t ON t.in_id = l.id WHERE l.id % 2 = 1"""
SQL["dedup_disposition"] = f"""WITH l AS (SELECT doc_id AS id, source AS title, lang AS company, CASE doc_id % 3 WHEN 0 THEN 'rome' WHEN 1 THEN 'oslo' END AS place, CASE WHEN doc_id % 4 > 0 THEN n_chars % 40 * 1000 END AS low, CASE WHEN doc_id % 8 > 3 THEN n_chars % 40 * 1000 + 20000 WHEN doc_id % 4 > 0 THEN n_chars % 40 * 1000 END AS high FROM documents),
 p AS (SELECT a.id AS in_id, b.id AS cand_id, CASE WHEN a.title = b.title AND a.company = b.company AND a.place IS NOT DISTINCT FROM b.place THEN 1 ELSE 100 END AS r1, {_RANK.format("CASE WHEN a.company = b.company THEN 1.0::DOUBLE WHEN a.company[1] = b.company[1] THEN 2 / 3.0::DOUBLE + 0.1::DOUBLE * (1 - 2 / 3.0::DOUBLE) ELSE 0 END")} AS r2,
  CASE WHEN a.place IS NOT NULL AND b.place IS NOT NULL THEN CASE WHEN a.place = b.place THEN 1 ELSE 50 END END AS r3, {_RANK.format(_OVER)} AS r4, {_OVER} AS shared FROM l a JOIN l b ON a.id % 2 = 1 AND b.id % 2 = 0 AND (a.company = b.company OR a.title = b.title)),
 c AS (SELECT in_id, cand_id, r1, r2, r3, CASE WHEN shared IS NOT NULL THEN r4 END AS r4 FROM p), t AS (SELECT in_id, cand_id, {_fused('r1 r2 r3 r4')} AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY in_id ORDER BY {_fused('r1 r2 r3 r4')} DESC, cand_id) = 1)
{_BEST}"""

#: Jaro-Winkler of the distinct pairs (x, y) of a table: the places in y of the letters of x that match, in x's order, then
#: transpositions against their sorted order, and the prefix of up to 4.
_NAMED = """g AS (SELECT x, y, greatest(0, greatest(length(x), length(y)) // 2 - 1) AS reach FROM {pairs}),
 h AS (SELECT x, y, list_reduce(range(1, length(x) + 1), lambda acc, i: list_concat(acc, list_filter(range(greatest(1, i - reach), least(length(y), i + reach) + 1), lambda j: y[j:j] = x[i:i] AND NOT list_contains(acc, j))[1:1]), []::BIGINT[]) AS hits FROM g WHERE x <> y AND x <> '' AND y <> ''),
 o AS (SELECT x, y, len(hits)::DOUBLE AS m, len(list_filter(list_zip(hits, list_sort(hits)), lambda z: y[z[1]:z[1]] <> y[z[2]:z[2]])) / 2 AS swaps, len(list_filter(range(1, 5), lambda n: n <= length(x) AND n <= length(y) AND x[:n] = y[:n])) AS prefix FROM h),
 q AS (SELECT x, y, CASE WHEN m > 0 THEN (m / length(x) + m / length(y) + (m - swaps) / m) / 3::DOUBLE ELSE 0 END AS jaro, m, prefix FROM o),
 jw AS (SELECT x, y, CASE WHEN m > 0 THEN jaro + prefix * 0.1::DOUBLE * (1 - jaro) ELSE 0::DOUBLE END AS s FROM q)"""
SQL["dedup_names"] = f"""WITH w AS (SELECT doc_id AS id, 'Role ' || doc_id // 64 AS title, string_split_regex(text, '[ .,\\n]+') AS w, n_chars FROM documents),
 l0 AS (SELECT id, title, CASE WHEN id % 11 > 0 THEN concat_ws(' ', w[1], w[2]) END AS name, {PLACES}[id % 8 + 1] AS spot, CASE WHEN id % 4 > 0 THEN n_chars % 40 * 1000 END AS low, CASE WHEN id % 8 > 3 THEN n_chars % 40 * 1000 + 20000 WHEN id % 4 > 0 THEN n_chars % 40 * 1000 END AS high FROM w),
 l AS (SELECT id, title, lower(name) AS company, lower(spot) AS place, low, high, sha256(regexp_replace(lower(coalesce(title, '') || coalesce(name, '') || coalesce(spot, '')), '[^a-z0-9]', '', 'g')) AS print FROM l0),
 c AS (SELECT a.id AS in_id, b.id AS cand_id, CASE WHEN a.print = b.print THEN 1 ELSE 100 END AS r1, a.company AS x, b.company AS y, a.place AS u, b.place AS v, {_RANK.format(_OVER)} AS r4, {_OVER} AS shared FROM l a JOIN l b ON a.id % 2 = 1 AND b.id % 2 = 0 AND (a.company = b.company OR a.title = b.title OR a.print = b.print)),
 n AS (SELECT DISTINCT x, y FROM c WHERE x IS NOT NULL AND y IS NOT NULL UNION SELECT DISTINCT u, v FROM c WHERE u IS NOT NULL AND v IS NOT NULL),
 {_NAMED.format(pairs="n")},
 k AS (SELECT in_id, cand_id, r1, CASE WHEN c.x IS NOT NULL AND c.y IS NOT NULL THEN {_RANK.format("CASE WHEN c.x = c.y THEN 1.0::DOUBLE ELSE coalesce(j.s, 0) END")} END AS r2, CASE WHEN u IS NOT NULL AND v IS NOT NULL THEN {_RANK.format("CASE WHEN u = v THEN 1.0::DOUBLE ELSE coalesce(i.s, 0) END")} END AS r3, CASE WHEN shared IS NOT NULL THEN r4 END AS r4 FROM c LEFT JOIN jw j ON j.x = c.x AND j.y = c.y LEFT JOIN jw i ON i.x = u AND i.y = v),
 t AS (SELECT in_id, cand_id, {_fused('r1 r2 r3 r4')} AS confidence FROM k QUALIFY row_number() OVER (PARTITION BY in_id ORDER BY {_fused('r1 r2 r3 r4')} DESC, cand_id) = 1)
{_BEST}"""
SQL["dedup_vectors"] = f"""WITH l AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, vec_id % 7 * 1000 AS low, CASE WHEN vec_id % 3 > 0 THEN vec_id % 7 * 1000 + 3000 ELSE vec_id % 7 * 1000 END AS high FROM embeddings),
 p AS (SELECT a.id AS in_id, b.id AS cand_id, CASE WHEN a.id // 4 = b.id // 4 THEN 1 ELSE 100 END AS r1, {_RANK.format("CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 2 / 3.0::DOUBLE + 0.1::DOUBLE * (1 - 2 / 3.0::DOUBLE) END")} AS r2, {_RANK.format(_OVER)} AS r3, {_RANK.format('1 - list_cosine_distance(a.v, b.v)')} AS r4 FROM l a JOIN l b ON a.id % 2 = 1 AND b.id % 2 = 0 AND list_cosine_distance(a.v, b.v) < 0.9),
 t AS (SELECT in_id, cand_id, {_fused('r1 r2 r3 r4')} AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY in_id ORDER BY {_fused('r1 r2 r3 r4')} DESC, cand_id) = 1)
{_BEST}"""
SQL["health_of_stream"] = f"SELECT * FROM ({SQL['counters_fold']}) JOIN ({SQL['source_health']}) USING (user_id)"
SQL["merged_listings"] = """WITH i AS (SELECT doc_id AS k, doc_id // 9 * 9 AS c, source, lang, n_chars FROM documents WHERE doc_id % 3 > 0 AND doc_id % 7 > 0),
 m AS (SELECT c, arg_min(-n_chars, k) AS low, arg_min(CASE WHEN k % 4 > 0 THEN lang END, k) FILTER (WHERE k % 4 > 0) AS place, arg_max(0.9::DOUBLE + k % 10 / 1000.0::DOUBLE, k) AS conf, min(k) AS first, string_agg(source || ':' || k || CASE WHEN k = f THEN ',x:1' ELSE '' END, ',' ORDER BY k) AS s FROM (SELECT *, min(k) OVER (PARTITION BY c) AS f FROM i) GROUP BY 1)
 SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars END, low) AS salary_min, place AS location, source || ':' || doc_id || coalesce(',' || s, '') AS sources, round(conf, 6) AS dedup_confidence, c IS NOT NULL AND doc_id % 5 = 0 AS needs_score FROM documents LEFT JOIN m ON c = doc_id WHERE doc_id % 3 = 0"""
