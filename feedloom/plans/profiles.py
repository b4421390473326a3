"""Queries on resumes, scoring paths, the retired scorer, state changes and backfills over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import companies, resume, retired, scores
from feedloom.functions import text as X
from feedloom.operators import catalog, enrichment, merging, runs, state
from feedloom.plans.details import _as_of, _catalog
from feedloom.plans.feeds import _s
from feedloom.plans.stored import events, table
from feedloom.sources import payloads, urls

YEAR = 2024


def _resumes(spark, sf_dir):
    """Suppliers' resumes: companies' lines or blocks, by number; skills are the words of a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^A-Za-z0-9 ]", "").alias("w"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(d, F.col("s_suppkey") == F.col("doc_id"))
    k = F.col("s_suppkey")
    by_company = _s("ACME ", F.lit("CORP"), ".  •  Reno, NV\t", k % 10 + 2000, " - ", F.when(k % 4 == 0, "Present").otherwise((k % 10 + 2003).cast("string")), "\nLed a team of cooks.\nSenior Data Cook\nBuilt Many Things\nBETA, INC | Oslo  2001 – 2004\nhelped out with the daily work")
    by_block = _s("Dev ", k, " at Acme ", k, "\n", k % 10 + 2000, " - current\n\nHead Cook, Blue Diner\n2010 – 2014\n\nStable hand\nFarm, |  2001-2003,\n\nno years here\nnor here")
    text = F.concat(F.col("s_name"), F.lit("\nme@x.example, Reno, NV\n12 Main St. Reno, NV 89501\n\n"), F.lit("Summary:\nA seasoned Data Engineer and"), _s(" lead Site Architect ", k, "\n"), F.lit("KEY SKILLS\n- SQL, sql; Go | "), F.replace("w", F.lit(" "), F.lit(",")), F.lit("\nWork Experience\n"), F.when(k % 2 == 0, by_company).otherwise(by_block), F.lit("\nEDUCATION\nnone"))
    return s.select("s_suppkey", text.alias("text"))


def resumes(spark, sf_dir):
    r = _resumes(spark, sf_dir).select("s_suppkey", resume.parse_resume(F.col("text"), F.lit(YEAR)).alias("r"))
    shown = F.array_join(F.transform("r.experience", lambda x: F.concat_ws("/", x["title"], x["company"], F.coalesce(x["years"].cast("string"), F.lit("-")))), ";")
    return r.select("s_suppkey", F.array_join("r.skills", ",").alias("skills"), shown.alias("experience"), F.array_join("r.jobTitles", ";").alias("titles"), F.col("r.location").alias("location"), resume.total_years(F.col("r.experience")).alias("years"))


def resume_skills(spark, sf_dir):
    """Every word of every document as a skill, once, in its first spelling."""
    lines = F.split(F.regexp_replace("text", r"[^A-Za-z0-9]+", ","), "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", resume.skills_of(lines).alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", ","), 256).alias("digest"))


def resume_sections(spark, sf_dir):
    """Lines of each section of documents whose every sixth line is a header."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    headers = F.array(*map(F.lit, ["SKILLS", "Work history:", "Education", "About me", "none", "Profile -"]))
    lines = F.transform(F.split(F.regexp_replace("text", r"[^A-Za-z ]", "\n"), "\n"), lambda x, i: F.when(i % 6 == 5, F.get(headers, ((i - 5) / 6).cast("int") % 6)).otherwise(F.concat(F.lit("x "), x)))
    found = d.select("doc_id", resume.sections(F.array_join(lines, "\n")).alias("s"))
    count = lambda name: F.size(resume.lines_of(F.col("s"), name)).alias(name)
    return found.select("doc_id", F.size("s").alias("sections"), *(count(n) for n in ("preamble", "skills", "experience", "education", "summary")))


def search_preferences(spark, sf_dir):
    k = F.col("c_custkey")
    titles, where = F.when(k % 2 == 0, F.array(F.lit("Dev"))), F.when(k % 3 == 0, F.array(F.lit("Rome"))).otherwise(F.array().cast("array<string>"))
    read = F.struct(F.when(k % 5 > 0, F.array(F.when(k % 5 == 1, " X ").otherwise(_s("Cook ", k)))).otherwise(F.array().cast("array<string>")).alias("jobTitles"), F.when(k % 4 > 0, _s("City ", k)).alias("location"))
    got = table(spark, sf_dir, "customer").select("c_custkey", resume.search_preferences(titles, where, read).alias("p"))
    return got.select("c_custkey", F.array_join("p.titles", ",").alias("titles"), F.array_join("p.locations", ",").alias("locations"))


def scored_paths(spark, sf_dir):
    """Orders as listings: known by title only, with a profile, or without one."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (k % 97 / 96.0).alias("skills_sim"), (F.col("o_custkey") % 89 / 88.0).alias("title_sim"), F.when(k % 3 == 0, 100).otherwise(50).alias("salary"), (k % 5 == 0).alias("bare"), (k % 7 > 1).alias("profiled"))
    b = scores.score_job(F.col("bare"), F.col("profiled"), F.col("skills_sim"), F.col("title_sim"), F.col("salary"))
    return o.select("o_orderkey", b.alias("b")).select("o_orderkey", "b.*")


def embedding_texts(spark, sf_dir):
    """The texts to embed: a listing's, and a profile's skills and title; their digests."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.when(F.col("doc_id") % 7 > 0, F.col("text")).alias("text"))
    p = F.struct(F.when(F.col("doc_id") % 3 > 0, F.array(F.col("lang"), F.col("source"))).otherwise(F.array().cast("array<string>")).alias("hardSkills"), F.col("lang").alias("seniorityLevel"), F.col("source").alias("title"))
    texts = scores.profile_texts(p)
    return d.select("doc_id", F.sha2(scores.embedding_text(F.col("source"), F.col("lang"), F.col("text")), 256).alias("listing"), texts["hardSkills"].alias("skills"), texts["title"].alias("title"))


def model_profiles(spark, sf_dir):
    """Profiles in models' answers: with words around them, a years text, empty skills, or no JSON at all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    k = F.col("doc_id")
    body = _s('{"title": "', F.col("source"), '", "yearsExperience": ', F.when(k % 3 == 0, F.concat(F.lit('"'), (k % 9).cast("string"), F.lit('"'))).when(k % 3 == 1, (k % 9 - 4).cast("string")).otherwise("null"), ', "hardSkills": ["', F.col("lang"), '", "", "Go"], "softSkills": null}')
    answer = F.when(k % 5 == 0, "I cannot say").when(k % 5 == 1, F.concat(F.lit("Here:\n"), body, F.lit("\nDone"))).otherwise(body)
    return d.select("doc_id", scores.profile_of(answer).alias("p")).select("doc_id", "p.title", "p.domain", F.col("p.yearsExperience").alias("years"), F.array_join("p.hardSkills", ",").alias("skills"), F.size("p.softSkills").alias("soft"))


def score_bands(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 101).alias("s"), (F.col("o_custkey") % 90 * 1000).alias("low"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") % 90 * 1000 + 5001).alias("high"))
    target = scores.salary_target(F.when(F.col("low") % 7000 > 0, F.col("low")), F.col("high"))
    return o.groupBy(scores.badge(F.col("s")).alias("badge"), scores.ring_color(F.col("s")).alias("color")).agg(F.count("*").alias("n"), F.sum(target).alias("targets"))


_PARTS = ["health", "medical plan", "pension", "stock options", "free lunch", "bonus", "paid leave", "dog friendly office", "dental", "parental leave"]


def benefit_lists(spark, sf_dir):
    """Benefits by the customer's number, grouped: the first six groups, and how many are over."""
    k = F.col("c_custkey")
    own = F.filter(F.transform(F.array(*map(F.lit, _PARTS)), lambda x, i: F.when(F.pmod(k * (i + 3), F.lit(11)) < 7, x)), lambda x: x.isNotNull())
    got = table(spark, sf_dir, "customer").select("c_custkey", X.shown_benefits(own, 2).alias("b"))
    groups = F.array_join(F.transform("b.shown", lambda g: F.concat(g["category"], F.lit("="), F.array_join(g["originals"], "+"))), ";")
    return got.select("c_custkey", groups.alias("shown"), F.col("b.more").alias("more"))


def unknown_facts(spark, sf_dir):
    """Facts of documents with a sentence on some: how many lack each, and how many expire within a day."""
    k = F.col("doc_id")
    told = F.concat(F.col("text"), F.when(k % 2 == 0, _s(" It has ", k, "0 employees.")).otherwise(""), F.when(k % 3 == 0, " Rated 4.5 out of 5.").otherwise(""), F.when(k % 5 == 0, " It raised $7 million in May.").otherwise(""))
    f = table(spark, sf_dir, "documents").select(companies.facts(F.regexp_replace(told, "[$](?![0-9])", "")).alias("f"))
    late = companies.expires_at(F.col("f"), _as_of()) > _as_of() + F.make_dt_interval(days=F.lit(1))
    return f.agg(*companies.unknown_counts("f"), F.count_if(late).alias("kept_long"))


def detail_snippets(spark, sf_dir):
    """Search results of customers' listings: relevant, foreign, noisy, short, and repeated ones."""
    k, i = F.col("c_custkey"), F.col("rank")
    said = F.when(i % 4 == 0, _s("The cook at Acme works with others on dishes number ", i, " of plan ", k, " and is paid $", i + 20, ".00 an hour in town, day and night")).when(i % 4 == 1, "Acme wants a cook. Sign in to apply for this and other work at all places").when(i % 4 == 2, _s("A cook of Acme, as said before: this snippet starts alike in each of these results and then differs in its number ", i)).otherwise("Acme cook")
    r = table(spark, sf_dir, "customer").select("c_custkey").select(k.alias("id"), "c_custkey", F.explode(F.sequence(F.lit(1), (k % 4 + 9).cast("int"))).alias("rank")).select("id", "rank", F.lit("Head cook").alias("title"), F.lit("Acme Co").alias("company"), said.alias("content"))
    d = enrichment.details_of(r)
    return d.select("id", F.length("description_text").alias("chars"), F.sha2("description_text", 256).alias("digest"), "salary_min", "salary_max")


def closed_listings(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").select(F.col("source").alias("source_name"), F.col("doc_id").alias("external_id"), F.when(F.col("doc_id") % 10 == 0, _as_of() - F.expr("interval 1 day")).alias("closed_at"))
    fresh = stored.filter("external_id % 3 <> 0").select("source_name", "external_id")
    gone = stored.transform(merging.to_close(fresh, stored.filter("source_name in ('src0', 'src1', 'src2')").select("source_name").distinct()))
    out = stored.transform(state.closed(gone, ["source_name", "external_id"], _as_of()))
    return out.select("source_name", "external_id", (F.col("closed_at") == _as_of()).alias("closed_now"))


def runs_changed(spark, sf_dir):
    """Users' events as runs: one begins, those of every third user end."""
    e = events(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("started_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("completed_at"))
    done = e.filter("id % 3 = 0").select("id")
    return e.transform(state.run_started(F.lit(-1).cast("bigint"), _as_of())).transform(state.run_completed(done, _as_of()))


def source_last_errors(spark, sf_dir):
    """The last failure of each user's events, kept after later successes."""
    rows = events(spark, sf_dir).withColumn("failed", F.pmod(F.col("event_id") * 7, F.lit(5)) < 2).withColumn("message", F.col("event_type"))
    return rows.transform(runs.last_errors("user_id", ["ts", "event_id"], "failed", "message"))


def _named_catalog(spark, sf_dir):
    return _catalog(spark, sf_dir).withColumn("display_name", F.initcap("name"))


def seeded_sources(spark, sf_dir):
    none = _named_catalog(spark, sf_dir).select("name", "display_name", "type", F.lit(True).alias("is_enabled")).filter("name is null")
    return none.transform(state.seeded(_named_catalog(spark, sf_dir)))


def configured_sources(spark, sf_dir):
    """Configs for suppliers' nations and two unknown sources; nations of region 0 have none yet."""
    n = table(spark, sf_dir, "nation")
    stored = n.filter("n_regionkey > 0").select(F.col("n_name").alias("name"), F.lower("n_name").alias("display_name"), F.lit("open").alias("type"), F.lit("old").alias("config"), F.lit(None).cast("timestamp").alias("updated_at"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    delta = n.join(s, F.col("n_nationkey") == F.col("s_nationkey")).select(F.when(F.col("n_nationkey") % 11 == 0, F.concat(F.lit("new "), F.col("n_name"))).otherwise(F.col("n_name")).alias("name"), F.col("n").cast("string").alias("config"))
    out = stored.transform(state.configured(delta, _named_catalog(spark, sf_dir), _as_of()))
    return out.select("name", "display_name", "type", "config", F.col("updated_at").isNotNull().alias("changed"))


def single_rows(spark, sf_dir):
    """A resume over one that is stored, and over none; then the same after parsing it anew."""
    one = events(spark, sf_dir).agg(F.min("event_id").alias("id"), F.min("ts").alias("created_at"), F.max("event_type").alias("file_name"), F.sum("value").isNotNull().alias("parsed"), F.lit("p").alias("extracted_profile"), F.max("ts").alias("updated_at"))
    row = events(spark, sf_dir).agg((F.max("event_id") + 1).alias("id"), _as_of().alias("created_at"), F.min("event_type").alias("file_name"), F.lit(False).alias("parsed"), F.lit("q").alias("extracted_profile"))
    over = one.transform(state.singleton(row, _as_of()))
    anew = one.transform(state.reparsed(row.select("file_name", "parsed"), _as_of()))
    shown = lambda df, name: df.select(F.lit(name).alias("case"), "id", "created_at", "file_name", "parsed", "extracted_profile", "updated_at")
    return shown(over, "over").unionByName(shown(one.filter("id < 0").transform(state.singleton(row, _as_of())), "none")).unionByName(shown(anew, "anew"))


def rescored_rows(spark, sf_dir):
    """Stored orders with updates of their score by key, and the one row of a table beside each."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).cast("int").alias("match_score"))
    new = o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 8 > 0, F.lit(101)).alias("match_score"))
    one = table(spark, sf_dir, "region").agg(F.max("r_name").alias("wanted"))
    return o.transform(state.scores_updated(new, ["o_orderkey"], ["match_score"])).transform(state.with_singleton(one, ["wanted"]))


def country_backfills(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "XX").alias("country"), F.when(F.col("c_custkey") % 5 > 0, F.col("n_name")).alias("location"))
    return state.country_backfilled(c).select("c_custkey", "country")


def vector_backfills(spark, sf_dir):
    """Half of the vectors missing; the embedder here gives a text's length, and an infinite one for some."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0))).alias("embedding"))
    embed = lambda t: F.array(F.when(F.length(t) % 7 == 0, F.lit(float("inf"))).otherwise(F.length(t).cast("double")))
    return state.backfill_counts(d.transform(state.vectors_backfilled(scores.embedding_text(F.col("source"), F.col("lang"), F.col("text")), embed)))


def partial_inserts(spark, sf_dir):
    """How many partial listings are inserted: keys in stored or repeated ones do not count."""
    line = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("source_name"), F.col("l_partkey").alias("external_id"), F.struct("l_orderkey", "l_linenumber").alias("position"))
    stored = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.lit("s").alias("source_name"), F.col("p_partkey").alias("external_id"))
    return line.transform(state.partial_inserts(stored, ["source_name", "external_id"], "position")).agg(F.count_if("partial").alias("inserted"))


def known_also_closed(spark, sf_dir):
    """Orders that lines do not know, where closed ones count as known."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") > 1, F.col("l_shipdate")).alias("closed_at")).filter("o_orderkey % 3 > 0")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").transform(merging.unknown_listings(lines, ["o_orderkey"], reopen_closed=False))


def nearest_few(spark, sf_dir):
    """The five lines of each part with the lowest price."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.round("l_extendedprice", 2).alias("price"), "l_orderkey", "l_linenumber")
    return line.transform(state.nearest_few("l_partkey", ["price", "l_orderkey", "l_linenumber"], 5))


def stored_rows(spark, sf_dir):
    """Stored rows with nulls as normalised ones."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(_s(k).alias("external_id"), F.col("source").alias("source_name"), F.when(k % 3 > 0, F.col("source")).alias("title"), F.when(k % 4 > 0, F.col("lang")).alias("company"), F.when(k % 5 > 0, F.col("text")).alias("description_text"), F.when(k % 2 > 0, "Rome").alias("location"), F.when(k % 7 > 0, F.col("lang")).alias("country"), F.lit(None).cast("string").alias("source_url"))
    return payloads.restored(d).select("external_id", "title", "company", "country", "source_url", "fingerprint", F.sha2("search_text", 256).alias("digest"))


def route_urls(spark, sf_dir):
    """Feed addresses for each part's name as a search."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.col("p_name"), F.lit(" é&c ")).alias("query"))
    return p.select("p_partkey", urls.rsshub_feed(F.col("query"), F.lit("https://hub.example//"), geo=F.when(F.col("p_partkey") % 2 == 0, "a b")).alias("url"))


def company_overlap(spark, sf_dir):
    """Stored company rows of documents' sources, each with the skills of a list that the document names."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    intel = d.select("source").distinct().filter("source <> 'src3'").select(X.normalize_company(F.col("source")).alias("key"), F.upper("source").alias("known"))
    named = X.named_skills(F.col("text"), ["the", "C++", "que", "Und", "%%%"])
    joined = d.join(intel, X.normalize_company(F.col("source")) == F.col("key"), "left")
    return joined.select("doc_id", "known", F.array_join(named, ",").alias("overlap"))


def listing_sums(spark, sf_dir):
    """Listings by source in all: the sum of the sources' counts."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("listings_count")).agg(F.sum("listings_count").alias("total"))


def retired_scores(spark, sf_dir):
    """The first scorer: skills of a list in each document, requirements from a model's answer, a nudge by another."""
    k = F.col("doc_id")
    own = F.array(*map(F.lit, ["The", "data and the of que", "C++", "SQL tools", "und"]))
    answer = F.when(k % 4 == 0, "only one").otherwise(_s("1. SQL, - Go lang, 42, x, C++ templates, level ", k))
    terms = retired.requirement_list(answer)
    axes = F.struct(retired.skill_percent(own, F.col("text")).alias("skills"), retired.requirement_percent(own, terms).alias("requirements"), retired.experience_axis(k % 13 / 12.0).alias("experience"), (k % 3 * 50).cast("int").alias("salary"))
    said = F.when(k % 5 == 0, "no").when(k % 5 == 1, " 9\nRequirements: 12\nExperience: 0").when(k % 5 == 2, "Skills: 3\nTech Stack: 4").otherwise(" 5\nExperience: 7")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", axes.alias("a"), said.alias("said")).withColumn("after", retired.nudged(F.col("said"), F.col("a")))
    d = d.withColumn("t", retired.tiered(F.col("a"), F.col("after")))
    return d.select("doc_id", F.col("a.skills").alias("skills"), F.col("a.requirements").alias("requirements"), retired.weighted(F.col("a")).alias("own"), F.col("t.skills").alias("t_skills"), F.col("t.requirements").alias("t_requirements"), F.col("t.experience").alias("t_experience"), retired.weighted(F.col("t")).alias("score"), F.sha2(retired.nudge_prompt(F.col("text"), F.col("source"), F.col("text"), F.col("a")), 256).alias("prompt_digest"))


def search_addresses(spark, sf_dir):
    """Nations' names as searches, some blank, over two routes, of which one has no address for every third."""
    k = F.col("n_nationkey")
    base, other = F.lit("https://hub.example//"), F.when(k % 3 > 0, "https://more.example")
    routes = {"linkedin": lambda q: urls.rsshub_feed(q, base), "more": lambda q: urls.rsshub_feed(q, other, F.lit("7"), job_types="full")}
    n = table(spark, sf_dir, "nation").select(k, F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("n_name"))).alias("query"))
    feeds = F.map_entries(urls.search_feeds(F.col("query"), routes))
    return n.select("n_nationkey", F.size(feeds).alias("n"), F.array_join(F.transform(feeds, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("feeds"))


QUERIES = {f.__name__: f for f in (search_addresses, resumes, resume_skills, resume_sections, search_preferences, scored_paths, embedding_texts, model_profiles, score_bands, benefit_lists, unknown_facts, detail_snippets, closed_listings, runs_changed, source_last_errors, seeded_sources, configured_sources, single_rows, rescored_rows, country_backfills, vector_backfills, partial_inserts, known_also_closed, nearest_few, stored_rows, route_urls, company_overlap, listing_sums, retired_scores)}

_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
_WORDS = "string_split(regexp_replace(text, '[^A-Za-z0-9]+', ',', 'g'), ',')"
_SCALE = "CAST(floor(greatest(0, least(1, ({} - {}::DOUBLE) / ({}::DOUBLE - {}::DOUBLE))) * 100 + 0.5) AS INT)"
_GROUPS = ["Health", "Health", "401k", "Equity", None, "Bonus", "PTO", "Pet", "Health", "Parental"]


def _grouped_benefits() -> str:
    """Each benefit with its category and place, the customers' own by number, then grouped by the first place."""
    rows = ", ".join(f"({i}, '{p}', '{g}')" for i, (p, g) in enumerate(zip(_PARTS, _GROUPS, strict=True)) if g)
    return f"""WITH p(i, b, g) AS (VALUES {rows}), o AS (SELECT c_custkey, g, min(i) AS pos, string_agg(b, '+' ORDER BY i) AS bs FROM customer, p WHERE c_custkey * (i + 3) % 11 < 7 GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY pos) AS n, count(*) OVER (PARTITION BY c_custkey) AS m FROM o)
 SELECT c.c_custkey, coalesce(string_agg(g || '=' || bs, ';' ORDER BY n) FILTER (WHERE n <= 2), '') AS shown, CAST(greatest(coalesce(max(m), 0) - 2, 0) AS INT) AS more FROM customer c LEFT JOIN r ON r.c_custkey = c.c_custkey GROUP BY 1"""


SQL = {
    "resumes": """WITH r AS (SELECT s_suppkey AS k, list_filter(list_concat(['SQL', 'sql', 'Go'], string_split(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' ')), lambda x: len(trim(x)) BETWEEN 1 AND 59) AS w FROM supplier JOIN documents ON doc_id = s_suppkey),
 u AS (SELECT k, x, i FROM (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM r) QUALIFY row_number() OVER (PARTITION BY k, lower(x) ORDER BY i) = 1),
 s AS (SELECT k, string_agg(x, ',' ORDER BY i) AS skills FROM u GROUP BY 1)
 SELECT k AS s_suppkey, skills, CASE WHEN k % 2 = 0 THEN 'Senior Data Cook/ACME CORP/' || CASE WHEN k % 4 = 0 THEN 24 - k % 10 ELSE 3 END ELSE 'Dev ' || k || '/Acme ' || k || '/' || (24 - k % 10) || ';Head Cook/Blue Diner/4;Stable hand/Farm, |/2' END AS experience,
 CASE WHEN k % 2 = 0 THEN 'Senior Data Cook' ELSE 'Dev ' || k || ';Head Cook;Stable hand' END || ';seasoned Data Engineer and lead Site Architect' AS titles, 'Reno, NV' AS location, CAST(CASE WHEN k % 4 = 0 THEN 24 - k % 10 WHEN k % 2 = 0 THEN 3 ELSE 30 - k % 10 END AS INT) AS years FROM s""",
    "resume_skills": f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS x, generate_subscripts({_WORDS}, 1) AS i FROM documents),
 u AS (SELECT * FROM w WHERE len(x) BETWEEN 1 AND 59 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) = 1)
 SELECT d.doc_id, CAST(count(x) AS INT) AS n, sha256(coalesce(string_agg(x, ',' ORDER BY i), '')) AS digest FROM documents d LEFT JOIN u USING (doc_id) GROUP BY 1""",
    "resume_sections": """WITH n AS (SELECT doc_id, len(regexp_replace(text, '[A-Za-z ]', '', 'g')) + 1 AS n FROM documents), l AS (SELECT doc_id, n, unnest(range(n)) AS i FROM n),
 h AS (SELECT *, i % 6 = 5 AND i // 6 % 6 <> 4 AS header, CASE i // 6 % 6 WHEN 0 THEN 'skills' WHEN 1 THEN 'experience' WHEN 2 THEN 'education' ELSE 'summary' END AS name FROM l),
 g AS (SELECT *, sum(header::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h),
 q AS (SELECT doc_id, s, max(s) OVER (PARTITION BY doc_id) AS final, coalesce(max(name) FILTER (WHERE header), 'preamble') AS name, count(*) FILTER (WHERE NOT header) AS lines FROM g GROUP BY doc_id, s)
 SELECT doc_id, CAST(count(*) FILTER (WHERE lines > 0 OR (name <> 'preamble' AND s < final)) AS INT) AS sections, """ + ", ".join(f"CAST(coalesce(sum(lines) FILTER (WHERE name = '{n}'), 0) AS INT) AS {n}" for n in ("preamble", "skills", "experience", "education", "summary")) + " FROM q GROUP BY 1",
    "search_preferences": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Dev' WHEN c_custkey % 5 > 1 THEN 'Cook ' || c_custkey ELSE '' END AS titles, CASE WHEN c_custkey % 3 = 0 THEN 'Rome' WHEN c_custkey % 4 > 0 THEN 'City ' || c_custkey ELSE '' END AS locations FROM customer""",
    "scored_paths": f"""WITH v AS (SELECT o_orderkey AS k, (o_orderkey % 97)::DOUBLE / 96 AS s, (o_custkey % 89)::DOUBLE / 88 AS t, CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 50 END AS pay, CASE WHEN o_orderkey % 5 = 0 THEN 'title' WHEN o_orderkey % 7 > 1 THEN 'profile' ELSE 'fallback' END AS path FROM orders),
 a AS (SELECT *, CASE WHEN path = 'profile' THEN {_SCALE.format('s', '0.25', '0.75', '0.25')} ELSE 0 END AS skills, {_SCALE.format('t', '0.25', '0.75', '0.25')} AS experience, CASE path WHEN 'profile' THEN {_SCALE.format('s', '0.30', '0.85', '0.30')} WHEN 'title' THEN {_SCALE.format('t', '0.30', '0.85', '0.30')} ELSE 0 END AS domain FROM v)
 SELECT k AS o_orderkey, path, skills, experience, CAST(CASE WHEN path = 'title' THEN 0 ELSE pay END AS INT) AS salary, domain,
 CAST(CASE WHEN path = 'title' THEN least(100, floor(experience * 0.30::DOUBLE * (domain::DOUBLE / 100) + 0.5)) ELSE least(100, floor((0.4::DOUBLE * skills + 0.3::DOUBLE * experience + 0.3::DOUBLE * pay) * CASE WHEN pay = 100 THEN 1.15::DOUBLE ELSE 1 END * domain / 100 + 0.5)) END AS INT) AS score FROM a""",
    "embedding_texts": """SELECT doc_id, sha256(source || ' ' || lang || ' ' || CASE WHEN doc_id % 7 > 0 THEN substr(text, 1, 500) ELSE '' END) AS listing, CASE WHEN doc_id % 3 > 0 THEN lang || ', ' || source ELSE 'none' END AS skills, lang || ' ' || source AS title FROM documents""",
    "model_profiles": """SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS title, CASE WHEN doc_id % 5 > 0 THEN '' END AS domain, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN (doc_id % 9)::DOUBLE WHEN doc_id % 3 = 1 THEN greatest(doc_id % 9 - 4, 0)::DOUBLE ELSE 0 END AS years,
 CASE WHEN doc_id % 5 > 0 THEN lang || ',Go' END AS skills, CAST(CASE WHEN doc_id % 5 > 0 THEN 0 END AS INT) AS soft FROM documents""",
    "score_bands": """WITH v AS (SELECT o_orderkey % 101 AS s, o_custkey % 90 * 1000 AS low, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 90 * 1000 + 5001 END AS high FROM orders)
 SELECT CASE WHEN s >= 80 THEN 'high' WHEN s >= 50 THEN 'medium' ELSE 'low' END AS badge, CASE WHEN s < 30 THEN '#ef4444' WHEN s < 50 THEN '#f97316' WHEN s < 70 THEN '#eab308' WHEN s < 85 THEN '#22c55e' ELSE '#10b981' END AS color, count(*) AS n,
 sum(CASE WHEN low % 7000 > 0 THEN CASE WHEN high IS NULL THEN low::DOUBLE ELSE floor((low + high) / 2.0::DOUBLE + 0.5) END END) AS targets FROM v GROUP BY 1, 2""",
    "benefit_lists": _grouped_benefits(),
    "detail_snippets": """WITH r AS (SELECT c_custkey AS k, unnest(range(1, least(c_custkey % 4 + 9, 10) + 1)) AS i FROM customer),
 s AS (SELECT k, i, CASE WHEN i % 4 = 0 THEN 'The cook at Acme works with others on dishes number ' || i || ' of plan ' || k || ' and is paid $' || (i + 20) || '.00 an hour in town, day and night' ELSE 'A cook of Acme, as said before: this snippet starts alike in each of these results and then differs in its number ' || i END AS x FROM r WHERE i % 4 = 0 OR i = 2),
 t AS (SELECT k, string_agg(x, chr(10) || chr(10) ORDER BY i) AS t FROM s GROUP BY 1)
 SELECT k AS id, CAST(len(t) AS INT) AS chars, sha256(t) AS digest, 24 * 2080.0::DOUBLE AS salary_min, CAST(NULL AS DOUBLE) AS salary_max FROM t WHERE len(t) >= 200""",
    "closed_listings": """SELECT source AS source_name, doc_id AS external_id, CASE WHEN doc_id % 10 > 0 AND doc_id % 3 = 0 AND source IN ('src0', 'src1', 'src2') THEN TRUE WHEN doc_id % 10 = 0 THEN FALSE END AS closed_now FROM documents""",
    "runs_changed": f"""SELECT user_id AS id, min(ts) AS started_at, CASE WHEN user_id % 3 = 0 THEN {_AS_OF} ELSE max(ts) FILTER (WHERE event_type = 'purchase') END AS completed_at FROM events GROUP BY 1 UNION ALL SELECT -1, {_AS_OF}, NULL""",
    "source_last_errors": """SELECT user_id, last(event_type ORDER BY ts, event_id) FILTER (WHERE (event_id * 7) % 5 < 2) AS last_error, max(ts) FILTER (WHERE (event_id * 7) % 5 < 2) AS last_error_at, max(ts) FILTER (WHERE (event_id * 7) % 5 >= 2) AS last_fetch_at FROM events GROUP BY 1""",
    "seeded_sources": """SELECT n_name AS name, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS display_name, 'open' AS type, TRUE AS is_enabled FROM nation WHERE n_nationkey % 5 > 0""",
    "configured_sources": """WITH s AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1), d AS (SELECT CASE WHEN n_nationkey % 11 = 0 THEN 'new ' ELSE '' END || n_name AS name, CAST(n AS VARCHAR) AS config FROM nation JOIN s ON s_nationkey = n_nationkey)
 SELECT n_name AS name, lower(n_name) AS display_name, 'open' AS type, coalesce(d.config, 'old') AS config, d.name IS NOT NULL AS changed FROM nation LEFT JOIN d ON d.name = n_name WHERE n_regionkey > 0
 UNION ALL SELECT d.name, CASE WHEN n_name IS NULL THEN d.name ELSE array_to_string(list_transform(string_split(lower(d.name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END, CASE WHEN n_name IS NULL OR n_nationkey % 5 = 0 THEN 'key_required' ELSE 'open' END, d.config, TRUE FROM d LEFT JOIN nation ON n_name = d.name WHERE n_regionkey IS NULL OR n_regionkey = 0""",
    "single_rows": f"""WITH a AS (SELECT min(event_id) AS id, min(ts) AS created_at, max(event_type) AS high, min(event_type) AS low, max(event_id) + 1 AS next FROM events)
 SELECT 'over' AS "case", id, created_at, low AS file_name, FALSE AS parsed, 'q' AS extracted_profile, {_AS_OF} AS updated_at FROM a UNION ALL SELECT 'none', next, {_AS_OF}, low, FALSE, 'q', {_AS_OF} FROM a UNION ALL SELECT 'anew', id, created_at, low, FALSE, NULL, {_AS_OF} FROM a""",
    "rescored_rows": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 > 0 THEN 101 ELSE o_orderkey % 100 END AS INT) AS match_score, (SELECT max(r_name) FROM region) AS wanted FROM orders""",
    "country_backfills": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'XX' WHEN c_custkey % 5 > 0 THEN coalesce(map {'united states': 'US', 'united kingdom': 'GB', 'canada': 'CA', 'germany': 'DE', 'france': 'FR', 'india': 'IN', 'china': 'CN', 'japan': 'JP', 'brazil': 'BR', 'argentina': 'AR', 'egypt': 'EG', 'indonesia': 'ID', 'kenya': 'KE', 'peru': 'PE', 'romania': 'RO', 'saudi arabia': 'SA', 'vietnam': 'VN', 'russia': 'RU'}[lower(n_name)], 'Unknown') ELSE 'Unknown' END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "vector_backfills": """WITH d AS (SELECT len(source || ' ' || lang || ' ' || substr(text, 1, 500)) % 7 = 0 AS bad FROM documents WHERE doc_id % 2 > 0) SELECT count(*) AS total, count(*) FILTER (WHERE NOT bad) AS updated, count(*) FILTER (WHERE bad) AS errors FROM d""",
    "partial_inserts": "SELECT count(DISTINCT l_partkey) AS inserted FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)",
    "known_also_closed": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "nearest_few": "SELECT l_partkey, round(l_extendedprice, 2) AS price, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY round(l_extendedprice, 2), l_orderkey, l_linenumber) <= 5",
    "stored_rows": """WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS title, CASE WHEN doc_id % 4 > 0 THEN lang ELSE '' END AS company, CASE WHEN doc_id % 5 > 0 THEN text ELSE '' END AS text, CASE WHEN doc_id % 7 > 0 THEN lang ELSE 'Unknown' END AS country FROM documents)
 SELECT CAST(k AS VARCHAR) AS external_id, title, company, country, '' AS source_url, substr(sha256(regexp_replace(lower(title || company || CASE WHEN k % 2 > 0 THEN 'Rome' ELSE '' END), '[^a-z0-9]', '', 'g')), 1, 16) AS fingerprint, sha256(concat_ws(' ', nullif(title, ''), nullif(company, ''), nullif(text, ''))) AS digest FROM d""",
    "route_urls": """SELECT p_partkey, 'https://hub.example/linkedin/jobs/all/all/' || replace(replace(url_encode(p_name || ' é&c'), '%21', '!'), '%2A', '*') || CASE WHEN p_partkey % 2 = 0 THEN '?geoId=a%20b' ELSE '' END AS url FROM part""",
    "company_overlap": r"""SELECT doc_id, CASE WHEN source <> 'src3' THEN upper(source) END AS known, array_to_string(list_filter(['the', 'C++', 'que', 'Und', '%%%'], lambda s: CASE WHEN regexp_matches(s, '[^A-Za-z0-9\s]') THEN contains(lower(text), lower(s)) ELSE regexp_matches(text, '(^|[^A-Za-z0-9_])' || s || '($|[^A-Za-z0-9_])') END), ',') AS overlap FROM documents""",
    "listing_sums": "SELECT CAST(count(*) AS BIGINT) AS total FROM documents",
}

SQL["unknown_facts"] = r"""WITH d AS (SELECT doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b, doc_id % 5 = 0 AS c, doc_id % 5 = 0 OR regexp_matches(text || CASE WHEN doc_id % 2 = 0 THEN ' It has ' || doc_id || '0 employees.' ELSE '' END, '(?i)(?:launched|announced|acquired|partnered|released|introduced|raised)\s+[^.]{10}') AS news FROM documents)
 SELECT count(*) FILTER (WHERE NOT b) AS unknown_rating, count(*) FILTER (WHERE NOT a) AS unknown_size, count(*) FILTER (WHERE NOT c) AS unknown_funding, count(*) AS unknown_growth, count(*) FILTER (WHERE NOT news) AS unknown_news, count(*) AS unknown_industry, count(*) FILTER (WHERE a OR b OR news) AS kept_long FROM d"""
_SCORE = "least(100, floor(({0}skills * 0.35::DOUBLE + {0}requirements * 0.25::DOUBLE + {0}experience * 0.20::DOUBLE + salary * 0.20::DOUBLE) * CASE WHEN salary = 100 THEN 1.15::DOUBLE ELSE 1 END + 0.5))"
_NUDGE = "CASE WHEN {0} = 0 THEN 0 ELSE greatest(0, least(100, {0} + greatest(-10, least(10, {1} - {0})))) END"
SQL["search_addresses"] = """WITH q AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 > 0 THEN replace(n_name, ' ', '%20') END AS q FROM nation)
 SELECT k AS n_nationkey, CAST(CASE WHEN q IS NULL THEN 0 WHEN k % 3 > 0 THEN 2 ELSE 1 END AS INT) AS n, CASE WHEN q IS NULL THEN '' ELSE 'linkedin=https://hub.example/linkedin/jobs/all/all/' || q || CASE WHEN k % 3 > 0 THEN '|more=https://more.example/linkedin/jobs/full/all/' || q || '?geoId=7' ELSE '' END END AS feeds FROM q"""
SQL["retired_scores"] = rf"""WITH d AS (SELECT doc_id AS k, lower(text) AS t FROM documents),
 n AS (SELECT k, regexp_matches(t, '(^|[^a-z0-9_])the($|[^a-z0-9_])')::INT + (contains(t, 'data') AND contains(t, 'que'))::INT + contains(t, 'c++')::INT + (contains(t, 'sql') AND contains(t, 'tools'))::INT + regexp_matches(t, '(^|[^a-z0-9_])und($|[^a-z0-9_])')::INT AS n FROM d),
 a AS (SELECT k, CAST(floor(n / 5.0::DOUBLE * 100 + 0.5) AS INT) AS skills, CASE WHEN k % 4 > 0 THEN 50 ELSE 0 END AS requirements, {_SCALE.format('(k % 13)::DOUBLE / 12', '0.2', '0.6', '0.2')} AS experience, k % 3 * 50 AS salary FROM n),
 p AS (SELECT k, sha256('A scoring system rated this candidate-job match. Review and adjust each score. Output ONLY 3 lines, no other text.' || chr(10) || chr(10) || 'Initial scores — Skills: ' || CAST(floor(skills / 10.0 + 0.5) AS BIGINT) || '/10, Requirements: ' || CAST(floor(requirements / 10.0 + 0.5) AS BIGINT) || '/10, Experience: ' || CAST(floor(experience / 10.0 + 0.5) AS BIGINT)
  || '/10' || chr(10) || chr(10) || 'Candidate: ' || text[:300] || chr(10) || 'Job: ' || source || ' - ' || text[:500] || chr(10) || chr(10) || 'Adjusted scores (each 0-10, adjust by at most ±2 from initial):' || chr(10) || 'Skills:') AS prompt_digest FROM a JOIN documents ON doc_id = k),
 b AS (SELECT *, CASE k % 5 WHEN 1 THEN 90 WHEN 2 THEN 30 ELSE 50 END AS s1, CASE k % 5 WHEN 1 THEN 100 WHEN 2 THEN 40 ELSE requirements END AS r1, CASE k % 5 WHEN 1 THEN 0 WHEN 2 THEN experience ELSE 70 END AS e1, {_SCORE.format('')} AS own FROM a),
 c AS (SELECT *, CASE WHEN k % 5 = 0 OR own < 15 THEN skills ELSE {_NUDGE.format('skills', 's1')} END AS n_skills, CASE WHEN k % 5 = 0 OR own < 15 THEN requirements ELSE {_NUDGE.format('requirements', 'r1')} END AS n_requirements, CASE WHEN k % 5 = 0 OR own < 15 THEN experience ELSE {_NUDGE.format('experience', 'e1')} END AS n_experience FROM b),
 e AS (SELECT *, {_SCORE.format('n_')} AS after FROM c),
 f AS (SELECT k, skills AS skills0, requirements AS requirements0, own, own >= 15 AND own < 45 AND after > 50 AS capped, after, n_skills, n_requirements, n_experience, salary FROM e),
 g AS (SELECT k, skills0, requirements0, own, CASE WHEN capped THEN floor(n_skills * (50 / after::DOUBLE) + 0.5) ELSE n_skills END AS skills, CASE WHEN capped THEN floor(n_requirements * (50 / after::DOUBLE) + 0.5) ELSE n_requirements END AS requirements, CASE WHEN capped THEN floor(n_experience * (50 / after::DOUBLE) + 0.5) ELSE n_experience END AS experience, CASE WHEN capped THEN floor(salary * (50 / after::DOUBLE) + 0.5) ELSE salary END AS salary FROM f)
 SELECT k AS doc_id, skills0 AS skills, CAST(requirements0 AS INT) AS requirements, CAST(own AS INT) AS own, CAST(skills AS INT) AS t_skills, CAST(requirements AS INT) AS t_requirements, CAST(experience AS INT) AS t_experience, CAST({_SCORE.format('')} AS INT) AS score, prompt_digest FROM g JOIN p USING (k)"""
