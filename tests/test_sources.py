import json

import pytest
from pyspark.sql import functions as F

from feedloom.functions import money, similarity
from feedloom.functions import text as X
from feedloom.sources import payloads as P
from feedloom.streaming import ingest


def rows(spark, parser, payload):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return [r.asDict() for r in parser(spark.createDataFrame([(text,)], "payload string")).collect()]


def test_remoteok_skips_the_notice(spark):
    got = rows(spark, P.remoteok(), [{"legal": "x"}, {"id": "7", "position": "Nurse", "company": "Acme", "description": "<p>Care&nbsp;well</p>", "location": "", "url": "https://a.example/7", "salary_min": 5}])
    assert [(r["external_id"], r["description_text"], r["location"], r["is_remote"], r["salary_min"]) for r in got] == [("remoteok-7", "Care well", "", None, 5.0)]


def test_jobicy_remote_rule(spark):
    jobs = [{"id": i, "url": "https://j.example/1", "jobTitle": "T", "companyName": "C", "jobGeo": g, "jobExcerpt": "short"} for i, g in enumerate(["Anywhere", "USA", None])]
    assert [(r["is_remote"], r["description_text"]) for r in rows(spark, P.jobicy(), {"jobs": jobs})] == [(True, "short"), (False, "short"), (None, "short")]


def test_himalayas_salary_text_only_without_numbers(spark):
    jobs = [{"id": "1", "guid": "g", "title": "T", "salary": "$120k-$150k"}, {"id": "2", "title": "T", "maxSalary": 9, "salary": "$1 - $2"}]
    assert [(r["external_id"], r["salary_min"], r["salary_max"]) for r in rows(spark, P.himalayas(), {"jobs": jobs})] == [("himalayas-g", 120000.0, 150000.0), ("himalayas-2", None, 9.0)]


def test_boards(spark):
    got = rows(spark, P.greenhouse("s", "S"), {"jobs": [{"id": 1, "title": "T", "content": "Salary: $120k - $150k", "absolute_url": "https://g.example", "offices": [{"name": "Berlin"}]}]})[0]
    assert (got["external_id"], got["salary_min"], got["location"]) == ("gh-s-1", 120.0, "Berlin")
    got = rows(spark, P.lever("s", "S"), [{"id": "1", "text": "T", "description": "a", "additional": "b", "workplaceType": "remote", "salaryRange": {"min": 1, "max": 2}}])[0]
    assert (got["description_text"], got["is_remote"], got["salary_max"]) == ("a b", True, 2.0)
    got = rows(spark, P.ashby("s", "S"), {"jobs": [{"id": "1", "title": "T", "compensationTierSummary": "$100K – 150"}]})[0]
    assert (got["salary_min"], got["salary_max"]) == (100000.0, 150000.0)
    got = rows(spark, P.smartrecruiters("s", "S"), {"content": [{"id": "1", "uuid": "u", "name": "T", "location": {"city": "Bonn", "country": "de"}}]})[0]
    assert (got["location"], got["description_text"], got["external_id"], got["source_url"]) == ("Bonn, de", "T", "sr-s-u", "https://jobs.smartrecruiters.com/s/1")
    got = rows(spark, P.themuse(), {"results": [{"id": 5, "name": "T", "company": {"name": "C"}, "locations": [{"name": "Rome"}, {"name": "Flexible / Remote"}]}]})[0]
    assert (got["source_url"], got["is_remote"]) == ("https://www.themuse.com/jobs/5", True)
    got = rows(spark, P.serply(), {"jobs": [{"job_id": "1", "title": "T", "snippet": "s", "detected_extensions": {"salary": "Competitive"}}]})[0]
    assert (got["description_text"], got["salary_min"]) == ("s", None)


def test_rss(spark):
    xml = '<rss><channel><item><title>Dev at Acme</title><link>https://x.example/1</link><guid isPermaLink="false">g1</guid><description>Located in Austin, TX. Pay $100k - $120k</description></item><item><title>No link</title></item></channel></rss>'
    got = rows(spark, P.rss(), xml)
    assert [(r["title"], r["company"], r["location"], r["salary_min"], r["is_remote"], len(r["external_id"])) for r in got] == [("Dev", "Acme", "Austin, TX", 100000.0, False, 24)]


def test_atom(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">Acme is hiring Dev</title><link href="https://x.example/1"/><id>i1</id><summary>work from home</summary></entry><entry><title>Nurse at Care</title><link>https://x.example/2</link><id>i2</id><content type="html">remote</content></entry><entry><title>No link</title></entry></feed>'
    assert [(r["title"], r["company"], r["source_url"], r["description_text"], r["is_remote"]) for r in rows(spark, P.atom(), xml)] == [("Dev", "Acme", "https://x.example/1", "work from home", False), ("Nurse", "Care", "https://x.example/2", "remote", True)]


def test_web_search_keeps_the_first(spark):
    first = {"results": [{"title": "Acme hiring Dev in Rome | LinkedIn", "url": "https://www.linkedin.com/jobs/view/dev-123456", "content": "x"}, {"title": "S", "url": "https://www.indeed.com/jobs?q=1", "content": "x"}, {"title": "Noise", "url": "https://www.reddit.com/jobs/123456", "content": "x"}]}
    second = {"results": [{"title": "Other", "url": "https://www.linkedin.com/jobs/view/other-123456", "content": "y"}, {"title": "Nurse - Care Inc", "url": "https://careers.care.example/jobs/99999", "content": "in Boise, ID 83701"}]}
    df = spark.createDataFrame([(1, json.dumps(first)), (2, json.dumps(second))], "page int, payload string")
    assert sorted((r["title"], r["company"], r["location"], r["source_name"]) for r in P.web_search()(df).collect()) == [("Dev", "Acme", "Rome", "linkedin"), ("Nurse", "Care Inc", "Boise, ID", "care")]


def test_broken_payload_gives_no_rows(spark):
    assert rows(spark, P.jobicy(), "{not json") == []
    assert P.parse_failures(spark.createDataFrame([("{not",), ("{}",)], "payload string")).first().failed == 1


def test_validity_and_normalising(spark):
    base = dict.fromkeys(P.FIELDS) | {"source_name": "s", "external_id": "1", "title": "  senior\tDEV ", "company": "A", "source_url": "https://x.example", "description_text": "<b>hi</b>", "salary_min": 500001.0, "salary_max": 1000000.0, "location": "Remote, US"}
    bad = base | {"external_id": "2", "location": ""}
    schema = ", ".join(f"{f} {'double' if f in P.NUMBERS else 'boolean' if f == 'is_remote' else 'string'}" for f in P.FIELDS)
    df = spark.createDataFrame([tuple(r[f] for f in P.FIELDS) for r in (base, bad)], schema)
    (r,) = P.normalized(df).collect()
    assert (r.title, r.description_text, r.salary_min, r.salary_max, r.is_remote) == ("Senior\tDev", "hi", None, 1000000.0, True)


@pytest.mark.parametrize(("a", "b", "want"), [("google", "google llc", 0.92), ("abcx", "abyz", 0.7333), ("", "", 1), ("", "a", 0), ("a", "b", 0)])
def test_jaro_winkler(a, b, want):
    assert similarity.jaro_winkler_pair(a, b) == pytest.approx(want, abs=5e-4)


def test_salary_overlap(spark):
    got = spark.range(1).select(money.overlap(F.lit(100.0), F.lit(150.0), F.lit(120.0), F.lit(180.0)).alias("x")).first().x
    assert got == pytest.approx(0.375)


def test_title_case_and_url_id(spark):
    r = spark.range(1).select(X.title_case(F.lit("hELLO wORLD/x")).alias("t"), X.url_id(F.lit("https://www.linkedin.com/jobs/view/dev-at-acme-12345?x=1")).alias("u")).first()
    assert (r.t, r.u) == ("Hello World/x", "searxng-li-12345")


def test_stream_adds_each_listing_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"jobs": [{"id": 1, "url": "https://j.example/1", "jobTitle": "T", "companyName": "C", "jobExcerpt": "e"}] * 2}))
    args = (P.jobicy(), str(tmp_path / "store"), str(tmp_path / "cp"))
    ingest.ingest(ingest.payload_files(spark, str(tmp_path / "in")), *args).awaitTermination()
    (tmp_path / "in/b.json").write_text(json.dumps({"jobs": [{"id": i, "url": "https://j.example/1", "jobTitle": "T", "companyName": "C", "jobExcerpt": "e"} for i in (1, 2)]}))
    ingest.ingest(ingest.payload_files(spark, str(tmp_path / "in")), *args).awaitTermination()
    assert sorted(r.external_id for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["jobicy-1", "jobicy-2"]


@pytest.mark.parametrize(("text", "want"), [("Berlin, Germany", "DE"), ("Berlin, DE", "US"), ("Austin, TX", "US"), ("Remote", "US"), ("Remote - EMEA", "INTL"), ("Greater San Francisco Area", "Unknown"), ("Greater Mexico City", "MX"), ("APAC-C1", "INTL"), ("São Paulo", "BR"), ("Nowhere", "Unknown"), ("", "Unknown"), (None, "Unknown"), ("Paris; Remote", "FR")])
def test_country(spark, text, want):
    from feedloom.functions import places

    df = spark.createDataFrame([(text,)], "l string")
    assert df.select(places.country_of(F.col("l")).alias("c")).first().c == want


def test_company_facts(spark):
    from feedloom.functions import companies

    text = "Acme is a leading health care/pharma company. Total funding of $863M over 6 rounds. Rated 4.2 out of 5. 1,000-5,000 employees. Revenue grew from $10M to $20M. It launched a new line of products today."
    series, public = "Series C funding round of $40 million", "listed on the NYSE; 300 people work here"
    r = spark.createDataFrame([(text,), (series,), (public,), ("nothing",)], "t string").select(companies.facts(F.col("t")).alias("f")).collect()
    assert tuple(r[0].f) == ("4.2 / 5.0", "1,000-5,000 employees", "$863M (6 rounds)", "$10M to $20M", "launched a new line of products today", "Health Care/Pharma")
    assert (r[1].f.funding, r[2].f.funding, r[2].f.size) == ("Series C ($40M)", "Public", "300 employees")
    assert set(r[3].f.asDict().values()) == {"Unknown"}
