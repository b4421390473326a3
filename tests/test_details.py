import datetime
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from feedloom.functions import money, places, scores, titles
from feedloom.functions import text as X
from feedloom.operators import enrichment, merging, neighbours


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("title", "want"),
    [("Acme is hiring Dev", ("Dev", "Acme")), ("Proxify Ab: Senior Dev", ("Senior Dev", "Proxify Ab")), ("Location: Here at Foo", ("Location: Here", "Foo")), ("Dev @ Acme", ("Dev", "Acme")), ("Dev - Acme Inc", ("Dev", "Acme Inc")), ("Dev - Senior", ("Dev - Senior", "Unknown")), ("Dev | Acme", ("Dev", "Acme")), ("Dev", ("Dev", "Unknown")), ("", ("", "Unknown"))],
)
def test_feed_titles(spark, title, want):
    assert tuple(value(spark, titles.split_feed_title(F.lit(title))))[:2] == want


@pytest.mark.parametrize(("title", "want"), [("Acme hiring Dev in NY, NY | LinkedIn", ("Dev", "Acme", "NY, NY")), ("Acme hiring Dev - Indeed", ("Dev", "Acme", None)), ("Dev - Jobs - Careers at Apple", ("Dev", "Apple", None)), ("Dev - Acme | Glassdoor", ("Dev", "Acme", None))])
def test_search_titles(spark, title, want):
    assert tuple(value(spark, titles.split_search_title(F.lit(title)))) == want


def test_entities(spark):
    assert value(spark, X.decode_entities(F.lit("a &#8212; b &#x41; &amp;#39; &#039; &lt;&nbsp;&#55357; &#; &#x;"))) == "a — b A ' ' < � &#; &#x;"
    assert value(spark, X.strip_html_lines(F.lit("<p>Hi<br>x</p><ul><li>a&nbsp;b</li></ul><b>c</b>"))) == "Hi\nx\n\na b\n\nc"
    assert value(spark, X.decode_entities(F.lit(None).cast("string"))) is None


def test_places(spark):
    got = [value(spark, c) for c in (places.place_in_text(F.lit("We are based in San Jose, CA today")), places.place_in_snippet(F.lit("job in San Mateo, CA 10001")), places.place_in_snippet(F.lit("in Paris, FR")), places.place_in_slug(F.lit("https://linkedin.com/jobs/view/dev-boise-id-12345/")), places.broadened(F.lit("Reston, VA")), places.broadened(F.lit("Paris, France")), places.normal_place(F.lit(" nyc ")))]
    assert got == ["San Jose, CA", "San Mateo, CA", None, "Boise, ID", "Washington DC", "Paris", "New York, NY"]


def test_salary_texts(spark):
    got = [value(spark, c) for c in (money.snippet_salary(F.lit("$32.50 an hour")), money.snippet_salary(F.lit("$120k - $150k")), money.labelled_range(F.lit("Salary range: $120k - $150k")), money.parse_salary(F.lit("Competitive. $120k")), money.parse_salary(F.lit("120-150k")), money.parse_salary(F.lit("")))]
    assert [None if x is None else tuple(x) for x in got] == [(67600.0, None), (120000.0, 150000.0), (120.0, 150.0), None, (120.0, 150000.0), None]


@pytest.mark.parametrize(("low", "high", "want"), [(None, None, (50, "not posted")), (0.0, 0.0, (50, "not posted")), (90.0, 110.0, (100, "in range")), (125.0, None, (60, "target below")), (None, 80.0, (60, "target above")), (300.0, None, (0, "target below"))])
def test_salary_axis(spark, low, high, want):
    assert tuple(value(spark, money.salary_axis(F.lit(100.0), F.lit(low).cast("double"), F.lit(high).cast("double")))) == want


def test_profiles_and_styles(spark):
    p = value(spark, scores.profile_of(F.lit('so: {"title": "Dev", "yearsExperience": "-7", "hardSkills": ["a", ""]} end')))
    assert (p.title, p.domain, p.yearsExperience, p.hardSkills, p.softSkills) == ("Dev", "", 0.0, ["a"], [])
    assert [value(spark, scores.profile_of(F.lit(x))) for x in ("none", "{bad}")] == [None, None]
    styles = [(True, "Berlin"), (True, "remote"), (False, "Berlin (Hybrid)"), (False, "hybrid"), (False, "Oslo"), (None, None)]
    assert [value(spark, scores.work_style(F.lit(r).cast("boolean"), F.lit(p).cast("string"))) for r, p in styles] == ["Remote · Berlin", "Remote", "Hybrid · Berlin", "Hybrid", "Oslo", "On-site"]


def test_benefits_condensed(spark):
    got = value(spark, X.condensed_benefits(F.array(*map(F.lit, ["401k match", "Dental", "vision plan", "snacks"]))))
    assert [(x.category, x.originals) for x in got] == [("401k", ["401k match"]), ("Health", ["Dental", "vision plan"])]


def test_benefits_section(spark):
    html = "<h2>Our Benefits</h2><ul><li>Health insurance plan</li><li>401k</li><li>Unlimited PTO days</li></ul><h3>About Us Here</h3><p>We are a firm</p>"
    assert value(spark, X.benefits_section(F.lit(html), F.lit(""))) == ["Health insurance plan", "Unlimited PTO days"]
    assert value(spark, X.benefits_section(F.lit(""), F.lit("Perks\nLOTS OF THEM\nfree food daily"))) is None
    assert value(spark, X.benefits_section(F.lit(None).cast("string"), F.lit("nothing to see here"))) is None


def plain_benefits(text):
    """The items of benefit_lines, line by line."""
    lines = [x for line in text.split("\n") if (x := re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", "- " + line)).strip())]
    items = []
    for line in lines:
        if len(line) < 60 and re.fullmatch(r"[A-Z][A-Z\s]{3,}", line):
            break
        item = re.sub(r"^[\s\-–—*•●◦▪·]+", "", line).strip()
        if 5 <= len(item) < 200:
            items.append(item)
    return items or None


def test_benefit_lines_of_all_documents(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r["items"] for r in entry.queries()["benefit_lines"](spark, sf).collect()}
    tame = [d for d, t in text.items() if t and not re.search(r"<|javascript:|on\w+\s*=", t, re.I)]
    assert len(tame) > len(text) * 0.8 and len(got) == len(text)
    assert [(d, got[d]) for d in tame if got[d] != plain_benefits(text[d])] == []


def test_benefits_section_computes_a_step_once(spark, sf):
    """A step that a lambda names anew is run again for each line, so time grew with the square of a text's lines."""
    plan = entry.queries()["benefit_lines"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("javascript:") == 1 and plan.count("what we offer") == 1
    rows = [["Perks", "ab", "Free Lunch", *["- something good"] * 3, "Next Title Here", "- not this"], ["Perks", "Title", "TEAM", "- not this"], ["Perks", *["- something good"] * 500], ["Perks", "ab", "CAPS", "- not this"], ["No header", "- not this"]]
    got = [r.x for r in spark.createDataFrame([("\n".join(r),) for r in rows], "t string").select(X.benefits_section(F.lit(""), F.col("t")).alias("x")).collect()]
    assert got == [["Free Lunch", *["something good"] * 3], ["Title"], ["something good"] * 500, None, None]


def plain_description(html):
    """By depth of open divs, then the meta description, then the largest section."""
    if m := re.search(r'class="show-more-less-html__markup[^"]*"[^>]*>', html, re.I):
        depth = 1
        for tag in re.finditer("<div|</div>", html[m.end() :]):
            depth += 1 if tag[0] == "<div" else -1
            if depth == 0:
                return html[m.end() : m.end() + tag.start()].strip()
    if (m := re.search(r'<meta\s+name="description"\s+content="([^"]*?)"\s*/?>', html, re.I)) and len(m[1].strip()) > 50:
        return m[1].strip()
    return max((s.strip() for s in re.findall(r"(?is)<section[^>]*>(.*?)</section>", html)), key=len, default="") or None


def test_page_description(spark, sf):
    pages = [
        '<div class="show-more-less-html__markup x"><div>a<div>b</div></div> c </div><div>d</div>',
        '<div class="show-more-less-html__markup"><div>never closed',
        f'<meta name="description" content="{"m" * 51}"/><section>{"s" * 200}</section>',
        f"<section>{'a' * 101}</section><section class='x'>{'b' * 101}</section>",
    ]
    got = [r.d for r in spark.createDataFrame([(p,) for p in pages], "h string").select(enrichment.page_description(F.col("h")).alias("d")).collect()]
    assert got == ["<div>a<div>b</div></div> c", None, "m" * 51, "a" * 101] == [plain_description(p) for p in pages]
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html", enrichment.page_description(F.col("html")).alias("d")).collect()
    want = [plain_description(r.html) for r in rows]
    assert [r.d for r in rows] == [w if w is None or len(w) > 50 else None for w in want]
    assert entry.queries()["page_descriptions"](spark, sf).count() == len(rows)


def test_details_from_snippets(spark):
    good = "Acme seeks a senior developer with many years of practice in large systems, paying $120k - $150k a year. "
    rows = [(1, 1, "Developer", "Acme Inc", good + "x" * 120), (1, 2, "Developer", "Acme Inc", good.upper() + "y" * 90), (1, 3, "Developer", "Acme Inc", "Sign in to view Acme developer jobs and many more"), (1, 11, "Developer", "Acme Inc", "Acme developer " + "z" * 200), (2, 1, "Developer", "Acme Inc", good[:60])]
    (r,) = enrichment.details_of(spark.createDataFrame(rows, "id long, rank int, title string, company string, content string")).collect()
    assert (r.id, r.salary_min, r.salary_max, r.description_text) == (1, 120000.0, 150000.0, good + "x" * 120)
    assert r.description_html == f"<p>{good + 'x' * 120}</p>"


def test_enrichment_round(spark):
    now = datetime.datetime(2024, 2, 1)
    cols = "id long, title string, company string, description_text string, description_html string, salary_min double, salary_max double, match_score int, partial boolean, enrichment_attempted_at timestamp"
    jobs = spark.createDataFrame([(1, "T", None, None, None, 0.0, 9.0, None, True, None), (2, "T", None, "old", None, None, None, 3, True, None), (3, "", None, None, None, None, None, 3, True, None), (4, "T", None, None, None, None, None, 3, True, now), (5, "T", None, None, None, None, None, 3, None, None)], cols)
    details = spark.createDataFrame([(i, "new", "<p>", 5.0, 6.0) for i in (1, 3, 4, 5)], "id long, description_text string, description_html string, salary_min double, salary_max double")
    scored = spark.createDataFrame([(1, 80), (2, 90)], "id long, match_score int")
    got = {r.id: (r.description_text, r.salary_min, r.salary_max, r.match_score, r.partial, r.enrichment_attempted_at) for r in jobs.transform(enrichment.enriched(details, scored, F.lit(now))).collect()}
    assert got == {1: ("new", 5.0, 9.0, 80, False, now), 2: ("old", None, None, 3, False, now), 3: (None, None, None, 3, True, now), 4: (None, None, None, 3, True, now), 5: (None, None, None, 3, None, None)}


def test_refreshed(spark):
    cols = "source_name string, external_id string, salary_min double, location string, closed_at string, match_score int"
    stored = spark.createDataFrame([("s", "1", None, "Rome", "2024", None), ("s", "2", 1.0, None, "2024", 5)], cols)
    new = spark.createDataFrame([("s", "1", None, "Oslo", 1), ("s", "1", 7.0, "Bern", 2), ("s", "1", 8.0, None, 3), (None, "2", 9.0, "Oslo", 4)], "source_name string, external_id string, salary_min double, location string, position int")
    got = {r.external_id: tuple(r)[2:] for r in merging.refreshed(stored, new, "position", columns=["salary_min", "location"]).collect()}
    assert got == {"1": (7.0, "Rome", None, None, True), "2": (1.0, None, "2024", 5, False)}


def test_neighbours_in_small_blocks(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(neighbours.within(rows.filter("vec_id % 50 = 0"), rows, 0.8))
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    monkeypatch.setattr(neighbours, "ROWS", 70)
    assert key(neighbours.within(rows.filter("vec_id % 50 = 0"), rows, 0.8)) == whole and whole
