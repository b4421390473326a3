"""A resume's text to its sections, skills, experience, titles and place, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.places import country_of
from feedloom.functions.text import trim_all

#: Headers of sections, in upper case.
HEADERS = {
    "skills": ("SKILLS", "TECHNICAL SKILLS", "CORE COMPETENCIES", "KEY SKILLS", "TECHNOLOGIES", "PROFICIENCIES", "AREAS OF EXPERTISE"),
    "experience": ("EXPERIENCE", "WORK EXPERIENCE", "PROFESSIONAL EXPERIENCE", "EMPLOYMENT HISTORY", "EMPLOYMENT", "WORK HISTORY", "EXPERIENCE & NOTABLE CONTRIBUTIONS", "EXPERIENCE AND NOTABLE CONTRIBUTIONS", "CAREER HISTORY", "RELEVANT EXPERIENCE"),
    "education": ("EDUCATION", "ACADEMIC BACKGROUND", "QUALIFICATIONS"),
    "summary": ("SUMMARY", "OBJECTIVE", "PROFESSIONAL SUMMARY", "PROFILE", "ABOUT ME"),
}
#: Words of rank, and verbs that begin a description instead of a title.
RANKS = ("lead", "senior", "staff", "principal", "vp", "head", "junior", "chief", "sr", "jr")
VERBS = "led|built|created|developed|designed|implemented|established|collaborated|served|facilitated|performed|won|leveraged|instrumented|stood|making|architected"
#: Patterns of year ranges, of a company's line and its name, of a title with a company, of a title in a
#: summary, of lines that hold no place, and of a street before a city.
YEARS = r"(\d{4})\s*[-–—]\s*(?:\w+\s+)?(\d{4}|[Pp]resent|[Cc]urrent)"
COMPANY_LINE = r"^([A-Z][A-Z\s.&',()-]+?)(?:\s*[•·|]\s*|\s{2,})[\w\s,]+(?:\t|\s{2,}).*\d{4}"
COMPANY_NAME = r"^([A-Z][A-Z\s.&',()-]+?)(?:\s*[•·|]|\t|\s{3,})"
TITLE_AT = r"(?i)^(.+?)\s+(?:at|@)\s+(.+?)$"
TITLE_COMMA = r"^([A-Z][A-Za-z\s/&-]{2,40}),\s+([A-Z][A-Za-z\s.&'-]{2,60})$"
SUMMARY_TITLE = r"(?i)(?:experienced|seasoned|senior|junior|lead|principal|staff)\s+([A-Z][a-zA-Z\s]+(?:Engineer|Developer|Designer|Manager|Analyst|Architect|Consultant))"
NO_PLACE = r"(?i)^(https?:|www\.|mailto:|[\w.-]+@|\+?\d[\d\s()-]{7,}|[A-Z]{2,}\s*[-–:])"
STREET = r"(?i)^\d+\s+[\w\s.]+(?:St|Ave|Blvd|Rd|Dr|Ln|Way|Ct|Pl|Pkwy)\b\.?\s*"
BEST_LINES, LEAST_SCORE = 7, 2


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, although lambdas in f use it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def header_of(line: Column) -> Column:
    """The section that a line begins, else null."""
    plain = F.upper(trim_all(F.regexp_replace(line, r"[:\-–—]", "")))
    chain = F.when(F.length(plain) > 60, F.lit(None))
    for name, headers in HEADERS.items():
        chain = chain.when(plain.rlike(f"^(?:{'|'.join(headers)})(?: |$)"), F.lit(name))
    return chain


def sections(text: Column) -> Column:
    """array<struct<name,lines>>: what comes before the first header is the preamble; an empty preamble and an empty
    last section are left out."""

    def cut(lines: Column, headers: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(headers, i).isNotNull())
        return let(F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines))), lambda starts: F.filter(
            F.transform(F.sequence(F.lit(0), F.size(starts) - 2), lambda j: F.struct(
                F.coalesce(F.get(headers, F.get(starts, j)), F.lit("preamble")).alias("name"),
                F.slice(lines, F.get(starts, j) + 2, F.get(starts, j + 1) - F.get(starts, j) - 1).alias("lines"),
                (j == F.size(starts) - 2).alias("last"))),
            lambda s: (F.size(s["lines"]) > 0) | ((s["name"] != "preamble") & ~s["last"])))

    found = let(F.split(text, "\n"), lambda lines: let(F.transform(lines, header_of), lambda headers: cut(lines, headers)))
    return F.transform(found, lambda s: F.struct(s["name"].alias("name"), s["lines"].alias("lines")))


def lines_of(found: Column, name: str) -> Column:
    """The lines of all sections of a name."""
    return F.flatten(F.transform(F.filter(found, lambda s: s["name"] == name), lambda s: s["lines"]))


def first_spellings(items: Column) -> Column:
    """The items without those that an earlier one equals in lower case, in order; by two sorts."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at"), x.alias("item"))))
    first = let(keyed, lambda k: F.filter(k, lambda s, i: (i == 0) | (F.get(k, i - 1)["key"] != s["key"])))
    return F.transform(F.sort_array(F.transform(first, lambda s: F.struct(s["at"].alias("at"), s["item"].alias("item")))), lambda s: s["item"])


def skills_of(lines: Column) -> Column:
    """The skills that commas, bars, semicolons, bullets and lines separate: 1 to 59 characters, first spellings."""
    parts = F.transform(F.split(F.array_join(lines, "\n"), "[,|;•●◦▪\n]"), lambda s: trim_all(F.regexp_replace(s, r"(?U)^[\s\-–—*·]+", "")))
    return first_spellings(F.filter(parts, lambda s: F.length(s).between(1, 59)))


def years_of(text: Column, year: Column) -> Column:
    """The years of a text's first range, at least 0; an open range ends in the given year; null without one."""
    end = F.regexp_extract(text, YEARS, 2)
    last = F.when(F.lower(end).isin("present", "current"), year).otherwise(end.try_cast("int"))
    return F.when(F.regexp_like(text, F.lit(YEARS)), F.greatest(F.lit(0), last - F.regexp_extract(text, YEARS, 1).try_cast("int")))


def total_years(experience: Column) -> Column:
    """The sum of all entries' years; unknown ones count as 0."""
    return F.aggregate(experience, F.lit(0), lambda s, x: s + F.coalesce(x["years"], F.lit(0)))


def title_score(line: Column) -> Column:
    """How much a line looks like a title: two to eight words, capitals, a rank; not a verb first nor a full stop last."""
    trimmed = trim_all(line)

    def of(words: Column) -> Column:
        long = F.filter(words, lambda w: F.length(w) >= 3)
        share = F.size(F.filter(long, lambda w: w.rlike("^[A-Z]"))) / F.nullif(F.size(long), F.lit(0))
        rank = F.exists(words, lambda w: F.lower(w).isin(list(RANKS)))
        return F.when(F.size(words).between(2, 8), 1).otherwise(0) + F.when(share >= 1, 2).when(share >= 0.5, 1).otherwise(0) + F.when(rank, 1).otherwise(0)

    fines = F.when(trimmed.rlike(f"(?i)^(?:{VERBS})"), 3).otherwise(0) + F.when(F.endswith(trimmed, F.lit(".")), 1).otherwise(0)
    return F.when(F.length(line).between(5, 80), let(F.split(trimmed, r"\s+"), of) - fines).otherwise(0)


def best_title(lines: Column) -> Column:
    """The first of the lines with the highest title score of at least two, else null."""
    return let(F.transform(lines, lambda x: F.struct(title_score(x).alias("score"), trim_all(x).alias("line"))), lambda scored: let(
        F.array_max(F.transform(scored, lambda s: s["score"])), lambda most: F.when(most >= LEAST_SCORE, F.get(F.filter(scored, lambda s: s["score"] == most), F.lit(0))["line"])))


def _company(line: Column) -> Column:
    named = F.regexp_extract(line, COMPANY_NAME, 1)
    plain = F.when(F.regexp_like(line, F.lit(COMPANY_NAME)), named).otherwise(F.get(F.split(line, "\t"), F.lit(0)))
    return trim_all(F.regexp_replace(plain, r"[.\s]+$", ""))


def _entry(title: Column, company: Column, years: Column) -> Column:
    return F.struct(title.alias("title"), company.alias("company"), years.cast("int").alias("years"))


def _by_company(lines: Column, year: Column) -> Column:
    """An entry for each company's line with a year range, titled by the best of the lines up to the next."""
    heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(COMPANY_LINE) & F.get(lines, i).rlike(YEARS))

    def entries(at: Column) -> Column:
        below = lambda j: F.slice(lines, F.get(at, j) + 2, F.least(F.lit(BEST_LINES), F.coalesce(F.get(at, j + 1), F.size(lines)) - F.get(at, j) - 1))
        return F.filter(F.transform(at, lambda i, j: _entry(best_title(below(j)), _company(F.get(lines, i)), years_of(F.get(lines, i), year))), lambda x: x["title"].isNotNull())

    return F.when(F.size(lines) > 0, let(heads, lambda at: F.when(F.size(at) > 0, entries(at))))


def _by_block(lines: Column, year: Column) -> Column:
    """An entry for each block between empty lines: 'title at company', 'Title, Company', or two lines with years."""

    def entry(block: Column) -> Column:
        rows = F.filter(F.transform(F.split(block, "\n"), trim_all), lambda x: x != "")

        def of(own: Column) -> Column:
            first, second, years = F.get(own, F.lit(0)), F.get(own, F.lit(1)), years_of(block, year)
            named = lambda p: _entry(trim_all(F.regexp_extract(first, p, 1)), trim_all(F.regexp_extract(first, p, 2)), years)
            below = trim_all(F.regexp_replace(F.regexp_replace(second, f"^(.*?){YEARS}", "$1"), r"[,|]+$", ""))
            return F.when(first.rlike(TITLE_AT), named(TITLE_AT)).when(first.rlike(TITLE_COMMA), named(TITLE_COMMA)).when((F.size(own) >= 2) & years.isNotNull(), _entry(first, F.when(below == "", "Unknown").otherwise(below), years))

        return let(rows, of)

    blocks = F.filter(F.split(F.array_join(lines, "\n"), r"\n\s*\n"), lambda b: trim_all(b) != "")
    return F.filter(F.transform(blocks, entry), lambda x: x.isNotNull())


def experience_of(lines: Column, year: Column) -> Column:
    """array<struct<title,company,years>> of a section: by companies' lines if there are any, else by blocks."""
    return let(lines, lambda own: F.coalesce(let(F.filter(own, lambda x: trim_all(x) != ""), lambda full: _by_company(full, year)), _by_block(own, year)))


def place_of(lines: Column) -> Column:
    """'City, Region' of the first line whose segments, from the right, name a known place; null if none does."""

    def of_line(line: Column) -> Column:
        trimmed = trim_all(line)
        parts = F.filter(F.transform(F.split(trimmed, ","), trim_all), lambda p: p != "")

        def at(own: Column) -> Column:
            def of(i: Column) -> Column:
                plain = trim_all(F.regexp_replace(F.get(own, i), r"\s+\d{4,6}(-\d{4})?$", ""))
                before = F.get(own, i - 1)
                city = trim_all(F.regexp_replace(before, STREET, ""))
                whole = F.when((i >= 2) & (F.length(before) <= 3), F.concat_ws(", ", F.get(own, i - 2), before, plain)).otherwise(F.concat_ws(", ", city, plain))
                return F.when((plain != "") & (country_of(plain) != "Unknown") & (F.length(city) >= 2), whole)

            found = F.filter(F.transform(F.reverse(F.sequence(F.lit(1), F.size(own) - 1)), of), lambda x: x.isNotNull())
            return F.when(F.size(own) >= 2, F.get(found, F.lit(0)))

        return F.when((trimmed != "") & (F.length(trimmed) <= 200) & ~trimmed.rlike(NO_PLACE), let(parts, at))

    return F.get(F.filter(F.transform(lines, of_line), lambda x: x.isNotNull()), F.lit(0))


def titles_of(experience: Column, summaries: Column) -> Column:
    """The titles of the experience, then those that summaries (arrays of lines) name, each once."""
    said = F.flatten(F.transform(summaries, lambda s: F.transform(F.regexp_extract_all(F.array_join(s["lines"], " "), F.lit(SUMMARY_TITLE), F.lit(0)), trim_all)))
    return F.array_distinct(F.concat(F.transform(experience, lambda x: x["title"]), said))


def parse_resume(text: Column, year: Column) -> Column:
    """struct<skills,experience,jobTitles,location>; a text without anything gives empty arrays. year ends open ranges."""

    def of(found: Column) -> Column:
        each = lambda name, f: F.flatten(F.transform(F.filter(found, lambda s: s["name"] == name), lambda s: f(s["lines"])))
        return let(each("experience", lambda x: experience_of(x, year)), lambda experience: F.struct(
            each("skills", skills_of).alias("skills"), experience.alias("experience"), titles_of(experience, F.filter(found, lambda s: s["name"] == "summary")).alias("jobTitles"), place_of(lines_of(found, "preamble")).alias("location")))

    return let(sections(F.coalesce(text, F.lit(""))), of)


def search_preferences(titles: Column, locations: Column, resume: Column) -> Column:
    """struct<titles,locations>: those wanted, else the resume's first title of three characters or more, and its place."""
    none = F.array().cast("array<string>")
    first, place = trim_all(F.get(resume["jobTitles"], F.lit(0))), F.nullif(resume["location"], F.lit(""))
    wanted = lambda own, derived: F.when(F.size(F.coalesce(own, none)) > 0, own).when(derived.isNotNull(), F.array(derived)).otherwise(none)
    return F.struct(wanted(titles, F.when(F.length(first) >= 3, first)).alias("titles"), wanted(locations, place).alias("locations"))
