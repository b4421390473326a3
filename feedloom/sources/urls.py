"""Which addresses of search results are pages of one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pages of one job.
JOB_PAGES = (
    r"linkedin\.com/jobs/view/", r"indeed\.com/(?:viewjob|rc/clk)", r"glassdoor\.com/job-listing/", r"ziprecruiter\.com/c/", r"jobs\.\w+\.com/.+/details/",
    r"(?i:/careers?/.*/(?:job|position))", r"/careers?/.*\d{4,}", r"(?i:careers\.\w+\.com/.*/job/)", r"builtin\w*\.com/job/", r"lever\.co/.+/", r"greenhouse\.io/.*job",
    r"myworkdayjobs\.com/", r"wellfound\.com/jobs/\d", r"remotive\.com/remote/jobs/.+/.+", r"snagajob\.com/jobs/\d", r"monster\.com/job-openings/", r"devitjobs\.com/jobs/",
    r"remotefront\.com/remote-jobs/.+-", r"dice\.com/job-detail/", r"jobgether\.com/offer/", r"/jobs/\d{5,}", r"(?i:/job/[a-z0-9-]{8,})",
)
#: Pages of searches.
SEARCH_PAGES = (
    r"glassdoor\.com/Job/", r"ziprecruiter\.com/Jobs/", r"indeed\.com/q-", r"indeed\.com/jobs\?", r"jobs\.apple\.com/.*search", r"careers\.google\.com/jobs/results/",
    r"explore\.jobs\.netflix\.net/careers\?query", r"remotive\.com/remote-jobs/[a-z-]+$",
)
#: Sites and parts of sites without jobs.
NOISE_PAGES = (
    r"\.(?:edu|gov)/", r"reddit\.com", r"quora\.com", r"stackoverflow\.com", r"medium\.com", r"geeksforgeeks\.org", r"softwaretestinghelp\.com", r"testguild\.com", r"wikipedia\.org",
    r"guru99\.com", r"techtarget\.com", r"climbtheladder\.com", r"apidog\.com", r"marutitech\.com", r"testmuai\.com", r"syntaxtechs\.com", r"dailyremote\.com", r"remoterocketship\.com",
    r"qatestingjobs\.com", r"corptocorp\.org", r"h30434\.www3\.hp\.com", r"\.qa\.com", r"platform\.qa\.com", r"azure\.microsoft\.com", r"atlassian\.com/(?:devops|solutions)",
    r"ibm\.com/think", r"aws\.amazon\.com/devops", r"cloud\.google\.com/devops", r"github\.com/resources", r"builtin\.com/articles/", r"edtech\.com/jobs", r"ycombinator\.com/jobs/role",
    r"virtualvocations\.com", r"thrivas\.com", r"usnlx\.com", r"belmontforum\.org", r"britannica\.com", r"merriam-webster\.com", r"cambridge\.org/dictionary", r"collinsdictionary\.com",
    r"oxfordlearnersdictionaries\.com", r"computerhope\.com", r"newworldencyclopedia\.org", r"english\.stackexchange\.com", r"randstadusa\.com", r"roberthalf\.com", r"upwork\.com",
    r"jobtoday\.com", r"testdevjobs\.com", r"producthunt\.com", r"hestiya\.com", r"sooperkanoon\.com", r"casemine\.com", r"usaswimming\.org", r"theiacp\.org", r"dynamitejobs\.com",
    r"arc\.dev", r"deeprec\.ai",
)


def is_job_page(url: Column) -> Column:
    """Whether an address is that of one job: not noise, not a search, and like a known job page."""
    return ~url.rlike("|".join(NOISE_PAGES)) & ~url.rlike("|".join(SEARCH_PAGES)) & url.rlike("|".join(JOB_PAGES))


def encoded(c: Column) -> Column:
    """A text as one component of an address: letters, digits and -_.!~*'() stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def rsshub_feed(query: Column, base: Column, geo: Column | None = None, job_types: str = "all", levels: str = "all") -> Column:
    """The address of a feed of a job search; null for a blank query."""
    text = F.nullif(F.trim(query), F.lit(""))
    url = F.concat(F.regexp_replace(base, r"/+$", ""), F.lit(f"/linkedin/jobs/{job_types}/{levels}/"), encoded(text))
    return url if geo is None else F.concat(url, F.coalesce(F.concat(F.lit("?geoId="), encoded(F.nullif(geo, F.lit("")))), F.lit("")))


def search_feeds(query: Column, routes: dict[str, Callable[[Column], Column]]) -> Column:
    """map<name,address> of the routes (name to a function of the query) that give one."""
    entries = F.array(*(F.struct(F.lit(n).alias("key"), f(query).alias("value")) for n, f in routes.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
