"""Text, hash and HTML expressions. All are Column to Column and stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters of Unicode's white space.
_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, although lambdas in f use it for each element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fingerprint(title: Column, company: Column, location: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the lower-cased letters and digits (ASCII) of all three."""
    joined = F.concat(*(F.coalesce(c, F.lit("")) for c in (title, company, location)))
    return F.substring(F.sha2(F.regexp_replace(F.lower(joined), "[^a-z0-9]", ""), 256), 1, 16)


def title_case(c: Column, after: str = r"\s") -> Column:
    """Lower case, with an upper-case first character at the start and after white space (or what `after` names)."""
    marked = F.split(F.regexp_replace(F.lower(c), f"({after})", "$1\u0000"), "\u0000")
    return F.array_join(F.transform(marked, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def sanitize_html(c: Column) -> Column:
    """Without script elements, event attributes and javascript: addresses, by four fixed patterns."""
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script>", "")
    c = F.regexp_replace(c, r"""(?i)on\w+\s*=\s*["'][^"']*["']""", "")
    c = F.regexp_replace(c, r"(?i)on\w+\s*=\s*\S+", "")
    return F.regexp_replace(c, r"(?i)javascript:", "")


def sanitize_text(c: Column) -> Column:
    """Sanitised, tags to spaces, white space collapsed; entities stay."""
    return collapse(F.regexp_replace(sanitize_html(c), r"<[^>]*>", " "))


def sanitize_lines(c: Column) -> Column:
    """Sanitised text that keeps line structure: breaks and block ends to line feeds, list items to dashes."""
    c = F.regexp_replace(sanitize_html(c), r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6])>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<li[^>]*>", "- "), r"<[^>]*>", " ")
    c = F.regexp_replace(c, r"(?U)[^\S\n]+", " ")
    return trim_all(F.regexp_replace(c, r"\n\s*\n", "\n"))


def strip_html(c: Column) -> Column:
    """Tags to spaces, four common entities decoded (&lt; and &gt; stay), white space collapsed."""
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return collapse(c)


def _from_codes(c: Column, pattern: str, base: int) -> Column:
    """Numeric entities of UTF-16 code units to characters; halves of surrogate pairs become U+FFFD."""
    pieces = F.split(c, f"(?={pattern})|(?<={pattern})")

    def plain(piece: Column) -> Column:
        digits = F.regexp_extract(piece, f"^{pattern}$", 1)
        unit = F.conv(digits, base, 10).cast("bigint").bitwiseAND(F.lit(0xFFFF))
        shown = F.when(unit.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(unit), 4, "0")), "UTF-16BE"))
        return F.when(digits != "", shown).otherwise(piece)

    return F.array_join(F.transform(pieces, plain), "")


def decode_entities(c: Column, hexadecimal: bool = True) -> Column:
    """Named entities of markup, then decimal and hexadecimal ones of up to seven digits."""
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    c = _from_codes(c, r"&#([0-9]{1,7});", 10)
    return _from_codes(c, r"&#x([0-9a-fA-F]{1,7});", 16) if hexadecimal else c


def strip_html_lines(c: Column) -> Column:
    """Block tags to line feeds, other tags to nothing, entities decoded, at most one empty line between lines; the tags'
    names are fixed values."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[1-6])[^>]*>", "\n")
    c = decode_entities(F.regexp_replace(c, r"<[^>]+>", ""))
    return trim_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def escape_html(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def infer_remote(location: Column) -> Column:
    """Whether a location says remote; null for none."""
    return F.when(F.length(location) > 0, F.contains(F.lower(location), F.lit("remote")))


def normalize_company(c: Column) -> Column:
    return F.lower(collapse(c))


def skill_matches(text: Column, skills: Column) -> Column:
    """The skills (an array) that a text names: those with special characters as case-blind substrings, others as whole
    words, case-sensitive if of three characters or fewer."""

    def named(skill: Column) -> Column:
        s = trim_all(skill)
        special = F.regexp_like(F.lower(s), F.lit(r"[^a-z0-9\s]"))
        word = F.concat(F.lit(r"(?<![A-Za-z0-9_])"), s, F.lit(r"(?![A-Za-z0-9_])"))
        return F.when(s == "", False).when(special, F.contains(F.lower(text), F.lower(s))).when(F.length(s) <= 3, F.regexp_like(text, word)).otherwise(F.regexp_like(text, F.concat(F.lit("(?i)"), word)))

    return F.filter(skills, named)


def named_skills(text: Column, skills: list[str]) -> Column:
    """skill_matches() for a list that is known: each skill is a constant pattern, compiled once."""

    def named(skill: str) -> Column:
        if re.search(r"[^a-z0-9\s]", skill.lower()):
            return F.contains(F.lower(text), F.lit(skill.lower()))
        return text.rlike(("" if len(skill) <= 3 else "(?i)") + rf"(?<![A-Za-z0-9_]){re.escape(skill)}(?![A-Za-z0-9_])")

    own = [s for s in (x.strip() for x in skills) if s]
    return F.filter(F.array(*(F.when(named(s), F.lit(s)) for s in own)), lambda x: x.isNotNull()) if own else F.array().cast("array<string>")


#: Parts of hosts that name a source.
HOSTS = {"linkedin.com": "linkedin", "indeed.com": "indeed", "glassdoor.com": "glassdoor", "ziprecruiter.com": "ziprecruiter", "builtin": "builtin"}


def source_of(url: Column) -> Column:
    """The source a URL's host names: a known site, the label after jobs. or careers., else its first label; 'web' if the
    address has no host."""
    h = F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^(.*?)www\.", "$1"))
    labels = F.split(h, r"\.")
    chain = F.when(h.isNull() | (h == ""), "web")
    for part, name in HOSTS.items():
        chain = chain.when(F.contains(h, F.lit(part)), name)
    first = F.get(labels, F.lit(0))
    return chain.when(first.isin("jobs", "careers"), F.coalesce(F.get(labels, F.lit(1)), h)).otherwise(first)


def url_id(url: Column) -> Column:
    """A job's number on two known sites, else the 31-multiplier 32-bit hash of the address without scheme, query and
    fragment, absolute, in base 36."""
    linkedin = F.regexp_extract(url, r"linkedin\.com/jobs/view/(?:.*[-/])?(\d{5,})", 1)
    apple = F.regexp_extract(url, r"jobs\.apple\.com/.+/details/(\d+)", 1)
    path = F.regexp_replace(F.regexp_replace(url, r"^(.*?)https?://", "$1"), r"(?s)[?#].*", "")
    hashed = F.call_function("reflect", F.lit("java.util.Objects"), F.lit("hashCode"), path)
    short = F.lower(F.conv(F.abs(hashed.cast("bigint")).cast("string"), 10, 36))
    return F.when(linkedin != "", F.concat(F.lit("searxng-li-"), linkedin)).when(apple != "", F.concat(F.lit("searxng-apple-"), apple)).otherwise(F.concat(F.lit("searxng-"), short))


#: Benefit categories and what names them; the first that matches counts.
BENEFITS = {
    "Health": r"health|medical|dental|vision|wellness",
    "Unlimited PTO": r"unlimited\s+(?:pto|vacation|time.off)",
    "PTO": r"\bpto\b|vacation|time.off|paid.leave|holiday",
    "401k": r"401k|retirement|pension",
    "Equity": r"equity|stock|\brsu\b|option",
    "Bonus": r"bonus|incentive|commission",
    "Parental": r"parental|maternity|paternity|family.leave",
    "Pet": r"\bpet\b|dog.friendly",
}


def benefit_category(c: Column) -> Column:
    """The first category that a benefit's text names, else null."""
    chain = F.when(c.isNull(), F.lit(None))
    for name, pattern in BENEFITS.items():
        chain = chain.when(c.rlike(f"(?i){pattern}"), F.lit(name))
    return chain


def condensed_benefits(benefits: Column) -> Column:
    """array<struct<category,originals>> of an array of benefits, in order of first mention; those of no category drop."""
    tagged = F.filter(F.transform(benefits, lambda b: F.struct(benefit_category(b).alias("category"), b.alias("text"))), lambda x: x["category"].isNotNull())
    names = F.array_distinct(F.transform(tagged, lambda x: x["category"]))
    return F.transform(names, lambda n: F.struct(n.alias("category"), F.transform(F.filter(tagged, lambda x: x["category"] == n), lambda x: x["text"]).alias("originals")))


def shown_benefits(benefits: Column, most: int = 6) -> Column:
    """struct<shown,more>: the first groups of condensed benefits, and how many there are beyond."""
    groups = F.transform(F.array(condensed_benefits(benefits)), lambda g: F.struct(F.slice(g, 1, most).alias("shown"), F.greatest(F.size(g) - most, F.lit(0)).alias("more")))
    return F.get(groups, F.lit(0))


_BENEFITS_HEADER = r"(?i)\b(?:benefits|what we offer|perks|compensation\s*(?:&|and)\s*benefits|our benefits|employee benefits|why join us|why work here)\b"


def benefits_section(html: Column, text: Column) -> Column:
    """The lines of 5 to 199 characters, without bullets, below the first short line that names benefits; null if none.

    They end at a short line in capitals, or, once there is one, at a short line of five words or fewer that starts like
    a title and has neither bullet nor colon. HTML comes before text. Each step is computed once for a text, since
    lambdas would repeat for each line what they hold."""
    short = lambda x: F.length(x) < 60
    first = lambda rows, test: F.array_position(F.transform(rows, lambda x: F.coalesce(test(x), F.lit(False))), True).cast("int")
    plain = lambda x: trim_all(F.regexp_replace(x, r"^[\s\-–—*•●◦▪·]+", ""))
    title = lambda x: short(x) & ~x.rlike(r"^[-•*]") & x.rlike(r"^[A-Z][a-z]") & ~F.contains(x, F.lit(":")) & (F.size(F.split(x, r"\s+")) <= 5)

    def found(source: Column) -> Column:
        lines = F.filter(F.transform(F.split(source, "\n"), trim_all), lambda x: x != "")
        return F.when(F.length(source) >= 10, _once(lines, section))

    def section(lines: Column) -> Column:
        start = first(lines, lambda x: short(x) & x.rlike(_BENEFITS_HEADER))
        return _once(start, lambda at: F.when(at > 0, _once(F.slice(lines, at + 1, F.size(lines) - at), listed)))

    def listed(below: Column) -> Column:
        rows = F.transform(below, lambda x: F.struct(x.alias("line"), plain(x).alias("item")))
        rows = F.transform(rows, lambda r: F.struct(r["line"], r["item"], F.length(r["item"]).between(5, 199).alias("fits")))
        return _once(rows, lambda r: _once(first(r, lambda x: x["fits"]), lambda item: F.when(item > 0, items(r, item))))

    def items(rows: Column, item: Column) -> Column:
        ends = lambda x, i: (short(x["line"]) & x["line"].rlike(r"^[A-Z][A-Z\s]{3,}$")) | ((i + 1 > item) & title(x["line"]))
        end = F.array_position(F.transform(rows, ends), True).cast("int")
        kept = F.filter(_once(end, lambda at: F.when(at > 0, F.slice(rows, 1, at - 1)).otherwise(rows)), lambda x: x["fits"])
        return _once(F.transform(kept, lambda x: x["item"]), lambda x: F.when(F.size(x) > 0, x))

    return _once(F.when(F.length(html) > 0, sanitize_lines(html)).otherwise(text), found)


#: Headers at which a listing's own text starts, most specific first, and sentences that say nothing of it.
SECTIONS = (
    r"what you'?ll do|what you'?ll bring|what you'?ll need|what we'?re looking for",
    r"key responsibilities|responsibilities|requirements|qualifications",
    r"about the role|about this (?:role|job|position|opportunity)|(?:role|position|job) (?:overview|description|summary)",
    r"an overview of this role|the opportunity|your role|the role",
)
JUNK = (
    r"^about us\b", r"^about the company\b", r"^who we are\b", r"^our mission is", r"equal opportunity employer", r"we do not discriminate",
    r"^are you looking for", r"^do you love the challenge", r"^if you'?re passionate about", r"we'?d love to meet you",
)


#: Parts in lower case, one of which any match of a section's header, or of a sentence that says nothing, holds.
SECTION_STEMS = (("what you", "what we"), ("responsibilities", "requirements", "qualifications"), ("about th", "overview", "description", "summary"), ("role", "opportunity"))
JUNK_STEMS = ("about us", "about the company", "who we are", "our mission is", "equal opportunity employer", "do not discriminate", "you looking for", "do you love", "if you", "love to meet you")


def _holds(low: Column, stems: tuple[str, ...]) -> Column:
    return reduce(lambda c, s: c | F.contains(low, F.lit(s)), stems[1:], F.contains(low, F.lit(stems[0])))


def strip_boilerplate(text: Column) -> Column:
    """From the first section header on that starts in the first 70 % of the text; without one, the sentences that are
    not boilerplate. Patterns are searched for only in texts that hold a part of them."""

    def places(low: Column) -> Column:
        found = (F.when(_holds(low, stems), F.regexp_instr(text, F.lit(f"(?i)(?:{pattern})"))).otherwise(0) for pattern, stems in zip(SECTIONS, SECTION_STEMS, strict=True))
        return F.struct(F.array(*found).alias("at"), _holds(low, JUNK_STEMS).alias("junk"))

    def cut(found: Column) -> Column:
        chain = F.when(text.isNull(), F.lit(None))
        for i in range(len(SECTIONS)):
            at = found["at"][i]
            chain = chain.when((at > 0) & (at - 1 < F.length(text) * 0.7), trim_all(F.substring(text, at, F.length(text))))
        sentences = F.transform(F.split(text, r"(?<=[.!?])\s+|(?<=:)\s+(?=[A-Z])"), lambda s: F.struct(s.alias("s"), trim_all(s).alias("plain")))
        says = lambda s: ~(found["junk"] & s["plain"].rlike("(?i)" + "|".join(f"(?:{j})" for j in JUNK)))
        own = F.filter(sentences, lambda s: (s["plain"] != "") & says(s))
        return chain.otherwise(trim_all(F.array_join(F.transform(own, lambda s: s["s"]), " ")))

    return _once(_once(F.lower(text), places), cut)


def relative_date(day: Column, as_of: Column) -> Column:
    """Today, Yesterday, '3d ago', else 'Mar 5'; a dash without a date."""
    days = F.floor((as_of.cast("timestamp").cast("double") - day.cast("timestamp").cast("double")) / 86400)
    return F.when(day.isNull(), "—").when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit("d ago"))).otherwise(F.date_format(day, "MMM d"))
