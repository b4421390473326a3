"""The retired first scorer: skills by keyword, requirements covered, weighted axes, and a bounded nudge by a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.money import half_up
from feedloom.functions.resume import let
from feedloom.functions.scores import SALARY_BOOST, scale
from feedloom.functions.text import trim_all

#: Weights of skills, requirements, experience and salary; bounds of the experience axis; tiers and their cap.
WEIGHTS, BOUNDS = (0.35, 0.25, 0.20, 0.20), (0.2, 0.6)
REJECT, UNLIKELY, CAP, LEAST_TERMS, NUDGE = 15, 45, 50, 4, 10
#: Words of a skill that do not count.
FILLERS = ("and", "the", "for", "with", "in", "of", "to", "a", "an")
AXES = ("skills", "requirements", "experience", "salary")


def matched_skills(skills: Column, text: Column) -> Column:
    """The skills that a text names: a single word as a whole word, or as a substring if it has special characters; of
    several words, at least 60 % of those that count, as substrings."""

    def named(skill: Column, low: Column) -> Column:
        words = F.filter(F.split(F.lower(skill), r"[\s&,]+"), lambda w: F.length(w) >= 2)

        def of(w: Column) -> Column:
            one = F.get(w, F.lit(0))
            alone = F.when(one.rlike("[^a-z0-9]"), F.contains(low, one)).otherwise(F.regexp_like(low, F.concat(F.lit(r"(?<![a-z0-9_])"), one, F.lit(r"(?![a-z0-9_])"))))
            own = F.filter(w, lambda x: ~x.isin(list(FILLERS)))
            hits = F.size(F.filter(own, lambda x: F.contains(low, x)))
            return F.when(F.size(w) == 0, False).when(F.size(w) == 1, alone).otherwise((F.size(own) > 0) & (hits >= F.ceil(F.size(own) * 0.6)))

        return let(words, of)

    return let(F.lower(text), lambda low: F.filter(skills, lambda skill: named(skill, low)))


def skill_percent(skills: Column, text: Column) -> Column:
    return F.when(F.size(skills) > 0, half_up(F.size(matched_skills(skills, text)) / F.size(skills) * 100)).otherwise(0).cast("int")


def requirement_list(answer: Column) -> Column:
    """The terms of a model's comma-separated answer: 2 to 59 characters, no bare numbers; empty if there are under two."""
    terms = F.filter(F.transform(F.split(answer, ","), lambda t: trim_all(F.regexp_replace(trim_all(t), r"(?U)^[-•*\d.)\s]+", ""))), lambda t: F.length(t).between(2, 59) & ~t.rlike(r"^\d+$"))
    return let(terms, lambda t: F.when(F.size(t) >= 2, t).otherwise(F.array().cast("array<string>")))


def requirement_percent(skills: Column, terms: Column) -> Column:
    """How many of the terms the skills cover: as a skill or a word of one, or, from three characters on, as a part of a
    skill or one as a part of them; of four terms at least."""
    low = F.transform(skills, lambda s: F.lower(s))
    words = F.concat(low, F.filter(F.flatten(F.transform(low, lambda s: F.split(s, r"[\s/&,]+"))), lambda w: F.length(w) >= 2))

    def of(own: Column, known: Column) -> Column:
        part = lambda t: F.exists(own, lambda s: (F.length(s) >= 3) & (F.contains(s, t) | F.contains(t, s)))
        covered = F.filter(F.transform(terms, lambda t: F.lower(t)), lambda t: F.array_contains(known, t) | ((F.length(t) >= 3) & part(t)))
        return half_up(F.size(covered) / F.greatest(F.size(terms), F.lit(LEAST_TERMS)) * 100)

    none = (F.size(terms) == 0) | (F.size(skills) == 0)
    return F.when(none, 0).otherwise(let(low, lambda own: let(words, lambda known: of(own, known)))).cast("int")


def experience_axis(similarity: Column) -> Column:
    return scale(similarity, *BOUNDS)


def weighted(axes: Column) -> Column:
    """The score of a struct of axes, boosted for a full salary score, at most 100."""
    raw = sum((axes[a] * w for a, w in zip(AXES[1:], WEIGHTS[1:], strict=True)), axes[AXES[0]] * WEIGHTS[0])
    return F.least(F.lit(100), half_up(F.when(axes["salary"] == 100, raw * SALARY_BOOST).otherwise(raw))).cast("int")


#: The parts of the model's prompt.
PROMPT = (
    "A scoring system rated this candidate-job match. Review and adjust each score. Output ONLY 3 lines, no other text.\n\nInitial scores — Skills: ",
    "/10, Requirements: ",
    "/10, Experience: ",
    "/10\n\nCandidate: ",
    "\nJob: ",
    " - ",
    "\n\nAdjusted scores (each 0-10, adjust by at most ±2 from initial):\nSkills:",
)


def nudge_prompt(resume: Column, title: Column, description: Column, axes: Column) -> Column:
    """The model's prompt; description is without boilerplate."""
    tenth = lambda a: half_up(axes[a] / 10).cast("string")
    parts = [tenth("skills"), tenth("requirements"), tenth("experience"), F.substring(resume, 1, 300), title, F.substring(description, 1, 500)]
    return F.concat(*(c for text, part in zip(PROMPT, parts, strict=False) for c in (F.lit(text), part)), F.lit(PROMPT[-1]))


def clamped(said: Column, own: Column) -> Column:
    """A nudged axis: at most ten points from its own, within 0 and 100; an axis of 0 stays."""
    return F.when(own == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), own + F.greatest(F.lit(-NUDGE), F.least(F.lit(NUDGE), said - own))))).cast("int")


def nudged(answer: Column, axes: Column) -> Column:
    """The axes after a model's answer of up to three lines; null without the first, other missing lines change nothing."""
    full = F.when(F.startswith(answer, F.lit("Skills")), answer).otherwise(F.concat(F.lit("Skills: "), answer))

    def said(*names: str) -> Column:
        found = [F.regexp_extract(full, rf"(?i){n}:\s*(\d{{1,2}})", 1).try_cast("int") for n in names]
        return F.coalesce(*(F.when(x.isNotNull(), F.least(F.lit(10), x) * 10) for x in found))

    each = {"skills": said("Skills"), "requirements": F.coalesce(said("Requirements?", r"Tech(?:\s*Stack)?"), axes["requirements"]), "experience": F.coalesce(said("Experience"), axes["experience"])}
    return F.when(each["skills"].isNotNull(), F.struct(*(clamped(c, axes[a]).alias(a) for a, c in each.items()), axes["salary"].cast("int").alias("salary")))


def tiered(axes: Column, after: Column) -> Column:
    """The axes that count: their own below the first tier; nudged ones else, scaled down to the cap if the nudge lifts a
    score of the second tier over it."""
    own = weighted(axes)

    def of(new: Column) -> Column:
        capped = (own < UNLIKELY) & (weighted(new) > CAP)
        return F.struct(*(F.when(capped, half_up(new[a] * (CAP / weighted(new)))).otherwise(new[a]).cast("int").alias(a) for a in AXES))

    return F.when(own < REJECT, F.struct(*(axes[a].cast("int").alias(a) for a in AXES))).otherwise(let(F.coalesce(after, axes), of))
