"""The scoring model's arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.money import half_up

#: Weights of the skills, experience and salary axes; factor of a full salary score; cosine bounds of the axes and domain.
WEIGHTS, SALARY_BOOST = (0.40, 0.30, 0.30), 1.15
AXIS_BOUNDS, DOMAIN_BOUNDS = (0.25, 0.75), (0.30, 0.85)


def scale(similarity: Column, floor: float, ceiling: float) -> Column:
    """Linear from floor to ceiling onto 0..100, rounded."""
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - floor) / (ceiling - floor))) * 100).cast("int")


def final_score(skills: Column, experience: Column, salary: Column, domain: Column) -> Column:
    """Weighted axes, boosted for a full salary score, gated by the domain, at most 100."""
    base = WEIGHTS[0] * skills + WEIGHTS[1] * experience + WEIGHTS[2] * salary
    return F.least(F.lit(100), half_up(F.when(salary == 100, base * SALARY_BOOST).otherwise(base) * domain / 100)).cast("int")


def breakdown(skills_sim: Column, title_sim: Column, salary: Column) -> Column:
    """struct<skills,experience,salary,domain,score>; skills similarity doubles as the domain's."""
    skills, experience, domain = scale(skills_sim, *AXIS_BOUNDS), scale(title_sim, *AXIS_BOUNDS), scale(skills_sim, *DOMAIN_BOUNDS)
    return F.struct(skills.alias("skills"), experience.alias("experience"), salary.alias("salary"), domain.alias("domain"), final_score(skills, experience, salary, domain).alias("score"))


def salary_target(low: Column, high: Column) -> Column:
    """The middle of a wanted range, the low end alone, or null without one."""
    return F.when(low.isNotNull(), F.coalesce(half_up((low + high) / 2).cast("double"), low.cast("double")))


def badge(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")


def ring_color(score: Column) -> Column:
    """The colors of five bands."""
    return F.when(score < 30, "#ef4444").when(score < 50, "#f97316").when(score < 70, "#eab308").when(score < 85, "#22c55e").otherwise("#10b981")


def partial_score(title_sim: Column) -> Column:
    """struct<experience,domain,score> of a listing known by its title alone: no skills, no salary, and the title's
    similarity gates its own axis."""
    sim = F.greatest(F.lit(0.0), title_sim)
    experience, domain = scale(sim, *AXIS_BOUNDS), scale(sim, *DOMAIN_BOUNDS)
    return F.struct(experience.alias("experience"), domain.alias("domain"), F.least(F.lit(100), half_up(experience * WEIGHTS[1] * (domain / 100))).cast("int").alias("score"))


def score_job(title_only: Column, profiled: Column, skills_sim: Column, title_sim: Column, salary: Column) -> Column:
    """struct<path,skills,experience,salary,domain,score>: a listing known by its title alone; one with a profile, whose
    skills similarity is the domain's too; or, without a profile, the title's axis alone, whose domain of 0 gives 0."""
    partial, whole, zero = partial_score(title_sim), breakdown(skills_sim, title_sim, salary), F.lit(0)
    named = lambda path, *values: F.struct(F.lit(path).alias("path"), *(v.cast("int").alias(n) for n, v in zip(("skills", "experience", "salary", "domain", "score"), values, strict=True)))
    return (
        F.when(title_only, named("title", zero, partial["experience"], zero, partial["domain"], partial["score"]))
        .when(profiled, named("profile", whole["skills"], whole["experience"], salary, whole["domain"], whole["score"]))
        .otherwise(named("fallback", zero, whole["experience"], salary, zero, zero))
    )


def embedding_text(title: Column, company: Column, description: Column) -> Column:
    """The text to embed of a listing: title, company and the first 500 characters of its description."""
    return F.concat(title, F.lit(" "), company, F.lit(" "), F.coalesce(F.substring(description, 1, 500), F.lit("")))


def profile_texts(profile: Column) -> Column:
    """struct<hardSkills,title>: the texts to embed of a profile."""
    skills = F.when(F.size(profile["hardSkills"]) > 0, F.array_join(profile["hardSkills"], ", ")).otherwise("none")
    return F.struct(skills.alias("hardSkills"), F.concat(profile["seniorityLevel"], F.lit(" "), profile["title"]).alias("title"))


PROFILE = "struct<title string, domain string, seniorityLevel string, yearsExperience string, hardSkills array<string>, softSkills array<string>, certifications array<string>>"


def profile_of(raw: Column) -> Column:
    """The profile in a model's answer: its outermost braces as JSON, missing texts empty, years a number of at least 0,
    empty strings dropped from lists; null if it is not JSON."""
    found = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    p = F.from_json(found, PROFILE)
    years = F.coalesce(F.greatest(F.lit(0.0), F.nanvl(p["yearsExperience"].try_cast("double"), F.lit(0.0))), F.lit(0.0))
    texts = [F.coalesce(p[n], F.lit("")).alias(n) for n in ("title", "domain", "seniorityLevel")]
    lists = [F.coalesce(F.filter(p[n], lambda x: F.length(x) > 0), F.array().cast("array<string>")).alias(n) for n in ("hardSkills", "softSkills", "certifications")]
    return F.when(F.try_parse_json(found).isNotNull(), F.struct(*texts, years.alias("yearsExperience"), *lists))


def work_style(is_remote: Column, location: Column) -> Column:
    """'Remote', 'Hybrid', the place, both, or 'On-site' if nothing is known."""
    place = F.trim(F.coalesce(location, F.lit("")))
    rest = F.trim(F.regexp_replace(place, r"(?i)^(.*?)\s*\(?\bhybrid\b\)?[,\s-]*", "$1"))
    joined = lambda word, text: F.when(text != "", F.concat(F.lit(f"{word} · "), text)).otherwise(word)
    return (
        F.when(is_remote, joined("Remote", F.regexp_replace(place, "(?i)^remote$", "")))
        .when(F.contains(F.lower(place), F.lit("hybrid")), joined("Hybrid", rest))
        .when(place != "", place)
        .otherwise("On-site")
    )
