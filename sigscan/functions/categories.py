"""The article categories: their three spellings, their flags and predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigscan.functions.text import W, trim_ws


@dataclass(frozen=True)
class Category:
    key: str
    flag: str
    bucket: str
    has: str | None = None
    without: str | None = None


# fixed values: the category vocabulary, with the publication type that a member has and the one that excludes it
CATEGORIES = [
    Category("all", "all_article", "all-articles"),
    Category("rct", "randomized_controlled_trial", "randomized-controlled-trial", "randomized controlled trial"),
    Category("ct", "clinical_trial", "clinical-trial", "clinical trial", "randomized controlled trial"),
    Category("meta", "meta_analysis", "meta-analysis", "meta-analysis"),
    Category("review", "review", "review", "review", "meta-analysis"),
    Category("cuj", "clinical_useful_journal", "clinical-useful-journal"),
]
#: Predicates beyond the categories.
EXTRA = {"Systematic_Review": "systematic review", "Observational_Study": "observational study"}
TREND_YEARS, DISTRIBUTION_YEARS = (1990, 2025), (2015, 2025)
# fixed values: the spellings of a set flag, and what stands between publication types
TRUTHY = ["1", "true", "t", "y", "yes"]
SEPARATOR = " ; "


def publication_types(c: Column) -> Column:
    """The lower-case types of a " ; "-separated list, without blanks; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SEPARATOR), lambda x: F.lower(trim_ws(x))), lambda x: x != "")


def member(types: Column, has: str, without: str | None = None) -> Column:
    found = F.array_contains(types, has)
    return found & ~F.array_contains(types, without) if without else found


def type_flags(publication_type: Column) -> dict[str, Column]:
    """0/1 columns of the categories that publication types decide."""
    types = publication_types(publication_type)
    flags = {c.flag: member(types, c.has, c.without).cast("int") for c in CATEGORIES if c.has}
    return flags | {"all_article": F.lit(1)}


def predicate(field: str, year: int, types: Column, pub_year: Column, has_abstract: Column, medline: Column, core_journal: Column) -> Column:
    """The named search as a row predicate; raises ValueError for an unknown name."""
    within = (pub_year == year) & has_abstract & medline
    if field in EXTRA:
        return F.coalesce(member(types, EXTRA[field]) & within, F.lit(False))
    c = next((c for c in CATEGORIES if c.key == field), None)
    if c is None:
        raise ValueError(f"no such search: {field}")
    own = core_journal if c.key == "cuj" else member(types, c.has, c.without) if c.has else F.lit(True)
    return F.coalesce(own & within, F.lit(False))


def query_text(field: str, year: int, journals: list[str] | None = None) -> str:
    """The search as text for a literature service."""
    # fixed values: the spelling of the searches
    tail = f'"{year}"[PDAT] AND hasabstract AND medline[sb]'
    words = {"rct": '"Randomized Controlled Trial"[PT]', "ct": '"Clinical Trial"[PT] NOT "Randomized Controlled trial"[PT]', "meta": '"Meta-analysis"[PT]', "review": '"Review"[PT] NOT "Meta-analysis"[PT]', "Systematic_Review": '"Systematic Review"[PT]', "Observational_Study": '"Observational Study"[PT]'}
    if field == "all":
        return tail
    if field == "cuj":
        if not journals:
            raise ValueError("the journals of the search are a parameter")
        return "(" + " OR ".join(f'"{j}"[Journal]' for j in journals) + f") AND {tail}"
    if field not in words:
        raise ValueError(f"no such search: {field}")
    return f"{words[field]} AND {tail}"


def truthy(c: Column) -> Column:
    """1, true, t, y, yes in any case and padding; "1.0" is not."""
    return F.coalesce(F.lower(trim_ws(c.cast("string"))).isin(TRUTHY), F.lit(False))


def article_id(c: Column) -> Column:
    """Trimmed, upper case, with its prefix; null if blank."""
    t = F.upper(trim_ws(c.cast("string")))
    return F.when(t.startswith("PMC"), t).when(t != "", F.concat(F.lit("PMC"), t))


def year_of(c: Column) -> Column:
    """The integer before a dot; null if there is none."""
    return F.regexp_replace(F.element_at(F.split(trim_ws(c.cast("string")), r"\."), 1), f"{W}", "").try_cast("int")


def null_id(c: Column) -> Column:
    """Trimmed; the spellings of a missing id become null."""
    t = trim_ws(c.cast("string"))
    return F.when(~t.isin("", "0", "nan", "None"), t)


def bucket_array(flags: dict[str, Column]) -> Column:
    """Sorted bucket names of the flags (column name to boolean column) that hold."""
    named = [F.when(flags[c.flag], F.lit(c.bucket)) for c in CATEGORIES if c.flag in flags]
    return F.array_sort(F.array_compact(F.array(*named))) if named else F.array().cast("array<string>")
