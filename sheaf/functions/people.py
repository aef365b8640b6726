"""Names, titles and author lists as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import _c

#: Ranks of job titles, the first pattern that fits counts, with their level.
RANK_LADDER = (
    (r"emerit", "Emeritus Professor", None), (r"adjunct|honorary|visiting|casual", "Adjunct or visiting", None),
    (r"professor of practice|practice professor", "Professor of Practice", "E"), (r"assoc[a-z.]* *prof|a/prof", "Associate Professor", "D"), (r"\bprof", "Professor", "E"),
    (r"(senior|snr|sr)\.? *lect", "Senior Lecturer", "C"), (r"assoc[a-z.]* *lect|a/lect", "Associate Lecturer", "A"), (r"\blect", "Lecturer", "B"),
    (r"(senior|snr|sr)\.? *research fellow", "Senior Research Fellow", "C"), (r"research fellow|res\.? fellow", "Research Fellow", "B"), (r"post-?doc", "Postdoctoral Fellow", "A"),
)
#: Rank of each level.
LEVEL_RANK = {"A": "Associate Lecturer", "B": "Lecturer", "C": "Senior Lecturer", "D": "Associate Professor", "E": "Professor"}
#: Roles found in job titles, the longest first.
ROLES = ("deputy head of school", "head of school", "head of department", "associate dean", "dean", "program director", "director of research", "director")
_PREFIX = r"(?i)^(a/prof\.?|assoc\.? prof\.?|associate professor|emeritus professor|professor|prof\.?|dr\.?|mrs\.?|mr\.?|ms\.?|miss) +"


def honorific(x: Column | str) -> Column:
    p = F.regexp_extract(F.trim(_c(x)), _PREFIX, 1)
    return F.when(p != "", p)


def without_honorific(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_c(x)), _PREFIX, ""), _PREFIX, ""))


def _ladder(x: Column | str, at: int) -> Column:
    low = F.lower(_c(x))
    out = None
    for step in RANK_LADDER:
        out = F.when(low.rlike(step[0]), F.lit(step[at])) if out is None else out.when(low.rlike(step[0]), F.lit(step[at]))
    return out


def rank_of(x: Column | str) -> Column:
    return _ladder(x, 1)


def level_of(x: Column | str) -> Column:
    return _ladder(x, 2)


def rank_for_level(x: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in LEVEL_RANK.items() for v in kv]), _c(x))


def roles_of(x: Column | str) -> Column:
    """Roles in a job title, the longest first, none inside another one that was found."""
    low = F.lower(_c(x))
    rest, found = low, []
    for role in ROLES:
        found.append(F.when(rest.contains(role), F.lit(role)))
        rest = F.replace(rest, F.lit(role), F.lit("|"))
    return F.array_compact(F.array(*found))


def name_tokens(x: Column | str) -> Column:
    """Sorted distinct ASCII words of a name without titles."""
    words = F.split(F.trim(F.regexp_replace(F.lower(without_honorific(x)), "[^a-z]+", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def name_key(x: Column | str) -> Column:
    return F.array_join(name_tokens(x), " ")


def long_tokens(x: Column | str) -> Column:
    """name_tokens without initials."""
    return F.filter(name_tokens(x), lambda w: F.length(w) > 1)


def surname(x: Column | str) -> Column:
    """Family name of 'Family, Given' or 'Given Family'."""
    t = F.trim(_c(x))
    return F.lower(F.when(t.contains(","), F.trim(F.substring_index(t, ",", 1))).otherwise(F.substring_index(t, " ", -1)))


def author_names(x: Column | str) -> Column:
    """The names of a semicolon list; null where the separator is in doubt."""
    parts = F.filter(F.transform(F.split(_c(x), ";"), lambda p: F.trim(p)), lambda p: (p != "") & ~F.lower(p).rlike("^et al"))
    return F.when(_c(x).contains(";"), parts).when(~_c(x).contains(",") & ~F.lower(_c(x)).rlike(" and | & |\\||/|\\n") & (F.trim(_c(x)) != ""), F.array(F.trim(_c(x))))


def author_count(x: Column | str) -> Column:
    names = author_names(x)
    return F.when(names.isNotNull(), F.size(names))


def coauthor_surnames(x: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(author_names(x), lambda n: surname(n))))


def fullness(x: Column | str) -> Column:
    """How many spelled-out words an author list holds."""
    return F.regexp_count(_c(x), F.lit("[A-Z][a-z]+"))


def given_first(x: Column | str) -> Column:
    """'Family, Given; ...' as 'Given Family; ...'."""
    flip = lambda n: F.when(n.contains(","), F.concat_ws(" ", F.trim(F.substring_index(n, ",", -1)), F.trim(F.substring_index(n, ",", 1)))).otherwise(n)
    return F.array_join(F.transform(author_names(x), flip), "; ")
