"""Rules over nested or half-structured records: preferred entries, three-valued states, lenient JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import _c, title_key


def forthcoming(venue: Column | str) -> tuple[Column, Column]:
    """(venue without the remark, whether it said so) of 'Journal (forthcoming)'."""
    pattern = r"(?i)[\s,;(]*\b(forthcoming|in press|accepted)\b[\s).]*"
    v = F.trim(F.regexp_replace(_c(venue), pattern, " "))
    return F.nullif(v, F.lit("")), _c(venue).rlike(pattern)


def prose_not_title(title: Column | str, doi: Column | str, year: Column | str, words: int = 25) -> Column:
    """Long running text in place of a title, with neither DOI nor year."""
    return (F.size(F.split(title_key(title), " ")) > words) & _c(doi).isNull() & _c(year).isNull()


def first_year(text: Column | str, low: int = 1950, high: int = 2100) -> Column:
    """The first plausible year of a text."""
    found = F.transform(F.regexp_extract_all(_c(text), F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), 1), lambda y: y.cast("int"))
    return F.get(F.filter(found, lambda y: (y >= low) & (y <= high)), F.lit(0))


def in_an_issue(volume: Column | str, issue: Column | str, online_only: Column | str) -> Column:
    """True with a volume or issue, False when only online, null when nothing is known."""
    return F.when(_c(volume).isNotNull() | _c(issue).isNotNull(), True).when(_c(online_only), False)


def record_year(*years: Column | str) -> Column:
    """The first given one of print, issue and online years."""
    return F.coalesce(*[_c(y) for y in years])


def preferred_location(locations: Column | str) -> Column:
    """Name of array<struct<kind, name, repository>>: a journal's, else one that is no repository, else the first."""
    a = _c(locations)
    journal = F.get(F.filter(a, lambda x: (x["kind"] == "journal") & x["name"].isNotNull()), F.lit(0))["name"]
    other = F.get(F.filter(a, lambda x: ~F.coalesce(x["repository"], F.lit(False)) & x["name"].isNotNull()), F.lit(0))["name"]
    return F.coalesce(journal, other, F.get(a, F.lit(0))["name"])


def preferred_typed(values: Column | str, kind: str) -> Column:
    """Value of array<struct<kind, value>>: the first of the wanted kind, else the first of any kind, else the first."""
    a = _c(values)
    return F.coalesce(F.get(F.filter(a, lambda x: x["kind"] == kind), F.lit(0))["value"], F.get(F.filter(a, lambda x: x["kind"].isNotNull()), F.lit(0))["value"], F.get(a, F.lit(0))["value"])


def veto(keys: Column | str, shared: list[str], own_name: Column | str, shared_names: list[str]) -> Column:
    """Keys without those of aggregators, unless the record is the aggregator itself."""
    mine = F.lower(F.trim(_c(own_name))).isin(*[n.lower() for n in shared_names])
    return F.when(F.coalesce(mine, F.lit(False)), _c(keys)).otherwise(F.array_except(_c(keys), F.array(*[F.lit(s) for s in shared]).cast("array<string>")))


def own_entry(entries: Column | str, own_id: Column | str, field: str) -> Column:
    """Of array<struct<id, ...>> the field of the record's own entry, where it has one."""
    return F.get(F.filter(_c(entries), lambda x: (x["id"] == _c(own_id)) & x[field].isNotNull()), F.lit(0))[field]


def lenient_json(text: Column | str) -> Column:
    """JSON out of a fenced or surrounded text as VARIANT, null where there is none."""
    bare = F.regexp_extract(F.regexp_replace(_c(text), r"```(json)?", ""), r"(?s)([\[{].*[\]}])", 1)
    return F.try_parse_json(F.nullif(bare, F.lit("")))


def merged_ids(ids: Column | str) -> Column:
    """array<struct<key, value>> as a map, the first value of each key."""
    a = _c(ids)
    keys = F.array_distinct(F.transform(a, lambda x: x["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(a, lambda x: x["key"] == k), F.lit(0))["value"]))


def scope_note(**conditions: Column) -> Column:
    """Names of the conditions that hold, joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n.replace("_", " "))) for n, c in conditions.items()])), "; ")
