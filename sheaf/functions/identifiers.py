"""DOI, ISSN, ORCID, URL and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import _c


def doi(x: Column | str, tails: bool = True) -> Column:
    """The DOI in lower case without URL, prefix, query, fragment, file tails and closing punctuation; null unless complete."""
    t = F.lower(F.trim(_c(x)))
    t = F.regexp_replace(t, "%2f", "/")
    t = F.regexp_extract(t, r"(10\.[0-9]{4,9}/[^ ?#]+)", 1)
    if tails:
        t = F.regexp_replace(t, r"(/(pdf|full|abstract|epdf)|\.html?)$", "")
    t = F.regexp_replace(t, r"[.,;)]+$", "")
    return F.when(t.rlike(r"^10\.[0-9]{4,9}/.+"), t)


def doi_link(x: Column | str) -> Column:
    d = doi(x)
    return F.when(d.isNotNull(), F.concat(F.lit("https://doi.org/"), d))


def dedup_doi(x: Column | str, repository_prefix: str) -> Column:
    """The DOI, null where its prefix is a repository's."""
    d = doi(x)
    return F.when(d.startswith(repository_prefix), None).otherwise(d)


def issn(x: Column | str) -> Column:
    """One ISSN with hyphen, null where it has another shape."""
    t = F.upper(F.regexp_replace(F.trim(_c(x)), "[^0-9Xx]", ""))
    return F.when(t.rlike("^[0-9]{7}[0-9X]$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 4)))


def issns(x: Column | str) -> Column:
    """All ISSNs of a cell in order, each once."""
    found = F.regexp_extract_all(F.upper(_c(x)), F.lit(r"(?<![0-9])([0-9]{4}-?[0-9]{3}[0-9X])(?![0-9])"), 1)
    return F.array_distinct(F.transform(found, lambda s: F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, -4, 4))))


def issn_valid(x: Column | str) -> Column:
    """Whether an ISSN's check digit is right (modulus 11)."""
    t = F.regexp_replace(_c(x), "-", "")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(0), lambda a, i: a + (9 - i) * F.substring(t, i, F.lit(1)).cast("int"))
    check = (11 - total % 11) % 11
    return F.when(t.rlike("^[0-9]{7}[0-9X]$"), F.substring(t, 8, 1) == F.when(check == 10, "X").otherwise(check.cast("string")))


def orcid(x: Column | str) -> Column:
    """The ORCID in its usual shape, null without one."""
    t = F.regexp_extract(F.regexp_replace(F.upper(_c(x)), "-", ""), "([0-9]{15}[0-9X])", 1)
    return F.when(t != "", F.concat_ws("-", *[F.substring(t, i, 4) for i in (1, 5, 9, 13)]))


def orcid_valid(x: Column | str) -> Column:
    """Whether its check character is right (ISO 7064 mod 11-2)."""
    t = F.regexp_replace(_c(x), "-", "")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0).cast("bigint"), lambda a, i: (a + F.substring(t, i, F.lit(1)).cast("bigint")) * 2 % 11)
    check = (12 - total % 11) % 11
    return F.when(t.rlike("^[0-9]{15}[0-9X]$"), F.substring(t, 16, 1) == F.when(check == 10, "X").otherwise(check.cast("string")))


def loose_int(x: Column | str) -> Column:
    """'2014.0' as 2014; null for what is no number."""
    d = F.trim(_c(x)).try_cast("double")
    return d.cast("bigint").cast("int")


def decimal_comma(x: Column | str) -> Column:
    return F.regexp_replace(F.trim(_c(x)), ",", ".").try_cast("double")


def plausible_year(x: Column | str, low: int = 1900, high: Column | int = 2100) -> Column:
    """The first four-digit number that is a plausible year."""
    y = F.regexp_extract(_c(x).cast("string"), r"(\d{4})", 1).try_cast("int")
    return F.when((y >= low) & (y <= high), y)


def url_id(x: Column | str) -> Column:
    """The last part of a URL's path."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(_c(x), "[?#].*$", ""), "/+$", ""), "/"), -1)
