"""Text keys and clean-up as Column expressions; only what Spark lacks is a Python function."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spellings of a missing cell.
MISSING = ("", "nan", "none", "null")
#: Words that stay in lower case inside a tidied title, and acronyms that stay in capitals.
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to", "with")
#: Venues that are repositories rather than journals.
REPOSITORY_VENUES = ("ssrn", "ssrn electronic journal", "repec", "arxiv", "arxiv.org", "zenodo", "figshare", "research square")


#: What keys leave out.
NO_KEY = r"[^\p{L}\p{M}\p{N}]+"


def source_name(x: Column | str) -> Column:
    """A source's name without regard to case, blanks, hyphens and underscores."""
    return F.lower(F.trim(F.regexp_replace(_c(x), r"[\s_\-]+", " ")))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_clean(x: Column | str) -> Column:
    """Trimmed text, null for blank cells and for the words that stand for missing ones."""
    t = F.trim(_c(x).cast("string"))
    return F.when(F.lower(t).isin(*MISSING), None).otherwise(t)


def first_filled(columns: list[str], have: list[str]) -> Column:
    """The first filled one of several alias columns, of those that exist."""
    return F.coalesce(*[null_clean(c) for c in columns if c in have], F.lit(None).cast("string"))


def squeeze(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def title_key(x: Column | str) -> Column:
    """Lower case, everything but letters (with their marks) and digits of any script as one blank."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), NO_KEY, " "))


def journal_key(x: Column | str) -> Column:
    """title_key with '&' as 'and' and without a leading 'the'."""
    return F.regexp_replace(title_key(F.regexp_replace(_c(x), "&", " and ")), "^the ", "")


def article_key(x: Column | str) -> Column:
    """title_key without a leading article."""
    return F.regexp_replace(title_key(x), "^(the|a|an) ", "")


def bare_key(x: Column | str) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(_c(x)), NO_KEY, "")


def slug(x: Column | str) -> Column:
    return F.regexp_replace(title_key(x), " ", "-")


def stable_id(x: Column | str, length: int = 16) -> Column:
    return F.substring(F.sha2(_c(x), 256), 1, length)


def tidy_title(x: Column | str) -> Column:
    """Title case by word; small words in lower case but for the first, words in capitals of up to four letters kept, '&' as 'and'."""
    words = F.filter(F.split(F.trim(F.regexp_replace(_c(x), "&", "and")), " +"), lambda w: w != "")
    cased = F.transform(
        words,
        lambda w, i: F.when((i > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w))
        .when((F.length(w) <= 4) & w.rlike("^[A-Z]{2,}$") & ~F.lower(w).isin(*SMALL_WORDS), w)
        .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))),
    )
    return F.array_join(cased, " ")


def drop_repository(x: Column | str) -> Column:
    """The venue, null where it is a repository or a working-paper series."""
    low = F.lower(F.trim(_c(x)))
    return F.when(low.isin(*REPOSITORY_VENUES) | low.rlike("working paper|discussion paper|unpublished"), None).otherwise(F.trim(_c(x)))


def single_case(x: Column | str) -> Column:
    """Whether all letters are of one case."""
    letters = F.regexp_replace(_c(x), r"[^\p{L}]", "")
    return (letters != "") & ((letters == F.upper(letters)) | (letters == F.lower(letters)))


def strip_footnote(x: Column | str) -> Column:
    """Without a trailing footnote mark, in titles of four words or more."""
    words = F.size(F.split(F.trim(_c(x)), " +"))
    return F.when(words >= 4, F.regexp_replace(_c(x), r"[*†‡]+\s*$|(?<=[a-z])\d$", "")).otherwise(_c(x))


def has_markup(x: Column | str) -> Column:
    return _c(x).rlike(r"</?[A-Za-z][^>]*>|&[A-Za-z]+;|&#[0-9]+;")


def placeholder(x: Column | str) -> Column:
    return F.lower(F.trim(_c(x))).isin("n/a", "na", "tbc", "tba", "unknown", "-", "?", "test", "to be advised", "various")


def page_span(x: Column | str) -> Column:
    """Number of pages of '12-15', null where there is no range."""
    a = F.regexp_extract(_c(x), r"(\d+)\s*[-–]\s*(\d+)", 1)
    b = F.regexp_extract(_c(x), r"(\d+)\s*[-–]\s*(\d+)", 2)
    return F.when(a != "", b.cast("int") - a.cast("int") + 1)


def is_correction_notice(x: Column | str) -> Column:
    return F.lower(_c(x)).rlike(r"\(vol\.? *\d+, *(pg|pp|p)\.? *\d+.*\d{4}\)")


def excluded_title(x: Column | str) -> Column:
    """Titles of notices rather than papers, at their beginning."""
    return F.lower(F.trim(_c(x))).rlike(r"^(erratum|corrigendum|correction|editorial|rejoinder|comment on|book review)\b")


def part_marker(x: Column | str) -> Column:
    """The part a title names, '' where none."""
    return F.lower(F.regexp_extract(_c(x), r"(?i)\bpart\s+([ivx]+|\d+)\b", 1))


def prefix_of(short: Column | str, long: Column | str) -> Column:
    """Whether the first is the beginning of the second at a word's end."""
    return _c(long).startswith(F.concat(_c(short), F.lit(" ")))


def jaccard(a: Column, b: Column) -> Column:
    """Share of two arrays' distinct elements that both hold; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def csv_safe(x: Column | str) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(_c(x).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), _c(x))).otherwise(_c(x))


def safe_url(x: Column | str) -> Column:
    return F.when(F.lower(F.trim(_c(x))).rlike("^https?://"), F.trim(_c(x)))


def html_escape(x: Column | str) -> Column:
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


_TAG = re.compile(r"<[^<>]+>")
_SPACE = re.compile(r"\s+")
_BEFORE = re.compile(r"\s+([,.;:!?])")


def clean_text(value: str | None) -> str | None:
    """Entities decoded until stable (five times at most), tags out, blanks single, none before punctuation."""
    if value is None:
        return None
    for _ in range(5):
        new = html.unescape(value)
        if new == value:
            break
        value = new
    value = _SPACE.sub(" ", _TAG.sub(" ", value)).strip()
    return _BEFORE.sub(r"\1", value)


@F.pandas_udf(StringType())
def clean_html(texts: pd.Series) -> pd.Series:
    return texts.map(clean_text, na_action="ignore")


@F.pandas_udf(StringType())
def normal_form(texts: pd.Series) -> pd.Series:
    """Compatibility form NFKC."""
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


def undo_utf8_as_cp1252(value: str) -> str:
    """UTF-8 that was read as Windows-1252, only where that is exactly reversible; else the value itself."""
    try:
        return value.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return value


@F.pandas_udf(StringType())
def reversible_repair(texts: pd.Series) -> pd.Series:
    return texts.map(undo_utf8_as_cp1252, na_action="ignore")
