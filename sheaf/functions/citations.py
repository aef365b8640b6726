"""Citations as free text, parsed into fields; what isn't certain stays empty and is marked."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBERING = re.compile(r"^\s*(?:\[\d+\]|\(?\d{1,3}[.)])\s*")
_YEAR = re.compile(r"\(?\b((?:19|20)\d{2})[a-z]?\b\)?")
_DOI = re.compile(r"\b10\.\d{4,9}/[^\s\"<>]+")
_QUOTED = re.compile(r"[\"“‘']([^\"”’]{8,}?)[,.]?[\"”’']")
_VOLUME = re.compile(r"\b(\d{1,4})\s*(?:\((\d+)\))?\s*[,:]\s*(?:pp?\.?\s*)?(\d+)\s*[-–]\s*(\d+)")
_OPEN = re.compile(r"\b(forthcoming|in press|under review|submitted|working paper)\b", re.I)
_FIELDS = ["title", "journal", "year", "doi", "authors", "volume", "issue", "pages", "status", "confident"]


def parse_citation(text: str | None, latest: int = 2100) -> tuple | None:
    """(title, journal, year, doi, authors, volume, issue, pages, status, confident) of one entry.

    Forms: authors (year) title. journal, volume(issue), pages, with the title in quotes or up to the first
    full stop after the year. confident: title, year and journal were all found.
    """
    if not text or not text.strip():
        return None
    s = " ".join(_NUMBERING.sub("", text).split())
    doi = m.group(0).rstrip(".,;)").lower() if (m := _DOI.search(s)) else None
    s = re.sub(r"https?://\S+|doi:\s*\S+", "", _DOI.sub("", s), flags=re.I).strip()
    status = m.group(1).lower() if (m := _OPEN.search(s)) else "published"
    title = journal = volume = issue = pages = authors = None
    quoted = _QUOTED.search(s)
    span = quoted.span() if quoted else (0, 0)
    years = [m for m in _YEAR.finditer(s) if not span[0] <= m.start() < span[1] and 1950 <= int(m.group(1)) <= latest]
    year = years[0] if years else None
    if quoted:
        title, rest, authors = quoted.group(1), s[quoted.end() :], s[: quoted.start()]
    elif year:
        authors, tail = s[: year.start()], s[year.end() :].lstrip(").,: ")
        head, dot, rest = tail.partition(". ")
        title = head if dot else tail.rstrip(".")
        rest = rest if dot else ""
    else:
        rest = ""
    if m := _VOLUME.search(rest):
        volume, issue, pages = m.group(1), m.group(2), f"{m.group(3)}-{m.group(4)}"
        journal = rest[: m.start()]
    else:
        journal = rest
    journal = re.sub(r"\(?\b(?:19|20)\d{2}\b\)?|\b(?:vol|no|pp)\.?$|\bforthcoming\b|\bin press\b", "", journal or "", flags=re.I).strip(" .,;:()") or None
    authors = re.sub(r"\(?\b(?:19|20)\d{2}[a-z]?\b\)?", "", authors or "").strip(" .,;:(") or None
    return title, journal, int(year.group(1)) if year else None, doi, authors, volume, issue, pages, status, bool(title and journal and year)


def citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per citation; unparsed ones have confident false and go to review."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(k, *p) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (p := parse_citation(t))]
            cols = list(zip(*got)) if got else [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, *kinds])], ["key", *_FIELDS])

    schema = f"key {df.schema[key].dataType.simpleString()}, title string, journal string, year int, doi string, authors string, volume string, issue string, pages string, status string, confident boolean"
    return df.select(F.col(key).alias("key"), text).where(F.col(text).isNotNull()).mapInArrow(run, schema)
