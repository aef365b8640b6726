"""Visually identical text with different characters, brought to one form by DuckDB inside Arrow partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cyrillic and Greek letters and the Latin ones they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝѵҮ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxhdqwvY"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXovcj"
#: Spaces of other widths; characters without a width.
SPACES = "               　"
INVISIBLE = "­͏؜᠎​‎‏‪-‮⁠-⁤⁦-⁩﻿"
#: Typographic ligatures.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_WIDE_AS = "".join(map(chr, range(0x21, 0x7F)))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    """One SELECT: invisible characters out, spaces, full-width forms, ligatures, composition, then scripts by word."""
    x = "text"
    x = f"regexp_replace({x}, '[{INVISIBLE}]', '', 'g')"
    for _ in range(2):  # joiners are as meant in scripts that shape with them
        x = f"regexp_replace({x}, '(^|[^؀-࿿က-႟])[‌‍]+', '\\1', 'g')"
    x = f"translate({x}, {_quote(SPACES)}, {_quote(' ' * len(SPACES))})"
    east = "regexp_matches(text, '[⺀-鿿가-힯]') AND NOT regexp_matches(text, '[０-９Ａ-Ｚａ-ｚ]')"
    x = f"CASE WHEN {east} THEN {x} ELSE translate({x}, {_quote(_WIDE)}, {_quote(_WIDE_AS)}) END"
    for a, b in LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"nfc_normalize({x})"
    latin = f"translate(w, {_quote(CYRILLIC + GREEK)}, {_quote(CYRILLIC_AS + GREEK_AS)})"
    back = f"translate(w, {_quote(CYRILLIC_AS)}, {_quote(CYRILLIC)})"
    word = f"""CASE
        WHEN NOT regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN w
        WHEN regexp_matches(w, '\\p{{Latin}}') THEN CASE
            WHEN regexp_matches({latin}, '\\p{{Cyrillic}}') AND NOT regexp_matches({back}, '\\p{{Latin}}') THEN {back}
            ELSE {latin} END
        WHEN foreign_words OR regexp_matches({latin}, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN w
        ELSE {latin} END"""
    return f"""
    WITH a AS (SELECT record_id, text, {x} AS s FROM batch),
    b AS (SELECT *, regexp_matches(translate(s, {_quote(CYRILLIC + GREEK)}, ''), '[\\p{{Cyrillic}}\\p{{Greek}}]{{2,}}') AS foreign_words FROM a),
    c AS (SELECT record_id, text, CASE WHEN regexp_matches(s, '[\\p{{Cyrillic}}\\p{{Greek}}]')
        THEN nfc_normalize(array_to_string(list_transform(regexp_extract_all(s, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {word}), '')) ELSE s END AS form FROM b)
    SELECT record_id, text AS original, form, form <> text AS is_case FROM c"""


def consistent_form(df: DataFrame, key: str, column: str) -> DataFrame:
    """(record_id, original, form, is_case) for every row with a text; is_case: the form differs.

    Equal-looking texts have the same form. Invisible characters go (joiners stay in scripts that shape
    with them), spaces of other widths become blanks, full-width ASCII becomes ASCII (full-width
    punctuation in East Asian text without full-width letters stays), ligatures are spelled out, accents
    are composed, and look-alike Cyrillic or Greek letters become Latin in words with Latin letters or
    made of look-alikes alone in a text without words of those scripts. Superscripts, fractions,
    mathematical letters, typographic quotes and dashes stay. All-ASCII rows keep their text and never
    reach Python. Nulls give no row, blank texts and repeated rows are kept, texts are handled whole.
    """
    slim = df.select(F.col(key).cast("bigint").alias("record_id"), F.col(column).cast("string").alias("text")).where(F.col("text").isNotNull())
    odd = F.col("text").rlike(r"[^\x00-\x7f]")
    plain = slim.where(~odd).select("record_id", F.col("text").alias("original"), F.col("text").alias("form"), F.lit(False).alias("is_case"))
    return plain.unionByName(_odd_form(slim.where(odd)))


def _odd_form(slim: DataFrame) -> DataFrame:
    sql = _sql()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            got = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            yield from got.to_batches()
        con.close()

    return slim.mapInArrow(run, "record_id bigint, original string, form string, is_case boolean")


def lookalikes(df: DataFrame, key: str, column: str) -> DataFrame:
    """consistent_form's rows whose text isn't in the form already."""
    slim = df.select(F.col(key).cast("bigint").alias("record_id"), F.col(column).cast("string").alias("text"))
    return _odd_form(slim.where(F.col("text").rlike(r"[^\x00-\x7f]"))).where("is_case").drop("is_case")
