"""Sequence similarity, which Spark has no expression for."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Words without weight in title containment.
STOP = frozenset("a an and as at by for from in of on or the to with its into".split())


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp ratio of a against b; 0 where the lengths alone keep it under least. Not symmetric."""
    if a == b:
        return 1.0
    total = len(a) + len(b)
    if not total or 2 * min(len(a), len(b)) / total < least:
        return 0.0
    m = SequenceMatcher(None, a, b)
    if least and m.quick_ratio() < least:
        return 0.0
    return m.ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _content(title: str) -> list[str]:
    return [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in title.lower().split() if w not in STOP]


def containment(a: str, b: str) -> float:
    """Share of the shorter title's content words that the longer one holds, with typing errors."""
    x, y = sorted((_content(a), _content(b)), key=len)
    if not x:
        return 0.0
    return sum(any(w == v or ratio(w, v, 0.85) >= 0.85 for v in y) for w in x) / len(x)


@F.pandas_udf(DoubleType())
def title_containment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else containment(x, y) for x, y in zip(a, b)], dtype="float64")
