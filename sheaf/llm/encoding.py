"""Garbled text from wrong character encoding, found and undone by a hidden Markov model.

States: one clean state and one state per encoding pair (the bytes' real encoding, the one they were
read in; twice-garbled text has pairs of its own), and a state for characters that no encoding gives
back (U+FFFD, C1 controls). Observations: the characters of a text. A pair's state emits a character
only as part of a unit that its inverse transform can undo, with the probability that the *undone*
characters have in clean text; the clean state emits it with the probability it has there as it is.
Those probabilities are trigram counts (left neighbour, character, right neighbour) over all texts.
The Viterbi path labels every character, and each labelled span gets its state's inverse transform.

ASCII characters have the same emission in every state, so the path is computed over the non-ASCII
characters and units; runs of ASCII only add the cost of staying.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte encodings that texts are read in by mistake.
READ_AS = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp1253", "cp1254", "cp1257", "koi8_r", "iso8859_2", "iso8859_15")
#: Double-byte encodings that UTF-8 is read in by mistake.
READ_AS_WIDE = ("gbk", "big5", "cp932", "cp949")
#: Single-byte pairs (real encoding, read in).
NARROW = (
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp1253"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
)

LOST = "lost"
_ENTER, _LEAVE = math.log(0.08), math.log(0.05)
#: A text's own occurrence is mostly left out of the counts it is judged by.
_OWN = 0.7
_FLOOR = 1e-7
#: Cost of a symbol that stands for many characters.
_MANY = math.log(200)


@lru_cache(maxsize=None)
def _byte_of(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes without a character stand for themselves as C1 controls, as lenient readers do."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


def symbol(c: str) -> str:
    """A neighbour in a trigram: ASCII as it is, digits and blanks as one each, others by script and case."""
    if c < "\x80":
        return "0" if c.isdigit() else " " if c.isspace() else c
    if c.isspace():
        return " "
    return "^" + _block(c)


@lru_cache(maxsize=65536)
def _block(c: str) -> str:
    cat = unicodedata.category(c)
    if cat[0] in "LM":
        name = unicodedata.name(c, "?").split(" ", 1)[0]
        return name[:6] + cat
    return cat


def _small(s: str) -> bool:
    return s[-2:] == "Ll" if s[:1] == "^" else s.islower()


def _lower(s: str) -> str:
    return s[:-1] + "l" if s[:1] == "^" and s[-2:] == "Lu" else s.lower()


def centre(c: str) -> str:
    """A trigram's middle: the character, but one symbol for each script beyond the alphabetic ones."""
    return c if c < "؀" or "Ḁ" <= c < "⺀" or c == "�" else "^" + _block(c)


def trigrams(text: str) -> Iterator[tuple[str, str, str]]:
    last = len(text) - 1
    for i, c in enumerate(text):
        if c >= "\x80":
            yield symbol(text[i - 1]) if i else "", centre(c), symbol(text[i + 1]) if i < last else ""


class Clean:
    """Smoothed trigram scores of clean text: the count, plus part of what its two halves let expect."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.n3 = counts
        self.left: Counter = Counter()
        self.right: Counter = Counter()
        self.one: Counter = Counter()
        for (a, c, b), n in counts.items():
            self.left[a, c] += n
            self.right[c, b] += n
            self.one[c] += n
        self.base = math.log(max(sum(self.one.values()), 1))
        self.memo: dict[tuple[str, str, str], float] = {}
        self.memo_own: dict[tuple[str, str, str], float] = {}
        self.runs: dict[str, tuple[str, ...]] = {}
        self.paths: dict[str, list[tuple[int, int, str, str]]] = {}

    def score(self, key: tuple[str, str, str], own: bool = False) -> float:
        """own: the key's occurrence in the very text that is judged is among the counts."""
        memo = self.memo_own if own else self.memo
        got = memo.get(key)
        if got is None:
            a, c, b = key
            less = _OWN if own else 0.0
            one = max(self.one.get(c, 0) - less, 0.0)
            n = max(self.n3.get(key, 0) - less, 0.0) + (0.0 if c[0] == "^" else 1e-4 * one) + _FLOOR
            if one:
                n += 0.3 * max(self.left.get((a, c), 0) - less, 0.0) * max(self.right.get((c, b), 0) - less, 0.0) / one
            if c.isupper() and not _small(a) and not _small(b):
                n += 0.1 * self.n3.get((_lower(a), c.lower(), _lower(b)), 0)
            got = memo[key] = math.log(n) - self.base - (_MANY if c[0] == "^" else 0.0)
        return got


_LATEST: list[Clean] = []


def clean_of(counts: dict[tuple[str, str, str], int]) -> Clean:
    """The model of these counts; a worker that goes on with the same broadcast keeps its model and what that remembers."""
    if not _LATEST or _LATEST[0].n3 is not counts:
        _LATEST[:] = [Clean(counts)]
    return _LATEST[0]


def _utf8_units(codes: list[int | None], size: list[int]) -> list[tuple[int, int, str]]:
    """(start, end, character) of valid UTF-8 sequences in a list of bytes (None: no byte)."""
    out, i, n = [], 0, len(codes)
    while i < n:
        b = codes[i]
        if b is None or b < 0xC2 or b > 0xF4:
            i += 1
            continue
        need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        part = codes[i : i + need]
        if len(part) == need and all(x is not None and 0x80 <= x < 0xC0 for x in part[1:]):
            try:
                out.append((size[i], size[i + need - 1] + 1, bytes(part).decode("utf-8")))
                i += need
                continue
            except UnicodeDecodeError:
                pass
        i += 1
    return out


def _apply(text: str, units: list[tuple[int, int, str]]) -> tuple[str, list[int]]:
    """The text with its units undone, and for each new character the place of the first old one."""
    new, where, at = [], [], 0
    for s, e, c in units:
        new.append(text[at:s])
        where += range(at, s)
        new.append(c)
        where += [s] * len(c)
        at = e
    new.append(text[at:])
    where += range(at, len(text) + 1)
    return "".join(new), where


def _single(text: str, encoding: str) -> list[tuple[int, int, str]]:
    table = _byte_of(encoding)
    codes = [None if c < "\x80" else table.get(c) for c in text]
    return _utf8_units(codes, list(range(len(text))))


def _twice(text: str, inner: str, outer: str) -> list[tuple[int, int, str]]:
    """Units of text garbled through inner and then outer: undone from the outside in."""
    first = _single(text, outer)
    if not first:
        return []
    mid, where = _apply(text, first)
    out = []
    for s, e, c in _single(mid, inner):
        out.append((where[s], where[e], c))
    return out


def _wide(text: str, encoding: str) -> list[tuple[int, int, str]]:
    """Units are runs of characters whose double bytes are UTF-8; the last may have swallowed an ASCII one."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i] < " ":
            i += 1
            continue
        j = i
        while j < n and text[j] >= " ":
            j += 1
        run = text[i:j]
        try:
            undone = run.encode(encoding).decode("utf-8")
            if undone and not all("⺀" <= c <= "퟿" for c in undone):
                out.append((i, j, undone))
        except UnicodeError:
            pass
        i = j
    return out


#: Ranges of letters, signs and punctuation whose remains are known when bytes were dropped.
_REMAINS = ((0xA0, 0x180), (0x391, 0x3CA), (0x410, 0x452), (0x2010, 0x2027), (0x20AC, 0x20AD), (0x2122, 0x2123), (0x2212, 0x2213))


@lru_cache(maxsize=None)
def _stripped(encoding: str) -> dict[str, str]:
    """What is left of a UTF-8 unit whose undefined bytes (C1 controls) were dropped -> the characters it may have been."""
    out: dict[str, list[str]] = {}
    char_of = {b: c for c, b in _byte_of(encoding).items()}
    for lo, hi in _REMAINS:
        for point in range(lo, hi):
            raw = [char_of[b] for b in chr(point).encode("utf-8")]
            left = "".join(c for c in raw if not "\x80" <= c <= "\x9f")
            if left and len(left) < len(raw):
                out.setdefault(left, []).append(chr(point))
    return {k: "".join(v) for k, v in out.items()}


def _remains(text: str, encoding: str) -> list[tuple[int, int, str]]:
    """Complete units of the encoding, and where there are none what dropped bytes left; several characters: a choice."""
    table, out, i, n = _stripped(encoding), [], 0, len(text)
    whole = {s: (e, c) for s, e, c in _single(text, encoding)}
    while i < n:
        if i in whole:
            out.append((i, *whole[i]))
            i = whole[i][0]
            continue
        for j in (i + 2, i + 1):
            if j <= n and (u := table.get(text[i:j])):
                out.append((i, j, u))
                i = j
                break
        else:
            i += 1
    return out


@lru_cache(maxsize=1)
def _narrow_tables() -> list[tuple[str, dict[str, str]]]:
    out = []
    for real, read in NARROW:
        table = {}
        for c, b in _byte_of(read).items():
            try:
                d = bytes([b]).decode(real)
            except UnicodeDecodeError:
                continue
            if d != c and d >= "\x80":
                table[c] = d
        out.append((f"{real}>{read}", table))
    return out


@lru_cache(maxsize=1)
def _states_by_char() -> dict[str, tuple[str, ...]]:
    """First character of a unit -> the states it may belong to."""
    by: dict[str, set[str]] = {}
    for e in READ_AS:
        firsts = {c for c, b in _byte_of(e).items() if 0xC2 <= b <= 0xF4} | {k[0] for k in _stripped(e)}
        for c in firsts:
            by.setdefault(c, set()).add(f"utf_8>{e}")
    for a in ("cp1252", "latin_1"):
        for b in ("cp1252", "latin_1"):
            for c, byte in _byte_of(b).items():
                if 0xC2 <= byte <= 0xF4:
                    by.setdefault(c, set()).add(f"utf_8>{a}>utf_8>{b}")
    for name, table in _narrow_tables():
        for c in table:
            by.setdefault(c, set()).add(name)
    return {c: tuple(v) for c, v in by.items()}


_WIDE_STATES = tuple(f"utf_8>{e}" for e in READ_AS_WIDE)
_RANK = {
    s: i
    for i, s in enumerate(
        [*(f"utf_8>{e}" for e in READ_AS), *(f"utf_8>{a}>utf_8>{b}" for a in ("cp1252", "latin_1") for b in ("cp1252", "latin_1")), *_WIDE_STATES, *(f"{a}>{b}" for a, b in NARROW)]
    )
}


def _possible(text: str) -> set[str]:
    by, states = _states_by_char(), set()
    for c in text:
        if c >= "\x80":
            states.update(by.get(c, ()))
            if c >= "⺀":
                states.update(_WIDE_STATES)
    return states


def candidates(text: str, states: set[str]) -> dict[str, list[tuple[int, int, str]]]:
    """State -> units of the text that it can undo."""
    found: dict[str, list[tuple[int, int, str]]] = {}
    narrow = dict(_narrow_tables())
    for state in sorted(states, key=_RANK.__getitem__):
        if state in narrow:
            table = narrow[state]
            units = [(i, i + 1, table[c]) for i, c in enumerate(text) if c in table]
        else:
            path = state.split(">")
            if len(path) == 4:
                units = _twice(text, path[1], path[3])
            elif path[1] in READ_AS_WIDE:
                units = _wide(text, path[1])
            else:
                units = _remains(text, path[1])
        if units:
            found[state] = units
    return found


def _lost(c: str) -> bool:
    return c == "�" or "\x80" <= c <= "\x9f"


def gains(text: str, clean: Clean, states: set[str]) -> tuple[dict[int, float], dict[str, dict[int, tuple[int, str, float]]]]:
    """Clean scores of the non-ASCII characters; state -> start -> (end, undone, score against the clean state)."""
    base = {i: clean.score(k, True) for i, k in zip((i for i, c in enumerate(text) if c >= "\x80"), trigrams(text))}
    gain: dict[str, dict[int, tuple[int, str, float]]] = {}
    for state, units in candidates(text, states).items():
        one = {}
        choice = state[6:] not in READ_AS_WIDE
        plain = [(s, e, u[0]) for s, e, u in units] if choice else units
        undone, where = _apply(text, plain)
        back: dict[int, int] = {}
        for j, w in enumerate(where):
            back.setdefault(w, j)
        for (s, e, u), (_, _, p) in zip(units, plain):
            j = back[s]
            left = symbol(undone[j - 1]) if j else ""
            best, pick = -1e9, u
            for option in u if choice else (u,):
                got, last = 0.0, left
                for k, c in enumerate(option):
                    right = option[k + 1] if k + 1 < len(option) else undone[j + len(p)] if j + len(p) < len(undone) else ""
                    if c >= "\x80":
                        got += clean.score((last, centre(c), symbol(right) if right else ""))
                    last = symbol(c)
                if got > best:
                    best, pick = got, option
            diff = best - sum(base.get(i, 0.0) for i in range(s, e))
            one[s] = (e, pick, diff)
        if any(v[2] > 0 for v in one.values()):
            gain[state] = one
    return base, gain


_RUN = re.compile("(?:^|[\x00-\x7f])[^\x00-\x7f]+(?:[\x00-\x7f]|$)")


def suspects(text: str, clean: Clean) -> set[str]:
    """The states in which some unit of the text is likelier undone than as it is, seen alone; runs are remembered.

    Units lie within runs of non-ASCII characters and are scored with one neighbour on each side, so a
    text without such a run has the clean path as its best one.
    """
    memo, at, found = clean.runs, 0, set()
    while m := _RUN.search(text, at):
        run = m.group(0)
        got = memo.get(run)
        if got is None:
            if len(memo) > 200_000:
                memo.clear()
            got = memo[run] = (*gains(run, clean, _possible(run))[1], *([LOST] if any(map(_lost, run)) else []))
        found.update(got)
        at = m.end() - 1 if run[-1] < "\x80" else m.end()
    return found


def label(text: str, clean: Clean) -> list[tuple[int, int, str, str]]:
    """Viterbi: (start, end, state, undone text) of every span that is not clean."""
    states = suspects(text, clean)
    if not states:
        return []
    short, places = _compact(text)
    spans = clean.paths.get(short)
    if spans is None:
        if len(clean.paths) > 100_000:
            clean.paths.clear()
        spans = clean.paths[short] = _viterbi(short, clean, states - {LOST})
    return [(places[s], places[e - 1] + 1, state, undone) for s, e, state, undone in spans]


_INSIDE = re.compile("^[\x00-\x7f]+(?=[\x00-\x7f])|(?<=[\x00-\x7f])[\x00-\x7f]+(?=[\x00-\x7f]|$)")


def _compact(text: str) -> tuple[str, list[int]]:
    """The text without its ASCII characters that touch no other, which every state emits alike, and the old places."""
    parts, places, at = [], [], 0
    for m in _INSIDE.finditer(text):
        parts.append(text[at : m.start()])
        places += range(at, m.start())
        at = m.end()
    parts.append(text[at:])
    places += range(at, len(text))
    return "".join(parts), places


def _viterbi(text: str, clean: Clean, states: set[str]) -> list[tuple[int, int, str, str]]:
    n = len(text)
    base, gain = gains(text, clean, states)
    spots = list(base)
    lost = {i for i in spots if _lost(text[i])}
    if not gain and not lost:
        return []
    names = ["", *gain, *([LOST] if lost else [])]
    score = {s: (0.0 if not s else _ENTER) for s in names}
    trail: dict[str, tuple] = {s: () for s in names}
    #: place -> scores of paths that end exactly there
    stops = sorted({0, n, *spots, *(i + 1 for i in spots), *(v[0] for one in gain.values() for v in one.values())})
    best: dict[int, dict[str, tuple[float, tuple]]] = {0: {s: (score[s], trail[s]) for s in names}}

    def arrive(at: int, state: str, value: float, path: tuple) -> None:
        row = best.setdefault(at, {})
        if state not in row or row[state][0] < value:
            row[state] = (value, path)

    for a, nxt in zip(stops, [*stops[1:], None]):
        row = best.get(a)
        if row is None:
            continue
        top = max(row.items(), key=lambda x: x[1][0])
        for s in names:  # change of state between two characters
            change = top[1][0] + (_LEAVE if not s else _ENTER + (_LEAVE if top[0] else 0.0)) if s != top[0] else None
            if change is not None and (s not in row or row[s][0] < change):
                row[s] = (change, top[1][1])
        if nxt is None:
            break
        for s, (value, path) in row.items():
            if a not in base:  # ASCII: the same in every state
                arrive(nxt, s, value, path)
                continue
            if not s:
                arrive(a + 1, s, value + (-30.0 if a in lost else 0.0), path)
            elif s == LOST:
                arrive(a + 1, s, value + (0.0 if a in lost else -8.0), (path, (a, a + 1, LOST, "")) if a in lost else path)
            elif a in gain[s]:
                e, undone, diff = gain[s][a]
                arrive(e, s, value + diff, (path, (a, e, s, undone)))
            else:
                arrive(a + 1, s, value - 4.0, path)
    end = best[n]
    _, path = max(end.values(), key=lambda x: x[0])
    spans = []
    while path:
        path, span = path
        spans.append(span)
    return spans[::-1]


def restore(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """Every span undone by its state; lost characters become U+FFFD."""
    return _apply(text, [(s, e, u if state != LOST else "�") for s, e, state, u in spans])[0]


_DIFFER = r"[^\x00-\x7f]"


def clean_counts(texts: DataFrame, column: str) -> dict[tuple[str, str, str], int]:
    """Trigram counts over all texts, added up per partition and then by key.

    The result is bounded by the alphabet (characters below U+2E80 and one symbol per further script,
    between two neighbours of some 150 symbols), not by the number of texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(trigrams(text))
        keys = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([n[k] for k in keys], pa.int64())], ["a", "c", "b", "n"]
        )

    got = texts.select(column).where(F.col(column).rlike(_DIFFER)).mapInArrow(count, "a string, c string, b string, n bigint")
    rows = got.groupBy("a", "c", "b").agg(F.sum("n").alias("n")).toArrow()
    cols = [rows.column(i).to_pylist() for i in range(4)]
    return {(a, c, b): n for a, c, b, n in zip(*cols)}


def garbled(df: DataFrame, key: str, column: str, counts: dict[tuple[str, str, str], int] | None = None) -> DataFrame:
    """(record_id, original, restored, states) of the rows whose text is garbled.

    counts: see clean_counts; by default counted over this column. restored has U+FFFD where the text
    can't be had back. Nulls, blank and all-ASCII texts are never garbled; very long texts are handled
    whole; repeated rows are reported each time; other columns are not read; an empty table gives none.
    """
    spark = df.sparkSession
    slim = df.select(F.col(key).cast("bigint").alias("record_id"), F.col(column).cast("string").alias("original"))
    slim = slim.where(F.col("original").rlike(_DIFFER))
    shared = spark.sparkContext.broadcast(clean_counts(slim, "original") if counts is None else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = clean_of(shared.value)
        for batch in batches:
            ids, old, new, states = [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = label(text, clean)
                if spans:
                    ids.append(k)
                    old.append(text)
                    new.append(restore(text, spans))
                    states.append(",".join(dict.fromkeys(s[2] for s in spans)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (old, new, states))], ["record_id", "original", "restored", "states"])

    return slim.mapInArrow(run, "record_id bigint, original string, restored string, states string")


def ungarbled(df: DataFrame, key: str, column: str, counts: dict[tuple[str, str, str], int]) -> DataFrame:
    """(record_id, original) of the rows with non-ASCII characters whose text is not garbled."""
    slim = df.select(F.col(key).cast("bigint").alias("record_id"), F.col(column).cast("string").alias("original")).where(F.col("original").rlike(_DIFFER))
    shared = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = clean_of(shared.value)
        for batch in batches:
            keep = pa.array([not label(t, clean) for t in batch.column(1).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return slim.mapInArrow(run, "record_id bigint, original string")
