"""A parsing expression grammar for fields that pack several values into one string.

    Field     <- Bracketed / Strong / Quotes / Strong' / Quotes' / Listed       the first two without Broken, the others with it
    Bracketed <- WS '[' (Quoted / BareIn) (WS ',' WS (Quoted / BareIn))* WS ']' WS !.
    Strong    <- Elem (STRONG Elem)+ !.          STRONG: ';' '|' newline, or '/' between blanks; two elements or more aren't empty
    Quotes    <- Elem (',' Elem)* !.             one element or more is Quoted
    Listed    <- People / Labels
    Elem      <- Quoted / Broken / Bare / nothing
    Quoted    <- WS '"' ('""' / '\\' any / [^"])* '"' WS &(separator / end)
    Broken    <- Bare                            with an odd quote: each quote is an ordinary character
    Bare      <- (!separator .)*
    People    <- Chunk (AND Chunk)*              AND: 'and' or '&' between blanks
    Chunk     <- Names / Pairs
    Names     <- Name (',' Name)* !.             every name holds a blank
    Pairs     <- Pair (',' Pair)* !.             Pair <- Bare (',' Bare)? (',' SUFFIX)*
    Labels    <- Label (',' Label)* !.           Label <- Bare (',' Bare-with-'and')?

Alternatives are tried in order and a failing one backtracks, locally: an opening quote that finds no closing quote
before a separator is read again as an ordinary character of its element. Elements come with their place and a flag:
EMPTY_ELEMENT and ET_AL stand for elements without a value, MALFORMED_QUOTE for a value with a broken quote (and, as it
never ends, for what follows an opening quote without any closing one).
"""

from __future__ import annotations

import re

OK, EMPTY_ELEMENT, MALFORMED_QUOTE, ET_AL = "", "EMPTY_ELEMENT", "MALFORMED_QUOTE", "ET_AL"

_QUOTED = re.compile(r'[^\S\n\r]*"((?:""|\\.|[^"\\])*)"[^\S\n\r]*', re.S)
_UNESCAPE = re.compile(r'""|\\(.)', re.S)
_STRONG = re.compile(r"[;|\n\r]|(?<=\s)/(?=\s)")
_COMMA = re.compile(",")
_BARE_IN = re.compile(r'[^,"]*')
_ET_AL = re.compile(r"[\s,;|/]*\bet\.?\s*al\b\.?\s*$", re.I)
_AND = re.compile(r"\s*,?\s+(?:and|&)\s+|\s*,\s*&\s*", re.I)
_INITIALS = re.compile(r"(?:[^\W\d_]\.?[\s-]*){1,5}$")
_SUFFIX = re.compile(r"(?:[JS]r\.?|II|III|IV)$")

#: (value, quoted, flag, start, stop) of an element.
Element = tuple[str, bool, str, int, int]


def _unquote(body: str) -> str:
    return _UNESCAPE.sub(lambda m: m.group(1) if m.group(1) is not None else '"', body).strip()


def _bracketed(s: str) -> list[Element] | None:
    t = s.strip()
    if not (t.startswith("[") and t.endswith("]")):
        return None
    pos, end, out = 1, len(t) - 1, []
    while pos <= end:
        m = _QUOTED.match(t, pos, end)
        if m and (m.end() == end or t[m.end()] == ","):
            out.append((_unquote(m.group(1)), True, OK, pos, m.end()))
            pos = m.end()
        else:
            m = _BARE_IN.match(t, pos, end)
            if m.end() != end and t[m.end()] != ",":
                return None
            out.append((m.group(0).strip(), False, OK, pos, m.end()))
            pos = m.end()
        if pos == end:
            return out
        pos += 1
    return out


def _sequence(s: str, pos: int, end: int, sep: re.Pattern, quotes: bool) -> list[Element]:
    """Elem (sep Elem)* from pos to end; it never fails, as Bare takes what Quoted can't."""
    out: list[Element] = []
    search = sep.search
    if not quotes:
        while m := search(s, pos, end):
            out.append((s[pos : m.start()].strip(), False, OK, pos, m.start()))
            pos = m.end()
        out.append((s[pos:end].strip(), False, OK, pos, end))
        return out
    endless = False
    while True:
        m = _QUOTED.match(s, pos, end)
        after = sep.match(s, m.end(), end) if m and m.end() < end else None
        if m and (after or m.end() == end):
            out.append((_unquote(m.group(1)), True, OK, pos, m.end()))
        else:
            after = search(s, pos, end)
            stop = after.start() if after else end
            value = s[pos:stop].strip()
            odd = value.count('"') % 2 == 1
            endless = endless or (odd and value[0] == '"' and s.find('"', s.index('"', pos) + 1, end) < 0)
            out.append((value, False, MALFORMED_QUOTE if odd or endless else OK, pos, stop))
        if after is None:
            return out
        pos = after.end()


def _joined(a: Element, b: Element) -> Element:
    return f"{a[0]}, {b[0]}", False, a[2] or b[2], a[3], b[4]


def _names(pieces: list[Element]) -> list[Element] | None:
    """Names that stand alone, as 'Given Family'; fails where one holds no blank."""
    full = [p for p in pieces if p[0]]
    if not all(" " in p[0] or "\xa0" in p[0] for p in full):
        return None
    if len(full) == 2 and full[0][0][:1].islower() and _INITIALS.match(full[1][0]):
        return None
    return pieces


def _pairs(pieces: list[Element]) -> list[Element]:
    """'Family, Given' pairs, each with the suffix that may follow."""
    out: list[Element] = []
    last, half = -1, False
    for p in pieces:
        if not p[0]:
            out.append(p)
        elif half or last >= 0 and _SUFFIX.match(p[0]):
            out[last] = _joined(out[last], p)
            half = False
        else:
            last, half = len(out), True
            out.append(p)
    return out


def _people(s: str, pos: int, end: int, quotes: bool) -> list[Element]:
    out: list[Element] = []
    while True:
        m = _AND.search(s, pos, end)
        pieces = _sequence(s, pos, m.start() if m else end, _COMMA, False)
        if quotes:
            pieces = [(v, q, MALFORMED_QUOTE if v.count('"') % 2 else f, a, z) for v, q, f, a, z in pieces]
        if m and len(pieces) > 1 and not pieces[-1][0]:  # a comma before 'and' ends no element
            pieces.pop()
        got = _names(pieces)
        out += _pairs(pieces) if got is None else got
        if not m:
            return out
        pos = m.end()


def _labels(s: str, pos: int, end: int, quotes: bool) -> list[Element]:
    """A label 'X, Y and Z' keeps its comma: only ')' or a plain word ends one."""
    out: list[Element] = []
    for p in _sequence(s, pos, end, _COMMA, False):
        if quotes and p[0].count('"') % 2:
            p = (p[0], False, MALFORMED_QUOTE, p[3], p[4])
        if out and out[-1][0] and not out[-1][0].endswith(")") and " and " in p[0] and " and " not in out[-1][0]:
            out[-1] = _joined(out[-1], p)
        else:
            out.append(p)
    return out


def _loose(elements: list[Element]) -> bool:
    """Whether an element that isn't quoted holds a quote: then other alternatives come first."""
    return any('"' in e[0] for e in elements if not e[1])


def _field(s: str, end: int, people: bool) -> list[Element]:
    if "[" in s and (got := _bracketed(s[:end])) is not None:
        return _conjoined(got) if people else got
    quotes = '"' in s
    got = _sequence(s, 0, end, _STRONG, quotes)
    if quotes and _loose(got):  # a separator may stand within a quoted element of the next alternative
        quoted = _sequence(s, 0, end, _COMMA, True)
        if not _loose(quoted):
            return _conjoined(quoted) if people else quoted
    full = [e for e in got if e[0]]
    if len(full) > 1 or (full and full[0][1]):
        return _conjoined(got) if people else got
    if not full:
        return got
    _, _, _, a, z = full[0]
    if quotes:
        within = _sequence(s, a, z, _COMMA, True)
        if not any(e[1] for e in within):
            within = _people(s, a, z, True) if people else _labels(s, a, z, True)
        elif people:
            within = _conjoined(within)
    else:
        within = _people(s, a, z, False) if people else _labels(s, a, z, False)
    if len(got) == 1:
        return within
    at = next(i for i, e in enumerate(got) if e[0])
    return got[:at] + within + got[at + 1 :]


def _conjoined(elements: list[Element]) -> list[Element]:
    """Elements that 'and' or '&' parts into several, unless they are quoted."""
    out: list[Element] = []
    for e in elements:
        v, quoted, flag, a, z = e
        if quoted or not (" & " in v or " and " in v):
            out.append(e)
            continue
        pos = 0
        while m := _AND.search(v, pos):
            out.append((v[pos : m.start()].strip(" ,"), False, flag, a, z))
            pos = m.end()
        out.append((v[pos:].strip(" ,"), False, flag, a, z))
    return out


def elements(text: str | None, people: bool = False) -> list[tuple[int, str | None, str]]:
    """(pos, value, flag) of every element in order; those without a value have None and the place of the last value before them.

    Null and blank texts have no elements.
    """
    if text is None or not text or text.isspace():
        return []
    end, tail = len(text), False
    if people and "al" in text.lower() and (m := _ET_AL.search(text)):
        end, tail = m.start(), True
    out: list[tuple[int, str | None, str]] = []
    pos = 0
    if end and not text[:end].isspace():
        for value, _, flag, _, _ in _field(text, end, people):
            if not value:
                out.append((pos, None, EMPTY_ELEMENT))
            elif people and _ET_AL.fullmatch(" " + value):
                out.append((pos, None, ET_AL))
            else:
                pos += 1
                out.append((pos, value, flag))
    if tail:
        out.append((pos, None, ET_AL))
    return out


def parse(text: str | None, people: bool = False) -> list[tuple[int, str, str]]:
    """(pos, value, flag) of every single value; blank text, 'et al' and empty elements give no value.

    people: names, where 'and' and '&' separate too and 'Family, Given' is one value.
    """
    return [e for e in elements(text, people) if e[1] is not None]
