"""Variant spellings of people's names, linked by merge-and-rematch resolution.

Spellings are parsed into a family name, given names and initials. Keys are merged first by what proves
identity (a valid ORCID, or the same full name in the same field). Every profile then holds all the
spellings and initials of its keys. Profiles enter blocks under each spelling (family name with one letter
left out, or whole, and the given name's initial), block neighbours are compared, each profile finds its
best partner, pairs that are each other's best partner merge, and the richer profiles enter the blocks
again, under the family and given names they now have together, until no two profiles merge any more.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import peg
from sheaf.llm.canonical import distance
from sheaf.llm.lookalike import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS
from sheaf.session import checkpointed, materialized

#: Titles before a name, letters after it, particles of family names.
TITLES = frozenset("dr prof professor a/prof aprof mr mrs ms miss mx sir dame emeritus emerita assoc associate asst assistant adj adjunct hon rev prof. dr.".split())
LETTERS = frozenset("phd md mba fca ca cpa am ao oam ac frs faha fassa faa mphil msc bsc ba ma llb llm jd dphil obe cbe mbe esq fcpa jr sr ii iii iv".split())
PARTICLES = frozenset("von van der den de la le di da del du dos das al el bin ben ter ten".split())
#: Short forms of given names.
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex sandy sasha xander al lex", "alexandra": "alex sandy sandra", "andrew": "andy drew", "anthony": "tony ant",
    "benjamin": "ben benny", "catherine": "cathy kate cath katie", "charles": "charlie chuck chas chaz", "christopher": "chris kit topher", "daniel": "dan danny",
    "david": "dave davey", "deborah": "debbie deb debra", "dmitri": "dima mitya", "edward": "ed eddie ted ned teddy", "ekaterina": "katya katia", "elizabeth": "liz beth betty eliza lizzie libby",
    "francisco": "paco pancho frank kiko", "frederick": "fred freddie rick", "gabrielle": "gabby gabi gaby elle", "gregory": "greg", "guadalupe": "lupe lupita", "ibrahim": "ibo ibra abe",
    "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "john": "jack johnny", "jonathan": "jon jonny nathan", "jose": "pepe pepito", "joseph": "joe joey", "katherine": "kate kathy kat katie kath",
    "lawrence": "larry laurie", "margaret": "meg peggy maggie marge greta", "matthew": "matt matty", "michael": "mike mick mikey", "muhammad": "mo mohammed mohammad mohamed", "nicholas": "nick nicky nico",
    "patricia": "pat trish patty tricia", "penelope": "penny nell", "peter": "pete", "philip": "phil pip", "rebecca": "becky becca", "richard": "rick dick rich richie", "robert": "rob bob bobby bert",
    "samuel": "sam sammy", "stephanie": "steph steffi", "steven": "steve", "susan": "sue suzie susie", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky vicki tori", "william": "will bill billy liam",
}

#: Different given names that are one letter apart.
CONFUSED = frozenset(map(frozenset, (("andrew", "andre"), ("thomas", "tomas"), ("jon", "jan"), ("maria", "mario"), ("carlo", "carla"), ("daniel", "daniela"), ("michael", "michaela"), ("gabriel", "gabriele"), ("eric", "erica"), ("paul", "paula"), ("robert", "roberta"), ("marc", "mara"), ("john", "joan"), ("julia", "julie"), ("joan", "jean"), ("alan", "alana"), ("hans", "hana"), ("ann", "anna"))))

_FULL: dict[str, frozenset[str]] = {}
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL[_s] = _FULL.get(_s, frozenset()) | {_name}

_ALIKE = str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)
_LETTER = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "ß": "ss", "ı": "i", "đ": "d", "ð": "d", "þ": "th"})
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_BRACKETS = re.compile(r"[(\[\"“]([^)\]\"”]*)[)\]\"”]")
_QUOTES = re.compile("['’‘`´ʼ]")
_DASHES = re.compile("[‐‑‒–—−]")


def _simple() -> dict[int, str | None]:
    """One table for what most names need: base letters, look-alikes, no quotes and invisible characters."""
    table: dict[int, str | None] = {}
    for point in range(0xA0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point).lower().translate(_LETTER)) if not unicodedata.combining(c))
        if plain.isascii():
            table[point] = plain
    table.update({ord(a): b for a, b in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)})
    table.update(dict.fromkeys(map(ord, "'’‘`´ʼ\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")))
    table.update(dict.fromkeys(map(ord, "‐‑‒–—−"), "-"))
    return table


_SIMPLE = _simple()
_MARKS = re.compile("[\u0300-\u036f]")


_BEYOND = re.compile("[^\x00-\x7f]+")


@lru_cache(maxsize=200_000)
def _plain(run: str) -> str:
    return run.translate(_SIMPLE)


def fold(text: str) -> str:
    """Lower case, Latin look-alikes, no accents, apostrophes or invisible characters."""
    if text.isascii():
        return text.lower().replace("'", "").replace("`", "")
    s = _BEYOND.sub(lambda m: _plain(m.group()), text)
    if s.isascii():
        return s.lower().replace("'", "").replace("`", "")
    s = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(_ALIKE).lower().translate(_LETTER)
    s = _MARKS.sub("", unicodedata.normalize("NFKD", s))
    return _QUOTES.sub("", _DASHES.sub("-", s))


#: fold() of single words, which recur.
fold_word = lru_cache(maxsize=200_000)(fold)


@lru_cache(maxsize=200_000)
def _is_title(token: str) -> bool:
    f = fold(token)
    return f.strip(".,") in TITLES or f.strip(",") in TITLES


class Name:
    """A parsed spelling: family name, given names (joined without hyphens) and all initials."""

    __slots__ = ("family", "given", "initials", "full", "nick", "other")

    def __init__(self, family: str, given: list[str], nick: str, other: tuple[str, str] | None):
        self.family, self.nick, self.other = family, nick, other
        self.given = [g.replace("-", "").replace(".", "") for g in given]
        self.initials = "".join(_letters(g) for g in given)
        self.full = next((g for g in given[:1] if not _initial(g)), "").replace("-", "").replace(".", "")


def _initial(token: str) -> bool:
    return len(token.replace(".", "").replace("-", "")) == 1 or "." in token


def _letters(token: str) -> str:
    if "." in token:
        return "".join(c for c in token if c.isalpha())
    return "".join(p[0] for p in token.split("-") if p)


@lru_cache(maxsize=200_000)
def parse(text: str) -> Name | None:
    """The parsed name, or None where there is no word."""
    raw = _INVISIBLE.sub("", text).strip()
    nick = ""
    if m := _BRACKETS.search(raw):
        nick = fold_word(m.group(1)).strip()
        raw = _BRACKETS.sub(" ", raw)
    before, comma, after = raw.partition(",")
    if comma and sum(w not in PARTICLES for w in fold_word(before).split()) > 1 and all(t in LETTERS for t in fold_word(after).replace(".", "").replace(",", " ").split()):
        raw, comma = before, ""
    if comma:
        family = _words(before)
        given = _given(after)
        return Name("".join(family), given, nick, None) if family else None
    # letters in capitals are initials when they follow a family name
    tokens = [t for t in raw.split() if not _is_title(t)]
    while len(tokens) > 2 and _after_name(tokens[-1]):  # of two tokens the last may be initials
        tokens.pop()
    if not tokens:
        return None
    last = tokens[-1]
    bare = last.replace(".", "").replace("-", "")
    if len(tokens) > 1 and bare.isalpha() and ("." in last or (bare.isupper() and len(bare) <= 3)) and len(fold_word(tokens[0]).strip(".")) > 1 and "." not in tokens[0]:
        letters = list(fold_word(bare))
        family = [fold_word(t) for t in tokens[:-1]]
        return Name("".join(family).replace("-", "").replace(".", ""), [c + "." for c in letters], nick, None)
    at = len(tokens) - 1
    while at > 1 and fold_word(tokens[at - 1]) in PARTICLES:
        at -= 1
    family = "".join(_words(" ".join(tokens[at:])))
    given = _given(" ".join(tokens[:at]))
    other = None
    if len(tokens) == 2 and not _initial(fold_word(tokens[0])):
        other = (fold_word(tokens[0]).replace("-", ""), fold_word(tokens[1]).replace("-", ""))
    return Name(family, given, nick, other) if family else None


@lru_cache(maxsize=200_000)
def _after_name(token: str) -> bool:
    """Letters after a name, as AM or Jr; initials with dots are none."""
    f = fold_word(token)
    return f.strip(".") in ("jr", "sr") and not token.isupper() or f in LETTERS and token.isupper() or f.replace(".", "") in LETTERS and "." in token and not token.replace(".", "").isupper()


def _words(text: str) -> list[str]:
    return [w.replace("-", "").strip(".") for w in fold_word(text).split() if w.strip(".,-")]


def _given(text: str) -> list[str]:
    out = []
    for t in text.replace(",", " ").split():
        f = fold_word(t)
        bare = t.replace(".", "").replace("-", "")
        if f.strip(".") in TITLES or len(bare) > 2 and _after_name(t):
            continue
        if "." in t or (bare.isupper() and len(bare) <= 3 and bare.isalpha() and len(bare) > 1):
            out += [c + "." for c in fold_word(bare)]
        elif f.strip(".-"):
            out.append(f.strip("-"))
    return out


def _close(a: str, b: str) -> int:
    """0 the same, 1 or 2 typing errors that their lengths allow, 9 otherwise."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    short = min(la, lb)
    most = 0 if short < 4 else 1 if short < 7 else 2
    if not most or abs(la - lb) > most:
        return 9
    i = 0
    while i < short and a[i] == b[i]:
        i += 1
    j = 0
    while j < short - i and a[la - 1 - j] == b[lb - 1 - j]:
        j += 1
    if i + j < short - 2 * most:  # more than the errors' own letters differ between the equal ends
        return 9 if most == 1 or i + j < 3 else _far(a, b)
    d = distance(a, b, most)
    return d if d <= most else 9


def _far(a: str, b: str) -> int:
    """Two errors far apart, by the letters' counts before the distance itself."""
    if sum(a.count(c) != b.count(c) for c in set(a + b)) > 4:
        return 9
    d = distance(a, b, 2)
    return d if d <= 2 else 9


@lru_cache(maxsize=100_000)
def _same_given(a: str, b: str) -> int:
    """0 the same, 1 a short form, 2 a typing error, 9 another name."""
    if a == b:
        return 0
    fa, fb = _FULL.get(a, frozenset()) | {a}, _FULL.get(b, frozenset()) | {b}
    if fa & fb:
        return 1
    if frozenset((a, b)) in CONFUSED:
        return 9
    if _close(a, b) <= 1 or any(_close(x, y) <= 1 for x in fa for y in fb if len(x) > 4 and len(y) > 4):
        return 2
    if abs(len(a) - len(b)) <= 2 and distance(a, b, 2) <= 2:
        return 3
    return 9


@lru_cache(maxsize=100_000)
def _letters_of(given: str) -> frozenset[str]:
    return frozenset({given[0]} | {f[0] for f in _FULL.get(given, ())} | {s[0] for f in _FULL.get(given, frozenset()) | {given} for s in NICKNAMES.get(f, "").split()})


def _first_letters(n: Name) -> frozenset[str]:
    """First letters that the given name may be shortened to, those of its short forms included."""
    out = frozenset(n.initials[:1])
    for g in (n.full, n.nick):
        if g:
            out |= _letters_of(g)
    return out


def _family_given(a: Name, b: Name) -> tuple[int, str, str] | None:
    family = _close(a.family, b.family)
    if family < 9:
        return family, a.full, b.full
    for x, y, swap in ((a, b, False), (b, a, True)):
        if x.other:
            f, g = x.other
            d = _close(f, y.family)
            if d < 9 and y.full and _same_given(g, y.full) < 9:
                return d, *((g, y.full) if not swap else (y.full, g))
            if d < 9 and not y.full and y.initials[:1] in _letters_of(g):
                return -1 - d, "", ""
    return None


#: The highest score.
MOST = 10


def score(a: Name, b: Name) -> int:
    """How well two spellings agree: 7 to 10 with given names, 4 to 6 by initials, 3 with more errors, 0 not at all; -1: family name alike, given names of two people."""
    found = _family_given(a, b)
    if found is None:
        return 0
    if found[0] < 0:
        return 6 if found[0] == -1 else 3
    family, ga, gb = found
    swapped = ga != a.full or gb != b.full
    if ga and gb:
        same = min(_same_given(x, y) for x in {ga, a.nick or ga} for y in {gb, b.nick or gb})
        if same and (ga == "".join(b.given) or gb == "".join(a.given)):
            return 3 if family > 1 else 10 - family
        if same == 3 or same == 9 or (same == 2 and family > 1):
            return -1 if same == 9 and family == 0 else 3 if same == 3 and family == 0 else 0
        if not swapped and len(a.initials) > 1 and len(b.initials) > 1:
            ma, mb = _middle(a), _middle(b)
            if ma and mb and ma[0] != mb[0]:
                return -1
        return 3 if family > 1 else (10, 9, 8)[same] - family
    if not a.initials or not b.initials:
        return 0
    fa, fb = _first_letters(a), _first_letters(b)
    if not fa & fb:
        return -1 if family == 0 else 0
    if a.initials[0] == b.initials[0]:
        n = min(len(a.initials), len(b.initials))
        if a.initials[1:n] != b.initials[1:n] and not (_middle(a) and _middle(b) and _middle(a)[0] == _middle(b)[0]):
            return 0
    direct = a.initials[0] == b.initials[0]
    return (6 if direct else 5) if family == 0 else (4 if direct and family == 1 else 3)


def _middle(n: Name) -> str:
    return "".join(g[0] for g in n.given[1:] if g)


def block_keys(n: Name) -> set[str]:
    """Family name whole and with each letter left out, with the first letters that the given name may have."""
    out = set()
    pairs = [(n.family, _first_letters(n) or {""})]
    if n.other:
        f, g = n.other
        pairs.append((f, {g[0]} | {x[0] for x in _FULL.get(g, ())}))
    for family, letters in pairs:
        forms = {family} | ({family[:i] + family[i + 1 :] for i in range(len(family))} if len(family) >= 4 else set())
        out |= {f"{form}|{c}" for form in forms for c in letters}
    return out


def valid_orcid(value: str | None) -> str | None:
    """The sixteen characters of an ORCID whose check character is right."""
    if not value:
        return None
    m = re.search(r"(\d{4})-?(\d{4})-?(\d{4})-?(\d{3}[\dXx])(?![\dXx])", value.strip())
    if not m:
        return None
    code = "".join(m.groups()).upper()
    total = 0
    for c in code[:15]:
        total = (total + int(c)) * 2
    check = (12 - total % 11) % 11
    return code if code[15] == ("X" if check == 10 else str(check)) else None


def _arrow(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, name, field, orcid -> key, name, field, valid orcid, full (folded whole name, null without a given name), given."""
    for b in batches:
        rows = []
        for key, name, field, orcid in zip(*(c.to_pylist() for c in b.columns)):
            n = parse(name)
            if n is not None:
                full = f"{n.family}|{'.'.join(n.given)}" if n.full else None
                rows.append((key, name, field, valid_orcid(orcid), full, (sorted(_FULL.get(n.full, [n.full]))[0])[:3] or None))
        yield _arrow(rows, ["key", "name", "field", "orcid", "full", "given"], [pa.int64()] + [pa.string()] * 5)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(block, e, name, field, orcid) for e, name, field, orcid in zip(*(c.to_pylist() for c in b.columns)) for block in block_keys(parse(name))]
        yield _arrow(rows, ["block", "entity", "name", "field", "orcid"], [pa.string(), pa.int64()] + [pa.string()] * 3)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(a, z, s) for a, x, z, y in zip(*(c.to_pylist() for c in b.columns)) if (s := score(parse(x), parse(y)))]
        yield _arrow(rows, ["a", "b", "score"], [pa.int64(), pa.int64(), pa.int32()])


def _compatible(x: str, y: str):
    return F.col(x).isNull() | F.col(y).isNull() | (F.col(x) == F.col(y))


def recombined(spellings: list[str]) -> list[str]:
    """The spellings that a profile's family and given names make beside its own, each as 'family, given names (nickname)'.

    Only families that are typing variants of the commonest one take part, and only given names that were written beside one of
    those (spellings in another order have their family name elsewhere); a single initial adds nothing.
    """
    own = [n for n in map(parse, spellings) if n is not None]
    near = {n.family: sum(_close(n.family, m.family) < 9 for m in own) for n in own}
    most = max(near.values(), default=0)
    kin = [n for n in own if near[n.family] == most]
    if most < 2 or any(_close(kin[0].family, n.family) == 9 for n in kin):
        return []
    kin = [n for n in own if _close(kin[0].family, n.family) < 9]
    have = {(n.family, tuple(n.given)) for n in own}
    givens = {tuple(n.given): n.nick for n in kin if len("".join(n.given)) > 1}
    return [f"{f}, {' '.join(g)}" + (f" ({nick})" if nick else "") for f in sorted({n.family for n in kin}) for g, nick in sorted(givens.items()) if (f, g) not in have]


def _recombined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entity, spellings, field, orcid -> the blocks of its recombined spellings."""
    for b in batches:
        rows = [(block, e, name, field, orcid) for e, spellings, field, orcid in zip(*(c.to_pylist() for c in b.columns)) for name in recombined(spellings) for block in block_keys(parse(name))]
        yield _arrow(rows, ["block", "entity", "name", "field", "orcid"], [pa.string(), pa.int64()] + [pa.string()] * 3)


_BLOCKED = "block string, entity bigint, name string, field string, orcid string"


def _neighbours(asking: DataFrame, blocks: DataFrame, bare: DataFrame | None, once: Column) -> DataFrame:
    """(a, b, best, worst): scores of the spellings of profiles that share a block and may be one person by field.

    With bare, the blocks of profiles without a field, rows of one block meet by field, so that only those without a field
    meet a whole block; asking should then hold no more than blocks. Without bare, asking is small beside blocks.
    """
    a = asking.select("block", F.col("entity").alias("a"), F.col("name").alias("an"), F.col("field").alias("af"), F.col("orcid").alias("ao"))
    side = lambda df: df.select("block", F.col("entity").alias("b"), F.col("name").alias("bn"), F.col("field").alias("bf"), F.col("orcid").alias("bo"))
    b = side(blocks)
    if bare is None:
        near = a.join(b, "block").where(_compatible("af", "bf"))
    else:
        near = a.join(b.withColumn("af", F.col("bf")), ["block", "af"]).select(*a.columns, *b.columns[1:])
        near = near.unionByName(a.where("af is null").join(b, "block")).unionByName(a.where("af is not null").join(side(bare), "block"))
    near = near.where((F.col("a") != F.col("b")) & (F.col("ao").isNull() | F.col("bo").isNull()) & once)
    pairs = near.select("a", "an", "b", "bn").distinct().mapInArrow(_scored, "a bigint, b bigint, score int")
    return pairs.groupBy("a", "b").agg(F.max("score").alias("best"), F.min("score").alias("worst"))


def resolve(people: DataFrame, key: str, name: str, orcid: str, field: str, max_rounds: int = 1000) -> DataFrame:
    """(key, name, entity, names): every key with a name, all its names, and the smallest key of the person it belongs to.

    Two valid ORCIDs or two fields that differ make two persons. Pairs of profiles that both have an ORCID
    are never compared, as equal ones are one profile already: what is compared is linear in a block that
    many people of one name share. A profile whose best partners are several persons (of several ORCIDs,
    fields or given names) stays alone until they have merged. A profile that has grown unites its spellings and
    initials and enters the blocks again with each family name under each given name or initials it now has.
    Keys without a name are left out; a key delivered several times counts once, with all its spellings (name is the
    greatest); repeated rows, ties and extra columns change nothing.
    """
    named = people.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(name).alias("name"), F.col(field).alias("field"), F.col(orcid).alias("orcid"))
    once = named.groupBy("key").agg(F.collect_set("name").alias("names"), F.max("field").alias("field"), F.max("orcid").alias("orcid"))
    rows = once.select("key", F.explode("names").alias("name"), "field", "orcid").mapInArrow(_parsed, "key bigint, name string, field string, orcid string, full string, given string")
    rows = checkpointed(rows)
    sure = rows.groupBy("key").agg(F.max("orcid").alias("orcid"), F.max("field").alias("field"), F.min("full").alias("full"), F.max("given").alias("given"), F.max("name").alias("name"))
    alone = F.concat(F.lit("k"), F.col("key").cast("string"))
    proof = F.coalesce(F.concat(F.lit("o"), "orcid"), F.when(F.col("field").isNotNull() & F.col("full").isNotNull(), F.concat_ws("\t", F.lit("n"), "full", "field")), alone)
    sure = sure.withColumn("proof", proof)
    first = sure.groupBy("proof").agg(F.min("key").alias("node"), F.max("orcid").alias("e_orcid"), F.max("field").alias("e_field"), F.max("given").alias("e_given"))
    keys = checkpointed(sure.select("key", "name", "proof").join(first, "proof").drop("proof"))
    nodes = rows.select("key", F.col("name").alias("spelling")).join(keys, "key")
    spellings = materialized(nodes.select(F.col("node").alias("entity"), F.col("spelling").alias("name"), F.col("e_field").alias("field"), F.col("e_orcid").alias("orcid")).distinct())
    blocks = materialized(spellings.mapInArrow(_blocked, _BLOCKED))
    bare = materialized(blocks.where("field is null"))
    asking = blocks.where("field is not null and orcid is null").unionByName(bare.where("orcid is null"))
    pairs = checkpointed(_neighbours(asking, blocks, bare, F.col("bo").isNotNull() | (F.col("a") < F.col("b"))))
    now = checkpointed(keys.select("node", F.col("node").alias("entity"), F.col("e_orcid").alias("orcid"), F.col("e_field").alias("field"), F.col("e_given").alias("given")).distinct())
    for _ in range(max_rounds):
        now = checkpointed(_round(pairs, now))
        grown = now.where("changed").select("entity").distinct()
        now = now.drop("changed")
        richer = now.select(F.col("node"), "entity", "orcid", "field").join(grown, "entity", "left_semi").join(spellings.select(F.col("entity").alias("node"), "name"), "node")
        richer = richer.groupBy("entity", "field", "orcid").agg(F.collect_set("name").alias("names")).select("entity", "names", "field", "orcid")
        richer = checkpointed(richer)
        if not richer.limit(1).count():
            break
        asking = materialized(richer.where(F.size("names") > 1).mapInArrow(_recombined, _BLOCKED))
        found = _neighbours(asking, blocks, None, F.lit(True))
        pairs = checkpointed(pairs.unionByName(found.where("best > 0").select("a", "b", "best", F.col("best").alias("worst"))))
    else:
        raise RuntimeError(f"resolve: profiles still merge after {max_rounds} rounds")
    return keys.select("key", "name", "node").join(now.select("node", "entity"), "node").join(once.select("key", "names"), "key").select("key", "name", "entity", "names")


def _round(pairs: DataFrame, now: DataFrame) -> DataFrame:
    """One rematch of all profiles: node, entity, orcid, field, given, changed."""
    a = now.select(F.col("node").alias("a"), F.col("entity").alias("x"), F.col("orcid").alias("xo"), F.col("field").alias("xf"), F.col("given").alias("xg"))
    b = now.select(F.col("node").alias("b"), F.col("entity").alias("y"), F.col("orcid").alias("yo"), F.col("field").alias("yf"), F.col("given").alias("yg"))
    e = pairs.join(a, "a").join(b, "b").where(F.col("x") != F.col("y"))
    flip = e.select(F.col("y").alias("x"), F.col("x").alias("y"), "best", "worst", F.col("xo").alias("yo"), F.col("xf").alias("yf"), F.col("xg").alias("yg"), F.col("yo").alias("xo"), F.col("yf").alias("xf"))
    e = e.select(*flip.columns).unionByName(flip)
    e = e.groupBy("x", "y").agg(F.max("best").alias("best"), F.min("worst").alias("worst"), *[F.max(c).alias(c) for c in ("xo", "xf", "yo", "yf", "yg")])
    e = e.where((F.col("worst") >= 0) & ((F.col("best") > 4) | ((F.col("best") == 4) & (F.col("xf") == F.col("yf")))) & _compatible("xo", "yo") & _compatible("xf", "yf"))
    level = F.when(F.col("best") > 6, 2).otherwise(1)
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    per = e.groupBy("x", level.alias("level")).agg(
        F.max(F.struct("best", (-lo).alias("lo"), (-hi).alias("hi"), "y")).alias("top"),
        *[(F.min(c) == F.max(c)).alias(f"one_{c}") for c in ("yo", "yf", "yg")],
    )
    sure = F.coalesce(F.col("one_yo"), F.lit(True)) & F.coalesce(F.col("one_yf"), F.lit(True)) & ((F.col("level") == 2) | F.coalesce(F.col("one_yg"), F.lit(True)))
    pick = per.groupBy("x").agg(F.max(F.struct("level", "top", sure.alias("sure"))).alias("p")).where("p.sure").select("x", F.col("p.top.y").alias("y"))
    pick = materialized(pick)  # used several times below; else the plan would hold it as often
    back = pick.select(F.col("x").alias("y"), F.col("y").alias("z"))
    root = pick.join(back, "y", "left").select("x", F.when(F.col("z") == F.col("x"), F.least("x", "y")).otherwise(F.lit(None)).alias("mutual"), "y")
    mates = root.where("mutual is not null").select(F.col("x").alias("y"), F.col("mutual").alias("joined"))
    hooked = root.join(mates, "y", "left").select("x", F.coalesce("mutual", "joined").alias("new"), F.col("mutual").isNotNull().alias("firm")).where("new is not null")
    hooked = materialized(hooked)
    who = now.select(F.col("entity").alias("x"), "orcid", "field").distinct()
    facts = hooked.join(who, "x").groupBy("new").agg(F.min("orcid").alias("o1"), F.max("orcid").alias("o2"), F.min("field").alias("f1"), F.max("field").alias("f2"))
    clean = facts.select("new", (F.coalesce(F.col("o1") == F.col("o2"), F.lit(True)) & F.coalesce(F.col("f1") == F.col("f2"), F.lit(True))).alias("whole"))
    moves = hooked.join(clean, "new").where("whole or firm").select(F.col("x").alias("entity"), "new")
    out = now.join(moves, "entity", "left").withColumn("changed", F.col("new").isNotNull() & (F.col("new") != F.col("entity")))
    out = out.withColumn("entity", F.coalesce("new", "entity")).drop("new")
    all_of = out.groupBy("entity").agg(F.max("orcid").alias("orcid"), F.max("field").alias("field"), F.max("given").alias("given"))
    return out.select("node", "entity", "changed").join(all_of, "entity").select("node", "entity", "orcid", "field", "given", "changed")


def same_person_pairs(resolved: DataFrame) -> DataFrame:
    """(left_id, right_id): every pair of different keys of one person, the smaller first."""
    a = resolved.select("entity", F.col("key").alias("left_id"))
    b = resolved.select("entity", F.col("key").alias("right_id"))
    return a.join(b, "entity").where(F.col("left_id") < F.col("right_id")).select("left_id", "right_id")


def author_entries(papers: DataFrame, paper_id: str, person_key: str, authors: str, resolved: DataFrame) -> DataFrame:
    """(paper_id, key, pos, entry, name): the entry of each paper's author list that is the paper's own researcher.

    The list is split into its entries; each is compared with all spellings of the person, and the best one wins,
    of equals the first. Papers whose list doesn't hold the researcher, or whose key has no name, give no row.
    Null and blank lists hold nobody.
    """
    every = F.explode("names") if "names" in resolved.columns else F.col("name")
    spelt = resolved.select("entity", every.alias("name")).groupBy("entity").agg(F.array_sort(F.collect_set("name")).alias("spellings"))
    who = resolved.join(spelt, "entity").select("key", "name", "spellings")
    slim = papers.select(F.col(paper_id).cast("bigint").alias("paper_id"), F.col(person_key).cast("bigint").alias("key"), F.col(authors).cast("string").alias("authors"))
    return slim.where(F.col("authors").isNotNull()).join(who, "key").select("paper_id", "key", "authors", "name", "spellings").mapInArrow(_own_entry, "paper_id bigint, key bigint, pos int, entry string, name string")


def _own_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for paper, key, authors, name, spellings in zip(*(c.to_pylist() for c in b.columns)):
            own = list(dict.fromkeys(n for n in map(parse, spellings) if n is not None))
            if not own:
                continue
            best, found = 2, None
            for pos, v, _ in peg.parse(authors, True):
                n = parse(v)
                if n is None:
                    continue
                s = score(n, own[0]) if len(own) == 1 else max([score(n, o) for o in own])
                if s > best:
                    best, found = s, (paper, key, pos, v, name)
                    if s == MOST:  # of equals the first counts
                        break
            if found:
                rows.append(found)
        yield _arrow(rows, ["paper_id", "key", "pos", "entry", "name"], [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()])
