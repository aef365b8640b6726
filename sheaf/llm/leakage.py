"""Evaluation texts leaking into training text, found by one Aho-Corasick automaton."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Markup: tags whose attributes have values, comments and declarations; "a<b and c>d" is none.
_MARKUP = r"</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))*\s*/?>|<!--.*?-->|<![A-Za-z][^<>]*>"
_TAG = re.compile(_MARKUP, re.S)
_ENTITY = re.compile(r"&#?\w{1,31};")
_MARKED = re.compile(f"(?P<tag>{_MARKUP})|{_ENTITY.pattern}", re.S)
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile("[a-z0-9]+")
_SPLIT = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")


def words(text: str) -> list[str]:
    """The words of a text: without markup, case, punctuation, line breaks and invisible characters; entities are what they stand for."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_SPLIT.sub("", unicodedata.normalize("NFKC", text)).casefold())


_PLAIN = re.compile("[\x00-\x7f]+")


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Place in the original of each of words(text): the same steps, each character with where it came from."""
    parts: list[str] = []
    begins: list[int] = []
    ends: list[int] = []
    at = 0
    for m in _MARKED.finditer(text):
        new = " " if m.lastgroup == "tag" else html.unescape(m.group())
        parts += [text[at : m.start()], new]
        begins += [*range(at, m.start()), *[m.start()] * len(new)]
        ends += [*range(at + 1, m.start() + 1), *[m.end()] * len(new)]
        at = m.end()
    parts.append(text[at:])
    begins += range(at, len(text))
    ends += range(at + 1, len(text) + 1)
    s = "".join(parts)
    if s.isascii():
        return [(begins[m.start()], ends[m.end() - 1]) for m in _WORD.finditer(s.lower())]
    # characters that may join the one before them are normalised together with it
    out: list[str] = []
    first: list[int] = []
    last: list[int] = []
    i, n = 0, len(s)
    while i < n:
        j = i
        if m := _PLAIN.match(s, i):
            j = m.end() - (m.end() < n and _joins(s[m.end()]))
        if j > i:
            out.append(s[i:j].lower())
            first += begins[i:j]
            last += ends[i:j]
        else:
            j = i + 1
            while j < n and _joins(s[j]):
                j += 1
            new = _SPLIT.sub("", unicodedata.normalize("NFKC", s[i:j])).casefold()
            out.append(new)
            first += [begins[i]] * len(new)
            last += [ends[j - 1]] * len(new)
        i = j
    return [(first[m.start()], last[m.end() - 1]) for m in _WORD.finditer("".join(out))]


def _joins(c: str) -> bool:
    return c >= "\u0300" and (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or "\uff9e" <= c <= "\uff9f")


class Automaton:
    """Blocks of the items' words; every common run of min_words words holds a whole block, and is then extended.

    Blocks of (min_words + 1) // 2 words are taken at that stride, so that each run of min_words words
    covers one of them entirely; items shorter than min_words can't be contained. A run is longer than a block, so it
    goes on with the word before or after it: of the items that share a block only those with one of these two words
    are looked at.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        import ahocorasick

        self.min_words, self.size = min_words, (min_words + 1) // 2
        self.items: list[tuple[int, list[str]]] = [(item, words(text)) for item, text in items]
        posts: dict[str, dict[tuple[int, str], list[tuple[int, int]]]] = {}
        for n, (_, w) in enumerate(self.items):
            if len(w) >= min_words:
                for k in range(0, len(w) - self.size + 1, self.size):
                    near = posts.setdefault(" " + " ".join(w[k : k + self.size]) + " ", {})
                    for side, at in ((0, k - 1), (1, k + self.size)):
                        if 0 <= at < len(w):
                            near.setdefault((side, w[at]), []).append((n, k))
        self.machine = ahocorasick.Automaton()
        for block, near in posts.items():
            self.machine.add_word(block, (near, len(block)))
        if posts:
            self.machine.make_automaton()
        self.empty = not posts

    def runs(self, doc: list[str]) -> dict[int, list[tuple[int, int]]]:
        """item -> (first word, last word + 1) of every common run that is long enough."""
        if self.empty or len(doc) < self.min_words:
            return {}
        line = " " + " ".join(doc) + " "
        found: dict[int, set[tuple[int, int]]] = defaultdict(set)
        at, word = 0, 0
        for last, (near, length) in self.machine.iter(line):
            begin = last - length + 1
            word += line.count(" ", at, begin)
            at = begin
            end = word + self.size
            hits = set(near.get((0, doc[word - 1]), ()) if word else ())
            if end < len(doc):
                hits.update(near.get((1, doc[end]), ()))
            for n, k in hits:
                item, w = self.items[n]
                i, j = word, end
                a, b = k, k + self.size
                while i > 0 and a > 0 and doc[i - 1] == w[a - 1]:
                    i, a = i - 1, a - 1
                while j < len(doc) and b < len(w) and doc[j] == w[b]:
                    j, b = j + 1, b + 1
                if j - i >= self.min_words:
                    found[item].add((i, j))
        return {item: sorted(s) for item, s in found.items()}


def item_blocks(items: DataFrame, id_col: str, text_cols: list[str], block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of at most block_chars characters (at least one item), read one at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(id_col).cast("bigint"), *text_cols).distinct().orderBy(id_col, *text_cols)
    for row in rows.toLocalIterator():
        for text in (t for t in row[1:] if t):
            if block and size + len(text) > block_chars:
                yield block
                block, size = [], 0
            block.append((row[0], text))
            size += len(text)
    if block:
        yield block


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 13, block_chars: int = 4_000_000, held_chars: int = 64_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, run_words): every run of min_words or more words of an item in a document.

    start and end are offsets in the original text. The items are the query set and go to every task; documents
    are read, normalised and scanned in one pass without a shuffle. Items of up to block_chars characters (some
    300 MB as automaton) are one automaton, built once per task. More items, which would not fit into a task, are
    several automata, which a task builds one after the other for each held_chars characters of documents it holds;
    the result is the same. Null or empty texts hold nothing; items shorter than min_words can't be found; repeated
    rows give repeated results.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    blocks = list(item_blocks(items.where(F.col(item_id).isNotNull()), item_id, [item_text], block_chars))
    shared = slim.sparkSession.sparkContext.broadcast(blocks)

    def scan(machine: Automaton, held: list[tuple[int, str, list[str]]]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc, body, w in held:
            hits = machine.runs(w)
            if hits:
                places = word_offsets(body)
                for item, spans in hits.items():
                    rows += [(doc, item, places[i][0], places[j - 1][1], j - i) for i, j in spans]
        cols = list(zip(*rows)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end", "run_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        only = Automaton(parts[0] if parts else [], min_words) if len(parts) < 2 else None
        held: list[tuple[int, str, list[str]]] = []
        size = 0
        for batch in batches:
            read = [(doc, body, words(body)) for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if only:
                yield scan(only, read)
                continue
            held += read
            size += sum(len(body) for _, body, _ in read)
            if size >= held_chars:
                yield from (scan(Automaton(p, min_words), held) for p in parts)
                held, size = [], 0
        if held:
            yield from (scan(Automaton(p, min_words), held) for p in parts)

    return slim.mapInArrow(run, "doc_id bigint, item_id bigint, start bigint, end bigint, run_words bigint")
