"""Free-entered values mapped to the entries of a reference list, the unmatched reported as 0.

Every value is folded (repaired text, lower case, no accents, '&' as 'and') and its words are first corrected
towards the words of the list. One Aho-Corasick automaton over the canonical names and their aliases finds
embedded mentions; the longest non-overlapping ones win, and of these the first. What has no accepted
mention goes to token-set similarity: every content word of an entry must have its own word of the value,
as it is, abbreviated or with a typing error, and no content word of the value may be left over.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPECIAL = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "ß": "ss", "ı": "i", "đ": "d", "ð": "d", "þ": "th", "’": "'", "&": " and "})
_WORD = re.compile(r"[\w�]+")
_NOISE = re.compile(r"['`´]")

#: Words of journal names that carry no content; words that qualify a name without changing it.
STOP = frozenset("the es of in and on for a an to de la le les des du et e y i un und fur der die das pa di do da dos das d l".split())
QUALIFIERS = frozenset(
    "print online electronic resource edition imprimee internet web cd rom issn file international forum new series serie b eissn pissn vol volume no number issue former formerly continued".split()
)

#: Abbreviations and other spellings of job titles, each with the entry it stands for.
JOB_ALIASES = {
    "associate lecturer": "assoc lecturer|assoc lect|assoc lectr|a lecturer|a lect|associate lect|lecturer level a|tutor associate lecturer|ass lecturer|al lecturer",
    "lecturer": "lect|lectr|lecturer level b|lecturer b|level b lecturer|assistant professor",
    "senior lecturer": "s lecturer|s lect|snr lecturer|sen lecturer|sr lecturer|snr lect|sen lect|sr lect|senior lect|senior lectr|snr lectr|sr lectr|sen lectr|lecturer level c|lecturer senior|lecturer c",
    "associate professor": "a prof|aprof|a professor|assoc prof|assoc professor|associate prof|ass prof associate|ass prof|ass professor|professor associate|assocprof|professor level d|reader associate professor",
    "professor": "prof|full professor|full prof|professor level e|professor full|prof full|chair professor",
    "emeritus professor": "professor emerita|professor emeritus|prof emeritus|prof emerita|emerita professor|emeritus prof|emerita prof|em prof|em professor|emer prof|emer professor|emeritus",
    "adjunct lecturer": "adj lecturer|adj lect|adjunct lect|adjunct lectr|lecturer adjunct|adjunct lecturer",
    "adjunct professor": "adj prof|adj professor|adjunct prof|professor adjunct|prof adjunct",
    "adjunct associate professor": "adj assoc prof|adjunct assoc prof|adj a prof|adjunct a prof|adjunct aprof|adj aprof|adj associate professor|associate professor adjunct|assoc prof adjunct|a prof adjunct|adjunct assoc professor|adj assoc professor",
    "honorary fellow": "hon fellow|honorary fell|hon fell|fellow honorary|honorary research fellow",
    "research assistant": "res assistant|rsch assistant|research asst|res asst|rsch asst|research assist|ra|r a|assistant research|assistant researcher",
    "research fellow": "rsch fellow|res fellow|resch fellow|fellow research|research fell|r fellow",
    "senior research fellow": "snr research fellow|sen research fellow|sr research fellow|snr res fellow|sr res fellow|sen res fellow|senior res fellow|senior rsch fellow|snr rsch fellow|sr rsch fellow|sen rsch fellow|srf",
    "postdoctoral fellow": "postdoc|post doc|post doctoral fellow|postdoc fellow|post doc fellow|postdoctoral research fellow|postdoctoral researcher|post doctoral researcher|pdf",
    "professor of practice": "practice professor|prof of practice|prof practice|professor practice|pop",
    "visiting professor": "visiting prof|vis prof|vis professor|vstg prof|vstg professor|professor visiting",
    "head of school": "hos|head school|school head|head of sch|head sch",
    "head of department": "hod|head department|department head|dept head|head of dept|head dept|head of dep",
    "deputy head of school": "dep head of school|deputy hos|dep hos|deputy head school|dep head school|deputy school head|dep head of sch|deputy head of sch|head of school deputy",
    "program director": "programme director|director program|director programme|director of program|director of programme|prog director|program dir|programme dir|prog dir|dir program|director of programs|dir of program",
    "director of research": "research director|dir of research|director research|dir research|research dir",
    "teaching fellow": "tchg fellow|teach fellow|fellow teaching|teaching fell|tf",
    "senior teaching fellow": "snr teaching fellow|sen teaching fellow|sr teaching fellow|snr tchg fellow|sen tchg fellow|sr tchg fellow|senior tchg fellow|stf",
    "dean": "faculty dean|dean of faculty|dean of the faculty|executive dean",
    "associate dean": "a dean|assoc dean|ass dean|adean|dean associate",
    "industry fellow": "ind fellow|fellow industry|industrial fellow|industry fell",
}


def fold(value: str) -> str:
    s = unicodedata.normalize("NFKD", value.lower().translate(_SPECIAL))
    return _NOISE.sub("", "".join(c for c in s if not unicodedata.combining(c)))


_SIGN = re.compile(r"(?<=[^\W\d_])[^\w\s'’`´\x00-\x7f‐-―](?=[^\W\d_])")


def folded_words(value: str) -> list[str]:
    """Words of a folded value; a sign within a word is taken for a lost letter, and runs of lost letters for one."""
    found = _WORD.findall(fold(_SIGN.sub("�", value)).replace("_", " "))
    return [w for w in (re.sub("�+", "�", w) for w in found) if w != "�"]


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions; a lost character (U+FFFD) equals any one; more than most is most + 1."""
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    before, row = None, list(range(lb + 1))
    for i in range(1, la + 1):
        last, row2 = row, [i] + [0] * lb
        x = a[i - 1]
        for j in range(1, lb + 1):
            y = b[j - 1]
            v = min(last[j] + 1, row2[j - 1] + 1, last[j - 1] + (0 if x == y or x == "�" else 1))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            row2[j] = v
        if min(row2) > most:
            return most + 1
        before, row = last, row2
    return row[lb]


def allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


def stop_like(word: str) -> bool:
    """A word without content, or such a one with a typing error."""
    return word in STOP or (1 < len(word) <= 4 and any(distance(word, w, 1) <= 1 for w in STOP if len(w) > 1))


def shortens(word: str, full: str) -> bool:
    """Whether word is full's beginning, or an abbreviation that leaves out letters."""
    if len(word) >= len(full) or word[0] != full[0]:
        return False
    if full.startswith(word):
        return len(word) >= 2 or word in "jqr"
    if not 4 <= len(word) <= 0.7 * len(full):
        return False
    letters = iter(full)
    return all(c in letters for c in word)


class Catalogue:
    """A reference list with its aliases: the automaton, the corrected words and the token index."""

    def __init__(self, entries: list[tuple[int, str]], aliases: dict[str, str], strict: bool):
        import ahocorasick

        self.strict = strict
        self.machine = ahocorasick.Automaton()
        self.words: dict[str, set[int]] = defaultdict(set)
        self.entry_words: dict[int, list[str]] = {}
        spelled: dict[str, int] = {}
        known: set[str] = set()
        for ref, title in sorted(entries):
            w = folded_words(title)
            content = [x for x in w if x not in STOP] or w
            self.entry_words[ref] = content
            for x in content:
                self.words[x].add(ref)
            known.update(w)
            forms = [" ".join(content)] if strict else [" ".join(w), *aliases.get(" ".join(w), "").split("|")]
            for form in filter(None, forms):
                spelled.setdefault(form, ref)
                known.update(form.split())
        for form, ref in spelled.items():
            self.machine.add_word(f" {form} ", (ref, len(form) + 2))
        if spelled:
            self.machine.make_automaton()
        self.empty = not spelled
        self.known = {w for w in known if len(w) >= 4}
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(self.known):
            self.by_length[len(w)].append(w)
        self.close: dict[str, list[tuple[str, float]]] = {}
        self.corrected: dict[str, str] = {}

    def correct(self, word: str) -> str:
        """The one known word at the least distance that its length allows, else the word."""
        got = self.corrected.get(word)
        if got is None:
            got, best, tie = word, allowed(word) + 1, False
            if word not in self.known and len(word) >= 4:
                for length in range(len(word) - 2, len(word) + 3):
                    for k in self.by_length.get(length, ()):
                        d = distance(word, k, min(best, allowed(word), allowed(k)))
                        if d < best and d <= allowed(k):
                            got, best, tie = k, d, False
                        elif d == best and d <= allowed(k) and k != got:
                            tie = True
                if tie and best > 1:
                    got = word
            if len(self.corrected) < 500_000:
                self.corrected[word] = got
        return got

    def mentions(self, words: list[str]) -> list[tuple[int, int, int]]:
        """Longest non-overlapping mentions, (first word, last word + 1, entry), from left to right."""
        line = " " + " ".join(words) + " "
        found = [(end - n + 1, end, ref) for end, (ref, n) in self.machine.iter(line)] if not self.empty else []
        found.sort(key=lambda x: (-(x[1] - x[0]), x[0], x[2]))
        taken: list[tuple[int, int, int]] = []
        for s, e, ref in found:
            if all(e <= a or s >= b for a, b, _ in taken):
                taken.append((s, e, ref))
        return sorted((line.count(" ", 0, s), line.count(" ", 0, e), ref) for s, e, ref in taken)

    def near(self, word: str) -> list[tuple[str, float]]:
        """Words of the list that this one may stand for, with a similarity."""
        got = self.close.get(word)
        if got is None:
            got = []
            for w in self.words:
                if w == word:
                    got.append((w, 1.0))
                elif shortens(word, w):
                    got.append((w, 0.9))
                else:
                    most = min(allowed(word), allowed(w))
                    if most and (d := distance(word, w, most)) <= most:
                        got.append((w, 0.9 - 0.1 * d))
            if len(self.close) < 500_000:
                self.close[word] = got
        return got

    def similar(self, words: list[str]) -> int:
        """The entry whose words all have their own word here, with none left over; 0 where none or two are as good."""
        content = [w for w in words if w not in STOP and not w.isdigit()]
        near = [self.near(w) for w in content]
        votes: dict[int, int] = defaultdict(int)
        for options in near:
            for ref in {r for w, _ in options for r in self.words[w]}:
                votes[ref] += 1
        best, found = 0.0, 0
        for ref, n in sorted(votes.items()):
            need = list(self.entry_words[ref])
            if n < len(need):
                continue
            total, left, errors = 0.0, 0, 0
            for word, options in sorted(zip(content, near), key=lambda x: (sum(w in self.entry_words[ref] for w, _ in x[1]), x[0])):
                fit = max(((q, w) for w, q in options if w in need), default=None)
                if fit is None:
                    left += word not in QUALIFIERS and (bool(options) or not stop_like(word))
                else:
                    need.remove(fit[1])
                    total += fit[0]
                    errors += fit[0] < 0.85
            score = total / len(self.entry_words[ref])
            if need or left or errors > 2:
                continue
            if score > best + 1e-9:
                best, found = score, ref
            elif score > best - 1e-9:
                found = 0
        return found

    def match(self, value: str) -> int:
        words = folded_words(value)
        if not words:
            return 0
        if self.strict:
            content = [w for w in words if w not in STOP]
            for s, e, ref in self.mentions(content):
                if all(w in QUALIFIERS or w.isdigit() for w in content[:s] + content[e:]):
                    return ref
            return self.similar(words)
        fixed = [self.correct(w) for w in words]
        found = self.mentions(fixed)
        return found[0][2] if found else self.similar(fixed)


def canonical(values: DataFrame, key: str, column: str, entries: DataFrame, entry_id: str, entry_name: str, aliases: dict[str, str] | None = None, strict: bool = True, max_entries: int = 200_000) -> DataFrame:
    """(record_id, value, ref_id) of every key whose value is not blank; ref_id 0 where the list has no such entry.

    strict: a mention counts only where nothing but qualifiers is left over (names); else the first mention
    counts, whatever surrounds it (job titles). The list is read to every task and its size is checked:
    more than max_entries entries raise an error. A key delivered several times counts once, with the value
    loaded last (then the greatest); nulls and blanks give no row; an empty list gives 0 for every value.
    """
    spark = values.sparkSession
    rows = entries.where(F.col(entry_id).isNotNull() & (F.trim(entry_name) != "")).select(F.col(entry_id).cast("bigint"), entry_name).distinct().limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"more than {max_entries} reference entries")
    shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows])
    folded_aliases = {k: v for k, v in (aliases or {}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalogue = Catalogue(shared.value, folded_aliases, strict)
        memo: dict[str, int] = {}
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                got = memo.get(value)
                if got is None:
                    got = catalogue.match(value)
                    if len(memo) < 200_000:
                        memo[value] = got
                out.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["record_id", "value", "ref_id"])

    slim = values.select(F.col(key).cast("bigint").alias("record_id"), F.col(column).cast("string").alias("value"))
    return slim.where(F.trim(F.regexp_replace("value", r"[\s\x{A0}\x{3000}]+", " ")) != "").mapInArrow(run, "record_id bigint, value string, ref_id bigint")
