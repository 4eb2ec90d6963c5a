"""Mapping free-typed values to a canonical list (problem 5).

A multi-pattern automaton over the canonical names and their aliases finds mentions inside a value; the longest
non-overlapping match wins, and the value maps if nothing but qualifiers is left beside it. What remains goes to token-set
similarity: with the words of a name, tolerant of typing slips, abbreviations and missing blanks, and then with all words that
an entry is known by, those of its name and of its note; a value maps to the only entry that knows all of its words.

Edge cases: a value that is character for character a term gives no row; null and blank values are no values; a value with
nothing near it maps to 0; a value as near to two terms as to one maps to the smaller term_id only if they tie exactly;
values of any length are compared whole; an empty reference list maps everything to 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from millrace.operators.packed import infer_all, strip_blank, values_of, with_choices

#: Least token-set similarity of a match.
SIMILARITY = 0.8
#: Remembered values per worker (a speed matter only).
CACHE_VALUES = 100_000

# Words around a term that don't change what it means.
QUALIFIERS = frozenset("work works advice projects project lead leads practice sector sectors related general other misc group team services and of the for in".split())
# Words of trade that say nothing about which.
TRADE_WORDS = frozenset("firm firms company companies group groups house houses chain chains maker makers operator operators provider providers vendor vendors contractor contractors body bodies any use age that a an to with on by own us".split())
# What people call entries of the canonical list in words that neither its names nor its notes have (term ->
# aliases); a table of one's own may be given instead.
ALIASES = {
    "Buyout & Venture Funds": ("private equity", "venture capital"),
    "Medicines & Devices": ("medical devices", "pharma"),
    "Power, Heat & Grid": ("network owners",),
    "Shops & Consumer Brands": ("retailers",),
    "Vehicles & Parts": ("car makers",),
    "Rail, Road & Ports": ("road haulage",),
    "State & Local Government": ("local councils",),
    "Charities & Foundations": ("nonprofits",),
    "Growing Sales": ("sales growth",),
    "Brand & Campaigns": ("marketing",),
    "Courts & Contracts": ("contract law",),
}

_TOKEN = re.compile(r"[^\W_]+\.?")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def tokens_of(text: str) -> list[str]:
    """Words in order, an ending full stop kept as the mark of an abbreviation; joining words dropped."""
    return [t for t in _TOKEN.findall(fold(text).replace("-.", ".")) if t.rstrip(".") not in ("and", "the", "of")]


def slip_distance(a: str, b: str, limit: int) -> int:
    """Edit distance with swaps of neighbours, cut off above ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > limit:
            return limit + 1
        before, row = row, now
    return row[-1]


def far_apart(a: str, b: str, limit: int) -> bool:
    """Cheap proof that the edit distance is above ``limit``: an edit adds or removes at most one letter on each side."""
    x, y = set(a), set(b)
    return abs(len(a) - len(b)) > limit or len(x - y) > limit or len(y - x) > limit


def same_word(a: str, b: str) -> float:
    """How far word ``a`` as typed stands for word ``b`` of a term: 1 equal, less for slips and abbreviations, 0 otherwise."""
    bare = a.rstrip(".")
    if bare == b:
        return 1.0
    if a.endswith(".") and len(bare) >= 3 and b.startswith(bare):
        return 0.95
    if bare + "s" == b or b + "s" == bare:
        return 0.95
    if len(b) < 4 or far_apart(bare, b, 2):
        return 0.0
    distance = slip_distance(bare, b, 2)
    return 0.9 if distance <= 1 else 0.85 if distance == 2 and len(b) >= 9 else 0.0


_ENDINGS = ("isations", "isation", "ations", "ation", "ances", "ance", "ments", "ment", "ings", "ing", "ers", "er", "ies", "es", "s", "y", "e")


def stem(word: str) -> str:
    """A word without its ending, at least three letters of it: banks, banking and bank are one."""
    for e in _ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 3:
            return word[: -len(e)]
    return word


@dataclass
class Matcher:
    """Maps values of one kind to term ids."""

    terms: list[tuple[int, str]]
    aliases: dict[str, tuple[str, ...]] = field(default_factory=lambda: ALIASES)
    #: What an entry covers in other words (term -> note).
    notes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.exact = {t: i for i, t in self.terms}
        self.forms: list[tuple[int, list[str], str]] = []
        names: dict[str, int] = {}
        for i, term in self.terms:
            for form in (term, *self.aliases.get(term, ())):
                words = [w.rstrip(".") for w in tokens_of(form)]
                if words:
                    self.forms.append((i, words, "".join(words)))
                    names.setdefault(" ".join(words), i)
                # A hyphenated word may be abbreviated as one word.
                if "-" in form and (closed := [w.rstrip(".") for w in tokens_of(form.replace("-", ""))]):
                    self.forms.append((i, closed, "".join(closed)))
        #: Stem -> the entries with a note that know it.
        self.known_by: dict[str, set[int]] = {}
        for i, term in self.terms:
            if self.notes.get(term):
                for w in tokens_of(f"{term} {self.notes[term]}"):
                    if (bare := w.rstrip(".")) not in TRADE_WORDS and bare not in QUALIFIERS:
                        self.known_by.setdefault(stem(bare), set()).add(i)
        self.whole = {whole: i for i, _, whole in reversed(self.forms)}
        self.automaton = ahocorasick.Automaton()
        for name, i in names.items():
            self.automaton.add_word(f" {name} ", (len(name), i))
        if names:
            self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def term_of(self, value: str) -> int:
        """The id the value maps to, 0 for none."""
        if (out := self.known.get(value)) is None:
            if len(self.known) > CACHE_VALUES:
                self.known.clear()
            out = self.known[value] = self._find(value) if self.forms else 0
        return out

    def _find(self, value: str) -> int:
        typed = tokens_of(value)
        words = [w.rstrip(".") for w in typed]
        if not words:
            return 0
        if (hit := self.whole.get("".join(words))) is not None:
            return hit
        if (hit := self._mention(words)) is not None:
            return hit
        core = [w for w in typed if w.rstrip(".") not in QUALIFIERS] or typed
        return self._similar(typed) or (self._similar(core) if core != typed else 0) or self._described(words)

    def _described(self, words: list[str]) -> int:
        """The only entry whose name and note know all telling words of the value."""
        telling = [stem(w) for w in words if w not in TRADE_WORDS and w not in QUALIFIERS]
        if not telling or not self.known_by:
            return 0
        able = set.intersection(*(self.known_by.get(w, set()) for w in telling))
        return able.pop() if len(able) == 1 else 0

    def _mention(self, words: list[str]) -> int | None:
        """Longest non-overlapping mentions; the value maps if they agree on one term and only qualifiers are left."""
        spaced = f" {' '.join(words)} "
        hits = sorted(((length, end - length, i) for end, (length, i) in self.automaton.iter(spaced)), key=lambda h: (-h[0], h[1]))
        if not hits:
            return None
        taken: list[tuple[int, int, int]] = []
        for length, start, i in hits:
            if all(start + length <= s or start >= s + n for s, n, _ in taken):
                taken.append((start, length, i))
        left = list(spaced)
        for start, length, _ in taken:
            left[start : start + length] = " " * length
        if len({i for *_, i in taken}) > 1 or any(w not in QUALIFIERS for w in "".join(left).split()):
            return None
        return taken[0][2]

    def _similar(self, typed: list[str]) -> int:
        best, at = 0.0, 0
        joined = "".join(w.rstrip(".") for w in typed)
        for i, words, whole in self.forms:
            score = self._token_set(typed, words)
            if score < SIMILARITY and len(whole) >= 8 and not far_apart(joined, whole, 1) and slip_distance(joined, whole, 1) <= 1:
                score = 0.9
            if score > best:
                best, at = score, i
        return at if best >= SIMILARITY else 0

    @staticmethod
    def _token_set(typed: list[str], words: list[str]) -> float:
        """Sum of the best one-to-one word likenesses over the size of the union."""
        if abs(len(typed) - len(words)) > max(1, len(words) // 3):
            return 0.0
        free = list(words)
        total = 0.0
        for w in typed:
            likeness, j = max(((same_word(w, x), -k) for k, x in enumerate(free)), default=(0.0, 0))
            if likeness:
                total += likeness
                del free[-j]
        return total / max(len(typed), len(words))


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(terms: tuple[tuple[int, str], ...], aliases: dict[str, tuple[str, ...]], notes: dict[str, str]) -> Matcher:
    """One matcher per worker and list, so that its memory of values outlives a task."""
    key = (terms, tuple(sorted(aliases.items())), tuple(sorted(notes.items())))
    if key not in _MATCHERS:
        if len(_MATCHERS) > 32:
            _MATCHERS.clear()
        _MATCHERS[key] = Matcher(list(terms), aliases, notes)
    return _MATCHERS[key]


def map_values(value: Column, kind: Column, terms: dict[str, list[tuple[int, str]]], aliases: dict[str, tuple[str, ...]] | None = None, notes: dict[str, dict[str, str]] | None = None) -> Column:
    """Term id of each value within its kind: null for a term written exactly, 0 for no entry. No shuffle."""

    @F.pandas_udf(IntegerType())
    def ids(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matchers = {k: _matcher(tuple(v), ALIASES if aliases is None else aliases, (notes or {}).get(k, {})) for k, v in terms.items()}
        for values, kinds in batches:
            yield pd.Series([None if v is None or v in (m := matchers[k]).exact else m.term_of(v) for v, k in zip(values, kinds)], dtype="Int32")

    return ids(value, kind)


FIELD_KINDS = {"sector": "sector", "primary_expertise": "expertise", "matched_inferred_expertise_topics": "topic"}


def find_terms(people: DataFrame, reference_terms: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, field_name, item_pos, term_id): one row per value that isn't exactly a term of its field's kind."""
    terms: dict[str, list[tuple[int, str]]] = {k: [] for k in FIELD_KINDS.values()}
    notes: dict[str, dict[str, str]] = {k: {} for k in FIELD_KINDS.values()}
    if "note" not in reference_terms.columns:
        reference_terms = reference_terms.withColumn("note", F.lit(None).cast("string"))
    for r in reference_terms.where(F.col("kind").isin(list(terms)) & F.col("term").isNotNull()).orderBy("term_id").collect():
        terms[r["kind"]].append((r["term_id"], r["term"]))
        if r["note"]:
            notes[r["kind"]][r["term"]] = r["note"]
    vocabulary = [t for _, t in terms["sector"]]
    if "data_source" not in people.columns:
        people = people.withColumn("data_source", F.lit(None).cast("string"))
    choices = infer_all(people, {"sector": vocabulary}, "data_source")
    people = with_choices(people, choices, "data_source")
    sectors = values_of(people, "sector", vocabulary, choices["sector"])
    item = lambda pos, value: F.struct(pos.cast("int").alias("item_pos"), value.alias("value"))
    lists = {
        "sector": F.transform(sectors, lambda x, i: item(i + 1, x)),
        "primary_expertise": F.array(item(F.lit(1), F.col("primary_expertise"))),
        "matched_inferred_expertise_topics": F.transform("matched_inferred_expertise_topics", lambda x, i: item(i + 1, x)),
    }
    cells = people.select("id", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(FIELD_KINDS[f]).alias("kind"), items.alias("items")) for f, items in lists.items()])))
    values = cells.where("items is not null").select("id", "field_name", "kind", F.inline("items")).where(F.col("value").isNotNull() & (strip_blank(F.col("value")) != ""))
    return values.withColumn("term_id", map_values(F.col("value"), F.col("kind"), terms, aliases, notes)).where("term_id is not null").select("id", "field_name", "item_pos", "term_id")
