"""Template residue, filler and error-page text in fields of records (problem 7).

A multi-pattern automaton finds multilingual error, filler and script-required phrases. A text is residue when, in some
sentence of it, the matched phrases cover most of the letters: a sentence that merely speaks about such things is
covered to a small part only. Unfilled placeholders are residue wherever they stand.

Edge cases: null, blank, dash-only and cut-off texts are no residue; texts of any length are read whole (the automaton is
linear); repeated rows give the same result each; extra columns are ignored.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Share of a sentence's letters that the phrases must cover.
COVERAGE = 0.55

# The words of the usual filler text.
LOREM_WORDS = (
    "lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "do", "eiusmod", "tempor", "incididunt", "ut", "labore", "et", "dolore", "magna", "aliqua", "enim", "ad", "minim", "veniam", "quis",
    "nostrud", "exercitation", "ullamco", "laboris", "nisi", "aliquip", "ex", "ea", "commodo", "consequat", "duis", "aute", "irure", "in", "reprehenderit", "voluptate", "velit", "esse", "cillum", "eu", "fugiat", "nulla",
    "pariatur", "excepteur", "sint", "occaecat", "cupidatat", "non", "proident", "sunt", "culpa", "qui", "officia", "deserunt", "mollit", "anim", "id", "est", "laborum",
)


@lru_cache(maxsize=8)
def load_phrases(path: str | None = None) -> dict[str, tuple[str, ...]]:
    """Section -> phrases of a phrase file (``phrases.txt`` of this package if none is given)."""
    text = Path(path).read_text(encoding="utf-8") if path else pkgutil.get_data(__package__, "phrases.txt").decode()
    out: dict[str, list[str]] = {}
    section = ""
    for line in map(str.strip, text.splitlines()):
        if line.startswith("[") and line.endswith("]") and line != "[object object]":
            section = line[1:-1]
        elif line and not line.startswith("#"):
            out.setdefault(section, []).append(line)
    return {k: tuple(v) for k, v in out.items()}


_IDENT = r"[A-Za-z_][A-Za-z0-9_.]*"
_TAGS = "p|br|b|i|u|a|em|strong|span|div|li|ul|ol|noscript|script|style|h[1-6]|td|tr|table|img|hr|sup|sub|small|html|body|head|title|section|article|header|footer|nav|main|font|center"
#: Unfilled placeholders in the notations of common template languages.
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_IDENT}\s*\}}\}}|\$\{{\s*{_IDENT}\s*\}}|\#\{{\s*{_IDENT}\s*\}}|\{{%\s*{_IDENT}\s*%\}}|(?<![\w{{])\{{\s*{_IDENT}\s*\}}|<%=?\s*{_IDENT}\s*%>|\[\[\s*{_IDENT}\s*\]\]|\[insert\s+{_IDENT}\s*\]|\[{_IDENT}\s+here\]|\[(?:your|enter|add)\s[\w ]{{1,30}}\]"
    rf"|%%\s*{_IDENT}\s*%%|@@\s*{_IDENT}\s*@@|(?<!\w)__{_IDENT.replace('[A-Za-z_]', '[A-Za-z]', 1)}__(?!\w)|\*\|\s*{_IDENT}\s*\|\*|<(?!/?(?:{_TAGS})\b){_IDENT}>|\[object object\]|\b[A-Z]+(?:_[A-Z0-9]+)+\b|«{_IDENT}»",
    re.I,
)
_SCREAMING = re.compile(r"^[A-Z]+(?:_[A-Z0-9]+)+$")
_OPENERS = re.compile(r"[{\[<%@_*«]")
_TAG = re.compile(rf"</?(?:{_TAGS})\b[^<>]{{0,200}}>", re.I)
_SENTENCE_END = re.compile(r"(?<=[.!?…。])[\s]+|[\r\n]+|\s[|]\s")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT_WORD = re.compile(r"\b\w*\d\w*\b")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=8)
def automaton(names: bool, path: str | None = None) -> ahocorasick.Automaton:
    """Automaton over all phrases; ``names`` adds those that are residue only where a name is expected."""
    phrases, out = load_phrases(path), ahocorasick.Automaton()
    also = phrases.get("also names", ())
    for section in ("scripts", "errors", "filler", *(["names"] if names else [])):
        for phrase in phrases.get(section, ()):
            if not (names and phrase in also):
                out.add_word(phrase, len(phrase))
    out.make_automaton()
    return out


_LOREM = frozenset(LOREM_WORDS)
_LATIN_ONLY = frozenset(w for w in LOREM_WORDS if len(w) > 3)


def has_placeholder(text: str) -> bool:
    if not _OPENERS.search(text):
        return False
    for m in PLACEHOLDER.finditer(text):
        hit = m.group()
        if hit[0].isalpha() and not _SCREAMING.match(hit):
            continue
        return True
    return False


def covered_share(sentence: str, names: bool, path: str | None = None) -> float:
    """Share of the letters of a lower-case sentence inside matched phrases; words with digits don't count."""
    total = len(_LETTER.findall(_DIGIT_WORD.sub(" ", sentence)))
    if not total:
        return 0.0
    spans: list[tuple[int, int]] = []
    for end, length in automaton(names, path).iter(sentence):
        a, b = end - length + 1, end + 1
        before = sentence[a - 1] if a else " "
        after = sentence[b] if b < len(sentence) else " "
        if length == 3 and sentence[a:b] == "xxx" or not ((before.isalnum() and sentence[a].isalnum()) or (after.isalnum() and sentence[b - 1].isalnum())):
            spans.append((a, b))
    words = [m for m in _WORD.finditer(sentence)]
    lorem = [m for m in words if m.group() in _LOREM]
    if len(lorem) >= 2 and sum(m.group() in _LATIN_ONLY for m in lorem) >= max(1, len(lorem) // 3):
        spans += [m.span() for m in lorem]
    covered, reach = 0, 0
    for a, b in sorted(spans):
        a = max(a, reach)
        if b > a:
            covered += len(_LETTER.findall(_DIGIT_WORD.sub(" ", sentence[a:b])))
            reach = b
    return covered / total


def is_residue(text: str | None, names: bool = False, path: str | None = None) -> bool:
    """Whether the text is template residue, filler or an error page, or contains some of it."""
    if text is None or not text.strip():
        return False
    if has_placeholder(text):
        return True
    low = _TAG.sub(" ", text).lower().replace(" ", " ").replace("’", "'")
    if next(automaton(names, path).iter(low), None) is None and not any(w in low for w in ("lorem", "ipsum", "dolor", "adipiscing", "eiusmod", "tempor", "nostrud", "magna")):
        return False
    for sentence in [low] if names else _SENTENCE_END.split(low):
        sentence = " ".join(sentence.split())
        if sentence and covered_share(sentence, names, path) >= COVERAGE:
            return True
    return False


def residue_flag(c: Column, names: bool = False, phrases: str | None = None) -> Column:
    """Boolean column: the text is residue (never null). The phrases come from this package, or from a file that every worker can read."""

    @F.pandas_udf(BooleanType())
    def flag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([is_residue(t, names, phrases) for t in texts], dtype=bool)

    return flag(c)


def find_residue(people: DataFrame, fields: tuple[str, ...] = ("bio", "name"), phrases: str | None = None) -> DataFrame:
    """(id, field_name): one row per row and field that holds residue. One pass, no shuffle."""
    flags = people.select("id", *[residue_flag(F.col(f), f == "name", phrases).alias(f) for f in fields])
    hits = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return flags.select("id", F.explode(hits).alias("field_name"))


def keep_real_names(people: DataFrame) -> DataFrame:
    """The rows whose name is not residue."""
    return people.where(~residue_flag(F.col("name"), names=True))
