"""Several values packed in one cell: delimiter inference per source, protected split, explode with position.

Edge cases (defined results): null, blank and separator-only cells give no values; null elements of an array give no
values and take no place; an unclosed quotation mark is ordinary text; cells of any length are split without
backtracking (possessive quantifiers only); repeated values are kept; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import broadcast_if_small, checkpoint


@dataclass(frozen=True)
class Delimiter:
    """A candidate: its Java pattern and how likely it is to be one before any cell was seen."""

    name: str
    pattern: str
    prior: float


#: Candidates scored for every source. Marks that also occur inside values count only with blanks around them.
CANDIDATES = (
    Delimiter("semicolon", ";", 0.95),
    Delimiter("comma", ",", 0.9),
    Delimiter("pipe", r"\|", 0.95),
    Delimiter("bullet", "[•·]", 0.95),
    Delimiter("newline", r"[\r\n]", 0.95),
    Delimiter("tab", r"\t", 0.95),
    Delimiter("break tag", r"<[bB][rR]\s*+/?>", 0.95),
    Delimiter("spaced slash", r"(?:(?<=\s)|^)/(?=\s|$)", 0.9),
    Delimiter("spaced dash", r"(?:(?<=\s)|^)[–—](?=\s|$)", 0.9),
    Delimiter("spaced hyphen", r"(?<=\s)-(?=\s)", 0.2),
    Delimiter("spaced ampersand", r"(?<=\s)&(?=\s)", 0.1),
    Delimiter("spaced plus", r"(?<=\s)\+(?=\s)", 0.1),
    Delimiter("full stop", r"\.", 0.1),
    Delimiter("colon", ":", 0.3),
)
#: Pseudo-observations behind each prior, and the score from which a candidate is taken.
PRIOR_WEIGHT = 20
ACCEPT_SCORE = 0.6

QUOTED = r'"[^"]*+"(?:"[^"]*+")*+|“[^”]*+”'
_SPACE = r"[\s\p{Z}]"
_MARK = "\u0001"


def term_pattern(terms: list[str], containing: str | None = None) -> str | None:
    """Java alternation of terms, longest first, as whole words in any case; ``containing`` keeps those it is found in."""
    kept = [t for t in terms if t and (containing is None or re.search(containing, t))]
    if not kept:
        return None
    alternatives = "|".join(_quote(t) for t in sorted(set(kept), key=lambda t: (-len(t), t)))
    flags = "i" if alternatives.isascii() else "iu"
    return rf"(?<![\p{{L}}\p{{N}}])(?{flags}:{alternatives})(?![\p{{L}}\p{{N}}])"


def _quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def strip_blank(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}++|{_SPACE}++$", "")


def split_values(cell: Column, separators: str, terms: list[str]) -> Column:
    """The values of one cell. ``separators`` is a Java alternation; quoted text and ``terms`` are never cut."""
    protected = term_pattern(terms, r"[^\w\s&]")
    body = "|".join(x for x in (QUOTED, protected, r"[\p{L}\p{N}]++\x20*+", rf"(?!{separators})[\s\S]") if x)
    # The separator is the second alternative, so that all of it is consumed; its group 1 is empty.
    pieces = F.regexp_extract_all(cell, F.lit(f"((?:{body})++)|(?:{separators})"), F.lit(1))
    many = F.filter(F.transform(pieces, lambda p: _unquote(strip_blank(p))), lambda p: p != "")
    one = F.array_remove(F.array(_unquote(strip_blank(cell))), "")
    return F.when(cell.rlike(separators), many).when(cell.isNotNull(), one)


def _unquote(p: Column) -> Column:
    straight = p.rlike(r'^"[^"]*+(?:""[^"]*+)*+"$') & (F.length(p) > 1)
    curly = p.rlike("^“[^”]*+”$")
    inner = F.substring(p, F.lit(2), F.length(p) - 2)
    return strip_blank(F.when(straight, F.replace(inner, F.lit('""'), F.lit('"'))).when(curly, inner).otherwise(p))


def score_delimiters(df: DataFrame, fields: dict[str, list[str]], source: str, candidates=CANDIDATES) -> DataFrame:
    """Per field, source and candidate: cells it cuts, its pieces, regular pieces, and the spread of the piece counts.

    ``fields`` are string or list columns with the vocabulary of each. One pass over all of them with map-side partial
    aggregation; the result has at most fields x sources x candidates rows.
    """
    kinds = dict(df.dtypes)
    any_mark = "|".join(c.pattern for c in candidates)

    def masked(cell: Column, terms: list[str]) -> Column:
        known = term_pattern(terms)
        quoted = F.regexp_replace(cell, QUOTED, _MARK)
        return F.regexp_replace(quoted, known, _MARK) if known else quoted

    def cells(field: str) -> Column:
        own = F.col(field) if kinds[field].startswith("array") else F.array(field)
        return F.transform(F.filter(own, lambda x: x.rlike(any_mark)), lambda x: masked(x, fields[field]))

    lists = df.select(F.col(source).cast("string").alias("source"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(bool(term_pattern(t))).alias("known"), cells(f).alias("cells")) for f, t in fields.items()])))
    base = lists.where(F.size("cells") > 0).select("field", "known", "source", F.explode("cells").alias("m")).where(F.col("m").rlike(any_mark))
    # Masked cells repeat a lot, so they are counted before any of them is split.
    shapes = base.groupBy("field", "known", "source", "m").agg(F.count(F.lit(1)).alias("w"))
    regular = lambda p: F.when(F.col("known"), p == _MARK).otherwise(p.rlike(r"^[\p{L}\p{N}" + _MARK + r"][^.;|]{0,60}$"))

    def stats(c: Delimiter) -> Column:
        pieces = F.transform(F.split("m", c.pattern), strip_blank)
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("r"))
        counted = F.aggregate(pieces, zero, lambda acc, p: F.struct((acc["n"] + (p != "").cast("int")).alias("n"), (acc["r"] + ((p != "") & regular(p)).cast("int")).alias("r")))
        return F.struct(F.lit(c.name).alias("delimiter"), counted.alias("x"))

    long = shapes.select("field", "source", "w", F.inline(F.array(*[stats(c) for c in candidates]))).where("x.n > 1")
    n, w = F.col("x.n"), F.col("w")
    sums = long.groupBy("field", "source", "delimiter").agg(F.sum(n * w).alias("pieces"), F.sum(F.col("x.r") * w).alias("regular"), F.sum("w").alias("cells"), F.sum(n * n * w).alias("squares"))
    mean = F.col("pieces") / F.col("cells")
    return sums.withColumn("spread", F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("cells") - mean * mean))).drop("squares")


@dataclass(frozen=True)
class Choices:
    """Delimiters taken for one field: over all sources, and where a source's own differ from these."""

    default: str
    #: The alternations that some sources have instead (subsets of the candidates, however many sources there are).
    others: tuple[str, ...]
    #: (source, choice) of those sources.
    table: DataFrame | None


def choose_delimiters(scores: DataFrame, candidates=CANDIDATES) -> dict[str, Choices]:
    """Field -> the delimiters taken, chosen per source in the table and joined back by source; only distinct choices and
    the sums over all sources come to the driver.

    Score: share of regular pieces, smoothed by the prior, times a consistency factor of the piece counts.
    """
    priors = F.create_map(*[F.lit(x) for c in candidates for x in (c.name, c.prior)])
    patterns = F.create_map(*[F.lit(x) for c in candidates for x in (c.name, c.pattern)])
    order = F.create_map(*[F.lit(x) for i, c in enumerate(candidates) for x in (c.name, i)])
    # A candidate that was never seen is judged by its prior alone.
    unseen = [c.name for c in candidates if c.prior >= ACCEPT_SCORE]

    def choice(keys: list[str], sums: DataFrame) -> DataFrame:
        score = (F.col("regular") + PRIOR_WEIGHT * priors[F.col("delimiter")]) / (F.col("pieces") + PRIOR_WEIGHT) / (1 + 0.05 * F.col("spread"))
        seen = sums.groupBy(*keys).agg(F.collect_list(F.struct("delimiter", (score >= ACCEPT_SCORE).alias("taken"))).alias("d"))
        names = F.transform(F.filter("d", lambda x: x["taken"]), lambda x: x["delimiter"])
        free = F.array_except(F.array(*[F.lit(u) for u in unseen]), F.transform("d", lambda x: x["delimiter"]))
        ranked = F.array_sort(F.transform(F.concat(names, free), lambda x: F.struct(order[x].alias("i"), x.alias("x"))))
        return seen.select(*keys, F.array_join(F.transform(ranked, lambda r: patterns[r["x"]]), "|").alias("choice"))

    scores = checkpoint(scores)
    pooled = scores.groupBy("field", "delimiter").agg(F.sum("pieces").alias("pieces"), F.sum("regular").alias("regular"), (F.sum(F.col("spread") * F.col("cells")) / F.sum("cells")).alias("spread"))
    default = {r["field"]: r["choice"] or NOTHING for r in choice(["field"], pooled).collect()}
    own = checkpoint(choice(["field", "source"], scores.where("source is not null")))
    distinct = own.select("field", "choice").distinct().collect()
    out = {}
    for field in default:
        others = tuple(sorted({r["choice"] or NOTHING for r in distinct if r["field"] == field} - {default[field]}))
        table = own.where(F.col("field") == field).select("source", F.when(F.col("choice") == "", NOTHING).otherwise(F.col("choice")).alias("choice")).where(F.col("choice") != default[field])
        out[field] = Choices(default[field], others, table if others else None)
    return out


#: A pattern that cuts nothing, and what is taken where no cell shows any candidate.
NOTHING = r"(?!)"
UNSEEN = Choices("|".join(c.pattern for c in CANDIDATES if c.prior >= ACCEPT_SCORE), (), None)


def infer_all(df: DataFrame, fields: dict[str, list[str]], source: str) -> dict[str, Choices]:
    """The delimiters of several columns (string or list) of a table, in one pass."""
    found = choose_delimiters(score_delimiters(df, fields, source))
    return {f: found.get(f, UNSEEN) for f in fields}


def with_choices(df: DataFrame, choices: dict[str, Choices], source: str) -> DataFrame:
    """Adds ``_choice_<field>`` where sources differ: an equality join with the sources' own choices, broadcast if small."""
    for field, c in choices.items():
        if c.table is not None:
            own = c.table.select(F.col("source").alias("_source"), F.col("choice").alias(f"_choice_{field}"))
            df = df.join(broadcast_if_small(own), F.col(source).cast("string") == F.col("_source"), "left").drop("_source")
    return df


def splitter(field: str, terms: list[str], choices: Choices):
    """Function of a cell column to its values, by the delimiters of the row's source; equal choices share one branch."""

    def split(cell: Column) -> Column:
        out = split_values(cell, choices.default, terms)
        for choice in choices.others:
            out = F.when(F.col(f"_choice_{field}") == choice, split_values(cell, choice, terms)).otherwise(out)
        return out

    return split


def values_of(df: DataFrame, field: str, terms: list[str], choices: Choices) -> Column:
    """Array of the values of a column of ``with_choices`` (of all elements of a list, null elements left out)."""
    split = splitter(field, terms, choices)
    is_array = dict(df.dtypes)[field].startswith("array")
    return F.flatten(F.transform(F.filter(field, lambda x: x.isNotNull()), split)) if is_array else split(F.col(field))


FIELD_KINDS = {"geography": "geography", "sector": "sector", "inferred_expertise_functional": "functional"}


def terms_by_kind(reference_terms: DataFrame, kinds: list[str]) -> dict[str, list[str]]:
    """The vocabulary, a small table by definition (it doesn't grow with the data)."""
    out: dict[str, list[str]] = {k: [] for k in kinds}
    for r in reference_terms.select("kind", "term").where(F.col("kind").isin(kinds) & F.col("term").isNotNull()).collect():
        out[r["kind"]].append(r["term"])
    return out


def unpack_values(people: DataFrame, reference_terms: DataFrame, fields: dict[str, str] | None = None, packed_only: bool = True) -> DataFrame:
    """(id, field_name, item_pos, item): one row per value, of packed cells only or of all cells.

    A single pass over the table; no shuffle besides the tiny score aggregation.
    """
    fields = fields or FIELD_KINDS
    vocabulary = terms_by_kind(reference_terms, sorted(set(fields.values())))
    if "data_source" not in people.columns:
        people = people.withColumn("data_source", F.lit(None).cast("string"))
    choices = infer_all(people, {f: vocabulary[k] for f, k in fields.items()}, "data_source")
    people = with_choices(people, choices, "data_source")
    structs = []
    for field, kind in fields.items():
        split = splitter(field, vocabulary[kind], choices[field])
        if dict(people.dtypes)[field].startswith("array"):
            # Elements are split once; a list is packed if one of them gives several values.
            pieces = F.transform(F.filter(field, lambda x: x.isNotNull()), split)
            values = F.aggregate(pieces, F.struct(F.array().cast("array<string>").alias("all"), F.lit(False).alias("packed")), lambda acc, x: F.struct(F.concat(acc["all"], x).alias("all"), (acc["packed"] | (F.size(x) > 1)).alias("packed")), lambda acc: F.when(acc["packed"] | F.lit(not packed_only), acc["all"]))
        else:
            values = split(F.col(field))
            if packed_only:
                values = F.when(F.col(field).rlike("|".join((choices[field].default, *choices[field].others))), values)
        structs.append(F.struct(F.lit(field).alias("field_name"), values.alias("items")))
    cells = people.select("id", F.inline(F.array(*structs))).where(F.col("items").isNotNull())
    if packed_only:
        cells = cells.where(F.size("items") > 1)
    return cells.select("id", "field_name", F.posexplode("items").alias("p", "item")).select("id", "field_name", (F.col("p") + 1).cast("int").alias("item_pos"), "item")
