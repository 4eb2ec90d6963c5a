"""Data-quality rules as column expressions: each gives a message and a rule id; status and histogram follow from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null
from millrace.operators.analytics import check_page
from millrace.operators.classify import CATEGORIES


@dataclass(frozen=True)
class Limits:
    categories: int = 4
    declared: int = 8
    inferred: int = 12
    topics: int = 20


def _none() -> Column:
    return F.array().cast("array<string>")


def listed(items: Column) -> Column:
    """A list as it stands in messages: ['a', 'b']."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def rules(columns: set[str], vocabulary: tuple[str, ...] = CATEGORIES, sectors: tuple[str, ...] = (), limits: Limits = Limits()) -> list[tuple[str, str, Column]]:
    """(rule id, level, message or null) for the columns that a table has: primary_expertise, categories, matched_sector,
    inferred, topics, declared, reasoning, evidence_sectors, declared_text, analysed."""
    has = columns.__contains__
    known = F.array(*[F.lit(v) for v in vocabulary])
    arr = lambda c: F.coalesce(F.col(c), _none()) if has(c) else _none()
    pe = blank_to_null(F.col("primary_expertise"))
    cats, sec, inferred = arr("categories"), arr("matched_sector"), arr("inferred")
    out: list[tuple[str, str, Column]] = []
    say = lambda rule, level, when, *parts: out.append((rule, level, F.when(when, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))))
    say("primary_value", "hard", ~F.array_contains(known, pe), "primary_expertise '", pe, "' is not a valid taxonomy value")
    bad = F.filter(cats, lambda c: ~F.array_contains(known, c))
    say("category_value", "hard", F.size(bad) > 0, "categories contains invalid values: ", listed(bad))
    if has("matched_sector"):
        wrong = F.filter(sec, lambda c: ~F.array_contains(F.array(*[F.lit(v) for v in sectors]).cast("array<string>"), c))
        say("sector_value", "hard", F.size(wrong) > 0, "matched_sector contains invalid values: ", listed(wrong))
    for name, most in (("categories", limits.categories), ("declared", limits.declared), ("inferred", limits.inferred), ("topics", limits.topics)):
        if has(name):
            say(f"{name}_count", "soft", F.size(arr(name)) > most, f"{name} has ", F.size(arr(name)).cast("string"), f" items (max {most})")
    say("primary_listed", "hard", pe.isNotNull() & (F.size(cats) > 0) & ~F.coalesce(F.array_contains(cats, pe), F.lit(False)), "primary_expertise '", pe, "' not present in categories")
    if has("reasoning"):
        say("reasoning", "hard", (F.size(inferred) > 0) & blank_to_null(F.col("reasoning")).isNull(), "reasoning is empty but inferred is non-empty")
    if has("evidence_sectors"):
        extra = F.array_sort(F.array_except(arr("evidence_sectors"), sec))
        say("evidence", "hard", F.size(extra) > 0, "evidence_map has entries not committed to matched_sector: ", listed(extra))
    if has("declared_text"):
        copied = F.filter(inferred, lambda i: F.lower(F.coalesce("declared_text", F.lit(""))).contains(F.lower(i)))
        say("verbatim", "hard", F.size(copied) > 0, "inferred contains verbatim profile text: ", listed(copied))
    done = F.coalesce(F.col("analysed"), F.lit(False)) if has("analysed") else F.lit(True)
    if has("matched_sector"):
        say("sector_missing", "soft", done & (F.size(sec) == 0), "matched_sector is empty")
    say("category_missing", "soft", done & (F.size(cats) == 0), "categories is empty")
    say("primary_missing", "soft", done & pe.isNull(), "primary_expertise is not set after analysis")
    return out


def issue_kind(message: Column) -> Column:
    """Bucket of a message, by the first phrase that fits."""
    m = F.lower(message)
    return (
        F.when(m.contains("not a valid taxonomy") | m.contains("invalid values"), "taxonomy_violation").when(m.contains("items (max"), "count_violation").when(m.contains("verbatim"), "verbatim_copy")
        .when(m.contains("evidence_map") | m.contains("not committed") | m.contains("not present in"), "consistency").when(m.contains("empty") | m.contains("not set"), "missing_fields").otherwise("other")
    )


def validate(people: DataFrame, **kw) -> DataFrame:
    """(id, status, hard, soft): messages of all rules and the status they give. One pass, no shuffle."""
    found = rules(set(people.columns), **kw)
    pick = lambda level: F.filter(F.array(*[m for _, l, m in found if l == level]), lambda x: x.isNotNull())
    hard, soft = pick("hard"), pick("soft")
    return people.select("id", hard.alias("hard"), soft.alias("soft")).withColumn("status", F.when(F.size("hard") > 0, "failed").when(F.size("soft") > 0, "flagged").otherwise("clean"))


def status_histogram(validated: DataFrame) -> DataFrame:
    return validated.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def issue_histogram(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode(F.concat("hard", "soft")).alias("m")).groupBy(issue_kind(F.col("m")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def select_issues(validated: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Validated rows with a status or a kind of issue; at least one filter must be given."""
    if status is None and kind is None:
        raise ValueError("give a status or a kind of issue")
    out = validated if status is None else validated.where(F.col("status") == status)
    return out if kind is None else out.where(F.exists(F.concat("hard", "soft"), lambda m: issue_kind(m) == kind))


def issue_page(people: DataFrame, companies: DataFrame, validated: DataFrame, status: str | None = None, kind: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of validated people with the name of their company, by name; filters are optional here."""
    check_page(page, size, 200)
    chosen = validated if status is None and kind is None else select_issues(validated, status, kind)
    labels = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    named = people.select("id", F.col("name").alias("person_name"), "company_id").join(labels, "company_id")
    rows = chosen.join(named, "id").select("id", "person_name", "company_id", "company_name", "status", "hard", "soft")
    return rows.orderBy(F.asc_nulls_last("person_name"), "id").offset((page - 1) * size).limit(size)


def layer_rules(people: DataFrame) -> DataFrame:
    """(id, issue): what the layers of a result break beyond ``rules``: a layer that is not in alphabetical order, an entry in
    two layers, a topic twice. Columns: categories, declared, inferred, topics."""
    layers = {c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), _none()) for c in ("categories", "declared", "inferred", "topics") if c in people.columns}
    found = [F.when(layers[c] != F.array_sort(layers[c]), f"{c} not sorted") for c in layers if c != "inferred"]
    names = [c for c in ("categories", "declared", "inferred") if c in layers]
    found += [F.when(F.arrays_overlap(layers[a], layers[b]), f"{a} and {b} overlap") for i, a in enumerate(names) for b in names[i + 1 :]]
    if "topics" in layers:
        found.append(F.when(F.size(F.array_distinct(layers["topics"])) < F.size(layers["topics"]), "topics repeated"))
    return people.select("id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("issue"))


# Where evidence may come from, and how many words of it are kept.
EVIDENCE_SOURCES = ("title", "department", "bio", "headline", "summary", "experience", "education", "skills", "industries", "capabilities", "location")
EVIDENCE_WORDS = 25


def evidence_rules(people: DataFrame, items: str = "items", evidence: str = "evidence") -> DataFrame:
    """(id, issue): entries of ``items`` without evidence, keys without entries, unknown sources and long quotations.
    ``evidence`` is map<string, array<struct<source, text>>>."""
    quotes = F.flatten(F.map_values(evidence))
    found = F.array(
        F.when(F.exists(items, lambda i: ~F.map_contains_key(F.col(evidence), i)), "entry without evidence"),
        F.when(F.exists(F.map_values(evidence), lambda v: F.size(v) == 0), "empty evidence"),
        F.when(F.exists(quotes, lambda q: ~q["source"].isin(*EVIDENCE_SOURCES)), "unknown source"),
        F.when(F.exists(quotes, lambda q: F.size(F.split(F.trim(q["text"]), r"\s+")) > EVIDENCE_WORDS), "long quotation"),
    )
    return people.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


# Regions, and the short forms that stand for one or two of them.
REGIONS = ("North America", "Latin America", "Europe", "Middle East & Africa", "Asia Pacific")
REGION_SHORT = {"emea": ("Europe", "Middle East & Africa"), "apac": ("Asia Pacific",), "latam": ("Latin America",), "americas": ("North America", "Latin America"), "asia-pacific": ("Asia Pacific",), "global": ()}


def to_regions(values: Column) -> Column:
    """Sorted distinct regions of a list of names: regions as they are, short forms by the table, others dropped."""
    short = F.create_map(*[x for k, v in REGION_SHORT.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]).cast("array<string>"))])
    known = F.create_map(*[x for r in REGIONS for x in (F.lit(r.lower()), F.array(F.lit(r)))])
    low = lambda v: F.lower(F.trim(v))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(values, lambda v: F.coalesce(known[low(v)], short[low(v)], _none())))))
