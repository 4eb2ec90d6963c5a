"""Rule-based classification: keyword hits, evidence filters, vocabulary validation, merging with an external classifier."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null
from millrace.functions.udfs import close_match

# The canonical categories, in their order, other names for them, and the order of choice for one label.
CATEGORIES = ("Revenue Growth", "Operational Improvements", "Finance and Accounting", "Marketing", "People and Talent", "Technology", "M&A and Corporate Development", "Real Estate & Assets", "R&D", "Environment (ESG)", "Governance (ESG)", "Social (ESG)", "Legal")
ALIASES = {"tax": "Finance and Accounting", "tax advisory": "Finance and Accounting", "restructuring": "M&A and Corporate Development", "digital": "Technology", "data analytics": "Technology", "esg": "Environment (ESG)", "hr": "People and Talent", "human resources": "People and Talent"}
PRIORITY = ("Finance and Accounting", "M&A and Corporate Development", "Operational Improvements", "Revenue Growth", "Technology", "People and Talent", "Marketing", "Legal", "Governance (ESG)")
NO_CATEGORY = "Management Consulting"

KeywordMap = dict[str, list[str]]

# Categories that need evidence in the person's own text, and the words that are evidence.
REQUIRED_EVIDENCE: KeywordMap = {
    "R&D": ["r&d", "research and development", "research lab", "patent", "innovation pipeline", "r & d"],
    "People and Talent": [
        "people & organization", "people and organization", "talent management practice", "talent advisory", "human resources practice", "hr practice", "hr leader", "people chair", "people practice", "people lead", "chief people officer", "chief human resources", "workforce planning", "people officer",
        "organizational effectiveness practice", "talent practice", "human resources", "hr consultant", "hr director", "hr manager", "hr business partner", "hrbp", "hr transformation", "hr advisory", "talent acquisition", "talent development", "talent management", "recruitment", "executive search",
        "headhunting", "learning and development", "l&d", "training and development", "employee relations", "employee engagement", "organizational development", "organisation development", "people analytics", "workforce analytics", "people director", "hr specialist", "hr generalist",
        "compensation and benefits", "total rewards", "diversity, equity", "diversity and inclusion", "succession planning", "performance management",
    ],
    "Environment (ESG)": ["climate practice", "sustainability practice", "climate & sustainability", "climate and sustainability", "esg practice", "esg reporting", "esg advisory", "decarbonization", "decarbonisation", "net-zero", "net zero", "nature-positive", "environmental advisory"],
    "Social (ESG)": ["social impact", "social responsibility", "social practice", "dei practice", "diversity, equity", "diversity and inclusion", "community impact"],
    "Governance (ESG)": ["board governance", "esg governance", "governance framework", "governance architecture", "audit committee", "corporate governance advisory", "esg reporting"],
    "Legal": ["general counsel", "chief legal", "legal officer", "litigation", "law firm", "legal practice", "legal advisory", "in-house counsel", "legal and regulatory"],
}


def load_keyword_map(path: str) -> KeywordMap:
    """A keyword map {category: [keyword]} from a JSON file; its order is the order of the categories."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def keyword_hits(text: Column, keywords: KeywordMap) -> Column:
    """array<struct<category, hits>>: categories in map order with the keywords that stand in the text (literally)."""
    found = F.array(*[F.struct(F.lit(c).alias("category"), F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: text.contains(k)).alias("hits")) for c, ks in keywords.items()])
    return F.filter(found, lambda x: F.size(x["hits"]) > 0)


def primary_by_priority(categories: Column, priority: tuple[str, ...] = PRIORITY) -> Column:
    """The first category of the priority list that is there, else the first of all, else the stand-in."""
    first = F.get(F.filter(F.array(*[F.lit(p) for p in priority]), lambda p: F.array_contains(categories, p)), F.lit(0))
    return F.coalesce(first, F.get(categories, F.lit(0)), F.lit(NO_CATEGORY))


def evidence_filter(categories: Column, text: Column, required: KeywordMap) -> Column:
    """Drops restricted categories without a required keyword in the text."""
    ok = F.map_from_arrays(F.array(*[F.lit(c) for c in required]), F.array(*[F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: text.contains(k)) for ks in required.values()]))
    return F.filter(categories, lambda c: F.coalesce(ok[c], F.lit(True)))


def strip_verbatim(inferred: Column, declared: Column) -> Column:
    """Drops items that stand literally in the declared text."""
    return F.filter(inferred, lambda i: ~F.lower(declared).contains(F.lower(i)))


def resolve_ids(values: Column, vocabulary: list[str]) -> Column:
    """Entries given as 1-based numbers or exact names, in order, once each; unknown ones drop out."""
    names = F.array(*[F.lit(v) for v in vocabulary])
    one = lambda v: F.when(F.array_contains(names, v), v).otherwise(F.get(names, v.try_cast("int") - 1))
    return F.array_distinct(F.filter(F.transform(values, one), lambda x: x.isNotNull()))


def validate_categories(df: DataFrame, column: str, intruders: list[str], vocabulary: tuple[str, ...] = CATEGORIES, aliases: dict[str, str] = ALIASES, key: str = "id") -> DataFrame:
    """(key, value, category, how) per list element: exact, alias, fuzzy (0.8) or rejected; sector names are dropped.

    Exact names and aliases are looked up in literal maps; only the remaining distinct values reach the Python UDF.
    """
    low = F.lower(F.trim("value"))
    exact = {v.lower(): v for v in vocabulary}
    lookup = lambda m: F.create_map(*[F.lit(x) for k, v in m.items() for x in (k, v)])[low] if m else F.lit(None).cast("string")
    items = df.select(key, F.explode(column).alias("value")).where("value is not null").where(~low.isin([i.lower() for i in intruders]) if intruders else F.lit(True))
    known = items.withColumn("category", F.coalesce(lookup(exact), lookup(aliases))).withColumn("how", F.when(lookup(exact).isNotNull(), "exact").when(lookup(aliases).isNotNull(), "alias"))
    open_ = known.where("category is null").select("value").distinct().withColumn("near", close_match(list(vocabulary))("value"))
    joined = known.join(open_, "value", "left")
    return joined.select(key, "value", F.coalesce("category", "near").alias("category"), F.coalesce("how", F.when(F.col("near").isNotNull(), "fuzzy").otherwise("rejected")).alias("how"))


def taxonomy_hints(people: DataFrame, mapping: DataFrame, tags: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(id, hints): sorted distinct categories of a person's tags by a mapping (tag, category)."""
    exploded = people.select("id", F.explode(tags).alias("tag")).where(~F.col("tag").isin(*skip) if skip else F.lit(True))
    return exploded.join(mapping, "tag").groupBy("id").agg(F.array_sort(F.collect_set("category")).alias("hints"))


def flatten_taxonomy(tree: Column) -> Column:
    """Names of both levels of a tree array<struct<name, children array<string>>>."""
    return F.flatten(F.transform(tree, lambda n: F.concat(F.array(n["name"]), F.coalesce(n["children"], F.array()))))


def merge_values(model: Column, keyword: Column) -> Column:
    """Ordered union ignoring case: the model's values first."""
    extra = F.filter(keyword, lambda k: ~F.exists(model, lambda m: F.lower(m) == F.lower(k)))
    return F.concat(model, extra)


def merge_results(keyword: DataFrame, model: DataFrame) -> DataFrame:
    """Keyword result where the model gave none, else the model's with the keyword categories and evidence added.

    Both: (id, primary string, categories array<string>, evidence map<string, array<string>>).
    """
    k = keyword.select("id", *[F.col(c).alias(f"k_{c}") for c in ("primary", "categories", "evidence")])
    j = k.join(model, "id", "left")
    there = F.col("categories").isNotNull()
    merged = F.array_sort(F.array_distinct(F.concat("categories", "k_categories")))
    primary = F.when(F.array_contains(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("primary")), F.col("primary")).otherwise(F.get(merged, F.lit(0)))
    evidence = F.map_zip_with(F.coalesce("evidence", F.create_map().cast("map<string,array<string>>")), "k_evidence", lambda c, a, b: F.slice(F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))), 1, 5))
    return j.select("id", F.when(there, F.coalesce(blank_to_null(primary), F.col("k_primary"))).otherwise(F.col("k_primary")).alias("primary"), F.when(there, merged).otherwise(F.col("k_categories")).alias("categories"), F.when(there, evidence).otherwise(F.col("k_evidence")).alias("evidence"))


class Classifier(Protocol):
    """An external classifier: one answer (a JSON text) per batch of rendered people."""

    def __call__(self, texts: list[str]) -> list[str]: ...


def classify(people: DataFrame, rendered: str, classifier: Classifier, batch: int = 10) -> DataFrame:
    """(id, answer): answers of an external classifier, called on batches inside the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers: list[str] = []
            for i in range(0, len(f), batch):
                answers += classifier(f[rendered].iloc[i : i + batch].tolist())
            yield pd.DataFrame({"id": f["id"], "answer": answers})

    return people.select("id", rendered).mapInPandas(run, "id long, answer string")


def render_person(people: DataFrame) -> DataFrame:
    """(id, rendered): the text block an external classifier reads."""
    line = lambda label, c: F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(label + ": "), c))
    return people.select("id", F.concat_ws("\n", line("Name", F.col("name")), line("Title", F.col("title")), line("Department", F.col("department")), line("Bio", F.left("bio", F.lit(500))), line("Topics", F.array_join(F.slice("matched_inferred_expertise_topics", 1, 20), ", "))).alias("rendered"))
