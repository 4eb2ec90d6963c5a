"""Answers of an external classifier brought back to people: matching, checking, guarding, applying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, join_list, split_list
from millrace.functions.udfs import close_match
from millrace.operators.classify import CATEGORIES, KeywordMap, evidence_filter, keyword_hits, primary_by_priority


def plain_name(name: Column) -> Column:
    """A name for comparing answers with people: lower case, blanks as one."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def match_answers(people: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, answer, how): answers (batch, pos, name, answer) given to the people (batch, pos, id, name) of their batch.

    By name, the last of equal names wins; a batch whose answers carry no name at all is matched by position if it has as
    many answers as people. Both are equality joins with the batch in the key.
    """
    named = answers.withColumn("n", plain_name(F.col("name"))).where("n <> ''")
    last = named.groupBy("batch", "n").agg(F.max_by("answer", "pos").alias("answer"))
    by_name = people.withColumn("n", plain_name(F.col("name"))).join(last, ["batch", "n"]).select("id", "answer", F.lit("name").alias("how"))
    counts = answers.groupBy("batch").agg(F.count(F.lit(1)).alias("given"), F.count(F.when(F.coalesce(plain_name(F.col("name")), F.lit("")) != "", 1)).alias("names"))
    sizes = people.groupBy("batch").agg(F.count(F.lit(1)).alias("people"))
    nameless = counts.join(sizes, "batch").where("names = 0 and given = people").select("batch")
    by_place = people.join(nameless, "batch", "left_semi").join(answers.select("batch", "pos", "answer"), ["batch", "pos"]).select("id", "answer", F.lit("position").alias("how"))
    return by_name.unionByName(by_place)


def guard_primary(df: DataFrame, vocabulary: tuple[str, ...] = CATEGORIES, intruders: tuple[str, ...] = (), hints: dict[str, str] | None = None) -> DataFrame:
    """(id, primary): the main label of (id, primary, categories) made valid.

    A sector's name gives its hint, else the first category; a valid name stays as written; a near one (0.8) is corrected;
    others give the first category, null if there is none.
    """
    low = F.lower(F.trim("primary"))
    first = F.get("categories", F.lit(0))
    hint = F.create_map(*[F.lit(x) for k, v in hints.items() for x in (k.lower(), v)])[low] if hints else F.lit(None).cast("string")
    intruder = low.isin(*[i.lower() for i in intruders]) if intruders else F.lit(False)
    valid = low.isin(*[v.lower() for v in vocabulary])
    # Only the distinct values that nothing else settles reach the Python UDF.
    odd = df.where(blank_to_null(F.col("primary")).isNotNull() & ~intruder & ~valid).select("primary").distinct().withColumn("near", close_match(list(vocabulary))("primary"))
    joined = df.join(odd, "primary", "left")
    out = F.when(blank_to_null(F.col("primary")).isNull(), F.lit(None)).when(intruder, F.coalesce(hint, first)).when(valid, F.col("primary")).otherwise(F.coalesce("near", first))
    return joined.select("id", out.alias("primary"))


# Fields that the first answer of a batch must have.
REQUIRED_FIELDS = ("primary_expertise", "explicit_expertise_13", "inferred_expertise_functional", "sectors", "geographies", "evidence_map")


def check_batches(answers: DataFrame, required: tuple[str, ...] = REQUIRED_FIELDS, vocabulary: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(batch, error): batches of answers (batch, pos, fields array<string>, categories array<string>) that must be asked again.

    The first answer must have all required fields; no answer may hold a category outside the vocabulary.
    """
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce("fields", F.array().cast("array<string>")))
    wrong = F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: ~c.isin(*vocabulary))
    first = answers.groupBy("batch").agg(F.min_by(missing, "pos").alias("missing"))
    bad = answers.select("batch", F.explode(wrong).alias("w")).groupBy("batch").agg(F.array_sort(F.collect_set("w")).alias("wrong"))
    both = first.join(bad, "batch", "left")
    parts = F.concat_ws("; ", F.when(F.size("missing") > 0, F.concat(F.lit("missing fields: "), F.array_join(F.array_sort("missing"), ", "))), F.when(F.size("wrong") > 0, F.concat(F.lit("invalid categories: "), F.array_join("wrong", ", "))))
    return both.select("batch", blank_to_null(parts).alias("error")).where("error is not null")


def couple_parents(sectors: Column, matched: Column, parents: dict[str, str]) -> Column:
    """Sectors with the parents of the matched ones added, sorted."""
    if not parents:
        return F.array_sort(F.array_distinct(sectors))
    of = F.create_map(*[F.lit(x) for k, v in parents.items() for x in (k, v)])
    return F.array_sort(F.array_union(sectors, F.filter(F.transform(matched, lambda m: of[m]), lambda p: p.isNotNull())))


def apply_answers(people: DataFrame, answers: DataFrame, text: Column, required: KeywordMap, sector_required: KeywordMap | None = None) -> DataFrame:
    """(id, the analysed fields): an answer written on to a person.

    Categories and matched sectors need their evidence in the person's text once more; lists of sectors and places become
    text; a practice that is named overwrites the department. Rows without an answer keep what they have.
    """
    a = answers.select("id", *[F.col(c).alias(f"new_{c}") for c in ("primary", "categories", "sectors", "matched_sectors", "geographies", "inferred", "topics", "practice")], F.lit(True).alias("answered"))
    j = people.withColumn("_text", text).join(a, "id", "left")
    none = F.array().cast("array<string>")
    filtered = lambda c, need: evidence_filter(F.coalesce(c, none), F.col("_text"), need) if need else F.coalesce(c, none)
    keep = lambda new, old: F.when(F.col("answered"), new).otherwise(old)
    empty = lambda c: F.when(F.size(c) > 0, c)
    return j.select(
        "id",
        keep(F.col("new_primary"), F.col("primary_expertise")).alias("primary_expertise"),
        keep(filtered(F.col("new_categories"), required), none).alias("categories"),
        keep(join_list(F.coalesce("new_sectors", none)), F.col("sector")).alias("sector"),
        keep(empty(filtered(F.col("new_matched_sectors"), sector_required)), F.lit(None)).alias("matched_sector"),
        keep(join_list(F.coalesce("new_geographies", none)), F.col("geography")).alias("geography"),
        keep(F.col("new_inferred"), F.col("inferred_expertise_functional")).alias("inferred_expertise_functional"),
        keep(F.col("new_topics"), F.col("matched_inferred_expertise_topics")).alias("matched_inferred_expertise_topics"),
        keep(F.coalesce(blank_to_null(F.col("new_practice")), F.col("department")), F.col("department")).alias("department"),
    )


def match_people(people: DataFrame, text: Column, categories: KeywordMap, functional: KeywordMap, geography: KeywordMap) -> DataFrame:
    """(id, categories, hits, primary, functional, geography, sectors): keyword results over all maps; sectors are left to the
    external classifier and stay empty."""
    named = lambda m: F.transform(keyword_hits(F.col("_text"), m), lambda x: x["category"])
    rows = people.select("id", text.alias("_text")).withColumn("_hits", keyword_hits(F.col("_text"), categories))
    cats = F.transform("_hits", lambda x: x["category"])
    return rows.select("id", cats.alias("categories"), F.map_from_entries(F.transform("_hits", lambda x: F.struct(x["category"], x["hits"]))).alias("hits"), primary_by_priority(cats).alias("primary"), named(functional).alias("functional"), named(geography).alias("geography"), F.array().cast("array<string>").alias("sectors"))


def person_entry(people: DataFrame, optional: tuple[str, ...] = (), hints: DataFrame | None = None) -> DataFrame:
    """(id, entry): the JSON object an external classifier reads; base fields always, others only if they say something."""
    base = [F.col(c) for c in ("name", "title", "department", "bio", "location")]
    kinds = dict(people.dtypes)
    extra = [F.when(F.size(c) > 0, F.col(c)).alias(c) if kinds[c].startswith("array") else blank_to_null(F.col(c)).alias(c) for c in optional if c in kinds]
    df = people
    if hints is not None:
        df = people.join(hints.select("id", F.col("hints").alias("_hints")), "id", "left")
        extra.append(F.when(F.size("_hints") > 0, F.col("_hints")).alias("resolved_hints"))
    # Null fields are left out of the JSON text, so the base fields are written as empty ones.
    return df.select("id", F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(base, ("name", "title", "department", "bio", "location"))], *extra)).alias("entry"))


def pick_sector(candidates: DataFrame) -> DataFrame:
    """(id, sector): of the matched sectors (id, sector, specificity, hits) the most specific, then most frequent, then first."""
    return candidates.groupBy("id").agg(F.min_by("sector", F.struct((-F.col("specificity")).alias("s"), (-F.col("hits")).alias("h"), "sector")).alias("sector"))


def primary_tiebreak(df: DataFrame, text_categories: KeywordMap) -> DataFrame:
    """(id, primary, rule): the main category of (id, title, practice, counts map<string, bigint>), by the first rule that
    decides: the only category named in the title; of several the one with most evidence, else the first named; the one of
    the practice; else the one with most evidence."""
    counts = F.coalesce("counts", F.create_map().cast("map<string,bigint>"))
    in_text = lambda c: F.transform(keyword_hits(F.lower(F.coalesce(c, F.lit(""))), text_categories), lambda x: x["category"])
    titled, practised = in_text(F.col("title")), in_text(F.col("practice"))
    most = lambda cats: F.array_max(F.transform(cats, lambda c, i: F.struct(F.coalesce(F.col("_counts")[c], F.lit(0)).alias("n"), (-i).alias("p"), c.alias("c"))))["c"]
    rows = df.select("id", counts.alias("_counts"), titled.alias("_titled"), practised.alias("_practised"))
    ranked = F.array_max(F.transform(F.array_sort(F.map_keys("_counts")), lambda c, i: F.struct(F.col("_counts")[c].alias("n"), (-i).alias("p"), c.alias("c"))))["c"]
    rule = F.when(F.size("_titled") == 1, "title").when(F.size("_titled") > 1, "title evidence").when(F.size("_practised") > 0, "practice").when(F.size(F.map_keys("_counts")) > 0, "evidence")
    value = F.when(F.size("_titled") > 0, most(F.col("_titled"))).when(F.size("_practised") > 0, most(F.col("_practised"))).otherwise(ranked)
    return rows.select("id", value.alias("primary"), rule.alias("rule"))


def normalise_rows(people: DataFrame, runs: DataFrame) -> DataFrame:
    """People and runs of a classifier in one form of nine fields, for comparison: (origin, id, primary, categories, sectors,
    matched_sectors, geographies, inferred, topics)."""
    none = F.array().cast("array<string>")
    lists = lambda c: F.coalesce(split_list(c, ";"), none)
    arr = lambda df, c: F.coalesce(F.col(c), none) if c in df.columns else none
    a = people.select(F.lit("people").alias("origin"), "id", F.col("primary_expertise").alias("primary"), arr(people, "matched_13_categories").alias("categories"), lists(F.col("sector")).alias("sectors"), arr(people, "matched_sector").alias("matched_sectors"), lists(F.col("geography")).alias("geographies"), arr(people, "inferred_expertise_functional").alias("inferred"), arr(people, "matched_inferred_expertise_topics").alias("topics"))
    b = runs.select(F.lit("run").alias("origin"), "id", "primary", *[F.coalesce(c, none).alias(c) for c in ("categories", "sectors", "matched_sectors", "geographies", "inferred", "topics")])
    return a.unionByName(b)


def provider_list(providers: dict[str, str], spark) -> DataFrame:
    """(provider, model): the classifiers that are registered, sorted."""
    return spark.createDataFrame(sorted(providers.items()), "provider string, model string").orderBy("provider")
