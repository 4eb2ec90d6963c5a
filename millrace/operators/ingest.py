"""Ingest, deduplication and reprocessing of records: semi and anti joins, first-wins rules, upsert plans, null-out, masks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, first_set, norm_url
from millrace.session import broadcast_if_small, checkpoint, input_partitions


def existing_urls(requested: DataFrame, companies: DataFrame) -> DataFrame:
    """Requested addresses that are stored already (compared normalised)."""
    stored = companies.select(norm_url(F.col("url")).alias("n"))
    return requested.withColumn("n", norm_url(F.col("url"))).join(stored, "n", "left_semi").select("url")


def new_urls(requested: DataFrame, companies: DataFrame) -> DataFrame:
    """Requested addresses that aren't stored, once each."""
    stored = companies.select(norm_url(F.col("url")).alias("n"))
    return requested.withColumn("n", norm_url(F.col("url"))).dropDuplicates(["n"]).join(stored, "n", "left_anti").select(F.col("n").alias("url"))


def upsert_plan(requested: DataFrame, companies: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(url, company_id, action): insert, reset or skip for each requested address, by its latest record."""
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("created_at"), "id"))
    latest = companies.where("url is not null").withColumn("n", norm_url(F.col("url"))).withColumn("r", rank).where("r = 1").select("n", F.col("id").alias("company_id"))
    wanted = requested.select(norm_url(F.col("url")).alias("n")).distinct().join(latest, "n", "left")
    if skip is None:
        skipped = wanted.withColumn("skip", F.lit(False))
    else:
        skipped = wanted.join(skip.select(norm_url(F.col("url")).alias("n"), F.lit(True).alias("skip")).distinct(), "n", "left")
    action = F.when(F.col("company_id").isNull(), "insert").when(F.coalesce("skip", F.lit(False)), "skip").otherwise("reset")
    return skipped.select(F.col("n").alias("url"), "company_id", action.alias("action"))


def superseded_duplicates(companies: DataFrame) -> DataFrame:
    """Records whose normalised address stands under a later id as well (the last one is kept for work)."""
    newest = companies.where("url is not null").groupBy(norm_url(F.col("url")).alias("n")).agg(F.max("id").alias("last"))
    return companies.withColumn("n", norm_url(F.col("url"))).join(newest, "n").where("id < last").select("id", "url", F.col("last").alias("kept_id"))


def first_of(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key; the ranking column is dropped again."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dedupe_people(people: DataFrame) -> DataFrame:
    """First record per own page, else per lower-case name and title."""
    key = F.coalesce(blank_to_null(F.col("profile_url")), F.concat_ws("\u0001", F.lower(F.trim("name")), F.lower(F.trim(F.coalesce("title", F.lit(""))))))
    return first_of(people, [F.col("company_id"), key], [F.col("id")])


def unstored_people(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch rows whose name and title (trimmed, lower case) aren't stored for the company; within the batch the first wins."""
    key = lambda df: df.withColumn("_n", F.lower(F.trim("name"))).withColumn("_t", F.lower(F.trim(F.coalesce("title", F.lit("")))))
    first = first_of(key(batch), [F.col("company_id"), F.col("_n"), F.col("_t")], [F.col("id")])
    return first.join(key(stored).select("company_id", "_n", "_t").distinct(), ["company_id", "_n", "_t"], "left_anti").drop("_n", "_t")


def null_shared_values(people: DataFrame, columns: tuple[str, ...] = ("phone", "image_url")) -> DataFrame:
    """Values that several rows of a company share become null.

    One aggregate with map-side combine counts the values of all columns at once (nulls, which can't be shared, are set aside
    before), and only what is shared is joined back, as one list of hits per row's company and value.
    """
    values = people.select("company_id", F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in columns]))).where("_value is not null")
    shared = checkpoint(values.groupBy("company_id", "_column", "_value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    out = people
    for c in columns:
        hits = broadcast_if_small(shared.where(F.col("_column") == c).select("company_id", F.col("_value").alias(c), F.lit(True).alias("_shared")))
        bare, filled = out.where(F.col(c).isNull()), out.where(F.col(c).isNotNull())
        marked = filled.join(hits, ["company_id", c], "left")
        out = marked.withColumn(c, F.when(F.col("_shared").isNull(), F.col(c))).select(*people.columns).unionByName(bare)
    return out


def keep_substantive(people: DataFrame) -> DataFrame:
    """Rows with a name and at least one other field that says something."""
    some = first_set(*[F.trim(c) for c in ("title", "bio", "email", "phone", "linkedin_url", "image_url", "location", "profile_url")])
    return people.where(blank_to_null(F.trim("name")).isNotNull() & some.isNotNull())


def running_number(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``place``, the number from 1 of each row within its group in the given order.

    The rows are range-partitioned by group and order, so that a hot group spreads over many tasks; each task numbers its own
    part, and the counts of the parts before it (one row per group and part) are added.
    """
    ranged = df.repartitionByRange(input_partitions(df), F.col(group).asc_nulls_first(), F.col(order)).withColumn("_part", F.spark_partition_id())
    ranged = checkpoint(ranged)
    counts = ranged.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"))
    # Most groups lie within one part; of a group's parts there are at most as many as partitions.
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", F.col(group).alias("_group"), "_before")
    place = F.row_number().over(Window.partitionBy("_part", group).orderBy(order))
    numbered = ranged.withColumn("_local", place).alias("a").join(broadcast_if_small(checkpoint(before)).alias("b"), (F.col("a._part") == F.col("b._part")) & F.col(f"a.{group}").eqNullSafe(F.col("b._group")))
    return numbered.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_local") + F.col("_before")).alias("place"))


def number_batches(people: DataFrame, size: int) -> DataFrame:
    """(id, company_id, batch): batches of ``size`` rows per company, by id."""
    return running_number(people.select("id", "company_id"), "company_id", "id").select("id", "company_id", (F.floor((F.col("place") - 1) / size) + 1).cast("int").alias("batch"))


def next_versions(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Version numbers from 1 within each key (null keys form their own sequence)."""
    return runs.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


# Columns that a repetition of a step empties.
ANALYSIS_COLUMNS = ("primary_expertise", "justification", "matched_13_categories", "sector", "matched_sector", "geography", "inferred_expertise_functional", "inference_reasoning", "matched_inferred_expertise_topics", "expertise_raw")
PROFILE_COLUMNS = ("linkedin_enriched_at", "linkedin_headline", "linkedin_summary", "linkedin_experience", "linkedin_education", "linkedin_skills", "linkedin_experience_summary")
RESET_COLUMNS = {
    "reanalyze": ANALYSIS_COLUMNS,
    "reenrich": PROFILE_COLUMNS + ANALYSIS_COLUMNS,
    "backfill": ("primary_expertise", "justification", "matched_13_categories", "sector", "geography", "inferred_expertise_functional", "matched_inferred_expertise_topics", "expertise_raw"),
    "requalify": ("primary_expertise",),
}
#: Flags that a repetition sets back to false.
RESET_FLAGS = {"reenrich": ("linkedin_enriched",)}
# States in which a company is at work already and may not be started again.
IN_PROGRESS = ("pending", "discovering", "scraping", "searching", "analyzing", "resolving", "enriching")


def mask_columns(people: DataFrame, chosen: Column, columns: tuple[str, ...], flags: tuple[str, ...] = ()) -> DataFrame:
    """Null in ``columns`` and false in ``flags`` of the chosen rows; columns that the table lacks are passed over."""
    hit = F.coalesce(chosen, F.lit(False))
    empty = {c: F.when(~hit, F.col(c)) for c in columns if c in people.columns}
    return people.withColumns(empty | {c: F.when(hit, F.lit(False)).otherwise(F.col(c)) for c in flags if c in people.columns})


def choose_rows(mode: str) -> Column:
    """Rows a repetition applies to."""
    if mode in ("resume", "reanalyze", "reenrich", "rescrape", "requalify"):
        return F.lit(True)
    if mode == "analyze_missing":
        return F.col("primary_expertise").isNull()
    if mode == "reresolve":
        return F.col("linkedin_url").isNull()
    if mode == "backfill":
        return F.col("primary_expertise").isNotNull() & (F.col("sector").isNull() | (F.col("sector") == ""))
    raise ValueError(f"unknown mode {mode!r}")


def plan_retry(people: DataFrame, mode: str, company_id: int | None = None) -> DataFrame:
    """People (of one company, or of all) as a repetition would leave them, with the step each row goes to next.

    ``resume`` keeps all rows and goes on collecting; ``rescrape`` leaves none. ``reenrich`` keeps the profile addresses: rows
    that have one are enriched again, the others are analysed again, and where nobody in a company has one all of them are
    resolved first.
    """
    own = people if company_id is None else people.where(F.col("company_id") == company_id)
    chosen = choose_rows(mode)
    if mode == "rescrape":
        return own.where(~chosen).withColumn("next_step", F.lit("scrape"))
    if mode == "reenrich":
        has = blank_to_null(F.col("linkedin_url")).isNotNull()
        some = own.where(has).select("company_id").distinct().withColumn("_some", F.lit(True))
        step = F.when(has, "enrich").when(F.col("_some"), "analyze").otherwise("resolve")
        routed = own.join(some, "company_id", "left").withColumn("next_step", step).select(*own.columns, "next_step")
    else:
        step = {"resume": "scrape", "reanalyze": "analyze", "analyze_missing": "analyze", "backfill": "analyze", "requalify": "analyze", "reresolve": "resolve"}[mode]
        routed = own.withColumn("next_step", F.when(chosen, F.lit(step)))
    return mask_columns(routed, chosen, RESET_COLUMNS.get(mode, ()), RESET_FLAGS.get(mode, ()))


def requalify(people: DataFrame, ids: DataFrame) -> DataFrame:
    """People as a repetition for chosen ids (of a quality filter, or one person) leaves them: a semi join, no list of literals."""
    wanted = ids.select("id").distinct().withColumn("_wanted", F.lit(True))
    routed = people.join(wanted, "id", "left").withColumn("next_step", F.when(F.col("_wanted"), F.lit("analyze")))
    return mask_columns(routed, F.col("_wanted"), RESET_COLUMNS["requalify"]).select(*people.columns, "next_step")


def startable(companies: DataFrame) -> DataFrame:
    """Companies that may be started again: those not at work."""
    return companies.where(~F.col("status").isin(*IN_PROGRESS))


def failed_jobs(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """The job of each failed company."""
    failed = companies.where("status = 'error'").select(F.col("id").alias("company_id"), "job_id", "error_message")
    return failed.join(jobs.select(F.col("id").alias("job_id"), "filename", F.col("status").alias("job_status")), "job_id")


def pick(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids``: a semi join, so that long lists don't become literals."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def text_to_list(value: Column, delimiter: str = ";") -> Column:
    """A delimited text as a list: pieces trimmed, empty ones dropped; null for null, for a lone dash and for no pieces."""
    pieces = F.filter(F.transform(F.split(value, re.escape(delimiter)), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(value.isNotNull() & (value != "—") & (F.size(pieces) > 0), pieces)


def list_to_text(value: Column, delimiter: str = "; ") -> Column:
    """The way back of ``text_to_list``."""
    return F.array_join(value, delimiter)


def missing_sectors(people: DataFrame) -> DataFrame:
    """(company_id, id): the analysed people without a sector, one row each, so that no company becomes one huge array."""
    return people.where(choose_rows("backfill")).select("company_id", "id")
