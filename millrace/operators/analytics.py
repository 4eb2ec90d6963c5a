"""Relational roll-ups over people, companies, jobs and usage: counts, shares, top-k, heatmap, search, costs.

Small sides are broadcast only by Catalyst's own size check; every ``orderBy ... limit`` has a tie-break, so that results
are stable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import all_of, blank_to_null, norm_url, split_list

CATEGORIES = "inferred_expertise_functional"


def count_if(predicate: Column) -> Column:
    return F.count(F.when(predicate, 1))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, half up, 0 for an empty whole."""
    scale = 10**digits
    return F.when(whole > 0, F.floor(part * (100.0 * scale) / whole + 0.5) / float(scale)).otherwise(0.0)


def finished(companies: DataFrame) -> DataFrame:
    return companies.where("status = 'completed'")


def people_stats(people: DataFrame) -> DataFrame:
    """Counts per company, aggregated on the map side before anything is joined: people, analysed, enriched, with a photo."""
    return people.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("people"),
        count_if(F.col("primary_expertise").isNotNull()).alias("analyzed"),
        count_if(F.col("linkedin_enriched")).alias("enriched"),
        count_if(F.col("image_url").isNotNull()).alias("with_photo"),
    )


STATS = ("people", "analyzed", "enriched", "with_photo")


def _with_stats(companies: DataFrame, people: DataFrame) -> DataFrame:
    stats = people_stats(people).withColumnRenamed("company_id", "_company")
    return companies.join(stats, F.col("id") == F.col("_company"), "left").select(*companies.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in STATS])


def company_overview(people: DataFrame, companies: DataFrame) -> DataFrame:
    """One row per completed company, also without people: people, analysed, enriched, with a photo."""
    return _with_stats(finished(companies).select("id", "name", "url"), people)


def overview_totals(people: DataFrame, companies: DataFrame) -> DataFrame:
    o = company_overview(people, companies)
    return o.agg(F.count(F.lit(1)).alias("companies"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS])


def company_completeness(people: DataFrame, companies: DataFrame) -> DataFrame:
    """Every company's counts as whole percentages, half to even."""
    share = lambda c, name: F.when(F.col("people") > 0, F.bround(F.col(c) * 100.0 / F.col("people")).cast("int")).otherwise(0).alias(f"{name}_pct")
    return _with_stats(companies.select("id"), people).select("id", "people", share("analyzed", "analyzed"), share("enriched", "enriched"), share("with_photo", "photo"))


def worst_completeness(people: DataFrame, companies: DataFrame, first: int = 20) -> DataFrame:
    """Completed companies by the mean of their three shares, lowest first."""
    o = company_overview(people, companies)
    score = F.when(F.col("people") > 0, (F.col("analyzed") + F.col("enriched") + F.col("with_photo")) * 100.0 / (3 * F.col("people"))).otherwise(0.0)
    return o.select("id", "people", F.round(score, 6).alias("score")).orderBy("score", "id").limit(first)


def completeness_bands(people: DataFrame, companies: DataFrame, good: int = 80, fair: int = 50) -> DataFrame:
    """Each completed company's shares rounded half up, with the band of each (good, fair or poor)."""
    o = company_overview(people, companies)
    band = lambda c: F.when(F.col(c) >= good, "good").when(F.col(c) >= fair, "fair").otherwise("poor")
    shares = o.select("id", *[percent(F.col(c), F.col("people"), 0).cast("int").alias(f"{c}_pct") for c in STATS[1:]])
    return shares.select("id", *[f"{c}_pct" for c in STATS[1:]], *[band(f"{c}_pct").alias(f"{c}_band") for c in STATS[1:]])


def of_finished(people: DataFrame, companies: DataFrame) -> DataFrame:
    return people.join(finished(companies).select(F.col("id").alias("company_id")), "company_id")


def category_counts(people: DataFrame, companies: DataFrame) -> DataFrame:
    """People per category of the list column (null and empty lists drop out), with the share of analysed people."""
    base = of_finished(people.select("company_id", "primary_expertise", CATEGORIES), companies)
    counts = base.select(F.explode(CATEGORIES).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = base.agg(F.count("primary_expertise").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", percent(F.col("n"), F.col("total")).alias("pct"))  # one row


def top_values(people: DataFrame, companies: DataFrame, column: str, first: int) -> DataFrame:
    base = of_finished(people.select("company_id", column).where(F.col(column).isNotNull()), companies)
    return base.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(first)


def split_counts(people: DataFrame, column: str, first: int = 15) -> DataFrame:
    """Top values of a delimited column per company; empty tokens count."""
    tokens = people.where(F.col(column).isNotNull()).select("company_id", F.explode(split_list(F.col(column), ";", keep_empty=True)).alias("value"))
    counts = tokens.groupBy("company_id", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= first)


def heatmap(people: DataFrame, companies: DataFrame) -> DataFrame:
    """People per completed company and category."""
    base = of_finished(people.select("company_id", CATEGORIES), companies)
    return base.select("company_id", F.explode(CATEGORIES).alias("category")).groupBy("company_id", "category").agg(F.count(F.lit(1)).alias("n"))


def heatmap_maps(people: DataFrame, companies: DataFrame) -> DataFrame:
    """The heatmap with one map per company, its intensity scaled to the largest cell."""
    cells = heatmap(people, companies).where("category is not null")
    peak = cells.agg(F.max("n").alias("peak"))
    scaled = cells.crossJoin(F.broadcast(peak)).withColumn("intensity", F.least(F.col("n") / F.col("peak"), F.lit(1.0)))
    return scaled.groupBy("company_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.struct("n", "intensity"))))).alias("cells"))


def top_categories(people: DataFrame, first: int = 3) -> DataFrame:
    counts = people.select("company_id", F.explode(CATEGORIES).alias("category")).where("category is not null").groupBy("company_id", "category").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("n"), "category"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= first)


def skills_matrix(people: DataFrame, company_id: int | None = None) -> DataFrame:
    """Category, expertise, sector and geography counts of each company (or of one) in one long table."""
    own = people if company_id is None else people.where(F.col("company_id") == company_id)
    entries = F.flatten(F.array(
        F.transform(F.coalesce(CATEGORIES, F.array()), lambda x: F.struct(F.lit("category").alias("kind"), x.alias("value"))),
        F.array(F.struct(F.lit("expertise").alias("kind"), F.col("primary_expertise").alias("value"))),
        F.transform(F.coalesce(split_list(F.col("sector"), ";", True), F.array()), lambda x: F.struct(F.lit("sector").alias("kind"), x.alias("value"))),
        F.transform(F.coalesce(split_list(F.col("geography"), ";", True), F.array()), lambda x: F.struct(F.lit("geography").alias("kind"), x.alias("value"))),
    ))
    return own.select("company_id", F.inline(entries)).where("value is not null").groupBy("company_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def search_filter(q: str | None = None, category: str | None = None, sector: str | None = None, geography: str | None = None, enriched: bool | None = None) -> Column:
    """Conjunction of the filters that are given; '%' and '_' of the text are wildcards."""
    parts: list[Column] = []
    if q:
        parts.append(any_like(q, "name", "title", "primary_expertise"))
    if category:
        parts.append(F.array_contains(CATEGORIES, category))
    if sector:
        parts.append(F.col("sector").ilike(f"%{sector}%"))
    if geography:
        parts.append(F.col("geography").ilike(f"%{geography}%"))
    if enriched is not None:
        parts.append(F.col("linkedin_enriched") == enriched)
    return all_of(parts)


def any_like(q: str, *columns: str) -> Column:
    """Whether one of the columns contains the text, in any case; null columns don't."""
    hits = [F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False)) for c in columns]
    return reduce(Column.__or__, hits)


def check_page(page: int, size: int, most: int = 100) -> None:
    if page < 1 or not 1 <= size <= most:
        raise ValueError(f"page must be 1 or more and size 1 to {most}")


SEARCH_COLUMNS = ("id", "name", "title", "location", "image_url", "linkedin_url", "primary_expertise", CATEGORIES, "sector", "geography", "company_id")


def search_people(people: DataFrame, companies: DataFrame, page: int = 1, size: int = 20, **filters) -> DataFrame:
    """A page of the people of completed companies that match, by name; the filters run before the join."""
    check_page(page, size)
    hits = people.where(search_filter(**filters)).select(*SEARCH_COLUMNS)
    named = hits.join(finished(companies).select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id")
    return named.orderBy(F.asc_nulls_last("name"), "id").offset((page - 1) * size).limit(size).select(*SEARCH_COLUMNS, "company_name")


def search_total(people: DataFrame, companies: DataFrame, size: int = 20, **filters) -> DataFrame:
    """How many people match, and how many pages they fill."""
    hits = people.where(search_filter(**filters)).select("company_id")
    found = hits.join(finished(companies).select(F.col("id").alias("company_id")), "company_id").agg(F.count(F.lit(1)).alias("total"))
    return found.select("total", F.ceil(F.col("total") / size).alias("pages"))


def people_page(people: DataFrame, company_id: int, page: int = 1, size: int = 50, search: str | None = None) -> DataFrame:
    check_page(page, size, 200)
    own = people.where(F.col("company_id") == company_id)
    if search:
        own = own.where(any_like(search, "name", "title"))
    return own.select("id", "name", "title", "department", "email", "location").orderBy(F.asc_nulls_last("name"), "id").offset((page - 1) * size).limit(size)


def latest_per_url(companies: DataFrame) -> DataFrame:
    """The latest record of every address as written; ties stay."""
    rank = F.rank().over(Window.partitionBy("url").orderBy(F.desc("created_at")))
    return companies.where("url is not null").withColumn("r", rank).where("r = 1").select("id", "url", "status")


def latest_per_norm_url(companies: DataFrame) -> DataFrame:
    """The latest record of every normalised address; of ties the smallest id."""
    rank = F.row_number().over(Window.partitionBy(norm_url(F.col("url"))).orderBy(F.desc("created_at"), "id"))
    return companies.where("url is not null").withColumn("r", rank).where("r = 1").select("id", norm_url(F.col("url")).alias("norm_url"))


def money(c: str) -> Column:
    """Exact addition: doubles are added as decimals, whatever the partitioning."""
    return F.sum(F.col(c).cast("decimal(18,6)"))


def cost_by(usage: DataFrame, key: str, first: int | None = None) -> DataFrame:
    out = usage.groupBy(key).agg(F.coalesce(money("cost_usd"), F.lit(0)).cast("decimal(28,6)").alias("cost"), F.count(F.lit(1)).alias("calls"))
    return out.orderBy(F.desc("cost"), F.asc_nulls_last(key)).limit(first) if first else out


def cost_by_company(usage: DataFrame, companies: DataFrame, first: int = 50) -> DataFrame:
    top = cost_by(usage.where("company_id is not null"), "company_id", first)
    label = companies.select(F.col("id").alias("company_id"), F.coalesce(blank_to_null(F.col("name")), F.col("url")).alias("label"))
    return top.join(label, "company_id", "left").select("company_id", "label", "cost", "calls")


def cost_daily(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("created_at").alias("day")).agg(money("cost_usd").cast("decimal(28,6)").alias("cost"), F.count(F.lit(1)).alias("calls"))


def usage_events(usage: DataFrame) -> DataFrame:
    """Each event once: a log may hold whole-row repeats, and an id stands for one call. All costs count these rows."""
    return usage.dropDuplicates(["id"])


def usage_window(usage: DataFrame, days: int | None = None, as_of: str | None = None, company_id: int | None = None) -> DataFrame:
    """Events of the last days before a given moment, and of one company; both filters reach the scan."""
    recent = usage
    if days is not None:
        if not 1 <= days <= 365:
            raise ValueError("days must be 1 to 365")
        end = F.lit(as_of).cast("timestamp")
        recent = recent.where((F.col("created_at") >= end - F.make_dt_interval(F.lit(days))) & (F.col("created_at") <= end))
    if company_id is not None:
        recent = recent.where(F.col("company_id") == company_id)
    return usage_events(recent)


def cost_summary(usage: DataFrame, days: int, as_of: str, company_id: int | None = None) -> DataFrame:
    """Totals of the last days before a given moment."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return usage_window(usage, days, as_of, company_id).agg(zero(money("cost_usd")).cast("decimal(28,6)").alias("cost"), zero(F.sum("input_tokens")).alias("input_tokens"), zero(F.sum("output_tokens")).alias("output_tokens"), F.count(F.lit(1)).alias("calls"))


def job_progress(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Finished companies of each job, derived instead of counted up."""
    done = companies.groupBy("job_id").agg(F.count(F.lit(1)).alias("companies"), count_if(F.col("status").isin("completed", "error")).alias("finished"))
    return jobs.select(F.col("id").alias("job_id"), "total_urls").join(done, "job_id", "left").select("job_id", "total_urls", F.coalesce("companies", F.lit(0)).alias("companies"), F.coalesce("finished", F.lit(0)).alias("finished"))


def jobs_with_companies(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    nested = companies.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("id", "url", "status"))).alias("companies"))
    return jobs.select(F.col("id").alias("job_id"), "filename", "status").join(nested, "job_id", "left")
