"""Rows as they are exported, and photo names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import first_set
from millrace.operators.ingest import running_number

EXPORT_COLUMNS = ("name", "title", "department", "bio", "email", "phone", "linkedin_url", "twitter_url", "image_url", "location", "profile_url", "primary_expertise", "sector", "geography", "inferred_expertise_functional", "matched_inferred_expertise_topics", "data_source")


def shown(c: Column, is_list: bool) -> Column:
    """A cell of the export: lists joined without empty elements, a dash for nothing."""
    text = F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), "; ") if is_list else c
    return first_set(text, F.lit("—"))


def export_rows(people: DataFrame, companies: DataFrame, company_id: int | None = None) -> DataFrame:
    """(id, company, the export columns): a missing department shows the company."""
    own = people if company_id is None else people.where(F.col("company_id") == company_id)
    named = own.join(companies.select(F.col("id").alias("company_id"), first_set(F.col("name"), F.col("url")).alias("company")), "company_id")
    kinds = dict(people.dtypes)
    cells = [first_set(F.col("department"), F.col("company"), F.lit("—")).alias("department") if c == "department" else shown(F.col(c), kinds[c].startswith("array")).alias(c) for c in EXPORT_COLUMNS]
    return named.select("id", "company", *cells)


# Fields and headings of the table that users get, in its order, and the widths of its columns.
TABLE_COLUMNS = (
    ("image_url", "Photo", 18), ("name", "Name", 24), ("title", "Title", 22), ("company", "Company / Practice", 38), ("location", "Location", 30), ("email", "Email", 32), ("phone", "Phone", 22), ("linkedin_url", "LinkedIn URL", 40), ("linkedin_headline", "LinkedIn Headline", 40), ("primary_expertise", "Primary Expertise", 28),
    ("justification", "Justification (LinkedIn + Bio/Website)", 65), ("matched_13_categories", "Matched 13 Expertise Categories", 48), ("sector", "Sector", 40), ("matched_sector", "Matched Sector", 50), ("geography", "Geography", 35), ("inferred_expertise_functional", "Inferred Expertise (Functional)", 65), ("inference_reasoning", "Inference Reasoning", 65),
    ("matched_inferred_expertise_topics", "Matched Inferred Expertise (Topics)", 70), ("linkedin_experience_summary", "LinkedIn Experience Summary", 60), ("bio", "Bio", 80), ("website_industries", "Website Industries", 45), ("website_capabilities", "Website Capabilities", 45), ("website_education", "Website Education", 45), ("data_source", "Data Source", 22),
)


def render_education(entries: Column) -> Column:
    """Education entries (raw, degree, institution, year) as one text: as written, else their parts."""
    one = lambda e: first_set(e["raw"], F.concat_ws(", ", F.nullif(e["degree"], F.lit("")), F.nullif(e["institution"], F.lit("")), F.nullif(e["year"], F.lit(""))))
    return F.nullif(F.array_join(F.filter(F.transform(entries, one), lambda x: x.isNotNull()), " | "), F.lit(""))


def export_table(people: DataFrame, companies: DataFrame, company_id: int | None = None) -> DataFrame:
    """(id, the 24 headed columns): the practice is the department, else the company; fields that a table lacks show a dash."""
    own = people if company_id is None else people.where(F.col("company_id") == company_id)
    named = own.join(companies.select(F.col("id").alias("company_id"), first_set(F.col("name"), F.col("url")).alias("_firm")), "company_id")
    kinds = dict(people.dtypes)

    def cell(field: str) -> Column:
        if field == "company":
            return first_set(F.col("department"), F.col("_firm"), F.lit("—"))
        if field == "website_education" and field in kinds:
            return first_set(render_education(F.col(field)), F.lit("—"))
        return shown(F.col(field), kinds[field].startswith("array")) if field in kinds else F.lit("—")

    return named.select("id", *[cell(f).alias(heading) for f, heading, _ in TABLE_COLUMNS])


def photo_names(people: DataFrame) -> DataFrame:
    """(id, file_name): number over the name order within the company, first and last name, ending of the address."""
    clean = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    words = F.split(F.trim("name"), r"\s+")
    ending = first_set(F.regexp_extract(F.lower("image_url"), r"(\.(?:jpe?g|png|webp|gif))(?:[?#]|$)", 1), F.lit(".jpg"))
    shown_ = people.where("image_url is not null and name is not null").select("id", "company_id", "name", F.struct("name", "id").alias("rank"), ending.alias("ending"))
    numbered = running_number(shown_, "company_id", "rank")
    return numbered.select("id", F.concat(F.lpad(F.col("place").cast("string"), 3, "0"), F.lit("_"), clean(F.element_at(words, 1)), F.lit("_"), clean(F.element_at(words, -1)), "ending").alias("file_name"))
