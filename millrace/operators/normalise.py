"""Raw scraped records (string maps) into the canonical person columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, clean_person_name, mask_location, mask_profile_url

PERSON_FIELDS = ("name", "title", "department", "bio", "email", "phone", "linkedin_url", "twitter_url", "other_url", "image_url", "location", "profile_url")
# Other names of the canonical fields.
FIELD_ALIASES = {
    "name": ("full_name", "person_name", "member_name", "employee_name", "staff_name"), "title": ("job_title", "role", "position", "job_role", "designation", "job_position"), "department": ("team", "division", "group", "practice", "area", "unit"),
    "bio": ("description", "about", "summary", "biography", "profile_text", "overview", "excerpt", "text"), "email": ("email_address", "mail"), "phone": ("telephone", "tel", "mobile", "phone_number", "contact_number"),
    "linkedin_url": ("linkedin", "linkedin_profile"), "twitter_url": ("twitter", "x_url"), "other_url": ("website", "personal_website", "github", "url"), "image_url": ("photo", "avatar", "picture", "headshot", "img", "photo_url"),
    "location": ("office", "city", "country", "region"), "profile_url": ("profile_link", "page_url", "detail_url", "link"),
}


def canonical_key(key: Column) -> Column:
    """Lower case, trimmed, blanks and dashes as underscores, aliases resolved."""
    plain = F.translate(F.lower(F.trim(key)), " -", "__")
    lookup = F.create_map(*[F.lit(x) for field, others in FIELD_ALIASES.items() for o in others for x in (o, field)])
    return F.coalesce(lookup[plain], plain)


def canonical_entries(record: Column) -> Column:
    """array<struct<key, value>> with canonical keys, in the order of the record."""
    return F.transform(F.map_entries(record), lambda e: F.struct(canonical_key(e["key"]).alias("key"), e["value"].alias("value")))


def normalise_records(raw: DataFrame, record: str = "record") -> DataFrame:
    """Canonical columns of raw records (map<string,string>); of several values for a field the last wins, unknown keys go to
    ``extra``; names, places and addresses are cleaned."""
    entries = canonical_entries(F.col(record))

    def field(name: str) -> Column:
        own = F.filter(entries, lambda e: e["key"] == name)
        return blank_to_null(F.trim(F.try_element_at(own, F.lit(-1))["value"]))

    others = F.filter(entries, lambda e: ~e["key"].isin(*PERSON_FIELDS))
    # Equal keys keep their last value.
    last = F.transform(F.array_distinct(F.transform(others, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(others, lambda x: x["key"] == k), -1)["value"].alias("value")))
    extra = F.map_from_entries(last)
    keep = [c for c in raw.columns if c != record]
    out = raw.select(*keep, *[field(f).alias(f) for f in PERSON_FIELDS], extra.alias("extra"))
    return out.withColumns({"name": clean_person_name(F.col("name"), F.col("location")), "location": mask_location(F.col("location")), "linkedin_url": mask_profile_url(F.col("linkedin_url"))})
