"""Tiered entity resolution of people against a roster, and the merges of what the roster adds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, first_set, significant_tokens
from millrace.functions.udfs import fold
from millrace.operators.ratios import best_partners
from millrace.session import broadcast_if_small, checkpoint, input_partitions

#: Words before and after names that don't count, words of firms that say nothing, thresholds.
NAME_PREFIXES = "sir|dame|lord|lady|dr|prof|mr|mrs|ms|rev|gen|col|maj|adm|amb|hon"
NAME_SUFFIXES = "jr|sr|ii|iii|iv|v|esq|phd|md|dds|jd|lld"
GENERIC_FIRM_WORDS = ("group", "llc", "ltd", "plc", "inc", "corp", "company", "partners", "associates", "consulting", "consultants", "advisory", "advisors", "services", "solutions", "global", "holdings", "international")
RATIO, RATIO_WITH_TITLE = 0.88, 0.80


def norm_name(folded: Column) -> Column:
    """Folded name without one title and one suffix, letters only."""
    c = F.regexp_replace(folded, rf"^\s*(?:{NAME_PREFIXES})\.?\s+", "")
    c = F.regexp_replace(c, rf"\s+(?:{NAME_SUFFIXES})\.?\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z]+", " "), r"\s+", " "))


def is_nickname(a: Column, b: Column) -> Column:
    """Equal last words, and one first word of three letters or more begins the other."""
    fa, fb = F.split_part(a, F.lit(" "), F.lit(1)), F.split_part(b, F.lit(" "), F.lit(1))
    la, lb = F.element_at(F.split(a, " "), -1), F.element_at(F.split(b, " "), -1)
    two = a.contains(" ") & b.contains(" ")
    short = F.least(F.length(fa), F.length(fb))
    return two & (la == lb) & (short >= 3) & (fa.startswith(fb) | fb.startswith(fa))


def name_classes(names: DataFrame) -> DataFrame:
    """(company_id, n, first_id, rows): the classes of rows of one company with one normalised name; counted before any join."""
    return names.where("n <> ''").groupBy("company_id", "n").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("rows"))


def nickname_pairs(names: DataFrame) -> DataFrame:
    """(id_a, id_b, rows_a, rows_b): classes of rows of one company (by their smallest ids, with their sizes) whose names differ
    and are nicknames of each other. ``names``: id, company_id, n (normalised).

    Rows of one name are one class, so copies never pair. The last word and three letters of the first are equal in all such
    pairs, so they are part of the key.
    """
    classes = name_classes(names).withColumnRenamed("first_id", "id")
    keyed = classes.where(F.col("n").contains(" ")).withColumn("last", F.element_at(F.split("n", " "), -1)).withColumn("start", F.left(F.col("n"), F.lit(3)))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = (F.col("a.company_id") == F.col("b.company_id")) & (F.col("a.last") == F.col("b.last")) & (F.col("a.start") == F.col("b.start")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, met).where(is_nickname(F.col("a.n"), F.col("b.n"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.rows").alias("rows_a"), F.col("b.rows").alias("rows_b"))


def _segment_hit(token: Column, segments: Column) -> Column:
    def hit(s: Column) -> Column:
        return (s == token) | ((F.least(F.length(s), F.length(token)) >= 3) & (s.startswith(token) | token.startswith(s)))

    return F.exists(segments, hit)


def slug_fits(folded_slug: Column, folded_name: Column) -> Column:
    """First and last name token both stand in the slug, up to beginnings of three letters; one-word names need that word."""
    segments = F.split(folded_slug, r"[^a-z0-9]+")
    tokens = significant_tokens(folded_name)
    return F.when(F.size(tokens) == 0, False).otherwise(_segment_hit(F.element_at(tokens, 1), segments) & _segment_hit(F.element_at(tokens, -1), segments))


def firm_in_text(folded_firm: Column, folded_text: Column) -> Column:
    """A distinctive word of the firm stands in the text; true for firms without words, false for empty text."""
    tokens = significant_tokens(folded_firm)
    telling = F.filter(tokens, lambda t: ~t.isin(*GENERIC_FIRM_WORDS))
    used = F.when(F.size(telling) > 0, telling).otherwise(tokens)
    return F.when(F.trim(folded_text) == "", False).when(F.size(used) == 0, True).otherwise(F.exists(used, lambda t: folded_text.contains(t)))


def title_supports(title: Column, candidate: Column) -> Column:
    """Some word of four letters or more of the title stands in the candidate's title or headline."""
    words = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)
    return F.exists(words, lambda w: F.lower(candidate).contains(w))


def letter_bound(a: Column, b: Column) -> Column:
    """Upper bound of the sequence ratio from the letters alone: twice the common letters over both lengths."""
    la, lb = F.split(a, ""), F.split(b, "")
    common = F.aggregate(F.array_distinct(la), F.lit(0), lambda acc, ch: acc + F.least(F.size(F.filter(la, lambda x: x == ch)), F.size(F.filter(lb, lambda x: x == ch))))
    return 2.0 * common / F.greatest(F.length(a) + F.length(b), F.lit(1))


#: Names of a company that one task compares with its roster; a larger company is spread over tasks.
NAMES_TOGETHER = 8192


def near_names(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(company_id, n, profile_id, ratio): for each name (company_id, n) the entry (company_id, m, first) of its company with
    the best sequence ratio of ``RATIO_WITH_TITLE`` or more, the first in roster order of equals.

    Whole companies, or shares of large ones, come together with their entries, so that pairs are compared in memory and none
    is shuffled (see ``ratios.best_partners``).
    """
    tasks = input_partitions(names)
    sizes = broadcast_if_small(checkpoint(names.groupBy("company_id").agg(F.ceil(F.count(F.lit(1)) / NAMES_TOGETHER).alias("shares"))))
    place = F.pmod(F.xxhash64("company_id", F.pmod(F.xxhash64("n"), F.col("shares"))), F.lit(4 * tasks)).alias("place")
    placed = checkpoint(names.join(sizes, "company_id").select("company_id", "n", place))
    placed_entries = entries.join(placed.select("company_id", F.col("place").alias("at")).distinct(), "company_id").select("company_id", "at", "m", "first.pos", "first.profile_id")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = dict(tuple(right.sort_values(["pos", "profile_id"], kind="stable").groupby("company_id")))
        out = []
        for company, rows in left.groupby("company_id"):
            if company in own:
                n, there = rows["n"].tolist(), own[company]
                at, ratio = best_partners(n, there["m"].tolist(), RATIO_WITH_TITLE)
                ids = there["profile_id"].tolist()
                out += [(company, n[k], ids[at[k]], float(ratio[k])) for k in (at >= 0).nonzero()[0].tolist()]
        return pd.DataFrame(out, columns=["company_id", "n", "profile_id", "ratio"])

    # A stated width keeps AQE from putting the little data, which takes long, into a few tasks.
    together = placed.repartition(tasks, "place").groupBy("place").cogroup(placed_entries.repartition(tasks, "at").groupBy("at"))
    return together.applyInPandas(compare, "company_id long, n string, profile_id long, ratio double")


def match_roster(people: DataFrame, roster: DataFrame) -> DataFrame:
    """(id, profile_id, tier, ratio): the roster entry of each person of the same company.

    ``people``: id, company_id, name, title. ``roster``: profile_id, company_id, name, headline, pos. An exact or nickname hit
    wins, the first in roster order; else the best sequence ratio of 0.88, or 0.80 with a supporting title. Equal names of a
    company are one: exact and nickname hits are an equality join on last name and three letters, and only the names that it
    leaves are compared by ratio (see ``near_names``), which loses no pair above 0.80.
    """
    p = checkpoint(people.select("id", "company_id", "title", norm_name(fold("name")).alias("n")).where("n <> '' and company_id is not null"))
    r = checkpoint(roster.select("profile_id", "company_id", "headline", "pos", norm_name(fold("name")).alias("m")).where("m <> '' and company_id is not null"))
    names = checkpoint(p.select("company_id", "n").distinct())
    entries = checkpoint(r.groupBy("company_id", "m").agg(F.min(F.struct(F.col("pos").isNull().alias("o"), "pos", "profile_id")).alias("first")))
    keyed = lambda d, c: d.withColumn("last", F.element_at(F.split(c, " "), -1)).withColumn("start", F.left(F.col(c), F.lit(3)))
    met = keyed(names, "n").join(keyed(entries, "m"), ["company_id", "last", "start"]).where((F.col("n") == F.col("m")) | is_nickname(F.col("n"), F.col("m")))
    sure = checkpoint(met.groupBy("company_id", "n").agg(F.min("first").alias("first")))
    near = checkpoint(near_names(names.join(sure, ["company_id", "n"], "left_anti"), entries))
    best = sure.select("company_id", "n", "first.profile_id", F.lit(True).alias("sure"), F.lit(1.0).alias("ratio")).unionByName(near.select("company_id", "n", "profile_id", F.lit(False).alias("sure"), "ratio"))
    # Only the pairs between the two thresholds ask for a headline.
    asked = broadcast_if_small(near.where(F.col("ratio") < RATIO).select("company_id", "profile_id").distinct())
    headlines = checkpoint(r.join(asked, ["company_id", "profile_id"], "left_semi").groupBy("company_id", "profile_id").agg(F.max("headline").alias("headline")))
    found = p.join(best, ["company_id", "n"]).join(broadcast_if_small(headlines), ["company_id", "profile_id"], "left")
    ok = F.col("sure") | (F.col("ratio") >= RATIO) | title_supports(F.col("title"), F.coalesce("headline", F.lit("")))
    return found.where(ok).select("id", "profile_id", F.when(F.col("sure"), "exact").when(F.col("ratio") >= RATIO, "ratio").otherwise("title").alias("tier"), "ratio")


def overwrite_merge(new: Column, old: Column) -> Column:
    """The new value unless it is missing."""
    return F.coalesce(blank_to_null(new), old)


def fill_merge(new: Column, old: Column) -> Column:
    """The old value unless it is missing."""
    return first_set(old, new)


def apply_profiles(people: DataFrame, matches: DataFrame, profiles: DataFrame) -> DataFrame:
    """People with what their profile adds: address and headline overwrite, place and text fill gaps; source label."""
    found = matches.select("id", "profile_id").join(profiles.select("profile_id", F.col("linkedin_url").alias("new_url"), F.col("location").alias("new_place"), F.col("about").alias("new_bio")), "profile_id")
    joined = people.join(found, "id", "left")
    hit = F.col("profile_id").isNotNull()
    return joined.select(
        "id",
        F.when(hit, overwrite_merge(F.col("new_url"), F.col("linkedin_url"))).otherwise(F.col("linkedin_url")).alias("linkedin_url"),
        F.when(hit, fill_merge(F.col("new_place"), F.col("location"))).otherwise(F.col("location")).alias("location"),
        F.when(hit, fill_merge(F.col("new_bio"), F.col("bio"))).otherwise(F.col("bio")).alias("bio"),
        F.when(hit, "Website + LinkedIn").otherwise("Website").alias("data_source"),
    )


def enrich_profiles(people: DataFrame, matches: DataFrame, profiles: DataFrame) -> DataFrame:
    """People with what the profile read last says: headline, summary and skills are overwritten even with nothing, place and
    picture only fill gaps, and the row counts as enriched."""
    new = profiles.select("profile_id", *[F.col(a).alias(f"new_{b}") for a, b in (("headline", "headline"), ("about", "summary"), ("skills", "skills"), ("location", "location"))])
    joined = people.join(matches.select("id", "profile_id").join(new, "profile_id"), "id", "left")
    hit = F.col("profile_id").isNotNull()
    own = lambda c: F.col(c) if c in people.columns else F.lit(None).cast("string")
    return joined.select(
        "id",
        *[F.when(hit, F.col(f"new_{c}")).otherwise(own(f"linkedin_{c}")).alias(f"linkedin_{c}") for c in ("headline", "summary", "skills")],
        F.when(hit, fill_merge(F.col("new_location"), F.col("location"))).otherwise(F.col("location")).alias("location"),
        (hit | F.coalesce("linkedin_enriched", F.lit(False))).alias("linkedin_enriched"),
    )


# Where a row comes from.
SOURCE_LABELS = {"both": "Website + LinkedIn", "site": "Website", "roster": "LinkedIn (Apify)"}


def source_label(on_site: Column, in_roster: Column) -> Column:
    """Label of a row that stands on the site, in the roster, or in both."""
    return F.when(on_site & in_roster, SOURCE_LABELS["both"]).when(on_site, SOURCE_LABELS["site"]).when(in_roster, SOURCE_LABELS["roster"])


def match_search_results(people: DataFrame, results: DataFrame) -> DataFrame:
    """(id, url): of the results (id, pos, url, snippet) found for a person (id, name, company) the first whose slug carries the
    first and the last name and whose text names the firm; an address given to several people stays with the first."""
    names = people.select("id", fold("name").alias("_name"), fold("company").alias("_firm"))
    slug = fold(F.regexp_extract("url", r"(?i)/in/([^/?#]+)", 1))
    found = results.where(F.lower("url").contains("/in/")).select("id", "pos", "url", slug.alias("_slug"), fold(F.coalesce("snippet", F.lit(""))).alias("_text")).join(names, "id")
    right = found.where(slug_fits(F.col("_slug"), F.col("_name")) & firm_in_text(F.col("_firm"), F.col("_text")))
    first = right.groupBy("id").agg(F.min_by("url", F.struct("pos", "url")).alias("url"), F.min("pos").alias("pos"))
    return one_owner_per_url(first).select("id", "url")


def cascade(people: DataFrame, steps: list) -> DataFrame:
    """(id, profile_id, step): each step sees only what the steps before it left unmatched, and runs once."""
    left, out = people, None
    for k, step in enumerate(steps):
        hits = checkpoint(step(left).select("id", "profile_id").withColumn("step", F.lit(k)))
        left = left.join(hits.select("id"), "id", "left_anti")
        out = hits if out is None else out.unionByName(hits)
    return out


def one_owner_per_url(matches: DataFrame) -> DataFrame:
    """(id, url, pos): an address given to several people stays with the first."""
    rank = F.row_number().over(Window.partitionBy("url").orderBy("pos", "id"))
    return matches.withColumn("r", rank).where("r = 1").drop("r")


def match_addresses(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, profile_id): profiles by the slug of their address, an equality join instead of containment both ways."""
    slug = lambda c: blank_to_null(F.regexp_extract(F.lower(c), r"/in/([^/?#]+)", 1))
    a = people.select("id", slug(F.col("linkedin_url")).alias("slug")).where("slug is not null")
    b = profiles.select("profile_id", slug(F.col("linkedin_url")).alias("slug")).where("slug is not null")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("profile_id"))
    return a.join(b, "slug").withColumn("r", rank).where("r = 1").select("id", "profile_id")
