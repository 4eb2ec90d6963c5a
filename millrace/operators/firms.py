"""Firms as they are written: keys of their names, and which of them a written name may mean."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.udfs import fold_text
from millrace.session import broadcast_if_small, checkpoint

#: Letters of the first word of a firm that it is looked up by.
PREFIX = 14
_LEGAL = frozenset("the llp ltd inc gmbh sa plc llc ag limited co company".split())


def employer_key(name: str | None, fold: Callable[[str], str] = fold_text) -> str:
    """The first three words of a firm's name without article, legal form and case: 'The GulkekiChambers Ltd' is 'gulkeki chambers'."""
    if not name:
        return ""
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name)
    words = [w for w in re.findall(r"[^\W_]+", fold(re.sub(r"\bS\.\s?A\.?", " ", spaced))) if w not in _LEGAL]
    return " ".join(words[:3])


def employer_in_text(headline: str | None, about: str | None) -> str:
    """The firm that a headline or a text names."""
    if headline and (m := re.search(r"(?:\s@\s|\sat\s)([^|@]+)$", headline)):
        return m[1]
    for pattern in (r"\bjoined (.{3,60}?) in \d{4}", r"\bAt ((?:[A-Z][^\s,]*\s?){1,5}),", r" is [^.]{3,80}? at ((?:[A-Z][^\s.,]*\s?){1,5})[.,]"):
        if about and (m := re.search(pattern, about)):
            return m[1]
    return ""


def firm_text() -> Column:
    """The name of a company, or for nameless ones what its host says (columns ``name`` and ``url``)."""
    host = F.regexp_extract(F.lower("url"), r"^(?:https?://)?(?:www\.)?([^/:?#]+)", 1)
    return F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.translate(F.split_part(host, F.lit("."), F.lit(1)), "-_", "  "))


def first_word(employer: Column) -> Column:
    return F.split_part(employer, F.lit(" "), F.lit(1))


def same_word(a: Column, b: Column) -> Column:
    """Whether ``b`` is the first word ``a`` of a firm, up to slips."""
    return F.levenshtein(a, b) <= F.when(F.length(a) >= 5, 2).otherwise(0)


def deletions(word: str) -> list[str]:
    """The word without up to two of its letters: words at most two edits apart share one.

    Only the first ``PREFIX`` letters count, and the first ``PREFIX`` - 2 of what is left of them: what two words have in
    common after their deletions begins with as much, so nothing is lost and long words have no more than 106 of them.
    """
    w = word[:PREFIX]
    once = {w[:i] + w[i + 1 :] for i in range(len(w))}
    return sorted({x[: PREFIX - 2] for x in {w, *once, *(x[:i] + x[i + 1 :] for x in once for i in range(len(x)))}})


def near_firms(firms: DataFrame, records: DataFrame) -> DataFrame:
    """(employer, firms): for each employer of ``records`` the employers of ``firms``, hashed, that ``same_firm`` takes it for (all of them)."""

    @F.pandas_udf("array<string>")
    def keys(words: pd.Series) -> pd.Series:
        return words.map(deletions)

    known = firms.where("employer <> ''").select(F.col("employer").alias("firm"), first_word(F.col("employer")).alias("known")).distinct()
    asked = records.where("employer <> ''").select("employer", first_word(F.col("employer")).alias("word")).distinct()
    left, right = (d.select(c).distinct().withColumn("key", F.explode(keys(c))) for d, c in ((known, "known"), (asked, "word")))
    words = left.join(right, "key").where(same_word(F.col("known"), F.col("word"))).select("known", "word").distinct()
    pairs = words.join(known, "known").join(asked, "word").where(same_firm(F.col("firm"), F.col("employer")))
    return pairs.groupBy("employer").agg(F.collect_list(F.xxhash64("firm")).alias("firms"))


def nearest_firms(firms: DataFrame, records: DataFrame) -> DataFrame:
    """(employer, firm): for each employer of ``records`` those of ``firms`` that ``same_firm`` takes it for and that are
    written nearest to it: all with its own first word, or if there are none all at the smallest number of slips.

    Only employers without a firm as written are looked up by deletions, so the many that are written right cost one join
    of equal words, and the firms a record is taken to don't grow with the number of firms.
    """

    @F.pandas_udf("array<string>")
    def keys(words: pd.Series) -> pd.Series:
        return words.map(deletions)

    known = firms.where("employer <> ''").select(F.col("employer").alias("firm"), first_word(F.col("employer")).alias("known")).distinct()
    asked = records.where("employer <> ''").select("employer").distinct()
    asked = checkpoint(asked.withColumn("word", first_word(F.col("employer"))))
    known = checkpoint(known)
    exact = checkpoint(asked.join(broadcast_if_small(known), F.col("known") == F.col("word")).where(same_firm(F.col("firm"), F.col("employer"))).select("employer", "firm"))
    rest = asked.join(broadcast_if_small(exact.select("employer").distinct()), "employer", "left_anti")
    left = known.select("known").distinct().withColumn("key", F.explode(keys("known")))
    right = rest.select("word").distinct().withColumn("key", F.explode(keys("word")))
    words = left.join(right, "key").where(same_word(F.col("known"), F.col("word"))).select("known", "word").distinct()
    near = words.join(known, "known").join(rest, "word").where(same_firm(F.col("firm"), F.col("employer")))
    near = near.select("employer", "firm", F.levenshtein("known", "word").alias("slips"))
    least = near.groupBy("employer").agg(F.min("slips").alias("slips"))
    return exact.unionByName(near.join(least, ["employer", "slips"]).select("employer", "firm"))


def same_firm(a: Column, b: Column) -> Column:
    """Whether two employer keys name one firm: first words equal up to slips, second words equal or cut."""
    rest_a, rest_b = F.split_part(a, F.lit(" "), F.lit(2)), F.split_part(b, F.lit(" "), F.lit(2))
    second = (rest_a == "") | (rest_b == "") | rest_a.startswith(F.left(rest_b, F.lit(3))) | rest_b.startswith(F.left(rest_a, F.lit(3)))
    return (a != "") & (b != "") & second & same_word(first_word(a), first_word(b))


@F.pandas_udf(StringType())
def firm_keys(names: pd.Series) -> pd.Series:
    return names.map(employer_key)


@F.pandas_udf(StringType())
def profile_keys(company: pd.Series, headline: pd.Series, about: pd.Series) -> pd.Series:
    """The key of a profile's firm: as given, else as its headline or text names it."""
    return pd.Series([employer_key(c or employer_in_text(h, a)) for c, h, a in zip(company, headline, about)], dtype=object)


def company_roster(companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile_id, company_id, name, headline, pos): profiles at every company that their firm may mean; ``company_id`` is
    null for profiles that fit none."""
    named = companies.select(F.col("id").alias("company_id"), firm_keys(firm_text()).alias("firm"))
    read = checkpoint(profiles.select("profile_id", profile_keys("company_name", "headline", "about").alias("employer"), F.concat_ws(" ", "first_name", "last_name").alias("name"), "headline", F.col("profile_id").alias("pos")))
    near = near_firms(named.select(F.col("firm").alias("employer")), read).select("employer", F.explode("firms").alias("hash"))
    at = near.join(named.select("company_id", F.xxhash64("firm").alias("hash")), "hash").select("employer", "company_id")
    return read.join(at, "employer", "left").select("profile_id", "company_id", "name", "headline", "pos")
