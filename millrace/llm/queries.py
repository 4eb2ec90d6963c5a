"""Queries of the training-data problems tagged llm, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import canonical, copies, crossmatch, mixing, residue, spellings, subjects, survivor, tokens
from millrace.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.find_spellings(table(spark, sf_dir, "people", spellings.READ_COLUMNS))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.find_copies(table(spark, sf_dir, "people", ["id", "company_id", "name", "title"]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "people", spellings.READ_COLUMNS)
    companies = table(spark, sf_dir, "companies", ["id", "name", "url"])
    return crossmatch.find_matches(people, companies, table(spark, sf_dir, "roster_profiles", crossmatch.PROFILE_COLUMNS))


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "people", spellings.READ_COLUMNS)
    companies = table(spark, sf_dir, "companies", ["id", "name", "url"])
    return crossmatch.match_profiles(people, companies, table(spark, sf_dir, "roster_profiles", crossmatch.PROFILE_COLUMNS))


def p4_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles left unmatched because several persons are equally good."""
    people = table(spark, sf_dir, "people", spellings.READ_COLUMNS)
    companies = table(spark, sf_dir, "companies", ["id", "name", "url"])
    return crossmatch.match_ties(people, companies, table(spark, sf_dir, "roster_profiles", crossmatch.PROFILE_COLUMNS))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record with the number of its copies."""
    return copies.collapse(table(spark, sf_dir, "people", ["id", "company_id", "name", "title"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "people", ["id", "data_source", "sector", "primary_expertise", "matched_inferred_expertise_topics"])
    return canonical.find_terms(people, table(spark, sf_dir, "reference_terms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.find_survivors(table(spark, sf_dir, "people", ["id", "company_id", "name", "title", "updated_at", *survivor.FIELDS]))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "people", ["id", "bio", "name"]))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return documents.select("doc_id", tokens.encode(F.col("text")).alias("ids"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return mixing.mix(documents, table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return mixing.report_shares(documents, table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return subjects.find_subjects(documents, table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "subject_examples"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_confidence": p4_confidence, "p4_ties": p4_ties, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found}

#: None of these is expressible in SQL (automata, BPE, learned precedence); tests compare them with brute force.
SQL: dict[str, str] = {}
