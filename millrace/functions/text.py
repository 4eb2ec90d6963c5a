"""Column helpers over strings, addresses and delimited lists. All are built-in expressions (no Python per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Null for empty strings, as in the truthiness of scripting languages."""
    return F.nullif(c, F.lit(""))


def first_set(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def norm_url(c: Column) -> Column:
    """Address for comparison: no trailing slashes, lower case."""
    return F.lower(F.regexp_replace(c, r"/+$", ""))


def url_host(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def title_words(c: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere."""
    words = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000_000)))), "")


def domain_name(url: Column) -> Column:
    """Display name from a host: first label without www., dashes and underscores as blanks, in title case."""
    label = F.get(F.split(F.replace(url_host(url), F.lit("www."), F.lit("")), r"\."), F.lit(0))
    return title_words(F.translate(label, "-_", "  "))


def search_name(name: Column, url: Column) -> Column:
    """The stored name if it has a blank or a capital, else the domain's name, else what there is."""
    real = name.rlike(r"[ \p{Lu}]")
    return F.when(real, name).otherwise(F.coalesce(blank_to_null(domain_name(url)), name, url, F.lit("")))


#: Endings of firm names that don't count, in the order they are tried.
FIRM_ENDINGS = (" consulting", " consultants", " advisory", " advisors", " group", " partners", " & co", " and co", " llc", " llp", " inc", " ltd")


def firm_slug(name: Column) -> Column:
    """Letters and digits of a firm's name without one ending: 'L.E.K. Consulting' is 'lek'."""
    low = F.lower(F.trim(name))
    cut = low
    for e in reversed(FIRM_ENDINGS):
        cut = F.when(low.endswith(e), F.trim(F.left(low, F.length(low) - len(e)))).otherwise(cut)
    return F.regexp_replace(cut, r"[^a-z0-9]+", "")


def site_slug(url: Column) -> Column:
    return F.left(F.regexp_replace(url_host(url), r"[^A-Za-z0-9_]", "_"), F.lit(40))


def profile_slug(url: Column) -> Column:
    """Slug of a personal or company profile address."""
    return blank_to_null(F.regexp_extract(F.lower(url), r"/(?:company|in)/([^/?#]+)", 1))


def display_name(title: Column) -> Column:
    """Page title up to ' | LinkedIn' or ' - LinkedIn'."""
    return blank_to_null(F.trim(F.get(F.split(title, r"\s*[|\-–]\s*LinkedIn"), F.lit(0))))


def headline_title(headline: Column, fallback: Column | None = None) -> Column:
    """Job title: the headline before ' at '."""
    own = F.split_part(headline, F.lit(" at "), F.lit(1))
    return first_set(own, fallback) if fallback is not None else blank_to_null(own)


def split_list(c: Column, delimiter: str = ";", keep_empty: bool = False) -> Column:
    parts = F.transform(F.split(c, delimiter), lambda x: F.trim(x))
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def join_list(c: Column, delimiter: str = "; ") -> Column:
    """Joined text, null for no elements."""
    return blank_to_null(F.array_join(c, delimiter))


def distinct_ignoring_case(c: Column) -> Column:
    """Elements in order without later ones that differ only by case."""
    empty = F.slice(c, 1, 0)
    return F.aggregate(c, empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def list_skills(top_skills: Column, role_skills: Column) -> Column:
    """Skills of a bullet-separated text and of the roles, once each."""
    return distinct_ignoring_case(F.concat(F.coalesce(split_list(top_skills, "•"), F.array().cast("array<string>")), F.coalesce(F.flatten(role_skills), F.array().cast("array<string>"))))


def experience_summary(experience: Column, first: int = 5) -> Column:
    """'Position @ Company · Duration · Location' of the first roles, one a line; a dash for none."""

    def role(x: Column) -> Column:
        place = F.concat_ws(" @ ", first_set(x["position"]), first_set(x["companyName"]))
        return F.concat_ws(" · ", blank_to_null(place), first_set(x["duration"]), first_set(x["location"]))

    lines = F.filter(F.transform(F.slice(experience, 1, first), role), lambda x: x != "")
    return F.coalesce(blank_to_null(F.array_join(lines, "\n")), F.lit("—"))


def url_decode(c: Column) -> Column:
    """A text with its percent escapes read; a plus sign stays one. Null for broken escapes."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def address_key(url: Column) -> Column:
    """The key that a fetched address is kept under."""
    return F.md5(url)


def strip_nul(c: Column) -> Column:
    return F.regexp_replace(c, r"\x00", "")


#: Words that begin a title pasted on to a name, and words of titles in a place field.
TITLE_WORDS = ("Head", "Director", "Partner", "Manager", "Senior", "Associate", "Consultant", "Chief", "Principal", "Analyst", "Vice", "Managing", "Executive", "Advisor", "President", "Counsel")


def clean_person_name(name: Column, location: Column | None = None) -> Column:
    """A name without 'Meet X', the place and a title pasted on behind it."""
    c = F.regexp_replace(name, r"Meet\s+\S+\s*$", "")
    if location is not None:
        ends = c.endswith(location) & (F.length(location) > 0) & (F.length(c) > F.length(location))
        c = F.when(ends, F.left(c, F.length(c) - F.length(location))).otherwise(c)
    return F.trim(F.regexp_replace(c, r"(?<=\p{Ll})(?:" + "|".join(TITLE_WORDS) + r")\b.*$", ""))


def mask_profile_url(url: Column) -> Column:
    return F.when(F.lower(url).contains("/in/"), url)


def mask_location(location: Column) -> Column:
    """Null for a place that reads like a title."""
    return F.when(~location.rlike(r"(?i)\b(?:" + "|".join(TITLE_WORDS) + r")\b"), location)


def significant_tokens(folded: Column) -> Column:
    """Name tokens of three letters or more, without small words; the text must be folded already."""
    small = F.array(*[F.lit(w) for w in ("the", "and", "for", "von", "van", "de", "le", "la")])
    return F.filter(F.split(folded, r"[^a-z]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(small, t))


def compose_text(*columns: Column) -> Column:
    """Lower-case text of the non-empty parts, for keyword search."""
    return F.lower(F.concat_ws(" ", *[blank_to_null(c) for c in columns]))


def all_of(predicates: list[Column]) -> Column:
    """Conjunction of the predicates that are given."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))
