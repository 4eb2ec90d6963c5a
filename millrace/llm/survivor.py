"""Best representative of each group of copies, field by field (problem 6).

The surviving value of a field is its usable value with the latest timestamp. Where timestamps are missing, currency reasoning
decides. The dated rows teach a precedence of value kinds: in each group kind a comes before kind b if it was last seen
earlier, and over all groups a precedes b where that happens significantly more often than the other way round; edges that
would close a cycle are left out, weakest first. In each group the timestamps and the precedence make a partial order of its
values, and a topologically latest one survives: an undated value beats the latest dated one only if its kind comes after that
one's, and it is out if any dated or undated value of the group comes after it. Of values that nothing orders a dated one
goes first, then the smallest id.

A group is reduced to its kinds (a handful per field) by partial aggregates before any of this, so a hot group is no burden.

Edge cases: fields without a usable value give no row; ties of timestamps go to the smallest id; a group without any
timestamp is ordered by precedence alone; without any dated group the smallest id wins; single rows are no group; values that
three or more names of a company share are nobody's own; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.copies import find_copies
from millrace.llm.residue import residue_flag
from millrace.session import broadcast_if_small, checkpoint

# What stands in a field instead of a value, and mailboxes that belong to no single person.
FILLER_WORDS = ("tbc", "tbd", "tba", "n/a", "na", "n.a.", "none", "null", "nil", "unknown", "see bio", "see office", "see website", "on request", "email hidden", "hidden", "private", "xxx", "not available", "not provided", "pending", "various", "other")
SHARED_MAILBOXES = ("info", "hello", "team", "contact", "enquiries", "enquiry", "inquiries", "office", "noreply", "no-reply", "donotreply", "mail", "admin", "reception", "press", "media", "careers", "jobs", "hr", "support", "sales", "webmaster", "help", "general", "marketing", "service", "kontakt", "people")
STOCK_IMAGE = r"(?i)(?:^|[/_.-])(?:logo|coming-soon|coming_soon|blank|placeholder|no-photo|nophoto|no_photo|no-image|noimage|silhouette|default|default-avatar|avatar-generic|avatar|generic|spacer|pixel|empty|dummy|unknown|missing|anonymous)(?:[/_.-]|$)"
CUT_OFF = r"(?i)(?:\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\]|\(continued\)|(?:\.\.\.|…)\s*(?:read\s+)?more)\s*$"

FIELDS = ("bio", "email", "phone", "image_url")


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}​]++|[\s\p{Z}​]++$", "")


def _is_filler(c: Column) -> Column:
    bare = F.lower(_plain(c))
    return ~bare.rlike(r"[\p{L}\p{N}]") | bare.isin(*FILLER_WORDS) | bare.rlike(r"^(.)\1*$")


def usable_email(c: Column) -> Column:
    low = F.lower(_plain(c))
    return low.rlike(r"^[\p{L}\p{N}][\p{L}\p{N}._%+'-]*@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}$") & ~F.split_part(low, F.lit("@"), F.lit(1)).isin(*SHARED_MAILBOXES) & ~low.rlike(r"^x{3,}@|@x{3,}\.")


def usable_phone(c: Column) -> Column:
    bare = _plain(c)
    digits = F.regexp_replace(bare, r"\D", "")
    whole = bare.rlike(r"^\+?[\d\s().\-/]+$") & (F.length(digits) >= 8) & ~digits.rlike(r"^(\d)\1*$") & ~bare.rlike(r"[.\-]$")
    return whole & ~bare.rlike(r"\s0$")  # extension 0 is the switchboard


def usable_image(c: Column) -> Column:
    bare = _plain(c)
    return bare.rlike(r"(?i)^(?:https?:)?//[^\s/]+/\S+$") & ~F.regexp_replace(bare, r"(?i)^(?:https?:)?//[^/]+", "").rlike(STOCK_IMAGE)


def usable_bio(c: Column) -> Column:
    return ~_is_filler(c) & ~c.rlike(CUT_OFF) & ~residue_flag(c)


USABLE = {"bio": usable_bio, "email": lambda c: ~_is_filler(c) & usable_email(c), "phone": lambda c: ~_is_filler(c) & usable_phone(c), "image_url": lambda c: ~_is_filler(c) & usable_image(c)}


def value_kind(field: Column, value: Column) -> Column:
    """A coarse form of a value, a handful per field, over which transitions are counted."""
    local = F.lower(F.split_part(value, F.lit("@"), F.lit(1)))
    email = F.when(local.rlike(r"^\p{L}{2,}\.\p{L}{2,}"), "dotted").when(local.contains("_"), "underscored").when(local.contains("."), "initial").when(local.rlike(r"\d"), "numbered").otherwise("joined")
    phone = F.when(value.startswith("+"), F.when(value.contains("-"), "dashed").otherwise("spaced")).otherwise("national")
    image = F.coalesce(F.nullif(F.regexp_extract(value, r"([_@-]\w+)?\.\w+$", 1), F.lit("")), F.lit("plain"))
    bio = F.when(F.length(value) < 120, "short").when(F.length(value) < 300, "medium").otherwise("long")
    return F.when(field == "email", email).when(field == "phone", phone).when(field == "image_url", F.left(image, F.lit(12))).otherwise(bio)


#: From so many different names on a company's value is shared, hence nobody's own.
SHARED_BY = 3


def shared_values(people: DataFrame, least: int = SHARED_BY) -> DataFrame:
    """(company_id, field_name, value): lines, mailboxes and pictures that several persons of a company have.

    Persons are told apart by the longest word of the name, so that spellings of one name rarely count as several.
    """
    longest = F.array_max(F.transform(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    named = people.where("name is not null and company_id is not null").select("company_id", F.left(longest, F.lit(4)).alias("who"), *[f for f in FIELDS if f != "bio"])
    long = named.select("company_id", "who", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS if f != "bio"])))
    hashed = long.where("value is not null").select("company_id", "field_name", F.xxhash64("value").alias("value"), F.xxhash64("who").alias("who"))
    # The least and the greatest person show whether there are two; only such values are counted out.
    ends = hashed.groupBy("company_id", "field_name", "value").agg(F.min("who").alias("low"), F.max("who").alias("high")).where("low < high")
    several = hashed.join(broadcast_if_small(checkpoint(ends)), ["company_id", "field_name", "value"])
    return several.where("who > low and who < high").select("company_id", "field_name", "value").distinct() if least == 3 else several.distinct().groupBy("company_id", "field_name", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")


def candidate_values(people: DataFrame) -> DataFrame:
    """(first_id, field_name, ts, from_id, kind): the distinct usable values of each group of copies."""
    copies = checkpoint(find_copies(people))
    members = copies.select("first_id", F.col("copy_id").alias("id")).union(copies.select("first_id", F.col("first_id").alias("id")).distinct())
    rows = people.select("id", "company_id", "updated_at", *FIELDS).join(members, "id")
    long = rows.select("first_id", "company_id", "id", "updated_at", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS]))).where("value is not null")
    # Usability depends on the value alone, so it is tested once per distinct value of a group.
    distinct = long.groupBy("first_id", "company_id", "field_name", "value").agg(F.max("updated_at").alias("ts"), F.min("id").alias("from_id"))
    usable = F.lit(False)
    for f, test in USABLE.items():
        if f != "bio":
            usable = F.when(F.col("field_name") == f, test(F.col("value"))).otherwise(usable)
    bios = distinct.where((F.col("field_name") == "bio") & ~_is_filler(F.col("value")) & ~F.col("value").rlike(CUT_OFF)).where(~residue_flag(F.col("value"))).drop("company_id")
    shared = broadcast_if_small(checkpoint(shared_values(people)))
    rest = distinct.where((F.col("field_name") != "bio") & usable).withColumn("plain", F.col("value")).withColumn("value", F.xxhash64("value"))
    own = rest.join(shared, ["company_id", "field_name", "value"], "left_anti").select("first_id", "field_name", F.col("plain").alias("value"), "ts", "from_id")
    return own.union(bios).withColumn("kind", value_kind(F.col("field_name"), F.col("value"))).drop("value")


def kinds_of_groups(candidates: DataFrame) -> DataFrame:
    """(first_id, field_name, kinds): per group and field each kind with its latest dated value and its first undated one."""
    kinds = candidates.groupBy("first_id", "field_name", "kind").agg(
        F.max(F.when(F.col("ts").isNotNull(), F.struct("ts", (-F.col("from_id")).alias("n")))).alias("dated"),
        F.min(F.when(F.col("ts").isNull(), F.col("from_id"))).alias("undated"),
    )
    # As many entries as there are kinds of the field: a bound by construction.
    return kinds.groupBy("first_id", "field_name").agg(F.collect_list(F.struct("kind", "dated", "undated")).alias("kinds"))


#: How many standard deviations the transitions of two kinds must lean to one side.
SIGNIFICANCE = 2.0


def learn_precedence(groups: DataFrame, significance: float = SIGNIFICANCE) -> dict[tuple[str, str], frozenset[str]]:
    """(field, kind) -> the kinds that come after it, learnt from the dated kinds of all groups: a strict partial order.

    The counts of ordered pairs of kinds (a fixed few) come to the driver.
    """
    dated = groups.select("field_name", F.filter("kinds", lambda k: k["dated"].isNotNull()).alias("k")).where(F.size("k") > 1)
    pairs = dated.select("field_name", F.explode(F.flatten(F.transform("k", lambda x: F.transform(F.filter(F.col("k"), lambda y: x["dated"]["ts"] < y["dated"]["ts"]), lambda y: F.struct(x["kind"].alias("early"), y["kind"].alias("late")))))).alias("p"))
    counts = {(r["field_name"], r["early"], r["late"]): r["n"] for r in pairs.groupBy("field_name", "p.early", "p.late").agg(F.count(F.lit(1)).alias("n")).collect()}
    edges = []
    for (field, a, b), n in counts.items():
        back = counts.get((field, b, a), 0)
        if (n - back) / (n + back) ** 0.5 >= significance:
            edges.append(((n - back) / (n + back), field, a, b))
    later: dict[tuple[str, str], set[str]] = defaultdict(set)
    for _, field, a, b in sorted(edges, key=lambda e: (-e[0], e[1:])):
        if a not in later[field, b] and a != b:
            # The order stays closed: whatever is before a comes before whatever is after b.
            after = {b} | later[field, b]
            for k in [k for (f, k), s in later.items() if f == field and a in s] + [a]:
                later[field, k] |= after
    return {k: frozenset(v) for k, v in later.items() if v}


def latest_of(kinds: Column, field: Column, later: dict[tuple[str, str], frozenset[str]]) -> Column:
    """The id that gives the topologically latest value of a group's kinds."""
    if later:
        table = F.create_map(*[x for (f, k), v in sorted(later.items()) for x in (F.lit(f"{f}/{k}"), F.array(*[F.lit(o) for o in sorted(v)]))])
        after = lambda k: F.coalesce(table[F.concat_ws("/", field, k)], F.array().cast("array<string>"))
    else:
        after = lambda k: F.array().cast("array<string>")
    newest = F.array_max(F.transform(F.filter(kinds, lambda k: k["dated"].isNotNull()), lambda k: F.struct(k["dated"]["ts"].alias("ts"), k["dated"]["n"].alias("n"), k["kind"].alias("kind"))))
    # Undated values with nothing after them: a dated value that comes after one has the newest dated value after it, too.
    open_ = F.filter(kinds, lambda k: k["undated"].isNotNull() & ~F.exists(kinds, lambda o: F.array_contains(after(k["kind"]), o["kind"])))
    first_undated = lambda ks: F.array_min(F.transform(ks, lambda k: k["undated"]))
    beats = F.filter(open_, lambda k: F.array_contains(after(newest["kind"]), k["kind"]))
    return F.when(newest.isNull(), first_undated(open_)).when(F.size(beats) > 0, first_undated(beats)).otherwise(-newest["n"])


def find_survivors(people: DataFrame, later: dict[tuple[str, str], frozenset[str]] | None = None) -> DataFrame:
    """(first_id, field_name, from_id): the row of each group that gives the surviving value of each field.

    ``later`` is a precedence learnt elsewhere (``learn_precedence``), for tables without timestamps.
    """
    groups = checkpoint(kinds_of_groups(candidate_values(people)))
    order = learn_precedence(groups) if later is None else later
    return groups.select("first_id", "field_name", latest_of(F.col("kinds"), F.col("field_name"), order).alias("from_id"))
