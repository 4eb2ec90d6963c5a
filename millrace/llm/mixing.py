"""Mixing sources to target weights by capped water-filling (problem 9).

A source can give at most ``max_repeats`` times its tokens. Shares are first asked of all sources; those that would pass
their cap are clamped to it and what is left is shared out again in proportion to the weights, until nothing changes. A
source is then used floor(e) whole times and a seeded fraction of it once more, where e is its tokens in the mix by its
tokens. The seeded fraction takes documents in the order of a hash until the tokens are reached: per-bucket token sums
locate the bucket where that happens, and only that bucket is ordered, so no source is gathered into one task.

Edge cases: sources not listed (null among them) have share 0 and aren't used; listed sources without tokens reach share
0; documents without tokens aren't used; null or negative shares and caps count as 0; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import count_tokens
from millrace.session import checkpoint

SEED = 17
#: Hash buckets per source in which the cut of the fractional repetition is located.
BUCKETS = 65_536
#: Listed sources, gathered on the driver for the water-filling; the list is a small table by definition.
MAX_TARGETS = 100_000


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    cap: int
    tokens: int
    wanted: float


def water_fill(targets: list[tuple[str, float, int, int]], total: float) -> dict[str, float]:
    """Tokens of each source (name, weight, cap, tokens), at most cap x tokens each and ``total`` in all if that can be."""
    limit = {s: float(cap * tokens) for s, _, cap, tokens in targets}
    weight = {s: w for s, w, _, _ in targets if w > 0 and limit[s] > 0}
    out = {s: 0.0 for s, *_ in targets}
    left, open_ = float(total), dict(weight)
    while open_ and left > 0:
        scale = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * scale >= limit[s]]
        if not full:
            for s, w in open_.items():
                out[s] = w * scale
            break
        for s in full:
            out[s] = limit[s]
            left -= limit[s]
            del open_[s]
    return out


def sized_documents(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, h): documents with their size and their place in the seeded order."""
    return documents.select("doc_id", "source", count_tokens(F.col("text")).cast("long").alias("tokens"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"))


def plan_mix(sized: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None) -> list[Share]:
    """The water-filling over the listed sources; ``total_tokens`` defaults to the tokens of all listed sources."""
    listed = mix_targets.select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap")).where("source is not null")
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = listed.join(sizes, "source", "left").select("source", "w", "cap", F.coalesce("tokens", F.lit(0)).alias("tokens")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} listed sources")
    targets = [(r["source"], float(r["w"]), int(r["cap"]), int(r["tokens"])) for r in rows]
    total = sum(t[3] for t in targets) if total_tokens is None else total_tokens
    wanted = water_fill(targets, total)
    return [Share(s, w, cap, tokens, wanted[s]) for s, w, cap, tokens in targets]


def use_documents(sized: DataFrame, plan: list[Share]) -> DataFrame:
    """(doc_id, source, tokens, uses): documents of the mix with how often each is used."""
    spark = sized.sparkSession
    rows = [(p.source, int(p.wanted // p.tokens), int(round(p.wanted - p.tokens * (p.wanted // p.tokens)))) for p in plan if p.tokens > 0 and p.wanted > 0]
    parts = F.broadcast(spark.createDataFrame(rows, "source string, whole int, rest long"))
    docs = sized.where("tokens > 0").join(parts, "source").withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)).cast("int"))
    # Token sums by bucket: at most sources x BUCKETS rows, whatever the size of the corpus.
    sums = docs.where("rest > 0").groupBy("source", "bucket").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("before", before).where("before < rest and before + t >= rest").select("source", F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("left"))
    # One row per listed source: broadcast by construction.
    placed = docs.join(F.broadcast(cut), "source", "left")
    within = Window.partitionBy("source").orderBy("h", "doc_id")
    columns = ["doc_id", "source", "tokens", "uses"]
    at_cut = placed.where("bucket = cut").withColumn("reach", F.sum("tokens").over(within)).withColumn("uses", F.col("whole") + (F.col("reach") <= F.col("left")).cast("int"))
    rest = placed.where("cut is null or bucket <> cut").withColumn("uses", F.col("whole") + F.when((F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))), 1).otherwise(0))
    return rest.select(columns).unionByName(at_cut.select(columns)).where("uses > 0")


def mix(documents: DataFrame, mix_targets: DataFrame, seed: int = SEED, total_tokens: int | None = None) -> tuple[DataFrame, list[Share], DataFrame]:
    """The mix (doc_id, source, tokens, uses), its plan, and the sized documents it came from."""
    sized = checkpoint(sized_documents(documents, seed))
    plan = plan_mix(sized, mix_targets, total_tokens)
    return use_documents(sized, plan), plan, sized


def report_shares(documents: DataFrame, mix_targets: DataFrame, seed: int = SEED, total_tokens: int | None = None) -> DataFrame:
    """One row per source, listed or found: its target and reached share, documents, tokens, uses and repetitions."""
    used, plan, sized = mix(documents, mix_targets, seed, total_tokens)
    spark = documents.sparkSession
    listed = spark.createDataFrame([(p.source, p.target, p.cap) for p in plan], "source string, target_share double, max_repeats int")
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens_available"))
    taken = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.count(F.lit(1)).alias("documents_used"), F.max("uses").alias("most_uses"))
    joined = have.join(F.broadcast(listed), "source", "full").join(F.broadcast(taken), "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = joined.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("max_repeats"), zero("documents"), zero("tokens_available"), zero("documents_used"), zero("tokens_used"), zero("most_uses"))
    everything = out.agg(F.sum("tokens_used").alias("all_tokens"))
    return out.crossJoin(F.broadcast(everything)).select("*", F.coalesce(F.round(F.try_divide("tokens_used", "all_tokens"), 6), F.lit(0.0)).alias("reached_share")).drop("all_tokens")
