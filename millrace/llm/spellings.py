"""Variant spellings of names typed by people (problem 1).

Rows of one company that spell one person differently are linked. Each row is read into name parts and identifiers (the
person's own page, line, portrait and mailbox); rows with equal parts are one node, so copies never meet in pairs. Nodes of a
company meet where they share a MinHash band over the padded q-grams of their name, an identifier, or surname and initial; a meeting is verified by
Monge-Elkan similarity of the name parts and by what the identifiers say; and star clustering, heaviest node first, makes
persons of the nodes.

Bands: their number is tuned from the collision curve 1-(1-s^r)^b (``choose_bands``), so that names at the Jaccard similarity
``TARGET`` still meet with the chance ``RECALL``: 10 bands of 3 rows (0.91 at 0.6, 0.98 at 0.7). The grams of the surname count
twice, so that a slip in a name of usual length leaves the similarity at 0.6 or more while namesakes by the given name alone
stay near 0.2, where few of them meet.

Edge cases: rows without company or name words take no part; residue in the name keeps a row out; equal names in the same
order give no pair; a hot person's rows are joined by key only (AQE splits them); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from millrace.llm.persons import FULL_FORMS, NICKNAMES, SUFFIXES, TITLES, edits, fold, read_person
from millrace.llm.residue import is_residue
from millrace.session import broadcast_if_small, checkpoint, reread

Q, ROWS = 3, 3
#: Least similarity at which two names must still meet, and the chance of it.
TARGET, RECALL = 0.6, 0.9
#: Least share of all names in which a given name comes first, so that at most 1 / share words are gathered; rarer names are
#: known if they are in the fixed list of ``persons``. A share, not a number: the same at every size of the table.
GIVEN_SHARE = 4e-4
#: A word that comes first is a slip of another, no name, if it is one edit from it and so many times as rare.
SLIP_RATIO = 12
#: Least Monge-Elkan similarity of two name parts.
SIMILARITY = 0.84

READ_COLUMNS = ["id", "company_id", "name", "title", "bio", "email", "phone", "image_url", "linkedin_url", "twitter_url", "profile_url", "location"]
_READ_SCHEMA = "id long, company_id long, words string, given string, surname string, page string, network string, mailbox string, line string, portrait string, title_key string, city string, weak string"


def choose_bands(similarity: float = TARGET, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` rows in one of which names of this similarity meet with the chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def given_names(people: DataFrame, share: float = GIVEN_SHARE) -> frozenset[str]:
    """Words that come first in names far more often than last, without slips of commoner ones: at most 1 / ``share``.

    Only shares and ratios decide, so a table and any number of copies of it have the same given names.
    """
    words = F.filter(F.regexp_extract_all(F.lower("name"), F.lit(r"\p{L}{2,}"), F.lit(0)), lambda w: ~w.isin(*TITLES, *SUFFIXES))
    ends = people.where("name is not null").select(words.alias("w")).where(F.size("w") > 1)
    counted = ends.select(F.explode(F.array(F.struct(F.element_at("w", 1).alias("word"), F.lit(1).alias("f"), F.lit(0).alias("l")), F.struct(F.element_at("w", -1).alias("word"), F.lit(0).alias("f"), F.lit(1).alias("l")))).alias("x"))
    sums = counted.groupBy("x.word").agg(F.sum("x.f").alias("f"), F.sum("x.l").alias("l"))
    total = ends.agg(F.count(F.lit(1)).alias("n"))
    rows = sums.join(F.broadcast(total), F.col("f") >= share * F.col("n")).where(F.col("f") > 3 * F.col("l")).select("word", "f").collect()
    often: dict[str, int] = {}
    for r in rows:
        word = fold(r["word"])
        often[word] = often.get(word, 0) + r["f"]
    listed = {w for w in often if w in NICKNAMES or w in FULL_FORMS}
    return frozenset(w for w in often if w in listed or not any(often[o] >= SLIP_RATIO * often[w] and edits(w, o, 1) == 1 for o in often))


_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=100_000)
def title_key(title: str | None) -> str:
    """The first letters of the words of a title, sorted: the same for reordered and shortened titles."""
    if not title:
        return ""
    return " ".join(sorted({w[:3] for w in _WORD.findall(fold(title)) if w not in ("of", "the", "and")}))


@lru_cache(maxsize=100_000)
def city_key(location: str | None) -> str:
    """The first part of a place."""
    if not location:
        return ""
    text = fold(location).split("(")[0].split(",")[0].strip()
    return text.removesuffix(" area").strip()


def read_people(people: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """Rows with real names, read into parts (see ``persons.read_person``). No shuffle."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, company, name, title, bio, email, phone, image, network, twitter, page, location in zip(*(b[c].tolist() for c in READ_COLUMNS)):
                if not name or company is None or company != company or is_residue(name, True):
                    continue
                words = " ".join(_words(name))
                if not words:
                    continue
                p = read_person(name, email, phone, image, page, twitter, network, bio, location, lexicon)
                tk, city = title_key(title), city_key(location)
                weak = ""
                if not p["hinted"] and len(p["given"]) < 2:
                    # An initial alone isn't a name: such rows are one node only if everything else agrees too.
                    weak = "|".join((p["page"], p["mailbox"], p["line"], p["portrait"], tk, city))
                out.append((id_, int(company), words, p["given"], p["surname"], p["page"], p["network"], p["mailbox"], p["line"], p["portrait"], tk, city, weak))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _READ_SCHEMA.split(", ")])

    return people.select(READ_COLUMNS).mapInPandas(read, _READ_SCHEMA)


def _words(name: str) -> list[str]:
    return _WORD.findall(name.lower())


def padded_grams(words: list[str], q: int = Q) -> set[str]:
    """q-grams of each word with q-1 marks before and after it."""
    pad = "_" * (q - 1)
    return {(pad + w + pad)[i : i + q] for w in words if w for i in range(len(w) + q - 1)}


def weighted_grams(given: str, surname: str) -> set[str]:
    """The padded q-grams of both names, those of the surname twice (under two marks)."""
    twice = padded_grams([surname])
    return padded_grams([given]) | {f"1{g}" for g in twice} | {f"2{g}" for g in twice}


def minhash_bands(given: Column, surname: Column, bands: int = choose_bands(), rows: int = ROWS) -> Column:
    """Band keys (array<long>) of a name by MinHash over its weighted padded q-grams."""

    @F.pandas_udf(ArrayType(LongType()))
    def keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import zlib

        seeds = np.random.default_rng(11).integers(1, 1 << 61, size=(2, bands * rows), dtype=np.uint64)
        a, b = seeds[0] | np.uint64(1), seeds[1]
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        @lru_cache(maxsize=100_000)
        def codes(word: str) -> list[int]:
            return [zlib.crc32(g.encode()) for g in padded_grams([word])]

        for givens, surnames in batches:
            out: list[list[int]] = []
            names = list(zip(givens.tolist(), surnames.tolist()))
            for at in range(0, len(names), 2000):
                # The two marks of a surname's gram are two other numbers made of its code.
                grams = [codes(g) + [c ^ m for m in (0x5BD1E995, 0x27D4EB2F) for c in codes(s)] or [0] for g, s in names[at : at + 2000]]
                sizes = np.array([len(g) for g in grams])
                x = np.array([c for gs in grams for c in gs], dtype=np.uint64)
                h = (x[:, None] * a[None, :] + b[None, :]) >> np.uint64(20)
                low = np.minimum.reduceat(h, np.cumsum(sizes) - sizes, axis=0).reshape(len(grams), bands, rows)
                mixed = np.tile(salt, (len(grams), 1))
                for r in range(rows):
                    mixed = (mixed ^ low[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(29)
                out += [m if g or s else [] for m, (g, s) in zip(mixed.view(np.int64).tolist(), names[at : at + 2000])]
            yield pd.Series(out, dtype=object)

    return keys(given, surname)


def name_likeness(a: Column, b: Column) -> Column:
    """Likeness of two name words: by edits, 1 if equal, and 0.95 for an initial or a cut form."""
    longest = F.greatest(F.length(a), F.length(b))
    shortest = F.least(F.length(a), F.length(b))
    cut = (F.length(a) <= 3) & b.startswith(a) | (F.length(b) <= 3) & a.startswith(b)
    # levenshtein counts a swap of neighbours as two edits; as one slip it weighs as one.
    edits = F.levenshtein(a, b)
    swapped = (F.length(a) == F.length(b)) & (edits == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    slips = F.when(swapped, 1).otherwise(edits)
    return F.when(a == b, 1.0).when(shortest == 0, 0.0).when(cut, 0.95).otherwise(1 - slips * 1.2 / longest)


def _conflict(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def _agree(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


#: What tells persons apart or alike; kept as hashes, since only equality counts.
IDENTIFIERS = ("page", "network", "mailbox", "line", "portrait", "title", "city")


def make_nodes(read: DataFrame) -> DataFrame:
    """One node per company, name parts and (for initials) everything else, with its weight and identifiers (null if it has none)."""
    return read.groupBy("node", "company_id", "given", "surname").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first_id"), *[F.max(c).alias(c) for c in IDENTIFIERS])


def read_nodes(people: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """The rows of ``read_people`` with the node they belong to; ``words`` is a hash of the words of the name in order, and
    so are the identifiers hashes."""
    hashed = {c: F.when(F.col("title_key" if c == "title" else c) != "", F.xxhash64("title_key" if c == "title" else c)) for c in IDENTIFIERS}
    read = read_people(people, lexicon)
    return read.select("id", "company_id", F.xxhash64("company_id", "given", "surname", "weak").alias("node"), F.xxhash64("words").alias("words"), "given", "surname", "title_key", F.col("city").alias("place"), *[v.alias(c) for c, v in hashed.items()])


def link_nodes(nodes: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """(light, heavy, score): verified links from lighter to heavier nodes of a company."""
    pairs = checkpoint(meet_nodes(nodes, lexicon))
    # What the rules reject by the names alone is gone already, so few nodes are left to be compared.
    ends = broadcast_if_small(pairs.select(F.explode(F.array("n1", "n2")).alias("node")).distinct())
    met = checkpoint(nodes.join(ends, "node", "left_semi"))
    both = pairs.join(met.alias("p"), F.col("n1") == F.col("p.node")).join(met.alias("q"), F.col("n2") == F.col("q.node"))
    linked, score = alike(lexicon)
    # Full names before initials, then by weight.
    p_rank, q_rank = (F.struct(F.length(f"{x}.given") > 1, f"{x}.weight", f"{x}.node") for x in "pq")
    light, heavy = F.when(p_rank < q_rank, F.col("p.node")).otherwise(F.col("q.node")), F.when(p_rank < q_rank, F.col("q.node")).otherwise(F.col("p.node"))
    return both.where(linked).select(light.alias("light"), heavy.alias("heavy"), score.alias("score"))


def meet_nodes(nodes: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """(n1, n2): nodes of a company that share a key, without those that ``alike`` rejects by their names alone.

    Two different known given names are never linked but by an identifier, so among nodes with known given names the given
    name is part of the band's key: namesakes by the surname alone, whose number grows as the square of a company, don't meet.
    The others (initials, slips, rare names) meet all nodes by the plain keys. Names travel with the keys, so that the join
    tests them and only pairs that pass are shuffled.
    """
    known = F.col("given").isin(*lexicon) if lexicon else F.lit(False)
    named = ("node", "given", "surname")
    banded = checkpoint(nodes.select("company_id", *named, known.alias("known"), minhash_bands(F.col("given"), F.col("surname")).alias("bands")))
    # The company is part of the key, so that a bucket is one number.
    keyed = lambda rows, keys: rows.select(*named, F.explode(F.transform(F.array_distinct(keys), lambda k: F.xxhash64("company_id", k))).alias("key"))
    # A bare initial has too few q-grams for the bands, so it meets by the surname beside it.
    short = F.when(F.col("surname") != "", F.xxhash64(F.concat_ws("|", F.lit("i"), F.left("given", F.lit(1)), "surname")))
    plain = F.concat("bands", F.array_compact(F.array(short)))
    by_given = keyed(banded.where("known"), F.transform("bands", lambda k: F.xxhash64("given", k)))
    unknown = broadcast_if_small(checkpoint(keyed(banded.where("not known"), plain)))
    exact = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), c)) for c in ("page", "network", "mailbox", "line", "portrait")]
    by_id = keyed(nodes, F.array_compact(F.array(*exact)))
    by_name, monge_elkan = named_alike()
    met = lambda a, b, order, test: a.alias("p").join(b.alias("q"), (F.col("p.key") == F.col("q.key")) & order & test).select(F.least("p.node", "q.node").alias("n1"), F.greatest("p.node", "q.node").alias("n2"))
    once = F.col("p.node") < F.col("q.node")
    pairs = met(by_given, by_given, once, by_name).unionByName(met(by_id, by_id, once, monge_elkan >= 0.6))
    # Equal lines, portraits or pages ask for less, but such nodes meet by them.
    return pairs.unionByName(met(keyed(banded, plain), unknown, F.col("p.node") != F.col("q.node"), by_name)).distinct()


def named_alike() -> tuple[Column, Column]:
    """Whether the names of ``p`` and ``q`` (aliases) are those of one person, and their Monge-Elkan similarity."""
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    surname, given = name_likeness(p("surname"), q("surname")), name_likeness(p("given"), q("given"))
    crossed = (name_likeness(p("surname"), q("given")) + name_likeness(p("given"), q("surname"))) / 2
    monge_elkan = F.greatest((surname + given) / 2, crossed)
    return (surname >= 0.6) & (given >= 0.5) & (monge_elkan >= SIMILARITY) | (crossed >= 0.9), monge_elkan


def alike(lexicon: frozenset[str]) -> tuple[Column, Column]:
    """Whether the nodes ``p`` and ``q`` (aliases) of one company stand for one person, and how much speaks for it."""
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    known = (lambda c: c.isin(*lexicon)) if lexicon else (lambda c: F.lit(False))
    by_name, monge_elkan = named_alike()
    same_id = _agree(p("line"), q("line")) | _agree(p("portrait"), q("portrait")) | _agree(p("page"), q("page"))
    mailbox, title, city = (_agree(p(c), q(c)) for c in ("mailbox", "title", "city"))
    other_id = _conflict(p("line"), q("line")) | _conflict(p("portrait"), q("portrait")) | _conflict(p("page"), q("page"))
    two_names = known(p("given")) & known(q("given")) & (p("given") != q("given"))
    one_initial = (F.length(p("given")) < 2) | (F.length(q("given")) < 2)
    support = mailbox.cast("int") * 3 + title.cast("int") * 2 + city.cast("int") + _agree(p("network"), q("network")).cast("int") * 3
    apart = _conflict(p("title"), q("title")) & _conflict(p("city"), q("city")) & ~mailbox
    linked = F.when(other_id, False).when(same_id, monge_elkan >= 0.6).when(two_names, False).otherwise(by_name & F.when(one_initial, ~apart).otherwise(True))
    return linked, monge_elkan + F.when(same_id, 4).otherwise(0) + support / 4


def star_cluster(links: DataFrame) -> DataFrame:
    """(node, center): satellites of the stars. A node is a center unless a heavier linked node is one; a satellite goes to
    the center with the best score. Each round decides all nodes whose heavier neighbours are decided."""
    links = checkpoint(links)
    light = links.select(F.col("light").alias("node")).distinct()
    first = links.select(F.col("heavy").alias("node")).distinct().join(light, "node", "left_anti").withColumn("center", F.lit(True))
    # Each round appends the nodes that it decides; none is written twice.
    rounds = [checkpoint(first)]
    decided = rounds[0]
    while True:
        open_ = light.join(decided, "node", "left_anti")
        state = links.join(open_, F.col("light") == F.col("node"), "left_semi").join(decided.withColumnRenamed("node", "heavy"), "heavy", "left")
        ready = state.groupBy("light").agg(F.count(F.when(F.col("center").isNull(), 1)).alias("waiting"), F.max(F.coalesce("center", F.lit(False))).alias("taken"))
        now = checkpoint(ready.where("waiting = 0 or taken").select(F.col("light").alias("node"), (~F.col("taken")).alias("center")))
        if now.isEmpty():
            break
        rounds.append(now)
        decided = reread(rounds)
    stars = links.join(decided.where("center").select(F.col("node").alias("heavy")), "heavy", "left_semi").join(decided.where("not center").select(F.col("node").alias("light")), "light", "left_semi")
    return stars.groupBy("light").agg(F.max_by("heavy", F.struct("score", "heavy")).alias("center")).withColumnRenamed("light", "node")


def resolve_people(people: DataFrame) -> DataFrame:
    """(id, company_id, words, person): the person that each row with a real name stands for; ``words`` is a hash of the
    words of the name in order."""
    lexicon = given_names(people)
    read = checkpoint(read_nodes(people, lexicon))
    nodes = checkpoint(make_nodes(read))
    centers = broadcast_if_small(checkpoint(star_cluster(link_nodes(nodes, lexicon))))
    rows = read.select("id", "company_id", "node", "words").join(centers, "node", "left")
    return rows.select("id", "company_id", "words", F.coalesce("center", "node").alias("person"))


def find_spellings(people: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs of rows of one company that stand for one person under different names.

    Persons of one spelling are set aside by a map-side aggregate; of the others the spellings are paired first, so that
    rows of one spelling never meet and every comparison is a result.
    """
    resolved = resolve_people(people).select("person", "id", F.col("words").alias("w"))
    several = resolved.groupBy("person").agg(F.min("w").alias("low"), F.max("w").alias("high")).where("low < high").select("person")
    rows = checkpoint(resolved.join(several, "person", "left_semi"))
    spellings = rows.select("person", "w").distinct()
    two = spellings.alias("x").join(spellings.alias("y"), (F.col("x.person") == F.col("y.person")) & (F.col("x.w") < F.col("y.w"))).select("x.person", F.col("x.w").alias("w"), F.col("y.w").alias("v"))
    first = two.join(rows, ["person", "w"]).select("person", "v", F.col("id").alias("i"))
    pairs = first.join(rows.withColumnRenamed("w", "v"), ["person", "v"])
    return pairs.select(F.least("i", "id").alias("id_a"), F.greatest("i", "id").alias("id_b"))
