"""Matching persons across two sources without a shared key (problem 4).

Records of both sources form a graph record - attribute - token. Random walks over shares of it, all records
taking part, train skip-gram vectors of the (hashed) tokens, which are averaged. Blocking: one family of hyperplane tables over the trained vectors of the names,
within a firm. A record stands in the cell of its surname, and in cells of its given name that the hyperplanes of the surname
split: the number of these planes follows the firm's size, so that a cell stays small whatever the size, and the number of
tables follows from the planes, so that surnames at the cosine ``SLIP_COSINE`` still meet with the chance ``RECALL``
(``choose_tables``). Records whose firm is unknown meet by the whole name alone. Rerank: the exact cosine of the whole records
(each attribute's vector side by side) decides between the persons that a profile met; the rules on names, firm and address
only veto. The cosine is calibrated to a confidence on the best pairs that have a profile address on both sides.

The firm of a bucket is a firm of ``companies``: a profile stands in the buckets of the firms written nearest to its own
(``nearest_firms``), so slips in the firm keep nobody apart and the buckets of a profile don't grow with the number of firms.

Index recall against brute force is measured in tests: at least 0.95 of pairs of a firm with one slip in the surname share a
bucket, in small and large firms. Names that differ in both parts don't meet.

Edge cases: profiles without any name word match nothing; equal best cosines of different persons give no match and are listed
by ``match_ties``; residue in the name keeps a row out; several rows or profiles of a person give all pairs; empty tables give
an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.persons import fold, read_person
from millrace.llm.spellings import SIMILARITY, alike, city_key, given_names, make_nodes, name_likeness, read_nodes, title_key
from millrace.operators import firms
from millrace.operators.firms import employer_in_text, nearest_firms, same_firm
from millrace.session import broadcast_if_small, checkpoint

#: Records that one task walks and trains on; there are as many shares as all records need.
RECORDS_TOGETHER = 20_000
#: Records that the tests of the index train on.
SAMPLE_RECORDS = 3_000
VOCABULARY, DIMENSIONS, WALKS, WALK_LENGTH, WINDOW, NEGATIVES, RATE = 1 << 14, 32, 3, 8, 1, 4, 0.05
#: Pairs of a step, whose vectors move together; a step has under twice as many, and their negatives must fit the vocabulary.
PAIRS_TOGETHER = 2048
#: The cosine at which two surnames must still meet, and the chance of it: one slip in a surname of usual length leaves 0.6, a swap a little less.
SLIP_COSINE, RECALL = 0.55, 0.95
#: Records of a firm that need no planes of the surname (the given names alone split them); the most planes; planes that stand for a whole name.
SMALL_FIRM, MOST_PLANES, WHOLE_PLANES = 1024, 20, 24
#: Weight of each attribute in the vector of a record.
WEIGHTS = {"surname": 1.0, "given": 0.8, "employer": 0.8, "title": 0.5, "city": 0.5}
ADDRESS_WEIGHT = 1.0
ATTRIBUTES = tuple(WEIGHTS)

employer_key = partial(firms.employer_key, fold=fold)
PROFILE_COLUMNS = ["profile_id", "first_name", "last_name", "headline", "current_title", "company_name", "location", "linkedin_url", "about"]
_PROFILE_SCHEMA = "profile_id long, given string, surname string, address string, employer string, title_key string, city string"


def read_profiles(profiles: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """Profiles read into the same parts as the rows of people."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, first, last, headline, title, company, location, url, about in zip(*(b[c].tolist() for c in PROFILE_COLUMNS)):
                name = f"{first or ''} {last or ''}".strip() if not (first and last and len(first.split()) == 1 and "," not in last) else f"{last}, {first}"
                p = read_person(name, None, None, None, None, None, url, about, location, lexicon)
                if not p["surname"]:
                    continue
                slug = (url or "").strip().lower().split("?")[0].rstrip("/").rpartition("/in/")[2]
                firm = company or employer_in_text(headline, about)
                head = re.split(r"\s@\s|\sat\s|\s\|\s", headline)[0] if headline else None
                out.append((id_, p["given"], p["surname"], slug, employer_key(firm), title_key(title or head), city_key(location)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PROFILE_SCHEMA.split(", ")])

    return profiles.select(PROFILE_COLUMNS).mapInPandas(read, _PROFILE_SCHEMA)


@lru_cache(maxsize=100_000)
def tokens_of(attribute: str, value: str) -> tuple[int, ...]:
    """Hashed tokens of one attribute: padded trigrams of names and firms, words of titles, the whole of the rest."""
    if not value:
        return ()
    if attribute in ("surname", "employer"):
        padded = f"  {value.split()[0] if attribute == 'employer' else value} "
        parts = [padded[i : i + 3] for i in range(len(padded) - 2)]
    elif attribute == "title":
        parts = value.split()
    else:
        parts = [value]
    return tuple([zlib.crc32(f"{attribute}:{p}".encode()) % VOCABULARY for p in parts])


def choose_tables(planes: int, cosine: float = SLIP_COSINE, recall: float = RECALL) -> int:
    """The fewest tables of so many planes in one of which vectors at this cosine share a cell with the chance ``recall``."""
    alike = (1 - math.acos(cosine) / math.pi) ** planes
    return math.ceil(math.log(1 - recall) / math.log(1 - alike)) if planes else 1


def planes_of(size: Column) -> Column:
    """Planes of the surname for a firm of so many records."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1)) / SMALL_FIRM)).cast("int"), F.lit(0)), F.lit(MOST_PLANES))


@dataclass
class TokenVectors:
    """Token vectors and token weights: a few MB, whatever the size of the tables."""

    vectors: np.ndarray
    weights: np.ndarray
    #: Mean of the attribute vectors over the sample; without it all vectors would lean to one side of the planes.
    means: dict[str, np.ndarray]

    def attribute_vectors(self, attribute: str, values: list[str]) -> np.ndarray:
        """Unit vectors (zero for missing values) of one attribute of many records."""
        seen = {v: i for i, v in enumerate(dict.fromkeys(values))}
        out = np.zeros((len(seen), DIMENSIONS), dtype=np.float32)
        lists = [tokens_of(attribute, v) for v in seen]
        flat = np.array([t for ts in lists for t in ts], dtype=np.int64)
        if len(flat):
            sizes = np.array([len(ts) for ts in lists])
            full = sizes > 0
            out[full] = np.add.reduceat(self.vectors[flat] * self.weights[flat][:, None], (np.cumsum(sizes) - sizes)[full], axis=0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1))[[seen[v] for v in values]] if values else out

    def centred(self, attribute: str, values: list[str]) -> np.ndarray:
        own = self.attribute_vectors(attribute, values)
        return own - self.means[attribute] * (np.abs(own).sum(axis=1, keepdims=True) > 0)

    def bucket_keys(self, surnames: list[str], givens: list[str], firms: np.ndarray, planes: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of every bucket: rows with a firm (planes of 0 or more) stand in its tables, ``free`` ones in that of whole names."""
        surname, given = self.centred("surname", surnames), self.centred("given", givens)
        firm = firms.astype(np.int64).view(np.uint64)

        def codes(vectors: np.ndarray, bits: int, table: int) -> np.ndarray:
            normal = np.random.default_rng([23, table, bits]).standard_normal((DIMENSIONS, max(bits, 1))).astype(np.float32)[:, :bits]
            return ((vectors @ normal > 0).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

        def mixed(table: int, *parts: np.ndarray) -> np.ndarray:
            out = np.uint64((table + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            for part in parts:
                out = (out ^ part) * np.uint64(0xBF58476D1CE4E5B9)
                out = out ^ (out >> np.uint64(29))
            return out.view(np.int64)

        rows, keys = [], []
        at = np.flatnonzero((planes >= 0) & np.array([bool(x) for x in surnames], dtype=bool))
        whole_surname, whole_given = codes(surname, WHOLE_PLANES, 0), codes(given, WHOLE_PLANES, 1)
        rows.append(at)
        keys.append(mixed(0, firm[at], whole_surname[at]))
        named = (planes >= 0) & np.array([bool(x) for x in givens], dtype=bool)
        for bits in np.unique(planes[named]).tolist():
            at = np.flatnonzero(named & (planes == bits))
            for table in range(choose_tables(bits)):
                rows.append(at)
                keys.append(mixed(2 + table, firm[at], whole_given[at], codes(surname[at], bits, 2 + table)))
        at = np.flatnonzero(free)
        rows.append(at)
        keys.append(mixed(1, whole_surname[at], whole_given[at]))
        return np.concatenate(rows), np.concatenate(keys)

    def cosines(self, left: dict[str, list[str]], right: dict[str, list[str]], same: np.ndarray, left_has: np.ndarray, right_has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of whole records (attribute vectors side by side) with and without the profile address."""
        n = len(same)
        dot, a, b = np.zeros(n), np.zeros(n), np.zeros(n)
        for attribute, weight in WEIGHTS.items():
            x, y = self.attribute_vectors(attribute, left[attribute]), self.attribute_vectors(attribute, right[attribute])
            dot += weight**2 * np.einsum("nd,nd->n", x, y)
            a += weight**2 * (np.abs(x).sum(axis=1) > 0)
            b += weight**2 * (np.abs(y).sum(axis=1) > 0)
        w = ADDRESS_WEIGHT**2
        whole = (dot + w * same) / np.sqrt(np.maximum(a + w * left_has, 1e-9) * np.maximum(b + w * right_has, 1e-9))
        return whole.round(6), (dot / np.sqrt(np.maximum(a, 1e-9) * np.maximum(b, 1e-9))).round(6)


def _offsets(lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins among all members in order, and how long it is."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.cumsum(sizes) - sizes, sizes


def walk_tokens(records: list[dict[str, str]], rng: np.random.Generator) -> np.ndarray:
    """Tokens seen by random walks record -> attribute -> token -> record, one walk a line; all walkers step together."""
    attributes = [own for r in records if (own := [ts for a in ATTRIBUTES if (v := r.get(a)) and (ts := tokens_of(a, v))])]
    if not attributes:
        return np.zeros((0, WALK_LENGTH), dtype=np.int64)
    lists = [ts for own in attributes for ts in own]
    (first_attribute, attribute_count), (first_token, token_count) = _offsets(attributes), _offsets(lists)
    tokens = np.array([t for ts in lists for t in ts], dtype=np.int64)
    owner = np.repeat(np.repeat(np.arange(len(attributes)), attribute_count), token_count)
    order = np.argsort(tokens, kind="stable")
    holders, held = owner[order], tokens[order]
    start, end = np.searchsorted(held, np.arange(VOCABULARY)), np.searchsorted(held, np.arange(VOCABULARY), side="right")
    pick = lambda n: (rng.random(len(n)) * n).astype(np.int64)
    at = np.repeat(np.arange(len(attributes)), WALKS)
    seen = np.zeros((len(at), WALK_LENGTH), dtype=np.int64)
    for step in range(WALK_LENGTH):
        attribute = first_attribute[at] + pick(attribute_count[at])
        token = tokens[first_token[attribute] + pick(token_count[attribute])]
        seen[:, step] = token
        at = holders[start[token] + pick((end - start)[token])]
    return seen


def skip_gram(records: list[dict[str, str]], seed: int = 5) -> np.ndarray:
    """Token vectors by skip-gram with negative sampling over the random walks; steps on ``PAIRS_TOGETHER`` pairs at once.

    The tokens that the pairs of a step aren't near are a run of the vocabulary from a random start. Tokens stand there by their
    hashes and pairs come in random order, so each pair still has ``NEGATIVES`` tokens, any one as likely as another; but none
    comes twice in a step, so they are read and written as rows, without a search for those that are to be summed.
    """
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((VOCABULARY, DIMENSIONS)) / np.sqrt(DIMENSIONS)).astype(np.float32)
    context = np.zeros_like(vectors)
    seen = walk_tokens(records, rng)
    steps = [d for d in range(-WINDOW, WINDOW + 1) if d]
    pairs = np.concatenate([np.stack([seen[:, max(0, -d) : WALK_LENGTH - max(0, d)].ravel(), seen[:, max(0, d) : WALK_LENGTH - max(0, -d)].ravel()]) for d in steps], axis=1)
    if not pairs.size:
        return vectors
    pairs = pairs[:, rng.permutation(pairs.shape[1])]
    pull = lambda x: np.float32(RATE) / (1 + np.exp(x))
    halves = np.arange(DIMENSIONS // 2)

    def add(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        # Two numbers at once, as one complex number; a token may come several times.
        np.add.at(table.view(np.complex64).reshape(-1), (rows[:, None] * (DIMENSIONS // 2) + halves).reshape(-1), values.view(np.complex64).reshape(-1))

    for center, near in np.array_split(pairs, max(1, pairs.shape[1] // PAIRS_TOGETHER), axis=1):
        start, n = int(rng.integers(VOCABULARY)), NEGATIVES * len(center)
        over = max(0, start + n - VOCABULARY)
        v, u = vectors[center], context[near]
        w = np.concatenate([context[start : start + n], context[:over]]).reshape(NEGATIVES, len(center), DIMENSIONS)
        g, h = pull(np.einsum("bd,bd->b", v, u))[:, None], -pull(-np.einsum("bd,nbd->nb", v, w))
        away = (h[:, :, None] * v).reshape(n, DIMENSIONS)
        context[start : start + n] += away[: n - over]
        context[:over] += away[n - over :]
        add(context, near, g * v)
        add(vectors, center, g * u + np.einsum("nb,nbd->bd", h, w))
    return vectors


def token_weights(frequencies: np.ndarray) -> np.ndarray:
    """Rare tokens tell more than frequent ones."""
    return np.log((frequencies.sum() + 1) / (frequencies + 1)).clip(0.1).astype(np.float32)


def train_vectors(records: list[dict[str, str]], frequencies: np.ndarray, seed: int = 5) -> TokenVectors:
    """Vectors and means of these records alone."""
    model = TokenVectors(skip_gram(records, seed), token_weights(frequencies), {})
    for a in ATTRIBUTES:
        own = model.attribute_vectors(a, [r.get(a) or "" for r in records])
        present = np.abs(own).sum(axis=1) > 0
        model.means[a] = own[present].mean(axis=0) if present.any() else np.zeros(DIMENSIONS, dtype=np.float32)
    return model


def count_values(records: DataFrame) -> DataFrame:
    """(attribute, value, n): in how many records each value of an attribute stands."""
    values = records.select(F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in ATTRIBUTES]))).where("value <> ''")
    return values.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def token_frequencies(records: DataFrame, values: DataFrame | None = None) -> np.ndarray:
    """How many records hold each hashed token, over all records: distinct values are counted first (``values``, if it is done),
    and at most VOCABULARY numbers come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(VOCABULARY, dtype=np.int64)
        for b in batches:
            for a, v, n in zip(b["attribute"].tolist(), b["value"].tolist(), b["n"].tolist()):
                for t in set(tokens_of(a, v)):
                    sums[t] += n
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"token": at, "n": sums[at]})

    counts = (count_values(records) if values is None else values).mapInPandas(count, "token long, n long")
    out = np.zeros(VOCABULARY)
    for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = r["n"]
    return out


def with_buckets(records: DataFrame, model: TokenVectors, id_: str) -> DataFrame:
    """(id, key): the buckets of ``records`` (id, surname, given, firm, planes, free)."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, key = model.bucket_keys(b["surname"].tolist(), b["given"].tolist(), b["firm"].to_numpy(), b["planes"].to_numpy(), b["free"].to_numpy(dtype=bool))
            yield pd.DataFrame({id_: b[id_].to_numpy()[row], "key": key})

    return records.select(id_, "surname", "given", F.coalesce("firm", F.lit(0)).alias("firm"), F.coalesce("planes", F.lit(-1)).alias("planes"), "free").mapInPandas(keys, f"{id_} long, key long")


def with_cosines(pairs: DataFrame, model: TokenVectors) -> DataFrame:
    """Adds ``whole`` and ``rest``, the cosines of the records with and without the profile address."""

    @F.pandas_udf("whole double, rest double")
    def cosines(same: pd.Series, left_has: pd.Series, right_has: pd.Series, *values: pd.Series) -> pd.DataFrame:
        lists = [v.tolist() for v in values]
        left, right = dict(zip(ATTRIBUTES, lists)), dict(zip(ATTRIBUTES, lists[len(ATTRIBUTES) :]))
        whole, rest = model.cosines(left, right, *(x.to_numpy(dtype=float) for x in (same, left_has, right_has)))
        return pd.DataFrame({"whole": whole, "rest": rest})

    return pairs.withColumn("cosine", cosines("same_address", F.expr("size(p.addresses) > 0"), F.expr("q.address is not null"), *[f"{s}.{a}" for s in "pq" for a in ATTRIBUTES]))


def train_all(records: DataFrame, frequencies: np.ndarray, together: int = RECORDS_TOGETHER, values: DataFrame | None = None) -> TokenVectors:
    """``train_vectors`` over all records: shares of about ``together`` records, by a hash, are walked and trained side by side
    from the same start, and the vectors of a token are averaged over the shares that hold it, weighted by its records there.
    The means are those of all records, by their distinct values. A vector a token comes to the driver, whatever the number of shares."""
    shares = max(1, math.ceil(records.count() / together))
    placed = records.select(F.pmod(F.xxhash64(*ATTRIBUTES), F.lit(shares)).alias("share"), *ATTRIBUTES)

    def train(b: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(VOCABULARY, dtype=np.int64)
        for a in ATTRIBUTES:
            for v, n in b[a].value_counts().items():
                held[list(set(tokens_of(a, v)))] += n
        at = np.flatnonzero(held)
        own = [dict(zip(ATTRIBUTES, r)) for r in sorted(zip(*(b[a].fillna("").tolist() for a in ATTRIBUTES)))]
        return pd.DataFrame({"token": at, "share": b["share"].iloc[0], "n": held[at], "v": list(skip_gram(own)[at])})

    def average(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["token", "share"])
        token, n = b["token"].to_numpy(), b["n"].to_numpy()
        first = np.flatnonzero(np.diff(token, prepend=-1))
        sums = np.add.reduceat(np.stack(b["v"].tolist()) * n[:, None], first, axis=0)
        return pd.DataFrame({"token": token[first], "v": list((sums / np.add.reduceat(n, first)[:, None]).astype(np.float32))})

    trained = placed.groupBy("share").applyInPandas(train, "token long, share long, n long, v array<float>")
    model = TokenVectors(skip_gram([]), token_weights(frequencies), {a: np.zeros(DIMENSIONS, dtype=np.float32) for a in ATTRIBUTES})
    for r in trained.groupBy(F.pmod("token", F.lit(64))).applyInPandas(average, "token long, v array<float>").collect():
        model.vectors[r["token"]] = r["v"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a, part in b.groupby("attribute"):
                own, n = model.attribute_vectors(a, part["value"].tolist()).astype(float), part["n"].to_numpy()
                yield pd.DataFrame({"attribute": [a], "n": [n[np.abs(own).sum(axis=1) > 0].sum()], "v": [n @ own]})

    columns = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMENSIONS)]
    for r in (count_values(records) if values is None else values).mapInPandas(sums, "attribute string, n long, v array<double>").groupBy("attribute").agg(F.sum("n").alias("n"), *columns).collect():
        model.means[r["attribute"]] = np.array([r[f"v{i}"] for i in range(DIMENSIONS)], dtype=np.float32) / np.float32(max(1, r["n"]))
    return model


def judge_pairs(people: DataFrame, companies: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocking and rerank: ``rows`` (id, node) and ``judged`` (profile_id, node, whole, rest, known, sure, role), the pairs
    that no rule vetoes. ``known`` tells that both have a profile address, ``sure`` that it is one; ``role`` is ``best`` for a
    profile's best node, ``same`` for nodes that stand for its person, ``tie`` for another person's node with the same cosine
    and ``other`` for the rest.
    """
    lexicon = given_names(people)
    read = checkpoint(read_nodes(people, lexicon))
    nodes = checkpoint(make_nodes(read))

    @F.pandas_udf("string")
    def firm_key(names: pd.Series) -> pd.Series:
        return names.map(employer_key)

    named = checkpoint(companies.select(F.col("id").alias("company_id"), firm_key(firms.firm_text()).alias("employer")))
    # Nodes carry hashes; their first rows give the title and the place in letters.
    words = read.select(F.col("id").alias("first_id"), F.col("title_key").alias("title"), F.col("place").alias("city"))
    persons = checkpoint(
        nodes.select("node", "company_id", "given", "surname", "page", "network", "first_id").join(words, "first_id").join(broadcast_if_small(named), "company_id", "left")
        .select("node", "given", "surname", F.coalesce("employer", F.lit("")).alias("employer"), F.array_compact(F.array("page", "network")).alias("addresses"), F.col("network").isNotNull().alias("networked"), "title", "city")
    )
    roster = checkpoint(read_profiles(profiles, lexicon).withColumnRenamed("title_key", "title").withColumn("address", F.when(F.col("address") != "", F.xxhash64("address"))))
    records = persons.select(*ATTRIBUTES).unionByName(roster.select(*ATTRIBUTES))
    values = checkpoint(count_values(records))
    model = train_all(records, token_frequencies(records, values), values=values)
    sizes = checkpoint(persons.where("employer <> ''").groupBy("employer").agg(F.count(F.lit(1)).alias("n")).select("employer", F.xxhash64("employer").alias("firm"), planes_of(F.col("n")).alias("planes")))
    near = _near(named, roster, sizes)
    stand_a = persons.join(broadcast_if_small(sizes), "employer", "left").withColumn("free", F.lit(True))
    stand_b = roster.join(broadcast_if_small(near), "employer", "left").withColumn("free", F.col("firm").isNull())
    pairs = with_buckets(stand_a, model, "node").join(with_buckets(stand_b, model, "profile_id"), "key").select("node", "profile_id").distinct()
    both = pairs.join(roster.select("profile_id", "address", *ATTRIBUTES).alias("q"), "profile_id").join(persons.select("node", "addresses", "networked", *ATTRIBUTES).alias("p"), "node")
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    # Every rule below asks for a likeness of the surnames of 0.5, so at most half of the letters may differ.
    near_surname = (p("surname") == q("surname")) | (F.length(p("surname")) <= 3) | (F.length(q("surname")) <= 3) | (F.levenshtein(p("surname"), q("surname")) * 2 <= F.greatest(F.length(p("surname")), F.length(q("surname"))) + 2)
    surname, given = name_likeness(p("surname"), q("surname")), name_likeness(p("given"), q("given"))
    likeness = (surname + given) / 2
    known = (lambda c: c.isin(*lexicon)) if lexicon else (lambda c: F.lit(False))
    two_names = known(p("given")) & known(q("given")) & (p("given") != q("given"))
    same_address = F.coalesce(F.array_contains(p("addresses"), q("address")), F.lit(False))
    firm, no_firm = same_firm(p("employer"), q("employer")), (q("employer") == "") | (p("employer") == "")
    whole = (F.length(p("given")) > 1) & (F.length(q("given")) > 1)
    title, city = (q("title") != "") & (p("title") == q("title")), (q("city") != "") & (p("city") == q("city"))
    # What a pair must not fail: unlike names, another firm, or nothing but a name.
    by_name = (surname >= 0.6) & (given >= 0.5) & (likeness >= SIMILARITY)
    allowed = near_surname & ~two_names & ((same_address & (surname >= 0.5)) | (by_name & (firm | (no_firm & whole & (likeness >= 0.99) & (title | city)))))
    scored = with_cosines(both.where(allowed).withColumn("same_address", same_address), model)
    kept = checkpoint(scored.select("profile_id", "node", "cosine.whole", "cosine.rest", F.col("same_address").alias("sure"), (p("networked") & q("address").isNotNull()).alias("known")))
    best = kept.groupBy("profile_id").agg(F.max(F.struct("whole", "node")).alias("top"), F.count(F.lit(1)).alias("nodes"))
    # Only the few profiles with several nodes need to ask which of them are one person.
    rivals = kept.join(best.where("nodes > 1"), "profile_id").where("node <> top.node").select("profile_id", "node", F.col("top.node").alias("top_node"), (F.col("whole") == F.col("top.whole")).alias("level"))
    linked, _ = alike(lexicon)
    verdict = rivals.join(nodes.alias("p"), F.col("p.node") == rivals["node"]).join(nodes.alias("q"), F.col("q.node") == F.col("top_node"))
    verdict = verdict.select("profile_id", rivals["node"], F.when((p("company_id") == q("company_id")) & linked, "same").when(F.col("level"), "tie").otherwise("other").alias("role"))
    judged = kept.join(broadcast_if_small(checkpoint(verdict)), ["profile_id", "node"], "left").withColumn("role", F.coalesce("role", F.lit("best")))
    return read.select("id", "node"), judged


def _near(named: DataFrame, roster: DataFrame, sizes: DataFrame) -> DataFrame:
    """(employer, firm, planes): the buckets of a profile's employer; firms without people have none."""
    at = sizes.select(F.col("employer").alias("name"), F.col("firm").alias("hash"), "planes")
    return checkpoint(nearest_firms(named, roster).join(broadcast_if_small(at), F.col("firm") == F.col("name")).select("employer", F.col("hash").alias("firm"), "planes"))


def _winners(judged: DataFrame) -> DataFrame:
    """The nodes of each profile's best person, without profiles for which two persons are equally good."""
    tied = broadcast_if_small(checkpoint(judged.where("role = 'tie'").select("profile_id").distinct()))
    return judged.where("role in ('best', 'same')").join(tied, "profile_id", "left_anti")


def match_ties(people: DataFrame, companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile_id, persons): profiles that are left unmatched because another person's row is as good as the best."""
    judged = judge_pairs(people, companies, profiles)[1]
    return judged.where("role in ('best', 'tie')").groupBy("profile_id").agg(F.count(F.lit(1)).alias("persons")).where("persons > 1")


def match_profiles(people: DataFrame, companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, profile_id, confidence): every row of people with the profiles of the same person at the same company."""
    rows, judged = judge_pairs(people, companies, profiles)
    winners = _winners(judged)
    stated = winners.select("profile_id", "node", calibrated(F.col("rest"), judged.where("known")).alias("confidence"))
    return rows.join(stated, "node").select("id", "profile_id", "confidence")


def calibrated(cosine: Column, settled: DataFrame, bins: int = 50, sure_from: float = 0.95) -> Column:
    """Confidence of a cosine: the share of ``settled`` pairs (rest, sure) around it that are right, made monotone.

    Settled pairs have a profile address on both sides; whether it is the same one takes no part in the cosine. A right pair
    may still show two addresses (an old one, one of two), so equal addresses mark only some of the right pairs: the share of
    them at a cosine is set against the share among the pairs that nothing speaks against (cosine ``sure_from`` and above).
    """
    at = lambda c: F.least(F.floor(F.greatest(c, F.lit(0.0)) * bins).cast("int"), F.lit(bins - 1))
    counts = {r["bin"]: (r["n"], r["sure"]) for r in settled.groupBy(at(F.col("rest")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sure").cast("int")).alias("sure")).collect()}
    top = [counts[b] for b in counts if b >= int(sure_from * bins)] or list(counts.values())
    marked = (sum(s for _, s in top) + 1) / (sum(n for n, _ in top) + 2)
    blocks: list[list[float]] = []
    for b in range(bins):
        n, sure = counts.get(b, (0, 0))
        # One pair's weight of the share of marked ones, so that bins without pairs follow their neighbours.
        blocks.append([n + 1.0, sure + marked, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] > blocks[-1][1] / blocks[-1][0]:
            n2, s2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + s2, blocks[-1][2] + k2]
    steps = [min(1.0, s / n / marked) for n, s, k in blocks for _ in range(int(k))]
    return F.element_at(F.array(*[F.lit(round(x, 6)) for x in steps]), at(cosine) + 1)


def find_matches(people: DataFrame, companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, profile_id): the pairs of ``match_profiles``."""
    rows, judged = judge_pairs(people, companies, profiles)
    return rows.join(_winners(judged).select("profile_id", "node"), "node").select("id", "profile_id")


__all__ = ["find_matches", "match_profiles", "match_ties"]
