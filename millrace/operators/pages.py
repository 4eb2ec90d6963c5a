"""Operators over already-fetched pages: anchors, link scoring, category indexes, page addresses, simplification, salvage.

HTML is parsed with the standard library inside Arrow batches; scoring and choice are column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.session import checkpoint

# Link texts and paths that lead to people, with points; words that never do.
LINK_TEXTS = (("our team", 5), ("meet the team", 5), ("meet our team", 5), ("our people", 5), ("the team", 4), ("leadership team", 4), ("management team", 4), ("team members", 4), ("team", 3), ("people", 3), ("our staff", 4), ("staff", 3), ("leadership", 3), ("management", 3), ("executives", 3), ("board", 2), ("faculty", 3), ("experts", 3), ("partners", 2), ("advisors", 3), ("who we are", 3), ("about us", 1))
LINK_PATHS = (("/our-team", 4), ("/our-people", 4), ("/meet-the-team", 4), ("/the-team", 4), ("/team", 3), ("/people", 3), ("/staff", 3), ("/leadership", 3), ("/management", 3), ("/management-team", 3), ("/executives", 3), ("/exec-team", 3), ("/faculty", 3), ("/experts", 3), ("/advisors", 3), ("/who-we-are", 3), ("/about/team", 4), ("/about/people", 4), ("/about/leadership", 4), ("/about/staff", 4), ("/about/management", 3))
BLOCKED_SEGMENTS = (
    "careers", "jobs", "news", "blog", "press", "contact", "login", "signup", "register", "privacy", "terms", "sitemap", "faq", "search", "events", "resources", "services", "product", "pricing",
    "story", "stories", "testimonial", "case-study", "case-studies", "demo", "book-a-demo", "talk-to", "meet-with", "spotlight", "capabilities", "capability", "insights", "insight", "industries", "industry", "solutions", "solution", "sectors", "sector", "work",
    "who-we-are", "our-story", "our-mission", "our-values", "about-us", "our-purpose", "our-history", "our-culture",
)
BLOCKED_TEXTS = ("talk to sales", "book a demo", "contact us", "our story", "customer stories", "meet john", "talk to an expert", "schedule a call", "get in touch", "request a demo")
LEAST_SCORE = 3
LEAST_PAGE = 5000


class _Anchors(HTMLParser):
    """Collects links with their text and the landmark they stand in."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.links: list[list[str]] = []
        self.current: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("nav", "header", "footer"):
            self.open.append(tag)
        if tag == "a":
            a = dict(attrs)
            self.current = [a.get("href") or "", "", self.open[-1] if self.open else "", a.get("rel") or ""]
            self.links.append(self.current)

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        if tag == "a":
            self.current = None

    def handle_data(self, data):
        if self.current is not None:
            self.current[1] += data


def anchors_of(html: str | None) -> list[tuple[str, str, str, str]]:
    parser = _Anchors()
    parser.feed(html or "")
    return [(h, " ".join(t.split()), c, r) for h, t, c, r in parser.links]


def extract_anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, text, context): one row per link of (page_id, url, html), addresses made absolute."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, u, i, urljoin(u or "", h), t, c) for p, u, html in f.itertuples(index=False, name=None) for i, (h, t, c, _) in enumerate(anchors_of(html))]
            yield pd.DataFrame(rows, columns=["page_id", "url", "pos", "href", "text", "context"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, pos int, href string, text string, context string")


def _first_points(value: Column, table: tuple[tuple[str, int], ...], contains) -> Column:
    out = F.lit(0)
    for word, points in reversed(table):
        out = F.when(contains(value, word), points).otherwise(out)
    return out


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def score_links(links: DataFrame) -> DataFrame:
    """Adds ``score``: text and path points (first fit each) and the landmark; 0 for other hosts, blocked words, no pages."""
    text, path = F.lower(F.trim("text")), path_of(F.col("href"))
    blocked = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(b) for b in BLOCKED_SEGMENTS])) | reduce(Column.__or__, [text.contains(b) for b in BLOCKED_TEXTS])
    usable = (host_of(F.col("href")) == host_of(F.col("url"))) & ~F.lower("href").rlike(r"^(?:javascript|mailto|tel):|^#")
    base = _first_points(text, LINK_TEXTS, lambda v, w: v.contains(w)) + _first_points(path, LINK_PATHS, lambda v, w: v.startswith(w) | v.contains(f"{w}/"))
    bonus = F.when(F.col("context").isin("nav", "header"), 2).when(F.col("context") == "footer", 1).otherwise(0)
    return links.withColumn("score", F.when(usable & ~blocked, base + bonus).otherwise(0))


def best_links(links: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """The best link of each page from ``least`` points on; of equal scores the first."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return score_links(links).where(F.col("score") >= least).withColumn("r", rank).where("r = 1").drop("r")


def category_indexes(links: DataFrame, least: int = 2) -> DataFrame:
    """Pages whose links lead exactly one level deeper, ``least`` times or more."""
    here, there = F.regexp_replace(path_of(F.col("url")), "/+$", ""), F.regexp_replace(path_of(F.col("href")), "/+$", "")
    deeper = there.startswith(F.concat(here, F.lit("/"))) & (F.size(F.split(there, "/")) == F.size(F.split(here, "/")) + 1)
    same = host_of(F.col("href")) == host_of(F.col("url"))
    return links.where(deeper & same).select("page_id", "href").distinct().groupBy("page_id").agg(F.array_sort(F.collect_list("href")).alias("children")).where(F.size("children") >= least)


def page_addresses(sites: DataFrame) -> DataFrame:
    """Addresses of numbered pages of (url, strategy, param, start, step, pages): by query parameter or path segment."""
    numbers = F.sequence(F.col("start"), F.col("start") + (F.col("pages") - 1) * F.col("step"), F.col("step"))
    numbered = sites.where("pages > 0").select("url", "strategy", "param", F.explode(numbers).alias("n"))
    bare = F.regexp_replace("url", r"[/?#]+$", "")
    query = F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), "param", F.lit("="), F.col("n").cast("string"))
    segment = F.concat(bare, F.lit("/"), "param", F.lit("/"), F.col("n").cast("string"))
    return numbered.select("url", "n", F.when(F.col("strategy") == "query_param", query).otherwise(segment).alias("page_url"))


def follow_next(pages: DataFrame, first: DataFrame) -> DataFrame:
    """(url, hop): pages reached by next links (url, next_url) from the first ones, however long the chains; seen pages stop a chain.

    Links double: round k follows links that span 2^k pages and then joins them with themselves, so a chain of n pages takes
    log2(n) rounds. A round that reaches nothing new shows that the set is closed (cycles included).
    """
    links = checkpoint(pages.where("next_url is not null").groupBy("url").agg(F.min("next_url").alias("ahead")).withColumn("far", F.lit(1)))
    reached, size = checkpoint(first.select("url").distinct().withColumn("hop", F.lit(0))), -1
    while (grown := reached.count()) > size:
        size = grown
        step = reached.join(links, "url").select(F.col("ahead").alias("url"), (F.col("hop") + F.col("far")).alias("hop"))
        reached = checkpoint(reached.unionByName(step).groupBy("url").agg(F.min("hop").alias("hop")))
        on = links.select(F.col("url").alias("ahead"), F.col("ahead").alias("next"), F.col("far").alias("more"))
        links = checkpoint(links.join(on, "ahead").select("url", F.col("next").alias("ahead"), (F.col("far") + F.col("more")).alias("far")))
    return reached


def fingerprint_stop(pages: DataFrame) -> DataFrame:
    """Pages of (site, n, names) before the first one whose set of names was seen already."""
    mark = F.sha2(F.array_join(F.array_sort(F.array_distinct("names")), "\u0001"), 256)
    seen = F.row_number().over(Window.partitionBy("site", "mark").orderBy("n"))
    marked = pages.withColumn("mark", mark).withColumn("again", seen > 1)
    stop = F.min(F.when(F.col("again"), F.col("n"))).over(Window.partitionBy("site"))
    return marked.withColumn("stop", stop).where("stop is null or n < stop").drop("mark", "again", "stop")


def empty_run_stop(pages: DataFrame, most: int = 2) -> DataFrame:
    """Pages of (site, n, found) up to the end of the first run of ``most`` pages without records."""
    by_site = Window.partitionBy("site").orderBy("n")
    island = F.sum((F.col("found") > 0).cast("int")).over(by_site)
    runs = pages.withColumn("island", island).withColumn("empty", F.sum((F.col("found") == 0).cast("int")).over(Window.partitionBy("site", "island").orderBy("n")))
    stop = F.min(F.when(F.col("empty") >= most, F.col("n"))).over(Window.partitionBy("site"))
    return runs.withColumn("stop", stop).where("stop is null or n <= stop").drop("island", "empty", "stop")


def adaptive_empty_stop(pages: DataFrame, least: int = 1, most: int = 5, good: float = 0.8, after: int = 5) -> DataFrame:
    """As ``empty_run_stop``, but a site that gave records on more than ``good`` of its pages so far, over more than ``after``
    pages, may have ``most`` empty pages in a row instead of ``least`` before it ends."""
    by_site = Window.partitionBy("site").orderBy("n")
    so_far = pages.withColumn("seen", F.row_number().over(by_site)).withColumn("full", F.sum((F.col("found") > 0).cast("int")).over(by_site))
    # Pages up to the last full one share its count, so a run of empty pages is what follows within a count.
    runs = so_far.withColumn("empty", F.sum((F.col("found") == 0).cast("int")).over(Window.partitionBy("site", "full").orderBy("n")))
    # The share counts up to the run's beginning, so that the run itself doesn't spoil it.
    before = F.col("seen") - F.col("empty")
    allowed = F.when((before > after) & (F.col("full") > good * before), most).otherwise(least)
    stop = F.min(F.when((F.col("empty") > 0) & (F.col("empty") >= allowed), F.col("n"))).over(Window.partitionBy("site"))
    return runs.withColumn("stop", stop).where("stop is null or n <= stop").drop("seen", "full", "empty", "stop")


def short_pages(pages: DataFrame, least: int = LEAST_PAGE) -> DataFrame:
    return pages.where(F.length("html") < least)


#: Signs of a page that holds a challenge instead of content.
CHALLENGE = r"checking your browser|verify you are human|access denied|attention required|captcha|enable javascript and cookies|ray id"


def challenge_flag(html: Column) -> Column:
    """Whether the page looks like a challenge (a quality flag); the whole page counts."""
    return F.lower(html).rlike(CHALLENGE)


def simplify_html(html: Column, budget: int | None = None) -> Column:
    """Markup without scripts, styles, media, landmarks and attributes other than addresses; whole unless a reader has a budget."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|video|audio|header|nav|footer)\b[^>]*+>.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r'(?i)\s(?!(?:href|src)\s*=)[a-z-]+\s*=\s*(?:"[^"]*"|\'[^\']*\')', "")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return c if budget is None else F.left(c, F.lit(budget))


def embedded_json(html: Column, least: int = 3, budget: int | None = None) -> Column:
    """The embedded JSON text with the most person-like keys (at least ``least``), else null; whole unless a reader has a budget."""
    texts = F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*(?:application/json|__NEXT_DATA__|__NUXT_DATA__)[^>]*>(.*?)</script>'), F.lit(1))
    scored = F.transform(texts, lambda t: F.struct(F.regexp_count(t, F.lit(r'"(?:name|title|email|bio|role|firstName|lastName|jobTitle|image|photo)"')).alias("score"), t.alias("t")))
    best = F.array_max(scored)
    return F.when(best["score"] >= least, best["t"] if budget is None else F.left(best["t"], F.lit(budget)))


def dereference(value, top: list, depth: int = 15):
    """A value whose numbers are indices into the top-level list, resolved up to a depth."""
    if depth == 0:
        return None
    if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < len(top):
        target = top[value]
        return target if not isinstance(target, (dict, list)) else dereference(target, top, depth - 1)
    if isinstance(value, dict):
        return {k: dereference(v, top, depth - 1) for k, v in value.items()}
    if isinstance(value, list):
        return [dereference(v, top, depth - 1) for v in value]
    return value


@F.pandas_udf(StringType())
def dereference_json(texts: pd.Series) -> pd.Series:
    """JSON text of an indexed array with its references resolved from the first element; null if it is no such array."""

    def one(text):
        try:
            top = json.loads(text)
        except (TypeError, ValueError):
            return None
        return json.dumps(dereference(top[0], top), ensure_ascii=False, sort_keys=True) if isinstance(top, list) and top else None

    return texts.map(one)


def rel_next(html: Column, first: int = 3) -> Column:
    """Addresses of the first links marked as leading to the next page."""
    tags = F.regexp_extract_all(html, F.lit(r'(?is)<(?:a|link)\b(?=[^>]*\brel\s*=\s*["\']?[^"\'>]*\bnext\b)[^>]*>'), F.lit(0))
    hrefs = F.transform(tags, lambda t: F.regexp_extract(t, r'(?i)\bhref\s*=\s*["\']([^"\']*)["\']', 1))
    return F.slice(F.filter(hrefs, lambda h: h != ""), 1, first)


#: What a link to the next page says.
NEXT_TEXTS = ("next", "next page", ">", ">>", "next >>", "next >")


def next_links(pages: DataFrame) -> DataFrame:
    """(page_id, next_url): the link to the next page, by its mark, then its class, id or label, then its text; null if none."""

    def rank_of(tag: dict, inside: list[tuple[str, set[str]]], text: str) -> int | None:
        classes = set((tag.get("class") or "").split())
        if "next" in (tag.get("rel") or "").lower().split():
            return 0
        for k, hit in enumerate(("next" in classes, "next-page" in classes, tag.get("id") == "next", tag.get("aria-label") == "Next", any(t == "li" and "next" in c for t, c in inside)), 1):
            if hit:
                return k
        return 7 if text.lower() in NEXT_TEXTS else None

    @F.pandas_udf("string")
    def find(urls: pd.Series, htmls: pd.Series) -> pd.Series:
        out = []
        for url, html in zip(urls, htmls):
            best = None
            for k, (tag, inside, text) in enumerate(_links_in_place(html)):
                if (tag.get("href") or "") in ("", "#", "javascript:void(0)"):
                    continue
                r = rank_of(tag, inside, text)
                if r is not None and (best is None or (r, k) < best[0]):
                    best = ((r, k), urljoin(url or "", tag["href"]))
            out.append(best[1] if best else None)
        return pd.Series(out, dtype=object)

    return pages.select("page_id", find("url", "html").alias("next_url"))


class _Tree(HTMLParser):
    """A small element tree: [tag, attributes, children, text before each child]."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__()
        self.root: list = ["", {}, []]
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.path[-1][2].append(node)
        if tag not in self.VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        for k in range(len(self.path) - 1, 0, -1):
            if self.path[k][0] == tag:
                del self.path[k:]
                return

    def handle_data(self, data):
        self.path[-1][2].append(data)


def parse_tree(html: str | None) -> list:
    parser = _Tree()
    parser.feed(html or "")
    return parser.root


def _walk(node: list, inside: tuple = ()):
    """Every element with the elements around it, in order."""
    stack = [(node, inside)]
    while stack:
        at, around = stack.pop()
        yield at, around
        stack += [(c, (*around, at)) for c in reversed(at[2]) if not isinstance(c, str)]


def text_of(node: list) -> str:
    """The text of an element, blanks as one."""
    parts: list[str] = []
    stack: list = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            parts.append(at)
        else:
            stack += reversed(at[2])
    return " ".join(" ".join(parts).split())


def _links_in_place(html: str | None):
    for node, around in _walk(parse_tree(html)):
        if node[0] == "a":
            yield node[1], [(a[0], set((a[1].get("class") or "").split())) for a in around], text_of(node)


def collapse_tree(root: list, keep: int = 3) -> int:
    """Of the children of one element that share tag and classes only the first ``keep`` stay; the number taken out.

    One pass from the top gives the fixed point: what is taken out is never looked at again.
    """
    removed, stack = 0, [root]
    while stack:
        node = stack.pop()
        seen: dict[tuple, int] = {}
        kept = []
        for child in node[2]:
            if not isinstance(child, str):
                kind = (child[0], tuple(sorted((child[1].get("class") or "").split())))
                seen[kind] = seen.get(kind, 0) + 1
                if seen[kind] > keep:
                    removed += 1
                    continue
                stack.append(child)
            kept.append(child)
        node[2] = kept
    return removed


def render_tree(root: list) -> str:
    """Markup of a tree."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        tag, attrs, children = node
        if tag:
            out.append("<" + tag + "".join(f' {k}="{escape(v)}"' if v is not None else f" {k}" for k, v in attrs.items()) + ">")
            if tag not in _Tree.VOID:
                stack.append(f"</{tag}>")
        stack += reversed(children)
    return "".join(out)


def collapse_repeats(pages: DataFrame, keep: int = 3) -> DataFrame:
    """(page_id, html, removed): pages without all but the first ``keep`` of repeated sibling elements."""

    @F.pandas_udf("html string, removed int")
    def run(htmls: pd.Series) -> pd.DataFrame:
        rows = []
        for html in htmls:
            root = parse_tree(html)
            removed = collapse_tree(root, keep)
            rows.append((render_tree(root), removed))
        return pd.DataFrame(rows, columns=["html", "removed"])

    return pages.select("page_id", run("html").alias("x")).select("page_id", "x.html", "x.removed")


# Classes of the text in a card's dialog, and the least length of a biography.
BIO_CLASSES = frozenset("about-self bio description detail person-bio member-bio team-bio text-content".split())
LEAST_BIO = 80


def modal_bios(pages: DataFrame) -> DataFrame:
    """(page_id, modal_id, pos, bio): biographies in the dialogs of a page (``div.modal`` with an id)."""

    def bio_of(modal: list) -> str:
        classes = lambda n: set((n[1].get("class") or "").split())
        nodes = [n for n, _ in _walk(modal)]
        own = next((n for n in nodes if n[0] and (classes(n) & BIO_CLASSES)), None) or next((n for n, a in _walk(modal) if "content" in classes(n) and any("modal-body" in classes(x) for x in a)), None)
        body = own or next((n for n in nodes if n[0] and "modal-body" in classes(n)), None)
        if body is None:
            return ""
        paragraphs = [t for n, _ in _walk(body) if n[0] == "p" and (t := text_of(n))]
        return "\n\n".join(paragraphs) or (text_of(body) if own else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page, html in f.itertuples(index=False, name=None):
                modals = [n for n, _ in _walk(parse_tree(html)) if n[0] == "div" and n[1].get("id") and "modal" in (n[1].get("class") or "").split()]
                rows += [(page, m[1]["id"], k, bio) for k, m in enumerate(modals) if len(bio := bio_of(m)) >= LEAST_BIO]
            yield pd.DataFrame(rows, columns=["page_id", "modal_id", "pos", "bio"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, modal_id string, pos int, bio string")


def match_modals(people: DataFrame, bios: DataFrame) -> DataFrame:
    """(id, page_id, modal_id, bio): dialogs given to the people (id, page_id, pos, name, bio) of a page that lack a biography.

    In page order each person takes the first free dialog that holds the full name, else the last name of three letters or
    more, else the first name. A page is one group: it holds as many dialogs as one page can.
    """

    def give(key, persons: pd.DataFrame, modals: pd.DataFrame) -> pd.DataFrame:
        free = [(m, b, b.lower()) for m, b in modals.sort_values("pos")[["modal_id", "bio"]].itertuples(index=False, name=None)]
        rows = []
        for id_, name, bio in persons.sort_values(["pos", "id"])[["id", "name", "bio"]].itertuples(index=False, name=None):
            parts = (name or "").lower().split()
            if not parts or len(bio or "") >= LEAST_BIO:
                continue
            wanted = [name.lower(), *([parts[-1]] if len(parts) > 1 and len(parts[-1]) >= 3 else []), parts[0]]
            hit = next((k for w in wanted for k, (_, _, low) in enumerate(free) if w in low), None)
            if hit is not None:
                m, b, _ = free.pop(hit)
                rows.append((id_, key[0], m, b))
        return pd.DataFrame(rows, columns=["id", "page_id", "modal_id", "bio"])

    return people.groupBy("page_id").cogroup(bios.groupBy("page_id")).applyInPandas(give, "id long, page_id long, modal_id string, bio string")


def modal_site_share(people: DataFrame, site: str, least: float = 0.1) -> DataFrame:
    """Per site the share of people with a biography of 80 characters or more from the list page, and whether it is a dialog site."""
    long_bio = F.length(F.coalesce("bio", F.lit(""))) >= LEAST_BIO
    own = long_bio & ~F.coalesce(F.col("profile_enriched"), F.lit(False))
    counts = people.groupBy(site).agg(F.count(F.lit(1)).alias("people"), F.count(F.when(own, 1)).alias("with_bio"))
    return counts.withColumn("modal_site", (F.col("with_bio") > 0) & (F.col("with_bio") >= F.col("people") * least))


def discover_pages(links: DataFrame, fallback: Column | None = None) -> DataFrame:
    """(page_id, href, how): the people page of each start page: the best link, refined once by the best link of that page
    (``links`` holds the links of both, by url), else what the fallback column gives."""
    starts = best_links(links).select("page_id", F.col("url").alias("start"), "href")
    inner = best_links(links.withColumn("page_id", F.xxhash64("url"))).select(F.col("url").alias("href"), F.col("href").alias("deeper"))
    found = starts.join(inner, "href", "left").select("page_id", F.coalesce("deeper", "href").alias("href"), F.when(F.col("deeper").isNotNull(), "refined").otherwise("link").alias("how"))
    if fallback is None:
        return found
    pages = links.select("page_id", fallback.alias("given")).distinct()
    rest = pages.join(found, "page_id", "left_anti").where("given is not null").select("page_id", F.col("given").alias("href"), F.lit("fallback").alias("how"))
    return found.unionByName(rest)


def keyword_score(text: Column, keywords: tuple[str, ...]) -> Column:
    """How often quoted keywords stand in a text."""
    return reduce(Column.__add__, [F.regexp_count(text, F.lit(f'"{re.escape(k)}"')) for k in keywords], F.lit(0))


def code_and_meta(answer: Column) -> Column:
    """struct<code, meta>: the fenced code and the JSON notes of an answer; the code is text and is never run."""
    return F.struct(
        F.nullif(F.trim(F.regexp_extract(answer, r"(?s)```(?:python)?\s*\n(.*?)\s*```", 1)), F.lit("")).alias("code"),
        F.nullif(F.trim(F.regexp_extract(answer, r"(?s)```json\s*\n(.*?)\s*```", 1)), F.lit("")).alias("meta"),
    )


def json_objects(text: str | None) -> list[str]:
    """Complete top-level objects of a JSON text that may be fenced, cut off or followed by prose."""
    if not text:
        return []
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    decoder, out, at = json.JSONDecoder(), [], 0
    while (at := body.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(body, at)
        except ValueError:
            at += 1
            continue
        out.append(json.dumps(value, ensure_ascii=False, sort_keys=True))
        at = end
    return out


def salvage_objects(answers: DataFrame, column: str = "answer") -> DataFrame:
    """(id, pos, object): every complete object of each answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, o) for i, t in f.itertuples(index=False, name=None) for k, o in enumerate(json_objects(t))]
            yield pd.DataFrame(rows, columns=["id", "pos", "object"])

    return answers.select("id", column).mapInPandas(run, "id long, pos int, object string")


def same_site(a: str, b: str) -> bool:
    return urlsplit(a).netloc.removeprefix("www.") == urlsplit(b).netloc.removeprefix("www.")


# Names of parameters and path segments that number pages; those that count entries step by more than one.
PAGE_PARAMS = ("page", "p", "start", "offset")


def detect_pagination(links: DataFrame) -> DataFrame:
    """(page_id, strategy, param, start, step): how the pages of a list are numbered, from its links (page_id, url, href).

    A numbered parameter wins over a numbered path segment, that over a cursor, that over a next link. The step is the
    smallest gap between the numbers; a parameter starts at its smallest number, or one step before it if that is above 1; a
    segment starts with the second page.
    """
    names = "|".join(PAGE_PARAMS)
    found = links.where(host_of(F.col("href")) == host_of(F.col("url"))).select(
        "page_id",
        F.regexp_extract("href", rf"[?&]({names})=(\d+)", 1).alias("q"), F.regexp_extract("href", rf"[?&](?:{names})=(\d+)", 1).try_cast("int").alias("qn"),
        F.regexp_extract("href", rf"/({names})/(\d+)", 1).alias("s"), F.regexp_extract("href", rf"/(?:{names})/(\d+)", 1).try_cast("int").alias("sn"),
        F.col("href").rlike(r"[?&]cursor=").alias("cursor"), F.lower(F.trim("text")).isin(*NEXT_TEXTS, "load more").alias("next"),
    )
    numbered = found.select("page_id", F.inline(F.array(F.struct(F.lit("query_param").alias("strategy"), F.col("q").alias("param"), F.col("qn").alias("n")), F.struct(F.lit("path_segment").alias("strategy"), F.col("s").alias("param"), F.col("sn").alias("n"))))).where("n is not null").distinct()
    gap = F.col("n") - F.lag("n").over(Window.partitionBy("page_id", "strategy", "param").orderBy("n"))
    by_param = numbered.withColumn("gap", gap).groupBy("page_id", "strategy", "param").agg(F.min("n").alias("low"), F.min("gap").alias("gap"), F.count(F.lit(1)).alias("k"))
    step = F.coalesce("gap", F.when(F.col("param").isin("start", "offset"), F.col("low")).otherwise(F.lit(1)))
    rank = F.struct((F.col("strategy") == "query_param").cast("int").alias("a"), F.col("k").alias("b"), F.col("param").alias("c"))
    best = by_param.groupBy("page_id").agg(F.max_by(F.struct("strategy", "param", "low", step.alias("step")), rank).alias("x"))
    rest = found.groupBy("page_id").agg(F.max("cursor").alias("cursor"), F.max("next").alias("next"))
    start = F.when((F.col("x.strategy") == "query_param") & (F.col("x.low") >= 2), F.greatest(F.col("x.low") - F.col("x.step"), F.lit(0))).otherwise(F.col("x.low"))
    other = F.when(F.col("cursor"), "cursor").when(F.col("next"), "next_link").otherwise("none")
    return rest.join(best, "page_id", "left").select("page_id", F.coalesce("x.strategy", other).alias("strategy"), "x.param", start.alias("start"), F.col("x.step").alias("step"))


def profile_fields(pages: DataFrame) -> DataFrame:
    """(page_id, name, email, phone, image_url, industries, capabilities, education): fields of single profile pages.

    The name is the first ``h1``; a picture is the last entry of its ``srcset``; tags go by their address; mail and telephone
    come from their links; entries of an education list stand as written.
    """

    def fields(url, html) -> tuple:
        name = email = phone = image = None
        industries, capabilities, education = [], [], []
        for node, around in _walk(parse_tree(html)):
            tag, attrs = node[0], node[1]
            href = attrs.get("href") or ""
            if tag == "h1" and name is None:
                name = text_of(node) or None
            elif tag == "a" and href.startswith("mailto:") and email is None:
                email = href[7:].split("?")[0]
            elif tag == "a" and href.startswith("tel:") and phone is None:
                phone = href[4:]
            elif tag == "a" and "/industries/" in href:
                industries.append(text_of(node))
            elif tag == "a" and "/capabilities/" in href:
                capabilities.append(text_of(node))
            elif tag == "img" and image is None and (attrs.get("srcset") or attrs.get("src")):
                image = urljoin(url or "", (attrs.get("srcset") or attrs["src"]).split(",")[-1].split()[0])
            elif tag == "li" and any("education" in (a[1].get("class") or "") for a in around):
                education.append(text_of(node))
        return name, email, phone, image, industries, capabilities, education

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *fields(u, h)) for p, u, h in f.itertuples(index=False, name=None)], columns=["page_id", "name", "email", "phone", "image_url", "industries", "capabilities", "education"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, name string, email string, phone string, image_url string, industries array<string>, capabilities array<string>, education array<string>")
