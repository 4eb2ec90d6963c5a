"""Reading the fields of a person's record: name parts, identifiers and the spelling that other fields suggest.

All functions take text as found and give plain values; nulls, blanks and very long values give empty parts.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from millrace.llm.survivor import FILLER_WORDS, SHARED_MAILBOXES, STOCK_IMAGE

# What stands before and after names, and short forms of given names.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame lord lady hon rev".split())
SUFFIXES = frozenset("phd mba cfa fca hons jr sr ii iii iv md esq jd llm llb bsc msc cpa aca acca ceng obe cbe mbe".split())
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex sandy xander", "alexandra": "alex sandra lexi", "albert": "bert al", "andrew": "andy drew", "angela": "angie", "anthony": "tony", "antonia": "toni", "arthur": "art", "barbara": "barb babs", "beatrice": "bea", "benjamin": "ben", "bernard": "bernie",
    "bettina": "bet tina", "brenda": "bren", "caroline": "caro carrie", "catherine": "cathy kate", "cecilia": "cec cece", "charles": "charlie chuck", "christine": "chris tina", "christopher": "chris kit", "daniel": "dan danny", "daniela": "dani", "deborah": "deb debbie", "dennis": "den", "dorothy": "dot dolly",
    "edward": "ed eddie ted", "elizabeth": "betty beth liz lisa", "emilia": "emmy", "esther": "est", "florence": "flo", "francis": "frank", "frederick": "fred freddie", "gabriel": "gabe", "gabriela": "gabi gab", "gerald": "gerry", "gregory": "greg", "harold": "hal harry", "helen": "nell", "henrietta": "hettie etta", "henry": "hank harry",
    "isaac": "ike", "isabel": "izzy bella", "jacob": "jake", "james": "jim jimmy", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "josie jo", "julia": "jules", "katharina": "kat kathi", "kenneth": "ken", "kristin": "kris", "lawrence": "larry laurie", "leonard": "len leo",
    "louis": "lou", "louise": "lou", "lucas": "luke", "margaret": "maggie meg peggy", "martha": "marty", "martin": "marty", "matthew": "matt", "maurice": "mo", "michael": "mike mick", "michelle": "shelly", "nathaniel": "nate nat", "natalia": "nat tasha", "nicholas": "nick nicky nico", "nicole": "nikki", "oliver": "ollie",
    "olivia": "livvy liv", "pamela": "pam", "patricia": "pat trish patty", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rachel": "rach", "rafael": "rafa", "astrid": "asti", "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich", "robert": "bob bobby rob", "roger": "rodge", "rosalind": "ros", "samantha": "sam", "samuel": "sam sammy",
    "sandra": "sandy", "sarah": "sally", "stefan": "stef", "stefanie": "steffi", "stephen": "steve", "susan": "sue suzy", "terence": "terry ter", "theodore": "ted theo", "theresa": "terri tess", "thomas": "tom tommy", "timothy": "tim", "ulrich": "uli", "ursula": "ulla", "valentina": "val", "valerie": "val", "victor": "vic",
    "victoria": "vic vicky tori", "vincent": "vince", "walter": "walt", "wendy": "wen", "william": "bill will billy", "winifred": "winnie", "zachary": "zach zack",
}
#: Short form -> the given names it may stand for.
FULL_FORMS: dict[str, tuple[str, ...]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        FULL_FORMS[_s] = (*FULL_FORMS.get(_s, ()), _full)

_SPECIAL = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "œ": "oe", "ı": "i"})
_LETTERS = re.compile(r"[a-z]+")
_CAPITALISED = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÞŠŽŁŚŻŹČĆĐ][^\W\d_]*(?:[’'-][^\W\d_]+)*")
_LINE = re.compile(r"\s*\+?[\d\s().-]+$")
_SWITCHBOARD = re.compile(r"\s0\s*$|[-.\s]$")
_NO_DIGIT = re.compile(r"\D+")
_SLUG = re.compile(r"/([^/?#]+)/?(?:[?#].*)?$")


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """Lower case letters without accents."""
    low = text.lower().translate(_SPECIAL)
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def edits(a: str, b: str, limit: int) -> int:
    """Edit distance with swaps of neighbours; ``limit`` + 1 when it is above ``limit``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), limit + 1)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > limit:
            return limit + 1
        before, row = row, now
    return min(row[-1], limit + 1)


def close(a: str, b: str) -> bool:
    """Whether two name words may be one word with slips of the keys."""
    longest = max(len(a), len(b))
    return a == b or longest >= 3 and edits(a, b, 1 if longest < 5 else 2) <= (1 if longest < 5 else 2)


_PASTED = re.compile(r"(\bPh\.?D\.?|\b[JS]r\.?|\bM\.?B\.?A\.?|\bC\.?F\.?A\.?|\bF\.?C\.?A\.?|LL\.?M\.?|J\.D\.|\))(?=[A-ZÀ-Þ][^\W\d_A-Z]).*$")
_DEGREE = re.compile(r"\b(?:J\.\s?D\.?|LL\.\s?[MB]\.?|Ph\.?\s?D\.?)(?=\W|$|[A-Z])", re.I)
_MEET = re.compile(r"(?<=[a-zß-ÿ.)])\s*Meet\s+\S+.*$")
_MEET_LOW = re.compile(r"(?<=\w)meet\s+\S+\s*$")
_GLUE = re.compile(r"(?<=[a-zß-ÿ)])(?=[A-ZÀ-Þ])")
_PREFIX = re.compile(r"\b(?:Mc|Mac|De|Di|Le|La|Van|O)$")
_DEGREE_SIGNS = ("ph", "jr", "sr", "ba", "fa", "ca", "ll", "j.", ")")


def clean_name(name: str, places: tuple[str, ...] = ()) -> str:
    """The name without quotes, invisible marks, degrees and pasted-on text ('NamePlaceMeet Name')."""
    text = name
    if not (text.isascii() and text.isprintable()):
        text = "".join(" " if c.isspace() or unicodedata.category(c) in ("Cf", "Cc", "Zs") else c for c in name)
    low = text.lower()
    if any(d in low for d in _DEGREE_SIGNS):
        # Text pasted on behind a degree, a full stop or a bracket, without a blank.
        text = _DEGREE.sub(" ", _PASTED.sub(r"\1", text))
    if "meet" in low:
        text = _MEET_LOW.sub("", _MEET.sub("", text))
    # A capital right after a small letter begins pasted-on text, unless it is the whole name without its blank.
    glued = _GLUE.search(text)
    if glued and glued.start() > 3 and not _PREFIX.search(text[: glued.start()]):
        text = text[: glued.start()] + (" " if " " not in text[: glued.start()].strip() else " \u0000") + text[glued.start() :]
        text = text.split("\u0000")[0]
    if places:
        low = fold(text)
        bare = len(low.rstrip(" .,|*;·-\"'"))
        for place in places:
            at = low.rfind(place)
            if at > 3 and low[at - 1].isalnum() and bare == at + len(place):
                text = text[:at]
                break
    return text


def name_words(text: str) -> list[str]:
    return [w for w in _LETTERS.findall(fold(text)) if w not in TITLES and w not in SUFFIXES]


@lru_cache(maxsize=100_000)
def _near_given(word: str, given_names: frozenset[str]) -> bool:
    """Whether a word may be a given name with slips."""
    return len(word) > 3 and any(g[0] in word[:2] and len(g) > 3 and edits(word, g, 1) <= 1 for g in given_names)


_HYPHEN = re.compile(r"([^\W\d_]+)[-‐]([^\W\d_]+)")


def split_name(name: str | None, places: tuple[str, ...] = (), given_names: frozenset[str] = frozenset()) -> tuple[str, str, str]:
    """(given, middle, surname) of a name as typed, folded; parts that are missing are empty."""
    if not name:
        return "", "", ""
    text = clean_name(name, places)
    if "(" in text:
        text = re.sub(r"\([^()]*\)", " ", text)
    before, comma, after = text.partition(",")
    first, rest = name_words(before), name_words(after)
    hyphen = _HYPHEN.search(before) if "-" in before or "‐" in before else None
    if hyphen:  # a double surname counts by its first part
        second = fold(hyphen[2])
        if second in first and len(first) > 1:
            first.remove(second)
    if comma and first and rest and not (len(first) > 1 and first[0] in given_names and rest[0] not in given_names and len(rest[0]) > 1):
        return rest[0], " ".join(rest[1:]), first[-1]
    words = first + rest
    if not words:
        return "", "", ""
    if len(words) == 1:
        return "", "", words[0]
    known = lambda w: w in given_names or w in FULL_FORMS or w in NICKNAMES
    if len(words[0]) > 2 and not known(words[0]):
        near = lambda w: known(w) or _near_given(w, given_names)
        # Surname first: a given name, an initial or a cut form comes behind it.
        cut_last = lambda: len(words[-1]) <= 4 and f"{words[-1]}." in fold(text) and re.search(rf"\b{words[-1]}\.", fold(text)) is not None
        if len(words) > 2 and near(words[1]) and not near(words[0]):
            return words[1], " ".join(words[2:]), words[0]
        if len(words) == 2 and (known(words[1]) or len(words[1]) == 1 or cut_last()):
            return words[1], "", words[0]
    return words[0], " ".join(words[1:-1]), words[-1]


def given_forms(given: str) -> tuple[str, ...]:
    """The full given names a given name may stand for (itself if it is none's short form)."""
    return FULL_FORMS.get(given, (given,)) if given not in NICKNAMES else (given,)


def slug_of(url: str | None, own: bool = True) -> str:
    """The last path part of a profile address in lower case, empty for pages of companies."""
    if not url:
        return ""
    low = url.strip().lower()
    if "/company/" in low:
        return ""
    m = _SLUG.search(low)
    return m[1] if m else ""


@lru_cache(maxsize=100_000)
def slug_name(slug: str) -> tuple[str, str]:
    """(given, surname) as a slug spells them."""
    parts = [p for p in fold(slug).split("-") if p]
    if len(parts) > 2 and re.search(r"\d", parts[-1]) or len(parts) > 2 and re.fullmatch(r"[0-9a-f]{2,8}", parts[-1]):
        parts = parts[:-1]
    parts = [p for p in parts if p.isalpha()]
    return (parts[0], parts[-1]) if len(parts) >= 2 else ("", parts[0] if parts else "")


def own_mailbox(email: str | None) -> str:
    """The local part of a personal e-mail address, whole or cut after the @; empty for shared boxes and filler."""
    if not email:
        return ""
    low = fold(email.strip())
    local, _, _ = low.partition("@")
    if not re.fullmatch(r"[a-z][a-z0-9._'-]*", local) or local in SHARED_MAILBOXES or low in FILLER_WORDS or local in ("xxx", "none", "tbc", "email") or len(local) < 3:
        return ""
    return local


def mailbox_name(local: str) -> tuple[str, str]:
    """(given or initial, surname) as a mailbox spells them; the surname may start with the initial ('flast')."""
    parts = [p for p in re.split(r"[._]", re.sub(r"\d+", "", local)) if p]
    if len(parts) == 2:
        return (parts[1], parts[0]) if len(parts[1]) == 1 and len(parts[0]) > 1 else (parts[0], parts[1])
    if len(parts) == 1 and len(parts[0]) > 3:
        return parts[0][0], parts[0][1:]
    return "", ""


def name_in_text(text: str | None, given: str, surname: str, given_names: frozenset[str] = frozenset()) -> tuple[str, str]:
    """(given, surname) as a running text spells them, found by nearness to the name as typed."""
    if not text:
        return "", ""
    found_given, before, end = "", "", -9
    for m in _CAPITALISED.finditer(text):
        w = m.group()
        beside = before if m.start() - end <= 3 and not any(c.isalpha() for c in text[end : m.start()]) else ""
        before, end = w, m.end()
        if len(w) < 2:
            continue
        f = fold(w)
        if surname and beside and len(f) >= 3 and close(f, surname):
            g = fold(beside)
            if not given or g[0] == given[0] or close(g, given) or g in given_forms(given) or given in NICKNAMES.get(g, "").split():
                return g, f
        if not found_given and given and (f in NICKNAMES or f in given_names) and (f in given_forms(given) or given in NICKNAMES.get(f, "").split() or (f.startswith(given) if len(given) <= 4 else close(f, given))):
            found_given = f
    return found_given, ""


@lru_cache(maxsize=100_000)
def _places(location: str) -> tuple[str, ...]:
    return tuple(p for p in (fold(x).strip() for x in re.split(r"[,(]", location)) if len(p) > 2)


_SIZE = re.compile(r"[@_-](?:\d+x(?:\d+)?|small|large|thumb|crop|square|web|\d)$")
_STOCK = re.compile(STOCK_IMAGE)


def own_line(phone: str | None) -> str:
    """The digits of a personal telephone line without the marks of a foreign call; empty for masked, cut and office lines."""
    if not phone or not _LINE.match(phone) or _SWITCHBOARD.search(phone):
        return ""
    digits = _NO_DIGIT.sub("", phone).lstrip("0")
    return digits if len(digits) >= 9 and len(set(digits)) > 2 else ""


def own_portrait(image: str | None) -> str:
    """The file of a portrait without its ending and size; empty for stock pictures."""
    if not image or "/" not in image or _STOCK.search(image):
        return ""
    stem = image.strip().split("?")[0].rstrip("/").lower().rpartition("/")[2].rpartition(".")[0]
    return _SIZE.sub("", stem) if len(stem) > 3 else ""


def _fits(g: str, given: str) -> bool:
    """Whether ``g`` may be the given name as typed: equal up to slips, a short form of it or its other way round, or what an initial or a cut form begins."""
    return not given or g[0] == given[0] and len(given) == 1 or close(g, given) or g in given_forms(given) or given in NICKNAMES.get(g, "").split() or len(given) == 3 and g.startswith(given)


def read_person(name: str | None, email: str | None, phone: str | None, image: str | None, profile_url: str | None, twitter_url: str | None, linkedin_url: str | None, bio: str | None, location: str | None, given_names: frozenset[str] = frozenset()) -> dict[str, str]:
    """Name parts as best known from all fields, and the identifiers of the record.

    ``given`` and ``surname`` are taken from the own page, the other addresses, the text or the mailbox where these agree
    with the name as typed up to slips; ``hinted`` tells that they were. The text is read only where the addresses leave a
    part open.
    """
    given, middle, surname = split_name(name, _places(location) if location else (), given_names)
    slugs = [slug_of(u) if u else "" for u in (profile_url, twitter_url, linkedin_url)]
    mailbox = own_mailbox(email) if email else ""
    network = slugs[2]
    best_given, best_surname = "", ""
    typed_given, typed_surname = given, surname
    for source in range(5):
        if best_given and best_surname:
            break
        if source < 3:
            if not slugs[source]:
                continue
            g, s = slug_name(slugs[source])
        elif source == 3:
            g, s = name_in_text(bio, typed_given, typed_surname, given_names) if bio else ("", "")
        else:
            g, s = mailbox_name(mailbox) if mailbox else ("", "")
        if s and not best_surname and (close(s, surname) or given and close(s, given)):
            # The name as typed may have its parts the other way round.
            best_surname = s
            if not close(s, surname):
                given, surname = surname, given
        if len(g) > 1 and not best_given and (not s or best_surname and close(s, best_surname)) and _fits(g, given):
            best_given = g
    if network and (other := slug_name(network)[1]) and not close(other, best_surname or surname):
        network = ""  # somebody else's address
    forms = given_forms(given)
    return {"given": best_given or (forms[0] if len(forms) == 1 else given), "surname": best_surname or surname, "hinted": "y" if best_given and best_surname else "", "page": slugs[0] or slugs[1], "network": network, "mailbox": mailbox, "line": own_line(phone), "portrait": own_portrait(image)}
