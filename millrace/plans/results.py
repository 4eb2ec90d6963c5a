"""Queries of reprocessing, quality pages, exports and classifier answers over the project tables, and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import export, ingest, pages, quality, resolve, results
from millrace.session import table

MODES = ("resume", "reanalyze", "analyze_missing", "reenrich", "reresolve", "backfill", "requalify")
_FIELDS = ("primary_expertise", "sector", "geography", "inferred_expertise_functional", "matched_inferred_expertise_topics")


def _p(s, d):
    return table(s, d, "people")


def _c(s, d):
    return table(s, d, "companies")


def _terms(s, d, kind: str) -> list[tuple[str, str]]:
    """(term, note) of one kind: the reference list is small and doesn't grow."""
    return [(r["term"], r["note"]) for r in table(s, d, "reference_terms").where(F.col("kind") == kind).orderBy("term_id").collect()]


def reset_masks(s, d):
    """Every person as each repetition would leave them."""
    one = lambda m: ingest.plan_retry(_p(s, d), m).select("id", F.lit(m).alias("mode"), *_FIELDS, "linkedin_url", "linkedin_enriched", "next_step")
    return reduce(DataFrame.unionByName, [one(m) for m in MODES])


def _validated(s, d):
    people = _p(s, d).select("id", "primary_expertise", F.col("inferred_expertise_functional").alias("categories"), F.col("matched_inferred_expertise_topics").alias("topics"))
    vocabulary = tuple(x for k in ("expertise", "functional") for x, _ in _terms(s, d, k))
    return quality.validate(people.where("primary_expertise is not null or categories is not null"), vocabulary=vocabulary)


def qa_full_rules(s, d):
    """Every rule over every person: topics stand for the matched sectors, the functional list for what is inferred, sectors for
    what is declared, the text for the reasoning, and the main label beside the topics for the evidence."""
    none = F.array().cast("array<string>")
    functional, topics = F.col("inferred_expertise_functional"), F.col("matched_inferred_expertise_topics")
    rows = _p(s, d).select(
        "id", "primary_expertise", functional.alias("categories"), topics.alias("matched_sector"), functional.alias("inferred"), topics.alias("topics"), t.split_list(F.col("sector"), ";").alias("declared"), F.col("bio").alias("reasoning"),
        F.array_compact(F.concat(F.coalesce(topics, none), F.array("primary_expertise"))).alias("evidence_sectors"), F.concat_ws(" ", "title", "department").alias("declared_text"), F.col("profile_enriched").alias("analysed"),
    )
    names = lambda k: tuple(x for x, _ in _terms(s, d, k))
    return quality.validate(rows, vocabulary=names("expertise") + names("functional"), sectors=names("topic"), limits=quality.Limits(categories=2, declared=3, inferred=3, topics=4))


def requalified(s, d):
    """People that a quality filter sends back to analysis."""
    ids = quality.select_issues(_validated(s, d), status="failed")
    return ingest.requalify(_p(s, d), ids).select("id", "primary_expertise", "next_step")


def _batches(s, d):
    """People in batches of their company, and answers as a classifier would give them: names in other letters, or none at all."""
    people = _p(s, d).select(F.col("company_id").alias("batch"), F.col("id").alias("pos"), "id", "name")
    named = F.when(F.col("company_id") % 5 != 0, F.concat(F.lit(" "), F.upper(F.replace("name", F.lit(" "), F.lit("  ")))))
    answers = _p(s, d).select(F.col("company_id").alias("batch"), F.col("id").alias("pos"), named.alias("name"), F.col("primary_expertise").alias("answer"))
    return people, answers


def answer_check(s, d):
    fields = F.when(F.col("id") % 7 != 0, F.array(*[F.lit(f) for f in results.REQUIRED_FIELDS])).otherwise(F.array(F.lit("primary_expertise"), F.lit("sectors")))
    answers = _p(s, d).select(F.col("company_id").alias("batch"), F.col("id").alias("pos"), fields.alias("fields"), F.filter("inferred_expertise_functional", lambda x: x.isNotNull()).alias("categories"))
    return results.check_batches(answers, vocabulary=tuple(x for x, _ in _terms(s, d, "functional")))


def _text():
    return t.compose_text(F.col("title"), F.col("department"), F.col("bio"))


def _first_word(term: str) -> str:
    return term.lower().split(" ")[0]


def applied_answers(s, d):
    """Answers written on to the people: here each enriched person's own analysis comes back as an answer."""
    own = _p(s, d).where("linkedin_enriched")
    none = F.array().cast("array<string>")
    lists = lambda c: F.coalesce(t.split_list(F.col(c), ";"), none)
    keep = lambda c: F.filter(c, lambda x: x.isNotNull())
    answers = own.select("id", F.col("primary_expertise").alias("primary"), keep("inferred_expertise_functional").alias("categories"), lists("sector").alias("sectors"), keep("matched_inferred_expertise_topics").alias("matched_sectors"), lists("geography").alias("geographies"), keep("inferred_expertise_functional").alias("inferred"), keep("matched_inferred_expertise_topics").alias("topics"), F.col("title").alias("practice"))
    need = {x: [_first_word(x)] for x, _ in _terms(s, d, "functional")}
    return results.apply_answers(_p(s, d), answers, _text(), need).drop("matched_inferred_expertise_topics", "inferred_expertise_functional")


def person_matches(s, d):
    """Keyword results of every person over three maps made from the reference list."""
    words = {x: [w for w in x.lower().replace("&", " ").split() if len(w) > 5] or [x.lower()] for x, _ in _terms(s, d, "expertise")}
    literal = lambda k: {x: [x.lower()] for x, _ in _terms(s, d, k)}
    found = results.match_people(_p(s, d), _text(), words, literal("functional"), literal("geography"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("values")) for k in ("categories", "functional", "geography", "sectors")])
    return found.select("id", "primary", F.inline(kinds)).select("id", "kind", F.explode("values").alias("category"))


def coupled_sectors(s, d):
    """Topics with what each listed sector covers added, by the notes of the reference list."""
    parents = {x: n for x, n in _terms(s, d, "sector") if n}
    none = F.array().cast("array<string>")
    topics = F.array_distinct(F.coalesce(F.filter("matched_inferred_expertise_topics", lambda x: x.isNotNull()), none))
    rows = _p(s, d).select("id", results.couple_parents(topics, F.coalesce(t.split_list(F.col("sector"), ";"), none), parents).alias("sectors"))
    return rows.select("id", F.array_join("sectors", "|").alias("sectors"))


def picked_sectors(s, d):
    """Of each person's topics the one chosen by length of its name, then how many people have it, then its name."""
    topics = _p(s, d).select("id", F.explode("matched_inferred_expertise_topics").alias("sector")).where("sector is not null").distinct()
    hits = topics.groupBy("sector").agg(F.count(F.lit(1)).alias("hits"))
    return results.pick_sector(topics.join(hits, "sector").withColumn("specificity", F.size(F.split("sector", " "))))


def compared_results(s, d):
    """People and profiles in the one form of nine fields."""
    runs = table(s, d, "roster_profiles").select(F.col("profile_id").alias("id"), F.col("current_title").alias("primary"), *[F.lit(None).cast("array<string>").alias(c) for c in ("categories", "sectors", "matched_sectors", "geographies", "inferred")], t.split_list(F.col("skills"), "•").alias("topics"))
    both = results.normalise_rows(_p(s, d), runs)
    return both.select("origin", "id", "primary", *[F.array_join(c, "|").alias(c) for c in ("categories", "sectors", "matched_sectors", "geographies", "inferred", "topics")])


def layer_issues(s, d):
    return quality.layer_rules(_p(s, d).select("id", F.col("inferred_expertise_functional").alias("categories"), F.array("primary_expertise").alias("declared"), F.col("matched_inferred_expertise_topics").alias("topics")))


QUERIES = {
    "reset_masks": reset_masks,
    "rescrape_leaves_nothing": lambda s, d: ingest.plan_retry(_p(s, d), "rescrape").select("id", "next_step"),
    "qa_full_rules": qa_full_rules,
    "requalified": requalified,
    "startable_companies": lambda s, d: ingest.startable(_c(s, d)).select("id", "status"),
    "failed_jobs": lambda s, d: ingest.failed_jobs(_c(s, d), table(s, d, "jobs")),
    "picked_people": lambda s, d: ingest.pick(_p(s, d), resolve.match_addresses(_p(s, d), table(s, d, "roster_profiles"))).select("id", "name", "title"),
    "sector_lists": lambda s, d: _p(s, d).select("id", ingest.text_to_list(F.col("sector")).alias("sectors")).select("id", "sectors", ingest.list_to_text(F.col("sectors")).alias("text")),
    "address_keys": lambda s, d: _c(s, d).select("id", t.address_key(F.col("url")).alias("key")),
    "decoded_names": lambda s, d: _p(s, d).where("name is not null").select("id", t.url_decode(F.replace(F.replace("name", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))).alias("name")),
    "qa_page": lambda s, d: quality.issue_page(_p(s, d), _c(s, d), _validated(s, d), status="failed", page=2, size=100),
    "qa_page_all": lambda s, d: quality.issue_page(_p(s, d), _c(s, d), _validated(s, d), size=200).drop("hard", "soft"),
    "layer_issues": layer_issues,
    "person_regions": lambda s, d: _p(s, d).where("geography is not null").select("id", quality.to_regions(t.split_list(F.col("geography"), ";")).alias("regions")),
    "export_table": lambda s, d: export.export_table(_p(s, d), _c(s, d)),
    "answer_matches": lambda s, d: results.match_answers(*_batches(s, d)),
    "answer_check": answer_check,
    "applied_answers": applied_answers,
    "guarded_primary": lambda s, d: results.guard_primary(_p(s, d).select("id", F.col("primary_expertise").alias("primary"), F.col("inferred_expertise_functional").alias("categories")), tuple(x for x, _ in _terms(s, d, "expertise")), tuple(x for x, _ in _terms(s, d, "sector"))),
    "person_matches": person_matches,
    "coupled_sectors": coupled_sectors,
    "picked_sectors": picked_sectors,
    "compared_results": compared_results,
    "modal_sites": lambda s, d: pages.modal_site_share(_p(s, d), "company_id"),
}

_HAS_URL = "company_id in (select company_id from people where nullif(linkedin_url, '') is not null)"
_WHERE = {"resume": "true", "reanalyze": "true", "analyze_missing": "primary_expertise is null", "reenrich": "true", "reresolve": "linkedin_url is null", "backfill": "primary_expertise is not null and (sector is null or sector = '')", "requalify": "true"}
_STEP = {"resume": "'scrape'", "reresolve": "'resolve'", "reenrich": f"case when nullif(linkedin_url, '') is not null then 'enrich' when {_HAS_URL} then 'analyze' else 'resolve' end"}
_EMPTIED = {"reanalyze": _FIELDS, "reenrich": _FIELDS, "backfill": _FIELDS, "requalify": ("primary_expertise",)}


def _mask(mode: str) -> str:
    hit = f"coalesce({_WHERE[mode]}, false)"
    fields = ", ".join(f"case when {hit} then null else {c} end as {c}" if c in _EMPTIED.get(mode, ()) else c for c in _FIELDS)
    flag = f"case when {hit} then false else linkedin_enriched end" if mode == "reenrich" else "linkedin_enriched"
    return f"select id, '{mode}' as mode, {fields}, linkedin_url, {flag} as linkedin_enriched, case when {hit} then {_STEP.get(mode, chr(39) + 'analyze' + chr(39))} end as next_step from people"


_QA = """with v as (select list(term) as vocab from reference_terms where kind in ('expertise', 'functional')),
 q as (select id, nullif(primary_expertise, '') as pe, coalesce(inferred_expertise_functional, []) as cats, coalesce(matched_inferred_expertise_topics, []) as topics, vocab from people, v where primary_expertise is not null or inferred_expertise_functional is not null),
 b as (select *, list_filter(cats, lambda c: not list_contains(vocab, c)) as bad from q),
 r as (select id, list_filter([case when not list_contains(vocab, pe) then 'primary_expertise ''' || pe || ''' is not a valid taxonomy value' end, case when len(bad) > 0 then 'categories contains invalid values: [''' || array_to_string(bad, ''', ''') || ''']' end,
 case when pe is not null and len(cats) > 0 and not list_contains(cats, pe) then 'primary_expertise ''' || pe || ''' not present in categories' end], lambda x: x is not null) as hard,
 list_filter([case when len(cats) > 4 then 'categories has ' || len(cats) || ' items (max 4)' end, case when len(topics) > 20 then 'topics has ' || len(topics) || ' items (max 20)' end, case when len(cats) = 0 then 'categories is empty' end, case when pe is null then 'primary_expertise is not set after analysis' end], lambda x: x is not null) as soft from b),
 s as (select *, case when len(hard) > 0 then 'failed' when len(soft) > 0 then 'flagged' else 'clean' end as status from r) """
_PIECES = "list_filter(list_transform(string_split(sector, ';'), lambda x: trim(x, ' ')), lambda x: x <> '')"
_TEXT = "lower(concat_ws(' ', nullif(title, ''), nullif(department, ''), nullif(bio, '')))"
_CLEAN = "list_filter({}, lambda x: x is not null)"
_SPLIT = "list_filter(list_transform(string_split({}, ';'), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _cell(field: str, kinds: set[str]) -> str:
    if field == "company":
        return "coalesce(nullif(p.department, ''), nullif(c.name, ''), nullif(c.url, ''), '—')"
    if field not in kinds:
        return "'—'"
    value = f"array_to_string(list_filter(p.{field}, lambda x: x is not null and x <> ''), '; ')" if field in ("inferred_expertise_functional", "matched_inferred_expertise_topics") else f"p.{field}"
    return f"coalesce(nullif({value}, ''), '—')"


_HAD = {"image_url", "name", "title", "location", "email", "phone", "linkedin_url", "primary_expertise", "sector", "geography", "inferred_expertise_functional", "matched_inferred_expertise_topics", "bio", "data_source"}

SQL = {
    "reset_masks": " union all ".join(_mask(m) for m in MODES),
    "rescrape_leaves_nothing": "select id, 'scrape' as next_step from people where false",
    "qa_full_rules": """with v as (select list(term) filter (where kind in ('expertise', 'functional')) as vocab, list(term) filter (where kind = 'topic') as sectors from reference_terms),
 q as (select id, nullif(primary_expertise, '') as pe, coalesce(inferred_expertise_functional, []) as c, coalesce(matched_inferred_expertise_topics, []) as m, coalesce(list_filter(list_transform(string_split(sector, ';'), lambda x: trim(x, ' ')), lambda x: x <> ''), []) as d,
  nullif(bio, '') as bio, lower(concat_ws(' ', title, department)) as own, coalesce(profile_enriched, false) as done, primary_expertise as p, vocab, sectors from people, v),
 b as (select *, list_filter(c, lambda x: not list_contains(vocab, x)) as bad, list_filter(m, lambda x: not list_contains(sectors, x)) as wrong, list_sort(list_distinct(list_filter([p], lambda x: x is not null and not list_contains(m, x)))) as extra, list_filter(c, lambda x: contains(own, lower(x))) as copied from q),
 r as (select id, list_filter([case when not list_contains(vocab, pe) then 'primary_expertise ''' || pe || ''' is not a valid taxonomy value' end, case when len(bad) > 0 then 'categories contains invalid values: [''' || array_to_string(bad, ''', ''') || ''']' end,
  case when len(wrong) > 0 then 'matched_sector contains invalid values: [''' || array_to_string(wrong, ''', ''') || ''']' end, case when pe is not null and len(c) > 0 and not coalesce(list_contains(c, pe), false) then 'primary_expertise ''' || pe || ''' not present in categories' end,
  case when len(c) > 0 and bio is null then 'reasoning is empty but inferred is non-empty' end, case when len(extra) > 0 then 'evidence_map has entries not committed to matched_sector: [''' || array_to_string(extra, ''', ''') || ''']' end,
  case when len(copied) > 0 then 'inferred contains verbatim profile text: [''' || array_to_string(copied, ''', ''') || ''']' end], lambda x: x is not null) as hard,
 list_filter([case when len(c) > 2 then 'categories has ' || len(c) || ' items (max 2)' end, case when len(d) > 3 then 'declared has ' || len(d) || ' items (max 3)' end, case when len(c) > 3 then 'inferred has ' || len(c) || ' items (max 3)' end, case when len(m) > 4 then 'topics has ' || len(m) || ' items (max 4)' end,
  case when done and len(m) = 0 then 'matched_sector is empty' end, case when done and len(c) = 0 then 'categories is empty' end, case when done and pe is null then 'primary_expertise is not set after analysis' end], lambda x: x is not null) as soft from b)
 select id, hard, soft, case when len(hard) > 0 then 'failed' when len(soft) > 0 then 'flagged' else 'clean' end as status from r""",
    "requalified": _QA + "select p.id, case when s.id is not null then null else p.primary_expertise end as primary_expertise, case when s.id is not null then 'analyze' end as next_step from people p left join (select id from s where status = 'failed') s on s.id = p.id",
    "startable_companies": "select id, status from companies where status not in ('" + "', '".join(ingest.IN_PROGRESS) + "')",
    "failed_jobs": "select c.id as company_id, c.job_id, c.error_message, j.filename, j.status as job_status from companies c join jobs j on j.id = c.job_id where c.status = 'error'",
    "picked_people": "select id, name, title from people where nullif(regexp_extract(lower(linkedin_url), '/in/([^/?#]+)', 1), '') in (select nullif(regexp_extract(lower(linkedin_url), '/in/([^/?#]+)', 1), '') from roster_profiles where linkedin_url is not null and regexp_extract(lower(linkedin_url), '/in/([^/?#]+)', 1) <> '')",
    "sector_lists": f"select id, case when sector is not null and sector <> '—' and len({_PIECES}) > 0 then {_PIECES} end as sectors, case when sector is not null and sector <> '—' and len({_PIECES}) > 0 then array_to_string({_PIECES}, '; ') end as text from people",
    "address_keys": "select id, md5(url) as key from companies",
    "decoded_names": "select id, name from people where name is not null",
    "qa_page": _QA + "select s.id, p.name as person_name, p.company_id, c.name as company_name, s.status, s.hard, s.soft from s join people p on p.id = s.id join companies c on c.id = p.company_id where s.status = 'failed' order by p.name nulls last, s.id limit 100 offset 100",
    "qa_page_all": _QA + "select s.id, p.name as person_name, p.company_id, c.name as company_name, s.status from s join people p on p.id = s.id join companies c on c.id = p.company_id order by p.name nulls last, s.id limit 200",
    "layer_issues": f"""with x as (select id, coalesce({_CLEAN.format('inferred_expertise_functional')}, []) as c, {_CLEAN.format('[primary_expertise]')} as d, coalesce({_CLEAN.format('matched_inferred_expertise_topics')}, []) as t from people)
 select id, 'categories not sorted' as issue from x where c <> list_sort(c) union all select id, 'topics not sorted' from x where t <> list_sort(t)
 union all select id, 'categories and declared overlap' from x where list_has_any(c, d) union all select id, 'topics repeated' from x where len(list_distinct(t)) < len(t)""",
    "person_regions": "select id, list_sort(list_distinct(flatten(list_transform(" + _SPLIT.format("geography") + ", lambda v: case lower(trim(v)) " + " ".join(f"when '{r.lower()}' then ['{r}']" for r in quality.REGIONS) + " " + " ".join(f"when '{k}' then [" + ", ".join(f"'{r}'" for r in v) + "]" for k, v in quality.REGION_SHORT.items() if v) + " else [] end)))) as regions from people where geography is not null",
    "export_table": "select p.id, " + ", ".join(f'{_cell(f, _HAD)} as "{h}"' for f, h, _ in export.TABLE_COLUMNS) + " from people p join companies c on c.id = p.company_id",
    "answer_matches": """with n as (select company_id, id, lower(regexp_replace(trim(regexp_replace(name, '\\s+', ' ', 'g'), ' '), '\\s+', ' ', 'g')) as n, primary_expertise from people),
 a as (select company_id, n, max_by(coalesce(primary_expertise, chr(1)), id) as answer from n where company_id % 5 <> 0 and n <> '' group by 1, 2)
 select n.id, nullif(a.answer, chr(1)) as answer, 'name' as how from n join a on a.company_id = n.company_id and a.n = n.n
 union all select id, primary_expertise, 'position' from people where company_id % 5 = 0""",
    "answer_check": """with v as (select list(term) as vocab from reference_terms where kind = 'functional'),
 f as (select company_id, min_by(id % 7 = 0, id) as short from people group by 1),
 w as (select company_id, string_agg(distinct c, ', ' order by c) as wrong from (select company_id, unnest(inferred_expertise_functional) as c from people), v where c is not null and not list_contains(vocab, c) group by 1),
 e as (select f.company_id as batch, nullif(concat_ws('; ', case when short then 'missing fields: evidence_map, explicit_expertise_13, geographies, inferred_expertise_functional' end, 'invalid categories: ' || wrong), '') as error from f left join w on w.company_id = f.company_id)
 select batch, error from e where error is not null""",
    "applied_answers": f"""with v as (select list(term) as vocab from reference_terms where kind = 'functional'), x as (select *, {_TEXT} as txt from people)
 select id, primary_expertise, case when linkedin_enriched then coalesce(list_filter({_CLEAN.format('inferred_expertise_functional')}, lambda c: not list_contains(vocab, c) or contains(txt, string_split(lower(c), ' ')[1])), []) else [] end as categories,
 case when linkedin_enriched then nullif(array_to_string(coalesce({_SPLIT.format('sector')}, []), '; '), '') else sector end as sector,
 case when linkedin_enriched and len(coalesce({_CLEAN.format('matched_inferred_expertise_topics')}, [])) > 0 then {_CLEAN.format('matched_inferred_expertise_topics')} end as matched_sector,
 case when linkedin_enriched then nullif(array_to_string(coalesce({_SPLIT.format('geography')}, []), '; '), '') else geography end as geography,
 case when linkedin_enriched then coalesce(nullif(title, ''), department) else department end as department from x, v""",
    "person_matches": f"""with x as (select id, {_TEXT} as txt from people),
 w as (select term, unnest(list_filter(string_split(replace(lower(term), '&', ' '), ' '), lambda w: length(w) > 5)) as w from reference_terms where kind = 'expertise' union all
 select term, lower(term) from reference_terms where kind = 'expertise' and len(list_filter(string_split(replace(lower(term), '&', ' '), ' '), lambda w: length(w) > 5)) = 0)
 select distinct id, 'categories' as kind, term as category from x, w where contains(txt, w.w)
 union all select id, kind, term from x, reference_terms r where kind in ('functional', 'geography') and contains(txt, lower(term))""",
    "coupled_sectors": f"""with r as (select list(term) as ts, list(note) as ns from reference_terms where kind = 'sector' and note is not null)
 select id, array_to_string(list_sort(list_distinct(list_concat(coalesce({_CLEAN.format('matched_inferred_expertise_topics')}, []), list_filter(list_transform(coalesce({_SPLIT.format('sector')}, []), lambda m: ns[list_position(ts, m)]), lambda p: p is not null)))), '|') as sectors from people, r""",
    "picked_sectors": """with u as (select distinct id, sector from (select id, unnest(matched_inferred_expertise_topics) as sector from people) where sector is not null), h as (select sector, count(*) as hits from u group by 1)
 select id, sector from (select u.id, u.sector, row_number() over (partition by u.id order by len(string_split(u.sector, ' ')) desc, h.hits desc, u.sector) as r from u join h on h.sector = u.sector) where r = 1""",
    "compared_results": f"""select 'people' as origin, id, primary_expertise as "primary", '' as categories, array_to_string(coalesce({_SPLIT.format('sector')}, []), '|') as sectors, '' as matched_sectors, array_to_string(coalesce({_SPLIT.format('geography')}, []), '|') as geographies,
 array_to_string(coalesce({_CLEAN.format('inferred_expertise_functional')}, []), '|') as inferred, array_to_string(coalesce({_CLEAN.format('matched_inferred_expertise_topics')}, []), '|') as topics from people
 union all select 'run', profile_id, current_title, '', '', '', '', '', array_to_string(list_filter(list_transform(string_split(coalesce(skills, ''), '•'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') from roster_profiles""",
    "modal_sites": """with x as (select company_id, count(*) as people, count(*) filter (where length(bio) >= 80 and not coalesce(profile_enriched, false)) as with_bio from people group by 1)
 select company_id, people, with_bio, with_bio > 0 and with_bio >= people * 0.1 as modal_site from x""",
}
