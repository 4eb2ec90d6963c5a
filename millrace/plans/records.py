"""Queries of the record-level operators over the project tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.functions.udfs import fold
from millrace.operators import analytics, classify, export, firms, ingest, pages, quality, resolve
from millrace.session import table

# A small keyword map for the topics of the test tables; real maps are files (classify.load_keyword_map).
KEYWORDS = {"Finance and Accounting": ["ledger", "audit", "tax", "treasury"], "M&A and Corporate Development": ["deal", "restructuring", "m&a"], "Technology": ["cyber", "data", "software"], "People and Talent": ["talent", "reward", "learning"], "Legal": ["disputes", "counsel"]}


def _p(s, d):
    return table(s, d, "people")


def _c(s, d):
    return table(s, d, "companies")


def _requested(s, d):
    """Addresses as a list might give them: stored ones written otherwise, and new ones."""
    c = _c(s, d)
    return c.select(F.concat(F.upper("url"), F.lit("//")).alias("url")).unionByName(c.select(F.concat(F.lit("https://new-"), F.col("id").cast("string"), F.lit(".example/")).alias("url")))


_REQ = "select upper(url) || '//' as url from companies union all select 'https://new-' || id || '.example/' from companies"


def _text(s, d):
    return _p(s, d).select("id", t.compose_text(F.col("title"), F.col("department"), F.col("bio")).alias("text"))


_TEXT = "select id, lower(concat_ws(' ', nullif(title, ''), nullif(department, ''), nullif(bio, ''))) as text from people"


def keyword_categories(s, d):
    hits = classify.keyword_hits(F.col("text"), KEYWORDS)
    return _text(s, d).select("id", F.inline(hits)).select("id", "category", F.size("hits").alias("hits"))


def _case_hits(words):
    return " + ".join(f"cast(contains(text, '{w}') as int)" for w in words)


def primary_by_priority(s, d):
    cats = F.transform(classify.keyword_hits(F.col("text"), KEYWORDS), lambda x: x["category"])
    return _text(s, d).select("id", classify.primary_by_priority(cats).alias("primary"))


def evidence_filter(s, d):
    """Which of all categories each person's own text has evidence for, where it is asked for."""
    cats = F.array(*[F.lit(c) for c in classify.CATEGORIES])
    return _text(s, d).select("id", F.array_join(classify.evidence_filter(cats, F.col("text"), classify.REQUIRED_EVIDENCE), ";").alias("kept"))


def _quality_table(s, d):
    return _p(s, d).select("id", "primary_expertise", F.col("inferred_expertise_functional").alias("categories"), F.col("matched_inferred_expertise_topics").alias("topics"))


def _validated(s, d):
    terms = [r[0] for r in table(s, d, "reference_terms").where("kind in ('expertise', 'functional')").orderBy("term_id").select("term").collect()]
    return quality.validate(_quality_table(s, d), vocabulary=tuple(terms))


def _plain_names(s, d):
    return _p(s, d).select("id", "company_id", resolve.norm_name(fold("name")).alias("n"))


def nickname_pairs(s, d):
    """Classes of rows of one company whose names are nicknames of each other; ``name_classes`` has the members."""
    return resolve.nickname_pairs(_plain_names(s, d))


def name_classes(s, d):
    """Every row with the class of its name in its company: the smallest id with that name."""
    names = _plain_names(s, d).where("n <> ''")
    classes = resolve.name_classes(names)
    return names.join(classes, (names["n"] == classes["n"]) & names["company_id"].eqNullSafe(classes["company_id"])).select(names["id"], F.col("first_id").alias("class_id"), "rows")


def roster_match(s, d):
    """People against the profiles of their own company (see ``firms.company_roster``)."""
    roster = firms.company_roster(_c(s, d), table(s, d, "roster_profiles")).where("company_id is not null")
    return resolve.match_roster(_p(s, d).select("id", "company_id", "name", "title"), roster)


def roster_without_company(s, d):
    """Profiles whose firm is no company of the table."""
    return firms.company_roster(_c(s, d), table(s, d, "roster_profiles")).where("company_id is null").select("profile_id")


def _team_links(s, d):
    """Links of the companies' own pages, with the text the page would show."""
    c = _c(s, d).where("team_url is not null").select(F.col("id").alias("page_id"), "url", "team_url")
    entries = F.array(F.struct(F.col("team_url").alias("href"), F.lit("Our people").alias("text"), F.lit("nav").alias("context")), F.struct(F.concat("url", F.lit("careers")).alias("href"), F.lit("Careers").alias("text"), F.lit("nav").alias("context")), F.struct(F.concat("url", F.lit("board")).alias("href"), F.lit("Board").alias("text"), F.lit("").alias("context")))
    return c.select("page_id", "url", F.posexplode(entries).alias("pos", "e")).select("page_id", "url", "pos", "e.href", "e.text", "e.context")


def taxonomy_hints(s, d):
    """What a person's listed sectors cover, by the notes of the reference list."""
    mapping = table(s, d, "reference_terms").where("kind = 'sector' and note is not null").select(F.col("term").alias("tag"), F.col("note").alias("category"))
    tagged = _p(s, d).select("id", t.split_list(F.col("sector"), ";").alias("tags"))
    return classify.taxonomy_hints(tagged, mapping, "tags").select("id", F.array_join("hints", "|").alias("hints"))


def firm_mentions(s, d):
    """People whose text names a telling word of their firm."""
    named = _c(s, d).where("name is not null").select(F.col("id").alias("company_id"), fold("name").alias("firm"))
    texts = _p(s, d).where("bio is not null").select("id", "company_id", fold("bio").alias("t"))
    return texts.join(named, "company_id").where(resolve.firm_in_text(F.col("firm"), F.col("t"))).select("id")


def cascade_match(s, d):
    """Profiles by address first; of the rest by name within the firm."""
    profiles = table(s, d, "roster_profiles")
    roster = firms.company_roster(_c(s, d), profiles).where("company_id is not null")
    people = _p(s, d).select("id", "company_id", "name", "title", "linkedin_url")
    return resolve.cascade(people, [lambda left: resolve.match_addresses(left, profiles), lambda left: resolve.match_roster(left, roster)])


def retry_steps(s, d):
    """Rows each repetition would touch in every company."""
    people = _p(s, d)
    modes = F.filter(F.array(*[F.when(F.coalesce(ingest.choose_rows(m), F.lit(False)), F.lit(m)) for m in ("resume", "reanalyze", "analyze_missing", "reenrich", "reresolve", "backfill")]), lambda x: x.isNotNull())
    return people.select("company_id", F.explode(modes).alias("mode")).groupBy("company_id", "mode").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "taxonomy_hints": taxonomy_hints,
    "firm_mentions": firm_mentions,
    "cascade_match": cascade_match,
    "retry_steps": retry_steps,
    "job_companies": lambda s, d: analytics.jobs_with_companies(table(s, d, "jobs"), _c(s, d)).select("job_id", "filename", "status", F.array_join(F.transform("companies", lambda c: F.concat_ws("|", c["id"].cast("string"), c["url"], c["status"])), ";").alias("companies")),
    "event_windows": lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("decimal(28,6)").alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total"),
    "rendered_people": lambda s, d: classify.render_person(_p(s, d)),
    "category_check": lambda s, d: classify.validate_categories(_p(s, d).select("id", F.array("primary_expertise").alias("c")), "c", [], tuple(r[0] for r in table(s, d, "reference_terms").where("kind = 'expertise'").orderBy("term_id").select("term").collect()), {}).groupBy("how").agg(F.count(F.lit(1)).alias("n")),
    "existing_urls": lambda s, d: ingest.existing_urls(_requested(s, d), _c(s, d)),
    "new_urls": lambda s, d: ingest.new_urls(_requested(s, d), _c(s, d)),
    "upsert_plan": lambda s, d: ingest.upsert_plan(_requested(s, d), _c(s, d), _c(s, d).where("status = 'completed'")),
    "superseded_duplicates": lambda s, d: ingest.superseded_duplicates(_c(s, d)),
    "dedupe_people": lambda s, d: ingest.dedupe_people(_p(s, d).select("id", "company_id", "name", "title", "profile_url")).select("id"),
    "null_shared_values": lambda s, d: ingest.null_shared_values(_p(s, d).select("id", "company_id", "phone", "image_url")).select("id", "phone", "image_url"),
    "substantive_people": lambda s, d: ingest.keep_substantive(_p(s, d)).select("id"),
    "batch_numbers": lambda s, d: ingest.number_batches(_p(s, d), 50),
    "run_versions": lambda s, d: ingest.next_versions(table(s, d, "usage_logs").dropDuplicates(["id"]).select("id", "company_id", "provider", "model", "created_at"), ["company_id", "provider", "model"], ["created_at", "id"]).select("id", "version"),
    "missing_sectors": lambda s, d: ingest.missing_sectors(_p(s, d)),
    "export_rows": lambda s, d: export.export_rows(_p(s, d), _c(s, d)),
    "photo_names": lambda s, d: export.photo_names(_p(s, d)),
    "norm_url": lambda s, d: _c(s, d).select("id", t.norm_url(F.col("url")).alias("norm_url")),
    "domain_name": lambda s, d: _c(s, d).select("id", t.domain_name(F.col("url")).alias("domain_name")),
    "search_name": lambda s, d: _c(s, d).select("id", t.search_name(F.col("name"), F.col("url")).alias("search_name")),
    "firm_slug": lambda s, d: _c(s, d).where("name is not null").select("id", t.firm_slug(F.col("name")).alias("slug")),
    "profile_slug": lambda s, d: _p(s, d).select("id", t.profile_slug(F.col("linkedin_url")).alias("slug")),
    "headline_title": lambda s, d: table(s, d, "roster_profiles").select("profile_id", t.headline_title(F.col("headline"), F.col("current_title")).alias("title")),
    "list_skills": lambda s, d: table(s, d, "roster_profiles").select("profile_id", F.array_join(t.distinct_ignoring_case(F.coalesce(t.split_list(F.col("skills"), "•"), F.array().cast("array<string>"))), "•").alias("skills")),
    "join_topics": lambda s, d: _p(s, d).select("id", t.join_list(F.col("matched_inferred_expertise_topics")).alias("topics")),
    "keyword_categories": keyword_categories,
    "primary_by_priority": primary_by_priority,
    "evidence_filter": evidence_filter,
    "verbatim_strip": lambda s, d: _p(s, d).select("id", F.array_join(classify.strip_verbatim(F.filter("inferred_expertise_functional", lambda x: x.isNotNull()), F.coalesce("title", F.lit(""))), ";").alias("kept")),
    "qa_status": lambda s, d: quality.status_histogram(_validated(s, d)),
    "qa_issue_counts": lambda s, d: quality.issue_histogram(_validated(s, d)),
    "qa_failed": lambda s, d: quality.select_issues(_validated(s, d), status="failed", kind="taxonomy_violation").select("id"),
    "nickname_pairs": nickname_pairs,
    "name_classes": name_classes,
    "roster_match": roster_match,
    "roster_without_company": roster_without_company,
    "slug_fits": lambda s, d: _p(s, d).where("linkedin_url like '%/in/%' and name is not null").select("id", fold(F.regexp_extract("linkedin_url", "/in/([^/?#]+)", 1)).alias("s"), fold("name").alias("n")).select("id", resolve.slug_fits(F.col("s"), F.col("n")).alias("fits")),
    "address_match": lambda s, d: resolve.match_addresses(_p(s, d), table(s, d, "roster_profiles")),
    "enrichment_overwrite": lambda s, d: resolve.enrich_profiles(_p(s, d), resolve.match_addresses(_p(s, d), table(s, d, "roster_profiles")), table(s, d, "roster_profiles")),
    "site_names": lambda s, d: _c(s, d).where("url is not null").select("id", t.url_host(F.col("url")).alias("host"), t.site_slug(F.col("url")).alias("slug")),
    "name_texts": lambda s, d: _p(s, d).where("name is not null").select("id", fold("name").alias("folded"), resolve.norm_name(fold("name")).alias("plain"), F.array_join(t.significant_tokens(fold("name")), " ").alias("tokens")),
    "masked_places": lambda s, d: _p(s, d).select("id", t.mask_location(F.col("location")).alias("location"), t.mask_profile_url(F.col("linkedin_url")).alias("linkedin_url")),
    "enrichment_merge": lambda s, d: resolve.apply_profiles(_p(s, d), resolve.match_addresses(_p(s, d), table(s, d, "roster_profiles")), table(s, d, "roster_profiles")),
    "best_team_link": lambda s, d: pages.best_links(_team_links(s, d)).select("page_id", "href", "score"),
    "page_addresses": lambda s, d: pages.page_addresses(_c(s, d).where("pages_scraped > 0").select("url", F.when(F.col("id") % 2 == 0, "query_param").otherwise("path_segment").alias("strategy"), F.lit("page").alias("param"), F.lit(1).alias("start"), F.lit(1).alias("step"), F.col("pages_scraped").alias("pages"))).select("url", "n", "page_url"),
}

_NORM = "lower(rtrim({}, '/'))"
_EMPTYS = "coalesce(nullif({0}, ''), '—') as {0}"
_VALID = """with v as (select list(term) as vocab from reference_terms where kind in ('expertise', 'functional')),
 q as (select id, nullif(primary_expertise, '') as pe, coalesce(inferred_expertise_functional, []) as cats, coalesce(matched_inferred_expertise_topics, []) as topics, vocab from people, v),
 r as (select id, coalesce(not list_contains(vocab, pe), false) as r1, len(list_filter(cats, lambda c: not list_contains(vocab, c))) > 0 as r2, len(cats) > 4 as r3, len(topics) > 20 as r4,
 pe is not null and len(cats) > 0 and not list_contains(cats, pe) as r5, len(cats) = 0 as r6, pe is null as r7 from q) """

_LABEL = "translate(string_split(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', ''), '.')[1], '-_', '  ')"
_DOMAIN = f"array_to_string(list_transform(string_split({_LABEL}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


_PATH_POINTS = "case " + " ".join(f"when starts_with(path, '{w}') or contains(path, '{w}/') then {n}" for w, n in pages.LINK_PATHS) + " else 0 end"


def _line(label, c):
    return f"case when nullif({c}, '') is not null then '{label}: ' || {c} end"


# Compatibility forms of the test texts: special blanks and the ellipsis; other signs outside ASCII fall away.
_FOLD = "lower(regexp_replace(strip_accents(replace(regexp_replace({}, '[\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g'), '…', '...')), '[^\\x00-\\x7F]', '', 'g'))"
_TOKENS = "list_filter(string_split_regex({}, '[^a-z]+'), lambda w: length(w) >= 3 and w not in ('the', 'and', 'for', 'von', 'van', 'de', 'le', 'la'))"
_HIT = "len(list_filter(segs, lambda s: s = {0} or (least(length(s), length({0})) >= 3 and (starts_with(s, {0}) or starts_with({0}, s))))) > 0"
_GENERIC = ", ".join(f"'{w}'" for w in resolve.GENERIC_FIRM_WORDS)
_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^\\s*(?:" + resolve.NAME_PREFIXES + ")\\.?\\s+', ''), '\\s+(?:" + resolve.NAME_SUFFIXES + ")\\.?\\s*$', ''), '[^a-z]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"

SQL = {
    "domain_name": f"select id, {_DOMAIN} as domain_name from companies",
    "search_name": f"select id, case when regexp_matches(name, '[ \\p{{Lu}}]') then name else coalesce(nullif({_DOMAIN}, ''), name, url, '') end as search_name from companies",
    "rendered_people": "select id, concat_ws(chr(10), " + ", ".join([_line("Name", "name"), _line("Title", "title"), _line("Department", "department"), _line("Bio", "left(bio, 500)"), _line("Topics", "array_to_string(list_slice(matched_inferred_expertise_topics, 1, 20), ', ')")]) + ") as rendered from people",
    "best_team_link": "select id as page_id, team_url as href, 5 + 2 + " + _PATH_POINTS + " as score from (select *, regexp_extract(lower(team_url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path from companies where team_url is not null)",
    "taxonomy_hints": """with x as (select distinct p.id, r.note as c from (select id, trim(unnest(string_split(sector, ';')), ' ') as tag from people) p join reference_terms r on r.term = p.tag and r.kind = 'sector' where r.note is not null)
 select id, string_agg(c, '|' order by c) as hints from x group by 1""",
    "retry_steps": """select company_id, mode, count(*) as n from (select company_id, unnest(['resume', 'reanalyze', 'reenrich']) as mode from people union all select company_id, 'analyze_missing' from people where primary_expertise is null
 union all select company_id, 'reresolve' from people where linkedin_url is null union all select company_id, 'backfill' from people where primary_expertise is not null and (sector is null or sector = '')) group by 1, 2""",
    "job_companies": "select j.id as job_id, j.filename, j.status, string_agg(concat_ws('|', cast(c.id as varchar), c.url, c.status), ';' order by c.id) as companies from jobs j left join companies c on c.job_id = j.id group by 1, 2, 3",
    "event_windows": "select cast(ts as date) as day, event_type, count(*) as n, cast(sum(cast(value as decimal(18,6))) as decimal(28,6)) as total from events group by 1, 2",
    "existing_urls": f"select r.url from ({_REQ}) r where {_NORM.format('r.url')} in (select {_NORM.format('url')} from companies)",
    "new_urls": f"select distinct {_NORM.format('r.url')} as url from ({_REQ}) r where {_NORM.format('r.url')} not in (select {_NORM.format('url')} from companies)",
    "upsert_plan": f"""with l as (select id, n from (select id, {_NORM.format('url')} as n, row_number() over (partition by {_NORM.format('url')} order by created_at desc, id) as r from companies) where r = 1),
 k as (select distinct {_NORM.format('url')} as n from companies where status = 'completed'), w as (select distinct {_NORM.format('url')} as n from ({_REQ}))
 select w.n as url, l.id as company_id, case when l.id is null then 'insert' when k.n is not null then 'skip' else 'reset' end as action from w left join l on l.n = w.n left join k on k.n = w.n""",
    "superseded_duplicates": f"select id, url, kept_id from (select id, url, max(id) over (partition by {_NORM.format('url')}) as kept_id from companies) where id < kept_id",
    "dedupe_people": "select id from (select id, row_number() over (partition by company_id, coalesce(nullif(profile_url, ''), concat_ws(chr(1), lower(trim(name, ' ')), lower(trim(coalesce(title, ''), ' ')))) order by id) as r from people) where r = 1",
    "null_shared_values": """select id, case when phone is null or count(phone) over (partition by company_id, phone) > 1 then null else phone end as phone,
 case when image_url is null or count(image_url) over (partition by company_id, image_url) > 1 then null else image_url end as image_url from people""",
    "substantive_people": "select id from people where nullif(trim(name, ' '), '') is not null and coalesce(" + ", ".join(f"nullif(trim({c}, ' '), '')" for c in ("title", "bio", "email", "phone", "linkedin_url", "image_url", "location", "profile_url")) + ") is not null",
    "batch_numbers": "select id, company_id, cast((row_number() over (partition by company_id order by id) - 1) // 50 + 1 as int) as batch from people",
    "run_versions": "select id, cast(row_number() over (partition by company_id, provider, model order by created_at, id) as int) as version from (select distinct id, company_id, provider, model, created_at from usage_logs)",
    "missing_sectors": "select company_id, id from people where primary_expertise is not null and (sector is null or sector = '')",
    "export_rows": "select p.id, coalesce(nullif(c.name, ''), c.url) as company, coalesce(nullif(p.department, ''), nullif(c.name, ''), c.url, '—') as department, "
    + ", ".join(_EMPTYS.format(c).replace("nullif(", "nullif(p.") for c in export.EXPORT_COLUMNS if c not in ("department", "inferred_expertise_functional", "matched_inferred_expertise_topics"))
    + ", "
    + ", ".join(f"coalesce(nullif(array_to_string(list_filter(p.{c}, lambda x: x is not null and x <> ''), '; '), ''), '—') as {c}" for c in ("inferred_expertise_functional", "matched_inferred_expertise_topics"))
    + " from people p join companies c on c.id = p.company_id",
    "norm_url": f"select id, {_NORM.format('url')} as norm_url from companies",
    "headline_title": "select profile_id, coalesce(nullif(string_split(headline, ' at ')[1], ''), nullif(current_title, '')) as title from roster_profiles",
    "list_skills": "with x as (select profile_id, list_filter(list_transform(string_split(coalesce(skills, ''), '•'), lambda x: trim(x, ' ')), lambda x: x <> '') as l from roster_profiles) select profile_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '•') as skills from x",
    "join_topics": "select id, nullif(array_to_string(matched_inferred_expertise_topics, '; '), '') as topics from people",
    "profile_slug": "select id, nullif(regexp_extract(lower(linkedin_url), '/(?:company|in)/([^/?#]+)', 1), '') as slug from people",
    "firm_slug": "select id, regexp_replace(case "
    + " ".join(f"when lower(trim(name, ' ')) like '%{e}' then left(lower(trim(name, ' ')), length(lower(trim(name, ' '))) - {len(e)})" for e in t.FIRM_ENDINGS)
    + " else lower(trim(name, ' ')) end, '[^a-z0-9]+', '', 'g') as slug from companies where name is not null",
    "keyword_categories": f"with x as ({_TEXT}) " + " union all ".join(f"select id, '{c}' as category, {_case_hits(ws)} as hits from x where {_case_hits(ws)} > 0" for c, ws in KEYWORDS.items()),
    "primary_by_priority": f"with x as ({_TEXT}) select id, case " + " ".join(f"when {_case_hits(KEYWORDS[c])} > 0 then '{c}'" for c in classify.PRIORITY if c in KEYWORDS) + f" else '{classify.NO_CATEGORY}' end as \"primary\" from x",
    "evidence_filter": f"with x as ({_TEXT}) select id, array_to_string(list_filter([" + ", ".join(f"case when {_case_hits(classify.REQUIRED_EVIDENCE[c])} > 0 then '{c}' end" if c in classify.REQUIRED_EVIDENCE else f"'{c}'" for c in classify.CATEGORIES) + "], lambda v: v is not null), ';') as kept from x",
    "verbatim_strip": "select id, array_to_string(list_filter(inferred_expertise_functional, lambda x: x is not null and not contains(lower(coalesce(title, '')), lower(x))), ';') as kept from people",
    "qa_status": _VALID + "select case when r1 or r2 or r5 then 'failed' when r3 or r4 or r6 or r7 then 'flagged' else 'clean' end as status, count(*) as n from r group by 1",
    "qa_issue_counts": _VALID + """select issue, n from (select 'taxonomy_violation' as issue, cast(sum(r1::int + r2::int) as bigint) as n from r union all select 'count_violation', cast(sum(r3::int + r4::int) as bigint) from r
 union all select 'consistency', cast(sum(r5::int) as bigint) from r union all select 'missing_fields', cast(sum(r6::int + r7::int) as bigint) from r) where n > 0""",
    "qa_failed": _VALID + "select id from r where (r1 or r2 or r5) and (r1 or r2)",
    "photo_names": """with x as (select *, regexp_split_to_array(trim(name, ' '), '\\s+') as w, row_number() over (partition by company_id order by name, id) as n from people where image_url is not null and name is not null)
 select id, lpad(cast(n as varchar), greatest(3, 3), '0') || '_' || regexp_replace(w[1], '[^\\pL\\pN]+', '', 'g') || '_' || regexp_replace(w[-1], '[^\\pL\\pN]+', '', 'g') || coalesce(nullif(regexp_extract(lower(image_url), '(\\.(?:jpe?g|png|webp|gif))(?:[?#]|$)', 1), ''), '.jpg') as file_name from x""",
    "slug_fits": f"""with x as (select id, string_split_regex({_FOLD.format("regexp_extract(linkedin_url, '/in/([^/?#]+)', 1)")}, '[^a-z0-9]+') as segs, {_TOKENS.format(_FOLD.format('name'))} as toks from people where linkedin_url like '%/in/%' and name is not null)
 select id, case when len(toks) = 0 then false else {_HIT.format('toks[1]')} and {_HIT.format('toks[-1]')} end as fits from x""",
    "firm_mentions": f"""with x as (select p.id, {_FOLD.format('p.bio')} as txt, {_TOKENS.format(_FOLD.format('c.name'))} as toks from people p join companies c on c.id = p.company_id where p.bio is not null and c.name is not null),
 y as (select *, list_filter(toks, lambda w: w not in ({_GENERIC})) as telling from x), z as (select *, case when len(telling) > 0 then telling else toks end as used from y)
 select id from z where case when trim(txt, ' ') = '' then false when len(used) = 0 then true else len(list_filter(used, lambda w: contains(txt, w))) > 0 end""",
    "nickname_pairs": f"""with n as (select id, company_id, {_PLAIN.format(_FOLD.format('name'))} as n from people), g as (select company_id, n, min(id) as id, count(*) as c from n where n <> '' and contains(n, ' ') group by 1, 2), k as (select *, string_split(n, ' ') as w from g)
 select a.id as id_a, b.id as id_b, a.c as rows_a, b.c as rows_b from k a join k b on a.company_id = b.company_id and a.id < b.id and a.w[-1] = b.w[-1] where least(length(a.w[1]), length(b.w[1])) >= 3 and (starts_with(a.w[1], b.w[1]) or starts_with(b.w[1], a.w[1]))""",
    "name_classes": f"""with n as (select id, company_id, {_PLAIN.format(_FOLD.format('name'))} as n from people)
 select id, min(id) over (partition by company_id, n) as class_id, count(*) over (partition by company_id, n) as rows from n where n <> ''""",
    "name_texts": f"select id, {_FOLD.format('name')} as folded, {_PLAIN.format(_FOLD.format('name'))} as plain, array_to_string({_TOKENS.format(_FOLD.format('name'))}, ' ') as tokens from people where name is not null",
    "masked_places": "select id, case when not regexp_matches(location, '(?i)\\b(?:" + "|".join(t.TITLE_WORDS) + ")\\b') then location end as location, case when contains(lower(linkedin_url), '/in/') then linkedin_url end as linkedin_url from people",
    "site_names": "select id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host, left(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '[^A-Za-z0-9_]', '_', 'g'), 40) as slug from companies where url is not null",
    "enrichment_overwrite": """with a as (select id, nullif(regexp_extract(lower(linkedin_url), '/in/([^/?#]+)', 1), '') as slug from people), b as (select profile_id, nullif(regexp_extract(lower(linkedin_url), '/in/([^/?#]+)', 1), '') as slug from roster_profiles),
 m as (select id, min(profile_id) as profile_id from a join b using (slug) group by 1)
 select p.id, r.headline as linkedin_headline, r.about as linkedin_summary, r.skills as linkedin_skills, case when m.id is not null then coalesce(nullif(p.location, ''), nullif(r.location, '')) else p.location end as location,
 m.id is not null or coalesce(p.linkedin_enriched, false) as linkedin_enriched from people p left join m on m.id = p.id left join roster_profiles r on r.profile_id = m.profile_id""",
    "address_match": """with a as (select id, nullif(regexp_extract(lower(linkedin_url), '/in/([^/?#]+)', 1), '') as slug from people), b as (select profile_id, nullif(regexp_extract(lower(linkedin_url), '/in/([^/?#]+)', 1), '') as slug from roster_profiles)
 select id, min(profile_id) as profile_id from a join b using (slug) group by 1""",
    "enrichment_merge": """with a as (select id, nullif(regexp_extract(lower(linkedin_url), '/in/([^/?#]+)', 1), '') as slug from people), b as (select profile_id, nullif(regexp_extract(lower(linkedin_url), '/in/([^/?#]+)', 1), '') as slug from roster_profiles),
 m as (select id, min(profile_id) as profile_id from a join b using (slug) group by 1)
 select p.id, case when m.id is not null then coalesce(nullif(r.linkedin_url, ''), p.linkedin_url) else p.linkedin_url end as linkedin_url, case when m.id is not null then coalesce(nullif(p.location, ''), nullif(r.location, '')) else p.location end as location,
 case when m.id is not null then coalesce(nullif(p.bio, ''), nullif(r.about, '')) else p.bio end as bio, case when m.id is not null then 'Website + LinkedIn' else 'Website' end as data_source from people p left join m on m.id = p.id left join roster_profiles r on r.profile_id = m.profile_id""",
    "page_addresses": """with s as (select url, rtrim(url, '/?#') as b, id, unnest(range(1, pages_scraped + 1)) as n from companies where pages_scraped > 0)
 select url, cast(n as int) as n, case when id % 2 = 0 then b || '?page=' || n else b || '/page/' || n end as page_url from s""",
}
