"""Queries over the project tables and their SQL twins: coverage, counts, search, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import analytics as a
from millrace.session import table

AS_OF = "2024-06-30 00:00:00"


def _people(s, d):
    return table(s, d, "people")


def _companies(s, d):
    return table(s, d, "companies")


def _usage(s, d, **window):
    return a.usage_window(table(s, d, "usage_logs"), **window)


def _raw_usage(s, d):
    return table(s, d, "usage_logs")


_RECENT = {"days": 90, "as_of": AS_OF}


def _pc(f, *args, **kw):
    return lambda s, d: f(_people(s, d), _companies(s, d), *args, **kw)


QUERIES = {
    "company_overview": _pc(a.company_overview),
    "overview_totals": _pc(a.overview_totals),
    "company_completeness": _pc(a.company_completeness),
    "worst_completeness": _pc(a.worst_completeness),
    "category_counts": _pc(a.category_counts),
    "top_expertise": _pc(a.top_values, "primary_expertise", 20),
    "top_sectors_raw": _pc(a.top_values, "sector", 15),
    "top_geographies_raw": _pc(a.top_values, "geography", 15),
    "sector_split_counts": lambda s, d: a.split_counts(_people(s, d), "sector"),
    "geography_split_counts": lambda s, d: a.split_counts(_people(s, d), "geography"),
    "category_heatmap": _pc(a.heatmap),
    "top3_categories": lambda s, d: a.top_categories(_people(s, d)),
    "skills_matrix": lambda s, d: a.skills_matrix(_people(s, d)),
    "completeness_bands": _pc(a.completeness_bands),
    "heatmap_intensity": lambda s, d: a.heatmap_maps(_people(s, d), _companies(s, d)).select("company_id", F.explode("cells").alias("category", "cell")).select("company_id", "category", "cell.n", F.round("cell.intensity", 9).alias("intensity")),
    "search_people": _pc(a.search_people, q="director", sector="bank", page=2),
    "search_total": _pc(a.search_total, q="director", sector="bank"),
    "search_by_category": _pc(a.search_total, category="Disputes", geography="europe"),
    "people_page": lambda s, d: a.people_page(_people(s, d), 3, page=1, size=100, search="an"),
    "latest_company_per_url": lambda s, d: a.latest_per_url(_companies(s, d)),
    "latest_per_norm_url": lambda s, d: a.latest_per_norm_url(_companies(s, d)),
    "active_companies": lambda s, d: _companies(s, d).where(~F.col("status").isin("completed", "error")).select("id", "url", "status"),
    "cost_total": lambda s, d: _usage(s, d).agg(F.coalesce(a.money("cost_usd"), F.lit(0)).cast("decimal(28,6)").alias("cost")),
    "cost_by_service": lambda s, d: a.cost_by(_usage(s, d), "service"),
    "cost_by_provider": lambda s, d: a.cost_by(_usage(s, d), "provider"),
    "cost_by_step": lambda s, d: a.cost_by(_usage(s, d), "pipeline_step"),
    "cost_by_company_top50": lambda s, d: a.cost_by_company(_usage(s, d), _companies(s, d)),
    "cost_daily": lambda s, d: a.cost_daily(_usage(s, d)),
    "cost_summary_90d": lambda s, d: a.cost_summary(_raw_usage(s, d), 90, AS_OF),
    "cost_summary_90d_company": lambda s, d: a.cost_summary(_raw_usage(s, d), 90, AS_OF, company_id=3),
    "cost_by_service_90d": lambda s, d: a.cost_by(_usage(s, d, **_RECENT), "service"),
    "cost_by_provider_90d": lambda s, d: a.cost_by(_usage(s, d, **_RECENT), "provider"),
    "cost_by_step_90d": lambda s, d: a.cost_by(_usage(s, d, **_RECENT), "pipeline_step"),
    "cost_by_company_90d": lambda s, d: a.cost_by_company(_usage(s, d, **_RECENT), _companies(s, d)),
    "cost_daily_90d": lambda s, d: a.cost_daily(_usage(s, d, **_RECENT)),
    "cost_daily_company": lambda s, d: a.cost_daily(_usage(s, d, company_id=3)),
    "token_totals": lambda s, d: _usage(s, d).agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens")),
    "job_progress": lambda s, d: a.job_progress(table(s, d, "jobs"), _companies(s, d)),
    "people_counts": lambda s, d: _people(s, d).agg(F.count(F.lit(1)).alias("total"), F.count("primary_expertise").alias("analyzed")),
}

_OVERVIEW = """select c.id, c.name, c.url, count(p.id) as people, count(p.id) filter (where p.primary_expertise is not null) as analyzed,
 count(p.id) filter (where p.linkedin_enriched = true) as enriched, count(p.id) filter (where p.image_url is not null) as with_photo
 from companies c left join people p on p.company_id = c.id where c.status = 'completed' group by c.id, c.name, c.url"""
_STATS = """select c.id, count(p.id) as people, count(p.id) filter (where p.primary_expertise is not null) as analyzed,
 count(p.id) filter (where p.linkedin_enriched = true) as enriched, count(p.id) filter (where p.image_url is not null) as photo from companies c left join people p on p.company_id = c.id group by c.id"""
_EVENTS = "(select distinct * from usage_logs)"
_IN_90D = f"created_at at time zone 'UTC' >= timestamp '{AS_OF}' - interval 90 day and created_at at time zone 'UTC' <= timestamp '{AS_OF}'"
_TOP = """select p.{0} as value, count(*) as n from people p join companies c on c.id = p.company_id
 where c.status = 'completed' and p.{0} is not null group by 1 order by n desc, value limit {1}"""
_SPLIT = """with t as (select company_id, trim(unnest(string_split({0}, ';')), ' ') as value from people where {0} is not null),
 c as (select company_id, value, count(*) as n from t group by 1, 2)
 select * from (select *, cast(row_number() over (partition by company_id order by n desc, value) as int) as rank from c) where rank <= 15"""
_COST = "select {0}, cast(coalesce(sum(cast(cost_usd as decimal(18,6))), 0) as decimal(28,6)) as cost, count(*) as calls from {1} group by 1"
_RECENT_SQL = f"(select distinct * from usage_logs where {_IN_90D})"
_BY_COMPANY = """with t as (select company_id, cast(sum(cast(cost_usd as decimal(18,6))) as decimal(28,6)) as cost, count(*) as calls from {0} where company_id is not null group by 1 order by cost desc, company_id limit 50)
 select t.company_id, coalesce(nullif(c.name, ''), c.url) as label, t.cost, t.calls from t left join companies c on c.id = t.company_id"""
_DAILY = "select cast(created_at at time zone 'UTC' as date) as day, cast(sum(cast(cost_usd as decimal(18,6))) as decimal(28,6)) as cost, count(*) as calls from {0} group by 1"
_SUMMARY = """select cast(coalesce(sum(cast(cost_usd as decimal(18,6))), 0) as decimal(28,6)) as cost, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, count(*) as calls
 from {0}"""
_SEARCH = "c.status = 'completed' and (p.name ilike '%director%' or p.title ilike '%director%' or p.primary_expertise ilike '%director%') and p.sector ilike '%bank%'"

SQL = {
    "company_overview": _OVERVIEW,
    "overview_totals": f"select count(*) as companies, cast(coalesce(sum(people),0) as bigint) as people, cast(coalesce(sum(analyzed),0) as bigint) as analyzed, cast(coalesce(sum(enriched),0) as bigint) as enriched, cast(coalesce(sum(with_photo),0) as bigint) as with_photo from ({_OVERVIEW})",
    "company_completeness": "select id, people, " + ", ".join(f"case when people > 0 then cast(round_even({c} * 100.0 / people, 0) as int) else 0 end as {c}_pct" for c in ("analyzed", "enriched", "photo")) + f" from ({_STATS})",
    "worst_completeness": f"select id, people, round(case when people > 0 then cast((analyzed + enriched + with_photo) as double) * 100.0::double / (3 * people) else 0.0::double end, 6) as score from ({_OVERVIEW}) order by score, id limit 20",
    "completeness_bands": "with s as (select id, " + ", ".join(f"case when people > 0 then cast(floor({c} * 100.0::double / people + 0.5) as int) else 0 end as {c}_pct" for c in ("analyzed", "enriched", "with_photo")) + f" from ({_OVERVIEW})) select *, " + ", ".join(f"case when {c}_pct >= 80 then 'good' when {c}_pct >= 50 then 'fair' else 'poor' end as {c}_band" for c in ("analyzed", "enriched", "with_photo")) + " from s",
    "heatmap_intensity": """with k as (select company_id, category, count(*) as n from (select p.company_id, unnest(p.inferred_expertise_functional) as category from people p join companies c on c.id = p.company_id where c.status = 'completed') group by 1, 2)
 select company_id, category, n, round(least(n / (select max(n) from k)::double, 1.0), 9) as intensity from k where category is not null""",
    "category_counts": """with b as (select p.* from people p join companies c on c.id = p.company_id where c.status = 'completed'),
 k as (select category, count(*) as n from (select unnest(inferred_expertise_functional) as category from b) group by 1), t as (select count(primary_expertise) as total from b)
 select category, n, case when total > 0 then floor(n * 1000.0::double / total + 0.5) / 10.0::double else 0.0::double end as pct from k, t""",
    "top_expertise": _TOP.format("primary_expertise", 20),
    "top_sectors_raw": _TOP.format("sector", 15),
    "top_geographies_raw": _TOP.format("geography", 15),
    "sector_split_counts": _SPLIT.format("sector"),
    "geography_split_counts": _SPLIT.format("geography"),
    "category_heatmap": """select company_id, category, count(*) as n from (select p.company_id, unnest(p.inferred_expertise_functional) as category
 from people p join companies c on c.id = p.company_id where c.status = 'completed') group by 1, 2""",
    "top3_categories": """with k as (select company_id, category, count(*) as n from (select company_id, unnest(inferred_expertise_functional) as category from people) where category is not null group by 1, 2)
 select * from (select *, cast(row_number() over (partition by company_id order by n desc, category) as int) as rank from k) where rank <= 3""",
    "skills_matrix": """with x as (
 select company_id, 'category' as kind, unnest(inferred_expertise_functional) as value from people union all select company_id, 'expertise', primary_expertise from people
 union all select company_id, 'sector', trim(unnest(string_split(sector, ';')), ' ') from people union all select company_id, 'geography', trim(unnest(string_split(geography, ';')), ' ') from people)
 select company_id, kind, value, count(*) as n from x where value is not null group by 1, 2, 3""",
    "search_people": f"select p.id, p.name, p.title, p.location, p.image_url, p.linkedin_url, p.primary_expertise, p.inferred_expertise_functional, p.sector, p.geography, p.company_id, c.name as company_name from people p join companies c on c.id = p.company_id where {_SEARCH} order by p.name nulls last, p.id limit 20 offset 20",
    "search_total": f"select count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as pages from people p join companies c on c.id = p.company_id where {_SEARCH}",
    "search_by_category": "select count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as pages from people p join companies c on c.id = p.company_id where c.status = 'completed' and list_contains(p.inferred_expertise_functional, 'Disputes') and p.geography ilike '%europe%'",
    "people_page": "select id, name, title, department, email, location from people where company_id = 3 and (name ilike '%an%' or title ilike '%an%') order by name nulls last, id limit 100",
    "latest_company_per_url": "select id, url, status from (select *, rank() over (partition by url order by created_at desc) as r from companies where url is not null) where r = 1",
    "latest_per_norm_url": "select id, norm_url from (select id, lower(rtrim(url, '/')) as norm_url, row_number() over (partition by lower(rtrim(url, '/')) order by created_at desc, id) as r from companies where url is not null) where r = 1",
    "active_companies": "select id, url, status from companies where status not in ('completed', 'error')",
    "cost_total": f"select cast(coalesce(sum(cast(cost_usd as decimal(18,6))), 0) as decimal(28,6)) as cost from {_EVENTS}",
    "cost_by_service": _COST.format("service", _EVENTS),
    "cost_by_provider": _COST.format("provider", _EVENTS),
    "cost_by_step": _COST.format("pipeline_step", _EVENTS),
    "cost_by_company_top50": _BY_COMPANY.format(_EVENTS),
    "cost_daily": _DAILY.format(_EVENTS),
    "cost_summary_90d": _SUMMARY.format(_RECENT_SQL),
    "cost_summary_90d_company": _SUMMARY.format(_RECENT_SQL) + " where company_id = 3",
    "cost_by_service_90d": _COST.format("service", _RECENT_SQL),
    "cost_by_provider_90d": _COST.format("provider", _RECENT_SQL),
    "cost_by_step_90d": _COST.format("pipeline_step", _RECENT_SQL),
    "cost_by_company_90d": _BY_COMPANY.format(_RECENT_SQL),
    "cost_daily_90d": _DAILY.format(_RECENT_SQL),
    "cost_daily_company": _DAILY.format("(select distinct * from usage_logs where company_id = 3)"),
    "token_totals": f"select cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens from {_EVENTS}",
    "job_progress": """select j.id as job_id, j.total_urls, coalesce(d.companies, 0) as companies, coalesce(d.finished, 0) as finished from jobs j left join
 (select job_id, count(*) as companies, count(*) filter (where status in ('completed', 'error')) as finished from companies group by 1) d on d.job_id = j.id""",
    "people_counts": "select count(*) as total, count(primary_expertise) as analyzed from people",
}
