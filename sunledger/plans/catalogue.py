"""Queries over the test tables, and the SQL that must give the same rows.

The test tables are retail-shaped, so their columns stand in for projects, contacts and referrals;
texts with capacities and technologies are put together from columns, alike in both engines.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import contacts, dedup, directory, enrichment, gates, referrals, runs
from ..operators.staging import spread
from ..sources import parsers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = datetime.date(1998, 8, 2)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_any(column: str, literals: tuple[str, ...]) -> str:
    return f"regexp_matches(lower({column}), '{P.any_of(literals).replace(chr(39), chr(39) * 2)}')"


# Projects out of orders, line items, parts and suppliers.

PROJECTS_SQL = """
select l.l_orderkey * 8 + l.l_linenumber as id,
  concat(p.p_name, case when p.p_size % 7 = 0 then ' Wind' else '' end, ' Solar Farm ', p.p_size * 10, ' MW') as name,
  s.s_name as developer, n.n_name as location, case when p.p_size % 4 = 0 then null else p.p_brand end as epc,
  cast(case when p.p_size % 9 = 0 then 0 else l.l_extendedprice / 10000 end as decimal(10, 2)) as capacity_mw,
  o.o_orderstatus as status, case when p.p_type in ('ECONOMY', 'SMALL', 'STANDARD') then 'AU' when p.p_type = 'LARGE' then 'NZ' else p.p_type end as country,
  cast(o.o_orderdate as date) as announced_date, l.l_linenumber as scan_id,
  case when l.l_linenumber % 2 = 0 then concat('a@', lower(p.p_brand), '.example') end as contact_email
from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey
  join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    rows = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    kind = F.col("p_type")
    return rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.concat("p_name", F.when(F.col("p_size") % 7 == 0, " Wind").otherwise(""), F.lit(" Solar Farm "), F.col("p_size") * 10, F.lit(" MW")).alias("name"),
        F.col("s_name").alias("developer"), F.col("n_name").alias("location"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("epc"),
        F.when(F.col("p_size") % 9 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice") / 10000).cast("decimal(10,2)").alias("capacity_mw"),
        F.col("o_orderstatus").alias("status"), F.when(kind.isin("ECONOMY", "SMALL", "STANDARD"), "AU").when(kind == "LARGE", "NZ").otherwise(kind).alias("country"),
        F.col("o_orderdate").cast("date").alias("announced_date"), F.col("l_linenumber").alias("scan_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("a@"), F.lower("p_brand"), F.lit(".example"))).alias("contact_email"),
    )


PERMANENT_SQL = "name not ilike '%wind%' and country in ('AU', 'NZ') and (capacity_mw = 0 or capacity_mw >= 5)"


@query(f"""with d as ({PROJECTS_SQL}) select id, name, developer, location, country, status, capacity_mw, announced_date from d
where {PERMANENT_SQL} and announced_date >= date '1996-01-01' and announced_date <= date '1999-06-30' and country = 'AU'
and (name ilike '%re%' or developer ilike '%re%' or location ilike '%re%' or epc ilike '%re%') and contact_email is not null""")
def directory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = directory.DirectoryQuery("AU", "re", datetime.date(1996, 1, 1), datetime.date(1999, 6, 30), None, "false")
    return directory.directory_list(projects(spark, sf_dir), asked).select("id", "name", "developer", "location", "country", "status", "capacity_mw", "announced_date")


STATS_SQL = f"""with d as (select * from ({PROJECTS_SQL}) where {PERMANENT_SQL})"""


@query(f"""{STATS_SQL} select count(*) as total, coalesce(sum(capacity_mw), 0)::decimal(38,2) as total_capacity_mw,
count(*) filter (where announced_date >= date '1998-07-26') as recent_count,
count(*) filter (where country = 'AU') as n_au, count(*) filter (where country = 'NZ') as n_nz,
count(*) filter (where status = 'O') as n_open from d""")
def directory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = directory.directory_stats(projects(spark, sf_dir), directory.DirectoryQuery(), TODAY)
    zero = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).cast("long")
    return stats.select("total", "total_capacity_mw", "recent_count", zero(F.col("by_country"), "AU").alias("n_au"), zero(F.col("by_country"), "NZ").alias("n_nz"), zero(F.col("by_status"), "O").alias("n_open"))


@query(f"""{STATS_SQL} select case grouping_id(country, status) when 3 then 'total' when 1 then 'country' else 'status' end as dimension,
coalesce(country, status, '') as value, count(*) as n, coalesce(sum(capacity_mw), 0)::decimal(38,2) as capacity_mw,
count(*) filter (where announced_date >= date '1998-07-26') as recent_count from d group by grouping sets ((), (country), (status))""")
def directory_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.stats_rows(projects(spark, sf_dir), directory.permanent_filters(), TODAY)


@query("select p_partkey, p_name from part where p_name ilike '%r_d%' or p_brand ilike '%r_d%'")
def directory_search_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a visitor's % and _ are wildcards; the pattern is open at both ends
    return table(spark, sf_dir, "part").filter(directory.search_filter("r_d", ("p_name", "p_brand"))).select("p_partkey", "p_name")


@query("""select c_custkey, concat_ws(',', c_custkey::varchar, case when regexp_matches(label, '[,"\\n]') then concat('"', replace(label, '"', '""'), '"') else label end,
coalesce(segment, ''), balance::varchar) as line from (select c_custkey, case when c_custkey % 3 = 0 then concat(c_name, ', "', n_name, '"') else c_name end as label,
nullif(c_mktsegment, 'BUILDING') as segment, c_acctbal::decimal(12,2) as balance from customer join nation on c_nationkey = n_nationkey)""")
def export_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(', "'), "n_name", F.lit('"'))).otherwise(F.col("c_name")).alias("label"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"),
    )
    return directory.csv_lines(rows, ["c_custkey", "label", "segment", "balance"]).select("c_custkey", "line")


# Scans.


@query("""with r as (select event_id as id, event_type as scan_id, user_id as project_id, value > 100 as is_new from events),
f as (select project_id, arg_max(is_new, id) as is_new from r where scan_id = 'click' group by 1)
select c_custkey as id, c_name as name, is_new from customer join f on c_custkey = project_id where c_acctbal >= 5""")
def scan_projects_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("scan_id"), F.col("user_id").alias("project_id"), (F.col("value") > 100).alias("is_new"))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("capacity_mw"), F.lit("none").alias("scan_id"))
    return runs.scan_projects(relations, found, "click").select("id", "name", "is_new")


@query("""with e as (select event_id as ord, case when event_id % 50 = 0 then null else user_id::varchar end as url, event_type <> 'error' as gate_ok, cast(ts as date) as d from events),
s as (select c_custkey::varchar as url, c_custkey as stored_id, date '2024-01-01' + cast(c_custkey % 30 as integer) as stored_date from customer where c_custkey % 5 = 0),
k as (select e.*, stored_id, coalesce(stored_date, d) as eff_date from e left join s using (url)),
p as (select *, gate_ok and eff_date >= date '2024-01-03' and eff_date <= date '2024-01-25' as passes from k),
w as (select *, coalesce(max(case when not gate_ok then 1 else 0 end) over b, 0) = 1 as prior_fail, min(case when passes then ord end) over b as first_pass from p
  window b as (partition by url, case when url is null then ord end order by ord rows between unbounded preceding and 1 preceding))
select ord, passes, url is null or (stored_id is null and not prior_fail and first_pass is null) as is_new,
case when url is null or (stored_id is null and not prior_fail and first_pass is null) then 'new' when prior_fail then 'barred' when stored_id is not null then 'stored' else 'created' end as project_ref from w""")
def scan_dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stored = scan_events(spark, sf_dir)
    bound = lambda d: F.lit(d).cast("date")
    return dedup.scan_dedup(rows, stored, bound("2024-01-03"), bound("2024-01-25")).select("ord", "passes", "is_new", "project_ref")


def scan_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as records of a scan, and customers as what is stored."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.when(F.col("event_id") % 50 != 0, F.col("user_id").cast("string")).alias("source_url"),
        (F.col("event_type") != "error").alias("gate_ok"), F.col("ts").cast("date").alias("announced_date"),
    )
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(
        F.col("c_custkey").cast("string").alias("source_url"), F.col("c_custkey").alias("stored_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).alias("stored_date"),
    )
    return rows, stored


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id) = 1")
def keep_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


SYNTH_SQL = """select p_partkey, p_partkey % 97 as s_suppkey, concat(p_name, case p_size % 6 when 0 then ' Solar Farm and battery' when 1 then ' Wind Farm' when 2 then ' PV plant' when 3 then ' substation'
when 4 then ' Grain storage' else ' Plains' end) as name, concat(case p_size % 5 when 0 then 'Proposed ' when 1 then 'now generating ' when 2 then 'planning approval for ' when 3 then 'Solar ' else '' end,
p_size * 10, case p_size % 4 when 0 then ' MW' when 1 then 'GW' when 2 then ' megawatt' else ',500 MW' end, case p_size % 3 when 0 then ' in NSW' when 1 then ' near USA' else ' Victoria' end,
' by Alpha', case when p_partkey % 97 % 2 = 0 then ' Energy' else ' Solar' end, '; turbine', p_size % 2) as body, case p_size % 4 when 0 then 'Not Approved' when 1 then 'Withdrawn' when 2 then 'Approval in force' end as state
from part"""


def synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")

    def pick(n: int, *values: str | None) -> Column:
        out = F.lit(values[-1])
        for i, v in reversed(list(enumerate(values[:-1]))):
            out = F.when(size % n == i, F.lit(v)).otherwise(out)
        return out

    rows = table(spark, sf_dir, "part").withColumn("s_suppkey", F.col("p_partkey") % 97)
    name = F.concat("p_name", pick(6, " Solar Farm and battery", " Wind Farm", " PV plant", " substation", " Grain storage", " Plains"))
    body = F.concat(
        pick(5, "Proposed ", "now generating ", "planning approval for ", "Solar ", ""), size * 10, pick(4, " MW", "GW", " megawatt", ",500 MW"),
        pick(3, " in NSW", " near USA", " Victoria"), F.lit(" by Alpha"), F.when(F.col("s_suppkey") % 2 == 0, " Energy").otherwise(" Solar"), F.lit("; turbine"), size % 2,
    )
    return rows.select("p_partkey", "s_suppkey", name.alias("name"), body.alias("body"), pick(4, "Not Approved", "Withdrawn", "Approval in force", None).alias("state"))


SYNTH = f"with t as ({SYNTH_SQL})"


@query(f"""{SYNTH} select p_partkey, s_suppkey, nullif(regexp_extract(body, '(\\d+(?:\\.\\d+)?)\\s*(mw|gw|megawatt|gigawatt)', 1, 'i'), '')::double *
case when lower(regexp_extract(body, '(\\d+(?:\\.\\d+)?)\\s*(mw|gw|megawatt|gigawatt)', 2, 'i')) like 'g%' then 1000 else 1 end as mw from t""")
def capacity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth(spark, sf_dir).select("p_partkey", "s_suppkey", X.capacity(F.col("body")).alias("mw"))


@query(f"{SYNTH} select p_partkey, s_suppkey, replace(nullif(regexp_extract(body, '(\\d[\\d,]*(?:\\.\\d+)?)\\s*(?:MW|megawatt)', 1, 'i'), ''), ',', '')::double as mw from t")
def capacity_mw_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth(spark, sf_dir).select("p_partkey", "s_suppkey", X.megawatts(F.col("body")).alias("mw"))


@query(f"{SYNTH} select p_partkey, s_suppkey, list_filter({str(list(P.LOCATIONS['AU']))}, lambda x: contains(body, x))[1] as place from t")
def location_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth(spark, sf_dir).select("p_partkey", "s_suppkey", X.location(F.col("body")).alias("place"))


@query(f"{SYNTH} select p_partkey, s_suppkey, case when {sql_any('body', P.UNDER_DEVELOPMENT)} then 'under_development' else 'announced' end as status from t")
def status_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth(spark, sf_dir).select("p_partkey", "s_suppkey", X.status(F.col("body")).alias("status"))


@query(f"{SYNTH} select p_partkey, s_suppkey, not {sql_any('body', P.EXCLUDE)} and {sql_any('body', P.EARLY_STAGE)} as early from t")
def early_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth(spark, sf_dir).select("p_partkey", "s_suppkey", X.is_early_stage(F.col("body")).alias("early"))


NOISE_SQL = "|".join(P.NOISY_NAMES).replace("\\z", "$") + "|\\b(?:" + P.FOREIGN_PLACES + ")\\b"


@query(f"""{SYNTH} select p_partkey, s_suppkey, length(trim(name)) <= 3 or regexp_matches(name, '{NOISE_SQL}', 'i') as noisy,
regexp_matches(name, 'wind\\b', 'i') or contains(lower(body), 'turbine1') as wind, regexp_matches(concat(name, ' ', body), '\\b(?:solar|photovoltaic|pv)\\b', 'i') as solar,
length(trim(name)) <= 3 or regexp_matches(name, '{NOISE_SQL}', 'i') or not regexp_matches(name, '\\b(?:{P.PROJECT_SHAPE})\\b', 'i') as shapeless from t""")
def noise_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, name = synth(spark, sf_dir), F.col("name")
    wind = X.is_wind(name) | F.lower("body").contains("turbine1")
    return t.select("p_partkey", "s_suppkey", X.is_noisy_name(name).alias("noisy"), wind.alias("wind"), X.has_solar_component(name, F.col("body")).alias("solar"), X.is_noisy_name(name, True).alias("shapeless"))


DEVELOPER_SQL = "(?:by|developer?|developed by|from)\\s+([A-Z][A-Za-z\\s&]+(?:Energy|Solar|Power|Renewables|Green|Clean|Capital|Group|Ltd|Pty|Inc|Corp|Co\\.|Company)?)"


@query(f"""{SYNTH} select p_partkey, s_suppkey, case when length(trim(regexp_extract(body, '{DEVELOPER_SQL}', 1))) between 4 and 59 then trim(regexp_extract(body, '{DEVELOPER_SQL}', 1)) end as developer from t""")
def developer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth(spark, sf_dir).select("p_partkey", "s_suppkey", X.developer(F.col("body")).alias("developer"))


def _has(kind: str) -> str:
    return f"regexp_matches(concat(name, ' ', body), '\\b(?:{P.TECHNOLOGY[kind]})\\b', 'i')"


@query(f"""{SYNTH} select p_partkey, s_suppkey, case when {_has('solar')} and {_has('bess')} then 'Solar + BESS' when {_has('solar')} then 'Solar' when {_has('wind')} and {_has('bess')} then 'Wind + BESS'
when {_has('wind')} then 'Wind' when {_has('bess')} then 'BESS' when {_has('transmission')} then 'Transmission' when {_has('renewable')} then 'Renewable (unclassified)' else 'Unknown' end as technology_type,
case when {_has('solar')} then 'solar' when {_has('wind')} then 'wind' when {_has('bess')} then 'bess' when {_has('transmission')} then 'transmission' else 'needs_review' end as relevance_status, {_has('renewable')} as is_renewable from t""")
def classify_technology(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = X.technology_flags(F.col("name"), F.col("body"))
    t = synth(spark, sf_dir).withColumns({f"_{k}": v for k, v in flags.items()})  # each pattern once a row
    kinds = X.technology_of({k: F.col(f"_{k}") for k in flags})
    return t.select("p_partkey", "s_suppkey", *(kinds[k].alias(k) for k in ("technology_type", "relevance_status", "is_renewable")))


@query(f"""{SYNTH} select p_partkey, s_suppkey, {sql_any("concat(coalesce(state, ''), ' ')", P.APPROVED)} as approved,
{sql_any("concat(coalesce(state, ''), ' ')", P.APPROVED)} and not {sql_any("concat(coalesce(state, ''), ' ')", P.REJECTED)} as approved_strict from t""")
def classify_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, none = F.col("state"), F.lit(None).cast("string")
    return synth(spark, sf_dir).select("p_partkey", "s_suppkey", X.is_approved(state, none).alias("approved"), X.is_approved(state, none, True).alias("approved_strict"))


@query(f"""{SYNTH} select p_partkey, s_suppkey, coalesce(not (length(trim(name)) <= 3 or regexp_matches(name, '{NOISE_SQL}', 'i')) and nullif(regexp_extract(body, '(\\d+(?:\\.\\d+)?)\\s*(mw|gw|megawatt|gigawatt)', 1, 'i'), '') is not null
and not (regexp_matches(name, 'wind\\b', 'i') or contains(lower(body), 'turbine')) and regexp_matches(concat(name, ' ', body), '\\b(?:solar|photovoltaic|pv)\\b', 'i'), false) as gate_ok
from (select p_partkey, s_suppkey, name, replace(body, 'turbine1', '') as body from t)""")
def scan_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = synth(spark, sf_dir).withColumn("body", F.replace("body", F.lit("turbine1"), F.lit("")))
    return t.select("p_partkey", "s_suppkey", gates.gate_ok(F.col("name"), F.col("body"), F.lit("AU"), X.capacity(F.col("body"))).alias("gate_ok"))


# Pages.

TEXT_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[\s\S]*?</script>|<style[\s\S]*?</style>', ' ', 'gi'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"select page_id, {TEXT_SQL} as body from pages")
def html_text_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("body"))


def _cells_sql(tag: str, out: str) -> str:
    return f"""select page_id, (i - 1)::int as pos, trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as {out}
from (select page_id, unnest(regexp_extract_all(html, '{tag}', 1)) as x, generate_subscripts(regexp_extract_all(html, '{tag}', 1), 1) as i from pages)"""


@query(_cells_sql("(?is)(<h[1-6][^>]*>.*?</h[1-6]>)", "heading"))
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.html_headings(table(spark, sf_dir, "pages")).select("page_id", "pos", "heading")


@query(_cells_sql("(?is)<li[^>]*>(.*?)</li>", "item"))
def html_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.html_list_items(table(spark, sf_dir, "pages")).select("page_id", "pos", "item")


@query("select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') as host from pages")
def page_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.host(F.col("url")).alias("host"))


EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
EMAILS_SQL = f"select doc_id, unnest(regexp_extract_all({TEXT_SQL.replace('html', 'text')}, '{EMAIL}')) as e from documents where contains(text, '@')"


@query(f"select doc_id, lower(e) as email, count(*) as n from ({EMAILS_SQL}) group by 1, 2")
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").contains("@"))
    return docs.select("doc_id", F.explode(X.emails(F.col("text"))).alias("email")).groupBy("doc_id", "email").agg(F.count(F.lit(1)).alias("n"))


# Contacts.

COMPANY_SQL = "concat(p_brand, case p_size % 6 when 0 then ' Pty Ltd' when 1 then ' Energy Group' when 2 then ' Holdings Limited' when 3 then ' Co.' when 4 then ' Solar Australia' else ' & Sons' end)"


def company(size: Column) -> Column:
    ends = F.array(*(F.lit(x) for x in (" Pty Ltd", " Energy Group", " Holdings Limited", " Co.", " Solar Australia", " & Sons")))
    return F.concat("p_brand", F.get(ends, size % 6))


def _company_key_sql(c: str) -> str:
    for suffix in P.COMPANY_SUFFIXES:
        c = f"regexp_replace({c}, '\\s+{suffix}\\s*$', '')"
    return f"regexp_replace({c}, '[^a-z0-9]', '', 'g')"


@query(f"""select p_partkey, {_company_key_sql(f'lower({COMPANY_SQL})')} as company_key,
trim(regexp_replace(regexp_replace(regexp_replace(lower({COMPANY_SQL}), '\\b(?:{P.CONTACT_STOP_WORDS})\\b', '', 'g'), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) as contact_key from part""")
def company_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("c", company(F.col("p_size")))
    return parts.select("p_partkey", X.company_key(F.col("c")).alias("company_key"), X.contact_key(F.col("c")).alias("contact_key"))


MATCH_SQL = f"""with dv as (select distinct concat(p_name, case when p_size % 3 = 0 then ' Pty Ltd' when p_size % 3 = 1 then ' Energy' else '' end) as developer from part),
og as (select p_partkey as ord, concat(split_part(p_name, ' ', 2), case p_size % 4 when 0 then ' Group' when 1 then concat(' ', split_part(p_name, ' ', 1)) when 2 then ' works extra' else '' end) as organization_name from part ),
n1 as (select developer, trim(regexp_replace(regexp_replace(regexp_replace(lower(developer), '\\b(?:{P.CONTACT_STOP_WORDS})\\b', '', 'g'), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) as dn from dv),
n2 as (select *, trim(regexp_replace(regexp_replace(regexp_replace(lower(organization_name), '\\b(?:{P.CONTACT_STOP_WORDS})\\b', '', 'g'), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) as gn from og),
s as (select developer, organization_name, ord, case when dn = gn then 100.0 when contains(dn, gn) or contains(gn, dn) then 80.0 else
 len(list_filter(list_filter(string_split(dn, ' '), lambda w: length(w) >= 3), lambda w: list_contains(list_filter(string_split(gn, ' '), lambda v: length(v) >= 3), w)))
 / greatest(len(list_filter(string_split(dn, ' '), lambda w: length(w) >= 3)), len(list_distinct(list_filter(string_split(gn, ' '), lambda w: length(w) >= 3))), 1) * 60 end::double as score from n1, n2 where dn <> '' and gn <> '')
select developer, organization_name as contact_name, concat('c', ord, '@org.example') as contact_email, round(score, 3) as score from s
qualify row_number() over (partition by developer order by score desc, ord) = 1 and score >= 40"""


@query(MATCH_SQL)
def contact_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contact_top1(spark, sf_dir)


def _contact_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, size = table(spark, sf_dir, "part"), F.col("p_size")
    devs = parts.select(F.concat("p_name", F.when(size % 3 == 0, " Pty Ltd").when(size % 3 == 1, " Energy").otherwise("")).alias("developer"))
    second, first = F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))
    end = F.when(size % 4 == 0, " Group").when(size % 4 == 1, F.concat(F.lit(" "), first)).when(size % 4 == 2, " works extra").otherwise("")
    none = F.lit(None).cast("string")
    orgs = parts.select(
        F.col("p_partkey").alias("ord"), F.concat(second, end).alias("organization_name"), none.alias("first_name"), none.alias("last_name"),
        F.concat(F.lit("c"), "p_partkey", F.lit("@org.example")).alias("email1"),
    )
    return contacts.match_contacts(devs, orgs).withColumn("score", F.round("score", 3))


@query("""with u as (select lower(trim(concat('U', c_custkey % 700, '@X.example '))) as email, c_name as name, c_mktsegment as company, null::varchar as phone, 0 as f, c_custkey as ord from customer
union all select lower(trim(concat('u', s_suppkey * 3, '@x.example'))), s_name, 'supplier', concat('+61 ', s_suppkey), 1, s_suppkey from supplier)
select email, name, company, phone from u where contains(email, '@') qualify row_number() over (partition by email order by f, ord) = 1""")
def union_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("U"), F.col("c_custkey") % 700, F.lit("@X.example ")).alias("email"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("company"), F.col("c_custkey").alias("ord")
    )
    second = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("u"), F.col("s_suppkey") * 3, F.lit("@x.example")).alias("email"), F.col("s_name").alias("name"), F.lit("supplier").alias("company"),
        F.concat(F.lit("+61 "), "s_suppkey").alias("phone"), F.col("s_suppkey").alias("ord"),
    )
    return contacts.union_contacts([first, second]).select("email", "name", "company", "phone")


RELATED_SQL = f"""with t as (select p_partkey, {COMPANY_SQL} as company, case p_size % 5 when 0 then concat('jo@', lower(replace(p_brand, '#', '')), '.com.au') when 1 then 'info@brand.example' when 2 then 'x@bpl.example' when 3 then 'y@gmail.com' else 'z@brandnew.co' end as email from part),
d as (select *, split_part(email, '@', 2) as domain, lower(company) as low from t),
e as (select *, list_filter(string_split_regex(regexp_replace(low, '[^a-z0-9]', ' ', 'g'), '\\s+'), lambda w: w <> '') as words, regexp_replace(low, '[^a-z0-9]', '', 'g') as slug,
 regexp_replace(regexp_replace(domain, '\\.[^.]+$', ''), '[^a-z0-9]', '', 'g') as root from d),
f as (select *, list_filter(words, lambda w: length(w) >= 2 and w not in {sql_list(P.COMMON_COMPANY_WORDS)}) as rare, list_aggregate(list_transform(words, lambda w: left(w, 1)), 'string_agg', '') as acronym from e),
g as (select *, len(list_filter(rare, lambda w: contains(domain, w))) > 0 or (length(slug) >= 3 and contains(domain, slug)) or (length(root) >= 3 and contains(slug, root))
 or len(list_filter(list_filter(rare, lambda w: length(w) >= 4), lambda w: len(list_filter(range(1, greatest(length(w) - 2, 1)), lambda i: length(root) >= 4 and contains(root, substr(w, i::int, 4)))) > 0)) > 0
 or (length(acronym) >= 2 and contains(domain, acronym)) as related from f)
select p_partkey, related, related and not regexp_matches(domain, '(?:{P.any_of(P.INVALID_DOMAINS)})$') and not regexp_matches(email, '^(?:{P.GENERIC_MAILBOX})@', 'i') as valid from g"""


@query(RELATED_SQL)
def email_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    email = F.when(size % 5 == 0, F.concat(F.lit("jo@"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".com.au"))).when(size % 5 == 1, "info@brand.example").when(size % 5 == 2, "x@bpl.example").when(size % 5 == 3, "y@gmail.com").otherwise("z@brandnew.co")
    t = table(spark, sf_dir, "part").select("p_partkey", company(size).alias("company"), email.alias("email"))
    return t.select("p_partkey", X.email_related(F.col("email"), F.col("company")).alias("related"), X.valid_project_contact(F.col("email"), F.col("company")).alias("valid"))


# Referrals.


@query("""with s as (select o_orderkey as k, o_orderstatus as a, o_orderpriority as b from orders where o_orderdate < timestamp '1998-01-01'),
i as (select case when o_orderkey % 3 = 0 then o_orderkey - 1 else o_orderkey end as k, concat('new', o_orderstatus) as a, o_orderpriority as b, o_orderkey as ord from orders where o_orderkey % 2 = 0),
f as (select k, arg_min(b, ord) as b, arg_max(a, ord) as a from i group by k)
select coalesce(s.k, f.k) as k, coalesce(f.a, s.a) as a, case when s.k is not null then s.b else f.b end as b,
case when s.k is null then 'inserted' when f.k is not null then 'updated' else 'unchanged' end as action from s full outer join f on s.k = f.k""")
def referral_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    stored = orders.filter("o_orderdate < timestamp_ntz '1998-01-01 00:00:00'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    key = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    came = orders.filter("o_orderkey % 2 = 0").select(key.alias("k"), F.concat(F.lit("new"), "o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_orderkey").alias("ord"))
    return referrals.upsert(stored, came, "k", ("a",), ["ord"])


@query(f"""with r as (select o_orderkey as ord, case when o_orderkey % 11 = 0 then '' else concat(' Customer#', lpad((o_custkey * 2)::varchar, 9, '0')) end as name,
case o_orderkey % 5 when 0 then 'Project Lapsed' else 'Open' end as status from orders),
k as (select *, lower(trim(name)) as key, status in {sql_list(P.SKIPPED_STATUSES)} as skip, lower(trim(name)) in (select lower(c_name) from customer where c_custkey % 3 = 0) as known from r)
select ord, case when key = '' then 'no_name' when skip then 'skipped' when not known and row_number() over (partition by key, skip, known order by ord) = 1 then 'inserted' else 'duplicate' end as label from k""")
def import_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.concat(F.lit(" Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), name.alias("name"), F.when(F.col("o_orderkey") % 5 == 0, "Project Lapsed").otherwise("Open").alias("status"))
    known = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_name").alias("name"))
    return referrals.import_labels(rows, known, "ord", "name", "status", "ord").select("ord", "label")


# Enrichment and runs.


@query("""with g as (select coalesce(nullif(lower(trim(case when user_id % 10 = 0 then '' else concat(' Dev', user_id % 40) end)), ''), concat('id:', event_id)) as group_key, event_id,
case when event_type = 'click' then concat('host', user_id % 7, '.example') end as domain, case when event_type = 'view' then concat('n', event_id % 5) end as name from events)
select group_key, count(*) as n_projects, min(event_id) as first_project, arg_min(domain, event_id) filter (where domain is not null) as domain, arg_min(name, event_id) filter (where name is not null) as existing_name from g group by 1""")
def enrichment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.lit(" Dev"), F.col("user_id") % 40)).alias("developer"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("a@host"), F.col("user_id") % 7, F.lit(".example"))).alias("contact_email"), F.lit(None).cast("string").alias("source_url"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("n"), F.col("event_id") % 5)).alias("contact_name"),
    )
    return enrichment.enrichment_summary(e)


@query("""select o_custkey as group_key, o_orderkey as pos, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as phase from orders
qualify row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end, o_orderkey) = 1""")
def phase_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_key"), F.col("o_orderkey").alias("pos"), phase.alias("phase"))
    return enrichment.cascade(found, ["phase", "pos"])


@query("""with e as (select user_id, list({'email': concat('e', event_id), 'type': case event_type when 'click' then 'work' else 'personal' end, 'confidence': case when value > 20 then 'A+' else 'B' end} order by event_id) as m from events where event_type in ('click', 'view') group by 1)
select user_id, coalesce(list_filter(m, lambda x: x.type = 'work' and x.confidence = 'A+')[1].email, list_filter(m, lambda x: x.type = 'work')[1].email, m[1].email) as email from e""")
def best_email_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    one = F.struct("event_id", F.concat(F.lit("e"), "event_id").alias("email"), F.when(F.col("event_type") == "click", "work").otherwise("personal").alias("type"), F.when(F.col("value") > 20, "A+").otherwise("B").alias("confidence"))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("m")).select("user_id", enrichment.best_email(F.col("m")).alias("email"))


TITLES = ("Business Development Lead", "Head of Projects", "CEO", "General Manager", "Analyst", "Project Manager", "Deputy CEO")


@query(f"""with t as (select c_nationkey, c_custkey, {list(TITLES)}[(c_custkey % 7 + 1)::int] as title from customer where c_custkey % 13 <> 0),
s as (select *, case {' '.join(f"when regexp_matches(title, '{p.replace(chr(92) + 'z', '$')}', 'i') then {v}" for p, v in P.TITLE_SCORES)} else 1 end as title_score from t)
select c_nationkey, c_custkey, title, title_score from s qualify row_number() over (partition by c_nationkey order by title_score desc, c_custkey) = 1""")
def title_rank_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(
        "c_nationkey", "c_custkey", F.get(F.array(*(F.lit(t) for t in TITLES)), (F.col("c_custkey") % 7).cast("int")).alias("title"),
        F.when(F.col("c_custkey") % 13 == 0, "").otherwise("A").alias("first_name"), F.lit("B").alias("last_name"),
    )
    return enrichment.best_by_title(people, "c_nationkey", "title", "c_custkey").select("c_nationkey", "c_custkey", "title", "title_score")


@query("select event_id, (props->>'$.k')::int as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as the items of a model's answer, prose and fences around them
    answers = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Here it is:\n```json\n["), "props", F.lit("]\n```\n")).alias("content"))
    return parsers.answer_items(answers, "k int").select("event_id", "item.k")


@query("""select user_id, arg_max(event_type, event_id) as status, max(event_id) as at from events group by 1""")
def run_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("at"))
    return runs.latest(log, "user_id", "at").select("user_id", "status", "at")


@query("select event_id, case when event_type = 'view' then 'failed' else event_type end as status, case when event_type = 'view' then 'Interrupted by a restart' end as error_message from events")
def stale_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"), F.lit(None).cast("string").alias("error_message"))
    return runs.recover(log)


# Parsers over texts put together from columns.


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, dealt over tasks, for texts that are put together from them."""
    return spread(table(spark, sf_dir, "part"), "p_partkey")


def _landed(df: DataFrame, content: Column) -> DataFrame:
    return df.select(F.lit("s").alias("source"), F.concat(F.lit("https://x.example/"), "p_partkey").alias("url"), F.col("p_partkey").alias("ord"), content.alias("content"))


@query("""with r as (select p_partkey as ord, 0 as pos, concat(p_name, case when p_size % 2 = 0 then ' solar' else ' wind' end) as name, concat('https://x.example/', p_partkey, '/a') as source_url,
  concat('Plans by Alpha Energy in Victoria, ', p_size * 10, ' MW') as description, case when p_size % 5 = 0 then null else date '2024-01-02' end as d from part
union all select p_partkey, 1, concat(p_name, ' photovoltaic'), concat('https://x.example/', p_partkey, '/b'), case when p_size % 3 = 0 then 'now generating' else 'resource consent' end, date '2024-02-03' from part
union all select p_partkey, 2, concat(p_name, ' solar late'), 'https://x.example/c', 'soon', date '2025-02-03' from part union all select p_partkey, 3, concat(p_name, ' solar linkless'), '', 'soon', date '2024-02-03' from part)
select ord, pos, name, source_url, description, d as announced_date, case when pos = 0 then nullif(regexp_extract(description, '(\\d+) MW', 1), '')::double end as capacity_mw, case when pos = 0 then 'Victoria' end as location,
case when pos = 1 then 'under_development' else 'announced' end as status from r
where contains(name, 'solar') and pos <> 3 and d <= date '2024-12-31' or pos = 1 and description = 'resource consent'""")
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    # tags with attributes, an item that generates, one after the window, one without date, one without link
    size, link = F.col("p_size"), F.concat(F.lit("https://x.example/"), "p_partkey")
    item = lambda title, url, text, day: F.concat(F.lit("<item><title type='html'><![CDATA["), title, F.lit("]]></title><link rel='self'>"), url, F.lit("</link><description><![CDATA[<p>"), text, F.lit("</p>]]></description>"), day, F.lit("</item>\n"))
    day = lambda text: F.lit(f"<pubDate zone='utc'>{text} 10:00:00 GMT</pubDate>")
    one = item(F.concat("p_name", F.when(size % 2 == 0, " solar").otherwise(" wind")), F.concat(link, F.lit("/a")), F.concat(F.lit("Plans by Alpha Energy in <b>Victoria</b>, "), size * 10, F.lit(" MW")), F.when(size % 5 != 0, day("Tue, 02 Jan 2024")).otherwise(""))
    two = item(F.concat("p_name", F.lit(" photovoltaic")), F.concat(link, F.lit("/b")), F.when(size % 3 == 0, "now generating").otherwise("resource consent"), day("Sat, 03 Feb 2024"))
    three = item(F.concat("p_name", F.lit(" solar late")), F.lit("https://x.example/c"), F.lit("soon"), day("Mon, 03 Feb 2025"))
    four = item(F.concat("p_name", F.lit(" solar linkless")), F.lit(""), F.lit("soon"), day("Sat, 03 Feb 2024"))
    feeds = _landed(landing(spark, sf_dir), F.concat(F.lit("<rss>"), one, two, three, four, F.lit("</rss>")))
    found = parsers.rss_items(feeds, F.lit("2024-01-01").cast("date"), F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date"))
    return found.withColumn("description", F.replace("description", F.lit(" ,"), F.lit(","))).select("ord", "pos", "name", "source_url", "description", "announced_date", "capacity_mw", "location", "status")


@query("""select p_partkey as ord, 2 as pos, p_name as name, (p_size * 10)::double as capacity_mw from part
union all select p_partkey, 3, case when p_size % 2 = 0 then concat(p_size, ' MW solar') else concat('X', p_size) end, p_size::double from part where p_size % 2 = 0 or p_size % 4 = 1""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    blank = F.when(size % 2 == 0, F.concat(F.lit("| | "), size, F.lit(" MW solar | y |"))).when(size % 4 == 1, F.concat(F.lit("| X"), size, F.lit(" | "), size, F.lit("MW |"))).otherwise("| only name | none |")
    rows = F.concat(F.lit("| Project | Capacity | z |\n|---|---|---|\n| [**"), "p_name", F.lit("**](http://a) | "), size * 10, F.lit(" MW | q |\n"), blank, F.lit("\n"))
    return parsers.markdown_tables(_landed(landing(spark, sf_dir), F.concat(F.lit("intro\n\n"), rows, F.lit("\nend")))).select("ord", "pos", "name", "capacity_mw")


@query("select p_partkey as ord, p_name as name, p_size::double as capacity_mw from part where length(p_name) >= 5")
def markdown_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("- **"), "p_name", F.lit("** - "), "p_size", F.lit(" MW proposed\n* "), "p_name", F.lit(" 7 MW\n- no figure here"))
    return parsers.markdown_bullets(_landed(landing(spark, sf_dir), text)).select("ord", "name", "capacity_mw")


@query("""select p_partkey as ord, case p_size % 3 when 0 then p_name else concat(p_name, ' Ridge') end as name, p_brand as developer, (p_size * 10)::double as capacity_mw from part where p_size % 3 <> 2
union all select p_partkey, concat(p_name, ' Ridge'), p_brand, (p_size * 10)::double from part where p_size % 3 = 2""")
def captured_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    row = F.create_map(F.lit("id"), F.col("p_partkey").cast("string"), F.lit("Project Name"), F.when(size % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" Ridge"))), F.lit("Developer"), F.col("p_brand"), F.lit("Size"), F.concat(size * 10, F.lit(" MW")))
    docs = landing(spark, sf_dir).select(F.col("p_partkey").alias("ord"), F.create_map(F.lit("l"), F.array(row)).alias("lists"))
    return parsers.captured_lists(docs).select("ord", "name", "developer", "capacity_mw")


# Listed rows: every gate has rows that it alone rejects.

LISTED = {
    "name": "case p_partkey % 8 when 1 then concat(p_name, ' Plains') when 4 then 'PV 1' when 5 then concat('Our solar farm ', p_name) when 6 then concat(p_name, ' Solarium') else concat(p_name, ' Solar Farm') end",
    "size": "case p_partkey % 8 when 3 then 'tba' else concat(p_size * 10, ' MW') end",
    "note": "case p_partkey % 8 when 2 then 'Now operating' when 4 then 'solar' when 7 then 'PV' else 'scoping' end",
}
LISTED_SQL = "with t as (select p_partkey as ord, case when p_partkey % 8 <> 3 then (p_size * 10)::double end as mw, " + ", ".join(f"{v} as {k}" for k, v in LISTED.items()) + " from part)"
LISTED_GATES_SQL = f"""(contains(lower(text), 'solar') or contains(lower(text), 'photovoltaic') or contains(lower(text), ' pv ')) and not {sql_any('text', P.EXCLUDE)} and mw is not null
and length(name) >= 5 and not regexp_matches(name, '{NOISE_SQL}', 'i') and regexp_matches(concat(name, ' ', text), '\\b(?:solar|photovoltaic|pv)\\b', 'i')"""
DAY_ONE = datetime.date(2024, 1, 1)


def listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    return landing(spark, sf_dir), [F.expr(LISTED[k]) for k in ("name", "size", "note")]


@query(f"""{LISTED_SQL}, r as (select ord, 0 as table_pos, name, mw, concat(name, ' ', size, ' ', note) as text from t union all select ord, 1, name, mw, concat(name, ' ', note, ' ', size) from t)
select ord, table_pos, name, mw as capacity_mw from r where {LISTED_GATES_SQL}""")
def table_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the second table has no column of names
    parts, (name, size, note) = listed(spark, sf_dir)
    cells = lambda a, b, c: F.concat(F.lit("| "), a, F.lit(" | "), b, F.lit(" | "), c, F.lit(" |\n"))
    text = F.concat(F.lit("| Project | Capacity | Stage |\n|---|---|---|\n"), cells(name, size, note), F.lit("\n| Site | Stage | Size |\n|---|---|---|\n"), cells(name, note, size))
    return parsers.table_projects(_landed(parts, text), F.lit(DAY_ONE)).select("ord", "table_pos", "name", "capacity_mw")


@query(f"""{LISTED_SQL}, r as (select ord, 0 as pos, name, mw, concat(name, ' - ', size, ' - ', note) as text from t union all select ord, 1, name, 7, concat(name, ' - 7 MW') from t)
select ord, pos, name, mw as capacity_mw from r where {LISTED_GATES_SQL} qualify row_number() over (partition by ord, lower(name) order by pos) = 1""")
def bullet_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the second bullet has the first one's name: it stays where a gate rejects the first
    parts, (name, size, note) = listed(spark, sf_dir)
    text = F.concat(F.lit("- **["), name, F.lit("](http://a)** - "), size, F.lit(" - "), note, F.lit("\n* "), name, F.lit(" - 7 MW\n"))
    return parsers.bullet_projects(_landed(parts, text), F.lit(DAY_ONE)).select("ord", "pos", "name", "capacity_mw")


@query(f"""{LISTED_SQL}, r as (select ord, name, mw, concat(name, ' ', size, ' ', note) as text from t) select ord, name, mw as capacity_mw from r where {LISTED_GATES_SQL}""")
def captured_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, (name, size, note) = listed(spark, sf_dir)
    row = F.create_map(F.lit("Project Name"), name, F.lit("Size"), size, F.lit("Stage"), note)
    docs = parts.select(F.col("p_partkey").alias("ord"), F.create_map(F.lit("l"), F.array(row)).alias("lists"))
    return parsers.captured_projects(docs, F.lit(DAY_ONE)).select("ord", "name", "capacity_mw")


@query("""with r as (select p_partkey as ord, case when p_size % 7 = 1 then 'PV ' else concat(p_name, ' & Sons Solar Farm ', p_size, ' MW') end as name, case when p_size % 2 = 0 then 'Added to list' when p_size % 5 = 0 then 'Being assessed' else 'Built' end as m,
case when p_size % 3 = 0 then 'NZ' else 'NSW' end as place, p_brand as dev, case when p_size % 4 = 0 then 'a turbine site' when p_size % 4 = 1 then 'near town' else '' end as about, p_size from part)
select ord, name, p_size::double as capacity_mw, case when place = 'NZ' then 'NZ' else 'AU' end as country, place as location, dev as developer, case when m = 'Being assessed' then 'under_development' else 'announced' end as status,
case when about = '' then concat(name, ' ') else about end as description, date '2024-05-06' as announced_date from r where m <> 'Built' and not contains(about, 'turbine') and p_size >= 5 and length(name) > 3""")
def newsletter_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a short name, a built project, a turbine in the description, a small one, header rows, rows outside tables
    size = F.col("p_size")
    name = F.when(size % 7 == 1, "PV").otherwise(F.concat("p_name", F.lit(" &amp; Sons&nbsp;Solar Farm "), size, F.lit(" MW")))
    state = F.when(size % 2 == 0, "Added to list").when(size % 5 == 0, "Being assessed").otherwise("Built")
    about = F.when(size % 4 == 0, "a turbine site").when(size % 4 == 1, "near town").otherwise("")
    row = F.concat(F.lit("<tr><td><b>"), name, F.lit("</b></td><td>"), state, F.lit("</td><td>"), F.when(size % 3 == 0, "NZ").otherwise("NSW"), F.lit("</td><td>"), "p_brand", F.lit("</td><td>"), about, F.lit("</td></tr>"))
    head = F.lit("<table class='x'><tr><th>Project</th><th>proposed</th><th>State</th><th>x</th><th>solar 9 MW</th></tr><tr><th>Country</th><th>proposed</th><th>State</th><th>x</th><th>solar 9 MW</th></tr>")
    found = parsers.milestone_rows(_landed(landing(spark, sf_dir), F.concat(head, row, F.lit("</table>"), row)), F.lit("2024-05-06").cast("date"))
    return found.select("ord", "name", "capacity_mw", "country", "location", "developer", "status", "description", "announced_date")


@query("""with r as (select p_partkey as ord, 1 as pos, concat(p_name, ' Solar Farm') as name, case when p_size >= 5 then p_size::double end as capacity_mw, p_size % 3 = 0 as over from part
union all select p_partkey, 2, 'Total capacity', 900, false from part union all select p_partkey, 4, 'Two figures', 10000, false from part
union all select p_partkey, 6, 'Solar plant without a name of its own, 30 MW', 30, false from part)
select ord, pos, name, capacity_mw, 'NSW' as location, date '2024-06-07' as announced_date from r where capacity_mw is not null and not over""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each section but the good ones is dropped by one rule alone: nothing but a market's figure, no date in the window
    size, far = F.col("p_size"), "x" * 90
    one = F.concat(F.lit("intro\n## **"), "p_name", F.lit(" Solar Farm**\nA solar plant of "), size, F.when(size >= 5, " MW").otherwise(" acres"), F.when(size % 3 == 0, " now generating").otherwise(""), F.lit(" in NSW, June 7, 2024"))
    rest = (
        "\n## Total capacity\nsolar pipeline of 900 MW nationwide, NSW, June 7, 2024\n## Of the market\n10 GW cumulative large-scale solar, NSW, June 7, 2024"
        f"\n## Two figures\n10 GW total solar {far} and a plant of 20 MW, NSW, June 7, 2024\n## Undated one\nsolar 40 MW, NSW\n# abc\nSolar plant without a name of its own, 30 MW\nNSW, June 7, 2024"
        "\n## Too late solar\n40 MW, NSW, June 7, 2025"
    )
    bound = lambda d: F.lit(d).cast("date")
    found = parsers.markdown_sections(_landed(landing(spark, sf_dir), F.concat(one, F.lit(rest))), F.lit(DAY_ONE), bound("2024-01-01"), bound("2024-12-31"))
    return found.select("ord", "pos", "name", "capacity_mw", "location", "announced_date")


@query("select p_partkey as ord, p_name as name from part")
def snapshot_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = b"k3y"
    hexes = lambda c: F.transform(F.sequence(F.lit(0), F.length(c) - 1), lambda i: F.lpad(F.hex(F.ascii(F.substr(c, i + 1, F.lit(1))).bitwiseXOR(F.get(F.array(*(F.lit(k) for k in key)), i % len(key))).cast("long")), 2, "0"))
    coded = landing(spark, sf_dir).select(F.col("p_partkey").alias("ord"), F.base64(F.unhex(F.array_join(hexes(F.to_json(F.struct("p_name"))), ""))).alias("content"))
    return coded.select("ord", F.get_json_object(parsers.decode_snapshot(F.col("content"), key), "$.p_name").alias("name"))


# A scan from landed pages to new projects: parser, gates, date window, stored URLs, deduplication.


@query(f"""{LISTED_SQL}, r as (select *, concat(name, ' ', size, ' ', note) as text, concat('https://x.example/', ord % 100) as url from t),
e as (select r.*, coalesce(k.d, date '2024-01-01' + (ord % 30)::int) as eff, k.id from r left join
  (select concat('https://x.example/', s_suppkey) as u, s_suppkey as id, date '2024-01-01' + (s_suppkey % 30)::int as d from supplier where s_suppkey % 3 = 0) k on k.u = r.url where {LISTED_GATES_SQL}),
g as (select *, not (regexp_matches(name, 'wind\\b', 'i') or contains(lower(text), 'turbine')) as gate_ok from e),
p as (select *, gate_ok and eff between date '2024-01-03' and date '2024-01-25' as passes from g)
select ord, name, mw as capacity_mw, passes, case when coalesce(max(case when not gate_ok then 1 end) over b, 0) = 1 then 'barred' when id is not null then 'stored'
when min(case when passes then ord end) over b is not null then 'created' else 'new' end as project_ref from p window b as (partition by url order by ord rows between unbounded preceding and 1 preceding)""")
def scan_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, (name, size, note) = listed(spark, sf_dir)
    row = F.create_map(F.lit("Project Name"), name, F.lit("Size"), size, F.lit("Stage"), note)
    docs = parts.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("https://x.example/"), F.col("p_partkey") % 100).alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 30).cast("int")).alias("day"), F.create_map(F.lit("l"), F.array(row)).alias("lists"))
    found = gates.with_gates(parsers.captured_projects(docs, F.col("day")).withColumn("country", F.lit("AU")))
    key = F.col("s_suppkey")
    stored = table(spark, sf_dir, "supplier").filter(key % 3 == 0).select(F.concat(F.lit("https://x.example/"), key).alias("source_url"), key.alias("stored_id"), F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int")).alias("stored_date"))
    bound = lambda d: F.lit(d).cast("date")
    return dedup.scan_dedup(found, stored, bound("2024-01-03"), bound("2024-01-25")).select("ord", "name", "capacity_mw", "passes", "project_ref")


@query(f"""with d as (select id, name, developer, location, country, status, capacity_mw, announced_date from ({PROJECTS_SQL}) where {PERMANENT_SQL}) select developer, country, count(*) as n, sum(capacity_mw)::decimal(38,2) as capacity_mw, max(announced_date) as latest from d group by 1, 2""")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projects(spark, sf_dir).filter(directory.permanent_filters())
    return rows.groupBy("developer", "country").agg(F.count(F.lit(1)).alias("n"), F.sum("capacity_mw").cast("decimal(38,2)").alias("capacity_mw"), F.max("announced_date").alias("latest"))
