"""Further queries over the test tables: the referral screen and its uploads, contacts, scans with several
sources, and functions on texts whose results are written down by hand."""

from __future__ import annotations

import datetime
import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import contacts, dedup, directory, enrichment, gates, numbering, referrals, runs, search, sinks, statistics
from ..operators.staging import run_folder, spread, stage
from ..operators.versions import VersionedTable
from ..sources import parsers, workbooks
from ..streaming import portal, scan
from .catalogue import DAY_ONE, LISTED, LISTED_GATES_SQL, LISTED_SQL, MATCH_SQL, ORACLE_SQL, PERMANENT_SQL, PROJECTS_SQL, TODAY, _contact_top1, _landed, landing, listed, projects, query, scan_events, sql_any, table

# Referrals out of parts.

REFERRALS_SQL = """select p_partkey as id, concat(2018 + p_size % 5, '/', p_partkey) as epbc_number, concat(p_name, ' Solar Farm') as project_name, p_brand as proponent,
case p_size % 4 when 0 then 'NSW' when 1 then 'VIC' when 2 then 'QLD' end as state, case p_size % 3 when 0 then 'Solar' when 1 then 'Wind' else '' end as technology_type,
case when p_size % 5 = 0 then 'needs_review' else 'solar' end as relevance_status, p_size % 2 = 0 as is_approved,
case when p_size % 6 <> 0 then strftime(date '2020-01-01' + (p_partkey % 900)::int, '%Y-%m-%d') end as referral_date, p_size::double as size_mw,
timestamp '2024-01-01 00:00:00' + to_days((p_partkey % 365)::int) as scraped_at from part"""


def referral_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (key % 900).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.concat((2018 + size % 5).cast("string"), F.lit("/"), key).alias("epbc_number"), F.concat("p_name", F.lit(" Solar Farm")).alias("project_name"), F.col("p_brand").alias("proponent"),
        F.when(size % 4 == 0, "NSW").when(size % 4 == 1, "VIC").when(size % 4 == 2, "QLD").alias("state"), F.when(size % 3 == 0, "Solar").when(size % 3 == 1, "Wind").otherwise("").alias("technology_type"),
        F.when(size % 5 == 0, "needs_review").otherwise("solar").alias("relevance_status"), (size % 2 == 0).alias("is_approved"),
        F.when(size % 6 != 0, day.cast("string")).alias("referral_date"), size.cast("double").alias("size_mw"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 365).cast("int")).cast("timestamp_ntz").alias("scraped_at"),
    )


def _referral_screen(where: str) -> str:
    return f"select id, epbc_number, project_name, state, referral_date from ({REFERRALS_SQL}) where {where}"


SCREEN = ("id", "epbc_number", "project_name", "state", "referral_date")


@query(_referral_screen("(project_name ilike '%re%' or proponent ilike '%re%' or epbc_number ilike '%re%') and state = 'NSW' and technology_type = 'Solar' and is_approved"))
def referral_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = referrals.ReferralQuery("re", "NSW", "Solar", None, "approved")
    return referrals.referral_list(referral_table(spark, sf_dir), asked).select(*SCREEN)


@query(_referral_screen("(project_name ilike '%2_/1%' or proponent ilike '%2_/1%' or epbc_number ilike '%2_/1%') and relevance_status = 'solar' and not is_approved"))
def referral_search_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a visitor's _ is a wildcard
    return referrals.referral_list(referral_table(spark, sf_dir), referrals.ReferralQuery("2_/1", None, None, "solar", "not_approved")).select(*SCREEN)


@query(_referral_screen("state = 'VIC'"))
def referral_any_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referrals.referral_list(referral_table(spark, sf_dir), referrals.ReferralQuery(state="VIC", approval="all")).select(*SCREEN)


@query(f"select count(*) as total, max(scraped_at) as last_scraped_at from ({REFERRALS_SQL})")
def referral_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referrals.referral_meta(referral_table(spark, sf_dir))


@query(f"select distinct technology_type from ({REFERRALS_SQL}) where technology_type <> '' and state = 'NSW'")
def referral_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referrals.technology_types(referrals.referral_list(referral_table(spark, sf_dir), referrals.ReferralQuery(state="NSW")))


# Uploads: numbers repeat, some rows have none, headers are spelt by aliases.

UPLOAD_SQL = f"""r as (select p_partkey as ord, case p_partkey % 7 when 0 then 'none' when 1 then '' else concat(2018 + (p_partkey // 2) % 5, '/', p_partkey // 2) end as n,
case when p_size % 5 <> 0 then concat(p_name, ' Solar Farm ', p_size * 10, ' MW') end as project, case p_size % 3 when 0 then 'Approved' when 1 then 'Withdrawn' end as status,
case p_size % 4 when 0 then '2024-03-15' when 1 then '2024-01-31' when 3 then '2024-12-05' end as day, p_brand as holder, case when p_size % 2 = 0 then 'NSW' end as state from part),
v as (select *, coalesce(project, n) as name, coalesce({sql_any("status", P.APPROVED)}, false) as approved, case when project is not null then 'Solar' else 'Unknown' end as technology,
case when project is not null then regexp_extract(project, '(\\d+) MW', 1)::double end as mw, row_number() over (partition by n order by ord) as k, row_number() over (partition by n order by ord desc) as back from r where regexp_matches(n, '[0-9]')),
s as (select concat(2018 + (p_partkey // 2) % 5, '/', p_partkey // 2) as n, 'Stored' as status, p_name as name from part where p_partkey % 6 = 0)"""
URL = "https://x.example/detail/"


def upload_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    number = F.concat((2018 + F.expr("p_partkey div 2") % 5).cast("string"), F.lit("/"), F.expr("p_partkey div 2"))
    return table(spark, sf_dir, "part").select(
        key.alias("ord"), F.when(key % 7 == 0, "none").when(key % 7 == 1, "  ").otherwise(F.concat(F.lit(" "), number)).alias("EPBC No"),
        F.when(size % 5 == 0, " ").otherwise(F.concat("p_name", F.lit(" Solar Farm "), size * 10, F.lit(" MW "))).alias("Project"), F.col("p_brand").alias("Proposer/Approval Holder"),
        F.when(size % 4 == 0, "45366").when(size % 4 == 1, "2024-01-31").when(size % 4 == 2, "soon").otherwise("12/5/2024").alias(" valid DATE "),
        F.when(size % 3 == 0, "Approved").when(size % 3 == 1, "Withdrawn").alias("Status"), F.when(size % 2 == 0, "NSW").otherwise("").alias("Jurisdiction"), F.lit("x").alias("Notes"),
    )


def upload_stored(spark: SparkSession, sf_dir: str, like: DataFrame) -> DataFrame:
    number = F.concat((2018 + F.expr("p_partkey div 2") % 5).cast("string"), F.lit("/"), F.expr("p_partkey div 2"))
    rows = table(spark, sf_dir, "part").filter("p_partkey % 6 = 0").select(number.alias("epbc_number"), F.lit("Stored").alias("project_status"), F.col("p_name").alias("project_name"))
    kinds = {f.name: f.dataType for f in like.schema.fields}
    out = [F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in UPLOADED]
    return rows.select(*out)


UPLOADED = ("epbc_number", "project_name", "proponent", "state", "project_status", "decision_status", "referral_date", "technology_type", "size_mw", "is_approved", "source_url")


@query(f"""with {UPLOAD_SQL}, f as (select a.n, a.name, a.holder, a.state, b.status, a.day, a.technology, a.mw, b.approved from v a join v b on a.n = b.n and a.k = 1 and b.back = 1)
select coalesce(s.n, f.n) as epbc_number, coalesce(s.name, f.name) as project_name, case when s.n is null then f.holder end as proponent, case when s.n is null then f.state end as state,
case when f.n is null then s.status else f.status end as project_status, case when s.n is null then f.day end as referral_date, case when s.n is null then f.technology end as technology_type,
case when s.n is null then f.mw end as size_mw, f.approved as is_approved, case when s.n is null then concat('{URL}', replace(f.n, '/', '-')) end as source_url,
case when s.n is null then 'inserted' when f.n is not null then 'updated' else 'unchanged' end as action from s full outer join f on s.n = f.n""")
def upload_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = referrals.upload_rows(upload_sheet(spark, sf_dir), URL).filter("valid")
    updates = tuple(c for c in referrals.UPLOAD_UPDATES if c != "updated_at")
    return referrals.upsert(upload_stored(spark, sf_dir, rows), rows, "epbc_number", updates, ["ord"]).drop("decision_status")


@query(f"""with {UPLOAD_SQL} select (select count(*) from v where k = 1 and n not in (select n from s)) as new_count, (select count(*) from v where k > 1 or n in (select n from s)) as updated_count,
(select count(*) from r where not regexp_matches(n, '[0-9]')) as skipped, (select count(*) from r) as total""")
def upload_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = referrals.upload_rows(upload_sheet(spark, sf_dir), URL)
    return referrals.counters(referrals.upload_labels(rows, upload_stored(spark, sf_dir, rows)))


def _workbook(rows: pa.Table) -> pa.Table:
    """A container with one sheet: texts shared, every third row's in the cell itself, day numbers as numbers, empty cells left out."""
    names, shared, lines = [c for c in rows.column_names if c != "ord"], {}, []
    text = lambda x: escape(x, {'"': "&quot;"})

    def cell(at: str, value: str | None, row: int) -> str:
        if value is None or value == "":
            return ""
        if value.isdigit():
            return f'<c r="{at}"><v>{value}</v></c>'
        if row % 3 == 0:
            return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text(value)}</t></is></c>'
        return f'<c r="{at}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'

    for i, values in enumerate([names, *(list(r.values()) for r in rows.sort_by("ord").select(names).to_pylist())], 1):
        lines.append(f'<row r="{i}">' + "".join(cell(f"{chr(65 + k)}{i}", v, i) for k, v in enumerate(values)) + "</row>")
    out, main = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        box.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" r:id="r2"/></sheets></workbook>')
        box.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="x.xml"/><Relationship Id="r2" Target="worksheets/one.xml"/></Relationships>')
        box.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f'<si><t xml:space="preserve">{text(x)}</t></si>' for x in shared) + "</sst>")
        box.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    first = rows["ord"].combine_chunks().to_pylist()
    return pa.table({"path": [f"upload-{min(first):012d}.xlsx"], "content": pa.array([out.getvalue()], pa.binary())})


@query(ORACLE_SQL["upload_upsert"])
def upload_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upload out of workbooks of 250 rows."""
    files = upload_sheet(spark, sf_dir).groupBy(F.expr("ord div 250").alias("file")).applyInArrow(_workbook, "path string, content binary")
    sheet = workbooks.sheet_columns(workbooks.workbook_rows(files))
    rows = referrals.upload_rows(sheet, URL).filter("valid")
    updates = tuple(c for c in referrals.UPLOAD_UPDATES if c != "updated_at")
    return referrals.upsert(upload_stored(spark, sf_dir, rows), rows, "epbc_number", updates, ["ord"]).drop("decision_status")


# Portal pages and answers of models.


def _json_of(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


@query("""select p_partkey as page_ord, concat(2018 + p_size % 5, '/', p_partkey) as epbc_number, concat(p_name, ' Solar Farm 1,200 MW') as project_name, p_brand as proponent, 1200::double as size_mw,
'Solar' as technology_type, p_size % 3 = 0 as is_approved, concat('https://x.example/detail/', 2018 + p_size % 5, '-', p_partkey) as source_url from part where p_size % 4 <> 0 and p_size % 5 <> 0""")
def portal_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .. import schemas

    size = F.col("p_size")
    number = F.concat((2018 + size % 5).cast("string"), F.lit("/"), "p_partkey")
    one = _json_of(
        referralNumber=F.when(size % 2 == 0, F.concat(F.lit(" "), number)), epbcNumber=number, title=F.concat("p_name", F.lit(" Solar Farm 1,200 MW")), proponent=F.col("p_brand"),
        industryType=F.when(size % 4 == 0, "Mining").otherwise("Energy Generation and Supply"), referralStatus=F.when(size % 3 == 0, "Approved").otherwise("Open"), projectName=F.lit("never"),
    )
    empty = F.lit('{"referralNumber":"","title":"x"}')  # an empty first choice drops the row
    page = F.concat(F.when(size % 3 == 0, '{"content":[').when(size % 3 == 1, '{"results":[').otherwise('{"items":['), F.when(size % 5 == 0, empty).otherwise(one), F.lit("]}"))
    pages = landing(spark, sf_dir).select(F.col("p_partkey").alias("ord"), F.from_json(page, schemas.PORTAL_PAGE).alias("page"))
    out = referrals.normalise(referrals.portal_records(pages).drop("pos").withColumn("location", F.concat(F.lit("p"), "page_ord")), "https://x.example/detail/")
    return out.select(F.substring("location", 2, 20).cast("long").alias("page_ord"), "epbc_number", "project_name", "proponent", "size_mw", "technology_type", "is_approved", "source_url")


@query("""with p as (select o_custkey as source, row_number() over (partition by o_custkey order by o_orderkey) - 1 as page, case when o_orderkey % 3 = 0 then 13 else 200 end as items from orders)
select source, page, items from p qualify page < 50 and coalesce(max(case when items < 200 then 1 else 0 end) over (partition by source order by page rows between unbounded preceding and 1 preceding), 0) = 0""")
def portal_page_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), page.alias("page"), F.when(F.col("o_orderkey") % 3 == 0, 13).otherwise(200).alias("items"))
    return parsers.page_limit(pages, 200)


def _portal_pages(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Orders as pages of their priority's portal; the twelfth page of urgent ones has but its first half."""
    numbered = numbering.number_rows(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus"), ["o_orderpriority", "o_orderkey"], "i", 0)
    first = numbered.groupBy("o_orderpriority").agg(F.min("i").alias("least"))
    at = F.col("i") - F.col("least")
    rows = numbered.join(first, "o_orderpriority").select(F.col("o_orderpriority").alias("source"), F.floor(at / size).cast("int").alias("page"), (at % size).alias("pos"), "o_orderkey", "o_orderstatus")
    rows = rows.filter(~((F.col("source") == "1-URGENT") & (F.col("page") == 11) & (F.col("pos") >= size // 2)))
    one = F.struct("pos", F.col("o_orderkey").cast("string").alias("epbcNumber"), F.col("o_orderstatus").alias("projectStatus"))
    # a page has at most `size` records
    return rows.groupBy("source", "page").agg(F.sort_array(F.collect_list(one)).alias("items")).select("source", "page", F.to_json(F.struct("items", F.lit(99).alias("totalPages"))).alias("value"))


@query("""with p as (select o_orderpriority as source, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as i, o_orderkey::varchar as epbc_number, o_orderstatus as project_status from orders)
select source, i // 100 as page, i % 100 as pos, epbc_number, project_status from p where i // 100 < 50 and not (source = '1-URGENT' and (i // 100 > 11 or i // 100 = 11 and i % 100 >= 50))""")
def portal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portal pages that land in two parts, out of order, read by a stream that stops between them and goes on."""
    from .. import schemas

    folder = run_folder(spark, "portal")
    pages = stage(_portal_pages(spark, sf_dir, 100))
    spark.dataSource.register(portal.PortalPages)
    for i, landed in enumerate((F.col("page") % 5 < 3, F.col("page") % 5 >= 3)):
        portal.land_pages(spread(pages.filter(landed), ["source", "page"], 1000), f"{folder}/landed")
        stream = spark.readStream.format("portal_pages").option("path", f"{folder}/landed").option("size", 100).load()
        records = referrals.portal_records(stream.select(F.struct("source", "page").alias("ord"), F.from_json("content", schemas.PORTAL_PAGE).alias("page")))
        out = records.select("page_ord.source", "page_ord.page", "pos", F.col("epbcNumber").alias("epbc_number"), F.col("projectStatus").alias("project_status"))
        stream_out = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/offsets")
        stream_out.queryName(f"portal-{i}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("""with a as (select p_partkey as ord, concat(case when p_partkey % 2 = 0 then ' ' else '' end, p_partkey // 4) as n, p_name as name, p_brand as who, case when p_size % 2 = 0 then 'NSW' end as state from part where p_size % 7 <> 0)
select n as "epbcNumber", name as "projectName", who as proposer, 'Energy' as "industryType", 'Open' as "projectStatus", state, state as location, '2024-02-03' as "referralDate" from a
qualify row_number() over (partition by trim(n) order by ord) = 1""")
def referral_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    number = F.concat(F.when(F.col("p_partkey") % 2 == 0, " ").otherwise(""), F.expr("p_partkey div 4"))
    one = _json_of(epbc_number=F.when(size % 7 != 0, number).otherwise(" "), project_name=F.col("p_name"), proponent=F.col("p_brand"), technology=F.lit("Solar"), state=F.when(size % 2 == 0, "NSW"), capacity_mw=size, status=F.lit("Open"), notice_date=F.lit("2024-02-03"))
    answers = landing(spark, sf_dir).select(F.col("p_partkey").alias("ord"), F.concat(F.lit("Here:\n```json\n["), one, F.lit("]\n```")).alias("content"))
    items = parsers.answer_items(answers, "epbc_number string, project_name string, proponent string, technology string, state string, capacity_mw double, status string, notice_date string, comment_close_date string")
    return referrals.search_answers(items.select("ord", "pos", "item.*"), ["ord", "pos"])


@query("""select p_partkey as ord, p_name as name, case when p_size % 3 = 0 then 'a plant' else p_name end as description, case when p_size % 2 = 0 then p_size::double end as capacity_mw, case when p_size % 4 = 0 then 'NZ' else 'AU' end as country,
case when p_size % 5 = 0 then 'under_development' else 'announced' end as status, case when p_size % 3 = 1 then 'https://x.example/own' else concat('https://x.example/', p_partkey) end as source_url,
case when p_size % 3 = 2 then date '2024-03-15' else date '2024-01-01' end as announced_date from part where p_size % 2 = 1 or p_size >= 5""")
def project_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    one = _json_of(
        name=F.col("p_name"), description=F.when(size % 3 == 0, "a plant"), capacity_mw=F.when(size % 2 == 0, size), country=F.when(size % 4 == 0, "NZ").otherwise("US"),
        status=F.when(size % 5 == 0, "under_development").otherwise("operating"), source_url=F.when(size % 3 == 1, "https://x.example/own"), announced_date=F.when(size % 3 == 2, "2024-03-15"),
    )
    answers = _landed(landing(spark, sf_dir), F.concat(F.lit("```json\n["), one, F.lit(',{"name":"","capacity_mw":9}]\n```')))
    return parsers.answer_projects(answers, F.lit(DAY_ONE)).select("ord", "name", "description", "capacity_mw", "country", "status", "source_url", "announced_date")


@query("""select id, concat('https://x.example/detail/', year, '%2F', id, '%20(a)') as import_url, printf('RUN-%04d', id) as run_label from (select o_orderkey as id, 2018 + o_orderkey % 5 as year from orders)
where id % 4 <> 0 union all select o_orderkey, 'https://x.example/all', printf('RUN-%04d', o_orderkey) from orders where o_orderkey % 4 = 0""")
def import_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    number = F.when(key % 4 != 0, F.concat((2018 + key % 5).cast("string"), F.lit("/"), key, F.lit(" (a)")))
    return table(spark, sf_dir, "orders").select(key.alias("id"), referrals.import_url(number, "https://x.example/detail/", "https://x.example/all").alias("import_url"), runs.run_label(key).alias("run_label"))


@query(f"""with r as (select *, concat('u', id % 50) as source_url from ({REFERRALS_SQL})), k as (select distinct concat('u', s_suppkey % 50) as u from supplier where s_suppkey % 2 = 0)
select project_name as name, size_mw::decimal(10,2) as capacity_mw, proponent as developer, case when is_approved then 'under_development' else 'announced' end as status, source_url,
coalesce(referral_date::date, date '2024-01-01') as announced_date from r where source_url not in (select u from k) qualify row_number() over (partition by source_url order by epbc_number) = 1""")
def referral_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = referral_table(spark, sf_dir).withColumns({"source_url": F.concat(F.lit("u"), F.col("id") % 50), "location": F.lit("x"), "raw_description": F.lit("y")})
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("u"), F.col("s_suppkey") % 50).alias("source_url"))
    return referrals.to_projects(rows, known, DAY_ONE).select("name", "capacity_mw", "developer", "status", "source_url", "announced_date")


# News, newsletters, embedded records and snapshots.

CARD_SQL = f"""c as (select p_partkey as ord, case p_size % 4 when 0 then concat(p_name, ' Solar Farm') when 1 then concat(p_name, ' Plains Project') when 2 then concat('Our solar farm ', p_name) else concat(p_name, ' Solar Park') end as title,
case when p_size % 3 = 0 then 'Now operating.' else concat('Proposed ', p_size * 10, ' MW plant in NSW.') end as body, concat('https://x.example/show/', p_partkey // 2) as url,
case when p_size % 5 = 0 then date '2024-01-01' else date '2026-06-12' end as d from part)"""


@query(f"""with {CARD_SQL} select ord, title as name, url as source_url, (regexp_extract(body, '(\\d+) MW', 1))::double as capacity_mw, 'NSW' as location, d as announced_date from c
join (select ord as o2, body as b2, url as u2 from c) on u2 = url and o2 % 2 = 0 where {sql_any('title', P.SOLAR_TITLES)} and not regexp_matches(title, '^our ', 'i') and contains(b2, 'Proposed') and d >= date '2024-01-02'
and true qualify row_number() over (partition by url order by ord) = 1""".replace("regexp_extract(body", "regexp_extract(b2"))
def news_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, parts = F.col("p_size"), landing(spark, sf_dir)
    title = F.when(size % 4 == 0, F.concat("p_name", F.lit(" Solar Farm"))).when(size % 4 == 1, F.concat("p_name", F.lit(" Plains Project"))).when(size % 4 == 2, F.concat(F.lit("Our solar farm "), "p_name")).otherwise(F.concat("p_name", F.lit(" Solar Park")))
    url = F.concat(F.lit("https://x.example/show/"), F.expr("p_partkey div 2"))
    day = F.when(size % 5 != 0, F.lit("<p>Published Date: 2026-June-12</p>")).otherwise("")
    card = F.concat(F.lit('<div class="x news-block-four"><div><div><a href="'), url, F.lit('">.</a><h3> <b>'), title, F.lit("</b></h3>"), day, F.lit("</div>\n</div></div><p>end</p>"))
    cards = parsers.news_cards(_landed(parts, F.concat(F.lit('<div class="news-block-four"><h3>no link</h3></div></div></div>'), card)), F.lit(DAY_ONE), r"https://x\.example/show/")
    body = F.when(size % 3 == 0, "Now operating.").otherwise(F.concat(F.lit("Proposed "), size * 10, F.lit(" MW plant in NSW.")))
    articles = parts.filter("p_partkey % 2 = 0").select(url.alias("source_url"), F.concat(F.lit('<div class="lower-box"><p>'), body, F.lit("</p></div>")).alias("html"))
    bound = F.lit("2024-01-02").cast("date")
    return parsers.news_projects(cards, articles, bound).select("ord", "name", "source_url", "capacity_mw", "location", "announced_date")


@query("""select p_partkey as ord, concat('https://x.example/letter/', p_partkey, '/a') as source_url, date '2024-06-12' as announced_date from part
union all select p_partkey, concat('https://x.example/letter/', p_partkey, '/b'), case when p_size % 2 = 0 then date '2024-07-03' else date '2024-01-01' end from part""")
def newsletter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit('href="https://x.example/letter/'), "p_partkey")
    block = F.concat(F.lit('<div class="pdf-block-watts-new"><div><div><h2>Letter of <b>12 June 2024</b></h2><a '), base, F.lit('/a">x</a></div></div></div>'))
    far = F.repeat(F.lit("z"), F.lit(400))
    rest = F.concat(far, F.when(F.col("p_size") % 2 == 0, "<p>3 July 2024</p>").otherwise(""), F.lit("<a "), base, F.lit('/b">y</a>'), far, F.lit("9 May 2020 <a "), base, F.lit('/a">again</a>'))
    return parsers.newsletter_index(_landed(landing(spark, sf_dir), F.concat(block, rest)), F.lit(DAY_ONE), r"https://x\.example/letter/")


@query("""select p_partkey as ord, concat(p_name, ' Solar Farm') as name, p_size::double as capacity_mw, p_brand as developer, case when p_size % 4 = 0 then 'NZ' else 'AU' end as country,
case p_size % 5 when 0 then 'under_development' else 'announced' end as status from part where p_size >= 5 and p_size % 3 <> 0 and p_size % 5 <> 4""")
def embedded_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    one = _json_of(
        energy_id=F.when(size % 3 == 0, 2).otherwise(4), type=F.when(size % 5 == 0, "In Development").when(size % 5 == 4, "Operating").otherwise("Announced"), project_name=F.concat("p_name", F.lit(" Solar Farm")),
        country=F.when(size % 4 == 0, "NZ").otherwise("AU"), capacity=F.concat(size, F.lit(" MW")), developer=F.lit(""), owner=F.col("p_brand"), status=F.lit(""), updated_at=F.lit("2024-02-03T00:00:00Z"),
    )
    pages = _landed(landing(spark, sf_dir), F.concat(F.lit("<script>var project = ["), one, F.lit("]; var x = 1;</script>")))
    return parsers.embedded_projects(pages, F.lit(DAY_ONE)).select("ord", "name", "capacity_mw", "developer", "country", "status")


@query("""select p_partkey as ord, concat(p_name, ' Hub') as name, p_size::double as capacity_mw, p_brand as developer, case p_size % 4 when 0 then 'announced' else 'under_development' end as status
from part where p_size >= 5 and p_size % 4 <> 3 and p_size % 3 <> 1""")
def snapshot_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = b"k3y", F.col("p_size")
    fields = dict(
        name=F.concat("p_name", F.lit(" Hub")), category=F.lit("Energy"), type=F.when(size % 3 == 1, "Battery").otherwise("Solar"), capacity=size.cast("string"), owner=F.col("p_brand"),
        status=F.when(size % 4 == 0, "Proposed").when(size % 4 == 1, "Approved").when(size % 4 == 2, "Committed (FID)").otherwise("Operating"),
    )
    text = F.concat(F.lit("["), _json_of(**fields), F.lit(","), _json_of(**fields | {"owner": F.lit("second")}), F.lit("]"))
    keys = F.array(*(F.lit(k) for k in key))
    # the text's characters once, as a lambda would put the text together anew for each of them
    coded = F.transform(F.split(text, ""), lambda c, i: F.lpad(F.hex(F.ascii(c).bitwiseXOR(F.get(keys, i % len(key))).cast("long")), 2, "0"))
    pages = _landed(landing(spark, sf_dir), F.base64(F.unhex(F.array_join(coded, ""))))
    return parsers.snapshot_projects(pages, key, F.lit(DAY_ONE)).select("ord", "name", "capacity_mw", "developer", "status")


@query("""select p_partkey as ord, concat(p_name, ' proposed solar') as name, case when p_size % 3 = 0 then 'https://x.example/n' else concat('https://x.example/', p_partkey) end as source_url, date '2024-06-12' as announced_date,
(p_size * 10)::double as capacity_mw, 'SA' as location, 'announced' as status from part where p_size % 2 = 0 and p_size % 5 <> 0""")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # blocks that generate, without date, with a short heading
    size = F.col("p_size")
    block = F.concat(
        F.lit('<article class="post"><h2><i>'), "p_name", F.lit("</i> proposed solar</h2>"), F.when(size % 3 == 0, '<a href="https://x.example/n">x</a>').otherwise(""), F.when(size % 5 == 0, " undated ").otherwise(" June 12, 2024 "),
        F.when(size % 2 == 0, "permit lodged").otherwise("now operating"), F.lit(" in SA, "), size * 10, F.lit(' MW</article><section class="entry"><h3>solar</h3> permit, June 12, 2024</section>'),
    )
    found = parsers.html_blocks(_landed(landing(spark, sf_dir), block), "url", F.lit(DAY_ONE), F.lit("2024-02-01").cast("date"))
    return found.select("ord", "name", "source_url", "announced_date", "capacity_mw", "location", "status")


LETTER_SQL = """s as (select p_partkey as ord, concat(p_name, ' Solar Farm') as name, p_size::double as mw, 'announced' as status from part where p_size >= 5 and p_size % 4 <> 0
union all select p_partkey, concat(p_name, ' Hybrid Solar'), 80, 'under_development' from part where p_size % 4 <> 0)"""


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newsletters with a section without solar power, headers in any case, a name that comes again, and some without any section."""
    text = F.concat(
        F.lit("<p>hello</p> NEW PROJECT: "), "p_name", F.lit(" Solar Farm. A plant of "), "p_size", F.lit(" MW <b>PROJECT UPDATE:</b> "), "p_name", F.lit(" Ridge. 70 MW project update: "), "p_name",
        F.lit(" Hybrid Solar. 80 MW New Project: "), "p_name", F.lit(" Solar Farm. 90 MW again PROJECT MILESTONE: Other solar. 90 MW"),
    )
    return _landed(landing(spark, sf_dir), F.when(F.col("p_size") % 4 == 0, "<p>nothing</p>").otherwise(text))


@query(f"with {LETTER_SQL} select ord, name, mw as capacity_mw, status from s")
def newsletter_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.newsletter_sections(letters(spark, sf_dir), F.lit(DAY_ONE)).select("ord", "name", "capacity_mw", "status")


@query(f"""with {LETTER_SQL}, a as (select p_partkey as ord, p_name as name, case when p_size % 3 = 0 then null when p_size % 3 = 1 then p_size::double else 25 end as mw from part)
select ord, name, mw as capacity_mw, 'announced' as status, concat('https://x.example/', ord, '#gpt-', replace(name, ' ', '%20')) as source_url from a where ord not in (select ord from s) and (mw is null or mw >= 5)
union all select ord, name, mw, status, null from s""")
def newsletter_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers stand in for newsletters without sections: their capacity, else that of their text."""
    size = F.col("p_size")
    one = _json_of(name=F.col("p_name"), description=F.when(size % 3 == 2, "some 25 MW").otherwise("a plant"), capacity_mw=F.when(size % 3 == 1, size))
    answers = _landed(landing(spark, sf_dir), F.concat(F.lit("```json\n["), one, F.lit(',{"capacity_mw":9},'), one, F.lit("]\n```")))
    found = parsers.newsletter_sections(letters(spark, sf_dir), F.lit(DAY_ONE)).withColumn("source_url", F.lit(None).cast("string"))
    return parsers.with_answers(found, answers, F.lit(DAY_ONE)).select("ord", "name", "capacity_mw", "status", "source_url")


SOURCE_SQL = """r as (select p_partkey, p_partkey % 50 as k, p_name, p_size from part),
f as (select concat('s', k) as source, 0 as branch, p_partkey as ord, concat(p_name, ' solar ', p_size, ' MW') as name, concat('https://x.example/', p_partkey % 200) as url from r where k % 3 = 0),
g as (select concat('s', k), 1, p_partkey, concat(p_name, ' proposed solar ', p_size, ' MW'), concat('https://x.example/', p_partkey % 400) from r where k % 3 < 2 and k % 5 <> 0),
b as (select * from f union all select * from g), o as (select concat('s', k) as source, 2 as branch, p_partkey as ord, concat(p_name, ' Solar Farm') as name, concat('https://x.example/', p_partkey % 100) as url from r),
u as (select * from b union all select * from o where source not in (select source from b))
select source, branch, ord, name, url as source_url from u qualify row_number() over (partition by source, url order by branch, ord) = 1"""


@query(f"with {SOURCE_SQL}")
def source_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's feed, then its pages, the first of a URL; a model's answers for sources without any row."""
    key, size = F.col("p_partkey"), F.col("p_size")
    landed = lambda keep, content: landing(spark, sf_dir).filter(keep).select(F.concat(F.lit("s"), key % 50).alias("source"), F.concat(F.lit("https://x.example/"), key % 100).alias("url"), key.alias("ord"), content.alias("content"))
    item = F.concat(F.lit("<item><title>"), "p_name", F.lit(" solar "), size, F.lit(" MW</title><link>https://x.example/"), key % 200, F.lit("</link></item>"))
    block = F.concat(F.lit('<div class="post"><h2>'), "p_name", F.lit(" proposed solar "), size, F.lit(' MW</h2><a href="https://x.example/'), key % 400, F.lit('">x</a></div>'))
    k, day = key % 50, F.lit(DAY_ONE)
    feed = parsers.rss_items(landed(k % 3 == 0, item), day).withColumn("branch", F.lit(0))
    pages = parsers.html_blocks(landed((k % 3 < 2) & (k % 5 != 0), block), "url", day).withColumn("branch", F.lit(1))
    answers = parsers.answer_projects(landed(F.lit(True), F.concat(F.lit("["), _json_of(name=F.concat("p_name", F.lit(" Solar Farm"))), F.lit("]"))), day).withColumn("branch", F.lit(2))
    return gates.first_of_source([feed, pages], answers).select("source", "branch", "ord", "name", "source_url")


# Contacts.


@query("""select c_custkey as ord, nullif(case when c_custkey % 3 = 0 then '' else c_name end, '') as first_name, c_mktsegment as organization_name, case when c_custkey % 2 = 0 then concat('a', c_custkey, '@x.example') end as email1,
case when c_custkey % 5 = 0 then 'b@x.example' end as email2, row_number() over (order by c_custkey) as id from customer where c_custkey % 2 = 0 or c_custkey % 5 = 0""")
def contact_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        key.alias("ord"), F.when(key % 3 == 0, " ").otherwise(F.col("c_name")).alias("First Name"), F.concat(F.lit(" "), "c_mktsegment").alias("Organization Name"),
        F.when(key % 2 == 0, F.concat(F.lit("a"), key, F.lit("@x.example "))).alias("E-mail 1 - Value"), F.when(key % 5 == 0, "b@x.example").otherwise("").alias("E-mail 2 - Value"),
    )
    return contacts.reload_contacts(raw, "ord").select("ord", "first_name", "organization_name", "email1", "email2", "id")


@query("""with n as (select c_custkey as id, case c_custkey % 4 when 0 then concat(' Jo ', c_mktsegment, ' Smith ') when 1 then 'Solar Team' when 2 then c_mktsegment else concat(c_mktsegment, ' Lee') end as name from customer)
select id, case when id % 4 = 0 then 'Jo' when id % 4 = 3 then split_part(name, ' ', 1) end as first, case when id % 4 = 0 then trim(substr(trim(name), 4)) when id % 4 = 3 then 'Lee' end as last from n""")
def person_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(key % 4 == 0, F.concat(F.lit(" Jo "), segment, F.lit(" Smith "))).when(key % 4 == 1, "Solar Team").when(key % 4 == 2, segment).otherwise(F.concat(segment, F.lit(" Lee")))
    first, last = contacts.split_person(name)
    return table(spark, sf_dir, "customer").select(key.alias("id"), first.alias("first"), last.alias("last"))


@query(f"""with m as (select developer as d, contact_name as n, contact_email as e from ({MATCH_SQL})),
p as (select p_partkey as id, concat(p_name, case when p_size % 3 = 0 then ' Pty Ltd' when p_size % 3 = 1 then ' Energy' else '' end) as developer, p_size % 2 = 0 as is_new, case when p_size % 5 = 0 then 'me' end as contact_name, case when p_size % 7 = 0 then '' end as contact_email from part)
select id, coalesce(contact_name, case when is_new then n end) as contact_name, case when is_new and contact_name is null and e is not null then e else contact_email end as contact_email from p left join m on d = developer""")
def fallback_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.when(size % 3 == 0, " Pty Ltd").when(size % 3 == 1, " Energy").otherwise("")).alias("developer"),
        (size % 2 == 0).alias("is_new"), F.when(size % 5 == 0, "me").alias("contact_name"), F.when(size % 7 == 0, "").alias("contact_email"),
    )
    return contacts.with_fallback(rows, _contact_top1(spark, sf_dir)).select("id", "contact_name", "contact_email")


@query("select distinct p_brand as company from part order by 1 limit 50")
def company_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.first_companies(table(spark, sf_dir, "part").select(F.col("p_brand").alias("company")))


@query("""with c as (select distinct regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') as company_key, concat('e', p_size, '@x.example') as email from part),
n as (select regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') as company_key, count(distinct p_brand) as spellings from part group by 1)
select company_key, email, row_number() over (partition by company_key order by email) as pos, spellings from c join n using (company_key)""")
def company_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("company"), F.concat(F.lit("e"), "p_size", F.lit("@x.example")).alias("email"))
    return contacts.company_contacts(rows)


@query("""select o_orderkey as id, o_custkey as batch_of, (row_number() over (order by o_custkey, o_orderkey) - 1) // 100 as batch, (row_number() over (order by o_custkey, o_orderkey) - 1) % 100 as pos from orders""")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in batches of a hundred, in order, numbered without a task that sees them all."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch_of"))
    return numbering.in_batches(rows, ["batch_of", "id"])


@query("""with q as (select c_custkey as id, row_number() over (order by c_acctbal, c_custkey) as i from customer), r as (select s_name as found, row_number() over (order by s_name) as i from supplier)
select id, found from q join r using (i)""")
def zipped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("due"))
    return numbering.zip_rows(asked, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("found")), ["due", "id"], ["found"]).select("id", "found")


@query("""with a as (select o_orderkey as ord, o_custkey as id from orders), r as (select c_custkey as id, case when c_custkey % 7 <> 0 then concat('u', c_custkey // 2) end as url from customer where c_custkey % 5 <> 0),
p as (select distinct concat('u', s_suppkey) as url from supplier)
select ord, a.id, case when r.id is null then 404 when url is null then 201 when url in (select url from p) or row_number() over (partition by url order by ord) > 1 then 409 else 201 end as answer from a left join r on a.id = r.id""")
def import_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("id"))
    key = F.col("c_custkey")
    known = table(spark, sf_dir, "customer").filter(key % 5 != 0).select(key.alias("id"), F.when(key % 7 != 0, F.concat(F.lit("u"), F.expr("c_custkey div 2"))).alias("source_url"))
    return referrals.import_answers(asked, known, table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("source_url")))


PEOPLE = ("CEO", "Project Manager", "Head of Solar Projects", "Manager", "Analyst", "Director", "Managing Partner")


@query(f"""with recursive t as (select o_custkey as g, o_orderkey as o, {list(PEOPLE)}[(o_orderkey % 7 + 1)::int] as title, row_number() over (partition by o_custkey order by o_orderkey) as k from orders where o_orderkey % 7 <> 4),
s as (select *, case when regexp_matches(lower(title), 'director|head|ceo|chief|managing') then 3 when contains(lower(title), 'manager') then 2 else 1 end as s from t),
b(g, k, o, title) as (select g, k, o, title from s where k = 1 union all select s.g, s.k, case when s.s > len(string_split(b.title, ' ')) then s.o else b.o end, case when s.s > len(string_split(b.title, ' ')) then s.title else b.title end from b join s on s.g = b.g and s.k = b.k + 1)
select g, o::varchar as name, title from b qualify row_number() over (partition by g order by k desc) = 1""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.get(F.array(*(F.lit(t) for t in PEOPLE)), (F.col("o_orderkey") % 7).cast("int"))
    people = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("o"), F.col("o_orderkey").cast("string").alias("name"), title.alias("title"))
    return enrichment.running_best(people, "g", "o", F.col("title") != "Analyst", enrichment.title_seniority(F.col("title")))


@query("""with e as (select user_id as run_id, event_id as "at", case event_type when 'view' then 'running' when 'click' then 'completed' when 'error' then 'failed' else 'running' end as status from events),
b as (select *, lag(status) over (partition by run_id order by "at") as before from e) select run_id, "at", status, coalesce(before is null and status = 'running' or before = 'running', false) as valid from b""")
def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("at"), F.when(kind == "click", "completed").when(kind == "error", "failed").otherwise("running").alias("status"))
    return runs.run_changes(log)


@query("""select p_partkey, p_name, p_type from part where p_name ilike '%re_%w%' or p_type ilike '%re_%w%' or p_name ilike '%LARGE%' or p_type ilike '%LARGE%' or p_name ilike '%ue g%' or p_type ilike '%ue g%'""")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three searches through postings: one with wildcards and no trigram, one in another case, one across words."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    columns = ("p_name", "p_type")
    postings = stage(search.post(rows, "p_partkey", columns))
    counts = search.frequencies(postings)
    found = [search.search(rows, postings, counts, "p_partkey", columns, text) for text in ("re_%w", "LARGE", "ue g")]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


@query(f"""with p as (select id, case when id % 3 = 0 and scan_id = 2 then 'X' else status end as status, country, capacity_mw, case when scan_id = 2 and id % 5 = 0 then date '1998-08-01' else announced_date end as announced_date, name from ({PROJECTS_SQL}) where not (scan_id = 3 and id % 2 = 0))
select case grouping_id(country, status) when 3 then 'total' when 1 then 'country' else 'status' end as dimension, coalesce(country, status, '') as value, count(*) as n, coalesce(sum(capacity_mw), 0)::decimal(38,2) as capacity_mw,
count(*) filter (where announced_date >= date '1998-07-26') as recent_count from p where {PERMANENT_SQL} group by grouping sets ((), (country), (status))""")
def statistics_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures after three changes (new rows, changed rows, deleted rows), from the changes alone."""
    rows, keep = projects(spark, sf_dir), directory.permanent_filters()
    second, third = F.col("scan_id") == 2, F.col("scan_id") == 3
    state = statistics.cells(rows.filter(~second), keep)
    state = statistics.merge(state, statistics.cells(rows.filter(second), keep))
    changed = rows.filter(second & ((F.col("id") % 3 == 0) | (F.col("id") % 5 == 0)))
    after = changed.withColumns({"status": F.when(F.col("id") % 3 == 0, "X").otherwise(F.col("status")), "announced_date": F.when(F.col("id") % 5 == 0, F.lit("1998-08-01").cast("date")).otherwise(F.col("announced_date"))})
    state = statistics.merge(state, statistics.change_cells(changed, after, keep))
    state = statistics.merge(state, statistics.cells(rows.filter(third & (F.col("id") % 2 == 0)), keep, -1))
    return statistics.figures(state, TODAY)


@query("""select count(*) filter (where p_size % 4 in (0, 1, 2)) as checked, count(*) filter (where p_size % 4 in (0, 1, 2) and p_partkey % 3 = 0) as updated from part""")
def enrichment_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no contact, a general mailbox, a stranger's address, the developer's own
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lit("Sunny Acme Corporation").alias("developer"), F.lit(None).cast("string").alias("contact_name"),
        F.when(size % 4 == 1, "info@sunnyacme.example").when(size % 4 == 2, "jo@stranger.example").when(size % 4 == 3, "jo@sunnyacme.example").alias("contact_email"),
    )
    return contacts.enrichment_counters(rows, rows.filter("id % 3 = 0"))


@query("""with e as (select user_id, list({'n': case when event_id % 4 = 0 then null when event_id % 4 = 1 then concat('04...', event_id) else concat('+61 ', event_id) end, 't': case when event_type = 'click' then 'Mobile' else 'direct' end} order by event_id) as m from events group by 1),
f as (select user_id, list_filter(m, lambda x: x.n is not null and not contains(x.n, '...')) as m from e)
select user_id, coalesce(list_filter(m, lambda x: x.t = 'Mobile')[1].n, m[1].n) as phone from f""")
def best_phone_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    number = F.when(key % 4 == 1, F.concat(F.lit("04..."), key)).when(key % 4 > 1, F.concat(F.lit("+61 "), key))
    one = F.struct("event_id", number.alias("number"), F.when(F.col("event_type") == "click", "Mobile").otherwise("direct").alias("type"))
    people = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return people.select("user_id", enrichment.best_phone(F.col("m")).alias("phone"))


@query("""select q.o_orderkey as id, q.o_custkey as batch, r.o_totalprice as found from (select *, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders) q
join (select *, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders where o_orderstatus = 'F') r on q.o_custkey = r.o_custkey and q.pos = r.pos""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos")
    orders = table(spark, sf_dir, "orders")
    asked = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch"), pos)
    found = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("batch"), F.col("o_totalprice").alias("found"), pos)
    return enrichment.positional_join(asked, found).select("id", "batch", "found")


@query("""with f as (select o_custkey as id, arg_max(o_orderstatus, o_orderkey) as s from orders group by 1)
select c_custkey as id, case when s = 'F' then coalesce(null, concat('g', c_custkey), c_name) else c_name end as contact_name, case when s = 'F' then concat('e', c_custkey) else 'old' end as contact_email, 'p' as contact_phone from customer left join f on id = c_custkey""")
def apply_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, key = F.lit(None).cast("string"), F.col("c_custkey")
    projects = table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_name").alias("contact_name"), F.lit("old").alias("contact_email"), F.lit("p").alias("contact_phone"))
    last = dedup.last_by(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus"], "o_orderkey")
    status = F.col(last.columns[1])
    found = last.filter(status == "F").select(F.col("o_custkey").alias("id"), none.alias("found_name"), F.concat(F.lit("g"), "o_custkey").alias("group_name"), F.concat(F.lit("e"), "o_custkey").alias("found_email"), none.alias("found_phone"))
    return enrichment.apply_contacts(projects, found)


# Stored tables.


@query("""with c as (select o_custkey as k, arg_max(o_orderstatus, o_orderkey) as s from orders where o_orderkey % 2 = 0 group by 1)
select c_custkey as id, coalesce(s, c_mktsegment) as status, c_name as name, case when s is null then timestamp '2020-01-01 00:00:00' else timestamp '2024-01-01 00:00:00' end as updated_at from customer left join c on k = c_custkey""")
def update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("name"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    changes = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"))
    return sinks.update_by_key(stored, changes, "id", ("status",), "at", F.lit("2024-01-01 00:00:00"))


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority like '1%')")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.delete_by_key(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


@query("""select c_custkey, concat('{"id":', c_custkey, ',"name":"', c_name, case when c_custkey % 2 = 0 then '","size":2.5' else '"' end, ',"at":"2024-01-02T03:04:05.000Z"}') as json from customer""")
def json_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2.50")).cast("decimal(10,2)").alias("size"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("at")
    )
    return sinks.json_rows(rows).select(F.get_json_object("json", "$.id").cast("long").alias("c_custkey"), "json")


@query("""with s as (select o_orderkey as k, o_orderstatus as a, o_orderpriority as b from orders where o_orderdate < timestamp '1998-01-01'),
i as (select case when o_orderkey % 3 = 0 then o_orderkey - 1 else o_orderkey end as k, concat('new', o_orderstatus) as a, o_orderpriority as b, o_orderkey as ord from orders where o_orderkey % 2 = 0),
f as (select k, arg_min(b, ord) as b, arg_max(a, ord) as a from i group by k), t as (select coalesce(s.k, f.k) as k, coalesce(f.a, s.a) as a, case when s.k is not null then s.b else f.b end as b from s full outer join f on s.k = f.k)
select k, a, case when k % 10 = 0 then 'done' else b end as b from t where k not in (select l_orderkey from lineitem where l_quantity > 49)""")
def table_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after three commits: an upsert, an update by key, a deletion."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stored = orders.filter("o_orderdate < timestamp_ntz '1998-01-01 00:00:00'").select(key.alias("k"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    came = orders.filter("o_orderkey % 2 = 0").select(F.when(key % 3 == 0, key - 1).otherwise(key).alias("k"), F.concat(F.lit("new"), "o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), key.alias("ord"))
    stored_table = VersionedTable.create(spark, f"{run_folder(spark, 'commits')}/table", stored, "k", buckets=8)
    stored_table.upsert(came, ("a",), ["ord"])
    stored_table.update(orders.filter(key % 10 == 0).select(key.alias("k"), F.lit("done").alias("b")), ("b",))
    stored_table.delete(table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("k")))
    return stored_table.snapshot()


@query(f"""with d as ({PROJECTS_SQL}) select id, name, country, capacity_mw, announced_date from d
where {PERMANENT_SQL} and announced_date >= date '1996-03-01' and announced_date <= date '1996-03-31' and country = 'NZ'""")
def directory_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of one country out of a stored directory that is clustered by date, capacity and country."""
    stored = VersionedTable.create(
        spark, f"{run_folder(spark, 'directory')}/table", projects(spark, sf_dir), "id", buckets=2, cluster=("announced_date", "capacity_mw", "country"), file_rows=2_000
    )
    asked = directory.DirectoryQuery("NZ", None, datetime.date(1996, 3, 1), datetime.date(1996, 3, 31))
    return directory.stored_list(stored, asked).select("id", "name", "country", "capacity_mw", "announced_date")


# Scans.


@query(ORACLE_SQL["scan_dedup_window"])
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan in three batches against a stored state."""
    rows, stored = scan_events(spark, sf_dir)
    folder = run_folder(spark, "scan")
    state = scan.open_state(spark, f"{folder}/state", stored, buckets=8)
    last, bound = rows.agg(F.max("ord")).first()[0] or 0, lambda d: F.lit(d).cast("date")
    for i in range(3):
        part = rows.filter((F.col("ord") >= last * i // 3 + (i > 0)) & (F.col("ord") <= last * (i + 1) // 3))
        scan.scan_batch(state, part, str(i), f"{folder}/out/batch={i}", bound("2024-01-03"), bound("2024-01-25"))
    return spark.read.parquet(f"{folder}/out").select("ord", "passes", "is_new", "project_ref")


@query("select event_type as scan_id, count(*) filter (where value > 50) as new_count from events group by 1")
def scan_new_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.new_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("scan_id"), (F.col("value") > 50).alias("is_new")))


CHAIN_SQL = f"""{LISTED_SQL}, r as (
select 0 as branch, ord, 2 as pos, name, mw, concat(name, ' ', size, ' ', note) as text, concat('https://x.example/', ord % 100) as url from t
union all select 1, ord, 0, name, mw, concat(name, ' - ', size, ' - ', note), concat('https://x.example/', ord % 150) from t
union all select 2, ord, 0, name, mw, concat(name, ' ', size, ' ', note), concat('https://x.example/', ord % 60) from t),
s as (select *, row_number() over (order by branch, ord, pos) as seq from r where {LISTED_GATES_SQL}),
e as (select s.*, coalesce(k.d, date '2024-01-01' + (ord % 30)::int) as eff, k.id from s left join
  (select concat('https://x.example/', s_suppkey) as u, s_suppkey as id, date '2024-01-01' + (s_suppkey % 30)::int as d from supplier where s_suppkey % 3 = 0) k on k.u = s.url),
g as (select *, not (regexp_matches(name, 'wind\\b', 'i') or contains(lower(text), 'turbine')) as gate_ok from e),
p as (select *, gate_ok and eff between date '2024-01-03' and date '2024-01-25' as passes from g),
w as (select *, case when coalesce(max(case when not gate_ok then 1 end) over b, 0) = 1 then 'barred' when id is not null then 'stored'
when min(case when passes then seq end) over b is not null then 'created' else 'new' end as project_ref from p window b as (partition by url order by seq rows between unbounded preceding and 1 preceding))"""


def scan_of_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of landed content to records, one after another, then gates, window, stored URLs and repeats."""
    parts, (name, size, note) = listed(spark, sf_dir)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("ord") % 30).cast("int"))
    page = lambda k: F.concat(F.lit("https://x.example/"), F.col("p_partkey") % k)
    cells = F.concat(F.lit("| Project | Capacity | Stage |\n|---|---|---|\n| "), name, F.lit(" | "), size, F.lit(" | "), note, F.lit(" |\n"))
    bullet = F.concat(F.lit("- "), name, F.lit(" - "), size, F.lit(" - "), note, F.lit("\n"))
    row = F.create_map(F.lit("Project Name"), name, F.lit("Size"), size, F.lit("Stage"), note)
    lists = parts.select(F.col("p_partkey").alias("ord"), page(60).alias("url"), F.create_map(F.lit("l"), F.array(row)).alias("lists"))
    branches = [
        parsers.table_projects(_landed(parts, cells).withColumn("url", F.concat(F.lit("https://x.example/"), F.col("ord") % 100)), day),
        parsers.bullet_projects(_landed(parts, bullet).withColumn("url", F.concat(F.lit("https://x.example/"), F.col("ord") % 150)), day),
        parsers.captured_projects(lists, day),
    ]
    return gates.scan_sources(branches)


def stored_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(key % 3 == 0).select(F.concat(F.lit("https://x.example/"), key).alias("source_url"), key.alias("stored_id"), F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int")).alias("stored_date"))


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = lambda d: F.lit(d).cast("date")
    return dedup.scan_dedup(stage(scan_of_all_sources(spark, sf_dir)), stored_urls(spark, sf_dir), bound("2024-01-03"), bound("2024-01-25"))


@query(f"{CHAIN_SQL} select branch, ord, pos, name, mw as capacity_mw, url as source_url, passes, project_ref from w")
def scan_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped(spark, sf_dir).select("branch", "ord.ord", "ord.pos", "name", "capacity_mw", "source_url", "passes", "project_ref")


@query(f"{CHAIN_SQL} select count(*) filter (where passes) as projects_found, count(*) filter (where passes and project_ref = 'new') as new_projects from w")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.scan_counters(_deduped(spark, sf_dir))


# Functions on texts, with results written down by hand.

GOLDEN: tuple[tuple[str, str, str | None], ...] = (
    ("capacity", "a 1.2GW hub", "1200.0"), ("capacity", "1,200 MW", "200.0"), ("capacity", "400 MWh battery", "400.0"), ("capacity", "no figure", None),
    ("megawatts", "1,200 MW", "1200.0"), ("megawatts", "1.2 GW", None),
    ("location", "Victoria and NSW", "NSW"), ("location", "USA grid", "SA"), ("status", "resource consent lodged", "under_development"),
    ("early", "proposed; now generating", "false"), ("wind", "Tailwind Hub", "true"), ("wind", "Windy Hill Solar Farm", "false"), ("solar_part", "PV plant", "true"), ("solar_part", "PVC plant", "false"),
    ("noisy", "Faq", "true"), ("noisy", "Our solar farm", "true"), ("noisy", "Sunny Plains", "false"), ("shapeless", "Sunny Plains", "true"),
    ("technology", "X Solar Farm and battery", "Solar + BESS"), ("technology", "Big wind project", "Renewable (unclassified)"), ("technology", "Grain storage", "BESS"),
    ("approved", "Not Approved", "true"), ("approved", "Withdrawn", "false"), ("serial", "45366", "2024-03-15"), ("referral_date", "15/03/2024", None), ("referral_date", "45366", "2024-03-15"),
    ("long_date", "2026-June-12", "2026-06-12"), ("csv", 'a,"b"', '"a,""b"""'), ("jurisdiction", "New Zealand", "NZ"), ("jurisdiction", "NSW", "AU"),
    ("phone", "call +61 02 9999 1234 now", "+61 02 9999 1234"), ("phone", "call 12 now", None), ("person", "by Project Manager and Jo Smith", "Jo Smith"), ("url", "a b/(c)", "a%20b%2F(c)"), ("limited", "Quota exceeded", "true"), ("limited", "fine", "false"),
    ("host", "https://www.x.example/a", "x.example"), ("domain", "jo@X.Example", "x.example"), ("company", "Acme Energy Pty Ltd", "acmeenergy"), ("title", "CEO", "8"),
    ("statistic", "10 GW cumulative large-scale solar capacity", "true"), ("statistic", "2.5 gigawatt of solar by 2030", "true"), ("statistic", "3 GW total, and a 50 MW farm", "true"), ("statistic", "50 MW farm " + "x" * 80 + " 3 GW total", "false"),
    ("statistic", "pipeline of 900 MW nationwide", "false"), ("statistic", "installed 40 MW", "false"), ("statistic", "no figure in total", "false"),
    ("email_context", "<p>write to Jo@X.example today</p>", "jo@x.example|write to Jo@X.example today"),
)


def golden_value(text: Column) -> dict[str, Column]:
    none = F.lit(None).cast("string")
    return {
        "capacity": X.capacity(text), "megawatts": X.megawatts(text), "location": X.location(text), "status": X.status(text), "early": X.is_early_stage(text), "wind": X.is_wind(text),
        "solar_part": X.has_solar_component(text), "noisy": X.is_noisy_name(text), "shapeless": X.is_noisy_name(text, True), "technology": X.technology(text, none)["technology_type"],
        "approved": X.is_approved(text, none), "serial": X.serial_date(text.try_cast("double")), "referral_date": X.referral_date(text), "long_date": X.long_date(text), "csv": X.csv_field(text),
        "jurisdiction": X.jurisdiction_country(text), "phone": X.phone(text), "person": X.person_name(text), "url": X.url_component(text), "limited": X.is_rate_limited(text), "host": X.host(text),
        "domain": X.email_domain(text), "company": X.company_key(text), "title": X.title_score(text), "statistic": parsers.only_statistics(text),
        "email_context": F.array_join(F.transform(X.email_contexts(text), lambda x: F.concat(x["email"], F.lit("|"), x["context"])), ";"),
    }


def _quoted(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


GOLDEN_SQL = "values " + ", ".join(f"({i}, {_quoted(f)}, {_quoted(t)}, {_quoted(v)})" for i, (f, t, v) in enumerate(GOLDEN))


@query(f"select p_partkey as id, fn, concat(p_partkey, '|', input) as input, value from part join ({GOLDEN_SQL}) as t(i, fn, input, value) on i = p_partkey % {len(GOLDEN)}")
def golden_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the texts for each part."""
    pick = (F.col("p_partkey") % len(GOLDEN)).cast("int")
    some = lambda k: F.get(F.array(*(F.lit(g[k]) for g in GOLDEN)), pick)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), some(0).alias("fn"), some(1).alias("input"))
    value = F.lit(None).cast("string")
    for name, found in golden_value(F.col("input")).items():
        value = F.when(F.col("fn") == name, found.cast("string")).otherwise(value)
    return rows.withColumn("value", value).withColumn("input", F.concat_ws("|", F.col("id").cast("string"), "input"))


__all__ = ["LISTED", "scan_of_all_sources"]
