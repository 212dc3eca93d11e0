"""Referrals: normalising, classifying, upserting, importing."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .dedup import keep_first
from .directory import search_filter

#: What a portal sync changes in a known referral; a spreadsheet leaves the description alone.
SYNC_UPDATES = ("project_status", "decision_status", "is_approved", "raw_description", "updated_at")
UPLOAD_UPDATES = ("project_status", "decision_status", "is_approved", "updated_at")


@dataclass(frozen=True)
class ReferralQuery:
    """What a visitor asks for. Any `approval` but approved and not_approved is ignored."""

    search: str | None = None
    state: str | None = None
    technology: str | None = None
    relevance: str | None = None
    approval: str | None = None


def referral_filter(query: ReferralQuery) -> Column:
    keep = search_filter(query.search, ("project_name", "proponent", "epbc_number")) if query.search else F.lit(True)
    for column, value in (("state", query.state), ("technology_type", query.technology), ("relevance_status", query.relevance)):
        if value:
            keep &= F.col(column) == value
    if query.approval in ("approved", "not_approved"):
        keep &= F.col("is_approved") == (query.approval == "approved")
    return keep


def referral_list(referrals: DataFrame, query: ReferralQuery) -> DataFrame:
    """Oldest referral first, those without a date last; equal dates by number."""
    return referrals.filter(referral_filter(query)).orderBy(F.col("referral_date").asc_nulls_last(), "epbc_number")


def referral_meta(referrals: DataFrame) -> DataFrame:
    """How many there are, and when one was last read."""
    return referrals.agg(F.count(F.lit(1)).alias("total"), F.max("scraped_at").alias("last_scraped_at"))


def technology_types(referrals: DataFrame) -> DataFrame:
    """The kinds that a list shows, each once."""
    return referrals.filter("technology_type <> ''").select("technology_type").distinct()


def resolve_headers(headers: list[str], aliases: dict[str, tuple[str, ...]] = P.UPLOAD_HEADERS) -> dict[str, str]:
    """The header of each field: of its aliases, in their order, the first that some header equals in any case."""
    found = {}
    for field, names in aliases.items():
        for name in names:
            hit = next((h for h in headers if h.strip().lower() == name), None)
            if hit is not None:
                found[field] = hit
                break
    return found


def upload_rows(sheet: DataFrame, url_base: str, order: str = "ord") -> DataFrame:
    """Referrals out of a spreadsheet's rows (read from CSV or Parquet, a column per header), with `valid`:
    a row counts if its number holds a digit. Cells are trimmed, empty ones are null; a row without a
    name is called by its number."""
    at = resolve_headers([c for c in sheet.columns if c != order])
    cell = lambda field: F.nullif(F.trim(F.col(f"`{at[field]}`").cast("string")), F.lit("")) if field in at else F.lit(None).cast("string")
    number = F.coalesce(cell("epbc_number"), F.lit(""))
    rows = sheet.select(
        F.col(order), number.alias("epbc_number"), number.rlike("[0-9]").alias("valid"), F.coalesce(cell("project_name"), number).alias("project_name"),
        *(cell(c).alias(c) for c in ("proponent", "location", "industry_type", "project_status", "state", "decision_status")), X.referral_date(cell("referral_date")).cast("string").alias("referral_date"),
    )
    kinds = X.technology(F.col("project_name"), F.lit(None).cast("string"))
    return rows.withColumns(kinds | {
        "is_approved": X.is_approved(F.col("project_status"), F.col("decision_status")), "size_mw": X.megawatts(F.col("project_name")),
        "source_url": F.concat(F.lit(url_base), F.replace("epbc_number", F.lit("/"), F.lit("-"))),
    })


def upload_labels(rows: DataFrame, stored: DataFrame, key: str = "epbc_number", order: str = "ord") -> DataFrame:
    """`rows` with `label`, as one row after another would have it: skipped (not valid), inserted (the
    first of a number that isn't stored), updated."""
    known = stored.select(F.col(key).alias("_known")).distinct()
    first = rows.filter("valid").groupBy(key).agg(F.min(order).alias("_first")).join(known, F.col(key) == F.col("_known"), "left_anti").select(F.col("_first"))
    labelled = rows.join(first, F.col(order) == F.col("_first"), "left")
    return labelled.withColumn("label", F.when(~F.col("valid"), "skipped").when(F.col("_first").isNotNull(), "inserted").otherwise("updated")).drop("_first")


def counters(labelled: DataFrame) -> DataFrame:
    """new, updated, skipped and total of labelled rows."""
    names = (("new_count", "inserted"), ("updated_count", "updated"), ("skipped", "skipped"))
    return labelled.agg(*(F.count_if(F.col("label") == label).alias(name) for name, label in names), F.count(F.lit(1)).alias("total"))


def year_bands(start: int = 2018, end: int = 2018) -> list[str]:
    """Labels of the years that a search is split into; "all years" if there is none."""
    return [str(y) for y in range(start, end + 1)] or ["all years"]


def search_answers(items: DataFrame, order: list[str]) -> DataFrame:
    """Referrals out of the items of many answers (epbc_number, project_name, proponent, state, status,
    notice_date): the first of each trimmed number stays; capacity and technology are not taken over."""
    named = items.withColumn("_key", F.trim(F.coalesce("epbc_number", F.lit("")))).filter("_key <> ''")
    return keep_first(named, ["_key"], order).select(
        F.col("epbc_number").alias("epbcNumber"), F.col("project_name").alias("projectName"), F.col("proponent").alias("proposer"), F.lit("Energy").alias("industryType"),
        F.col("status").alias("projectStatus"), "state", F.col("state").alias("location"), F.col("notice_date").alias("referralDate"),
    )


def import_url(number: Column, detail_base: str, list_url: str) -> Column:
    """A referral's page as the one-off import writes it: the number percent-encoded, or the list of all."""
    return F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit(detail_base), X.url_component(number))).otherwise(F.lit(list_url))


def portal_records(pages: DataFrame, page: str = "page") -> DataFrame:
    """Rows of portal pages, whichever of four envelopes they come in."""
    some = F.coalesce(*(F.col(f"{page}.{k}") for k in ("content", "results", "items", "referrals")))
    return pages.select(F.col("ord").alias("page_ord"), F.posexplode(some).alias("pos", "r")).select("page_ord", "pos", "r.*")


def normalise(records: DataFrame, url_base: str) -> DataFrame:
    """Canonical referrals. Only null falls through to the next field; an empty first choice drops
    the row, as does an industry that has nothing to do with energy."""
    text = F.col("description")
    named = records.select(
        F.trim(F.coalesce("referralNumber", "epbcNumber")).alias("epbc_number"),
        F.trim(F.coalesce("projectTitle", "title", "projectName")).alias("project_name"),
        F.coalesce("proposer", "proponent").alias("proponent"), F.col("industryType").alias("industry_type"),
        F.coalesce("projectStatus", "referralStatus").alias("project_status"), F.col("decisionStatus").alias("decision_status"),
        F.coalesce("primaryJurisdiction", "state").alias("state"), "location", text.alias("raw_description"),
        F.col("referralDate").alias("referral_date"), F.coalesce("approvalDate", "decisionDate").alias("approval_date"), "url",
    )
    energy = F.col("industry_type").isNull() | F.col("industry_type").rlike("(?i)energy|electricity|generation|supply|power")
    named = named.filter((F.col("epbc_number") != "") & (F.col("project_name") != "") & energy)
    size = F.coalesce(X.megawatts(F.col("raw_description")), X.megawatts(F.col("project_name")))
    url = F.concat(F.lit(url_base), F.replace("epbc_number", F.lit("/"), F.lit("-")))
    return named.withColumns(
        X.technology(F.col("project_name"), F.col("raw_description"))
        | {"size_mw": size, "is_approved": X.is_approved(F.col("project_status"), F.col("decision_status")), "source_url": F.coalesce("url", url)}
    ).drop("url")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, updates: tuple[str, ...], order: list[Column | str]) -> DataFrame:
    """The table after an upsert, with `action` (inserted, updated, unchanged).

    Known keys take the incoming values of `updates` only, so manual edits elsewhere survive.
    Of several incoming rows of a key the first inserts and the last updates, as one after another
    would. One full outer join; `VersionedTable.upsert` does it for the buckets that the incoming keys fall into."""
    columns = stored.columns
    first = keep_first(incoming, [key], order)
    last = keep_first(incoming, [key], [F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    new = first.select(F.col(key).alias("_k"), F.struct(*columns).alias("_first")).join(
        last.select(F.col(key).alias("_k"), F.struct(*(c for c in updates)).alias("_last")), "_k"
    )
    both = stored.withColumn("_here", F.lit(True)).join(new, F.col(key) == F.col("_k"), "full_outer")
    here, came = F.col("_here").isNotNull(), F.col("_k").isNotNull()
    out = []
    for c in columns:
        insert = F.col(f"_last.{c}") if c in updates else F.col(f"_first.{c}")
        update = F.when(came, F.col(f"_last.{c}")).otherwise(F.col(c)) if c in updates else F.col(c)
        out.append(F.when(here, update).otherwise(insert).alias(c))
    action = F.when(~here, "inserted").when(came, "updated").otherwise("unchanged")
    return both.select(*out, action.alias("action"))


def import_labels(rows: DataFrame, known_names: DataFrame, number: str, name: str, status: str, order: str) -> DataFrame:
    """`rows` with `label`: no_name, skipped (by status), duplicate (of a stored name or of an
    earlier row) or inserted, tested in this order. Rows without a name and skipped ones take no part in
    joins, so they are no hot key; rows with equal `order` get equal labels."""
    key = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    tagged = rows.withColumns({"_key": key, "_skip": F.coalesce(F.col(status).isin(*P.SKIPPED_STATUSES), F.lit(False))})
    usable = (F.col("_key") != "") & ~F.col("_skip")
    known = known_names.select(F.lower(F.trim("name")).alias("_known")).distinct()
    first = tagged.filter(usable).groupBy("_key").agg(F.min(order).alias("_o")).join(known, F.col("_key") == F.col("_known"), "left_anti")
    first = first.select(F.col("_key").alias("_k"), "_o")
    named = tagged.filter(usable).join(first, (F.col("_key") == F.col("_k")) & (F.col(order) == F.col("_o")), "left")
    named = named.withColumn("label", F.when(F.col("_o").isNotNull(), "inserted").otherwise("duplicate")).select(*rows.columns, "label")
    rest = tagged.filter(~usable).withColumn("label", F.when(F.col("_key") == "", "no_name").otherwise("skipped")).select(*rows.columns, "label")
    return named.unionByName(rest)


def to_projects(referrals: DataFrame, projects: DataFrame, today: datetime.date) -> DataFrame:
    """Referrals as new projects, without those whose URL is one already; of referrals with one URL the
    first by number becomes a project, and those without URL all do."""
    urls = projects.filter("source_url is not null").select("source_url").distinct()
    new = referrals.join(urls, "source_url", "left_anti")
    new = keep_first(new.filter("source_url is not null"), ["source_url"], ["epbc_number"]).unionByName(new.filter("source_url is null"))
    return new.select(
        F.col("project_name").alias("name"), F.col("raw_description").alias("description"),
        F.coalesce("size_mw", F.lit(0.0)).cast("decimal(10,2)").alias("capacity_mw"), F.col("proponent").alias("developer"),
        F.coalesce("location", "state").alias("location"), F.lit("AU").alias("country"),
        F.when(F.col("is_approved"), "under_development").otherwise("announced").alias("status"), "source_url",
        F.coalesce(F.left("referral_date", F.lit(10)).try_cast("date"), F.lit(today)).alias("announced_date"),
    )


def import_answers(asked: DataFrame, referrals: DataFrame, projects: DataFrame, order: str = "ord") -> DataFrame:
    """What requests to import referrals (id, `order`) are answered, one after another: 404 where there is no such
    referral, 409 where its URL is a project's or an earlier request made it one, else 201. Referrals without URL are
    always imported."""
    known = referrals.select("id", "source_url")
    urls = projects.filter("source_url is not null").select(F.col("source_url").alias("_u")).distinct()
    found = asked.join(known.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    first = found.filter("source_url is not null").groupBy("source_url").agg(F.min(order).alias("_first")).withColumnRenamed("source_url", "_s")
    joined = found.join(first, F.col("source_url") == F.col("_s"), "left").join(urls, F.col("source_url") == F.col("_u"), "left")
    taken = F.col("_u").isNotNull() | (F.col("_first") < F.col(order))
    answer = F.when(F.col("_id").isNull(), 404).when(F.col("source_url").isNull(), 201).when(taken, 409).otherwise(201)
    return joined.select(*asked.columns, answer.alias("answer"))
