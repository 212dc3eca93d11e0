"""Landed content to canonical records.

Each parser takes a DataFrame of landed documents (source, url, ord, content, and country, AU where there is
no such column) and yields rows of one kind. Patterns run in the JVM; documents become rows by
explode, and the order of a row within its document goes along as `pos`. Rows have the fields of a scraped
record: what a text says of capacity, developer, place and status, and null for contacts it doesn't name.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..functions.spans import only_statistics
from ..operators.dedup import keep_first
from ..operators.gates import date_gate


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _one(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def explode_at(df: DataFrame, items: Column, name: str) -> DataFrame:
    return df.select("*", F.posexplode(items).alias("pos", name))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are worked out once a row. A plain column is worked out anew wherever a filter or another column asks
    for it, which counts where that is a pattern over a text."""
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def clean_cell(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def written_date(text: Column) -> Column:
    """The first ISO date or "Month d, yyyy" in a text, null if there is none or it can't be read."""
    return read_date(date_text(text))


def date_text(text: Column) -> Column:
    return _one(text, r"(\d{4}-\d{2}-\d{2}|[A-Za-z]+ \d{1,2},? \d{4})")


def read_date(found: Column) -> Column:
    """The date that `date_text` found; only formats of its shape are tried."""
    plain = F.replace(found, F.lit(","), F.lit(""))
    named = F.coalesce(F.try_to_date(plain, "MMMM d yyyy"), F.try_to_date(plain, "MMM d yyyy"))
    return F.when(found.rlike("^[0-9]"), F.try_to_date(found, "yyyy-MM-dd")).otherwise(named)


def date_or_today(text: Column, today: Column) -> tuple[Column, Column]:
    """(the date in a text, else `today`; whether it was the text's)."""
    found = written_date(text)
    return F.coalesce(found, today), found.isNotNull()


def feed_date(text: Column) -> Column:
    """A feed's date: "Tue, 02 Jan 2024 ..." or ISO."""
    return F.coalesce(F.try_to_date(_one(text, r"(\d{1,2} [A-Za-z]{3} \d{4})"), "d MMM yyyy"), written_date(text))


def _country(df: DataFrame) -> Column:
    return F.coalesce("country", F.lit("AU")) if "country" in df.columns else F.lit("AU")


def place_in(text: Column, country: Column) -> Column:
    """The first place of the record's country that the text names."""
    return F.when(country == "NZ", X.location(text, "NZ")).otherwise(X.location(text, "AU"))


def with_record(df: DataFrame, text: Column, today: Column | None, date_from: Column | None, date_to: Column | None, date: Column | None = None) -> DataFrame:
    """`df` (name, description, source_url) with what `text` says: capacity_mw unless there is one, developer, location,
    country, status and announced_date, a date that is not written being `today`. With a bound rows without
    a written date go, and so do those outside."""
    df = once(df, _text=text, _found=date_text(text) if date is None else F.lit(None).cast("string"))
    text = F.col("_text")
    df = once(df, _date=read_date(F.col("_found")) if date is None else date).drop("_found").withColumn("country", _country(df))
    fields = {"capacity_mw": X.capacity(text)} if "capacity_mw" not in df.columns else {}
    fields |= {"developer": X.developer(text), "location": place_in(text, F.col("country")), "status": X.status(text), "source_name": F.col("source")}
    fields["announced_date"] = F.col("_date") if today is None else F.coalesce("_date", today)
    df = df.withColumns(fields).filter(date_gate(F.col("_date").isNotNull(), F.col("announced_date"), date_from, date_to))
    none = F.lit(None).cast("string")
    return df.withColumns({c: none for c in ("contact_name", "contact_email", "contact_phone")}).drop("_text", "_date", "content")


def rss_items(feeds: DataFrame, today: Column, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """Items of RSS feeds that speak of solar power and of nothing that already generates. Tags may have attributes."""
    df = explode_at(feeds, _all(F.col("content"), r"(?is)<item>(.*?)</item>"), "item")

    def field(tag: str, flags: str) -> Column:
        pattern = rf"(?{flags})<{tag}[^>]*><!\[CDATA\[(.*?)\]\]></{tag}>|<{tag}[^>]*>(.*?)</{tag}>"
        return F.trim(F.coalesce(_one(F.col("item"), pattern, 1), _one(F.col("item"), pattern, 2), F.lit("")))

    link = F.trim(F.regexp_extract("item", r"(?i)<link[^>]*>(.*?)</link>|<link[^>]*/>", 1))
    df = once(df, name=field("title", "i"), source_url=link).filter("name <> '' and source_url <> ''")
    df = once(df, description=F.left(clean_cell(field("description", "is")), F.lit(800)), _pub=F.trim(_one(F.col("item"), r"(?i)<pubDate[^>]*>(.*?)</pubDate>")))
    df = once(df, _both=F.concat_ws(" ", "name", "description"))
    both = F.col("_both")
    return with_record(df.filter(X.mentions_solar(both) & ~X.has_any(both, X.P.EXCLUDE)), both, today, date_from, date_to, feed_date(F.col("_pub"))).drop("item", "_pub", "_both")


def html_blocks(pages: DataFrame, search_url: str = "url", today: Column | None = None, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """Article-like blocks of listings: early-stage solar news with a heading of 10 or more. Rules read the block as it
    is, marks and all; the description is its text."""
    block = r'(?is)<(?:article|div|section)[^>]*class="[^"]*(?:post|article|entry|item|result)[^"]*"[^>]*>(.*?)</(?:article|div|section)>'
    df = explode_at(pages, _all(F.col("content"), block), "block")
    raw = F.col("block")
    df = df.filter(X.mentions_solar(raw) & X.is_early_stage(raw)).withColumns({
        "name": F.trim(F.regexp_replace(F.coalesce(_one(raw, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit("")), "<[^>]+>", "")),
        "source_url": F.coalesce(_one(raw, r'(?i)href="(https?://[^"]+)"'), F.col(search_url)), "description": F.left(clean_cell(raw), F.lit(500)),
    }).filter(F.length("name") >= 10)
    return with_record(df, raw, today, date_from, date_to).drop("block")


def html_headings(pages: DataFrame, content: str = "html") -> DataFrame:
    """Every heading: level and text."""
    df = explode_at(pages, _all(F.col(content), r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), "h")
    return df.withColumns({"level": F.substring("h", 3, 1).cast("int"), "heading": clean_cell(F.col("h"))}).drop("h")


def html_list_items(pages: DataFrame, content: str = "html") -> DataFrame:
    return explode_at(pages, _all(F.col(content), r"(?is)<li[^>]*>(.*?)</li>"), "li").withColumn("item", clean_cell(F.col("li"))).drop("li")


def markdown_sections(pages: DataFrame, today: Column | None = None, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """Sections that begin at a heading of level 1 to 3, with a capacity, solar, and a usable name."""
    df = explode_at(pages, F.split(F.col("content"), r"\n(?=#{1,3} )"), "section")
    section = F.col("section")
    heading = F.trim(F.regexp_replace(F.regexp_extract(section, r"(?m)^#{1,3} ([^\n\r]+)", 1), r"[*\[\]`]", ""))
    line = F.get(F.filter(F.split(section, "\n"), lambda x: F.length(F.trim(x)) > 10), F.lit(0))
    head = F.col("_heading")
    df = once(df, _heading=heading, capacity_mw=X.capacity(section)).filter("capacity_mw is not null")
    df = once(df, name=F.when(F.length(head) >= 5, head).otherwise(F.trim(F.coalesce(line, F.lit(""))))).drop("_heading").filter(is_listed_project(F.col("name"), section, F.col("capacity_mw")) & ~only_statistics(section)).withColumns({
        "source_url": F.coalesce(_one(section, r"\[.*?\]\((https?://[^)]+)\)"), F.col("url")),
        "description": F.trim(F.left(F.regexp_replace(section, r"\A#{1,3} [^\n]+\n?", ""), F.lit(500))),
    })
    return with_record(df, section, today, date_from, date_to).drop("section")


def markdown_tables(pages: DataFrame) -> DataFrame:
    """Rows of pipe tables with a name (of the first cell, if no column is one of names) and a
    capacity: candidates, which `table_projects` passes through the gates. Empty cells are dropped
    before columns are counted, so cells after a blank move left."""
    table = r"(?m)((?:^[ \t]*\|[^\n]*\|[ \t]*(?:\n|\z)){2,})"
    df = pages.select("*", F.posexplode(_all(F.col("content"), table)).alias("table_pos", "table"))
    rows = F.filter(F.split(F.col("table"), r"\n"), lambda r: F.trim(r) != "")
    cells = lambda r: F.filter(F.transform(F.split(r, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    header = F.transform(cells(F.get(rows, F.lit(0))), F.lower)

    def position(words: str) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size("header") - 1, F.lit(0))), lambda i: F.coalesce(F.get(F.col("header"), i).rlike(words), F.lit(False)))
        return F.get(hits, F.lit(0))

    df = df.withColumn("header", header).withColumns({"name_at": position("name|project|title|proponent"), "mw_at": position("capacity|mw|size|power")})
    df = df.select("*", F.posexplode(rows).alias("pos", "row")).filter((F.col("pos") > 0) & ~F.col("row").rlike(r"^[\s|:\-]+\z"))
    df = df.withColumn("cells", cells(F.col("row"))).filter(F.size("cells") >= 2)
    name = F.regexp_replace(F.regexp_replace(F.coalesce(F.get("cells", F.col("name_at")), F.get("cells", F.lit(0))), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]", "")
    text = F.array_join("cells", " ")
    mw = F.coalesce(X.capacity(F.get("cells", F.col("mw_at"))), X.capacity(text))
    return df.withColumns({"name": F.trim(name), "capacity_mw": mw, "text": text}).filter("name <> '' and capacity_mw is not null").select(
        "source", "url", "ord", "table_pos", "pos", "name", "capacity_mw", F.col("row").alias("description"), "text", _country(df).alias("country")
    )


def is_listed_project(name: Column, text: Column, capacity_mw: Column) -> Column:
    """The row gates of listings: a capacity, some solar, nothing that already generates, a usable name."""
    return F.coalesce(
        X.mentions_solar(text) & ~X.has_any(text, X.P.EXCLUDE) & capacity_mw.isNotNull()
        & (F.length(name) >= 5) & ~X.is_noisy_name(name) & X.has_solar_component(name, text),
        F.lit(False),
    )


def _listed_projects(rows: DataFrame, today: Column, date_from: Column | None, date_to: Column | None) -> DataFrame:
    """Rows (name, text, capacity_mw) through the gates and the window, with what their text says."""
    df = rows.filter(is_listed_project(F.col("name"), F.col("text"), F.col("capacity_mw"))).withColumns({
        "source_url": F.coalesce(_one(F.col("text"), r"\[.*?\]\((https?://[^)]+)\)"), F.col("url")), "description": F.left("text", F.lit(500)),
    })
    return with_record(df, F.col("text"), today, date_from, date_to).drop("text")


def table_projects(pages: DataFrame, today: Column, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """Rows of pipe tables that are projects."""
    return _listed_projects(markdown_tables(pages), today, date_from, date_to)


def markdown_bullets(pages: DataFrame) -> DataFrame:
    """Bullets with a capacity; of equal names in a page the first stays. Candidates, without the
    gates of `bullet_projects`."""
    df = explode_at(pages, _all(F.col("content"), r"(?m)^[*\-]\s+(.+)$"), "bullet")
    name = F.regexp_replace(F.regexp_replace("bullet", r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]", "")
    name = F.trim(F.regexp_replace(name, r"(?i)\s*[-–(,:]?\s*\d+(?:\.\d+)?\s*(?:mw|gw|megawatt|gigawatt).*\z", ""))
    df = df.withColumns({"name": name, "capacity_mw": X.capacity(F.col("bullet"))}).filter((F.length("name") >= 5) & F.col("capacity_mw").isNotNull())
    return keep_first(df.withColumn("_n", F.lower("name")), ["ord", "_n"], ["pos"]).select("source", "url", "ord", "pos", "name", "capacity_mw")


def bullet_projects(pages: DataFrame, today: Column, date_from: Column | None = None, date_to: Column | None = None, captured: DataFrame | None = None) -> DataFrame:
    """Bullets that are projects; of equal names in a page the first that passes stays, unless
    `captured` (ord, name; what headings and tables of the page gave) has the name."""
    df = explode_at(pages, _all(F.col("content"), r"(?m)^[*\-]\s+(.+)$"), "bullet").withColumn("text", F.trim("bullet"))
    name = F.trim(F.regexp_replace(F.regexp_replace("text", r"\[([^\]]+)\]\([^)]+\)", "$1"), r"[*_`]", ""))
    name = F.trim(F.regexp_replace(name, r"(?i)\s*[–\-]\s*\d[\d,.]*\s*(?:mw|gw|megawatt|gigawatt).*\z", ""))
    name = F.trim(F.regexp_replace(name, r"(?i)\s*[–\-]\s*(?:under assessment|application|referred|approved|proposed|development|planning).*\z", ""))
    df = df.withColumns({"name": name, "capacity_mw": X.capacity(F.col("text")), "_n": F.lower(name)})
    df = _listed_projects(df, today, date_from, date_to)
    if captured is not None:
        df = df.join(captured.select("ord", F.lower("name").alias("_n")), ["ord", "_n"], "left_anti")
    return keep_first(df, ["ord", "_n"], ["pos"]).drop("_n", "bullet")


def captured_lists(documents: DataFrame, lists: str = "lists") -> DataFrame:
    """Rows of captured lists (map of list name to rows of columns), joined values, and the value
    of the first column whose name holds a word; a blank value hides later columns. Candidates,
    without the gates of `captured_projects`."""
    df = documents.select("*", F.explode(lists).alias("list", "rows")).select("*", F.posexplode("rows").alias("pos", "row"))

    def column(words: str) -> Column:
        hit = F.get(F.filter(F.map_entries("row"), lambda e: F.lower(e["key"]).rlike(words)), F.lit(0))
        return F.nullif(F.trim(hit["value"]), F.lit(""))

    values = F.array_join(F.map_values("row"), " ")
    fallback = F.get(F.filter(F.map_values("row"), lambda v: (F.length(v) > 5) & ~v.startswith("http") & ~F.trim(v).rlike(r"^\d+\z")), F.lit(0))
    return df.withColumns({"text": values, "name": F.coalesce(column("name|title|project"), fallback), "capacity_mw": X.capacity(values), "developer": column("developer|proponent|applicant|company|organisation|organization|operator|sponsor"), "row_url": F.coalesce(column("url|link|href|detail"), F.get(F.filter(F.map_values("row"), lambda v: v.startswith("http")), F.lit(0)))}).drop("rows", "row")


def captured_projects(documents: DataFrame, today: Column, date_from: Column | None = None, date_to: Column | None = None, lists: str = "lists") -> DataFrame:
    """Rows of captured lists that are projects. A row without a date counts as of today; `pv` is a
    word here, wherever it stands."""
    df = captured_lists(documents, lists).withColumn("name", F.trim(F.regexp_replace("name", r"\[([^\]]+)\]\([^)]+\)", "$1")))
    df = df.filter(is_listed_project(F.col("name"), F.regexp_replace("text", "(?i)" + X.P.whole_word("pv"), " pv "), F.col("capacity_mw")))
    found = _one(F.col("text"), r"(\d{4}-\d{2}-\d{2}|\d{1,2}[/\-]\d{1,2}[/\-]\d{4})")
    date = F.coalesce(F.try_to_date(found, "yyyy-MM-dd"), F.try_to_date(F.replace(found, F.lit("/"), F.lit("-")), "M-d-yyyy"), today)
    url = F.coalesce("row_url", "url") if "url" in documents.columns else F.col("row_url")
    df = df.withColumns({"announced_date": date, "developer": F.coalesce("developer", X.developer(F.col("text"))), "source_url": url, "description": F.left("text", F.lit(600))})
    return df.filter(date_gate(F.lit(True), F.col("announced_date"), date_from, date_to)).drop("row_url", "text")


def embedded_projects(pages: DataFrame, today: Column | None = None, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """Projects in development of a JSON array inside a page's script, solar by their kind and not
    known to be under 5 MW; a page whose array can't be read has none. A record without a date has
    an earlier one than any bound, and `today` (null, if not given) as its announcement."""
    raw = _one(F.col("content"), r"(?s)var project\s*=\s*(\[.*?\]);\s*(?:var|//|\z)")
    df = pages.select("*", F.posexplode(F.from_json(raw, schemas.EMBEDDED_PROJECTS)).alias("pos", "p"))
    mw = F.nullif(F.regexp_extract("p.capacity", r"^\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    place = F.concat_ws(", ", F.nullif("p.location", F.lit("")), F.nullif("p.state", F.lit("")))
    kind, state = F.coalesce("p.type", F.lit("")), F.coalesce("p.status", F.lit(""))
    early = F.lower(kind).rlike(X.P.EARLY_TYPE) | F.lower(state).rlike(X.P.EARLY_STATUS)
    wanted = F.col("p.energy_id").isin(1, 4, 9) & (mw.isNull() | (mw >= 5)) & early
    updated = F.left(F.coalesce("p.updated_at", F.lit("")), F.lit(10))
    if date_from is not None:
        wanted &= updated >= date_from.cast("string")
    if date_to is not None:
        wanted &= updated <= date_to.cast("string")
    return df.filter(wanted).select(
        "source", "url", "ord", "pos", F.col("p.project_name").alias("name"), F.col("p.description").alias("description"), mw.alias("capacity_mw"),
        F.coalesce(F.nullif("p.developer", F.lit("")), "p.owner").alias("developer"), F.nullif(place, F.lit("")).alias("location"),
        F.when(F.col("p.country") == "NZ", "NZ").otherwise("AU").alias("country"),
        F.when(kind == "In Development", "under_development").otherwise(X.status(F.concat_ws(" ", kind, state))).alias("status"),
        (updated.try_cast("date") if today is None else F.coalesce(updated.try_cast("date"), today)).alias("announced_date"),
        F.when(X.valid_project_contact(F.col("p.contact_email"), F.coalesce("p.developer", "p.owner")), F.col("p.contact_email")).alias("contact_email"),
    )


def milestone_rows(pages: DataFrame, day: Column | None = None) -> DataFrame:
    """Rows of newsletter tables (name, state of the project, place, developer, description by position) that are
    news of solar projects of 5 MW or more. `day` is the newsletter's date."""
    df = pages.select("*", F.posexplode(_all(F.col("content"), r"(?is)<table[^>]*>(.*?)</table>")).alias("table_pos", "table"))
    df = df.select("*", F.posexplode(_all(F.col("table"), r"(?is)<tr[^>]*>(.*?)</tr>")).alias("pos", "tr"))
    plain = lambda c: F.trim(F.regexp_replace(F.replace(F.replace(F.regexp_replace(c, "<[^>]+>", " "), F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" ")), r"\s+", " "))
    df = df.withColumn("cells", F.transform(_all(F.col("tr"), r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), plain)).filter(F.size("cells") >= 4)
    at = lambda i: F.get("cells", F.lit(i))
    df = df.withColumns({"name": at(0), "milestone": F.lower(at(1)), "state": at(2), "dev": at(3), "about": F.coalesce(at(4), F.lit(""))})
    both = F.concat_ws(" ", "name", "about")
    wanted = (F.length("name") >= 4) & ~F.lower("name").isin(*X.P.MILESTONE_HEADERS) & X.has_any(F.col("milestone"), X.P.MILESTONE_STATES)
    solar = X.has_solar_component(F.col("name"), F.col("about")) & ~X.is_wind(F.col("name"), F.col("about"))
    df = df.withColumn("capacity_mw", X.capacity(both)).filter(wanted & solar & (F.col("capacity_mw") >= 5))
    return df.withColumns({
        "country": F.when(F.col("state").rlike(X.P.whole_word("NZ")), "NZ").otherwise("AU"), "description": F.left(F.coalesce(F.nullif("about", F.lit("")), both), F.lit(600)),
        "developer": F.when(F.length("dev").between(2, 99), F.col("dev")), "location": F.when((F.length("state") < 30) & (F.col("state") != ""), F.col("state")),
        "status": F.when(X.has_any(F.col("milestone"), X.P.MILESTONE_UNDER_WAY), "under_development").otherwise("announced"),
        "source_url": F.concat("url", F.lit("#milestone-"), X.url_component(F.left("name", F.lit(40)))), "announced_date": F.lit(None).cast("date") if day is None else day,
    }).drop("dev", "state", "about", "cells", "tr", "table", "content")


def newsletter_sections(pages: DataFrame, day: Column | None = None) -> DataFrame:
    """Sections NEW PROJECT and PROJECT UPDATE of newsletters, in any case and wherever they stand, that speak of solar power and
    have 5 MW or more, as the 700 characters from their heading on say: the last section has no end but the page's. The first section
    of a name in a newsletter stands for it, even where a later gate drops it."""
    df = explode_at(pages, F.split(X.strip_html(F.col("content")), "(?i)(?=NEW PROJECT:|PROJECT UPDATE:|PROJECT MILESTONE:)"), "section")
    name = F.trim(F.regexp_extract("section", r"(?i)^(?:NEW PROJECT|PROJECT UPDATE):\s*([^.\n]+)", 1))
    # what is sorted by name has no more of the text than later columns ask for
    df = once(df.drop("content"), body=F.left("section", F.lit(700)), name=name).drop("section").filter((F.length("name") >= 5) & X.has_any(F.col("body"), X.P.SOLAR_TITLES))
    df = df.withColumn("source_url", F.concat("url", F.lit("#"), X.url_component(F.left("name", F.lit(40)))))
    df = once(keep_first(df, ["ord", "source_url"], ["pos"]), capacity_mw=X.capacity(F.col("body"))).filter(F.col("capacity_mw") >= 5)
    return df.withColumns({
        "status": F.when(F.lower("body").startswith("new"), "announced").otherwise("under_development"), "description": F.left(F.trim("body"), F.lit(600)),
        "developer": X.developer(F.col("body")), "location": X.location(F.col("body")), "country": F.lit("AU"), "announced_date": F.lit(None).cast("date") if day is None else day,
    }).drop("body")


NEWSLETTER_PROJECT = "name string, description string, capacity_mw double, developer string, location string, country string, status string"


def with_answers(found: DataFrame, answers: DataFrame, day: Column) -> DataFrame:
    """`found` (rows of tables and sections of newsletters), and projects of a model's answers (source, url, ord, content) about those
    newsletters of which it has none: a capacity that the answer lacks is looked for in its text,
    nameless ones and those known to be under 5 MW go, and the first of each name stays. Both go through one window by
    newsletter, so `found` is worked out once and newsletters dealt by ord need no join."""
    raw = answers.select("source", "url", "ord", F.col("content").alias("_answer"), F.lit(False).alias("_found"))
    rows = found.withColumn("_found", F.lit(True)).unionByName(raw, allowMissingColumns=True)
    have = F.col("ord").isNotNull() & F.max("_found").over(Window.partitionBy("ord"))
    rows = rows.withColumn("_have", have).filter(F.col("_found") | ~F.col("_have")).drop("_have")
    items = F.from_json(X.json_array(F.col("_answer")), f"array<struct<{NEWSLETTER_PROJECT}>>")
    none = F.array(F.lit(None).cast(f"struct<{NEWSLETTER_PROJECT}>"))
    df = rows.select("*", F.posexplode(F.when(F.col("_found"), none).otherwise(items)).alias("_pos", "item")).drop("_answer")
    p = lambda k: F.col(f"item.{k}")
    text = F.concat_ws(" ", F.coalesce(p("name"), F.lit("")), F.coalesce(p("description"), F.lit("")))
    said = {
        "pos": F.col("_pos"), "name": p("name"), "description": F.coalesce(p("description"), p("name")), "capacity_mw": F.coalesce(p("capacity_mw"), X.capacity(text)),
        "developer": p("developer"), "location": p("location"), "country": F.when(p("country") == "NZ", "NZ").otherwise("AU"),
        "status": F.when(p("status") == "under_development", "under_development").otherwise("announced"),
        "source_url": F.concat("url", F.lit("#gpt-"), X.url_component(F.left(p("name"), F.lit(40)))), "announced_date": day,
    }
    df = once(df, **{k: F.when(F.col("_found"), F.col(k)).otherwise(c) for k, c in said.items()}).drop("item", "_pos")
    df = df.filter(F.col("_found") | ((F.coalesce("name", F.lit("")) != "") & (F.col("capacity_mw").isNull() | (F.col("capacity_mw") >= 5))))
    first = F.row_number().over(Window.partitionBy("ord", "source_url").orderBy("pos"))
    return df.withColumn("_first", first).filter(F.col("_found") | (F.col("_first") == 1)).drop("_found", "_first")


def decode_snapshot(encoded: Column, key: bytes) -> Column:
    """Base64, then XOR with a repeating key; the text inside, null if there is none or it can't be read. One pass
    over the bytes of a batch of snapshots."""

    @F.pandas_udf("string")
    def decode(some: pd.Series) -> pd.Series:
        return some.map(lambda x: _unmask(x, key), na_action="ignore")

    return F.when(F.length(encoded) > 0, decode(encoded))


def _unmask(encoded: str, key: bytes) -> str | None:
    try:
        plain = np.frombuffer(base64.b64decode(encoded), np.uint8)
        return (plain ^ np.resize(np.frombuffer(key, np.uint8), len(plain))).tobytes().decode()
    except ValueError:
        return None


def snapshot_projects(pages: DataFrame, key: bytes, today: Column, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """Solar projects of encoded snapshots (a JSON array under a repeating key): energy, one of four
    statuses, 5 MW or more, no wind; of equal names in a snapshot the first stays. Snapshots have no
    dates of their own, so all count as of today. A snapshot that can't be read has none."""
    df = pages.withColumn("_json", decode_snapshot(F.trim("content"), key))
    df = df.select("*", F.posexplode(F.from_json("_json", schemas.SNAPSHOT_PROJECTS)).alias("pos", "p"))
    field = lambda k: F.trim(F.coalesce(F.col(f"p.{k}"), F.lit("")))
    mw = _one(F.col("p.capacity"), r"^\s*([+\-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+\-]?\d+)?)").cast("double")
    df = df.withColumns({"name": field("name"), "capacity_mw": mw, "_about": F.concat_ws(" ", field("name"), field("type"), field("subtype")), "_n": F.lower(field("name"))})
    wanted = (
        (F.col("name") != "") & (field("category") == "Energy") & field("status").isin(*X.P.SNAPSHOT_STATUSES) & (F.col("capacity_mw") >= 5)
        & X.has_solar_component(F.col("_about")) & ~X.is_wind(F.col("name"), F.col("_about")) & date_gate(F.lit(True), today, date_from, date_to)
    )
    df = keep_first(df.filter(wanted), ["ord", "_n"], ["pos"])
    place = F.nullif(F.concat_ws(", ", F.nullif(field("location"), F.lit("")), F.nullif(field("state"), F.lit(""))), F.lit(""))
    kind = F.concat(field("type"), F.when((field("subtype") != "") & (field("subtype") != field("type")), F.concat(F.lit(" — "), field("subtype"))).otherwise(""))
    size = F.concat(F.coalesce("p.capacityRaw", F.regexp_replace(F.col("capacity_mw").cast("string"), r"\.0\z", "")), F.lit(" MW"))
    return df.select(
        "source", "ord", "pos", "name", "capacity_mw", F.concat_ws(" · ", F.nullif(kind, F.lit("")), field("status"), place, size).alias("description"),
        F.nullif(field("owner"), F.lit("")).alias("developer"), place.alias("location"), F.lit("AU").alias("country"),
        F.when(field("status") == "Proposed", "announced").otherwise("under_development").alias("status"),
        F.concat("url", F.lit("#"), X.url_component(F.col("_n"))).alias("source_url"), today.alias("announced_date"),
    )


def news_cards(pages: DataFrame, today: Column, link: str, block: str = "news-block-four") -> DataFrame:
    """Cards of a news listing: title, source_url (the first link that matches `link`), announced_date (a
    "Published Date: 2024-June-12", else `today`); cards without link or title have no row."""
    card = rf'(?is)<div[^>]*class="[^"]*{block}[^"]*"[^>]*>(.*?)</div>\s*</div>\s*</div>'
    df = explode_at(pages, _all(F.col("content"), card), "card").withColumns({
        "source_url": _one(F.col("card"), rf'(?i)href="({link}[^"]+)"'),
        "title": F.trim(F.regexp_replace(F.regexp_replace(_one(F.col("card"), r"(?is)<h[23][^>]*>(.*?)</h[23]>"), "<[^>]+>", ""), r"\s+", " ")),
        "announced_date": F.coalesce(X.long_date(_one(F.col("card"), r"(?i)Published\s+Date:\s*(\d+-[A-Za-z]+-\d+)")), today),
    })
    return df.filter("source_url is not null and title <> ''").drop("card", "content")


def news_projects(cards: DataFrame, articles: DataFrame, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """Projects among news cards, with the text of their articles (source_url, html; one at most for each
    link): a title that speaks of solar power and has the shape of a project's name, and an early stage. Of
    cards with one link the first that passes stays."""
    detail = _one(F.col("html"), r'(?is)<div[^>]*class="[^"]*(?:lower-box|post-details|blog-content)[^"]*"[^>]*>(.*?)</div>')
    bodies = articles.select(F.col("source_url").alias("_u"), F.left(clean_cell(F.coalesce(detail, F.lit(""))), F.lit(1000)).alias("body"))
    wanted = X.has_any(F.col("title"), X.P.SOLAR_TITLES) & ~X.is_noisy_name(F.col("title"), True) & date_gate(F.lit(True), F.col("announced_date"), date_from, date_to)
    df = cards.filter(wanted).join(bodies, F.col("source_url") == F.col("_u"), "left").withColumn("body", F.coalesce("body", F.lit("")))
    df = df.withColumn("text", F.concat_ws(" ", "title", "body")).filter(X.is_early_stage(F.col("text")))
    text = F.col("text")
    return keep_first(df, ["source_url"], ["ord", "pos"]).select(
        "source", "ord", "pos", F.col("title").alias("name"), F.coalesce(F.nullif(F.left("body", F.lit(600)), F.lit("")), "title").alias("description"), X.capacity(text).alias("capacity_mw"),
        X.developer(text).alias("developer"), X.location(text).alias("location"), F.lit("AU").alias("country"), X.status(text).alias("status"), "source_url", "announced_date",
    )


#: Characters before a link, and from it on, among which its date is looked for; and the fewest that a link takes.
BEFORE, AFTER, LEAST_LINK = 200, 300, len('href=""') + 1


def with_links(pages: DataFrame, link: str) -> DataFrame:
    """`pages` with `links`, the places of links in the order of the page: url and around, what stands about that place. A page is cut
    at its links and the pieces are shortened before they are put together again, so the work on it grows with its
    length, however many links it has."""
    href, most = F.lit(rf'(?i)href="{link}[^"]+"'), lambda characters: F.lit(-(-characters // LEAST_LINK))
    df = once(pages, links=F.regexp_extract_all("content", href, F.lit(0)), _gaps=F.split("content", href))
    heads = F.transform("links", lambda x, i: F.left(F.concat(x, F.get("_gaps", i + 1)), F.lit(AFTER)))
    tails = F.transform("_gaps", lambda gap, i: F.right(F.concat(F.coalesce(F.get("links", i - 1), F.lit("")), gap), F.lit(BEFORE)))

    def place(href: Column, i: Column) -> Column:
        before = F.array_join(F.slice("_tails", F.greatest(i + 2 - most(BEFORE), F.lit(1)), F.least(i + 1, most(BEFORE))), "")
        after = F.array_join(F.slice("_heads", i + 1, most(AFTER)), "")
        around = F.concat(F.right(before, F.lit(BEFORE)), F.left(after, F.lit(AFTER)))
        return F.struct(F.substr(href, F.lit(7), F.length(href) - 7).alias("url"), around.alias("around"))

    return once(once(df, _heads=heads, _tails=tails).drop("_gaps"), links=F.transform("links", place)).drop("_heads", "_tails")


def newsletter_index(pages: DataFrame, today: Column, link: str, block: str = "pdf-block-watts-new") -> DataFrame:
    """Newsletters that an index page links to (source_url, announced_date), found in two ways: in blocks of a
    class, dated by their heading; and at any link, dated by what stands up to 200 characters before and
    300 after it. Of one link in a page the first find stays, blocks before links."""
    found = lambda way, pos, url, text: F.struct(F.lit(way).alias("way"), pos.alias("pos"), url.alias("source_url"), text.alias("_text"))
    blocks = F.transform(
        _all(F.col("content"), rf'(?is)<div[^>]*class="[^"]*{block}[^"]*"[^>]*>(.*?)</div>\s*</div>\s*</div>'),
        lambda b, i: found(0, i, F.regexp_extract(b, rf'(?i)href="({link}[^"]+)"', 1), F.regexp_replace(F.regexp_extract(b, r"(?is)<h2[^>]*>(.*?)</h2>", 1), "<[^>]+>", "")),
    )
    links = F.transform("links", lambda x, i: found(1, i, x["url"], F.regexp_replace(x["around"], "<[^>]+>", " ")))
    finds = with_links(pages, link).select("ord", F.inline(F.concat(blocks, links))).filter("source_url <> ''")
    finds = once(finds, _day=F.regexp_replace(F.regexp_extract("_text", r"(\d{1,2}\s+[A-Za-z]+\s+\d{4})", 1), r"\s+", " "))
    finds = once(finds.drop("_text"), announced_date=F.coalesce(X.long_date(F.col("_day")), today)).drop("_day")
    return keep_first(finds, ["ord", "source_url"], ["way", "pos"]).select("ord", "source_url", "announced_date")


ANSWER_PROJECT = "name string, description string, capacity_mw double, developer string, location string, country string, status string, source_url string, announced_date string"


def answer_projects(answers: DataFrame, today: Column) -> DataFrame:
    """Projects of a model's answers about a source (source, url, ord, content): nameless ones and those known
    to be under 5 MW go, what is missing gets the source's defaults."""
    df = answer_items(answers, ANSWER_PROJECT)
    p = lambda k: F.col(f"item.{k}")
    return df.filter((F.coalesce(p("name"), F.lit("")) != "") & (p("capacity_mw").isNull() | (p("capacity_mw") >= 5))).select(
        "source", "ord", "pos", p("name").alias("name"), F.coalesce(p("description"), p("name")).alias("description"), p("capacity_mw").alias("capacity_mw"),
        p("developer").alias("developer"), p("location").alias("location"), F.when(p("country") == "NZ", "NZ").otherwise("AU").alias("country"),
        F.when(p("status") == "under_development", "under_development").otherwise("announced").alias("status"), F.coalesce(p("source_url"), "url").alias("source_url"),
        F.coalesce(p("announced_date").try_cast("date"), today).alias("announced_date"),
    )


def answer_items(answers: DataFrame, schema: str, column: str = "content") -> DataFrame:
    """Items of a model's answer; an answer that can't be read has none."""
    return answers.select("*", F.posexplode(F.from_json(X.json_array(F.col(column)), f"array<struct<{schema}>>")).alias("pos", "item"))


def page_limit(pages: DataFrame, size: int, most: int = 50) -> DataFrame:
    """Portal pages up to the first short one, at most `most`."""
    short = F.max((F.col("items") < size).cast("int")).over(Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("_s", short).filter(F.coalesce(F.col("_s"), F.lit(0)) == 0).filter(F.col("page") < most).drop("_s")
