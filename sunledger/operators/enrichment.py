"""Contact enrichment: grouping projects, picking from responses, the cascade of phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .dedup import keep_first


def _keyed(projects: DataFrame, order: str, skip_urls: tuple[str, ...]) -> DataFrame:
    key = F.coalesce(F.nullif(F.lower(F.trim("developer")), F.lit("")), F.concat(F.lit("id:"), F.col("id").cast("string")))
    domain = F.coalesce(F.nullif(X.email_domain(F.col("contact_email")), F.lit("")), X.developer_domain(F.col("source_url"), skip_urls))
    return projects.select(key.alias("group_key"), F.col("id"), F.col(order).alias("_o"), domain.alias("domain"), F.nullif("contact_name", F.lit("")).alias("name"))


def _first(c: str) -> Column:
    return F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c)


def enrichment_summary(projects: DataFrame, order: str = "id", skip_urls: tuple[str, ...] = ()) -> DataFrame:
    """Projects by developer (or alone, without one): how many, the first id, the first known e-mail
    domain or allowed source host, and the first contact name. All partial aggregates, so a group
    may be any share of the table."""
    return _keyed(projects, order, skip_urls).groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n_projects"), F.min(F.struct("_o", "id"))["id"].alias("first_project"), _first("domain"), _first("name")
    ).withColumnRenamed("name", "existing_name")


def enrichment_members(projects: DataFrame, order: str = "id", skip_urls: tuple[str, ...] = ()) -> DataFrame:
    """The projects of each group of `enrichment_summary`, a row each: group_key, id, pos (from 1, by `order`)."""
    pos = F.row_number().over(Window.partitionBy("group_key").orderBy("_o", "id")).alias("pos")
    return _keyed(projects, order, skip_urls).select("group_key", "id", pos)


def running_best(people: DataFrame, group: str, order: str, relevant: Column, seniority: Column, most: int = 200) -> DataFrame:
    """Of each group's search results (at most `most`, as a search gives) the one that a loop over them ends with: the first
    relevant one, replaced by a later one whose seniority exceeds the number of words in the title it has."""
    rows = people.filter(relevant).withColumn("_s", seniority).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_k") <= most)
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_k", "name", "title", "_s"))).alias("r"))
    words = lambda b: F.size(F.split(b["title"], " "))
    best = F.aggregate(F.slice("r", 2, most), F.get("r", F.lit(0)), lambda b, x: F.when(x["_s"] > words(b), x).otherwise(b))
    return listed.select(group, best["name"].alias("name"), best["title"].alias("title"))


def title_seniority(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.rlike("director|head|ceo|chief|managing"), 3).when(low.contains("manager"), 2).otherwise(1)


def cascade(candidates: DataFrame, order: list[str]) -> DataFrame:
    """The first phase's first candidate of each group: a later phase sees only what is left."""
    return keep_first(candidates, ["group_key"], order)


def apply_contacts(projects: DataFrame, found: DataFrame) -> DataFrame:
    """Found contacts on every project of their group: names fill gaps, e-mails replace, phones
    replace if there is one. `found` has id, found_name, group_name, found_email, found_phone."""
    joined = projects.join(found, "id", "left")
    return joined.withColumns({
        "contact_name": F.when(F.col("found_email").isNotNull(), F.coalesce("found_name", "group_name", "contact_name")).otherwise(F.col("contact_name")),
        "contact_email": F.coalesce("found_email", "contact_email"),
        "contact_phone": F.when(F.col("found_email").isNotNull(), F.coalesce("found_phone", "contact_phone")).otherwise(F.col("contact_phone")),
    }).select(*projects.columns)


def best_email(emails: Column) -> Column:
    """Of (email, type, confidence): the first work address of grade A+, any work address, the first."""
    work = F.filter(emails, lambda e: F.coalesce(F.lower(e["type"]) == "work", F.lit(False)))
    top = F.filter(work, lambda e: F.coalesce(e["confidence"] == "A+", F.lit(False)))
    return F.coalesce(F.get(top, F.lit(0))["email"], F.get(work, F.lit(0))["email"], F.get(emails, F.lit(0))["email"])


def best_phone(phones: Column) -> Column:
    """Of (number, type): the first mobile that isn't masked, else any number that isn't."""
    plain = F.filter(phones, lambda p: p["number"].isNotNull() & ~p["number"].contains("..."))
    mobile = F.filter(plain, lambda p: F.coalesce(F.lower(p["type"]) == "mobile", F.lit(False)))
    return F.coalesce(F.get(mobile, F.lit(0))["number"], F.get(plain, F.lit(0))["number"])


def positional_join(queries: DataFrame, results: DataFrame) -> DataFrame:
    """The i-th result of a batch belongs to its i-th query; what has no partner goes."""
    return queries.join(results, ["batch", "pos"])


def best_by_title(people: DataFrame, group: str, title: str, order: str) -> DataFrame:
    """The person with the highest title score in each group, the earlier on ties; both names needed."""
    named = people.filter("first_name <> '' and last_name <> ''").withColumn("title_score", X.title_score(F.col(title)))
    return keep_first(named, [group], [F.desc("title_score"), order])
