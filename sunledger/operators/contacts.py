"""Contacts: one list from many files, and matching organisations to developers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .dedup import keep_first
from .matching import best_names
from .numbering import number_rows
from .staging import stage


def union_contacts(frames: list[DataFrame]) -> DataFrame:
    """name, company, email, phone, source of all files; the first row of an address stays.

    Each frame has `ord`, its order within its file; files count in the order given."""
    parts = []
    for i, df in enumerate(frames):
        email = F.lower(F.trim("email"))
        parts.append(df.withColumns({"email": email, "_file": F.lit(i)}).filter(email.contains("@")))
    both = parts[0]
    for df in parts[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    return keep_first(both, ["email"], ["_file", "ord"]).drop("_file")


#: The columns of a contact file, each with its field.
CONTACT_COLUMNS = {
    "First Name": "first_name", "Middle Name": "middle_name", "Last Name": "last_name", "Organization Name": "organization_name",
    "Organization Title": "organization_title", "E-mail 1 - Value": "email1", "E-mail 2 - Value": "email2",
}


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """A contact file as text columns. Quoted commas and line feeds stay inside their field."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def contact_rows(raw: DataFrame) -> DataFrame:
    """Contacts that a reload takes: cells trimmed, empty ones null, rows without any address gone."""
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    rest = [c for c in raw.columns if c not in CONTACT_COLUMNS]
    return raw.select(*rest, *(cell(c).alias(name) for c, name in CONTACT_COLUMNS.items())).filter("email1 is not null or email2 is not null")


def reload_contacts(raw: DataFrame, order: str) -> DataFrame:
    """The whole contact table anew, ids from 1 by `order` (the number of the row in its file)."""
    return number_rows(contact_rows(raw), [order])


def split_person(name: Column) -> tuple[Column, Column]:
    """(first, last) of a contact's name at its first space; null for teams and for single words."""
    full = F.trim(name)
    at = F.instr(full, F.lit(" "))
    one = (at > 1) & ~full.rlike(f"(?i){P.NOT_ONE_PERSON}")
    return F.when(one, F.left(full, at - 1)), F.when(one, F.substr(full, at + 1))


def with_fallback(projects: DataFrame, matches: DataFrame) -> DataFrame:
    """New projects of a known developer without name and address of a contact take those of the developer's
    best match; a phone is never taken. `matches` is what `match_contacts` gives."""
    found = matches.select(F.col("developer").alias("_d"), F.col("contact_name").alias("_name"), F.col("contact_email").alias("_email"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    use = F.col("is_new") & blank("contact_email") & blank("contact_name") & ~blank("developer") & F.col("_email").isNotNull()
    joined = projects.join(found, F.col("developer") == F.col("_d"), "left")
    return joined.withColumns({"contact_name": F.when(use, F.col("_name")).otherwise(F.col("contact_name")), "contact_email": F.when(use, F.col("_email")).otherwise(F.col("contact_email"))}).select(*projects.columns)


def first_companies(contacts: DataFrame, n: int = 50) -> DataFrame:
    """The first `n` companies in alphabetical order."""
    return contacts.select("company").distinct().orderBy("company").limit(n)


def enrichment_counters(projects: DataFrame, updated: DataFrame, key: str = "id") -> DataFrame:
    """checked (rows that needed a contact) and updated (rows among them that were written)."""
    checked = projects.filter(needs_enrichment()).select(key)
    both = checked.join(updated.select(F.col(key).alias("_u")).distinct(), F.col(key) == F.col("_u"), "left")
    return both.agg(F.count(F.lit(1)).alias("checked"), F.count("_u").alias("updated"))


def company_contacts(contacts: DataFrame) -> DataFrame:
    """The distinct addresses of each normalised company, a row each: company_key, email, pos (from 1, in alphabetical
    order) and spellings (how many its name has)."""
    keyed = contacts.filter("company is not null and company <> ''").withColumn("company_key", X.company_key(F.col("company")))
    pos = F.row_number().over(Window.partitionBy("company_key").orderBy("email"))
    names = keyed.select("company_key", "company").distinct().groupBy("company_key").agg(F.count(F.lit(1)).alias("spellings"))
    return keyed.select("company_key", "email").distinct().withColumn("pos", pos).join(names, "company_key")


def match_contacts(developers: DataFrame, contacts: DataFrame) -> DataFrame:
    """The best contact of each developer: developer, contact_name, contact_email, score.

    Names are compared without company words: equal 100, one within the other 80, else 60 times
    the shared words over the longer list; at least 40. Ties go to the earlier contact (`ord`).
    Developers and organisations are reduced to distinct keys first; see `matching` for how keys meet.
    """
    devs = developers.select("developer").distinct().withColumn("dev", X.contact_key(F.col("developer"))).filter("dev <> ''")
    orgs = contacts.filter("organization_name is not null and organization_name <> '' and email1 is not null and email1 <> ''")
    orgs = orgs.withColumn("org", X.contact_key(F.col("organization_name"))).filter("org <> ''")
    orgs = stage(keep_first(orgs, ["org"], ["ord"]).select("org", "ord", "first_name", "last_name", "organization_name", "email1"))
    names = stage(devs.select(F.col("dev").alias("name")).distinct())
    top = best_names(names, orgs.select(F.col("org").alias("other"), "ord")).join(orgs, F.col("other") == F.col("org"))
    person = F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit("")))
    name = F.coalesce(F.nullif(person, F.lit("")), "organization_name")
    return devs.join(top, F.col("dev") == F.col("name")).select("developer", name.alias("contact_name"), F.col("email1").alias("contact_email"), "score")


def needs_enrichment(email: str = "contact_email", name: str = "contact_name", developer: str = "developer"):
    """No contact at all, a general mailbox, or an address that isn't the developer's."""
    e = F.coalesce(F.col(email), F.lit(""))
    general = F.lower(e).rlike("^(?:" + P.any_of(P.GENERIC_PREFIXES) + ")")
    nothing = (e == "") & (F.coalesce(F.col(name), F.lit("")) == "")
    return nothing | ((e != "") & (general | ~X.valid_project_contact(e, F.col(developer))))
