"""Queries by where things stand in a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans
from ..functions import text as X
from .catalogue import EMAIL, TEXT_SQL, query, table

#: Words of companies and of stages; of these, the former occur in the test documents.
LITERALS = P.COMMON_COMPANY_WORDS + P.EARLY_STAGE + P.EXCLUDE
LITERALS_SQL = "values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LITERALS))


@query(f"""
select literal, count(*) as documents, cast(sum(n) as bigint) as occurrences from (
  select l.literal, (length(d.low) - length(replace(d.low, l.literal, ''))) // length(l.literal) as n
  from (select lower(text) as low from documents) d join ({LITERALS_SQL}) as l(i, literal) on contains(d.low, l.literal)) group by 1""")
def literal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each literal occurs, and how often: one pass for all of them."""
    texts = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), spans.literal_spans(F.col("text"), LITERALS)["literal"].alias("all"))
    found = texts.select("row", F.explode("all").alias("i"))
    of_row = found.groupBy("row", "i").agg(F.count(F.lit(1)).alias("n"))
    name = F.get(F.array(*(F.lit(x) for x in LITERALS)), F.col("i"))
    return of_row.groupBy("i").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences")).select(name.alias("literal"), "documents", "occurrences")


# Two figures and what follows each, at distances around the reach of the rule.

FOLLOWS = (" total", " of wind", " plant", " across australia", " installed", "h total", " capacity in New Zealand")
_FOLLOWS_SQL = "[" + ", ".join(f"'{x}'" for x in FOLLOWS) + "]"
_UNIT = r"\s*(?:mw|gw|megawatt|gigawatt)"
_MARKET = rf"(?i)\d+(?:\.\d+)?{_UNIT}\s+(?:cumulative|total|installed|of (?:solar|renewable|wind|bess|battery)|capacity in australia|capacity in new zealand|across australia)"


@query(f"""
with t as (select p_partkey, concat(p_name, ': ', p_size, '.5 MW', {_FOLLOWS_SQL}[1 + p_partkey % 7], ' ', repeat('x', cast(p_partkey % 97 as int)), ' ', p_size + 100, ' GW',
    {_FOLLOWS_SQL}[1 + p_partkey // 7 % 7]) as text, concat(p_size, '.5 MW') as one, concat(p_size + 100, ' GW') as two from part),
w as (select *, strpos(text, one) - 1 as a, strpos(text, two) - 1 as b from t)
select p_partkey, text, regexp_matches(text, '{_MARKET}') and regexp_matches(substr(text, greatest(a - 60, 0) + 1, a + 80 - greatest(a - 60, 0)), '{_MARKET}')
  and regexp_matches(substr(text, greatest(b - 60, 0) + 1, b + 80 - greatest(b - 60, 0)), '{_MARKET}') as only_statistics from w""")
def market_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts have capacities of markets alone."""
    follows = lambda i: F.get(F.array(*(F.lit(x) for x in FOLLOWS)), (i % 7).cast("int"))
    key = F.col("p_partkey")
    text = F.concat("p_name", F.lit(": "), "p_size", F.lit(".5 MW"), follows(key), F.lit(" "), F.expr("repeat('x', cast(p_partkey % 97 as int))"), F.lit(" "), F.col("p_size") + 100, F.lit(" GW"), follows(F.floor(key / 7)))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return rows.withColumn("only_statistics", spans.only_statistics(F.col("text")))


_BEFORE = "cast(coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint)"


@query(f"""
with t as (select doc_id, {TEXT_SQL.replace("html", "text")} as text from documents where contains(text, '@')),
s as (select doc_id, text, regexp_split_to_array(text, '{EMAIL}') as pieces, regexp_extract_all(text, '{EMAIL}') as found from t),
e as (select *, unnest(range(1, len(found) + 1)) as i from s),
p as (select doc_id, text, lower(found[i]) as email, {_BEFORE} as start from e)
select doc_id, email, start, substr(text, greatest(start - 200, 0) + 1, start + length(email) + 200 - greatest(start - 200, 0)) as context from p""")
def email_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address in a document, where it stands and what is around it."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").contains("@"))
    rows = docs.select("doc_id", F.inline(X.email_contexts(F.col("text"))))
    return rows.select("doc_id", "email", F.col("start").cast("long").alias("start"), "context")
