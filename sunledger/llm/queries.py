"""The queries of this subpackage, and SQL for those that SQL can express.

Each query applies its operator to a whole table and derives the contract's columns from the
operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import audit_sources
from .exact_dedup import dedup_documents
from .jaccard_join import component_of_documents
from .mixing import mix_documents
from .nearest_neighbours import nearest
from .packing import pack_documents
from .quality_classifier import score_quality
from .quality_rules import apply_rules
from .sharding import shard_documents
from .substring_dedup import remove_repeats
from .toxicity import score_toxicity
from .vector_codes import compress
from .warc import archive_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = apply_rules(spark, table(spark, sf_dir, "documents"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark, table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_of_documents(spark, table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_documents(spark, table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(spark, table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark, table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_source_mixing": op4_source_mixing,
    "op5_sharding": op5_sharding,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_warc": op10_warc,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_codes": op13_vector_codes,
}

WORDS = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _codes_sql(rounds: int = 2, parts: int = 16, length: int = 4, entries: int = 64) -> str:
    """Brute force: every part against every entry of its codebook, `rounds` times and once more."""
    distance = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, length + 1))
    steps = [
        "k as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"p as (select r, i as part, v[i * {length} + 1 : i * {length} + {length}] as x from k, range({parts}) t(i))",
        f"c0 as (select part, row_number() over (partition by part order by vec_id) - 1 as e, x as c from p join k using (r) where r in (select r from k order by vec_id limit {entries}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} as (select r, part, min(d) as d, arg_min(e, d * {entries} + e) as e from (select r, part, e, {distance} as d from p join c{i} using (part)) group by 1, 2)")
        if i < rounds:
            means = ", ".join(f"floor(sum(x[{j}])::double / count(*))::bigint" for j in range(1, length + 1))
            steps.append(f"c{i + 1} as (select part, e, coalesce(m, c) as c from c{i} left join (select part, e, [{means}] as m from a{i} join p using (r, part) group by 1, 2) using (part, e))")
    steps.append(f"s as (select r, string_agg(printf('%02x', e), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by 1)")
    steps.append(f"h as (select sha256(string_agg(x, ',' order by part, e)) as codebooks_sha256 from (select part, e, array_to_string(c, ',') as x from c{rounds}))")
    return f"with {', '.join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from s join k using (r), h"


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""with d as (select row_number() over () as r, doc_id, {WORDS.format("text")} as w from documents),
h as (select r, unnest(range(1, len(w) - 33)) as i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) as k from d where len(w) >= 35),
again as (select r, i from h qualify count(*) over (partition by k) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as j from again),
words as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from d),
kept as (select r, string_agg(x, ' ' order by j) as s, count(*) as n from words anti join gone using (r, j) group by r)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(s, '')) as kept_sha256 from d left join kept using (r)""",
    "op7_jaccard_join": f"""with recursive d as (select row_number() over () as r, doc_id, {WORDS.format(LOWER)} as w from documents),
s as (select distinct r, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select r, count(*) as n from s group by r),
p as (select a.r as a, b.r as b, count(*) as i from s a join s b on a.g = b.g and a.r < b.r group by all),
l as (select a, b from p join n x on x.r = a join n y on y.r = b where 100 * i >= 90 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
reach(r, q) as (select r, r from d union select reach.r, e.b from reach join e on e.a = reach.q),
c as (select reach.r, min(d.doc_id) as component_id from reach join d on d.r = reach.q group by reach.r)
select doc_id, coalesce(n, 0) as n_shingles, component_id from d join c using (r) left join n using (r)""",
    "op10_warc": """with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, octet_length(encode(body)) as payload_bytes, sha1(body) as hex, min(page_id) over (partition by body) as first from p)
select page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
 (strpos('0123456789abcdef', substr(hex || '0', (1 + (5 * k) // 4)::int, 1)) - 1) * 256 + (strpos('0123456789abcdef', substr(hex || '0', (2 + (5 * k) // 4)::int, 1)) - 1) * 16
 + (strpos('0123456789abcdef', substr(hex || '00', (3 + (5 * k) // 4)::int, 1)) - 1)) >> (7 - (5 * k) % 4)) & 31)::int, 1)), 'string_agg', '') as payload_digest,
case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from h""",
    "op11_exact_dedup": r"""with d as (select row_number() over () as r, doc_id, length(coalesce(text, '')) as c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size, row_number() over w = 1 as kept, h as text_sha256 from d window w as (partition by h order by c desc, doc_id, r)""",
    "op12_source_divergence": f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWER.replace("text", "coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term from t group by 1, 2 having count(distinct r) >= 3),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from k group by 1),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by all),
m as (select lang, source, coalesce(sum(n), 0)::hugeint as n from g left join c using (lang, source) group by 1, 2),
p as (select lang, source, term, coalesce(c.n, 0) as n, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (m.n + v.v))::bigint as p from m join v using (lang) join k using (lang) left join c using (lang, source, term)),
q as (select lang, term, (1 + 1000000000::hugeint * (n + 1) // (a + v.v))::bigint as q from (select lang, term, sum(n)::hugeint as n, sum(sum(n)) over (partition by lang) as a from c group by 1, 2) join v using (lang)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
e as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from e union all
select lang, source, 'term', term, (p - q) * (p - q) // q as value, (row_number() over (partition by lang, source order by (p - q) * (p - q) // q desc, term))::int as rank from p join q using (lang, term) where n > 0 and p > q
qualify row_number() over (partition by lang, source order by (p - q) * (p - q) // q desc, term) <= 200""",
    "op13_vector_codes": _codes_sql(),
}
