"""The stages of the corpus pipeline: their contract on odd tables, and on columns that clash."""

from __future__ import annotations

from collections import Counter

import edge
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sunledger.llm.jaccard_join import keep_one_of_each
from sunledger.llm.mixing import mix_corpus
from sunledger.llm.substring_dedup import cut_repeats
from sunledger.llm.toxicity import drop_toxic

#: Names that an operator gives to columns of its own somewhere on its way.
NAMES = (
    "rate", "target", "copies", "source_size", "size", "taken", "_copy", "row", "words", "of", "key", "n", "lam", "mean",
    "n_words", "n_removed", "kept", "removed", "_key", "sym", "name", "node", "more", "comp", "level", "score", "y", "f0", "rank",
)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")


def clashing(spark):
    return edge.frame(spark).drop("rank", "node", "n", "sym", "count").withColumns({name: F.lit(7) for name in NAMES})


STAGES = {
    "toxicity": lambda spark, docs: drop_toxic(spark, docs, labels(spark)),
    "jaccard_join": keep_one_of_each,
    "substring_dedup": cut_repeats,
    "source_mixing": mix_corpus,
}


@pytest.mark.parametrize("stage", STAGES)
def test_columns_survive(spark, stage):
    docs = clashing(spark)
    out = STAGES[stage](spark, docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[name] == 7 for r in rows for name in NAMES)
    given = {(r["doc_id"], r["lang"], r["source"]) for r in docs.collect()}
    assert {(r["doc_id"], r["lang"], r["source"]) for r in rows} <= given
    assert STAGES[stage](spark, docs.limit(0)).count() == 0


def test_stages_of_the_pipeline(spark, sf_dir):
    """Each stage keeps the columns of documents and works on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, Counter(r["doc_id"] for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        kept = Counter(r["doc_id"] for r in out.collect())
        assert set(kept) <= set(ids)
        if name in ("toxicity", "jaccard_join"):
            assert max(kept.values()) == 1 and len(kept) < len(ids)
        if name == "substring_dedup":
            assert kept == ids
        if name == "source_mixing":
            assert max(kept.values()) <= 3
        docs = spark.createDataFrame(out.toArrow(), out.schema)
        ids = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in pieces} == set(ids) and all(r["n"] == r["t"] * ids[r["doc_id"]] for r in pieces)
