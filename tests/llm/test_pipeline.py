"""The pipeline's stages, and the queries of the llm operators, over the smallest tables."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, queries
from tessera.llm.shared import table
from tests.llm.test_operators import base_by_brute_force, groups_by_brute_force

SMALLEST = "/root/testdata/sf0.001"


def test_each_stage_keeps_what_it_should(spark):
    docs = table(spark, SMALLEST, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, SMALLEST)
        kept = {r.doc_id for r in after.collect()}
        assert kept <= set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == names
        if name == "quality rules":
            for doc, text in before.items():
                n, *_, repeated = base_by_brute_force(text)
                assert not (doc in kept and (n < 10 or 100 * repeated > 20 * n))
        elif name == "n-gram Jaccard join":
            assert kept == {top for _, _, top in groups_by_brute_force(list(before.items()), 5, 80)}
        elif name == "benchmark decontamination":
            items = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", r.text.lower()) for r in table(spark, SMALLEST, "benchmark").collect()]
            for doc, text in before.items():
                words = " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower()))
                leaks = any(len(i) >= decontaminate.LEAST_WORDS and " ".join(i) in words for i in items)
                assert not (leaks and doc in kept)
        docs = after
    last = {r.doc_id: r.decoded_sha256 for r in docs.collect()}
    assert all(last[r.doc_id] == hashlib.sha256((r.text or "").encode()).hexdigest() for r in table(spark, SMALLEST, "documents").collect() if r.doc_id in last)


def test_each_stage_takes_odd_rows_and_more_columns(spark):
    rows = [(1, None, "en", "a", 1), (2, "", None, "a", None), (None, "one two three four five six seven eight nine ten eleven twelve", "en", None, 3), (5, "long word " * 20_000, "de", "b", 4), (5, "long word " * 20_000, "de", "b", 4)]
    names = ["kept", "predicted", "hits", "score", "component_id", "c0"]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(f"own {n}") for n in names})
    for stage_name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            got = stage(spark, docs, SMALLEST)
            if stage_name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == odd.columns
            kept = got.collect()
            assert all(r[n] == f"own {n}" for r in kept for n in names)
            assert len(kept) <= docs.count()
    assert corpus_pipeline.tokens(spark, odd.withColumn("n_tokens", F.lit(9)), SMALLEST).where("n_tokens_input = 9").count() == 5


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    got = queries.QUERIES[name](spark, SMALLEST)
    n = {"op3": "pages", "op10": "conversations"}.get(name.split("_")[0], "documents")
    rows = got.collect()
    if name.startswith("op10_"):
        assert {r.conv_id for r in rows} == {r.conv_id for r in table(spark, SMALLEST, n).collect()} | {-1}
    elif name.startswith("op5_"):
        assert sum(r.n_tokens for r in rows) == sum(r.n_tokens for r in queries.op9_byte_bpe(spark, SMALLEST).collect())
    elif name.startswith("op13_"):
        # A row for each component of each vector that is kept, here all of them.
        kept = table(spark, SMALLEST, "embeddings").collect()
        assert sorted((r.vec_id, r.component) for r in rows) == sorted((r.vec_id, c) for r in kept for c in range(1, 17))
    elif not name.startswith("op2_"):
        assert len(rows) == table(spark, SMALLEST, n).count()
