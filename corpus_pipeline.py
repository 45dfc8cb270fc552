"""A corpus pipeline of the llm operators: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, jaccard_join, quality_rules, toxicity
from tessera.llm.queries import VOCABULARY
from tessera.llm.shared import Scratch, table


def _by_place(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, str, str]:
    """docs with columns named by their places, so that none clashes; labels to fit; the id's and the text's names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    key, text = names["doc_id"], names["text"]
    return docs.toDF(*names.values()), labels.withColumnRenamed("doc_id", key), key, text


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the fixed rules or the forests reject go, null and empty ones among them."""
    placed, labels, key, text = _by_place(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(placed, labels, key, text).where("kept").select(placed.columns).toDF(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts predicted to be toxic go."""
    placed, labels, key, text = _by_place(docs, table(spark, sf_dir, "labels"))
    return toxicity.judge(placed, labels, key, text).where("predicted = 0").select(placed.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of linked ones stays: the one with the smallest id.

    Words are grouped by five and texts link from a similarity of 0.8. Texts without words
    all stay, and rows that share an id stay or go together.
    """
    groups = jaccard_join.near_groups(docs, size=5, percent=80)
    stay = groups.where("doc_id = component_id or component_id is null").select("doc_id").distinct()
    return docs.join(stay, docs.doc_id.eqNullSafe(stay.doc_id), "left_semi")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and decoded again; a column named like a digest comes back with _input behind it."""
    return bpe.encode_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

#: SQL can't express the learned filters; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written and read again.

    A stage's table goes once the next one is written. Documents without text go with the
    short ones, an empty table gives no rows, and more columns of documents, whatever their
    names, pass through.
    """
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        scratch.drop(f"stage-{i - 1}")
    return docs
