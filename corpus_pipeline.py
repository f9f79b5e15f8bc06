"""Corpus pipeline: documents in, token digests of what is worth training on out.

Each stage calls one operator of ``profitlens.llm`` on all that the stage before it kept, and its decisions
take effect: rejected documents go, repeated lines are cut from texts, one document of each group of near
duplicates stays (the smallest id; rows without words stay, and rows equal in id and text are one document),
documents that hold a benchmark item go.  All stages but the last return the columns of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from profitlens.llm import decontaminate, jaccard_join, line_dedup, quality_knn
from profitlens.llm.common import crc_mod, keyed, stored, table, without
from profitlens.llm.queries import bpe_digests, vocabulary_path


def _drop(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the documents of ``gone`` (dkey, tkey)."""
    rows = keyed(docs.select("doc_id", "text", F.struct("*").alias("row")), "row")
    return without(rows, gone, "dkey", "tkey").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return quality_knn.classify(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row")))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # by the component's own key: components of null or repeated ids share a component_id
    groups = stored(jaccard_join.similar(docs).where("n_shingles > 0").select("root", "dkey", "tkey"), "near-duplicates")
    first = groups.groupBy("root").agg(F.min(F.struct("dkey", "tkey")).alias("first"))
    gone = groups.join(first, "root").where(F.struct("dkey", "tkey") != F.col("first"))
    return _drop(docs, gone.select("dkey", "tkey"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return _drop(docs, stored(found.where("leaked").select("dkey", "tkey"), "leaked"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", leaks),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express the classifier, the joins' components or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
