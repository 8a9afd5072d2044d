"""Corpus pipeline: documents of known language, without near copies, repeated passages and benchmark text, packed.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; stages are written as Parquet between.

- language: documents without a letter go, and those whose language is little more likely than any other (the mean probability over all positions is
  below LEAST times an even share). Without any labelled language to learn from, all stay.
- near_duplicates: of each class of documents linked by a Jaccard similarity of 0.8 or more of their word five-grams, the one with the least id stays
  (null ids come last; of one id's several texts that with the least hash); repeated rows (one id and text) become one.
- repeated_passages: words covered by a window of 20 words that occurs earlier go out of the text; documents of which nothing is left go.
- benchmark: documents with a window of 10 words of a benchmark item go.
- packing: what is left becomes sequences of 2048 ids.

All stages but the last return the columns of docs as they came (but for the texts, and n_chars, of repeated_passages), whatever their names: rows travel as one
struct beside what a stage computes. Nulls: documents with null texts have no letter and go first; null ids are ids like others. Very long texts are worked on whole, by one task each. Empty tables give
empty tables, of pieces at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditarium.llm import decontamination, language_id, near_duplicates, packing, substring_dedup
from auditarium.llm.shared import table, written

LEAST = 1.4


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text, and key: a hash of id and text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("key"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.select("text", "lang"))
    if model is None:
        return docs
    return language_id.predict(keyed(docs), model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST / max(2, len(model.languages)))).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    classes = near_duplicates.join(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "class_id")
    names = rows.select("key", F.struct(F.col("row.doc_id").isNull().alias("last"), F.col("row.doc_id").alias("id"), "key").alias("name"))
    heads = classes.join(names, "key").groupBy("class_id").agg(F.min("name").alias("name")).select(F.col("name.key").alias("key")).distinct()
    kept = rows.join(heads.hint("shuffle_hash"), "key", "left_semi")
    if rows.groupBy("key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["key"])
    return kept.select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.rewritten(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    found = decontamination.find(rows.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.where(F.size("begins") > 0).select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_copies), ("repeated_passages", repeated_passages), ("benchmark", benchmark), ("packing", pack)]

#: SQL has no recurrent networks, hashes of this kind or linear programs: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
