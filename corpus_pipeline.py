"""The corpus pipeline: five stages, each written and reread before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  No stage has an SQL form that finishes on whole tables, so
ORACLE_SQL is None; the tests hold the later four stages against brute force on a small table
and the first against its operator.

Defined results: null texts and texts without a letter are rejected by the first stage (so no
later one sees null); each later stage passes empty texts, null ids, repeated rows and other
columns on as its operator's docstring says; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.byte_bpe import bpe_round_trip
from docketry.llm.decontaminate import decontaminate
from docketry.llm.language_id import identify
from docketry.llm.line_dedup import line_dedup
from docketry.llm.minhash_dedup import minhash_dedup
from docketry.session import Scratch

ORACLE_SQL: str | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the classifier rejects go."""
    return identify(docs).where("not rejected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document of nothing else goes with them."""
    out = line_dedup(docs).where("n_dropped = 0 or length(trim(text)) > 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays, and of equal texts of one id one row.

    Documents are compared by sets of five-word shingles at a similarity of 0.8.  Rows that share
    an id but not a text go or stay together.  Of rows of equal id and text the least stays, by
    their other columns.
    """
    marks = minhash_dedup(docs).groupBy(F.col("doc_id").alias("__id")).agg(F.min("kept").alias("__kept"), F.count("*").alias("__rows"))
    marks = Scratch(spark, "marks").table(marks.where("not __kept or __rows > 1"))
    marked = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("__id")), "left").where("coalesce(__kept, true)")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = marked.where("__rows > 1").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__least")).select("doc_id", "text", "__least.*")
    return marked.where("__rows is null").select(*docs.columns).unionByName(one.select(*docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule marks go."""
    marks = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("h").alias("__e")).distinct()
    same = F.col("__d").eqNullSafe(F.col("doc_id")) & F.xxhash64("text").eqNullSafe(F.col("__e"))
    return docs.join(marks, same, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes they decode to."""
    return bpe_round_trip(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
