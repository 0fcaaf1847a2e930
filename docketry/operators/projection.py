"""Projection, reshaping and selection helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.semantics import running_total, top_by


def first_available(df: DataFrame, names: Sequence[str], kind: str) -> Column:
    """The first of the columns that exists, else a typed null."""
    found = next((n for n in names if n in df.columns), None)
    return F.col(f"`{found}`").try_cast(kind) if found else F.lit(None).cast(kind)


def ensure_columns(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Add the columns that are missing, as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def wide_to_long(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """A row for each positive measure, with the measure's place as rank."""
    parts = F.array(*(F.struct(F.lit(n).alias("measure"), F.col(c).alias("value"), F.lit(k).alias("rank")) for k, (n, c) in enumerate(measures.items(), 1)))
    return df.select(*keys, F.explode(parts).alias("m")).select(*keys, "m.*").where("value > 0")


def with_row_number(df: DataFrame, order: Sequence[str | Column], start: int = 1, name: str = "source_row_number", slices: int | None = None) -> DataFrame:
    """Consecutive numbers in a total order, without sorting all rows in one task."""
    out = running_total(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", name, slices)
    return out.withColumn(name, F.col(name) + (start - 1)).drop("__one")


def flat_for_export(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Everything as text: lists joined with |, structs as JSON."""

    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name in keep:
            return c
        if isinstance(f.dataType, T.ArrayType):
            inner = F.transform(c, F.to_json) if isinstance(f.dataType.elementType, T.StructType) else c.cast("array<string>")
            return F.array_join(inner, "|").alias(f.name)
        if isinstance(f.dataType, (T.StructType, T.MapType)):
            return F.to_json(c).alias(f.name)
        return c.cast("string").alias(f.name)

    return df.select(*(text(f) for f in df.schema))


def for_display(df: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(unknown)).alias(c) for c in df.columns))


def replace_strict(c: Column, values: Mapping, default) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def clamp(limit: int | None, cap: int, default: int = 500) -> int:
    return max(1, min(default if limit is None else limit, cap))


def in_order(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """The rows of the given ids with their place in the list (a stated, short list)."""
    places = F.array(*(F.struct(F.lit(i).alias("__id"), F.lit(k).alias("pos")) for k, i in enumerate(ids)))
    wanted = df.sparkSession.range(1).select(F.explode(places).alias("p")).select("p.*")
    return df.join(F.broadcast(wanted), F.col(key) == F.col("__id")).drop("__id")


def first_match(left: DataFrame, key: str, right: DataFrame, ways: Sequence[tuple[str, str]], order: str, take: Sequence[str]) -> DataFrame:
    """LEFT JOIN LATERAL of the least right row that matches in any of several ways.

    Each way is an equi-join against the least right row of its key, found by an aggregate.
    """
    cols = [order, *(c for c in take if c != order)]
    parts = []
    for a, b in ways:
        best = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("__k")).agg(F.min(F.struct(*cols)).alias("__m"))
        parts.append(left.join(best, F.col(a) == F.col("__k")).select(key, "__m"))
    found = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min("__m").alias("__m"))
    return left.join(found, key, "left").select(key, *(F.col(f"__m.{c}").alias(c) for c in take))


def search(df: DataFrame, aliases: DataFrame, key: str, name: str, alias: str, term: str) -> DataFrame:
    """Rows whose name, or any alias, holds the term (ILIKE; the term's wildcards count)."""
    like = f"%{term}%"
    by_alias = aliases.where(F.col(alias).ilike(like)).select(F.col(key).alias("__k"))
    hit = df.where(F.col(name).ilike(like)).select(F.col(key).alias("__k")).union(by_alias).distinct()
    return df.join(hit, F.col(key) == F.col("__k"), "left_semi")


__all__ = ["clamp", "empty", "ensure_columns", "first_available", "first_match", "flat_for_export", "for_display", "in_order", "replace_strict", "search", "top_by", "wide_to_long", "with_row_number"]
