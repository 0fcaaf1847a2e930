"""Column functions whose null, rounding and ordering rules are part of the results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.session import Scratch

# --- null rules ---------------------------------------------------------------------------


def sum0(c: Column | str) -> Column:
    """Sum that is 0, not null, over nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def any0(c: Column | str) -> Column:
    """Whether any is true; false, not null, where none is known."""
    return F.coalesce(F.bool_or(c), F.lit(False))


def known(c: Column) -> Column:
    """A predicate with null read as false."""
    return F.coalesce(c, F.lit(False))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null (greatest and least would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def sum_across(cols: Sequence[Column]) -> Column:
    """Row-wise sum that reads null as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cols))


def weighted(components: Mapping[str, Column], weights: Mapping[str, float]) -> tuple[Column, Column]:
    """Weighted mean over the components that are known, and the share of weight they carry."""
    seen = sum_across([F.when(components[k].isNotNull(), F.lit(w)) for k, w in weights.items()])
    value = sum_across([components[k] * w for k, w in weights.items()])
    return F.when(seen > 0, clip(value / seen, 0.0, 100.0)), clip(seen / sum(weights.values()), 0.0, 1.0)


# --- text ---------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Trim all white space, not spaces alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def canonical_status(c: Column) -> Column:
    """Trimmed, upper case, no white space around hyphens; null is empty."""
    return F.regexp_replace(F.upper(strip(F.coalesce(c, F.lit("")))), r"\s*-\s*", "-")


def zfill(c: Column, width: int) -> Column:
    """Left-pad with zeros; longer values are not cut."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 20 hex digits of the SHA-256 of the parts, null read as empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 20))


def normalize_postal(c: Column) -> Column:
    return F.substring(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")), 1, 5)


def normalize_city(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "))


def host_of(url: Column) -> Column:
    """Host of an address with or without scheme: lower case, no www., no final dot."""
    full = F.when(url.rlike("(?i)^[a-z][a-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(full, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.|\.$", ""), F.lit(""))


def is_official(url: Column, domain: Column) -> Column:
    """https, and the host is the domain or one below it."""
    h = host_of(url)
    return known(url.rlike("(?i)^https://") & ((h == domain) | F.endswith(h, F.concat(F.lit("."), domain))))


def stars(rating: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), rating), F.repeat(F.lit("☆"), 5 - rating))


# --- numbers, dates -----------------------------------------------------------------------


def try_number(c: Column) -> Column:
    """A double from text that may hold commas and dollar signs; null if it isn't one."""
    return F.regexp_replace(c, "[,$]", "").try_cast("double")


def try_date(c: Column) -> Column:
    """The first that fits of ISO and US forms, with or without a time."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy")
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in forms)).cast("date")


def fiscal_year(d: Column) -> Column:
    """Fiscal years begin on 1 October of the year before."""
    return F.year(d) + F.when(F.month(d) >= 10, 1).otherwise(0)


def fiscal_quarter(d: Column) -> Column:
    return (F.floor(F.pmod(F.month(d) + 2, F.lit(12)) / 3) + 1).cast("int")


def log_score(c: Column, cap: Column) -> Column:
    """100 * log(1 + value) / log(1 + cap), within 0 and 100; the cap is at least 1."""
    v = F.log1p(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), v / F.log1p(F.greatest(cap, F.lit(1.0))) * 100))


# --- rows ---------------------------------------------------------------------------------


def running_total(df: DataFrame, order: Sequence[str | Column], amount: str, out: str, slices: int | None = None) -> DataFrame:
    """Add the sum of ``amount`` over this row and those before it in a total order.

    Rows are range-partitioned (into as many slices as shuffles have partitions, unless told) and summed within each slice; the sums of the slices before,
    one short row each, give the offsets.  The slices are written once, because a second
    evaluation could cut them elsewhere.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(slices, *order).withColumn("__p", F.spark_partition_id())
    cut = Scratch(df.sparkSession, "slices").table(cut)
    own = F.sum(amount).over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    sums = cut.groupBy("__p").agg(F.sum(amount).alias("__n"))
    before = sums.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__b"))  # a row for each slice
    return cut.withColumn("__i", own).join(F.broadcast(before), "__p").withColumn(out, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def average_rank_share(df: DataFrame, value: str, out: str, null_as_zero: bool = False) -> DataFrame:
    """Add the average rank of a value over the number of ranked rows.

    Ranks come from running totals of the counts by value, joined back.
    """
    v = F.coalesce(F.col(value), F.lit(0)) if null_as_zero else F.col(value)
    counts = df.where(v.isNotNull()).groupBy(v.alias("__v")).agg(F.count("*").alias("__n"))
    upto = running_total(counts, ["__v"], "__n", "__upto")
    total = F.broadcast(upto.agg(F.max("__upto").alias("__total")))  # one row
    share = upto.crossJoin(total).select("__v", ((F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2) / F.col("__total")).alias(out))
    return df.join(share, v == F.col("__v"), "left").drop("__v")


def nearest_percentiles(df: DataFrame, values: Mapping[str, Column], p: float) -> DataFrame:
    """One row: for each name the value at position floor(p * (n - 1) + 0.5) of its sorted non-null values, else 0."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c.cast("double").alias("v")) for k, c in values.items())))
    counts = df.select(each.alias("x")).select("x.*").where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    upto = running_total(counts, ["k", "v"], "n", "upto")
    ends = upto.groupBy("k").agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.max("upto").alias("end"))  # a row for each name
    place = F.floor(F.lit(p) * (F.col("end") - F.col("start") - 1) + 0.5)
    found = upto.join(F.broadcast(ends), "k").where(F.col("upto") - F.col("start") > place)
    return found.agg(*(F.round(F.coalesce(F.min(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0)), 6).alias(k) for k in values))


def nearest_percentile(df: DataFrame, value: Column, p: float, out: str) -> DataFrame:
    return nearest_percentiles(df, {out: value}, p)


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


class NotUnique(ValueError):
    """A key that must be unique is not."""


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    """Fail closed if a key repeats; costs one aggregate."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise NotUnique(f"{what}: {', '.join(keys)} repeats")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str = "m:1") -> DataFrame:
    """Left join that first asserts the uniqueness that ``validate`` (m:1 or 1:1) claims."""
    assert_unique(right, keys, "right side")
    if validate == "1:1":
        assert_unique(left, keys, "left side")
    return left.join(right, list(keys), "left")
