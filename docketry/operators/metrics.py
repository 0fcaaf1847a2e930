"""Program metrics of organisations over fiscal periods, with additive parent copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.semantics import any0, canonical_status, known, sum0, top_by


def with_parent_rollups(df: DataFrame, entity: str = "legal_entity_id", parent: str = "parent_id") -> DataFrame:
    """Every row for its legal entity and again for its parent, in one pass over the input."""
    scopes = F.array(F.struct(F.col(entity).alias("id"), F.lit("LEGAL_ENTITY").alias("scope")), F.struct(F.col(parent).alias("id"), F.lit("PARENT_ROLLUP").alias("scope")))
    out = df.withColumn("__s", F.explode(scopes)).where("__s.id is not null")
    return out.withColumns({"organization_id": F.col("__s.id"), "identity_scope": F.col("__s.scope")}).drop("__s")


def status_flags(full: str, half: str, relevant: Column) -> tuple[Column, Column, Column]:
    """Whether a case counts fully or half, and its weight."""
    status = canonical_status(F.col("case_status"))
    a, b = known(relevant) & (status == full), known(relevant) & (status == half)
    return a, b, F.when(a, 1.0).when(b, 0.5).otherwise(0.0)


def program_metrics(cases: DataFrame, program: str, full: str, half: str, relevant: Column, entity: str = "legal_entity_id", parent: str = "parent_id") -> DataFrame:
    """One row per organisation: counts, weights, years, families of the cases that qualify.

    Cases are aggregated once by entity, year and family; parents' copies and distinct
    counts are made from that small table, so cases are neither copied nor expanded.
    """
    a, b, w = status_flags(full, half, relevant)
    flags = cases.select(entity, parent, "fiscal_year", "role_family", "is_partial_period", a.alias("__full"), b.alias("__half"), w.alias("__w"))
    small = flags.groupBy(entity, parent, "fiscal_year", "role_family", "is_partial_period").agg(F.count("*").alias("__n"), F.count_if("__full").alias("__f"), F.count_if("__half").alias("__h"), F.sum("__w").alias("__w"))
    year, partial, ok = F.col("fiscal_year"), known(F.col("is_partial_period")), F.col("__f") + F.col("__h") > 0
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731 - of years or families, which are few
    return with_parent_rollups(small, entity, parent).groupBy("identity_scope", "organization_id").agg(
        F.sum("__n").alias(f"{program}_case_count"),
        F.sum("__f").alias(f"{program}_full_count"),
        F.sum("__h").alias(f"{program}_half_count"),
        sum0("__w").cast("double").alias(f"weighted_{program}_count"),
        distinct(F.when(ok, year)).alias(f"{program}_active_years"),
        distinct(F.when(ok & ~partial, year)).alias(f"{program}_complete_active_years"),
        F.max(F.when(ok, year)).alias(f"last_{program}_year"),
        F.max(F.when(~partial, year)).alias(f"{program}_latest_complete_year"),
        F.max(F.when(partial, year)).alias(f"{program}_partial_year"),
        any0("is_partial_period").alias(f"{program}_has_partial_period"),
        distinct(F.when(ok, F.col("role_family"))).alias(f"{program}_family_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("role_family")))), "|").alias(f"{program}_families"),
    )


def top_family(cases: DataFrame, full: str, half: str, relevant: Column) -> DataFrame:
    """Each organisation's family of largest weight; ties go to the first by name."""
    a, b, w = status_flags(full, half, relevant)
    rows = with_parent_rollups(cases).withColumns({"__w": w, "__ok": a | b}).where(F.col("__ok") & F.col("role_family").isNotNull())
    sums = rows.groupBy("identity_scope", "organization_id", "role_family").agg(F.sum("__w").alias("family_weight"))
    return top_by(sums, ["identity_scope", "organization_id"], [F.col("family_weight").desc(), F.col("role_family").asc()])


def yearly_counts(cases: DataFrame, full: str, half: str, relevant: Column) -> DataFrame:
    """One row per organisation and fiscal year."""
    a, b, w = status_flags(full, half, relevant)
    rows = with_parent_rollups(cases).withColumns({"__full": a, "__half": b, "__w": w})
    return rows.groupBy("identity_scope", "organization_id", "fiscal_year").agg(
        F.count("*").alias("case_count"),
        F.count_if("__full").alias("certified_count"),
        F.count_if("__half").alias("half_count"),
        sum0("__w").cast("double").alias("weighted_count"),
        any0("is_partial_period").alias("is_partial_period"),
    )
