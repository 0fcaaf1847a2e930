"""The fifteen presentation views, over required tables and optional ones that may be missing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.semantics import canonical_status, known
from docketry.operators.metrics import with_parent_rollups
from docketry.operators.projection import empty, ensure_columns

#: Columns of the tables that a build may lack.
OPTIONAL = {
    "everify_observations": {
        "lookup_id": "string", "priority_rank": "bigint", "organization_id": "string", "queried_name": "string", "state": "string", "enrollment_status": "string", "matched_name": "string", "matched_dba": "string",
        "enrollment_date": "string", "termination_date": "string", "workforce_size": "string", "hiring_site_count": "bigint", "hiring_site_locations": "string", "retrieved_at": "string", "match_confidence": "double",
        "match_method": "string", "review_status": "string", "review_reason": "string", "source_url": "string", "source_evidence_json": "string",
    },
    "opt_employer_observations": {
        "observation_id": "string", "organization_id": "string", "report_year": "int", "rank": "int", "employer_name_raw": "string", "program_type": "string", "reported_count": "bigint", "is_positive": "boolean",
        "source_artifact_id": "string", "source_url": "string", "retrieved_at": "string", "coverage_note": "string", "match_method": "string", "match_confidence": "double", "review_status": "string",
    },
    "policy_documents": {
        "policy_document_id": "string", "institution_id": "string", "document_type": "string", "title": "string", "url": "string", "official_domain": "string", "retrieved_at": "string", "http_status": "bigint", "content_type": "string",
        "content_sha256": "string", "text_sha256": "string", "published_or_updated_date": "string", "raw_path": "string", "parsed_text_path": "string", "is_current": "boolean", "parse_status": "string", "discovery_method": "string",
        "suspicious_text": "boolean", "cache_hit": "boolean",
    },
    "policy_facts": {
        "policy_fact_id": "string", "institution_id": "string", "policy_document_id": "string", "fact_type": "string", "fact_value": "string", "qualifier": "string", "supporting_excerpt": "string", "section_or_page": "string",
        "source_url": "string", "retrieved_at": "string", "extractor_version": "string", "model_name": "string", "model_response_id": "string", "confidence": "double", "exact_excerpt_verified": "boolean",
        "human_review_status": "string", "reviewer_note": "string", "contradiction_group_id": "string", "valid_from": "string", "valid_to": "string", "is_current": "boolean", "reviewer_id": "string", "reviewed_at": "string",
    },
    "quality_checks": {"check_id": "string", "category": "string", "status": "string", "critical": "boolean", "value": "double", "threshold": "string", "details": "string", "build_id": "string", "checked_at": "string"},
}
REQUIRED = ("employer_metrics", "institution_metrics", "first_cases", "second_cases", "petitions", "entity_aliases", "data_health", "source_artifacts")
KEYS = ["organization_id", "identity_scope", "fiscal_year"]
UNSETTLED = ("REVIEW_REQUIRED", "REJECTED", "UNRESOLVED")


def optional_table(spark: SparkSession, tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """The table with the columns it may lack, or an empty one of its columns."""
    kinds = OPTIONAL[name]
    return ensure_columns(tables[name], kinds) if name in tables else empty(spark, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def _scoped(small: DataFrame) -> DataFrame:
    """Counts by entity and parent, once for each; the rows before them are not copied."""
    own = small.withColumnRenamed("organization_id", "__own")
    return with_parent_rollups(own, "__own", "parent_organization_id")


def _h1b() -> Column:
    return F.upper(F.trim(F.coalesce("visa_class", F.lit("")))) == "H-1B"


def _counted(cases: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Cases and those with each flag, by organisation, scope and year."""
    by = cases.groupBy("organization_id", "parent_organization_id", "fiscal_year")
    small = by.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items()), F.bool_or("is_partial_period").alias("is_partial_period"))
    return _scoped(small).groupBy(*KEYS).agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in flags), F.bool_or("is_partial_period").alias("is_partial_period"))


def first_trends(cases: DataFrame, petitions: DataFrame) -> DataFrame:
    """First-program cases and petitions by organisation and year; a year of either is a row."""
    status, ok = canonical_status(F.col("case_status")), known(F.col("technical_role")) & _h1b()
    a = _counted(cases, {"full": ok & (status == "CERTIFIED"), "half": ok & (status == "CERTIFIED-WITHDRAWN")}).withColumnRenamed("is_partial_period", "a_partial")
    sums = ["initial_approvals", "initial_denials", "continuing_approvals", "continuing_denials"]
    small = petitions.groupBy("organization_id", "parent_organization_id", "fiscal_year").agg(*(F.sum(c).alias(c) for c in sums), F.bool_or("is_partial_period").alias("b_partial"))
    b = _scoped(small).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in sums), F.bool_or("b_partial").alias("b_partial"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, KEYS, "full_outer").select(
        *KEYS,
        zero("n").alias("lca_count"),
        zero("full").alias("relevant_certified_lca_count"),
        zero("half").alias("relevant_certified_withdrawn_lca_count"),
        (zero("full") + zero("half") * 0.5).alias("weighted_relevant_lca_count"),
        *(zero(c).alias(c) for c in sums),
        (known(F.col("a_partial")) | known(F.col("b_partial"))).alias("is_partial_period"),
        F.lit("DERIVED_METRIC").alias("evidence_class"),
    )


def second_trends(cases: DataFrame) -> DataFrame:
    status, raw, ok = canonical_status(F.col("case_status")), F.upper(F.coalesce("case_status", F.lit(""))), known(F.col("technical_role"))
    full, half = status == "CERTIFIED", status == "CERTIFIED-EXPIRED"
    n = _counted(cases, {"relevant_full": ok & full, "relevant_half": ok & half, "full": full, "half": half, "denied": raw.startswith("DENIED"), "withdrawn": raw.startswith("WITHDRAWN")})
    return n.select(
        *KEYS,
        F.col("n").alias("perm_count"),
        F.col("relevant_full").alias("relevant_certified_perm_count"),
        F.col("relevant_half").alias("relevant_certified_expired_perm_count"),
        (F.col("relevant_full") + F.col("relevant_half") * 0.5).alias("weighted_relevant_perm_count"),
        F.col("full").alias("certified_count"),
        F.col("half").alias("certified_expired_count"),
        F.col("denied").alias("denied_count"),
        F.col("withdrawn").alias("withdrawn_count"),
        "is_partial_period",
        F.lit("DERIVED_METRIC").alias("evidence_class"),
    )


def relevant_titles(first: DataFrame, second: DataFrame) -> DataFrame:
    """Titles of the technical cases that were certified, by organisation, code and family."""
    what = ["job_title_raw", "soc_code", "soc_title", "role_family", "classification_version"]
    status, ok = canonical_status(F.col("case_status")), known(F.col("technical_role"))

    def counted(cases: DataFrame, source: str, keep: Column) -> DataFrame:
        small = cases.where(ok & keep).groupBy("organization_id", "parent_organization_id", *what).agg(F.count("*").alias("n"), F.max("fiscal_year").alias("last"))
        rows = _scoped(small).groupBy("organization_id", "identity_scope", *what).agg(F.sum("n").alias("record_count"), F.max("last").alias("last_activity_year"))
        return rows.select("organization_id", "identity_scope", F.lit(source).alias("source_id"), *what, "record_count", "last_activity_year", F.lit("DERIVED_METRIC").alias("evidence_class"))

    one = counted(first, "dol_lca", _h1b() & status.isin("CERTIFIED", "CERTIFIED-WITHDRAWN"))
    return one.unionByName(counted(second, "dol_perm", status.isin("CERTIFIED", "CERTIFIED-EXPIRED")))


def policy_evidence(facts: DataFrame, documents: DataFrame, institutions: DataFrame) -> DataFrame:
    """Facts with their document and institution, and how far each is evidence."""
    review, ended = F.col("human_review_status"), F.col("valid_to").isNotNull()
    sound = known(F.col("exact_excerpt_verified")) & known(F.col("fact_is_current")) & ~ended & known(F.startswith("source_url", F.lit("https://")))
    kind = (
        F.when((review == "REVIEWED_NOT_STATED") & sound, "REVIEWED_OFFICIAL_POLICY_NOT_STATED")
        .when((review == "REVIEWED_ACCEPTED") & sound, "REVIEWED_OFFICIAL_POLICY")
        .when((review == "REVIEWED_ACCEPTED") & ended, "REVIEWED_OFFICIAL_POLICY_HISTORICAL")
        .when(review == "REVIEWED_ACCEPTED", "REVIEWED_POLICY_INELIGIBLE")
        .otherwise("MODEL_EXTRACTED_UNREVIEWED")
    )
    of_document = documents.select("policy_document_id", "institution_id", "document_type", F.col("title").alias("document_title"), "published_or_updated_date", F.col("is_current").alias("document_is_current"))
    of_fact = [
        "policy_fact_id", "institution_id", "policy_document_id", "fact_type", "fact_value", "qualifier", "supporting_excerpt", "section_or_page", "source_url", "retrieved_at", "confidence",
        "exact_excerpt_verified", "human_review_status", "reviewer_note", "reviewer_id", "reviewed_at", "contradiction_group_id", "valid_from", "valid_to",
    ]
    rows = facts.select(*of_fact, F.col("is_current").alias("fact_is_current")).join(of_document, ["policy_document_id", "institution_id"])
    return rows.join(institutions.select("institution_id", "organization_id", "official_name"), "institution_id", "left").withColumn("evidence_class", kind)


def views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All fifteen views; a missing required table raises, a missing optional one is empty."""
    if missing := [n for n in REQUIRED if n not in tables]:
        raise ValueError(f"required tables are missing: {', '.join(missing)}")
    more = {n: optional_table(spark, tables, n) for n in OPTIONAL}
    facts = policy_evidence(more["policy_facts"], more["policy_documents"], tables["institution_metrics"])
    everify, aliases = more["everify_observations"], tables["entity_aliases"]
    return {
        "vw_employer_explorer": tables["employer_metrics"],
        "vw_institution_explorer": tables["institution_metrics"],
        "vw_organization_detail": tables["employer_metrics"],
        "vw_h1b_trends": first_trends(tables["first_cases"], tables["petitions"]),
        "vw_perm_trends": second_trends(tables["second_cases"]),
        "vw_relevant_titles": relevant_titles(tables["first_cases"], tables["second_cases"]),
        "vw_policy_evidence": facts,
        "vw_everify_evidence": everify,
        "vw_opt_evidence": more["opt_employer_observations"],
        "vw_entity_review_queue": aliases.where(F.col("match_status").isin(*UNSETTLED) | F.col("review_status").isin(*UNSETTLED)),
        "vw_policy_review_queue": facts.where("human_review_status = 'NEEDS_REVIEW'"),
        "vw_everify_review_queue": everify.where("review_status = 'NEEDS_REVIEW'"),
        "vw_data_health": tables["data_health"],
        "vw_source_artifacts": tables["source_artifacts"],
        "vw_quality_checks": more["quality_checks"],
    }


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """The views under their names, for SQL."""
    made = views(spark, tables)
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)
