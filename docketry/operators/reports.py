"""Selections, dimensions and reports of a build: canonical files, organisations, source health, taxonomy changes, review packets, the quality gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.names import normalize_state
from docketry.functions.semantics import known
from docketry.operators.history import require_none

# --- canonical files ----------------------------------------------------------------------


def canonical_files(candidates: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """The files that stand for each year and variant: (fiscal_year, variant, candidate_id, flags).

    A year is complete if a later one exists or it has an annual or fourth-quarter file.  A
    complete year takes its annual file, else its fourth quarter or, where ``segments``
    (fiscal_year, first, last) are given, a file for each reviewed segment; the running
    year its latest quarter.  What can't be covered raises.  Equal files go by address.
    """
    year = ["fiscal_year", "variant"]
    best = candidates.groupBy(*year, "fiscal_quarter").agg(F.min_by("candidate_id", F.struct(F.lower("download_url"), "candidate_id")).alias("candidate_id"))
    q = F.col("fiscal_quarter")
    years = best.groupBy(*year).agg(F.bool_or(q.isNull()).alias("annual"), F.bool_or(known(q == 4)).alias("fourth"), F.max(q).alias("last_quarter"))
    years = years.crossJoin(F.broadcast(years.agg(F.max("fiscal_year").alias("latest"))))  # one row
    complete = (F.col("fiscal_year") < F.col("latest")) | F.col("annual") | F.col("fourth")
    part = lambda quarter, start, partial, cut: F.struct(quarter.cast("int").alias("q"), start.cast("int").alias("coverage_start_quarter"), F.lit(partial).alias("is_partial_period"), F.lit(cut).alias("is_quarter_partition"))
    one, null = F.lit(1), F.lit(None)
    if segments is None:
        rest, problem = F.array(part(F.lit(4), one, False, False)), F.when(complete & ~F.col("annual") & ~F.col("fourth"), "no annual or fourth-quarter file")
    else:
        cover = F.sort_array(F.flatten(F.collect_list(F.sequence("first", "last"))))
        got = segments.groupBy("fiscal_year").agg(F.collect_list(part(F.col("last"), F.col("first"), False, True)).alias("parts"), F.array_join(cover, "").alias("cover"))
        years = years.join(got, "fiscal_year", "left")
        rest, problem = F.col("parts"), F.when(complete & ~F.col("annual") & ~known(F.col("cover") == "1234"), "no reviewed segments that cover the year once")
    wanted = F.when(complete & F.col("annual"), F.array(part(null, one, False, False))).when(complete, rest).otherwise(F.array(part(F.col("last_quarter"), one, True, False)))
    years = years.withColumn("problem", problem)
    require_none(years.where("problem is not null"), "years can't be covered", *year, "problem")
    need = years.select(*year, F.explode(wanted).alias("w")).select(*year, "w.*")
    b = best.select(*(F.col(c).alias(f"__{c}") for c in year), F.col("fiscal_quarter").alias("__q"), "candidate_id")
    out = need.join(b, (F.col("fiscal_year") == F.col("__fiscal_year")) & (F.col("variant") == F.col("__variant")) & F.col("q").eqNullSafe(F.col("__q")), "left")
    require_none(out.where("candidate_id is null"), "reviewed segments without a file", *year, "q")
    return out.select(*year, F.col("q").alias("fiscal_quarter"), "candidate_id", "coverage_start_quarter", "is_partial_period", "is_quarter_partition")


# --- organisations, sources ---------------------------------------------------------------

#: Types of organisations by the control of their institution, else by their own kind.
BY_CONTROL = {"PUBLIC": "university_public", "PRIVATE_NONPROFIT": "university_private_nonprofit", "PRIVATE_FOR_PROFIT": "college_other"}
BY_KIND = {"TECHNOLOGY": "for_profit", "RETAIL": "for_profit", "HIGHER_EDUCATION_SYSTEM": "university_system"}


def organizations(legal: DataFrame, parents: DataFrame, institutions: DataFrame) -> DataFrame:
    """Legal entities and parents in one dimension, with a type derived from institutions first.

    An organisation of several institutions takes the least of their controls.
    """
    parent = parents.select(
        "parent_organization_id", F.col("canonical_name").alias("parent_organization_name"), F.col("headquarters_state").alias("__state"), F.col("organization_type").alias("__kind"),
        F.col("is_staffing_or_consulting").alias("__staffing"), F.col("review_status").alias("parent_relationship_review_status"),
    )
    none = F.lit(None).cast("string")
    one = legal.join(parent, "parent_organization_id", "left").select(
        F.col("legal_entity_id").alias("organization_id"), "legal_entity_id", "parent_organization_id", F.col("legal_name").alias("organization_name"), F.col("legal_name").alias("legal_entity_name"), "parent_organization_name",
        F.col("organization_type").alias("organization_type_raw"), "state", F.lit(1).cast("long").alias("legal_entity_count"), known(F.col("__staffing")).alias("is_staffing_or_consulting"), F.lit("LEGAL_ENTITY").alias("identity_scope"),
        F.col("review_status").alias("entity_resolution_status"), "parent_relationship_review_status",
    )
    counts = legal.select("parent_organization_id", "legal_entity_id").distinct().groupBy("parent_organization_id").agg(F.count("*").alias("n"))
    two = parent.join(counts, "parent_organization_id", "left").select(
        F.col("parent_organization_id").alias("organization_id"), none.alias("legal_entity_id"), "parent_organization_id", F.col("parent_organization_name").alias("organization_name"), none.alias("legal_entity_name"), "parent_organization_name",
        F.col("__kind").alias("organization_type_raw"), F.col("__state").alias("state"), F.coalesce("n", F.lit(0)).alias("legal_entity_count"), F.col("__staffing").alias("is_staffing_or_consulting"), F.lit("PARENT_ROLLUP").alias("identity_scope"),
        F.col("parent_relationship_review_status").alias("entity_resolution_status"), "parent_relationship_review_status",
    )
    ids = F.explode(F.array_compact(F.array(F.col("legal_entity_id").cast("string"), F.col("parent_organization_id").cast("string"))))
    control = institutions.select(ids.alias("__id"), "control").groupBy("__id").agg(F.min("control").alias("institution_control"))
    table = lambda c, values: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in values.items()))
    out = one.unionByName(two)
    out = out.join(control, F.col("organization_id").cast("string") == F.col("__id"), "left").drop("__id")
    return out.withColumn("organization_type", F.coalesce(table("institution_control", BY_CONTROL), table("organization_type_raw", BY_KIND), F.lit("unknown")))


def source_health(sources: Mapping[str, tuple[DataFrame, str, str | None]], cohorts: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """A row for each source with its years and, where its latest is partial, a warning.

    ``sources`` have is_partial_period and name their columns of year and quarter;
    ``cohorts`` have whole years only.
    """
    out = []
    for name, (df, year, quarter) in sources.items():
        y, partial = F.col(year), known(F.col("is_partial_period"))
        out.append(
            df.agg(
                F.lit(name).alias("source_id"), F.count("*").alias("row_count"), F.min(y).alias("earliest_year"), F.max(y).alias("latest_year"), F.max(F.when(~partial, y)).alias("latest_complete_fiscal_year"),
                F.max(F.when(partial, y)).alias("current_partial_fiscal_year"), (F.max(F.when(partial, F.col(quarter))) if quarter else F.lit(None)).cast("int").alias("current_partial_quarter"), F.count_if(partial).alias("__n"),
            )
        )
    for name, (df, year) in cohorts.items():
        none = F.lit(None).cast("int")
        out.append(
            df.agg(
                F.lit(name).alias("source_id"), F.count("*").alias("row_count"), F.min(year).alias("earliest_year"), F.max(year).alias("latest_year"), F.max(year).alias("latest_complete_fiscal_year"),
                none.alias("current_partial_fiscal_year"), none.alias("current_partial_quarter"), F.lit(0).alias("__n"),
            )
        )
    rows = reduce(DataFrame.unionByName, out).withColumn("has_partial_period", F.col("__n") > 0).drop("__n")
    text = F.concat(F.lit("Partial FY"), F.col("current_partial_fiscal_year").cast("string"), F.lit(" data must not be compared with complete years without a warning."))
    return rows.withColumns({"evidence_class": F.lit("OBSERVED_GOVERNMENT_RECORD"), "freshness_warning": F.when(F.col("has_partial_period"), text)})


# --- coverage of entities -----------------------------------------------------------------

#: Resolutions that count as valid.
RESOLVED = ("DETERMINISTIC", "HIGH_CONFIDENCE_AUTO", "MANUAL_OVERRIDE")


def coverage_states(df: DataFrame) -> DataFrame:
    """Add how far each program's evidence is known to be the organisation's, and the worse of both.

    Reads entity_resolution_status and, for h1b and perm, has_unresolved_{}_candidate_evidence
    and weighted_relevant_{lca,perm}_count.  Unresolved candidates make observed evidence
    partial; where nothing is observed the identity itself is open.
    """
    valid = known(F.col("entity_resolution_status").isin(*RESOLVED))
    out = df.withColumn("entity_resolution_valid", valid)
    for program, count in (("h1b", "weighted_relevant_lca_count"), ("perm", "weighted_relevant_perm_count")):
        open_ = known(F.col(f"has_unresolved_{program}_candidate_evidence"))
        state = F.when(~valid, "UNRESOLVED_IDENTITY").when(open_ & known(F.col(count) > 0), "PARTIAL_ENTITY_COVERAGE").when(open_, "UNRESOLVED_IDENTITY").otherwise("COMPLETE_ENTITY_COVERAGE")
        out = out.withColumns({f"{program}_entity_coverage_state": state, f"{program}_entity_resolution_valid": state != "UNRESOLVED_IDENTITY"})
    either = lambda s: (F.col("h1b_entity_coverage_state") == s) | (F.col("perm_entity_coverage_state") == s)
    worse = F.when(either("UNRESOLVED_IDENTITY"), "UNRESOLVED_IDENTITY").when(either("PARTIAL_ENTITY_COVERAGE"), "PARTIAL_ENTITY_COVERAGE").otherwise("COMPLETE_ENTITY_COVERAGE")
    return out.withColumn("entity_coverage_state", worse)


def entity_audit(activity: DataFrame, legal: DataFrame, aliases: DataFrame, limit: int) -> DataFrame:
    """The most active legal entities with what their aliases tell against their resolution.

    ``activity`` has legal_entity_id, selection_name, relevant_count and approval_count, and is
    ranked by them; ``legal`` has legal_entity_id, legal_name, city and state.  An alias in
    another state, or in another city of the same one, is a conflict.
    """
    order = [F.col("relevant_count").desc_nulls_last(), F.col("approval_count").desc_nulls_last(), F.col("selection_name"), F.col("legal_entity_id")]
    top = activity.orderBy(*order).limit(limit).join(legal.select("legal_entity_id", "legal_name", normalize_state(F.col("state")).alias("__state"), F.upper(F.trim(F.coalesce("city", F.lit("")))).alias("__city")), "legal_entity_id")
    rows = aliases.join(F.broadcast(top.select("legal_entity_id", "__state", "__city")), "legal_entity_id")  # no more rows than the limit
    state, city = normalize_state(F.col("state")), F.upper(F.trim(F.coalesce("city", F.lit(""))))
    both = (state != "") & (F.col("__state") != "")
    conflict = both & ((state != F.col("__state")) | ((city != "") & (F.col("__city") != "") & (city != F.col("__city"))))
    status = F.col("match_status")
    is_ = lambda *v: F.count_if(status.isin(*v))
    words = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    found = rows.withColumn("__odd", conflict).groupBy("legal_entity_id").agg(
        F.count("*").alias("__n"), words("alias_raw").alias("observed_source_names"), words("source_id").alias("source_ids"), words("match_status").alias("match_statuses"), F.round(F.min("match_score"), 6).alias("minimum_match_score"),
        F.count_if("__odd").alias("conflicts"), F.coalesce(F.sum(F.when(F.col("__odd"), F.col("occurrence_count"))), F.lit(0)).cast("long").alias("conflict_rows"),
        is_("REVIEW_REQUIRED", "UNRESOLVED").alias("__open"), is_("MANUAL_OVERRIDE").alias("__manual"), is_("DETERMINISTIC", "HIGH_CONFIDENCE_AUTO").alias("__sure"),
    )
    out = top.drop("__state", "__city").join(found, "legal_entity_id", "left").na.fill(0, ["conflicts", "conflict_rows"])
    needs = known(F.col("__open") > 0)
    confidence = (
        F.when(F.col("conflicts") > 0, "LOCATION_CONFLICT_REVIEW_REQUIRED").when(needs, "REVIEW_REQUIRED").when(F.col("__manual") > 0, "REVIEWED_OVERRIDE_PRESENT")
        .when(F.col("__sure") == F.col("__n"), "HIGH").otherwise("MIXED_OR_UNKNOWN")
    )
    return out.withColumns({"resolution_confidence": confidence, "human_override_required": F.when((F.col("conflicts") > 0) | needs, "YES").otherwise("NO_EVIDENT_NEED")}).drop("__n", "__open", "__manual", "__sure")


# --- changes of a taxonomy ----------------------------------------------------------------

DECISION = ("technical_role", "role_family", "classification_method")


def taxonomy_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combinations whose decision two taxonomies take differently; each has occurrence_count."""
    a = before.select(*keys, "occurrence_count", *(F.col(c).alias(f"before_{c}") for c in DECISION))
    b = after.select(*keys, *(F.col(c).alias(f"after_{c}") for c in DECISION))
    rows = a.join(b, list(keys)).where(reduce(lambda x, y: x | y, (~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")) for c in DECISION)))
    role = lambda s: F.when(F.col(f"{s}_technical_role"), "TECHNICAL").when(~F.col(f"{s}_technical_role"), "NOT_RELEVANT").otherwise("AMBIGUOUS")
    label = lambda s: F.concat_ws(":", role(s), f"{s}_role_family")
    return rows.withColumns({"before": label("before"), "after": label("after")})


def transitions(changes: DataFrame) -> DataFrame:
    return changes.groupBy("before", "after").agg(F.sum("occurrence_count").alias("changed_records"), F.count("*").alias("changed_combinations"))


def transition_sample(changes: DataFrame, keys: Sequence[str], each: int) -> DataFrame:
    """Of each transition the commonest combinations, for a person to look at."""
    first = W.partitionBy("before", "after").orderBy(F.col("occurrence_count").desc(), *keys)
    return changes.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).withColumn("inspection_status", F.lit("PENDING_MANUAL_INSPECTION"))


# --- review packets -----------------------------------------------------------------------

#: The questions that a packet asks of each institution.
CORE_FACTS = ("h1b_research_staff_eligible", "pr_research_staff_eligible", "perm_supported", "eb1b_supported")
PRIORITY = ("sponsorship_history_coverage", "sponsorship_history_score", "relevant_certified_perm_count", "h1b_history_score", "research_strength_score")


def review_packet(institutions: DataFrame, facts: DataFrame, documents: DataFrame, limit: int = 50) -> DataFrame:
    """Four rows for each of the first institutions, each with its best current fact or none.

    Accepted facts go before reviewed silence, pending and other ones; then exact, sure and
    recent ones first.
    """
    order = [*(F.col(c).desc_nulls_last() for c in PRIORITY), F.col("official_name"), F.col("institution_id")]
    top = institutions.where("institution_id is not null").orderBy(*order).limit(limit)
    top = top.withColumn("priority_rank", F.row_number().over(W.orderBy(*order)))  # no more rows than the limit
    grid = top.select("priority_rank", "institution_id", F.col("official_name").alias("institution"), F.explode(F.array(*(F.lit(k) for k in CORE_FACTS))).alias("fact_type"))
    review = F.col("human_review_status")
    rank = F.when(review == "REVIEWED_ACCEPTED", 3).when(review == "REVIEWED_NOT_STATED", 2).when(review == "NEEDS_REVIEW", 1).otherwise(0)
    now = facts.where(F.col("fact_type").isin(*CORE_FACTS) & F.col("is_current") & F.col("valid_to").isNull()).join(F.broadcast(top.select("institution_id")), "institution_id", "left_semi")
    what = F.struct("policy_document_id", "fact_value", "source_url", "supporting_excerpt", "human_review_status", "reviewer_note")
    best = now.groupBy("institution_id", "fact_type").agg(F.max(F.struct(rank.alias("rank"), "exact_excerpt_verified", "confidence", "retrieved_at", what.alias("f"))).alias("b"))
    best = best.select("institution_id", "fact_type", "b.f.*", "b.confidence", "b.retrieved_at").join(documents.select("institution_id", "policy_document_id", F.col("title").alias("page_title")), ["institution_id", "policy_document_id"], "left")
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)).alias(c)
    return grid.join(best, ["institution_id", "fact_type"], "left").select(
        "priority_rank", "institution", "fact_type", F.coalesce("fact_value", F.lit("UNKNOWN")).alias("extracted_value"), text("source_url", ""), text("supporting_excerpt", ""), text("page_title", ""), text("retrieved_at", ""),
        F.lit("UNKNOWN_SCOPE_REVIEW_REQUIRED").alias("campus_system_scope"), F.col("confidence").alias("extractor_confidence"), F.coalesce("human_review_status", F.lit("MISSING_CANDIDATE")).alias("review_status"), text("reviewer_note", ""),
    )


# --- the quality gate ---------------------------------------------------------------------

#: Scores with their ratings, and coverages.
RATED = (("h1b_history_score", "h1b_history_star_rating"), ("green_card_history_score", "green_card_history_star_rating"), ("overall_sponsorship_score", "overall_sponsorship_star_rating"))
COVERAGES = ("h1b_history_coverage", "green_card_history_coverage", "overall_sponsorship_coverage")
RESEARCH = ("research_scale_score", "research_scale_star_rating")


def _contract_errors(df: DataFrame, research: bool) -> Column:
    """Rows that break the meaning of a score, rating or coverage, counted once for each."""
    cols, bad = set(df.columns), []
    for score, stars in (*RATED, *((RESEARCH,) if research else ())):
        if {score, stars} <= cols:
            s, r = F.col(score), F.col(stars)
            odd = ~s.between(0, 100) | ~r.between(1, 5) | (s.isNull() & r.isNotNull())
            odd2 = (s == 0) & r.isNotNull() | (s > 0) & r.isNull()
            bad.append(known(odd) if (score, stars) == RESEARCH else known(odd) | known(odd2))
    bad += [known(~F.col(c).between(0, 1)) for c in COVERAGES if c in cols]
    return reduce(lambda a, b: a + b, (F.count_if(b) for b in bad), F.lit(0).cast("long"))


def quality_checks(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]], metric_version: str, score_version: str) -> DataFrame:
    """The twelve checks of a build: (check_id, category, status, critical, value, threshold).

    Tables that are missing fail their checks; every other check is one aggregate of a table.
    """
    spark = next(iter(tables.values())).sparkSession
    absent = [n for n in required if n not in tables]
    lacking = sum(len(set(cols) - set(tables[n].columns)) for n, cols in required.items() if n in tables)
    one = [spark.range(1).select(F.lit(len(required) - len(absent)).alias("present"), F.lit(len(absent)).alias("absent"), F.lit(lacking).alias("lacking"))]

    def add(name: str, empty: Sequence[str], make) -> None:
        df = tables.get(name)
        one.append(make(df) if df is not None else spark.range(1).select(*(F.lit(None).cast("long").alias(c) for c in empty)))

    ids = F.trim(F.col("source_artifact_id").cast("string"))
    active = tables["source_artifacts"].select(F.nullif(ids, F.lit("")).alias("source_artifact_id")) if "source_artifacts" in tables else spark.createDataFrame([], "source_artifact_id string")
    one.append(active.agg(F.count("*").alias("ids"), F.count_distinct("source_artifact_id").alias("good_ids")))
    named = lambda df: df.withColumn("source_artifact_id", F.col("source_artifact_id").cast("string")).join(active, "source_artifact_id", "left_semi")
    state = F.col("validation_status")
    add("manifest", ("records", "record_ids", "failed", "warned"), lambda df: named(df).agg(F.count("*").alias("records"), F.count_distinct("source_artifact_id").alias("record_ids"), F.count_if(state == "FAILED").alias("failed"), F.count_if(state == "WARNING").alias("warned")))
    add("schema_reports", ("reports", "report_ids", "report_missing"), lambda df: named(df).agg(F.count("*").alias("reports"), F.count_distinct("source_artifact_id").alias("report_ids"), F.coalesce(F.sum("missing_columns"), F.lit(0)).alias("report_missing")))
    cases = (("lca_cases_resolved", "case_id"), ("perm_cases_resolved", "case_id"), ("h1b_petitions_resolved", "source_row_number"))
    for k, (name, key) in enumerate(cases):
        has = lambda df, c: F.count(c) if c in df.columns else F.lit(0).cast("long")

        def counted(df: DataFrame, k=k, key=key) -> DataFrame:
            extra = [has(df, "organization_id").alias("o"), has(df, "technical_role").alias("t")]
            groups = df.groupBy("source_artifact_id", key).agg(F.count("*").alias("n"), *extra)
            return groups.agg(F.sum("n").alias(f"rows{k}"), (F.sum("n") - F.count("*")).alias(f"twice{k}"), F.sum("o").alias(f"resolved{k}"), F.sum("t").alias(f"classified{k}"))

        add(name, (f"rows{k}", f"twice{k}", f"resolved{k}", f"classified{k}"), counted)
    add("legal_entities", ("collisions",), lambda df: df.agg(F.count_if(F.col("legal_entity_id") == F.col("parent_organization_id")).alias("collisions")))
    for k, name in enumerate(("employer_metrics", "institution_metrics")):
        right = lambda c, v: F.min(known(F.col(c) == v))

        def contract(df: DataFrame, k=k) -> DataFrame:
            good = F.coalesce(right("metric_version", metric_version) & right("score_version", score_version), F.lit(False)) if {"metric_version", "score_version"} <= set(df.columns) else F.lit(False)
            return df.agg(F.count("*").alias("__n"), good.cast("long").alias(f"versions{k}"), _contract_errors(df, k == 1).alias(f"errors{k}")).drop("__n")

        add(name, (f"versions{k}", f"errors{k}"), contract)
    add("data_health", ("health",), lambda df: df.agg(F.count("*").alias("health")))
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one)  # one row each
    c = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    total = lambda name, n=3: reduce(lambda a, b: a + b, (c(f"{name}{k}") for k in range(n)))
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    unmapped = c("good_ids") - c("record_ids")
    checks = [
        ("required_processed_tables", "outputs", c("absent") == 0, True, c("present"), f"{len(required)} required tables"),
        ("required_columns", "schema", c("lacking") == 0, True, c("lacking"), "0 missing columns"),
        ("source_manifest", "provenance", (c("records") > 0) & (c("ids") == c("good_ids")) & (unmapped == 0) & (c("records") == c("record_ids")), True, c("records"), "every active artifact maps to exactly one validated manifest record"),
        ("manifest_validations", "schema", c("failed") == 0, True, c("failed"), "0 failed manifest validations"),
        ("manifest_warnings", "schema", c("warned") == 0, False, c("warned"), "review every warning"),
        ("schema_reports", "schema", (c("reports") > 0) & (c("report_missing") == 0) & (c("good_ids") == c("report_ids")), True, c("report_missing") + c("good_ids") - c("report_ids"), "one active report per artifact and 0 missing required source columns"),
        ("duplicate_source_records", "records", total("twice") == 0, True, total("twice"), "0 duplicate source keys"),
        ("entity_match_coverage", "entity_resolution", share(total("resolved"), total("rows")) >= 0.95, True, share(total("resolved"), total("rows")), ">= 95%"),
        ("role_classification_coverage", "roles", share(total("classified", 2), total("rows", 2)) >= 0.98, True, share(total("classified", 2), total("rows", 2)), ">= 98%"),
        ("legal_parent_separation", "entity_resolution", c("collisions") == 0, True, c("collisions"), "0 legal/parent ID collisions"),
        ("score_contract", "scoring", (total("versions", 2) == 2) & (total("errors", 2) == 0), True, total("errors", 2), "expected versions and valid 0-100 score/1-5 star semantics"),
        ("source_freshness", "freshness", c("health") >= 5, True, c("health"), ">= 5 source health rows"),
    ]
    made = [
        F.struct(F.lit(k).alias("check_id"), F.lit(cat).alias("category"), F.when(known(ok), "PASS").otherwise("FAIL" if critical else "WARN").alias("status"), F.lit(critical).alias("critical"), v.cast("double").alias("value"), F.lit(t).alias("threshold"))
        for k, cat, ok, critical, v, t in checks
    ]
    return row.select(F.explode(F.array(*made)).alias("c")).select("c.*")
