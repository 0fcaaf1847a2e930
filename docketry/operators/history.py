"""Histories that fail closed: superseded cases, active artifacts, cohorts, reviews, enrichment, reconciled names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.names import normalize_name, stable_identity
from docketry.functions.semantics import any0, assert_unique, canonical_status, known


class DataQuality(ValueError):
    """Rows break a rule that results rest on."""


def require_none(bad: DataFrame, what: str, *columns: str) -> None:
    """Raise with the first few rows that break a rule; costs one look for any."""
    rows = bad.select(*columns).limit(10).collect()
    if rows:
        raise DataQuality(f"{what}: {', '.join(str(tuple(r)) for r in rows)}")


# --- superseded cases ---------------------------------------------------------------------

#: What must be equal, but for spelling, in both rows of a superseded case.
IDENTITY = ("employer_name_raw", "visa_class", "employer_address_1", "employer_address_2", "employer_city", "employer_state", "employer_postal_code")


def case_overlaps(rows: DataFrame) -> DataFrame:
    """Cases of several rows: their first and last row, and whether the last may supersede the first.

    That takes just two rows of different artifacts: certified, then later withdrawn, of one
    employer.  Rows have source_artifact_id, fiscal_year, source_row_number, case_id,
    case_status and decision_date; identity columns that are absent are null.  Only the least
    and greatest row of a case are kept, so a case of many rows needs no more room than one of two.
    """
    identity = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in IDENTITY]
    order = [F.col("decision_date").cast("date").alias("decision_date"), F.col("source_artifact_id"), F.col("source_row_number").cast("long").alias("source_row_number")]
    row = F.struct(*order, F.col("fiscal_year"), canonical_status(F.col("case_status")).alias("status"), *identity)
    cases = rows.where("case_id is not null").groupBy("case_id").agg(F.count("*").alias("n"), F.min(row).alias("earlier"), F.max(row).alias("later")).where("n > 1")
    a, b = F.col("earlier"), F.col("later")
    stable = lambda r, c: stable_identity(r[c], postal=c == "employer_postal_code")
    same = reduce(lambda x, y: x & y, (stable(a, c) == stable(b, c) for c in IDENTITY))
    ok = (
        (F.col("n") == 2) & (F.trim("case_id") != "") & (a["source_artifact_id"] != b["source_artifact_id"]) & a["source_row_number"].isNotNull() & b["source_row_number"].isNotNull() & (a["decision_date"] < b["decision_date"])
        & (a["status"] == "CERTIFIED") & (b["status"] == "CERTIFIED-WITHDRAWN") & (stable(a, IDENTITY[0]) != "") & same
    )
    return cases.withColumn("valid", known(ok))


def superseded(rows: DataFrame) -> DataFrame:
    """The earlier rows of superseded cases with what superseded them; any other repeated case raises."""
    pairs = case_overlaps(rows)
    require_none(pairs.where("not valid"), "cases repeat in a way that isn't a supersession", "case_id", "n")
    a, b = F.col("earlier"), F.col("later")
    return pairs.select(
        a["source_artifact_id"].alias("source_artifact_id"), a["source_row_number"].alias("source_row_number"), F.trim("case_id").alias("case_id"), a["fiscal_year"].alias("fiscal_year"), b["fiscal_year"].alias("superseding_fiscal_year"),
        b["source_artifact_id"].alias("superseding_source_artifact_id"), b["source_row_number"].alias("superseding_source_row_number"), a["decision_date"].alias("earlier_decision_date"), b["decision_date"].alias("later_decision_date"),
    )


ROW_KEY = ["source_artifact_id", "source_row_number"]


def without_superseded(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    return rows.join(ledger.select(*ROW_KEY), ROW_KEY, "left_anti")


def ledger_audit(staged: DataFrame, ledger: DataFrame, active: DataFrame) -> DataFrame:
    """One row: whether the active rows are the staged ones less the ledger's, each case once."""
    count = lambda df, *also: df.agg(F.count("*").alias("n"), *also)
    s = count(staged, F.count_distinct("case_id").alias("c")).select(F.col("n").alias("staged"), F.col("c").alias("staged_cases"))
    led = count(ledger).select(F.col("n").alias("superseded"))
    found = count(staged.join(ledger.select(*ROW_KEY), ROW_KEY, "left_semi")).select(F.col("n").alias("superseded_found"))
    a = count(active, F.count_distinct("case_id").alias("c")).select(F.col("n").alias("active"), F.col("c").alias("active_cases"))
    left = count(active.join(ledger.select(*ROW_KEY), ROW_KEY, "left_semi")).select(F.col("n").alias("superseded_left"))
    one = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), (s, led, found, a, left))  # one row each
    sound = (F.col("superseded") == F.col("superseded_found")) & (F.col("staged") - F.col("superseded") == F.col("active")) & (F.col("superseded_left") == 0) & (F.col("staged_cases") == F.col("active_cases")) & (F.col("active") == F.col("active_cases"))
    return one.withColumn("passed", sound)


# --- active artifacts ---------------------------------------------------------------------

#: What a manifest record must share with the candidate that was selected.
MANIFEST_KEY = ("source_id", "download_url", "fiscal_year", "fiscal_quarter", "is_partial_period", "is_quarter_partition", "coverage_start_quarter", "file_name", "parser_version", "schema_version")


def active_artifacts(selected: DataFrame, manifest: DataFrame) -> DataFrame:
    """The newest manifest record of each selected candidate.

    A selection that repeats, a candidate without a record, or a newest record that failed or
    isn't available raises; an older record never stands in.  Records of one time go by id.
    """
    require_none(selected.groupBy(*MANIFEST_KEY).count().where("count > 1"), "candidates selected more than once", "source_id", "file_name")
    records = manifest.groupBy(*MANIFEST_KEY).agg(F.max_by(F.struct("source_artifact_id", "retrieved_at", "validation_status", "available"), F.struct("retrieved_at", "source_artifact_id")).alias("r"))
    right = records.select(*(F.col(c).alias(f"__{c}") for c in MANIFEST_KEY), "r")
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in MANIFEST_KEY))
    rows = selected.select(*MANIFEST_KEY).join(right, on, "left").select(*MANIFEST_KEY, "r.*")
    why = F.when(F.col("source_artifact_id").isNull(), "no record").when(F.col("validation_status") == "FAILED", "newest failed").when(~known(F.col("available")), "newest unavailable")
    rows = rows.withColumn("__why", why)
    require_none(rows.where("__why is not null"), "selected artifacts can't be used", "source_id", "file_name", "__why")
    return rows.drop("__why", "available")


# --- cohorts, enrichment ------------------------------------------------------------------


def latest_cohort(df: DataFrame, key: str, year: str) -> DataFrame:
    """The rows of the latest year; a known key that repeats within a year raises, unknown ones may."""
    assert_unique(df.where(F.col(key).isNotNull()), [key, year], "cohort")
    last = df.agg(F.max(year).alias("__last"))
    return df.join(F.broadcast(last), F.col(year) == F.col("__last")).drop("__last")  # one row


def _last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Of each key the row that is greatest in an order; ties go by the columns themselves."""
    best = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v"))).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, "b.v.*")


def enrich_lookups(df: DataFrame, everify: DataFrame, opt: DataFrame) -> DataFrame:
    """Add the latest register lookup and the best positive report; no match is unknown, not a no."""
    rows = everify.where("organization_id is not null")
    looked = _last(rows, ["organization_id"], [F.col("retrieved_at")], ["retrieved_at", "enrollment_status", "source_url", "match_confidence", "review_status"])
    status = F.col("enrollment_status")
    looked = looked.select(
        "organization_id", F.when(status.isin("CONFIRMED_ACTIVE", "CONFIRMED_INACTIVE"), status).otherwise("UNKNOWN").alias("__status"), status.alias("everify_lookup_status"), F.col("retrieved_at").alias("everify_retrieved_at"),
        F.col("source_url").alias("everify_source_url"), F.col("match_confidence").alias("everify_match_confidence"), F.col("review_status").alias("everify_review_status"),
    )
    positive = opt.where((F.col("program_type") == "OPT_OR_STEM_OPT") & F.col("is_positive") & F.col("organization_id").isNotNull())
    best = _last(positive, ["organization_id"], [F.col("report_year"), -F.col("rank")], ["report_year", "reported_count", "rank", "source_url"])
    best = best.select("organization_id", F.lit("OBSERVED_POSITIVE").alias("__opt"), F.col("report_year").alias("opt_report_year"), F.col("reported_count").alias("opt_reported_count"), F.col("rank").alias("opt_report_rank"), F.col("source_url").alias("opt_source_url"))
    out = df.join(looked, "organization_id", "left").join(best, "organization_id", "left")
    out = out.withColumns({"everify_status": F.coalesce("__status", "everify_status"), "everify_lookup_status": F.coalesce("everify_lookup_status", F.lit("NOT_CHECKED")), "known_opt_observation": F.coalesce("__opt", "known_opt_observation")})
    return out.drop("__status", "__opt")


#: The columns that facts fill.
POLICY_COLUMNS = {
    "h1b_research_staff_eligible": "research_staff_h1b_policy",
    "pr_research_staff_eligible": "research_staff_permanent_residence_policy",
    "pr_general_staff_eligible": "general_staff_permanent_residence_policy",
    "perm_supported": "perm_support",
    "eb1b_supported": "eb1b_support",
}


def enrich_policy(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Fill the policy columns from reviewed facts (of each type the latest) and tell the state of review."""
    review, value = F.col("human_review_status"), F.col("fact_value")
    current = known(F.col("is_current")) & F.col("valid_to").isNull() & known(F.startswith("source_url", F.lit("https://")))
    usable = current & (((review == "REVIEWED_ACCEPTED") & known(F.col("exact_excerpt_verified"))) | ((review == "REVIEWED_NOT_STATED") & (value == "NOT_STATED")))
    latest = [F.max(F.when(usable & (F.col("fact_type") == k), F.struct("valid_from", "fact_value"))).alias(f"__{c}") for k, c in POLICY_COLUMNS.items()]
    states = [any0(review == s).alias(k) for k, s in (("__accepted", "REVIEWED_ACCEPTED"), ("__silent", "REVIEWED_NOT_STATED"), ("__pending", "NEEDS_REVIEW"))]
    out = df.join(facts.groupBy("institution_id").agg(*latest, *states), "institution_id", "left")
    accepted, silent, pending = (known(F.col(c)) for c in ("__accepted", "__silent", "__pending"))
    reviewed = accepted | silent
    status = F.when(reviewed & pending, "PARTIALLY_REVIEWED").when(reviewed, "REVIEWED").when(pending, "NEEDS_REVIEW").otherwise(F.col("policy_review_status"))
    extra = F.when(accepted, "|REVIEWED_OFFICIAL_POLICY").when(silent, "|REVIEWED_POLICY_PROFILE").otherwise("")
    out = out.withColumns({"policy_review_status": status, "evidence_classes": F.concat("evidence_classes", extra), **{c: F.coalesce(F.col(f"__{c}")["fact_value"], c) for c in POLICY_COLUMNS.values()}})
    return out.drop("__accepted", "__silent", "__pending", *(f"__{c}" for c in POLICY_COLUMNS.values()))


# --- reviews ------------------------------------------------------------------------------


def apply_reviews(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts under the decisions of people; extracted evidence is never changed.

    Decisions (policy_fact_id, human_review_status, reviewer_note, current_confirmed,
    reviewed_at, reviewer_id) are one to one with facts.  An acceptance without current https
    evidence, an exact excerpt and a named reviewer raises, and so does a reviewed silence on
    a fact that states something.
    """
    assert_unique(facts, ["policy_fact_id"], "facts")
    assert_unique(decisions, ["policy_fact_id"], "decisions")
    d = decisions.select("policy_fact_id", F.col("human_review_status").alias("__status"), F.col("reviewer_note").alias("__note"), F.col("current_confirmed").alias("__current"), "reviewed_at", "reviewer_id")
    out = facts.drop("reviewed_at", "reviewer_id").join(d, "policy_fact_id", "left")
    now = F.when(known(F.col("__current")) & F.col("valid_to").isNull(), F.lit(True)).otherwise(F.col("is_current"))
    out = out.withColumns({"human_review_status": F.coalesce("__status", "human_review_status"), "reviewer_note": F.coalesce("__note", "reviewer_note"), "is_current": now}).drop("__status", "__note", "__current")
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    unnamed = blank("reviewer_id") | blank("reviewed_at")
    stale, insecure = ~F.col("is_current"), ~F.startswith("source_url", F.lit("https://"))
    accepted = (F.col("human_review_status") == "REVIEWED_ACCEPTED") & F.col("valid_to").isNull()
    require_none(out.where(accepted & (~F.col("exact_excerpt_verified") | insecure | blank("supporting_excerpt") | stale | unnamed)), "accepted without current evidence or a reviewer", "policy_fact_id")
    silent = F.col("human_review_status") == "REVIEWED_NOT_STATED"
    require_none(out.where(silent & ((F.col("fact_value") != "NOT_STATED") | insecure | stale | F.col("valid_to").isNotNull() | unnamed)), "reviewed as not stated without a current silent fact or a reviewer", "policy_fact_id")
    return out


# --- names of reports ---------------------------------------------------------------------

METHODS = ("EXACT_PARENT_NAME", "EXACT_LEGAL_NAME", "EXACT_OBSERVED_ALIAS")


def reconcile_names(names: DataFrame, parents: DataFrame, legal: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names of a report by exact reference: parents before legal entities before aliases; one organisation or a review.

    ``names`` has name; ``parents`` parent_organization_id and name, the others legal_entity_id,
    parent_organization_id and name.  References are one row for each name, however many share it.
    """
    none = F.lit(None).cast("string")
    cols = lambda df, k, own: df.select(
        normalize_name(F.col("name")).alias("employer_name_normalized"), F.lit(k).alias("k"), (none if own is None else F.col(own).cast("string")).alias("legal"), F.col("parent_organization_id").cast("string").alias("parent")
    )
    refs = cols(parents, 0, None).unionByName(cols(legal, 1, "legal_entity_id")).unionByName(cols(aliases.where("legal_entity_id is not null"), 2, "legal_entity_id"))
    key = "employer_name_normalized"
    refs = refs.withColumn("org", F.coalesce("parent", "legal"))
    one = [F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in ("org", "legal", "parent")]
    best = refs.groupBy(key, "k").agg(*one).groupBy(key).agg(F.min_by(F.struct("k", "org", "legal", "parent"), "k").alias("b"))
    out = names.withColumn(key, normalize_name(F.col("name"))).join(best, key, "left")
    org = F.col("b.org")
    found, sure = org["low"].isNotNull(), org["low"] == org["high"]
    single = lambda c: F.when(sure & (F.col(f"b.{c}.low") == F.col(f"b.{c}.high")), F.col(f"b.{c}.low"))
    method = F.element_at(F.array(*(F.lit(m) for m in METHODS)), F.col("b.k") + 1)
    return out.withColumns(
        {
            "organization_id": F.when(sure, org["low"]), "legal_entity_id": single("legal"), "parent_organization_id": single("parent"),
            "match_method": F.when(~found | F.col("b").isNull(), "NO_EXACT_MATCH").when(~sure, "AMBIGUOUS_EXACT_MATCH").otherwise(method),
            "match_confidence": F.when(~known(sure), 0.0).when(F.col("b.k") == 2, 0.99).otherwise(1.0), "review_status": F.when(known(sure), "NOT_REQUIRED").otherwise("NEEDS_REVIEW"),
        }
    ).drop("b")
