"""Gates, coverage and gold checks, fingerprints, reconciliations: aggregates over their input."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.names import core_name, evidence_text, legal_suffix, normalize_name
from docketry.functions.semantics import checked_join, is_official, known, normalize_city
from docketry.operators.resolve import AUTO, location_conflict, name_score, suffix_conflict


def gate(counts: DataFrame, checks: Sequence[tuple[str, Column, bool, Column]]) -> DataFrame:
    """A row for each check (id, passed, critical, observed) over a one-row frame of counters."""
    rows = [F.struct(F.lit(k).alias("check_id"), F.when(known(ok), "PASS").otherwise("FAIL" if critical else "WARN").alias("status"), F.lit(critical).alias("critical"), v.cast("double").alias("observed")) for k, ok, critical, v in checks]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Counts, precision and recall; 0 where nothing was predicted or nothing is gold."""
    g, p = known(F.col(gold)), known(F.col(pred))
    share = lambda a, b: F.round(F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b)), 6)
    n = df.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(p).alias("__p"), F.count_if(g).alias("__g"))
    return n.select("tp", "fp", "fn", share("tp", "__p").alias("precision_"), share("tp", "__g").alias("recall"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of either side, those whose values differ and those that the right side lacks."""
    a = left.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.col(value).alias("a_value"))
    b = right.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col(value).alias("b_value"))
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]
    rows = a.join(b, on, "full_outer")
    return rows.agg(F.count("*").alias("keys"), F.count_if(~F.col("a_value").eqNullSafe(F.col("b_value"))).alias("mismatches"), F.count_if(F.col(f"b_{keys[0]}").isNull()).alias("missing"))


# --- coverage of fiscal years -------------------------------------------------------------


class IncompleteCoverage(ValueError):
    """A year's artifacts leave quarters out, overlap or are not reviewed."""


def coverage_problems(artifacts: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(fiscal_year, problem) of every year; null where its artifacts cover it rightly.

    A year with a partial artifact must be the latest and have that one cumulative artifact;
    any other year has one annual artifact, or quarter partitions that cover each quarter once
    and are just those reviewed.  ``reviewed`` has fiscal_year, first and last of each segment.
    """
    segment = lambda a, b: F.struct(F.col(a).cast("int").alias("first"), F.col(b).cast("int").alias("last"))
    first, last, partition = F.col("coverage_start_quarter"), F.col("fiscal_quarter"), F.col("is_quarter_partition")
    sound = known(first <= last)
    years = artifacts.groupBy("fiscal_year").agg(
        F.count("*").alias("n"),
        F.max("is_partial_period").alias("partial"),
        F.min(partition).alias("parts"),
        F.max(last).alias("quarter"),
        F.count_if(~sound).alias("unsound"),
        F.sort_array(F.flatten(F.collect_list(F.when(sound, F.sequence(first, last))))).alias("quarters"),
        F.sort_array(F.collect_list(segment("coverage_start_quarter", "fiscal_quarter"))).alias("segments"),
    )
    latest = F.broadcast(artifacts.agg(F.max("fiscal_year").alias("latest")))  # one row
    known_ = reviewed.groupBy("fiscal_year").agg(F.sort_array(F.collect_list(segment("first", "last"))).alias("right"))
    rows = years.crossJoin(latest).join(known_, "fiscal_year", "left")
    alone = (F.col("n") == 1) & ~F.col("parts")
    problem = (
        F.when(F.col("partial"), F.when(~(alone & (F.col("fiscal_year") == F.col("latest"))), "PARTIAL_YEAR"))
        .when(alone & F.col("quarter").isNull(), None)
        .when(~F.col("parts"), "NOT_PARTITIONED")
        .when(F.col("unsound") > 0, "QUARTER_BOUNDS")
        .when(F.array_join("quarters", ",") != "1,2,3,4", "QUARTERS_COVERED")
        .when(~known(F.col("segments") == F.col("right")), "NOT_REVIEWED")
    )
    return rows.select("fiscal_year", problem.alias("problem"))


def require_coverage(artifacts: DataFrame, reviewed: DataFrame) -> None:
    bad = coverage_problems(artifacts, reviewed).where("problem is not null").orderBy("fiscal_year").limit(10).collect()
    if bad:
        raise IncompleteCoverage("; ".join(f"FY{r['fiscal_year']}: {r['problem']}" for r in bad))


# --- gold pairs ---------------------------------------------------------------------------


def gold_report(pairs: DataFrame, minimums: Mapping[str, int] | None = None) -> DataFrame:
    """One row: how automatic matching would do on labelled pairs of names.

    Pairs have category, {left,right}_{name,city,state}, expected_match, ambiguous and
    parent_legal_pair.  It passes with precision of 0.99, no false match, no parent merged
    with its legal entity, every ambiguous pair left to review and enough pairs of each category.
    """
    side = {f"{s}_{c}": f for s in ("left", "right") for c, f in (("norm", normalize_name(F.col(f"{s}_name"))), ("place", normalize_city(F.col(f"{s}_city"))))}
    df = pairs.withColumns(side)
    score = F.round(
        name_score(core_name(F.col("left_norm")), core_name(F.col("right_norm")))
        + F.when((F.col("left_state") != "") & (F.col("left_state") == F.col("right_state")), 0.08).otherwise(0.0)
        + F.when((F.col("left_place") != "") & (F.col("left_place") == F.col("right_place")), 0.05).otherwise(0.0),
        6,
    )
    near = (F.col("left_state") != "") & (F.col("left_state") == F.col("right_state")) & (F.col("left_place") != "") & (F.col("left_place") == F.col("right_place"))
    exact = (F.col("left_norm") != "") & (F.col("left_norm") == F.col("right_norm")) & ~location_conflict(F.col("left_state"), F.col("left_place"), F.col("right_state"), F.col("right_place"))
    fuzzy = (score >= AUTO) & near & ~suffix_conflict(legal_suffix(F.col("left_norm")), legal_suffix(F.col("right_norm")))
    df = df.withColumn("accepted", known(exact | fuzzy))
    got, right = F.col("accepted"), F.col("expected_match")
    need = minimums or {}
    n = df.agg(
        F.count("*").alias("row_count"),
        F.count_if(got).alias("auto_accepted"),
        F.count_if(got & right).alias("correct_auto"),
        F.count_if(got & ~right).alias("false_auto"),
        F.count_if(got & F.col("parent_legal_pair")).alias("parent_legal_collapses"),
        F.count_if("ambiguous").alias("ambiguous_total"),
        F.count_if(F.col("ambiguous") & ~got).alias("ambiguous_routed"),
        *(F.count_if(F.col("category") == c).alias(f"__{c}") for c in need),
    )
    precision = F.when(F.col("auto_accepted") == 0, 0.0).otherwise(F.col("correct_auto") / F.col("auto_accepted"))
    passed = (precision >= 0.99) & (F.col("false_auto") == 0) & (F.col("parent_legal_collapses") == 0) & (F.col("ambiguous_routed") == F.col("ambiguous_total"))
    for c, least in need.items():
        passed &= F.col(f"__{c}") >= least
    return n.select("row_count", "auto_accepted", "false_auto", "parent_legal_collapses", "ambiguous_total", "ambiguous_routed", F.round(precision, 6).alias("auto_precision"), passed.alias("passed"))


# --- reviewed facts against a benchmark ---------------------------------------------------


def policy_evaluation(facts: DataFrame, documents: DataFrame, annotations: DataFrame, institutions: int = 30) -> DataFrame:
    """One row: how far accepted facts agree with annotations, and whether all are supported.

    A fact counts if its review accepted it and it is current.  An annotation is met by the
    fact of its institution, address and type; that is correct if the value is equal, the
    annotated excerpt stands in the fact's and the fact's was verified.  Of several such
    facts the largest (by value, excerpt, verified) is taken.
    """
    now = facts.where(known((F.col("human_review_status") == "REVIEWED_ACCEPTED") & F.col("is_current")) & F.col("valid_to").isNull())
    keys = ["policy_document_id", "institution_id"]
    domain = F.rtrim(F.lower(F.coalesce("official_domain", F.lit(""))), F.lit("."))
    now = checked_join(now, documents.select(*keys, domain.alias("__domain")), keys)
    official = known(F.col("__domain") != "") & is_official(F.col("source_url"), F.col("__domain"))
    said, verified = known(F.trim("supporting_excerpt") != ""), known(F.col("exact_excerpt_verified"))
    now = now.select("institution_id", "source_url", "fact_type", "fact_value", "supporting_excerpt", official.alias("official"), said.alias("said"), verified.alias("verified"))
    totals = now.agg(F.count("*").alias("n"), F.count_if("official").alias("urls"), F.count_if("said").alias("excerpts"), F.count_if(~F.col("verified") | ~F.col("official") | ~F.col("said")).alias("unsupported"))
    on = ["institution_id", "source_url", "fact_type"]
    one = now.groupBy(*on).agg(F.max(F.struct("fact_value", "supporting_excerpt", "verified")).alias("fact"))
    met = annotations.join(one, on, "left")
    want = evidence_text(F.col("supporting_excerpt"))
    right = (F.col("fact.fact_value") == F.col("expected_value")) & (want != "") & F.contains(evidence_text(F.col("fact.supporting_excerpt")), want) & F.col("fact.verified")
    n = met.agg(F.count("*").alias("annotations"), F.count_distinct("institution_id").alias("institutions"), F.count_if(F.col("fact").isNotNull()).alias("evaluated"), F.count_if(known(right)).alias("correct"))
    share = lambda a, b: F.round(F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b)), 6)
    out = n.crossJoin(F.broadcast(totals))  # one row each
    out = out.withColumns({"precision_": share("correct", "evaluated"), "coverage": share("evaluated", "annotations"), "url_rate": share("urls", "n"), "excerpt_rate": share("excerpts", "n")})
    whole = (F.col("evaluated") == F.col("annotations")) & (F.col("annotations") > 0) & (F.col("urls") == F.col("n")) & (F.col("excerpts") == F.col("n")) & (F.col("n") > 0)
    passed = (F.col("institutions") >= institutions) & (F.col("precision_") >= 0.95) & whole & (F.col("unsupported") == 0)
    return out.select("annotations", "institutions", "evaluated", "correct", "precision_", "coverage", "url_rate", "excerpt_rate", "unsupported", passed.alias("passed"))


# --- fingerprints -------------------------------------------------------------------------


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, the digest of the rows of the given columns, whatever their order and files.

    Each row's SHA-256 is cut into eight numbers, whose sums and the row count are hashed.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(columns)))
    rows = df.select(F.sha2(text, 256).alias("h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for k in range(8)]
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("fingerprint"))


def build_id(prefix: str, material: Mapping[str, object]) -> str:
    """prefix- and 16 hex digits of what a build was made from: versions, counts, fingerprints."""
    return f"{prefix}-{hashlib.sha256(json.dumps(material, sort_keys=True).encode()).hexdigest()[:16]}"
