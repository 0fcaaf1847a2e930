"""Queries of superseded cases, active artifacts, cohorts, enrichment, reviews and reconciled names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import history as H
from docketry.plans.local import Tables, query

C, L = F.col, F.lit

#: Orders as certified cases of one artifact; some come back as withdrawn in another, under other spellings.
_AGAIN = "o_orderkey % 10 = 0"


def _cases(t: Tables, odd: bool = False) -> DataFrame:
    o = t.orders.select(C("o_orderkey").cast("string").alias("case_id"), C("o_orderkey").alias("k"), C("o_custkey").alias("who"), C("o_orderdate").cast("date").alias("day"))
    name = F.concat(L("Acme–"), C("who").cast("string"))
    a = o.select("case_id", L("a").alias("source_artifact_id"), C("k").alias("source_row_number"), F.year("day").alias("fiscal_year"), L("Certified").alias("case_status"), C("day").alias("decision_date"), name.alias("employer_name_raw"), L("2139").alias("employer_postal_code"))
    later = F.date_add("day", F.when((C("k") % 40 == 0) & L(odd), 0).otherwise(30))
    again = F.concat(L(" acme"), F.when((C("k") % 60 == 0) & L(odd), "x").otherwise(""), C("who").cast("string"))
    b = o.where(C("k") % 10 == 0).select("case_id", L("b").alias("source_artifact_id"), C("k").alias("source_row_number"), F.year(later).alias("fiscal_year"), L(" certified -  withdrawn").alias("case_status"), later.alias("decision_date"), again.alias("employer_name_raw"), L("02139").alias("employer_postal_code"))
    return a.unionByName(b)


_LEDGER = f"""SELECT 'a' AS source_artifact_id, o_orderkey AS source_row_number, CAST(o_orderkey AS VARCHAR) AS case_id, CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(year(CAST(o_orderdate AS DATE) + 30) AS INT) AS superseding_fiscal_year,
 'b' AS superseding_source_artifact_id, o_orderkey AS superseding_source_row_number, CAST(o_orderdate AS DATE) AS earlier_decision_date, CAST(o_orderdate AS DATE) + 30 AS later_decision_date FROM orders WHERE {_AGAIN}"""


@query("do03_supersession", _LEDGER)
def do03(t: Tables) -> DataFrame:
    return H.superseded(_cases(t))


@query("do03_overlaps", f"SELECT CAST(o_orderkey AS VARCHAR) AS case_id, 2 AS n, o_orderkey % 40 <> 0 AND o_orderkey % 60 <> 0 AS valid FROM orders WHERE {_AGAIN}")
def do03_overlaps(t: Tables) -> DataFrame:
    return H.case_overlaps(_cases(t, odd=True)).select("case_id", C("n").cast("int").alias("n"), "valid")


@query("do04_apply_supersession", f"SELECT CASE WHEN {_AGAIN} THEN 'b' ELSE 'a' END AS source_artifact_id, CAST(o_orderkey AS VARCHAR) AS case_id FROM orders")
def do04(t: Tables) -> DataFrame:
    rows = _cases(t)
    return H.without_superseded(rows, H.superseded(rows)).select("source_artifact_id", "case_id")


@query("do52_ledger_audit", f"SELECT n + m AS staged, n AS staged_cases, m AS superseded, m AS superseded_found, n AS active, n AS active_cases, 0::BIGINT AS superseded_left, TRUE AS passed FROM (SELECT count(*) AS n, count_if({_AGAIN})::BIGINT AS m FROM orders)")
def do52(t: Tables) -> DataFrame:
    rows = _cases(t)
    ledger = H.superseded(rows)
    return H.ledger_audit(rows, ledger, H.without_superseded(rows, ledger))


@query("do01_active_artifacts", """SELECT o_orderpriority AS source_id, 'u' || o_custkey AS download_url, CAST(year(o_orderdate) AS INT) AS fiscal_year, CASE WHEN o_orderstatus <> 'F' THEN CAST(quarter(o_orderdate) AS INT) END AS fiscal_quarter,
 arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS source_artifact_id, max(o_orderdate) AS retrieved_at, 'PASSED' AS validation_status FROM orders GROUP BY ALL""")
def do01(t: Tables) -> DataFrame:
    o, d = t.orders, C("o_orderdate")
    base = o.select(
        C("o_orderpriority").alias("source_id"), F.concat(L("u"), C("o_custkey").cast("string")).alias("download_url"), F.year(d).alias("fiscal_year"), F.when(C("o_orderstatus") != "F", F.quarter(d)).alias("fiscal_quarter"),
        L(False).alias("is_partial_period"), L(False).alias("is_quarter_partition"), L(1).alias("coverage_start_quarter"), L(None).cast("string").alias("file_name"), L("p1").alias("parser_version"), L("s1").alias("schema_version"),
        C("o_orderkey").alias("source_artifact_id"), d.alias("retrieved_at"), L("PASSED").alias("validation_status"), L(True).alias("available"),
    )
    older = base.withColumns({"retrieved_at": F.expr("retrieved_at - interval 9 years"), "validation_status": L("FAILED"), "available": L(False)})
    out = H.active_artifacts(base.select(*H.MANIFEST_KEY).distinct(), base.unionByName(older))
    return out.select("source_id", "download_url", "fiscal_year", "fiscal_quarter", "source_artifact_id", "retrieved_at", "validation_status")


@query("do25_latest_shared_cohort", "SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS top FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1, 2 UNION ALL SELECT NULL, CAST(ts AS DATE), value FROM events WHERE event_type = 'error' AND CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def do25(t: Tables) -> DataFrame:
    day = C("ts").cast("date").alias("day")
    named = t.events.groupBy("user_id", day).agg(F.max("value").alias("top"))
    unknown = t.events.where("event_type = 'error'").select(L(None).cast("long").alias("user_id"), day, C("value").alias("top"))  # may repeat
    return H.latest_cohort(named.unionByName(unknown), "user_id", "day")


_STATES = ("CONFIRMED_ACTIVE", "CONFIRMED_INACTIVE", "NO_MATCH", "AMBIGUOUS")


@query("do29_lookup_enrichment", """WITH e AS (SELECT o_custkey AS organization_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1),
p AS (SELECT l_suppkey AS organization_id, CAST(year(l_shipdate) AS INT) AS y, l_orderkey * 10 + l_linenumber AS r, CAST(l_quantity AS BIGINT) AS n FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus = 'O'),
o AS (SELECT organization_id, y, r, n FROM p QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY y DESC, r, n DESC) = 1),
s AS (SELECT c_custkey AS organization_id, ['CONFIRMED_ACTIVE', 'CONFIRMED_INACTIVE', 'NO_MATCH', 'AMBIGUOUS'][k % 4 + 1] AS looked, 'u' || k AS url, y, r, n FROM customer c LEFT JOIN e ON c_custkey = e.organization_id LEFT JOIN o ON c_custkey = o.organization_id)
SELECT organization_id, CASE WHEN looked IS NULL OR NOT starts_with(looked, 'CONFIRMED') THEN 'UNKNOWN' ELSE looked END AS everify_status, coalesce(looked, 'NOT_CHECKED') AS everify_lookup_status, url AS everify_source_url, CASE WHEN y IS NULL THEN 'UNKNOWN' ELSE 'OBSERVED_POSITIVE' END AS known_opt_observation,
 y AS opt_report_year, n AS opt_reported_count, r AS opt_report_rank FROM s""")
def do29(t: Tables) -> DataFrame:
    k = C("o_orderkey")
    everify = t.orders.select(
        C("o_custkey").alias("organization_id"), F.struct("o_orderdate", "o_orderkey").alias("retrieved_at"), F.element_at(F.array(*(L(s) for s in _STATES)), (k % 4 + 1).cast("int")).alias("enrollment_status"),
        F.concat(L("u"), k.cast("string")).alias("source_url"), L(1.0).alias("match_confidence"), L("NOT_REQUIRED").alias("review_status"),
    )
    opt = t.lineitem.select(
        C("l_suppkey").alias("organization_id"), F.year("l_shipdate").alias("report_year"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("rank"), C("l_quantity").cast("long").alias("reported_count"),
        F.when(C("l_returnflag") != "A", "OPT_OR_STEM_OPT").otherwise("CPT").alias("program_type"), (C("l_linestatus") == "O").alias("is_positive"), L("https://x").alias("source_url"),
    )
    base = t.customer.select(C("c_custkey").alias("organization_id"), L("UNKNOWN").alias("everify_status"), L("UNKNOWN").alias("known_opt_observation"))
    out = H.enrich_lookups(base, everify, opt)
    return out.select("organization_id", "everify_status", "everify_lookup_status", "everify_source_url", "known_opt_observation", "opt_report_year", "opt_reported_count", "opt_report_rank")


_KINDS = [*H.POLICY_COLUMNS, "waiting_period"]
_FACT = f"""SELECT o_custkey AS institution_id, o_orderkey AS policy_fact_id, CASE o_orderkey % {len(_KINDS)} {' '.join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(_KINDS))} END AS fact_type, CASE o_orderkey % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'LIMITED' ELSE 'NOT_STATED' END AS fact_value,
 CASE o_orderkey % 7 WHEN 0 THEN 'REVIEWED_ACCEPTED' WHEN 1 THEN 'REVIEWED_NOT_STATED' WHEN 2 THEN 'REVIEWED_ACCEPTED' WHEN 3 THEN 'NEEDS_REVIEW' ELSE 'REVIEWED_REJECTED' END AS human_review_status, o_orderkey % 5 <> 0 AS exact_excerpt_verified, o_orderkey % 11 <> 0 AS is_current,
 CASE WHEN o_orderkey % 13 = 0 THEN '2024' END AS valid_to, CASE WHEN o_orderkey % 17 = 0 THEN 'http://x' ELSE 'https://x' END AS source_url, o_orderkey AS valid_from FROM {{orders}}"""
_USABLE = "is_current AND valid_to IS NULL AND starts_with(source_url, 'https://') AND ((human_review_status = 'REVIEWED_ACCEPTED' AND exact_excerpt_verified) OR (human_review_status = 'REVIEWED_NOT_STATED' AND fact_value = 'NOT_STATED'))"


@query("do30_policy_enrichment", f"""WITH f AS ({_FACT.format(orders="orders")}), l AS (SELECT institution_id, fact_type, arg_max(fact_value, valid_from) AS v FROM f WHERE {_USABLE} GROUP BY 1, 2), w AS (SELECT institution_id, {", ".join(f"max(CASE WHEN fact_type = '{k}' THEN v END) AS {c}" for k, c in H.POLICY_COLUMNS.items())} FROM l GROUP BY 1),
s AS (SELECT institution_id, bool_or(human_review_status = 'REVIEWED_ACCEPTED') AS a, bool_or(human_review_status = 'REVIEWED_NOT_STATED') AS b, bool_or(human_review_status = 'NEEDS_REVIEW') AS p FROM f GROUP BY 1)
SELECT c_custkey AS institution_id, {", ".join(f"coalesce({c}, 'UNKNOWN') AS {c}" for c in H.POLICY_COLUMNS.values())}, CASE WHEN (a OR b) AND p THEN 'PARTIALLY_REVIEWED' WHEN a OR b THEN 'REVIEWED' WHEN p THEN 'NEEDS_REVIEW' ELSE 'NOT_REVIEWED' END AS policy_review_status,
 'DERIVED_METRIC' || CASE WHEN a THEN '|REVIEWED_OFFICIAL_POLICY' WHEN b THEN '|REVIEWED_POLICY_PROFILE' ELSE '' END AS evidence_classes FROM customer LEFT JOIN w ON c_custkey = w.institution_id LEFT JOIN s ON c_custkey = s.institution_id""")
def do30(t: Tables) -> DataFrame:
    base = t.customer.select(C("c_custkey").alias("institution_id"), *(L("UNKNOWN").alias(c) for c in H.POLICY_COLUMNS.values()), L("NOT_REVIEWED").alias("policy_review_status"), L("DERIVED_METRIC").alias("evidence_classes"))
    return H.enrich_policy(base, t.spark.sql(_FACT, orders=t.orders))


@query("do42_review_overlay", """SELECT d.doc_id, CASE WHEN quality = 1 THEN 'REVIEWED_ACCEPTED' WHEN quality = 0 THEN 'REVIEWED_NOT_STATED' ELSE 'NEEDS_REVIEW' END AS human_review_status, CASE WHEN quality IS NOT NULL THEN 'seen' ELSE 'PENDING_HUMAN_REVIEW' END AS reviewer_note,
 quality IS NOT NULL AS is_current, CASE WHEN quality IS NOT NULL THEN 'r1' END AS reviewer_id FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NOT NULL""")
def do42(t: Tables) -> DataFrame:
    seen = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    decisions = seen.where("quality is not null").select(
        C("doc_id").alias("policy_fact_id"), F.when(C("quality") == 1, "REVIEWED_ACCEPTED").otherwise("REVIEWED_NOT_STATED").alias("human_review_status"), L("seen").alias("reviewer_note"), L(True).alias("current_confirmed"),
        L("2024-01-01").alias("reviewed_at"), L("r1").alias("reviewer_id"),
    )
    silent = seen.select(C("doc_id"), (C("quality") == 0).alias("silent"))
    facts = t.documents.where("doc_id is not null").select("doc_id").join(silent, "doc_id", "left").select(
        C("doc_id").alias("policy_fact_id"), L("NEEDS_REVIEW").alias("human_review_status"), L("PENDING_HUMAN_REVIEW").alias("reviewer_note"), L(False).alias("is_current"), L(None).cast("string").alias("valid_to"), L(True).alias("exact_excerpt_verified"),
        L("https://x").alias("source_url"), L("said so").alias("supporting_excerpt"), F.when(C("silent"), "NOT_STATED").otherwise("YES").alias("fact_value"),
    )
    return H.apply_reviews(facts, decisions).select(C("policy_fact_id").alias("doc_id"), "human_review_status", "reviewer_note", "is_current", "reviewer_id")


@query("do39_name_reconciliation", """WITH r AS (SELECT n_name AS name, 0 AS k, NULL AS legal, 'p' || n_nationkey AS parent FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'NATION_' || (c_custkey % 25), 1, 'l' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'q' || (c_custkey % 25) END FROM customer WHERE c_custkey % 25 % 3 = 1
 UNION ALL SELECT 'NATION_' || (s_suppkey % 25), 2, 'l' || s_suppkey, NULL FROM supplier WHERE s_suppkey < 25),
o AS (SELECT *, coalesce(parent, legal) AS org, min(k) OVER (PARTITION BY name) AS best FROM r), g AS (SELECT name, best, count(DISTINCT org) AS orgs, min(org) AS org, count(DISTINCT legal) AS legals, min(legal) AS legal, count(DISTINCT parent) AS parents, min(parent) AS parent FROM o WHERE k = best GROUP BY 1, 2)
SELECT n_name AS name, CASE WHEN orgs = 1 THEN org END AS organization_id, CASE WHEN orgs = 1 AND legals = 1 THEN legal END AS legal_entity_id, CASE WHEN orgs = 1 AND parents = 1 THEN parent END AS parent_organization_id,
 CASE WHEN orgs IS NULL THEN 'NO_EXACT_MATCH' WHEN orgs > 1 THEN 'AMBIGUOUS_EXACT_MATCH' ELSE ['EXACT_PARENT_NAME', 'EXACT_LEGAL_NAME', 'EXACT_OBSERVED_ALIAS'][best + 1] END AS match_method, CASE WHEN orgs IS NULL OR orgs > 1 THEN 0 WHEN best = 2 THEN 0.99 ELSE 1 END::DOUBLE AS match_confidence
FROM nation LEFT JOIN g ON n_name = name""")
def do39(t: Tables) -> DataFrame:
    k = C("c_custkey")
    parents = t.nation.where("n_nationkey % 3 = 0").select(F.concat(L("p"), C("n_nationkey").cast("string")).alias("parent_organization_id"), C("n_name").alias("name"))
    legal = t.customer.where(k % 25 % 3 == 1).select(F.concat(L("l"), k.cast("string")).alias("legal_entity_id"), F.when(k % 2 == 0, F.concat(L("q"), (k % 25).cast("string"))).alias("parent_organization_id"), F.concat(L("nation "), (k % 25).cast("string")).alias("name"))
    s = C("s_suppkey")
    aliases = t.supplier.where("s_suppkey < 25").select(F.concat(L("l"), s.cast("string")).alias("legal_entity_id"), L(None).cast("string").alias("parent_organization_id"), F.concat(L("Nation-"), (s % 25).cast("string")).alias("name"))
    out = H.reconcile_names(t.nation.select(C("n_name").alias("name")), parents, legal, aliases)
    return out.select("name", "organization_id", "legal_entity_id", "parent_organization_id", "match_method", "match_confidence")
