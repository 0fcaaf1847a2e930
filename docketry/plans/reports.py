"""Queries of selections, dimensions, reports and the quality gate."""

from __future__ import annotations

import io
import zipfile
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import reports as R
from docketry.operators.classify import classify
from docketry.plans.local import ENTITIES, FIRST, SECOND, Tables, entities, first_cases, query, second_cases
from docketry.plans.services import _CLASSIFY, TAXONOMY, _titles
from docketry.session import Scratch
from docketry.sources.files import read_zipped_csv, upsert, write_bytes, write_json

C, L = F.col, F.lit


@query("sc06_zipped_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def sc06(t: Tables) -> DataFrame:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("data/nation.csv", t.nation.select("n_nationkey", "n_name").toPandas().to_csv(index=False))  # the table of nations doesn't grow
    path = Scratch(t.spark, "zip").path("nation.zip")
    write_bytes(t.spark, path, held.getvalue())
    return read_zipped_csv(t.spark, path, "data/nation.csv", ["n_nationkey", "n_name"])


@query("sc18_json_ledger", "SELECT CAST(r_regionkey AS BIGINT) AS k, CASE WHEN r_regionkey % 2 = 0 THEN 'new ' ELSE '' END || r_name AS name FROM region UNION ALL SELECT 99, 'added'")
def sc18(t: Tables) -> DataFrame:
    old = [{"k": r["r_regionkey"], "name": r["r_name"]} for r in t.region.collect()]  # a ledger of files, small by nature
    new = [{"k": x["k"], "name": f"new {x['name']}"} for x in old if x["k"] % 2 == 0] + [{"k": 99, "name": "added"}]
    path = Scratch(t.spark, "ledger").path("ledger.json")
    write_json(t.spark, path, old)
    write_json(t.spark, path, upsert(old, new, ["k"]))
    return t.spark.read.schema("k long, name string").json(path, multiLine=True)


@query("sc12_canonical_files", """WITH c AS (SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderstatus AS v, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN NULL ELSE CAST(quarter(o_orderdate) AS INT) END AS q, min(o_orderkey) AS id FROM orders WHERE year(o_orderdate) < (SELECT max(year(o_orderdate)) FROM orders) OR quarter(o_orderdate) < 3 AND (o_orderstatus <> 'F' OR o_orderkey % 3 <> 0) GROUP BY ALL),
g AS (SELECT y, v, bool_or(q IS NULL) AS annual, max(q) AS last FROM c GROUP BY ALL), x AS (SELECT *, y < max(y) OVER () AS done FROM g)
SELECT c.y AS fiscal_year, c.v AS variant, c.q AS fiscal_quarter, id AS candidate_id, CASE WHEN annual OR NOT done THEN 1 WHEN c.q = 2 THEN 1 ELSE c.q END AS coverage_start_quarter, NOT done AS is_partial_period, done AND NOT annual AS is_quarter_partition
FROM c JOIN x ON c.y = x.y AND c.v = x.v WHERE CASE WHEN done AND annual THEN c.q IS NULL WHEN done THEN c.q >= 2 ELSE c.q = x.last END""")
def sc12(t: Tables) -> DataFrame:
    d = C("o_orderdate")
    q = F.when(~((C("o_orderstatus") == "F") & (C("o_orderkey") % 3 == 0)), F.quarter(d))
    rows = t.orders.select(C("o_orderkey").alias("candidate_id"), F.year(d).alias("fiscal_year"), C("o_orderstatus").alias("variant"), q.alias("fiscal_quarter"), F.format_string("https://x/%015d", "o_orderkey").alias("download_url"))
    last = F.broadcast(rows.agg(F.max("fiscal_year").alias("last")))
    rows = rows.crossJoin(last).where("fiscal_year < last or fiscal_quarter < 3").drop("last")  # the last year is still running
    segments = rows.select("fiscal_year").distinct().select("fiscal_year", F.explode(F.expr("array(struct(1 as a, 2 as b), struct(3 as a, 3 as b), struct(4 as a, 4 as b))")).alias("s"))
    return R.canonical_files(rows, segments.select("fiscal_year", C("s.a").alias("first"), C("s.b").alias("last")))


_ORGS = f"""WITH {ENTITIES}, p AS (SELECT n_nationkey + 1000000000 AS parent_id, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'TECHNOLOGY' WHEN 1 THEN 'HIGHER_EDUCATION_SYSTEM' ELSE 'OTHER' END AS kind FROM nation WHERE n_nationkey <> 9),
u AS (SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PRIVATE_NONPROFIT' WHEN 2 THEN 'PRIVATE_FOR_PROFIT' END AS control, CASE WHEN s_suppkey % 4 = 0 THEN 1000000000 + s_nationkey END AS parent_id FROM supplier),
c AS (SELECT id, min(control) AS control FROM (SELECT s_suppkey AS id, control FROM u UNION ALL SELECT parent_id, control FROM u WHERE parent_id IS NOT NULL) GROUP BY 1),
d AS (SELECT 'LEGAL_ENTITY' AS identity_scope, legal_entity_id AS organization_id, legal_name AS organization_name, p.name AS parent_organization_name, CASE WHEN segment = 'FURNITURE' THEN 'RETAIL' ELSE 'OTHER' END AS kind, CAST(1 AS BIGINT) AS legal_entity_count, coalesce(kind = 'TECHNOLOGY', FALSE) AS is_staffing_or_consulting FROM entities LEFT JOIN p USING (parent_id)
 UNION ALL SELECT 'PARENT_ROLLUP', parent_id, p.name, p.name, kind, (SELECT count(*) FROM entities e WHERE e.parent_id = p.parent_id), kind = 'TECHNOLOGY' FROM p)
SELECT identity_scope, organization_id, organization_name, parent_organization_name, legal_entity_count, is_staffing_or_consulting, CASE control WHEN 'PUBLIC' THEN 'university_public' WHEN 'PRIVATE_NONPROFIT' THEN 'university_private_nonprofit' WHEN 'PRIVATE_FOR_PROFIT' THEN 'college_other' ELSE
 CASE WHEN kind IN ('TECHNOLOGY', 'RETAIL') THEN 'for_profit' WHEN kind = 'HIGHER_EDUCATION_SYSTEM' THEN 'university_system' ELSE 'unknown' END END AS organization_type FROM d LEFT JOIN c ON organization_id = id"""


@query("do22_organization_types", _ORGS)
def do22(t: Tables) -> DataFrame:
    n = C("n_nationkey")
    parents = t.nation.where("n_nationkey <> 9").select((n.cast("long") + 1_000_000_000).alias("parent_organization_id"), C("n_name").alias("canonical_name"), F.when(n % 4 == 0, "TECHNOLOGY").when(n % 4 == 1, "HIGHER_EDUCATION_SYSTEM").otherwise("OTHER").alias("organization_type"), L("X").alias("headquarters_state"), (n % 4 == 0).alias("is_staffing_or_consulting"), L("REVIEWED").alias("review_status"))
    legal = entities(t).select("legal_entity_id", C("parent_id").alias("parent_organization_id"), "legal_name", "state", F.when(C("segment") == "FURNITURE", "RETAIL").otherwise("OTHER").alias("organization_type"), L("AUTO").alias("review_status"))
    k = C("s_nationkey")
    institutions = t.supplier.select(C("s_suppkey").alias("legal_entity_id"), F.when(C("s_suppkey") % 4 == 0, k.cast("long") + 1_000_000_000).alias("parent_organization_id"), F.when(k % 4 == 0, "PUBLIC").when(k % 4 == 1, "PRIVATE_NONPROFIT").when(k % 4 == 2, "PRIVATE_FOR_PROFIT").alias("control"))
    return R.organizations(legal, parents, institutions).select("identity_scope", "organization_id", "organization_name", "parent_organization_name", "legal_entity_count", "is_staffing_or_consulting", "organization_type")


def _health_sql(name: str, table: str, y: str, partial: str, quarter: str) -> str:
    return f"""SELECT '{name}' AS source_id, count(*) AS row_count, CAST(min({y}) AS INT) AS earliest_year, CAST(max({y}) AS INT) AS latest_year, CAST(max(CASE WHEN NOT ({partial}) THEN {y} END) AS INT) AS latest_complete_fiscal_year, CAST(max(CASE WHEN {partial} THEN {y} END) AS INT) AS current_partial_fiscal_year,
 CAST(max(CASE WHEN {partial} THEN {quarter} END) AS INT) AS current_partial_quarter, count_if({partial}) > 0 AS has_partial_period, 'OBSERVED_GOVERNMENT_RECORD' AS evidence_class, CASE WHEN count_if({partial}) > 0 THEN 'Partial FY' || max(CASE WHEN {partial} THEN {y} END) || ' data must not be compared with complete years without a warning.' END AS freshness_warning FROM {table}"""


@query("do27_source_health", f"WITH {ENTITIES}, {FIRST}, {SECOND} " + " UNION ALL ".join([
    _health_sql("dol_lca", "first_cases", "fiscal_year", "is_partial_period", "CAST(floor(((month(decision_date) + 2) % 12) / 3) AS INT) + 1"), _health_sql("dol_perm", "second_cases", "fiscal_year", "is_partial_period", "NULL"),
    _health_sql("uscis_h1b", "events", "year(ts)", "FALSE", "NULL"), _health_sql("ipeds", "supplier", "s_nationkey + 2000", "FALSE", "NULL"), _health_sql("herd", "part", "p_size + 1990", "FALSE", "NULL")]))
def do27(t: Tables) -> DataFrame:
    events = t.events.select(F.year("ts").alias("y"), L(False).alias("is_partial_period"))
    sources = {"dol_lca": (first_cases(t), "fiscal_year", "fiscal_quarter"), "dol_perm": (second_cases(t), "fiscal_year", None), "uscis_h1b": (events, "y", None)}
    return R.source_health(sources, {"ipeds": (t.supplier.select((C("s_nationkey") + 2000).alias("y")), "y"), "herd": (t.part.select((C("p_size") + 1990).alias("y")), "y")})


#: The second taxonomy has no rule for sales and knows no ambiguous titles.
_SECOND = _CLASSIFY.replace(" OR (regexp_matches(t, '5$') AND NOT regexp_matches(t, '0$|15$'))", "").replace("  WHEN regexp_matches(t, '2$') THEN 'NEEDS_REVIEW'", "").replace(" WHEN regexp_matches(t, '2$') THEN 'NEEDS_REVIEW'", "")
_ROLE = lambda a: f"CASE WHEN {a}.technical_role THEN 'TECHNICAL' WHEN NOT {a}.technical_role THEN 'NOT_RELEVANT' ELSE 'AMBIGUOUS' END || ':' || {a}.role_family"
_CHANGES = f"""WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), ch AS (SELECT a.p_partkey, 'PART ' || a.p_partkey AS title, n, {_ROLE("a")} AS before, {_ROLE("b")} AS after FROM ({_CLASSIFY}) a JOIN ({_SECOND}) b USING (p_partkey) JOIN n ON a.p_partkey = l_partkey
 WHERE (a.technical_role, a.role_family, a.classification_method) IS DISTINCT FROM (b.technical_role, b.role_family, b.classification_method)) """


def _changes(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(C("l_partkey").alias("p_partkey")).agg(F.count("*").alias("occurrence_count"))
    titles = _titles(t).join(n, "p_partkey")
    second = replace(TAXONOMY, exclusions=TAXONOMY.exclusions[:1], ambiguous=())
    return R.taxonomy_changes(classify(titles, TAXONOMY), classify(titles, second), ["title", "code"])


@query("do18_transitions", _CHANGES + "SELECT before, after, CAST(sum(n) AS BIGINT) AS changed_records, count(*) AS changed_combinations FROM ch GROUP BY 1, 2")
def do18(t: Tables) -> DataFrame:
    return R.transitions(_changes(t))


@query("do18_review_sample", _CHANGES + "SELECT before, after, title, n AS occurrence_count, row_number() OVER (PARTITION BY before, after ORDER BY n DESC, title) AS place FROM ch QUALIFY place <= 25")
def do18_sample(t: Tables) -> DataFrame:
    return R.transition_sample(_changes(t), ["title", "code"], 25).select("before", "after", "title", "occurrence_count", "place")


_PACKET_FACTS = f"""SELECT l_suppkey AS institution_id, l_partkey AS policy_document_id, CASE l_linenumber % 5 {' '.join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(R.CORE_FACTS))} ELSE 'waiting_period' END AS fact_type, l_returnflag AS fact_value, 'https://x' AS source_url, CASE WHEN l_tax > 0.01 THEN l_linestatus END AS supporting_excerpt,
 CASE l_orderkey % 40 WHEN 0 THEN 'REVIEWED_ACCEPTED' WHEN 1 THEN 'REVIEWED_NOT_STATED' WHEN 2 THEN 'NEEDS_REVIEW' ELSE 'REVIEWED_REJECTED' END AS human_review_status, CAST(NULL AS VARCHAR(10)) AS reviewer_note, l_quantity > 10 AS exact_excerpt_verified, l_discount AS confidence, l_orderkey * 10 + l_linenumber AS retrieved_at,
 l_orderkey % 7 <> 0 AS is_current, CASE WHEN l_orderkey % 11 = 0 THEN '2024' END AS valid_to FROM {{lineitem}}"""


@query("do45_review_packet", f"""WITH top AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_nationkey DESC, s_name) AS priority_rank FROM supplier QUALIFY priority_rank <= 50), f AS ({_PACKET_FACTS.format(lineitem="lineitem")}),
b AS (SELECT * FROM f WHERE fact_type <> 'waiting_period' AND is_current AND valid_to IS NULL QUALIFY row_number() OVER (PARTITION BY institution_id, fact_type ORDER BY CASE human_review_status WHEN 'REVIEWED_ACCEPTED' THEN 0 WHEN 'REVIEWED_NOT_STATED' THEN 1 WHEN 'NEEDS_REVIEW' THEN 2 ELSE 3 END, exact_excerpt_verified DESC, confidence DESC, retrieved_at DESC) = 1)
SELECT priority_rank, s_name AS institution, k AS fact_type, coalesce(fact_value, 'UNKNOWN') AS extracted_value, coalesce(supporting_excerpt, '') AS supporting_excerpt, CASE WHEN fact_value IS NULL THEN '' ELSE coalesce(p_name, '') END AS page_title, coalesce(CAST(retrieved_at AS VARCHAR), '') AS retrieved_at, confidence AS extractor_confidence, coalesce(human_review_status, 'MISSING_CANDIDATE') AS review_status
FROM top CROSS JOIN (VALUES {", ".join(f"('{k}')" for k in R.CORE_FACTS)}) v(k) LEFT JOIN b ON institution_id = s_suppkey AND b.fact_type = k LEFT JOIN part ON p_partkey = policy_document_id AND p_size % 2 = 0""")
def do45(t: Tables) -> DataFrame:
    facts = t.spark.sql(_PACKET_FACTS, lineitem=t.lineitem)
    documents = facts.select("institution_id", "policy_document_id").distinct().join(t.part.where("p_size % 2 = 0").select(C("p_partkey").alias("policy_document_id"), C("p_name").alias("title")), "policy_document_id")
    none = L(None).cast("double")
    institutions = t.supplier.select(C("s_suppkey").alias("institution_id"), C("s_name").alias("official_name"), none.alias("sponsorship_history_coverage"), C("s_acctbal").alias("sponsorship_history_score"), C("s_nationkey").alias("relevant_certified_perm_count"), none.alias("h1b_history_score"), none.alias("research_strength_score"))
    return R.review_packet(institutions, facts, documents).select("priority_rank", "institution", "fact_type", "extracted_value", "supporting_excerpt", "page_title", "retrieved_at", "extractor_confidence", "review_status")


@query("do46_quality_gate", """WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS twice, (SELECT count(*) FROM events) AS e, (SELECT count_if(event_type <> 'view') FROM events) AS seen,
 (SELECT count_if(l_linenumber <> 7) FROM lineitem) AS classified, (SELECT count_if(s_nationkey = 3) FROM supplier) AS warned, (SELECT count(*) FROM supplier) AS s, (SELECT count_if(c_acctbal > 9000) FROM customer) AS odd),
v AS (SELECT 'required_processed_tables' AS check_id, FALSE AS ok, 8 AS value FROM n UNION ALL SELECT 'required_columns', FALSE, 1 FROM n UNION ALL SELECT 'source_manifest', TRUE, s FROM n UNION ALL SELECT 'manifest_validations', TRUE, 0 FROM n UNION ALL SELECT 'manifest_warnings', warned = 0, warned FROM n
 UNION ALL SELECT 'schema_reports', FALSE, (SELECT count_if(s_nationkey = 4) FROM supplier) + 2 FROM n UNION ALL SELECT 'duplicate_source_records', twice = 0, twice FROM n UNION ALL SELECT 'entity_match_coverage', (o + l + seen) >= 0.95::DOUBLE * (o + l + e), (o + l + seen)::DOUBLE / (o + l + e) FROM n
 UNION ALL SELECT 'role_classification_coverage', (o + classified) >= 0.98::DOUBLE * (o + l), (o + classified)::DOUBLE / (o + l) FROM n UNION ALL SELECT 'legal_parent_separation', FALSE, (SELECT count_if(c_custkey = c_nationkey) FROM customer) FROM n UNION ALL SELECT 'score_contract', odd = 0, odd FROM n UNION ALL SELECT 'source_freshness', TRUE, 5 FROM n)
SELECT check_id, CASE WHEN ok THEN 'PASS' WHEN check_id = 'manifest_warnings' THEN 'WARN' ELSE 'FAIL' END AS status, check_id <> 'manifest_warnings' AS critical, round(value::DOUBLE, 6) AS value FROM v""")
def do46(t: Tables) -> DataFrame:
    s, artifact = C("s_suppkey"), L("0").alias("source_artifact_id")
    score = C("c_acctbal") / 90
    tables = {
        "source_artifacts": t.supplier.select(s.alias("source_artifact_id")),
        "manifest": t.supplier.select(s.alias("source_artifact_id"), F.when(C("s_nationkey") == 3, "WARNING").otherwise("PASSED").alias("validation_status")).unionByName(t.spark.sql("SELECT -1L AS source_artifact_id, 'FAILED' AS validation_status")),
        "schema_reports": t.supplier.where("s_nationkey <> 4").select(s.alias("source_artifact_id"), F.when(s == s, 0).alias("missing_columns")).unionByName(t.supplier.where("s_nationkey <> 4").groupBy().agg(F.min("s_suppkey").alias("source_artifact_id"), L(2).alias("missing_columns"))),
        "lca_cases_resolved": t.orders.select(artifact, C("o_orderkey").alias("case_id"), C("o_custkey").alias("organization_id"), L(True).alias("technical_role")),
        "perm_cases_resolved": t.lineitem.select(artifact, (C("l_orderkey") * 10 + C("l_linenumber")).alias("case_id"), C("l_suppkey").alias("organization_id"), F.when(C("l_linenumber") != 7, L(False)).alias("technical_role")),
        "h1b_petitions_resolved": t.events.select(artifact, C("event_id").alias("source_row_number"), F.when(C("event_type") != "view", C("user_id")).alias("organization_id")),
        "legal_entities": t.customer.select(C("c_custkey").alias("legal_entity_id"), C("c_nationkey").cast("long").alias("parent_organization_id")),
        "employer_metrics": t.customer.select(L("m").alias("metric_version"), L("s").alias("score_version"), score.alias("h1b_history_score"), F.when(C("c_acctbal") > 0, 1).alias("h1b_history_star_rating"), L(0.5).alias("h1b_history_coverage")).where("h1b_history_score >= 0"),
        "institution_metrics": t.region.select(L("m").alias("metric_version"), L("s").alias("score_version"), L(None).cast("double").alias("research_scale_score"), L(None).cast("int").alias("research_scale_star_rating")),
        "data_health": t.region,
    }
    required = {n: ["organization_id"] for n in ("lca_cases_resolved", "perm_cases_resolved", "h1b_petitions_resolved")} | {"legal_entities": ["legal_entity_id", "legal_name"], "employer_metrics": [], "institution_metrics": [], "data_health": [], "source_artifacts": [], "parent_organizations": []}
    return R.quality_checks(tables, required, "m", "s").select("check_id", "status", "critical", F.round("value", 6).alias("value"))


_STATE = lambda flag, n: f"CASE WHEN NOT valid THEN 'UNRESOLVED_IDENTITY' WHEN {flag} AND {n} > 0 THEN 'PARTIAL_ENTITY_COVERAGE' WHEN {flag} THEN 'UNRESOLVED_IDENTITY' ELSE 'COMPLETE_ENTITY_COVERAGE' END"


@query("do24_coverage_states", f"""WITH b AS (SELECT c_custkey, c_nationkey % 4 <> 3 AS valid, c_custkey % 3 = 0 AS f, c_custkey % 5 = 0 AS g, c_custkey % 2 AS a, c_custkey % 4 AS b FROM customer), s AS (SELECT *, {_STATE("f", "a")} AS h1b, {_STATE("g", "b")} AS perm FROM b)
SELECT c_custkey, h1b AS h1b_entity_coverage_state, perm AS perm_entity_coverage_state, h1b <> 'UNRESOLVED_IDENTITY' AS h1b_entity_resolution_valid, CASE WHEN 'UNRESOLVED_IDENTITY' IN (h1b, perm) THEN 'UNRESOLVED_IDENTITY' WHEN 'PARTIAL_ENTITY_COVERAGE' IN (h1b, perm) THEN 'PARTIAL_ENTITY_COVERAGE' ELSE 'COMPLETE_ENTITY_COVERAGE' END AS entity_coverage_state FROM s""")
def do24_states(t: Tables) -> DataFrame:
    k, n = C("c_custkey"), C("c_nationkey") % 4
    status = F.when(n == 0, "DETERMINISTIC").when(n == 1, "HIGH_CONFIDENCE_AUTO").when(n == 2, "MANUAL_OVERRIDE")
    rows = t.customer.select(
        "c_custkey", status.alias("entity_resolution_status"), F.when(k % 3 == 0, True).alias("has_unresolved_h1b_candidate_evidence"), (k % 5 == 0).alias("has_unresolved_perm_candidate_evidence"),
        (k % 2).alias("weighted_relevant_lca_count"), (k % 4).alias("weighted_relevant_perm_count"),
    )
    return R.coverage_states(rows).select("c_custkey", "h1b_entity_coverage_state", "perm_entity_coverage_state", "h1b_entity_resolution_valid", "entity_coverage_state")


@query("do53_entity_audit", """WITH n AS (SELECT o_custkey AS id, count(*) AS relevant_count FROM orders GROUP BY 1), top AS (SELECT id, c_name, relevant_count, CASE WHEN c_nationkey % 2 = 0 THEN 'TX' ELSE 'NY' END AS st FROM n JOIN customer ON c_custkey = id ORDER BY relevant_count DESC, c_name LIMIT 50),
a AS (SELECT l_suppkey AS id, l_shipdate, ['tx', 'New York', ''][l_linenumber % 3 + 1] AS s, CASE WHEN l_quantity > 45 THEN 'Reno' ELSE ' austin' END AS city, ['DETERMINISTIC', 'HIGH_CONFIDENCE_AUTO', 'MANUAL_OVERRIDE', 'UNRESOLVED'][l_suppkey % 4 + 1] AS status, l_quantity AS q, l_discount AS score, l_returnflag AS source FROM lineitem),
j AS (SELECT top.*, a.*, CASE s WHEN 'tx' THEN 'TX' WHEN 'New York' THEN 'NY' ELSE '' END AS ast FROM top LEFT JOIN a USING (id)), k AS (SELECT *, coalesce(ast <> '' AND (ast <> st OR city = 'Reno'), FALSE) AS odd FROM j)
SELECT id AS legal_entity_id, c_name AS legal_name, relevant_count, string_agg(DISTINCT source, ' | ' ORDER BY source) AS source_ids, string_agg(DISTINCT status, ' | ' ORDER BY status) AS match_statuses, round(min(score), 6) AS minimum_match_score, count_if(odd)::BIGINT AS conflicts, CAST(coalesce(sum(CASE WHEN odd THEN q::BIGINT END), 0) AS BIGINT) AS conflict_rows,
 CASE WHEN count_if(odd) > 0 THEN 'LOCATION_CONFLICT_REVIEW_REQUIRED' WHEN max(status) = 'UNRESOLVED' THEN 'REVIEW_REQUIRED' WHEN max(status) = 'MANUAL_OVERRIDE' THEN 'REVIEWED_OVERRIDE_PRESENT' WHEN max(status) IS NULL THEN 'MIXED_OR_UNKNOWN' ELSE 'HIGH' END AS resolution_confidence,
 CASE WHEN count_if(odd) > 0 OR coalesce(max(status) = 'UNRESOLVED', FALSE) THEN 'YES' ELSE 'NO_EVIDENT_NEED' END AS human_override_required FROM k GROUP BY id, c_name, relevant_count""")
def do53(t: Tables) -> DataFrame:
    home = F.when(C("c_nationkey") % 2 == 0, "Texas").otherwise("NY")
    legal = t.customer.select(C("c_custkey").alias("legal_entity_id"), C("c_name").alias("legal_name"), home.alias("state"), L("Austin").alias("city"))
    activity = t.orders.groupBy(C("o_custkey").alias("legal_entity_id")).agg(F.count("*").alias("relevant_count")).join(legal.select("legal_entity_id", C("legal_name").alias("selection_name")), "legal_entity_id").withColumn("approval_count", L(0))
    pick = lambda values, k: F.element_at(F.array(*(L(v) for v in values)), k.cast("int") + 1)
    aliases = t.lineitem.select(
        C("l_suppkey").alias("legal_entity_id"), C("l_linestatus").alias("alias_raw"), C("l_returnflag").alias("source_id"), pick(("tx", "New York", ""), C("l_linenumber") % 3).alias("state"), F.when(C("l_quantity") > 45, "Reno").otherwise(" austin").alias("city"),
        pick(("DETERMINISTIC", "HIGH_CONFIDENCE_AUTO", "MANUAL_OVERRIDE", "UNRESOLVED"), C("l_suppkey") % 4).alias("match_status"), C("l_discount").alias("match_score"), C("l_quantity").cast("long").alias("occurrence_count"),
    )
    out = R.entity_audit(activity, legal, aliases, 50)
    return out.select("legal_entity_id", "legal_name", "relevant_count", "source_ids", "match_statuses", "minimum_match_score", "conflicts", "conflict_rows", "resolution_confidence", "human_override_required")
