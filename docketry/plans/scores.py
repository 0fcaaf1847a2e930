"""Queries of the sidecar scores."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from docketry.operators import evidence_scores as X
from docketry.operators.scoring import ScoreConfig
from docketry.plans.local import Tables, query

#: Customers as institutions with histories, research and enrolment; one text for Spark and DuckDB.
_BASE = """SELECT c_custkey AS organization_id, 'ipeds:' || c_custkey AS institution_id, CASE WHEN c_custkey % 12 <> 5 THEN c_custkey END AS ipeds_unitid, CASE WHEN c_custkey % 9 <> 4 THEN 'ACTIVE' ELSE 'INACTIVE_OR_UNKNOWN' END AS active_status,
 CASE WHEN c_custkey % 13 <> 6 THEN c_custkey END AS legal_entity_id, c_custkey % 7 AS lca_case_count, least(c_custkey % 5, c_custkey % 7) AS relevant_lca_count, c_custkey % 6 + 1 AS lca_active_years,
 CASE WHEN c_custkey % 7 > 0 THEN 2020 + c_custkey % 8 END AS last_lca_activity_year, c_custkey % 4 AS uscis_employer_year_rows, c_custkey % 3 + 1 AS uscis_active_years, CASE WHEN c_custkey % 4 > 0 THEN 2019 + c_custkey % 6 END AS last_uscis_activity_year,
 (c_custkey % 4) * (c_custkey % 11) * 5 AS initial_approvals, c_custkey % 9 AS initial_denials, c_custkey % 5 * 3 AS perm_case_count, (c_custkey % 5) * (c_custkey % 4) AS relevant_certified_perm_count, c_custkey % 7 AS perm_active_years,
 CASE WHEN c_custkey % 5 > 0 THEN 2021 + c_custkey % 5 END AS last_perm_activity_year, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 3 END AS top_perm_technical_title_count,
 CASE c_custkey % 3 WHEN 0 THEN 'CONFIRMED_ACTIVE' WHEN 1 THEN 'CONFIRMED_INACTIVE' ELSE 'NO_MATCH' END AS everify_status, CASE WHEN c_custkey % 2 = 0 THEN 'OBSERVED_POSITIVE' ELSE 'UNKNOWN' END AS known_opt_observation,
 c_acctbal AS total_rd, c_custkey % 6 <> 0 AS has_total_rd_data, c_nationkey AS computing_rd, c_custkey % 4 <> 1 AS has_computing_rd_data, c_custkey % 101 AS engineering_rd, c_custkey % 5 <> 2 AS has_engineering_rd_data,
 c_custkey % 17 AS federal_rd, c_custkey % 10 <> 3 AS has_federal_rd_data FROM {customer}"""

#: Orders as facts on their customers.
_KINDS = list(X.EvidenceConfig().policy_values)
_FACTS = f"""SELECT 'ipeds:' || o_custkey AS institution_id, CASE o_orderkey % {len(_KINDS)} {' '.join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(_KINDS))} END AS fact_type, CASE o_orderkey % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'LIMITED' WHEN 2 THEN 'NO' ELSE 'NOT_STATED' END AS fact_value,
 CASE o_orderkey % 5 WHEN 0 THEN 'REVIEWED_NOT_STATED' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'REVIEWED_REJECTED' ELSE 'REVIEWED_ACCEPTED' END AS human_review_status, o_orderkey % 6 <> 0 AS exact_excerpt_verified, o_orderkey % 13 <> 0 AS is_current,
 CASE WHEN o_orderkey % 17 = 0 THEN '2024' END AS valid_to, CASE WHEN o_orderkey % 19 = 0 THEN 'http://x' ELSE 'https://x' END AS source_url, lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '0') AS valid_from FROM {{orders}}"""


def _base(t: Tables) -> DataFrame:
    return t.spark.sql(_BASE, customer=t.customer)


def _facts(t: Tables) -> DataFrame:
    return t.spark.sql(_FACTS, orders=t.orders)


# --- the same formulas as SQL text --------------------------------------------------------

_CONFIG = X.EvidenceConfig()


def _d(x: float) -> str:
    return f"{x}::DOUBLE"


def _mean_sql(parts: dict[str, str], weights, eligible: str) -> tuple[str, str]:
    seen = " + ".join(f"CASE WHEN {parts[k]} IS NULL THEN 0::DOUBLE ELSE {_d(w)} END" for k, w in weights.items())
    value = " + ".join(f"coalesce({parts[k]} * {_d(w)}, 0::DOUBLE)" for k, w in weights.items())
    return f"CASE WHEN ({eligible}) AND ({seen}) > 0 THEN round(least(100::DOUBLE, greatest(0::DOUBLE, ({value}) / ({seen}))), 2) END", f"round(least(1::DOUBLE, ({seen}) / {_d(sum(weights.values()))}), 4)"


def _band_sql(value: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {m} THEN '{label}'" for label, m in bands) + " ELSE 'UNKNOWN' END"


def _upto(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(100::DOUBLE, greatest(0::DOUBLE, {x})) END"


def _log_sql(c: str, cap: int, seen: str) -> str:
    return f"CASE WHEN {seen} THEN least(100::DOUBLE, ln(1 + {c}::DOUBLE) / ln({1 + cap}::DOUBLE) * 100) END"


def _recent_sql(last: str) -> str:
    return _upto(f"(100 - greatest(2026 - {last}, 0) * 25)::DOUBLE")


def _when(c: str, x: str) -> str:
    return f"CASE WHEN {c} THEN {x} END"


_LCA, _PET, _PERM = "lca_case_count > 0", "uscis_employer_year_rows > 0", "perm_case_count > 0"
_H1B = _mean_sql(
    {
        "relevant_lca_volume": _log_sql("relevant_lca_count", 1000, _LCA),
        "initial_approvals": _log_sql("initial_approvals", 500, _PET),
        "active_years": _upto(f"greatest({_when(_LCA, 'lca_active_years')}, {_when(_PET, 'uscis_active_years')}) / 5::DOUBLE * 100"),
        "recency": _when("coalesce(last_lca_activity_year, last_uscis_activity_year) IS NOT NULL", _recent_sql("greatest(last_lca_activity_year, last_uscis_activity_year)")),
        "technical_share": _when(_LCA, _upto("relevant_lca_count::DOUBLE / lca_case_count * 100")),
        "approval_ratio": _when(f"{_PET} AND initial_approvals + initial_denials >= 10", _upto("initial_approvals::DOUBLE / (initial_approvals + initial_denials) * 100")),
    },
    _CONFIG.weights["h1b_history"], f"{_LCA} OR {_PET}",
)
_GREEN = _mean_sql(
    {
        "relevant_perm_volume": _log_sql("relevant_certified_perm_count", 500, _PERM),
        "active_years": _when(_PERM, _upto("perm_active_years / 5::DOUBLE * 100")),
        "recency": _when("last_perm_activity_year IS NOT NULL", _recent_sql("last_perm_activity_year")),
        "technical_share": _when(_PERM, _upto("relevant_certified_perm_count::DOUBLE / perm_case_count * 100")),
        "exact_title_repetition": _when("relevant_certified_perm_count > 0", _upto("top_perm_technical_title_count::DOUBLE / relevant_certified_perm_count * 100")),
    },
    _CONFIG.weights["green_card_history"], _PERM,
)
_STEM = "CASE WHEN everify_status = 'CONFIRMED_INACTIVE' THEN 0 WHEN everify_status = 'CONFIRMED_ACTIVE' THEN CASE WHEN known_opt_observation = 'OBSERVED_POSITIVE' THEN 100 ELSE 85 END WHEN known_opt_observation = 'OBSERVED_POSITIVE' THEN 55 END::DOUBLE"
_STEM_COVER = "round(CASE WHEN everify_status <> 'NO_MATCH' THEN 0.7 ELSE 0 END::DOUBLE + CASE WHEN known_opt_observation = 'OBSERVED_POSITIVE' THEN 0.3 ELSE 0 END::DOUBLE, 4)"
_RD = list(_CONFIG.weights["research_strength"])
_PCT = ", ".join(f"CASE WHEN has_{c}_data THEN round((rank() OVER (PARTITION BY has_{c}_data ORDER BY {c}) + (count(*) OVER (PARTITION BY has_{c}_data, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY has_{c}_data) * 100, 2) END AS {c}_p" for c in _RD)
_RESEARCH = _mean_sql({c: f"{c}_p" for c in _RD}, _CONFIG.weights["research_strength"], "has_total_rd_data")
_VALUE = "CASE " + " ".join(f"WHEN fact_type = '{k}' AND fact_value = '{v}' THEN {s}" for k, vs in _CONFIG.policy_values.items() for v, s in vs.items()) + " END::DOUBLE"
_WEIGHT = "CASE fact_type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in _CONFIG.weights["policy_support"].items()) + " END::DOUBLE"
_CORE = ", ".join(f"'{k}'" for k in _CONFIG.core_policy)
_PARTS = f"""WITH base AS ({_BASE.format(customer="customer")}), facts AS ({_FACTS.format(orders="orders")}),
h AS (SELECT *, {_H1B[0]} AS h1b, {_H1B[1]} AS h1b_c, {_GREEN[0]} AS green, {_GREEN[1]} AS green_c, {_STEM} AS stem, {_STEM_COVER} AS stem_c, {_PCT} FROM base),
r AS (SELECT *, {_RESEARCH[0]} AS research, {_RESEARCH[1]} AS research_c FROM h),
l AS (SELECT institution_id, fact_type, arg_max(fact_value, valid_from) AS fact_value FROM facts WHERE human_review_status = 'REVIEWED_ACCEPTED' AND exact_excerpt_verified AND is_current AND valid_to IS NULL AND starts_with(source_url, 'https://') GROUP BY 1, 2),
v AS (SELECT institution_id, {_WEIGHT} AS w, {_VALUE} AS s FROM l WHERE fact_value <> 'NOT_STATED'), pol AS (SELECT institution_id, round(sum(w * s) / sum(w), 2) AS policy, round(sum(w), 4) AS policy_c, count(*)::INT AS policy_n FROM v GROUP BY 1),
f AS (SELECT *, human_review_status = 'REVIEWED_ACCEPTED' AND fact_value <> 'NOT_STATED' AND exact_excerpt_verified AND starts_with(source_url, 'https://') AS ev, human_review_status = 'REVIEWED_NOT_STATED' AND fact_value = 'NOT_STATED' AND starts_with(source_url, 'https://') AS ns
 FROM facts WHERE fact_type IN ({_CORE}) AND is_current AND valid_to IS NULL), g AS (SELECT institution_id, fact_type, bool_or(ev) AS ev, bool_or(ev OR ns) AS seen, bool_or(ev AND fact_type = 'pr_research_staff_eligible' AND fact_value = 'NO') AS stop,
 CASE WHEN bool_or(ev) THEN 'REVIEWED_EVIDENCE' WHEN bool_or(ns) THEN 'REVIEWED_NOT_STATED' WHEN bool_or(human_review_status = 'NEEDS_REVIEW') THEN 'REVIEW_PENDING' WHEN bool_or(human_review_status = 'REVIEWED_REJECTED') THEN 'REVIEWED_REJECTED' ELSE 'UNKNOWN' END AS state FROM f GROUP BY 1, 2),
core AS (SELECT institution_id, count_if(ev) AS n_ev, count_if(seen) AS n_seen, bool_or(stop) AS stop, max(CASE WHEN fact_type = 'perm_supported' THEN state END) AS perm_state FROM g GROUP BY 1),
x AS (SELECT r.*, policy, coalesce(policy_c, 0) AS policy_c, coalesce(policy_n, 0) AS policy_n, coalesce(n_ev, 0)::INT AS n_ev, coalesce(n_seen, 0)::INT AS n_seen, coalesce(stop, FALSE) AS stop, coalesce(perm_state, 'UNKNOWN') AS perm_state FROM r LEFT JOIN pol USING (institution_id) LEFT JOIN core USING (institution_id))"""


def _sure_sql(parts: dict[str, str], weights) -> str:
    return "least(1::DOUBLE, " + " + ".join(f"coalesce({parts[k]}, 0) * {_d(w)}" for k, w in weights.items()) + ")"


_W = _CONFIG.weights
_IMM = _mean_sql({"stem_opt_readiness": "stem", "h1b_history": "h1b", "green_card_history": "green"}, _W["immigration_evidence"], "stem IS NOT NULL AND h1b IS NOT NULL AND green IS NOT NULL")[0]
_IMM_C = f"round({_sure_sql({'stem_opt_readiness': 'stem_c', 'h1b_history': 'h1b_c', 'green_card_history': 'green_c'}, _W['immigration_evidence'])}, 4)"
_PATH1 = _mean_sql({"immigration_evidence": "imm", "research_strength": "research", "policy_support": "policy"}, _W["research_pathway_first"], "imm IS NOT NULL AND research IS NOT NULL AND policy IS NOT NULL")[0]
_PATH1_C = f"round({_sure_sql({'immigration_evidence': 'imm_c', 'research_strength': 'research_c', 'policy_support': 'policy_c'}, _W['research_pathway_first'])}, 4)"
_GRADE = lambda x: _band_sql(x, _CONFIG.grade_bands)


@query("do33_first_formula", f"""{_PARTS}, y AS (SELECT *, {_IMM} AS imm, {_IMM_C} AS imm_c FROM x), z AS (SELECT *, {_PATH1} AS path, {_PATH1_C} AS path_c FROM y)
SELECT organization_id, stem AS stem_opt_readiness_score, CASE WHEN everify_status = 'CONFIRMED_INACTIVE' THEN 'EXPLICIT_BLOCKER' ELSE {_band_sql("stem", _CONFIG.status_bands)} END AS stem_opt_readiness_status, h1b AS h1b_history_score, h1b_c AS h1b_history_coverage, {_GRADE("h1b")} AS h1b_history_grade,
 green AS green_card_history_score, green_c AS green_card_history_coverage, imm AS immigration_evidence_score, imm_c AS immigration_evidence_coverage, {_band_sql("imm_c", _CONFIG.confidence_bands)} AS evidence_confidence, research AS research_strength_score, research_c AS research_strength_coverage,
 policy AS policy_support_score, policy_c AS policy_support_coverage, policy_n AS policy_support_fact_count, path AS research_pathway_score, path_c AS research_pathway_coverage, {_GRADE("path")} AS research_pathway_grade FROM z""")
def do33(t: Tables) -> DataFrame:
    out = X.score_institutions_first(_base(t), _facts(t), replace(_CONFIG, version="evidence_scores_v1_2026_08"))
    return out.select(
        "organization_id", "stem_opt_readiness_score", "stem_opt_readiness_status", "h1b_history_score", "h1b_history_coverage", "h1b_history_grade", "green_card_history_score", "green_card_history_coverage", "immigration_evidence_score",
        "immigration_evidence_coverage", "evidence_confidence", "research_strength_score", "research_strength_coverage", "policy_support_score", "policy_support_coverage", "policy_support_fact_count", "research_pathway_score",
        "research_pathway_coverage", "research_pathway_grade",
    )


_SPON = _mean_sql({"h1b_history": "h1b", "green_card_history": "green"}, _W["sponsorship_history"], "h1b IS NOT NULL OR green IS NOT NULL")
_SPON_S = f"round({_sure_sql({'h1b_history': 'h1b_c', 'green_card_history': 'green_c'}, _W['sponsorship_history'])}, 4)"
_PATH2 = _mean_sql({"sponsorship_history": "spon", "policy_support": "policy", "research_strength": "research"}, _W["research_pathway"], "spon IS NOT NULL OR policy IS NOT NULL OR research IS NOT NULL")[0]
_PATH2_S = _sure_sql({"sponsorship_history": "spon_s", "policy_support": "policy_c", "research_strength": "research_c"}, _W["research_pathway"])
_STATE = lambda s, c, gate, word: f"CASE WHEN {s} IS NULL THEN 'UNKNOWN' WHEN {c} >= {gate} THEN '{word}' ELSE 'PARTIAL' END"
_BOTH = "h1b_s = 'COMPLETE' AND green_s = 'COMPLETE'"


@query("do34_second_formula", f"""{_PARTS}, y AS (SELECT *, {_STATE("h1b", "h1b_c", 1, "COMPLETE")} AS h1b_s, {_STATE("green", "green_c", 1, "COMPLETE")} AS green_s, {_SPON[0]} AS spon, {_SPON[1]} AS spon_c, {_SPON_S} AS spon_s FROM x),
z AS (SELECT *, CASE WHEN h1b IS NULL AND green IS NULL THEN 'UNKNOWN' WHEN {_BOTH} AND spon_c >= 1 THEN 'COMPLETE' ELSE 'PARTIAL' END AS spon_state, {_PATH2} AS evidence, {_PATH2_S} AS sure FROM y),
q AS (SELECT *, CASE WHEN stop THEN 'POLICY_BLOCKED' WHEN spon_state = 'COMPLETE' AND research_c >= 0.55 AND n_seen = 4 AND spon IS NOT NULL AND policy IS NOT NULL AND research IS NOT NULL AND sure >= 0.8::DOUBLE THEN 'COMPLETE' WHEN evidence IS NOT NULL THEN 'INCOMPLETE_EVIDENCE' ELSE 'UNKNOWN' END AS path_state FROM z)
SELECT organization_id, h1b_s AS h1b_history_status, CASE WHEN h1b IS NOT NULL AND h1b_c >= 1 THEN {_GRADE("h1b")} END AS h1b_history_grade, green_s AS green_card_history_status, spon AS sponsorship_history_score, spon_c AS sponsorship_history_coverage, spon_s AS sponsorship_history_confidence,
 spon_state AS sponsorship_history_status, CASE WHEN spon_state = 'COMPLETE' THEN {_GRADE("spon")} END AS sponsorship_history_grade, {_band_sql("spon_s", _CONFIG.confidence_bands)} AS evidence_confidence, {_STATE("research", "research_c", 0.55, "SUFFICIENT_COVERAGE")} AS research_strength_status,
 {_STATE("policy", "policy_c", "0.6::DOUBLE", "SUFFICIENT_COVERAGE")} AS policy_support_status, CASE WHEN policy_c >= 0.6::DOUBLE THEN {_GRADE("policy")} END AS policy_support_grade, n_seen AS core_policy_reviewed_count, n_ev AS core_policy_evidence_count,
 CASE WHEN n_seen = 4 THEN 'COMPLETE_REVIEW' WHEN n_seen > 0 THEN 'PARTIAL_REVIEW' ELSE 'NOT_REVIEWED' END AS core_policy_profile_status, perm_state AS perm_supported_review_state, CASE WHEN NOT stop THEN evidence END AS research_pathway_score, round(sure, 4) AS research_pathway_coverage, path_state AS research_pathway_status,
 CASE WHEN path_state = 'COMPLETE' THEN {_GRADE("evidence")} END AS research_pathway_grade, CASE WHEN {_BOTH} AND n_seen = 4 AND ipeds_unitid IS NOT NULL AND active_status = 'ACTIVE' AND legal_entity_id IS NOT NULL THEN 'TIER_1_REVIEWED' WHEN {_BOTH} AND n_seen < 4 THEN 'TIER_2_STRONG_HISTORY_POLICY_INCOMPLETE'
 WHEN (h1b IS NOT NULL OR green IS NOT NULL) AND NOT ({_BOTH}) THEN 'TIER_3_PARTIAL_HISTORY' ELSE 'TIER_4_INSUFFICIENT_EVIDENCE' END AS decision_readiness_tier FROM q""")
def do34(t: Tables) -> DataFrame:
    out = X.score_institutions_second(_base(t), _facts(t), _CONFIG)
    return out.select(
        "organization_id", "h1b_history_status", "h1b_history_grade", "green_card_history_status", "sponsorship_history_score", "sponsorship_history_coverage", "sponsorship_history_confidence", "sponsorship_history_status",
        "sponsorship_history_grade", "evidence_confidence", "research_strength_status", "policy_support_status", "policy_support_grade", "core_policy_reviewed_count", "core_policy_evidence_count", "core_policy_profile_status",
        "perm_supported_review_state", "research_pathway_score", "research_pathway_coverage", "research_pathway_status", "research_pathway_grade", "decision_readiness_tier",
    )


def _accepted(make) -> bool:
    try:
        make()
    except ValueError:
        return False
    return True


@query("do35_config_checks", """SELECT * FROM (VALUES ('default', TRUE), ('history weights', FALSE), ('negative weight', FALSE), ('fact without values', FALSE), ('equal bands', FALSE), ('unknown core fact', FALSE), ('active default', TRUE), ('active weights', FALSE), ('active keys', FALSE), ('active bands', FALSE)) v(config, accepted)""")
def do35(t: Tables) -> DataFrame:
    w, h = _CONFIG.weights, ScoreConfig().first
    tries = {
        "default": X.EvidenceConfig,
        "history weights": lambda: X.EvidenceConfig(weights={**w, "h1b_history": {**w["h1b_history"], "recency": 0.16}}),
        "negative weight": lambda: X.EvidenceConfig(weights={**w, "sponsorship_history": {"h1b_history": -0.4, "green_card_history": 1.4}}),
        "fact without values": lambda: X.EvidenceConfig(policy_values={k: v for k, v in _CONFIG.policy_values.items() if k != "perm_supported"}),
        "equal bands": lambda: X.EvidenceConfig(grade_bands=(("A", 80), ("B", 80))),
        "unknown core fact": lambda: X.EvidenceConfig(core_policy=("other",)),
        "active default": ScoreConfig,
        "active weights": lambda: ScoreConfig(overall={"first": 0.5, "second": 0.6}),
        "active keys": lambda: ScoreConfig(first={**{k: v for k, v in h.items() if k != "breadth"}, "width": h["breadth"]}),
        "active bands": lambda: ScoreConfig(bands=((5, 80), (4, 80), (3, 45), (2, 25), (1, 1))),
    }
    return t.spark.createDataFrame([(k, _accepted(f)) for k, f in tries.items()], "config string, accepted boolean")
