"""Domain operators: program metrics, scores, supersession, histories, gates, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.semantics import any0, average_rank_share, known, top_by
from docketry.operators.metrics import program_metrics, top_family, with_parent_rollups, yearly_counts
from docketry.operators.scoring import score_organizations
from docketry.plans.local import ENTITIES, FIRST, SECOND, Tables, entities, first_cases, query, second_cases

def _tech():
    return F.col("technical_role")


def _rollup(cases: str) -> str:
    return f"""keyed AS (
  SELECT 'LEGAL_ENTITY' AS identity_scope, legal_entity_id AS organization_id, c.* FROM {cases} c WHERE legal_entity_id IS NOT NULL
  UNION ALL SELECT 'PARENT_ROLLUP', parent_id, c.* FROM {cases} c WHERE parent_id IS NOT NULL)"""


def _flags(half: str) -> str:
    return f"""flagged AS (
  SELECT *, coalesce(technical, FALSE) AND status = 'CERTIFIED' AS f, coalesce(technical, FALSE) AND status = '{half}' AS h FROM keyed)"""


def _metrics(p: str) -> str:
    return f"""SELECT identity_scope, organization_id, count(*) AS {p}_case_count, count_if(f) AS {p}_full_count, count_if(h) AS {p}_half_count,
  CAST(sum(CASE WHEN f THEN 1.0 WHEN h THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS weighted_{p}_count,
  count(DISTINCT CASE WHEN f OR h THEN fiscal_year END) AS {p}_active_years,
  count(DISTINCT CASE WHEN (f OR h) AND NOT is_partial_period THEN fiscal_year END) AS {p}_complete_active_years,
  max(CASE WHEN f OR h THEN fiscal_year END) AS last_{p}_year,
  max(CASE WHEN NOT is_partial_period THEN fiscal_year END) AS {p}_latest_complete_year,
  max(CASE WHEN is_partial_period THEN fiscal_year END) AS {p}_partial_year,
  coalesce(bool_or(is_partial_period), FALSE) AS {p}_has_partial_period,
  count(DISTINCT CASE WHEN f OR h THEN role_family END) AS {p}_family_count,
  coalesce(string_agg(DISTINCT CASE WHEN f OR h THEN role_family END, '|' ORDER BY CASE WHEN f OR h THEN role_family END), '') AS {p}_families
FROM flagged GROUP BY 1, 2"""


_DO20 = f"WITH {ENTITIES}, {FIRST}, {_rollup('first_cases')}, {_flags('CERTIFIED-WITHDRAWN')} "
_DO20B = f"WITH {ENTITIES}, {SECOND}, {_rollup('second_cases')}, {_flags('CERTIFIED-EXPIRED')} "


@query("do19_parent_rollup", f"WITH {ENTITIES}, {FIRST}, {_rollup('first_cases')} SELECT identity_scope, organization_id, count(*) AS n, round(sum(wage), 2) AS wages FROM keyed GROUP BY 1, 2")
def do19(t: Tables) -> DataFrame:
    return with_parent_rollups(first_cases(t)).groupBy("identity_scope", "organization_id").agg(F.count("*").alias("n"), F.round(F.sum("wage"), 2).alias("wages"))


@query("do20_program_metrics", _DO20 + _metrics("first"))
def do20(t: Tables) -> DataFrame:
    return program_metrics(first_cases(t), "first", "CERTIFIED", "CERTIFIED-WITHDRAWN", _tech())


@query("do20_second_program_metrics", _DO20B + _metrics("second"))
def do20b(t: Tables) -> DataFrame:
    return program_metrics(second_cases(t), "second", "CERTIFIED", "CERTIFIED-EXPIRED", _tech())


@query("do20_yearly_counts", _DO20 + """SELECT identity_scope, organization_id, fiscal_year, count(*) AS case_count, count_if(f) AS certified_count, count_if(h) AS half_count,
  CAST(sum(CASE WHEN f THEN 1.0 WHEN h THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS weighted_count, bool_or(is_partial_period) AS is_partial_period FROM flagged GROUP BY 1, 2, 3""")  # fmt: skip
def do20c(t: Tables) -> DataFrame:
    return yearly_counts(first_cases(t), "CERTIFIED", "CERTIFIED-WITHDRAWN", _tech())


@query("ag10_top_family", _DO20 + """, sums AS (SELECT identity_scope, organization_id, role_family, CAST(sum(CASE WHEN f THEN 1.0 ELSE 0.5 END) AS DOUBLE) AS family_weight FROM flagged WHERE f OR h GROUP BY 1, 2, 3)
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY identity_scope, organization_id ORDER BY family_weight DESC, role_family) AS rn FROM sums) WHERE rn = 1""")  # fmt: skip
def ag10(t: Tables) -> DataFrame:
    return top_family(first_cases(t), "CERTIFIED", "CERTIFIED-WITHDRAWN", _tech())


_YEARLY = """SELECT user_id AS legal_entity_id, CAST(year(ts) AS INT) AS year, count_if(event_type = 'purchase') AS initial_approvals, count_if(event_type = 'error') AS initial_denials,
  count(*) AS n FROM events GROUP BY 1, 2"""


@query("do21_employer_year_metrics", _YEARLY)
def do21(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.groupBy(F.col("user_id").alias("legal_entity_id"), F.year("ts").alias("year")).agg(F.count_if(kind == "purchase").alias("initial_approvals"), F.count_if(kind == "error").alias("initial_denials"), F.count("*").alias("n"))


_DIMENSION = f"""WITH {ENTITIES}
SELECT 'LEGAL_ENTITY' AS identity_scope, legal_entity_id AS organization_id, legal_name AS name, CAST(1 AS BIGINT) AS legal_entity_count, parent_id IS NOT NULL AS has_parent FROM entities
UNION ALL SELECT 'PARENT_ROLLUP', parent_id, max(state), count(*), FALSE FROM entities WHERE parent_id IS NOT NULL GROUP BY parent_id"""


def organization_dimension(legal: DataFrame) -> DataFrame:
    """Legal entities and, over them, the parents that any of them names."""
    one = legal.select(F.lit("LEGAL_ENTITY").alias("identity_scope"), F.col("legal_entity_id").alias("organization_id"), F.col("legal_name").alias("name"), F.lit(1).cast("long").alias("legal_entity_count"), F.col("parent_id").isNotNull().alias("has_parent"))
    many = legal.where("parent_id is not null").groupBy("parent_id").agg(F.max("state").alias("name"), F.count("*").alias("legal_entity_count"))
    return one.unionByName(many.select(F.lit("PARENT_ROLLUP").alias("identity_scope"), F.col("parent_id").alias("organization_id"), "name", "legal_entity_count", F.lit(False).alias("has_parent")))


@query("do22_organization_dimension", _DIMENSION)
def do22(t: Tables) -> DataFrame:
    return organization_dimension(entities(t))


_ALIASES = f"""WITH {ENTITIES}, aliases AS (SELECT s_suppkey AS alias_id, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'REVIEW_REQUIRED' ELSE 'DETERMINISTIC' END AS match_status,
   CASE WHEN s_suppkey % 2 = 0 THEN 'first' ELSE 'second' END AS program, s_suppkey % 50 + 1 AS candidate FROM supplier),
 hit AS (SELECT candidate, program, parent_id FROM aliases JOIN entities ON candidate = legal_entity_id WHERE match_status = 'REVIEW_REQUIRED'),
 keyed AS (SELECT candidate AS organization_id, program FROM hit UNION ALL SELECT parent_id, program FROM hit WHERE parent_id IS NOT NULL)
SELECT organization_id, bool_or(program = 'first') AS has_first, bool_or(program = 'second') AS has_second FROM keyed GROUP BY 1"""


@query("do23_unresolved_flags", _ALIASES)
def do23(t: Tables) -> DataFrame:
    s = F.col("s_suppkey")
    aliases = t.supplier.select((s % 50 + 1).alias("legal_entity_id"), F.when(s % 2 == 0, "first").otherwise("second").alias("program"), (s % 3 == 0).alias("review")).where("review")
    hit = with_parent_rollups(aliases.join(entities(t).select("legal_entity_id", "parent_id"), "legal_entity_id"))
    return hit.groupBy("organization_id").agg(any0(F.col("program") == "first").alias("has_first"), any0(F.col("program") == "second").alias("has_second"))


def employer_metrics(t: Tables) -> DataFrame:
    """The dimension with both programs' metrics, approvals and coverage states."""
    keys = ["identity_scope", "organization_id"]
    one = program_metrics(first_cases(t), "first", "CERTIFIED", "CERTIFIED-WITHDRAWN", _tech())
    two = program_metrics(second_cases(t), "second", "CERTIFIED", "CERTIFIED-EXPIRED", _tech())
    approvals = t.events.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("organization_id")).agg(F.count("*").alias("approvals")).withColumn("identity_scope", F.lit("LEGAL_ENTITY"))
    # whole-table scalars as one broadcast row
    span = first_cases(t).agg(F.max(F.when(~F.col("is_partial_period"), F.col("fiscal_year"))).alias("latest_complete_year"), F.max(F.when(F.col("is_partial_period"), F.col("fiscal_year"))).alias("partial_year"), F.countDistinct(F.when(~F.col("is_partial_period"), F.col("fiscal_year"))).alias("first_complete_years"))
    span2 = second_cases(t).agg(F.countDistinct(F.when(~F.col("is_partial_period"), F.col("fiscal_year"))).alias("second_complete_years"))
    wide = organization_dimension(entities(t)).join(one, keys, "left").join(two, keys, "left").join(approvals, keys, "left").crossJoin(F.broadcast(span)).crossJoin(F.broadcast(span2))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("first_case_count", "second_case_count", "first_family_count", "second_family_count", "first_complete_active_years", "second_complete_active_years", "approvals")}
    wide = wide.withColumns(zero | {c: F.coalesce(c, F.lit(0.0)) for c in ("weighted_first_count", "weighted_second_count")})
    state = F.when((F.col("first_case_count") > 0) & (F.col("second_case_count") > 0), "COMPLETE").when((F.col("first_case_count") > 0) | (F.col("second_case_count") > 0), "PARTIAL").otherwise("NO_EVIDENCE")
    return wide.withColumn("coverage_state", state)


_EMPLOYER = f"""{ENTITIES}, {FIRST}, {SECOND},
 dim AS ({_DIMENSION.split(ENTITIES)[1]}),
 k1 AS (SELECT 'LEGAL_ENTITY' AS identity_scope, legal_entity_id AS organization_id, c.* FROM first_cases c UNION ALL SELECT 'PARENT_ROLLUP', parent_id, c.* FROM first_cases c WHERE parent_id IS NOT NULL),
 k2 AS (SELECT 'LEGAL_ENTITY' AS identity_scope, legal_entity_id AS organization_id, c.* FROM second_cases c UNION ALL SELECT 'PARENT_ROLLUP', parent_id, c.* FROM second_cases c WHERE parent_id IS NOT NULL),
 f1 AS (SELECT *, coalesce(technical, FALSE) AND status = 'CERTIFIED' AS f, coalesce(technical, FALSE) AND status = 'CERTIFIED-WITHDRAWN' AS h FROM k1),
 f2 AS (SELECT *, coalesce(technical, FALSE) AND status = 'CERTIFIED' AS f, coalesce(technical, FALSE) AND status = 'CERTIFIED-EXPIRED' AS h FROM k2),
 m1 AS ({_metrics('first').replace('flagged', 'f1')}), m2 AS ({_metrics('second').replace('flagged', 'f2')}),
 ap AS (SELECT user_id AS organization_id, count(*) AS approvals, 'LEGAL_ENTITY' AS identity_scope FROM events WHERE event_type = 'purchase' GROUP BY 1),
 sp AS (SELECT max(CASE WHEN NOT is_partial_period THEN fiscal_year END) AS latest_complete_year, max(CASE WHEN is_partial_period THEN fiscal_year END) AS partial_year, count(DISTINCT CASE WHEN NOT is_partial_period THEN fiscal_year END) AS first_complete_years FROM first_cases),
 sp2 AS (SELECT count(DISTINCT CASE WHEN NOT is_partial_period THEN fiscal_year END) AS second_complete_years FROM second_cases),
 em AS (SELECT dim.identity_scope, dim.organization_id, dim.name, coalesce(first_case_count, 0) AS first_case_count, coalesce(second_case_count, 0) AS second_case_count,
   coalesce(weighted_first_count, 0.0) AS weighted_first_count, coalesce(weighted_second_count, 0.0) AS weighted_second_count, coalesce(approvals, 0) AS approvals,
   coalesce(first_complete_active_years, 0) AS first_complete_active_years, coalesce(second_complete_active_years, 0) AS second_complete_active_years,
   coalesce(first_family_count, 0) AS first_family_count, coalesce(second_family_count, 0) AS second_family_count, last_first_year, last_second_year, sp.*, sp2.*,
   CASE WHEN coalesce(first_case_count, 0) > 0 AND coalesce(second_case_count, 0) > 0 THEN 'COMPLETE' WHEN coalesce(first_case_count, 0) > 0 OR coalesce(second_case_count, 0) > 0 THEN 'PARTIAL' ELSE 'NO_EVIDENCE' END AS coverage_state
   FROM dim LEFT JOIN m1 USING (identity_scope, organization_id) LEFT JOIN m2 USING (identity_scope, organization_id) LEFT JOIN ap USING (identity_scope, organization_id) CROSS JOIN sp CROSS JOIN sp2)"""
_EM_COLS = ["identity_scope", "organization_id", "name", "first_case_count", "second_case_count", "weighted_first_count", "weighted_second_count", "approvals", "first_complete_active_years", "second_complete_active_years", "first_family_count", "second_family_count", "last_first_year", "last_second_year", "latest_complete_year", "partial_year", "first_complete_years", "second_complete_years", "coverage_state"]


@query("do24_employer_metrics", f"WITH {_EMPLOYER} SELECT {', '.join(_EM_COLS)} FROM em")
def do24(t: Tables) -> DataFrame:
    return employer_metrics(t).select(*_EM_COLS)


def _scored(t: Tables) -> DataFrame:
    # entities of one segment stand for those whose identity isn't resolved for the second program
    unresolved = entities(t).where("segment = 'MACHINERY'").select(F.col("legal_entity_id").alias("organization_id"), F.lit(True).alias("open"))
    em = employer_metrics(t).join(unresolved, "organization_id", "left")
    em = em.withColumns({"first_valid": F.lit(True), "second_valid": F.col("open").isNull(), "approvals_valid": F.col("identity_scope") == "LEGAL_ENTITY"})
    return score_organizations(em)


_SCORE_COLS = ["identity_scope", "organization_id", *(f"{x}_{y}" for x in ("first", "second", "overall") for y in ("score", "status", "rating", "stars", "label", "coverage"))]


def _cap(col: str, where: str) -> str:
    return f"(SELECT coalesce(round(max(v), 6), 0) FROM (SELECT CAST({col} AS DOUBLE) AS v, row_number() OVER (ORDER BY {col}) - 1 AS i, count(*) OVER () AS n FROM v0 WHERE {where} AND identity_scope = 'LEGAL_ENTITY') WHERE i = floor(0.95 * (n - 1) + 0.5))"


def _comp(x: str) -> str:
    return f"""(0.45 * least(100.0, greatest(0.0, ln(1 + weighted_{x}_count) / ln(1 + greatest({x}_cap, 1.0)) * 100))
   + 0.25 * CASE WHEN {x}_complete_years > 0 THEN CAST({x}_complete_active_years AS DOUBLE) / {x}_complete_years * 100 ELSE 0.0 END
   + 0.15 * CASE WHEN last_{x}_year IS NULL THEN 0.0 WHEN last_{x}_year = partial_year THEN 100.0 ELSE CASE greatest(latest_complete_year - last_{x}_year, 0) WHEN 0 THEN 100.0 WHEN 1 THEN 75.0 WHEN 2 THEN 50.0 WHEN 3 THEN 25.0 ELSE 0.0 END END
   + {'0.10' if x == 'first' else '0.15'} * least(100.0, CAST({x}_family_count AS DOUBLE) / 5 * 100))"""


def _rate(x: str) -> str:
    none = {"first": "No observed first-program history", "second": "No observed second-program history", "overall": "No observed history"}[x]
    r = f"CASE WHEN {x}_score >= 80 THEN 5 WHEN {x}_score >= 65 THEN 4 WHEN {x}_score >= 45 THEN 3 WHEN {x}_score >= 25 THEN 2 WHEN {x}_score >= 0.000000001 THEN 1 END"
    return f"""{x}_score, {x}_status, CAST({r} AS INT) AS {x}_rating, CASE {x}_status WHEN 'UNRATED' THEN 'Unrated' WHEN 'RATED' THEN repeat('★', {r}) || repeat('☆', 5 - ({r})) ELSE '{none}' END AS {x}_stars,
   CASE {x}_status WHEN 'UNRATED' THEN 'Unrated' WHEN 'RATED' THEN CAST({r} AS VARCHAR) || ' out of 5 stars' ELSE '{none}' END AS {x}_label, round(CASE WHEN {x}_status = 'UNRATED' THEN 0.0 ELSE {x}_cover END, 4) AS {x}_coverage"""


_DO31 = f"""WITH {_EMPLOYER},
 v0 AS (SELECT em.*, NOT coalesce(segment = 'MACHINERY', FALSE) AS ok2, em.identity_scope = 'LEGAL_ENTITY' AS has FROM em LEFT JOIN entities ON em.organization_id = legal_entity_id),
 v1 AS (SELECT *, {_cap('weighted_first_count', 'TRUE')} AS first_cap, {_cap('weighted_second_count', 'ok2')} AS second_cap, {_cap('approvals', 'has')} AS approvals_cap FROM v0),
 v2 AS (SELECT *, ({_comp('first')} + CASE WHEN has THEN 0.05 * least(100.0, greatest(0.0, ln(1 + CAST(approvals AS DOUBLE)) / ln(1 + greatest(approvals_cap, 1.0)) * 100)) ELSE 0.0 END) / CASE WHEN has THEN 1.0 ELSE 0.95 END AS s1, {_comp('second')} AS s2 FROM v1),
 v3 AS (SELECT *, CASE WHEN weighted_first_count > 0 THEN round(least(100.0, greatest(0.0, s1)), 2) ELSE 0.0 END AS first_score, CASE WHEN weighted_first_count > 0 THEN 'RATED' ELSE 'NO_OBSERVED_HISTORY' END AS first_status, CASE WHEN has THEN 1.0 ELSE 0.95 END AS first_cover,
   CASE WHEN NOT ok2 THEN NULL WHEN weighted_second_count > 0 THEN round(least(100.0, greatest(0.0, s2)), 2) ELSE 0.0 END AS second_score, CASE WHEN NOT ok2 THEN 'UNRATED' WHEN weighted_second_count > 0 THEN 'RATED' ELSE 'NO_OBSERVED_HISTORY' END AS second_status, 1.0 AS second_cover FROM v2),
 v4 AS (SELECT *, CASE WHEN second_status = 'UNRATED' THEN NULL WHEN first_score > 0 OR second_score > 0 THEN round(first_score * 0.4 + second_score * 0.6, 2) ELSE 0.0 END AS overall_score,
   CASE WHEN second_status = 'UNRATED' THEN 'UNRATED' WHEN first_score > 0 OR second_score > 0 THEN 'RATED' ELSE 'NO_OBSERVED_HISTORY' END AS overall_status, first_cover * 0.4 + (CASE WHEN second_status = 'UNRATED' THEN 0.0 ELSE 1.0 END) * 0.6 AS overall_cover FROM v3)
SELECT identity_scope, organization_id, {_rate('first')}, {_rate('second')}, {_rate('overall')} FROM v4"""


@query("do31_scores", _DO31)
def do31(t: Tables) -> DataFrame:
    return _scored(t).select(*_SCORE_COLS)


def entry(t: Tables) -> DataFrame:
    """Ten organisations of best overall score."""
    return _scored(t).orderBy(F.col("overall_score").desc_nulls_last(), "organization_id").limit(10).select("name", *_SCORE_COLS)


@query("ag31_status_distribution", f"SELECT overall_status, overall_rating, count(*) AS n FROM ({_DO31}) GROUP BY 1, 2")
def ag31(t: Tables) -> DataFrame:
    return _scored(t).groupBy("overall_status", "overall_rating").agg(F.count("*").alias("n"))


# --- supersession, latest, histories --------------------------------------------------------

@query("ag11_latest_per_key", "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role FROM conversations GROUP BY 1")
def ag11(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("ag12_unique_keep_last", "SELECT * EXCLUDE (rn) FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def ag12(t: Tables) -> DataFrame:
    return top_by(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("do41_history_merge", """WITH new AS (SELECT conv_id, role, turn FROM conversations WHERE turn >= 2), old AS (SELECT conv_id, role, turn FROM conversations WHERE turn < 2)
SELECT o.conv_id, o.role, o.turn, CASE WHEN n.first IS NULL THEN NULL ELSE n.first END AS valid_to, n.first IS NULL AS is_current FROM old o LEFT JOIN (SELECT conv_id, role, min(turn) AS first FROM new GROUP BY 1, 2) n ON o.conv_id = n.conv_id AND o.role = n.role
UNION ALL SELECT conv_id, role, turn, NULL, TRUE FROM new""")  # fmt: skip
def do41(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "role", "turn")
    new, old = rows.where("turn >= 2"), rows.where("turn < 2")
    first = new.groupBy("conv_id", "role").agg(F.min("turn").alias("valid_to"))
    closed = old.join(first, ["conv_id", "role"], "left").withColumn("is_current", F.col("valid_to").isNull())
    return closed.unionByName(new.withColumns({"valid_to": F.lit(None).cast("long"), "is_current": F.lit(True)}))


@query("do07_crosswalk", """SELECT s_suppkey, s_nationkey, c.n IS NOT NULL AND c.n > 0 AS matched, CASE WHEN c.n IS NULL THEN 'NEEDS_REVIEW' ELSE 'EXACT' END AS match_status FROM supplier LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON s_nationkey = c_nationkey""")
def do07(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return t.supplier.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "left").select("s_suppkey", "s_nationkey", known(F.col("n") > 0).alias("matched"), F.when(F.col("n").isNull(), "NEEDS_REVIEW").otherwise("EXACT").alias("match_status"))


_RANKED = "(rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER ()"


@query("wn01_average_rank_percentile", f"SELECT c_custkey, round({_RANKED.replace('v)', 'c_acctbal)')} * 100, 6) AS share FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE NOT c_acctbal > 0")
def wn01(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return average_rank_share(rows, "v", "share").select("c_custkey", F.round(F.col("share") * 100, 6).alias("share"))


@query("wn02_average_rank_null_as_zero", f"SELECT p_partkey, round({_RANKED}, 6) AS share FROM (SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_size END, 0) AS v FROM part)")
def wn02(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("v"))
    return average_rank_share(rows, "v", "share", null_as_zero=True).select("p_partkey", F.round("share", 6).alias("share"))


_RESEARCH = """WITH b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS a, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS e, s_acctbal AS z FROM supplier),
 pa AS (SELECT s_suppkey, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () * 100 AS p FROM b WHERE a IS NOT NULL),
 pe AS (SELECT s_suppkey, (rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0) / count(*) OVER () * 100 AS p FROM b WHERE e IS NOT NULL),
 pz AS (SELECT s_suppkey, (rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0) / count(*) OVER () * 100 AS p FROM b)
SELECT s_suppkey, round(coalesce(pa.p, pe.p, pz.p), 2) AS research_score, CASE WHEN pa.p IS NOT NULL THEN 'computing' WHEN pe.p IS NOT NULL THEN 'engineering' ELSE 'total' END AS basis
FROM b LEFT JOIN pa USING (s_suppkey) LEFT JOIN pe USING (s_suppkey) LEFT JOIN pz USING (s_suppkey)"""


@query("do32_research_scale", _RESEARCH)
def do32(t: Tables) -> DataFrame:
    s, v = F.col("s_suppkey"), F.col("s_acctbal")
    rows = t.supplier.select("s_suppkey", F.when(s % 3 == 0, v).alias("a"), F.when(s % 2 == 0, v).alias("e"), v.alias("z"))
    for c in "aez":
        rows = average_rank_share(rows, c, f"p{c}")
    basis = F.when(F.col("pa").isNotNull(), "computing").when(F.col("pe").isNotNull(), "engineering").otherwise("total")
    return rows.select("s_suppkey", F.round(F.coalesce("pa", "pe", "pz") * 100, 2).alias("research_score"), basis.alias("basis"))


# --- quality, audits --------------------------------------------------------------------------

@query("ag32_confusion_metrics", """WITH p AS (SELECT l.quality = 1 AS gold, n_chars >= 1000 AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT count_if(gold AND pred) AS tp, count_if(NOT gold AND pred) AS fp, count_if(gold AND NOT pred) AS fn, round(CASE WHEN count_if(pred) = 0 THEN 0.0 ELSE CAST(count_if(gold AND pred) AS DOUBLE) / count_if(pred) END, 6) AS precision_,
 round(CASE WHEN count_if(gold) = 0 THEN 0.0 ELSE CAST(count_if(gold AND pred) AS DOUBLE) / count_if(gold) END, 6) AS recall FROM p""")  # fmt: skip
def ag32(t: Tables) -> DataFrame:
    from docketry.operators.quality import confusion

    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("gold"), (F.col("n_chars") >= 1000).alias("pred"))
    return confusion(rows, "gold", "pred")


@query("jn07_reconciliation", """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 2000 GROUP BY 1)
SELECT count(*) AS keys, count_if(a.n IS DISTINCT FROM b.n) AS mismatches, count_if(b.k IS NULL) AS missing FROM a FULL OUTER JOIN b ON a.k = b.k""")  # fmt: skip
def jn07(t: Tables) -> DataFrame:
    from docketry.operators.quality import reconcile

    count = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return reconcile(count(t.orders), count(t.orders.where("o_totalprice > 2000")), ["k"], "n")
