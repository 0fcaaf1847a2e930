"""Queries of the presentation views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import views as V
from docketry.plans.local import ENTITIES, FIRST, SECOND, Tables, first_cases, query, second_cases

C, L = F.col, F.lit


def _first(t: Tables) -> DataFrame:
    k = C("case_id")
    visa = F.when(k % 5 == 0, "E-3").when(k % 7 != 0, " h-1b ")
    more = {"visa_class": visa, "job_title_raw": F.concat(L("Engineer "), (k % 3).cast("string")), "soc_code": F.when(k % 4 != 0, "15-1252"), "soc_title": L(None).cast("string"), "classification_version": L("v1")}
    return first_cases(t).withColumnsRenamed({"legal_entity_id": "organization_id", "parent_id": "parent_organization_id"}).withColumns(more)


def _second(t: Tables) -> DataFrame:
    more = {"job_title_raw": C("state"), "soc_code": L("15-1252"), "soc_title": L("Developers"), "classification_version": L("v1")}
    return second_cases(t).withColumnsRenamed({"legal_entity_id": "organization_id", "parent_id": "parent_organization_id"}).withColumns(more)


def _petitions(t: Tables) -> DataFrame:
    u, kind = C("user_id"), C("event_type")
    return t.events.select(
        F.when(kind != "view", u).alias("organization_id"), F.when(u % 3 == 0, u % 25 + 1_000_000_000).alias("parent_organization_id"), (u % 8 + 1995).cast("int").alias("fiscal_year"), (kind == "purchase").cast("int").alias("initial_approvals"),
        (kind == "error").cast("int").alias("initial_denials"), F.when(kind == "click", 2).alias("continuing_approvals"), L(0).alias("continuing_denials"), F.when(u % 2 == 0, kind == "error").alias("is_partial_period"),
    )


_PETITIONS = """petitions AS (SELECT CASE WHEN event_type <> 'view' THEN user_id END AS organization_id, CASE WHEN user_id % 3 = 0 THEN user_id % 25 + 1000000000 END AS parent_id, CAST(user_id % 8 + 1995 AS INT) AS fiscal_year,
 CAST(event_type = 'purchase' AS INT) AS a, CAST(event_type = 'error' AS INT) AS b, CASE WHEN event_type = 'click' THEN 2 END AS c, CASE WHEN user_id % 2 = 0 THEN event_type = 'error' END AS is_partial_period FROM events)"""
_VISA = "case_id % 5 <> 0 AND case_id % 7 <> 0"


def _scoped(name: str, of: str, entity: str = "legal_entity_id") -> str:
    return f"""{name} AS (SELECT 'LEGAL_ENTITY' AS identity_scope, {entity} AS id, x.* FROM {of} x WHERE {entity} IS NOT NULL UNION ALL SELECT 'PARENT_ROLLUP', parent_id, x.* FROM {of} x WHERE parent_id IS NOT NULL)"""


@query("do48_first_trends", f"""WITH {ENTITIES}, {FIRST}, {_PETITIONS}, {_scoped("s", "first_cases")}, {_scoped("p", "petitions", "organization_id")},
a AS (SELECT id, identity_scope, fiscal_year, count(*) AS n, count_if(technical IS TRUE AND {_VISA} AND status = 'CERTIFIED') AS f, count_if(technical IS TRUE AND {_VISA} AND status = 'CERTIFIED-WITHDRAWN') AS h, bool_or(is_partial_period) AS part FROM s GROUP BY 1, 2, 3),
b AS (SELECT id, identity_scope, fiscal_year, sum(a) AS a, sum(b) AS b, sum(c) AS c, bool_or(is_partial_period) AS part FROM p GROUP BY 1, 2, 3)
SELECT id AS organization_id, identity_scope, fiscal_year, coalesce(n, 0) AS lca_count, coalesce(f, 0) AS relevant_certified_lca_count, coalesce(h, 0) AS relevant_certified_withdrawn_lca_count, CAST(coalesce(f, 0) + 0.5 * coalesce(h, 0) AS DOUBLE) AS weighted_relevant_lca_count,
 CAST(coalesce(b.a, 0) AS BIGINT) AS initial_approvals, CAST(coalesce(b.b, 0) AS BIGINT) AS initial_denials, CAST(coalesce(b.c, 0) AS BIGINT) AS continuing_approvals, CAST(0 AS BIGINT) AS continuing_denials, coalesce(a.part, FALSE) OR coalesce(b.part, FALSE) AS is_partial_period, 'DERIVED_METRIC' AS evidence_class
FROM a FULL JOIN b USING (id, identity_scope, fiscal_year)""")
def do48_first(t: Tables) -> DataFrame:
    return V.first_trends(_first(t), _petitions(t)).withColumn("weighted_relevant_lca_count", C("weighted_relevant_lca_count").cast("double"))


@query("do48_second_trends", f"""WITH {ENTITIES}, {SECOND}, {_scoped("s", "second_cases")}
SELECT id AS organization_id, identity_scope, fiscal_year, count(*) AS perm_count, count_if(technical IS TRUE AND status = 'CERTIFIED') AS relevant_certified_perm_count, count_if(technical IS TRUE AND status = 'CERTIFIED-EXPIRED') AS relevant_certified_expired_perm_count,
 CAST(count_if(technical IS TRUE AND status = 'CERTIFIED') + 0.5 * count_if(technical IS TRUE AND status = 'CERTIFIED-EXPIRED') AS DOUBLE) AS weighted_relevant_perm_count, count_if(status = 'CERTIFIED') AS certified_count, count_if(status = 'CERTIFIED-EXPIRED') AS certified_expired_count,
 count_if(status LIKE 'DENIED%') AS denied_count, CAST(0 AS BIGINT) AS withdrawn_count, bool_or(is_partial_period) AS is_partial_period, 'DERIVED_METRIC' AS evidence_class FROM s GROUP BY 1, 2, 3""")
def do48_second(t: Tables) -> DataFrame:
    return V.second_trends(_second(t)).withColumn("weighted_relevant_perm_count", C("weighted_relevant_perm_count").cast("double"))


@query("do48_relevant_titles", f"""WITH {ENTITIES}, {FIRST}, {SECOND}, {_scoped("a", "first_cases")}, {_scoped("b", "second_cases")}
SELECT id AS organization_id, identity_scope, 'dol_lca' AS source_id, 'Engineer ' || case_id % 3 AS job_title_raw, CASE WHEN case_id % 4 <> 0 THEN '15-1252' END AS soc_code, CAST(NULL AS VARCHAR) AS soc_title, role_family, 'v1' AS classification_version, count(*) AS record_count, max(fiscal_year) AS last_activity_year, 'DERIVED_METRIC' AS evidence_class
FROM a WHERE technical AND {_VISA} AND status IN ('CERTIFIED', 'CERTIFIED-WITHDRAWN') GROUP BY ALL
UNION ALL SELECT id, identity_scope, 'dol_perm', state, '15-1252', 'Developers', role_family, 'v1', count(*), max(fiscal_year), 'DERIVED_METRIC' FROM b WHERE technical AND status IN ('CERTIFIED', 'CERTIFIED-EXPIRED') GROUP BY ALL""")
def do48_titles(t: Tables) -> DataFrame:
    return V.relevant_titles(_first(t), _second(t))


def _policy(t: Tables) -> dict[str, DataFrame]:
    k, n = C("c_custkey"), C("c_nationkey")
    review = F.element_at(F.array(L("REVIEWED_NOT_STATED"), L("REVIEWED_ACCEPTED"), L("NEEDS_REVIEW"), L("REVIEWED_REJECTED")), (k % 4 + 1).cast("int"))
    facts = t.customer.select(
        k.cast("string").alias("policy_fact_id"), (k % 10).cast("string").alias("policy_document_id"), F.when(n == 5, "-").otherwise((k % 10 % 3).cast("string")).alias("institution_id"), review.alias("human_review_status"),
        F.when(n != 3, n != 4).alias("exact_excerpt_verified"), (n != 6).alias("is_current"), F.when(n == 8, "2024").alias("valid_to"), F.when(n == 9, "http://x").otherwise("https://x").alias("source_url"),
    )
    documents = t.supplier.select(C("s_suppkey").cast("string").alias("policy_document_id"), (C("s_suppkey") % 3).cast("string").alias("institution_id"), C("s_name").alias("title"))
    institutions = t.region.where("r_regionkey <> 2").select(C("r_regionkey").cast("string").alias("institution_id"), C("r_regionkey").alias("organization_id"), C("r_name").alias("official_name"))
    return {"policy_facts": facts, "policy_documents": documents, "institution_metrics": institutions}


_POLICY = """e AS (SELECT c_custkey, CAST(c_custkey % 10 % 3 AS VARCHAR) AS institution_id, s_name AS document_title, r_name AS official_name, ['REVIEWED_NOT_STATED', 'REVIEWED_ACCEPTED', 'NEEDS_REVIEW', 'REVIEWED_REJECTED'][c_custkey % 4 + 1] AS review,
 c_nationkey NOT IN (3, 4, 6, 8, 9) AS sound, c_nationkey = 8 AS ended FROM customer JOIN supplier ON c_custkey % 10 = s_suppkey AND c_nationkey <> 5 LEFT JOIN region ON r_regionkey = c_custkey % 10 % 3 AND r_regionkey <> 2)"""


@query("do48_policy_evidence", f"""WITH {_POLICY} SELECT CAST(c_custkey AS VARCHAR) AS policy_fact_id, institution_id, document_title, official_name, CASE WHEN review = 'REVIEWED_NOT_STATED' AND sound THEN 'REVIEWED_OFFICIAL_POLICY_NOT_STATED' WHEN review = 'REVIEWED_ACCEPTED' THEN
 CASE WHEN sound THEN 'REVIEWED_OFFICIAL_POLICY' WHEN ended THEN 'REVIEWED_OFFICIAL_POLICY_HISTORICAL' ELSE 'REVIEWED_POLICY_INELIGIBLE' END ELSE 'MODEL_EXTRACTED_UNREVIEWED' END AS evidence_class FROM e""")
def do48_policy(t: Tables) -> DataFrame:
    p = _policy(t)
    more = {n: V.optional_table(t.spark, p, n) for n in ("policy_facts", "policy_documents")}
    return V.policy_evidence(more["policy_facts"], more["policy_documents"], p["institution_metrics"]).select("policy_fact_id", "institution_id", "document_title", "official_name", "evidence_class")


def _tables(t: Tables) -> dict[str, DataFrame]:
    """Every required table, and the optional ones but two."""
    k = C("s_suppkey")
    aliases = t.supplier.select(k.alias("alias_id"), F.when(k % 3 == 0, "REVIEW_REQUIRED").otherwise("DETERMINISTIC").alias("match_status"), F.when(k % 5 == 0, "REJECTED").alias("review_status"))
    everify = t.customer.select(C("c_custkey").cast("string").alias("lookup_id"), F.when(C("c_nationkey") == 1, "NEEDS_REVIEW").otherwise("NOT_REQUIRED").alias("review_status"))
    rest = {"employer_metrics": t.customer, "first_cases": _first(t), "second_cases": _second(t), "petitions": _petitions(t), "entity_aliases": aliases, "everify_observations": everify, "data_health": t.region, "source_artifacts": t.nation}
    return _policy(t) | rest


@query("do48_all_views", f"""WITH {ENTITIES}, {FIRST}, {SECOND}, {_PETITIONS}, {_POLICY}, {_scoped("a", "first_cases")}, {_scoped("b", "second_cases")}, {_scoped("p", "petitions", "organization_id")}
SELECT 'vw_employer_explorer' AS view, count(*) AS n FROM customer UNION ALL SELECT 'vw_institution_explorer', count(*) FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'vw_organization_detail', count(*) FROM customer
UNION ALL SELECT 'vw_h1b_trends', count(*) FROM (SELECT id, identity_scope, fiscal_year FROM a UNION SELECT id, identity_scope, fiscal_year FROM p) UNION ALL SELECT 'vw_perm_trends', count(*) FROM (SELECT DISTINCT id, identity_scope, fiscal_year FROM b)
UNION ALL SELECT 'vw_relevant_titles', (SELECT count(*) FROM (SELECT DISTINCT id, identity_scope, case_id % 3, case_id % 4 = 0, role_family FROM a WHERE technical AND {_VISA} AND status IN ('CERTIFIED', 'CERTIFIED-WITHDRAWN'))) + (SELECT count(*) FROM (SELECT DISTINCT id, identity_scope, state, role_family FROM b WHERE technical AND status IN ('CERTIFIED', 'CERTIFIED-EXPIRED')))
UNION ALL SELECT 'vw_policy_evidence', count(*) FROM e UNION ALL SELECT 'vw_everify_evidence', count(*) FROM customer UNION ALL SELECT 'vw_opt_evidence', 0 UNION ALL SELECT 'vw_entity_review_queue', count(*) FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0
UNION ALL SELECT 'vw_policy_review_queue', count(*) FROM e WHERE review = 'NEEDS_REVIEW' UNION ALL SELECT 'vw_everify_review_queue', count(*) FROM customer WHERE c_nationkey = 1 UNION ALL SELECT 'vw_data_health', count(*) FROM region UNION ALL SELECT 'vw_source_artifacts', count(*) FROM nation UNION ALL SELECT 'vw_quality_checks', 0""")
def do48_all(t: Tables) -> DataFrame:
    out = None
    for name, df in V.views(t.spark, _tables(t)).items():
        one = df.agg(F.count("*").alias("n")).select(L(name).alias("view"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("sc21_typed_empty", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', '{k}', 0)" for n, kinds in V.OPTIONAL.items() for c, k in kinds.items()) + ") v(relation, column_, kind, rows_)")
def sc21(t: Tables) -> DataFrame:
    """Columns of each empty table as the tables themselves have them."""
    out = None
    for name in V.OPTIONAL:
        df = V.optional_table(t.spark, {}, name)
        cols = F.array(*(F.struct(L(c).alias("column_"), L(k).alias("kind")) for c, k in df.dtypes))
        one = df.agg(F.count("*").cast("int").alias("rows_")).select(L(name).alias("relation"), F.explode(cols).alias("c"), "rows_").select("relation", "c.*", "rows_")
        out = one if out is None else out.unionByName(one)
    return out


@query("sc20_load_views", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")) + ")")
def sc20(t: Tables) -> DataFrame:
    """Every table as a view, counted by SQL."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    return t.spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n FROM {{{n}}}" for n in names), **{n: getattr(t, n) for n in names})
