"""Queries of names, addresses, dates, registers, candidates and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.names import STATES, normalize_state, normalize_title, stable_identity
from docketry.functions.semantics import host_of
from docketry.operators import evidence as E
from docketry.plans.local import Tables, query

C, L = F.col, F.lit


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NAMES, _CODES = list(STATES), list(STATES.values())
_RAW_STATE = f"""CASE WHEN c_nationkey = 7 THEN NULL WHEN c_custkey % 6 = 0 THEN lower({_list(_CODES)}[c_custkey % {len(STATES)} + 1]) WHEN c_custkey % 6 = 1 THEN {_list(_NAMES)}[c_custkey % {len(STATES)} + 1]
 WHEN c_custkey % 6 = 2 THEN ' ' || {_list(_NAMES)}[c_custkey % {len(STATES)} + 1] || ' Watauga County' WHEN c_custkey % 6 = 3 THEN 'Ontário' WHEN c_custkey % 6 = 4 THEN replace({_list(_NAMES)}[c_custkey % {len(STATES)} + 1], 'A', 'á') ELSE '' END"""


@query("fn08_normalize_state", f"""WITH s AS (SELECT unnest({_list(_NAMES)}) AS name, unnest({_list(_CODES)}) AS code), r AS (SELECT c_custkey, {_RAW_STATE} AS raw FROM customer),
k AS (SELECT DISTINCT raw, regexp_replace(upper(strip_accents(raw)), '[^A-Z0-9]+', '', 'g') AS up FROM r),
m AS (SELECT raw, coalesce(max(CASE WHEN up = code THEN code END), arg_max(code, length(replace(name, ' ', ''))) FILTER (WHERE starts_with(up, replace(name, ' ', ''))), '') AS state FROM k CROSS JOIN s GROUP BY raw)
SELECT c_custkey, coalesce(state, '') AS state FROM r LEFT JOIN m USING (raw)""")
def fn08(t: Tables) -> DataFrame:
    k = C("c_custkey") % 6
    of = lambda values: F.element_at(F.array(*(L(v) for v in values)), (C("c_custkey") % len(STATES) + 1).cast("int"))
    raw = (
        F.when(C("c_nationkey") == 7, None).when(k == 0, F.lower(of(_CODES))).when(k == 1, of(_NAMES)).when(k == 2, F.concat(L(" "), of(_NAMES), L(" Watauga County")))
        .when(k == 3, "Ontário").when(k == 4, F.replace(of(_NAMES), L("A"), L("á"))).otherwise("")
    )
    return t.customer.select("c_custkey", normalize_state(raw).alias("state"))


@query("fn09_title", "SELECT p_partkey, trim(regexp_replace(upper(strip_accents(' Sr. Ingénieur—' || p_name || ' (' || p_type || ') / II')), '[^A-Z0-9]+', ' ', 'g')) AS title FROM part")
def fn09(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", normalize_title(F.concat(L(" Sr. Ingénieur—"), "p_name", L(" ("), "p_type", L(") / II"))).alias("title"))


_IDENTITY = r"lower(trim(regexp_replace(translate(replace('  SchÃ¶n–“X”' || chr(9) || c_name, 'Ã¶', 'ö'), '�–“’¿', ''), '\s+', ' ', 'g')))"


@query("fn21_stable_identity", f"SELECT c_custkey, {_IDENTITY} AS name, CASE WHEN length(z) = 4 THEN '0' || z ELSE z END AS zip FROM (SELECT *, CAST(900 + c_custkey AS VARCHAR) AS z FROM customer)")
def fn21(t: Tables) -> DataFrame:
    name = F.concat(L("  SchÃ¶n–“X”\t"), "c_name")
    return t.customer.select("c_custkey", stable_identity(name).alias("name"), stable_identity((C("c_custkey") + 900), postal=True).alias("zip"))


#: Pages' addresses with the words of policy pages among them.
_TAILS = ("", "/H-1B_Green_Card", "/perm-immigration.PNG", "/postdoc/eb1b", "/Permanent-Residence/perm/", "/international_scholar")
_URL = f"split_part(url, '?', 1) || {_list(_TAILS)}[page_id % {len(_TAILS)} + 1]"
_SCORE = "(" + " + ".join(f"CAST(contains(replace(lower(u), '_', '-'), '{w}') AS INT)" for w in E.POLICY_WORDS) + ")"
_TYPE = "CASE " + " ".join(f"WHEN contains(lower(u), '{w}') THEN '{k}'" for w, k in E.DOCUMENT_TYPES) + f" ELSE '{E.OTHER_TYPE}' END"


def _addresses(t: Tables) -> DataFrame:
    tail = F.element_at(F.array(*(L(x) for x in _TAILS)), (C("page_id") % len(_TAILS) + 1).cast("int"))
    return t.pages.select("page_id", F.concat(F.substring_index("url", "?", 1), tail).alias("u"))


@query("fn20_url_score", f"SELECT page_id, {_SCORE} AS score, {_TYPE} AS kind FROM (SELECT page_id, {_URL} AS u FROM pages)")
def fn20(t: Tables) -> DataFrame:
    return _addresses(t).select("page_id", E.url_score(C("u")).alias("score"), E.document_type(C("u")).alias("kind"))


_HOST = r"regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '')"


@query("sc15_policy_pages", f"""WITH p AS (SELECT page_id, {_URL} AS u FROM pages), d AS (SELECT DISTINCT {_HOST} AS site, u FROM p WHERE page_id % 11 <> 0 AND page_id % 13 <> 0),
s AS (SELECT site, u, {_SCORE} AS score FROM d WHERE starts_with(u, 'https:') AND NOT regexp_matches(lower(u), '\\.(jpg|jpeg|png|gif|zip)$'))
SELECT site, row_number() OVER (PARTITION BY site ORDER BY score DESC, length(u), u) AS rank, u AS url, score, replace(replace(regexp_extract(rtrim(u, '/'), '([^/]*)$', 1), '-', ' '), '_', ' ') AS title, {_TYPE} AS document_type
FROM s WHERE score > 0 QUALIFY rank <= 5""")
def sc15(t: Tables) -> DataFrame:
    # a sitemap for each page; some are broken, some list sitemaps, not pages
    listed = F.concat(L('<loc> '), F.replace("u", L("&"), L("&amp;")), L(" </loc>"))
    plain = F.concat(L('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url>'), listed, L("</url></urlset>"))
    content = F.when(C("page_id") % 11 == 0, F.concat(L("<!doctype x>"), plain)).when(C("page_id") % 13 == 0, F.concat(L("<sitemapindex><sitemap>"), listed, L("</sitemap></sitemapindex>"))).otherwise(plain)
    return E.policy_pages(E.sitemap_locations(_addresses(t).select(host_of(C("u")).alias("site"), content.alias("content"))))


@query("fn31_is_current", """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, 'D:%Y%m%d120000') WHEN 1 THEN strftime(o_orderdate, 'on %Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y-02-30') END AS s FROM orders),
d AS (SELECT o_orderkey, regexp_extract(s, '(20[0-9]{2})[-/:]?(0[1-9]|1[0-2])[-/:]?([0-2][0-9]|3[01])', ['y', 'm', 'd']) AS g FROM p)
SELECT o_orderkey, coalesce(TRY_CAST(g.y || '-' || g.m || '-' || g.d AS TIMESTAMP) >= TIMESTAMP '2001-12-01 12:00:00' - INTERVAL 548 DAY, FALSE) AS current_ FROM d""")
def fn31(t: Tables) -> DataFrame:
    k, d = C("o_orderkey") % 4, C("o_orderdate")
    said = F.when(k == 0, F.date_format(d, "'D:'yyyyMMdd'120000'")).when(k == 1, F.date_format(d, "'on 'yyyy/MM/dd")).when(k == 2, F.date_format(d, "yyyy'-02-30'"))
    return t.orders.select("o_orderkey", E.is_current(said, L("2001-12-01 12:00:00")).alias("current_"))


#: Lines as results of looking their supplier's number up as a customer's name.
_RESULTS = """results AS (SELECT l_suppkey AS id, l_orderkey * 10 + l_linenumber AS pos,
 CASE WHEN l_suppkey % 4 = 1 AND l_linenumber % 2 = 1 THEN 'customer ' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') ELSE 'Other' END AS employer,
 CASE WHEN l_suppkey % 4 >= 2 AND l_linenumber % 3 = 0 THEN 'CUSTOMER' || chr(35) || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') END AS dba,
 'CA, ' || CASE WHEN l_suppkey % 5 = 3 THEN 'XX' ELSE 'ny' END AS locations,
 CASE WHEN l_suppkey % 3 = 0 THEN 'Closed' WHEN l_suppkey % 3 = 1 OR l_linestatus = 'F' THEN 'TERMINATED' ELSE 'Open' END AS account FROM lineitem)"""


@query("do37_match_evaluation", f"""WITH {_RESULTS}, l AS (SELECT c_custkey AS id, 'CUSTOMER ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'NY' ELSE '' END AS state FROM customer),
r AS (SELECT l.id, pos, employer, dba, account, upper(replace(employer, '#', ' ')) = name AS e, coalesce(upper(replace(dba, '#', ' ')) = name, FALSE) AS d, state = '' OR list_contains(list_transform(string_split(locations, ','), lambda x: upper(trim(x))), state) AS here FROM l JOIN results USING (id)),
x AS (SELECT *, max(e) OVER (PARTITION BY id) AS by_e FROM r), y AS (SELECT id, by_e, here, pos, employer, dba, lower(account) AS account, CASE WHEN by_e THEN e ELSE d END AS exact FROM x),
g AS (SELECT id, bool_or(by_e) AS by_e, bool_or(exact) AS exact, bool_or(exact AND here) AS at_, bool_or(exact AND here AND account = 'open') AS o, bool_or(exact AND here AND account = 'terminated') AS t,
 coalesce(min(pos) FILTER (WHERE exact AND here AND account = 'open'), min(pos) FILTER (WHERE exact AND here AND account = 'terminated')) AS pos FROM y GROUP BY id),
s AS (SELECT l.id, l.state, g.pos, by_e, CASE WHEN g.id IS NULL THEN 'NO_MATCH' WHEN NOT at_ THEN 'AMBIGUOUS' WHEN o THEN 'CONFIRMED_ACTIVE' WHEN t THEN 'CONFIRMED_INACTIVE' ELSE 'AMBIGUOUS' END AS status,
 CASE WHEN g.id IS NULL THEN 'NO_RESULTS' WHEN NOT exact THEN 'SUBSTRING_RESULTS_ONLY' WHEN by_e THEN 'EXACT_EMPLOYER_NAME' ELSE 'EXACT_DBA_NAME' END AS match_method FROM l LEFT JOIN g USING (id))
SELECT s.id AS lookup_id, status, match_method, CASE WHEN s.pos IS NULL THEN 0.0 WHEN by_e AND state <> '' THEN 1.0 ELSE 0.98 END::DOUBLE AS confidence, CASE WHEN status = 'AMBIGUOUS' THEN 'NEEDS_REVIEW' ELSE 'NOT_REQUIRED' END AS review_status, employer AS matched_name, dba AS matched_dba
FROM s LEFT JOIN (SELECT DISTINCT id, pos, employer, dba FROM r) r ON s.id = r.id AND s.pos = r.pos""")
def do37(t: Tables) -> DataFrame:
    k, number = C("l_suppkey"), F.lpad(C("l_suppkey").cast("string"), 9, "0")
    results = t.lineitem.select(
        k.alias("lookup_id"),
        (C("l_orderkey") * 10 + C("l_linenumber")).alias("position"),
        F.when((k % 4 == 1) & (C("l_linenumber") % 2 == 1), F.concat(L("customer "), number)).otherwise("Other").alias("employer"),
        F.when((k % 4 >= 2) & (C("l_linenumber") % 3 == 0), F.concat(L("CUSTOMER#"), number)).alias("dba"),
        F.concat(L("CA, "), F.when(k % 5 == 3, "XX").otherwise("ny")).alias("locations"),
        F.when(k % 3 == 0, "Closed").when((k % 3 == 1) | (C("l_linestatus") == "F"), "TERMINATED").otherwise("Open").alias("account_status"),
    )
    lookups = t.customer.select(C("c_custkey").alias("lookup_id"), C("c_name").alias("queried_name"), F.when(C("c_nationkey") % 2 == 0, "ny").alias("state"))
    return E.evaluate_matches(lookups, results).drop("queried_name", "state")


_SHARE = lambda v: f"((rank() OVER (ORDER BY coalesce({v}, 0)) + (count(*) OVER (PARTITION BY coalesce({v}, 0)) - 1) / 2.0) / count(*) OVER ())"
_INSTITUTIONS = """i AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name, NULLIF(p_size, 7) AS lca, p_partkey % 13 AS perm, NULLIF(1990 + p_size % 30, 2000) AS y1, 1990 + p_partkey % 31 AS y2, p_retailprice AS rd,
 NULLIF(p_size * 3 % 17, 4) AS comp, CAST(substr(p_brand, 7) AS INT) AS eng, p_partkey % 3 = 0 AS opt, p_partkey % 4 = 0 AS ev, p_type FROM part WHERE p_partkey % 20 <> 3)"""


@query("do40_candidate_rank", f"""WITH {_INSTITUTIONS}, c AS (SELECT *, {_SHARE("lca")} AS a, {_SHARE("perm")} AS b, {_SHARE("greatest(y1, y2)")} AS c, {_SHARE("rd")} AS d, {_SHARE("comp")} AS e, {_SHARE("eng")} AS f,
 CASE WHEN opt THEN 1.0 ELSE 0.0 END::DOUBLE AS g, CASE WHEN ev THEN 1.0 ELSE 0.0 END::DOUBLE AS h, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 1.0 ELSE 0.25 END::DOUBLE AS t, CASE WHEN id IN (11, 12) THEN 1.0 ELSE 0.0 END::DOUBLE AS m FROM i),
s AS (SELECT *, round(a * 0.2::DOUBLE + b * 0.1::DOUBLE + c * 0.1::DOUBLE + d * 0.2::DOUBLE + e * 0.1::DOUBLE + f * 0.1::DOUBLE + g * 0.07::DOUBLE + h * 0.03::DOUBLE + t * 0.05::DOUBLE + m * 0.05::DOUBLE, 12) AS v FROM c)
SELECT row_number() OVER (ORDER BY v DESC, rd DESC, lca DESC NULLS FIRST, name) AS candidate_rank, id AS institution_id, name AS official_name, round(v, 6) AS candidate_score, round(a, 6) AS relevant_lca_component, round(c, 6) AS recent_activity_component,
 round(e, 6) AS computing_rd_component, t AS institution_type_component, m AS manual_priority_component FROM s QUALIFY candidate_rank <= 150""")
def do40(t: Tables) -> DataFrame:
    k, size = C("p_partkey"), C("p_size")
    name = F.concat("p_name", L(" "), k.cast("string"))
    rows = t.part.select(
        k.alias("institution_id"), name.alias("official_name"), F.when(k % 20 == 3, " ").otherwise("x.org").alias("official_domain"), F.nullif(size, L(7)).alias("relevant_lca_count"), (k % 13).alias("relevant_certified_perm_count"),
        F.nullif(size % 30 + 1990, L(2000)).alias("last_lca_activity_year"), (k % 31 + 1990).cast("int").alias("last_perm_activity_year"), L(None).cast("int").alias("last_uscis_activity_year"), C("p_retailprice").alias("total_rd"),
        F.nullif(size * 3 % 17, L(4)).alias("computing_rd"), F.expr("cast(substr(p_brand, 7) as int)").alias("engineering_rd"), F.when(k % 3 == 0, "OBSERVED_POSITIVE").alias("known_opt_observation"),
        F.when(k % 4 == 0, "CONFIRMED_ACTIVE").otherwise("NO_MATCH").alias("everify_status"), F.when(C("p_type") == "ECONOMY", "Private, not-for-profit").when(C("p_type") == "PROMO", "PUBLIC").alias("control"),
    )
    named = [r[0] for r in rows.where("institution_id in (11, 12)").select("official_name").collect()]  # two reviewed names
    out = E.rank_candidates(rows, 150, named)
    keep = ["relevant_lca_component", "recent_activity_component", "computing_rd_component"]
    return out.select("candidate_rank", "institution_id", "official_name", F.round("candidate_score", 6).alias("candidate_score"), *(F.round(c, 6).alias(c) for c in keep), "institution_type_component", "manual_priority_component")


_EXCERPT = "CASE doc_id % 4 WHEN 0 THEN replace(substr(text, 21, 60), ' ', '  ') WHEN 1 THEN substr(text, 2, 40) WHEN 2 THEN 'no such words ' || doc_id ELSE ' ' END"
_TEXT = r"""trim(regexp_replace(lower(translate({}, '‘’“”', '''''""')), '\s+', ' ', 'g'))"""


@query("do43_policy_facts", f"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'pr_general_staff_eligible' ELSE 'support' END AS fact_type, ['YES', 'NO', 'LIMITED', 'NOT_STATED'][doc_id % 5 % 4 + 1] AS fact_value, {_EXCERPT} AS x, coalesce(lang, '') = 'en' AS cur,
 CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE 0.9 END AS conf, doc_id % 11 <> 0 AS same, doc_id % 6 = 0 AS against, text FROM documents),
f AS (SELECT *, coalesce({_TEXT.format("x")} <> '' AND contains({_TEXT.format("text")}, {_TEXT.format("x")}), FALSE) AS exact FROM e)
SELECT substr(sha256(doc_id || '|' || fact_type || '|v1'), 1, 32) AS policy_fact_id, doc_id AS policy_document_id, fact_type, fact_value, exact AND same AS exact_excerpt_verified, CASE WHEN against THEN substr(sha256(doc_id || '|a|b'), 1, 24) END AS contradiction_group_id,
 coalesce(NULLIF(concat_ws(';', CASE WHEN fact_value <> 'NOT_STATED' AND NOT exact THEN 'EXCERPT_NOT_FOUND_IN_FETCHED_SOURCE' END, CASE WHEN NOT same THEN 'SOURCE_URL_MISMATCH' END, CASE WHEN fact_value IN ('NO', 'LIMITED') THEN 'VALUE_' || fact_value END,
  CASE WHEN conf < 0.85 THEN 'CONFIDENCE_BELOW_0.85' END, CASE WHEN against THEN 'DOCUMENT_CONTRADICTION' END, CASE WHEN NOT cur THEN 'CURRENT_POLICY_DATE_NOT_CONFIRMED' END, CASE WHEN fact_type <> 'support' THEN 'FACT_TYPE_REQUIRES_HUMAN_REVIEW' END), ''), 'PENDING_HUMAN_REVIEW') AS reviewer_note FROM f""")
def do43(t: Tables) -> DataFrame:
    k = C("doc_id")
    values = F.element_at(F.array(*(L(v) for v in ("YES", "NO", "LIMITED", "NOT_STATED"))), (k % 5 % 4 + 1).cast("int"))
    excerpt = F.expr("CASE doc_id % 4 WHEN 0 THEN replace(substr(text, 21, 60), ' ', '  ') WHEN 1 THEN substr(text, 2, 40) WHEN 2 THEN 'no such words ' || doc_id ELSE ' ' END")
    said = t.documents.select(
        k.alias("policy_document_id"), F.when(k % 9 == 0, "pr_general_staff_eligible").otherwise("support").alias("fact_type"), values.alias("fact_value"), excerpt.alias("supporting_excerpt"),
        F.when(k % 11 != 0, "https://x.org/a").otherwise("https://x.org/b").alias("source_url"), F.when(k % 7 == 0, 0.5).otherwise(0.9).alias("confidence"),
    )
    documents = t.documents.select(
        k.alias("policy_document_id"), C("source").alias("institution_id"), L("https://x.org/a").alias("url"), "text", F.when(k % 6 == 0, F.array(L("a"), L("b"))).alias("contradictions"), (C("lang") == "en").alias("document_current")
    )
    return E.policy_facts(said, documents, "v1").select("policy_fact_id", "policy_document_id", "fact_type", "fact_value", "exact_excerpt_verified", "contradiction_group_id", "reviewer_note")


def _coded(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE 'UNKNOWN' END"


@query("do06_directory", f"""WITH r AS (SELECT s_suppkey, CASE WHEN length(CAST(s_suppkey AS VARCHAR)) < 6 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS unit, CAST(s_nationkey % 5 AS VARCHAR) AS a, CAST(s_nationkey % 11 AS VARCHAR) AS b, CAST(s_nationkey % 14 AS VARCHAR) AS c, s_name, s_nationkey FROM supplier)
SELECT 'ipeds:' || unit AS institution_id, s_name AS official_name, CASE WHEN s_nationkey <> 1 THEN 'System' END AS system_name, {_coded("a", E.CONTROL)} AS control, {_coded("b", E.SECTOR)} AS sector, {_coded("c", E.HIGHEST_DEGREE)} AS highest_degree,
 CASE WHEN s_nationkey <> 2 THEN 'site' || s_suppkey || '.edu' END AS official_domain, CASE WHEN s_nationkey = 3 THEN 'INACTIVE_OR_UNKNOWN' ELSE 'ACTIVE' END AS active_status, 2023 AS directory_year, 'PROVISIONAL' AS release_status, CAST(s_nationkey AS VARCHAR) AS calendar_system_code, CAST(NULL AS VARCHAR) AS open_admissions_code FROM r""")
def do06(t: Tables) -> DataFrame:
    k, n = C("s_suppkey").cast("string"), C("s_nationkey")
    raw = t.supplier.select(
        F.concat(L(" "), k).alias("unitid"), C("s_name").alias("instnm"), F.when(n == 1, "-2").otherwise("System").alias("f1sysnam"), (n % 5).cast("string").alias("control"), (n % 11).cast("string").alias("sector"), (n % 14).cast("string").alias("hloffer"),
        F.when(n == 2, "  ").otherwise(F.concat(L("HTTPS://www.Site"), k, L(".edu/home"))).alias("webaddr"), F.when(n == 3, "2").otherwise("1").alias("cyactive"),
    )
    more = E.characteristics(t.supplier.select(k.alias("unitid"), n.cast("string").alias("calsys")), 2022, True, "b").select("ipeds_unitid", "calendar_system_code", "open_admissions_code")
    out = E.directory(raw, 2023, False, "a").join(more, "ipeds_unitid", "left")
    return out.select("institution_id", "official_name", "system_name", "control", "sector", "highest_degree", "official_domain", "active_status", "directory_year", "release_status", "calendar_system_code", "open_admissions_code")


@query("do06_directory_issues", """WITH u AS (SELECT CASE WHEN c_nationkey = 0 THEN 'x' ELSE lpad(CAST(c_nationkey AS VARCHAR), 6, '0') END AS unit FROM customer), g AS (SELECT unit, count(*) AS n FROM u GROUP BY 1)
SELECT 'minimum_row_count' AS category, 'ERROR' AS severity, sum(n)::BIGINT AS actual FROM g HAVING sum(n) < 1000000000 UNION ALL SELECT 'invalid_unitid', 'ERROR', sum(n)::BIGINT FROM g WHERE unit = 'x' HAVING sum(n) > 0 UNION ALL SELECT 'duplicate_unitid', 'ERROR', sum(n)::BIGINT FROM g WHERE n > 1 HAVING sum(n) > 0""")
def do06_issues(t: Tables) -> DataFrame:
    unit = F.when(C("c_nationkey") == 0, "x").otherwise(F.lpad(C("c_nationkey").cast("string"), 6, "0"))
    return E.directory_issues(t.customer.select(unit.alias("ipeds_unitid")), 1_000_000_000)
