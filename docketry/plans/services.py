"""Classification, resolution and explorer queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.names import acronym
from docketry.operators.classify import Rule, Taxonomy, classify, classify_rows
from docketry.operators.resolve import attach_ids, best_pairs, candidate_pairs, decide, location_conflict, resolve, scope_compatible, select_override, suffix_conflict
from docketry.operators.service import Explorer, Filters
from docketry.plans.local import ENTITIES, FIRST, Tables, entities, first_cases, query

#: A small rule set over part names and types.
TAXONOMY = Taxonomy(
    exact={"PART 7": (None, "ambiguous", 0.4)},
    exclusions=(Rule("faculty", "not_relevant", 0.99, ("^PART \\d*9$",)), Rule("sales", "not_relevant", 0.98, ("5$",))),
    codes=(Rule("steel", "metal", 0.96, prefixes=("STEEL", "BRASS")),),
    titles=(Rule("tens", "round", 0.95, ("0$",)), Rule("fives", "five", 0.94, ("15$",))),
    combined=(Rule("tin_one", "tin", 0.91, ("1$",), ("TIN",)),),
    ambiguous=("2$",),
)
_TITLE, _CODE = "'PART ' || p_partkey", "p_type"
_CLASSIFY = f"""SELECT p_partkey, CASE WHEN m = 'NEEDS_REVIEW' THEN NULL WHEN m = 'EXACT_REVIEWED_TITLE' THEN NULL ELSE m NOT IN ('STRONG_EXCLUSION_PATTERN', 'DEFAULT_NOT_RELEVANT') END AS technical_role,
 CASE m WHEN 'SOC_MAPPING' THEN 'metal' WHEN 'STRONG_TITLE_PATTERN' THEN CASE WHEN regexp_matches(t, '0$') THEN 'round' ELSE 'five' END WHEN 'COMBINED_SOC_TITLE' THEN 'tin' WHEN 'NEEDS_REVIEW' THEN 'ambiguous' WHEN 'EXACT_REVIEWED_TITLE' THEN 'ambiguous' ELSE 'not_relevant' END AS role_family, m AS classification_method
FROM (SELECT p_partkey, t, CASE WHEN t = 'PART 7' THEN 'EXACT_REVIEWED_TITLE' WHEN regexp_matches(t, '^PART \\d*9$') OR (regexp_matches(t, '5$') AND NOT regexp_matches(t, '0$|15$')) THEN 'STRONG_EXCLUSION_PATTERN'
  WHEN regexp_matches(c, '^(STEEL|BRASS)') THEN 'SOC_MAPPING' WHEN regexp_matches(t, '0$|15$') THEN 'STRONG_TITLE_PATTERN' WHEN regexp_matches(c, '^TIN') AND regexp_matches(t, '1$') THEN 'COMBINED_SOC_TITLE'
  WHEN regexp_matches(t, '2$') THEN 'NEEDS_REVIEW' ELSE 'DEFAULT_NOT_RELEVANT' END AS m FROM (SELECT p_partkey, {_TITLE} AS t, {_CODE} AS c FROM part))"""


def _titles(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("PART "), F.col("p_partkey").cast("string")).alias("title"), F.col("p_type").alias("code"))


@query("do16_classify", _CLASSIFY)
def do16(t: Tables) -> DataFrame:
    return classify(_titles(t), TAXONOMY).select("p_partkey", "technical_role", "role_family", "classification_method")


@query("do17_classify_distinct", f"SELECT l_orderkey, l_linenumber, role_family FROM lineitem JOIN ({_CLASSIFY}) ON l_partkey = p_partkey")
def do17(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(_titles(t), F.col("l_partkey") == F.col("p_partkey"))
    return classify_rows(rows, TAXONOMY, "title", "code").select("l_orderkey", "l_linenumber", "role_family")


def _named(df: DataFrame, key: str, name: str, nation: str) -> DataFrame:
    core = F.upper(F.regexp_replace(name, "[^A-Za-z0-9]+", " "))
    return df.select(F.col(key).alias("id"), core.alias("core_name"), acronym(core).alias("acronym"), F.col(nation).cast("string").alias("state"), F.lit("").alias("city"), F.lit("").alias("postal_code"))


def _suppliers(t: Tables) -> DataFrame:
    return _named(t.supplier, "s_suppkey", "s_name", "s_nationkey")


@query("do09_pair_scores")
def do09(t: Tables) -> DataFrame:
    # every name against the whole table, itself included
    return candidate_pairs(_suppliers(t), _suppliers(t))


@query("do12_resolution_decisions")
def do12(t: Tables) -> DataFrame:
    # decisions need the best two of do09's pairs only
    return decide(best_pairs(_suppliers(t), _suppliers(t)))


def _observed(t: Tables) -> DataFrame:
    """Customers under the names of suppliers of their number, as observations of a source."""
    name = F.concat(F.lit("SUPPLIER "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    nothing = F.lit("")
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("observation_id"), F.col("c_mktsegment").alias("source_id"), F.col("c_name").alias("alias_raw"), F.lit(1).cast("long").alias("occurrence_count"), name.alias("normalized_name"),
        name.alias("core_name"), acronym(name).alias("acronym"), nothing.alias("legal_suffix"), nothing.alias("city"), F.col("c_nationkey").cast("string").alias("state"), nothing.alias("postal_code"),
    )


def _aliases(t: Tables) -> DataFrame:
    """For every tenth supplier a reviewed alias, and a more specific one for one source."""
    name = F.concat(F.lit("SUPPLIER "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    some = t.supplier.where("s_acctbal < 1000").select(name.alias("normalized_name"), F.col("s_suppkey").cast("string").alias("k"))
    kinds = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("source_id"), F.lit("any_").alias("p")), F.struct(F.lit("BUILDING").alias("source_id"), F.lit("own_").alias("p"))))
    some = some.withColumn("x", kinds)
    none = F.lit(None).cast("string")
    return some.select("normalized_name", "x.source_id", none.alias("city"), none.alias("state"), none.alias("postal_code"), F.concat("x.p", "k").alias("legal_entity_id"))


@query("do11_guards", """SELECT s_suppkey, s_nationkey <> c_nationkey OR floor(s_acctbal / 1000) <> floor(c_acctbal / 1000) AS location_conflict,
  s_acctbal > 2000 AND c_acctbal > 4000 AND c_acctbal <= 8000 AS suffix_conflict, (s_acctbal > 5000) = (c_acctbal > 5000) AS scope_compatible
FROM supplier JOIN customer ON s_suppkey = c_custkey""")
def do11(t: Tables) -> DataFrame:
    s, c = F.col("s_acctbal"), F.col("c_acctbal")
    text = lambda x: F.floor(x / 1000).cast("string")
    suffix = F.when(c > 8000, "INC").when(c > 4000, "LLC").otherwise("")
    core = lambda x, front: F.concat(F.lit(front), F.when(x > 5000, " HOSPITAL").otherwise(" LAB"))
    return t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey")).select(
        "s_suppkey",
        location_conflict(F.col("s_nationkey").cast("string"), text(s), F.col("c_nationkey").cast("string"), text(c)).alias("location_conflict"),
        suffix_conflict(F.when(s > 2000, "INC").otherwise(""), suffix).alias("suffix_conflict"),
        scope_compatible(core(s, "A B ACME"), core(c, "THE ACME")).alias("scope_compatible"),
    )


@query("do13_override", """SELECT CAST(c_custkey AS VARCHAR) AS observation_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'own_' ELSE 'any_' END || s_suppkey AS override_id
FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE s_acctbal < 1000""")
def do13(t: Tables) -> DataFrame:
    return select_override(_observed(t), _aliases(t))


@query("do12_resolve")
def do12_whole(t: Tables) -> DataFrame:
    known_ = _named(t.supplier, "s_suppkey", "s_name", "s_nationkey")
    name = F.concat(F.lit("SUPPLIER "), F.lpad(F.col("id").cast("string"), 9, "0"))
    known_ = known_.select(F.concat(F.lit("legal_"), F.col("id").cast("string")).alias("legal_entity_id"), name.alias("normalized_name"), name.alias("core_name"), acronym(name).alias("acronym"), F.lit("").alias("legal_suffix"), "city", "state", "postal_code")
    none = t.spark.createDataFrame([], "source_id string, normalized_name string, candidate_legal_entity_id string")
    return resolve(_observed(t), known_, _aliases(t), none)


@query("do14_attach_ids", "SELECT o_orderkey, CASE WHEN s_suppkey IS NULL THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'own_' || s_suppkey ELSE 'any_' || s_suppkey END AS override_id FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON c_custkey = s_suppkey AND s_acctbal < 1000")
def do14(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("observation_id"))
    return attach_ids(rows, do13(t), ["observation_id"]).select("o_orderkey", "override_id")


@query("do10_block_keys", "SELECT s_suppkey AS id, 'state_prefix:' || s_nationkey || ':' || substr(upper(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g')), 1, 5) AS key FROM supplier")
def do10(t: Tables) -> DataFrame:
    from docketry.operators.resolve import block_keys

    n = _named(t.supplier, "s_suppkey", "s_name", "s_nationkey")
    return n.select("id", F.explode(block_keys(F.col("state"), F.col("core_name"), F.lit(""), F.col("postal_code"))).alias("key"))


def explorer(t: Tables) -> Explorer:
    n = t.orders.groupBy(F.col("o_custkey").alias("organization_id")).agg(F.count("*").alias("n"))
    orgs = entities(t).select(F.col("legal_entity_id").alias("organization_id"), F.col("legal_name").alias("name"), "segment", "state", F.col("balance").alias("score")).join(n, "organization_id", "left")
    aliases = t.supplier.select(F.col("s_suppkey").alias("organization_id"), F.col("s_name").alias("alias"))
    return Explorer(orgs, aliases, first_cases(t).withColumnRenamed("legal_entity_id", "organization_id"))


_ORGS = f"WITH {ENTITIES}, o AS (SELECT legal_entity_id AS organization_id, legal_name AS name, segment, state, balance AS score, (SELECT count(*) FROM orders WHERE o_custkey = legal_entity_id) AS n0 FROM entities), orgs AS (SELECT organization_id, name, segment, state, score, nullif(n0, 0) AS n FROM o)"


@query("pr14_employer_filters", f"""{_ORGS} SELECT organization_id, name FROM orgs WHERE score >= 100 AND n >= 3 AND segment IN ('BUILDING', 'MACHINERY') AND (name ILIKE '%1%' OR organization_id IN (SELECT s_suppkey FROM supplier WHERE s_name ILIKE '%1%'))
 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = organization_id AND o_orderpriority IN ('1-URGENT', '2-HIGH', '1', '2'))""")  # fmt: skip
def pr14(t: Tables) -> DataFrame:
    f = Filters(minimums=(("score", 100), ("n", 3)), any_of=(("segment", ("BUILDING", "MACHINERY")),), term="1", families=("1-URGENT", "2-HIGH", "1", "2"))
    return explorer(t).where(f).select("organization_id", "name")


@query("pr16_organization_scope", f"WITH {ENTITIES}, {FIRST} SELECT case_id FROM first_cases WHERE legal_entity_id = 5 OR parent_id = 1000000003")
def pr16(t: Tables) -> DataFrame:
    return first_cases(t).where((F.col("legal_entity_id") == 5) | (F.col("parent_id") == 1_000_000_003)).select("case_id")


@query("do49_list", f"{_ORGS} SELECT organization_id, name, score FROM orgs WHERE n >= 1 ORDER BY score DESC NULLS LAST, organization_id LIMIT 50")
def do49(t: Tables) -> DataFrame:
    return explorer(t).list(Filters(minimums=(("n", 1),)), "score", 50).select("organization_id", "name", "score")


@query("do49_facets", f"{_ORGS} SELECT DISTINCT 'segment' AS facet, segment AS value FROM orgs UNION ALL SELECT DISTINCT 'state', state FROM orgs")
def do49_facets(t: Tables) -> DataFrame:
    return explorer(t).facets(["segment", "state"])


@query("do49_compare", f"{_ORGS} SELECT organization_id, name, pos FROM orgs JOIN (VALUES (9, 0), (3, 1)) v(id, pos) ON organization_id = id")
def do49_compare(t: Tables) -> DataFrame:
    return explorer(t).compare([9, 3]).select("organization_id", "name", "pos")


@query("do36_priority_queue", f"""WITH {ENTITIES}, q AS (SELECT legal_entity_id AS org, 1 AS tier FROM entities WHERE balance > 9000 UNION ALL SELECT legal_entity_id, 2 FROM entities WHERE segment = 'BUILDING' UNION ALL SELECT legal_entity_id, 3 FROM entities)
SELECT org, tier, row_number() OVER (ORDER BY tier, org) AS rank FROM (SELECT org, min(tier) AS tier FROM q GROUP BY 1)""")  # fmt: skip
def do36(t: Tables) -> DataFrame:
    from docketry.operators.projection import with_row_number

    e = entities(t)
    tiers = ((1, e.where("balance > 9000")), (2, e.where("segment = 'BUILDING'")), (3, e))
    rows = reduce(DataFrame.unionByName, (d.select(F.col("legal_entity_id").alias("org"), F.lit(k).alias("tier")) for k, d in tiers))
    return with_row_number(rows.groupBy("org").agg(F.min("tier").alias("tier")), ["tier", "org"], name="rank").select("org", "tier", F.col("rank").cast("long").alias("rank"))


@query("do28_observed_artifacts", "SELECT o_orderpriority AS artifact, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 1000) GROUP BY 1")
def do28(t: Tables) -> DataFrame:
    seen = t.orders.where("o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("artifact")).agg(F.count("*").alias("n"))
    return seen.join(t.orders.where("o_totalprice > 1000").select(F.col("o_orderpriority").alias("artifact")), "artifact", "left_semi")
