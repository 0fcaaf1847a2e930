"""Single operators over the local tables, each beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions import semantics as S
from docketry.operators import projection as P
from docketry.plans.local import Tables, query

C = F.col

# --- scans, sinks, construction -----------------------------------------------------------


@query("sc01_parquet_scan", "SELECT r_regionkey, r_name FROM region")
def sc01(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", "r_name")


@query("sc02_lazy_scan_pruned", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def sc02(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 300000").select("o_orderkey", "o_totalprice")


@query("sc08_wide_to_long", """SELECT l_orderkey, l_linenumber, m.name AS measure, m.v AS value, m.rank AS rank FROM lineitem, LATERAL (VALUES ('tax', l_tax, 1), ('discount', l_discount, 2)) m(name, v, rank) WHERE m.v > 0""")
def sc08(t: Tables) -> DataFrame:
    return P.wide_to_long(t.lineitem, ["l_orderkey", "l_linenumber"], {"tax": "l_tax", "discount": "l_discount"})


@query("sc13_latest_period_pairs", """WITH p AS (SELECT year(o_orderdate) AS y, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1) SELECT CAST(max(y) AS INT) AS latest FROM p WHERE kinds >= 2""")
def sc13(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.countDistinct("o_orderstatus").alias("kinds")).where("kinds >= 2").agg(F.max("y").alias("latest"))


@query("sc19_export_text", """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS families, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1""")
def sc19(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("families"), F.count("*").alias("n"))
    return P.flat_for_export(rows, keep=["o_custkey"])


@query("sc22_add_missing_column", "SELECT r_regionkey, CAST(NULL AS DOUBLE) AS score FROM region")
def sc22(t: Tables) -> DataFrame:
    return P.ensure_columns(t.region, {"score": "double", "r_regionkey": "int"}).select("r_regionkey", "score")


@query("pr01_first_available", "SELECT c_custkey, c_name AS name, CAST(NULL AS VARCHAR) AS absent FROM customer")
def pr01(t: Tables) -> DataFrame:
    c = t.customer
    return c.select("c_custkey", P.first_available(c, ["legal_name", "c_name"], "string").alias("name"), P.first_available(c, ["nothing"], "string").alias("absent"))


@query("pr05_constant_stamp", "SELECT n_nationkey, 'dol' AS source_id, 'v1' AS schema_version FROM nation")
def pr05(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey").withColumns({"source_id": F.lit("dol"), "schema_version": F.lit("v1")})


@query("pr06_row_index", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) + 1 AS source_row_number FROM part")
def pr06(t: Tables) -> DataFrame:
    return P.with_row_number(t.part, ["p_partkey"], start=2).select("p_partkey", "source_row_number")


@query("pr07_three_valued_filter", "SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice > 100000 END, FALSE) AND o_totalprice < 300000")
def pr07(t: Tables) -> DataFrame:
    maybe = F.when(C("o_orderstatus") == "P", None).otherwise(C("o_totalprice") > 100000)
    return t.orders.where(S.known(maybe) & (C("o_totalprice") < 300000)).select("o_orderkey")


@query("pr08_membership_predicates", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_retailprice BETWEEN 900 AND 1500 AND p_brand IS NOT NULL")
def pr08(t: Tables) -> DataFrame:
    return t.part.where(C("p_size").isin(1, 5, 9) & C("p_retailprice").between(900, 1500) & C("p_brand").isNotNull()).select("p_partkey")


@query("pr09_case_chain", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'L' WHEN p_size > 20 THEN 'M' END AS size_band FROM part")
def pr09(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(C("p_size") > 40, "L").when(C("p_size") > 20, "M").alias("size_band"))


@query("pr10_coalesce", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def pr10(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("pr11_non_strict_cast", "SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) AS n, TRY_CAST(c_mktsegment AS DOUBLE) AS none FROM customer")
def pr11(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.substring("c_name", 10, 100).try_cast("long").alias("n"), C("c_mktsegment").try_cast("double").alias("none"))


@query("pr12_rename_drop", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def pr12(t: Tables) -> DataFrame:
    return t.nation.withColumnsRenamed({"n_nationkey": "id", "n_name": "name"}).drop("n_regionkey", "not_there")


@query("pr13_all_but", "SELECT * EXCLUDE (c_acctbal) FROM customer")
def pr13(t: Tables) -> DataFrame:
    return t.customer.drop("c_acctbal")


@query("pr17_display_unknown", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END, 'UNKNOWN') AS p_size FROM part")
def pr17(t: Tables) -> DataFrame:
    return P.for_display(t.part.select("p_partkey", F.when(C("p_size") > 25, C("p_size")).alias("p_size")))


# --- joins --------------------------------------------------------------------------------


@query("jn01_left_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def jn01(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey"), "left").select("c_custkey", "n_name")


@query("jn02_left_join_many_to_one", "SELECT l.l_orderkey, l.l_linenumber, x.n FROM lineitem l LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) * 2 AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2) x ON l.l_orderkey = x.l_orderkey AND l.l_linenumber = x.l_linenumber")
def jn02(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    right = t.lineitem.where("l_quantity > 25").groupBy(*keys).agg((F.max("l_quantity") * 2).alias("n"))
    return S.checked_join(t.lineitem.select(*keys), right, keys)


@query("jn03_one_to_one", "SELECT n_nationkey, n_name, count FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS count FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey")
def jn03(t: Tables) -> DataFrame:
    n = t.supplier.groupBy(C("s_nationkey").alias("n_nationkey")).count()
    return S.checked_join(t.nation.select("n_nationkey", "n_name"), n, ["n_nationkey"], "1:1")


@query("jn04_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def jn04(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 200000").join(t.customer, C("o_custkey") == C("c_custkey")).select("o_orderkey", "c_name")


@query("jn05_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def jn05(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")


@query("jn06_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def jn06(t: Tables) -> DataFrame:
    a = t.customer.where("c_acctbal > 5000").groupBy(C("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = t.supplier.groupBy(C("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer")


@query("jn08_semi_join", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def jn08(t: Tables) -> DataFrame:
    hit = t.lineitem.where((C("l_quantity") > 45) | (C("l_discount") > 0.09)).select("l_partkey")
    return t.part.join(hit, C("p_partkey") == C("l_partkey"), "left_semi").select("p_partkey")


@query("jn09_scope_cross_join", "SELECT o_orderkey, top FROM orders, (SELECT max(o_totalprice) AS top FROM orders) WHERE o_totalprice >= 0.9 * top")
def jn09(t: Tables) -> DataFrame:
    return t.orders.crossJoin(F.broadcast(t.orders.agg(F.max("o_totalprice").alias("top")))).where("o_totalprice >= 0.9 * top").select("o_orderkey", "top")


@query("jn10_lateral_top1", """WITH r AS (SELECT c_custkey AS a, c_nationkey AS b, CAST(c_custkey % 7 AS INT) AS c, c_name FROM customer)
SELECT s_suppkey, m.c_name FROM supplier s LEFT JOIN LATERAL (SELECT c_name FROM r WHERE r.a = s.s_suppkey OR r.b = s.s_nationkey OR r.c = s.s_nationkey ORDER BY r.a LIMIT 1) m ON TRUE""")
def jn10(t: Tables) -> DataFrame:
    r = t.customer.select(C("c_custkey").alias("a"), C("c_nationkey").cast("long").alias("b"), (C("c_custkey") % 7).alias("c"), "c_name")
    s = t.supplier.select("s_suppkey", C("s_nationkey").cast("long").alias("n"))
    # the OR as three equi-joins, each on its least row, so that no pair is looped over
    return P.first_match(s, "s_suppkey", r, [("s_suppkey", "a"), ("n", "b"), ("n", "c")], "a", ["c_name"])


@query("jn11_using_two_keys", "SELECT conv_id, turn, a.role, n FROM conversations a JOIN (SELECT conv_id, turn, count(*) AS n FROM conversations GROUP BY 1, 2) USING (conv_id, turn)")
def jn11(t: Tables) -> DataFrame:
    n = t.conversations.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    return t.conversations.select("conv_id", "turn", "role").join(n, ["conv_id", "turn"])


@query("jn12_selection_order", "SELECT c_custkey, c_name, pos FROM customer JOIN (VALUES (30, 0), (10, 1), (20, 2)) v(id, pos) ON c_custkey = id")
def jn12(t: Tables) -> DataFrame:
    return P.in_order(t.customer, "c_custkey", [30, 10, 20]).select("c_custkey", "c_name", "pos")


@query("jn13_required_grid", "SELECT r_regionkey, k AS fact_type, CAST(n AS BIGINT) AS n FROM region CROSS JOIN (VALUES ('a'), ('b')) v(k) LEFT JOIN (SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'c' END AS f, count(*) AS n FROM nation GROUP BY 1, 2) ON n_regionkey = r_regionkey AND f = k")
def jn13(t: Tables) -> DataFrame:
    facts = t.nation.groupBy(C("n_regionkey").alias("r_regionkey"), F.when(C("n_nationkey") % 2 == 0, "a").otherwise("c").alias("fact_type")).agg(F.count("*").alias("n"))
    grid = t.region.select("r_regionkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("fact_type"))
    return grid.join(facts, ["r_regionkey", "fact_type"], "left")


@query("jn14_null_keys", "SELECT a.doc_id, b.doc_id AS other FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS k FROM labels) a LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS k FROM labels) b ON a.k = b.k")
def jn14(t: Tables) -> DataFrame:
    a = t.labels.select("doc_id", F.when(C("doc_id") % 2 == 0, C("doc_id")).alias("k"))
    b = t.labels.select(C("doc_id").alias("other"), F.when(C("doc_id") % 3 == 0, C("doc_id")).alias("k"))
    return a.join(b, "k", "left").select("doc_id", "other")


@query("jn15_blocked_candidates", """WITH k AS (SELECT s_suppkey AS a, unnest([ 'n:' || s_nationkey || ':' || CAST(floor(s_acctbal / 500) AS INT), 'b:' || CAST(floor(s_acctbal) AS INT) ]) AS key FROM supplier),
c AS (SELECT c_custkey AS b, unnest([ 'n:' || c_nationkey || ':' || CAST(floor(c_acctbal / 500) AS INT), 'b:' || CAST(floor(c_acctbal) AS INT) ]) AS key FROM customer)
SELECT DISTINCT a, b FROM k JOIN c USING (key)""")
def jn15(t: Tables) -> DataFrame:
    whole = lambda c: F.floor(c).cast("int").cast("string")
    keys = lambda n, v: F.explode(F.array(F.concat_ws(":", F.lit("n"), C(n).cast("string"), whole(C(v) / 500)), F.concat_ws(":", F.lit("b"), whole(C(v))))).alias("key")
    a = _with_keys(t.supplier.select(C("s_suppkey").alias("a"), keys("s_nationkey", "s_acctbal")), "a")
    b = _with_keys(t.customer.select(C("c_custkey").alias("b"), keys("c_nationkey", "c_acctbal")), "b")
    # a pair is made under the last of the keys that it shares, so no pairs are shuffled to make them distinct
    last = (C("key") == F.array_max("a_keys")) | (C("key") == F.array_max("b_keys")) | (C("key") == F.array_max(F.array_intersect("a_keys", "b_keys")))
    return a.join(b, "key").where(last).select("a", "b")


def _with_keys(keyed: DataFrame, name: str) -> DataFrame:
    """Each id once under each of its keys, beside all of them."""
    return keyed.groupBy(name).agg(F.collect_set("key").alias(f"{name}_keys")).select("*", F.explode(f"{name}_keys").alias("key"))


@query("jn16_not_exists_top5", "SELECT p_partkey, p_name FROM part p WHERE regexp_matches(p_type, 'STEEL|BRASS') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_quantity > 49) ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_partkey LIMIT 5")
def jn16(t: Tables) -> DataFrame:
    rows = t.part.where(C("p_type").rlike("STEEL|BRASS")).join(t.lineitem.where("l_quantity > 49"), C("p_partkey") == C("l_partkey"), "left_anti")
    return rows.orderBy(F.when(C("p_size") > 25, 0).otherwise(1), "p_partkey").limit(5).select("p_partkey", "p_name")


@query("jn17_having_top1", "SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, o_custkey LIMIT 1")
def jn17(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1").orderBy(C("n").desc(), "o_custkey").limit(1)


# --- aggregates ---------------------------------------------------------------------------


@query("ag01_group_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def ag01(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("ag02_conditional_count", "SELECT l_returnflag, count_if(l_discount > 0.05) AS n FROM lineitem GROUP BY 1")
def ag02(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(C("l_discount") > 0.05).alias("n"))


@query("ag03_weighted_sum", "SELECT o_custkey, CAST(sum(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS w FROM orders GROUP BY 1")
def ag03(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sum(F.when(C("o_orderstatus") == "F", 1.0).when(C("o_orderstatus") == "P", 0.5).otherwise(0.0)).alias("w"))


@query("ag04_filtered_distinct", "SELECT l_suppkey, count(DISTINCT CASE WHEN l_quantity > 30 THEN l_partkey END) AS n FROM lineitem GROUP BY 1")
def ag04(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.countDistinct(F.when(C("l_quantity") > 30, C("l_partkey"))).alias("n"))


@query("ag05_filtered_extremes", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS hi, min(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS lo FROM orders GROUP BY 1")
def ag05(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max(F.when(C("o_orderstatus") == "F", C("o_totalprice"))).alias("hi"), F.min(F.when(C("o_orderstatus") == "O", C("o_totalprice"))).alias("lo"))


@query("ag06_sorted_distinct_list", "SELECT n_regionkey, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def ag06(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "|").alias("names"))


@query("ag07_any_false_if_unknown", "SELECT o_custkey, coalesce(bool_or(CASE WHEN o_orderstatus = 'P' THEN TRUE END), FALSE) AS any_p FROM orders GROUP BY 1")
def ag07(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(S.any0(F.when(C("o_orderstatus") == "P", True)).alias("any_p"))


@query("ag08_sum_zero_if_unknown", "SELECT l_suppkey, coalesce(sum(CASE WHEN l_quantity > 49 THEN l_linenumber END), 0) AS n FROM lineitem GROUP BY 1")
def ag08(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(S.sum0(F.when(C("l_quantity") > 49, C("l_linenumber"))).alias("n"))


@query("ag09_structs_in_year_order", "SELECT o_custkey, string_agg(y || '=' || n, ',' ORDER BY y) AS by_year FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def ag09(t: Tables) -> DataFrame:
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    lists = y.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("y", "n"))).alias("s"))
    return lists.select("o_custkey", F.array_join(F.transform("s", lambda s: F.concat(s["y"].cast("string"), F.lit("="), s["n"].cast("string"))), ",").alias("by_year"))


@query("ag13_exact_duplicates", "SELECT count(*) AS rows_, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)) AS removed FROM orders")
def ag13(t: Tables) -> DataFrame:
    cols = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return t.orders.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows_"), F.sum(C("n") - 1).alias("removed"))


@query("ag14_duplicate_members", "SELECT sum(n) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1)")
def ag14(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).where("n > 1").agg(F.sum("n").alias("n"))


@query("ag15_surplus_duplicates", "SELECT count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS surplus FROM lineitem")
def ag15(t: Tables) -> DataFrame:
    return t.lineitem.agg((F.count("*") - F.countDistinct("l_partkey", "l_suppkey")).alias("surplus"))


@query("ag16_collapse_repeats", """WITH c AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1), flag AS (SELECT bool_or(kinds > 5) AS bad FROM c),
 r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r, flag WHERE bad OR rn = 1""")  # fmt: skip
def ag16(t: Tables) -> DataFrame:
    kinds = t.orders.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds"))
    flag = kinds.agg(F.bool_or(C("kinds") > 5).alias("bad"))
    w = W.partitionBy("o_custkey").orderBy(C("o_orderdate").desc_nulls_last(), C("o_orderkey").desc())
    return t.orders.withColumn("rn", F.row_number().over(w)).crossJoin(F.broadcast(flag)).where("bad or rn = 1").select("o_custkey", "o_orderkey")


_TALL = "max(CASE WHEN event_type = '{0}' THEN value END) AS {0}"


@query("ag17_tall_to_wide", f"SELECT user_id, {', '.join(_TALL.format(x) for x in ('click', 'purchase', 'view'))} FROM events GROUP BY 1")
def ag17(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(*(F.max(F.when(C("event_type") == x, C("value"))).alias(x) for x in ("click", "purchase", "view")))


@query("ag18_sum_if_both", "SELECT user_id, round((max(CASE WHEN event_type = 'click' THEN value END) + max(CASE WHEN event_type = 'view' THEN value END)) * 1000, 2) AS both FROM events GROUP BY 1")
def ag18(t: Tables) -> DataFrame:
    part = lambda x: F.max(F.when(C("event_type") == x, C("value")))
    return t.events.groupBy("user_id").agg(F.round((part("click") + part("view")) * 1000, 2).alias("both"))


@query("ag19_pivot", "SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS \"F\", count_if(o_orderstatus = 'O') AS \"O\", count_if(o_orderstatus = 'X') AS \"X\" FROM orders GROUP BY 1")
def ag19(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "X"]).agg(F.count("o_orderkey")).na.fill(0)


@query("ag20_nearest_percentile", "SELECT round(v, 6) AS cap FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i = floor(0.95 * (n - 1) + 0.5)")
def ag20(t: Tables) -> DataFrame:
    return S.nearest_percentile(t.orders, C("o_totalprice"), 0.95, "cap")


@query("ag21_quantiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1")
def ag21(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(*(F.round(F.percentile("o_totalprice", p), 4).alias(f"q{k}") for k, p in enumerate((0.25, 0.5, 0.75), 1)))


@query("ag22_any_value_skips_nulls", "SELECT l_suppkey, bool_or(l_tax > 0.07) AS taxed, max(l_shipmode_) AS mode, any_value(k) AS k FROM (SELECT l_suppkey, l_tax, l_returnflag AS l_shipmode_, CASE WHEN l_linenumber > 3 THEN l_suppkey END AS k FROM lineitem) GROUP BY 1")
def ag22(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("k", F.when(C("l_linenumber") > 3, C("l_suppkey")))
    return rows.groupBy("l_suppkey").agg(F.bool_or(C("l_tax") > 0.07).alias("taxed"), F.max("l_returnflag").alias("mode"), F.any_value("k", True).alias("k"))


@query("ag23_scalar_subqueries", "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders_, (SELECT max(o_totalprice) FROM orders) AS top")
def ag23(t: Tables) -> DataFrame:
    return t.customer.agg(F.count("*").alias("customers")).crossJoin(t.orders.agg(F.count("*").alias("orders_"), F.max("o_totalprice").alias("top")))


@query("ag24_group_by_all", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def ag24(t: Tables) -> DataFrame:
    t.lineitem.createOrReplaceTempView("docketry_lineitem")
    return t.spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM docketry_lineitem GROUP BY ALL")


@query("ag25_having_duplicates", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def ag25(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).where("n > 1")


@query("ag26_distinct_case", "SELECT count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS n FROM orders")
def ag26(t: Tables) -> DataFrame:
    return t.orders.agg(F.countDistinct(F.when(C("o_orderstatus") == "F", C("o_custkey"))).alias("n"))


@query("ag27_alias_reuse", "SELECT o_custkey, f, h, f + 0.5 * h AS w FROM (SELECT o_custkey, CAST(count_if(o_orderstatus = 'F') AS DOUBLE) AS f, CAST(count_if(o_orderstatus = 'P') AS DOUBLE) AS h FROM orders GROUP BY 1)")
def ag27(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count_if(C("o_orderstatus") == "F").cast("double").alias("f"), F.count_if(C("o_orderstatus") == "P").cast("double").alias("h"))
    return n.withColumn("w", C("f") + 0.5 * C("h"))


@query("ag28_renormalized_weights", """SELECT c_custkey, round(v / w, 2) AS score, round(w, 4) AS coverage FROM (SELECT c_custkey, coalesce(a * 0.6, 0) + coalesce(b * 0.4, 0) AS v, CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END AS w
 FROM (SELECT c_custkey, CAST(c_custkey % 100 AS DOUBLE) AS a, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS b FROM customer))""")
def ag28(t: Tables) -> DataFrame:
    k = C("c_custkey")
    score, cover = S.weighted({"a": (k % 100).cast("double"), "b": F.when(k % 2 == 0, (k % 50).cast("double"))}, {"a": 0.6, "b": 0.4})
    return t.customer.select("c_custkey", F.round(score, 2).alias("score"), F.round(cover, 4).alias("coverage"))


@query("ag29_string_join", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def ag29(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "; ").alias("segments"))


@query("ag30_global_scalars", "SELECT o_orderkey, CAST((SELECT max(year(o_orderdate)) FROM orders) - year(o_orderdate) AS INT) AS lag_ FROM orders")
def ag30(t: Tables) -> DataFrame:
    top = t.orders.agg(F.max(F.year("o_orderdate")).alias("top"))
    return t.orders.crossJoin(F.broadcast(top)).select("o_orderkey", (C("top") - F.year("o_orderdate")).alias("lag_"))


# --- windows, order, sets -------------------------------------------------------------------


@query("wn03_dense_index", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def wn03(t: Tables) -> DataFrame:
    return P.with_row_number(t.customer.select("c_custkey", "c_acctbal"), [C("c_acctbal").desc(), C("c_custkey")], name="rank").select("c_custkey", "rank")


@query("wn04_group_first_last", "SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def wn04(t: Tables) -> DataFrame:
    key = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.min(key)["o_orderkey"].alias("first"), F.max(key)["o_orderkey"].alias("last"))


@query("wn05_duplicate_flag", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1 AS duplicated FROM lineitem")
def wn05(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.count("*").over(W.partitionBy("l_orderkey", "l_partkey")) > 1).alias("duplicated"))


@query("wn06_margin", "SELECT n_regionkey, best, round(best - coalesce(second, 0), 6) AS margin FROM (SELECT n_regionkey, max(v) AS best, max(CASE WHEN rn = 2 THEN v END) AS second FROM (SELECT n_regionkey, n, v, row_number() OVER (PARTITION BY n_regionkey ORDER BY v DESC, n DESC) AS rn FROM (SELECT n_regionkey, n_nationkey AS n, round(max(c_acctbal), 2) AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)) GROUP BY 1)")
def wn06(t: Tables) -> DataFrame:
    v = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.round(F.max("c_acctbal"), 2).alias("v"))
    w = W.partitionBy("n_regionkey").orderBy(C("v").desc(), C("n_nationkey").desc())
    top = v.withColumns({"rn": F.row_number().over(w), "second": F.lead("v").over(w)}).where("rn = 1")
    return top.select("n_regionkey", C("v").alias("best"), F.round(C("v") - F.coalesce("second", F.lit(0.0)), 6).alias("margin"))


@query("so01_mixed_sort", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20")
def so01(t: Tables) -> DataFrame:
    return t.part.orderBy(C("p_size").desc_nulls_first(), "p_partkey").limit(20).select("p_partkey", "p_size")


@query("so02_desc_nulls_last", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id LIMIT 30")
def so02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").orderBy(C("quality").desc_nulls_last(), "doc_id").limit(30).select("doc_id", "quality")


@query("so03_clamped_limit", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100")
def so03(t: Tables) -> DataFrame:
    return t.customer.orderBy("c_custkey").limit(P.clamp(100_000, cap=100)).select("c_custkey")


@query("so04_unlimited", "SELECT c_custkey, c_name FROM customer")
def so04(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name")


@query("so05_head", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")
def so05(t: Tables) -> DataFrame:
    return t.supplier.orderBy(C("s_acctbal").desc(), "s_suppkey").limit(7).select("s_suppkey", "s_acctbal")


@query("so06_case_sort", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 25")
def so06(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.when(C("o_orderstatus") == "P", 0).when(C("o_orderstatus") == "F", 1).otherwise(2), C("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_orderstatus")


@query("so07_first_in_order", "SELECT DISTINCT ON (p_brand) p_brand, p_partkey FROM part ORDER BY p_brand, p_partkey")
def so07(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))


@query("se01_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def se01(t: Tables) -> DataFrame:
    return t.nation.select(C("n_name").alias("name")).unionByName(t.region.select(C("r_name").alias("name")))


@query("se02_union_by_name", "SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def se02(t: Tables) -> DataFrame:
    a = t.supplier.select(C("s_suppkey").alias("id"), C("s_acctbal").alias("balance"))
    return a.unionByName(t.customer.select(C("c_custkey").alias("id"), C("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("se03_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def se03(t: Tables) -> DataFrame:
    return t.customer.select(C("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("se04_facets", "SELECT DISTINCT c_mktsegment FROM customer")
def se04(t: Tables) -> DataFrame:
    return t.customer.select("c_mktsegment").distinct()


@query("se05_key_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def se05(t: Tables) -> DataFrame:
    return t.customer.select(C("c_custkey").alias("k")).distinct().join(t.orders, C("k") == C("o_custkey"), "left_anti")


# --- scalar functions -----------------------------------------------------------------------


@query("fn01_canonical_status", "SELECT o_orderkey, regexp_replace(upper(regexp_replace(CASE o_orderstatus WHEN 'F' THEN chr(9) || ' Certified - Withdrawn ' WHEN 'P' THEN NULL ELSE 'denied' END, '^\\s+|\\s+$', '', 'g')), '\\s*-\\s*', '-', 'g') AS s FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, '' FROM orders WHERE o_orderstatus = 'P'")
def fn01(t: Tables) -> DataFrame:
    raw = F.when(C("o_orderstatus") == "F", "\t Certified - Withdrawn ").when(C("o_orderstatus") == "P", None).otherwise("denied")
    return t.orders.select("o_orderkey", S.canonical_status(raw).alias("s"))


@query("fn05_legal_suffix", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'LLC' WHEN s_suppkey % 3 = 1 THEN 'INC' ELSE '' END AS suffix FROM supplier")
def fn05(t: Tables) -> DataFrame:
    from docketry.functions.names import legal_suffix

    k = C("s_suppkey") % 3
    name = F.concat(F.lit("ACME "), C("s_suppkey").cast("string"), F.when(k == 0, " LLC").when(k == 1, " INC").otherwise(" PARTNERS"))
    return t.supplier.select("s_suppkey", legal_suffix(name).alias("suffix"))


@query("fn06_acronym", "SELECT DISTINCT p_type, array_to_string(list_transform(list_filter(string_split(p_type, ' '), lambda x: x NOT IN ('OF', 'AND', 'THE', '')), lambda x: x[1]), '') AS acronym FROM part")
def fn06(t: Tables) -> DataFrame:
    from docketry.functions.names import acronym

    return t.part.select("p_type", acronym(C("p_type")).alias("acronym")).distinct()


@query("fn07_normalize_place", "SELECT s_suppkey, trim(regexp_replace(upper(s_name), '[^A-Z0-9]+', ' ', 'g')) AS city, substr(upper(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')), 1, 5) AS postal FROM supplier")
def fn07(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", S.normalize_city(C("s_name")).alias("city"), S.normalize_postal(C("s_name")).alias("postal"))


@query("fn09_soc_code", "SELECT p_partkey, regexp_extract('SOC ' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-1252.00 X', '\\d{2}-\\d{4}(\\.\\d{2})?', 0) AS soc FROM part")
def fn09(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("SOC "), S.zfill(C("p_size").cast("string"), 2), F.lit("-1252.00 X"))
    return t.part.select("p_partkey", F.regexp_extract(raw, r"\d{2}-\d{4}(\.\d{2})?", 0).alias("soc"))


@query("fn10_stable_id", "SELECT c_custkey, 'org_' || substr(sha256(c_name || chr(31) || coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, '')), 1, 20) AS id FROM customer")
def fn10(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.stable_id("org", C("c_name"), F.when(C("c_custkey") % 2 == 0, C("c_mktsegment"))).alias("id"))


@query("fn11_hash_ids", "SELECT s_suppkey, substr(sha256(s_name || '|' || s_nationkey), 1, 24) AS a, substr(sha256(s_name), 1, 32) AS b FROM supplier")
def fn11(t: Tables) -> DataFrame:
    both = F.concat("s_name", F.lit("|"), C("s_nationkey").cast("string"))
    return t.supplier.select("s_suppkey", F.substring(F.sha2(both, 256), 1, 24).alias("a"), F.substring(F.sha2("s_name", 256), 1, 32).alias("b"))


@query("fn12_zfill", "SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 4 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS z FROM orders")
def fn12(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.zfill(C("o_orderkey").cast("string"), 4).alias("z"))


@query("fn13_text_tests", "SELECT p_partkey, starts_with(p_type, 'S') AS a, contains(p_name, 'a') AS b, upper(p_name) AS u, substr(p_brand, 1, 4) AS y FROM part")
def fn13(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", C("p_type").startswith("S").alias("a"), C("p_name").contains("a").alias("b"), F.upper("p_name").alias("u"), F.substring("p_brand", 1, 4).alias("y"))


@query("fn14_ilike", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%USTOMER%1_'")
def fn14(t: Tables) -> DataFrame:
    return t.customer.where(C("c_name").ilike("%USTOMER%1_")).select("c_custkey")


@query("fn15_null_concat", "SELECT doc_id, 'Q' || CAST(quality AS VARCHAR) || '/' || CAST(CASE WHEN toxic = 0 THEN 0 END AS VARCHAR) AS s FROM labels")
def fn15(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", F.concat(F.lit("Q"), C("quality").cast("string"), F.lit("/"), F.when(C("toxic") == 0, F.lit(0)).cast("string")).alias("s"))


@query("fn16_host", "SELECT page_id, nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', ''), '\\.$', ''), '') AS host FROM pages")
def fn16(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.host_of(C("url")).alias("host"))


@query("fn17_official_domain", "SELECT page_id, url LIKE 'https://%' AND (regexp_extract(url, '://([^/?#:]*)', 1) = 'example.org' OR regexp_extract(url, '://([^/?#:]*)', 1) LIKE '%.example.org') AS official FROM pages")
def fn17(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.is_official(C("url"), F.lit("example.org")).alias("official"))


@query("fn19_injection_screen", "SELECT doc_id, regexp_matches(lower(substr(text, 1, 500000)), 'ignore (all|any) previous|system prompt|you are now|disregard the above') AS flagged FROM documents")
def fn19(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.lower(F.substring("text", 1, 500000)).rlike("ignore (all|any) previous|system prompt|you are now|disregard the above").alias("flagged"))


@query("fn22_stars", "SELECT p_partkey, repeat('★', p_size % 6) || repeat('☆', 5 - p_size % 6) AS stars FROM part")
def fn22(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.stars((C("p_size") % 6).cast("int")).alias("stars"))


@query("fn23_clean_numeric", "SELECT c_custkey, TRY_CAST(regexp_replace('$1,' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '.5' END, '[,$]', '', 'g') AS DOUBLE) AS v FROM customer")
def fn23(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("$1,"), S.zfill((C("c_custkey") % 1000).cast("string"), 3), F.when(C("c_custkey") % 5 == 0, "x").otherwise(".5"))
    return t.customer.select("c_custkey", S.try_number(raw).alias("v"))


@query("fn24_log_score", "SELECT p_partkey, round(least(100.0, greatest(0.0, ln(1 + CAST(p_size AS DOUBLE)) / ln(1 + 40.0) * 100)), 6) AS score FROM part")
def fn24(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(S.log_score(C("p_size"), F.lit(40.0)), 6).alias("score"))


@query("fn25_clip_keeps_null", "SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN least(greatest(quality * 3, 1), 2) END AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def fn25(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", S.clip(C("quality") * 3, 1, 2).alias("c"))


@query("fn26_round", "SELECT o_orderkey, round(o_totalprice / 7, 3) AS r FROM orders")
def fn26(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(C("o_totalprice") / 7, 3).alias("r"))


@query("fn27_horizontal", "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS hi, round(coalesce(CASE WHEN l_linenumber > 2 THEN l_discount END, 0) + l_tax, 4) AS s, l_discount > 0.05 AND l_tax > 0.05 AS both, l_discount > 0.05 OR l_tax > 0.05 AS one FROM lineitem")
def fn27(t: Tables) -> DataFrame:
    d, x = C("l_discount"), C("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.greatest(d, x).alias("hi"), F.round(S.sum_across([F.when(C("l_linenumber") > 2, d), x]), 4).alias("s"), ((d > 0.05) & (x > 0.05)).alias("both"), ((d > 0.05) | (x > 0.05)).alias("one"))


@query("fn28_parse_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def fn28(t: Tables) -> DataFrame:
    k = C("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return t.orders.select("o_orderkey", S.try_date(raw).alias("d"))


@query("fn29_fiscal_period", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS fy, CAST(floor(((month(o_orderdate) + 2) % 12) / 3) + 1 AS INT) AS fq FROM orders")
def fn29(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.fiscal_year(C("o_orderdate")).alias("fy"), S.fiscal_quarter(C("o_orderdate")).alias("fq"))


@query("fn30_recency", "SELECT o_orderkey, CASE greatest(2000 - year(o_orderdate), 0) WHEN 0 THEN 100.0 WHEN 1 THEN 75.0 WHEN 2 THEN 50.0 WHEN 3 THEN 25.0 ELSE 0.0 END AS r FROM orders")
def fn30(t: Tables) -> DataFrame:
    from docketry.operators.scoring import recency

    return t.orders.select("o_orderkey", recency(F.year("o_orderdate"), F.lit(2000), F.lit(None).cast("int")).alias("r"))


@query("fn33_map_replace", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' ELSE 'other' END AS area FROM nation")
def fn33(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", P.replace_strict(C("n_regionkey"), {0: "south", 1: "west"}, "other").alias("area"))


@query("fn34_list_membership", "SELECT s_suppkey, list_contains(['AL', 'CA', CASE WHEN s_suppkey % 2 = 0 THEN 'NY' ELSE 'TX' END], 'NY') AS here FROM supplier")
def fn34(t: Tables) -> DataFrame:
    sites = F.concat(F.lit(" al, CA ,"), F.when(C("s_suppkey") % 2 == 0, "ny").otherwise("tx"))
    return t.supplier.select("s_suppkey", F.array_contains(F.transform(F.split(sites, ","), lambda x: F.upper(F.trim(x))), "NY").alias("here"))

