"""The local tables in the roles of case, identity and evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.semantics import fiscal_quarter, fiscal_year
from docketry.plans.registry import register


class Tables:
    """The tables of one folder as attributes; each read prunes to the columns used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables."""

    def add(f):
        register(name, sql)(lambda spark, sf_dir: f(Tables(spark, sf_dir)))
        return f

    return add


#: Customers as legal entities, their nations as parents; the parents of one nation are unknown.
ENTITIES = """entities AS (
  SELECT c_custkey AS legal_entity_id, CASE WHEN c_nationkey = 7 THEN NULL ELSE CAST(c_nationkey AS BIGINT) + 1000000000 END AS parent_id,
         c_name AS legal_name, n_name AS state, c_mktsegment AS segment, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

_FY = "CAST(year({d}) AS INT) + CASE WHEN month({d}) >= 10 THEN 1 ELSE 0 END"

#: Orders as cases of the first program, lines as cases of the second.
FIRST = f"""first_cases AS (
  SELECT o_orderkey AS case_id, legal_entity_id, parent_id, state,
         CASE o_orderstatus WHEN 'F' THEN 'CERTIFIED' WHEN 'P' THEN 'CERTIFIED-WITHDRAWN' ELSE 'DENIED' END AS status,
         CAST(o_orderdate AS DATE) AS decision_date, {_FY.format(d="o_orderdate")} AS fiscal_year,
         ({_FY.format(d="o_orderdate")}) > 2000 AS is_partial_period,
         o_orderpriority AS role_family, o_totalprice AS wage,
         CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN NULL ELSE substr(o_orderpriority, 1, 1) NOT IN ('4', '5') END AS technical
  FROM orders JOIN entities ON o_custkey = legal_entity_id)"""

SECOND = f"""second_cases AS (
  SELECT l_orderkey * 10 + l_linenumber AS case_id, legal_entity_id, parent_id, state,
         CASE l_returnflag WHEN 'A' THEN 'CERTIFIED' WHEN 'N' THEN 'CERTIFIED-EXPIRED' ELSE 'DENIED' END AS status,
         {_FY.format(d="l_shipdate")} AS fiscal_year, ({_FY.format(d="l_shipdate")}) > 2000 AS is_partial_period,
         l_linestatus AS role_family, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber <> 3 END AS technical
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN entities ON o_custkey = legal_entity_id)"""


def entities(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", F.col("n_name").alias("state"))
    parent = F.when(F.col("c_nationkey") == 7, None).otherwise(F.col("c_nationkey").cast("long") + 1_000_000_000)
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("legal_entity_id"), parent.alias("parent_id"), F.col("c_name").alias("legal_name"), "state", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )


def first_cases(t: Tables) -> DataFrame:
    """Orders as cases, with statuses in their raw spellings."""
    status = F.when(F.col("o_orderstatus") == "F", " Certified ").when(F.col("o_orderstatus") == "P", "Certified - Withdrawn").otherwise("Denied")
    kind = F.substring("o_orderpriority", 1, 1)
    year = fiscal_year(F.col("o_orderdate"))
    return t.orders.join(entities(t), F.col("o_custkey") == F.col("legal_entity_id")).select(
        F.col("o_orderkey").alias("case_id"), "legal_entity_id", "parent_id", "state", status.alias("case_status"), F.col("o_orderdate").cast("date").alias("decision_date"),
        year.alias("fiscal_year"), fiscal_quarter(F.col("o_orderdate")).alias("fiscal_quarter"), (year > 2000).alias("is_partial_period"), F.col("o_orderpriority").alias("role_family"),
        F.col("o_totalprice").alias("wage"), F.when(kind == "3", None).otherwise(~kind.isin("4", "5")).alias("technical_role"),
    )


def second_cases(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "Certified").when(F.col("l_returnflag") == "N", "Certified - Expired").otherwise("Denied")
    year = fiscal_year(F.col("l_shipdate"))
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(entities(t), F.col("o_custkey") == F.col("legal_entity_id")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), "legal_entity_id", "parent_id", "state", status.alias("case_status"), year.alias("fiscal_year"),
        F.lit(None).cast("int").alias("fiscal_quarter"), (year > 2000).alias("is_partial_period"), F.col("l_linestatus").alias("role_family"), F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_linenumber") != 3).alias("technical_role"),
    )
