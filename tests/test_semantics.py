"""Null rules, status table, star edges, raising checks."""

import pytest
from docketry.functions import names as N
from docketry.functions import semantics as S
from docketry.operators.metrics import program_metrics
from docketry.operators.scoring import ScoreConfig, rating_of, score_organizations
from pyspark.sql import functions as F


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_status_table(spark):
    table = {"Certified - Withdrawn": "CERTIFIED-WITHDRAWN", " certified-withdrawn ": "CERTIFIED-WITHDRAWN", "CeRtIfIeD- ExPiReD": "CERTIFIED-EXPIRED", "Withdrawn": "WITHDRAWN", "Certified Withdrawn": "CERTIFIED WITHDRAWN", "Not Certified - Withdrawn": "NOT CERTIFIED-WITHDRAWN", None: "", "\tDenied\n": "DENIED"}
    got = values(spark, [(k,) for k in table], "s string", S.canonical_status(F.col("s")))
    assert [g[0] for g in got] == list(table.values())


def test_program_metrics_golden(spark):
    rows = [("a", "Certified", True, 2025, False, "x"), ("a", "Certified - Withdrawn", True, 2026, True, "y"), ("a", "Certified", None, 2025, False, "x"), ("a", "Denied", True, 2025, False, "x"), ("a", "Certified", False, 2025, False, "x"), ("b", "Certified", True, 2025, False, "x")]
    df = spark.createDataFrame(rows, "legal_entity_id string, case_status string, technical_role boolean, fiscal_year int, is_partial_period boolean, role_family string").withColumn("parent_id", F.lit("p"))
    got = {r["organization_id"]: r for r in program_metrics(df, "x", "CERTIFIED", "CERTIFIED-WITHDRAWN", F.col("technical_role")).collect()}
    assert (got["a"]["x_case_count"], got["a"]["x_full_count"], got["a"]["x_half_count"], got["a"]["weighted_x_count"]) == (5, 1, 1, 1.5)
    assert (got["a"]["x_active_years"], got["a"]["x_complete_active_years"], got["a"]["last_x_year"], got["a"]["x_family_count"]) == (2, 1, 2026, 2)
    assert got["b"]["weighted_x_count"] == 1 and got["p"]["weighted_x_count"] == 2.5 and got["p"]["x_full_count"] == 2


def test_star_edges(spark):
    got = values(spark, [(x,) for x in (100.0, 80.0, 79.999, 65.0, 45.0, 25.0, 0.1, 0.0, None)], "s double", rating_of(F.col("s"), ScoreConfig()))
    assert [g[0] for g in got] == [5, 5, 4, 4, 3, 2, 1, None, None]


SCORE = "organization_id string, identity_scope string, first_valid boolean, second_valid boolean, approvals_valid boolean, weighted_first_count double, weighted_second_count double, approvals long, first_complete_active_years int, second_complete_active_years int, first_complete_years int, second_complete_years int, last_first_year int, last_second_year int, first_family_count int, second_family_count int, latest_complete_year int, partial_year int"


def test_zero_is_not_unrated(spark):
    base = ("LEGAL_ENTITY",)
    rows = [("seen", *base, True, True, True, 100.0, 50.0, 80, 3, 3, 4, 4, 2025, 2025, 3, 2, 2025, 2026), ("zero", *base, True, True, True, 0.0, 0.0, 0, 0, 0, 4, 4, None, None, 0, 0, 2025, 2026), ("open", *base, False, False, True, 5.0, 5.0, 5, 1, 1, 4, 4, 2025, 2025, 1, 1, 2025, 2026), ("uscis", *base, True, True, False, 10.0, 0.0, 5, 1, 1, 4, 4, 2025, None, 1, 0, 2025, 2026)]
    got = {r["organization_id"]: r for r in score_organizations(spark.createDataFrame(rows, SCORE)).collect()}
    assert got["seen"]["first_status"] == "RATED" and got["seen"]["first_cap"] == 100 and got["seen"]["second_cap"] == 50
    assert (got["zero"]["first_score"], got["zero"]["first_status"], got["zero"]["first_rating"]) == (0.0, "NO_OBSERVED_HISTORY", None)
    assert (got["open"]["first_score"], got["open"]["first_status"], got["open"]["first_stars"]) == (None, "UNRATED", "Unrated")
    assert got["uscis"]["first_coverage"] == 0.95 and got["uscis"]["first_status"] == "RATED"
    parent = [*rows, ("big", "PARENT_ROLLUP", True, True, True, 1e6, 1e6, 10**6, 4, 4, 4, 4, 2025, 2025, 5, 5, 2025, 2026)]
    again = {r["organization_id"]: r["first_cap"] for r in score_organizations(spark.createDataFrame(parent, SCORE)).collect()}
    assert set(again.values()) == {100.0}


def test_config_fails_closed():
    with pytest.raises(ValueError):
        ScoreConfig(overall={"first": 0.5, "second": 0.6})
    with pytest.raises(ValueError):
        ScoreConfig(bands=((5, 10), (4, 65), (3, 45), (2, 25), (1, 0)))


def test_unique_assertions(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(S.NotUnique):
        S.assert_unique(df, ["k"])
    with pytest.raises(S.NotUnique):
        S.checked_join(df, df, ["k"])


def test_null_rules(spark):
    got = values(spark, [(None,), (5,), (-1,)], "x int", S.clip(F.col("x"), 0, 3), S.sum_across([F.col("x"), F.lit(1)]))
    assert got == [(None, 1.0), (3, 6.0), (0, 0.0)]
    empty = spark.createDataFrame([], "x int, b boolean").agg(S.sum0("x").alias("s"), S.any0("b").alias("a")).first()
    assert tuple(empty) == (0, False)
    assert S.nearest_percentile(spark.createDataFrame([(0.0,), (100.0,)], "v double"), F.col("v"), 0.95, "c").first()["c"] == 100
    assert S.nearest_percentile(spark.createDataFrame([], "v double"), F.col("v"), 0.95, "c").first()["c"] == 0


def test_names(spark):
    n = N.normalize_name(F.col("s"))
    got = values(spark, [("  Acmé Tech., Inc.  ",), ("The Foo & Bar Co",), ("LLC INC",), (None,)], "s string", n, N.core_name(n), N.legal_suffix(n))
    assert got == [("ACME TECHNOLOGY INC", "ACME TECHNOLOGY", "INC"), ("THE FOO AND BAR COMPANY", "FOO AND BAR", "COMPANY"), ("LLC INC", "", "INC"), ("", "", "")]
