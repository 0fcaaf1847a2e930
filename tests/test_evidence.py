"""Edge cases of names, addresses, dates, histories, scores, views and the gate."""

import pytest
from docketry.functions import names as N
from docketry.operators import evidence as E
from docketry.operators import evidence_scores as X
from docketry.operators import history as H
from docketry.operators import reports as R
from docketry.operators import views as V
from pyspark.sql import functions as F


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_names(spark):
    assert one(spark, N.normalize_state, ["tx", "West Virginia", "MASSACHUSETTS MASSACHUSETTS", "North Carolina Watauga County", "Québec", "", None, "Washington, D.C."]) == ["TX", "WV", "MA", "NC", "", "", "", "WA"]
    assert one(spark, N.normalize_title, ["  Ingénieur—II ", None, "++"]) == ["INGENIEUR II", "", ""]
    assert one(spark, N.evidence_text, ["ﬁne  “X”\n Straße", "A\x1cB", "", None]) == ['fine "x" strasse', "a b", "", None]
    assert one(spark, lambda c: N.stable_identity(c, True), ["2139", "02139", "213", "１２３４", None]) == ["02139", "02139", "213", "１２３４", ""]
    assert one(spark, N.stable_identity, ["SchÃ¶n–Co", " schön  co"]) == ["schönco", "schön co"]


def test_addresses(spark):
    urls = ["https://x.edu/H_1B/Green_Card", "https://x.edu/perm", "https://x.edu/about", None]
    assert one(spark, E.url_score, urls) == [2, 1, 0, None]
    assert one(spark, E.document_type, urls) == ["international_scholar_policy", "perm_guidance", "international_scholar_policy", "international_scholar_policy"]
    xml = "<urlset><url><loc> https://x.edu/perm </loc></url><url><loc/></url></urlset>"
    index = "<sitemapindex><sitemap><loc>https://x.edu/s.xml</loc></sitemap></sitemapindex>"
    df = spark.createDataFrame([("a", xml), ("a", xml), ("b", index), ("c", "<!doctype x>" + xml), ("d", "<urlset>"), ("e", None)], "site string, content string")
    got = E.sitemap_locations(df)
    assert {r["site"]: (r["pages"], r["children"]) for r in got.collect()} == {"a": (["https://x.edu/perm"], []), "b": ([], ["https://x.edu/s.xml"]), "c": ([], []), "d": ([], []), "e": ([], [])}
    assert [(r["site"], r["rank"], r["title"]) for r in E.policy_pages(got).collect()] == [("a", 1, "perm")]


def test_dates(spark):
    # 548 days before the first of July 2025 is the last day of 2023; only the first date counts
    said = ["D:20240115", "2024-02-30", "updated 2023/12/31 and 2020-01-01", "updated 2023/12/30 and 2025-01-01", "1999-01-01", "2024-13-01", "", None]
    assert one(spark, lambda c: E.is_current(c, F.lit("2025-07-01")), said) == [True, False, True, False, False, False, False, False]


def test_match_evaluation(spark):
    lookups = spark.createDataFrame([(i, "Acme, Inc.", s) for i, s in ((1, "TX"), (2, "TX"), (3, None), (4, ""), (5, "TX"), (6, "TX"))], "lookup_id int, queried_name string, state string")
    rows = [
        (1, 2, "ACME INC", None, "ca, tx", "Open"), (1, 1, "Acme Inc", None, "TX", "Terminated"), (2, 1, "ACME INC", None, "CA", "Open"), (3, 1, "Other", "Acme Inc", None, "TERMINATED"), (4, 1, "Acme Holdings", None, "TX", "Open"),
        (6, 1, "ACME INC", None, "TX", None),
    ]
    results = spark.createDataFrame(rows, "lookup_id int, position int, employer string, dba string, locations string, account_status string")
    got = {r["lookup_id"]: (r["status"], r["match_method"], r["confidence"]) for r in E.evaluate_matches(lookups, results).collect()}
    assert got == {
        1: ("CONFIRMED_ACTIVE", "EXACT_EMPLOYER_NAME", 1.0), 2: ("AMBIGUOUS", "EXACT_EMPLOYER_NAME", 0.0), 3: ("CONFIRMED_INACTIVE", "EXACT_DBA_NAME", 0.98), 4: ("AMBIGUOUS", "SUBSTRING_RESULTS_ONLY", 0.0),
        5: ("NO_MATCH", "NO_RESULTS", 0.0), 6: ("AMBIGUOUS", "EXACT_EMPLOYER_NAME", 0.0),
    }


def test_too_few_candidates_raise(spark):
    names = "institution_id string, official_name string, official_domain string, control string, relevant_lca_count int, relevant_certified_perm_count int, last_lca_activity_year int, last_perm_activity_year int, last_uscis_activity_year int, total_rd double, computing_rd double, engineering_rd double, known_opt_observation string, everify_status string"
    df = spark.createDataFrame([("a", "A", "a.edu", None, 1, 0, 2024, None, None, 1.0, None, None, None, None)], names)
    with pytest.raises(ValueError):
        E.rank_candidates(df, 100)
    with pytest.raises(Exception, match="too few eligible"):
        E.rank_candidates(df, 150).collect()


CASE = "case_id string, source_artifact_id string, source_row_number long, fiscal_year int, case_status string, decision_date date, employer_name_raw string, employer_postal_code string"


def cases(spark, *rows):
    df = spark.createDataFrame([(*r[:5], None, *r[6:]) for r in rows], CASE)
    days = spark.createDataFrame([(r[0], r[1], r[2], r[5]) for r in rows], "case_id string, source_artifact_id string, source_row_number long, day string")
    return df.join(days, ["case_id", "source_artifact_id", "source_row_number"]).withColumn("decision_date", F.to_date("day")).drop("day")


A, B = ("c1", "a", 1, 2023, "Certified", "2023-01-01", "Acme–", "2139"), ("c1", "b", 9, 2024, "Certified - Withdrawn", "2024-01-01", "ACME", "02139")


def test_supersession(spark):
    rows = cases(spark, A, B, ("c2", "a", 2, 2023, "Denied", "2023-01-01", "X", None))
    ledger = H.superseded(rows)
    assert [(r["source_artifact_id"], r["source_row_number"], r["superseding_fiscal_year"]) for r in ledger.collect()] == [("a", 1, 2024)]
    active = H.without_superseded(rows, ledger)
    assert active.count() == 2 and H.ledger_audit(rows, ledger, active).first()["passed"]
    assert not H.ledger_audit(rows, ledger, rows).first()["passed"]
    assert H.superseded(rows.limit(0)).count() == 0


@pytest.mark.parametrize("later", [(*B[:6], "Other", B[7]), (*B[:5], "2023-01-01", *B[6:]), (*B[:4], "Certified", *B[5:]), ("c1", "a", *B[2:]), (*B[:7], "99999")])
def test_other_repeats_raise(spark, later):
    with pytest.raises(H.DataQuality):
        H.superseded(cases(spark, A, later))


def test_three_rows_raise(spark):
    with pytest.raises(H.DataQuality):
        H.superseded(cases(spark, A, B, ("c1", "c", 3, 2024, "Certified - Withdrawn", "2024-02-01", "ACME", "02139")))


def test_active_artifacts_fail_closed(spark):
    key = ("s", "u", 2024, None, False, False, 1, "f", "p", "v")
    kinds = "source_id string, download_url string, fiscal_year int, fiscal_quarter int, is_partial_period boolean, is_quarter_partition boolean, coverage_start_quarter int, file_name string, parser_version string, schema_version string"
    record = lambda *rows: spark.createDataFrame([(*key, *r) for r in rows], kinds + ", source_artifact_id string, retrieved_at string, validation_status string, available boolean")
    chosen = spark.createDataFrame([key], kinds)
    assert H.active_artifacts(chosen, record(("old", "1", "FAILED", False), ("new", "2", "PASSED", True))).first()["source_artifact_id"] == "new"
    for rows in ([("old", "1", "PASSED", True), ("new", "2", "FAILED", True)], [("old", "1", "PASSED", True), ("new", "2", "PASSED", False)]):
        with pytest.raises(H.DataQuality):
            H.active_artifacts(chosen, record(*rows))
    with pytest.raises(H.DataQuality):
        H.active_artifacts(chosen, record(("x", "1", "PASSED", True)).limit(0))
    with pytest.raises(H.DataQuality):
        H.active_artifacts(chosen.unionByName(chosen), record(("x", "1", "PASSED", True)))


def test_cohort_grain(spark):
    df = spark.createDataFrame([("a", 2023), ("a", 2024), (None, 2024), (None, 2024)], "k string, y int")
    assert H.latest_cohort(df, "k", "y").count() == 3
    with pytest.raises(ValueError):
        H.latest_cohort(df.unionByName(df.where("k = 'a'")), "k", "y")


def test_reviews_need_evidence_and_a_reviewer(spark):
    facts = spark.createDataFrame([("f", "YES", "NEEDS_REVIEW", None, True, None, True, "https://x", "said")], "policy_fact_id string, fact_value string, human_review_status string, reviewer_note string, is_current boolean, valid_to string, exact_excerpt_verified boolean, source_url string, supporting_excerpt string")
    decide = lambda status, who: spark.createDataFrame([("f", status, None, None, "2024-01-01", who)], "policy_fact_id string, human_review_status string, reviewer_note string, current_confirmed boolean, reviewed_at string, reviewer_id string")
    assert H.apply_reviews(facts, decide("REVIEWED_ACCEPTED", "r")).first()["human_review_status"] == "REVIEWED_ACCEPTED"
    for bad in (decide("REVIEWED_ACCEPTED", " "), decide("REVIEWED_NOT_STATED", "r")):
        with pytest.raises(H.DataQuality):
            H.apply_reviews(facts, bad)
    with pytest.raises(H.DataQuality):
        H.apply_reviews(facts.withColumn("source_url", F.lit("http://x")), decide("REVIEWED_ACCEPTED", "r"))


def test_canonical_files_raise(spark):
    rows = lambda *r: spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "candidate_id int, fiscal_year int, variant string, fiscal_quarter int, download_url string")
    assert [r["candidate_id"] for r in R.canonical_files(rows((2024, "v", 2, "u"), (2024, "v", 1, "u"))).collect()] == [0]
    assert [r["candidate_id"] for r in R.canonical_files(rows((2024, "v", None, "B"), (2024, "v", None, "a"), (2024, "v", 4, "a"))).collect()] == [1]
    with pytest.raises(H.DataQuality):
        R.canonical_files(rows((2023, "v", 2, "u"), (2024, "v", 1, "u")))
    segments = spark.createDataFrame([(2023, 1, 2), (2023, 3, 4)], "fiscal_year int, first int, last int")
    with pytest.raises(H.DataQuality):  # no file of the second segment
        R.canonical_files(rows((2023, "v", 2, "u"), (2024, "v", 1, "u")), segments)
    with pytest.raises(H.DataQuality):  # segments that leave a quarter out
        R.canonical_files(rows((2023, "v", 4, "u"), (2024, "v", 1, "u")), segments.where("first = 1"))


def test_configurations():
    assert X.config_problems(X.EvidenceConfig()) == []
    with pytest.raises(ValueError, match="strictly ordered"):
        X.EvidenceConfig(confidence_bands=(("HIGH", 0.5), ("LOW", 0.6)))


def test_views_need_their_tables(spark):
    with pytest.raises(ValueError, match="missing"):
        V.views(spark, {})
    assert V.optional_table(spark, {}, "policy_facts").count() == 0
    partly = spark.createDataFrame([("f",)], "policy_fact_id string")
    assert dict(V.optional_table(spark, {"policy_facts": partly}, "policy_facts").dtypes)["confidence"] == "double"


def test_gate_without_tables_fails(spark):
    checks = {r["check_id"]: r["status"] for r in R.quality_checks({"data_health": spark.range(5)}, {"data_health": ["id"], "legal_entities": ["x"]}, "m", "s").collect()}
    assert len(checks) == 12 and checks["source_freshness"] == "PASS" and checks["required_columns"] == "PASS"
    assert {k for k, v in checks.items() if v == "FAIL"} == {"required_processed_tables", "source_manifest", "schema_reports", "entity_match_coverage", "role_classification_coverage", "score_contract"}


def test_service(spark, sf_dir):
    from docketry.operators.presentation import FRAMES, Presentation, Unavailable
    from docketry.operators.service import Filters
    from docketry.plans.local import Tables
    from docketry.plans.presentation import service

    s = service(Tables(spark, sf_dir))
    frames = s.detail(7)
    assert tuple(frames) == FRAMES and frames["summary"].count() == 1 and s.detail(-1) is None
    for call in (lambda: s.compare(range(6)), lambda: s.employers(sort="stars"), lambda: Presentation(spark, {**s.views, "vw_data_health": spark.range(1)}, s.tables)):
        with pytest.raises(ValueError):
            call()
    assert s.employers(limit=-3).count() == 1 and s.employers(limit=None).count() == s.export_employers(Filters()).count() == s.views["vw_employer_explorer"].count()
    assert s.search("  ").count() == 0 and s.compare([" "]).count() == 0
    assert s.supporting_cases(8).where("source_id = 'dol_lca'").count() == 0  # its first history is unrated
    assert {r["facet"] for r in s.facets("employers", ["segment", "state"]).collect()} == {"segment", "state"}
    assert Unavailable(spark).detail(7) is None


def test_policy_scores_do_not_depend_on_the_order_of_facts(spark):
    from itertools import combinations, product

    config = X.EvidenceConfig()
    w, values = config.weights["policy_support"], config.policy_values

    def score(facts):
        v = n = 0.0
        for k, x in facts:
            v, n = v + w[k] * float(values[k][x]), n + w[k]
        return int(v / n * 100) / 100 if v / n * 100 % 1 < 0.5 else (int(v / n * 100) + 1) / 100

    kinds, want, rows = list(reversed(w)), {}, []
    for chosen in combinations(kinds, 4):
        for said in product(("YES", "LIMITED", "NO"), repeat=4):
            facts = list(zip(chosen, said, strict=True))
            if score(facts) != score(facts[::-1]):
                i = f"i{len(want)}"
                want[i] = score(facts)
                rows += [(i, k, x, "REVIEWED_ACCEPTED", True, True, None, "https://x", "1") for k, x in facts]
    assert len(want) > 20
    facts = spark.createDataFrame(rows, "institution_id string, fact_type string, fact_value string, human_review_status string, exact_excerpt_verified boolean, is_current boolean, valid_to string, source_url string, valid_from string")
    ids = spark.createDataFrame([(i,) for i in want], "institution_id string")
    assert {r["institution_id"]: r["policy_support_score"] for r in X.policy(ids, facts, config).collect()} == want
