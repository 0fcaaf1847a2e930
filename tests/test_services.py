"""Classifier truth table, similarity definitions, explorer clamps and refusals."""

import pytest
from docketry.operators import quality, resolve
from docketry.operators.classify import Rule, Taxonomy, classify
from docketry.operators.projection import clamp
from docketry.operators.service import Explorer
from pyspark.sql import functions as F

TAXONOMY = Taxonomy(
    exact={"MANAGER JC50": (None, "ambiguous", 0.4)},
    exclusions=(Rule("biological", "not_relevant", 0.98, (r"\bBIOMEDICAL\b",)), Rule("sales", "not_relevant", 0.98, (r"\bSALES ENGINEER",)), Rule("postdoctoral", "not_relevant", 0.99, (r"\bPOSTDOC",)), Rule("faculty", "not_relevant", 0.99, (r"\bPROFESSOR\b",)), Rule("internships", "not_relevant", 0.95, (r"\bINTERN\b",))),
    codes=(Rule("software", "software_engineering", 0.96, prefixes=("15-1252",)), Rule("data", "data_science", 0.96, prefixes=("15-2051",))),
    titles=(Rule("hpc", "hpc", 0.96, (r"\bHPC ENGINEER\b",)), Rule("data_science", "data_science", 0.96, (r"\bDATA SCIENTIST",)), Rule("software", "software_engineering", 0.95, (r"\bSOFTWARE ENGINEER",))),
    combined=(Rule("eng", "research_engineering", 0.9, (r"\bCOMPUTATIONAL\b",), ("17-",)),),
    ambiguous=(r"^(RESEARCH SCIENTIST|ENGINEER)$",),
)


def test_truth_table(spark):
    table = [
        ("MANAGER JC50", "15-1252.00", None, "ambiguous", "EXACT_REVIEWED_TITLE"), ("COMPUTING SPECIALIST", "15-1252.00", True, "software_engineering", "SOC_MAPPING"), ("SOFTWARE ENGINEER INTERN", "15-1252.00", False, "not_relevant", "STRONG_EXCLUSION_PATTERN"),
        ("POSTDOC RESEARCH SOFTWARE ENGINEER", "15-1252.00", False, "not_relevant", "STRONG_EXCLUSION_PATTERN"), ("SALES ENGINEER", "15-1252.00", False, "not_relevant", "STRONG_EXCLUSION_PATTERN"), ("BIOMEDICAL DATA SCIENTIST", "15-2051.00", True, "data_science", "SOC_MAPPING"),
        ("HPC ENGINEER", None, True, "hpc", "STRONG_TITLE_PATTERN"), ("RESEARCH SCIENTIST COMPUTATIONAL", "17-2071.00", True, "research_engineering", "COMBINED_SOC_TITLE"), ("ENGINEER", None, None, "ambiguous", "NEEDS_REVIEW"), (None, None, None, "ambiguous", "NEEDS_REVIEW"), ("COOK", None, False, "not_relevant", "DEFAULT_NOT_RELEVANT"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(table)], "i int, title string, code string")
    got = {r["i"]: (r["technical_role"], r["role_family"], r["classification_method"]) for r in classify(df, TAXONOMY).collect()}
    assert [got[i] for i in range(len(table))] == [tuple(x[2:]) for x in table]


def test_similarity_definitions():
    assert resolve.ratio("", "") == 100 and resolve.ratio("abc", "") == 0 and resolve.ratio("abcd", "abxd") == 75
    assert resolve.token_set_ratio("a b", "b a c") == 100 and resolve.token_set_ratio("", "a") == 0


def test_decisions(spark):
    cols = "l_id string, r_id string, score double, location_agreement boolean"
    rows = [("a", "1", 0.98, True), ("b", "1", 0.98, True), ("b", "2", 0.97, True), ("c", "1", 0.98, False), ("d", "1", 0.85, True), ("e", "1", 0.5, True)]
    got = {r["id"]: (r["match_status"], r["margin"]) for r in resolve.decide(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": ("HIGH_CONFIDENCE_AUTO", 0.98), "b": ("REVIEW_REQUIRED", 0.01), "c": ("REVIEW_REQUIRED", 0.98), "d": ("REVIEW_REQUIRED", 0.85), "e": ("NEW_ENTITY", 0.5)}


def test_explorer_refuses(spark):
    assert clamp(None, 100) == 100 and clamp(-3, 100) == 1 and clamp(7, 100) == 7
    orgs = spark.createDataFrame([(1, "a", 1.0, 1)], "organization_id int, name string, score double, n int")
    aliases, cases = spark.createDataFrame([(1, "b")], "organization_id int, alias string"), spark.createDataFrame([(1, "x")], "organization_id int, role_family string")
    e = Explorer(orgs, aliases, cases)
    for ids in ([], [1] * 6):
        with pytest.raises(ValueError):
            e.compare(ids)
    with pytest.raises(ValueError):
        Explorer(orgs.drop("name"), aliases, cases)
    with pytest.raises(ValueError):
        from docketry.operators.service import Filters

        e.list(Filters(), "odd")
    assert F.col("x") is not None


def test_pairs_and_decisions_are_over_the_whole_table(spark, tmp_path):
    from docketry.plans import registry

    names = [(1, "Acme Labs", 3), (2, "Acme Labs Inc", 3), (3, "Acme Laboratories", 3), (4, "Borealis", 3), (5, "Acme Labs", 4), (7, "Borealis", 3), (9, "Solo", 9)]
    spark.createDataFrame(names, "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    pairs = registry.queries()["do09_pair_scores"](spark, str(tmp_path)).collect()
    want = {(a, b) for a, x, m in names for b, y, n in names if m == n and x[:5].upper() == y[:5].upper()}
    assert sorted((r["l_id"], r["r_id"]) for r in pairs) == sorted(want)
    score = {(r["l_id"], r["r_id"]): r["score"] for r in pairs}
    got = {r["id"]: r for r in registry.queries()["do12_resolution_decisions"](spark, str(tmp_path)).collect()}
    assert set(got) == {k for k, _, _ in names}
    for k, r in got.items():
        best = sorted(((v, b) for (a, b), v in score.items() if a == k), reverse=True)
        assert (r["score"], r["candidate_id"]) == best[0]
        assert r["margin"] == pytest.approx(best[0][0] - (best[1][0] if len(best) > 1 else 0), abs=1e-6)


def test_blocked_pairs_are_distinct_without_a_shuffle_of_pairs(spark, tmp_path):
    import oracle
    from docketry.plans import registry

    rows = [(1, 3, 10.5), (1, 3, 10.7), (1, 4, 900.0), (2, 3, 10.1), (3, 4, 901.0), (4, 3, 700.0), (5, 4, 10.9)]
    for table, c in (("supplier", "s"), ("customer", "c")):
        key = "suppkey" if c == "s" else "custkey"
        spark.createDataFrame(rows, f"{c}_{key} long, {c}_nationkey int, {c}_acctbal double").write.parquet(str(tmp_path / f"{table}.parquet"))
    query, sql = registry.queries()["jn15_blocked_candidates"], registry.oracle_sql()["jn15_blocked_candidates"]
    assert oracle.differences(spark, oracle.connection(str(tmp_path)), query, sql, str(tmp_path)) == ""
    plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.split("\n")[0].startswith("Aggregate")


def test_excerpts_of_any_length_are_found(spark):
    from docketry.plans.more import find_excerpts

    docs = [(1, "The  Quick brown\nfox’s den"), (2, "xthe quick brown foxy"), (3, None), (4, ""), (5, "no"), (5, "quick thing")]
    items = [(1, "the quick brown fox"), (2, "fox's"), (3, "n"), (4, None), (5, " "), (6, "k b"), (7, "quick  brown"), (8, "brown quick the fox")]
    fold = lambda t: " ".join((t or "").lower().replace("’", "'").split())
    want = {(i, k) for i, t in docs for k, x in items if fold(x) and fold(x) in fold(t)}
    got = find_excerpts(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(want)


def test_excerpts_fold_as_their_sql_does(spark, tmp_path):
    import oracle
    from docketry.plans import registry

    texts = ["Die Straße ﬁndet ΣΑΣ statt", "die strasse findet", "a\u00a0b c\x0bd \x1c e", "a b c d e", "\u3000ＡＢＣ ABC\u2003", "İstanbul i̇stanbul istanbul", "x ΣΑΣ\u2028", "“q” ‘r’  s\tt", None, " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = ["strasse", "straße", "fi", "ﬁ", "σας", "σασ", "a b", "c d", "abc", "ａｂｃ", "\u2003abc\u00a0", "istanbul", "i̇stanbul", '"Q" \'r\' s t', "\x1c", "\x0b", "\u2028", "", None]
    spark.createDataFrame(list(enumerate(words)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert oracle.differences(spark, oracle.connection(str(tmp_path)), registry.queries()["fn18_exact_excerpt"], registry.oracle_sql()["fn18_exact_excerpt"], str(tmp_path)) == ""


def test_the_entity_queue_is_counted_whole(spark, tmp_path):
    import os

    import oracle
    from docketry.plans import registry

    folder = "/root/testdata/sf0.001"
    for f in os.listdir(folder):
        os.symlink(f"{folder}/{f}", tmp_path / f)
    os.unlink(tmp_path / "supplier.parquet")
    spark.range(16_000).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "cast(id % 25 AS int) AS s_nationkey", "1.0D AS s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    assert oracle.differences(spark, oracle.connection(str(tmp_path)), registry.queries()["do49_review_queues"], registry.oracle_sql()["do49_review_queues"], str(tmp_path)) == ""


def resolution(spark, observations, entities, aliases=(), rejections=()):
    text = lambda names: ", ".join(f"{n} string" for n in names)
    place = ["normalized_name", "core_name", "acronym", "legal_suffix", "city", "state", "postal_code"]
    o = spark.createDataFrame(observations, f"{text(['observation_id', 'source_id', 'alias_raw'])}, occurrence_count long, {text(place)}")
    e = spark.createDataFrame(entities, text(["legal_entity_id", *place]))
    a = spark.createDataFrame(list(aliases), text(["source_id", "normalized_name", "city", "state", "postal_code", "legal_entity_id"]))
    r = spark.createDataFrame(list(rejections), text(["source_id", "normalized_name", "candidate_legal_entity_id"]))
    return {x["observation_id"]: (x["match_status"], x["match_method"], x["legal_entity_id"], x["candidate_legal_entity_id"]) for x in resolve.resolve(o, e, a, r).collect()}


def seen(i, name, city="", state="", postal="", n=1, suffix="", source="lca"):
    return (i, source, name, n, name, name.removesuffix(f" {suffix}"), "".join(w[0] for w in name.split()), suffix, city, state, postal)


def whole(i, name, city="", state="", postal="", suffix=""):
    return (i, name, name.removesuffix(f" {suffix}"), "".join(w[0] for w in name.split()), suffix, city, state, postal)


def test_resolution_takes_each_way(spark):
    known = [whole("e1", "ACME WIDGETS", "AUSTIN", "TX", "78701"), whole("e2", "BETA UNIVERSITY", "RENO", "NV"), whole("e3", "GAMMA TOOLS INC", "ERIE", "PA", suffix="INC"), whole("e4", "ALPHA HOSPITAL GROUP", "MIAMI", "FL")]
    got = resolution(
        spark,
        [
            seen("1", "ACME WIDGETS", "AUSTIN", "TX"),
            seen("2", "ACME WIDGETS", "DALLAS", "TX"),  # another city: not merged
            seen("3", "BETA UNIVERSITY", "", ""),  # no known place: no conflict
            seen("4", "ACME WIDGETS CO", "AUSTIN", "TX", "78701"),  # nearly equal, and location agrees
            seen("5", "GAMMA TOOLS LLC", "ERIE", "PA", suffix="LLC"),  # suffixes conflict
            seen("6", "ALPHA GROUP HOSPITAL SYSTEM", "MIAMI", "FL"),  # scope words differ
            seen("7", "OTHER NAME", "X", "OH", n=9),
            seen("8", "OTHER NAME", "X", "OH", n=2),  # meets the entity that 7 founded
            seen("9", "OTHER NAME", "Y", "OH"),
            seen("10", ""),
            seen("11", "REVIEWED", "Z", "CA"),
            seen("12", "ACME WIDGET", "AUSTIN", "TX", "78701"),
        ],
        known,
        [(None, "REVIEWED", None, None, None, "e1"), ("lca", "REVIEWED", None, None, None, "e2"), ("other", "REVIEWED", "Z", "CA", None, "e3")],
        [(None, "ACME WIDGET", "e1")],
    )
    assert got["1"] == ("DETERMINISTIC", "EXACT_NORMALIZED_NAME", "e1", None)
    assert got["2"][:2] == ("REVIEW_REQUIRED", "EXACT_NAME_LOCATION_CONFLICT_UNMERGED") and got["2"][3] == "e1" and got["2"][2].startswith("legal_source_")
    assert got["3"] == ("DETERMINISTIC", "EXACT_NORMALIZED_NAME", "e2", None)
    assert got["4"][0] == "REVIEW_REQUIRED" and got["4"][3] == "e1"  # one informative word more
    assert got["5"][0] == "REVIEW_REQUIRED" and got["5"][3] == "e3"
    assert got["6"][0] in ("REVIEW_REQUIRED", "DETERMINISTIC") and got["6"][2].startswith("legal_source_")
    assert got["7"][:2] == ("DETERMINISTIC", "NEW_SOURCE_LEGAL_ENTITY")
    assert got["8"] == ("DETERMINISTIC", "EXACT_NORMALIZED_NAME", got["7"][2], None)
    assert got["9"][:2] == ("REVIEW_REQUIRED", "EXACT_NAME_LOCATION_CONFLICT_UNMERGED") and got["9"][3] == got["7"][2]
    assert got["10"] == ("UNRESOLVED", "NO_NAME", None, None)
    assert got["11"] == ("MANUAL_OVERRIDE", "REVIEWED_ALIAS", "e2", None)
    assert got["12"] == ("REJECTED", "REVIEWED_REJECTION", got["12"][2], "e1")


def test_fuzzy_merge_and_its_guards(spark):
    long = "NORTHERN INDUSTRIAL ELECTRONICS MANUFACTURING PARTNERSHIP INTERNATIONAL"
    known = [whole("e1", f"{long} INC", "AUSTIN", "TX", "78701", "INC")]
    near = f"{long}"[:-1]
    got = resolution(spark, [seen("1", near, "AUSTIN", "TX", "78701"), seen("2", near, "DALLAS", "TX", "75001"), seen("3", f"{near} LLC", "AUSTIN", "TX", "78701", suffix="LLC")], known)
    assert got["1"] == ("HIGH_CONFIDENCE_AUTO", "FUZZY_NAME_WITH_LOCATION", "e1", "e1")
    assert got["2"][0] == "REVIEW_REQUIRED" and got["3"][0] == "REVIEW_REQUIRED"


def test_tiles_give_what_single_pairs_give(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = ["ACME", "LABS", "OF", "HOSPITAL", "A", "X1", "ÜNÏ", *map(str, range(40))]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(150)] + ["Z" * 70 + " ACME", "Z" * 63 + " A"]
    got = resolve.name_scores(names, names[::-1])
    assert all(got[k, i] == 0.6 * resolve.token_set_ratio(a, b) / 100 + 0.25 * resolve.ratio(a, b) / 100 for i, a in enumerate(names) for k, b in enumerate(names[::-1]))

    monkeypatch.setattr(resolve, "BEST_TILE", 20)
    monkeypatch.setattr(resolve, "PAIR_TILE", 30)
    kinds = "id string, core_name string, acronym string, state string, city string, postal_code string"
    rows = [(str(i % 145), "ACME " + n, "ABC", rng.choice(["TX", "NV", ""]), rng.choice(["", "RENO"]), rng.choice(["", "78701"])) for i, n in enumerate(names)]
    d = spark.createDataFrame(rows, kinds)
    pairs = [r.asDict() for r in resolve.candidate_pairs(d, d).collect()]
    keys = lambda r: {k for k in (f"s{r[3]}{r[1].replace(' ', '')[:5]}" if r[3] else "", f"a{r[3]}" if r[3] else "", f"p{r[5]}" if r[5] else "") if k}
    assert len(pairs) == len({(*a, *b) for a in rows for b in rows if keys(a) & keys(b)})
    best = {}
    for r in pairs:
        best.setdefault(r["l_id"], []).append((r["score"], r["r_id"]))
    got = resolve.decide(resolve.best_pairs(d, d)).collect()
    assert len(got) == len(best)
    for r in got:
        want = sorted(best[r["id"]], reverse=True)
        assert (r["score"], r["candidate_id"], r["margin"]) == (*want[0], round(want[0][0] - (want[1][0] if len(want) > 1 else 0), 6))


def test_no_call_into_python_a_name(spark):
    """Decisions on many names are made by one call."""
    empty = lambda kinds: spark.createDataFrame([], kinds)
    place = "normalized_name string, core_name string, acronym string, legal_suffix string, city string, state string, postal_code string"
    plan = resolve.resolve(
        empty(f"observation_id string, source_id string, alias_raw string, occurrence_count long, {place}"), empty(f"legal_entity_id string, {place}"),
        empty("source_id string, normalized_name string, city string, state string, postal_code string, legal_entity_id string"), empty("source_id string, normalized_name string, candidate_legal_entity_id string"),
    )._jdf.queryExecution().toString()
    assert "CoGroupsIn" not in plan and "MapInArrow" in plan


def test_conflicting_aliases_fail(spark):
    with pytest.raises(resolve.ConflictingAliases):
        resolution(spark, [seen("1", "A B")], [whole("e1", "C")], [(None, "A B", None, None, None, "e1"), (None, "A B", None, None, None, "e2")])


def test_coverage_of_fiscal_years(spark):
    kinds = "fiscal_year int, coverage_start_quarter int, fiscal_quarter int, is_partial_period boolean, is_quarter_partition boolean"
    full = [(2020, None, None, False, False), (2021, 1, 1, False, True), (2021, 2, 4, False, True), (2022, 1, 2, False, True), (2022, 2, 4, False, True), (2023, 4, 3, False, True), (2019, None, 4, False, False), (2018, 1, 4, False, True), (2024, 1, 2, True, False), (2017, 1, 2, True, False)]
    reviewed = spark.createDataFrame([(2021, 1, 1), (2021, 2, 4), (2022, 1, 2), (2022, 3, 4)], "fiscal_year int, first int, last int")
    got = {r["fiscal_year"]: r["problem"] for r in quality.coverage_problems(spark.createDataFrame(full, kinds), reviewed).collect()}
    assert got == {2017: "PARTIAL_YEAR", 2018: "NOT_REVIEWED", 2019: "NOT_PARTITIONED", 2020: None, 2021: None, 2022: "QUARTERS_COVERED", 2023: "QUARTER_BOUNDS", 2024: None}
    with pytest.raises(quality.IncompleteCoverage, match="FY2017: PARTIAL_YEAR"):
        quality.require_coverage(spark.createDataFrame(full, kinds), reviewed)
    quality.require_coverage(spark.createDataFrame(full[:3], kinds), reviewed)


def test_gold_report_and_build_ids(spark):
    kinds = "category string, left_name string, right_name string, left_city string, right_city string, left_state string, right_state string, expected_match boolean, ambiguous boolean, parent_legal_pair boolean"
    rows = [("a", "Acme Inc.", "ACME, Incorporated", "X", "x", "TX", "TX", True, False, False), ("a", "Acme", "Acme", "X", "Y", "TX", "TX", False, True, False), ("b", "Beta", "Gamma", "", "", "", "", False, False, True)]
    report = lambda more, **need: quality.gold_report(spark.createDataFrame([*rows, *more], kinds), need).first()
    assert report([], a=2, b=1)["passed"] and not report([], a=3)["passed"]
    bad = report([("b", "Delta", "Delta", "", "", "", "", False, False, True)])
    assert (bad["false_auto"], bad["parent_legal_collapses"], bad["auto_precision"], bad["passed"]) == (1, 1, 0.5, False)
    one, two = (quality.fingerprint(spark.range(9).repartition(n), ["id"]).first()[0] for n in (1, 4))
    assert one == two != quality.fingerprint(spark.range(8), ["id"]).first()[0]
    assert quality.build_id("p", {"b": 1, "a": one}) == quality.build_id("p", {"a": one, "b": 1})


def test_policy_evaluation_passes_and_fails(spark):
    def report(**change):
        fact = {"institution_id": "1", "policy_document_id": "d", "fact_type": "t", "fact_value": "YES", "source_url": "https://hr.u.edu/p", "supporting_excerpt": "We  support", "exact_excerpt_verified": True, "human_review_status": "REVIEWED_ACCEPTED", "is_current": True, "valid_to": None} | change
        kinds = ", ".join(f"{c} {'boolean' if isinstance(v, bool) else 'string'}" for c, v in fact.items())
        documents = spark.createDataFrame([("d", "1", "U.edu.")], "policy_document_id string, institution_id string, official_domain string")
        quoted = spark.createDataFrame([("1", "https://hr.u.edu/p", "t", "YES", "we support")], "institution_id string, source_url string, fact_type string, expected_value string, supporting_excerpt string")
        return quality.policy_evaluation(spark.createDataFrame([tuple(fact.values())], kinds), documents, quoted, institutions=1).first()

    assert report()["passed"] and report()["precision_"] == 1
    assert report(fact_value="NO")["correct"] == 0 and report(supporting_excerpt="other")["precision_"] == 0
    assert report(exact_excerpt_verified=False)["unsupported"] == 1 and report(human_review_status="NEW")["evaluated"] == 0
    assert not report(valid_to="2024-01-01")["passed"] and report(source_url="https://u.edu.evil.org/p")["coverage"] == 0
