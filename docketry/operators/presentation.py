"""The read-only service over the presentation views, and its stand-in where no build is available.

Every call returns frames; nothing is read until they are.  Identifiers and terms become
typed predicates, limits are clamped, unknown sort orders are refused.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.semantics import canonical_status, known, top_by
from docketry.operators.projection import clamp, in_order
from docketry.operators.service import Filters

#: The orders of lists; a leading - is descending with nulls last.
SORTS = {
    "overall_sponsorship": ("-overall_sponsorship_score", "-green_card_history_score", "-h1b_history_score", "-last_observed_activity_year"),
    "green_card_history": ("-green_card_history_score", "-overall_sponsorship_score", "-h1b_history_score", "-last_observed_activity_year"),
    "h1b_history": ("-h1b_history_score", "-overall_sponsorship_score", "-green_card_history_score", "-last_observed_activity_year"),
    "recent_activity": ("-last_observed_activity_year", "-overall_sponsorship_score"),
    "name": (),
}
FRAMES = (
    "summary", "legal_entities", "aliases", "h1b_trends", "perm_trends", "rating_supporting_cases", "relevant_titles", "case_statuses", "worksite_states", "wage_summary", "institutions", "everify_evidence", "opt_evidence",
    "policy_evidence", "provenance",
)
PROGRAMS = (("dol_lca", "first_cases", "h1b_history_status", "CERTIFIED-WITHDRAWN"), ("dol_perm", "second_cases", "green_card_history_status", "CERTIFIED-EXPIRED"))


def _sorted(df: DataFrame, sort: str, name: str, key: str) -> DataFrame:
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort}")
    have = [F.col(c[1:]).desc_nulls_last() for c in SORTS[sort] if c[1:] in df.columns]
    return df.orderBy(*have, name, key)


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


class Unavailable:
    """Answers without a build: everything is empty or unknown, nothing is made up."""

    available = False

    def __init__(self, spark: SparkSession, message: str = "No presentation tables have been built. Evidence remains UNKNOWN."):
        self.spark, self.message = spark, message

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "organization_id string")

    def status(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("unavailable").alias("build_id"), F.lit(False).alias("data_available"), F.lit("UNKNOWN").alias("evidence_status"), F.lit(self.message).alias("message"))

    def overview(self) -> DataFrame:
        names = ("legal_entity_count", "parent_organization_count", "institution_count", "relevant_lca_count", "relevant_certified_perm_count", "unresolved_entity_match_count")
        return self.spark.range(1).select(*(F.lit(0).cast("long").alias(n) for n in names))

    def employers(self, *_, **__) -> DataFrame:
        return self._empty()

    institutions = search = compare = supporting_cases = export_employers = export_institutions = facets = employers

    def detail(self, organization_id) -> None:
        return None

    def review_queues(self, limit: int = 500) -> dict[str, DataFrame]:
        return {k: self._empty() for k in ("entity", "everify", "opt", "policy")}

    def data_health(self) -> dict[str, DataFrame]:
        return {k: self._empty() for k in ("source_coverage", "quality_checks", "source_artifacts")}


class Presentation:
    """Calls over the fifteen views and the tables behind them.

    ``tables`` has entity_aliases, legal_entities, parent_organizations, institutions and the
    three case tables; ``views`` is what ``views.views`` returns.
    """

    available = True

    def __init__(self, spark: SparkSession, views: Mapping[str, DataFrame], tables: Mapping[str, DataFrame]):
        need = {"vw_employer_explorer": {"organization_id", "organization_name", "identity_scope"}, "vw_institution_explorer": {"institution_id", "official_name", "organization_id"}, "vw_data_health": {"source_id"}}
        for name, cols in need.items():
            if lacking := cols - set(views[name].columns if name in views else ()):
                raise ValueError(f"incompatible tables: {name} lacks {', '.join(sorted(lacking))}")
        self.spark, self.views, self.tables = spark, views, tables

    # --- the build ------------------------------------------------------------------------

    def status(self) -> DataFrame:
        h = self.views["vw_data_health"].where(F.col("source_id").isin("dol_lca", "dol_perm", "uscis_h1b"))
        one = h.agg(*(F.max(c).alias(c) for c in ("latest_complete_fiscal_year", "current_partial_fiscal_year", "current_partial_quarter")))
        checks, employers = self.views["vw_quality_checks"], self.views["vw_employer_explorer"]
        one = one.crossJoin(F.broadcast(checks.agg(F.max("build_id").alias("__b"), F.max("checked_at").alias("build_date"))))  # one row each
        one = one.crossJoin(F.broadcast(employers.agg(F.max(_column(employers, "metric_version")).alias("__m"), F.max(_column(employers, "score_version")).alias("score_version"))))
        year, quarter = F.col("current_partial_fiscal_year"), F.col("current_partial_quarter")
        period = F.concat(F.lit(" FY"), year.cast("string"), F.coalesce(F.concat(F.lit(" Q"), quarter.cast("string")), F.lit("")), F.lit(" is partial and is not comparable with a complete year."))
        text = F.concat(F.lit("Observed government and institution evidence is available."), F.coalesce(period, F.lit("")))
        return one.select(
            F.coalesce("__b", "__m", F.lit("build-unknown")).alias("build_id"), F.lit(True).alias("data_available"), F.lit("AVAILABLE").alias("evidence_status"), text.alias("message"), "score_version", "latest_complete_fiscal_year",
            "current_partial_fiscal_year", "current_partial_quarter", "build_date",
        )

    def overview(self) -> DataFrame:
        e = self.views["vw_employer_explorer"].where("identity_scope = 'LEGAL_ENTITY'")
        sums = e.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("relevant_lca_count", "relevant_certified_perm_count")))
        counts = (("legal_entity_count", self.tables["legal_entities"]), ("parent_organization_count", self.tables["parent_organizations"]), ("institution_count", self.tables["institutions"]), ("unresolved_entity_match_count", self.views["vw_entity_review_queue"]))
        return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), (df.agg(F.count("*").alias(n)) for n, df in counts), sums)  # one row each

    def data_health(self) -> dict[str, DataFrame]:
        a = self.views["vw_source_artifacts"]
        return {"source_coverage": self.views["vw_data_health"].orderBy("source_id"), "quality_checks": self.views["vw_quality_checks"], "source_artifacts": a.orderBy(*(c for c in ("source_id", "fiscal_year") if c in a.columns))}

    def review_queues(self, limit: int = 500) -> dict[str, DataFrame]:
        n, v = clamp(limit, 5_000), self.views
        opt = v["vw_opt_evidence"].where("review_status = 'NEEDS_REVIEW'").orderBy(F.col("report_year").desc(), "rank")
        return {"entity": v["vw_entity_review_queue"].limit(n), "everify": v["vw_everify_review_queue"].orderBy("priority_rank").limit(n), "opt": opt.limit(n), "policy": v["vw_policy_review_queue"].limit(n)}

    # --- lists ----------------------------------------------------------------------------

    def _named(self, df: DataFrame, term: str) -> DataFrame:
        """Organisations of a name, or with an alias of their own or of their children, like a term."""
        like = f"%{term.strip()}%"
        a = self.tables["entity_aliases"].where(F.col("alias_raw").ilike(like))
        ids = a.select(F.explode(F.array("legal_entity_id", "parent_organization_id")).alias("organization_id")).where("organization_id is not null").distinct()
        hit = df.join(ids.withColumn("__hit", F.lit(True)), "organization_id", "left")
        return hit.where(F.col("organization_name").ilike(like) | known(F.col("__hit"))).drop("__hit")

    @staticmethod
    def _kept(df: DataFrame, f: Filters) -> DataFrame:
        for c, least in f.minimums:
            df = df.where(F.col(c) >= least)
        for c, values in f.any_of:
            df = df.where(F.col(c).isin(*values)) if values else df
        return df.where(~known(F.col(f.exclude))) if f.exclude else df

    def _employers(self, f: Filters) -> DataFrame:
        df = self._kept(self.views["vw_employer_explorer"], f)
        if f.term and f.term.strip():
            df = self._named(df, f.term)
        if f.families:
            df = df.join(self.views["vw_relevant_titles"].where(F.col("role_family").isin(*f.families)), "organization_id", "left_semi")
        return df

    def employers(self, f: Filters | None = None, sort: str = "overall_sponsorship", limit: int | None = 500) -> DataFrame:
        out = _sorted(self._employers(f or Filters()), sort, "organization_name", "organization_id")
        return out if limit is None else out.limit(clamp(limit, 10_000))

    def _institutions(self, f: Filters) -> DataFrame:
        df = self._kept(self.views["vw_institution_explorer"], f)
        if f.term and f.term.strip():
            names = [c for c in ("official_name", "legal_employer_name", "parent_organization_name") if c in df.columns]
            df = df.where(reduce(lambda a, b: a | b, (known(F.col(c).ilike(f"%{f.term.strip()}%")) for c in names)))
        return df

    def institutions(self, f: Filters | None = None, sort: str = "overall_sponsorship", limit: int | None = 500, **deprecated) -> DataFrame:
        """Institutions; filters that are no longer offered are taken and have no effect."""
        out = _sorted(self._institutions(f or Filters()), sort, "official_name", "institution_id")
        return out if limit is None else out.limit(clamp(limit, 10_000))

    def facets(self, of: str, columns: Sequence[str]) -> DataFrame:
        df = self.views[{"employers": "vw_employer_explorer", "institutions": "vw_institution_explorer"}[of]]
        return reduce(DataFrame.unionByName, (df.select(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")).where("value is not null").distinct() for c in columns))

    def search(self, term: str, limit: int = 50) -> DataFrame:
        found = self._named(self.views["vw_employer_explorer"], term) if term.strip() else self.views["vw_employer_explorer"].limit(0)
        return _sorted(found, "overall_sponsorship", "organization_name", "organization_id").limit(clamp(limit, 100))

    def export_employers(self, f: Filters) -> DataFrame:
        return self.employers(f, limit=None)

    def export_institutions(self, f: Filters) -> DataFrame:
        return self.institutions(f, limit=None)

    def compare(self, ids: Sequence) -> DataFrame:
        """At most five organisations in the order asked for, each with its first institution."""
        chosen = list(dict.fromkeys(i for i in ids if str(i).strip()))
        if len(chosen) > 5:
            raise ValueError("compare takes at most five organisations")
        e, i = self.views["vw_employer_explorer"], self.views["vw_institution_explorer"]
        if not chosen:
            return e.limit(0)
        own = F.array_distinct(F.array_compact(F.array(*(F.col(c) for c in ("organization_id", "legal_entity_id", "parent_organization_id") if c in i.columns))))
        near = i.select(F.explode(own).alias("organization_id"), "institution_id", F.col("official_name").alias("research_institution")).where(F.col("organization_id").isin(*chosen))
        first = top_by(near, ["organization_id"], [F.col("research_institution"), F.col("institution_id")])
        return in_order(e, "organization_id", chosen).join(first, "organization_id", "left")

    # --- one organisation -----------------------------------------------------------------

    def _cases(self, organization_id, name: str) -> DataFrame:
        df = self.tables[name]
        keys = [c for c in ("organization_id", "legal_entity_id", "parent_organization_id") if c in df.columns]
        return df.where(reduce(lambda a, b: a | b, (known(F.col(c) == organization_id) for c in keys)))

    def supporting_cases(self, organization_id, limit: int = 250) -> DataFrame:
        """Cases that give an organisation's ratings their weight, latest first; none for an unrated history."""
        rated = self.views["vw_employer_explorer"].where(F.col("organization_id") == organization_id)
        out = []
        for source, table, status, half in PROGRAMS:
            rows = self._cases(organization_id, table)
            state = canonical_status(F.col("case_status"))
            ok = known(F.col("technical_role")) & state.isin("CERTIFIED", half)
            if source == "dol_lca":
                ok &= F.upper(F.trim(F.coalesce("visa_class", F.lit("")))) == "H-1B"
            cols = [_column(rows, c).cast("string").alias(c) for c in ("job_title_raw", "role_family", "worksite_state", "wage_unit", "source_artifact_id")]
            rows = rows.where(ok).select(F.lit(source).alias("source_id"), "case_id", state.alias("canonical_status"), "fiscal_year", _column(rows, "fiscal_quarter", "int").alias("fiscal_quarter"), "is_partial_period", *cols)
            out.append(rows.join(F.broadcast(rated.where(F.col(status) == "RATED").select(F.lit(True).alias("__r")).limit(1)), F.lit(True)).drop("__r"))  # one row or none
        order = [F.col("fiscal_year").desc(), F.col("fiscal_quarter").desc_nulls_last(), F.col("source_id"), F.col("case_id")]
        return reduce(DataFrame.unionByName, out).orderBy(*order).limit(clamp(limit, 1_000))

    def detail(self, organization_id) -> dict[str, DataFrame] | None:
        """Fifteen frames on one organisation; None if there is no such."""
        v, own = self.views, F.col("organization_id") == organization_id
        summary = v["vw_employer_explorer"].where(own)
        if not summary.limit(1).count():
            return None
        related = known(F.col("legal_entity_id") == organization_id) | known(F.col("parent_organization_id") == organization_id)
        cases = []
        for source, table, *_ in PROGRAMS:
            df = self._cases(organization_id, table)
            cases.append(df.select(F.lit(source).alias("source_id"), "case_status", _column(df, "worksite_state").alias("worksite_state"), _column(df, "wage_unit").alias("wage_unit"), _column(df, "wage_from", "double").cast("double").alias("wage_from")))
        cases = reduce(DataFrame.unionByName, cases)
        derived = F.lit("DERIVED_METRIC").alias("evidence_class")
        wages = cases.where("wage_from > 0 and wage_unit is not null").groupBy("source_id", "wage_unit")
        traces = []
        for source, table in (("dol_lca", "first_cases"), ("dol_perm", "second_cases"), ("uscis_h1b", "petitions")):
            df = self._cases(organization_id, table)
            more = [_column(df, c).cast("string").alias(c) for c in ("source_artifact_id", "source_file_name", "ingested_at", "source_url", "source_sha256", "schema_version")]
            traces.append(df.select(F.lit(source).alias("source_id"), "fiscal_year", "is_partial_period", *more))
        by = ["source_id", "source_artifact_id", "source_file_name", "fiscal_year"]
        trace = reduce(DataFrame.unionByName, traces).groupBy(*by).agg(
            F.bool_or("is_partial_period").alias("is_partial_period"), F.max("ingested_at").alias("retrieved_at"), F.max("source_url").alias("official_url"), F.max("source_sha256").alias("sha256"), F.max("schema_version").alias("schema_version"),
            F.count("*").alias("record_count"), F.lit("OBSERVED_GOVERNMENT_RECORD").alias("evidence_class"),
        )
        n, i, p = F.col("case_count").desc(), v["vw_institution_explorer"], v["vw_policy_evidence"]
        ours = reduce(lambda a, b: a | b, (known(F.col(c) == organization_id) for c in ("organization_id", "legal_entity_id", "parent_organization_id") if c in i.columns))
        reviewed = known(F.col("organization_id") == organization_id) & F.col("human_review_status").isin("REVIEWED_ACCEPTED", "REVIEWED_NOT_STATED") & known(F.col("exact_excerpt_verified")) & known(F.col("fact_is_current")) & F.col("valid_to").isNull()
        return {
            "summary": summary,
            "legal_entities": self.tables["legal_entities"].where(related).orderBy("legal_name", "legal_entity_id"),
            "aliases": self.tables["entity_aliases"].where(related).orderBy(F.col("occurrence_count").desc(), "alias_raw").limit(500),
            "h1b_trends": v["vw_h1b_trends"].where(own).orderBy("fiscal_year"),
            "perm_trends": v["vw_perm_trends"].where(own).orderBy("fiscal_year"),
            "rating_supporting_cases": self.supporting_cases(organization_id),
            "relevant_titles": v["vw_relevant_titles"].where(own).orderBy(F.col("record_count").desc(), "source_id", "job_title_raw").limit(500),
            "case_statuses": cases.groupBy("source_id", "case_status").agg(F.count("*").alias("case_count"), derived).orderBy("source_id", n, "case_status"),
            "worksite_states": cases.where("worksite_state is not null").groupBy("source_id", "worksite_state").agg(F.count("*").alias("case_count"), derived).orderBy(n, "source_id", "worksite_state"),
            "wage_summary": wages.agg(F.count("*").alias("observation_count"), *(F.percentile("wage_from", F.lit(q)).alias(k) for k, q in (("wage_p25", 0.25), ("wage_median", 0.5), ("wage_p75", 0.75))), derived).orderBy("source_id", "wage_unit"),
            "institutions": _sorted(i.where(ours), "overall_sponsorship", "official_name", "institution_id"),
            "everify_evidence": v["vw_everify_evidence"].where(own).orderBy(F.col("retrieved_at").desc()),
            "opt_evidence": v["vw_opt_evidence"].where(own).orderBy(F.col("report_year").desc(), "rank"),
            "policy_evidence": p.where(reviewed).orderBy("institution_id", "fact_type", F.col("retrieved_at").desc()),
            "provenance": trace.orderBy("source_id", "fiscal_year"),
        }
