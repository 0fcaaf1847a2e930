"""Explorer queries: typed filters become column predicates, limits are clamped."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.semantics import known
from docketry.operators.projection import clamp, in_order, search


@dataclass(frozen=True)
class Filters:
    """Thresholds are at least; lists are any of; a term searches names and aliases."""

    minimums: tuple[tuple[str, float], ...] = ()
    any_of: tuple[tuple[str, tuple], ...] = ()
    term: str | None = None
    families: tuple[str, ...] = ()
    exclude: str | None = None


class Explorer:
    """Read-only queries over organisations, their aliases and their cases."""

    SORTS = {"score": "score", "count": "n", "name": "name"}

    def __init__(self, organizations: DataFrame, aliases: DataFrame, cases: DataFrame):
        for df, need in ((organizations, {"organization_id", "name"}), (aliases, {"organization_id", "alias"}), (cases, {"organization_id", "role_family"})):
            if missing := need - set(df.columns):
                raise ValueError(f"incompatible tables: {', '.join(sorted(missing))} missing")
        self.organizations, self.aliases, self.cases = organizations, aliases, cases

    def where(self, f: Filters) -> DataFrame:
        df = self.organizations
        tests: list[Column] = [F.col(c) >= v for c, v in f.minimums]
        tests += [F.col(c).isin(*v) for c, v in f.any_of if v]
        if f.exclude:
            tests.append(~known(F.col(f.exclude)))
        if tests:
            df = df.where(reduce(lambda a, b: a & b, tests))
        if f.term:
            df = search(df, self.aliases, "organization_id", "name", "alias", f.term)
        if f.families:
            have = self.cases.where(F.col("role_family").isin(*f.families)).select("organization_id")
            df = df.join(have, "organization_id", "left_semi")
        return df

    def list(self, f: Filters, sort: str = "score", limit: int | None = None) -> DataFrame:
        if sort not in self.SORTS:
            raise ValueError(f"unknown sort {sort}")
        key = F.col(self.SORTS[sort])
        first = key.asc_nulls_last() if sort == "name" else key.desc_nulls_last()
        return self.where(f).orderBy(first, "organization_id").limit(clamp(limit, 10_000))

    def export(self, f: Filters) -> DataFrame:
        return self.where(f)

    def facets(self, columns: Sequence[str]) -> DataFrame:
        parts = [self.organizations.select(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")).distinct() for c in columns]
        return reduce(DataFrame.unionByName, parts)

    def compare(self, ids: Sequence) -> DataFrame:
        if not 1 <= len(ids) <= 5:
            raise ValueError("compare takes one to five organisations")
        return in_order(self.organizations, "organization_id", list(ids))

    def supporting_cases(self, organization_id, limit: int | None = 500) -> DataFrame:
        return self.cases.where(F.col("organization_id") == organization_id).limit(clamp(limit, 5_000))
