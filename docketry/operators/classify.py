"""Ordered-rule classification of titles, compiled into column expressions.

Precedence: reviewed exact title; exclusion (unless a positive title matches and the
exclusion isn't one that always wins); code prefix; positive title; code and title
together; missing; ambiguous; else not relevant.  Within a kind the first rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    family: str
    confidence: float
    patterns: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Taxonomy:
    exact: dict[str, tuple[bool | None, str, float]] = field(default_factory=dict)
    exclusions: tuple[Rule, ...] = ()
    always: tuple[str, ...] = ("faculty", "internships", "postdoctoral", "student_workers")
    codes: tuple[Rule, ...] = ()
    titles: tuple[Rule, ...] = ()
    combined: tuple[Rule, ...] = ()
    ambiguous: tuple[str, ...] = ()


def _any(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def _prefix(c: Column, prefixes: Sequence[str]) -> Column:
    return c.rlike("^(?:" + "|".join(p.replace("-", r"\-") for p in prefixes) + ")") if prefixes else F.lit(False)


def _first(rules: Sequence[Rule], test) -> Column:
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(test(r), F.lit(r.rule_id)).otherwise(out)
    return out


def classify(df: DataFrame, taxonomy: Taxonomy, title: str = "title", code: str = "code") -> DataFrame:
    """Add technical_role (null: ambiguous), role_family, role_confidence, classification_method.

    Each kind of rule is matched once, into a column of its own, before the cascade reads it.
    """
    t, c = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(code), F.lit(""))
    df = df.withColumns(
        {
            "__x": _first(taxonomy.exclusions, lambda r: _any(t, r.patterns)),
            "__p": _first(taxonomy.titles, lambda r: _any(t, r.patterns)),
            "__c": _first(taxonomy.codes, lambda r: _prefix(c, r.prefixes)),
            "__b": _first(taxonomy.combined, lambda r: _prefix(c, r.prefixes) & _any(t, r.patterns)),
        }
    )
    excluded = F.col("__x").isNotNull() & (F.col("__p").isNull() | F.col("__x").isin(*taxonomy.always))
    steps: list[tuple[Column, Column, Column, Column, str]] = []
    for name, (role, family, confidence) in taxonomy.exact.items():
        steps.append((t == name, F.lit(role).cast("boolean"), F.lit(family), F.lit(confidence), "EXACT_REVIEWED_TITLE"))

    def pick(rules: Sequence[Rule], column: str, value) -> Column:
        out = F.lit(None)
        for r in rules:
            out = F.when(F.col(column) == r.rule_id, F.lit(value(r))).otherwise(out)
        return out

    steps.append((excluded, F.lit(False), F.lit("not_relevant"), pick(taxonomy.exclusions, "__x", lambda r: r.confidence), "STRONG_EXCLUSION_PATTERN"))
    for column, rules, method in (("__c", taxonomy.codes, "SOC_MAPPING"), ("__p", taxonomy.titles, "STRONG_TITLE_PATTERN"), ("__b", taxonomy.combined, "COMBINED_SOC_TITLE")):
        steps.append((F.col(column).isNotNull(), F.lit(True), pick(rules, column, lambda r: r.family), pick(rules, column, lambda r: r.confidence), method))
    unknown = F.lit(None).cast("boolean")
    steps.append(((t == "") & (c == ""), unknown, F.lit("ambiguous"), F.lit(0.0), "NEEDS_REVIEW"))
    steps.append((_any(t, taxonomy.ambiguous), unknown, F.lit("ambiguous"), F.lit(0.4), "NEEDS_REVIEW"))
    role, family, confidence, method = F.lit(False), F.lit("not_relevant"), F.lit(0.9), F.lit("DEFAULT_NOT_RELEVANT")
    for test, a, b, x, name in reversed(steps):
        role, family = F.when(test, a).otherwise(role), F.when(test, b).otherwise(family)
        confidence, method = F.when(test, x).otherwise(confidence), F.when(test, F.lit(name)).otherwise(method)
    out = df.withColumns({"technical_role": role, "role_family": family, "role_confidence": confidence.cast("double"), "classification_method": method})
    return out.drop("__x", "__p", "__c", "__b")


def classify_rows(df: DataFrame, taxonomy: Taxonomy, title: str, code: str) -> DataFrame:
    """Classify distinct (title, code) pairs and join back, nulls matching nulls."""
    pairs = df.select(F.col(title).alias("__t"), F.col(code).alias("__k")).distinct()
    known = classify(pairs, taxonomy, "__t", "__k")
    return df.join(known, F.col(title).eqNullSafe(F.col("__t")) & F.col(code).eqNullSafe(F.col("__k")), "left").drop("__t", "__k")
