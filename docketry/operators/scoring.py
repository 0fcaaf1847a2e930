"""Deterministic history scores, statuses and star ratings.

A resolved zero (no observed history, score 0, no rating) is never confused with missing
evidence (unrated, null score).  Weights and bands are checked before use.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.semantics import clip, known, log_score, nearest_percentiles, stars, sum_across
from docketry.session import Scratch


@dataclass(frozen=True)
class ScoreConfig:
    """Fixed values of the active formula; every group of weights sums to one."""

    cap_percentile: float = 0.95
    family_cap: int = 5
    first: dict[str, float] = field(default_factory=lambda: {"volume": 0.45, "consistency": 0.25, "recency": 0.15, "breadth": 0.10, "approvals": 0.05})
    second: dict[str, float] = field(default_factory=lambda: {"volume": 0.45, "consistency": 0.25, "recency": 0.15, "breadth": 0.15})
    overall: dict[str, float] = field(default_factory=lambda: {"first": 0.40, "second": 0.60})
    bands: tuple[tuple[int, float], ...] = ((5, 80), (4, 65), (3, 45), (2, 25), (1, 0.000000001))

    def __post_init__(self) -> None:
        for name in ("first", "second", "overall"):
            w = getattr(self, name)
            if any(v <= 0 for v in w.values()) or abs(sum(w.values()) - 1) > 1e-9:
                raise ValueError(f"weights of {name} must be positive and sum to 1")
        if set(self.first) != {"volume", "consistency", "recency", "breadth", "approvals"} or set(self.second) != {"volume", "consistency", "recency", "breadth"}:
            raise ValueError("unknown or missing components")
        if set(self.overall) != {"first", "second"}:
            raise ValueError("overall needs both histories")
        if [s for s, _ in self.bands] != [5, 4, 3, 2, 1] or any(a <= b for (_, a), (_, b) in zip(self.bands, self.bands[1:], strict=False)):
            raise ValueError("bands must be strictly ordered")


def rating_of(score: Column, config: ScoreConfig) -> Column:
    out = F.lit(None).cast("int")
    for n, least in reversed(config.bands):
        out = F.when(score >= least, F.lit(n)).otherwise(out)
    return out


def recency(last: Column, complete: Column, partial: Column) -> Column:
    """100 in the current partial or latest complete year, then 75, 50, 25 and 0."""
    lag = F.greatest(complete - last, F.lit(0))
    out = F.when(last.isNull(), 0.0).when(partial.isNotNull() & (last == partial), 100.0)
    for n, v in enumerate((100.0, 75.0, 50.0, 25.0)):
        out = out.when(lag == n, v)
    return out.otherwise(0.0)


def rated(df: DataFrame, name: str, valid: Column, observed: Column, score: Column, coverage: Column, config: ScoreConfig, none_text: str) -> DataFrame:
    """Add score, status, rating, stars, label and coverage under one prefix."""
    df = df.withColumns({"__valid": known(valid), "__seen": known(observed)})
    ok, seen = F.col("__valid"), F.col("__seen")
    df = df.withColumn(f"{name}_score", F.when(~ok, None).when(~seen, 0.0).otherwise(F.round(clip(score, 0.0, 100.0), 2)))
    df = df.withColumn(f"{name}_rating", rating_of(F.col(f"{name}_score"), config))
    rating = F.col(f"{name}_rating")
    pick = lambda shown: F.when(~ok, "Unrated").when(~seen, none_text).otherwise(shown)
    return df.withColumns(
        {
            f"{name}_status": F.when(~ok, "UNRATED").when(~seen, "NO_OBSERVED_HISTORY").otherwise("RATED"),
            f"{name}_stars": pick(stars(rating)),
            f"{name}_label": pick(F.concat(rating.cast("string"), F.lit(" out of 5 stars"))),
            f"{name}_coverage": F.round(F.when(ok, coverage).otherwise(0.0), 4),
        }
    ).drop("__valid", "__seen")


def score_organizations(df: DataFrame, config: ScoreConfig | None = None) -> DataFrame:
    """First, second and overall history scores.

    Reads organization_id, identity_scope, first_valid, second_valid, approvals_valid,
    weighted_first_count, weighted_second_count, approvals, {first,second}_complete_active_years,
    {first,second}_complete_years, last_{first,second}_year, {first,second}_family_count,
    latest_complete_year, partial_year.  Caps come from valid legal entities alone, as one
    row that is broadcast.
    """
    config = config or ScoreConfig()
    legal = F.col("identity_scope") == "LEGAL_ENTITY"
    p = config.cap_percentile
    positive = lambda c, ok: F.when(known(ok & legal) & (F.col(c) >= 0), F.col(c))
    df = Scratch(df.sparkSession, "scores").table(df)  # read for the caps and for the scores
    values = {
        "first_cap": positive("weighted_first_count", F.col("first_valid")),
        "second_cap": positive("weighted_second_count", F.col("second_valid")),
        "approvals_cap": positive("approvals", F.col("first_valid") & F.col("approvals_valid")),
    }
    caps = nearest_percentiles(df, values, p)
    df = df.crossJoin(F.broadcast(caps))  # one row, whatever the input

    def components(x: str) -> dict[str, Column]:
        years = F.col(f"{x}_complete_years").cast("double")
        return {
            "volume": log_score(F.col(f"weighted_{x}_count"), F.col(f"{x}_cap")),
            "consistency": F.when(years > 0, F.col(f"{x}_complete_active_years") / years * 100).otherwise(0.0),
            "recency": recency(F.col(f"last_{x}_year"), F.col("latest_complete_year"), F.col("partial_year")),
            "breadth": clip(F.col(f"{x}_family_count") / config.family_cap * 100, 0.0, 100.0),
        }

    one, two = components("first"), components("second")
    have = known(F.col("approvals_valid"))
    extra = F.when(have, log_score(F.col("approvals"), F.col("approvals_cap")) * config.first["approvals"]).otherwise(0.0)
    base = sum(w for k, w in config.first.items() if k != "approvals")
    seen = F.lit(base) + F.when(have, config.first["approvals"]).otherwise(0.0)
    first = (sum_across([one[k] * config.first[k] for k in one]) + extra) / seen
    second = sum_across([two[k] * config.second[k] for k in two])
    df = rated(df, "first", F.col("first_valid"), F.coalesce("weighted_first_count", F.lit(0.0)) > 0, first, clip(seen / sum(config.first.values()), 0.0, 1.0), config, "No observed first-program history")
    df = rated(df, "second", F.col("second_valid"), F.coalesce("weighted_second_count", F.lit(0.0)) > 0, second, F.lit(1.0), config, "No observed second-program history")
    mean = F.col("first_score") * config.overall["first"] + F.col("second_score") * config.overall["second"]
    cover = F.col("first_coverage") * config.overall["first"] + F.col("second_coverage") * config.overall["second"]
    valid = (F.col("first_status") != "UNRATED") & (F.col("second_status") != "UNRATED")
    return rated(df, "overall", valid, (F.col("first_score") > 0) | (F.col("second_score") > 0), mean, cover, config, "No observed history")
