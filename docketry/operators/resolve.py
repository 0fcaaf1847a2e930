"""Conservative resolution of organisation names: blocking, pair scores, guards, decisions.

Reviewed aliases come first, then equal names without a conflicting place, then a fuzzy
candidate among the known entities, which is merged only when it is nearly equal, far ahead
of the next and passes every guard.  What is left is a legal entity of its own; candidates
that were not merged go to review.
"""

from __future__ import annotations

import os
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.semantics import checked_join, known, stable_id

AUTO, REVIEW, MARGIN = 0.97, 0.80, 0.05
#: Words that scope comparisons leave out, words that tell an organisation's scope.
SCOPE_STOPWORDS = ("AND", "AT", "OF", "THE")
SCOPE_WORDS = ("AFFILIATE", "AFFILIATES", "ATHLETIC", "BRANCH", "CAMPUS", "DBA", "FOUNDATION", "HEALTH", "HOSPITAL", "HOSPITALS", "OFFICE", "RESEARCH", "SYSTEM")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    s = (1 << len(a)) - 1
    full = s
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - bin(s).count("1")


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not one or not two):
        return 100.0
    p, q = f"{both} {one}".strip(), f"{both} {two}".strip()
    best = ratio(p, q)
    return max(best, ratio(both, p), ratio(both, q)) if both else best


@F.pandas_udf(T.DoubleType())
def name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """0.60 of the token-set ratio and 0.25 of the plain ratio, as shares of one."""
    return pd.Series([0.6 * token_set_ratio(x or "", y or "") / 100 + 0.25 * ratio(x or "", y or "") / 100 for x, y in zip(a, b, strict=True)])


def block_keys(state: Column, core: Column, acronym: Column, postal: Column) -> Column:
    """Keys of which two names must share one to be compared."""
    return F.array_compact(
        F.array(
            F.when((state != "") & (core != ""), F.concat(F.lit("state_prefix:"), state, F.lit(":"), F.substring(F.replace(core, F.lit(" "), F.lit("")), 1, 5))),
            F.when((state != "") & (F.length(acronym) >= 3), F.concat(F.lit("state_acronym:"), state, F.lit(":"), acronym)),
            F.when(postal != "", F.concat(F.lit("postal:"), postal)),
        )
    )


# --- guards -----------------------------------------------------------------------------


def location_conflict(state: Column, city: Column, other_state: Column, other_city: Column) -> Column:
    """Both states are known and differ, or are equal while both cities are known and differ."""
    return (state != "") & (other_state != "") & ((state != other_state) | ((city != "") & (other_city != "") & (city != other_city)))


def suffix_conflict(a: Column, b: Column) -> Column:
    """Both names have a legal suffix, and not the same."""
    return (a != "") & (b != "") & (a != b)


def scope_compatible(a: Column, b: Column) -> Column:
    """As many informative words, initials in front apart, and the same words of scope."""

    def parts(core: Column) -> Column:
        said = F.array_join(F.filter(F.split(core, " "), lambda x: (x != "") & ~x.isin(*SCOPE_STOPWORDS)), " ")
        return F.filter(F.split(F.regexp_replace(said, r"^(?:\S(?: |$))+", ""), " "), lambda x: x != "")

    scope = lambda c: F.sort_array(F.array_intersect(parts(c), F.array(*map(F.lit, SCOPE_WORDS))))
    return (F.size(parts(a)) == F.size(parts(b))) & (scope(a) == scope(b))


# --- candidates -------------------------------------------------------------------------


#: Rows of a block's tile, where each row only keeps its best candidates and where every pair is returned.
BEST_TILE, PAIR_TILE = 2048, 512
_COLUMNS = ("id", "core_name", "state", "city", "postal_code")


def _lcs_rows(a: list[str], b: list[str]):
    """(k, lengths of the longest common subsequences of b[k] with all of a), for each k.

    The names of a have at most 64 characters, a machine word each.  b is walked in its sorted
    order, so that what two neighbours begin with is worked out once.
    """
    bits: dict[str, list[int]] = {}
    for i, x in enumerate(a):
        for j, c in enumerate(x):
            bits.setdefault(c, [0] * len(a))[i] |= 1 << j
    masks = {c: np.array(v, dtype=np.uint64) for c, v in bits.items()}
    full = np.array([(1 << len(x)) - 1 for x in a], dtype=np.uint64)
    size = np.array([float(len(x)) for x in a])
    states, last = [full], ""
    for k in sorted(range(len(b)), key=b.__getitem__):
        same = len(os.path.commonprefix([last, b[k]]))
        del states[same + 1 :]
        for c in b[k][same:]:
            s = states[-1]
            if (m := masks.get(c)) is not None:
                u = s & m
                s = (s + u) | (s - u)
            states.append(s)
        last = b[k]
        yield k, size - np.bitwise_count(states[-1] & full)


def _token_set_shares(a: list[str], b: list[str]) -> np.ndarray:
    """token_set_ratio of all of a (columns) with all of b (rows).

    Pairs are dealt by the words that they have in common, of which only frequent words count;
    the common words stand in front of both texts and are matched whole, so only what is left
    of both is compared.  The few pairs with a rare word in common are worked out one by one.
    """
    out = np.zeros((len(b), len(a)))
    x, y = [frozenset(t.split()) for t in a], [frozenset(t.split()) for t in b]
    at: dict[str, list[int]] = {}
    for i, words in enumerate(x):
        for w in words:
            at.setdefault(w, []).append(i)
    frequent = {w: np.isin(np.arange(len(a)), v) for w, v in at.items() if len(v) > 1 + len(a) // 100}
    usable = np.array([bool(words) for words in x])
    groups: dict[tuple, list[int]] = {}
    for k, words in enumerate(y):
        if words:
            groups.setdefault(tuple(sorted(w for w in words if w in frequent)), []).append(k)
    jobs: dict[tuple, list[tuple[list[int], np.ndarray]]] = {}
    for shared, ks in groups.items():
        sign = np.zeros(len(a), dtype=np.int64)
        for n, w in enumerate(shared):
            # numbered anew after each word: as many numbers as there are rows at most
            sign = np.unique(2 * sign + frequent[w], return_inverse=True)[1]
        for v in np.unique(sign[usable]):
            which = np.flatnonzero((sign == v) & usable)
            jobs.setdefault(tuple(w for w in shared if frequent[w][which[0]]), []).append((ks, which))
    for both, parts in jobs.items():
        cut = frozenset(both)
        rows = np.unique(np.concatenate([which for _, which in parts]))
        one = [" ".join(sorted(x[i] - cut)) for i in rows]
        where = {}
        for ks, which in parts:
            w = slice(None) if len(which) == len(rows) else np.searchsorted(rows, which)
            where |= dict.fromkeys(ks, (w, slice(None) if len(which) == len(a) else which))
        ks = list(where)
        two = [" ".join(sorted(y[k] - cut)) for k in ks]
        front = len(" ".join(both))
        space = 1 if both else 0
        p = np.array([float(len(t)) for t in one]) + (front + space)
        ahead, alone = 200.0 * front / (front + p), p == front + 1
        for n, lcs in _lcs_rows(one, two):
            q = len(two[n]) + front + space
            best = 200.0 * (lcs + (front + space)) / (p + q)
            if both and two[n]:
                best = np.maximum(best, np.maximum(ahead, 200.0 * front / (front + q)))
                best[alone] = 100.0
            elif both:
                best = np.full(len(rows), 100.0)
            w, which = where[ks[n]]
            out[ks[n], which] = best[w]
    for k, words in enumerate(y):
        for i in {i for w in words if w in at and w not in frequent for i in at[w]}:
            out[k, i] = token_set_ratio(a[i], b[k])
    return out


def name_scores(a: list[str], b: list[str]) -> np.ndarray:
    """What name_score gives for all of a (columns) with all of b (rows), to the bit."""
    out = np.empty((len(b), len(a)))
    short = [i for i, x in enumerate(a) if len(x) <= 64]
    for i in sorted(set(range(len(a))) - set(short)):
        out[:, i] = [0.6 * token_set_ratio(a[i], y) / 100 + 0.25 * ratio(a[i], y) / 100 for y in b]
    if short:
        x = [a[i] for i in short]
        size, tokens = np.array([float(len(t)) for t in x]), _token_set_shares(x, b)
        at = slice(None) if len(x) == len(a) else short
        for k, lcs in _lcs_rows(x, b):
            if b[k]:
                whole = 200.0 * lcs / (size + len(b[k]))
            else:
                whole = np.where(size > 0, 0.0, 100.0)
            out[k, at] = 0.6 * tokens[k] / 100 + 0.25 * whole / 100
    return out


def _millionths(score: np.ndarray) -> np.ndarray:
    """Scores in whole millionths, rounded half up as Spark rounds: by the shortest decimal."""
    scaled = score * 1e6
    out = np.floor(scaled)
    rest = scaled - out
    out += rest >= 0.5
    for i in zip(*np.nonzero(np.abs(rest - 0.5) < 1e-4), strict=True):
        out[i] = int((Decimal(repr(float(score[i]))) * 1_000_000).to_integral_value(ROUND_HALF_UP))
    return out.astype(np.int64)


_texts = lambda row: [x or "" for x in row]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _all_scores(l_names: pd.Series, r_names: pd.Series) -> pd.Series:
    return pd.Series([list(name_scores(_texts(a), _texts(b)).T) for a, b in zip(l_names, r_names, strict=True)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("l", T.IntegerType()), T.StructField("r", T.IntegerType())])))
def _best_places(l_names: pd.Series, r_names: pd.Series, l_places: pd.Series, r_places: pd.Series, r_ids: pd.Series) -> pd.Series:
    """Of each left row its best right row, the next and the best of another id; right rows are sorted by id."""
    out = []
    for a, b, at, bt, ids in zip(l_names, r_names, l_places, r_places, r_ids, strict=True):
        score = name_scores(_texts(a), _texts(b))
        codes = [pd.factorize(np.array([*_texts(p[n] for p in at), *_texts(p[n] for p in bt)], dtype=object))[0] for n in range(3)]
        rank = np.empty(score.shape, dtype=np.int64)
        for k in range(0, len(b), 32):  # few rows at once stay in the cache
            some, rows = score[k : k + 32], np.arange(k, min(k + 32, len(b)))
            for n, more in enumerate((0.08, 0.05, 0.02)):  # state, city, postal code
                known_ = np.array([bool(bt[j][n]) for j in rows])
                if known_.any():
                    some += np.where((codes[n][len(a) + rows][:, None] == codes[n][: len(a)]) & known_[:, None], more, 0.0)
            rank[k : k + 32] = _millionths(some) * len(b) + rows[:, None]
        same = pd.factorize(np.array(ids, dtype=object), use_na_sentinel=False)[0]
        every = np.arange(len(a))
        first = rank.argmax(axis=0)
        rank[first, every] = -1
        found = {(i, int(k)) for i, k in enumerate(first)}
        found |= {(i, int(k)) for i, k in enumerate(rank.argmax(axis=0)) if rank[k, i] >= 0}
        if len(set(same)) < len(b):
            rank[same[:, None] == same[first][None, :]] = -1
            found |= {(i, int(k)) for i, k in enumerate(rank.argmax(axis=0)) if rank[k, i] >= 0}
        out.append([{"l": i, "r": k} for i, k in sorted(found)])
    return pd.Series(out)


def _tiles(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """Pairs of tiles (key, l, r): the rows of each block, ``size`` a tile, every left tile with every right one.

    However large a block is, its pairs of tiles are dealt over all tasks, and no task holds more than one of them at a time.
    """

    def tiles(d: DataFrame, name: str) -> DataFrame:
        columns = [c for c in (*_COLUMNS, "legal_suffix") if c in d.columns]
        keys = block_keys(F.col("state"), F.col("core_name"), F.col("acronym"), F.col("postal_code"))
        rows = d.select(F.struct(*columns).alias("x"), keys.alias("keys")).where(F.size("keys") > 0)
        rows = rows.groupBy("x").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
        rows = rows.select("x", "keys", F.explode("keys").alias("key"))
        n = rows.groupBy("key").agg(F.ceil(F.count("*") / size).alias("n"))
        dealt = rows.join(n, "key").withColumn(f"{name}_tile", F.pmod(F.xxhash64("x"), F.col("n")))
        return dealt.groupBy("key", f"{name}_tile").agg(F.array_sort(F.collect_list(F.struct("x.*", "keys"))).alias(name))

    spark = left.sparkSession
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(batch).removesuffix("b")) > 8 << 20:
        spark.conf.set(batch, str(8 << 20))
    both = tiles(left, "l").join(tiles(right, "r"), "key")
    return both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "l_tile", "r_tile").select("key", "l", "r")


def _flat(pairs: DataFrame, *more: str) -> DataFrame:
    """The columns of both sides' structs, except their keys."""
    kind = {p: [f.name for f in pairs.schema[p].dataType if f.name != "keys"] for p in "lr"}
    return pairs.select(*(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "lr" for c in kind[p]), *more)


def _scored(pairs: DataFrame, name: Column) -> DataFrame:
    same = lambda c: (F.col(f"l_{c}") == F.col(f"r_{c}")) & (F.col(f"l_{c}") != "")
    score = name + F.when(same("state"), 0.08).otherwise(0.0) + F.when(same("city"), 0.05).otherwise(0.0) + F.when(same("postal_code"), 0.02).otherwise(0.0)
    return pairs.withColumns({"score": F.round(score, 6), "location_agreement": same("state") & (same("city") | same("postal_code"))})


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs that share a block, scored.

    Both sides have id, core_name, acronym, state, city, postal_code.  A pair is made under the
    first of the keys that it shares, so that no pairs are shuffled.
    """
    t = _tiles(left, right, PAIR_TILE).withColumn("s", _all_scores("l.core_name", "r.core_name"))
    t = t.select("key", "r", F.explode(F.arrays_zip("l", "s")).alias("x")).select("key", F.col("x.l").alias("l"), F.explode(F.arrays_zip(F.col("r"), F.col("x.s").alias("s"))).alias("y"))
    pairs = t.select("key", "l", F.col("y.r").alias("r"), F.col("y.s").alias("name"))
    pairs = pairs.where((F.col("l.keys")[0] == F.col("key")) | (F.array_intersect("l.keys", "r.keys")[0] == F.col("key")))
    return _scored(_flat(pairs, "name"), F.col("name")).drop("name")


def best_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of candidate_pairs those that can be a left row's best, its next or the best of another id.

    All pairs are scored, but a tile returns three for each of its left rows at most.
    """
    place = lambda c: F.transform(c, lambda x: F.array(x["state"], x["city"], x["postal_code"]))
    t = _tiles(left, right, BEST_TILE).withColumn("best", _best_places("l.core_name", "r.core_name", place("l"), place("r"), "r.id"))
    t = t.select("l", "r", F.explode("best").alias("b")).select(F.col("l")[F.col("b.l")].alias("l"), F.col("r")[F.col("b.r")].alias("r"))
    pairs = _flat(t).distinct()
    return _scored(pairs, name_score("l_core_name", "r_core_name"))


def decide(pairs: DataFrame) -> DataFrame:
    """Each left id's best candidate, its margin over the next, and what follows from them.

    A sole candidate's margin is its score.  Ties go to the larger id, as in the ranking.
    """
    w = W.partitionBy("l_id").orderBy(F.col("score").desc(), F.col("r_id").desc())
    best = pairs.withColumns({"rn": F.row_number().over(w), "next": F.lead("score").over(w)}).where("rn = 1")
    best = best.withColumn("margin", F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6))
    status = F.when((F.col("score") >= AUTO) & (F.col("margin") >= MARGIN) & F.col("location_agreement"), "HIGH_CONFIDENCE_AUTO").when(F.col("score") >= REVIEW, "REVIEW_REQUIRED").otherwise("NEW_ENTITY")
    return best.select(F.col("l_id").alias("id"), F.col("r_id").alias("candidate_id"), "score", "margin", "location_agreement", status.alias("match_status"))


# --- the whole resolution ---------------------------------------------------------------


class ConflictingAliases(ValueError):
    """Reviewed aliases of equal specificity name different entities."""


def select_override(observations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(observation_id, override_id): the most specific reviewed alias of each observation.

    An alias has the normalized name and may ask for a source, city, state and postal code;
    one that asks for the source is more specific than one that doesn't, then city, and so on.
    """
    asks = ("source_id", "city", "state", "postal_code")
    a = aliases.select("normalized_name", *(F.col(c).alias(f"__{c}") for c in asks), F.col("legal_entity_id").alias("override_id"))
    hit = observations.where("normalized_name <> ''").select("observation_id", "normalized_name", *asks).join(a, "normalized_name")
    for c in asks:
        hit = hit.where(F.col(f"__{c}").isNull() | (F.col(f"__{c}") == F.col(c)))
    rank = F.struct(*(F.col(f"__{c}").isNotNull() for c in asks))
    each = hit.groupBy("observation_id", rank.alias("rank")).agg(F.count_distinct("override_id").alias("n"), F.max("override_id").alias("override_id"))
    best = each.groupBy("observation_id").agg(F.max(F.struct("rank", "n", "override_id")).alias("b")).select("observation_id", "b.n", "b.override_id")
    if clash := best.where("n > 1").select("observation_id").take(1):
        raise ConflictingAliases(f"reviewed aliases conflict for observation {clash[0][0]}")
    return best.select("observation_id", "override_id")


def _select_rejection(observations: DataFrame, rejections: DataFrame) -> DataFrame:
    """(observation_id, rejected_id); a rejection for the source goes before one for all."""
    r = rejections.select("normalized_name", F.col("source_id").alias("__source"), F.col("candidate_legal_entity_id").alias("rejected_id"))
    hit = observations.select("observation_id", "normalized_name", "source_id").join(r, "normalized_name").where(F.col("__source").isNull() | (F.col("__source") == F.col("source_id")))
    return hit.groupBy("observation_id").agg(F.max(F.struct(F.col("__source").isNotNull().alias("own"), "rejected_id"))["rejected_id"].alias("rejected_id"))


def fuzzy_candidates(observations: DataFrame, entities: DataFrame) -> DataFrame:
    """(observation_id, fuzzy_id, fuzzy_score, margin, auto): the best known entity of a shared block."""
    pairs = best_pairs(observations.withColumnRenamed("observation_id", "id"), entities.where("core_name <> ''").withColumnRenamed("legal_entity_id", "id"))
    safe = F.col("location_agreement") & ~suffix_conflict(F.col("l_legal_suffix"), F.col("r_legal_suffix")) & scope_compatible(F.col("l_core_name"), F.col("r_core_name"))
    by_score = F.struct("score", F.col("r_id").alias("id"), known(safe).alias("safe"))
    # three pairs a tile at most, so an observation's list is short
    both = pairs.groupBy("l_id").agg(F.max(by_score).alias("b"), F.collect_list(F.struct("score", "r_id")).alias("all"))
    rest = F.filter("all", lambda x: x["r_id"] != F.col("b.id"))
    both = both.withColumn("next", F.array_max(F.transform(rest, lambda x: x["score"])))
    both = both.withColumn("margin", F.round(F.col("b.score") - F.coalesce("next", F.lit(0.0)), 6))
    auto = F.col("b.safe") & (F.col("b.score") >= AUTO) & (F.col("margin") >= MARGIN)
    return both.select(F.col("l_id").alias("observation_id"), F.col("b.id").alias("fuzzy_id"), F.col("b.score").alias("fuzzy_score"), "margin", auto.alias("auto"))


_PLACE = ("core_name", "state", "city", "postal_code")
_DECISION = "observation_id string, match_status string, match_method string, legal_entity_id string, candidate_legal_entity_id string, match_score double, candidate_margin double"


def _score(a, b) -> float:
    same = lambda c: bool(a[c]) and a[c] == b[c]
    name = 0.6 * token_set_ratio(a["core_name"], b["core_name"]) / 100 + 0.25 * ratio(a["core_name"], b["core_name"]) / 100
    return round(name + 0.08 * same("state") + 0.05 * same("city") + 0.02 * same("postal_code"), 6)


def _conflict(a, b) -> bool:
    return bool(a["state"] and b["state"] and (a["state"] != b["state"] or (a["city"] and b["city"] and a["city"] != b["city"])))


def _of_one_name(name: str, seen: list[dict], known_: list[dict]) -> list[tuple]:
    """Decisions on all observations of one normalized name, the commonest first.

    Only here does order count: an entity that one observation founds has the name that the
    later ones are held against.
    """
    named = {r["legal_entity_id"]: r for r in known_}
    order = ("state", "city", "source_id", "alias_raw", "postal_code", "observation_id")
    rows = sorted(seen, key=lambda r: (-r["occurrence_count"], *((r[c] is None, r[c] or "") for c in order)))
    out = []
    for r in rows:
        status, method, entity, candidate, score, margin = "UNRESOLVED", "NO_NAME", None, None, 0.0, None
        near = [k for k, e in sorted(named.items()) if not _conflict(r, e)]
        if r["override_id"] is not None:
            status, method, entity, score = "MANUAL_OVERRIDE", "REVIEWED_ALIAS", r["override_id"], 1.0
        elif not name:
            pass
        elif len(near) == 1:
            status, method, entity, score = "DETERMINISTIC", "EXACT_NORMALIZED_NAME", near[0], 1.0
        elif len(named) == 1:
            candidate = next(iter(named))
            status, method, score = "REVIEW_REQUIRED", "EXACT_NAME_LOCATION_CONFLICT_UNMERGED", _score(r, named[candidate])
        else:
            candidate, score, margin = r["fuzzy_id"], r["fuzzy_score"] or 0.0, r["margin"]
            if r["rejected_core_name"] is not None:
                candidate = r["rejected_id"]
                score = _score(r, {c: r[f"rejected_{c}"] for c in _PLACE})
            if candidate is not None and candidate == r["rejected_id"]:
                status, method = "REJECTED", "REVIEWED_REJECTION"
            elif candidate is not None and r["auto"]:
                status, method, entity = "HIGH_CONFIDENCE_AUTO", "FUZZY_NAME_WITH_LOCATION", candidate
            elif candidate is not None and score >= REVIEW:
                status, method = "REVIEW_REQUIRED", "FUZZY_CANDIDATE_UNMERGED"
        if entity is None and name:
            entity = r["own_id"]
            named.setdefault(entity, r)
            if status == "UNRESOLVED":
                status, method, score = "DETERMINISTIC", "NEW_SOURCE_LEGAL_ENTITY", 1.0
        out.append((r["observation_id"], status, method, entity, candidate, score, margin))
    return out


def _of_names(batches):
    """Batches of names with their observations and known entities into decisions; many names a call."""
    kinds = [(f, pa.float64() if f in ("match_score", "candidate_margin") else pa.string()) for f in (x.split()[0] for x in _DECISION.split(", "))]
    for batch in batches:
        out = [d for r in batch.to_pylist() for d in _of_one_name(r["normalized_name"], r["seen"], r["known"] or [])]
        yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in out], kind) for n, (_, kind) in enumerate(kinds)], names=[f for f, _ in kinds])


def resolve(observations: DataFrame, entities: DataFrame, aliases: DataFrame, rejections: DataFrame) -> DataFrame:
    """A decision for every observation.

    Observations: observation_id, source_id, alias_raw, occurrence_count and, like the known
    entities (legal_entity_id), normalized_name, core_name, acronym, legal_suffix, city, state,
    postal_code, all text and never null.  All entities of a shared block are scored, without a
    shortlist.  One task holds the distinct places under which one name was observed.
    """
    found = fuzzy_candidates(observations, entities)
    rejected = _select_rejection(observations, rejections)
    place = entities.select(F.col("legal_entity_id").alias("rejected_id"), *(F.col(c).alias(f"rejected_{c}") for c in _PLACE))
    rows = observations.select("observation_id", "source_id", "alias_raw", "occurrence_count", "normalized_name", *_PLACE, stable_id("legal_source", F.col("normalized_name"), F.col("state"), F.col("city")).alias("own_id"))
    rows = rows.join(select_override(observations, aliases), "observation_id", "left").join(found, "observation_id", "left")
    rows = rows.join(rejected.join(place, "rejected_id", "left"), "observation_id", "left")
    names = entities.select("normalized_name", "legal_entity_id", *_PLACE)
    together = lambda d, name: d.groupBy("normalized_name").agg(F.collect_list(F.struct(*(c for c in d.columns if c != "normalized_name"))).alias(name))
    every = together(rows, "seen").join(together(names, "known"), "normalized_name", "left")
    return every.mapInArrow(_of_names, _DECISION)


def attach_ids(rows: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows with the ids of their observations; fails if an observation has two decisions."""
    return checked_join(rows, decisions, keys)
