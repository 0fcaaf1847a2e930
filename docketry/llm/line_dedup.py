"""Line deduplication with a fixed-depth template tree.

A line's path in the tree is its token count and its first ``LEAD`` tokens.  Letters A-Z
count as lower case, and a token that holds a digit is a variable field and reads as a
wildcard where more than half of the line's tokens are without digits (a line of little
but numbers is compared as it is).  The leaf looks at the other tokens in up to ``RUNS``
positions: each token is one, and in longer lines each of ``RUNS`` equal runs of tokens.

Two lines of a leaf are alike if they agree in all but a quarter of their positions, the
first tokens counted: the template with wildcards at the positions where they differ
matches both.  So lines of under four tokens are alike only if all their tokens agree,
lines of 4 to 7 tokens may differ in one, and long ones in three runs.

A line recurs if it has an alike line, or itself, in another document; it is dropped from
every document but the first (by doc_id) that has it or an alike line, so that text that
many documents share stays once, or from all documents with ``keep_first=False``.  Repeats
within one document are not recurrences.

Leaves are not gathered.  Lines that differ in at most k positions agree in one of k + 1
groups of positions, so a line has that many keys, and aggregates find the keys that
several distinct lines of several documents have.  A table of bits about them (see
``bits``) and a join pick the lines concerned.  Each is held against the first line of its key, which settles all lines of one template whatever their
number; only keys that also hold lines unlike their first one are compared further, in pairs of
tiles of ``TILE`` lines, of which no pair is emitted.  Positions are compared by 32-bit
hashes, with one group of them by 64 bits.

Defined results: null and empty texts have no lines and are left as they are, and blank
lines always stay; documents with a null doc_id count as one document, after all others;
rows that repeat a doc_id are one document; other columns pass through, those named like
an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bits import may_have, table_of
from docketry.llm.text import NOT_SPACE, chunks, frugal, mix, small_batches, words
from docketry.session import Scratch

LEAD, RUNS, TILE = 2, 12, 2048
_STEP, _WILD, _PLAIN, _KEY = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F))
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
NO_ID = 2**63 - 1


def allowed(positions: int | np.ndarray) -> int | np.ndarray:
    """Positions after the first tokens in which alike lines may differ."""
    return (LEAD + positions) // 4


def _cuts(first: np.ndarray, n: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal parts of spans of n: each part's line, number, first and end."""
    line = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)
    return line, k, first[line] + n[line] * k // parts[line], first[line] + n[line] * (k + 1) // parts[line]


def paths(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all lines of a chunk: document, line in it, key of the whole line, number of positions and their hashes, number of keys and those.

    Lines that are alike only if equal have no positions.
    """
    w = words(b, o, NOT_SPACE)
    if not len(w.hashes):
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64), z, z.astype(np.uint32), z, z.view(np.uint64)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[b])])
    field = digits[w.ends] > digits[w.starts]
    breaks = np.concatenate([[0], np.cumsum(b == 10)])
    doc = np.searchsorted(o, w.starts, side="right") - 1
    line = breaks[w.starts] - breaks[o[doc]]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]))
    n = np.diff(first, append=len(field))
    fields = np.concatenate([[0], np.cumsum(field)])
    masked = 2 * (fields[first + n] - fields[first]) < n
    h = np.where(field & np.repeat(masked, n), _WILD, w.hashes)
    pos = (np.arange(len(h)) - np.repeat(first, n)).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + pos * _STEP))])
    size = n.astype(np.uint64)
    whole = mix(total[first + n] - total[first] + size * _STEP + np.where(masked, np.uint64(0), _PLAIN))

    positions = np.where(masked, np.clip(n - LEAD, 0, RUNS), 0)
    positions[allowed(positions) == 0] = 0
    at, _, lo, hi = _cuts(first + LEAD, n - LEAD, positions)
    runs = (mix(total[hi] - total[lo]) >> np.uint64(32)).astype(np.uint32)
    keys = np.where(positions > 0, allowed(positions) + 1, 0)
    at, k, lo, hi = _cuts(np.zeros(len(n), np.int64), positions, keys)
    m, p = (n - LEAD)[at], positions[at]
    lo, hi = (first[at] + LEAD + m * x // p for x in (lo, hi))
    leaf = mix(total[first[at] + LEAD] - total[first[at]] + size[at] * _STEP)
    key = mix(leaf + mix(total[hi] - total[lo] + k.astype(np.uint64) * _KEY))
    return doc[first], line[first], whole, positions, runs, keys, key


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for i, _, b, o in chunks(batch.column(2)):
            doc, line, whole, positions, runs, keys, key = paths(b, o)
            yield pa.record_batch(
                [pa.array(whole.view(np.int64)), pa.array(d[i + doc]), pa.array(h[i + doc]), pa.array(line, pa.int32()), _lists(runs.view(np.int32), positions, pa.int32()), _lists(key.view(np.int64), keys, pa.int64())],
                names=["whole", "d", "h", "line", "runs", "keys"],
            )


def _having(shared):
    """Lines with a key that the table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            keys = batch.column(3)
            found = np.concatenate([[0], np.cumsum(may_have(table, keys.flatten().to_numpy()))])
            o = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            yield batch.filter(pa.array(found[o[1:]] > found[o[:-1]]))

    return run


def _alike_in_tiles(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of the open lines of a pair of tiles, the first and last document of their alike lines in it."""
    t1, t2 = key[1].as_py(), key[2].as_py()
    tile, whole, first, last, open_ = (table.column(x).to_numpy() for x in ("tile", "whole", "first", "last", "open"))
    runs = np.stack([x.values.to_numpy() for x in table.column("runs")])
    most = allowed(runs.shape[1])
    found, lo, hi = [], [], []
    for one, other in {(t1, t2), (t2, t1)}:
        y = np.flatnonzero(tile == other)
        for x in np.flatnonzero((tile == one) & open_):
            same = y[((runs[y] != runs[x]).sum(axis=1) <= most)]
            same = same[same != x]
            if len(same):
                found.append(whole[x])
                lo.append(first[same].min())
                hi.append(last[same].max())
    return pa.table({"whole": pa.array(found, pa.int64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})


def _alike(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(whole, lo, hi): first and last document of lines alike, but not equal, to a line."""
    spark = lines.sparkSession
    each = lines.where("size(keys) > 0").select("whole", "d", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.min("whole").alias("w"), F.max("whole").alias("v"), F.min("d").alias("first"), F.max("d").alias("last")).where("w < v and first < last")
    shared = scratch.table(shared.select("key"), "keys")
    table = table_of(shared)
    some = lines.select("whole", "d", "runs", "keys").where("size(keys) > 0").mapInArrow(frugal(_having(spark.sparkContext.broadcast(table))), "whole long, d long, runs array<int>, keys array<long>")
    some = some.groupBy("whole").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.first("runs").alias("runs"), F.first("keys").alias("keys"))
    members = scratch.table(some.select("whole", "first", "last", "runs", F.explode("keys").alias("key")).join(shared, "key"), "members")
    # the first line of each key, against which all others are held
    heads = members.groupBy("key").agg(F.min(F.struct("first", "whole", "last", "runs")).alias("head"), F.count("*").alias("n")).where("n > 1")
    differ = F.aggregate(F.zip_with("runs", "head.runs", lambda x, y: (x != y).cast("int")), F.lit(0), lambda x, y: x + y)
    held = members.join(heads, "key").where("whole <> head.whole").withColumn("ok", differ <= F.floor((F.size("runs") + LEAD) / 4))
    # a line is open if this key's first line doesn't tell all that can be known through it
    told = (F.col("first") != F.col("last")) | (F.col("head.first") != F.col("first")) | (F.col("head.last") != F.col("last"))
    held = scratch.table(held.withColumn("open", ~(F.col("ok") & told)), "held")
    pair = lambda w, lo, hi: F.struct(F.col(w).alias("whole"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    found = held.where("ok").select(F.explode(F.array(pair("whole", "head.first", "head.last"), pair("head.whole", "first", "last"))).alias("x")).select("x.*")
    # where some lines are open, all but the head, which has met every line, are compared in tiles
    rest = held.groupBy("key").agg(F.max("open").alias("any"), F.count("*").alias("m")).where("any and m > 1")
    rest = held.select("key", "whole", "first", "last", "runs", "open").join(rest.select("key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")), "key")
    rest = rest.withColumn("tile", F.pmod(F.xxhash64("whole"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rest = rest.withColumns({"t1": F.least("tile", "o"), "t2": F.greatest("tile", "o")})
    more = rest.groupBy("key", "t1", "t2").applyInArrow(_alike_in_tiles, "whole long, lo long, hi long")
    out = scratch.table(found.unionByName(more).groupBy("whole").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "alike")
    scratch.drop(shared, members, held)
    return out


def _without(names: list[str], at: int):
    """The texts without their dropped lines; the columns after the texts are (dropped, recurring)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            text, k = batch.column(at), batch.num_columns - 2
            dropped, again = batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()
            out, lines = [], []
            for t, gone in zip(text.to_pylist(), dropped, strict=True):
                parts = t.split("\n") if t else []
                lines.append(len(parts))
                if gone:
                    gone = set(gone)
                    t = "\n".join(p for x, p in enumerate(parts) if x not in gone)
                out.append(t)
            cols = [pa.array(out, pa.string()) if x == at else batch.column(x) for x in range(k)]
            yield pa.record_batch([*cols, pa.array(lines, pa.int64()), pa.array([x or 0 for x in again], pa.int64()), pa.array([len(x or ()) for x in dropped], pa.int64())], names=names)

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = True) -> DataFrame:
    """The documents with dropped lines gone from their texts, and n_lines, n_recurring, n_dropped."""
    added = ["n_lines", "n_recurring", "n_dropped"]
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    d, h = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.col(text_col))
    rows = docs.select(d.alias("d"), h.alias("h"), F.col(text_col).alias("text")).where("text <> ''")
    lines = scratch.table(rows.mapInArrow(frugal(_lines), "whole long, d long, h long, line int, runs array<int>, keys array<long>"), "lines")
    # by the largest and least document, which partial aggregates keep small whatever recurs
    equal = lines.groupBy("whole").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi")
    alike = _alike(lines, scratch)
    often = equal.unionByName(alike).groupBy("whole").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    hit = lines.select("whole", "d", "h", "line").join(often, "whole").where("lo < d or hi > d")
    drop = F.col("lo") < F.col("d") if keep_first else F.lit(True)
    gone = hit.groupBy("d", "h").agg(F.collect_set(F.when(drop, F.col("line"))).alias("__gone"), F.size(F.collect_set("line")).cast("long").alias("__again"))
    gone = scratch.table(gone, "gone")
    scratch.drop(lines, alike)
    kept = [c for c in docs.columns if c.lower() not in added]
    keyed = docs.select(*(F.col(f"`{c}`") for c in kept), d.alias("__d"), h.alias("__h"))
    gone = gone.withColumnsRenamed({"d": "__gd", "h": "__gh"})
    full = keyed.join(gone, (F.col("__d") == F.col("__gd")) & (F.col("__h") == F.col("__gh")), "left")
    full = full.select(*(F.col(f"`{c}`") for c in kept), "__gone", "__again")
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema
    for c in added:
        schema = schema.add(c, "long")
    return full.mapInArrow(frugal(_without([*kept, *added], kept.index(text_col))), schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates in the whole ``documents``, and what is left of each text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_recurring", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
