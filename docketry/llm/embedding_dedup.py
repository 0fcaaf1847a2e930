"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are normalised in double precision and rotated into the eigenbasis of their second
moments (over all rows; d x d sums are all that leaves the executors), leading dimensions
first.  A rotation keeps every cosine, so nothing here is approximate.

* Two unit vectors of cosine c are sqrt(2 - 2c) apart, so also in each coordinate: a grid
  of that width over the first ``GRID`` rotated coordinates lets only adjacent cells meet.
* Cells are cut into tiles of bounded bytes, so a hot cell becomes many pairs of tiles
  dealt over tasks; no task ever holds more than two tiles.
* Within a pair of tiles dot products are accumulated block of dimensions by block.  What
  the remaining dimensions can add is at most the product of the suffix norms; columns and
  rows that cannot reach the threshold with any partner are dropped after each block, and
  a comparison stops when none is left.  Pairs that survive are judged by the dot product
  of the original normalised vectors.

A pair of tiles returns a count for each vector and a spanning forest of its links, so
what is shuffled grows with vectors, not with links.

Defined results: a vector that is null, zero, or holds null or non-finite components, or
whose label is null, links with nothing; vectors of different lengths never link; a null
vec_id links with nothing, has a null component and is kept; rows that repeat a vec_id
share a component, are counted one by one by their neighbours and not by each other, and
each shows the sum of their links; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.components import connected_components
from docketry.session import Scratch

THRESHOLD, GRID, TILE_BYTES, TILE_ROWS, BLOCK = 0.93, 2, 4 << 20, 4096, 16
_SLACK = 1e-9


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid rows with their vectors at unit length, as bytes."""
    for batch in batches:
        ids, labels, dims, out = [], [], [], []
        for i, label, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if i is None or label is None or not e.is_valid or e.values.null_count or not len(e.values):
                continue
            x = e.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            if not np.isfinite(top) or not top:
                continue
            x = x / top  # so that no square overflows or vanishes
            ids.append(i)
            labels.append(label)
            dims.append(len(x))
            out.append((x / np.linalg.norm(x)).tobytes())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "x"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in col])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dim = batch.column(0).to_numpy()
        for d in np.unique(dim):
            x = _matrix(batch.column(1).filter(pa.array(dim == d)))
            total[int(d)] = total.get(int(d), 0) + x.T @ x
    for d, m in total.items():
        yield pa.record_batch([pa.array([d] * d, pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["dim", "row", "sums"])


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    sums = np.sum([v.values.to_numpy() for v in table.column("sums")], axis=0)
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([sums], pa.list_(pa.float64()))})


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the eigenvectors of the second moments, largest first, as columns."""
    rows: dict[int, dict[int, list[float]]] = {}
    parts = units.select("dim", "x").mapInArrow(_moments, "dim int, row int, sums array<double>")
    for r in parts.groupBy("dim", "row").applyInArrow(_summed, "dim int, row int, sums array<double>").toLocalIterator():
        rows.setdefault(r["dim"], {})[r["row"]] = r["sums"]
    out = {}
    for d, m in rows.items():
        _, v = np.linalg.eigh(np.array([m[k] for k in range(d)]))
        out[d] = np.ascontiguousarray(v[:, ::-1])
    return out


def _cells(axes, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = 0
        for batch in batches:
            dim, n = batch.column(2).to_numpy(), batch.num_rows
            place, begin = np.arange(begin, begin + n), begin + n
            c = np.zeros((n, GRID), dtype=np.int32)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                z = _matrix(batch.column(3).take(pa.array(at))) @ axes.value[int(d)][:, :GRID]
                c[at, : z.shape[1]] = np.floor(z / width).astype(np.int32)
            yield pa.record_batch([*(batch.column(k) for k in range(4)), *(pa.array(c[:, k]) for k in range(GRID)), pa.array(place)], names=["vec_id", "label", "dim", "x", *(f"c{k}" for k in range(GRID)), "place"])

    return run


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row for a tile: its ids and vectors."""
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = _matrix(table.column("x").combine_chunks())[order]
    names = ("label", "dim", *(f"c{k}" for k in range(GRID)), "tile")
    cols = {n: pa.array([k.as_py()], t) for n, k, t in zip(names, key, (pa.string(), *(pa.int32(),) * (GRID + 2)), strict=True)}
    return pa.table(cols | {"ids": pa.array([ids[order].tobytes()], pa.binary()), "xs": pa.array([x.tobytes()], pa.binary())})


def close_pairs(a: np.ndarray, b: np.ndarray, za: np.ndarray, zb: np.ndarray, threshold: float, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of cosine at least the threshold; za and zb are a and b rotated.

    Rows of a go in strips; after each block of dimensions only columns that some row can
    still reach stay, and rows without one go.
    """
    d = za.shape[1]
    edges = [0, *range(min(4, d), d, BLOCK), d]
    tail = lambda z: np.sqrt(np.maximum(np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1], 0))
    ta, tb = (np.concatenate([tail(z), np.zeros((len(z), 1))], axis=1) for z in (za, zb))
    for s in range(0, len(a), 256):
        rows, cols = np.arange(s, min(s + 256, len(a))), np.arange(s if own else 0, len(b))
        sums = np.zeros((len(rows), len(cols)))
        for p, q in zip(edges[:-1], edges[1:], strict=True):
            sums += za[rows, p:q] @ zb[cols, p:q].T
            can = sums + np.outer(ta[rows, q], tb[cols, q]) >= threshold - _SLACK
            if own:
                can &= cols[None, :] > rows[:, None]
            r, c = can.any(axis=1), can.any(axis=0)
            if not r.any():
                rows = rows[:0]
                break
            rows, cols = rows[r], cols[c]
            sums, can = sums[np.ix_(r, c)], can[np.ix_(r, c)]
        if len(rows):
            i, j = np.nonzero(can)
            i, j = rows[i], cols[j]
            for k in range(0, len(i), 100_000):
                x, y = i[k : k + 100_000], j[k : k + 100_000]
                ok = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
                yield x[ok], y[ok]


def _forest(i: np.ndarray, j: np.ndarray, up: np.ndarray) -> list[tuple[int, int]]:
    """Links that join two trees of the union-find ``up``, which is updated."""

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _compared(axes, threshold: float):
    """For each pair of tiles: (a, null, links of a) and (a, b, 0) for the links of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                d, own = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                read = lambda k, t: np.frombuffer(batch.column(k)[r].as_buffer(), t)  # noqa: B023, E731
                ia, a = read(2, np.int64), read(3, np.float64).reshape(-1, d)
                ib, b = (ia, a) if own else (read(4, np.int64), read(5, np.float64).reshape(-1, d))
                v = axes.value[d]
                za = a @ v
                zb = za if own else b @ v
                na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
                shift = 0 if own else len(ia)
                up, ids = np.arange(shift + len(ib)), ia if own else np.concatenate([ia, ib])
                links: list[tuple[int, int]] = []
                for i, j in close_pairs(a, b, za, zb, threshold, own):
                    other = ia[i] != ib[j]
                    np.add.at(na, i[other], 1)
                    np.add.at(na if own else nb, j[other], 1)
                    links += _forest(i, j + shift, up)
                x = np.concatenate([ia[na > 0], ib[nb > 0] if not own else ib[:0], ids[[p for p, _ in links]] if links else ia[:0]])
                n = np.concatenate([na[na > 0], nb[nb > 0] if not own else nb[:0], np.zeros(len(links), np.int64)])
                y = np.concatenate([np.zeros(len(x) - len(links), np.int64), ids[[q for _, q in links]] if links else ia[:0]])
                yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64(), mask=n > 0), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return run


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``; label None compares all with all."""
    spark = df.sparkSession
    scratch = Scratch(spark, "embeddings")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("x"))
    units = scratch.table(rows.mapInArrow(_unit, "vec_id long, label string, dim int, x binary"), "units")
    axes = spark.sparkContext.broadcast(principal_axes(units))
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    cell = ["label", "dim", *(f"c{k}" for k in range(GRID))]
    placed = units.mapInArrow(_cells(axes, width), "vec_id long, label string, dim int, x binary, " + ", ".join(f"c{k} int" for k in range(GRID)) + ", place long")
    placed = scratch.table(placed, "placed")
    most = F.least(F.lit(TILE_ROWS), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (F.col("dim") * 8))))
    sizes = scratch.table(placed.groupBy(*cell).agg(F.count("*").alias("n")).select(*cell, F.ceil(F.col("n") / most).cast("int").alias("tiles")), "sizes")
    # by where the row was read, so that equal rows are dealt out too
    tiled = placed.join(sizes, cell).withColumn("tile", F.pmod(F.xxhash64("vec_id", "place"), F.col("tiles")).cast("int"))
    kinds = "label string, dim int, " + ", ".join(f"c{k} int" for k in range(GRID)) + ", tile int, ids binary, xs binary"
    tiles = scratch.table(tiled.select(*cell, "tile", "vec_id", "x").groupBy(*cell, "tile").applyInArrow(_pack, kinds), "tiles")
    # each tile with those of its own and of half the neighbouring cells: a list of names, not of rows
    near = [(0, y) for y in (0, 1)] + [(1, y) for y in (-1, 0, 1)]
    here = sizes.withColumn("s", F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"s{k}") for k, v in enumerate(s))) for s in near))))
    there = sizes.select(*(F.col(c).alias(f"_{c}") for c in cell), F.col("tiles").alias("_tiles"))
    meet = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))
    for k in range(GRID):
        meet &= (F.col(f"c{k}") + F.col(f"s.s{k}")) == F.col(f"_c{k}")
    pairs = here.join(there, meet).withColumn("t1", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    same = (F.col("s.s0") == 0) & (F.col("s.s1") == 0)
    pairs = pairs.withColumn("t2", F.explode(F.sequence(F.when(same, F.col("t1")).otherwise(0), F.col("_tiles") - 1)))
    name = lambda p, t: F.struct(*(F.col(f"{p}{c}").alias(c) for c in cell), F.col(t).alias("tile"))
    pairs = pairs.select("dim", name("", "t1").alias("one"), name("_", "t2").alias("two"))
    named = tiles.select(F.struct(*cell, "tile").alias("name"), "ids", "xs")
    left = named.select(F.col("name").alias("one"), F.col("ids").alias("ids1"), F.col("xs").alias("xs1"))
    right = named.select(F.col("name").alias("two"), F.col("ids").alias("ids2"), F.col("xs").alias("xs2"))
    full = pairs.join(left, "one").join(right, "two").repartition(F.xxhash64("one", "two"))
    found = full.select("dim", (F.col("one") == F.col("two")).alias("own"), "ids1", "xs1", "ids2", "xs2").mapInArrow(_compared(axes, threshold), "a long, b long, n long")
    found = scratch.table(found, "found")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n_links"))
    parts = connected_components(found.where("b is not null").select("a", "b"), scratch)
    out = rows.select("vec_id").join(counts.withColumnRenamed("a", "vec_id"), "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    scratch.drop(units, placed, tiles)
    root = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings`` of equal label, cosine 0.93 or more."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
