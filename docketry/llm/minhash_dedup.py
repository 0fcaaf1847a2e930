"""MinHash near-duplicate detection with tensored banding.

Each document's distinct word shingles are hashed.  Instead of drawing fresh minhashes
for every table, ``collections`` small collections of ``width`` minhashes are drawn once
and the key of table (i, j) combines collections i and j, so that c collections give
c(c-1)/2 tables (Andoni and Indyk's tensoring) for the minhashes of c.  Two documents
meet in some table unless fewer than two of their collections agree; with the defaults
(14 collections of 2) a pair of similarity exactly 0.8 is missed with probability 2e-5,
one of 0.9 with 1e-9.  Every pair that counts is confirmed on the full shingle sets.

Work is arranged so that no group, however large, meets in one task:

* documents of equal shingle sets collapse into one representative by an aggregate;
* each table first links every member with the bucket's least member (an aggregate and
  an equi-join), which connects real groups with a number of pairs linear in members;
  a member that leads many is dealt out in parts of about ``PART`` partners;
* only buckets that still hold several components are then compared pairwise, those of
  more than ``large`` members in pairs of tiles of about ``tile`` shingles; pairs already
  connected are passed over, and no link is lost to a cap.

A pair is passed over without its sets only where it can't be similar: by its sizes, or
because the sets' histograms over equal hash ranges (``sketch``) bound their intersection
from above, and even that many common shingles would be too few.  Sets are compared as
sets of 64-bit hashes of shingles (see ``text``).

Defined results: null or wordless text has no shingles and links with nothing; a null
doc_id links with nothing, has a null component and is kept; rows that repeat a doc_id
share that id's component; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bits import may_have, table_of
from docketry.llm.components import connected_components
from docketry.llm.text import NOT_SPACE, chunks, frugal, mix, small_batches, words
from docketry.session import Scratch

COLLECTIONS, WIDTH, SHINGLE, PERCENT = 14, 2, 5, 80
#: Buckets of more members are compared in tiles of about so many shingles.
LARGE, TILE = 64, 500_000
#: Partners of one document that are confirmed in one group.
PART = 256

_SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"


def shingle_sets(col: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; fewer words than ``size`` make one shingle."""
    for i, j, b, o in chunks(col):
        w = words(b, o, NOT_SPACE)
        for k in range(j - i):
            h = w.hashes[w.first[k] : w.first[k + 1]]
            if not len(h):
                yield h
                continue
            n = max(1, len(h) - size + 1)
            s = np.zeros(n, dtype=np.uint64)
            for x in range(min(size, len(h))):
                s = mix(s + h[x : x + n] + np.uint64(x + 1))
            yield np.unique(s)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(17)
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def _minhash(s: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.uint64(2**64 - 1))
    for k in range(0, len(s), 4096):
        np.minimum(out, (s[k : k + 4096, None] * a + c).min(axis=0), out=out)
    return out


#: Least and most hash ranges of a histogram; about half as many as there are shingles.
BINS = (64, 1024)


def _bins(s: np.ndarray) -> bytes:
    """How many of the sorted hashes are in each of equal ranges; 255 stands for that many or more."""
    log = int(np.clip(len(s) // 2, *BINS) - 1).bit_length()
    edge = np.searchsorted(s, np.arange(1 << log, dtype=np.uint64) << np.uint64(64 - log))
    return np.minimum(np.diff(edge, append=len(s)), 255).astype(np.uint8).tobytes()


class _Histograms:
    """The histograms of a group, compared at the coarser one's ranges."""

    def __init__(self, column: pa.ChunkedArray):
        rows = [np.frombuffer(x.as_buffer(), np.uint8) for x in column]
        self.size = np.array([len(r) for r in rows])
        self.full = np.array([bool((r == 255).any()) for r in rows])
        self.place = np.zeros(len(rows), dtype=np.int64)
        self.folded = {}
        for k in np.unique(self.size):
            at = np.flatnonzero(self.size == k)
            self.place[at] = np.arange(len(at))
            self.folded[k, k] = np.stack([rows[x] for x in at]).astype(np.uint16)

    def _at(self, size: int, to: int) -> np.ndarray:
        if (size, to) not in self.folded:
            m = self.folded[size, size]
            self.folded[size, to] = m.reshape(len(m), to, -1).sum(axis=2, dtype=np.uint16)
        return self.folded[size, to]

    def most(self, x: int, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """At most so many common shingles of x and each of y."""
        out = np.minimum(n[y], n[x])
        for k in np.unique(self.size[y]):
            at = np.flatnonzero((self.size[y] == k) & ~self.full[y] & ~self.full[x])
            to = min(k, self.size[x])
            mine, theirs = self._at(self.size[x], to)[self.place[x]], self._at(k, to)[self.place[y[at]]]
            out[at] = np.minimum(out[at], np.minimum(theirs, mine).sum(axis=1, dtype=np.int64))
        return out


def _sketches(size: int, collections: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = _coefficients(collections * width)
        seed = np.arange(1, collections + 1, dtype=np.uint64)
        for batch in batches:
            ids, n, h1, h2, bands, sketch = batch.column(0), [], [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                h1.append(np.bitwise_xor.reduce(mix(s)).view(np.int64) if len(s) else 0)
                h2.append(s.sum(dtype=np.uint64).view(np.int64) if len(s) else 0)
                if not len(s):
                    bands.append([])
                    sketch.append(b"")
                    continue
                low = _minhash(s, a, c)
                key = np.zeros(collections, dtype=np.uint64)
                for m in low.reshape(collections, width).T:
                    key = mix(key + m)
                bands.append(mix(key + seed).view(np.int64))
                sketch.append(_bins(s))
            yield pa.record_batch(
                [ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"],
            )

    return run


def _table_keys(u: np.ndarray) -> np.ndarray:
    """The keys of every table, from the collections' keys (one row for each document).

    Seeds are already in the collections' keys, so keys of different tables never meet.
    """
    left, right = np.triu_indices(u.shape[1], 1)
    return mix(u[:, left] + mix(u[:, right])).view(np.int64)


def _tables(collections: int):
    """Rows (key, doc_id) of every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                key = _table_keys(part.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), collections))
                yield pa.record_batch([pa.array(key.ravel()), pa.array(np.repeat(ids, key.shape[1]))], names=["key", "doc_id"])

    return run


def _with_sets(size: int, shared):
    """The shingle sets of documents that the table of ids may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(may_have(shared.value, batch.column(0).to_numpy())))
            sets = [s.tobytes() for s in shingle_sets(some.column(1), size)]
            yield pa.record_batch([some.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


def sets_of(ids: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles) of the documents of ``ids``, and of others that share their bits."""
    shared = texts.sparkSession.sparkContext.broadcast(table_of(ids))
    return texts.where("doc_id is not null").mapInArrow(frugal(_with_sets(size, shared)), "doc_id long, shingles binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda c, k: np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64)  # noqa: B023, E731
            keep = pa.array([_similar(read(2, k), read(3, k), percent) for k in range(batch.num_rows)], pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, part) whose full shingle sets are similar.

    ``part`` deals the partners of a document that has many into groups, each of which gets a copy of its set.
    """
    left = pairs.select("a", "part").distinct().join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    one = pairs.join(left, ["a", "part"])
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(frugal(_confirmed(percent)), "a long, b long")


def _pairs_of(collections: int, percent: int):
    """Pairs of one small bucket that are in different components and may be similar.

    A pair that meets in several tables is told by the first of them alone.
    """
    number = np.zeros((collections, collections), dtype=np.int64)
    number[np.triu_indices(collections, 1)] = np.arange(collections * (collections - 1) // 2)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        docs, comp, n, bands, low = _columns(table)
        here = (_table_keys(bands.view(np.uint64)) == key[0].as_py()).any(axis=0).argmax()  # the bucket's table
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in range(len(docs) - 1):
            y = _partners(x, np.arange(x + 1, len(docs)), comp, n, low, percent)
            same = bands[y] == bands[x]
            one = same.argmax(axis=1)
            same[np.arange(len(y)), one] = False
            y = y[number[one, same.argmax(axis=1)] == here]
            a.append(np.minimum(docs[x], docs[y]))
            b.append(np.maximum(docs[x], docs[y]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    docs, comp, n = (table.column(x).to_numpy() for x in ("doc_id", "component", "n_shingles"))
    bands = np.stack([x.values.to_numpy() for x in table.column("bands")])
    return docs, comp, n, bands, _Histograms(table.column("sketch"))


def _partners(x: int, y: np.ndarray, comp: np.ndarray, n: np.ndarray, low: _Histograms, percent: int) -> np.ndarray:
    """Those of y that are in another component and may be similar to x."""
    y = y[comp[y] != comp[x]]
    y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
    both = low.most(x, y, n)
    return y[100 * both >= percent * (n[x] + n[y] - both)]


def _links_of_tiles(percent: int):
    """Links within one pair of tiles of a large bucket, compared on the sets themselves.

    Once two components are linked here, their other pairs are passed over, so what is
    returned is at most one link fewer than there are members.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, t1, t2 = key[0].as_py(), key[2].as_py(), key[3].as_py()
        docs, comp, n, bands, low = _columns(table)
        comp = comp.copy()
        side = table.column("tile").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        left = np.arange(len(docs)) if t1 == t2 else np.flatnonzero(side == t1)
        right = left if t1 == t2 else np.flatnonzero(side == t2)
        a, b = [], []
        for x in left:
            y = right[right > x] if t1 == t2 else right
            same = bands[y] == bands[x]
            y = y[(same.argmax(axis=1) == at) & (same.sum(axis=1) > 1)]
            for z in _partners(x, y, comp, n, low, percent):
                if comp[z] != comp[x] and _similar(sets[x], sets[z], percent):
                    a.append(min(docs[x], docs[z]))
                    b.append(max(docs[x], docs[z]))
                    comp[comp == comp[z]] = comp[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def minhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    collections: int = COLLECTIONS,
    width: int = WIDTH,
    large: int = LARGE,
    tile: int = TILE,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_ = scratch.table(texts.mapInArrow(frugal(_sketches(shingle, collections, width)), _SKETCH), "sketches")
    some = all_.where("n_shingles > 0 and doc_id is not null")
    # one representative of each shingle set; a doc_id of several texts ties those sets together below
    classes = scratch.table(some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    same = some.join(classes.where("n > 1").drop("n"), ["h1", "h2", "n_shingles"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    same = scratch.table(same, "same")
    reps = some.join(classes.select("h1", "h2", "n_shingles", F.col("rep").alias("doc_id")), ["h1", "h2", "n_shingles", "doc_id"], "left_semi")
    reps = scratch.table(reps.dropDuplicates(["doc_id", "h1", "h2", "n_shingles"]).select("doc_id", "n_shingles", "bands", "sketch"), "reps")

    # the written table has few files, and each of its rows makes one for every table
    spread = reps.select("doc_id", "bands").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = spread.mapInArrow(frugal(_tables(collections)), "key long, doc_id long")
    # first pass: every member against its bucket's least member
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    members = scratch.table(keyed.join(buckets, "key").select("key", "doc_id", "low", "n"), "members")
    stars = members.where("doc_id <> low").groupBy(F.col("low").alias("a"), F.col("doc_id").alias("b")).agg(F.max("n").alias("n"))
    part = F.ceil(F.col("n") / PART)
    stars = scratch.table(stars.select("a", "b", F.xxhash64(part, F.pmod(F.xxhash64("b"), part)).alias("part")), "stars")
    size = reps.groupBy("doc_id").agg(F.max("n_shingles").alias("most"), F.min("n_shingles").alias("least"))
    side = lambda x: size.select(F.col("doc_id").alias(x), F.col("most").alias(f"{x}_most"), F.col("least").alias(f"{x}_least"))
    sized = stars.join(stars.select("a", "part").distinct().join(side("a"), "a"), ["a", "part"]).join(side("b"), "b")
    sized = scratch.table(sized.where(f"100 * a_most >= {percent} * b_least and 100 * b_most >= {percent} * a_least").select("a", "b", "part"), "sized")
    sets = scratch.table(sets_of(_ends(sized), texts, shingle), "sets")
    links = scratch.table(confirm(sized, sets, percent), "links")
    scratch.drop(sets, sized)
    first = scratch.table(connected_components(links.unionByName(same), scratch), "found")
    found = first

    # second pass: what buckets of three and more still hold apart
    placed = members.where("n > 2").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
    apart = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x < y").select("key", "m")
    mixed = placed.join(apart, "key").join(reps, "doc_id")
    small = mixed.where(F.col("m") <= large).select("key", "doc_id", "component", "n_shingles", "sketch", "bands")
    more = small.groupBy("key").applyInArrow(_pairs_of(collections, percent), "a long, b long").distinct()
    more = scratch.table(more.join(stars, ["a", "b"], "left_anti").withColumn("part", F.lit(0).cast("long")), "more")
    wide = scratch.table(mixed.where(F.col("m") > large).select("doc_id", "component", "n_shingles", "sketch", "bands").distinct(), "wide")
    sets = scratch.table(sets_of(_ends(more).unionByName(wide.select("doc_id")), texts, shingle), "sets")
    links2 = confirm(more, sets, percent)
    if wide.take(1):
        # members of large buckets meet once for each collection, not for each table, and in tiles
        full = wide.join(sets, "doc_id").select("*", F.posexplode("bands").alias("at", "band"))
        groups = wide.select("component", "n_shingles", F.posexplode("bands").alias("at", "band")).groupBy("at", "band")
        groups = groups.agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum("n_shingles").alias("size")).where("x < y")
        groups = groups.select("at", "band", F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
        dealt = full.join(groups, ["at", "band"]).withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.withColumns({"t1": F.least("tile", "o"), "t2": F.greatest("tile", "o")})
        links2 = links2.unionByName(dealt.groupBy("at", "band", "t1", "t2").applyInArrow(_links_of_tiles(percent), "a long, b long"))
    links2 = scratch.table(links2, "links2")
    if links2.take(1):
        bridge = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        found = scratch.table(connected_components(links2.unionByName(bridge), scratch), "found")
        scratch.drop(first)
    scratch.drop(members, stars, reps, classes, same, links, more, wide, sets, links2)
    named = all_.select("doc_id", "n_shingles").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return named.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, distinct 2-word shingles, similarity of 0.8 or more."""
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
