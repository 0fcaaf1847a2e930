"""Benchmark decontamination over a distributed positional inverted index.

1. Test terms.  Benchmark words are hashed; a table of ``SLOTS`` bytes (a fixed size,
   whatever the benchmark's) tells for each hash slot the least number of consecutive
   test words that an occurrence through such a word needs: the window length, or the
   whole item where it is shorter.
2. Postings.  One pass over the texts stores (term, document, position) of every word
   that the table admits and that stands in a run of admitted words long enough for some
   window.  A word outside such a run is in no occurrence, so nothing is lost, and common
   words alone leave few postings.  The index is written to the shared folder.
3. Rarest first.  Index frequencies choose the rarest terms of each window.  The rarest
   term's list is joined first and gives candidate offsets (position in the document less
   position in the item); the next rarest lists are intersected with them, shifted.
4. Phrases.  All postings of a candidate offset that agree with the item at that offset
   are gathered; runs of a window's length are occurrences, and their positions are hits.

Proximity matches are windows that stand in a text with up to ``SLOP`` words inserted, left
out or replaced in all (a quarter of the words at most, so windows of under four words must
be exact).  So many edits leave some run of a window's words whole; such runs are looked up
by a hash, for whatever is in between need not be a benchmark word and has no posting.  The
words about the runs found are stored and every window that holds one is tried on them.
Exact occurrences are proximity matches too.

Joins are equi-joins on terms or documents that adaptive execution can split; no list
is gathered but the positions of one document at one offset against one item.  Rows are
identified by doc_id and a hash of the text, so repeated rows get equal results and rows
that share an id but not a text get their own.

Defined results: null or wordless text has no words and no hits and isn't contaminated;
null doc_ids are judged like others; benchmark items that are null or wordless match
nothing; equal items all match; texts that share an item_id are searched one by one and
named by the one id; null item_ids match nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.text import ALNUM, chunks, frugal, mix, small_batches, words
from docketry.session import Scratch

WINDOW, SLOTS, RAREST, SLOP = 13, 1 << 22, 3, 3


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 22)).astype(np.int64)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, b, o in chunks(batch.column(1)):
            w = words(b, o, ALNUM)
            n = np.diff(w.first)
            part = batch.column(0).slice(i, j - i)
            pos = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], n)
            yield pa.record_batch(
                [part.take(pa.array(np.repeat(np.arange(j - i), n))), pa.array(pos, pa.int32()), pa.array(w.hashes.view(np.int64)), pa.array(np.repeat(n, n), pa.int32())],
                names=["item", "pos", "term", "n"],
            )


def _slot_table(window: int):
    """The slot table of a partition's items, in pieces of 64 kB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = np.full(SLOTS, 255, dtype=np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            np.minimum.at(need, _slots(h), np.minimum(batch.column(1).to_numpy(), window).astype(np.uint8))
        step = 1 << 16
        for k in range(0, SLOTS, step):
            if (need[k : k + step] < 255).any():
                yield pa.record_batch([pa.array([k]), pa.array([need[k : k + step].tobytes()], pa.binary())], names=["at", "need"])

    return run


def _postings(need_table):
    """For every text its word count and the admitted postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = need_table.value
        for batch in batches:
            for i, j, b, o in chunks(batch.column(1)):
                w = words(b, o, ALNUM)
                least = need[_slots(w.hashes)]
                # runs of admitted words; each document's first word starts one
                fresh = np.ones(len(least) + 1, dtype=bool)
                fresh[1:-1] = (least[1:] < 255) != (least[:-1] < 255)
                fresh[w.first] = True
                edge = np.flatnonzero(fresh)
                length = np.repeat(np.diff(edge), np.diff(edge))
                keep = np.flatnonzero((least < 255) & (length >= least))
                doc = np.searchsorted(w.first, keep, side="right") - 1
                pos = (keep - w.first[doc]).astype(np.int32)
                bound = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(bound), pa.array(w.hashes[keep].view(np.int64)))
                places = pa.ListArray.from_arrays(pa.array(bound), pa.array(pos))
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(w.first)), terms, places], names=["doc_id", "h", "n_words", "terms", "places"])

    return run


def _hits(window: int):
    """Of each candidate's agreeing positions, those within a whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, found in zip(batch.column(4).to_pylist(), batch.column(5), strict=True):
                p = np.unique(found.values.to_numpy(zero_copy_only=False))
                cut = np.flatnonzero(np.diff(p) != 1) + 1
                out.append(np.concatenate([np.zeros(0, np.int32), *(r for r in np.split(p, cut) if len(r) >= min(window, n))]))
            yield pa.record_batch([*(batch.column(k) for k in range(4)), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "h", "item", "delta", "positions"])

    return run


def _slots_of(rows: DataFrame, window: int) -> np.ndarray:
    """The slot table of (hash, words) rows."""
    need = np.full(SLOTS, 255, dtype=np.uint8)
    # at most 64 pieces of 64 kB from each of at most 8 partitions
    for r in rows.coalesce(8).mapInArrow(frugal(_slot_table(window)), "at long, need binary").toLocalIterator():
        part = np.frombuffer(bytes(r["need"]), np.uint8)
        need[r["at"] : r["at"] + len(part)] = np.minimum(need[r["at"] : r["at"] + len(part)], part)
    return need


def edits(n: int, slop: int) -> tuple[int, int]:
    """Edits allowed in a window of n words, and the least run of its words that they leave whole."""
    k = min(slop, n // 4)
    return k, -(-(n - k) // (k + 1))


def _seeds(h: np.ndarray, q: int) -> np.ndarray:
    """A hash of every run of q words."""
    out = np.full(max(0, len(h) - q + 1), q, dtype=np.uint64)
    for k in range(q):
        out = mix(out + h[k : k + len(out)])
    return out


def _item_seeds(window: int, slop: int):
    """Every item's runs of the least length that edits leave, with its words (once for all its runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, o in chunks(batch.column(1)):
                w = words(b, o, ALNUM)
                for d in range(j - i):
                    h = w.hashes[w.first[d] : w.first[d + 1]]
                    n = min(window, len(h))
                    if n:
                        q = edits(n, slop)[1]
                        yield pa.record_batch([batch.column(0).slice(i + d, 1), pa.array([q]), pa.array([h.view(np.int64)], pa.list_(pa.int64())), pa.array([_seeds(h, q).view(np.int64)], pa.list_(pa.int64()))], names=["item", "q", "item_words", "seeds"])

    return run


def _stretches(table, qs: list[int], reach: int):
    """The words about the runs that the table admits, and where in them which run begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = table.value
        for batch in batches:
            for i, _, b, o in chunks(batch.column(1)):
                w = words(b, o, ALNUM)
                found = []
                for q in qs:
                    seeds = _seeds(w.hashes, q)
                    at = np.flatnonzero(need[_slots(seeds)] <= q)
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    within = at + q <= w.first[doc + 1]
                    found.append((at[within], doc[within], np.full(within.sum(), q), seeds[at[within]]))
                at, doc, q, seed = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(at, kind="stable")
                at, doc, q, seed = at[order], doc[order], q[order], seed[order]
                lo = np.maximum(at - reach, w.first[doc])
                hi = np.maximum.accumulate(np.minimum(at + q + reach, w.first[doc + 1]))
                cut = np.concatenate([[0], np.flatnonzero(lo[1:] >= hi[:-1]) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
                rows = [(int(doc[x]), lo[x], hi[y - 1], x, y) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                rows_doc = pa.array([i + r[0] for r in rows], pa.int64())
                yield pa.record_batch(
                    [
                        batch.column(0).take(rows_doc),
                        batch.column(2).take(rows_doc),
                        pa.array([r[1] - w.first[r[0]] for r in rows], pa.int64()),
                        pa.array([w.hashes[r[1] : r[2]].view(np.int64) for r in rows], pa.list_(pa.int64())),
                        pa.array([seed[r[3] : r[4]].view(np.int64) for r in rows], pa.list_(pa.int64())),
                        pa.array([at[r[3] : r[4]] - r[1] for r in rows], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "h", "begin", "words", "seeds", "ats"],
                )

    return run


def near_windows(item: list[int], starts: list[int], n: int, k: int, text: list[int]) -> list[int]:
    """Those of an item's windows of n words that stand in the text with up to k edits.

    Wu and Manber's automaton, the windows side by side in the bits of one number.
    """
    masks: dict[int, int] = {}
    first = last = 0
    for x, s in enumerate(starts):
        first |= 1 << x * n
        last |= 1 << x * n + n - 1
        for y in range(n):
            masks[item[s + y]] = masks.get(item[s + y], 0) | 1 << x * n + y
    every = (1 << len(starts) * n) - 1
    state, met = [0] * (k + 1), 0
    for e in range(1, k + 1):
        state[e] = (state[e - 1] << 1 | first) & every
    for word in text:
        mask, below, was = masks.get(word, 0), 0, 0
        for e in range(k + 1):
            old = state[e]
            new = (old << 1 | first) & mask
            if e:
                new |= was | (was << 1 | below << 1 | first) & every
            state[e], was, below = new, old, new
        met |= below & last
    return [s for x, s in enumerate(starts) if met >> x * n + n - 1 & 1]


def _near(window: int, slop: int):
    """Of (doc_id, h, item, words, item_words, ats, poss) the windows that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts = [], []
            for r, (text, item, ats, poss) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6)), strict=True)):
                n = min(window, len(item))
                k, q = edits(n, slop)
                hits, met, x = sorted(set(zip(ats, poss, strict=True))), set(), 0
                while x < len(hits):
                    # hits so close that one window may reach several
                    y, begin, end = x, max(0, hits[x][0] - window - slop), 0
                    while y < len(hits) and (y == x or hits[y][0] - window - slop < end):
                        end = hits[y][0] + q + window + slop
                        y += 1
                    tried = sorted({s for _, p in hits[x:y] for s in range(max(0, p + q - n), min(p, len(item) - n) + 1)})
                    met.update(near_windows(item, tried, n, k, text[begin:end]))
                    x = y
                rows += [r] * len(met)
                starts += sorted(met)
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([*(batch.column(c).take(at) for c in range(3)), pa.array(starts, pa.int32())], names=["doc_id", "h", "item", "start"])

    return run


class PositionalIndex:
    """The index of one corpus against one benchmark."""

    def __init__(self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, rarest: int = RAREST):
        spark = docs.sparkSession
        small_batches(spark)
        self.window, self.rarest, self.scratch, self.made = window, rarest, Scratch(spark, "index"), []
        items = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null")
        # an item is an id with a text
        items = items.withColumn("item", F.xxhash64("item_id", "text"))
        self.names = self._made(items.select("item", "item_id").distinct(), "names")
        self.item_texts = items.select("item", "text")
        self.items = self._made(self.item_texts.mapInArrow(frugal(_item_words), "item long, pos int, term long, n int").distinct(), "items")
        need = _slots_of(self.items.select("term", "n"), window)
        need_table = spark.sparkContext.broadcast(need)
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
        kind = texts.schema["doc_id"].dataType.simpleString()
        self.doc_texts = texts
        self.texts = self.scratch.table(texts.mapInArrow(frugal(_postings(need_table)), f"doc_id {kind}, h long, n_words long, terms array<long>, places array<int>"), "texts")
        one = self.texts.where("size(terms) > 0").groupBy("doc_id", "h").agg(F.first("terms").alias("terms"), F.first("places").alias("places"))
        rows = one.select("doc_id", "h", F.explode(F.arrays_zip("terms", "places")).alias("p"))
        self.postings = self._made(rows.select("doc_id", "h", F.col("p.terms").alias("term"), F.col("p.places").alias("place")), "postings")
        self.anchors = self._made(self._anchors(), "anchors")

    def _anchors(self) -> DataFrame:
        """(item, start, rank, term, pos): the rarest words of every window, rarest first."""
        often = self.postings.groupBy("term").count()
        known = self.items.join(often, "term", "left").fillna(0, ["count"])
        starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - (self.window - 1)), F.greatest(F.lit(0), F.least("pos", F.col("n") - self.window)))
        each = known.withColumn("start", F.explode(F.when(F.col("n") <= self.window, F.array(F.lit(0))).otherwise(starts)))
        rank = F.row_number().over(W.partitionBy("item", "start").orderBy("count", "pos"))
        return each.withColumn("rank", rank).where(F.col("rank") <= self.rarest).select("item", "start", "rank", "term", "pos", "count")

    def _listed(self, rank: int) -> DataFrame:
        """Offsets at which the words of this rank stand; equal ones of overlapping windows count once."""
        a = self.anchors.where(F.col("rank") == rank).select("item", "start", "term", "pos")
        return a.join(self.postings, "term").select("doc_id", "h", "item", "start", (F.col("place") - F.col("pos")).alias("delta"))

    def candidates(self) -> DataFrame:
        """Distinct (doc_id, h, item, delta) at which all chosen words of a window stand."""
        least = self.anchors.groupBy("item", "start").agg(F.max("rank").alias("ranks"), F.min("count").alias("c")).where("c > 0")
        found = self._listed(1).join(least, ["item", "start"])
        a = self.anchors.select(F.col("item").alias("i"), F.col("start").alias("s"), F.col("rank").alias("r"), F.col("term").alias("t"), F.col("pos").alias("p"))
        p = self.postings.select(F.col("doc_id").alias("d"), F.col("h").alias("e"), F.col("term").alias("u"), F.col("place").alias("q"))
        for rank in range(2, self.rarest + 1):
            part = found.where(F.col("ranks") >= rank).join(a.where(F.col("r") == rank), (F.col("i") == F.col("item")) & (F.col("s") == F.col("start")))
            same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("e") == F.col("h")) & (F.col("u") == F.col("t")) & (F.col("q") == F.col("p") + F.col("delta"))
            kept = part.join(p, same, "left_semi").select(*found.columns)
            found = kept.unionByName(found.where(F.col("ranks") < rank))
        return found.select("doc_id", "h", "item", "delta").distinct()

    def phrases(self) -> DataFrame:
        """(doc_id, h, item_id, delta, positions): the words of each text in exact occurrences of a window."""
        c = self._made(self.candidates(), "candidates")
        p = self.postings.select(F.col("doc_id").alias("d"), F.col("h").alias("e"), "term", "place")
        near = c.join(p, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("e") == F.col("h"))).withColumn("pos", F.col("place") - F.col("delta"))
        agree = near.join(self.items, ["item", "pos", "term"])
        groups = agree.groupBy("doc_id", "h", "item", "delta").agg(F.max("n").alias("n"), F.collect_set("place").alias("places"))
        kind = f"doc_id {self.texts.schema['doc_id'].dataType.simpleString()}, h long, item long, delta int, positions array<int>"
        return self.named(groups.select("doc_id", "h", "item", "delta", "n", "places").mapInArrow(frugal(_hits(self.window)), kind).where("size(positions) > 0"))

    def _made(self, df: DataFrame, name: str) -> DataFrame:
        """A table that close() deletes."""
        self.made.append(self.scratch.table(df, name))
        return self.made[-1]

    def named(self, found: DataFrame) -> DataFrame:
        """With each item's id in place of its key."""
        return found.join(self.names, "item").drop("item")

    def close(self) -> None:
        """Delete all tables but ``texts``."""
        self.scratch.drop(*self.made)

    def proximity(self, slop: int = SLOP) -> DataFrame:
        """(doc_id, h, item_id, start): the windows that stand in a text with up to ``slop`` edits."""
        kind = self.texts.schema["doc_id"].dataType.simpleString()
        items = self._made(self.item_texts.mapInArrow(frugal(_item_seeds(self.window, slop)), "item long, q long, item_words array<long>, seeds array<long>").distinct(), "seeds")
        seeds = items.select("item", "q", F.posexplode("seeds").alias("pos", "seed"))
        qs = sorted(r["q"] for r in items.select("q").distinct().collect())  # at most one for each length up to the window's
        if not qs:
            return self.doc_texts.limit(0).select("doc_id", "h", F.lit("").alias("item_id"), F.lit(0).alias("start"))
        need = _slots_of(seeds.select("seed", F.col("q").cast("int").alias("n")), self.window)
        shared = self.doc_texts.sparkSession.sparkContext.broadcast(need)
        found = self.doc_texts.mapInArrow(frugal(_stretches(shared, qs, self.window + slop)), f"doc_id {kind}, h long, begin long, words array<long>, seeds array<long>, ats array<long>")
        near = self._made(found, "stretches").dropDuplicates(["doc_id", "h", "begin"])
        hits = near.select("doc_id", "h", "begin", F.explode(F.arrays_zip("seeds", "ats")).alias("x")).select("doc_id", "h", "begin", F.col("x.seeds").alias("seed"), F.col("x.ats").alias("at"))
        pairs = hits.join(seeds, "seed").groupBy("doc_id", "h", "begin", "item").agg(F.collect_list(F.struct("at", "pos")).alias("hits"))
        text = near.select(F.col("doc_id").alias("d"), F.col("h").alias("e"), F.col("begin").alias("b"), "words")
        whole = pairs.join(text, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("e") == F.col("h")) & (F.col("b") == F.col("begin")))
        whole = whole.join(items.select("item", "item_words"), "item")
        rows = whole.select("doc_id", "h", "item", "words", "item_words", F.col("hits.at").alias("ats"), F.col("hits.pos").cast("array<long>").alias("poss"))
        return self.named(rows.mapInArrow(frugal(_near(self.window, slop)), f"doc_id {kind}, h long, item long, start int")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, slop: int | None = None, **cols: str) -> DataFrame:
    """(doc_id, h, n_words, n_hit, items, contaminated) of every row of ``docs``; items sorted as strings.

    With ``slop`` also near_items, the items of which a window is in the text with so many edits.
    """
    index = PositionalIndex(docs, items, window=window, **cols)
    found = index.scratch.table(index.phrases().select("doc_id", "h", "item_id", "positions"), "phrases")
    hit = found.select("doc_id", "h", F.explode("positions").alias("p")).distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    named = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    marks = hit.join(named, hit.doc_id.eqNullSafe(named.doc_id) & (hit.h == named.h)).select(hit.doc_id.alias("d"), hit.h.alias("e"), "n_hit", "items")
    out = index.texts.select("doc_id", "h", "n_words").join(marks, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("e") == F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = out.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
    if slop is None:
        index.close()
        return out
    near = index.proximity(slop).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("near")).withColumnsRenamed({"doc_id": "d", "h": "e"})
    near = index.scratch.table(near, "near")
    index.close()
    out = out.join(near, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("e") == F.col("h")), "left").drop("d", "e")
    return out.withColumn("near", F.coalesce("near", F.array().cast("array<string>"))).withColumnRenamed("near", "near_items")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against the whole ``benchmark``, windows of 13 words."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    digest = lambda c: F.sha2(F.array_join(c, ",").cast("binary"), 256)
    return decontaminate(docs, items, slop=SLOP).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest("items").alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
        digest("near_items").alias("near_items_sha256"),
    )
