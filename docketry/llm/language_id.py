"""Language identification by nearest centroid over hashed n-gram TF-IDF vectors.

A text's vector counts byte trigrams (letters lower-cased, other ASCII read as space) in
``DIMS`` hashed dimensions, weighs them by 1 + log count and inverse document frequency
and normalises.  Each language has up to ``CENTROIDS`` centroids, from spherical k-means
on a sample of labelled documents of about ``SAMPLE`` rows in all, spread evenly over the
``LANGUAGES`` commonest languages and chosen by a hash; both bounds are parameters.  The
sample's vectors are made on executors and stay sparse on the driver.  The prediction is the language
of the nearest centroid by cosine, which is also the score.  A text further from its
centroid than ``REJECT`` times the cosine that 99 % of the centroid's own training
documents reach, or 99 % of the language's if that is more, is rejected: a centroid of one
odd document (a mislabelled one, junk) takes only what is close to it.  Only text is read
to predict.

Defined results: null text and text without a letter is ``und`` with score 0 and is
rejected; with nothing to learn from, so is everything; null doc_ids hash as null and are
held in; rows repeat as given; other columns pass through, those named like an added
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.text import chunks, frugal, give_back, small_batches

DIMS, CENTROIDS, SAMPLE, LANGUAGES, REJECT = 4096, 4, 6000, 300, 0.6
_DOCS = 128

_NORMAL = np.full(256, 32, dtype=np.uint64)
_NORMAL[97:123] = _NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[65:91] = True


@dataclass
class Model:
    names: list[str]  # of each centroid's language
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # cosine below which a text nearest to the centroid is rejected


def counts(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of documents: first, end, trigram counts (documents x DIMS), whether each has an ASCII letter."""
    for i, j, b, o in chunks(col, 1 << 19):
        for k in range(0, j - i, _DOCS):
            p = o[k : min(k + _DOCS, j - i) + 1]
            data, at = b[p[0] : p[-1]], p - p[0]
            m, n = len(at) - 1, len(data)
            if n < 3:
                yield i + k, i + k + m, np.zeros((m, DIMS), np.float32), _any(_LETTER[data], at)
                continue
            x = _NORMAL[data]
            code = x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]
            h = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
            doc = np.repeat(np.arange(m), np.diff(at))[: n - 2]
            keep = (at[doc + 1] > np.arange(n - 2) + 2) & (x[1:-1] != 32)
            c = np.bincount(doc[keep] * DIMS + h[keep], minlength=m * DIMS).reshape(m, DIMS)
            yield i + k, i + k + m, c.astype(np.float32), _any(_LETTER[data], at)


def _any(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])[at]
    return np.diff(total) > 0


def _vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, c, _ in counts(batch.column(1)):
            rows = [np.flatnonzero(r) for r in c]
            yield pa.record_batch(
                [batch.column(0).slice(i, j - i), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([x[r] for x, r in zip(c, rows, strict=True)], pa.list_(pa.float32()))],
                names=["lang", "at", "n"],
            )


class Rows:
    """Sparse rows: dimensions and values of row i are at first[i]:first[i+1]."""

    def __init__(self, at: np.ndarray, values: np.ndarray, sizes: np.ndarray):
        self.at, self.values, self.first = at, values, np.concatenate([[0], np.cumsum(sizes)])

    def __len__(self) -> int:
        return len(self.first) - 1

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """The product with each row of ``dense``, one at a time; no row is empty."""
        return np.stack([np.add.reduceat(self.values * d[self.at], self.first[:-1]) for d in dense], axis=1)

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.first)[rows]
        of = np.repeat(self.first[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return Rows(self.at[of], self.values[of], sizes)

    def sums(self, own: np.ndarray, k: int) -> np.ndarray:
        """The sums of the rows by cluster."""
        each = np.repeat(own, np.diff(self.first))
        return np.stack([np.bincount(self.at[each == x], self.values[each == x], DIMS) for x in range(k)]).astype(np.float32)

    def dense(self, row: int) -> np.ndarray:
        i, j = self.first[row : row + 2]
        return np.bincount(self.at[i:j], self.values[i:j], DIMS).astype(np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(np.linalg.norm(v), 1e-12)


def _clusters(v: Rows, k: int) -> np.ndarray:
    """Spherical k-means from a farthest-first start."""
    start = [_unit(v.sums(np.zeros(len(v), np.int64), 1)[0])]
    while len(start) < min(k, len(v)):
        start.append(v.dense(int(v.dot(np.array(start)).max(axis=1).argmin())))
    c = np.array(start, dtype=np.float32)
    for _ in range(10):
        own = v.dot(c).argmax(axis=1)
        sums = v.sums(own, len(c))
        for x in np.unique(own):
            c[x] = _unit(sums[x])
    return c


def _sampled(rows: DataFrame, sample: int, languages: int) -> tuple[np.ndarray, Rows] | None:
    """Language and trigram counts of the sample, in an order that no partitioning changes."""
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    seen = {r["lang"]: r["count"] for r in counted.collect()}  # at most ``languages`` rows
    if not seen:
        return None
    each = max(1, sample // len(seen))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(seen.items()) for x in (lang, min(1.0, each / n))))
    part = F.pmod(F.xxhash64("salt"), F.lit(1 << 30)) / float(1 << 30)
    found = rows.where(part < share[F.col("lang")]).select("lang", "text").mapInArrow(frugal(_sparse), "lang string, at array<int>, n array<float>").where("size(at) > 0").toArrow()
    if not found.num_rows:
        return None
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in found.column(c).chunks])
    lang = np.array(found.column("lang").to_pylist(), dtype=object)
    v = Rows(flat("at"), flat("n"), np.concatenate([np.diff(x.offsets.to_numpy()) for x in found.column("at").chunks]))
    order = np.lexsort((v.dot(np.sin(np.arange(DIMS, dtype=np.float32))[None])[:, 0], lang.astype(str)))
    return lang[order], v.take(order)


def fit(rows: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, reject: float = REJECT, languages: int = LANGUAGES) -> Model | None:
    """Learn from (lang, text, salt); ``salt`` is any stable column that spreads the sample."""
    small_batches(rows.sparkSession)
    found = _sampled(rows.where("lang is not null and text is not null"), sample, languages)
    if found is None:
        return None
    lang, v = found
    idf = (np.log((1 + len(v)) / (1 + np.bincount(v.at, minlength=DIMS))) + 1).astype(np.float32)
    v.values = ((1 + np.log(v.values)) * idf[v.at]).astype(np.float32)
    norm = np.sqrt(np.add.reduceat(v.values.astype(np.float64) ** 2, v.first[:-1]))
    v.values /= np.repeat(norm, np.diff(v.first)).astype(np.float32)
    names, all_, least = [], [], []
    for x in sorted(set(lang)):
        own = v.take(np.flatnonzero(lang == x))
        k = _clusters(own, centroids)
        cos = own.dot(k)
        of, top = cos.argmax(axis=1), cos.max(axis=1)
        near = np.quantile(top, 0.01)
        names += [x] * len(k)
        all_.append(k)
        least += [reject * max(near, np.quantile(top[of == i], 0.01) if (of == i).any() else near) for i in range(len(k))]
    del found, v, own
    give_back()
    return Model(names, idf, np.concatenate(all_), np.array(least))


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected to every row."""
    added = ("lang_pred", "score", "rejected")
    kept = [c for c in df.columns if c.lower() not in added]
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            col = batch.column(at)
            for i, j, c, letter in counts(col):
                names, scores, out = [], [], []
                if m is not None:
                    cos = _vectors(c, m.idf) @ m.centroids.T
                    best = cos.argmax(axis=1)
                    top = np.clip(cos[np.arange(j - i), best], 0, 1).astype(float)
                for k in range(j - i):
                    text = None if letter[k] else col[i + k].as_py()
                    if m is None or not (letter[k] or any(map(str.isalpha, text or ""))):
                        names.append("und"), scores.append(0.0), out.append(True)
                    else:
                        names.append(m.names[best[k]]), scores.append(top[k]), out.append(bool(top[k] < m.least[best[k]]))
                part = batch.slice(i, j - i)
                yield pa.record_batch([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=[*kept, *added])

    only = df.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*only.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return only.mapInArrow(frugal(run), schema)


def held_out(folds: int, fold: int, id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn from the documents outside the fold and add predictions and held_out to all."""
    model = fit(docs.where(~held_out(folds, fold)).select("lang", "text", F.col("doc_id").alias("salt")))
    return predict(docs.drop("held_out").withColumn("held_out", held_out(folds, fold)), model)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")
