"""Toxicity by compression distance: two zstandard dictionaries and calibrated margins.

Training takes a sample of labelled documents of about ``SAMPLE`` rows and ``SAMPLE_BYTES``
of text for each label (chosen by a hash; the bounds are parameters) and learns three things:

* an ordinary dictionary, trained by zstandard on ordinary text;
* a toxic dictionary, trained by zstandard on the strings of toxic text that are its own:
  of all strings of 5 and of 8 bytes, those in significantly more toxic than ordinary
  documents are joined into spans, and each of their occurrences is a training sample;
* a logistic calibration of how window margins turn into a probability, cross-fitted so
  that no document is scored by a dictionary that it helped to train.

Text is compressed in a form that lets a match tell where in a word it stands: the first
``HEAD`` bytes of each word are written in upper case (bytes beyond ASCII are flipped in
one bit), the rest in lower case, and white space as a space.

Every text is cut into windows of ``WINDOW`` words.  Each is compressed under the ordinary
dictionary and under the toxic one, which the ordinary one's content precedes: so both see
the same ordinary content, and the difference in length tells toxic content and little else.  The whole text
counts: the largest margins and the numbers of windows above each threshold are features.

Defined results: null and empty texts are one window of margin 0 and get the score that
calibration gives it; null doc_ids hash as null and are held in; a document labelled twice
counts as toxic if any label says so; null labels teach nothing; with fewer than five
documents of either label every score is the share of toxic labels, or 0 without any;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.text import LOWER, NOT_SPACE, chunks, frugal, give_back, mix, small_batches

SAMPLE, SAMPLE_BYTES, WINDOW, GRAMS, HEAD, LEVEL = 3000, 16 << 20, 8, (5, 8), 8, 3
ORDINARY_BYTES, TOXIC_BYTES = 32768, 8192
_STEPS = (1, 2, 3, 4, 5, 6, 8)
_BODY = LOWER.copy()
_BODY[[9, 10, 11, 12, 13]] = 32
_FIRST = _BODY.copy()
_FIRST[97:123] -= 32
_FIRST[65:91] = np.arange(65, 91)
_FIRST[128:] ^= 0x20


def coded(b: np.ndarray, inside: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The form of a chunk's bytes that is compressed."""
    at = np.arange(len(b))
    start = np.maximum.accumulate(np.where(inside & ~before, at, -HEAD)) if len(b) else at
    return np.where(at - start < HEAD, _FIRST[b], _BODY[b])


def _grams(b: np.ndarray, size: int) -> np.ndarray:
    """The codes of all strings of ``size`` bytes of a text."""
    x = b.astype(np.uint64)
    n = max(0, len(x) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out << np.uint64(8) | x[k : k + n]
    return out


def _bytes(text: str) -> np.ndarray:
    """A text in the form that is compressed, with a space on either side."""
    b = np.frombuffer(f" {text} ".encode(), dtype=np.uint8)
    inside = NOT_SPACE[b]
    return coded(b, inside, np.concatenate([[False], inside[:-1]]))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _document_counts(texts: list[np.ndarray], size: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    parts = []
    for t in texts:
        g = _grams(t, size)
        parts.append(np.unique(g if only is None else g[_among(g, only)]))
    return np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)


def _significant(toxic: list[np.ndarray], ordinary: list[np.ndarray], size: int, least: int, z: float) -> np.ndarray:
    grams, a = _document_counts(toxic, size)
    grams, a = grams[a >= least], a[a >= least]
    known, n = _document_counts(ordinary, size, grams)
    b = np.zeros(len(grams))
    b[np.searchsorted(grams, known)] = n
    share = (a + b) / (len(toxic) + len(ordinary))
    sd = np.sqrt(share * (1 - share) * (1 / len(toxic) + 1 / len(ordinary)))
    return grams[(a / len(toxic) - b / len(ordinary)) >= z * np.maximum(sd, 1e-12)]


def toxic_spans(toxic: list[np.ndarray], ordinary: list[np.ndarray], least: int = 4, z: float = 7.0) -> Counter:
    """Spans of toxic texts covered by strings that are significantly commoner in toxic documents."""
    hot = [(size, _significant(toxic, ordinary, size, least, z)) for size in GRAMS]
    spans: Counter = Counter()
    for t in toxic:
        cover = np.zeros(len(t) + 1, dtype=np.int64)
        for size, known in hot:
            at = np.flatnonzero(_among(_grams(t, size), known))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
        inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        for i, j in edge.reshape(-1, 2):
            for word in t[i:j].tobytes().split(b" "):
                if len(word) >= min(GRAMS) - 1:
                    spans[b" " + word] += 1
    return spans


class Compressors:
    """The pair of compressors that the two dictionaries make."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self._made = None

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "_made": None}

    def margins(self, data: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """How many bytes shorter each window is with the toxic dictionary than without."""
        if not len(segments):
            return np.zeros(0)
        if self._made is None:
            self._made = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        buffer = zstandard.BufferWithSegments(data.tobytes(), segments.astype(np.uint64).tobytes())
        one, two = (np.fromiter(map(len, c.multi_compress_to_buffer(buffer, threads=1)), np.int64, len(segments)) for c in self._made)
        return (one - two).astype(float)


def windows(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coded bytes, (start, length) of each window of WINDOW words, each document's first window."""
    inside = NOT_SPACE[b]
    before = np.concatenate([[False], inside[:-1]]) if len(b) else inside
    head = o[:-1][o[:-1] < len(b)]
    before[head] = False
    last = np.concatenate([inside[1:], [False]]) if len(b) else inside
    last[o[o > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~last) + 1
    first = np.searchsorted(starts, o)
    n = np.diff(first)
    k = -(-n // WINDOW)
    begin = np.concatenate([[0], np.cumsum(k)])
    doc = np.repeat(np.arange(len(n)), k)
    a = first[doc] + (np.arange(begin[-1]) - begin[doc]) * WINDOW
    z = np.minimum(a + WINDOW, first[doc + 1]) - 1
    if not len(a):
        return b, np.zeros((0, 2), np.int64), begin
    from_ = np.maximum(starts[a] - 1, o[doc])  # with the space before its first word
    return coded(b, inside, before), np.stack([from_, ends[z] - from_], axis=1), begin


def features(margins: np.ndarray) -> np.ndarray:
    m = margins if len(margins) else np.zeros(1)
    top = np.sort(m)[::-1][:3]
    return np.array([top[0], top.sum() / 3, *(np.log1p((m >= s).sum()) for s in _STEPS), np.log1p(len(m)), np.sqrt(max(m.sum(), 0))])


def all_features(pair: Compressors, b: np.ndarray, o: np.ndarray) -> np.ndarray:
    data, segments, begin = windows(b, o)
    m = pair.margins(data, segments)
    return np.array([features(m[i:j]) for i, j in zip(begin[:-1], begin[1:], strict=True)])


class Model:
    def __init__(self, pair: Compressors, mean: np.ndarray, sd: np.ndarray, weights: np.ndarray):
        self.pair, self.mean, self.sd, self.weights = pair, mean, sd, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd @ self.weights[:-1] + self.weights[-1], -30, 30)
        return 1 / (1 + np.exp(-z))


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """A dictionary trained by zstandard, or the samples where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, d=6, k=k, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


def _dictionaries(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> Compressors:
    base = _trained([t.tobytes()[i : i + 2000] for t in ordinary for i in range(0, len(t), 2000)], ORDINARY_BYTES, 32)
    spans = toxic_spans(toxic, ordinary)
    # twice in each sample, for the trainer passes over samples of a few bytes
    own = [(s + b" ") * 2 for s in sorted(spans, key=lambda s: (spans[s], s)) if spans[s] >= 3 for _ in range(spans[s])]
    return Compressors(base, _trained([own[i] for i in np.random.default_rng(0).permutation(len(own))], TOXIC_BYTES, 24))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 4000) -> np.ndarray:
    w, z = np.zeros(x.shape[1] + 1), np.c_[x, np.ones(len(x))]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= 0.5 * (z.T @ (p - y) / len(y) + 1e-4 * np.r_[w[:-1], 0])
    return w


def _one_of_each(data: list[np.ndarray]) -> list[int]:
    """Rows without those that share three of six minhashes of their strings with an earlier row.

    Near copies of one toxic document would otherwise make its every string look toxic.
    """
    r = np.random.default_rng(3)
    odd = r.integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: list[dict[int, list[int]]] = [{} for _ in odd]
    out = []
    for k, d in enumerate(data):
        g = mix(_grams(d, 8))
        low = [int((g * a).min()) for a in odd] if len(g) else []
        near = Counter(x for s, v in zip(seen, low, strict=False) for x in s.get(v, ()))
        if not near or max(near.values()) < 3:
            out.append(k)
            for s, v in zip(seen, low, strict=False):
                s.setdefault(v, []).append(k)
    return out


def train(texts: list[str], toxic: list[int]) -> Model | float:
    """A model, or the share of toxic labels where there are too few to learn from."""
    seen: dict[str, int] = {}
    for t, y in zip(texts, toxic, strict=True):
        seen[t] = max(y, seen.get(t, 0))
    names = sorted(seen)
    order = np.random.default_rng(5).permutation(len(names))
    raw = [np.frombuffer(names[i].encode(), dtype=np.uint8) for i in order]
    data, y = [_bytes(names[i]) for i in order], np.array([seen[names[i]] for i in order])
    keep = _one_of_each(data)
    raw, data, y = [raw[k] for k in keep], [data[k] for k in keep], y[keep]
    if min((y == 1).sum(), (y == 0).sum()) < 5:
        return float(y.mean()) if len(y) else 0.0
    fold = np.zeros(len(y), dtype=int)
    for v in (0, 1):
        fold[np.flatnonzero(y == v)[::2]] = 1
    pick = lambda keep: _dictionaries([d for d, v, k in zip(data, y, keep, strict=True) if k and v], [d for d, v, k in zip(data, y, keep, strict=True) if k and not v])
    x = np.zeros((len(y), len(_STEPS) + 4))
    for f in (0, 1):
        pair = pick(fold != f)
        for k in np.flatnonzero(fold == f):
            x[k] = all_features(pair, raw[k], np.array([0, len(raw[k])]))[0]
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(pick(np.ones(len(y), dtype=bool)), mean, sd, _logistic((x - mean) / sd, y))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | float:
    """Learn from (doc_id, text) and (doc_id, toxic)."""
    spark = docs.sparkSession
    each = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    texts = docs.select("doc_id", "text").where("text is not null")
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).join(each, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    share = {r["toxic"]: min(1.0, sample / r["n"], sample_bytes / max(1, r["size"])) for r in sizes.collect()}
    chosen = each.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    ids = [(r["doc_id"], r["toxic"]) for r in chosen.toLocalIterator()]  # about 2 * sample rows
    few = F.broadcast(spark.createDataFrame(ids or [(None, None)], "doc_id long, toxic int"))
    rows = texts.join(few, "doc_id").select("text", "toxic").toArrow()
    model = train(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if isinstance(m, float):
                out[:] = m
            else:
                for i, j, b, o in chunks(batch.column(1)):
                    out[i:j] = m.score(all_features(m.pair, b, o))
            yield pa.record_batch([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return only.mapInArrow(frugal(run), f"doc_id {only.schema['doc_id'].dataType.simpleString()}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, learning from the labels outside the held-out fifth."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs, labels.where(~held).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
