"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Every pre-token is encoded on its own.  A segment tree over its byte positions holds, at
leaf i, the rank of the pair that starts at live position i; each inner node holds the
least of its children, coded as rank * width + position, so the root is the leftmost pair
of least rank.  A merge updates the three leaves it touches (the merged position, the one
it swallows and the live neighbour before) and their ancestors: logarithmic work a merge.
Trees of many pre-tokens of like length are advanced together, one merge each a step, in
numpy; pre-tokens of 512 bytes and more are advanced alone.  A pre-token that is itself a
token is that token.  What a worker has encoded it remembers within a partition, up to ``REMEMBERED`` pieces.

Defined results: null text is empty and has no ids; rows repeat as given; other columns
pass through unless their names are those of the added ones, which replace them.  Special
tokens are never produced.  Memory grows with the longest single text, not with the batch.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.text import frugal, small_batches, string_bytes

NONE = np.int64(2**62)
REMEMBERED = 150_000
LONG = 512
CHUNK_CHARS = 1 << 19

#: For ASCII texts the pattern below splits as public_tokenizers.PATTERN does, and faster.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Rank of the concatenation of two tokens, by open addressing over arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        found = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = r
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.vals = np.full(1 << self.bits, NONE, dtype=np.int64)
        todo_k, todo_v = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        at = self._slot(todo_k)
        while len(todo_k):
            free = self.keys[at] < 0
            self.keys[at[free]] = todo_k[free]
            put = self.keys[at] == todo_k
            self.vals[at[put]] = todo_v[put]
            todo_k, todo_v, at = todo_k[~put], todo_v[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def one(self, a: int, b: int) -> int | None:
        """The same for a single pair."""
        key, mask = a << 32 | b, len(self.keys) - 1
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (k := self.keys.item(at)) != key:
            if k < 0:
                return None
            at = (at + 1) & mask
        return self.vals.item(at)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << np.int64(32) | b
        at = self._slot(key)
        out = self.vals[at]
        wrong = np.flatnonzero(self.keys[at] != key)
        out[wrong] = NONE
        wrong = wrong[self.keys[at[wrong]] >= 0]
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & (len(self.keys) - 1)
            k = self.keys[at]
            hit = k == key[wrong]
            out[wrong[hit]] = self.vals[at[hit]]
            on = ~hit & (k >= 0)
            wrong, at = wrong[on], at[on]
        return out


def _encode_together(pieces: list[bytes], width: int, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and the number of ids of each."""
    m, flat = len(pieces), np.frombuffer(b"".join(pieces), dtype=np.uint8)
    size = np.fromiter(map(len, pieces), np.int64, m)
    pos = np.arange(width)
    live = pos < size[:, None]
    tok = np.zeros((m, width + 1), dtype=np.int64)
    tok[:, :width][live] = merges.of_byte[flat]
    nxt = np.broadcast_to(np.minimum(pos + 1, width), (m, width)).copy()
    nxt[np.arange(m), size - 1] = width
    prv = np.broadcast_to(pos - 1, (m, width)).copy()
    tree = np.full((m, 2 * width), NONE, dtype=np.int64)
    pair = pos[:-1] < size[:, None] - 1
    rank = merges(tok[:, : width - 1][pair], tok[:, 1:width][pair])
    at = np.broadcast_to(pos[:-1], pair.shape)[pair]
    leaf = tree[:, width : 2 * width - 1]
    leaf[pair] = np.where(rank < NONE, rank * width + at, NONE)
    s = width // 2
    while s:
        np.minimum(tree[:, 2 * s : 4 * s : 2], tree[:, 2 * s + 1 : 4 * s : 2], out=tree[:, s : 2 * s])
        s //= 2
    cell = tree.reshape(-1)
    rows = np.flatnonzero(tree[:, 1] < NONE)

    def put(row: np.ndarray, where: np.ndarray, value: np.ndarray) -> None:
        node = where + width
        base = row * (2 * width)
        cell[base + node] = value
        while True:
            node = node >> 1
            if not node[0]:
                return
            cell[base + node] = np.minimum(cell[base + 2 * node], cell[base + 2 * node + 1])

    while len(rows):
        best = tree[rows, 1]
        i, r = best % width, best // width
        j = nxt[rows, i]
        k = nxt[rows, j]
        tok[rows, i] = r
        nxt[rows, i] = k
        live[rows, j] = False
        on = k < width
        prv[rows[on], k[on]] = i[on]
        put(rows, j, np.full(len(rows), NONE))
        rank = np.full(len(rows), NONE)
        rank[on] = merges(r[on], tok[rows[on], k[on]])
        put(rows, i, np.where(rank < NONE, rank * width + i, NONE))
        p = prv[rows, i]
        b = np.flatnonzero(p >= 0)
        if len(b):
            q, pb = rows[b], p[b]
            rank = merges(tok[q, pb], r[b])
            put(q, pb, np.where(rank < NONE, rank * width + pb, NONE))
        rows = rows[tree[rows, 1] < NONE]
    return tok[:, :width][live], live.sum(axis=1)


def _encode_alone(piece: bytes, merges: Merges) -> list[int]:
    """The same for one long piece, on plain lists."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    none = int(NONE)
    tok = [int(merges.of_byte[x]) for x in piece]
    nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
    tree = [none] * (2 * width)

    def leaf(i: int) -> int:
        j = nxt[i]
        r = merges.one(tok[i], tok[j]) if j < n else None
        return none if r is None else r * width + i

    for i in range(n):
        tree[width + i] = leaf(i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    while tree[1] < none:
        r, i = divmod(tree[1], width)
        j = nxt[i]
        tok[i], nxt[i], live[j] = r, nxt[j], 0
        if nxt[i] < n:
            prv[nxt[i]] = i
        for x in (j, i, prv[i]):
            if x < 0:
                continue
            tree[k := width + x] = none if x == j else leaf(x)
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low
    return [t for t, x in zip(tok, live, strict=True) if x]


class Codec:
    """Encoder of one vocabulary; remembers the pieces it has met."""

    def __init__(self, path: str, pattern: str):
        import public_tokenizers

        self.ranks = load_ranks(path)
        self.merges = Merges(self.ranks)
        self.split = regex.compile(pattern).findall
        self.ascii = _ASCII.findall if pattern == public_tokenizers.PATTERN else self.split
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.size, self.at, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        by: dict[int, list[tuple[str, bytes]]] = {}
        for s in new:
            b = s.encode()
            r = self.ranks.get(b)
            if r is not None:
                self._add([s], np.array([r]), np.array([1]))
            elif len(b) >= LONG:
                ids = _encode_alone(b, self.merges)
                self._add([s], np.array(ids), np.array([len(ids)]))
            else:
                by.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((s, b))
        for width, found in by.items():
            step = max(64, (1 << 19) // width)
            for k in range(0, len(found), step):
                part = found[k : k + step]
                self._add([s for s, _ in part], *_encode_together([b for _, b in part], width, self.merges))

    def _add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(self.known), len(names)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.size) < n + k:
            self.size, self.at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.at))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + k] = sizes
        self.at[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(names, range(n, n + k), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        pieces = [(self.ascii if t.isascii() else self.split)(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        distinct = set().union(*pieces) if pieces else set()
        self._learn(sorted(distinct.difference(self.known)))
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        of = np.fromiter((x for p in pieces for x in map(self.known.__getitem__, p)), np.int64, int(count.sum()))
        size = self.size[of]
        end = np.cumsum(size)
        take = np.repeat(self.at[of] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        bound = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]
        return self.flat[take], np.diff(bound)


class Decoder:
    """The bytes of tokens, side by side."""

    def __init__(self, path: str):
        bytes_of = {r: t for t, r in load_ranks(path).items()}
        n = max(bytes_of) + 1
        parts = [bytes_of.get(i, b"") for i in range(n)]
        self.d_len = np.fromiter(map(len, parts), np.int64, n)
        self.d_at = np.cumsum(self.d_len) - self.d_len
        self.d_data = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each text, given its ids."""
        n = self.d_len[ids]
        end = np.cumsum(n)
        take = np.repeat(self.d_at[ids] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)
        data = self.d_data[take].tobytes()
        at = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(sizes)])]
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@functools.lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _which(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [k for k, x in enumerate(batch.schema.names) if x.lower() != name.lower()]
    return pa.record_batch([*(batch.column(k) for k in keep), values], names=[*(batch.schema.names[k] for k in keep), name])


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to about ``limit``."""
    total, i = np.concatenate([[0], np.cumsum(sizes)]), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def bpe_encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``ids_col``, the token ids (array of int) of each text."""
    names = [c for c in df.columns if c.lower() != ids_col.lower()]
    kept = [F.col(f"`{c}`") for c in names]
    at = names.index(text_col)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*_which(path, pattern))
        for batch in batches:
            col = batch.column(at)
            col = col.fill_null("") if col.null_count else col
            size = np.diff(string_bytes(col)[1])
            for i, j in _runs(size, CHUNK_CHARS):
                ids, sizes = c.encode(col.slice(i, j - i).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                part = batch.slice(i, j - i)
                yield pa.record_batch([*part.columns, lists], names=[*names, ids_col])
        c.forget()

    schema = T.StructType([*df.select(*kept).schema, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return df.select(*kept).mapInArrow(frugal(run), schema)


def bpe_decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``out_col``, the bytes that the ids stand for; null ids count as none."""
    kept = [c for c in df.columns if c.lower() != out_col.lower()]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = decoder(_which(path, None)[0])
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids_col))
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0), dtype=np.int64)
            for i, j in _runs(size, CHUNK_CHARS // 2):
                part = col.slice(i, j - i)
                out = c.decode(part.flatten().to_numpy(zero_copy_only=False), size[i:j])
                yield _replaced(batch.slice(i, j - i), out_col, pa.array(out, pa.binary()))

    only = df.select(*(F.col(f"`{c}`") for c in kept))
    return only.mapInArrow(frugal(run), T.StructType([*only.schema, T.StructField(out_col, T.BinaryType())]))


def bpe_round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``.

    One worker encodes a text and decodes its ids again, where ``bpe_encode`` and
    ``bpe_decode`` in a row would take two at a time.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, pattern = _which(None, None)
        c, back = codec(path, pattern), decoder(path)
        for batch in batches:
            col = batch.column(1)
            col = col.fill_null("") if col.null_count else col
            for i, j in _runs(np.diff(string_bytes(col)[1]), CHUNK_CHARS):
                ids, sizes = c.encode(col.slice(i, j - i).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column(0).slice(i, j - i), lists, pa.array(back.decode(ids, sizes), pa.binary())], names=["doc_id", "ids", "decoded"])
        c.forget()

    only = docs.select("doc_id", "text")
    coded = only.mapInArrow(frugal(run), f"doc_id {only.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` under the vocabulary of 50,256 ranks, encoded and decoded again."""
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
