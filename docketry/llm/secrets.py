"""Secret scanning over trigram inverted indexes.

Each rule's regular expression is parsed and turned into a Boolean query over trigrams
that every match must hold (an alternation gives OR, a sequence AND; case is folded, which
only widens).  A shard is a run of documents of about a megabyte: its inverted index maps
each trigram that some query names to the sorted list of documents that hold it.  The
lists are intersected and united as the query says, and only the documents that remain
are verified with the expression itself.  A rule without mandatory trigrams is verified
on every document.  Shards are built where their rows are, so nothing is shuffled, no
index grows with the corpus, and a lost executor costs only its shards.

Spans are offsets in code points, end exclusive, of whole matches; those that fail their
rule's test are dropped without a second try.  Null and empty texts have no spans; rows
repeat as given; other columns pass through, one named like the added column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.text import LOWER, chunks, frugal, small_batches

MOST = 48  # strings that a run of a pattern may stand for before it is closed


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 1

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches whose group is long enough."""
        return [m.span() for m in re.compile(self.pattern, self.flags).finditer(text) if len(m[self.group]) >= self.least]


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
)

Query = tuple  # ("all",) or ("has", trigram) or ("and" | "or", query, ...)
ALL: Query = ("all",)


def _both(a: Query, b: Query) -> Query:
    return b if a == ALL else a if b == ALL else ("and", a, b)


def _strings(s: set[str]) -> Query:
    """What a text must hold that holds one of these strings."""
    if not s or min(map(len, s)) < 3:
        return ALL
    each = [("and", *(("has", x) for x in sorted({t[i : i + 3] for i in range(len(t) - 2)}))) for t in sorted(s)]
    return each[0] if len(each) == 1 else ("or", *each)


def _walk(items, run: set[str]) -> tuple[set[str] | None, Query]:
    """The strings that a sequence, after ``run``, may end in as a whole (None: unknown), and its query."""
    query, whole = ALL, True  # whole: the run began with the sequence
    for op, arg in items:
        nxt: set[str] | None = None
        if op is C.LITERAL:
            nxt = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            nxt = {chr(x).lower() for _, x in arg}
        elif op is C.SUBPATTERN:
            nxt, inner = _walk(arg[3], {""})
            query = _both(query, inner)
        elif op is C.BRANCH:
            parts = [_walk(x, {""}) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                nxt = set().union(*(s for s, _ in parts))
            else:
                ways = [_both(_strings(s or set()), q) for s, q in parts]
                query = _both(query, ALL if ALL in ways else ("or", *ways))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, body = arg
            inside, inner = _walk(body, {""})
            if least:
                query = _both(query, inner)
            if inside is not None and (least, most) == (0, 1):
                nxt = inside | {""}
            elif inside is not None and least == most and len(inside) ** least <= MOST:
                nxt = {""}
                for _ in range(least):
                    nxt = {a + b for a in nxt for b in inside}
        elif op is C.AT:
            continue
        if nxt is not None and len(run) * len(nxt) <= MOST:
            run = {x + y for x in run for y in nxt}
        else:
            query, whole = _both(query, _strings(run)), False
            run = nxt or {""}
    return (run, query) if whole else (None, _both(query, _strings(run)))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The Boolean query over lower-case trigrams that every text with a match satisfies."""
    run, query = _walk(list(_parser.parse(pattern, flags)), {""})
    return _both(query, _strings(run) if run is not None else ALL)


def trigrams(q: Query) -> set[str]:
    return {q[1]} if q[0] == "has" else set().union(*map(trigrams, q[1:])) if q != ALL else set()


def _ascii(q: Query) -> Query:
    """Trigrams beyond ASCII are not indexed; without one a query is only wider."""
    if q[0] == "has":
        return q if q[1].isascii() else ALL
    if q == ALL:
        return q
    parts = [_ascii(x) for x in q[1:]]
    if q[0] == "or":
        return ALL if ALL in parts else ("or", *parts)
    parts = [x for x in parts if x != ALL]
    return ("and", *parts) if parts else ALL


class Shard:
    """Posting lists of one run of documents for the given trigrams."""

    def __init__(self, b: np.ndarray, o: np.ndarray, number: np.ndarray, names: list[str]):
        self.n, self.at = len(o) - 1, {x: k + 1 for k, x in enumerate(names)}
        x = LOWER[b].astype(np.int32)
        code = x[:-2] << 16 | x[1:-1] << 8 | x[2:] if len(x) > 2 else np.zeros(0, np.int32)
        found = number[code]
        pos = np.flatnonzero(found)
        doc = np.searchsorted(o, pos, side="right") - 1
        whole = pos + 2 < o[doc + 1]  # not across the end of a document
        pos, doc = pos[whole], doc[whole]
        key = np.unique(found[pos].astype(np.int64) * (self.n + 1) + doc)
        self.gram, self.doc = key // (self.n + 1), key % (self.n + 1)

    def postings(self, trigram: str) -> np.ndarray:
        k = self.at[trigram]
        i, j = np.searchsorted(self.gram, [k, k + 1])
        return self.doc[i:j]

    def find(self, q: Query) -> np.ndarray:
        """Sorted documents that satisfy a query."""
        if q == ALL:
            return np.arange(self.n)
        if q[0] == "has":
            return self.postings(q[1])
        parts = sorted((self.find(x) for x in q[1:]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
            if q[0] == "and" and not len(out):
                break
        return out


def _numbers(names: list[str]) -> np.ndarray:
    number = np.zeros(1 << 24, dtype=np.uint16)
    for k, x in enumerate(names):
        a, b, c = x.encode()
        number[a << 16 | b << 8 | c] = k + 1
    return number


def _scanner(rules: tuple[Rule, ...], kept: list[str], last: int, out_col: str) -> Callable:
    queries = [_ascii(trigram_query(r.pattern, r.flags)) for r in rules]
    names = sorted(set().union(*map(trigrams, queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers(names)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for i, j, b, o in chunks(batch.column(last)):
                shard = Shard(b, o, number, names)
                texts = batch.column(last).slice(i, j - i).to_pylist()
                for rank, (rule, q) in enumerate(zip(rules, queries, strict=True)):
                    for k in shard.find(q):
                        for s, e in rule.spans(texts[k] or ""):
                            spans[i + k].append((s, rank, e))
            rows = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in sorted(x)] for x in spans]
            yield pa.record_batch([*batch.columns, pa.array(rows, kind)], names=[*kept, out_col])

    return run


def scan_secrets(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """Add ``out_col``, the spans found, by start and then by the order of the rules."""
    kept = [c for c in df.columns if c.lower() != out_col.lower()]
    only = df.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*only.schema, T.StructField(out_col, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    small_batches(df.sparkSession)
    return only.mapInArrow(frugal(_scanner(rules, kept, kept.index(text_col), out_col)), schema)


def _is(kind: str) -> Callable:
    return lambda k: k == kind


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    kinds = [r.kind for r in BASE]
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *(F.size(F.filter(F.col("spans")["kind"], _is(k))).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
