"""Personal data by a semi-Markov conditional random field over whole spans.

Text around digits, ``@`` and ``+`` is cut into atoms (runs of letters, runs of digits,
single other characters).  A segmentation labels runs of up to ``LONGEST`` atoms email,
ip, card or phone, and every other atom none.  A segment is scored as a whole: features
see the entire span (digits, groups, checksum, separators, shape, what stands on either
side), so no per-character tags are needed.  Bounded-length dynamic programming finds the
best boundaries and types together; training maximises the conditional likelihood with the
same recursions on generated sentences (fixed seed), in a second or two on the driver.

The base rules are applied beside the field and always stay; the field adds spans, such as
telephone numbers without a plus or cards of 13 to 15 digits, that touch no base span.
Text without a digit or ``@`` holds nothing that either could find, and is not cut at all.
Tokens of any length are cut, and runs of tokens of any number are decoded as one.

Defined results: null and empty texts have no spans; offsets are code points, end
exclusive; rows repeat as given; other columns pass through, one named like the added
column is replaced.  Time is linear in the text, whatever its runs.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.text import frugal, small_batches

KINDS = ("email", "ip", "card", "phone")
LONGEST, MARGIN = 24, 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run is entered at its first digit only, so long runs cost no more than their length
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base rules, each leftmost non-overlapping; matches that fail their test are dropped."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = re.sub("[ -]", "", m[0]) if len(m[0]) < 64 else ""
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# --- the field -------------------------------------------------------------------------

_ATOM = re.compile(r"[^\W\d_]+|[0-9]+|.", re.DOTALL)
_TOKEN = re.compile(r"\S+")
_CUE = {"phone": "phone", "tel": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "server": "ip", "mail": "email", "email": "email"}


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of tokens that hold a digit or @, whatever their length and number, with the token before."""
    out: list[list[int]] = []
    before = 0
    for m in _TOKEN.finditer(text):
        t = m[0]
        if "@" in t or _DIGIT.search(t):
            if out and out[-1][1] >= before:
                out[-1][1] = m.end()
            else:
                out.append([before, m.end()])
        before = m.start()
    return [(a, b) for a, b in out]


def _features(kind: str, span: str, left: str, right: str, cue: str) -> list[str]:
    """Whole-span features; left and right are the characters beside the span, cue the word before."""
    d = "".join(c for c in span if c in "0123456789")
    f = ["bias", "in word" if left.isalnum() or right.isalnum() or left in "@._" and left else "apart"]
    if kind == "email":
        local, _, host = span.partition("@")
        good = bool(local) and all(c in _LOCAL for c in local) and _DOMAIN.fullmatch(host) is not None
        f += [f"form {good}", f"top {host.rpartition('.')[2].isalpha() and 2 <= len(host.rpartition('.')[2]) <= 10}"]
        f.append(f"all {not (left and left in _LOCAL) and not (right and (right.isalnum() or right == '-'))}")
    elif kind == "ip":
        parts = span.split(".")
        good = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        f += [f"form {good}", f"longer {left == '.' or right == '.' and False}"]
    else:
        f.append(f"digits {len(d) if 6 < len(d) < 20 else 0}")
        f.append(f"clean {all(c in '0123456789 -' if kind == 'card' else c in '0123456789 ().+-' for c in span)}")
        groups = re.findall(r"[0-9]+", span)
        if kind == "card":
            f += [f"luhn {len(d) >= 13 and luhn(d)}", f"fours {len(groups) == 4 and all(len(g) == 4 for g in groups)}", f"one {len(groups) == 1}"]
        else:
            f += [f"plus {span[:1] == '+'}", f"area {span[:1] == '(' and ')' in span}", f"shape {'-'.join(str(len(g)) for g in groups) if len(groups) < 5 else '*'}", f"within + {'+' in span[1:]}"]
        f.append(f"edge {span[-1:].isdigit() and (span[:1].isdigit() or span[:1] in '+(')}")
    f.append(f"cue {_CUE.get(cue, 'none') if _CUE.get(cue) in (None, kind) else 'other'}")
    return [f"{kind}:{x}" for x in f]


def _candidates(text: str, atoms: Sequence[tuple[int, int]], cue: str) -> Iterator[tuple[int, str, list[str]]]:
    """(number of atoms, kind, features) of the segments that begin with the first of up to LONGEST atoms."""
    a = atoms[0][0]
    digits = ats = dots = other = 0
    for n, (s, e) in enumerate(atoms, 1):
        w = text[s:e]
        if w[0] in "0123456789":
            digits += e - s
        elif w == "@":
            ats += 1
        elif w == ".":
            dots += 1
        elif w.isspace() and w != " ":
            return
        elif w not in " -()+" or (w == "+" and n > 1 and text[s - 1] in "+ "):
            other += 1
        if digits > 22 or ats > 1:
            return
        if not (w[0] in "0123456789" or w[0].isalpha()):
            continue
        kinds = []
        if ats == 1 and dots and " " not in text[a:e]:
            kinds.append("email")
        elif not ats and not other:
            if dots == 3 and digits >= 4:
                kinds.append("ip")
            if not dots and 13 <= digits <= 19 and text[a] != "+":
                kinds.append("card")
            if 7 <= digits <= 15:
                kinds.append("phone")
        elif not ats and other and text[a] in "+(0123456789":
            return
        left, right = text[a - 1 : a] if a else "", text[e : e + 1]
        for k in kinds:
            yield n, k, _features(k, text[a:e], left, right, cue)


def _begins(c: str) -> bool:
    return c in "+(0123456789" or c.isalpha()


class Sentence:
    """Atoms of a region and its candidate segments with their features."""

    def __init__(self, text: str, start: int, end: int):
        atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
        self.bounds = [a for a, _ in atoms] + [end]
        self.n, self.at = len(atoms), start
        self.by_end: list[list[tuple[int, str, list[str]]]] = [[] for _ in range(self.n + 1)]
        cue = ""
        for i, (a, z) in enumerate(atoms):
            if _begins(text[a]):
                for n, kind, f in _candidates(text, atoms[i : i + LONGEST], cue):
                    self.by_end[i + n].append((i, kind, f))
            if text[a].isalpha():
                cue = text[a:z].lower()

    def span(self, i: int, j: int) -> tuple[int, int]:
        return self.bounds[i], self.bounds[j]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def decode(s: Sentence, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """The best segmentation's entities, as kinds and atom bounds."""
    best, back = [0.0] + [-math.inf] * s.n, [None] * (s.n + 1)
    for j in range(1, s.n + 1):
        best[j] = best[j - 1]
        for i, kind, f in s.by_end[j]:
            v = best[i] + sum(weights.get(x, 0.0) for x in f) - MARGIN
            if v > best[j]:
                best[j], back[j] = v, (i, kind)
    out, j = [], s.n
    while j:
        if back[j]:
            i, kind = back[j]
            out.append((kind, i, j))
            j = i
        else:
            j -= 1
    return out[::-1]


def field_spans(text: str, start: int, end: int, weights: dict[str, float]) -> Iterator[tuple[str, int, int]]:
    """What ``decode`` finds in a region, in one pass over its atoms.

    No more is held than the atoms of a longest segment and the programme since the last atom
    that no candidate segment crosses; every segmentation passes there, so nothing is lost.
    """
    coming = (m.span() for m in _ATOM.finditer(text, start, end))
    ahead = deque(itertools.islice(coming, LONGEST))
    cue, at = "", -1
    best, back, bounds, pending = [0.0], [None], [], {}  # from the last such atom on

    def done() -> list[tuple[str, int, int]]:
        out, j = [], len(back) - 1
        while j > 0:
            if back[j]:
                i, kind = back[j]
                out.append((kind, bounds[i][0], bounds[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    while ahead:
        i = len(bounds)
        if i and not pending:
            yield from done()
            best, back, bounds, i = [0.0], [None], [], 0
        a, z = ahead[0]
        c = text[a]
        if at is not None and at < a:
            at = text.find("@", a, end)
            at = None if at < 0 else at
        # a segment that begins with letters can only be an email
        if _begins(c) and (not c.isalpha() or at is not None and at < ahead[-1][1]):
            for n, kind, f in _candidates(text, ahead, cue):
                v = best[i] + sum(weights.get(x, 0.0) for x in f) - MARGIN
                if i + n not in pending or v > pending[i + n][0]:
                    pending[i + n] = v, (i, kind)
        if c.isalpha():
            cue = text[a:z].lower()
        bounds.append(ahead.popleft())
        ahead.extend(itertools.islice(coming, 1))
        v, via = pending.pop(i + 1, (-math.inf, None))
        best.append(max(v, best[i]))
        back.append(via if v > best[i] else None)
    yield from done()


def _gradient(s: Sentence, gold: set[tuple[str, int, int]], weights: dict[str, float], grad: dict[str, float]) -> None:
    """Add the gradient of the log-likelihood: observed less expected features."""
    score = [[sum(weights.get(x, 0.0) for x in f) for _, _, f in row] for row in s.by_end]
    fwd = [0.0] * (s.n + 1)
    for j in range(1, s.n + 1):
        fwd[j] = fwd[j - 1]
        for (i, _, _), v in zip(s.by_end[j], score[j], strict=True):
            fwd[j] = _add(fwd[j], fwd[i] + v)
    bwd = [-math.inf] * s.n + [0.0]
    for j in range(s.n, 0, -1):
        bwd[j - 1] = _add(bwd[j - 1], bwd[j])
        for (i, _, _), v in zip(s.by_end[j], score[j], strict=True):
            bwd[i] = _add(bwd[i], bwd[j] + v)
    for j in range(1, s.n + 1):
        for (i, kind, f), v in zip(s.by_end[j], score[j], strict=True):
            w = ((kind, *s.span(i, j)) in gold) - math.exp(min(0.0, fwd[i] + v + bwd[j] - fwd[s.n]))
            if abs(w) > 1e-6:
                for x in f:
                    grad[x] += w


def _generated(count: int, seed: int) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Sentences with entities of every kind and with numbers that are none."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))

    def card() -> str:
        n = r.choice((13, 14, 15, 16, 16, 16, 16, 19))
        d = digits(n - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if n != 16 or r.random() < 0.5 else r.choice(" -").join(d[k : k + 4] for k in (0, 4, 8, 12))

    def email() -> str:
        return f"{word()}{r.choice(('', '.' + word(), digits(2), '_' + word()))}@{word()}.{r.choice(('com', 'org', 'net', 'example.com', 'de', 'fr'))}"

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"+{digits(2)} {a} {b}{c}", f"+1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(11)}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}"))

    def nothing() -> str:
        bad = digits(16)
        while luhn(bad):
            bad = digits(16)
        return r.choice((digits(r.randint(1, 6)), f"{digits(1)}.{digits(2)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}", bad, f"{digits(2)}.{digits(1)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"999.{digits(3)}.777.{digits(2)}", digits(r.randint(20, 30)), f"{digits(8)}", digits(10), f"{digits(3)} {digits(4)}", f"@{word()}", f"{digits(4)}-{digits(4)}", f"{digits(12)}", f"{word()}{digits(7)}", f"{digits(9)}{word()}"))

    make = {"email": email, "card": card, "phone": phone, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))}
    out = []
    for _ in range(count):
        text, gold = "", set()
        for _ in range(r.randint(1, 4)):
            text += f"{word()} "
            kind = r.choice((*KINDS, "", "", ""))
            if kind and r.random() < 0.2:
                text += r.choice([k for k, v in _CUE.items() if v == kind]) + r.choice((" ", ": "))
            s = make[kind]() if kind else nothing()
            if kind:
                gold.add((kind, len(text), len(text) + len(s)))
            text += s + r.choice((" ", " ", ". ", ", ")) + (f"{word()} " if r.random() < 0.8 else "")
        out.append((text, gold))
    return out


@functools.lru_cache(maxsize=1)
def train(count: int = 500, rounds: int = 40, seed: int = 11) -> dict[str, float]:
    """Weights by regularised gradient ascent (Adagrad) on generated sentences."""
    rows = [(Sentence(t, a, b), g) for t, g in _generated(count, seed) for a, b in regions(t)]
    weights: dict[str, float] = defaultdict(float)
    power: dict[str, float] = defaultdict(lambda: 1e-8)
    for _ in range(rounds):
        grad: dict[str, float] = defaultdict(float)
        for s, g in rows:
            _gradient(s, g, weights, grad)
        for x, v in grad.items():
            v -= 0.05 * weights[x]
            power[x] += v * v
            weights[x] += 0.8 * v / math.sqrt(power[x])
    return dict(weights)


def all_spans(text: str, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """Base spans and the field's spans that touch none of them, by kind and start."""
    base = base_spans(text)
    taken: list[list[int]] = []  # what base spans cover, in disjoint stretches
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    more = []
    for a, b in regions(text) if "@" in text or _DIGIT.search(text) else ():
        for kind, x, y in field_spans(text, a, b, weights):
            k = bisect_right(taken, x, key=lambda t: t[1])  # the first that ends after x
            if k == len(taken) or taken[k][0] >= y:
                more.append((kind, x, y))
    return sorted(((k, s, e) for k, s, e in base + more), key=lambda z: (KINDS.index(z[0]), z[1]))


def find_pii(df: DataFrame, text_col: str = "text", out_col: str = "spans", weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``out_col``: kind, start, end and whether a base rule found it."""
    kept = [c for c in df.columns if c.lower() != out_col.lower()]
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(weights or train())
    at = kept.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            rows = []
            for x in batch.column(at):
                text = x.as_py() or ""
                if "@" not in text and not _DIGIT.search(text):
                    rows.append([])
                    continue
                base = set(base_spans(text))
                rows.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in base} for k, s, e in all_spans(text, w)])
            yield pa.record_batch([*batch.columns, pa.array(rows, kind)], names=[*kept, out_col])

    only = df.select(*(F.col(f"`{c}`") for c in kept))
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([*only.schema, T.StructField(out_col, T.ArrayType(item))])
    return only.mapInArrow(frugal(run), schema)


def _base_of(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; counts and digest are of the base spans, spans holds all."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", _base_of(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
