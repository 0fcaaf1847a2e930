"""Each operator against brute force, a round trip or held-out accuracy, and on odd tables."""

import collections
import hashlib
import itertools
import random
import re
import tempfile

import numpy as np
import pandas as pd
import pytest
from docketry.llm import byte_bpe, components, decontaminate, embedding_dedup, language_id, line_dedup, minhash_dedup, pii, secrets, text, toxicity, warc_bundle
from docketry.session import Scratch
from pyspark.sql import functions as F

#: Rows that every text operator must take: null, empty, long, repeated, clashing columns.
ODD = [(1, None, "en"), (2, "", None), (3, "a b c d e f", "en"), (3, "a b c d e f", "en"), (4, "x" * 200_000, None), (None, "no id here", "de"), (5, "é \x00 \t\n 漢字", "fr"), (6, "%%% 123", None)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({"ids": F.lit(1), "spans": F.lit("s"), "score": F.lit(0.5), "component_id": F.lit(7), "n_lines": F.lit("n"), "key": F.lit("k"), "decoded": F.lit(2), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


# --- shared parts -----------------------------------------------------------------------


def test_word_hashes_agree_with_words():
    texts = ["", "a", " Ab  cD\x0b\x1cé ", "x" * 5000, "a\nb", "É é", "Ab"]
    seen = {}
    import pyarrow as pa

    for i, j, b, o in text.chunks(pa.array([*texts, None]), 64):
        w = text.words(b, o, text.NOT_SPACE)
        for k in range(j - i):
            found = re.findall(r"[^\x20\x09-\x0D]+", lower([*texts, None][i + k]))
            h = w.hashes[w.first[k] : w.first[k + 1]].tolist()
            assert len(h) == len(found)
            for x, y in zip(found, h, strict=True):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(200, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df, Scratch(spark, "t")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 50)} == {1}
    assert components.connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


# --- 1 embeddings -----------------------------------------------------------------------


def brute_vectors(rows, threshold):
    n, up = collections.Counter(), {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    unit = lambda e: (e / np.abs(e).max()) / np.linalg.norm(e / np.abs(e).max())
    ok = [(i, unit(np.array(e, float)), lab) for i, e, lab in rows if e is not None and lab is not None and None not in e and np.isfinite(np.array(e, float)).all() and np.any(e)]
    for (i, x, a), (j, y, b) in itertools.combinations(ok, 2):
        if a == b and len(x) == len(y) and x @ y >= threshold:
            n[i] += 1
            n[j] += 1
            p, q = sorted((root(i), root(j)))
            up[q] = p
    return {i: (n[i], root(i), root(i) == i) for i in up}


@pytest.mark.parametrize("tile", [3, 4096])
def test_embeddings_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", tile)
    r = np.random.default_rng(1)
    hub = r.normal(size=12)
    rows = [(i, (hub + r.normal(size=12) * 0.27).tolist(), 1) for i in range(40)] + [(100 + i, r.normal(size=12).tolist(), i % 2) for i in range(30)]
    rows += [(200, None, 1), (201, [0.0] * 12, 1), (202, [None] + [1.0] * 11, 1), (203, [float("nan")] + [1.0] * 11, 1), (204, hub.tolist(), None), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1), (207, [1e300] * 12, 1), (208, [1e-300] * 12, 1)]
    df = spark.createDataFrame([(i, e, lab, 9) for i, e, lab in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(df).collect()}
    assert got == brute_vectors(rows, 0.93)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_repeated_vectors_are_dealt_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 5)
    rows = [(1, [1.0, 0.0, 0.5], 1)] * 40 + [(2, [1.0, 0.0, 0.5], 1), (3, [0.0, 1.0, 0.0], 1), (None, [1.0, 0.0, 0.5], 1)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    # a repeated vec_id's rows show the sum of their links, and don't count each other
    assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == {(1, 40, 1, True): 40, (2, 40, 1, False): 1, (3, 0, 3, True): 1, (None, 0, None, True): 1}


# --- 2 decontamination ------------------------------------------------------------------


def brute_hits(docs, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for _, t in docs:
        w, hit, named = find(t), set(), set()
        for item, x in items:
            x = find(x)
            n = min(window, len(x))
            for s in range(len(x) - n + 1) if x else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit.update(range(p, p + n))
                        named.add(str(item))
        out.append((len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fast_hits(docs, items, window=13):
    """What brute_hits finds, by a table of all windows."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    known = collections.defaultdict(set)
    for item, x in items:
        x = find(x)
        n = min(window, len(x))
        for s in range(len(x) - n + 1) if x and item is not None else ():
            known[tuple(x[s : s + n])].add(str(item))
    out = []
    for _, t in docs:
        w, hit, named = find(t), set(), set()
        for n in range(1, window + 1):
            for p in range(len(w) - n + 1):
                if found := known.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    named |= found
        out.append((len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_matches_brute_force(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(1, line(30)), (2, "w1"), (3, "w2 w3 w4"), (4, None), (5, ""), (10, line(13)), (11, "W1!")]
    docs = [(k, f"{line(r.randint(0, 40))} {r.choice(items)[1] or ''} {line(5)}".upper() if k % 2 else line(20)) for k in range(40)]
    docs += [(90, None), (91, ""), (92, items[0][1][:60]), (93, items[0][1]), (93, items[0][1]), (None, items[0][1]), (94, "w1 " * 500)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(d, b).collect())
    assert got == sorted((str(k), *x) for (k, _), x in zip(docs, brute_hits(docs, items), strict=True))
    assert fast_hits(docs, items) == brute_hits(docs, items)
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(d, b.limit(0)).collect())
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_proximity_finds_what_phrases_miss(spark):
    item = " ".join(f"t{k}" for k in range(13))
    d = spark.createDataFrame([(1, item.replace("t6", "foreign t6")), (2, "t1 t2"), (3, item.replace("t6", "foreign"))], "doc_id long, text string")
    index = decontaminate.PositionalIndex(d, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert index.phrases().count() == 0
    assert {(r["doc_id"], r["item_id"], r["start"]) for r in index.proximity(3).collect()} == {(1, "7", 0), (3, "7", 0)}


def test_texts_that_share_an_item_id_are_searched_one_by_one(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(13)) for x in "ab")
    items = [(7, one), (7, two), (7, one), (8, two), (None, one)]
    d = spark.createDataFrame([(1, one), (2, f"{two} x"), (3, "y")], "doc_id long, text string").withColumns({"item_id": F.lit("i"), "h": F.lit(0), "term": F.lit(1)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({"pos": F.lit(3), "doc_id": F.lit("d")})
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["near_items"]) for r in decontaminate.decontaminate(d, b, slop=3).collect()}
    assert got == {1: (13, ["7"], ["7"]), 2: (13, ["7", "8"], ["7", "8"]), 3: (0, [], [])}


def edit_distance_within(pattern, words, k):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) <= k


def test_proximity_matches_brute_force(spark):
    item = " ".join(f"t{k}" for k in range(13))
    r = random.Random(11)
    words = [f"w{k}" for k in range(12)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(7, item), (8, line(30)), (9, line(6)), (10, "w1 w2"), (11, line(4)), (12, line(9)), (13, None), (14, ""), (15, item.upper())]

    def edited(t):
        w = t.split()
        for _ in range(r.randint(0, 5)):
            p = r.randrange(len(w) + 1)
            w[p : p + r.randint(0, 1)] = [r.choice(["foreign", "x", "w3"])] * r.randint(0, 1)
        return " ".join(w)

    docs = [(1, item.replace("t6", "foreign t6")), (2, item.replace("t6", "foreign")), (3, item.replace("t6 ", "")), (4, "t1 t2"), (5, None), (6, ""), (None, item.replace("t6", "foreign t6")), (7, f"a b {item.replace('t3', 'q r t3').replace('t9', 'z')} c d"), (7, "again"), (8, item.replace("t6", "q r s u t6"))]
    docs += [(100 + k, f"{line(r.randint(0, 6))} {edited(r.choice(items)[1] or line(8))} {line(r.randint(0, 6))}") for k in range(60)]
    docs += [(200, f"{items[1][1]} " * 3 + "x " * 100 + edited(items[1][1])), (200, items[1][1]), (200, items[1][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in docs:
        for k, x in items:
            x, w = (x or "").lower().split(), (t or "").lower().split()
            n = min(13, len(x))
            for s in range(len(x) - n + 1) if x else ():
                if edit_distance_within(x[s : s + n], w, min(3, n // 4)):
                    want.add((i, str(k), s, t))
    hashes = {(x["doc_id"], x["h"]): x["text"] for x in d.withColumn("h", F.xxhash64("text")).collect()}
    got = {(x["doc_id"], x["item_id"], x["start"], hashes[x["doc_id"], x["h"]]) for x in decontaminate.PositionalIndex(d, b).proximity(3).collect()}
    assert got == want and {i for i, k, _, _ in want if k == "7" and (i or 0) < 100} == {1, 2, 3, 7, None}
    out = decontaminate.decontaminate(d, b, slop=3).collect()
    assert len(out) == len(docs)
    for x in out:
        t = hashes[x["doc_id"], x["h"]]
        assert x["near_items"] == sorted({k for i, k, _, u in want if (i, u) == (x["doc_id"], t)}) and set(x["items"]) <= set(x["near_items"])
    assert decontaminate.PositionalIndex(d, b.limit(0)).proximity(3).count() == 0


# --- 3 archives -------------------------------------------------------------------------


def test_archive_round_trip(spark):
    rows = [(1, "u\r\nv", "x" * 1500), (2, None, "x" * 1500), (3, "", None), (4, "w", "é" * 600), (5, "w", "é" * 600), (6, "s", "small"), (7, "s", "small"), (8, "l", "y" * 700_000), (None, "n", "x" * 1500), (9, "z", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("bundle", F.lit(1))
    index = warc_bundle.write_bundles(df, "file://" + tempfile.mkdtemp(), frame_bytes=2000, bundle_bytes=600)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc_bundle.read_bundles(index).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None), None: ("revisit", 2), 9: ("response", None)}
    for i, _, h in rows:
        b = (h or "").encode()
        assert got[i][2:] == (len(b), hashlib.sha1(b).hexdigest())
    one = warc_bundle.fetch(index, index.where("page_id = 8").select("record_id")).collect()
    assert [bytes(r["payload"]) for r in one] == [b"y" * 700_000]
    assert warc_bundle.write_bundles(df.limit(0), "file://" + tempfile.mkdtemp()).count() == 0


def test_bundles_are_plain_zstd_streams_and_reject_damage():
    import io

    import zstandard

    records = [warc_bundle.record(k, "u", b"p" * k * 50, "d", None) for k in range(40)]
    data = warc_bundle.to_bytes(records, 3000)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records)
    reader = warc_bundle.BundleReader(io.BytesIO(data), len(data))
    assert len(reader.frames) > 3 and sum(1 for _ in reader.records()) == 40
    with pytest.raises(ValueError):
        warc_bundle.BundleReader(io.BytesIO(data[:-1]), len(data) - 1)
    with pytest.raises(ValueError):
        warc_bundle.parse(records[5][:-10])


# --- 4 language -------------------------------------------------------------------------


def test_language_held_out_accuracy(docs):
    rows = language_id.identify(docs).select("held_out", "lang", "lang_pred", "score", "rejected").toPandas()
    held = rows[rows.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97 and rows.rejected.mean() < 0.02
    assert rows.score.between(0, 1).all()


def test_language_of_odd_rows(spark, docs, odd):
    model = language_id.fit(docs.select("lang", "text", F.col("doc_id").alias("salt")))
    got = language_id.predict(odd, model).collect()
    assert len(got) == len(ODD)
    by = {(r["doc_id"], r["text"]): r for r in got}
    for key in ((1, None), (2, ""), (6, "%%% 123")):
        assert (by[key]["lang_pred"], by[key]["score"], by[key]["rejected"]) == ("und", 0.0, True)
    assert by[(3, "a b c d e f")]["lang_pred"] in set(model.names)
    assert language_id.fit(odd.limit(0).select("lang", "text", F.lit(1).alias("salt"))) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}


def test_unlearned_languages_and_letter_junk_are_rejected(spark, docs):
    r = random.Random(10)
    junk = [r.randbytes(r.randint(40, 400)).hex() for _ in range(60)]
    junk += [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(40)) for _ in range(60)]
    rows = lambda df: df.select("lang", "text", F.col("doc_id").alias("salt"))
    for lang in ("en", "es", "de", "fr"):
        model = language_id.fit(rows(docs.where(F.col("lang") != lang)))
        got = language_id.predict(docs.where((F.col("lang") == lang) & (F.length("text") > 100)), model).toPandas()
        assert got.rejected.mean() > 0.85, (lang, got.rejected.mean())
    got = language_id.predict(spark.createDataFrame([(t,) for t in junk], "text string"), language_id.fit(rows(docs))).toPandas()
    assert got.rejected.mean() > 0.95


# --- 5 personal data --------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEST = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 16 <= len(re.sub("[ -]", "", x)) <= 19 and pii.luhn(re.sub("[ -]", "", x)), "phone": lambda x: 8 <= len(re.sub("[^0-9]", "", x)) <= 15}


def test_base_spans_are_those_of_the_expressions():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice(["@", ".", "-", "+", " ", "(", ")", "1", "4111 1111 1111 1111", "12", "255", "256", "a", "b.c", "é", "\n", "001"]) for _ in range(r.randint(0, 25)))
        want = [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, t) if TEST[k](m[0])]
        assert pii.base_spans(t) == want, t


def test_field_finds_held_out_entities():
    w, right, wrong, missed = pii.train(), 0, 0, 0
    for t, gold in pii._generated(150, 1234):
        found = set()
        for a, b in pii.regions(t):
            s = pii.Sentence(t, a, b)
            found |= {(k, *s.span(i, j)) for k, i, j in pii.decode(s, w)}
        right, wrong, missed = right + len(found & gold), wrong + len(found - gold), missed + len(gold - found)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9


def test_added_spans_touch_no_base_span():
    w = pii.train()
    text = "call 212-555-0187 or " + ", ".join(f"a{k}@b{k}.org +1 {200 + k} 555 0{100 + k} 10.0.0.{k} 4111 1111 1111 1111" for k in range(60))
    base = {(s, e) for _, s, e in pii.base_spans(text)}
    for _, s, e in pii.all_spans(text, w):
        assert (s, e) in base or not any(s < q and p < e for p, q in base)


def test_pii_of_odd_rows_and_long_runs(odd):
    got = pii.find_pii(odd).collect()
    assert len(got) == len(ODD) and all(isinstance(r["spans"], list) for r in got)
    for t in ("1" * 100_000, "a" * 100_000 + "@", "1." * 50_000, "+1 " * 30_000, "@" * 50_000):
        pii.all_spans(t, pii.train())


def test_field_sees_long_tokens_and_long_runs():
    w, r = pii.train(), random.Random(12)
    spans = lambda t: {(k, t[s:e]) for k, s, e in pii.all_spans(t, w)}
    rows = ",".join(f'{{"name":"n{k}","phone":"{200 + k}-555-{1000 + k}"}}' for k in range(40))
    assert " " not in rows and {("phone", f"{200 + k}-555-{1000 + k}") for k in range(40)} <= spans(rows)
    assert ("phone", "212-555-0187") in spans("漢字" * 200 + "、212-555-0187、" + "文書" * 200)
    # fields across every border of 64 tokens, none twice
    table = "7, 8, " + ", ".join(["(212) 555 0187"] * 100)
    assert [(k, table[s:e]) for k, s, e in pii.all_spans(table, w)] == [("phone", "(212) 555 0187")] * 100
    # one pass finds what the whole programme finds
    odd = ["".join(r.choice(["@", ".", "-", "+", " ", "(", ")", "1", "4111 1111 1111 1111", "555-123-4567", "12", "a", "b.c", "é", "\n", "x@y.org"]) for _ in range(r.randint(0, 120))) for _ in range(300)]
    for t in [t for t, _ in pii._generated(150, 77)] + odd + [rows, table]:
        for a, b in pii.regions(t):
            s = pii.Sentence(t, a, b)
            assert list(pii.field_spans(t, a, b, w)) == [(k, *s.span(i, j)) for k, i, j in pii.decode(s, w)]


# --- 6 lines ----------------------------------------------------------------------------


def brute_lines(rows, keep_first=True):
    """{(row number): (text, lines, recurring, dropped)} by comparing all lines of all documents."""
    own = 2**63 - 1

    def form(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        masked = 2 * sum(bool(re.search("[0-9]", x)) for x in w) < len(w)
        w = [None if masked and re.search("[0-9]", x) else x for x in w]
        n = len(w) - line_dedup.LEAD
        p = min(max(n, 0), line_dedup.RUNS) if masked else 0
        if p + line_dedup.LEAD < 4:
            return (len(w), masked, tuple(w)), None
        return (len(w), tuple(w[: line_dedup.LEAD])), [w[line_dedup.LEAD + n * k // p : line_dedup.LEAD + n * (k + 1) // p] for k in range(p)]

    def alike(x, y):
        if x[0] != y[0] or (x[1] is None) != (y[1] is None):
            return False
        return x[1] is None or 4 * sum(a != b for a, b in zip(x[1], y[1], strict=True)) <= len(x[1]) + line_dedup.LEAD

    parts = [[(x, form(x)) for x in t.split("\n")] if t else [] for _, t in rows]
    seen = {(own if i is None else i, repr(f)): f for (i, _), p in zip(rows, parts, strict=True) for x, f in p if f[0][0]}
    out = []
    for (i, t), p in zip(rows, parts, strict=True):
        i, keep, again = own if i is None else i, [], 0
        for x, f in p:
            others = [d for (d, _), g in seen.items() if d != i and alike(f, g)] if f[0][0] else []
            again += bool(others)
            if not others or (keep_first and min(others) > i):
                keep.append(x)
        out.append(("\n".join(keep) if p else t, len(p), again, len(p) - len(keep)))
    return out


def line_rows(spark, rows, **how):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int").withColumns({"d": F.lit("x"), "line": F.lit(1), "KEY": F.lit("k"), "N_lines": F.lit("n")})
    got = sorted(line_dedup.line_dedup(df, **how).collect(), key=lambda r: r["row"])
    return [(r["text"], r["n_lines"], r["n_recurring"], r["n_dropped"]) for r in got]


@pytest.mark.parametrize("tile", [3, 2048])
@pytest.mark.parametrize("keep_first", [True, False])
def test_lines_match_brute_force(spark, monkeypatch, tile, keep_first):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    r = random.Random(21)
    word = lambda k=9: "abcdefghijklmnop"[r.randrange(k)]
    forms = [[word(16) for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 12, 14, 15, 40, 61]))] for _ in range(25)]

    def line():
        w = list(r.choice(forms))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = r.choice([word(), f"{r.randint(0, 99)}", word().upper(), "new"])
        return r.choice(["  ", " "]).join(w)

    rows = [(k, "\n".join(line() for _ in range(r.randint(0, 5)))) for k in range(120)]
    rows += [(500 + k, " ".join(["same", "lead", *(word(4) for _ in range(6))])) for k in range(40)]
    rows += [(700, None), (701, ""), (702, "\n \n\t\n"), (703, "twice here\ntwice here"), (None, rows[0][1]), (None, "no id\nat all"), (None, "no id"), (3, rows[3][1]), (3, "another text of id three"), (704, "another text of id three")]
    assert line_rows(spark, rows, keep_first=keep_first) == brute_lines(rows, keep_first)


def test_recurring_lines_stay_once(spark):
    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, f"own one here\n{passage}"), (2, f"{passage}\nown two here"), (3, f"error 17 at host alpha in module core today now\n{passage}"), (4, "error 99 at host alpha in module core today now\nfour"), (5, "ok fine"), (6, "ok fine"), (9, "same line of five\nsame line of five"), (None, f"{passage}\nnull id"), (2, f"{passage}\nown two here")]
    got = line_rows(spark, rows)
    assert got[0] == (rows[0][1], 2, 1, 0)
    assert got[1] == got[8] == ("own two here", 2, 1, 1)
    assert got[2] == ("error 17 at host alpha in module core today now", 2, 2, 1)
    assert got[3] == ("four", 2, 1, 1)  # the template generalises the number
    assert got[4] == ("ok fine", 1, 1, 0) and got[5] == ("", 1, 1, 1)
    assert got[6] == (rows[6][1], 2, 0, 0) and got[7] == ("null id", 2, 1, 1)
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_templates_generalise_any_position(spark):
    names = ["alice", "bob", "carol", "dave"]
    cases = [
        [f"error while reading {x} for the user named {y} at the gate" for x, y in zip(["alpha", "beta", "gamma", "delta"], names, strict=True)],
        [f"Posted by {x} yesterday" for x in names],
        ["Read more"] * 20,
        [f"12 13 {k} 15" for k in range(4)],  # numbers alone are no template
    ]
    for k, lines in enumerate(cases):
        dropped = sum(x[3] for x in line_rows(spark, list(enumerate(lines))))
        assert dropped == (len(lines) - 1 if k < 3 else 0), lines


def test_recurring_lines_without_blanks_stay_once(spark):
    passage = "漢字文書の段落です。" * 50
    rows = [(1, f"{passage}\nfirst own line"), (2, f"second own line\n{passage}"), (3, passage), (4, "Datenschutzerklärung lesen"), (5, "Datenschutzerklärung  lesen\nx"), (6, "https://example.org/page/17"), (7, "https://example.org/page/18"), (8, "第1章" + "本文" * 9), (9, "第2章" + "別文" * 9)]
    got = line_rows(spark, rows)
    assert got[0] == (rows[0][1], 2, 1, 0) and got[1] == ("second own line", 2, 1, 1) and got[2] == ("", 1, 1, 1)
    assert got[3] == ("Datenschutzerklärung lesen", 1, 1, 0) and got[4] == ("x", 2, 1, 1)
    for (_, t), x in zip(rows[5:], got[5:], strict=True):  # other lines
        assert x == (t, 1, 0, 0)


# --- 7 byte-level BPE -------------------------------------------------------------------


def test_bpe_is_that_of_the_library(docs):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ours, ref = byte_bpe.codec(path, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    r = random.Random(4)
    texts = ["", " ", "<|endoftext|>", "a\x1cb\x85c", "I'll don't", "a" * 3000, "ab" * 700 + " " * 900, "日本語" * 300]
    texts += ["".join(r.choice(" abc\n\t\x1c\x850é日-_!'’😀") for _ in range(r.randrange(60))) for _ in range(800)]
    texts += [x["text"] for x in docs.select("text").limit(100).collect()]
    ids, sizes = ours.encode(texts)
    at = np.concatenate([[0], np.cumsum(sizes)])
    assert [ids[i:j].tolist() for i, j in itertools.pairwise(at)] == [ref.encode_ordinary(t) for t in texts]
    assert [b.decode() for b in byte_bpe.decoder(path).decode(ids, sizes)] == texts


def test_bpe_of_odd_rows(odd):
    got = byte_bpe.bpe_decode(byte_bpe.bpe_encode(odd)).collect()
    assert sorted(((r["text"] or "").encode() for r in got)) == sorted(bytes(r["decoded"]) for r in got)
    assert byte_bpe.bpe_round_trip(odd.limit(0)).count() == 0
    clash = odd.drop("ids", "decoded").withColumns({"IDS": F.lit(1), "Decoded": F.lit(2)})
    assert byte_bpe.bpe_decode(byte_bpe.bpe_encode(clash)).select("ids", "decoded").count() == len(ODD)


# --- 8 secrets --------------------------------------------------------------------------


def test_trigram_queries_hold_for_every_match():
    r = random.Random(5)
    for rule, make in ((secrets.BASE[0], lambda: r.choice(["Password", "apikey", "API_KEY", "secret", "ToKeN", "passwd"]) + r.choice(['"', "", "'"]) + r.choice([":", " = "]) + "abc123XYZ"), (secrets.BASE[1], lambda: "AKIA" + "A1" * 9), (secrets.MORE[0], lambda: "ghp_" + "a" * 40), (secrets.MORE[2], lambda: "-----BEGIN RSA PRIVATE KEY-----")):
        q = secrets.trigram_query(rule.pattern, rule.flags)
        holds = lambda q, t: q == secrets.ALL or (q[1] in t if q[0] == "has" else (all if q[0] == "and" else any)(holds(x, t) for x in q[1:]))  # noqa: B023, E731
        assert q != secrets.ALL
        for _ in range(50):
            t = "xx " + make() + " yy"
            assert rule.spans(t) and holds(q, t.lower()), t
        assert not holds(q, "nothing of the kind")
    assert secrets.trigram_query(r"[0-9a-f]+") == secrets.ALL
    assert secrets.trigram_query(r"(abc)?x*") == secrets.ALL
    assert secrets.trigrams(secrets.trigram_query(r"foo(bar|baz)+qux")) >= {"foo"}


def test_secrets_match_the_plain_expressions(spark, odd):
    r = random.Random(6)
    rows = [(k, "".join(r.choice(["password", "=", " ", "deadbeef" * 3, "AKIA" + "Z9" * 8, ":", "token", "'", "abcdef", "é", "\n", "K", "api_key", "ſecret"]) for _ in range(r.randint(0, 20)))) for k in range(400)]
    got = {x["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in x["spans"]] for x in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), secrets.BASE).collect()}
    for k, t in rows:
        want = [(s, i, rule.kind, e) for i, rule in enumerate(secrets.BASE) for s, e in rule.spans(t)]
        assert got[k] == [(s, kind, e) for s, _, kind, e in sorted(want)]
    assert secrets.scan_secrets(odd).count() == len(ODD)


# --- 9 toxicity -------------------------------------------------------------------------


def test_toxicity_held_out():
    r = random.Random(7)
    syllables = ["an", "the", "re", "on", "ti", "er", "ing", "st", "ha", "ou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    make = lambda bad: " ".join(r.choice(["moron", "worthless", "scum"]) if bad and r.random() < 0.06 else word() for _ in range(120)) + (" moron" if bad else "")
    rows = [(make(k % 4 == 0), int(k % 4 == 0)) for k in range(600)]
    model = toxicity.train([t for t, _ in rows[:400]], [y for _, y in rows[:400]])
    x = [toxicity.all_features(model.pair, b, np.array([0, len(b)]))[0] for b in (np.frombuffer(t.encode(), np.uint8) for t, _ in rows[400:])]
    right = (model.score(np.array(x)) >= 0.5) == np.array([y for _, y in rows[400:]], dtype=bool)
    assert right.mean() > 0.93


def test_toxicity_of_odd_rows_and_few_labels(odd, docs, spark, sf_dir):
    assert toxicity.train(["a", "b"], [1, 0]) == 0.5 and toxicity.train([], []) == 0.0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.fit(docs, labels.limit(0)) == 0.0


# --- 10 MinHash -------------------------------------------------------------------------


def brute_near(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            p, q = sorted((root(i), root(j)))
            up[q] = p
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("large", [2, 64])
def test_minhash_matches_brute_force(spark, large):
    r = random.Random(8)
    base = [[f"w{r.randint(0, 400)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for k in range(150):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"v{r.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "One"), (203, "one"), (204, "x" * 100_000), (205, rows[0][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.minhash_dedup(df, shingle=2, large=large, tile=2000).collect()}
    assert got == brute_near(rows, 2, 80)


def test_histograms_bound_the_common_shingles():
    import pyarrow as pa

    r = np.random.default_rng(13)
    pool = r.integers(0, 2**63, 60_000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(r.choice(pool[: 2 * n], n)) for n in (1, 2, 40, 130, 135, 300, 500, 4000, 4500, 30_000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 4 // 5], r.choice(pool, len(s) // 5 + 1)])) for s in sets]
    sets.append(np.arange(5000, dtype=np.uint64))  # all in one range, more than a byte counts
    sets.append(np.arange(100, 5000, dtype=np.uint64))
    low, n = minhash_dedup._Histograms(pa.chunked_array([pa.array([minhash_dedup._bins(s) for s in sets])])), np.array([len(s) for s in sets])
    for x in range(len(sets)):
        most = low.most(x, np.arange(len(sets)), n)
        assert all(m >= len(np.intersect1d(sets[x], s)) for m, s in zip(most, sets, strict=True))
    far = low.most(5, np.array([6]), n)[0]
    assert 100 * far < 80 * (n[5] + n[6] - far)  # and it tells unlike sets apart


def test_words_that_collide_under_polynomial_hashes_stay_apart(spark):
    one = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"{one} {one}"), (2, f"{two} {two}"), (3, one)], "doc_id long, text string")
    assert all(r["kept"] for r in minhash_dedup.minhash_dedup(df, shingle=2).collect())
    items = spark.createDataFrame([(1, two)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.decontaminate(df, items).collect()} == {1: 0, 2: 2, 3: 0}


def test_minhash_links_all_similar_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for size in (2, 5):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.minhash_dedup(docs, shingle=size).collect()}
        assert got == brute_near(rows, size, 80)


def test_minhash_of_odd_rows(odd):
    got = minhash_dedup.minhash_dedup(odd).collect()
    assert len(got) == len(ODD) and {(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None} == {(None, True)}
    assert minhash_dedup.minhash_dedup(odd.limit(0)).count() == 0
