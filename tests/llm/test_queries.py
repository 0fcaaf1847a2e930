"""Every registered query of the subpackage on whole tables, column by column against the plain rules."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import test_operators as brute
from docketry.llm import queries


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def spans_of(t):
    return [tuple(x.split(":")) for x in t.split(",")] if t else []


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark", "embeddings", "pages", "labels")}


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    def query(name, key):
        out = queries.QUERIES[name](spark, sf_dir).collect()
        found = {r[key]: r for r in out}
        assert len(found) == len(out)
        return found

    return query


def test_op1(run, rows):
    got = run("op1_embedding_dedup", "vec_id")
    want = brute.brute_vectors([(r["vec_id"], r["embedding"], r["label"]) for r in rows["embeddings"]], 0.93)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == want


def test_op2(run, rows):
    got = run("op2_decontaminate", "doc_id")
    docs = [(r["doc_id"], r["text"]) for r in rows["documents"]]
    for (i, _), (n, hit, items, bad) in zip(docs, brute.fast_hits(docs, [(r["item_id"], r["text"]) for r in rows["benchmark"]]), strict=True):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(items), sha(",".join(items)), bad)
        assert r["n_near_items"] >= len(items)
    assert any(r["contaminated"] for r in got.values()) and len(got) == len(docs)


def test_op3(run, rows):
    got, last = run("op3_warc_bundle", "page_id"), {}
    payloads = {r["page_id"]: (r["html"] or "").encode() for r in rows["pages"]}
    for i, b in payloads.items():
        last[b] = max(i, last.get(b, i))
    for i, b in payloads.items():
        first = len(b) < 1000 or last[b] == i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else last[b])
    assert len(got) == len(payloads)


def test_op4(run, rows):
    got = run("op4_language_id", "doc_id")
    known = {r["lang"] for r in rows["documents"] if r["lang"] is not None}
    right = []
    for r in rows["documents"]:
        x = got[r["doc_id"]]
        assert x["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= x["score"] <= 1
        if any(map(str.isalpha, r["text"] or "")):
            assert x["lang_pred"] in known
            if x["held_out"] and r["lang"]:
                right.append(x["lang_pred"] == r["lang"])
        else:
            assert x["lang_pred"] == "und"
    assert np.mean(right) > 0.97 and len(got) == len(rows["documents"])


def test_op5(run, rows):
    got = run("op5_pii", "doc_id")
    for r in rows["documents"]:
        t, x = r["text"] or "", got[r["doc_id"]]
        base = [(k, m.start(), m.end()) for k, p in brute.PLAIN.items() for m in re.finditer(p, t) if brute.TEST[k](m[0])]
        assert x["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [x[f"n_{k}"] for k in brute.PLAIN] == [sum(y[0] == k for y in base) for k in brute.PLAIN]
        every = spans_of(x["spans"])
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(every) and len(set(every)) == len(every)
    assert len(got) == len(rows["documents"])


def test_op6(run, rows):
    got = run("op6_line_dedup", "doc_id")
    docs = [(r["doc_id"], r["text"]) for r in rows["documents"]]
    for (i, _), (t, n, again, dropped) in zip(docs, brute.brute_lines(docs), strict=True):
        r = got[i]
        assert (r["n_lines"], r["n_recurring"], r["n_dropped"], r["text_sha256"]) == (n, again, dropped, sha(t or ""))
    assert any(r["n_dropped"] for r in got.values()) and len(got) == len(docs)


def test_op7(run, rows):
    import public_tokenizers
    import tiktoken
    from docketry.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    got = run("op7_byte_bpe", "doc_id")
    for r in rows["documents"]:
        ids, x = library.encode_ordinary(r["text"] or ""), got[r["doc_id"]]
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(r["text"] or ""))
    assert len(got) == len(rows["documents"])


SECRETS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", lambda m: len(m["v"]) >= 6),
    "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def test_op8(run, rows):
    got = run("op8_secret_scan", "doc_id")
    for r in rows["documents"]:
        t, x = r["text"] or "", got[r["doc_id"]]
        base = [(m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(SECRETS.items()) for m in re.finditer(p, t, re.ASCII) if ok(m)]
        assert x["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base)))
        assert [x[f"n_{k}"] for k in SECRETS] == [sum(y[2] == k for y in base) for k in SECRETS]
        assert {(k, str(a), str(b)) for a, _, k, b in base} <= set(spans_of(x["spans"]))
    assert len(got) == len(rows["documents"])


def test_op9_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in queries.QUERIES["op9_toxicity"](spark, sf).collect()}
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    labels = [(out[r["doc_id"]]["score"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None and r["doc_id"] in out and out[r["doc_id"]]["held_out"]]
    bad, good = ([s for s, y in labels if y == v] for v in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) > 0.8


def test_op10(run, rows):
    got = run("op10_minhash_dedup", "doc_id")
    want = brute.brute_near([(r["doc_id"], r["text"]) for r in rows["documents"]], 2, 80)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n, c, i == c) for i, (n, c) in want.items()}
