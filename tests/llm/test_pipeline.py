"""The pipeline's stages on a planted corpus, against brute force: decisions take effect, clean documents stay."""

import collections
import random

import corpus_pipeline
import pytest
import test_operators as brute
from docketry.llm import language_id
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def planted(spark, sf_dir, tmp_path_factory):
    """A folder of tables, the planted rows, and each stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    r = random.Random(9)
    vocabulary = [w for w in docs.where("lang = 'en'").first()["text"].split() if w.isalpha()]
    line = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "er", "ly"]) for _ in range(n))
    clean, passage = [line(80) for _ in range(6)], line(60)
    near = clean[0].split()
    near[3:5] = ["changed", "twice"]
    near.insert(20, "added")  # another token count: not the same template
    copy = clean[1].split()
    copy.insert(40, "copied")
    rows = [(10_000 + k, t) for k, t in enumerate(clean)] + [(20_000, " ".join(near)), (20_001, f"{passage}\n{line(40)}"), (20_002, f"{line(40)}\n{passage}"), (20_003, bench.first()["text"]), (20_004, "%%% 123 !!"), (20_005, None), (20_006, " ".join(copy))]
    again = f"{line(50)}\n{line(30)}"
    rows += [(30_000, again)] * 3 + [(30_001, line(70)), (30_001, line(70)), (None, line(60))]
    new = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    root = tmp_path_factory.mktemp("pipeline")
    docs.unionByName(new).coalesce(2).write.parquet(str(root / "sf/documents.parquet"))
    bench.write.parquet(str(root / "sf/benchmark.parquet"))
    now, found = spark.read.parquet(str(root / "sf/documents.parquet")), {}
    found["documents"] = now.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(root / "sf"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(root / name))
        now = spark.read.parquet(str(root / name))
        found[name] = now.collect()
    return str(root / "sf"), rows, found


def ids(rows):
    return {x["doc_id"] for x in rows}


def test_planted_documents(spark, planted):
    folder, rows, found = planted
    kept = {name: {x["doc_id"]: x for x in rows} for name, rows in found.items()}
    assert {i for i, _ in rows} - set(kept["language"]) == {20_004, 20_005}
    passage = rows[7][1].split("\n")[0]
    assert passage in kept["lines"][20_001]["text"] and passage not in kept["lines"][20_002]["text"]
    assert 20_006 in kept["lines"] and 20_006 not in kept["near_duplicates"]
    assert 20_003 not in kept["benchmark"]
    assert all(10_000 + k in kept["tokens"] for k in range(6))
    stays = collections.Counter(x["doc_id"] for x in found["near_duplicates"])
    assert stays[30_000] == 1 and stays[30_001] == 2 and stays[None] == 1
    whole = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter(x["doc_id"] for x in whole) == collections.Counter(x["doc_id"] for x in found["tokens"])


def test_language_stage_is_its_operator(spark, planted):
    folder, _, found = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = language_id.identify(docs).where(~F.col("rejected")).select(*docs.columns).collect()
    assert collections.Counter(good) == collections.Counter(found["language"])


def test_lines_stage_against_brute_force(planted):
    _, _, found = planted
    rows = [(x["doc_id"], x["text"]) for x in found["language"]]
    want = [(i, t) for (i, _), (t, _, _, dropped) in zip(rows, brute.brute_lines(rows), strict=True) if not dropped or t.strip(" ")]
    assert collections.Counter(want) == collections.Counter((x["doc_id"], x["text"]) for x in found["lines"])
    assert all(x["n_chars"] == len(x["text"]) for x in found["lines"])


def test_near_duplicates_stage_against_brute_force(planted):
    _, _, found = planted
    rows = collections.Counter((x["doc_id"], x["text"]) for x in found["lines"])
    named = {k: t for k, (i, t) in enumerate(rows)}
    of = {k: i for k, (i, _) in enumerate(rows)}
    near = brute.brute_near(list(named.items()), 5, 80)
    groups = collections.defaultdict(set)  # ids that share a group, by way of texts or of ids
    for k, (_, c) in near.items():
        if of[k] is not None:
            groups[c].add(of[k])
    least = {i: i for g in groups.values() for i in g}
    for _ in range(10):
        for g in groups.values():
            m = min(least[i] for i in g)
            for i in g:
                least[i] = min(least[i], m)
    want = {(i, t) for i, t in rows if i is None or least[i] == i}
    got = collections.Counter((x["doc_id"], x["text"]) for x in found["near_duplicates"])
    assert set(got) == want and set(got.values()) == {1}


def test_benchmark_stage_against_brute_force(spark, planted):
    folder, _, found = planted
    rows = [(x["doc_id"], x["text"]) for x in found["near_duplicates"]]
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = brute.fast_hits(rows, items)
    assert collections.Counter(x for x, h in zip(rows, hits, strict=True) if not h[3]) == collections.Counter((x["doc_id"], x["text"]) for x in found["benchmark"])


def test_tokens_stage_passes_all(planted):
    _, _, found = planted
    assert collections.Counter(x["doc_id"] for x in found["benchmark"]) == collections.Counter(x["doc_id"] for x in found["tokens"])


def test_empty_tables(spark, planted, tmp_path):
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
