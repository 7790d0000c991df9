import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import documents, edge_texts, sentence

from regimen.llm import arrays, queries, toxicity

MIDDLE = "/root/testdata/sf0.01"


def brute_marginals(potential, begins):
    """By the sum over all taggings of each text."""
    out = []
    bounds = [*np.flatnonzero(begins).tolist(), len(begins)]
    for a, b in zip(bounds, bounds[1:]):
        total, toxic = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            w = np.prod([potential[a + k, tags[k - 1] if k else 0, t] for k, t in enumerate(tags)])
            total += w
            toxic += w * np.array(tags)
        out += (toxic / total).tolist()
    return out


def test_marginals_equal_the_sum_over_all_taggings():
    rng = np.random.default_rng(4)
    field = toxicity.Field()
    field.step, field.start = np.array([[0, -1.5], [0.3, 0.9]]), np.array([0, -0.7])
    for lengths in ([1], [2, 1, 5], [7, 3, 1, 1, 9], [10]):
        n = sum(lengths)
        begins = np.zeros(n, bool)
        begins[np.cumsum([0, *lengths])[:-1]] = True
        emission = rng.normal(0, 3, n)
        assert toxicity.marginals(field, emission, begins) == pytest.approx(brute_marginals(field.potentials(emission, begins), begins))
    assert len(toxicity.marginals(field, np.zeros(0), np.zeros(0, bool))) == 0
    extreme = toxicity.marginals(field, np.full(50_000, 30.0), np.arange(50_000) == 0)
    assert np.isfinite(extreme).all() and (extreme > 0.99).all()


def test_a_texts_tokens_do_not_depend_on_its_neighbours():
    texts = [x for _, x in edge_texts()]
    _, _, first, rows = toxicity.tokens(*arrays.buffer_of(pa.array(texts, pa.string())))
    for k, x in enumerate(texts):
        assert (toxicity.tokens(*arrays.buffer_of(pa.array([x], pa.string())))[3] == rows[first[k]:first[k + 1]]).all()


def test_the_field_learns_runs():
    rng = np.random.default_rng(6)
    rows = (rng.integers(0, 50, (6000, toxicity.ALL)) + 50 * np.arange(toxicity.ALL)).astype(np.int32)
    begins = np.arange(6000) % 12 == 0
    y = (rows[:, 0] < 5).astype(np.int64)
    y[1:] |= (y[:-1] & ~begins[1:] & (rows[1:, 0] < 20))                          # runs go on more easily than they begin
    field = toxicity.fit(rows, y, begins)
    p = toxicity.marginals(field, field.emission(rows), begins)
    assert ((p >= 0.5) == y).mean() > 0.95 and field.step[1, 1] > field.step[0, 1]


def corpus(spark):
    bad = ["vilewort", "Nastling"]
    rows = [(k, sentence(k, 25) + (f" {bad[k % 2]} é{bad[(k + 1) % 2]}." if k % 3 == 0 else "") + " " + sentence(1000 + k, 25)) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    return documents(spark, rows), labels, dict(rows)


def test_spans_mark_the_offending_words(spark):
    docs, labels, texts = corpus(spark)
    got = toxicity.tag(docs, labels)
    assert set(docs.columns) <= set(got.columns)
    others = 0
    for r in got.select("doc_id", "text", "score", "predicted", "n_toxic_spans", "toxic_spans").collect():
        assert r["predicted"] == int(r["doc_id"] % 3 == 0) == int(r["score"] >= 0.5)
        spans = [r["text"][int(a):int(b)] for a, b in (s.split(":") for s in r["toxic_spans"].split(",") if s)]
        assert len(spans) == r["n_toxic_spans"]
        hits = [x for x in spans if "vilewort" in x or "Nastling" in x]
        assert bool(hits) == (r["doc_id"] % 3 == 0)
        others += len(spans) - len(hits)
    assert others <= 6                                      # words that share a feature's row with an offending one


def test_held_out_accuracy(spark):
    got = queries.op12_toxicity(spark, MIDDLE)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "n_toxic_spans", "toxic_spans"]
    rows = {r["doc_id"]: r for r in got.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in labels if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) >= 0.9
    assert np.mean([rows[i]["predicted"] for i in held if labels[i]]) >= 0.6


def test_edges_and_clashing_columns(spark):
    docs = documents(spark, edge_texts())
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (4, 0), (11, 1), (None, 1), (999, 1), (17, 1), (6, 0), (5, 1)], "doc_id long, toxic int")
    got = toxicity.tag(docs, labels)
    assert got.count() == len(edge_texts()) and set(docs.columns) <= set(got.columns)
    assert got.where("score is null or score < 0 or score > 1 or toxic_spans is null").count() == 0
    assert {r["score"] for r in toxicity.tag(docs, labels.where("false")).select("score").collect()} == {0.5}
    one = toxicity.tag(docs, labels.where("toxic = 0")).select("score").distinct().collect()
    assert len(one) == 1 and one[0]["score"] < 0.5
    assert toxicity.tag(docs.where("false"), labels).collect() == []
