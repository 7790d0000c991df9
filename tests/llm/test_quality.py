import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import documents, edge_texts, small

from regimen.llm import queries, quality
from corpus import SMALL


def test_statistics_of_edge_texts():
    texts = [x for _, x in edge_texts()]
    x = quality.statistics(pa.array(texts, pa.string()))
    assert x.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(x).all()
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(x, alone)                            # a text's neighbours don't matter
    at = quality.FEATURES.index
    assert x[texts.index("one"), at("distinct_words")] == 1 and x[texts.index(""), at("words")] == 0
    assert x[13, at("repeated_neighbours")] == pytest.approx(399 / 400)


def test_trees_separate_and_scores_match_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x, y, trees=30, depth=3)
    p = model.scores(x)
    assert ((p >= 0.5) == y).mean() > 0.97
    binned = model.binned(x[:50])
    for row in range(50):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(binned[row, model.feature[t, node]] > model.bin[t, node])
            total += model.value[t, node]
        assert 1 / (1 + np.exp(-total)) == pytest.approx(p[row])


def test_held_out_accuracy_and_columns(spark):
    got = queries.op4_quality_classifier(spark, SMALL)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    labels = {r["doc_id"]: r["quality"] for r in small(spark, "labels").collect()}
    assert len(rows) == small(spark, "documents").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i in labels if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) >= 0.8


def test_edges_and_clashing_columns(spark):
    docs = documents(spark, edge_texts())
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (4, 0, 0), (11, 1, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.count() == len(edge_texts()) and set(docs.columns) <= set(got.columns)
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    none = quality.classify(docs, labels.where("false"))
    assert {r["score"] for r in none.select("score").collect()} == {0.5}
    assert quality.classify(docs.where("false"), labels).collect() == []
