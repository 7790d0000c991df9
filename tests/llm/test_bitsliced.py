import math
from fractions import Fraction

import numpy as np
import pytest
from corpus import small
from pyspark.sql import functions as F

from regimen.llm import bitsliced


def brute(rows, every=50, k=5):
    kept = sorted({(i, tuple(math.floor(256 * Fraction(float(x))) for x in v)) for i, v in rows
                   if i is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = set()
    for i, q in kept:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j, min(max(-s, -2 ** 63), 2 ** 63 - 1)) for r, (s, j) in enumerate(scored)}
    return sorted(out)


def found(vectors, every=50):
    return sorted(tuple(r) for r in bitsliced.top_k(vectors, F.pmod("id", F.lit(every)) == 0).collect())


def test_whole_small_table(spark):
    vectors = small(spark, "embeddings")
    assert found(vectors) == brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()])


def test_edges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "ROWS", 40)
    monkeypatch.setattr(bitsliced, "QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=5).round(2).tolist()) for k in range(120)]
    rows += [(200 + k, rows[7][1]) for k in range(60)]                                   # one very common vector
    rows += [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0]), (550, [float("nan")] * 5), (551, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
             (None, [1.0] * 5), (600, [0.5, 0.5]), (601, [0.25, -1.0]), (650, [3.0]), (700, [0.0] * 5), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    assert found(table, 10) == brute(rows, 10)


def test_components_of_any_finite_size(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "ROWS", 20)
    monkeypatch.setattr(bitsliced, "WIDE_ROWS", 3)
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(40)]
    for k, big in enumerate([1e30, -1e30, 1e30, 5000.25, -4096.0, 1e17, 1.7e308, -1.7e308, 2.0 ** 53 + 2, 12345.678]):
        rows.append((50 + k, [*rng.normal(size=2).tolist(), big, 0.5]))
    rows += [(60, [0.0, 0.0, 1e30, 0.0]), (60, [0.0, 0.0, 1e30, 0.0]), (61, [1e300, 1e300, 1e300, 1e300]), (70, [1e20])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(table, 10) == brute(rows, 10)
    only = table.where("vec_id >= 50 and vec_id < 60")
    assert found(only, 10) == brute([r for r in rows if 50 <= r[0] < 60], 10)


def test_keys_follow_the_scores():
    scores = [0, 1, -1, 255, 256, -255, -256, 2 ** 63, -2 ** 63, 10 ** 40, -10 ** 40, 10 ** 600, 3 * 10 ** 40]
    assert sorted(scores, key=bitsliced.sort_key) == sorted(scores, reverse=True)


def test_no_queries_and_empty_table(spark):
    table = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert found(table) == [] and found(table.where("false")) == []


@pytest.mark.parametrize("seed", range(5))
def test_slices_add_up(seed):
    rng = np.random.default_rng(seed)
    values, query = rng.integers(-300, 300, (130, 9)), rng.integers(-300, 300, 9)
    least, maps, _ = bitsliced.slices_of(values)
    slices, constant = bitsliced.score_slices(query, least, maps)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) if s is not None else 0 for s in slices]
    assert (sum(b << w for w, b in enumerate(bits)) + constant == values @ query).all()
