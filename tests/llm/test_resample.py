import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import CLASHING, SMALL, by_id, documents, edge_texts, pairs, sentence, small

from regimen.llm import arrays, queries, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, max_n):
    words = WORDS.findall((text or "").translate(LOWER))
    return [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, max_n=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, into in (([x for _, x in rows], s), (target, t)):
        for x in texts:
            for g in grams(x, max_n):
                into[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        found = grams(x, max_n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = [r for r in out if r[1] >= least]
    drawn = sorted(able, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[:percent * len(able) // 100]
    return out, [(r[0], r[3]) for r in drawn]


def test_crc32_of_spans():
    words = [b"", b"a", "é漢字".encode(), b"x" * 47, b"y" * 48, b"z" * 49, b"w" * 5000, b"the", b"the"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    assert resample.crc32_of(data, starts, ends).tolist() == [zlib.crc32(w) for w in words]
    assert resample.crc32_of(data, starts[:0], ends[:0]).tolist() == []


@pytest.mark.parametrize("max_n", [1, 3])
def test_features_of_edge_texts(max_n):
    texts = [x for _, x in edge_texts()] + ["UPPER Éa", "a-b_c1"]
    owner, bucket = resample.features(*arrays.buffer_of(pa.array(texts, pa.string())), max_n, 997)
    for k, x in enumerate(texts):
        assert sorted(bucket[owner == k].tolist()) == sorted(zlib.crc32(g.encode()) % 997 for g in grams(x, max_n))


def test_weighted_median_leaves_a_quarter_on_either_side():
    rng = random.Random(5)
    for _ in range(200):
        parts = [sorted(rng.sample(range(10_000), rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        parts = [[(x, k) for x in p] for k, p in enumerate(parts)]
        pivot = resample.weighted_median([(len(p), p[(len(p) - 1) // 2]) for p in parts])
        keys = sorted(x for p in parts for x in p)
        assert 4 * sum(x <= pivot for x in keys) >= len(keys) and 4 * sum(x >= pivot for x in keys) >= len(keys)


@pytest.mark.parametrize("k", [0, 1, 2, 77, 499, 500, 999, 1000])
def test_cutoff_is_exact(spark, k):
    rng = random.Random(k)
    keys = [(rng.randint(-3, 3), rng.randint(0, 5), rng.randint(0, 2), i) for i in range(1000)]
    df = spark.createDataFrame(keys, "__k0 long, __k1 long, __k2 long, __k3 long").repartition(7)
    got = resample.cutoff(df, 1000, k, finish=3)
    assert got == (sorted(keys)[k - 1] if k else None)


@pytest.mark.parametrize("max_n, percent", [(1, 10), (2, 50), (1, 0), (1, 100)])
def test_resampling_equals_brute_force(spark, max_n, percent):
    rows = edge_texts() + [(200 + k, sentence(k, 15 + k)) for k in range(40)]
    target = [sentence(k, 30) for k in range(5)] + [None, ""]
    docs = documents(spark, rows)
    got = resample.resample(docs, spark.createDataFrame([(x, "n") for x in target], "text string, score string"), percent=percent, max_n=max_n,
                            keep=["t", "lang"], finish=2)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "t", "lang", "rank"] and set(CLASHING) >= {"t"}
    got = got.collect()
    want, drawn = brute(rows, target, max_n, percent=percent)
    assert by_id([tuple(r)[:4] for r in got]) == by_id([tuple(r) for r in want])
    ranked = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r[1], r[2]) for r in ranked] == drawn


def test_repeated_rows_and_ties_get_ranks_of_their_own(spark):
    rows = [(7, sentence(1, 30))] * 40 + [(8, sentence(1, 30))] * 3
    got = resample.resample(documents(spark, rows), small(spark, "benchmark"), percent=50, finish=2).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 22))
    none = resample.resample(documents(spark, rows).where("false"), small(spark, "benchmark"))
    assert none.collect() == [] and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    empty = resample.resample(documents(spark, rows[-3:]), small(spark, "benchmark").where("false")).collect()
    assert len(empty) == 3 and all(r["rank"] is None for r in empty)            # floor(10 * 3 / 100) rows


def test_query_equals_brute_force(spark):
    got = queries.op11_importance_resampling(spark, SMALL).collect()
    want, drawn = brute(pairs(small(spark, "documents")), [r["text"] for r in small(spark, "benchmark").collect()])
    assert by_id([tuple(r)[:4] for r in got]) == by_id([tuple(r) for r in want])
    assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
