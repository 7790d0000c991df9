import hashlib
import re

import numpy as np
from corpus import by_id, documents, edge_texts, pairs, sentence, small

from regimen.llm import arrays, substrings


def brute(rows, length=20):
    done = {}
    seen = set()
    for i, x in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = [a for a in re.split("[\x20\x09-\x0D]+", x or "") if a]
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            k = tuple(w[s:s + length])
            if k in seen:
                gone[s:s + length] = [True] * length
            seen.add(k)
        kept = [a for a, g in zip(w, gone) if not g]
        done[i, x] = (i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return by_id([done[r] for r in rows])


COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def found(docs, **more):
    return by_id([tuple(r) for r in substrings.repeated_words(docs, **more).select(*COLUMNS).collect()])


def test_edges(spark):
    rows = edge_texts()
    assert found(documents(spark, rows)) == brute(rows)


def test_many_chunks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 2_000)
    monkeypatch.setattr(substrings, "BUCKET", 500)
    rows = edge_texts() + [(1000 - 3 * k, sentence(k % 20, 30 + k)) for k in range(60)]
    assert found(documents(spark, rows)) == brute(rows)


def test_whole_small_table(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 50_000)
    docs = small(spark, "documents")
    assert found(docs) == brute(pairs(docs))


def test_spans_and_text(spark):
    rows = [(1, sentence(1, 40)), (2, "a b " + sentence(1, 40) + " c"), (3, "x")]
    got = {r["doc_id"]: r for r in substrings.repeated_words(documents(spark, rows), with_text=True).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(2, 42)] and got[2]["text"] == "a b c" and got[1]["spans"] == [] and got[1]["text"] == rows[0][1]


def test_empty_table(spark):
    assert found(documents(spark, [])) == []


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (substrings.from_planes(substrings.planes(x)) == x).all() if n else len(substrings.planes(x)) == 0


def test_grams_tell_windows_apart():
    h = arrays.mix(np.arange(60, dtype=np.uint64) % np.uint64(7))
    for n in (1, 2, 3, 5, 7, 10, 20, 60, 61):
        g = arrays.grams(h, n)
        assert len(g) == max(0, 60 - n + 1)
        assert all((g[i] == g[j]) == (list(h[i:i + n]) == list(h[j:j + n])) for i in range(len(g)) for j in range(len(g)))
