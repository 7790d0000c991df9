import collections
import hashlib
import random

import numpy as np
from corpus import by_id, documents, edge_texts, pairs, small

from regimen.llm import suffixes


def brute(rows, length=200):
    texts = [(x or "").encode() for _, x in rows]
    count = collections.Counter(b[s:s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), len(b) - len(kept), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return by_id(out)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def found(docs, length=200):
    return by_id([tuple(r) for r in suffixes.dedup(docs, length).select(*COLUMNS).collect()])


def test_edges(spark):
    rows = [(i, x[:6000] if i == 16 else x[:3000] if i == 22 else x) if x else (i, x) for i, x in edge_texts()]
    assert found(documents(spark, rows)) == brute(rows)


def test_whole_small_table(spark):
    docs = small(spark, "documents")
    rows = pairs(docs)
    assert found(docs) == brute(rows)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 4_000)
    monkeypatch.setattr(suffixes.arrays, "SLICE", 4_000)
    rows = [r for r in edge_texts() if r[0] in (1, 2, 11, 12, 14)] + [(50, edge_texts()[15][1][:20_000]), (51, edge_texts()[15][1][9_000:15_000])]
    assert found(documents(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert found(documents(spark, [])) == []


def test_suffix_arrays_and_repeats():
    rng = random.Random(2)
    for trial in range(300):
        symbols = rng.choice([1, 2, 3, 5, 200])
        d = bytes(rng.randrange(symbols) + (50 if symbols < 200 else 0) for _ in range(rng.randint(1, 120)))
        if trial % 5 == 0:
            d = d[:max(1, len(d) // 4)] * 6
        a = np.frombuffer(d, np.uint8)
        assert suffixes.suffix_array(a).tolist() == sorted(range(len(d)), key=lambda i: d[i:])
        for length in (1, 2, 5, 8):
            count = collections.Counter(d[i:i + length] for i in range(len(d) - length + 1))
            want = [i + length <= len(d) and count[d[i:i + length]] > 1 for i in range(len(d))]
            assert suffixes.repeated_places(a, length).tolist() == (want if len(d) > length else [False] * len(d))
