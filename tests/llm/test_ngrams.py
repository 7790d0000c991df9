import collections
import re

import pytest
from corpus import by_id, documents, edge_texts, pairs, sentence, small

from regimen.llm import graph, ngrams


def brute(rows, threshold=0.8, n=5):
    """All pairs with a common shingle, by exact sets; ids are unique but for equal rows."""
    sets = {}
    for i, x in rows:
        w = [a for a in re.split("[\x20\x09-\x0D]+", x or "") if a]
        sets[i, x] = frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else None
    order = lambda k: (k[0] is not None, k[0] or 0)
    classes, own = {}, {}
    for k in sorted(sets, key=order):
        own[k] = classes.setdefault(sets[k], k) if sets[k] else k
    reps = [k for k in sets if own[k] == k and sets[k]]
    holders = collections.defaultdict(list)
    for r in reps:
        for g in sets[r]:
            holders[g].append(r)
    up, links = {k: k for k in sets}, collections.Counter()

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for r in reps:
        common = collections.Counter(q for g in sets[r] for q in holders[g] if order(q) > order(r))
        for q, c in common.items():
            if c >= threshold * (len(sets[r]) + len(sets[q]) - c) - 1e-9:
                links[r] += 1
                links[q] += 1
                a, b = sorted((root(r), root(q)), key=order)
                up[b] = a
    return by_id([(k[0], own[k][0], links[own[k]], root(own[k])[0], root(own[k]) == k) for k in rows])


COLUMNS = ["doc_id", "class_id", "n_links", "group_id", "kept"]


def joined(docs):
    return by_id([tuple(r) for r in ngrams.join(docs).select(*COLUMNS).collect()])


def test_edges(spark):
    rows = [r for r in edge_texts() if r != (None, None)]
    assert joined(documents(spark, rows)) == brute(rows)


def test_whole_small_table(spark):
    docs = small(spark, "documents")
    assert joined(docs) == brute(pairs(docs))


def test_large_group_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 8)
    base = sentence(1, 120).split()
    rows = [(k, " ".join(base[:10 + k] + [f"own{k}"] + base[11 + k:])) for k in range(40)] + [(100 + k, " ".join(base)) for k in range(5)]
    rows += [(200, sentence(2, 50))]
    assert joined(documents(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert joined(documents(spark, [])) == []


def test_dedup_keeps_one_of_each_group(spark):
    rows = edge_texts()
    docs = documents(spark, rows)
    got = ngrams.dedup(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(17) == 1 and ids.count(18) == 2 and 2 not in ids and 3 not in ids and 9 not in ids
    assert {5, 6, 7} <= set(ids) and ids.count(None) == 2


def test_bands_reach_the_recall():
    bands, rows = ngrams.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999 and bands * rows <= 80


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (-5, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, -5: -5, 200: -5, 201: -5}


@pytest.mark.parametrize("n", [1, 5])
def test_short_texts(spark, n):
    rows = [(1, "a b c"), (2, "a  b\tc"), (3, "a b c d e"), (4, "c b a")]
    got = {r["doc_id"]: r["class_id"] for r in ngrams.join(documents(spark, rows), n=n).collect()}
    assert got[2] == 1 and got[3] == 3 and got[4] == (1 if n == 1 else 4)
