import hashlib

import pytest
from corpus import by_id, documents, edge_texts, pairs, small

from regimen.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, least=8):
    """Every pair of distinct lines, word by word."""
    key = lambda i, x: (i is not None, i or 0, x)
    first, places = {}, []
    for i, x in sorted({r for r in rows if r[1] is not None}, key=lambda r: key(*r)):
        for no, line in enumerate(x.split("\n")):
            words = tuple(line.split(" "))
            if line.strip(BLANK):
                first.setdefault(words, (key(i, x), no))
                places.append((key(i, x), no, words))
    distinct = list(first)

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < least:
            return False
        head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        tail = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
        return head + tail >= max(len(a), len(b)) - 1

    by_length = {}
    for w in distinct:
        by_length.setdefault(len(w), []).append(w)
    earlier = {w: any(first[v] < first[w] and near(v, w) for n in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(n, ()))
               for w in distinct}
    gone, close = {}, {}
    for k, no, words in places:
        if first[words] < (k, no):
            gone.setdefault(k, []).append(no)
        elif earlier[words]:
            gone.setdefault(k, []).append(no)
            close[k] = close.get(k, 0) + 1
    out = []
    for i, x in rows:
        k = key(i, x)
        lost = gone.get(k, [])
        out.append((i, 0 if x is None else x.count("\n") + 1, len(lost), close.get(k, 0), hashlib.sha256(",".join(map(str, lost)).encode()).hexdigest()))
    return by_id(out)


def test_edges(spark):
    rows = edge_texts()
    got = [tuple(r) for r in lines.report(documents(spark, rows)).collect()]
    assert by_id(got) == brute(rows)


def test_whole_small_table(spark):
    docs = small(spark, "documents")
    got = [tuple(r) for r in lines.report(docs).collect()]
    assert by_id(got) == brute(pairs(docs))
    assert sum(r[3] for r in got) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_many_near_lines_of_one(spark, seed):
    """A hot template: one word differs everywhere, also at the ends, put in and left out."""
    words = [f"w{seed}{k}" for k in range(12)]
    texts = [" ".join(words[:k] + [f"new{j}"] + words[k + 1:]) for j, k in enumerate([0, 3, 3, 3, 11, 6])]
    texts += [" ".join(words[:k] + words[k + 1:]) for k in (0, 5, 11)] + [" ".join(words[:k] + ["in"] + words[k:]) for k in (0, 6, 12)] + [" ".join(words)]
    rows = [((k * 7) % 31, x) for k, x in enumerate(texts)]
    got = [tuple(r) for r in lines.report(documents(spark, rows)).collect()]
    assert by_id(got) == brute(rows)


def test_empty_table(spark):
    assert lines.report(documents(spark, [])).collect() == []


def test_dedup_keeps_columns_and_drops_emptied(spark):
    docs = documents(spark, edge_texts())
    got = lines.dedup(docs, drop_emptied=True)
    assert got.columns == docs.columns
    kept = {(r["doc_id"], r["h"]): r["text"] for r in got.collect()}
    assert 2 not in {i for i, _ in kept} and 5 in {i for i, _ in kept} and 6 in {i for i, _ in kept}
    assert all(r["text"] == kept[(r["doc_id"], r["h"])] for r in docs.where("doc_id in (1, 4, 8, 16)").collect())
