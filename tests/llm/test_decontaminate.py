import hashlib
import re

from corpus import by_id, documents, edge_texts, pairs, sentence, small

from regimen.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for i, x in items:
        q = words(x)
        size = min(10, len(q))
        for s in range(len(q) - size + 1 if q else 0):
            windows.setdefault(tuple(q[s:s + size]), set()).add(None if i is None else str(i))
    out = []
    for i, x in rows:
        w, hit, found = words(x), set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s:s + size]) in windows:
                    hit.update(range(s, s + size))
                    found |= windows[tuple(w[s:s + size])] - {None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return by_id(out)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def report(docs, items):
    return by_id([tuple(r) for r in decontaminate.report(docs, items).select(*COLUMNS).collect()])


def test_edges(spark):
    rows = edge_texts()
    a, b = rows[0][1].split(), rows[3][1].split()
    items = [(1, " ".join(a[10:35])), (2, " ".join(b[:9]).upper()), (3, "one"), (4, None), (5, ""), (5, "!!"), (6, "again " * 12), (7, "two words"),
             (8, " ".join(a[10:35])), (8, sentence(99, 30)), (None, " ".join(b[20:31])), (10, "漢字 é ü"), (11, " ".join(a[60:]) + ", " + sentence(98, 5))]
    assert report(documents(spark, rows), items_of(spark, items)) == brute(rows, items)


def test_whole_small_table(spark):
    docs, items = small(spark, "documents"), small(spark, "benchmark")
    planted = [(9000 + k, "Before. " + r["text"] + " After") for k, r in enumerate(items.collect())]
    rows = pairs(docs) + planted
    want = brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert report(documents(spark, rows), items) == want
    assert sum(r[5] for r in want) >= len(planted)


def test_items_of_common_words(spark):
    """Windows whose rarest words are frequent, at the start and the end of documents, many times in one."""
    rows = [(k, "a b c d e f g h i j k l " * 20) for k in range(5)] + [(9, "j k l a b c d e f g"), (10, "a b c d e f g h i"), (11, "a b c d e f g h i j")]
    items = [(1, "a b c d e f g h i j k"), (2, "l a b c d e f g h i"), (3, "a a a a a a a a a a a")]
    assert report(documents(spark, rows), items_of(spark, items)) == brute(rows, items)


def test_equal_rows_that_hold_an_item(spark):
    item, one = sentence(60, 12), "solitaire"
    rows = [(1, f"{sentence(61, 9)} {item} {one}")] * 2 + [(2, f"{item} end")] * 3 + [(3, one)] * 2 + [(None, item)] * 2 + [(4, item), (5, sentence(62, 9))]
    want = brute(rows, [(1, item), (2, one)])
    assert report(documents(spark, rows), items_of(spark, [(1, item), (2, one)])) == want and sum(r[5] for r in want) == 10
    assert [r["doc_id"] for r in decontaminate.clean(documents(spark, rows), items_of(spark, [(1, item), (2, one)])).collect()] == [5]


def test_proximity_without_a_phrase(spark):
    item = sentence(50, 20).split()
    apart = item[:10] + ["x", "y"] + item[10:]
    text = " ".join(w if k % 7 else "zz" for k, w in enumerate(apart))
    got = decontaminate.report(documents(spark, [(1, text), (2, sentence(51, 30))]), items_of(spark, [(5, " ".join(item))])).orderBy("doc_id").collect()
    assert [r["n_hit"] for r in got] == [0, 0] and got[0]["n_near_items"] == 1 and got[1]["n_near_items"] == 0


def test_empty_tables(spark):
    docs = documents(spark, edge_texts()[:4])
    assert {r["n_hit"] for r in decontaminate.report(docs, items_of(spark, [])).collect()} == {0}
    assert decontaminate.report(documents(spark, []), items_of(spark, [(1, "a")])).collect() == []


def test_clean_keeps_columns(spark):
    docs = documents(spark, edge_texts())
    got = decontaminate.clean(docs, items_of(spark, [(1, edge_texts()[3][1])]))
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert 4 not in ids and 13 not in ids and 1 in ids and 5 in ids and ids.count(17) == 2
