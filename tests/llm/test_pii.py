import hashlib
import re

from corpus import by_id, documents, edge_texts, pairs, sentence, small

from regimen.llm import pii


def base(x):
    """The four patterns as they are written, with their checks."""
    x = x or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


HARD = ["a@b.c", "a@b", "@x.y", "x@@y.z", "a@b.c@d.e", "a.b+c%d@e-f.g.h.", "é@a.bc", "a@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0001.2.3.0255", "1.2.3",
        "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "41111111111111112222", "5 5", "+1 (925) 555-2751", "+1", "+12345678", "+123456789",
        "+1234567890123456", "++15551234567+15551234567", "+1 2 3 4 5 6 7 8 9 0)", "x+1-555-010-9999y", "漢字 a@b.cc 漢", "a@b.c" * 5, "1" * 40, "1.1.1.1@a.b", "a@1.1.1.1", None, ""]


def test_base_spans_are_those_of_the_patterns():
    for text in HARD + [x for _, x in edge_texts()]:
        assert pii.base_spans(text or "") == base(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_whole_small_table(spark):
    docs = small(spark, "documents")
    rows = pairs(docs) + [(9000 + k, t) for k, t in enumerate(HARD)]
    got = {r["doc_id"]: r for r in pii.report(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        spans = base(x)
        r = got[i]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and (r["spans"] + ",").startswith(joined and joined + ",")


def test_contexts_reach_over_any_distance():
    """The nearest five terms count, whatever stands between, and however long they are."""
    far = " 1234567890 |||| " * 40
    text = f"six five four three two one{far}kim@corp.example.com{far}un deux trois quatre cinq six"
    got = [text[a:b] for _, _, a, b in pii.contexts(text, pii.base_spans(text), 5)]
    assert got == "five four three two one un deux trois quatre cinq".split()
    run = "漢字" * 400
    text = f"{run} +1 925 555 2751 {run}。 one@two.example.com last"
    assert [text[a:b] for e, _, a, b in pii.contexts(text, [s for s in pii.base_spans(text) if s[0] == "phone"], 1)] == [run, f"{run}。"]


def corpus_of_disclosure():
    """``zorblax`` stands by one address in four documents and nowhere else; ``common`` stands everywhere."""
    rows = [(k, f"{sentence(k, 8)} common Zorblax wrote to kim@corp.example.com common {sentence(50 + k, 8)}") for k in range(4)]
    return rows + [(100 + k, f"{sentence(200 + k, 12)} common wrote to") for k in range(30)] + [(200, f"common call +1 925 555 2751 once {sentence(300, 5)}")]


def test_terms_that_disclose_are_added(spark):
    rows = corpus_of_disclosure()
    got = {r["doc_id"]: r for r in pii.report(documents(spark, rows)).collect()}
    for i, x in rows[:4]:
        at = x.index("Zorblax")
        assert f"removed:{at}:{at + 7}" in got[i]["spans"].split(",") and got[i]["n_email"] == 1
        assert not any(s.endswith(f":{x.index('common')}:{x.index('common') + 6}") for s in got[i]["spans"].split(","))
    assert all(got[i]["spans"] == "" for i, _ in rows[4:34]) and got[200]["n_removed"] == got[200]["n_generalised"] == 0


def test_degrees_are_those_of_the_counts(spark):
    rows = corpus_of_disclosure()
    docs = documents(spark, rows)
    found = pii.scanned(docs)
    got = {(r["entity"], r["term"]): r["degree"] for r in pii.disclosures(docs, found, 3, 0.0).collect()}
    import math
    words = {i: set(w.lower() for w in re.findall("[A-Za-z]+", x)) for i, x in rows}
    holders = {}
    for i, x in rows:
        for e, t, a, b in pii.contexts(x, pii.base_spans(x), 5):
            holders.setdefault((e, t, x[a:b].lower()), set()).add(i)
    entities = {}
    for (e, _, _), ids in holders.items():
        entities.setdefault(e, set()).update(ids)
    want = {}
    for (e, t, w), ids in holders.items():
        if len(ids) >= 3:
            n_t = sum(w in ws for ws in words.values())
            n = len(rows)
            degree = math.log2(n * len(ids) / (len(entities[e]) * n_t)) / math.log2(n / len(entities[e]))
            if degree >= 0:
                want[e, t] = degree
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want


def test_entities_of_one_or_two_documents(spark):
    """A rare term by an entity of one or two documents is added, a common one is not."""
    rows = [(1, "common Zorblax wrote to kim@corp.example.com common"), (2, "common Quuxly call +1 925 555 2751 common"), (3, "common Quuxly call +1 925 555 2751 common")]
    rows += [(100 + k, f"{sentence(200 + k, 4)} common wrote to call") for k in range(300)]
    got = {r["doc_id"]: r for r in pii.report(documents(spark, rows)).collect()}
    for i, x in rows[:3]:
        at = x.index("Zorblax" if i == 1 else "Quuxly")
        added = [s for s in got[i]["spans"].split(",") if s.startswith(("generalised", "removed"))]
        assert added == [f"generalised:{at}:{at + (7 if i == 1 else 6)}"]
    assert all(got[i]["spans"] == "" for i, _ in rows[3:])


def test_wholly_equal_rows_count_once(spark):
    rows = [(1, "common Zorblax wrote to kim@corp.example.com common")] + [(100 + k, f"{sentence(200 + k, 4)} common wrote to call") for k in range(300)]
    once = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    assert "generalised" in once[1]
    for copies in (2, 10):
        for repeated in (rows[0], rows[5]):
            got = [(r["doc_id"], r["spans"]) for r in pii.report(documents(spark, rows + [repeated] * (copies - 1))).collect()]
            assert len(got) == len(rows) + copies - 1 and set(got) == set(once.items())


def test_sanitise_and_edges(spark):
    docs = documents(spark, edge_texts() + corpus_of_disclosure())
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert "kim@corp" not in texts[0] or "[EMAIL]" in texts[0]
    assert texts[200].startswith("common call [PHONE] once") and texts[5] is None
    assert pii.report(documents(spark, [])).collect() == []
    assert by_id([(r["doc_id"], r["n_email"]) for r in pii.report(documents(spark, edge_texts())).collect()]) == by_id([(i, 0) for i, _ in edge_texts()])
