import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from corpus import SMALL, by_id, documents, edge_texts, pairs, small
from pyspark.sql import functions as F

from regimen.llm import arrays, infill, queries

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"(?s:.*?[.!?](?=[\x20\x09-\x0D]|\Z)|.+)", "clause": r"(?s:.*?(?:[.!?](?=[\x20\x09-\x0D]|\Z)|\n)|.+)"}
EDGES = ["", "\n", "\n\n\n", "a", "a\n", "\na", "a\nb", "a\n\nb\n", "é\n漢字\n", " ", "  x  y ", "One. Two! Three", "End.", ". . .", "a.b c.\nd", "\r\n x\ty\n"]


def units(text, unit):
    if unit == "word":
        starts = [m.start() for m in re.finditer(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", text)]
        bounds = [0, *starts[1:], len(text)]
        return [text[a:b] for a, b in zip(bounds, bounds[1:])] if text else []
    return [x for x in re.findall(PATTERNS[unit], text) if x]


def test_wavelet_rank_and_select():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 17, 400):
        symbols = rng.integers(0, 6, n).astype(np.uint8)
        matrix = infill.WaveletMatrix(symbols)
        for c in range(8):
            assert matrix.rank(c, np.arange(n + 1)).tolist() == [int((symbols[:i] == c).sum()) for i in range(n + 1)]
            there = np.flatnonzero(symbols == c)
            assert matrix.select(c, np.arange(len(there))).tolist() == there.tolist()


@pytest.mark.parametrize("unit", list(infill.UNITS))
def test_units_end_where_a_plain_scan_ends(unit):
    rng = random.Random(3)
    texts = EDGES + ["".join(rng.choice("ab.! \n漢") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    got = infill.Units(*arrays.buffer_of(pa.array(texts)), unit)
    want = [units(x, unit) for x in texts]
    assert got.n.tolist() == [len(u) for u in want]
    for m in range(0, max(map(len, want)) + 1):
        ends = got.end(np.minimum(m, got.n))
        assert ends.tolist() == [len("".join(u[:m])) for u in want]


def brute(i, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    u = units(text, unit)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(u)
    if not text or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit, rate", [("line", 100), ("word", 60), ("clause", 100)])
def test_transform_and_restore(spark, unit, rate):
    rows = edge_texts() + [(500 + k, x) for k, x in enumerate(EDGES * 3)] + [(600, "has <S> inside\n"), (601, "ends with <\n<"), (602, "<P\n<\nP>\n<M")]
    docs = documents(spark, rows)
    out = infill.transform(docs, unit, rate=rate).withColumn("again", infill.restored(F.col("output"), F.col("form")))
    assert set(docs.columns) - {"n", "text"} <= set(out.columns)
    got = out.select("doc_id", F.col("n"), "form", "prefix_chars", "middle_chars", "output", "again", "text").collect()
    assert by_id([tuple(r)[:6] for r in got]) == by_id([brute(i, x, unit, rate=rate) for i, x in rows])
    assert all(r["again"] == r["text"] for r in got) and {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert infill.transform(docs.where("false")).collect() == []


def test_query_equals_brute_force(spark):
    got = queries.op13_fill_in_middle(spark, SMALL)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(*(b := brute(i, x))[:5], sha(b[5]), sha(x or "")) for i, x in pairs(small(spark, "documents"))]
    assert by_id([tuple(r) for r in got.collect()]) == by_id(want)
