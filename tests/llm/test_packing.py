import collections
import zlib

import numpy as np
import public_tokenizers
from corpus import documents, edge_texts, pairs, small
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regimen.llm import packing
from regimen.llm.tokens import encoder

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True
ENCODE = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ids


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer():
    odd = ["", None, " ", "  ", " a", "a ", "a  b", "a \n b", "a\n \nb", "\n", "it's  we'll", "x y", "　漢字 é", "1 22  333", "!! ?", "a\tb c", "don't stop"]
    for text in odd + [x for _, x in edge_texts()]:
        assert np.frombuffer(ENCODE(text), "<u4").tolist() == ids_of(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1' \n\t.é漢 　 \x1c")), max_size=30))
def test_ids_of_any_white_space(text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == ids_of(text)


def test_added_tokens_are_those_of_the_tokenizer(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a b {end} c", end, end * 3, f"{end}a", f" {end} ", f"a  {end}\n {end}b ", f"don{end}'t <|endoftext|", f"<{end}>", "<|ENDOFTEXT|>"]
    got = {r["doc_id"]: r["ids"] for r in packing.sequences(documents(spark, list(enumerate(texts))), with_ids=True).collect()}
    for k, text in enumerate(texts):
        assert got[k] == [*plain.encode(text, add_special_tokens=False).ids, 2], text


def held(rows, got, capacity):
    """The pieces are those of every document, and sequences are gapless and within the capacity."""
    want = collections.Counter()
    for i, x in rows:
        ids = np.array([*ids_of(x), 2], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity)]
        for k, a in enumerate(cuts):
            b = first if k == 0 else a + capacity
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in got) // capacity)


def test_edges(spark):
    rows = edge_texts()
    used, least = held(rows, packing.sequences(documents(spark, rows)).collect(), 1024)
    assert used <= least * 1.05 + 2


def test_whole_small_table(spark):
    docs = small(spark, "documents")
    used, least = held(pairs(docs), packing.sequences(docs).collect(), 1024)
    assert used <= least * 1.03 + 2


def test_tree_of_many_partitions(spark):
    rows = [(k, "w " * (k * 37 % 90)) for k in range(400)]
    docs = documents(spark, rows).repartition(40)
    used, least = held(rows, packing.sequences(docs, capacity=64).collect(), 64)
    assert used <= least * 1.1 + 2


def test_residue_of_partitions_that_only_fit_each_other(spark):
    """Long pieces of one source meet the short ones of another, however many; the first partitions alone hold 20,400 long ones."""
    long, short = 20_400, 10_200
    docs = spark.createDataFrame([(k, "w" + " w" * (37 if k < long else 23)) for k in range(long + short)], "doc_id long, text string")
    docs = docs.repartitionByRange(12, "doc_id")
    got = packing.sequences(docs, capacity=64).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert sorted(r["n"] for r in got) == [39] * (long - short) + [64] * short


def test_plans_are_those_of_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = rng.integers(1, rng.integers(2, 66), rng.integers(1, 300))
        counts = collections.Counter(lengths.tolist())
        plan = packing.planned(counts, 64)
        fills = collections.Counter()
        places = collections.defaultdict(list)
        for n, first, each, sequence, base in plan.tolist():
            last = min([r[1] for r in plan.tolist() if r[0] == n and r[1] > first], default=counts[n])
            for i in range(last - first):
                fills[sequence + i // each] += n
                places[sequence + i // each].append((base + i % each * n, n))
        for own in places.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 64
        assert sum(fills.values()) == lengths.sum() and len(fills) == len(packing.best_fit(lengths, 64)[2])


def test_ids_on_request_and_empty_table(spark):
    got = packing.sequences(documents(spark, [(1, "hello world")]), with_ids=True).collect()
    assert got[0]["ids"] == [*ids_of("hello world"), 2]
    assert packing.sequences(documents(spark, [])).collect() == []


def test_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 65, rng.integers(1, 200))
        owner, offset, fill = packing.best_fit(lengths, 64)
        for b in range(len(fill)):
            own = owner == b
            order = np.argsort(offset[own])
            assert (np.cumsum(lengths[own][order]) - lengths[own][order] == offset[own][order]).all() and lengths[own].sum() == fill[b] <= 64
        assert len(fill) <= 1.3 * -(-lengths.sum() // 64) + 1
