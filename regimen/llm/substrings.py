"""Substring dedup by Rabin-Karp hashes of every window of ``length`` words, counted in Spark.

A word is a run of bytes other than ASCII white space. A word goes if it is covered by a window whose
words also start earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on
the input; removed windows that touch or overlap merge into maximal intervals.

Documents are dealt into chunks of neighbouring ids (bounds are quantiles of the ids, so chunks have
some ``CHUNK`` bytes whatever the ids look like). Then
1. every chunk hashes all its windows and sends its distinct hashes, sorted, cut by their leading bits
   into buckets, as byte planes of differences: one row per chunk and bucket, so a window that fills a
   third of the corpus is one entry per chunk;
2. every bucket merges the sorted lists and answers, per chunk, one bit per hash: whether an earlier
   chunk has it;
3. every chunk hashes its windows again and puts these bits and its own earlier windows together.
Hashes have 64 bits; two different windows share one with a chance of 2^-64 a pair.

Null and empty texts have no words. A null doc_id comes before all others. Rows that share a doc_id
are documents in the order of a hash of their text; wholly equal rows are one document and get the
same result each. Texts shorter than a window lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from regimen.llm import arrays
from regimen.llm.frames import text_key

#: bytes of text in a chunk, hashes in a bucket, and the most chunks (then they grow)
CHUNK, BUCKET, CHUNKS = 4 << 20, 2 << 20, 1 << 20


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, t, text, chunk) with chunks in the order of doc_id, and the bytes of all texts."""
    text = F.col("text").cast("string")
    docs = docs.select("doc_id", text_key(text).alias("t"), text.alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = min(CHUNKS, int(total) // CHUNK + 1)
    bounds = None
    if chunks > 1:
        shares = [k / chunks for k in range(1, chunks)]
        bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * chunks))).first()[0]
    cuts = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("long")
    def chunk_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "left"))

    first = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.withColumn("chunk", chunk_of(first) if len(cuts) else F.lit(0).cast("long")), int(total)


def _in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The distinct documents of a chunk in order, and for each row of ``table`` its document's number."""
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("t", "ascending")], null_placement="at_start").to_numpy()
    rows = table.take(pa.array(order))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        same = [pc.fill_null(pc.equal(rows["t"][1:], rows["t"][:-1]), True), pc.equal(rows["doc_id"][1:], rows["doc_id"][:-1])]
        both_null = pc.and_(pc.is_null(rows["doc_id"][1:]), pc.is_null(rows["doc_id"][:-1]))
        new[1:] = ~pc.and_(same[0], pc.or_(pc.fill_null(same[1], False), both_null)).to_numpy(zero_copy_only=False)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return rows.filter(pa.array(new)), number


def window_hashes(column: pa.ChunkedArray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word among all words) of every window, and the first word of each text and one past the last."""
    offsets, data = arrays.buffer_of(column)
    hashes, places, firsts, words_before = [], [], [np.zeros(1, np.int64)], 0
    for _, _, o, d in arrays.slices(offsets, data):
        starts, ends, first = arrays.word_bounds(o, d)
        word = arrays.span_hashes(arrays.prefix_sums(d), starts, ends)
        grams = arrays.grams(word, length)
        whole = np.maximum(np.diff(first) - length + 1, 0)
        at = arrays.gathered(first[:-1], whole)
        hashes.append(grams[at])
        places.append(at + words_before)
        firsts.append(first[1:] + words_before)
        words_before += len(word)
    return (np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate(firsts))


def planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers as differences, byte planes apart: the high planes are mostly zeros."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    bytes_ = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(bytes_.T).view("<u8").ravel(), dtype=np.uint64)


def _cuts(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the ``2 ** bits`` buckets begins in sorted hashes, and the end."""
    if bits == 0:
        return np.array([0, len(distinct)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(distinct, edges), [len(distinct)]))


def repeated_words(docs: DataFrame, length: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, t, n_words, n_removed, kept_sha256, spans (removed words, end exclusive) and, if asked
    for, text (the kept words joined by a space), per row of ``docs``."""
    docs, total = dealt(docs)
    bits = max(0, (total // 6 // BUCKET)).bit_length()
    sent = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary())])
    answered = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("earlier", pa.binary())])
    result = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("t", pa.int64()), ("n_words", pa.int64()),
                        ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                        ("spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), *([("text", pa.string())] if with_text else [])])

    def send(table: pa.Table) -> pa.Table:
        rows, _ = _in_order(table)
        distinct = np.unique(window_hashes(rows["text"], length)[0])
        cuts = _cuts(distinct, bits)
        full = np.flatnonzero(np.diff(cuts))
        return pa.table([pa.array(full, pa.int32()), pa.array([table["chunk"][0].as_py()] * len(full), pa.int64()),
                         pa.array([planes(distinct[cuts[b]:cuts[b + 1]]) for b in full], pa.binary())], schema=sent)

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        lists = [from_planes(x.as_py()) for x in table["hashes"]]
        hashes = np.concatenate(lists)
        order = np.argsort(hashes, kind="stable")
        later = np.zeros(len(hashes), bool)
        later[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
        ends = np.cumsum([len(x) for x in lists])
        bits_of = [later[e - len(x):e] for x, e in zip(lists, ends)]
        keep = [k for k, x in enumerate(bits_of) if x.any()]
        return pa.table([table["chunk"].take(pa.array(keep, pa.int64())).combine_chunks(), table["bucket"].take(pa.array(keep, pa.int64())).combine_chunks(),
                         pa.array([np.packbits(bits_of[k]).tobytes() for k in keep], pa.binary())], schema=answered)

    def cover(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return result.empty_table()
        rows, number = _in_order(table)
        hashes, places, first = window_hashes(rows["text"], length)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        gone = np.zeros(len(hashes), bool)
        gone[order[1:]] = same
        head = np.ones(len(hashes), bool)
        head[1:] = ~same
        distinct = hashes[order[head]]
        earlier, cuts = np.zeros(len(distinct), bool), _cuts(distinct, bits)
        for bucket, packed in zip(answers["bucket"].to_pylist(), answers["earlier"].to_pylist()):
            n = cuts[bucket + 1] - cuts[bucket]
            earlier[cuts[bucket]:cuts[bucket + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n)
        gone[order] |= earlier[np.cumsum(head) - 1]
        edge = np.zeros(int(first[-1]) + length + 1, np.int32)
        np.add.at(edge, places[gone], 1)
        np.add.at(edge, places[gone] + length, -1)
        covered = np.cumsum(edge[:int(first[-1])]) > 0
        texts = rows["text"].cast(pa.binary()).to_pylist()
        made = []
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            lost = covered[a:b]
            words = (texts[k] or b"").split()
            if lost.any():
                words = list(itertools.compress(words, (~lost).tolist()))
            kept = b" ".join(words)
            starts, ends = arrays.runs(lost)
            row = {"n_words": b - a, "n_removed": b - a - len(words), "kept_sha256": hashlib.sha256(kept).hexdigest(),
                   "spans": [{"from": s, "to": e} for s, e in zip(starts.tolist(), ends.tolist())]}
            made.append(row | ({"text": kept.decode()} if with_text else {}))
        picked = [made[k] for k in number.tolist()]
        return pa.table([table["doc_id"].combine_chunks(), table["t"].combine_chunks(),
                         *(pa.array([r[f.name] for r in picked], f.type) for f in list(result)[2:])], schema=result)

    hashes = docs.groupBy("chunk").applyInArrow(send, "bucket int, chunk long, hashes binary")
    answers = hashes.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, earlier binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(cover, f"doc_id {kind}, t long, n_words long, n_removed long, kept_sha256 string, "
                                 "spans array<struct<from:int,to:int>>" + ", text string" * with_text))
