"""Importance resampling towards a target distribution, by exact weighted median-of-medians selection.

A document's features are its runs of 1 to ``max_n`` consecutive words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
of the text with A-Z lower-cased), joined by one space, repeats counted. A feature's bucket is the crc32 of its
bytes modulo ``buckets``. The counts of all buckets over the whole corpus and the whole target give each
bucket a gain, floor(1000 ln of the smoothed ratio of the two shares). The rows are scored with arrays: ``weight`` is the sum
of a document's gains, ``score`` adds Gumbel noise that depends on (seed, doc_id) alone, so that the best scores
are a draw without replacement by weight.

The cutoff is found without a sort of all rows (``cutoff``): every partition of the stored keys tells the median and the number
of its keys in the open range; the median of these medians, weighted by the sizes, has at least a quarter of the
keys on either side of it, so a round discards a quarter at least, and goes on until the range holds the cutoff alone or
few enough keys (``finish``) to be looked at on the driver. Only the winners are sorted, by range partitions.

Defined results: a null or blank text has no feature, weight 0 and no rank. Rows that share a doc_id are
documents of their own; ties of the score go to the smaller doc_id (null last), then by the hash of the text; wholly equal
rows are interchangeable and get ranks of their own. An empty corpus gives no rows; an empty target counts 0 for every bucket.
Columns of ``docs`` other than doc_id and text are carried only if named in ``keep``, whatever their names. The
arrays of a task are some 60 bytes a byte of the longest text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regimen.llm import arrays
from regimen.llm.frames import shuffle_partitions, stored, text_key

#: the bytes of words: digits, letters, everything beyond ASCII
WORD = np.zeros(256, np.uint8)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: crc32's table, by its polynomial
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1)).astype(np.uint32)
#: spans up to this length are hashed together, byte by byte; longer ones one at a time
_TOGETHER = 48

KEY = ("__k0", "__k1", "__k2", "__k3")


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of every span of ``data``."""
    length = ends - starts
    clipped = np.minimum(length, _TOGETHER).astype(np.int8)
    order = np.argsort(-clipped, kind="stable")                 # longest first: the spans that go on are a prefix
    at, size = starts[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    active = np.searchsorted(-clipped[order], -np.arange(int(clipped.max(initial=0))).astype(np.int8), "left")
    for j, n in enumerate(active):
        c = crc[:n]
        crc[:n] = _CRC[(c ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _TOGETHER):
        crc[i] = zlib.crc32(data[at[i]:at[i] + size[i]])
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out


def features(offsets: np.ndarray, data: np.ndarray, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each feature, its bucket); the features of a text are together, not in the text's order."""
    data = _LOWER[data]
    starts, ends, first = arrays.word_bounds(offsets, data, WORD)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if max_n > 1:                                               # the words of a text, each followed by one space
        length = ends - starts
        new_ends = np.cumsum(length + 1) - 1
        joined = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
        joined[arrays.gathered(new_ends - length, length)] = data[arrays.gathered(starts, length)]
        data, starts, ends = joined, new_ends - length, new_ends
    owners, found = [owner], [crc32_of(data, starts, ends)]
    for n in range(2, max_n + 1):
        same = owner[n - 1:] == owner[:len(owner) - n + 1] if len(owner) >= n else np.zeros(0, bool)
        owners.append(owner[:len(same)][same])
        found.append(crc32_of(data, starts[:len(same)][same], ends[n - 1:][same]))
    return np.concatenate(owners), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, max_n: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows of ``texts``; a task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            offsets, data = arrays.buffer_of(batch.column("text"))
            for _, _, o, d in arrays.slices(offsets, data):
                total += np.bincount(features(o, d, max_n, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = (texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
               .groupBy("bucket").agg(F.sum("n").alias("n")).collect())                  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for row in counted:
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    buckets, of_corpus, of_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (of_corpus + buckets) / ((s + 1.0) * (of_target + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256(``seed:doc_id``); a null id is empty there."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: np.ndarray, max_n: int, seed: int, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_features, weight, score, a hash of the text and the columns of ``keep`` (as one struct) of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = arrays.buffer_of(batch.column("text"))
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for low, high, o, d in arrays.slices(offsets, data):
                owner, bucket = features(o, d, max_n, buckets)
                sums = np.concatenate(([0], np.cumsum(gain[bucket[np.argsort(owner, kind="stable")]])))
                ends = np.cumsum(np.bincount(owner, minlength=high - low))
                n[low:high] = np.diff(ends, prepend=0)
                weight[low:high] = np.diff(sums[ends], prepend=0)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n), pa.array(weight)],
                                             names=[*rest, "n_features", "weight"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), noise(F.col("doc_id"), seed).alias("__noise"),
                         text_key(F.col("text").cast("string")).alias("__text"), *([F.struct(*keep).alias("__keep")] if keep else []),
                         F.col("text").cast("string").alias("text"))
    fields = source.drop("text").schema.add("n_features", "long").add("weight", "long")
    return source.mapInArrow(run, fields).withColumn("score", F.col("weight") + F.col("__noise")).drop("__noise")


def _before(key: list[np.ndarray], pivot: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(keys before ``pivot``, keys equal to it), compared part by part."""
    before, equal = np.zeros(len(key[0]), bool), np.ones(len(key[0]), bool)
    for part, p in zip(key, pivot):
        before |= equal & (part < p)
        equal &= part == p
    return before, equal


def _median(key: list[np.ndarray], chosen: np.ndarray) -> tuple[int, list[int]]:
    """(number of the chosen keys, their lower median)."""
    parts = [p[chosen] for p in key]
    n = len(parts[0])
    at = np.lexsort(parts[::-1])[(n - 1) // 2] if n else None
    return n, [int(p[at]) for p in parts] if n else [0] * len(key)


def _round(keys: DataFrame, low: tuple | None, high: tuple | None, pivot: tuple | None) -> list[tuple]:
    """For every partition: number and median of its keys in the range before the pivot, and after it, and
    the number of keys that equal it. Without a pivot all keys count as after."""
    columns = list(KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in columns]
        for batch in batches:
            key = [batch.column(c).to_numpy() for c in columns]
            use = np.ones(batch.num_rows, bool)
            if low is not None:
                before, equal = _before(key, low)
                use &= ~(before | equal)
            if high is not None:
                use &= _before(key, high)[0]
            for part, k in zip(parts, key):
                part.append(k[use])
        key = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
        before, equal = _before(key, pivot) if pivot is not None else (np.zeros(len(key[0]), bool),) * 2
        n_before, m_before = _median(key, before)
        n_after, m_after = _median(key, ~(before | equal))
        if n_before or n_after or equal.any():
            row = [n_before, int(equal.sum()), n_after, m_before, m_after]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["b", "e", "a", "mb", "ma"])

    rows = keys.select(*columns).mapInArrow(run, "b long, e long, a long, mb array<long>, ma array<long>").collect()
    return [(r["b"], r["e"], r["a"], tuple(r["mb"]), tuple(r["ma"])) for r in rows]             # one row a partition


def weighted_median(medians: list[tuple[int, tuple]]) -> tuple:
    """The median of (size, key) pairs, weighted by the sizes."""
    medians = sorted(((m, n) for n, m in medians if n), key=lambda x: x[0])
    half, seen = sum(n for _, n in medians) / 2, 0
    for m, n in medians:
        seen += n
        if seen >= half:
            return m
    raise ValueError("no keys")


def in_range(low: tuple | None, high: tuple | None, with_high: bool = False) -> Column:
    """Whether the key columns lie after ``low`` and before ``high`` (or at it)."""
    key = F.struct(*[F.col(c) for c in KEY])
    as_key = lambda k: F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(KEY, k)])
    out = F.lit(True)
    if low is not None:
        out = out & (key > as_key(low))
    if high is not None:
        out = out & ((key <= as_key(high)) if with_high else (key < as_key(high)))
    return out


def cutoff(keys: DataFrame, total: int, k: int, finish: int = 10_000) -> tuple | None:
    """The ``k``-th smallest key of the ``total`` stored ``keys`` (all different), exactly; None if k is 0.
    Fewer than ``finish`` remaining keys are sorted on the driver. The remaining range is stored anew once it
    is an eighth of what is read, so all rounds together read little more than the first ones."""
    if k <= 0:
        return None
    low = high = pivot = None
    left, read = total, total
    rows = _round(keys, low, high, pivot)
    sizes = [(a, ma) for _, _, a, _, ma in rows]
    while left > finish:
        pivot = weighted_median(sizes)
        rows = _round(keys, low, high, pivot)
        before, equal = sum(r[0] for r in rows), sum(r[1] for r in rows)
        if k <= before:
            high, left, sizes = pivot, before, [(b, mb) for b, _, _, mb, _ in rows]
        elif k <= before + equal:
            return pivot
        else:
            low, left, k = pivot, left - before - equal, k - before - equal
            sizes = [(a, ma) for _, _, a, _, ma in rows]
        if left * 8 < read and left > finish:
            keys, read = stored(keys.where(in_range(low, high)).select(*KEY)), left
    rest = sorted(tuple(r) for r in keys.where(in_range(low, high)).select(*KEY).collect())     # at most ``finish``
    return rest[k - 1]


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank`` 1, 2, 3... by key: a range sort, and one offset a partition."""
    spark = winners.sparkSession
    at = F.monotonically_increasing_id()                        # partition and place in it
    placed = stored(winners.repartitionByRange(shuffle_partitions(spark), *KEY).sortWithinPartitions(*KEY).withColumn("__at", at))
    part = F.shiftright("__at", 33).cast("int")
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, seen = [], 0
    for p, n in sizes:                                          # one row a partition
        offsets.append((p, seen))
        seen += n
    table = spark.createDataFrame(offsets, "__p int, __before long")
    rank = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    return placed.withColumn("__p", part).join(F.broadcast(table), "__p").withColumn("rank", rank).drop("__p", "__before", "__at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, max_n: int = 1,
             buckets: int = 10_000, seed: int = 2024, keep: Sequence[str] = (), finish: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), and the columns of ``keep``
    as they are. Of the rows with at least ``least_words`` features, floor(``percent`` / 100) are drawn and ranked; rank
    is null for all others."""
    keep = [c for c in keep if c not in ("doc_id", "n_features", "weight", "score", "rank")]
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    greatest = F.lit((1 << 63) - 1).cast("long")
    rows = stored(scored(docs, gain, max_n, seed, keep)
                  .withColumn("__k0", -F.col("score")).withColumn("__k1", F.coalesce("doc_id", greatest))
                  .withColumn("__k2", F.col("__text")).withColumn("__k3", F.monotonically_increasing_id()).drop("__text"))
    able = F.col("n_features") >= least_words
    total = rows.where(able).count()
    last = cutoff(rows.where(able), total, percent * total // 100, finish)
    columns = ["doc_id", "n_features", "weight", "score", *(F.col("__keep")[c].alias(c) for c in keep)]
    no_rank = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select(*columns, no_rank)
    drawn = able & in_range(None, last, with_high=True)
    return ranked(rows.where(drawn)).select(*columns, F.col("rank").cast("long").alias("rank")).unionByName(rows.where(~drawn).select(*columns, no_rank))
