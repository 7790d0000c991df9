"""Language identification by bit-sliced Bloom filters of character n-grams.

Texts are lower-cased; what isn't a letter counts as one blank. ``train`` counts the n-grams of each
language in Spark over a bounded sample of labelled rows (of each language the ``max_rows`` with the smallest hash of
their id, so a rare language keeps its rows however many the others have) and gives an n-gram to every language in which
it is frequent, at least ``share`` of its highest frequency in any. A frequency is the count over the language's n-grams
and ``prior`` more: every n-gram counts, those seen once too, but a few rows don't outweigh a language of many. The filters of all languages lie side by side: each cell holds one bit per
language, so the AND of an n-gram's cells is the set of all languages that hold it.

``predict`` reads every text whole, counts per language the n-grams whose set holds it, corrects the
share for the filter's false positives, and takes the largest; ties go to the language with more
labelled rows, then to the smaller name. The score is the corrected share (0 to 1).

Null texts and texts without a letter are ``und`` with score 0, as is everything if no row is labelled.
A text with letters but no known n-gram gets the most frequent language with score 0. Rows with a
null id, and rows of the held-out remainder, train nothing. Repeated rows count as often as they stand.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from regimen.llm import arrays
from regimen.llm.frames import id_remainder

GRAM, PROBES, CELLS = 4, 2, 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every n-gram that has a letter, first n-gram of each text and one past the last, whether it has a letter)."""
    padded = [" " + (t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) for t in padded])
    letter = _letters()[points]
    blank = ~letter
    keep = letter.copy()                              # one blank of each run stays
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[0:1] = True
    keep[ends[:-1]] = True                            # each text begins with its own blank
    before = np.concatenate(([0], np.cumsum(keep)))
    owner_ends = before[ends]
    symbol = np.where(letter, points, 32)[keep].astype(np.uint64)
    first = np.concatenate(([0], owner_ends))
    sizes = np.maximum(np.diff(first) - GRAM + 1, 0)
    at = arrays.gathered(first[:-1], sizes)
    hashes = np.zeros(max(0, len(symbol) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        hashes = hashes * np.uint64(0x100000001B3) + symbol[k:len(symbol) - GRAM + 1 + k] if len(hashes) else hashes
    has = np.add.reduceat(letter.astype(np.int64), np.concatenate(([0], ends[:-1]))) > 0 if len(texts) else np.zeros(0, bool)
    return arrays.mix(hashes[at]), np.concatenate(([0], np.cumsum(sizes))), has


class Filters:
    """``cells[c, w]``: 64 languages' bits of cell c; ``names`` in order of training rows."""

    def __init__(self, names: list[str], grams: list[np.ndarray]):
        self.names = names
        self.cells = np.zeros((CELLS, -(-len(names) // 64) or 1), np.uint64)
        for k, own in enumerate(grams):
            for place in self._places(own):
                np.bitwise_or.at(self.cells[:, k // 64], place, np.uint64(1) << np.uint64(k % 64))
        held = [((self.cells[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(names))]
        self.false = np.array(held) ** PROBES

    @staticmethod
    def _places(hashes: np.ndarray) -> list[np.ndarray]:
        return [(arrays.mix(hashes + np.uint64(p)) % np.uint64(CELLS)).astype(np.int64) for p in range(PROBES)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        hashes, first, has = gram_hashes(texts)
        total = np.maximum(np.diff(first), 1)
        held = functools.reduce(np.bitwise_and, (self.cells[p] for p in self._places(hashes)))
        shares = np.zeros((len(self.names), len(texts)))
        for k in range(len(self.names)):
            hit = np.concatenate(([0], np.cumsum((held[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)))).astype(np.int64)
            raw = (hit[first[1:]] - hit[first[:-1]]) / total
            shares[k] = np.clip((raw - self.false[k]) / (1 - self.false[k] + 1e-12), 0, 1)
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        best = shares.argmax(axis=0)
        names = [self.names[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())]
        return names, np.where(has, shares.max(axis=0), 0.0).tolist()


def _text_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str | None]]]:
    offsets, data = arrays.buffer_of(batch.column("text"))
    for a, b, _, _ in arrays.slices(offsets, data):
        yield a, b, batch.column("text").slice(a, b - a).to_pylist()


def sampled(docs: DataFrame, max_rows: int) -> tuple[DataFrame, dict[str, int]]:
    """((lang, text) of at most ``max_rows`` rows a language, number of labelled rows of each)."""
    usable = F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), 5) != 0)
    rows = docs.where(usable).select(F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").alias("text"),
                                     F.xxhash64("doc_id").alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}            # one row a language
    limits = docs.sparkSession.createDataFrame(list(sizes.items()), "lang string, n long")
    # about twice the rows wanted pass by their hash, before rows of one language meet
    passes = F.pmod("h", F.lit(1 << 40)) < F.ceil(2.0 * max_rows / F.col("n") * (1 << 40))
    few = rows.join(F.broadcast(limits), "lang").where(passes)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    return few.withColumn("place", place).where(F.col("place") <= max_rows).select("lang", "text"), sizes


def train(docs: DataFrame, max_rows: int = 5_000, most_grams: int = 50_000, share: float = 0.2, prior: int = 10_000) -> Filters:
    """Filters from at most ``max_rows`` labelled rows and ``most_grams`` n-grams a language."""
    sample, sizes = sampled(docs, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _text_slices(batch):
                langs = np.array(batch.column("lang").slice(a, b - a).to_pylist(), object)
                for lang in sorted(set(langs.tolist())):
                    grams, n = np.unique(gram_hashes([texts[i] for i in np.flatnonzero(langs == lang)])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / (F.col("total") + prior))       # one row a language
    peak = rates.groupBy("gram").agg(F.max("rate").alias("peak"))
    ranked = (rates.join(peak, "gram").where(F.col("rate") >= share * F.col("peak"))
              .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))).where(F.col("place") <= most_grams))
    found: dict[str, list[int]] = {}
    for row in ranked.select("lang", "gram").collect():        # at most most_grams a language
        found.setdefault(row["lang"], []).append(row["gram"])
    names = sorted(found, key=lambda x: (-sizes.get(x, 0), x))
    return Filters(names, [np.array(found[x], np.int64).view(np.uint64) for x in names])


def identify(docs: DataFrame, max_rows: int = 5_000) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, which replace columns of these names."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, max_rows))        # CELLS words a language word
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.value.predict(texts) for _, _, texts in _text_slices(batch)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for p in parts for x in p[0]], pa.string()), pa.array([x for p in parts for x in p[1]], pa.float64())],
                names=[*names, "lang_pred", "score"])

    rows = docs.select(*names)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields]).add("lang_pred", "string").add("score", "double"))
