"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` computes a fixed vector per text with numpy over byte buffers. ``fit`` grows
depth-wise trees on binned columns with the logistic loss. The model is flattened into four
arrays (feature, threshold bin, left child, leaf value); ``scores`` walks all rows of a batch
through all trees one level at a time, by array indexing only.

The trees are fitted on a bounded sample of labelled rows (``max_rows``, those with the smallest
hash of their id); scoring reads every row. Null and empty texts have the statistics of an empty
text and get the score that the trees give it. Texts of any length are read whole. A doc_id that
several labels disagree on counts with their mean (0.5 and more is 1); labels without a quality,
and documents without a label, train nothing. Without any usable label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regimen.llm import arrays
from regimen.llm.frames import id_remainder

FEATURES = ("bytes", "words", "lines", "word_bytes", "line_words", "letters", "upper", "digits", "non_ascii", "marks",
            "bars", "ends", "commas", "marked_words", "upper_words", "mixed_words", "number_words", "short_words",
            "long_words", "repeated_neighbours", "distinct_words", "distinct_pairs", "distinct_lines", "top_word",
            "longest_word", "longest_line", "same_tail")

_CLASS = np.zeros((8, 256), np.uint8)
_CLASS[0, list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1   # letters
_CLASS[1, 65:91] = 1                                                                # upper
_CLASS[2, 48:58] = 1                                                                # digits
_CLASS[3, 128:256] = 1                                                              # beyond ASCII
_CLASS[4, list(b"!\"#$%&*<=>@^_`{}~|\\[]+/")] = 1                                   # marks
_CLASS[5, list(b"|")] = 1
_CLASS[6, list(b".!?")] = 1
_CLASS[7, list(b",;:")] = 1


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return (sums[first[1:]] - sums[first[:-1]]).astype(np.float64)


def _distinct(hashes: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct entries, most copies of one entry) of each text."""
    distinct, top = np.zeros(rows), np.zeros(rows)
    if len(hashes):
        salted = arrays.mix(hashes + owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        _, at, counts = np.unique(salted, return_index=True, return_counts=True)
        np.add.at(distinct, owner[at], 1)
        np.maximum.at(top, owner[at], counts)
    return distinct, top


def _longest(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows)
    np.maximum.at(out, owner, ends - starts)
    return out


def _slice_statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    sums = arrays.prefix_sums(data)
    starts, ends, first = arrays.word_bounds(offsets, data)
    words = np.diff(first).astype(np.float64)
    owner = np.repeat(np.arange(rows), np.diff(first))
    word = arrays.span_hashes(sums, starts, ends)
    length = ends - starts

    not_line = np.ones(256, np.uint8)
    not_line[10] = 0
    line_starts, line_ends, line_first = arrays.word_bounds(offsets, data, not_line)
    lines = np.diff(line_first).astype(np.float64)
    line_owner = np.repeat(np.arange(rows), np.diff(line_first))
    line = arrays.span_hashes(sums, line_starts, line_ends)

    counts = [_per_text(_CLASS[k][data], offsets) for k in range(8)]
    in_word = [np.concatenate(([0], np.cumsum(_CLASS[k][data], dtype=np.int64))) for k in (0, 1, 2, 4)]
    letters, upper, digits, marks = (c[ends] - c[starts] for c in in_word)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    pairs = word[:-1] * np.uint64(3) + arrays.mix(word[1:]) if len(word) else word
    joined = owner[:-1] == owner[1:] if len(word) else np.zeros(0, bool)
    pair_owner = owner[:-1][joined] if len(word) else owner
    pairs = pairs[joined] if len(word) else pairs
    tail = np.zeros(len(word), bool)
    if len(word):
        last = data[ends - 1]
        tail[1:] = (last[1:] == last[:-1]) & (_CLASS[4][last[1:]] == 1) & (owner[1:] == owner[:-1])

    one = np.maximum(words, 1)
    distinct_words, top_word = _distinct(word, owner, rows)
    distinct_pairs, _ = _distinct(pairs, pair_owner, rows)
    distinct_lines, _ = _distinct(line, line_owner, rows)
    byte = np.maximum(size, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), _per_text(length, first) / one, words / np.maximum(lines, 1),
        *[c / byte for c in counts],
        _per_text(marks > 0, first) / one,
        _per_text((upper == letters) & (letters > 1), first) / one,
        _per_text((upper > 1) & (upper < letters), first) / one,
        _per_text(digits > 0, first) / one,
        _per_text(length <= 3, first) / one,
        _per_text(length >= 13, first) / one,
        _per_text(same, first) / one,
        distinct_words / one, distinct_pairs / np.maximum(words - 1, 1), distinct_lines / np.maximum(lines, 1),
        top_word / one,
        np.log1p(_longest(starts, ends, owner, rows)), np.log1p(_longest(line_starts, line_ends, line_owner, rows)),
        _per_text(tail, first) / one,
    ]).astype(np.float32)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    offsets, data = arrays.buffer_of(column)
    parts = [_slice_statistics(o, d) for _, _, o, d in arrays.slices(offsets, data)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


class Model:
    """Flattened trees. ``cuts[f]`` are the bin borders of feature f; node arrays have one row a tree."""

    def __init__(self, cuts: list[np.ndarray], base: float, feature: np.ndarray, bin_: np.ndarray, left: np.ndarray, value: np.ndarray):
        self.cuts, self.base = cuts, base
        self.feature, self.bin, self.left, self.value = feature, bin_, left, value

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(cuts, x[:, f], "left")
        return out

    def raw(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Sum of the leaf values: every row stands at a node of every tree, and all step down together."""
        trees, depth = len(self.feature), int(np.log2(self.feature.shape[1] + 1)) - 1 if len(self.feature) else 0
        out = np.full(len(x), self.base)
        tree = np.arange(trees)[None, :]
        for at in range(0, len(x) if trees else 0, rows):
            part = self.binned(x[at:at + rows])
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                right = part[row, self.feature[tree, node]] > self.bin[tree, node]
                node = self.left[tree, node] + right
            out[at:at + rows] += self.value[tree, node].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        smooth: float = 5.0, least: float = 5.0) -> Model:
    """Gradient-boosted trees on binned columns; complete trees of ``depth`` levels, where a node that
    isn't worth a split sends all rows left."""
    columns = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) if len(x) else
            np.zeros(0, np.float32) for f in range(columns)]
    nodes = 2 ** (depth + 1) - 1
    left = np.minimum(2 * np.arange(nodes) + 1, nodes - 1)
    if len(y) == 0 or y.min() == y.max():
        base = 0.0 if len(y) == 0 else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        none = np.zeros((0, nodes), np.int64)
        return Model(cuts, base, none, none, none, none.astype(float))
    mean = y.mean()
    model = Model(cuts, float(np.log(mean / (1 - mean))), None, None, None, None)
    binned = model.binned(x)
    flat = binned.astype(np.int64) + np.arange(columns) * bins
    raw = np.full(len(y), model.base)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, border, value = np.zeros(nodes, np.int64), np.full(nodes, bins, np.int64), np.zeros(nodes)
        for level in range(depth):
            low, width = 2 ** level - 1, 2 ** level
            cell = ((node - low)[:, None] * (columns * bins) + flat).ravel()
            g = np.bincount(cell, np.repeat(gradient, columns), width * columns * bins).reshape(width, columns, bins).cumsum(2)
            h = np.bincount(cell, np.repeat(weight, columns), width * columns * bins).reshape(width, columns, bins).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g * g / (h + smooth) + (g_all - g) ** 2 / (h_all - h + smooth) - g_all ** 2 / (h_all + smooth)
            gain[(h < least * 0.1) | (h_all - h < least * 0.1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            use = gain.reshape(width, -1).max(1) > 1e-6
            feature[low:low + width] = np.where(use, best // bins, 0)
            border[low:low + width] = np.where(use, best % bins, bins)
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > border[node])
        low = 2 ** depth - 1
        g = np.bincount(node - low, gradient, nodes - low)
        h = np.bincount(node - low, weight, nodes - low)
        value[low:] = rate * g / (h + smooth)
        raw += value[node]
        grown.append((feature, border, left, value))
    model.feature, model.bin, model.left, model.value = (np.stack(a) for a in zip(*grown))
    return model


def statistics_of(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``stats`` (array of float, by FEATURES) of each row of ``docs`` (text)."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            at = np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)
            stats = pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), stats], names=[*names, "stats"])

    source = docs.select(*names, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return source.mapInArrow(run, f"{fields}, stats array<float>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Fits on at most ``max_rows`` labelled documents whose id's remainder is not the held-out one."""
    chosen = (labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
              .where(F.col("quality").isNotNull() & (id_remainder(F.col("doc_id"), 4) != 2))
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("_y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = (statistics_of(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "_y")    # max_rows ids
            .orderBy(F.xxhash64("doc_id"), F.xxhash64("stats")).limit(max_rows).collect())
    x = np.array([r["stats"] for r in rows], np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["_y"] for r in rows], float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 20_000) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``
    (1 from ``threshold`` on), which replace columns of these names."""
    model = train(docs, labels, max_rows)
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[*names, "score", "predicted"])

    fields = docs.select(*names).schema
    return docs.select(*names).mapInArrow(run, fields.add("score", "double").add("predicted", "integer"))
