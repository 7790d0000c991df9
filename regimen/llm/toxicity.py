"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

Tokens are words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased). A token's features are the hashes of itself, its
first 3, 4, 5 and 6 bytes, its last 4 bytes and its two neighbours, each a row of one table of weights. The field has two states
(clean, toxic); its transitions and weights are fitted by the likelihood of labelled token windows.

Labels mark documents, so the tokens are labelled from them first: over all sampled documents, a feature's number of
toxic and of clean documents gives a likelihood ratio; tokens of a toxic document that hold a significant one
(``alpha`` over all features, ``precision`` of balanced classes) are toxic, or else those of its most telling feature; all tokens of
clean documents are clean. The field is fitted on windows around toxic tokens, around the same features in
clean documents, and at hashed places of clean documents.

Scoring: forward and backward vectors of all texts of a slice at once, as one chain that forgets its past at every
text's start, in blocks that are multiplied side by side. A document's score is a logistic function of its greatest
marginal and of its expected number of toxic tokens, fitted on the sample; runs of tokens with a marginal of at
least ``span`` are its toxic spans (code points, end exclusive).

The sample is bounded: ``max_rows`` labelled ids a class (smallest hash of the id) and ``max_windows`` windows of a kind. Scoring reads
every row and whole texts. Null and texts without a word have no token and the score of an empty text. A doc_id that several labels
disagree on counts with their mean (0.5 and more is 1); labels without a value, and documents without a label, train
nothing. If either class has no text, every score is the smoothed share of toxic labels. Repeated rows are scored each.
The arrays of a task are some 150 bytes a byte of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regimen.llm import arrays
from regimen.llm.frames import id_remainder, stored
from regimen.llm.resample import WORD, _LOWER

BITS = 18                                                       # of a feature's row in the table
OWN, ALL = 6, 8                                                 # features of the token alone, and with its neighbours
_REACH = 6                                                      # tokens on either side of a window's middle


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first token of each text and one past the last, features) of the tokens of a slice."""
    data = _LOWER[data]
    starts, ends, first = arrays.word_bounds(offsets, data, WORD)
    sums = arrays.prefix_sums(data)
    word = arrays.span_hashes(sums, starts, ends)
    spans = [word, *(arrays.span_hashes(sums, starts, np.minimum(ends, starts + k)) for k in (3, 4, 5, 6)),
             arrays.span_hashes(sums, np.maximum(starts, ends - 4), ends)]
    before, after = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[first[:-1][first[:-1] < len(word)]] = 0              # a text's neighbours are not its tokens'
    after[first[1:][first[1:] > 0] - 1] = 0
    rows = np.empty((len(word), ALL), np.int32)
    for k, h in enumerate([*spans, before, after]):
        rows[:, k] = (arrays.mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int32)
    return starts, ends, first, rows


class Field:
    """Weights of the toxic state against the clean one: a row for each feature, a bias, transitions and starts."""

    def __init__(self, bits: int = BITS):
        self.weight = np.zeros(1 << bits, np.float32)
        self.bias = 0.0
        self.step = np.zeros((2, 2))                            # of a state after a state; [0, 0] stays 0
        self.start = np.zeros(2)                                # of a text's first state; [0] stays 0

    def emission(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.bias, np.float64)
        for k in range(rows.shape[1]):
            out += self.weight[rows[:, k]]
        return np.clip(out, -30, 30)

    def potentials(self, emission: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """(token, state before, state): after a text's start the state before doesn't matter."""
        out = np.empty((len(emission), 2, 2))
        e = np.exp(emission)
        for i in range(2):
            for j in range(2):
                value = np.where(begins, np.exp(self.start[j]), np.exp(self.step[i, j]))
                out[:, i, j] = value * e if j else value
        return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 x 2 products along the first axis, scaled to a greatest entry of 1."""
    out = np.empty_like(a)
    for i in range(2):
        for j in range(2):
            out[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
    return out / out.max(axis=(1, 2), keepdims=True)


def _vectors(potential: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors (of the states up to each token) and backward vectors (of what follows it), each scaled."""
    n = len(potential)
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    padded = np.broadcast_to(np.eye(2), (blocks * size, 2, 2)).copy()
    padded[:n] = potential
    step = padded.reshape(blocks, size, 2, 2)
    whole = step[:, 0]
    for k in range(1, size):
        whole = _product(whole, step[:, k])
    into, out_of = np.empty((blocks, 2)), np.empty((blocks, 2))  # forward vector before, backward vector after each block
    a0, a1 = 0.5, 0.5
    products = whole.tolist()
    for b, ((p, q), (r, s)) in enumerate(products):
        into[b] = a0, a1
        a0, a1 = a0 * p + a1 * r, a0 * q + a1 * s
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    a0, a1 = 0.5, 0.5
    for b in reversed(range(blocks)):
        (p, q), (r, s) = products[b]
        out_of[b] = a0, a1
        a0, a1 = p * a0 + q * a1, r * a0 + s * a1
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    forward, backward = np.empty((blocks, size, 2)), np.empty((blocks, size, 2))
    for k in range(size):
        m = step[:, k]
        into = np.stack([into[:, 0] * m[:, 0, 0] + into[:, 1] * m[:, 1, 0], into[:, 0] * m[:, 0, 1] + into[:, 1] * m[:, 1, 1]], 1)
        into /= into.sum(axis=1, keepdims=True)
        forward[:, k] = into
        back = size - 1 - k
        backward[:, back] = out_of
        m = step[:, back]
        out_of = np.stack([m[:, 0, 0] * out_of[:, 0] + m[:, 0, 1] * out_of[:, 1], m[:, 1, 0] * out_of[:, 0] + m[:, 1, 1] * out_of[:, 1]], 1)
        out_of /= out_of.sum(axis=1, keepdims=True)
    return forward.reshape(-1, 2)[:n], backward.reshape(-1, 2)[:n]


def marginals(field: Field, emission: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Chance of the toxic state at each token, given its whole text."""
    if not len(emission):
        return np.zeros(0)
    forward, backward = _vectors(field.potentials(emission, begins))
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


def fit(rows: np.ndarray, y: np.ndarray, begins: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """The field that makes the token labels ``y`` likely (Adagrad over all windows, L2 ``decay`` on the weights)."""
    field = Field()
    n = len(y)
    if not n:
        return field
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    field.bias = float(np.log(share / (1 - share)))
    used = np.unique(rows)
    at = np.searchsorted(used, rows)
    inner = np.flatnonzero(~begins)
    told_step = np.zeros((2, 2))
    np.add.at(told_step, (y[inner - 1], y[inner]), 1)
    told_start = np.bincount(y[begins], minlength=2).astype(float)
    g_weight, g_bias, g_step, g_start = np.full(len(used), 1e-8), 1e-8, np.full((2, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(rounds):
        potential = field.potentials(field.emission(rows), begins)
        forward, backward = _vectors(potential)
        both = forward * backward
        p = both[:, 1] / both.sum(axis=1)
        pair = forward[inner - 1][:, :, None] * potential[inner] * backward[inner][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        wrong = y - p
        d = np.zeros(len(used))
        for k in range(rows.shape[1]):
            d += np.bincount(at[:, k], wrong, len(used))
        d -= decay * n ** 0.5 * field.weight[used]
        g_weight += d * d
        field.weight[used] += (rate * d / np.sqrt(g_weight)).astype(np.float32)
        d = wrong.sum()
        g_bias += d * d
        field.bias += rate * d / np.sqrt(g_bias)
        d = told_step - pair.sum(axis=0)
        d[0, 0] = 0
        g_step += d * d
        field.step += rate * d / np.sqrt(g_step)
        d = told_start - np.array([(1 - p[begins]).sum(), p[begins].sum()])
        d[0] = 0
        g_start += d * d
        field.start += rate * d / np.sqrt(g_start)
    return field


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def document_statistics(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(greatest marginal as log-odds, log of 1 + the expected number of toxic tokens beyond chance) of each text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    top = np.zeros(len(first) - 1)
    np.maximum.at(top, owner, p)
    likely = np.where(p >= 0.1, p, 0)
    return np.column_stack([_logit(top) / 6, np.log1p(np.bincount(owner, likely, len(first) - 1))])


def fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray, smooth: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic function (the constant first) by damped Newton steps; falling ones are set to 0."""
    x = np.column_stack([np.ones(len(x)), x])
    keep = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (y - p)) - smooth * w
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + smooth * np.eye(x.shape[1])
            step = np.zeros(x.shape[1])
            step[keep] = np.linalg.solve(hessian[np.ix_(keep, keep)], gradient[keep])
            w += np.clip(step, -2, 2)
        falling = (w < 0) & keep
        falling[0] = False
        if not falling.any():
            return w
        keep &= ~falling


class Model:
    def __init__(self, field: Field, score: np.ndarray):
        self.field, self.score = field, score

    def slice_scores(self, offsets: np.ndarray, data: np.ndarray, span: float) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(score, toxic spans, number of them) of each text of a slice."""
        starts, ends, first, rows = tokens(offsets, data)
        begins = np.zeros(len(starts), bool)
        begins[first[:-1][first[:-1] < len(starts)]] = True
        p = marginals(self.field, self.field.emission(rows), begins)
        x = document_statistics(p, first) @ self.score[1:] + self.score[0]
        toxic = p >= span
        found = [""] * (len(offsets) - 1)
        count = np.zeros(len(offsets) - 1, np.int64)
        if toxic.any():
            run = toxic & (begins | ~np.concatenate(([False], toxic[:-1])))
            close = toxic & np.concatenate((~toxic[1:] | begins[1:], [True]))
            lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            a, b = lead[starts[run]], lead[ends[close]]
            owner = np.searchsorted(first, np.flatnonzero(run), "right") - 1
            base = lead[offsets[owner]]
            count = np.bincount(owner, minlength=len(found))
            for t, s, e in zip(owner.tolist(), (a - base).tolist(), (b - base).tolist()):
                found[t] += f",{s}:{e}" if found[t] else f"{s}:{e}"
        return 1 / (1 + np.exp(-np.clip(x, -30, 30))), found, count


def feature_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Number of clean and of toxic documents that hold each row of the feature table; a task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            offsets, data = arrays.buffer_of(batch.column("text"))
            for low, high, o, d in arrays.slices(offsets, data):
                _, _, first, rows = tokens(o, d)
                owner = np.repeat(np.arange(high - low), np.diff(first))
                cell = np.unique((owner[:, None].astype(np.int64) << BITS) + rows[:, :OWN])
                of = y[low:high][cell >> BITS]
                for c in (0, 1):
                    total[c] += np.bincount(cell[of == c] & ((1 << BITS) - 1), minlength=1 << BITS)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["row", "c", "t"])

    counted = (sample.select("y", "text").mapInArrow(run, "row long, c long, t long")
               .groupBy("row").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).toPandas())    # at most 2^BITS rows
    clean, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    clean[counted["row"]], toxic[counted["row"]] = counted["c"], counted["t"]
    return clean, toxic


def telling(clean: np.ndarray, toxic: np.ndarray, n_clean: float, n_toxic: float, alpha: float, precision: float) -> tuple[np.ndarray, float]:
    """(likelihood ratio of each feature that leans to toxic documents, the least significant one)."""
    both, n = clean + toxic, n_clean + n_toxic
    log = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(b, 1e-9)), 0)
    ratio = 2 * (log(toxic, both * n_toxic / n) + log(clean, both * n_clean / n)
                 + log(n_toxic - toxic, (n - both) * n_toxic / n) + log(n_clean - clean, (n - both) * n_clean / n))
    of_toxic, of_clean = (toxic + 0.1) / (n_toxic + 1), (clean + 0.1) / (n_clean + 1)
    ratio[(toxic < 2) | (of_toxic < precision * (of_toxic + of_clean))] = 0
    return ratio.astype(np.float32), float(2 * np.log(max(2, (both > 0).sum()) / alpha))


def token_labels(rows: np.ndarray, first: np.ndarray, y: np.ndarray, ratio: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether a token holds a telling feature, whether its document's toxicity is explained)."""
    best = ratio[rows[:, :OWN]].max(axis=1) if len(rows) else np.zeros(0)
    owner = np.repeat(np.arange(len(y)), np.diff(first))
    top = np.zeros(len(y))
    np.maximum.at(top, owner, best)
    limit = np.where(top >= least, least, np.where(y == 1, np.maximum(top, 1e-6), least))
    return best >= limit[owner], (y == 0) | (top > 0)


def windows(sample: DataFrame, ratio: np.ndarray, least: float, max_windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, first tokens) of the training windows: at most ``max_windows`` of each of three kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            offsets, data = arrays.buffer_of(batch.column("text"))
            for low, high, o, d in arrays.slices(offsets, data):
                _, _, first, rows = tokens(o, d)
                told, explained = token_labels(rows, first, y[low:high], ratio, least)
                kinds, places, cells, labels = [], [], [], []
                for t in range(high - low):
                    a, b = int(first[t]), int(first[t + 1])
                    if a == b or not explained[t]:
                        continue
                    toxic = bool(y[low + t])
                    middle = np.flatnonzero(told[a:b])
                    picked = [(0 if toxic else 1, m) for m in middle[np.diff(middle, prepend=-2 * _REACH) > _REACH].tolist()]
                    if not toxic:
                        h = arrays.mix(rows[a:b, 0].astype(np.uint64) + np.arange(b - a, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        picked += [(2, m) for m in np.argsort(h, kind="stable")[:3].tolist()]
                    for kind, m in picked:
                        s, e = max(a, a + m - _REACH), min(b, a + m + _REACH + 1)
                        kinds.append(kind)
                        places.append(m)
                        cells.append(rows[s:e].astype("<i4").tobytes())
                        labels.append((told[s:e] & toxic).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(places, pa.int64()), pa.array(cells, pa.binary()),
                                                  pa.array(labels, pa.binary())], names=["kind", "m", "cells", "labels"])

    made = stored(sample.select("y", "text").mapInArrow(run, "kind int, m long, cells binary, labels binary"))
    found = []
    for kind in range(3):
        chosen = made.where(F.col("kind") == kind).orderBy(F.xxhash64("cells", "m"), "cells").limit(max_windows)
        found += [(r["cells"], r["labels"]) for r in chosen.select("cells", "labels").collect()]
    rows = np.concatenate([np.frombuffer(c, "<i4").reshape(-1, ALL) for c, _ in found]) if found else np.zeros((0, ALL), np.int32)
    y = np.frombuffer(b"".join(bytes(x) for _, x in found), np.uint8).astype(np.int64)
    begins = np.zeros(len(y), bool)
    begins[np.cumsum([0] + [len(x) for _, x in found])[:-1]] = True
    return rows, y, begins


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(y and text of the sampled labelled documents, number of labelled ids of each class)."""
    judged = (labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
              .where(F.col("toxic").isNotNull() & (id_remainder(F.col("doc_id"), 5) != 0))
              .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y")))
    counts = {r["y"]: r["n"] for r in judged.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        part = judged.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return stored(texts.join(F.broadcast(chosen), "doc_id").select("y", "text")), counts          # 2 max_rows ids


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, max_windows: int = 8_000, alpha: float = 0.05,
          precision: float = 0.9) -> Model:
    """Fits on the labelled documents whose id's remainder is not the held-out one."""
    sample, counts = training_rows(docs, labels, max_rows)
    sampled = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if not sampled.get(0) or not sampled.get(1):
        return Model(Field(), np.array([float(np.log(share / (1 - share))), 0, 0]))
    clean, toxic = feature_counts(sample)
    ratio, least = telling(clean, toxic, sampled[0], sampled[1], alpha, precision)
    field = fit(*windows(sample, ratio, least, max_windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = arrays.buffer_of(batch.column("text"))
            for low, high, o, d in arrays.slices(offsets, data):
                _, _, first, rows = tokens(o, d)
                begins = np.zeros(len(rows), bool)
                begins[first[:-1][first[:-1] < len(rows)]] = True
                x = document_statistics(marginals(field, field.emission(rows), begins), first)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(low, high - low), pa.array(x[:, 0]), pa.array(x[:, 1])],
                                                 names=["y", "top", "mass"])

    judged = sample.mapInArrow(run, "y int, top double, mass double").orderBy(F.xxhash64("top", "mass"), "y").limit(2 * max_rows).toPandas()
    y = judged["y"].to_numpy()
    weight = np.array([counts[c] / max(1, (y == c).sum()) for c in (0, 1)])[y]
    return Model(field, fit_score(judged[["top", "mass"]].to_numpy(), y, weight * len(y) / weight.sum()))


def tag(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, span: float = 0.5, **training) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` (1 from ``threshold`` on),
    ``n_toxic_spans`` and ``toxic_spans`` (``start:end`` joined by commas), which replace columns of these names."""
    model = train(docs, labels, **training)
    added = {"score": "double", "predicted": "integer", "n_toxic_spans": "long", "toxic_spans": "string"}
    names = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = arrays.buffer_of(batch.column("text"))
            score, found, count = np.zeros(batch.num_rows), [], np.zeros(batch.num_rows, np.int64)
            for low, high, o, d in arrays.slices(offsets, data):
                score[low:high], spans, count[low:high] = model.slice_scores(o, d, span)
                found += spans
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                                              pa.array(count), pa.array(found, pa.string())], names=[*names, *added])

    fields = docs.select(*names).schema
    for name, kind in added.items():
        fields = fields.add(name, kind)
    return docs.select(*names).mapInArrow(run, fields)
