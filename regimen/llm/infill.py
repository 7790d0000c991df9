"""Fill-in-middle transformation with a wavelet matrix over character classes.

Every code point has a class: newline, other blank, sentence end (one of ``.!?`` before a blank or the end), word start,
both of these, or none. A wavelet matrix over the classes of a slice of texts answers rank (how many of a
class stand before a place) and select (where the k-th stands). Units end or begin at classes (``UNITS``), so the
number of units of a text is a sum of rank differences, and a cut after m units is a select where one class
bounds the unit, or a bisection on the summed ranks where several do. All texts of a slice are cut at once.

Units, matched left to right: ``line`` is ``[^\\n]*\\n|[^\\n]+``; ``sentence`` ends after a sentence end, ``clause`` after a sentence
end or a newline, with the rest of the text as the last one; ``word`` goes from one word start to the next, the first from
the text's start. White space is that of ASCII.

Prefix and middle end after h1 % (n + 1) and h2 % (n + 1) units, the smaller first, where h1..h4 are the first four 8-digit
groups of sha256(``seed:doc_id``). Outputs carry the sentinels ``<P>``, ``<S>`` and ``<M>``. A text that is empty, or holds a
sentinel, or is not chosen (h3) stays as it is (``plain``). ``restore`` rebuilds the text from output and form alone.

Defined results: a null text counts as empty, a null doc_id as an empty one in the hash. Rows that share a doc_id, or are
wholly equal, are transformed each; an empty table gives no rows. Other columns are kept, but for those whose
names the result uses. The arrays of a task are some 40 bytes a character of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from regimen.llm import arrays

SENTINELS = ("<P>", "<S>", "<M>")
WORD_START, SENTENCE_END, BLANK, NEWLINE = 1, 2, 4, 5           # 3 is a word start that ends a sentence
#: the classes that bound a unit, and whether a unit begins at them (else it ends after them)
UNITS = {"line": ((NEWLINE,), False), "sentence": ((SENTENCE_END, 3), False),
         "clause": ((SENTENCE_END, 3, NEWLINE), False), "word": ((WORD_START, 3), True)}

_SPACE = (1 - arrays.NOT_SPACE).astype(bool)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


class WaveletMatrix:
    """Rank and select over small symbols; queries are arrays."""

    def __init__(self, symbols: np.ndarray, bits: int = 3):
        self.n, self.bits = len(symbols), bits
        self.ones: list[np.ndarray] = []                        # by level: number of one bits before each place
        self.zeros: list[int] = []                              # by level: number of zero bits
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            ones = np.zeros(self.n + 1, np.int32 if self.n < 1 << 31 else np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def _down(self, symbol: int, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.bits))):
            ones = self.ones[k][at]
            at = self.zeros[k] + ones if symbol >> level & 1 else at - ones
        return at

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many ``symbol`` stand before each place of ``at``."""
        return (self._down(symbol, np.asarray(at, np.int64)) - self._down(symbol, np.zeros(1, np.int64))).astype(np.int64)

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """The place of the ``k``-th ``symbol`` (from 0; it has to exist)."""
        at = np.asarray(k, np.int64) + self._down(symbol, np.zeros(1, np.int64))
        for level in range(self.bits):
            ones = self.ones[self.bits - 1 - level]
            if symbol >> level & 1:
                at = np.searchsorted(ones, at - self.zeros[self.bits - 1 - level] + 1, "left") - 1
            else:                                               # the place with that many zero bits before it, by bisection
                low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
                while (low < high).any():
                    mid = (low + high) // 2
                    enough = mid + 1 - ones[np.minimum(mid + 1, self.n)] > at
                    high, low = np.where(enough, mid, high), np.where(enough | (low >= high), low, mid + 1)
                at = low
        return at


def classes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of every code point, offsets of the texts in code points)."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))[offsets]
    point = data[lead]
    n = len(point)
    space = _SPACE[point]
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)   # the first, and the last, of a text
    first[at[:-1]] = True
    last[at[1:] - 1] = True                                     # (an empty text marks a place that its neighbour marks, or the spare one)
    first, last = first[:n], last[:n]
    after_space = first.copy()
    after_space[1:] |= space[:-1]
    before_space = last.copy()
    before_space[:-1] |= space[1:]
    out = np.where(point == 0x0A, NEWLINE, np.where(space, BLANK, 0)).astype(np.uint8)
    out += (~space & after_space).astype(np.uint8) * WORD_START
    out += (_ENDS[point] & before_space).astype(np.uint8) * SENTENCE_END
    return out, at


class Units:
    """The units of the texts of one slice."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, unit: str):
        symbols, self.at = classes(offsets, data)
        self.bounds, self.begin = UNITS[unit]
        self.matrix = WaveletMatrix(symbols)
        self.size = np.diff(self.at)
        self.before = self._count(self.at[:-1])
        self.marks = self._count(self.at[1:]) - self.before     # bounds in each text
        last = np.full(len(self.size), -1)
        some = self.size > 0
        last[some] = symbols[self.at[1:][some] - 1]
        if self.begin:
            self.n = np.where(some, np.maximum(self.marks, 1), 0)
        else:
            self.n = self.marks + (some & ~np.isin(last, self.bounds))

    def _count(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, at) for c in self.bounds)

    def _place(self, k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the ``k``-th bound of the slice, which lies in [low, high)."""
        if len(self.bounds) == 1:
            return self.matrix.select(self.bounds[0], k)
        low, high = low.copy(), high.copy()
        while (low < high).any():
            mid = (low + high) // 2
            enough = self._count(np.minimum(mid + 1, self.matrix.n)) > k
            high, low = np.where(enough & (low < high), mid, high), np.where(enough | (low >= high), low, mid + 1)
        return low

    def end(self, units: np.ndarray) -> np.ndarray:
        """Where the first ``units`` units of each text end, in code points of the text."""
        out = np.where(units > 0, self.size, 0)
        inner = (units > 0) & ((units < self.n) if self.begin else (units <= self.marks))
        if inner.any():
            k = self.before[inner] + units[inner] - (0 if self.begin else 1)
            place = self._place(k, self.at[:-1][inner], self.at[1:][inner])
            out[inner] = place + (0 if self.begin else 1) - self.at[:-1][inner]
        return out


def _group(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def cuts(docs: DataFrame, unit: str = "line", seed: int = 7) -> DataFrame:
    """All columns of ``docs`` and ``__h`` (h1 to h4), ``n``, ``__low`` and ``__high``: the units of the text, and
    where the two cuts lie in code points."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    names = [c for c in docs.columns if c not in ("text", "n", "__h", "__low", "__high")]
    source = docs.select(*names, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                         F.array(*[_group(digest, k) for k in range(4)]).alias("__h"))
    kept = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = arrays.buffer_of(batch.column("text"))
            h = batch.column("__h").flatten().to_numpy().reshape(-1, 4)
            n, low, high = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b, o, d in arrays.slices(offsets, data):
                units = Units(o, d, unit)
                first, second = h[a:b, 0] % (units.n + 1), h[a:b, 1] % (units.n + 1)
                n[a:b], low[a:b], high[a:b] = units.n, units.end(np.minimum(first, second)), units.end(np.maximum(first, second))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, (n, low, high))],
                                             names=[*kept, "n", "__low", "__high"])

    fields = T.StructType(source.schema.fields[:]).add("n", "long").add("__low", "long").add("__high", "long")
    return source.mapInArrow(run, fields)


def transform(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """All columns of ``docs`` (text with null as empty) and ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.
    ``rate`` percent of the texts are transformed, ``spm`` percent of these with the suffix first."""
    out = cuts(docs.drop("form", "prefix_chars", "middle_chars", "output"), unit, seed)
    text, low, high = F.col("text"), F.col("__low").cast("int"), F.col("__high").cast("int")
    has_sentinel = F.lit(False)
    for s in SENTINELS:
        has_sentinel = has_sentinel | text.contains(s)
    plain = (text == "") | has_sentinel | (F.pmod(F.col("__h")[2], F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(F.col("__h")[3], F.lit(100)) < spm, "spm").otherwise("psm")
    prefix, middle, suffix = (F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low),
                              F.substring(text, high + 1, F.length(text)))
    p, s, m = map(F.lit, SENTINELS)
    output = (F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text))
    changed = F.col("form") != "plain"
    return (out.withColumn("form", form)
            .withColumn("prefix_chars", F.when(changed, F.col("__low")))
            .withColumn("middle_chars", F.when(changed, F.col("__high") - F.col("__low")))
            .withColumn("output", output).drop("__h", "__low", "__high"))


def restored(output: Column, form: Column) -> Column:
    """The exact text, from a transformed one and its form. (No sentinel can come about across a seam: each
    begins with the only ``<`` that it holds.)"""
    part = F.split(output, "|".join(SENTINELS), -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the restored text."""
    out = transform(docs.select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
