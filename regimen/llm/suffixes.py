"""Suffix-array dedup: removes bytes of every ``length``-byte string that also starts elsewhere.

Texts are UTF-8 bytes; matches never cross documents; all copies of a repeated string go, overlaps
included, judged on the input. The work is dealt into shards by content:

1. The ``length``-byte strings of a document are cut into segments, runs of strings that share the
   place of their least hashed ``GRAM``-byte gram (their anchor). Equal strings have equal anchors.
2. Anchors that occur once in the corpus are counted out: strings of their segments cannot repeat.
   The rest pass a bitmap of fixed size and then an exact join.
3. Equal segments are counted as one; a segment that occurs twice or more is repeated as a whole.
4. Distinct segments are dealt into shards by anchor. A shard's suffix array is made by induced
   sorting: suffixes are classified, leftmost-smaller substrings are sorted by inducing and named, the
   order of their suffixes (found by doubling the names' ranks, which numpy can do for a large
   alphabet) is induced to all suffixes. Permuted common prefixes follow, computed for irreducible
   places and carried on to the others. Neighbours with a prefix of ``length`` are repeated strings.
5. The repeated strings of each document come together as byte spans, and are cut out.

A very frequent segment is one row after counting, and its places are joined by a key that Spark can
split; a shard holds distinct segments only. Null and empty texts, and texts shorter than ``length``,
lose nothing. Rows that share a doc_id, or are wholly equal, are documents of their own, so wholly
equal rows of ``length`` bytes or more remove each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from regimen.llm import arrays
from regimen.llm.frames import bitmap_of, maybe_in, shuffle_partitions, stored, text_key

GRAM = 32
#: a text is cut into pieces of so many bytes (which overlap by a string less one byte), a shard has about so many
PIECE, SHARD = 1 << 22, 1 << 18
_PLACE = np.uint64((1 << 23) - 1)
_SEPARATOR = 0xFF                                   # never a byte of UTF-8


# ---- suffix arrays -------------------------------------------------------------------------------

def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S type); the last place holds the only 0."""
    edge = np.flatnonzero(s[1:] != s[:-1])               # last places of runs, but for the last run
    up = np.concatenate((s[edge] < s[edge + 1], [True]))
    return np.repeat(up, np.diff(np.concatenate(([-1], edge, [len(s) - 1]))))


def _spread(places: np.ndarray, s: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Appends ``places`` to the buckets of their symbols, in order."""
    if len(places) == 0:
        return
    symbol = s[places]
    order = np.argsort(symbol, kind="stable")
    places, symbol = places[order], symbol[order]
    cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    for part, c in zip(np.split(places, cuts), symbol[np.concatenate(([0], cuts))].tolist()):
        buckets[c].append(part)


def _induce(s: np.ndarray, small: np.ndarray, order: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes but the last symbol's in order, induced from ``order``, the order of the leftmost-smaller ones."""
    lms: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _spread(order, s, lms)

    def sweep(range_, kind: bool, seeds) -> list[list[np.ndarray]]:
        made: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        for c in range_:
            done = 0
            while done < len(made[c]):                    # a wave: what the bucket has got since the last one
                wave = np.concatenate(made[c][done:])
                done = len(made[c])
                before = wave[wave > 0] - 1
                _spread(before[small[before] == kind], s, made)
            for seed in seeds(c):
                before = seed[seed > 0] - 1
                _spread(before[small[before] == kind], s, made)
        return made

    larger = sweep(range(symbols), False, lambda c: lms[c])
    # from the right: buckets are filled from their ends, so everything is kept reversed
    smaller = sweep(range(symbols - 1, -1, -1), True, lambda c: [x[::-1] for x in reversed(larger[c])])
    out = [np.zeros(0, np.int64)]
    for c in range(symbols):
        out += larger[c]
        out += [x[::-1] for x in reversed(smaller[c])]
    return np.concatenate(out)


def _ranked(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling."""
    rank = names.astype(np.int64)
    step, n = 1, len(names)
    while True:
        follow = np.zeros(n, np.int64)
        follow[:max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of bytes."""
    s = np.concatenate((data.astype(np.int16) + 1, [0])).astype(np.int16)
    small = _smaller(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    symbols = int(s.max()) + 1
    if len(lms) > 1:
        placed = _induce(s, small, np.concatenate(([len(s) - 1], lms[lms != len(s) - 1])), symbols)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        order = np.concatenate(([len(s) - 1], placed[is_lms[placed]]))
        ends = np.minimum(np.append(lms[1:], len(s) - 1) + 1, len(s))
        sums = arrays.prefix_sums((s & 0xFF).astype(np.uint8))      # 256 meets 0, which only the end has
        by_place = np.zeros(len(s), np.uint64)
        by_place[lms] = arrays.span_hashes(sums, lms, ends) + (ends - lms).astype(np.uint64)
        name = np.zeros(len(s), np.int64)
        name[order[1:]] = np.cumsum(by_place[order[1:]] != by_place[order[:-1]])
        lms = lms[_ranked(name[lms])]
    return _induce(s, small, lms if len(lms) else np.array([len(s) - 1]), symbols)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(PLCP, PHI): the common prefix of each suffix with the one before it in ``order``, right up to ``most``.
    Prefixes are cut at twice that; every ``most``-th place is computed anew, so that a cut one carries far enough."""
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    has = phi >= 0
    before, other = np.arange(n) - 1, phi - 1
    reducible = has & (before >= 0) & (other >= 0)
    reducible &= data[np.maximum(before, 0)] == data[np.maximum(other, 0)]
    reducible[::most] = False
    at = np.flatnonzero(has & ~reducible)
    sums = arrays.prefix_sums(data)
    length = np.zeros(len(at), np.int64)
    step = 1 << most.bit_length()
    while step:
        left, right = at + length, phi[at] + length
        inside = np.flatnonzero(np.maximum(left, right) + step <= n)
        same = arrays.span_hashes(sums, left[inside], left[inside] + step) == arrays.span_hashes(sums, right[inside], right[inside] + step)
        length[inside[same]] += step
        step >>= 1
    reach = np.zeros(n, np.int64)
    reach[at] = length + at
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0), phi


def repeated_places(data: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each place also start at another place."""
    out = np.zeros(len(data), bool)
    if len(data) > length:
        prefix, phi = common_prefixes(data, suffix_array(data), length)
        found = np.flatnonzero((prefix >= length) & (phi >= 0))
        out[found] = True
        out[phi[found]] = True
    return out


# ---- segments ------------------------------------------------------------------------------------

def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values: heads and tails of blocks, met in the middle."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - width + 1], head[width - 1:n])


def segments(offsets: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first string, last string, anchor hash, segment hash) of all segments of a slice; strings count from
    the start of the slice."""
    width = length - GRAM + 1
    strings = np.maximum(np.diff(offsets) - length + 1, 0)
    start = arrays.gathered(offsets[:-1], strings)
    if len(start) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = arrays.prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = arrays.span_hashes(sums, at, at + GRAM)
    least = _least((gram & ~_PLACE) | at.astype(np.uint64), width)[start]
    anchor = (least & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(strings)), strings)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi = start[first], start[last]
    whole = arrays.mix(arrays.span_hashes(sums, lo, hi + length) + (hi - lo).astype(np.uint64))
    return text[first], lo, hi, gram[anchor[first]], whole


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each text, its place in the row's text, offsets, bytes) of slices; long texts come in overlapping pieces."""
    offsets, data = arrays.buffer_of(column)
    for row, end, o, d in arrays.slices(offsets, data):
        if len(d) <= PIECE:
            yield np.arange(row, end), np.zeros(end - row, np.int64), o, d
        else:                                       # one long text
            for at in range(0, len(d) - length + 1, PIECE - length + 1):
                part = d[at:at + PIECE]
                yield np.array([row]), np.array([at]), np.array([0, len(part)]), part


def _segment_rows(docs: DataFrame, length: int, columns: tuple[str, ...]) -> DataFrame:
    """Segments of all texts: anchor, whole (hash), and of doc_id, t, lo, hi, bytes those in ``columns``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, base, o, d in _pieces(batch.column("text"), length):
                text, lo, hi, anchor, whole = segments(o, d, length)
                out = {"anchor": pa.array(anchor.view(np.int64)), "whole": pa.array(whole.view(np.int64))}
                at = pa.array(rows[text])
                shift = (base - o[:-1])[text]
                if "lo" in columns:
                    out |= {"doc_id": batch.column("doc_id").take(at), "t": batch.column("t").take(at), "lo": pa.array(lo + shift), "hi": pa.array(hi + shift)}
                if "bytes" in columns:
                    sizes = hi + length - lo
                    ends = np.concatenate(([0], np.cumsum(sizes)))
                    flat = d[arrays.gathered(lo, sizes)]
                    out["bytes"] = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    text = F.col("text").cast("string")
    wanted = ["doc_id", text_key(text).alias("t")] if "lo" in columns else []
    source = docs.select(*wanted, text.alias("text"))
    fields = "anchor long, whole long"
    if "lo" in columns:
        fields += f", doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, lo long, hi long"
    return source.mapInArrow(run, fields + ", bytes binary" * ("bytes" in columns))


def _shard(length: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        """(anchor, whole, spans) of the repeated strings of the segments of a shard."""
        frame = frame.sort_values(["anchor", "whole"], ignore_index=True)
        parts = [np.frombuffer(x, np.uint8) for x in frame["bytes"]]
        sizes = np.array([len(x) + 1 for x in parts])
        data = np.full(sizes.sum(), _SEPARATOR, np.uint8)
        begin = np.cumsum(sizes) - sizes
        data[arrays.gathered(begin, sizes - 1)] = np.concatenate(parts)
        inside = np.zeros(len(data), bool)                   # strings that end before their segment's separator
        inside[arrays.gathered(begin, sizes - length)] = True
        found = repeated_places(data, length) & inside
        starts, ends = arrays.runs(found)
        owner = np.searchsorted(begin, starts, "right") - 1
        return pd.DataFrame({"anchor": frame["anchor"].to_numpy()[owner], "whole": frame["whole"].to_numpy()[owner],
                             "low": starts - begin[owner], "high": ends - begin[owner]})
    return search


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, t, spans): byte spans (from, to) of each text that strings of ``length`` bytes found elsewhere cover; spans may overlap."""
    spark = docs.sparkSession
    anchors = _segment_rows(docs, length, ()).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    bitmap = bitmap_of(stored(anchors), "anchor")
    distinct = stored(maybe_in(_segment_rows(docs, length, ("bytes",)), "anchor", bitmap).groupBy("anchor", "whole")
                      .agg(F.count("*").alias("n"), F.first("bytes").alias("bytes")))
    several = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    volume = distinct.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), int(volume) // SHARD)
    searched = (distinct.join(several, "anchor", "left_semi").select("anchor", "whole", "bytes").withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts))).groupBy("part")
                .applyInPandas(_shard(length), "anchor long, whole long, low long, high long"))
    # a segment that occurs once more is repeated as a whole, whatever its shard finds
    lists = distinct.where("n > 1").select("anchor", "whole", F.lit(0).cast("long").alias("low"), (F.length("bytes") - (length - 1)).cast("long").alias("high"))
    lists = lists.unionByName(searched.join(distinct.where("n = 1").select("anchor", "whole"), ["anchor", "whole"]))
    found = (maybe_in(_segment_rows(docs, length, ("lo",)), "anchor", bitmap).join(lists, ["anchor", "whole"])
             .select("doc_id", "t", F.struct((F.col("lo") + F.col("low")).alias("from"), (F.col("lo") + F.col("high") + (length - 1)).alias("to")).alias("span")))
    return found.groupBy("doc_id", "t").agg(F.collect_list("span").alias("spans"))


def dedup(docs: DataFrame, length: int = 200, with_text: bool = False) -> DataFrame:
    """doc_id, t, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes), per row of ``docs``."""
    spans = repeated_spans(docs, length).withColumnsRenamed({"doc_id": "__d", "t": "__t"})
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text_key(text).alias("t"), text.alias("text"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("t") == F.col("__t")), "left").select("doc_id", "t", "text", "spans")
    schema = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("t", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            offsets, data = arrays.buffer_of(batch.column("text"))
            for k, spans in enumerate(batch.column("spans")):
                raw = data[offsets[k]:offsets[k + 1]]
                n_spans, kept = 0, raw
                if spans.is_valid:
                    edge = np.zeros(len(raw) + 1, np.int32)
                    flat = spans.values.flatten()
                    np.add.at(edge, flat[0].to_numpy(), 1)
                    np.add.at(edge, flat[1].to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_spans, kept = len(arrays.runs(gone)[0]), raw[~gone]
                kept = kept.tobytes()
                out.append((len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept)[:4 + with_text])
            columns = list(zip(*out)) or [[]] * (4 + with_text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:]))], schema=schema)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, t long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
