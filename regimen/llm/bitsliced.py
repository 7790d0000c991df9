"""Exact top-k search by inner product over a bit-sliced index.

``index`` quantises every vector to integers, deals rows into blocks by a hash of their id and stores,
per block, the least value and one bitmap per dimension and bit (64 rows a word). For a query, each
dimension's slices, complemented where the weight is negative, are added with bitmap arithmetic:
bitmaps of one weight go through full adders (sum: xor, carry: majority) until one is left per
weight, which are the slices of all rows' scores. The best rows are taken from the most significant
slice downward; rows that are equal in all slices are resolved by their id.

Blocks of queries meet blocks of rows, each pair in a unit of bounded size. The bitmaps are shuffled once for every
``QUERIES`` queries, the queries (a small share of that) once for every ``ROWS`` rows. A unit returns the ``k`` best of its
rows per query, and the best of these are the result.

Rows with a null id, a null vector or a null, NaN or infinite component take no part, nor do empty
vectors. Vectors meet those of the same length only. Rows that share the query's id are its own and
no candidates; wholly equal rows count once. Vectors with a component beyond ``WIDE`` are held as whole numbers of any size,
in small blocks of their own, and searched in the same way. Ranks always follow the exact scores; a score that no long can
hold is shown as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from regimen.llm.frames import stored

#: rows of a block of the index, queries of a block, and the most partitions of units
ROWS, QUERIES, UNITS = 8_192, 2_048, 20_000
#: greatest magnitude of a component in 64-bit arithmetic, and rows of a block of vectors beyond it
WIDE, WIDE_ROWS = 1 << 20, 64
_LONG = 1 << 63


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, dim, v, x) of the vectors that take part: integers v = floor(scale * x), or x where one is beyond ``WIDE``."""
    x = F.transform(F.col(vector_column), lambda e: e.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), x.alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    narrow = F.forall("x", lambda e: F.abs(e * scale) < WIDE)
    return (rows.where(F.col("id").isNotNull() & (F.size("x") > 0) & finite)
            .select("id", F.size("x").alias("dim"), F.when(narrow, F.transform("x", lambda e: F.floor(e * scale).cast("long"))).alias("v"),
                    F.when(~narrow, F.col("x")).alias("x")).distinct())


def integers(v: list[int] | None, x: list[float] | None, scale: int) -> np.ndarray:
    """The integers of a row: 64-bit ones, or whole numbers of any size (a double beyond 2^53 is one itself)."""
    if v is not None:
        return np.asarray(v, np.int64)
    return np.array([math.floor(e * scale) if abs(e) < 2 ** 53 else int(e) * scale for e in x], object)


def _blocks(count: int, size: int) -> int:
    return -(-count // size) or 1


def _dealt(blocks: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks))


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(least value of each dimension, bitmaps by dimension and bit, number of bits)."""
    rows, dims = values.shape
    least = values.min(axis=0)
    shifted = values - least
    bits = max(1, int(shifted.max()).bit_length())
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        flags = ((shifted >> b) & 1).astype(np.uint8).T
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[:, b, :packed.shape[1]] = packed
    return least, out.view(np.uint64), bits


def index(rows: DataFrame, scale: int) -> DataFrame:
    """(dim, block, ids, wide, least, bits, maps): one row per block, ids ascending."""
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        values = np.stack([integers(v, x, scale) for v, x in zip(frame["v"], frame["x"])])
        least, maps, bits = slices_of(values)
        return pd.DataFrame({"dim": [values.shape[1]], "block": [int(frame["block"].iloc[0])], "ids": [frame["id"].to_numpy(np.int64).tobytes()],
                             "wide": [values.dtype == object], "least": [[str(n) for n in least.tolist()]], "bits": [bits], "maps": [maps.tobytes()]})

    return rows.groupBy("dim", "block").applyInPandas(build, "dim int, block long, ids binary, wide boolean, least array<string>, bits int, maps binary")


def _added(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One bitmap per weight, from lists of bitmaps per weight, by full adders."""
    out, weight = [], 0
    while weight < len(columns):
        maps = np.concatenate(columns[weight]) if columns[weight] else None
        if maps is None:
            out.append(None)
            weight += 1
            continue
        while len(maps) > 1:
            if weight + 1 == len(columns):
                columns.append([])
            if len(maps) == 2:
                columns[weight + 1].append(maps[:1] & maps[1:])
                maps = maps[:1] ^ maps[1:]
                break
            n = len(maps) // 3
            a, b, c = maps[:n], maps[n:2 * n], maps[2 * n:3 * n]
            half = a ^ b
            columns[weight + 1].append((a & b) | (half & c))
            maps = np.concatenate((half ^ c, maps[3 * n:]))
        out.append(maps[0])
        weight += 1
    return out


def score_slices(query: np.ndarray, least: np.ndarray, maps: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(slices of the rows' scores less a constant, the constant)."""
    bits = maps.shape[1]
    if object in (query.dtype, least.dtype):
        query, least = query.astype(object), least.astype(object)
    constant = int((query * least).sum())
    columns: list[list[np.ndarray]] = []
    for sign in (1, -1):
        weight = np.maximum(query * sign, 0)
        if sign < 0:
            constant -= int(weight.sum()) * ((1 << bits) - 1)
        for shift in range(int(weight.max(initial=0)).bit_length()):
            dims = np.flatnonzero(((weight >> shift) & 1).astype(bool))
            for b in range(bits if len(dims) else 0):
                while len(columns) <= shift + b:
                    columns.append([])
                part = maps[dims, b]
                columns[shift + b].append(part if sign > 0 else ~part)
    return _added(columns), constant


def best_rows(slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` allowed rows with the highest scores; ties go to the smaller number."""
    chosen, edge = np.zeros_like(allowed), allowed
    if np.bitwise_count(allowed).sum() > k:
        for part in reversed(slices):
            if part is None:
                continue
            more = edge & part
            n = int(np.bitwise_count(chosen | more).sum())
            if n > k:
                edge = more
            elif n < k:
                chosen, edge = chosen | more, edge & ~part
            else:
                chosen, edge = chosen | more, np.zeros_like(edge)
                break
    numbers = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    sure = numbers(chosen)
    return np.concatenate((sure, numbers(edge)[:k - len(sure)]))


def _searched(ids: np.ndarray, least: np.ndarray, maps: np.ndarray, queries: list[tuple[int, np.ndarray]], k: int) -> Iterator[tuple[int, int, int]]:
    words = maps.shape[2]
    valid = np.zeros(words * 8, np.uint8)
    packed = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
    valid[:len(packed)] = packed
    valid = valid.view(np.uint64)
    for own, query in queries:
        allowed = valid.copy()
        for row in range(*np.searchsorted(ids, (own, own + 1)).tolist()):
            allowed[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        slices, constant = score_slices(query, least, maps)
        for row in best_rows(slices, allowed, k).tolist():
            total = sum(int((m[row // 64] >> np.uint64(row % 64)) & np.uint64(1)) << w for w, m in enumerate(slices) if m is not None)
            yield own, int(ids[row]), total + constant


def sort_key(score: int) -> bytes:
    """Bytes in the order of the scores: sign, length and magnitude, from the greatest down."""
    size = (abs(score).bit_length() + 7) // 8
    body = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + body if score < 0 else b"\x00" + bytes(255 - c for c in body)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of each row for which ``is_query`` (over ``id``) holds."""
    rows = stored(quantised(vectors, id_column, vector_column, scale))
    n, n_wide, n_asked = rows.agg(F.count("v"), F.count("x"), F.count_if(is_query)).first()
    narrow, wide, parts = _blocks(n, ROWS), _blocks(n_wide, WIDE_ROWS), _blocks(n_asked, QUERIES)
    block = F.when(F.col("x").isNull(), _dealt(narrow, 1)).otherwise(-1 - _dealt(wide, 1))
    blocks = stored(index(rows.withColumn("block", block), scale))
    asked = (rows.where(is_query).groupBy("dim", _dealt(parts, 2).alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "v", "x"))).alias("queries")))
    unit, tasks = ["dim", "block", "part"], max(1, min(UNITS, parts * blocks.count()))
    here = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).repartition(tasks, *unit)
    there = asked.withColumn("block", F.explode(F.sequence(F.lit(-wide if n_wide else 0).cast("long"), F.lit(narrow - 1).cast("long"))))
    units = here.join(there.repartition(tasks, *unit), unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                least = np.array([int(n) for n in row["least"]], object if row["wide"] else np.int64)
                maps = np.frombuffer(row["maps"], np.uint64).reshape(row["dim"], row["bits"], -1)
                queries = [(q["id"], integers(q["v"], q["x"], scale)) for q in row["queries"]]
                own, found, score = list(zip(*_searched(ids, least, maps, queries, k))) or ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(found, pa.int64()), pa.array([min(max(x, -_LONG), _LONG - 1) for x in score], pa.int64()),
                     pa.array([sort_key(x) for x in score], pa.binary())], names=["query_id", "vec_id", "score", "key"])

    best = Window.partitionBy("query_id").orderBy("key", "vec_id")
    return (units.mapInArrow(run, "query_id long, vec_id long, score long, key binary").distinct().withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
