"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

``pieces`` turns every document into its ids plus an end id and cuts only those longer than a
sequence, into pieces of ``capacity`` tokens of which the first may be shorter. Then
1. each partition packs its pieces best-fit (longest first), in chunks of ``chunk`` pieces;
2. bins that are full but for ``slack`` tokens are sequences;
3. the residue, all pieces of all other bins of all partitions, is packed best-fit once more as a whole.
Only lengths decide in a best-fit packing, and there are at most ``capacity`` of them. So the whole residue
is planned from the number of its pieces of each length (``planned``): a plan of a size bounded by the
capacity, in which pieces of one length are told apart by their rank. Nothing is held back or closed early,
and no group grows with the input.

Null and empty texts are one piece with the end id alone. Rows that repeat a doc_id, or are wholly
equal, are packed as documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from regimen.llm.frames import stored
from regimen.llm.tokens import encoder


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be short of ``capacity``."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in the bin, fill of each bin); longest first, each into the bin with
    the least room that is enough. Ties go to the earlier item."""
    owner, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0                                     # bit r is set if a bin has r tokens of room
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        owner[i], offset[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return owner, offset, np.array(fill, np.int64)


def ranks_of(values: np.ndarray) -> np.ndarray:
    """The place of each value among the equal ones, in order."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.searchsorted(ordered, ordered)
    return out


def planned(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit packing, longest first, of ``counts[n]`` pieces of each length n, many alike bins at a time. Rows of
    (n, first rank, pieces a bin, first sequence, offset in it): from the first rank on, each ``pieces a bin`` next
    pieces of length n go one behind the other into the next sequence. A step uses up a class of alike bins for this
    length or the pieces of this length, so the number of rows depends on the capacity alone."""
    rows: list[tuple[int, int, int, int, int]] = []
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]       # (first sequence, number) of alike bins
    rooms = sequences = 0                                                          # bit r is set if a bin has r tokens of room

    def put(room: int, first: int, number: int) -> None:
        nonlocal rooms
        if room and number:
            by_room[room].append((first, number))
            rooms |= 1 << room

    for n in sorted((k for k, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[n]
        while left:
            fitting = rooms >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                first, number = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, first, number = capacity, sequences, -(-left // (capacity // n))
                sequences += number
            each = room // n
            rows.append((n, rank, each, first, capacity - room))
            whole = min(number, left // each)
            put(room - each * n, first, whole)
            used = whole * each
            if whole < number and used < left:                 # the last pieces don't make up a bin's share
                put(room - (left - used) * n, first + whole, 1)
                whole, used = whole + 1, left
            put(room, first + whole, number - whole)
            rank, left = rank + used, left - used
    return np.array(rows, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, chunk: int = 50_000, slack: int = 8, with_ids: bool = False,
           ranks: str | None = None, pattern: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Rows of doc_id, piece, start, length, ids_crc32 (and ids), packed within their partition:
    ``bin`` (unique) and ``offset`` in it; ``rank`` numbers the partition's residual pieces of each length, and is
    null in bins that are full but for ``slack``."""
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()
    id_field = docs.schema["doc_id"]
    schema = pa.schema([("doc_id", to_arrow_type(id_field.dataType)), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()),
                        ("rank", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern, vocabulary).ids
        numbered = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        seen = np.zeros(capacity + 1, np.int64)       # residual pieces of each length so far

        def packed() -> pa.RecordBatch:
            nonlocal numbered
            columns = list(zip(*rows)) or [[]] * (5 + with_ids)
            lengths = np.array(columns[3], np.int64)
            owner, offset, fill = best_fit(lengths, capacity)
            open_ = fill[owner] < capacity - slack if len(rows) else np.zeros(0, bool)
            rank = np.zeros(len(rows), np.int64)
            rank[open_] = ranks_of(lengths[open_]) + seen[lengths[open_]]
            seen[:] += np.bincount(lengths[open_], minlength=capacity + 1)
            out = [*columns[:5], owner + numbered, offset, pa.array(rank, mask=~open_), *columns[5:]]
            numbered += len(fill)
            rows.clear()
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = memoryview(encode(text.as_py()) + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    row = (doc, k, start, length, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
                if len(rows) >= chunk:
                    yield packed()
        yield packed()

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {id_field.dataType.simpleString()}, piece int, start long, length long, "
                                  "ids_crc32 long, bin long, offset long, rank long" + ", ids array<int>" * with_ids)


def sequences(docs: DataFrame, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id and offset of every piece."""
    packed = stored(pieces(docs, capacity, end_id, with_ids=with_ids).withColumn("_part", F.shiftright("bin", 33)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "offset", *["ids"] * with_ids]
    residue = packed.where("rank is not null")
    counts = stored(residue.groupBy("_part", "length").agg(F.count("*").alias("n")))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}       # at most capacity rows
    plan = docs.sparkSession.sparkContext.broadcast(planned(total, capacity))      # of a size bounded by the capacity
    beyond = ((packed.agg(F.max("_part")).first()[0] or 0) + 1) << 33             # above all bins of the partitions
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    ranked = residue.join(begins, ["_part", "length"]).withColumn("bin", F.col("rank") + F.col("_begin"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, each, sequence, base = plan.value.T
        order = np.lexsort((first, n))
        n, first, each, sequence, base = n[order], first[order], each[order], sequence[order], base[order]
        key = (n << 40) + first
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("bin").to_numpy()
            row = np.searchsorted(key, (lengths << 40) + ranks, "right") - 1
            nth = ranks - first[row]
            out = {c: batch.column(c) for c in columns}
            out["offset"] = pa.array(base[row] + nth % each[row] * lengths)
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(beyond + sequence[row] + nth // each[row])})

    done = packed.where("rank is null").select(*columns, F.col("bin").alias("sequence_id"))
    again = ranked.select(*columns, "bin")
    out = done.unionByName(again.mapInArrow(place, T.StructType([*again.schema.fields[:-1]]).add("sequence_id", "long")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "offset", *["ids"] * with_ids, "sequence_id")
