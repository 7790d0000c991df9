"""Similarity join on word n-gram sets by MinHash banding, and near-duplicate removal from it.

Words are what ASCII white space separates, unchanged; the set of a text holds its ``n``-word
shingles (of a text of fewer words: all its words as one shingle). Two texts are linked if the
Jaccard similarity of their sets is ``threshold`` or more.

1. One pass makes a sketch per row: set size, two 64-bit hashes of the set, and band hashes of its
   MinHash values. Bands and rows are chosen for ``recall`` at the threshold. Size and hashes give a
   class id of 64 bits that is taken as equality of the sets.
2. Rows with equal sets are one class; one representative of a class goes on.
3. Representatives meet on band hashes. Large buckets are cut into blocks, and pairs of blocks are the
   units of work, so no task holds a bucket that grows and no pair becomes a row. A first pass over
   sketches alone finds which representatives a bucket must compare: a pair is judged in the first
   band that it shares, and only there.
4. Their full shingle sets meet in these blocks and the similarity is computed exactly. A block returns,
   per representative, its number of links and one edge to its local component.
5. Components of these edges are the groups of near-duplicates.

Texts without words (null, empty, blank) are classes of their own and never linked. Rows that share a
doc_id are told apart by their text; a class or group is named by its smallest doc_id (a null id
comes first). Wholly equal rows are one document here. Extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regimen.llm import arrays
from regimen.llm.frames import shuffle_partitions, stored, text_key
from regimen.llm.graph import components

#: representatives of a bucket that are compared at once
BLOCK = 512
#: rows of a grouped task: band rows, and shingles
PART_ROWS, PART_SHINGLES = 20_000, 1_000_000


def choose_bands(threshold: float, recall: float, most: int = 80) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, for which ``bands * rows`` values
    are at most ``most`` and a pair at the threshold meets with probability ``recall``."""
    best = None
    for rows in range(1, most + 1):
        miss = 1 - threshold ** rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError(f"no banding of {most} values reaches recall {recall} at {threshold}")
    return best


def shingles(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, data = arrays.buffer_of(column)
    for _, _, o, d in arrays.slices(offsets, data):
        starts, ends, first = arrays.word_bounds(o, d)
        words = arrays.span_hashes(arrays.prefix_sums(d), starts, ends)
        grams = arrays.grams(words, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            elif b > a:
                yield arrays.grams(words[a:b], b - a) + np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, t, size, c, bands): c names the set; bands is empty where there are no words."""
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingles(batch.column("text"), n))
            size = np.array([len(s) for s in sets], np.int64)
            all_, at = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.cumsum(size) - size
            some = size > 0
            one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            mins = np.zeros((int(some.sum()), bands * rows), np.uint64)
            if some.any():
                one[some], two[some] = (np.add.reduceat(arrays.mix(all_ ^ np.uint64(s)), at[some]) for s in (0x51ED, 0xC0FFEE))
                owner = np.repeat(np.arange(int(some.sum())), size[some])
                for a in range(0, len(owner), 1 << 17):        # a window of shingles at a time: small arrays
                    part, own = all_[a:a + (1 << 17)], owner[a:a + (1 << 17)]
                    cut = np.flatnonzero(np.diff(own, prepend=-1))
                    for k in range(bands * rows):
                        low = np.minimum.reduceat((part ^ factors[0, k]) * factors[1, k], cut)
                        old = mins[own[cut], k] if a else None
                        fresh = own[cut] != (owner[a - 1] if a else -1)
                        mins[own[cut], k] = low if old is None else np.where(fresh, low, np.minimum(low, old))
            keys = np.zeros((len(mins), bands), np.uint64)
            for b in range(bands):
                for r in range(rows):
                    keys[:, b] = arrays.mix(keys[:, b] * np.uint64(31) + mins[:, b * rows + r] + np.uint64(b + 1))
            ends = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))],
                names=["doc_id", "t", "size", "one", "two", "bands"])

    text = F.col("text").cast("string")
    source = docs.select("doc_id", text_key(text).alias("t"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    made = source.mapInArrow(run, f"doc_id {kind}, t long, size long, one long, two long, bands array<long>")
    own = F.when(F.col("size") > 0, F.xxhash64("size", "one", "two")).otherwise(F.xxhash64("doc_id", "t", F.lit("none")))
    return made.select("doc_id", "t", "size", own.alias("c"), "bands")


def _groups(frame: pd.DataFrame) -> Iterator[np.ndarray]:
    """Row numbers of each (bucket, one, two)."""
    order = frame.sort_values(["bucket", "one", "two", "c"]).index.to_numpy()
    key = frame[["bucket", "one", "two"]].to_numpy()[order]
    cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    yield from np.split(order, cuts)


def _to_compare(band: int, own: np.ndarray, bands: np.ndarray, crossed: bool) -> np.ndarray:
    """Pairs of a unit that share no earlier band; ``crossed``: only those of different blocks."""
    new = np.triu(np.ones((len(own), len(own)), bool), 1)
    if crossed:
        new &= own[:, None] != own[None, :]
    for b in range(band):
        new &= bands[:, b][:, None] != bands[:, b][None, :]
    return new


def _needed(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of the units that have a pair to compare."""
    frame = frame.reset_index(drop=True)
    band, own, bands = frame["band"].to_numpy(), frame["own"].to_numpy(), np.stack(frame["bands"].to_numpy())
    keep = np.zeros(len(frame), bool)
    for at in _groups(frame):
        new = _to_compare(int(band[at[0]]), own[at], bands[at], frame["one"][at[0]] != frame["two"][at[0]])
        keep[at] = new.any(axis=0) | new.any(axis=1)
    return frame.loc[keep, ["bucket", "one", "two", "band", "own", "c", "bands"]]


def intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of a block, by products of its incidence matrix."""
    size = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    row, hit = np.repeat(np.arange(len(sets)), size), shared[place]
    row, place = row[hit], column[place[hit]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, (low, low + width))
        block = np.zeros((len(sets), width), np.float32)
        block[row[a:b], place[a:b] - low] = 1
        out += block @ block.T
    return out


def _verifier(threshold: float):
    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        """(c, links, root) of the linked rows of each unit."""
        frame = frame.reset_index(drop=True)
        band, own, c = frame["band"].to_numpy(), frame["own"].to_numpy(), frame["c"].to_numpy()
        bands, sets = np.stack(frame["bands"].to_numpy()), [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        out = []
        for at in _groups(frame):
            new = _to_compare(int(band[at[0]]), own[at], bands[at], frame["one"][at[0]] != frame["two"][at[0]])
            size = np.array([len(sets[i]) for i in at], np.float32)
            new &= np.minimum(size[:, None], size) >= np.float32(threshold - 1e-3) * np.maximum(size[:, None], size)
            if not new.any():
                continue
            common = intersections([sets[i] for i in at]).astype(np.float64)
            either = size.astype(np.float64)[:, None] + size - common
            linked = new & (common >= threshold * either - 1e-9)
            linked |= linked.T
            links = linked.sum(axis=1)
            root, before = c[at].copy(), None
            while before is None or (root != before).any():
                before = root
                root = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            some = links > 0
            out.append(pd.DataFrame({"c": c[at][some], "links": links[some], "root": root[some]}))
        return pd.concat(out) if out else pd.DataFrame({"c": [], "links": [], "root": []}, dtype="int64")
    return verify


def links_of(made: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(c, links, root) per unit in which representative c has links; ``made`` are stored sketches of ``docs``."""
    spark = docs.sparkSession
    some = made.where(F.size("bands") > 0)
    reps = stored(some.groupBy("c").agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    buckets = reps.select("c", F.posexplode("bands").alias("band", "bucket"))
    shared = stored(buckets.groupBy("bucket").agg(F.count("*").alias("g")).where("g > 1"))
    blocks = F.ceil(F.col("g") / BLOCK)
    units = (buckets.join(shared, "bucket").withColumn("own", F.pmod(F.xxhash64("c", "bucket"), blocks))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .select("bucket", "band", "c", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")))
    units = units.join(reps.select("c", "bands", "size"), "c")
    total = shared.agg(F.coalesce(F.sum(F.col("g") * blocks), F.lit(0))).first()[0]
    unit = F.xxhash64("bucket", "one", "two")
    parts = max(shuffle_partitions(spark), int(total) // PART_ROWS)
    needed = stored(units.withColumn("part", F.pmod(unit, F.lit(parts))).groupBy("part")
                    .applyInPandas(_needed, "bucket long, one long, two long, band int, own long, c long, bands array<long>"))
    wanted = reps.join(needed.select("c").distinct(), "c", "left_semi").select("c", F.col("rep.doc_id").alias("__d"), F.col("rep.t").alias("__t"))
    text = F.col("text").cast("string")
    texts = (docs.select("doc_id", text.alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & (text_key(text) == F.col("__t")))
             .select("c", "text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([s.tobytes() for s in shingles(batch.column("text"), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("c"), packed], names=["c", "shingles"])

    packed = texts.mapInArrow(sets, "c long, shingles binary").dropDuplicates(["c"])
    volume = needed.join(reps.select("c", "size"), "c").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), int(volume) // PART_SHINGLES)
    return stored(needed.join(packed, "c").withColumn("part", F.pmod(unit, F.lit(parts))).groupBy("part")
                  .applyInPandas(_verifier(threshold), "c long, links long, root long"))


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, t, class_id, n_links (linked classes), group_id, kept (the group's first document), per row of ``docs``."""
    made = stored(sketches(docs, n, *choose_bands(threshold, recall)))
    found = links_of(made, docs, n, threshold)
    counted = found.groupBy("c").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    classes = (made.groupBy("c").agg(F.min(F.struct("doc_id", "t")).alias("first"))
               .join(counted, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left")
               .withColumn("root", F.coalesce("root", "c")))
    groups = classes.groupBy("root").agg(F.min("first").alias("head"))
    named = classes.join(groups, "root").select("c", F.col("first.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                                                "head")
    return made.select("doc_id", "t", "c").join(named, "c").select(
        "doc_id", "t", "class_id", "n_links", F.col("head.doc_id").alias("group_id"), (F.struct("doc_id", "t") == F.col("head")).alias("kept"))


def dedup(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group its first document, of wholly equal rows with words one."""
    keys = (join(docs, n, threshold).where("kept").groupBy("doc_id", "t").agg(F.count("*").alias("__n"))
            .withColumnsRenamed({"doc_id": "__d", "t": "__t"}))
    key = text_key(F.col("text").cast("string"))
    kept = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("__d")) & (key == F.col("__t")))
    worded = F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    alone = kept.where((F.col("__n") == 1) | ~worded)
    equal = kept.where((F.col("__n") > 1) & worded).dropDuplicates(["__d", "__t"])
    return alone.unionByName(equal).select(*docs.columns)
