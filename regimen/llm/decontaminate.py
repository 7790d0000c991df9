"""Benchmark decontamination by a positional inverted index, with DataFrame operations only.

Words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A window is ``length``
consecutive words of an item; an item of fewer words, but not none, is one window.

1. The corpus is counted once: how often each word of the items stands in it.
2. Each window takes its two rarest words as anchors. The training postings (word, document,
   position) are stored for anchor words only.
3. Lists are offset-adjusted (position in the document less position in the item) and intersected:
   a window is a candidate where both anchors have the same shift.
4. Candidates are verified against the words of the document: exact phrase matches.
Where the anchors of one item stand apart by up to ``slop`` words more or less than in the item,
the item is a proximity match of the document, which is reported but marks no word.

Hashes only lead to candidates; words are compared as text. Null and empty texts have no words.
Rows of items that share an item_id are one item; rows with a null item_id mark words but are not
listed. Documents that share a doc_id are told apart by their text; wholly equal rows get equal
results, one each. Empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from regimen.llm.frames import broadcast_if_small, stored, text_key

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words of a text; null has none."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower()),
                    "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(parts, lambda w: w != "")


def item_rows(items: DataFrame, length: int) -> DataFrame:
    """(row, item, q, size): one row per distinct text of an item, q its words, size its window's length."""
    return (items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("q"))
            .where(F.size("q") > 0).distinct()
            .select(F.xxhash64("item", "q").alias("row"), "item", "q", F.least(F.size("q"), F.lit(length)).alias("size")))


def anchors_of(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, start, off, term): the places in the item of the two rarest words of the window that begins at ``start``."""
    places = rows.select("row", "size", F.posexplode("q").alias("off", "word")).withColumn("term", F.xxhash64("word"))
    ranked = (places.join(counts, "term", "left").groupBy("row")
              .agg(F.first("size").alias("size"),
                   F.sort_array(F.collect_list(F.struct("off", F.coalesce("count", F.lit(0)).alias("count"), "term"))).alias("all")))
    starts = F.explode(F.sequence(F.lit(0), F.size("all") - F.col("size")))
    window = F.transform(F.slice("all", F.col("start") + 1, F.col("size")), lambda x: F.struct(x["count"], x["off"], x["term"]))
    return (ranked.select("row", "size", "all", starts.alias("start"))
            .select("row", "start", F.explode(F.slice(F.sort_array(window), 1, 2)).alias("x"))
            .select("row", "start", "x.off", "x.term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, t, pos, term) of every place in ``docs`` where one of ``terms`` stands."""
    text = F.col("text").cast("string")
    placed = docs.select("doc_id", text_key(text).alias("t"), F.posexplode(words_of(text)).alias("pos", "word"))
    return placed.select("doc_id", "t", "pos", F.xxhash64("word").alias("term")).join(terms, "term")


def candidates(docs: DataFrame, rows: DataFrame, slop: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, row, shift, starts) of the windows both of whose anchors fit, and (doc_id, t, row) of proximity matches."""
    words = stored(rows.select(F.explode("q").alias("word")).select(F.xxhash64("word").alias("term")).distinct())
    text = F.col("text").cast("string")
    counts = (docs.select(F.explode(words_of(text)).alias("word")).select(F.xxhash64("word").alias("term"))
              .join(broadcast_if_small(words), "term").groupBy("term").count())
    anchors = stored(anchors_of(rows, counts))
    found = stored(postings(docs, broadcast_if_small(stored(anchors.select("term").distinct()))))
    shifted = (found.join(anchors.groupBy("row", "off", "term").agg(F.collect_set("start").alias("starts")), "term")
               .select("doc_id", "t", "row", "off", (F.col("pos") - F.col("off")).alias("shift"), "starts"))
    needed = anchors.groupBy("row", "start").agg(F.count("*").alias("needed"))
    met = F.when(F.min("off") < F.max("off"), 2).otherwise(1)       # anchors, of two at most; equal rows repeat their postings
    starts = (shifted.select("doc_id", "t", "row", "shift", "off", F.explode("starts").alias("start"))
              .groupBy("doc_id", "t", "row", "shift", "start").agg(met.alias("n"))
              .join(needed, ["row", "start"]).where("n = needed")
              .groupBy("doc_id", "t", "row", "shift").agg(F.collect_list("start").alias("starts")))
    near = Window.partitionBy("doc_id", "t", "row").orderBy("shift", "off")
    close = (shifted.select("doc_id", "t", "row", "shift", "off")
             .withColumn("other", F.lag("off").over(near)).withColumn("gap", F.col("shift") - F.lag("shift").over(near))
             .where((F.col("other") != F.col("off")) & (F.col("gap") <= slop)).select("doc_id", "t", "row").distinct())
    return starts, close


def matches(docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 5) -> DataFrame:
    """All columns of ``docs`` and a struct column ``__found``: n_words, hits (from, size, item; from counts words), near (items)."""
    rows = stored(item_rows(items, length))
    exact, close = candidates(docs, rows, slop)
    lists = (exact.join(rows, "row").select("doc_id", "t", F.struct("item", "q", "size", "shift", "starts").alias("a"), F.lit(None).cast("string").alias("near"))
             .unionByName(close.join(rows.select("row", "item"), "row").select("doc_id", "t", F.col("item").alias("near")), allowMissingColumns=True)
             .groupBy("doc_id", "t").agg(F.collect_list("a").alias("__a"), F.sort_array(F.collect_set("near")).alias("__near"))
             .withColumnsRenamed({"doc_id": "__d", "t": "__t"}))
    text = F.col("text").cast("string")
    joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("__d")) & (text_key(text) == F.col("__t")), "left")
    w = F.col("__w")
    hits = F.flatten(F.transform("__a", lambda a: F.transform(
        F.filter(a["starts"], lambda s: (s + a["shift"] >= 0) & (s + a["shift"] + a["size"] <= F.size(w))
                 & F.when(s + a["shift"] >= 0, F.slice(w, F.greatest(s + a["shift"] + 1, F.lit(1)), a["size"]) == F.slice(a["q"], s + 1, a["size"]))
                 .otherwise(False)),
        lambda s: F.struct((s + a["shift"]).alias("from"), a["size"].alias("size"), a["item"].alias("item")))))
    found = F.struct(F.size(w).cast("long").alias("n_words"), F.coalesce(hits, F.array()).alias("hits"),
                     F.coalesce("__near", F.array()).alias("near"))
    return (joined.withColumn("__w", words_of(text)).withColumn("__found", found).select(*(F.col(f"`{c}`") for c in docs.columns), "__found"))


def report(docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, per row of ``docs``."""
    f = F.col("__found")
    covered = F.array_distinct(F.flatten(F.transform(f["hits"], lambda h: F.sequence(h["from"], h["from"] + h["size"] - 1))))
    listed = F.sort_array(F.array_distinct(F.filter(F.transform(f["hits"], lambda h: h["item"]), lambda i: i.isNotNull())))
    return (matches(docs.select("doc_id", "text"), items, length, slop)
            .select("doc_id", f["n_words"].alias("n_words"), F.size(covered).cast("long").alias("n_hit"), listed.alias("listed"),
                    F.size(F.array_except(f["near"], listed)).cast("long").alias("n_near_items"))
            .select("doc_id", "n_words", "n_hit", F.size("listed").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "listed"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near_items"))


def clean(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """Rows of ``docs`` in which no window of an item occurs."""
    return matches(docs, items, length).where(F.size("__found.hits") == 0).drop("__found")
