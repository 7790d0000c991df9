"""Line dedup by a deletion-neighbourhood join, with DataFrame operations only.

A line is the text between two ``\\n``; its words are what single spaces separate (two spaces have an
empty word between them). Lines are equal if their words are. Two lines of ``min_words`` or more words are near if one word put in, left out or
replaced turns one into the other (edit distance 1 over words). A line goes if an equal or a near
line stands earlier in the corpus: in a smaller doc_id, or above it in the same document. All is
judged on the input, not on what is left.

1. Equal lines meet by hash; the earliest place of each distinct line is kept (pre-aggregated, so
   that a line that fills a third of the corpus is one row per task).
2. Two near lines have the same first or the same last half. Half hashes that only one distinct
   line has are dropped; the lines left (candidates) are found again by a bitmap of fixed size, and
   exactly by their hash.
3. Every candidate emits the hash of its words with word i left out, for every i, and its own full
   hash; hashes that one line alone emits are dropped. Lines that replace the same word share (hash, i); a line with a word put in shares a variant
   with the full hash of the other. Groups are reduced to their earliest line, never to pairs: in such
   a group every line is within the bound of the earliest.
4. The earliest partner of every line found is verified word by word.

A line, half or variant that very many lines share is dealt over several tasks wherever its rows are joined
(``frames.join_salted``).

Blank lines are never removed. Null and empty texts have no lines to remove. A null doc_id comes
before all others. Rows that share a doc_id count as documents in the order of a hash of their text;
wholly equal rows count as one document and get the same result. Long lines are treated as all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from regimen.llm.frames import bitmap_of, join_salted, maybe_in, stored, text_key

_BLANK = "^[\\x20\\x09-\\x0D]*$"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t, no, words, n, h) of every line that isn't blank; t with doc_id is the row's key."""
    text = F.col("text").cast("string")
    lines = docs.select("doc_id", text_key(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    return (lines.where(~F.col("line").rlike(_BLANK)).select("doc_id", "t", "no", F.split("line", " ").alias("words"))
            .withColumn("n", F.size("words")).withColumn("h", F.xxhash64("words")))


def _half_keys() -> Column:
    """Hashes of the first and the last h words, for the halves h that a line of as many words, of one
    less or of one more can share with this one."""
    def sides(h: Column) -> list[Column]:
        return [F.xxhash64(F.lit(0), h, F.slice("words", F.lit(1), h)), F.xxhash64(F.lit(1), h, F.slice("words", F.col("n") - h + 1, h))]
    half = F.floor(F.col("n") / 2).cast("int")
    return F.when(F.col("n") % 2 == 0, F.array(*sides(half), *sides(half - 1))).otherwise(F.array(*sides(half)))


def _candidates(table: DataFrame) -> DataFrame:
    """(h) of the distinct lines of which another one shares a half."""
    keys = table.where("keys is not null").select("h", F.explode("keys").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n")).where("low <> high")
                    .select("key", "n"))
    # few halves are shared; a line's copies count once before they meet
    few = maybe_in(keys, "key", bitmap_of(shared, "key")).distinct()
    return stored(join_salted(few, shared, ["key"]).select("h").distinct())


def _variants(found: DataFrame) -> DataFrame:
    """(h, m, v, i): hash v of the m words left without word i; i = -1: of all words."""
    words = found.select("h", "n", F.posexplode("words").alias("i", "word"))
    here, shifted = F.xxhash64("word", "i"), F.xxhash64("word", F.col("i") - 1)
    line = Window.partitionBy("h")
    before = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    to_here = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    summed = words.select("h", "n", "i", F.coalesce(F.bit_xor(here).over(before), F.lit(0).cast("long")).alias("left"),
                          F.bit_xor(here).over(to_here).alias("all"), F.bit_xor(shifted).over(to_here).alias("right"),
                          F.bit_xor(shifted).over(line).alias("total"))
    gone = F.struct((F.col("n") - 1).alias("m"), F.expr("left ^ total ^ right").alias("v"), F.col("i").alias("i"))
    full = F.struct(F.col("n").alias("m"), F.col("all").alias("v"), F.lit(-1).alias("i"))
    last = F.col("i") == F.col("n") - 1
    return (summed.select("h", F.explode(F.when(last, F.array(gone, full)).otherwise(F.array(gone))).alias("x"))
            .select("h", "x.m", "x.v", "x.i"))


def _near(words: Column, other: Column) -> Column:
    """Edit distance of at most 1 over words: what the common head and tail leave is one word at most."""
    def common(a: Column, b: Column) -> Column:
        differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(differs == 0, F.greatest(F.size(a), F.size(b))).otherwise(differs - 1)
    longest = F.greatest(F.size(words), F.size(other))
    return common(words, other) + common(F.reverse(words), F.reverse(other)) >= longest - 1


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, t, no, h, keys) of every line, kept; keys are null for lines too short for a near one."""
    keys = F.when(F.col("n") >= min_words, _half_keys()).alias("keys")
    return stored(lines_of(docs).select("doc_id", "t", "no", "h", keys))


def near_lines(docs: DataFrame, table: DataFrame, min_words: int) -> DataFrame:
    """(h, partner): distinct lines with an earlier near line, and the hash of the earliest found."""
    candidates = _candidates(table)
    bitmap = bitmap_of(candidates, "h")
    places = maybe_in(table, "h", bitmap).groupBy("h").agg(F.min(F.struct("doc_id", "t", "no")).alias("place"))
    words = (maybe_in(lines_of(docs).where(F.col("n") >= min_words), "h", bitmap).groupBy("h")
             .agg(F.first("n").alias("n"), F.first("words").alias("words")))
    found = stored(words.join(candidates, "h").join(places, "h").select("h", "n", "words", "place"))
    every = stored(_variants(found))
    # most variants belong to one line alone; the others are few
    shared = stored(every.groupBy("v").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n")).where("low <> high")
                    .select("v", "n"))
    variants = stored(join_salted(maybe_in(every, "v", bitmap_of(shared, "v")), shared, ["v"])
                      .join(found.select("h", F.struct("place", "h").alias("at")), "h"))
    groups = variants.groupBy("m", "v", "i").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by_variant = (groups.groupBy("m", "v").agg(F.min(F.when(F.col("i") < 0, F.col("first"))).alias("full"),
                                               F.min(F.when(F.col("i") >= 0, F.col("first"))).alias("longer")))
    earliest = stored(groups.join(by_variant, ["m", "v"]).select(
        "m", "v", "i", F.when(F.col("i") < 0, F.col("longer")).otherwise(F.least("first", "full")).alias("partner"), "n"))
    pairs = (join_salted(variants, earliest, ["m", "v", "i"]).where("partner < at").groupBy("h").agg(F.min("partner.h").alias("partner")))
    words = found.select("h", "words")
    return (pairs.join(words, "h").join(words.select(F.col("h").alias("partner"), F.col("words").alias("other")), "partner")
            .where(_near(F.col("words"), F.col("other"))).select("h", "partner"))


def removed_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """(doc_id, t, no, near) of every line that goes; near: no equal line stands earlier."""
    table = line_table(docs, min_words)
    place = F.struct("doc_id", "t", "no")
    distinct = table.groupBy("h").agg(F.min(place).alias("place"), F.max(place).alias("last"), F.count("*").alias("n"))
    near = near_lines(docs, table, min_words).select("h", F.lit(True).alias("is_near"))
    judged = stored(distinct.join(near, "h", "left").where("is_near or place < last")
                    .select("h", "place", F.coalesce("is_near", F.lit(False)).alias("is_near"), "n"))
    return (join_salted(table.select("h", "doc_id", "t", "no"), judged, ["h"])
            .where(F.col("is_near") | (place > F.col("place")))
            .select("doc_id", "t", "no", (place == F.col("place")).alias("near")))


def removed_by_row(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """(doc_id, t, gone: sorted line numbers, n_near) of the rows that lose lines."""
    return (removed_lines(docs, min_words).groupBy("doc_id", "t")
            .agg(F.sort_array(F.collect_set("no")).alias("gone"), F.count_if("near").alias("n_near")))


def report(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near and a digest of the removed lines' numbers (from 0), per row."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text_key(text).alias("t"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    gone = removed_by_row(docs, min_words).select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "gone", "n_near")
    numbers = F.concat_ws(",", F.transform("gone", lambda x: x.cast("string")))
    return (rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left")
            .select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.sha2(F.coalesce(numbers, F.lit("")), 256).alias("removed_sha256")))


def dedup(docs: DataFrame, min_words: int = 8, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the lines gone from its text; other columns and texts without such lines stay as they are.
    With ``drop_emptied``, rows that lose lines and keep none but blank ones are left out."""
    text = F.col("text").cast("string")
    gone = removed_by_row(docs, min_words).select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), F.col("gone").alias("__gone"))
    left = F.concat_ws("\n", F.filter(F.split(text, "\n"), lambda line, no: ~F.array_contains("__gone", no)))
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (text_key(text) == F.col("__t")), "left").withColumn("__left", left)
    if drop_emptied:
        kept = kept.where(F.col("__gone").isNull() | F.col("__left").rlike("[^\\x20\\x09-\\x0D]"))
    return kept.select(*(F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.col("__left")).alias("text") if c == "text" else F.col(f"`{c}`")
                         for c in docs.columns))
