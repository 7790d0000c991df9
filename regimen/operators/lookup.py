"""Lookups as batch key resolution.

A list of questions is a request DataFrame left-joined to the dimension; an
unresolved request gets a NULL id (one rule for all lookups). Where a key can
match several rows the smallest id is taken, so every request yields one row.
No broadcast hints: the dimensions grow with the data, AQE picks the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimen.operators.ordinal import count_before, ordinal
from regimen.operators.outline import second
from regimen.sources.tables import Model


#: characters of the longest grams in the index of names
GRAM = 3


def _resolve(requests: DataFrame, dim: DataFrame, on: Sequence[str], id_col: str,
             out: str) -> DataFrame:
    """Left join requests to ``dim`` on ``on``; one row per request (min id)."""
    first = dim.groupBy(*on).agg(F.min(id_col).alias(out))
    return requests.join(first, list(on), "left")


def routine_ids(m: Model, requests: DataFrame) -> DataFrame:
    """B1: (user_id, routine_name) -> routine_id (exact name)."""
    dim = m.setup_routines.select("user_id", F.col("name").alias("routine_name"), "id")
    return _resolve(requests, dim, ["user_id", "routine_name"], "id", "routine_id")


def routine_names(m: Model, requests: DataFrame) -> DataFrame:
    """B1 inverse: (user_id, routine_id) -> routine name."""
    dim = m.setup_routines.select("user_id", F.col("id").alias("routine_id"), "name")
    return _resolve(requests, dim, ["user_id", "routine_id"], "name", "routine_name")


def session_ids(m: Model, requests: DataFrame) -> DataFrame:
    """B2: (routine_id, session_name) -> session_id (exact name)."""
    dim = m.setup_sessions.select(F.col("setup_routine_id").alias("routine_id"),
                                  F.col("name").alias("session_name"), "id")
    return _resolve(requests, dim, ["routine_id", "session_name"], "id", "session_id")


def day_ids(m: Model, requests: DataFrame) -> DataFrame:
    """(routine_id, day_number) -> day_id."""
    dim = m.setup_days.select(F.col("setup_routine_id").alias("routine_id"), "day_number", "id")
    return _resolve(requests, dim, ["routine_id", "day_number"], "id", "day_id")


def slot_ids(m: Model, requests: DataFrame) -> DataFrame:
    """(day_id, session_order) -> junction id."""
    dim = m.setup_days_sessions.select("day_id", "session_order", "id")
    return _resolve(requests, dim, ["day_id", "session_order"], "id", "slot_id")


def custom_exercise_ids(m: Model, requests: DataFrame) -> DataFrame:
    """(user_id, exercise_name) -> custom exercise id, NULL if missing."""
    dim = m.custom_exercises.select("user_id", F.col("name").alias("exercise_name"), "id")
    return _resolve(requests, dim, ["user_id", "exercise_name"], "id", "exercise_id")


def user_ids(m: Model, requests: DataFrame) -> DataFrame:
    """Username -> user id."""
    return _resolve(requests, m.users.select("username", "id"), ["username"], "id", "user_id")


def session_exercise_ids(m: Model, requests: DataFrame) -> DataFrame:
    """(session_id, exercise_order) -> session exercise id; rows without a
    custom exercise do not resolve (the reference's inner join)."""
    sse = m.setup_session_exercises.join(
        m.custom_exercises.select(F.col("id").alias("custom_exercise_id")), "custom_exercise_id",
        "left_semi")
    dim = sse.select(F.col("setup_session_id").alias("session_id"), "exercise_order", "id")
    return _resolve(requests, dim, ["session_id", "exercise_order"], "id", "sse_id")


def logged_exercise_ids(m: Model, requests: DataFrame) -> DataFrame:
    """B7 on the log: (track_session_id, exercise_order) -> logged exercise id, with or without a custom exercise."""
    dim = m.track_session_exercises.select("track_session_id", "exercise_order", "id")
    return _resolve(requests, dim, ["track_session_id", "exercise_order"], "id", "track_session_exercise_id")


def session_name_exists(m: Model, requests: DataFrame) -> DataFrame:
    """(routine_id, session_name) -> ``exists`` (case-insensitive)."""
    dim = (m.setup_sessions.select(F.col("setup_routine_id").alias("routine_id"),
                                   F.lower("name").alias("_l")).distinct()
           .withColumn("exists", F.lit(True)))
    r = requests.withColumn("_l", F.lower("session_name")).join(dim, ["routine_id", "_l"], "left")
    return r.withColumn("exists", F.coalesce("exists", F.lit(False))).drop("_l")


def routine_name_like(m: Model, requests: DataFrame) -> DataFrame:
    """(request_id, user_id, pattern) -> ``exists`` a created routine of the
    user whose name ILIKE the request's pattern (``%``, ``_`` wildcards, ``\\``
    escape); a NULL pattern matches nothing.

    Patterns without wildcards are an equi-join on the lower-case name;
    prefix patterns (``abc%``) a pair-free successor lookup. Any other pattern
    is looked up in an index of the names' grams (``_like_exists``).
    """
    created = m.setup_routines.filter(F.col("routine_created")).select("user_id", "name")
    names = created.filter(F.col("name").isNotNull()).select("user_id", F.lower("name").alias("_l")).distinct()
    body = F.expr("substring(pattern, 1, length(pattern) - 1)")
    # an escape before an ordinary character stands for that character; one at the end matches nothing
    unescaped = F.regexp_replace("pattern", r"(\\[%_\\])|\\([^%_\\])", "$1$2")
    open_end = F.col("pattern").rlike(r"(^|[^\\])(\\\\)*\\$")
    kinds = requests.withColumn("_kind", F.when(F.col("pattern").isNull() | open_end, "none")
                                .when(~F.col("pattern").rlike(r"[%_\\]"), "plain")
                                .when(F.col("pattern").rlike(r"^[^%_\\]*%$"), "prefix").otherwise("wild"))
    plain, prefix, wild = (kinds.filter(F.col("_kind") == k) for k in ("plain", "prefix", "wild"))
    a = (plain.withColumn("_l", F.lower("pattern"))
         .join(names.withColumn("_hit", F.lit(True)), ["user_id", "_l"], "left")
         .select("request_id", F.col("_hit").isNotNull().alias("exists")))
    b = _prefix_exists(names, prefix.select("request_id", "user_id", F.lower(body).alias("_p")))
    asked = wild.select("request_id", "user_id", F.lower(unescaped).alias("_pattern"))
    found = _like_exists(names, asked.select("user_id", "_pattern").distinct())
    c = (asked.join(found.withColumn("_m", F.lit(True)), ["user_id", "_pattern"], "left")
         .select("request_id", F.col("_m").isNotNull().alias("exists")))
    hit = a.unionByName(b).unionByName(c)
    return requests.join(hit, "request_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def _like_exists(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """The (user_id, _pattern) rows for which some ``_l`` of the user is LIKE the pattern.

    An inverted index of the names' grams (runs of 1 to ``GRAM`` characters), of which only those asked for are
    kept: the literal pieces of a pattern give its grams, the one that the fewest names of the user hold gives the candidates,
    and LIKE judges them. A pattern with a gram that no name holds meets none. A pattern without any literal
    character asks for a length only."""
    pieces = F.transform(F.regexp_extract_all("_pattern", F.lit(r"((?:(?s)\\.|[^%_\\])+)"), 1), lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1"))
    parsed = patterns.withColumn("_pieces", pieces)

    # no literal at all: at least, or exactly, as many characters as there are underscores
    bare = parsed.filter(F.size("_pieces") == 0).select("user_id", "_pattern", F.length(F.replace("_pattern", F.lit("%"))).alias("_n"),
                                                        F.col("_pattern").contains("%").alias("_open"))
    lengths = names.select("user_id", F.length("_l").alias("_n")).distinct()
    exact = bare.filter(~F.col("_open")).join(lengths, ["user_id", "_n"], "left_semi").select("user_id", "_pattern")
    longest = lengths.groupBy("user_id").agg(F.max("_n").alias("_most"))
    at_least = bare.filter("_open").join(longest, "user_id").filter("_most >= _n").select("user_id", "_pattern")

    def grams(text: Column, low: int) -> Column:
        """The grams of ``text``: of all lengths from ``low`` on, or the text itself if it is shorter."""
        sizes = [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
                 .otherwise(F.array().cast("array<string>")) for n in range(low, GRAM + 1)]
        return F.array_distinct(F.concat(*sizes))

    longer = F.filter("_pieces", lambda x: F.length(x) >= GRAM)
    own = F.when(F.size(longer) > 0, F.array_distinct(F.flatten(F.transform(longer, lambda x: grams(x, GRAM))))).otherwise(F.col("_pieces"))
    asked = parsed.filter(F.size("_pieces") > 0).select("user_id", "_pattern", F.explode(own).alias("_gram"))
    index = (names.select("user_id", "_l", F.explode(grams(F.col("_l"), 1)).alias("_gram"))
             .join(asked.select("user_id", "_gram").distinct(), ["user_id", "_gram"], "left_semi"))
    held = index.groupBy("user_id", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (asked.join(held, ["user_id", "_gram"], "left").groupBy("user_id", "_pattern")
              .agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.min(F.col("_n").isNotNull()).alias("_all")).filter("_all"))
    by_gram = rarest.join(index, ["user_id", "_gram"]).filter("_l LIKE _pattern").select("user_id", "_pattern").distinct()
    return exact.unionByName(at_least).unionByName(by_gram)


def _prefix_exists(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``exists`` a name of the user starting with the prefix, without pairs:
    the smallest name >= the prefix starts with it exactly when any name
    does. ``count_before`` gives how many names sort below the prefix; the
    next name is the one with the following ordinal (an equi-join)."""
    numbered = ordinal(names, ["user_id"], ["_l"], "_a")
    below = count_before(prefixes, names.withColumnRenamed("_l", "_p"), ["user_id"], "_p", "request_id",
                         "_n")
    nxt = numbered.select("user_id", F.col("_a").alias("_want"), F.col("_l").alias("_next"))
    j = (below.withColumn("_want", (F.col("_n") + 1).cast("int"))
         .join(nxt, ["user_id", "_want"], "left"))
    return j.select("request_id", F.coalesce(F.col("_next").startswith(F.col("_p")), F.lit(False))
                    .alias("exists"))


def routine_name_exact(m: Model, requests: DataFrame) -> DataFrame:
    """(user_id, routine_name) -> ``exists`` by exact name."""
    dim = m.setup_routines.select("user_id", F.col("name").alias("routine_name")).distinct() \
        .withColumn("exists", F.lit(True))
    return (requests.join(dim, ["user_id", "routine_name"], "left")
            .withColumn("exists", F.coalesce("exists", F.lit(False))))


def in_subquery(df: DataFrame, col: str, keys: DataFrame, key: str) -> DataFrame:
    """``col IN (SELECT key ...)`` as a semi join."""
    return df.join(keys.select(F.col(key).alias(col)).distinct(), col, "left_semi")


def per_key_value(df: DataFrame, key: str, agg, name: str, keys: DataFrame | None = None) -> DataFrame:
    """Scalar subquery per key as an aggregate joined to the keys."""
    v = df.groupBy(key).agg(agg.alias(name))
    return v if keys is None else keys.join(v, key, "left")


def with_nulls(df: DataFrame, col: str, null: bool = True) -> DataFrame:
    """IS NULL / IS NOT NULL filter."""
    return df.filter(F.col(col).isNull() if null else F.col(col).isNotNull())


def flagged(df: DataFrame, col: str, value: bool = True) -> DataFrame:
    """Boolean flag filter (NULL flags drop either way)."""
    return df.filter(F.col(col) if value else ~F.col(col))


def above(df: DataFrame, col: str, k) -> DataFrame:
    """Range filter ``col > k``."""
    return df.filter(F.col(col) > F.lit(k))


def match_second(left: DataFrame, lcol: str, right: DataFrame, rcol: str, on: Sequence[str]) -> DataFrame:
    """Equi-join that also matches two instants at second precision."""
    a = left.withColumn("_sec", second(F.col(lcol)))
    b = right.withColumn("_sec", second(F.col(rcol)))
    return a.join(b, list(on) + ["_sec"]).drop("_sec")
