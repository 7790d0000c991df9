"""Validation and constraints as violation reports.

Every rule returns rows ``(rule, table, key, detail)``: nothing is thrown,
every violating row is reported, and rules over the whole model are a union
of independent jobs (each a filter, a grouped count or an anti join).
"""

from __future__ import annotations

import functools
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.functions.scalar import js_trim, to_int, to_weight
from regimen.operators.setops import union_all
from regimen.sources import schema as S
from regimen.sources.levels import stored
from regimen.sources.tables import Model

REPORT_COLUMNS = ["rule", "table", "key", "detail"]


def _key(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _report(df: DataFrame, rule: str, table: str, key: Column, detail: Column, *keep: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), key.alias("key"),
                     detail.cast("string").alias("detail"), *keep)


def key_rows(df: DataFrame, cols: Sequence[Column], needed: Sequence[Column], *keep: str) -> tuple[DataFrame, list[str]]:
    """The keys ``cols`` of the rows that have all of ``needed``, one column a part, with the columns ``keep``; names of the parts."""
    def part(c: Column) -> Column:          # whole numbers and texts are equal as their texts are
        return c if isinstance(df.select(c).schema[0].dataType, (T.IntegralType, T.StringType)) else c.cast("string")

    parts = [f"_{k}" for k in range(len(cols))]
    return df.filter(_present(needed)).select(*[part(c).alias(p) for c, p in zip(cols, parts)], *keep), parts


def key_report(found: DataFrame, rule: str, table: str, parts: Sequence[str], held: str, *keep: str) -> DataFrame:
    """Report rows of the keys ``found``; the detail is the number of rows that hold the key."""
    return _report(found, rule, table, _key(parts), F.col(held), *keep)


def repeated_keys(df: DataFrame, keys: Sequence[tuple[str, Sequence[Column], Sequence[Column]]], table: str = "") -> DataFrame:
    """J1/J2 for several keys of a table: ``keys`` are (rule, columns, the
    columns that must be present: a NULL among them never collides).

    Every key is counted by its own columns, pre-aggregated per task: rows that are dealt by one of them (buckets) are counted
    in place, others travel as these columns alone."""
    found = []
    for rule, cols, needed in keys:
        held, parts = key_rows(df, cols, needed)
        twice = held.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        found.append(key_report(_dealt(twice, parts), rule, table, parts, "_n"))
    return union_all(*found)


def _dealt(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """The few rows ``found``, dealt anew: where tables hold the same keys (a plan's sets and the log's), Spark counts them in one stage
    and reads what that stage found for each of them."""
    return found.repartition(F.xxhash64(*key))


def _present(needed: Sequence[Column]) -> Column:
    return functools.reduce(lambda x, y: x & y, [c.isNotNull() for c in needed])


def duplicate_keys(df: DataFrame, cols: Sequence[str], table: str = "", rule: str = "unique") -> DataFrame:
    """Key values held by more than one row; a NULL part never collides."""
    return repeated_keys(df, [(rule, [F.col(c) for c in cols], [F.col(c) for c in cols])], table)


def duplicate_lower_names(df: DataFrame, owner: str | None, name: str, table: str = "") -> DataFrame:
    """(owner, LOWER(name)) held by more than one row; NULL names are free."""
    return repeated_keys(df, [("unique_lower", [*([F.col(owner)] if owner else []), F.lower(name)], [F.col(name)])], table)


def _lower_names(m: Model) -> list[DataFrame]:
    return [duplicate_lower_names(m[t], owner, name, t) for t, owner, name in S.UNIQUE_LOWER]


def lower_names(m: Model) -> DataFrame:
    """J2 over all tables."""
    return union_all(*_lower_names(m))


def _unique_keys(m: Model, without: Collection[tuple[str, tuple[str, ...]]] = ()) -> list[DataFrame]:
    """J1 of every primary and unique key; ``without``: (table, columns) of primary keys that are counted elsewhere."""
    keys = [("primary_key", t, cols) for t, cols in S.PRIMARY_KEYS.items() if (t, cols) not in without] + [("unique", t, cols) for t, cols in S.UNIQUE]
    return [duplicate_keys(m[t], cols, t, rule) for rule, t, cols in keys]


def unique_keys(m: Model) -> DataFrame:
    """J1 over all tables: primary and unique keys."""
    return union_all(*_unique_keys(m))


def dangling_references(child: DataFrame, col: str, parent: DataFrame, parent_col: str,
                        table: str = "") -> DataFrame:
    """Non-NULL references without a parent row."""
    p = parent.select(F.col(parent_col).alias("_pk")).distinct()
    miss = child.filter(F.col(col).isNotNull()).join(p, F.col(col) == F.col("_pk"), "left_anti")
    return _report(miss, "foreign_key", table, F.col(col).cast("string"), F.lit(col))


def reference_rules(m: Model) -> list[tuple[str, str, list[tuple[str, str]], T.DataType]]:
    """Of each referenced key: table, column, the (table, column) pairs that refer to it, type."""
    parents: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for t, col, pt, pcol, _ in S.FOREIGN_KEYS:
        parents.setdefault((pt, pcol), []).append((t, col))
    return [(pt, pcol, children, m[pt].schema[pcol].dataType) for (pt, pcol), children in parents.items()]


def _entries(table: str, rules: list[tuple]) -> list[tuple[int, int, str, T.DataType]]:
    """The keys of ``table``: (number of the parent, place of the reference or -1 for the own key, column, type)."""
    return [(p, place, col, kind) for p, (pt, pcol, children, kind) in enumerate(rules)
            for place, (t, col) in enumerate([(pt, pcol), *children], -1) if t == table]


def reference_entries(df: DataFrame, table: str, rules: list[tuple], wanted: set | None = None, *keep: str) -> DataFrame:
    """(parent, number, text, place) for the own keys and references of the rows of ``table``, cast to the parent's
    key type; whole numbers and texts have columns of their own. ``wanted``: only these parents or (parent, place)
    pairs. One scan."""
    found = []
    for p, place, col, kind in _entries(table, rules):
        if wanted is None or p in wanted or (p, place) in wanted:
            key = f"CAST(`{col}` AS {kind.simpleString()})"
            whole = isinstance(kind, T.IntegralType)
            number, text = (f"CAST({key} AS BIGINT)", "CAST(NULL AS STRING)") if whole else ("CAST(NULL AS BIGINT)", f"CAST({key} AS STRING)")
            found.append(f"IF(`{col}` IS NULL, NULL, named_struct('parent', {p}, 'number', {number}, 'text', {text}, 'place', {place}))")
    return df.selectExpr(f"inline(array({', '.join(found)}))", *keep).filter("parent IS NOT NULL")


def refers(table: str, rules: list[tuple], parents: set[int]) -> bool:
    """Whether ``table`` holds a key or a reference of one of ``parents``."""
    return any(p in parents for p, *_ in _entries(table, rules))


def key_type(kind: T.DataType) -> T.DataType:
    """The type by which references of a key of type ``kind`` meet: whole numbers and texts are equal as their texts are."""
    return kind if isinstance(kind, (T.IntegralType, T.StringType)) else T.StringType()


def reference_rows(m: Model, rule: tuple, places: Collection[int] | None = None) -> dict[int, DataFrame]:
    """Of one referenced key (as of ``reference_rules``): ``key`` of every row that holds it, by place: -1 the parent's own, 0, 1, ... the
    children's references. ``places``: only these."""
    pt, pcol, children, kind = rule
    return {place: m[t].filter(F.col(col).isNotNull()).select(F.col(col).cast(kind).cast(key_type(kind)).alias("key"))
            for place, (t, col) in enumerate([(pt, pcol), *children], -1) if places is None or place in places}


def reference_counts(m: Model, rule: tuple) -> DataFrame:
    """Of one referenced key: ``key``, the rows ``own`` of the parent that hold it, the rows ``n0``, ``n1``, ... of the children that
    refer to it. Every table gives this one column in its own type, and rows are summed up per task before they meet."""
    rows = reference_rows(m, rule)
    names = {place: f"n{place}" if place >= 0 else "own" for place in rows}
    return (union_all(*[df.withColumn("place", F.lit(place)) for place, df in rows.items()])
            .groupBy("key").agg(*[F.expr(f"count_if(place = {place}) AS {name}") for place, name in names.items()]))


def _references(m: Model, primary_keys: bool = False) -> list[DataFrame]:
    """J3 of every referenced key: a key with references that no row of the parent claims is dangling, one row per
    dangling child row. ``primary_keys``: also J1 of the referenced primary keys, from the same counts."""
    found = []
    for rule in reference_rules(m):
        pt, pcol, children, _ = rule
        unique = primary_keys and S.PRIMARY_KEYS[pt] == (pcol,)
        entries = [f"named_struct('rule', 'foreign_key', 'table', '{t}', 'detail', '{col}', 'n', IF(own = 0, n{k}, 0L))" for k, (t, col) in enumerate(children)]
        entries += [f"named_struct('rule', 'primary_key', 'table', '{pt}', 'detail', CAST(own AS STRING), 'n', IF(own > 1, 1L, 0L))"] if unique else []
        broken = _dealt(reference_counts(m, rule).filter("own <> 1" if unique else "own = 0"), ["key"])           # the few keys that get entries
        told = broken.selectExpr("CAST(key AS STRING) AS key", f"inline(array({', '.join(entries)}))").filter("n > 0")
        found.append(told.select("rule", "table", "key", "detail", F.explode(F.expr("sequence(1L, n)")).alias("_i")).drop("_i"))
    return found


def all_dangling_references(m: Model) -> DataFrame:
    """J3 for every declared foreign key."""
    return union_all(*_references(m))


def row_rules(df: DataFrame, checks: Sequence[tuple] = (), not_null: Sequence[str] = (), table: str = "") -> DataFrame:
    """J4 and J5 of a table in one scan: ``checks`` are (column, operator, bound), where
    NULL passes; ``not_null`` columns are reported with the row's id as key."""
    row_id = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")

    def entry(bad: Column, rule: str, key: Column, detail: str) -> Column:
        return F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(table).alias("table"), key.alias("key"), F.lit(detail).alias("detail")))

    found = [(~F.expr(f"`{c}` {op} {bound}"), "check", F.col(c).cast("string"), f"{c} {op} {bound}") for c, op, bound in checks]
    found += [(F.col(c).isNull(), "not_null", row_id, c) for c in not_null]
    if not found:
        return df.select(*[F.lit(None).cast("string").alias(c) for c in REPORT_COLUMNS]).limit(0)
    broken = df.filter(functools.reduce(lambda x, y: x | y, [bad for bad, *_ in found]))             # the few rows that get entries
    return broken.select(F.explode(F.array(*[entry(*f) for f in found])).alias("x")).filter("x IS NOT NULL").select("x.*")


def failed_checks(df: DataFrame, col: str, op: str, bound, table: str = "") -> DataFrame:
    """CHECK (col op bound) is false; NULL passes."""
    return row_rules(df, checks=[(col, op, bound)], table=table)


def null_values(df: DataFrame, col: str, table: str = "") -> DataFrame:
    """NOT NULL columns holding NULL (key: the row's id when present)."""
    return row_rules(df, not_null=[col], table=table)


def row_violations(m: Model, rules: str = "check,not_null") -> DataFrame:
    """J4 and J5 over all tables, one scan per table."""
    parts = []
    for t in S.TABLES:
        checks = [(c, op, bound) for u, c, op, bound in S.CHECKS if u == t and "check" in rules.split(",")]
        not_null = [c for u, c in S.NOT_NULL if u == t and "not_null" in rules.split(",")]
        if checks or not_null:
            parts.append(row_rules(m[t], checks, not_null, t))
    return union_all(*parts)


def model_violations(m: Model, apart: bool = False) -> DataFrame:
    """J1-J5 over all tables, from the rules declared in ``schema``. A primary key that others refer to is counted once for both rules.
    ``apart``: every key is counted by itself and its report rows are stored, so that the disk holds the shuffle files of one key at a time."""
    referenced = {(pt, (pcol,)) for pt, pcol, *_ in reference_rules(m)}
    parts = [*_unique_keys(m, referenced), *_lower_names(m), *_references(m, primary_keys=True), row_violations(m)]
    return stored(parts, "report") if apart else union_all(*parts)


# --- input rules (J6-J8, J11-J14) -----------------------------------------------------

def weight_problem(text: Column) -> Column:
    """A weight must be a number >= 0, a multiple of 0.5, within numeric(6,2)."""
    t = js_trim(text.cast("string"))
    num = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), t.try_cast("double"))
    dec = t.try_cast("decimal(6,2)")
    return (F.when(num.isNull() | (num < 0), F.lit("weight:not_a_number"))
            .when((num * 2) != F.floor(num * 2), F.lit("weight:not_a_half_step"))
            .when(dec.isNull(), F.lit("weight:out_of_range")))


def reps_problem(text: Column, minimum: int = 0) -> Column:
    """Reps done: integer >= 0; rep goal (``minimum=1``): integer >= 1."""
    n = to_int(text.cast("string"))
    return F.when(n.isNull() | (n < minimum),
                  F.lit(f"reps:not_an_integer_from_{minimum}"))


def name_problem(name: Column, max_len: int | None = None) -> Column:
    """Trimmed name of length 1..max_len made of letters, digits, ( ) + - and space."""
    limit = max_len or S.NAME_MAX
    t = js_trim(name)
    return (F.when(t.isNull() | (F.length(t) == 0), F.lit("name:empty"))
            .when(F.length(t) > limit, F.lit("name:too_long"))
            .when(~t.rlike(S.NAME_PATTERN), F.lit("name:bad_character")))


def name_violations(df: DataFrame, name: str, key: str, table: str = "",
                    max_len: int | None = None) -> DataFrame:
    """J8 as a report over a name column."""
    x = df.withColumn("_p", name_problem(F.col(name), max_len)).filter(F.col("_p").isNotNull())
    return _report(x, "name", table, F.col(key).cast("string"), F.col("_p"))


def multiple_drafts(m: Model) -> DataFrame:
    """Users with more than one incomplete routine."""
    d = (m.setup_routines.filter(~F.col("routine_created")).groupBy("user_id")
         .agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    return _report(d, "one_draft", "setup_routines", F.col("user_id").cast("string"), F.col("_n"))


def multiple_open_workouts(m: Model) -> DataFrame:
    """Users with more than one open workout (starting twice leaves two open
    snapshots whose sets later reads interleave, D6); detail = how many."""
    d = (m.track_routines.filter(F.col("in_progress")).groupBy("user_id")
         .agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    return _report(d, "one_open_workout", "track_routines", F.col("user_id").cast("string"), F.col("_n"))


def set_log_problem(weight: Column, reps: Column) -> Column:
    """J12 + J6 + J7: a logged set needs both values, each valid."""
    w = js_trim(weight.cast("string"))
    r = js_trim(reps.cast("string"))
    missing = w.isNull() | (w == "") | r.isNull() | (r == "")
    return F.when(missing, F.lit("set:incomplete")) \
        .otherwise(F.coalesce(weight_problem(weight), reps_problem(reps, 0)))


def validated_set_log(events: DataFrame) -> DataFrame:
    """J6/J7/J12 on set logs (weight_text, reps_text): ``problem`` (NULL: accepted) and,
    for accepted ones, typed ``weight`` and ``reps_done``."""
    e = events.withColumn("problem", set_log_problem(F.col("weight_text"), F.col("reps_text")))
    return (e.withColumn("weight", F.when(F.col("problem").isNull(), to_weight(F.col("weight_text"))))
            .withColumn("reps_done", F.when(F.col("problem").isNull(), to_int(F.col("reps_text")))))


def exercise_choice_problem(m: Model, requests: DataFrame) -> DataFrame:
    """Requests (request_id, user_id, exercise_name): the choice must be
    non-empty and name one of the user's exercises (exact name, as B5)."""
    ce = m.custom_exercises.select("user_id", F.col("name").alias("exercise_name"), F.lit(True).alias("_k"))
    known = ce.groupBy("user_id", "exercise_name").agg(F.max("_k").alias("_k"))
    r = requests.join(known, ["user_id", "exercise_name"], "left")
    reason = (F.when(F.col("exercise_name").isNull() | (js_trim("exercise_name") == ""),
                     F.lit("no exercise chosen"))
              .when(F.col("_k").isNull(), F.lit("unknown exercise")))
    return r.select("request_id", "user_id", "exercise_name", reason.alias("reason"))


def empty_routines(m: Model) -> DataFrame:
    """Routines without a day or without a session (cannot be saved)."""
    days = m.setup_days.groupBy(F.col("setup_routine_id").alias("id")).agg(F.count(F.lit(1)).alias("_d"))
    ses = m.setup_sessions.groupBy(F.col("setup_routine_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_s"))
    j = m.setup_routines.select("id").join(days, "id", "left").join(ses, "id", "left")
    bad = j.filter(F.col("_d").isNull() | F.col("_s").isNull())
    detail = F.when(F.col("_d").isNull() & F.col("_s").isNull(), "no day and no session") \
        .when(F.col("_d").isNull(), "no day").otherwise("no session")
    return _report(bad, "day_and_session", "setup_routines", F.col("id").cast("string"), detail)
