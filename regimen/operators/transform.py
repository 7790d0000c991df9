"""State transitions (I1-I21) as batch table transforms.

Each function takes the current tables and a request DataFrame and returns
new versions of the tables it changes (a dict ``table -> DataFrame``, or one
DataFrame). Writing them is ``TableStore.commit``; nothing is edited in place.

Request batches: requests carry ``request_id`` and a total order ``seq``
(arrival order). Against one parent, deletes refer to the ordinals *before*
the batch, appends follow ``seq``, and updates keep the last ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimen.functions.keys import det_id
from regimen.operators.lookup import logged_exercise_ids, session_ids
from regimen.operators.nesting import count_days
from regimen.operators.ordinal import count_before, groups_bounded, hot_rows, join_null_safe, largest_group, ordinal
from regimen.operators.outline import active_slots, exercise_sets_of, setup_levels, slot_sessions, track_levels
from regimen.session import checkpoint_dir
from regimen.sources import schema as S
from regimen.sources.levels import shuffles_removed, stored
from regimen.sources.tables import Model

TRACK_TABLES = ("track_routines", "track_days", "track_sessions", "track_days_sessions",
                "track_session_exercises", "track_exercise_details")


def _lit_null(t: str) -> Column:
    return F.lit(None).cast(t)


# --- I15 / I16 / I17 / I21: the day cursor --------------------------------------------

def read_cursor(m: Model) -> DataFrame:
    """Current (routine, day number, session number) of every user."""
    return m.users_current_details.select(
        "user_id", F.col("current_routine_id").alias("routine_id"),
        F.col("current_day_number").alias("day_number"),
        F.col("current_session_number").alias("session_number"))


def advance_cursor(m: Model, users: DataFrame) -> DataFrame:
    """Move the cursor of the requested users (``user_id``, ``routine_id``) one
    day on, wrapping to day 1 after the last (the day count, not the max number).

    Only a cursor that points at the requested routine moves. Returns the new
    ``users_current_details``.
    """
    n = count_days(m)
    req = (users.select(F.col("user_id"), F.col("routine_id").alias("current_routine_id"))
           .distinct().withColumn("_hit", F.lit(True)))
    n = n.withColumnRenamed("routine_id", "current_routine_id")
    moved = (m.users_current_details.join(req, ["user_id", "current_routine_id"], "left")
             .join(n, "current_routine_id", "left"))
    nxt = F.when(F.col("current_day_number") < F.col("total_days"),
                 F.col("current_day_number") + 1).otherwise(F.lit(1))
    return moved.select(
        "user_id", "current_routine_id",
        F.when(F.col("_hit").isNotNull(), nxt).otherwise(F.col("current_day_number"))
        .cast("int").alias("current_day_number"),
        "current_session_number")


def next_training_day(m: Model) -> DataFrame:
    """I16: for every user with a current routine, the first day from the cursor
    on (wrapping) whose slot has an exercise with order 1.

    No loop: next = the cursor day if active, else the smallest active day in
    (cursor, day count], else the smallest active day <= day count. The
    successor is found without pairing cursors with days: ``count_before``
    gives the number of active days <= cursor, and the successor is the active
    day with the next ordinal (an equi-join). NULL when no active day is
    reachable (the reference would loop forever).
    """
    cur = (read_cursor(m).filter(F.col("routine_id").isNotNull())
           .withColumnRenamed("session_number", "session_order"))
    act = active_slots(m)                                   # routine_id, day_number, session_order
    n = count_days(m)
    reach = (act.join(n, "routine_id").filter(F.col("day_number") <= F.col("total_days"))
             .drop("total_days"))
    keys = ["routine_id", "session_order"]
    # cursors on a routine and days of it, both counted on their base tables
    bounded = (largest_group(m.users_current_details.filter("current_routine_id IS NOT NULL"), ["current_routine_id"])
               + largest_group(m.setup_days, ["setup_routine_id"])) <= hot_rows(m.setup_days.sparkSession)
    if bounded:
        return _next_day_windows(cur, act, n, keys)
    reach = ordinal(reach, keys, ["day_number"], "_a", bounded=bounded)
    before = count_before(cur.filter(F.col("day_number").isNotNull()), reach, keys,
                          "day_number", "user_id", "_n_le", inclusive=True, bounded=bounded)
    succ = reach.select(*keys, F.col("_a").alias("_succ_a"), F.col("day_number").alias("_succ"))
    first = reach.filter(F.col("_a") == 1).select(*keys, F.col("day_number").alias("_first"))
    here = act.select(*keys, "day_number", F.lit(True).alias("_here"))
    out = (cur.join(before.select("user_id", (F.col("_n_le") + 1).alias("_succ_a")), "user_id", "left")
           .join(here, keys + ["day_number"], "left")
           .join(succ, keys + ["_succ_a"], "left")
           .join(first, keys, "left"))
    nxt = F.coalesce(F.when(F.col("_here"), F.col("day_number")), F.col("_succ"), F.col("_first"))
    return out.select("user_id", "routine_id", F.col("day_number").alias("cursor_day"),
                      nxt.cast("int").alias("day_number"), "session_order")


def _next_day_windows(cur: DataFrame, act: DataFrame, n: DataFrame, keys: list[str]) -> DataFrame:
    """I16 when every (routine, slot) fits one task: cursors and active days in
    one frame, one exchange, three window functions.

    Ordered by (day, kind) with a cursor before an active day of the same
    number: the smallest active day from the cursor on tells whether the
    cursor day is active, the smallest reachable one is the successor, and the
    first reachable active day is the group min.
    """
    days = (act.join(n, "routine_id", "left")
            .select(*keys, F.col("day_number").alias("_d"), F.lit(1).alias("_kind"),
                    F.lit(None).cast(cur.schema["user_id"].dataType).alias("user_id"),
                    (F.col("day_number") <= F.col("total_days")).alias("_reach")))
    cursors = cur.select(*keys, F.col("day_number").alias("_d"), F.lit(0).alias("_kind"), "user_id",
                         F.lit(None).cast("boolean").alias("_reach"))
    active_day = F.when(F.col("_kind") == 1, F.col("_d"))
    reach_day = F.when((F.col("_kind") == 1) & F.col("_reach"), F.col("_d"))
    order = Window.partitionBy(*keys).orderBy(F.col("_d").asc_nulls_first(), "_kind")
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = (cursors.unionByName(days)
         .withColumn("_next_active", F.min(active_day).over(after))
         .withColumn("_succ", F.min(reach_day).over(after))
         .withColumn("_first", F.min(reach_day).over(Window.partitionBy(*keys)))
         .filter(F.col("_kind") == 0))
    # rows after a cursor all sort at or above its day: the next active day is
    # the cursor day exactly when that day is active
    here = F.col("_d").isNotNull() & (F.col("_next_active") == F.col("_d"))
    nxt = F.coalesce(F.when(here, F.col("_d")), F.when(F.col("_d").isNotNull(), F.col("_succ")),
                     F.col("_first"))
    return x.select("user_id", "routine_id", F.col("_d").alias("cursor_day"),
                    nxt.cast("int").alias("day_number"), "session_order")


def whats_next(m: Model) -> DataFrame:
    """Routine name, next training day and its session name, for every user."""
    names = m.setup_routines.select(F.col("id").alias("routine_id"), F.col("name").alias("routine_name"))
    return (next_training_day(m).join(names, "routine_id", "left")
            .join(slot_sessions(m).drop("session_id"), ["routine_id", "day_number", "session_order"],
                  "left")
            .select("user_id", "routine_id", "routine_name", "day_number", "session_name"))


def select_routine(m: Model, requests: DataFrame) -> DataFrame:
    """Requests (user_id, routine_name) set the current routine; the cursor
    resets to day 1 / session 1 only if the routine changed. Unknown names
    change nothing. Several requests of one user: the last ``seq`` wins.
    """
    last = (requests.groupBy("user_id").agg(F.max_by("routine_name", "seq").alias("routine_name"))
            if "seq" in requests.columns else requests)
    routines = m.setup_routines.select(F.col("user_id"), F.col("name").alias("routine_name"),
                                       F.col("id").alias("_new"))
    resolved = last.join(routines, ["user_id", "routine_name"]).select("user_id", "_new")
    ucd = m.users_current_details.join(resolved, "user_id", "left")
    changed = F.col("_new").isNotNull() & (
        F.col("current_routine_id").isNull() | (F.col("current_routine_id") != F.col("_new")))
    return ucd.select(
        "user_id",
        F.when(changed, F.col("_new")).otherwise(F.col("current_routine_id")).alias("current_routine_id"),
        F.when(changed, F.lit(1)).otherwise(F.col("current_day_number")).cast("int")
        .alias("current_day_number"),
        F.when(changed, F.lit(1)).otherwise(F.col("current_session_number")).cast("int")
        .alias("current_session_number"))


# --- I1 / I2 / I3: snapshot a plan into the log ----------------------------------------

def snapshot(m: Model, requests: DataFrame, run: str, whole_routine: bool = False
             ) -> dict[str, DataFrame]:
    """I1 (one day) / I2 (whole routine): copy the plan into the six log tables.

    ``requests``: request_id, user_id, routine_name [, day_number, session_name].
    New id = sha2(run | entity | request_id | source id): each table is an
    independent projection and a retry writes the same rows. ``reps_done``
    stays NULL; ``setup_id`` keeps the lineage (see ``clear_lineage``).
    """
    lv = setup_levels(m)
    named = [] if whole_routine else ["day_number", "session_name"]
    spark = m.setup_routines.sparkSession
    checkpoint_dir(spark)
    with shuffles_removed(spark):
        rows = _snapshot_walk(lv, exercise_sets_of(m, "plan_sets"), requests.select("request_id", "user_id", "routine_name", *named), named)
    # one row per new log row, all tables together, computed once; the six tables are filters of it and read their own rows
    rows = stored(rows, "snapshot", "table")
    request = F.col("request_id")

    def new(entity: str, source: str) -> Column:
        return det_id(run, entity, request, F.col(source))

    def of(table: str) -> DataFrame:
        return rows.filter(F.col("table") == table)

    track_routines = of("routine").select(new("routine", "key").alias("id"), F.col("name"), "user_id", F.col("key").alias("setup_id"),
                                          F.lit(True).alias("in_progress"), _lit_null("timestamp").alias("completion_date"))
    track_days = of("day").select(new("day", "key").alias("id"), F.col("ordinal").alias("day_number"), new("routine", "parent").alias("track_routine_id"),
                                  F.col("key").alias("setup_id"))
    track_sessions = of("session").select(new("session", "key").alias("id"), new("routine", "parent").alias("track_routine_id"), "name",
                                          F.col("key").alias("setup_id"))
    track_days_sessions = of("slot").select(new("slot", "key").alias("id"), new("day", "parent").alias("day_id"),
                                            new("session", "parent2").alias("session_id"), F.col("ordinal").alias("session_order"))
    track_session_exercises = of("exercise").select(new("exercise", "key").alias("id"), new("session", "parent").alias("track_session_id"), "exercise.*",
                                                    F.col("key").alias("setup_id"))
    track_exercise_details = of("set").select(new("set", "key").alias("id"), new("exercise", "parent").alias("track_session_exercise_id"), "set.*",
                                              F.col("key").alias("setup_id"))
    return dict(track_routines=track_routines, track_days=track_days, track_sessions=track_sessions,
                track_days_sessions=track_days_sessions,
                track_session_exercises=track_session_exercises,
                track_exercise_details=track_exercise_details)


def _snapshot_walk(lv: dict[str, DataFrame], sets: DataFrame, requests: DataFrame, named: list[str]) -> DataFrame:
    """The rows of all six tables that the requests copy, as one frame: table, request_id, source key and parent keys
    as text, and the payload. ``named``: day_number and session_name, or nothing for whole routines."""
    def text(c: str) -> Column:
        return F.col(c).cast("string")

    def rows(df: DataFrame, table: str, key: str, parent: str | None = None, parent2: str | None = None, **payload: Column) -> DataFrame:
        found = {"user_id": F.lit(None).cast(dict(lv["routines"].dtypes)["user_id"]), "name": _lit_null("string"), "ordinal": _lit_null("int"),
                 "exercise": F.lit(None).cast(exercise_type), "set": F.lit(None).cast(set_type)} | payload
        return df.select(F.lit(table).alias("table"), "request_id", text(key).alias("key"), (text(parent) if parent else _lit_null("string")).alias("parent"),
                         (text(parent2) if parent2 else _lit_null("string")).alias("parent2"), *[c.alias(n) for n, c in found.items()])

    exercise = F.struct("exercise_id", "custom_exercise_id", "exercise_order", "exercise_comment")
    one_set = F.struct("weight", "cur_set", "reps_goal", _lit_null("int").alias("reps_done"), "myo_order")
    exercise_type = lv["exercises"].select(exercise.alias("x")).schema["x"].dataType
    set_type = sets.select(one_set.alias("x")).schema["x"].dataType
    routines = (requests.join(lv["routines"].select("routine_id", "routine_name", "user_id"), ["user_id", "routine_name"])).checkpoint()
    base = routines.select("request_id", "routine_id", *named)
    days = base.join(lv["days"], ["routine_id"] + named[:1]).select("request_id", "routine_id", "day_id", "day_number")
    sessions = (base.join(lv["sessions"].withColumnRenamed("session_routine_id", "routine_id"), ["routine_id"] + named[1:])
                .select("request_id", "routine_id", "session_id", "session_name")).checkpoint()
    slots = (days.join(lv["slots"], "day_id").join(sessions.select("request_id", "session_id"), ["request_id", "session_id"]))
    below = sessions.select("request_id", "session_id")
    return (rows(routines, "routine", "routine_id", user_id=F.col("user_id"), name=F.col("routine_name"))
            .unionByName(rows(days, "day", "day_id", "routine_id", ordinal=F.col("day_number")))
            .unionByName(rows(sessions, "session", "session_id", "routine_id", name=F.col("session_name")))
            .unionByName(rows(slots, "slot", "slot_id", "day_id", "session_id", ordinal=F.col("session_order")))
            .unionByName(rows(below.join(lv["exercises"], "session_id"), "exercise", "sse_id", "session_id", exercise=exercise))
            .unionByName(rows(below.join(sets, "session_id"), "set", "set_id", "sse_id", set=one_set)))


def append_snapshot(m: Model, new: dict[str, DataFrame]) -> Model:
    """Add snapshot rows to the log tables (new model; union, no shuffle).

    Keys whose types differ (source keys vs. hashed keys) are unioned as text.
    """
    out = {}
    for t, rows in new.items():
        old = m[t]
        types = dict(old.dtypes)
        cols = [c for c in old.columns]
        a = old.select(*[F.col(c).cast("string").alias(c) if c in rows.columns and dict(rows.dtypes)[c] != types[c]
                         else F.col(c) for c in cols])
        b = rows.select(*[F.col(c).cast(dict(a.dtypes)[c]).alias(c) if c in rows.columns
                          else F.lit(None).cast(dict(a.dtypes)[c]).alias(c) for c in cols])
        out[t] = a.unionByName(b)
    return m.replace(**out)


def clear_lineage(m: Model, users: DataFrame) -> dict[str, DataFrame]:
    """``setup_id := NULL`` on the users' snapshots that still have lineage,
    and on all rows below those routines."""
    tr = m.track_routines
    hit = (tr.join(users.select("user_id").distinct(), "user_id", "left_semi")
           .filter(F.col("setup_id").isNotNull()).select(F.col("id").alias("_rid"))
           .withColumn("_hit", F.lit(True)))

    def clear(df: DataFrame, key: str, hits: DataFrame) -> DataFrame:
        # only rows that have lineage meet the hits; the others stay where they are
        j = df.filter(F.col("setup_id").isNotNull()).join(hits.withColumnRenamed("_rid", key), key, "left")
        cleared = j.withColumn("setup_id", F.when(F.col("_hit"), None).otherwise(F.col("setup_id"))).drop("_hit")
        return df.filter(F.col("setup_id").isNull()).unionByName(cleared)

    new_tr = clear(tr, "id", hit)
    new_days = clear(m.track_days, "track_routine_id", hit)
    new_sessions = clear(m.track_sessions, "track_routine_id", hit)
    ses_hit = (m.track_sessions.join(hit.withColumnRenamed("_rid", "track_routine_id"),
                                     "track_routine_id")
               .select(F.col("id").alias("_rid"), "_hit"))
    new_ex = clear(m.track_session_exercises, "track_session_id", ses_hit)
    ex_hit = (m.track_session_exercises.join(ses_hit.withColumnRenamed("_rid", "track_session_id"),
                                             "track_session_id")
              .select(F.col("id").alias("_rid"), "_hit"))
    new_sets = clear(m.track_exercise_details, "track_session_exercise_id", ex_hit)
    cols = {t: m[t].columns for t in TRACK_TABLES}
    return dict(track_routines=new_tr.select(*cols["track_routines"]),
                track_days=new_days.select(*cols["track_days"]),
                track_sessions=new_sessions.select(*cols["track_sessions"]),
                track_session_exercises=new_ex.select(*cols["track_session_exercises"]),
                track_exercise_details=new_sets.select(*cols["track_exercise_details"]))


# --- I4 / I5 / I6: ordinal maintenance -------------------------------------------------

def append_children(children: DataFrame, parent: str, ordinal_col: str, requests: DataFrame,
                    base: str = "max", count_col: str | None = None) -> DataFrame:
    """I4: new child rows at the next ordinals of their parent.

    ``requests``: request_id, seq, ``parent`` (+ payload). Base per parent is
    ``COALESCE(MAX, 0)`` (``base='max'``) or ``COUNT`` (``'count'``, of
    ``count_col`` when given); several requests of one parent follow ``seq``.
    Returns the requests with ``ordinal_col`` filled in.
    """
    if base == "max":
        agg = F.coalesce(F.max(ordinal_col), F.lit(0))
    else:
        agg = F.count(count_col) if count_col else F.count(F.lit(1))
    start = children.groupBy(parent).agg(agg.alias("_base"))
    ranked = ordinal(requests, [parent], ["seq", "request_id"], "_k")
    return (ranked.join(start, parent, "left")
            .withColumn(ordinal_col, (F.coalesce("_base", F.lit(0)) + F.col("_k")).cast("int"))
            .drop("_base", "_k"))


def add_session_exercises(m: Model, requests: DataFrame, run: str) -> dict[str, DataFrame]:
    """I4 (plan): append exercises to sessions (MAX + 1) with their first set.

    ``requests``: request_id, seq, setup_session_id, custom_exercise_id.
    Returns the new rows of ``setup_session_exercises`` and ``setup_exercise_details``.
    """
    placed = append_children(m.setup_session_exercises, "setup_session_id", "exercise_order", requests)
    sse = placed.select(det_id(run, "exercise", "request_id").alias("id"), "setup_session_id",
                        _lit_null("long").alias("exercise_id"), "custom_exercise_id",
                        "exercise_order", _lit_null("string").alias("exercise_comment"))
    first = placed.select(det_id(run, "set", "request_id").alias("id"),
                          det_id(run, "exercise", "request_id").alias("setup_session_exercise_id"),
                          _lit_null("decimal(6,2)").alias("weight"), F.lit(1).alias("cur_set"),
                          _lit_null("int").alias("reps_goal"), _lit_null("int").alias("myo_order"))
    return dict(setup_session_exercises=sse, setup_exercise_details=first)


def add_days(m: Model, requests: DataFrame, run: str) -> DataFrame:
    """I4: append days to routines at day count + 1 (the reference counts days)."""
    placed = append_children(m.setup_days, "setup_routine_id", "day_number", requests, base="count")
    return placed.select(det_id(run, "day", "request_id").alias("id"), "day_number", "setup_routine_id")


def add_logged_sets(m: Model, requests: DataFrame, run: str) -> DataFrame:
    """I4 (log): a new set at ``COUNT(cur_set) + 1`` of a logged exercise."""
    placed = append_children(m.track_exercise_details, "track_session_exercise_id", "cur_set",
                             requests, base="count", count_col="cur_set")
    return placed.select(det_id(run, "set", "request_id").alias("id"), "track_session_exercise_id",
                         _lit_null("decimal(6,2)").alias("weight"), "cur_set",
                         _lit_null("int").alias("reps_goal"), _lit_null("int").alias("reps_done"),
                         _lit_null("int").alias("myo_order"), _lit_null("string").alias("setup_id"))


def add_logged_sets_by_order(m: Model, requests: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """I4 (log) by address: requests (request_id, seq, track_session_id, exercise_order) add a set to the exercise at that
    place (B7). Returns the new sets and the requests that name no exercise."""
    found = logged_exercise_ids(m, requests)
    known = F.col("track_session_exercise_id").isNotNull()
    new = add_logged_sets(m, found.filter(known).select("request_id", "seq", "track_session_exercise_id"), run)
    return new, found.filter(~known).select("request_id", F.lit("unknown exercise").alias("reason"))


def add_planned_sets(m: Model, requests: DataFrame, run: str) -> DataFrame:
    """I4 (plan): a new set at ``COALESCE(MAX(cur_set), 0) + 1`` of a planned exercise."""
    placed = append_children(m.setup_exercise_details, "setup_session_exercise_id", "cur_set", requests)
    return placed.select(det_id(run, "set", "request_id").alias("id"), "setup_session_exercise_id",
                         _lit_null("decimal(6,2)").alias("weight"), "cur_set", _lit_null("int").alias("reps_goal"),
                         _lit_null("int").alias("myo_order"))


def add_logged_exercises(m: Model, requests: DataFrame, run: str) -> dict[str, DataFrame]:
    """I4 (log): append exercises to an open workout's session at ``COUNT + 1``, with their first set.

    ``requests``: request_id, seq, track_session_id, custom_exercise_id."""
    placed = append_children(m.track_session_exercises, "track_session_id", "exercise_order", requests, base="count")
    exercise = det_id(run, "exercise", "request_id")
    rows = placed.select(exercise.alias("id"), "track_session_id", _lit_null("long").alias("exercise_id"),
                         "custom_exercise_id", "exercise_order", _lit_null("string").alias("exercise_comment"),
                         _lit_null("string").alias("setup_id"))
    first = placed.select(det_id(run, "set", "request_id").alias("id"), exercise.alias("track_session_exercise_id"),
                          _lit_null("decimal(6,2)").alias("weight"), F.lit(1).alias("cur_set"), _lit_null("int").alias("reps_goal"),
                          _lit_null("int").alias("reps_done"), _lit_null("int").alias("myo_order"), _lit_null("string").alias("setup_id"))
    return dict(track_session_exercises=rows, track_exercise_details=first)


def delete_and_shift(children: DataFrame, parent: str, ordinal_col: str,
                     deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete the n-th children and close the gaps.

    ``deletes``: ``parent``, ``ordinal_col`` (ordinals before the batch).
    new ordinal = old - (number of deletes of the parent below it); only
    deletes that hit a row count. Returns (kept rows renumbered, deleted rows).
    """
    hits = deletes.select(parent, ordinal_col).dropna().distinct()
    if 2 * largest_group(children, [parent]) <= hot_rows(children.sparkSession):
        return _delete_frame(children, parent, ordinal_col, hits)
    hits = hits.join(children.select(parent, ordinal_col), [parent, ordinal_col], "left_semi")
    removed = children.join(hits, [parent, ordinal_col], "left_semi")
    kept = children.join(hits, [parent, ordinal_col], "left_anti")
    counted = count_before(kept, hits, [parent], ordinal_col, "id", "_below", bounded=False)
    kept = counted.withColumn(ordinal_col, (F.col(ordinal_col) - F.col("_below")).cast("int")).drop("_below")
    return kept.select(*children.columns), removed.select(*children.columns)


def _delete_frame(children: DataFrame, parent: str, ordinal_col: str, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I5 when every parent fits one task: children (as structs) and deletes in one
    frame, one hash exchange on the parent, a running count of the deletes below."""
    kids = children.select(F.col(parent).alias("_p"), F.col(ordinal_col).alias("_o"), F.lit(0).alias("_k"),
                           F.struct(*children.columns).alias("_row"))
    cuts = hits.select(F.col(parent).alias("_p"), F.col(ordinal_col).alias("_o"), F.lit(1).alias("_k"),
                       F.lit(None).cast(kids.schema["_row"].dataType).alias("_row"))
    here = Window.partitionBy("_p", "_o")
    below = Window.partitionBy("_p").orderBy("_o", "_k").rowsBetween(Window.unboundedPreceding, -1)
    x = (kids.unionByName(cuts).repartition("_p")
         .withColumn("_cut", F.max("_k").over(here) == 1)
         .withColumn("_hit", F.when((F.col("_k") == 1) & (F.min("_k").over(here) == 0), 1).otherwise(0))
         .withColumn("_below", F.coalesce(F.sum("_hit").over(below), F.lit(0))).filter("_k = 0"))
    shifted = (F.col(f"_row.{ordinal_col}") - F.col("_below")).cast("int").alias(ordinal_col)
    kept = x.filter(~F.col("_cut")).select(*[shifted if c == ordinal_col else F.col(f"_row.{c}").alias(c) for c in children.columns])
    return kept, x.filter("_cut").select("_row.*")


def delete_days(m: Model, deletes: DataFrame) -> dict[str, DataFrame]:
    """I5 (days): delete days (routine_id, day_number), cascade their slots, shift later days."""
    d = deletes.select(F.col("routine_id").alias("setup_routine_id"), "day_number")
    days, removed = delete_and_shift(m.setup_days, "setup_routine_id", "day_number", d)
    slots = m.setup_days_sessions.join(removed.select(F.col("id").alias("day_id")), "day_id", "left_anti")
    return dict(setup_days=days, setup_days_sessions=slots)


def delete_session_exercises(m: Model, deletes: DataFrame) -> dict[str, DataFrame]:
    """I5 (exercises): delete (session_id, exercise_order), cascade sets, shift."""
    d = deletes.select(F.col("session_id").alias("setup_session_id"), "exercise_order")
    ex, removed = delete_and_shift(m.setup_session_exercises, "setup_session_id", "exercise_order", d)
    sets = m.setup_exercise_details.join(
        removed.select(F.col("id").alias("setup_session_exercise_id")), "setup_session_exercise_id",
        "left_anti")
    return dict(setup_session_exercises=ex, setup_exercise_details=sets)


def _reorder_bounded(children: DataFrame, parent: str, requests: DataFrame) -> bool:
    spark = children.sparkSession
    if hot_rows(spark) == 0:
        return False
    return groups_bounded(children.select(parent).unionByName(requests.select(parent)), [parent])


def _reorder_frame(children: DataFrame, parent: str, ordinal_col: str, requests: DataFrame) -> DataFrame:
    """Children and requests of a parent in one frame, every check a window
    aggregate: one hash exchange on the parent (it clusters (parent, order)
    too). Child rows carry their row as a struct and the new ordinal."""
    new_int = F.col("new_order").cast("string").try_cast("int")
    row_type = F.struct(*children.columns)
    kids = children.select(parent, F.col(ordinal_col).alias("_o"), F.lit(0).alias("_k"),
                           row_type.alias("_row"), F.lit(None).cast("int").alias("_new"))
    reqs = requests.select(parent, F.col("old_order").cast("string").try_cast("int").alias("_o"),
                           F.lit(1).alias("_k"), F.lit(None).cast(kids.schema["_row"].dataType).alias("_row"),
                           new_int.alias("_new"))
    by_parent = Window.partitionBy(parent)
    by_old = Window.partitionBy(parent, "_o")
    by_new = Window.partitionBy(parent, "_new")
    is_req = F.col("_k") == 1
    x = (kids.unionByName(reqs)
         .withColumn("n", F.sum(1 - F.col("_k")).over(by_parent))
         .withColumn("listed", F.sum("_k").over(by_parent))
         .withColumn("_ints", F.sum(F.when(is_req & F.col("_new").isNotNull(), 1).otherwise(0)).over(by_parent))
         .withColumn("_lo", F.min("_new").over(by_parent))
         .withColumn("_hi", F.max("_new").over(by_parent))
         .withColumn("_same_new", F.sum(F.when(is_req & F.col("_new").isNotNull(), 1).otherwise(0)).over(by_new))
         .withColumn("_kids_at_old", F.sum(1 - F.col("_k")).over(by_old))
         .withColumn("_reqs_at_old", F.sum("_k").over(by_old))
         .withColumn("_target", F.max(F.when(is_req, F.col("_new"))).over(by_old)))
    dup_new = F.max(F.when(is_req & (F.col("_same_new") > 1), 1).otherwise(0)).over(by_parent) > 0
    bad_old = F.max(F.when(is_req & ((F.col("_kids_at_old") == 0) | (F.col("_reqs_at_old") > 1)), 1)
                    .otherwise(0)).over(by_parent) > 0
    reason = (F.when(F.col("listed") == 0, F.lit(None))
              .when(F.col("_ints") < F.col("listed"), "not an integer")
              .when(dup_new, "duplicate order")
              .when((F.col("_lo") < 1) | (F.col("_hi") > F.col("n")), "order out of range")
              .when(bad_old, "unknown exercise")
              .when(F.col("listed") != F.col("n"), "incomplete permutation"))
    return x.withColumn("reason", reason)


def _reorder_report(frame: DataFrame, parent: str) -> DataFrame:
    x = frame.filter(F.col("_k") == 1)
    return x.groupBy(parent).agg(F.first("listed").cast("long").alias("listed"),
                                 F.first("n").cast("long").alias("n"), F.first("reason").alias("reason"))


def reorder_check(children: DataFrame, parent: str, ordinal_col: str,
                  requests: DataFrame) -> DataFrame:
    """Per parent, is the request (old -> new) a permutation of 1..n?

    ``requests``: ``parent``, old_order, new_order (text or int). Valid when
    every new order is an integer, in 1..n, no duplicates, every old order
    exists, and all n children are listed (n = children of the parent).
    """
    if _reorder_bounded(children, parent, requests):
        return _reorder_report(_reorder_frame(children, parent, ordinal_col, requests), parent)
    n = children.groupBy(parent).agg(F.count(F.lit(1)).alias("n"))
    new_int = F.col("new_order").cast("string").try_cast("int")
    # as in the window plan, NULL is a parent and an order like any other, and children that share an order are one place
    exists = children.select(parent, F.col(ordinal_col).alias("old_order")).distinct().withColumn("_e", F.lit(True))
    r = join_null_safe(requests.withColumn("_new", new_int)
                       .withColumn("old_order", F.col("old_order").cast("string").try_cast("int")),
                       exists, [parent, "old_order"], "left")
    agg = r.groupBy(parent).agg(
        F.count(F.lit(1)).alias("listed"),
        F.count("_new").alias("integers"),
        F.countDistinct("_new").alias("distinct_new"),
        F.min("_new").alias("min_new"), F.max("_new").alias("max_new"),
        F.count("_e").alias("existing"),
        (F.countDistinct("old_order") + F.max(F.col("old_order").isNull().cast("int"))).alias("distinct_old"))
    j = join_null_safe(agg, n, [parent], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = (F.when(F.col("integers") < F.col("listed"), "not an integer")
              .when(F.col("distinct_new") < F.col("listed"), "duplicate order")
              .when((F.col("min_new") < 1) | (F.col("max_new") > F.col("n")), "order out of range")
              .when((F.col("existing") < F.col("listed")) | (F.col("distinct_old") < F.col("listed")),
                    "unknown exercise")
              .when(F.col("listed") != F.col("n"), "incomplete permutation"))
    return j.select(parent, F.col("listed").cast("long").alias("listed"),
                    F.col("n").cast("long").alias("n"), reason.alias("reason"))


def reorder(children: DataFrame, parent: str, ordinal_col: str,
            requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply valid permutations (one pass, no +/-1000 trick).

    Returns (children with new ordinals, J9 report of every requested parent).
    """
    if _reorder_bounded(children, parent, requests):
        x = _reorder_frame(children, parent, ordinal_col, requests)
        kids = x.filter(F.col("_k") == 0)
        moved = F.when((F.col("listed") > 0) & F.col("reason").isNull(), F.col("_target"))
        out = kids.select(*[F.coalesce(moved, F.col(f"_row.{c}")).cast("int").alias(c) if c == ordinal_col
                            else F.col(f"_row.{c}").alias(c) for c in children.columns])
        return out, _reorder_report(x, parent)
    report = reorder_check(children, parent, ordinal_col, requests)
    valid = report.filter(F.col("reason").isNull()).select(parent)
    mapping = (join_null_safe(requests, valid, [parent], "left_semi")
               .select(parent, F.col("old_order").cast("string").try_cast("int").alias(ordinal_col),
                       F.col("new_order").cast("string").try_cast("int").alias("_new")))
    out = (join_null_safe(children, mapping, [parent, ordinal_col], "left")
           .withColumn(ordinal_col, F.coalesce("_new", ordinal_col).cast("int")).drop("_new"))
    return out.select(*children.columns), report


# --- I7 / I8 / I9 / I10: updates ---------------------------------------------------------

def assign_sessions(m: Model, requests: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Requests (request_id, seq, routine_id, day_number, slot, session_name).

    Existing (day, slot) -> the slot points to the named session; otherwise a
    new slot at ``MAX(session_order) + 1`` of the day (the requested slot
    number is not used for inserts, as in the reference). Unknown session
    names or days are reported (J10) and the valid rows still apply.
    Returns (new setup_days_sessions, rejected requests with reason).
    """
    lv = setup_levels(m)
    ses = lv["sessions"].select(F.col("session_routine_id").alias("routine_id"), "session_name",
                                "session_id")
    r = (requests.join(lv["days"].select("routine_id", "day_number", "day_id"),
                       ["routine_id", "day_number"], "left")
         .join(ses, ["routine_id", "session_name"], "left"))
    reason = (F.when(F.col("session_name").isNull() | (F.trim("session_name") == ""), "no session name")
              .when(F.col("session_id").isNull(), "unknown session")
              .when(F.col("day_id").isNull(), "unknown day"))
    r = r.withColumn("reason", reason)
    rejected = r.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    ok = r.filter(F.col("reason").isNull())
    # last request per (day, slot) wins; equal seq: the larger request id
    ok = (ok.groupBy("day_id", "slot").agg(F.max_by(F.struct("request_id", "seq", "session_id"), F.struct("seq", "request_id")).alias("v"))
          .select("day_id", "slot", "v.*"))
    slots = m.setup_days_sessions
    upd = ok.select("day_id", F.col("slot").alias("session_order"), F.col("session_id").alias("_new"))
    updated = (slots.join(upd, ["day_id", "session_order"], "left")
               .withColumn("session_id", F.coalesce("_new", "session_id")).drop("_new"))
    inserts = ok.join(slots.select("day_id", F.col("session_order").alias("slot")),
                      ["day_id", "slot"], "left_anti")
    placed = append_children(slots, "day_id", "session_order", inserts)
    new_rows = placed.select(det_id(run, "slot", "request_id").alias("id"), "day_id", "session_id",
                             "session_order")
    kept = updated.select(*slots.columns).withColumn("id", F.col("id").cast("string"))
    return kept.unionByName(new_rows), rejected


TARGET_KEYS = ["user_id", "routine_name", "day_number", "session_name", "exercise_order", "set_number"]


def open_set_index(m: Model, users: DataFrame | None = None) -> DataFrame:
    """Logged sets of open workouts (slot 1) by their natural address: the
    targets of I8. Only in-progress workouts, so it is a small part of the log;
    only those of ``users`` (user_id), if given."""
    lv = track_levels(m)
    opened = lv["routines"].filter(F.col("in_progress")).select("routine_id", "user_id", "routine_name")
    if users is not None:
        opened = opened.join(users, "user_id", "left_semi")
    return (opened
            .join(lv["days"], "routine_id")
            .join(lv["slots"].filter(F.col("session_order") == 1), "day_id")
            .join(lv["sessions"].select("session_id", "session_name"), "session_id")
            .join(exercise_sets_of(m, "log_sets").select("session_id", "exercise_order", "set_id", F.col("cur_set").alias("set_number")),
                  "session_id")
            .select(*TARGET_KEYS, "set_id"))


def resolve_logged_sets(m: Model, requests: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """I8 target resolution: (user_id, routine_name, day_number, session_name,
    exercise_order, set_number) -> track set id, open workouts, slot 1 only.
    ``index``: a prebuilt ``open_set_index`` (the stream builds it once)."""
    targets = open_set_index(m) if index is None else index
    return requests.join(targets, TARGET_KEYS)


def update_logged_sets(m: Model, requests: DataFrame) -> DataFrame:
    """I8: write weight and reps of logged sets; the last request per set wins
    by (ts, event_id / seq); values are written as given (NULL included).
    Returns the new ``track_exercise_details``."""
    order_cols = [c for c in ("ts", "event_id", "seq") if c in requests.columns]
    hit = resolve_logged_sets(m, requests)
    last = (hit.groupBy("set_id")
            .agg(F.max_by(F.struct("weight", "reps_done"), F.struct(*order_cols)).alias("_v")))
    ted = m.track_exercise_details
    j = ted.join(last.withColumnRenamed("set_id", "id"), "id", "left")
    matched = F.col("_v").isNotNull()
    return j.select(*[F.when(matched, F.col("_v.weight").cast("decimal(6,2)")).otherwise(F.col("weight"))
                      .alias("weight") if c == "weight" else
                      F.when(matched, F.col("_v.reps_done").cast("int")).otherwise(F.col("reps_done"))
                      .alias("reps_done") if c == "reps_done" else F.col(c)
                      for c in ted.columns])


def set_rep_goals(m: Model, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (request_group, sse_id, set, reps text). A group applies only
    if every value is an integer >= 1 (all or nothing, J7). Returns (new
    ``setup_exercise_details``, rejected groups)."""
    from regimen.functions.scalar import to_int
    r = requests.withColumn("_reps", to_int(F.col("reps").cast("string")))
    bad = (r.filter(F.col("_reps").isNull() | (F.col("_reps") < 1))
           .select("request_group").distinct().withColumn("reason", F.lit("reps goal must be >= 1")))
    ok = r.join(bad, "request_group", "left_anti")
    last = (ok.groupBy("sse_id", "set").agg(F.max_by("_reps", "seq").alias("_new")))
    sed = m.setup_exercise_details
    j = sed.join(last.withColumnRenamed("sse_id", "setup_session_exercise_id")
                 .withColumnRenamed("set", "cur_set"), ["setup_session_exercise_id", "cur_set"], "left")
    return (j.withColumn("reps_goal", F.coalesce("_new", "reps_goal").cast("int"))
            .select(*sed.columns)), bad


FLAG_ACTIONS = {"created": ("routine_created", True), "edit_on": ("routine_edit_in_progress", True),
                "edit_off": ("routine_edit_in_progress", False)}


def flip_flags(m: Model, requests: DataFrame) -> DataFrame:
    """Requests (routine_id, action) with action in created / edit_on / edit_off."""
    sr = m.setup_routines
    acts = requests.select(F.col("routine_id").alias("id"), "action")
    flags = acts.groupBy("id").agg(*[
        F.max(F.when(F.col("action") == a, F.lit(True))).alias("_" + a) for a in FLAG_ACTIONS])
    j = sr.join(flags, "id", "left")
    created = F.when(F.col("_created"), F.lit(True)).otherwise(F.col("routine_created"))
    edit = (F.when(F.col("_edit_off"), F.lit(False)).when(F.col("_edit_on"), F.lit(True))
            .otherwise(F.col("routine_edit_in_progress")))
    return j.select("id", "name", "user_id", created.alias("routine_created"),
                    edit.alias("routine_edit_in_progress"))


# --- I11 / I12 / I13 / I14: completion and deletes ---------------------------------------

def complete_workouts(m: Model, requests: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Requests (user_id, routine_name) stamp ``as_of`` on the user's open
    workouts of that routine, close the same set, and advance the cursor of
    the user's plan routine of that name (I15)."""
    tr = m.track_routines
    req = requests.select("user_id", F.col("routine_name").alias("name")).distinct() \
        .withColumn("_req", F.lit(True))
    j = tr.join(req, ["user_id", "name"], "left")
    hit = F.col("_req").isNotNull() & F.col("in_progress")
    new_tr = j.select("id", "name", "user_id", "setup_id",
                      F.when(hit, F.lit(False)).otherwise(F.col("in_progress")).alias("in_progress"),
                      F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("completion_date"))
                      .alias("completion_date"))
    closed_users = (j.filter(hit).select("user_id", "name").distinct()
                    .join(m.setup_routines.select("user_id", "name", F.col("id").alias("routine_id")),
                          ["user_id", "name"]))
    return dict(track_routines=new_tr, users_current_details=advance_cursor(m, closed_users))


PLAN_TABLES = ("setup_routines", "setup_days", "setup_sessions", "setup_days_sessions", "setup_session_exercises", "setup_exercise_details")


def cascade(m: Model, root: str, ids: DataFrame, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    """Delete the rows of ``root`` with the keys ``ids`` (``id``) and all that hangs on them, by the declared cascading
    foreign keys among ``tables``. The graph is walked parents first. The deleted keys of a table that others
    refer to are found once, by its own references, and stored; the kept rows are then told by the table's own key, so the
    large side keeps its layout. Returns every table of ``tables``, those out of reach as they are."""
    checkpoint_dir(ids.sparkSession)
    keys = [(t, col, pt) for t, col, pt, _, rule in S.FOREIGN_KEYS if rule == "cascade" and t in tables and pt in tables]
    gone = {root: ids.select("id").filter(F.col("id").isNotNull()).distinct().checkpoint()}
    out = {t: m[t] for t in tables}
    out[root] = m[root].join(gone[root], "id", "left_anti")
    waiting = [t for t in tables if t != root]
    while waiting:
        t = next(x for x in waiting if not any(c == x and p in waiting for c, _, p in keys))         # all its parents are done
        waiting.remove(t)
        hits = [(col, gone[pt].withColumnRenamed("id", col)) for c, col, pt in keys if c == t and pt in gone]
        if not hits:
            continue
        if any(pt == t for _, _, pt in keys):
            found = None
            for col, g in hits:
                part = m[t].select("id", col).join(g, col, "left_semi").select("id")
                found = part if found is None else found.unionByName(part)
            gone[t] = (found if len(hits) == 1 else found.distinct()).checkpoint()
            out[t] = m[t].join(gone[t], "id", "left_anti")
        else:
            for col, g in hits:
                out[t] = out[t].join(g, col, "left_anti").select(*m[t].columns)
    return out


def delete_log_tree(m: Model, routine_ids: DataFrame) -> dict[str, DataFrame]:
    """I13 on the log: delete track routines (``id``) and all below."""
    return cascade(m, "track_routines", routine_ids, TRACK_TABLES)


def discard_open_workouts(m: Model, requests: DataFrame) -> dict[str, DataFrame]:
    """Requests (user_id, routine_name) delete the user's open workouts of
    that routine with everything below them (keyed by user, unlike the
    reference, which deletes every user's)."""
    ids = (m.track_routines.filter(F.col("in_progress"))
           .join(requests.select("user_id", F.col("routine_name").alias("name")), ["user_id", "name"],
                 "left_semi").select("id"))
    return delete_log_tree(m, ids)


def delete_plan_tree(m: Model, routine_ids: DataFrame) -> dict[str, DataFrame]:
    """I13 on the plan: delete setup routines (``id``) and all below."""
    return cascade(m, "setup_routines", routine_ids, PLAN_TABLES)


def delete_sessions(m: Model, requests: DataFrame) -> dict[str, DataFrame]:
    """Requests (routine_id, session_name) delete named sessions and all below."""
    ids = m.setup_sessions.join(
        requests.select(F.col("routine_id").alias("setup_routine_id"), F.col("session_name").alias("name")),
        ["setup_routine_id", "name"], "left_semi").select("id")
    return cascade(m, "setup_sessions", ids, PLAN_TABLES)


def restrict_check(m: Model, routine_ids: DataFrame) -> DataFrame:
    """Which requested routine deletes a non-cascading reference blocks:
    a user's current routine, or a log routine whose lineage is not cleared.
    Returns (id, blocked_by) with NULL ``blocked_by`` for allowed deletes."""
    req = routine_ids.select("id").distinct()
    cur = (m.users_current_details.select(F.col("current_routine_id").alias("id"))
           .join(req, "id", "left_semi").distinct().withColumn("_cur", F.lit(True)))
    lin = (m.track_routines.select(F.col("setup_id").alias("id"))
           .join(req, "id", "left_semi").distinct().withColumn("_lin", F.lit(True)))
    j = req.join(cur, "id", "left").join(lin, "id", "left")
    blocked = (F.when(F.col("_cur") & F.col("_lin"), "current routine, log lineage")
               .when(F.col("_cur"), "current routine").when(F.col("_lin"), "log lineage"))
    return j.select("id", blocked.alias("blocked_by"))


def delete_routines(m: Model, routine_ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """I13 + I14: cascade-delete the allowed routines; report the blocked ones."""
    check = restrict_check(m, routine_ids)
    allowed = check.filter(F.col("blocked_by").isNull()).select("id")
    return delete_plan_tree(m, allowed), check.filter(F.col("blocked_by").isNotNull())


# --- I18 / I19 / I20: names and creation ------------------------------------------------

def rename(existing: DataFrame, owner: str, requests: DataFrame, others: DataFrame | None = None,
           max_len: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests (request_id, seq, id, new_name) rename rows of ``existing``
    (id, ``owner``, name). Names are trimmed first. A rename applies if the
    name passes J8 and no *other* row of ``others`` (default: all rows) of the
    owner has the same lower-case name (a case-only change of the row itself is
    allowed); of several renames of one row the last (seq, request_id) wins, and
    two rows of one owner may not take the same new name in one batch (both
    refused). Returns (new rows, rejected requests with reason)."""
    from regimen.functions.scalar import js_trim
    from regimen.operators.quality import name_problem
    last = (requests.withColumn("new_name", js_trim("new_name")).groupBy("id")
            .agg(F.max_by(F.struct("request_id", "new_name"), F.struct("seq", "request_id")).alias("_r"))
            .select("id", "_r.request_id", "_r.new_name"))
    r = last.join(existing.select("id", owner), "id")
    r = r.withColumn("_lname", F.lower("new_name")).withColumn("reason", name_problem(F.col("new_name"), max_len))
    taken = (existing if others is None else others).select(F.col("id").alias("_other"), owner, F.lower(js_trim("name")).alias("_lname"))
    clash = (r.join(taken, [owner, "_lname"]).filter(F.col("_other") != F.col("id"))
             .select("request_id").distinct().withColumn("_clash", F.lit(True)))
    twice = (r.groupBy(owner, "_lname").agg(F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").drop("_n").withColumn("_twice", F.lit(True)))
    r = (r.join(clash, "request_id", "left").join(twice, [owner, "_lname"], "left")
         .withColumn("reason", F.coalesce("reason", F.when(F.col("_clash"), "name already used")
                                          .when(F.col("_twice"), "name requested twice"))))
    ok = r.filter(F.col("reason").isNull()).select("id", F.col("new_name").alias("_new"))
    renamed = existing.join(ok, "id", "left").withColumn("name", F.coalesce("_new", "name")).select(*existing.columns)
    return renamed, r.filter(F.col("reason").isNotNull()).select("request_id", "id", "reason")


def rename_sessions(m: Model, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I18 for sessions: requests (request_id, seq, session_id, new_name); names are unique per routine."""
    new, bad = rename(m.setup_sessions, "setup_routine_id", requests.withColumnRenamed("session_id", "id"))
    return new, bad.withColumnRenamed("id", "session_id")


def rename_sessions_named(m: Model, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I18 for sessions by their present name: requests (request_id, seq, routine_id, session_name, new_name); B2 finds the
    session, and all requests of a batch mean the names before it. Returns (new setup_sessions, rejected requests
    with reason); a name that the routine doesn't have is an unknown session."""
    found = session_ids(m, requests)
    new, bad = rename_sessions(m, found.filter(F.col("session_id").isNotNull()).select("request_id", "seq", "session_id", "new_name"))
    unknown = found.filter(F.col("session_id").isNull()).select("request_id", F.lit("unknown session").alias("reason"))
    return new, bad.select("request_id", "reason").unionByName(unknown)


def rename_routines(m: Model, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I18 for routines: requests (request_id, seq, routine_id, new_name); 1 to 100
    characters, unique among the user's *created* routines."""
    new, bad = rename(m.setup_routines, "user_id", requests.withColumnRenamed("routine_id", "id"),
                      others=m.setup_routines.filter("routine_created"), max_len=S.ROUTINE_NAME_MAX)
    return new, bad.withColumnRenamed("id", "routine_id")


def create_named(existing: DataFrame, owner: str, requests: DataFrame, run: str, entity: str,
                 max_len: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests (request_id, seq, ``owner``, name) -> new rows (id, owner, name).

    Names are trimmed and must pass J8; a name already used by the owner
    (case-insensitive) or repeated in the batch (first ``seq`` wins) is
    refused. Returns (new rows, rejected requests with reason)."""
    from regimen.functions.scalar import js_trim
    from regimen.operators.quality import name_problem
    r = requests.withColumn("name", js_trim("name")).withColumn("_lname", F.lower("name"))
    r = r.withColumn("reason", name_problem(F.col("name"), max_len))
    used = existing.select(owner, F.lower("name").alias("_lname")).distinct().withColumn("_used", F.lit(True))
    first = (r.filter(F.col("reason").isNull()).groupBy(owner, "_lname")
             .agg(F.min_by("request_id", F.struct("seq", "request_id")).alias("_first")))
    r = (r.join(used, [owner, "_lname"], "left").join(first, [owner, "_lname"], "left")
         .withColumn("reason", F.coalesce(
             "reason", F.when(F.col("_used"), "name already used")
             .when(F.col("_first") != F.col("request_id"), "duplicate in batch"))))
    ok = r.filter(F.col("reason").isNull())
    new_rows = ok.select(det_id(run, entity, "request_id").alias("id"), owner, "name")
    return new_rows, r.filter(F.col("reason").isNotNull()).select("request_id", owner, "name", "reason")


def create_sessions_on_days(m: Model, requests: DataFrame, run: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Requests (request_id, seq, setup_routine_id, day_number, slot, name) create a
    session and place it on a day in one step. The session obeys ``create_named``; an
    unknown day refuses the request; the slot number is taken as given.
    Returns (new setup_sessions and setup_days_sessions rows, rejects)."""
    days = m.setup_days.select("setup_routine_id", "day_number", F.col("id").alias("day_id"))
    placed = requests.join(days, ["setup_routine_id", "day_number"], "left")
    known = placed.filter(F.col("day_id").isNotNull())
    sessions, bad = create_named(m.setup_sessions, "setup_routine_id", known.select("request_id", "seq", "setup_routine_id", "name"),
                                 run, "session")
    slots = (known.select(det_id(run, "session", "request_id").alias("session_id"), "request_id", "day_id", "slot")
             .join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
             .select(det_id(run, "slot", "request_id").alias("id"), "day_id", "session_id", F.col("slot").cast("int").alias("session_order")))
    rejects = bad.select("request_id", "reason").unionByName(
        placed.filter(F.col("day_id").isNull()).select("request_id", F.lit("unknown day").alias("reason")))
    return dict(setup_sessions=sessions, setup_days_sessions=slots), rejects


def new_drafts(resolved: DataFrame) -> DataFrame:
    """The draft rows of ``setup_routines`` that ``resolve_drafts`` created (no name, flags at their defaults)."""
    return resolved.filter("created").select(F.col("routine_id").alias("id"), _lit_null("string").alias("name"), "user_id",
                                             F.lit(False).alias("routine_created"), F.lit(False).alias("routine_edit_in_progress"))


def resolve_drafts(m: Model, users: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Each requesting user's open draft (routine_created = false), else a
    new draft routine (its row: ``new_drafts``). Returns (user_id -> routine_id
    with ``created`` flag, users with more than one draft (J11), who get none)."""
    drafts = m.setup_routines.filter(~F.col("routine_created"))
    per_user = drafts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"),
                                            F.min("id").alias("draft_id"))
    u = users.select("user_id").distinct().join(per_user, "user_id", "left")
    many = u.filter(F.col("n") > 1).select("user_id", F.col("n").cast("long").alias("drafts"))
    one = u.filter(F.col("n").isNull() | (F.col("n") == 1))
    out = one.select("user_id",
                     F.coalesce(F.col("draft_id").cast("string"),
                                det_id(run, "draft", "user_id")).alias("routine_id"),
                     F.col("draft_id").isNull().alias("created"))
    return out, many
