"""K1: the set-log stream folds logged sets into the current log state.

Input is a stream of set logs: ``event_id``, ``ts``, the address of a logged set
(``TARGET_KEYS`` of I8) and the raw texts ``weight_text`` and ``reps_text``.
Every micro-batch is judged in one pass: validated (J6/J7/J12), joined to the
open sets, and written once to ``log/epoch=N/outcome=...``, where the outcome is
``refused`` (with the problem), ``unresolved`` (valid, but no open set has the
address) or ``update``. An epoch counts once its marker ``log/_epochs/N`` stands; a
retried epoch rewrites the same rows before that, and nobody reads half of one.

After a run its epochs are folded into the state. The state is dealt over ``buckets`` by
the hash of the set: a run reads and writes anew only the buckets in which it has updates, and then
publishes one manifest, ``state/_manifest/N``, that names the folder of every bucket, the last epoch folded in, and the logs that
are still unresolved. A run that dies before that has changed nothing that a reader sees, and the next one
folds the same epochs again. Folders that neither this manifest nor the one before names are deleted.

Workouts that open during the stream: every run judges the unresolved logs of all earlier runs again by the
workouts that are open now. Those that meet their set become updates (``resolved``), however much later the workout was
opened than the log was written. Logs that no workout ever answers to go on waiting, and are read by every run.

The value of a set is ``max_by(value, (ts, event_id))``, which does not depend on batch order:
a late, replayed or late resolved log can never overwrite a newer value, and the final state
equals the batch job I8 over the same events. An empty stream has an empty state.

No watermark: a watermark would drop events that arrive more than its delay
behind the newest one, but a late set log is still the truth for its set
unless a newer write exists, which the merge already decides.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.operators.quality import validated_set_log
from regimen.operators.transform import TARGET_KEYS, open_set_index
from regimen.session import checkpoint_dir
from regimen.sources import claims
from regimen.sources.levels import stored
from regimen.sources.tables import Model

_ADDRESS = "user_id long, routine_name string, day_number int, session_name string, exercise_order int, set_number int"
_VALUE = "weight decimal(6,2), reps_done int, ts timestamp, event_id long"
_LOG = f"{_ADDRESS}, {_VALUE}, problem string, set_id string, epoch long, outcome string"
_STATE = f"set_id string, {_VALUE}"
_WAITING = f"{_ADDRESS}, {_VALUE}"
#: buckets of a new state; a state keeps its number
BUCKETS = 64


def judged(batch: DataFrame, index: DataFrame) -> DataFrame:
    """Set logs with their outcome: refused, unresolved or update."""
    checked = validated_set_log(batch)
    hit = checked.join(index, TARGET_KEYS, "left")
    outcome = (F.when(F.col("problem").isNotNull(), "refused").when(F.col("set_id").isNull(), "unresolved").otherwise("update"))
    found = F.when(F.col("problem").isNull(), F.col("set_id")).alias("set_id")
    return hit.select(*TARGET_KEYS, "weight", "reps_done", "ts", "event_id", "problem", found, outcome.alias("outcome"))


def run_set_log_stream(m: Model, logs: DataFrame, root: str | None = None, buckets: int = BUCKETS) -> str:
    """Process what the stream ``logs`` has now (``availableNow``) and return the state
    folder. The stream's own checkpoint lives under the same root, so a restarted job
    resumes where it stopped. The sets of open workouts are resolved by the first batch of a run and, where others
    follow, stored for these; those of the users of waiting logs are resolved when these are judged. A later run sees also the
    workouts opened since."""
    spark = logs.sparkSession
    root = root or f"{checkpoint_dir(spark)}/regimen-setlog/{uuid.uuid4().hex}"
    checkpoint_dir(spark)
    here: set[int] = set()                                      # epochs that this run has judged, by this index
    whole: list[DataFrame] = []                                 # the index of the first batch; the same stored, for all others

    def targets(users: DataFrame | None = None) -> DataFrame:
        return open_set_index(m, users).select(*TARGET_KEYS, F.col("set_id").cast("string").alias("set_id"))

    def write(batch: DataFrame, epoch_id: int) -> None:
        here.add(epoch_id)
        if len(whole) < 2:
            whole.append(stored(whole[0], "open-sets") if whole else targets())
        judged(batch, whole[-1]).write.partitionBy("outcome").mode("overwrite").parquet(f"{root}/log/epoch={epoch_id}")
        claims.publish(spark, f"{root}/log/_epochs/{epoch_id:012d}", "")

    query = (logs.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    fold(spark, root, targets, buckets, here)
    return root


def _rows(spark: SparkSession, paths: list[str], schema: str, base: str | None = None) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return (reader.option("basePath", base) if base else reader).parquet(*paths)


def _epochs(spark: SparkSession, root: str, after: int = -1, outcome: str | None = None) -> DataFrame:
    """The logs of the finished epochs from ``after`` + 1 on."""
    done = [int(n) for n in claims.listed(spark, f"{root}/log/_epochs")]
    paths = [f"{root}/log/epoch={n}" for n in done if n > after]
    # an epoch without rows has no files, and its folder no columns
    paths = [p for p in paths if any(n.startswith("outcome=") for n in claims.listed(spark, p))]
    rows = _rows(spark, paths, _LOG, f"{root}/log")
    return rows if outcome is None else rows.where(F.col("outcome") == outcome)


def manifest(spark: SparkSession, root: str, back: int = 0) -> dict | None:
    """The newest manifest of the state, or the ``back``-th before it."""
    names = claims.listed(spark, f"{root}/state/_manifest")
    return json.loads(claims.content(spark, f"{root}/state/_manifest/{names[-1 - back]}")) if len(names) > back else None


def _bucket(n: int):
    return F.pmod(F.xxhash64("set_id"), F.lit(n)).cast("int")


def fold(spark: SparkSession, root: str, targets: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS,
         judged_here: set[int] = frozenset()) -> dict:
    """Fold the finished epochs that the state has not, and the waiting logs whose workout is open by now, into the
    state; returns the manifest in force. A run without either leaves everything as it is. ``targets`` gives the open sets
    of the given users. The logs of the epochs ``judged_here`` were judged by them already and are not asked again; the
    other waiting logs meet their users' open sets once."""
    old = manifest(spark, root) or {"number": -1, "epoch": -1, "buckets": buckets, "folders": {}, "waiting": None, "resolved": []}
    n, run = old["buckets"], uuid.uuid4().hex
    finished = claims.listed(spark, f"{root}/log/_epochs")
    last = int(finished[-1]) if finished else -1
    fresh = _epochs(spark, root, old["epoch"], "unresolved").select(*TARGET_KEYS, "weight", "reps_done", "ts", "event_id")
    earlier = _rows(spark, [old["waiting"]] if old["waiting"] else [], _WAITING)
    unjudged = any(old["epoch"] < int(e) and int(e) not in judged_here for e in finished)      # by a run that died, with an older index
    late, still = _rows(spark, [], _STATE), fresh
    if old["waiting"] or unjudged:
        asked = earlier.unionByName(fresh) if unjudged else earlier
        met = asked.join(targets(asked.select("user_id").distinct()), TARGET_KEYS, "left")
        met = stored(met.withColumn("found", F.col("set_id").isNotNull()), "late", "found")
        late = met.filter("found").select("set_id", "weight", "reps_done", "ts", "event_id")
        missed = met.filter("NOT found").select(earlier.columns)
        still = missed if unjudged else missed.unionByName(fresh)
    new = (_epochs(spark, root, old["epoch"], "update").select("set_id", "weight", "reps_done", "ts", "event_id").unionByName(late)
           .withColumn("bucket", _bucket(n)))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())          # at most ``buckets`` rows
    none_late = not (old["waiting"] or unjudged) or late.isEmpty()
    if last <= old["epoch"] and none_late:
        return old
    folders, waiting, resolved = dict(old["folders"]), old["waiting"], list(old["resolved"])
    if touched:
        before = _rows(spark, [folders[str(b)] for b in touched if str(b) in folders], _STATE).withColumn("bucket", _bucket(n))
        value = F.struct("weight", "reps_done", "ts", "event_id")
        merged = (new.unionByName(before).groupBy("bucket", "set_id").agg(F.max_by(value, F.struct("ts", "event_id")).alias("v"))
                  .select("bucket", "set_id", "v.*"))
        merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{root}/state/data/{run}")
        folders |= {str(b): f"{root}/state/data/{run}/bucket={b}" for b in touched}
    if not none_late:
        late.select("event_id", F.lit(True).alias("found"), "set_id").write.parquet(f"{root}/state/resolved/{run}")
        resolved.append(f"{root}/state/resolved/{run}")
    if last > old["epoch"] or not none_late:
        still.write.parquet(f"{root}/state/waiting/{run}")
        waiting = f"{root}/state/waiting/{run}"
    entry = {"number": old["number"] + 1, "epoch": last, "buckets": n, "folders": folders, "waiting": waiting, "resolved": resolved, "wrote": touched}
    if not claims.publish(spark, f"{root}/state/_manifest/{entry['number']:012d}", json.dumps(entry, sort_keys=True)):
        raise RuntimeError(f"another run has folded into {root}")
    _clean(spark, root, entry, old)
    return entry


def _clean(spark: SparkSession, root: str, *kept: dict) -> None:
    """Delete the folders of the state that no manifest of ``kept`` names."""
    named = {p for m in kept for p in [*m["folders"].values(), m["waiting"], *m["resolved"]] if p}
    for kind in ("data", "waiting", "resolved"):
        for run in claims.listed(spark, f"{root}/state/{kind}"):
            folder = f"{root}/state/{kind}/{run}"
            if kind != "data":
                if folder not in named:
                    claims.removed(spark, folder)
                continue
            parts = [f"{folder}/{b}" for b in claims.listed(spark, folder) if b.startswith("bucket=")]
            unused = [p for p in parts if p not in named]
            for path in [folder] if len(unused) == len(parts) else unused:
                claims.removed(spark, path)


def set_log(spark: SparkSession, root: str) -> DataFrame:
    """Every set log of the finished epochs, with its outcome: those whose workout opened later are updates."""
    found = manifest(spark, root)
    logs = _epochs(spark, root)
    if not found or not found["resolved"]:
        return logs
    late = _rows(spark, found["resolved"], "event_id long, found boolean, set_id string").select(
        "event_id", "found", F.col("set_id").alias("_late")).distinct()
    first = F.col("found") & (F.col("outcome") == "unresolved")
    return (logs.join(late, "event_id", "left").withColumn("set_id", F.when(first, F.col("_late")).otherwise(F.col("set_id")))
            .withColumn("outcome", F.when(first, "update").otherwise(F.col("outcome"))).select(logs.columns))


def current_state(spark: SparkSession, root: str) -> DataFrame:
    """Last write per set over all epochs folded in."""
    found = manifest(spark, root)
    return _rows(spark, sorted(found["folders"].values()) if found else [], _STATE).select("set_id", "weight", "reps_done")


def apply_state(m: Model, state: DataFrame) -> DataFrame:
    """New ``track_exercise_details`` with the streamed values written in."""
    ted = m.track_exercise_details
    j = ted.join(state.select(F.col("set_id").alias("id"), F.col("weight").alias("_w"), F.col("reps_done").alias("_r"),
                              F.lit(True).alias("_hit")), "id", "left")
    return j.select(*[F.when(F.col("_hit"), F.col("_w").cast("decimal(6,2)")).otherwise(F.col("weight"))
                      .alias("weight") if c == "weight" else
                      F.when(F.col("_hit"), F.col("_r").cast("int")).otherwise(F.col("reps_done"))
                      .alias("reps_done") if c == "reps_done" else F.col(c) for c in ted.columns])
