"""Tables of the model: read, literal rows, derived views, versioned writes (A1-A5).

A change never edits files in place: a batch of changes becomes a new version
directory per changed table plus one manifest, published last, that names
the directory of every table. Readers pick the highest committed version, so
a job that dies half way leaves the previous version intact and can be retried.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.sources import claims
from regimen.sources.levels import packed, shuffles_removed
from regimen.sources.schema import SCHEMAS, TABLES


#: joins of two levels that a source may hold ready, and the tables they stand for
JOINED = {"plan_sets": ("setup_session_exercises", "setup_exercise_details"),
          "log_sets": ("track_session_exercises", "track_exercise_details")}


class Model:
    """The 16 tables as DataFrames.

    A table may be given as a zero-argument function; it is built on first
    use and kept, so a query pays only for the tables it reads. ``joined`` gives joins of levels
    (``JOINED``) that the source has ready; they go when one of their tables is replaced.
    """

    def __init__(self, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None,
                 joined: dict[str, Callable[[], DataFrame]] | None = None):
        self._tables = dict(tables or {})
        self._joined = dict(joined or {})

    def joined(self, name: str) -> DataFrame | None:
        """The join ``name`` of ``JOINED``, if the source has it ready."""
        return self._joined[name]() if name in self._joined else None

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self[name]
        raise AttributeError(name)

    def __getitem__(self, name: str) -> DataFrame:
        value = self._tables[name]
        if callable(value) and not isinstance(value, DataFrame):
            value = value()
            self._tables[name] = value
        return value

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in self._tables}

    def names(self) -> list[str]:
        return list(self._tables)

    def replace(self, **changed: DataFrame) -> "Model":
        unknown = set(changed) - set(TABLES)
        if unknown:
            raise KeyError(f"unknown tables: {sorted(unknown)}")
        return Model({**self._tables, **changed}, {name: df for name, df in self._joined.items() if not set(JOINED[name]) & set(changed)})


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def literal_table(spark: SparkSession, name: str, rows) -> DataFrame:
    """A2: literal rows (``INSERT ... VALUES``) in the table's schema."""
    return spark.createDataFrame(list(rows), SCHEMAS[name])


def complete(spark: SparkSession, tables: dict[str, DataFrame]) -> Model:
    """Model with every table present; absent tables become empty."""
    return Model({t: tables[t] if t in tables else empty_table(spark, t) for t in TABLES})


def read_table(spark: SparkSession, path: str, name: str, declared: bool = True) -> DataFrame:
    """A1: read one base table with its declared schema (no inference).

    ``declared=False`` reads files this package wrote itself, whose key
    columns may carry the source's key type.
    """
    reader = spark.read.schema(SCHEMAS[name]) if declared else spark.read
    return reader.parquet(path)


def derived_view(df: DataFrame, name: str) -> DataFrame:
    """A3: a derived temp table (CTAS) as a named view over the same plan."""
    df.createOrReplaceTempView(name)
    return df


def split_parent_child(df: DataFrame, parent_cols: dict[str, str],
                       child_cols: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """A5: one keyed request frame -> parent rows and dependent child rows.

    Replaces ``INSERT ... RETURNING id`` feeding a second insert: the key is
    already in the request, so both projections are independent.
    """
    parent = df.select(*[F.col(src).alias(dst) for dst, src in parent_cols.items()])
    child = df.select(*[F.col(src).alias(dst) for dst, src in child_cols.items()])
    return parent, child


class TableStore:
    """A4: versioned table directories under one root on a shared file system.

    A commit writes each changed table to a directory of its own (``root/<table>/<writer>``) and then claims the next
    version by publishing ``root/_manifest/<version>.json``, which maps every table to its current directory. The
    manifest appears whole or not at all, and one writer at most gets a version (``claims.publish``): the other commit
    ends with ``VersionConflict``, and no reader sees its files. ``update`` builds the change anew on the other's
    version and tries again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self, version: int) -> str:
        return f"{self.root}/_manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in claims.listed(self.spark, f"{self.root}/_manifest")]

    def paths(self, version: int) -> dict[str, str]:
        """The directory of every table in one version."""
        return json.loads(claims.content(self.spark, self._manifest(version)))["tables"] if version else {}

    def current(self) -> tuple[int, dict[str, str]]:
        version = max(self.versions(), default=0)
        return version, self.paths(version)

    def load(self, version: int | None = None) -> Model:
        """The model of the newest version, or of the given one."""
        paths = self.current()[1] if version is None else self.paths(version)
        return complete(self.spark, {t: read_table(self.spark, p, t, declared=False) for t, p in paths.items()})

    def commit(self, changed: dict[str, DataFrame], based_on: int | None = None) -> int:
        """Write the changed tables together as the version after ``based_on`` (by default the newest one); return its number."""
        version, paths = self.current() if based_on is None else (based_on, self.paths(based_on))
        version += 1
        paths = dict(paths)
        writer = uuid.uuid4().hex

        def write(item):
            name, df = item
            path = f"{self.root}/{name}/{writer}"
            columns = SCHEMAS[name].fieldNames()
            df.select(*columns).write.options(**packed(columns)).parquet(path)
            return name, path

        # independent tables are written as concurrent jobs; the manifest that
        # makes the version visible is published only after all succeeded
        with shuffles_removed(self.spark), ThreadPoolExecutor(max_workers=min(8, max(len(changed), 1))) as pool:
            for name, path in pool.map(write, changed.items()):
                paths[name] = path
        entry = json.dumps({"version": version, "writer": writer, "tables": paths}, sort_keys=True)
        if not claims.publish(self.spark, self._manifest(version), entry):
            for name in changed:
                claims.removed(self.spark, f"{self.root}/{name}/{writer}")
            raise VersionConflict(f"version {version} of {self.root} was committed by another writer")
        return version

    def update(self, change: Callable[[Model], dict[str, DataFrame]], attempts: int = 10) -> int:
        """Commit ``change`` of the newest model; where another writer was first, build it anew on that version."""
        for k in range(attempts):
            version, _ = self.current()
            try:
                return self.commit(change(self.load(version)), based_on=version)
            except VersionConflict:
                if k + 1 == attempts:
                    raise
        raise ValueError("attempts")


class VersionConflict(RuntimeError):
    """Another writer has committed the version that this one was based on."""
