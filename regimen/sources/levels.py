"""Derived tables that are written once per version of their source files, in buckets of a key.

``Levels(spark, paths, tag).table(name, build, key, order)`` is the table ``build()`` as of the files under ``paths``: the first
use writes it under the shared checkpoint folder, dealt by the hash of ``key`` into as many buckets as there are shuffle
partitions and sorted in each; later uses, also by other sessions that share the folder, read it. Tables with
equal buckets join on their keys without an exchange, as do projections that rename the key. The version is the
fingerprint of path, length and time of every source file, so a changed source gives a new table. The data
are written to a folder of the writer's own and named by one published marker: a reader sees a whole table or none, and of two
writers one counts.

The key should be one whose groups are bounded (a workout, a session, never an owner): a bucket is one task.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.session import checkpoint_dir
from regimen.sources import claims

#: names of the tables registered in this process, by application and marker
_REGISTERED: dict[tuple[str, str], str] = {}


#: stored bytes of the source tables that one shuffle partition, and so one bucket, stands for
PARTITION_BYTES_CONF = "spark.regimen.partitionBytes"
PARTITION_BYTES_DEFAULT = 8 << 20
_SHUFFLE_CONF, _GIVEN_CONF, _FITTED_CONF = "spark.sql.shuffle.partitions", "spark.regimen.partitions.given", "spark.regimen.partitions.fitted"


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and modification time of all files at or below ``path``; none where it does not exist."""
    files, at = claims._system(spark, path)
    if not files.exists(at):
        return []
    stack, found = [files.getFileStatus(at)], []
    while stack:
        status = stack.pop()
        if status.isDirectory():
            stack += list(files.listStatus(status.getPath()))
        else:
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Of path, length and modification time of all files at or below ``paths``."""
    digest = hashlib.sha256()
    for path in sorted(paths):
        digest.update(repr(_files(spark, path)).encode())
    return digest.hexdigest()[:24]


def given_partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions as its user has set them, whatever ``fit_partitions`` has made of them."""
    now = spark.conf.get(_SHUFFLE_CONF)
    return int(spark.conf.get(_GIVEN_CONF, now) if spark.conf.get(_FITTED_CONF, None) == now else now)


def fit_partitions(spark: SparkSession, paths: Sequence[str]) -> int:
    """Let the session shuffle into as many partitions as the files under ``paths`` need, at least those that its user has
    set: what one task holds of a shuffle, window or bucket then stays the same however large the tables are."""
    given = given_partitions(spark)
    size = sum(length for path in paths for _, length, _ in _files(spark, path))
    fitted = max(given, -(-size // int(spark.conf.get(PARTITION_BYTES_CONF, str(PARTITION_BYTES_DEFAULT)))))
    spark.conf.set(_SHUFFLE_CONF, str(fitted))
    spark.conf.set(_GIVEN_CONF, str(given))
    spark.conf.set(_FITTED_CONF, str(fitted))
    return fitted


def packed(columns: Sequence[str]) -> dict[str, str]:
    """How tables that this package writes for itself are packed; keys have too many values for a dictionary, and those that follow one
    another are written as their differences."""
    return {"compression": "zstd", "parquet.writer.version": "v2"} | {f"parquet.enable.dictionary#{c}": "false" for c in columns if c.endswith(("id", "key"))}

#: stored bytes that are shuffled in one go where a step can be done in slices, and the most slices
SLICE_BYTES, MOST_SLICES = 8 << 20, 8

_REMOVAL_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions of frames made or written inside remove their shuffle files when they end; by default these stay until the
    driver happens to collect its garbage, and those of all steps add up. For steps whose result is stored."""
    before = spark.conf.get(_REMOVAL_CONF, None)
    spark.conf.set(_REMOVAL_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(_REMOVAL_CONF) if before is None else spark.conf.set(_REMOVAL_CONF, before)


def stored(df: DataFrame | Sequence[DataFrame], name: str, *by: str) -> DataFrame:
    """``df`` as it is now, written once under the shared checkpoint folder with a folder for every value of ``by``: a filter
    on ``by`` reads the rows of its value alone, and every reader only its columns. Several frames of the same columns are computed one
    after another, so that the disk holds the shuffle files of one at a time, and read as one."""
    parts = [df] if isinstance(df, DataFrame) else list(df)
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{checkpoint_dir(spark)}/regimen-stored/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        for part in parts:
            part.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").options(**packed(schema.names)).partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path).select(schema.names)


def slices(*dfs: DataFrame, most: int = MOST_SLICES) -> int:
    """In how many slices to shuffle the rows of ``dfs``, each slice by itself: one per ``SLICE_BYTES`` of the files that they
    read, at most ``most``, as every slice reads them anew."""
    folders = {unquote(f.rsplit("/", 1)[0]) for df in dfs for f in df.inputFiles()}
    size = sum(length for folder in folders for _, length, _ in _files(dfs[0].sparkSession, folder))
    return max(1, min(most, -(-size // SLICE_BYTES)))


class Levels:
    def __init__(self, spark: SparkSession, paths: Sequence[str], tag: str = ""):
        self.spark = spark
        # what else the rows or their layout depend on
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        kept = f"{fingerprint(spark, paths)}-{self.buckets}{'-' + tag if tag else ''}"
        self.root = f"{checkpoint_dir(spark)}/regimen-levels/{kept}"

    def deal(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` dealt as the buckets of ``key`` are; windows and joins on the key leave it so."""
        return df.repartition(self.buckets, key)

    def table(self, name: str, build: Callable[[], DataFrame], key: str, order: Sequence[str] = (), dealt: bool = False) -> DataFrame:
        """``dealt``: ``build()`` is dealt by ``key`` already (``deal``), and written without another exchange."""
        marker = f"{self.root}/{name}.json"
        here = (self.spark.sparkContext.applicationId, marker)
        written = f"{name}.json" in claims.listed(self.spark, self.root)             # the folder may have been cleared
        if written and here in _REGISTERED and self.spark.catalog.tableExists(_REGISTERED[here]):
            return self.spark.table(_REGISTERED[here])
        if not written:
            with shuffles_removed(self.spark):
                self._write(marker, name, build() if dealt else self.deal(build(), key), key, order)
        told = json.loads(claims.content(self.spark, marker))
        table = f"regimen_level_{uuid.uuid4().hex}"
        sort = f"SORTED BY ({', '.join(told['order'])})" if told["order"] else ""
        self.spark.sql(f"CREATE TABLE {table} ({told['columns']}) USING parquet CLUSTERED BY ({told['key']}) {sort} "
                       f"INTO {told['buckets']} BUCKETS LOCATION '{told['path']}'")
        _REGISTERED[here] = table
        return self.spark.table(table)

    def _write(self, marker: str, name: str, df: DataFrame, key: str, order: Sequence[str]) -> None:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        written = f"regimen_write_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").options(**packed(df.columns)).bucketBy(self.buckets, key)
        (writer.sortBy(*order) if order else writer).option("path", path).saveAsTable(written)
        self.spark.sql(f"DROP TABLE {written}")                # an external table: its files stay
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        told = {"path": path, "columns": columns, "key": key, "order": list(order), "buckets": self.buckets}
        if not claims.publish(self.spark, marker, json.dumps(told)):
            claims.removed(self.spark, path)
