"""Results that later steps read again: written once to the folder that every executor sees."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a new local folder only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of its own under :func:`shared_root`.

    What reads it starts from its files: filters on computed columns reach the
    scan instead of computing the columns twice, and a lost executor costs a
    reread. The table stays until the folder is cleared.
    """
    return _written(df, f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    """The shuffle files that led to the table go once it is written."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")  # counts for the plan that select() makes
    try:
        df.select("*").write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that are deleted together at the end of a ``with`` block, whose result must be stored elsewhere."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.count = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return _written(df, f"{self.path}/{self.count}")

    @contextmanager
    def brief(self, df: DataFrame) -> Iterator[DataFrame]:
        """A table that is deleted at the end of a ``with`` block of its own."""
        path = f"{self.path}/brief-{uuid.uuid4().hex}"
        yield _written(df, path)
        delete(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def size_of(spark: SparkSession, files: list[str]) -> int:
    """The bytes of files, looked up a folder at a time."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), set(files)
    total = 0
    for folder in {f.rpartition("/")[0] for f in found}:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        total += sum(s.getLen() for s in where.getFileSystem(conf).listStatus(where) if s.getPath().toUri().toString().rpartition("/")[2] in {f.rpartition("/")[2] for f in found})
    return total


def files_key(spark: SparkSession, path: str) -> str:
    """What changes when the files under ``path`` do: their names, sizes and times."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return repr(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))


def stored_once(make: Callable[[], DataFrame], label: str, key: str, spark: SparkSession) -> DataFrame:
    """The table that ``make`` gives, written once for each ``key`` under :func:`shared_root` and read from then on.

    ``key`` says what the table is made from (as :func:`files_key`) and by which rules.
    """
    path = f"{shared_root(spark)}/{label}-{hashlib.md5(key.encode()).hexdigest()}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
