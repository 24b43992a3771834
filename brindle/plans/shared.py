"""The shared folder, size-checked broadcasts and other things that plans have in common."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast; beyond it the join is left to Catalyst.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that is unset (local tests) a folder of this machine is made; on a
    cluster an unset folder is an error, since executors could not reach it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[str] = []


def work_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder, removed by clean or when Python ends unless it is kept."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        if not _written:
            atexit.register(_at_exit, spark)
        _written.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Remove all work folders written so far; results that read them must have been used or written."""
    while _written:
        remove_path(spark, _written.pop())


def _at_exit(spark: SparkSession) -> None:
    try:
        clean(spark)
    except Exception:  # Spark has gone already: nothing can be done from here
        _written.clear()


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written anew."""
    hadoop, files = _files(spark, path)
    out = files.create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    hadoop, files = _files(spark, path)
    stream = files.open(hadoop)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def list_path(spark: SparkSession, path: str) -> list[str]:
    """The files in a folder; none if it isn't there."""
    hadoop, files = _files(spark, path)
    return sorted(f.getPath().toString() for f in files.listStatus(hadoop)) if files.exists(hadoop) else []


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop, files = _files(spark, path)
    files.delete(hadoop, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than that many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_conf(spark: SparkSession, settings: dict[str, str]):
    """Context manager: settings for the actions inside it, put back afterwards."""

    class _Conf:
        def __enter__(self):
            self.old = {k: spark.conf.get(k, None) for k in settings}
            for k, v in settings.items():
                spark.conf.set(k, v)

        def __exit__(self, *_):
            for k, v in self.old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return _Conf()


def fence(column: Column) -> Column:
    """The same values, but no filter on them moves below the projection that makes them.

    A filter that Catalyst pushes through a chain of projections carries a copy of every
    expression it passes, which multiplies at each step; an always true term that counts
    as not deterministic keeps it above.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, so that helper columns never clash."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base = "_" + base
    return base
