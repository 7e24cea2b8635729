"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; an own folder only where that is unset and Spark runs in one process."""
    global _own_dir
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path there that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class _Scratch(threading.local):
    """The tables of each open :func:`scratch` of a thread, the innermost last."""

    def __init__(self):
        self.open: list[list[DataFrame]] = []


_scratch = _Scratch()


def stored(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` as Parquet there and read it back: lineage ends, and lost executors take nothing with them.

    Within a :func:`scratch` the table goes when that ends; with ``kept`` it stays until the one around that ends, if there is one.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if len(_scratch.open) > kept:
        _scratch.open[-1 - kept].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what :func:`stored` has written in it; what is needed of it must be stored as ``kept`` by then."""
    _scratch.open.append([])
    try:
        yield
    finally:
        discard(*_scratch.open.pop())


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` has written, once all that was made of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside hands Arrow batches of ``rows`` rows at most to Python; afterwards the session has its own number again.

    Rows are whole texts, and a task holds a batch of them in the JVM and again in its Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(own) <= 0 else min(rows, int(own))))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Rows of a sorted frame with their places from 1: places within its ranges, and the sizes of the ranges before."""
    placed = stored(ordered.withColumn("at", F.monotonically_increasing_id()), name)
    ranges = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.join(F.broadcast(ranges.select("range", before.alias("before"))), F.shiftright("at", 33) == F.col("range"))  # a row for each range
    return out.select(*ordered.columns, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
