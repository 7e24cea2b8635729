"""Whole files as rows: logs with their order of arrival, artifacts named by an index, contents from several places.

Paths are those of Spark's file systems.  A file is one row until it is parsed, so files have a limit in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import content
from faultline.sources import storage

RAW_LOG = "log_id string, source string, repository string, workflow_name string, run_id bigint, log_content string, created_at string, url string"
#: An index of artifacts: an array of entries with these fields.
ARTIFACT = "repo string, failed_build string, failed_build_id string, path string"
#: Bytes of a file of logs at most, unless one log alone takes more.
FILE_BYTES = 64 << 20
#: Places of a row in its file; the file's own place is above them.
PLACE_BITS = 32


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def whole_files(spark: SparkSession, root: str, only: Sequence[str] | None = None) -> DataFrame:
    """file (its path under ``root``) and value of every file there, or of those in ``only``; no other is opened.

    Empty files, and those that ``only`` names and that aren't there, give no row.  The choice is one of the files' metadata, which Spark makes when it lists them.
    """
    fs, p = _hadoop(spark, root)
    under = urlsplit(fs.makeQualified(p).toString()).path.rstrip("/")
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    own = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?" + r"\Q" + under + r"\E/?", "")
    found = files if only is None else files.filter(own.isin(*only) if only else F.lit(False))
    return found.select(own.alias("file"), "value")


def _arrived(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """``parsed`` (file, place, x) as x.* and ord: the place of the file among all, by name, and that in the file."""
    names = files.select("file").distinct()
    ranks = storage.numbered(names.repartitionByRange("file").sortWithinPartitions("file"), "rank")
    joined = parsed.join(F.broadcast(ranks) if ranks.count() <= 100_000 else ranks, "file")
    return joined.select("x.*", (F.shiftleft(F.col("rank") - 1, PLACE_BITS) + F.col("place")).alias("ord"))


def read_logs(spark: SparkSession, path: str, schema: str = RAW_LOG) -> DataFrame:
    """Logs of JSON files that hold an array of objects, with ord, their order of arrival: that of files by name, then of places in a file.

    A missing content is empty; a file that isn't JSON gives no rows (see :func:`content_index_of`).  A file is one row
    till it is parsed: land the logs as Parquet.
    """
    files = whole_files(spark, path)
    parsed = files.select("file", F.posexplode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("place", "x")).filter("x is not null")
    return _arrived(files, parsed).withColumn("log_content", content(F.col("log_content")))


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().split(" ", 1) for part in schema.split(",")))


def write_logs(logs: DataFrame, path: str, file_bytes: int = FILE_BYTES, order: str | None = None) -> None:
    """Logs as files that hold an array of objects; by name, then place, files give them in ``order`` (a column; else by log_id).

    Rows are dealt by their bytes: a file has at most ``file_bytes``, or one log alone.
    """
    write_arrays(logs, path, file_bytes, order or "log_id")


def write_arrays(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES, order: str | None = "log_id", head: str = "[", tail: str = "]") -> None:
    """Rows as JSON arrays between ``head`` and ``tail`` ({n} in it: the file's rows).

    Rows are shuffled once, into ranges of the order; each range's task fills one file after the other, so a task holds a file's rows at most.
    Without an order no row is moved: each task fills files with its rows as they come, and names have no order.
    """
    columns = [c for c in rows.columns if c != order or c == "log_id"]
    text = F.to_json(F.struct(*columns))
    if order is None:
        placed = rows.select(text.alias("row"))
    else:
        placed = rows.select(F.col(order).alias("_order"), text.alias("row")).repartitionByRange("_order").sortWithinPartitions("_order", "row")
    most = file_bytes - len(head.encode()) - len(tail.encode()) - 24

    def run(batches: Iterator[pa.RecordBatch]):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file():
            value = head.encode() + b",".join(held) + tail.replace("{n}", str(len(held))).encode()
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}{number:09d}"]), pa.array([value.decode()])], ["part", "value"])

        for batch in batches:
            for row in batch.column(0).cast(pa.binary()).to_pylist():
                if held and size + len(row) > most:
                    yield file()
                    number, size = number + 1, 0
                    held.clear()
                held.append(row)
                size += len(row) + 1
        if held:
            yield file()

    with storage.small_batches(rows.sparkSession, 100):
        arrays = placed.select("row").mapInArrow(run, "part string, value string")
        if order is None:
            arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
        else:  # names by part, and so a sort of what a task writes
            arrays.write.partitionBy("part").text(path)


def write_packed(artifacts: DataFrame, path: str) -> None:
    """Artifacts (file, value) as a packed tree: Parquet files sorted by file, so a few artifacts are read without the others, and there are as many files as the bytes take."""
    artifacts.select("file", "value").repartitionByRange("file").sortWithinPartitions("file").write.parquet(path)


def read_artifact_logs(spark: SparkSession, index: str, root: str, num_logs: int = 300, schema: str = ARTIFACT, packed: bool = False) -> DataFrame:
    """log_id, source, repository, build_id, log_content of an index's first ``num_logs`` entries with a failed build.

    index: JSON files, an array of entries; an entry's path is one under ``root``, or in the tree that :func:`write_packed` has packed there.  Only these entries' files are opened (``num_logs`` is the
    feature's limit, so their paths may pass through the driver); entries without a path, and whose file is missing or has nothing but line ends, are left out.
    """
    files = whole_files(spark, index)
    entries = _arrived(files, files.select("file", F.posexplode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("place", "x")).filter("x is not null"))
    first = entries.filter(content(F.col("failed_build")) != "").orderBy("ord").limit(num_logs).collect()
    wanted = spark.createDataFrame([(r.repo, r.failed_build_id, r.path) for r in first if r.path], "repo string, build_id string, file string")
    named = sorted({r.path for r in first if r.path})
    found = spark.read.schema("file string, value string").parquet(root).filter(F.col("file").isin(*named) if named else F.lit(False)) if packed else whole_files(spark, root, named)
    texts = found.filter(F.col("value").rlike(r"[^\r\n]"))
    name = F.concat(F.lit("bs_"), F.col("repo"), F.lit("_"), F.col("build_id"))
    return texts.join(F.broadcast(wanted), "file").select(name.alias("log_id"), F.lit("bugswarm").alias("source"), F.col("repo").alias("repository"), "build_id", F.col("value").alias("log_content"))


def content_index_of(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(index, report) over files of logs in several places.

    index: log_id, log_content of the first place (then file, then row) where the content isn't empty.  report: place (from 0), path, file,
    status (read, bad_json, missing) and rows of every file, and of every path that isn't there; bad files count for nothing in the index.
    """
    found, report = None, None
    for place, path in enumerate(paths):
        if exists(spark, path):
            files = whole_files(spark, path)
            n = F.json_array_length("value")
            told = files.select(F.lit(place).alias("place"), F.lit(path).alias("path"), "file", F.when(n.isNull(), "bad_json").otherwise("read").alias("status"), F.coalesce(n, F.lit(0)).cast("long").alias("rows"))
            rows = F.from_json(F.when(n.isNotNull(), F.col("value")), "array<struct<log_id: string, log_content: string>>")
            own = files.select("file", F.posexplode(rows).alias("at", "x")).filter("x.log_id <> '' and x.log_content <> ''")
            own = own.select("x.*", F.struct(F.lit(place).alias("place"), "file", "at").alias("first"))
            found = own if found is None else found.unionByName(own)
        else:
            told = spark.createDataFrame([(place, path, None, "missing", 0)], "place int, path string, file string, status string, rows long")
        report = told if report is None else report.unionByName(told)
    if found is None:
        found = spark.createDataFrame([], "log_id string, log_content string, first int")
    return found.groupBy("log_id").agg(F.min_by("log_content", "first").alias("log_content")), report
