"""Reading and writing logs, annotations, archives and run records."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import content
from faultline.sources.files import FILE_BYTES, read_logs, write_arrays, write_logs  # noqa: F401

ANNOTATION = "log_id string, repository string, workflow string, url string, llm_error_type string, actual_error_type string, type_correct boolean, root_cause_correct boolean, fix_actionable boolean, evidence_accurate boolean, quality_rating int, notes string, actual_root_cause string, llm_confidence double, hallucination_detected boolean, execution_time_ms double, model_used string, annotated_at string"
# Fixed values
STEPS = ("collect", "triage", "diagnose", "annotate", "evaluate", "benchmark")


def first_of_each(logs: DataFrame, key: str = "log_id", order: str = "ord") -> DataFrame:
    """The first row of each key in order of arrival; a partial aggregate, so a hot key isn't one task's rows."""
    rest = [c for c in logs.columns if c != key]
    return logs.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def last_of_each(rows: DataFrame, key: str = "log_id", order: str = "ord") -> DataFrame:
    """The last row of each key: inserts replace."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


#: Bytes of unpacked or packed files after which a task hands them on; one row may be more.
HELD_BYTES = 8 << 20
#: Bytes of a file from which packing tries to shrink it; shorter ones are stored as they are, which takes fewer bytes and a quarter of the time.
SHRINKS = 64


def members(archives: DataFrame) -> DataFrame:
    """run_id, name, content of every file in archives (run_id, content binary).

    Bytes that are no archive, or one that can't be unpacked (damaged, encrypted), are one text with a null name; null bytes give no row.
    """
    kind = archives.schema["run_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            at, names, contents, size = [], [], [], 0

            def rows(b=b):
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(names, pa.string()), pa.array(contents, pa.string())], ["run_id", "name", "content"])

            for i, raw in enumerate(b.column(1)):
                if not raw.is_valid:
                    continue
                raw = raw.as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        found = [(x.filename, z.read(x).decode("utf-8", "ignore")) for x in z.infolist() if not x.is_dir()]
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, ValueError, OSError):  # what zipfile raises for such bytes
                    found = [(None, raw.decode("utf-8", "ignore"))]
                for name, text in found:
                    at.append(i)
                    names.append(name)
                    contents.append(text)
                    size += len(text)
                    if size > HELD_BYTES:
                        yield rows()
                        at, names, contents, size = [], [], [], 0
            if at:
                yield rows()

    return archives.select("run_id", "content").mapInArrow(run, f"run_id {kind}, name string, content string")


def archives(files: DataFrame) -> DataFrame:
    """run_id, content: the files (run_id, name, content) of each row as an archive of its own."""
    kind = files.schema["run_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            first, packed, size = 0, [], 0
            for i, (name, text) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                raw, data = io.BytesIO(), (text.as_py() or "").encode()
                with zipfile.ZipFile(raw, "w") as z:
                    entry = zipfile.ZipInfo(name.as_py())  # of a fixed date, so an archive's bytes follow from its file
                    entry.compress_type = zipfile.ZIP_STORED if len(data) < SHRINKS else zipfile.ZIP_DEFLATED
                    z.writestr(entry, data)
                packed.append(raw.getvalue())
                size += len(packed[-1])
                if size > HELD_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(packed)), pa.array(packed, pa.binary())], ["run_id", "content"])
                    first, packed, size = i + 1, [], 0

    return files.select("run_id", "name", "content").mapInArrow(run, f"run_id {kind}, content binary")


def assembled(parts: DataFrame) -> DataFrame:
    """run_id, log_content: a run's files by name under their headings; a run without files has none."""
    text = F.when(F.col("name").isNull(), content(F.col("content"))).otherwise(F.concat(F.lit("=== "), "name", F.lit(" ===\n"), content(F.col("content"))))
    rows = parts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("name", text.alias("text")))).alias("x"))
    return rows.select("run_id", F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("log_content"))


def artifact_logs(index: DataFrame, texts: DataFrame, num_logs: int = 300) -> DataFrame:
    """log_id, source, repository, build_id, log_content: the first entries with a failed build, then those with a non-empty file.

    index: ord, repo, failed_build, failed_build_id, path; texts: path, value.
    """
    first = index.filter(F.coalesce(F.col("failed_build"), F.lit("")) != "").orderBy("ord").limit(num_logs)
    joined = first.join(texts.filter("value <> ''"), "path")
    return joined.select(F.concat(F.lit("bs_"), "repo", F.lit("_"), F.col("failed_build_id").cast("string")).alias("log_id"), F.lit("bugswarm").alias("source"), F.col("repo").alias("repository"), F.col("failed_build_id").alias("build_id"), F.col("value").alias("log_content"))


def content_index(*sources: DataFrame) -> DataFrame:
    """log_id, log_content: the first source (then row) that has a non-empty content."""
    ranked = None
    for rank, s in enumerate(sources):
        own = s.select("log_id", "log_content", "ord").filter("log_content <> ''").withColumn("rank", F.lit(rank))
        ranked = own if ranked is None else ranked.unionByName(own)
    return ranked.groupBy("log_id").agg(F.min_by("log_content", F.struct("rank", "ord")).alias("log_content"))


def read_annotations(spark: SparkSession, path: str, schema: str = ANNOTATION) -> DataFrame:
    """Annotations of JSON files: an envelope with ``annotations``, or a bare array."""
    df = spark.read.schema(f"annotations array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>, {schema}").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    names = [c for c in df.columns if c != "annotations"]
    bare = df.filter("annotations is null").select(*names)
    return df.select(F.explode("annotations").alias("a")).select("a.*").unionByName(bare)


def write_annotations(annotations: DataFrame, path: str, created_at: str, annotator: str = "manual", file_bytes: int = FILE_BYTES) -> None:
    """Annotations under envelopes (created_at, annotator, annotations, total) by log_id, at most ``file_bytes`` in each file; a total is that of its file."""
    head = json.dumps({"created_at": created_at, "annotator": annotator}, ensure_ascii=False)[:-1] + ', "annotations": ['
    write_arrays(annotations, path, file_bytes, head=head, tail='], "total": {n}}')


def exported(annotations: DataFrame) -> DataFrame:
    """Without the content, failure_lines as numbers."""
    return annotations.drop("log_content").withColumn("failure_lines", F.from_json("failure_lines", "array<int>"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_steps(records: DataFrame, path: str) -> None:
    """Append records of finished steps (step, ord, timestamp, ...) to the run's table."""
    records.write.mode("append").parquet(path)


def latest_steps(records: DataFrame) -> DataFrame:
    return last_of_each(records, "step")


def run_summary(records: DataFrame, steps: Sequence[str] = STEPS) -> DataFrame:
    """place, step, timestamp, outputs (whole numbers only) of the latest record of each step; ``(not run)`` without one."""
    order = records.sparkSession.createDataFrame(list(enumerate(steps)), "place int, step string")
    own = latest_steps(records).withColumn("numbers", F.map_filter("outputs", lambda k, v: v.rlike("^-?[0-9]+$")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("numbers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.broadcast(order).join(own, "step", "left").select("place", "step", F.coalesce(F.replace(F.substring("timestamp", 1, 19), F.lit("T"), F.lit(" ")), F.lit("(not run)")).alias("timestamp"), F.coalesce(shown, F.lit("")).alias("outputs"))


def collection_stats(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("logs"), F.countDistinct("repository").alias("repositories"), F.countDistinct("workflow_name").alias("workflows"))


def top(logs: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values (a report); ties by value."""
    return logs.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(n)


def annotation_stats(annotations: DataFrame) -> DataFrame:
    """kind (total or type), failure_type, n, avg_confidence: of all annotations (0 and null where there are none), and of each type."""
    facts = (F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"))
    kind = annotations.schema["failure_type"].dataType
    total = annotations.agg(*facts).select(F.lit("total").alias("kind"), F.lit(None).cast(kind).alias("failure_type"), "n", "avg_confidence")
    return total.unionByName(annotations.groupBy("failure_type").agg(*facts).select(F.lit("type").alias("kind"), "failure_type", "n", "avg_confidence"))
