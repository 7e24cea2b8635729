"""Files of logs, artifacts and annotations, and the keyed table."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline.operators import triage
from faultline.plans.queries import ORACLES, QUERIES
from faultline.sources import files, keyed
from faultline.sources import logs as sources

D = "/root/testdata/sf0.001"
TABLES = "orders events documents".split()
LOGS = "log_id string, ord long, log_content string"


def show(v):
    return f"{v:.5g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", "s1_read_logs s1_order_of_arrival s1_triage_of_files s4_artifact_files s5_index_of_files s5_report_of_files s6_annotations s7_keyed_store a1_annotation_stats".split())
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = c.execute(ORACLES[name])
    names = [x[0] for x in got.description]
    want = sorted(tuple(show(v) for _, v in sorted(zip(names, r, strict=True))) for r in got.fetchall())
    df = QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(show(r[k]) for k in sorted(names)) for r in df.collect()) == want and want


def test_files_have_a_limit_in_bytes_and_keep_the_order(spark, tmp_path):
    sizes = [10, 3000, 5, 700, 700, 700, 9000, 1, 400, 400, 400, 400, 20, 20] * 20
    rows = [(f"l{(i * 7919) % 1000:03d}-{i}", i, "x" * n if i % 9 else None) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, LOGS).repartition(5)
    path = f"file://{tmp_path}/logs"
    sources.write_logs(df, path, file_bytes=4000, order="ord")
    written = sorted(p for p in Path(tmp_path, "logs").rglob("part-*") if p.is_file())
    held = [json.loads(p.read_text()) for p in written]
    assert len(written) > 50 and all(p.stat().st_size <= 4001 or len(x) == 1 for p, x in zip(written, held, strict=True))
    assert [x["log_id"] for own in held for x in own] == [r[0] for r in rows]
    got = sources.read_logs(spark, path, "log_id string, log_content string").orderBy("ord").collect()
    assert [(r.log_id, r.log_content) for r in got] == [(k, t or "") for k, _, t in rows]
    assert len({r.ord for r in got}) == len(rows)


def test_files_of_no_rows_and_odd_files(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    sources.write_logs(spark.createDataFrame([], LOGS), path, order="ord")
    Path(tmp_path, "odd").mkdir()
    for name, text in {"a b+c%.json": '[{"log_id": "1", "log_content": "x"}, {"log_id": "2"}, null]', "b.json": '[{"log_id": "3"', "c.json": "", "d.json": '{"log_id": "4", "log_content": "alone"}', "e.json": "[]"}.items():
        Path(tmp_path, "odd", name).write_text(text)
    got = sources.read_logs(spark, f"file://{tmp_path}/odd").orderBy("ord").collect()
    assert [(r.log_id, r.log_content) for r in got] == [("1", "x"), ("2", ""), ("4", "alone")]
    index, report = files.content_index_of(spark, f"file://{tmp_path}/odd", f"file://{tmp_path}/nowhere")
    assert [(r.log_id, r.log_content) for r in index.collect()] == [("1", "x")]
    assert sorted((r.place, str(r.file), r.status, r.rows) for r in report.collect()) == [(0, "a b+c%.json", "read", 3), (0, "b.json", "bad_json", 0), (0, "d.json", "bad_json", 0), (0, "e.json", "read", 0), (1, "None", "missing", 0)]
    index, report = files.content_index_of(spark, f"file://{tmp_path}/nowhere")
    assert index.count() == 0 and report.count() == 1


def test_order_of_arrival_decides_which_duplicates_stay(spark, tmp_path):
    log = "\n".join(["error: the very same"] + ["x"] * 30)
    rows = [(f"z{9 - i}", i, log) for i in range(8)]
    path = f"file://{tmp_path}/logs"
    sources.write_logs(spark.createDataFrame(rows, LOGS).withColumn("repository", F.lit("r")), path, file_bytes=600, order="ord")
    kept = triage.triage(sources.read_logs(spark, path)).filter("reason is null")
    assert sorted(r.log_id for r in kept.collect()) == ["z8", "z9"]


def test_only_named_files_are_opened(spark, tmp_path):
    root = Path(tmp_path, "files")
    for i in range(40):
        (root / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 3}" / f"f {i}.log").write_text(f"log {i}\r\nend" if i % 5 else "\n\r\n")
    entries = [{"repo": f"r{i % 2}", "failed_build": "yes" if i % 4 else "", "failed_build_id": str(i), "path": None if i == 6 else f"d{i % 3}/f {i}.log" if i != 7 else "d1/gone.log"} for i in range(40)]
    Path(tmp_path, "index.json").write_text(json.dumps(entries))
    got = files.read_artifact_logs(spark, f"file://{tmp_path}/index.json", f"file://{root}", num_logs=12)
    first = [e for e in entries if e["failed_build"]][:12]
    want = {f"bs_{e['repo']}_{e['failed_build_id']}": f"log {e['failed_build_id']}\r\nend" for e in first if e["path"] and "gone" not in e["path"] and int(e["failed_build_id"]) % 5}
    assert {r.log_id: r.log_content for r in got.collect()} == want and 5 < len(want) < 12
    few = files.whole_files(spark, f"file://{root}", ["d1/f 1.log", "d2/none"])
    assert [(r.file, r.value) for r in few.collect()] == [("d1/f 1.log", "log 1\r\nend")]
    (root / "d1" / "damaged.gz").write_text("opening this fails")
    assert files.whole_files(spark, f"file://{root}", ["d1/f 1.log"]).count() == 1  # the others are dropped as they are listed
    with pytest.raises(Exception, match="damaged.gz|gzip"):
        files.whole_files(spark, f"file://{root}").select("value").collect()
    assert files.whole_files(spark, f"file://{root}", []).count() == 0


def test_upserts_rewrite_the_buckets_they_touch(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    make = lambda rows: spark.createDataFrame(rows, "log_id string, ord long, note string")
    store = keyed.KeyedTable(spark, path, "log_id string, ord long, note string", buckets=16)
    assert store.read().count() == 0 and store.upsert(make([])) == 0
    base = [(f"k{i}", i, f"first {i}") for i in range(200)]
    assert store.upsert(make([*base, (None, 1, "no key"), ("k3", 1, "older")])) == 1
    before = store.folders()
    stamps = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "store", "data").rglob("*.parquet")}
    new = [("k3", 900, "second"), ("k7", 2, "too old"), ("k8", 8, "same order"), ("new", 1, "added")]
    again = keyed.KeyedTable(spark, path, "log_id string, ord long, note string")
    assert again.buckets == 16 and again.upsert(make(new).repartition(3)) == 2
    after = store.folders()
    touched = {r.b for r in make(new).select(store.bucket(F.col("log_id")).alias("b")).collect()}
    assert {b for b in before if before[b] != after[b]} == touched & set(before) and len(touched) < 6
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items())
    want = {k: (o, n) for k, o, n in base} | {"k3": (900, "second"), "k8": (8, "same order"), "new": (1, "added")}
    assert {r.log_id: (r.ord, r.note) for r in store.read().collect()} == want
    assert {r.log_id: (r.ord, r.note) for r in store.read(1).collect()} == {k: (o, n) for k, o, n in base}
    assert sorted(tuple(r) for r in store.get("k3", "k5", "absent").collect()) == [("k3", 900, "second"), ("k5", 5, "first 5")]
    assert store.vacuum() > 0 and {r.log_id: (r.ord, r.note) for r in store.read().collect()} == want and store.version() == 2
    assert store.vacuum() == 0


def test_a_writer_that_dies_or_comes_late_changes_nothing(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/store", "log_id string, ord long, note string"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    store = keyed.KeyedTable(spark, path, schema, buckets=4)
    store.upsert(make(("a", 1, "x"), ("b", 1, "x")))
    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            store.upsert(make(("a", 2, "lost")))
    assert store.version() == 1 and {r.note for r in store.read().collect()} == {"x"}
    publish = keyed.KeyedTable._publish
    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_publish", lambda self, n, state: (m.undo(), store.upsert(make(("c", 1, "theirs"))), publish(self, n, state)))
        with pytest.raises(keyed.Conflict):
            store.upsert(make(("a", 3, "late")))
    assert store.version() == 2 and sorted((r.log_id, r.note) for r in store.read().collect()) == [("a", "x"), ("b", "x"), ("c", "theirs")]
    assert store.upsert(make(("a", 3, "now"))) == 3 and store.get("a").first().note == "now"


def test_packed_artifacts_are_read_by_the_index(spark, tmp_path):
    root, index = f"file://{tmp_path}/packed", f"file://{tmp_path}/index.json"
    rows = [(f"d{i % 3}/f {i}.log", f"log {i}\r\nend" if i % 5 else "\n") for i in range(40)]
    files.write_packed(spark.createDataFrame(rows, "file string, value string").repartition(5), root)
    assert len([p for p in Path(tmp_path, "packed").rglob("*.parquet")]) < len(rows)
    entries = [{"repo": "r", "failed_build": "yes" if i % 4 else "", "failed_build_id": str(i), "path": f"d{i % 3}/f {i}.log" if i != 7 else "gone.log"} for i in range(40)]
    Path(tmp_path, "index.json").write_text(json.dumps(entries))
    got = files.read_artifact_logs(spark, index, root, num_logs=12, packed=True)
    assert {r.log_id: r.log_content for r in got.collect()} == {f"bs_r_{i}": f"log {i}\r\nend" for i in range(16) if i % 4 and i % 5 and i != 7}
    Path(tmp_path, "index.json").write_text("[]")
    assert files.read_artifact_logs(spark, index, root, packed=True).count() == 0


def test_arrays_are_written_in_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files.storage, "stored", lambda *_, **__: pytest.fail("rows are written twice"))
    df = spark.createDataFrame([(f"l{i:03d}", "é" * (i % 50)) for i in range(300)], "log_id string, log_content string").repartition(3)
    files.write_arrays(df, f"file://{tmp_path}/rows", file_bytes=900, head='{"own": [', tail='], "total": {n}}')
    held = [json.loads(p.read_text()) for p in sorted(Path(tmp_path, "rows").rglob("part-*")) if p.is_file()]
    assert all(x["total"] == len(x["own"]) for x in held) and [r["log_id"] for x in held for r in x["own"]] == [f"l{i:03d}" for i in range(300)]
    assert all(p.stat().st_size <= 901 for p in Path(tmp_path, "rows").rglob("part-*") if p.is_file())


def test_arrays_without_an_order_move_no_row(spark, tmp_path):
    df = spark.range(300, numPartitions=3).select(F.format_string("l%03d", 299 - F.col("id")).alias("log_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("log_content"))
    files.write_arrays(df, f"file://{tmp_path}/rows", file_bytes=900, order=None)
    written = [p for p in Path(tmp_path, "rows").iterdir() if p.name.startswith("part-")]
    held = [[x["log_id"] for x in json.loads(p.read_text())] for p in written]
    assert len(written) > 15 and all(p.stat().st_size <= 901 for p in written)
    want = [r.log_id for r in df.collect()]
    assert sorted((x for own in held for x in own), reverse=True) == want
    places = [[want.index(x) for x in own] for own in held]
    assert all(own == list(range(own[0], own[0] + len(own))) and own[0] // 100 == own[-1] // 100 for own in places)  # as they came, from one partition
    index, report = files.content_index_of(spark, f"file://{tmp_path}/rows")
    assert index.count() == 294 and {(r.status) for r in report.collect()} == {"read"}
    empty = f"file://{tmp_path}/none"
    files.write_arrays(df.limit(0), empty, order=None)
    assert files.content_index_of(spark, empty)[0].count() == 0
