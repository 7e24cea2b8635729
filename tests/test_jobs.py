"""Rules on hand-made rows, and queries against their SQL."""

import io
import math
import zipfile
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.functions.text import strip
from faultline.operators import baselines, grounding, metrics, reduction, retrieval, stats, study, triage
from faultline.plans.queries import ORACLES, QUERIES
from faultline.sources import logs as sources
from faultline.sources import storage

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted(str([r[c] if not isinstance(r[c], float) else f"{r[c]:.5g}" for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("name", "t7_triage_events t7_triage_documents t7_kept_in_order t7_removed t8_report t8_written t1_t6_rules l3_l4_smart_filter l6_truncated l7_detected_lines b1_regex_baseline b2_heuristic_baseline g1_line_map g4_scores e2_metrics e15_aligned e19_baseline_report e11_baseline_accuracy e17_metric h5_by_experience h8_assignments h8_assignments_of_all s1_read_logs s3_unzipped s6_annotations s9_csv s10_appended_steps r2_page_links r4_chunks r5_nearest r5_nearest_filtered r6_routed_by_mentions r7_docs_block r11_updated_index".split())
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = c.execute(ORACLES[name])
    names = [x[0] for x in got.description]
    want = sorted(str([r[k] if not isinstance(r[k], float) else f"{r[k]:.5g}" for k in sorted(names)]) for r in (dict(zip(names, x, strict=True)) for x in got.fetchall()))
    assert rows(QUERIES[name](spark, D)) == want


def test_signature_ignores_times_colours_addresses(spark):
    lines = ["\x1b[31m2024-10-01T10:00:00.123Z error at 0xDEAD42 here\x1b[0m", "error: 3456", "error: 34567"]
    df = spark.createDataFrame([("\n".join(lines),), ("",), (None,)], "c string").select(triage.error_signature(F.col("c")).alias("s"))
    got = [r.s for r in df.collect()]
    assert got == ["22b8d05b92ad", "d41d8cd98f00", "d41d8cd98f00"]


def test_noise_rules(spark):
    texts = ["The Operation Was CANCELED", "401\nUnauthorized", "401\rUnauthorized", "", None]
    c = F.col("c")
    got = spark.createDataFrame([(t,) for t in texts], "c string").select(triage.is_cancelled(c).alias("a"), triage.is_token_error(c).alias("b"), triage.is_too_short(c, 2).alias("s")).collect()
    assert [r.a for r in got] == [True, False, False, False, False]
    assert [r.b for r in got] == [False, False, True, False, False]
    assert [r.s for r in got] == [True, False, True, True, True]


def test_case_folds_as_patterns_fold_it(spark):
    """Literals looked for in a lower-cased text against regular expressions without regard to case."""
    texts = ["the operation was CANCELED", "The operation wa\u017f canceled", "BAD CREDENT\u0130ALS", "bad credent\u0131als", "Resource not access\u0130ble by \u0130ntegration", "the runner has received a \u017fhutdown signal", "é 401 UNAUTHOR\u0131ZED", "401\nUnauthorized", "401 x\u2028 unauthorized", "unauthorized 401", "cancelling \u017fince a higher priority waiting request", "Cancelling since a higher priority waiting reque\u017ft é", "ünauthorized 401", "straße", ""]
    c = F.col("c")
    pattern = lambda p: F.coalesce(c, F.lit("")).rlike("(?iud)" + "|".join(f"(?:{x})" for x in p))
    got = spark.createDataFrame([(t,) for t in texts], "c string").select(triage.is_cancelled(c).alias("a"), pattern(triage.CANCELLED).alias("wa"), triage.is_token_error(c).alias("b"), pattern(triage.TOKEN_ERRORS).alias("wb")).collect()
    assert [(r.a, r.b) for r in got] == [(r.wa, r.wb) for r in got]
    assert sum(r.a for r in got) == 5 and sum(r.b for r in got) == 5


def test_kept_and_removed_are_written_in_one_job(spark, tmp_path):
    texts = ["failed", "plain", "error: x", "error: x", "error: x", "401 unauthorized"]
    df = spark.createDataFrame([(str(i), i, "r", f"{t} and some more text\n" * 30) for i, t in enumerate(texts)] + [("short", 9, "r", "x")], "log_id string, ord long, repository string, log_content string")
    path, made = f"file://{tmp_path}/out", triage.triage(df)
    told = triage.write_triaged(made, path)
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, triage.report(made).collect()))
    back = spark.read.parquet(path)
    assert {r.outcome: r["count"] for r in back.groupBy("outcome").count().collect()} == {"kept": 4, "removed": 3}
    assert sorted(str(r[:6]) for r in back.select(*made.columns).collect()) == sorted(str(r[:6]) for r in made.collect())
    scans = triage.report(made)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    assert scans == 2  # the logs, and the three levels


def cut_by_loop(lines, budget):
    size = lambda x: len("\n".join(x)) // 4
    if size(lines) <= budget:
        return "\n".join(lines)
    head, tail = lines[: len(lines) // 2], lines[len(lines) // 2 :]
    while size([*head, reduction.MARKER, *tail]) > budget and (len(head) > 5 or len(tail) > 5):
        if len(tail) >= len(head) and len(tail) > 5:
            tail = tail[1:]
        elif len(head) > 5:
            head = head[:-1]
        else:
            tail = tail[1:]
    return "\n".join([*head, reduction.MARKER, *tail])


def test_cut_equals_the_loop(spark):
    cases = {f"{n}-{b}": (["x" * (7 * i % 23) for i in range(n)], b) for n in (4, 9, 10, 11, 12, 25) for b in (5, 40)}
    for budget in (5, 40):
        own = {k: v for k, (v, b) in cases.items() if b == budget}
        df = spark.createDataFrame([(k, i + 1, t) for k, v in own.items() for i, t in enumerate(v)], "log_id string, rank int, text string")
        got = {r.log_id: r.filtered for r in reduction.truncated(df, max_tokens=budget).collect()}
        assert got == {k: cut_by_loop(v, budget) for k, v in own.items()}


def test_ties_of_the_heuristic(spark):
    c = F.col("c")
    df = spark.createDataFrame([("build.gradle",), ("module test",), ("",)], "c string").select(baselines.heuristic_type(baselines.heuristic_counts(c)).alias("t"))
    assert [r.t for r in df.collect()] == ["build_configuration", "dependency_error", "unknown"]


def test_overlap_of_lines(spark):
    df = spark.createDataFrame([([1, 1, 2], [2, 3]), ([1], []), ([], [1])], "predicted_lines array<int>, actual_lines array<int>")
    got = [(r.line_precision, r.line_recall, r.line_f1) for r in metrics.line_overlap(df).collect()]
    assert got == [(0.5, 0.5, 0.5), (0, 0, 0), (0, 0, 0)]


def test_grounding(spark):
    filtered = spark.createDataFrame([("a", "[Line 3] abxd\n[Line 4] the error is here"), ("b", "plain")], "log_id string, filtered string")
    evidence = spark.createDataFrame([("a", 0, 3, "abcd"), ("a", 1, 4, "error is"), ("a", 2, 9, "error"), ("a", 3, 4, " "), ("b", 0, 0, "plain")], "log_id string, evidence_no int, line_number int, cited string")
    got = {(r.log_id, r.evidence_no): r.verified for r in grounding.verified(evidence, grounding.line_map(filtered)).collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 3): False, ("b", 0): True}


def test_paired_tests(spark):
    df = spark.createDataFrame([("x", 5, 1, 2, 3, 4), ("y", 5, 0, 0, 3, 3), ("z", 9, 2, 2, 5, 5)], "k string, n long, n10 long, n01 long, right_a long, right_b long")
    got = {r.k: r for r in stats.permutation(stats.mcnemar(df).drop("verdict").withColumnRenamed("p_value", "p")).collect()}
    assert (got["x"].chi2, got["x"].p, got["y"].chi2, got["y"].p, got["z"].chi2) == (0, 1, 0, 1, 0.25)
    assert got["x"].p_value == 1 and got["x"].difference == pytest.approx(-0.2)
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803)


def test_strip(spark):
    assert spark.createDataFrame([("  a b\t\n",)], "c string").select(strip(F.col("c")).alias("c")).first().c == "a b"


def test_docs_block_of_whole_texts(spark):
    name = "r7_docs_block_routed"
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = {r.log_id: r.block for r in QUERIES[name](spark, D).collect()}
    assert got == dict(c.execute(ORACLES[name]).fetchall()) and len(got) > 5
    used = {r[0]: r[1:] for r in c.execute("select doc_id, source, coalesce(text, ''), lang from documents").fetchall()}
    routed = [(r.log_id, r.chunk_id) for r in QUERIES["r6_routed"](spark, D).collect() if r.chunk_id in used]
    assert all(f"[Documentation from {used[k][0]} - {k}]\n{used[k][1]}\nSource: {used[k][2]}" in got[log] for log, k in routed)
    assert any(k >= 20 for _, k in routed) and any(len(used[k][1]) > 20 for _, k in routed)


def test_metrics_by_temperature(spark):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = c.execute(ORACLES["e8_temperature"]).df().sort_values("temperature")
    got = QUERIES["e8_temperature"](spark, D).toPandas().sort_values("temperature")
    assert got["temperature"].tolist() == [0.0, 0.1, 0.3, 0.5, 0.7, 1.0] and sorted(got.columns) == sorted(want.columns)
    for name in got.columns:
        assert got[name].tolist() == pytest.approx(want[name].tolist(), rel=1e-5)


def test_repeated_logs_count_each(spark):
    log = "\n".join(["error: the very same"] + ["x"] * 30)
    df = spark.createDataFrame([("a", 1, "r", log)] * 3 + [(None, None, "r", log), ("b", 2, "r", "short")], "log_id string, ord long, repository string, log_content string")
    got = triage.triage(df)
    assert sorted((str(r.log_id), str(r.reason)) for r in got.collect()) == [("None", "None"), ("a", "None"), ("a", "duplicate_error"), ("a", "duplicate_error"), ("b", "too_short")]
    assert got.count() == 5 and triage.triage(df.limit(0)).count() == 0
    assert sorted(str(r.signature is None) + r.reason for r in triage.removed(got).collect()) == ["Falseduplicate_error", "Falseduplicate_error", "Truetoo_short"]


def test_cap_over_many_parts(spark):
    log = "\n".join(["fatal: one and the same"] + ["x"] * 30)
    df = spark.createDataFrame([(f"l{i:04d}", i, f"r{i % 2}", log) for i in range(400)], "log_id string, ord long, repository string, log_content string")
    kept = triage.kept_in_order(triage.triage(df, max_duplicates=3)).collect()
    assert [r.log_id for r in kept] == [f"l{i:04d}" for i in range(6)]
    assert {r.priority for r in kept} == {"high"}


def test_order_of_kept(spark):
    texts = ["failed", "plain", "error: x", "failure", "fatal"]
    df = spark.createDataFrame([(str(i), i, "r", f"{t} {i} something\n" * 30) for i, t in enumerate(texts)], "log_id string, ord long, repository string, log_content string")
    kept = triage.kept_in_order(triage.triage(df))
    numbered = storage.numbered(kept.repartition(3).orderBy("priority", "ord"), "place")
    assert [r.log_id for r in kept.collect()] == ["2", "4", "0", "3", "1"]
    assert sorted(r.place for r in numbered.collect()) == [1, 2, 3, 4, 5]


def test_line_numbers_of_any_length(spark):
    filtered = spark.createDataFrame([("a", "[Line 99999999999] far\n[Line 123456789012345678901234567890] none\n[Line 2] first\n[Line 2] last"), ("b", None)], "log_id string, filtered string")
    got = {(r.log_id, r.line_number): r.content for r in grounding.line_map(filtered).collect()}
    assert got == {("a", 99999999999): "far", ("a", 2): "last", ("b", 0): ""}
    wanted = spark.createDataFrame([("a", 2), ("a", 5), ("c", 1)], "log_id string, line_number int")
    assert [(r.line_number, r.content) for r in grounding.line_map(filtered, wanted).collect()] == [(2, "last")]


def test_fuzzy_evidence_against_difflib(spark):
    got = QUERIES["g3_fuzzy"](spark, D).collect()
    evidence = {(r.log_id, r.line_number): r.cited for r in __import__("faultline.plans.queries", fromlist=["_evidence"])._evidence(spark, D).collect()}
    lines = {r.log_id: r.log_content.split("\n") for r in __import__("faultline.sources.views", fromlist=["event_logs"]).event_logs(spark, D).collect()}
    assert len(got) == len(evidence) > 100
    for r in got:
        cited, actual = evidence[r.log_id, r.line_number].strip(), lines[r.log_id][r.line_number]
        assert r.verified == (cited != "" and (cited in actual or SequenceMatcher(None, cited, actual.strip()).ratio() >= 0.75))


def test_pages_and_links(spark):
    html = [
        "<html><title> T &amp; U </title><nav><div class='content'>menu</div></nav><article><p>Body</p><script>x()</script></article></html>",
        "<body><header><main>no</main></header>plain <b>text</b></body>",
        "<div id=content>by id<footer>gone</footer></div><main></main>",
        "<main><p>one<p>two</main><article>three</article>",
        None,
        "",
    ]
    pages = spark.createDataFrame([("s", f"http://h/{i}", h) for i, h in enumerate(html)], "source string, url string, html string")
    got = {r.url[-1]: (r.title, r.content) for r in retrieval.page_text(pages).collect()}
    assert got["0"] == ("T & U", "Body") and got["1"] == ("http://h/1", "plain\ntext") and got["3"] == ("http://h/3", "one\ntwo") and not {"4", "5"} & got.keys()
    links = """<nav-bar><a href='/one'>x</a></nav-bar><a class=x href=two.html>y</a><a href="http://b.org/?a=1&amp;b=2">z</a><nav ><a href="/gone"></a></nav><a data-href="no">n</a><A HREF = "/one">again</A><abbr href="/not">"""
    df = spark.createDataFrame([(links, "http://b.org/d/page")], "html string, url string")
    assert df.select(retrieval.page_links(F.col("html"), F.col("url"), F.lit("http://b.org")).alias("x")).first().x == ["http://b.org/one", "http://b.org/d/two.html", "http://b.org/?a=1&b=2"]


def test_archives_of_any_kind(spark):
    def zipped(**files):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
        return raw.getvalue()

    good = zipped(b="two", a="one")
    damaged = bytearray(zipped(a="x" * 50))
    damaged[40] ^= 0xFF
    df = spark.createDataFrame([("1", bytearray(good)), ("2", bytearray(b"no archive")), ("3", None), ("4", damaged), ("5", bytearray(zipped()))], "run_id string, content binary")
    parts = sources.members(df)
    got = {r.run_id: r.log_content for r in sources.assembled(parts).collect()}
    assert got["1"] == "=== a ===\none\n=== b ===\ntwo" and got["2"] == "no archive" and "3" not in got and "5" not in got
    assert [r.name for r in parts.filter("run_id = '4'").collect()] == [None]


def test_archives_come_and_go_in_batches(spark, monkeypatch):
    monkeypatch.setattr(sources, "HELD_BYTES", 2000)
    texts = ["", None, "é" * 30, "k-1", "x" * 63, "x" * 64, "abc" * 3000, "y" * 5000] * 50
    df = spark.createDataFrame([(i, f"f{i}.txt", t) for i, t in enumerate(texts)], "run_id long, name string, content string").repartition(2)
    packed = sources.archives(df)
    assert all(len(r.content) < 400 for r in packed.collect())  # long files shrink
    parts = sources.members(packed)
    assert sorted(map(tuple, parts.collect())) == [(i, f"f{i}.txt", t or "") for i, t in enumerate(texts)]
    held = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, *_: held.append(run))
    rows = pa.RecordBatch.from_pydict({"run_id": list(range(1000)), "name": ["a"] * 1000, "content": ["short"] * 1000})
    sources.archives(df), sources.members(packed)
    made = list(held[0]([rows]))
    assert sum(b.num_rows for b in made) == 1000 and 1 < len(made) < 100
    out = list(held[1](made))
    assert sum(b.num_rows for b in out) == 1000 and len(out) <= 2 * len(made)  # not a batch for each archive


def test_bare_and_enveloped_annotations(spark, tmp_path):
    df = spark.createDataFrame([(f"l{i}", i % 2 == 0, i) for i in range(7)], "log_id string, type_correct boolean, quality_rating int")
    sources.write_annotations(df, f"file://{tmp_path}/e", "2024-01-01", file_bytes=300)
    sources.write_logs(df, f"file://{tmp_path}/b", file_bytes=300)
    for part in "eb":
        got = sources.read_annotations(spark, f"file://{tmp_path}/{part}").select(*df.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_nearest_with_ties_over_blocks(spark):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 3, (60, 4)).astype(float)
    chunks = spark.createDataFrame([(i, f"s{i % 2}", p.tolist()) for i, p in enumerate(points)], "chunk_id long, source string, embedding array<double>")
    asked = spark.createDataFrame([(i, points[i].tolist(), f"s{i % 2}") for i in range(0, 60, 7)], "query_id long, embedding array<double>, source_filter string")
    for filtered in (False, True):
        for blocks in ((1000, 1000), (2, 7)):
            got = retrieval.nearest(asked if filtered else asked.drop("source_filter"), chunks, 4, *blocks).collect()
            for q in range(0, 60, 7):
                own = [i for i in range(60) if not filtered or i % 2 == q % 2]
                want = sorted(own, key=lambda i, q=q: (((points[i] - points[q]) ** 2).sum(), i))[:4]
                assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert retrieval.nearest(asked.limit(0), chunks).count() == 0 and retrieval.nearest(asked, chunks.limit(0)).count() == 0


def binomial(n, p, k):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_intervals_are_those_of_the_binomial(spark):
    df = spark.createDataFrame([("a", 8, 5), ("b", 400, 300), ("c", 0, 0)], "k string, n long, right long")
    got = {r.k: r for r in stats.bootstrap_accuracy(df, "k", resamples=4000).collect()}
    assert got["a"].observed == 0.625 and got["a"].lower == 0.25 and got["a"].upper in (0.875, 1.0)
    low, high = (next(k for k in range(401) if binomial(400, 0.75, k) >= q) / 400 for q in (0.025, 0.975))
    assert abs(got["b"].lower - low) <= 0.006 and abs(got["b"].upper - high) <= 0.006 and got["c"].observed == 0


def test_sign_flips_are_those_of_the_binomial(spark):
    cases = [(12, 3), (5, 5), (1, 0), (30, 12)]
    df = spark.createDataFrame([(str(i), 100, a, b, 50 + a, 50 + b) for i, (a, b) in enumerate(cases)], "k string, n long, n10 long, n01 long, right_a long, right_b long")
    got = {r.k: r.p_value for r in stats.permutation(df, flips=40_000).collect()}
    for i, (a, b) in enumerate(cases):
        m, far = a + b, abs(a - b)
        exact = sum(math.comb(m, k) for k in range(m + 1) if abs(2 * k - m) >= far) / 2**m
        assert got[str(i)] == pytest.approx(exact, abs=0.012)


def test_sections_are_packed_in_order(spark):
    text = "Intro\n" + "\n\n".join(["p" * 300, "q" * 300, "r" * 100]) + "\nNext\nshort"
    got = retrieval.chunks(spark.createDataFrame([("s", "u", text)], "source string, url string, content string")).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.title, r.content) for r in got] == [(0, "Intro", "p" * 300), (1, "Intro", "q" * 300 + "\n\n" + "r" * 100), (2, "Next", "short")]


def test_pooled_t_and_its_p(spark):
    """Two small arms by hand: means 10 and 14, pooled variance 4, so t = 4 / sqrt(4 * (1/4 + 1/4)) = 2.828... with 6 degrees."""
    times = {True: [8.0, 9.0, 11.0, 12.0], False: [12.0, 13.0, 15.0, 16.0]}
    df = spark.createDataFrame([(w, t) for w, own in times.items() for t in own], "with_assistance boolean, time_to_insight double")
    r = study.time_to_insight(df).first()
    var = 10 / 3
    assert r.t == pytest.approx(4 / math.sqrt(var / 2)) and r.df == 6 and r.reduction_percent == pytest.approx((1 - 10 / 14) * 100)
    # For 6 degrees: P(|T| > t) = 1 - x (1 + a / 2 + 3 a^2 / 8) with x = t / sqrt(6 + t^2) and a = 6 / (6 + t^2).
    x, a = r.t / math.sqrt(6 + r.t**2), 6 / (6 + r.t**2)
    assert r.p_value == pytest.approx(1 - x * (1 + a / 2 + 3 * a * a / 8), abs=1e-12)
    alone = study.time_to_insight(df.filter("with_assistance")).first()
    assert alone.mean_without is None and alone.t is None and (alone.p_value is None or math.isnan(alone.p_value))


def test_assignments_alternate(spark):
    logs = spark.createDataFrame([(f"l{i}", 100 - i) for i in range(12)], "log_id string, ord long").repartition(4)
    got = study.assignments(logs).orderBy("position").collect()
    assert [(r.task_id, r.with_assistance) for r in got] == [(f"task_l{11 - i}_{i}", i % 2 == 0) for i in range(8)]
    assert study.assignments(logs.limit(0)).count() == 0


def test_a_file_without_content_keeps_its_heading(spark):
    parts = spark.createDataFrame([("1", "a", None), ("1", "b", "two"), ("2", None, None)], "run_id string, name string, content string")
    assert {r.run_id: r.log_content for r in sources.assembled(parts).collect()} == {"1": "=== a ===\n\n=== b ===\ntwo", "2": ""}


def test_totals_of_no_annotations(spark):
    none = spark.createDataFrame([], "failure_type string, confidence double")
    assert [tuple(r) for r in sources.annotation_stats(none).collect()] == [("total", None, 0, None)]
