"""Replies of models, good and bad, and what is still to do."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline.operators import model_io
from faultline.plans.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
GOOD = {"error_type": "timeout", "failure_lines": [1, 2], "root_cause": "r", "suggested_fix": "s", "confidence_score": 0.5, "grounded_evidence": [{"line_number": 3, "content": "x"}], "reasoning": "w"}


def changed(**fields):
    return json.dumps({k: v for k, v in (GOOD | fields).items() if v != "gone"})


CASES = [
    (json.dumps(GOOD), None, None), (f"prose {json.dumps(GOOD)} more prose", None, None), (changed(grounded_evidence="gone"), None, None), (changed(confidence_score=0), None, None), (changed(confidence_score=1), None, None), (changed(extra={"a": 1}), None, None),
    (None, "bad_json", None), ("", "bad_json", None), ("no braces", "bad_json", None), ("[1, 2]", "bad_json", None), (json.dumps(GOOD)[:-5], "bad_json", None), (json.dumps(GOOD) * 2, "bad_json", None), ("{}", "missing_field", "error_type"),
    *((changed(**{f: "gone"}), "missing_field", f) for f in model_io.REQUIRED), (changed(reasoning=None), "missing_field", "reasoning"),
    (changed(confidence_score="high"), "bad_field", "confidence_score"), (changed(failure_lines="all"), "bad_field", "failure_lines"), (changed(failure_lines=[1, None]), "bad_field", "failure_lines"), (changed(grounded_evidence=[{"content": "no line"}]), "bad_field", "grounded_evidence"), (changed(grounded_evidence="none"), "bad_field", "grounded_evidence"),
    (changed(error_type="bad luck"), "unknown_type", "bad luck"), (changed(error_type="Timeout"), "unknown_type", "Timeout"), (changed(confidence_score=7), "out_of_range", "7"), (changed(confidence_score=-0.01), "out_of_range", "-0.01"), (changed(error_type="x", confidence_score=7), "unknown_type", "x"),
]


def test_every_reply_is_good_or_has_a_reason(spark):
    df = spark.createDataFrame([(i, c[0], "kept") for i, c in enumerate(CASES)], "id int, reply string, note string")
    good, bad = model_io.good_and_bad(df)
    assert {r.id: (r.reason, r.detail) for r in bad.collect()} == {i: c[1:] for i, c in enumerate(CASES) if c[1]}
    got = {r.id: r.diagnosis for r in good.collect()}
    assert sorted(got) == [i for i, c in enumerate(CASES) if not c[1]] and good.columns == ["id", "reply", "note", "diagnosis"]
    assert got[0].failure_lines == [1, 2] and got[0].grounded_evidence[0].line_number == 3 and got[2].grounded_evidence is None
    assert all(c.count() == 0 for c in model_io.good_and_bad(df.limit(0)))


def test_range_is_that_of_the_grounded_confidence(spark):
    df = spark.createDataFrame([(changed(confidence_score=1.6), 0.5), (changed(confidence_score=1.6), 1.0), (changed(confidence_score=0.5), None)], "reply string, g double")
    assert [r.reason for r in model_io.judged(df, grounding=F.col("g")).collect()] == [None, "out_of_range", None]


def test_a_reply_is_parsed_once(spark):
    """Parsing isn't repeated for each field that is looked at, nor in the filter below."""
    df = spark.createDataFrame([(c[0],) for c in CASES], "reply string")
    for part in model_io.good_and_bad(df):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract") == 1 and plan.count("from_json") + plan.count("jsontostructs") <= 2, plan
    seen = df.select(model_io.parsed(F.col("reply")).alias("p")).select("p.error_type", "p.failure_lines")
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
    assert [r.error_type for r in seen.collect()][:2] == ["timeout", "timeout"]


@pytest.mark.parametrize("name", ["p2_good_replies", "p2_bad_replies"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{D}/conversations.parquet'")
    got = c.execute(ORACLES[name])
    names = [x[0] for x in got.description]
    want = sorted(str([v for _, v in sorted(zip(names, r, strict=True))]) for r in got.fetchall())
    assert sorted(str([r[k] for k in sorted(names)]) for r in QUERIES[name](spark, D).collect()) == want and want


def test_limit_is_on_the_input(spark):
    logs = spark.createDataFrame([(f"l{i}", i) for i in range(10)], "log_id string, ord long").repartition(3)
    done = spark.createDataFrame([("l0",), ("l2",), ("l2",), ("l9",)], "log_id string")
    assert sorted(r.log_id for r in model_io.pending(logs, done, 4).collect()) == ["l1", "l3"]
    assert model_io.pending(logs, done).count() == 7
