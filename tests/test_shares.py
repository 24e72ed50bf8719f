"""What one task takes: tables dealt by their number of rows, and operators that meet a table once."""

from pyspark.sql import functions as F

from tracelode.functions import cluster
from tracelode.operators import intervals, judgments, responses
from tracelode.plans import fixtures

SF = "/root/testdata/sf0.001"


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(cluster, "ROWS", 500)
    lines = fixtures.table(spark, SF, "lineitem").count()
    for rows, key in ((fixtures.grades(spark, SF), "task_id"), (fixtures.intervals(spark, SF), "session"), (fixtures.attempts(spark, SF), "task")):
        at = rows.select(key, F.spark_partition_id().alias("p")).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        assert rows.rdd.getNumPartitions() == -(-lines // 500)
        assert at.filter("n > 1").isEmpty()


def test_segments_around_intervals_outside_the_trim(spark):
    m = spark.createDataFrame([(1, 0.0, 1.0), (1, 3.0, 4.0), (1, 6.0, 7.0), (1, 9.0, 12.0), (2, 0.0, 1.0), (2, 20.0, 30.0), (4, 1.0, 2.0)], "session long, start_s double, end_s double")
    trims = spark.createDataFrame([(1, 2.0, 10.0), (2, 2.0, 10.0), (3, 2.0, 10.0), (None, 2.0, 10.0)], "session long, trim_start_s double, trim_end_s double")
    got = intervals.keep_segments(trims, m)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2.0, 3.0), (1, 4.0, 6.0), (1, 7.0, 9.0), (2, 2.0, 10.0), (3, 2.0, 10.0)]
    # The intervals meet their trims once, and gaps come out of that join.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_a_prediction_meets_its_grades_as_one_row(spark):
    p = spark.createDataFrame([("s", "t1", "t1", "ok"), ("s", "t2", "t2", "ok")], "system string, task_id string, own_task_id string, status string")
    g = spark.createDataFrame([("s", "t1", "D1", "G"), ("s", "t1", "D1", "X"), ("s", "t1", "D2", None), ("r", "t1", "D3", "G")], "system string, task_id string, dim string, grade string")
    spec = spark.createDataFrame([("t1", d, True) for d in ("D3", "D2", "D1")] + [("t2", "D1", None)], "task_id string, dim string, applicable boolean")
    got = judgments.validate_prediction(p, g, spec)
    assert {r.task_id: r.errors for r in got.collect()} == {"t1": ["D1:unknown", "D2:missing", "D3:missing"], "t2": []}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_flags_go_through_python_once(spark):
    rounds = spark.createDataFrame([(1, 1, 0, 2, "Ｗhat  now？"), (1, 2, 2, None, "é")], "session long, rn long, turn long, next_turn long, text string")
    said = spark.createDataFrame([(1, 0, "</response> What now?"), (1, 1, "</response> ＬＥＴ ＭＥ ｋｅｅｐ ｌｏｏｋｉｎｇ"), (1, 2, "</response> e\u0301 </response>\r\n"), (1, 3, None), (1, 4, "</response> 火")], "session long, turn long, text string")
    got = responses.flags(said, rounds)
    assert {r.t: (r.kind, r.deferred, r.echo, r.completes) for r in got.collect()} == {
        0: ("substantive_response", False, True, False), 1: ("substantive_response", True, False, False), 2: ("unexpected_response_closer", False, False, False), 3: ("empty_output", False, False, False), 4: ("substantive_response", False, False, True),
    }
    assert got._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1
