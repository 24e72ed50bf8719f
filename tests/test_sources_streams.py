"""Sources and sinks on small files, and streams against the batch result of the same rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracelode import plans
from tracelode.operators import intervals, responses
from tracelode.plans import fixtures
from tracelode.sources import files, trees
from tracelode.streaming import ordered, sessions

SF = "/root/testdata/sf0.001"
EVENTS = "session long, seq long, ts timestamp, event_id long, t_ms double, type string, source_position_s double, text string, task long, status string, t double"


def test_task_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('# note\n\n{"id": "a", "queries": [{"id": "R1", "query": "q", "query_time_s": 1}]}\n')
    assert [(r.id, r.queries[0].query_time_s) for r in files.read_tasks_jsonl(spark, str(tmp_path / "t.jsonl")).collect()] == [("a", 1.0)]
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_tasks_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "t.csv").write_text('id , query\n1,"two\nlines ""quoted"""\n , \n2,x\n')
    assert sorted((r.id, r.query) for r in files.read_tasks_csv(spark, str(tmp_path / "t.csv")).collect()) == [("1", 'two\nlines "quoted"'), ("2", "x")]


@pytest.mark.parametrize("text,lines", [('{"id": "a", "video": "1.mp4"}\n{"task_id": "b", "path": "2.mp4"}', True), ('[{"id": "a", "video": "1.mp4"}, {"id": "b", "file": "2.mp4"}]', False), ('{"videos": [{"id": "a", "video": "1.mp4"}, {"id": "b", "video": "2.mp4"}]}', False), ('{"a": "1.mp4", "b": "2.mp4"}', False)])
def test_media_index_forms(spark, tmp_path, text, lines):
    (tmp_path / "i.json").write_text(text)
    assert sorted(tuple(r) for r in files.read_media_index(spark, str(tmp_path / "i.json"), lines).collect()) == [("a", "1.mp4", 1), ("b", "2.mp4", 1)]


def test_trees_logs_summaries_artifacts(spark, tmp_path):
    for stage, task, text in (("first", "t1", '{"ok": true}'), ("first", "t2", "{broken")):
        (tmp_path / "tree" / stage / task).mkdir(parents=True)
        (tmp_path / "tree" / stage / task / "prediction.json").write_text(text)
    out = {r.task_id: r.doc for r in files.read_result_tree(spark, str(tmp_path / "tree"), "ok boolean").collect()}
    assert out["t1"].ok is True and out["t2"] is None
    (tmp_path / "log.json").write_text('{"session": "s", "seq": 1, "t_ms": 5}\nbroken\n')
    assert files.read_events(spark, str(tmp_path / "log.json")).select("seq", "t_ms").collect() == [(1, 5.0)]
    row = json.dumps({"system": "s", "task_id": "t", "attempt": 1, "status": "ok", "query_events": [{"id": "R1", "query": "q", "query_time_s": 2}], "vlm_responses": [{"t_ms": 1, "text": "a"}, {"t_ms": 2, "text": "b"}], "background_tasks": [{"task_id": "bg"}]})
    (tmp_path / "sum.json").write_text(row)
    parts = files.explode_summaries(spark.read.schema(files.SUMMARY).json(str(tmp_path / "sum.json")))
    assert parts["sessions"].count() == 1 and [r.text for r in parts["vlm_responses"].orderBy("seq").collect()] == ["a", "b"]
    assert parts["background_tasks"].select("own_task_id", "task_id").collect() == [("t", "bg")]
    a = files.read_artifacts(spark, str(tmp_path / "tree")).collect()
    assert sorted(r.bytes for r in a) == [7, 12]


def test_result_tree_holds_every_document(spark, tmp_path):
    (tmp_path / "first").mkdir()
    (tmp_path / "first" / "part-0").write_text('t1\t{"ok": true}\nt2\t{broken\nt3\t{"ok": false}\n')
    out = {(r.stage, r.task_id): r.doc for r in files.read_result_tree(spark, str(tmp_path), "ok boolean", packed=True).collect()}
    assert out["first", "t1"].ok is True and out["first", "t2"] is None and out["first", "t3"].ok is False
    got = plans.queries()["src_result_tree"](spark, SF).collect()
    want = fixtures.grades(spark, SF).select("dim", F.concat_ws("-t", "system", "task_id"), "grade", "applicable").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and len(got) > 1000


def test_packed_tree(spark, tmp_path):
    names = ["t1", 't"2\\', "t\t3\nx", "\u4e00\U0001f600", "", None]
    rows = [(stage, n, {"ok": k % 2 == 0, "n": k} if k != 4 else None) for stage in ("D1", "a=b/c d", "007") for k, n in enumerate(names)]
    p = str(tmp_path / "tree")
    files.write_packed_tree(spark.createDataFrame(rows, "stage string, task_id string, doc struct<ok:boolean,n:long>"), p)
    (tmp_path / "tree" / "stage=D1" / "part-x").write_text('{"task_id": "b1", "doc": {broken\n{"task_id":"b\\"2","doc":{"ok":"no","n":1}}\n{"task_id":"b\\"3","doc":{"ok":true,\nb4\n{"task_id":"b5","doc":[1]}\n{"task_id":"b6"}\n')
    t = files.read_packed_tree(spark, p, "ok boolean, n long")
    got = sorted(((r.stage, r.task_id, r.doc and r.doc.asDict()) for r in t.collect()), key=repr)
    broken = [("D1", n, None) for n in ("b1", 'b"2', 'b"3', None, "b5", "b6")]
    assert got == sorted(rows + broken, key=repr)
    # Whether a document can be read does not depend on the fields that are asked for.
    assert sorted((r.n for r in t.select("doc.n").collect()), key=repr) == sorted((r[2] and r[2]["n"] for r in rows + broken), key=repr)
    assert t.filter("stage = '007'").count() == len(names) and t.filter("task_id = 'b\"3'").count() == 1


def test_result_tree_parses_a_document_once(spark):
    """The JSON reader makes the fields; rows are neither cut, parsed by an expression nor given their path."""
    plan = plans.queries()["src_result_tree"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Format: JSON" in plan and not any(x in plan for x in ("from_json", "file_path", "substring_index"))


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id").cast("string"))
    p = str(tmp_path / "out")
    assert files.write_if_changed(df, p) and not files.write_if_changed(df.orderBy(F.desc("id")), p) and files.write_if_changed(df.filter("id > 0"), p)
    files.write_run_summary(df, str(tmp_path / "sum"), ["v", "id"])
    assert spark.read.csv(str(tmp_path / "sum" / "csv"), header=True).columns == ["v", "id"]


def parts_of(path):
    """The data files of an index with the times they were written at."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path + "/data") for f in fs if f.startswith("part-")}


def test_index_rewrites_changed_parts_only(spark, tmp_path):
    df = spark.range(200).select("id", F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("v"))
    df = df.unionByName(df.filter("id < 5")).unionByName(spark.createDataFrame([(None, None)], "id long, v string"))  # repeated rows and nulls
    p, schema = str(tmp_path / "index"), df.schema
    held = lambda: sorted(map(repr, files.read_index(spark, p, schema).collect()))
    of = lambda x: sorted(map(repr, x.collect()))
    assert files.write_index(df, p, ["id"], 8) == (list(range(8)), []) and held() == of(df)
    before = parts_of(p)
    assert files.write_index(df.orderBy(F.desc("id")), p, ["id"], 8) == ([], []) and parts_of(p) == before
    one = df.withColumn("v", F.when(F.col("id") == 7, "other").otherwise(F.col("v")))
    written, gone = files.write_index(one, p, ["id"], 8)
    after = parts_of(p)
    assert len(written) == 1 and not gone and held() == of(one)
    assert {f for f in after if f"index_part={written[0]}/" not in f} == {f for f, t in before.items() if after.get(f) == t}
    # A row that occurs once less is a change, and a part without rows is not read though its folder stays.
    assert len(files.write_index(one.dropDuplicates(), p, ["id"], 8)[0]) >= 1 and held() == of(one.dropDuplicates())
    few = df.filter("id = 7")
    written, gone = files.write_index(few, p, ["id"], 8)
    assert len(written) == 1 and len(gone) == 7 and held() == of(few)
    assert files.write_index(df, p, ["id"], 4)[0] == list(range(4)) and held() == of(df)
    assert files.write_index(df.limit(0), p, ["id"], 4) == ([], list(range(4))) and held() == []
    with pytest.raises(ValueError, match="index_part"):
        files.write_index(df.withColumnRenamed("v", "index_part"), p)


def test_index_mends_a_write_that_failed(spark, tmp_path, monkeypatch):
    df, p = spark.range(100), str(tmp_path / "index")
    files.write_index(df, p, ["id"], 8)
    real, calls = files._write_generation, []

    def lost(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(*a)

    monkeypatch.setattr(files, "_write_generation", lost)
    with pytest.raises(RuntimeError, match="lost"):
        files.write_index(df.filter("id != 3"), p, ["id"], 8)  # the data are new, their hashes were not written
    monkeypatch.setattr(files, "_write_generation", real)
    written, _ = files.write_index(df, p, ["id"], 8)
    assert len(written) == 1 and sorted(r.id for r in files.read_index(spark, p, df.schema).collect()) == list(range(100))


def tree_of(root, stages, tasks):
    for stage in stages:
        for task in tasks:
            (root / stage / task).mkdir(parents=True)
            (root / stage / task / "prediction.json").write_text(json.dumps({"ok": task != "t2", "n": int(task[1:])}))
            (root / stage / task / "_hidden.json").write_text("{}")


def test_result_tree_opens_only_the_folders_asked_for(spark, tmp_path):
    stages, tasks = ["first", "second", "third"], [f"t{k}" for k in range(150)]
    tree_of(tmp_path, stages, tasks)
    (tmp_path / "first" / "t0" / "prediction.json").write_text("{broken")
    (tmp_path / "first" / "t1" / "prediction.json").write_bytes(b"\xff\xfe{")
    t = trees.result_tree(spark, str(tmp_path), "ok boolean, n long")
    every = {(r.stage, r.task_id): r.doc for r in t.collect()}
    assert len(every) == 450 and every["first", "t0"] is None and every["first", "t1"] is None and every["second", "t2"].ok is False and t.rdd.getNumPartitions() == 8
    old = {(r.stage, r.task_id): r.doc for r in files.read_result_tree(spark, f"{tmp_path}/*/*/prediction.json", "ok boolean, n long").collect()}
    assert {k: v and (v.ok, v.n) for k, v in old.items()} == {k: v and (v.ok, v.n) for k, v in every.items()}
    # Folders that are not asked for cannot be read at all.
    for task in tasks:
        (tmp_path / "third" / task / "prediction.json").unlink()
        (tmp_path / "third" / task / "prediction.json").symlink_to(tmp_path / "nowhere")
    keys = lambda df: sorted((r.stage, r.task_id) for r in df.collect())
    assert len(keys(t.filter("stage = 'second'"))) == 150
    assert keys(t.filter("stage IN ('first', 'second', 'none') AND task_id IN ('t5', 't7', '../t1', '')")) == [(s, k) for s in ("first", "second") for k in ("t5", "t7")]
    assert keys(t.filter("stage = 'first' AND task_id LIKE 't14%' AND doc.n > 145")) == [("first", f"t{k}") for k in range(146, 150)]
    assert keys(t.filter("stage = 'first' AND stage = 'second'")) == [] and keys(t.filter("stage = 'none'")) == []
    assert t.filter("stage = 'second' AND task_id = 't9'").rdd.getNumPartitions() == 1


def follow(spark, tmp_path, **options):
    """One run of the query to the end of the logs; all rows that its runs have written."""
    stream = trees.follow_events(spark, str(tmp_path / "logs"), "session string, seq long", **options)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.session, r.seq) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())


def test_followed_logs_lose_and_repeat_nothing(spark, tmp_path):
    log = lambda s, n: f'{{"session": "{s}", "seq": {n}}}\n'
    (tmp_path / "logs" / "sub").mkdir(parents=True)
    a, b = tmp_path / "logs" / "a.jsonl", tmp_path / "logs" / "sub" / "b.jsonl"
    a.write_text("".join(log("a", k) for k in range(500)) + "{broken\n\n" + log("a", 500)[:9])
    assert follow(spark, tmp_path, slice_bytes=100) == [("a", k) for k in range(500)]
    with a.open("a") as f:  # the line that was being written becomes whole
        f.write(log("a", 500)[9:] + "".join(log("a", k) for k in range(501, 600)))
    b.write_text("".join(log("b", k) for k in range(40)) + log("é" * 300, 1))
    want = [("a", k) for k in range(600)] + [("b", k) for k in range(40)] + [("é" * 300, 1)]
    assert follow(spark, tmp_path, slice_bytes=100) == want
    assert follow(spark, tmp_path) == want  # a restart without new lines
    b.unlink()
    with a.open("a") as f:
        f.write(log("a", 600))
    assert follow(spark, tmp_path) == sorted([*want, ("a", 600)])
    a.write_text(log("a", 1))
    with pytest.raises(Exception, match="has become shorter"):
        follow(spark, tmp_path)


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_slices_of_a_log_hold_each_line_once(tmp_path, size):
    lines = ["", "a", "é" * 40, "x" * 150, "", "last"]
    (tmp_path / "l").write_text("\n".join(lines) + "\n" + "unfinished")
    reader = trees.LogReader(str(tmp_path), size)
    end = reader.latestOffset()
    rows = [r for p in reader.partitions({}, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["value"] for r in rows] == lines and [r["at"] for r in rows] == sorted({r["at"] for r in rows})
    (tmp_path / "empty").write_text("")
    assert reader.latestOffset() == end and reader.partitions(end, end) == []


END = -1  # a session whose one event, far in the future, lets the watermark pass all others


def rows(spark):
    """Events of eight sessions, a minute apart."""
    r = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, [sessions.PROGRESS, sessions.STALLED[0], sessions.DISCONNECTED, sessions.RESUMED[0], sessions.RESUMED[2]])), (F.col("event_id") % 5 + 1).cast("int"))
    return r.select((F.col("user_id") % 8).alias("session"), F.col("event_id").alias("seq"), F.timestamp_seconds(1_700_000_000 + F.col("event_id") * 60).alias("ts"), (F.col("event_id") % 300).alias("event_id"), (F.col("event_id") * 10.0).alias("t_ms"), kind.alias("type"), (F.col("event_id") % 100 / 10.0).alias("source_position_s"), F.col("event_type").alias("text"), (F.col("event_id") % 3).alias("task"), F.element_at(F.array(F.lit("started"), F.lit("ready"), F.lit("error")), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), (F.col("event_id") * 1.0).alias("t"))


def stream_of(spark, df, path):
    """The rows as files, read one file a trigger: in an order that is up to 25 minutes away from the log's, and an event that ends all sessions."""
    came = df.withColumn("at", F.col("seq") + F.pmod(F.hash("seq"), F.lit(25))).orderBy("at").drop("at").collect()
    for k, part in enumerate(came[i : i + 400] for i in range(0, len(came), 400)):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").json(f"{path}/{k:03d}")
    last = spark.createDataFrame([(END, 10**9)], "session long, seq long").withColumn("ts", F.timestamp_seconds(F.lit(4_000_000_000)))
    last.coalesce(1).write.json(f"{path}/999")
    return files.read_events(spark, f"{path}/*", streaming=True, schema=EVENTS)


def finished(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).filter(F.col("session") != END)


def pairs(df, *c):
    return sorted((tuple(r) for r in df.select(*c).collect()), key=repr)


def numbers(df):
    return df.select("session", "seq", "ts", F.col("t_ms").alias("wall_ms"), (F.col("source_position_s") * 900).alias("inbound_ms"), F.when(F.col("seq") % 7 == 0, F.col("t_ms") / 2).alias("query_ms"), (F.col("t_ms") - F.col("seq") % 9).alias("queued_ms"), (F.col("t_ms") / 1000).alias("t_s"), F.col("source_position_s").alias("media_s"), (F.col("seq") % 50).cast("double").alias("frame"))


def chunks(df):
    said = F.element_at(F.array(*map(F.lit, [sessions.START + "a", " b" + sessions.END, "c", sessions.QUIET, sessions.START + " d"])), (F.col("seq") % 5 + 1).cast("int"))
    return df.select("session", "seq", "ts", F.floor(F.col("seq") / 90).alias("poll"), said.alias("text"))


def frames(df):
    """Requests of several frames, some of them late or longer than a segment."""
    start = (F.col("seq") * 1.0 - F.when(F.col("seq") % 11 == 0, 40).otherwise(0)).alias("start_s")
    return df.select("session", "seq", F.col("seq").alias("position"), "ts", F.floor(F.col("seq") / 20).alias("request"), start, (start + F.when(F.col("seq") % 17 == 0, 35).otherwise(1)).alias("end_s"))


@pytest.mark.parametrize("name", ["outages", "clock", "stalls", "rounds", "segments", "background"])
def test_streams_end_with_the_batch_result(spark, tmp_path, name):
    batch = rows(spark)
    stream = stream_of(spark, batch, str(tmp_path / "in"))
    got, want, columns = {
        "outages": lambda: (sessions.outages_stream(stream), sessions.closed_outages(batch), ("session", "start_s", "end_s", "reason")),
        "clock": lambda: (sessions.media_clock_stream(numbers(stream)), sessions.media_clock(numbers(batch)), ("session", "seq", "media_ms")),
        "stalls": lambda: (sessions.stalls_stream(numbers(stream)), intervals.stalls(numbers(batch)), ("session", "seq", "stall_s", "frame_stall_s")),
        "rounds": lambda: (sessions.assemble_rounds_stream(chunks(stream)), sessions.assemble_rounds(chunks(batch)), ("session", "poll", "content")),
        "segments": lambda: (sessions.segments_stream(frames(stream), 15.0), intervals.segments(frames(batch), 15.0), ("session", "segment", "frames", "start_s", "end_s")),
        "background": lambda: (sessions.background_tasks(stream), responses.background_tasks(batch.select("session", "task", "t", "status")), ("session", "task", "started_t", "finished_t", "status")),
    }[name]()
    got = finished(spark, got, f"s_{name}", tmp_path)
    assert pairs(got, *columns) == pairs(want, *columns) != []
    if name == "outages":
        assert pairs(sessions.merged_outages(got), "session", "start_s", "end_s") == pairs(sessions.outages(batch), "session", "start_s", "end_s")


def asked_and_said(df):
    """Every ninth event is a timed query, the others are responses with some evidence."""
    k, said = F.col("seq"), F.col("seq") % 9 > 0
    text = F.concat(F.lit("What  is "), (k % 4).cast("string"))
    when = lambda c, v: F.when(c, v)
    r = df.filter(said | (F.col("session") == END)).select("session", "seq", "ts", F.col("seq").alias("t"), when(k % 5 == 0, F.concat(F.lit("e"), (k % 40).cast("string"))).alias("event_id"), when(k % 7 == 1, F.sha2(F.concat(F.lit("What  is "), (k % 3).cast("string")), 256)).alias("query_sha256"), when(k % 7 == 2, F.concat(F.lit("what is"), (k % 5).cast("string"))).alias("prompt"), when(k % 7 > 4, k * 2.0 - 30).alias("frame_s"))
    q = df.filter(~said).select("session", "seq", "ts", F.floor(F.col("seq") / 9).cast("long").alias("rn"), F.col("seq").alias("turn"), when(k % 2 == 0, F.concat(F.lit("e"), (k % 40).cast("string"))).alias("event_id"), F.regexp_replace(F.regexp_replace(text, "W", "w"), "(\\d)$", " $1").alias("text"), (k * 2.0).alias("query_s"))
    return r, q


def test_attribution_streams_end_with_the_batch_result(spark, tmp_path):
    batch = rows(spark)
    stream = stream_of(spark, batch, str(tmp_path / "in"))
    r, q = asked_and_said(batch)
    got = finished(spark, sessions.attribute_stream(*asked_and_said(stream)), "s_attributed", tmp_path)
    want = responses.attribute_responses(r, q)
    assert pairs(got, "session", "rn", "t") == pairs(want, "session", "rn", "t") and got.count() > 500
    work = lambda df: df.filter("seq % 6 = 0 OR session = -1").select("session", "seq", "ts", F.col("seq").alias("task"), F.concat(F.lit("what is "), (F.col("seq") % 4).cast("string")).alias("question"), F.when(F.col("seq") % 4 > 0, F.col("seq") - 50).alias("started_t"))
    got = finished(spark, sessions.match_background_stream(work(stream), asked_and_said(stream)[1]), "s_background_of", tmp_path)
    want = responses.match_background(work(batch), q)
    assert pairs(got, "session", "task", "rn") == pairs(want, "session", "task", "rn") and got.count() > 100


def test_declarative_streams(spark, tmp_path):
    batch = rows(spark)
    stream = stream_of(spark, batch, str(tmp_path / "in"))
    got = finished(spark, sessions.dedupe_responses(stream, ["text"], "30 days"), "dedupe", tmp_path)
    assert pairs(got, "session", "text") == pairs(responses.dedupe_responses(batch, ["text"]), "session", "text")
    assert finished(spark, sessions.idempotent_events(stream, "30 days"), "idem", tmp_path).count() == intervals.idempotent_events(batch.withColumn("content", F.col("type"))).count()
    visits = finished(spark, sessions.visits(stream, "10 minutes"), "visits", tmp_path)
    assert pairs(visits, "session", "events") == pairs(intervals.sessions(batch.withColumn("t_s", F.unix_micros("ts") / 1e6), 600.0), "session", "events")


def test_late_rows_have_a_table_of_their_own(spark, tmp_path):
    batch = rows(spark)
    early = batch.filter("seq < 500").withColumn("seq", F.col("seq") + 5000)  # comes when the watermark is far beyond it
    parts = [batch.filter("seq < 400"), batch.filter("seq BETWEEN 400 AND 900"), early.unionByName(batch.filter("seq > 900")), batch.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))]
    for k, part in enumerate(parts):
        part.coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    stream, root = files.read_events(spark, str(tmp_path / "in" / "*"), streaming=True, schema=EVENTS), str(tmp_path / "out")
    write = ordered.divide_late(root, "1 hour")
    seen = []

    def twice(df, n):
        write(df, n)
        write(df, n)  # as after a lost commit
        seen.append(n)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    on_time, late = ordered.on_time(spark, root), ordered.late_rows(spark, root)
    kept, gone = on_time.count(), late.filter("ts IS NOT NULL").count()
    assert len(seen) >= 4 and kept + late.count() == sum(p.count() for p in parts)
    assert pairs(on_time.unionByName(late.drop("batch")), "session", "seq", "ts") == sorted(sum((pairs(p, "session", "seq", "ts") for p in parts), []), key=repr)
    assert late.filter("ts IS NULL").count() == 1 and late.filter("seq >= 5000").count() == early.count()
    write(stream_batch := spark.read.schema(EVENTS).json(str(tmp_path / "in" / "1")), 1)  # an old batch once more: the later ones do not count
    assert ordered.on_time(spark, root).count() == kept and stream_batch.count() == parts[1].count()
    # A stateful query with the same watermark drops some of these rows, by the watermark of one batch before or of this one, and no other.
    q = sessions.idempotent_events(stream.withColumn("event_id", F.col("seq")), "1 hour").writeStream.format("memory").queryName("dropped").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    assert 0 < dropped <= gone and {r.seq for r in spark.table("dropped").collect()} >= {r.seq for r in ordered.on_time(spark, root).collect()}


def test_requests_and_the_end_of_a_stream(spark):
    make = lambda fs: spark.createDataFrame([(1, i, r, s, e) for i, (r, s, e) in enumerate(fs)], "session long, position long, request long, start_s double, end_s double")
    got = lambda fs, end: [(r.segment, r.frames) for r in intervals.segments(make(fs), 10.0, end).orderBy("segment").collect()]
    # Both frames of request 1 have come before its first segment is taken; one by one the second would be late.
    assert got([(1, 1.0, 11.0), (1, 2.0, 3.0), (2, 12.0, 13.0)], False) == [(0, 2)]
    assert got([(1, 1.0, 11.0), (2, 2.0, 3.0), (3, 12.0, 13.0)], False) == [(0, 1)]
    # The request that ends the stream gives one segment only, though three are complete.
    assert got([(1, 1.0, 2.0), (2, 12.0, 22.0), (2, 25.0, 31.0)], True) == [(0, 1)] and got([(1, 1.0, 2.0), (2, 12.0, 22.0), (2, 25.0, 31.0)], False) == [(0, 1), (1, 1), (2, 1)]


def test_outage_is_dated_back_and_extended(spark):
    ev = [(1, 1, 1000.0, sessions.PROGRESS, 1.0), (1, 2, 5000.0, sessions.STALLED[0], 2.0), (1, 3, 6000.0, sessions.DISCONNECTED, None), (1, 4, 8000.0, sessions.RESUMED[1], None), (1, 5, 9000.0, sessions.DISCONNECTED, None)]
    df = spark.createDataFrame(ev, "session long, seq long, t_ms double, type string, source_position_s double")
    out = sessions.outages(df).collect()
    assert [(r.start_s, r.end_s) for r in out] == [(2.0, 8.0)] and out[0].reasons == [sessions.STALLED[0], sessions.DISCONNECTED, sessions.RESUMED[1]]


def test_overlapping_outages_are_one(spark):
    ev = [(1, 1, 1000.0, sessions.PROGRESS, 1.0), (1, 2, 5000.0, sessions.DISCONNECTED, None), (1, 3, 9000.0, sessions.RESUMED[1], None), (1, 4, 11000.0, sessions.STALLED[0], 6.0), (1, 5, 12000.0, sessions.RESUMED[2], None)]
    df = spark.createDataFrame(ev, "session long, seq long, t_ms double, type string, source_position_s double")
    assert [(r.start_s, r.end_s) for r in sessions.closed_outages(df).collect()] == [(5.0, 9.0), (6.0, 12.0)]
    out = sessions.outages(df).collect()
    assert [(r.start_s, r.end_s, r.start_position_s, r.reasons) for r in out] == [(5.0, 12.0, None, [sessions.DISCONNECTED, sessions.RESUMED[1], sessions.STALLED[0], sessions.RESUMED[2]])]


def test_media_clock_follows_its_anchor(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 10.0, None, None), (1, 2, 5.0, 3.0, None, None), (1, 3, 6.0, 0.0, 4.0, None), (1, 4, 6.0, None, None, None), (1, 5, 9.0, 100.0, None, None), (1, 6, 8.0, None, None, None), (2, 1, 50.0, 1.0, 7.0, 20.0), (2, 2, 60.0, 2.0, None, None)], "session long, seq long, wall_ms double, inbound_ms double, query_ms double, queued_ms double")
    # An exact query time is the value, even if the clock had gone further; after it the clock moves by 1 ms at least.
    assert [r.media_ms for r in sessions.media_clock(df.filter("session = 1")).orderBy("seq").collect()] == [10.0, 15.0, 4.0, 5.0, 100.0, 101.0]
    # A query that was queued at 20 and sent at 50: 40 ms after it was queued the clock is 40 ms on.
    assert [r.media_ms for r in sessions.media_clock(df.filter("session = 2")).orderBy("seq").collect()] == [7.0, 47.0]
    assert [r.media_ms for r in sessions.media_clock(df, sessions.INBOUND_TURN).orderBy("session", "seq").collect()] == [10.0, 3.0, 0.0, None, 100.0, None, 1.0, 2.0]


def test_rounds_cut_by_chunk_borders(spark):
    chunks = [
        (1, 1, 1, "<|round_sta"), (1, 2, 1, "rt|><|response|> a  b<|rou"), (1, 3, 1, "nd_end|>tail<|round_start|>open"), (1, 4, 2, " more<|round_end|>"), (1, 5, 3, "<|silence|>"), (1, 6, 4, "plain\n text"),
        (1, 7, 5, "<|round_start|>x<|silence|>y<|round_start|><|round_end|>"), (2, 1, 1, None),
    ]
    df = spark.createDataFrame(chunks, "session long, seq long, poll long, text string")
    got = {(r.session, r.poll): r.content for r in sessions.assemble_rounds(df).collect()}
    assert got == {(1, 1): "</response> a b tail", (1, 2): "</response> open more", (1, 3): "</silence>", (1, 4): "</response> plain text", (1, 5): "</response> xy", (2, 1): "</silence>"}


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    import hashlib

    (tmp_path / "large").write_bytes(bytes(range(256)) * 80_000)
    (tmp_path / "small").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in files.read_artifacts(spark, str(tmp_path), whole_bytes=1000).collect()}
    assert got == {n: ((tmp_path / n).stat().st_size, hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()) for n in ("large", "small")}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tracelode.functions import cluster

    spark = lambda master, at: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: at), sparkContext=SimpleNamespace(master=master))
    assert cluster.shared_dir(spark("spark://x:7077", "s3a://b/c/")) == "s3a://b/c" and cluster.shared_dir(spark("local[2]", None)).startswith("file:")
    with pytest.raises(ValueError, match="checkpoint"):
        cluster.shared_dir(spark("spark://x:7077", None))
