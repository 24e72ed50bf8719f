"""Literal cases, and tables changed in one place."""

import pytest
from pyspark.sql import functions as F

from tracelode.functions.text import name_key, nfkc
from tracelode.operators import audits, intervals, judgments, ledger, quality, responses, rubric, sampling, tasks, timeline, windows


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_protocol_classes(spark):
    cases = {
        "</silence>": "silence", "<silence>": "malformed_silence", "silence>": "malformed_silence", "</response>": "empty_response", "</response> <silence>": "malformed_silence", "</response> </silism>": "malformed_silence",
        "</response> 火灾已经发生，请立即撤离。": "substantive_response", "</response> 火灾已经发生。 </silence>": "mixed_silence_control_token", "火灾已经发生，请立即撤离。": "missing_response_marker",
        "</response> <29.0 seconds>": "timestamp_only_response", "</response> user: <29.0 seconds>": "role_transcript_continuation", "Error: Error code: 500 - provider frame preprocessing failed": "provider_error",
    }
    assert col(spark, list(cases), responses.classify_response) == list(cases.values())


def test_protocol_sees_upstream_text(spark):
    rows = [("</response> 看起来正常", "</response>\nuser: <29.0 seconds>\nassistant: </silence>", "role_transcript_continuation"), ("</response> <response> 火灾已经发生。", "<response> 火灾已经发生。", "malformed_action_marker"), ("</response> 火灾已经发生。", "火灾已经发生。", "missing_response_marker")]
    df = spark.createDataFrame(rows, "t string, raw string, want string")
    assert all(r.got == r.want for r in df.select("want", responses.classify_response(F.col("t"), F.col("raw")).alias("got")).collect())


def test_deferred_and_echo(spark):
    texts = ["</response> 已收到指令，我已准备在火灾发生时立即提醒您。 </response>", "</response> 好的，我会留意宝宝的动向。", "</response> 这个问题需要调用后台模型，请稍等。", "</response> response> 火灾警报已设定。如果检测到火灾，我会立即提醒你。", "</response> I cannot see a fire now. If a fire appears, I will immediately inform you.", "</response> 紧急提醒：现场已经发生火灾，请立即撤离。"]
    assert col(spark, texts, responses.is_deferred) == [True] * 5 + [False]
    q = F.lit("当小狗从笼子里跳出来的时候，提醒我。")
    assert col(spark, ["</response> 当小狗从笼子里跳出来的时候，提醒我。", "</response> 小狗已经从笼子里跳出来了。"], lambda c: responses.is_query_echo(c, q)) == [True, False]


def test_coupling_and_fail_closed(spark):
    g = [("s", 1, "D1", "G", True), ("s", 1, "D2", "B", True), ("s", 1, "D3", "G", True), ("s", 1, "D4", "S", True), ("s", 1, "D5", None, False)]
    g += [("s", 2, "D1", "G", True), ("s", 2, "D4", None, True), ("s", 3, "D1", "S", True), ("s", 3, "D4", "G", True)]
    scores = judgments.grade_scores(spark.createDataFrame(g, "system string, task_id int, dim string, grade string, applicable boolean"))
    out = {r.task_id: r for r in judgments.item_scores(scores).collect()}
    assert out[1].score == 0.5 and out[1].raw_mean == 0.625
    assert out[2].score is None and out[2].raw_mean is None
    assert out[3].score == 0.75  # a lone D1 stands for the pair


def test_leaderboard_ties_keep_order(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 2.0)], "system string, overall_score double")
    assert [r.system for r in judgments.leaderboard(df).orderBy("place").collect()] == ["d", "a", "b", "c"]


def test_rounds_by_label(spark):
    df = spark.createDataFrame([(1, "R1：开始计时 / R2：画面是什么", "R1: 1s R2: 5s"), (2, "one", None), (3, "one", "R1: 2秒 R2: 9秒"), (4, "R1: a R2: b", "3s")], "task_id int, query string, query_time string")
    out = [tuple(r) for r in tasks.query_rounds(df).orderBy("task_id", "pos").collect()]
    assert out == [(1, 0, "R1", "开始计时 /", 1.0), (1, 1, "R2", "画面是什么", 5.0), (2, 0, "R1", "one", 0.0), (3, 0, "R1", "one", 2.0), (3, 1, "R2", "one", 9.0), (4, 0, "R1", "a", 3.0), (4, 1, "R2", "b", 3.0)]


def test_text_functions(spark):
    assert col(spark, ["Ａ１", "abc", None], nfkc) == ["A1", "abc", None]
    assert col(spark, ["📄 My_File—Name ", "Ｘ y"], name_key) == ["myfilename", "xy"]
    assert col(spark, ["a\r\nb ", "  ", None], tasks.clean_cell) == ["a\nb", None, None]
    assert col(spark, ["视频开始", "12.5 s", "later", None], lambda c: tasks.parse_seconds(c, 3.0)) == [0.0, 12.5, 3.0, 3.0]
    assert col(spark, ["F: a P≥2, XF: b", "f 档p："], rubric.normalize_threshold) == ["S: a B≥2, XF: b", "S 档B："]
    assert col(spark, ["at -3.5s", "none", None], timeline.frame_time) == [-3.5, None, None]


def test_intervals_need_the_running_maximum(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0, "a"), (1, 1.0, 2.0, "b"), (1, 9.0, 12.0, "a"), (1, 12.0005, 13.0, "c"), (1, 20.0, 20.0, "d")], "session int, start_s double, end_s double, reason string")
    m = intervals.merge_intervals(df)
    assert [(r.start_s, r.end_s, r.reasons) for r in m.collect()] == [(0.0, 13.0, ["a", "b", "c"])]
    trims = spark.createDataFrame([(1, 5.0, 30.0), (2, 0.0, 4.0)], "session int, trim_start_s double, trim_end_s double")
    assert sorted((r.session, r.start_s, r.end_s) for r in intervals.keep_segments(trims, m).collect()) == [(1, 13.0, 30.0), (2, 0.0, 4.0)]


def test_first_output_is_first_in_the_log(spark):
    q = spark.createDataFrame([(1, 1, 0.0, "q"), (1, 5, 10.0, "r")], "session int, seq int, t_s double, text string")
    o = spark.createDataFrame([(1, 2, 4.0, 7.0, "x"), (1, 3, 3.0, 8.0, "y")], "session int, seq int, t_s double, latency_ms double, text string")
    out = {r.query_seq: r for r in timeline.first_output_after_query(q, o).collect()}
    assert out[1].output_t_s == 4.0 and out[5].output_t_s is None


@pytest.mark.parametrize("change,reason", [("bytes", "bytes"), ("sha256", "sha256"), ("path", "missing")])
def test_one_changed_cell_is_one_finding(spark, change, reason):
    actual = spark.createDataFrame([(f"f{i}", i, f"h{i}") for i in range(5)], "path string, bytes long, sha256 string")
    other = F.lit(99) if change == "bytes" else F.lit("zz")
    recorded = actual.withColumn(change, F.when(F.col("path") == "f3", other).otherwise(F.col(change)))
    assert [r.reason for r in audits.verify_artifacts(recorded, actual).collect()] == [reason]


def test_markers_inside_longer_words(spark):
    markers = ["longest of all", "one passage longest", "passage", "two words", "b", "漢字", "", " ", "  ", None, " led", "led ", "a(b", "long single", "\tx\n", "unusuallylongword", "c d e"]
    texts = ["see (longest of all)", '"longest of all".', "one passage longest.", "xone passage longestx", "the passages", "two wordsmith", "no wo two word", "a漢字b", "", " ", "  a", None, "settled now", "a(b)c", "an overlong singles", "q\tx\n", "theunusuallylongwords end", "unusuallylong", "c d e", "abc d efg", "c  d e"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    m = spark.createDataFrame(list(enumerate(markers)), "marker_id long, text string")
    want = sorted((i, k) for i, x in enumerate(texts) for k, y in enumerate(markers) if x is not None and y is not None and y in x)
    assert sorted((r.id, r.marker_id) for r in audits.marker_join(t, m).collect()) == want


def test_forbidden_keys_at_any_depth(spark):
    deep = '{"k": [' * 30 + '{"score": 1}' + "]}" * 30
    docs = spark.createDataFrame([(1, '{"a": [{"Scores": 1}, {"b": {"score": 2}}]}'), (2, "no"), (3, None), (4, deep)], "id int, json string")
    assert sorted(r.path for r in audits.forbidden_keys(docs, ["score"], "loose").collect()) == sorted(["$.a[0].Scores", "$.a[1].b.score", "$" + ".k[0]" * 30 + ".score"])
    assert sorted(r.id for r in audits.forbidden_keys(docs, ["score"]).collect()) == [1, 4]


def test_reachable_follows_chains_to_their_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(80)] + [(80, 3), (200, 201)], "a long, b long")
    got = audits.reachable(edges, spark.createDataFrame([(0,), (79,)], "node long")).collect()
    assert {r.node: r.depth for r in got} == {i: min(i, {79: 0, 80: 1}.get(i, 99), 2 + i - 3 if i >= 3 else 99) for i in range(81)}


def test_reachable_is_breadth_first_search(spark):
    import random

    rng = random.Random(5)
    for n, m in ((40, 40), (60, 90), (60, 45)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(9)] + [(7, 100), (300, 300), (310, 311), (311, 310), (None, 1), (2, None)]
        roots = [rng.randrange(n), rng.randrange(n), 104, 300, 310, 999, None]
        want, front = {x: 0 for x in roots if x is not None}, [x for x in roots if x is not None]
        while front:
            x = front.pop(0)
            for a, b in edges:
                if a == x and b is not None and b not in want:
                    want[b] = want[x] + 1
                    front.append(b)
        got = audits.reachable(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(x,) for x in roots], "node long")).collect()
        assert {r.node: r.depth for r in got} == want and len(got) == len(want)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(audits, "cut", lambda df, cut=audits.cut: rounds.append(1) or cut(df))
    got = audits.reachable(spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), spark.createDataFrame([(0,), (5000,)], "node long"))
    assert got.agg(F.count("*"), F.max("depth"), F.sum("depth")).first()[:] == (10_001, 5000, sum(range(5000)) + sum(range(5001)))
    assert len(rounds) < 25  # tables in all, of which 14 double the pointers


def test_markers_of_a_table_are_found_wherever_they_stand(spark, monkeypatch):
    import random

    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("aab \né漢.") for _ in range(rng.randrange(60))) + " the end") for i in range(150)] + [(900, None), (901, ""), (902, "\U0001f600 x")]
    markers = [(k, "".join(rng.choice("aab \né漢.") for _ in range(rng.randrange(1, 5)))) for k in range(120)] + [(500, ""), (501, " "), (502, "a"), (503, None), (504, "the end"), (505, "the end"), (506, "\U0001f600"), (507, "\n")]
    want = sorted((i, k) for i, t in texts for k, m in markers if t is not None and m is not None and m in t)
    for chars in (audits.MARKER_CHARS, 40):  # one automaton, and many
        monkeypatch.setattr(audits, "MARKER_CHARS", chars)
        got = audits.marker_join(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(markers, "marker_id long, text string"))
        assert sorted((r.id, r.marker_id) for r in got.collect()) == want


def test_fileset_hash_does_not_depend_on_order(spark):
    rows = [("g", f"p{i}", f"h{i}") for i in range(600)]
    make = lambda r: audits.fileset_hash(spark.createDataFrame(r, "g string, path string, sha256 string"), ["g"]).first()
    assert make(rows) == make(rows[::-1]) and make(rows).files == 600
    assert make(rows).hash != make([*rows[:-1], ("g", "p599", "other")]).hash


def test_sensitive_values(spark):
    cells = ["RTSP://x", "http://10.0.0.1", "https://127.0.0.1/a", "http://localhost", "sk-abcdefghijkl", "ark-ABCDEFGH_1-2", "pk-123456789012", "sk-short", "http://110.0.0.1", "/mnt/own/x", None]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, c string")
    assert sorted(r.id for r in audits.sensitive_cells(df, "id", ["c"]).collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert 9 in {r.id for r in audits.sensitive_cells(df, "id", ["c"], ("/mnt/own/",)).collect()}
    docs = spark.createDataFrame([(i, f'{{"{k}": 1}}') for i, k in enumerate(["Creation_Time", "video id", "UID", "format", "LVMetaInfo"])], "id int, json string")
    assert sorted(r.id for r in audits.sensitive_metadata(docs).collect()) == [0, 1, 2, 4]


def test_responses_are_read_in_normal_form(spark):
    cases = {
        "</silence>\n": "silence", "\n\t": "empty_output", "\n</response> hi": "substantive_response", "＜／ｓｉｌｅｎｃｅ＞": "silence", "\u3000</response>\u00a0ok\ufeff": "substantive_response", "</response>\r\n": "empty_response",
        "</response> a\rUser : b": "role_transcript_continuation", "</response>\n<silence>\n": "malformed_silence", "</response>\u2028<12s ~ 13.5 s>": "timestamp_only_response", "</response> a </response> b": "unexpected_response_closer",
    }
    assert col(spark, list(cases), responses.classify_response) == list(cases.values())
    assert col(spark, ["</response>ＡＢＣ", "</response> A\u3000BC\n"], lambda c: responses.is_query_echo(c, F.lit("ABC"))) == [True, True]
    assert col(spark, ["\n</response>\n好的，已收到，我会提醒你", "\n已经收到了"], responses.is_deferred) == [True, False]


def test_answers_lose_one_tag_and_every_outer_white_space(spark):
    texts = ["\n\t\u3000</response> hi</response>\r\n", "\x1c <response>\x85a\u2003", "</response></response> b", "c \n\n", "null\x1f", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i")
    got = rows.select(timeline.clean_response(F.col("text")).alias("t"), timeline.is_silence(F.col("text")).alias("s")).collect()
    assert [r.t for r in got] == ["hi</response>", "a", "</response> b", "c", "null", ""]
    assert [r.s for r in got] == [False, False, False, False, True, True]


def test_marked_forms_of_each_variant(spark):
    texts = ["None", "null", " ", "< / Silence >", "</silence>", "<response> hi\n", "<RESPONSE>", "a\n b", "</response> x  y"]
    form = lambda v: col(spark, texts, lambda c: responses.to_marker(c, v))
    assert form("session") == ["</response> None", "</response> null", "</silence>", "</silence>", "</silence>", "</response> hi", "</silence>", "</response> a\n b", "</response> x  y"]
    assert form("native") == ["</response> None", "</response> null", "</silence>", "</response> < / Silence >", "</silence>", "<response> hi", "<RESPONSE>", "</response> a\n b", "</response> x  y"]
    assert form("streaming") == ["</response> None", "</response> null", "</silence>", "</response> < / Silence >", "</silence>", "</response> <response> hi", "</response> <RESPONSE>", "</response> a b", "</response> x y"]


def test_failure_classes_of_a_session(spark):
    rows = [(500, False, "x"), (429, False, "x"), (None, False, "x"), (0, False, None), (500, False, "smart_resize: x"), (500, False, "Timed out"), (200, True, "")]
    df = spark.createDataFrame(rows, "s int, d boolean, m string")
    got = [tuple(r.f) for r in df.select(responses.session_failure_class(F.col("s"), F.col("d"), F.col("m")).alias("f")).collect()]
    assert got == [("provider_http_error", True), ("provider_rate_limit", True), ("provider_transport_error", True), ("provider_transport_error", True), ("provider_frame_preprocessing_error", True), ("model_latency_timeout", False), ("model_latency_timeout", False)]


def test_a_loop_is_an_advance(spark):
    media = [0.0, 1.0, 2.0, 3.0, 0.0, 1.0, 2.0, 3.0, 3.02, 3.02, 3.04, 2.9, None]
    df = spark.createDataFrame([(1, i, float(i), m, float(min(i, 5))) for i, m in enumerate(media)], "session long, seq long, t_s double, media_s double, frame double")
    out = intervals.stalls(df).orderBy("seq").collect()
    assert [r.stall_s for r in out] == [0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 0, 1, 2]
    assert intervals.longest_stalls(intervals.stalls(df)).first()[1:] == (2.0, 7.0) and [r.frame_stall_s for r in out][-1] == 7.0


def test_interruptions_take_the_first_reason(spark):
    base = {"session": 0, "seq": 1, "t_s": 0.0, "source": "upload", "lifecycle": "running", "analysis": True, "looping": True, "ended": False, "paused": False, "ready_state": 4, "closes": 0, "disconnected_s": None, "media_stall_s": 0.0, "frame_stall_s": 0.0, "guard_pauses": 0}
    cases = [({"source": "camera"}, "hard_state"), ({"lifecycle": "failed"}, "hard_state"), ({"lifecycle": None}, "hard_state"), ({"analysis": False}, "hard_state"), ({"looping": False}, "hard_state"), ({"ended": True, "paused": True}, "hard_state"), ({"paused": True}, "paused"),
             ({"closes": 4, "disconnected_s": 1.0}, "reconnect_budget"), ({"closes": 4}, None), ({"disconnected_s": 31.0}, "reconnect_timeout"), ({"media_stall_s": 2.5}, "media_stall"), ({"ready_state": 1}, None),
             ({"media_stall_s": 20.0, "guard_pauses": 1}, None), ({"frame_stall_s": 6.0}, "frame_stall"), ({"frame_stall_s": 6.0, "disconnected_s": 1.0}, None)]
    schema = "session int, seq int, t_s double, source string, lifecycle string, analysis boolean, looping boolean, ended boolean, paused boolean, ready_state int, closes int, disconnected_s double, media_stall_s double, frame_stall_s double, guard_pauses int"
    rows = [tuple((base | change | {"session": i}).values()) for i, (change, _) in enumerate(cases)]
    # Not ready for more than two seconds, and not ready twice with a healthy sample between.
    rows += [tuple((base | {"session": 90 + s, "seq": k, "t_s": t, "ready_state": r}).values()) for s, ts in enumerate([[(0.0, 1), (2.0, 1), (2.1, 1)], [(0.0, 1), (1.0, 4), (2.0, 1), (3.9, 1)]]) for k, (t, r) in enumerate(ts)]
    got = {r.session: (r.reason, r.seq) for r in intervals.interruptions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: (want, 1) for i, (_, want) in enumerate(cases) if want} | {90: ("unhealthy", 2)}


def test_marker_runs_by_duration_and_clock_offset(spark):
    def run(values, removed, step=0.04, least=0.19):
        df = spark.createDataFrame([(1, i, i * step, float(v), removed) for i, v in enumerate(values)], "session long, seq long, t_s double, value double, removed_s double")
        return intervals.value_runs(df, 20.0, least, 100.0).first()

    out = run([120] * 5 + [10] * 5 + [120] * 3 + [10] * 3 + [60, 120], 1.0)
    assert out.n == 5 and round(out.rise_s, 3) == 0.4 and round(out.offset_s, 3) == 0.6 and out.error is None
    assert run([120, 10, 10, 120], 1.0).error == "no_marker" and run([10] * 6, 1.0).error == "no_transition" and run([10] * 6 + [120], 99.0).error == "implausible_offset" and run([10], 1.0).error == "too_few"


def test_frame_windows(spark):
    w = lambda texts: [tuple(x) for x in col(spark, texts, lambda c: windows.frame_window(c, F.lit(1.0)))]
    assert w(["5 seconds", "5-5 seconds", "<3.5 to 4>", "no time", "", None]) == [(5.0, 6.0, None), (5.0, 5.0, None), (3.5, 4.0, None), (None, None, None), (None, None, None), (None, None, None)]
    assert [x[2] for x in w(["- 3 s", "1 - -2", "9-8", "86400-86401", "0-3601", "9" * 400])] == ["negative", "negative", "reversed", "too_late", "too_long", "not_finite"]
    df = spark.createDataFrame([(1, 1, "7-9.5 s", 1), (1, 2, None, 1), (2, 1, None, 0), (2, 2, None, 0), (3, 1, "4-4.5", 3), (3, 2, None, 3), (3, 3, "2", 3)], "session int, seq int, window string, listed int")
    got = [(r.session, r.start_s, r.end_s, r.in_order) for r in windows.resolve_windows(df, 2.0, 1).orderBy("session", "seq").collect()]
    assert got == [(1, 7.0, 9.5, True), (1, 9.0, 11.0, True), (2, 2.0, 4.0, True), (2, 4.0, 6.0, True), (3, 4.0, 4.5, True), (3, 4.0, 6.0, True), (3, 2.0, 4.0, False)]


def test_late_frames_and_the_flush(spark):
    rows = [(0, 1.0, 2.0), (1, 9.0, 11.0), (2, 8.0, 10.5), (3, 3.0, 4.0), (4, 19.5, 20.0), (5, 45.0, 46.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "session long, position long, start_s double, end_s double")
    got = lambda end: [(r.segment, r.frames) for r in intervals.segments(df, 10.0, end).orderBy("segment").collect()]
    assert got(False) == [(0, 2), (1, 2)]  # frame 2 still overlaps segment 1, frame 3 is lost
    assert got(True) == [(0, 2), (1, 2), (4, 1)]


def test_resume_reasons_in_order(spark):
    tasks = spark.createDataFrame([(i, "c", "v", True) for i in range(4)], "task int, contract string, source string, realtime boolean")
    good = (0, "ok", 0, "c", "v", True, "s", True, "p", True, True, "f", "h")
    stored = spark.createDataFrame([good, (1, *good[1:2], 1, *good[3:10], False, "f", "h"), (2, "ok", 2, *good[3:11], "g", "h")], "task int, status string, own_task int, contract string, source string, evaluation_ok boolean, semantics string, backend_ok boolean, prompt_sha256 string, identity_ok boolean, realtime_ok boolean, path string, sha256 string")
    files = spark.createDataFrame([("f", 1, "h"), ("g", 0, "h")], "path string, bytes int, sha256 string")
    assert {r.task: r.reason for r in quality.resume_valid(tasks, stored, files, "s", "p").collect()} == {0: None, 1: "realtime", 2: "empty_video", 3: "no_result"}


def test_ledger_rules(spark):
    good = [("t", 0, i) for i in (1, 2)]
    make = lambda rows: spark.createDataFrame([(t, s, a, "response", 200) for t, s, a in rows], "task string, stage int, attempt int, status string, status_code int")
    assert ledger.validate_ledger(make(good), 2).count() == 0
    assert [r.reason for r in ledger.validate_ledger(make(good), 1).collect()] == ["over_budget"]
    assert [r.reason for r in ledger.validate_ledger(make([("t", 0, 1), ("t", 0, 3)]), 5).collect()] == ["sequence"]


def test_even_samples_round_half_even(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "g int, i int")
    got = lambda k, **kw: [r.i for r in sampling.evenly_sample(df, ["g"], ["i"], k, **kw).orderBy("i").collect()]
    for k in range(2, 11):
        assert got(k) == sorted({round(i * 9 / (k - 1)) for i in range(k)})
    assert got(1) == [0] and got(1, middle=True) == [5] and got(0, middle=True) == []


def test_priority_order_keeps_every_item(spark):
    rows = [(1, i, "temporal_sheet_x" if i % 3 == 0 else "right_ui_tail_zoom" if i in (40, 41) else "full_ui") for i in range(60)]
    out = sampling.priority_order(spark.createDataFrame(rows, "session int, place int, view string")).orderBy("new_place").collect()
    assert [r.new_place for r in out] == list(range(60))
    assert {r.place for r in out[:24]} >= {i for i, (_, _, v) in enumerate(rows) if v != "full_ui"}


def test_frame_times_are_chosen_greedily(spark):
    sessions_ = [(1, 30.0), (2, 0.02), (3, 4.0)]
    events = [(1, 5, 3.0), (1, 2, 3.1), (1, 9, 29.9), (3, 1, 0.1), (3, 2, None)]
    got = {r.session: r.times for r in sampling.frame_times(spark.createDataFrame(sessions_, "session long, duration_s double"), spark.createDataFrame(events, "session long, seq long, t_s double"), 40).collect()}
    for s, duration in sessions_:
        d = max(duration, 0.1)
        end = max(0.05, d - min(0.5, max(0.05, d * 0.1)))
        around = [t + x for _, t in sorted((q, t) for k, q, t in events if k == s and t is not None) for x in (-0.6, 0.0, 0.8)]
        kept = []
        for t in around + [0.5 + i * (end - 0.5) / 12 for i in range(13)]:
            t = round(min(end, max(0.0, t)), 3)
            if len(kept) < 40 and all(abs(t - k) >= 0.18 for k in kept):
                kept.append(t)
        assert got[s] == sorted(kept)


def test_bag_difference_counts(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "h string")
    b = spark.createDataFrame([("x",), ("z",)], "h string")
    assert sorted((r.h, r.side) for r in quality.bag_diff(a, b).collect()) == [("x", "undelivered"), ("y", "undelivered"), ("z", "unexpected")]


def test_refused_credentials(spark):
    cases = {"HTTP 401 from x": True, "code: Unauthenticated": True, "API KEY无效": True, "Invalid API Key": True, "the api key invalid": True, "401": False, "http 403": False, "unauthorized": False, "authentication failed": False, None: False, "": False}
    assert col(spark, list(cases), ledger.auth_failed) == list(cases.values())


def test_json_of_an_answer_is_strict(spark):
    cases = {
        ' {"a": 1} \n': '{"a": 1}', 'x {"a":1} y {"b":2} z': None, 'pre {"a":1} post }': None, 'say {"a": {"b": 2}} end': '{"a": {"b": 2}}', "```json\n{\"a\": 1}\n```": '{"a": 1}', "a ```{\"a\": 1}``` b ```{\"c\": 2}``` c": None,
        "[1, 2]": "[1, 2]", "3": "3", "null": None, "{'a': 1}": None, '{"a":1}]': '{"a":1}', '1], [2': None, '1,"x"': None, "": None, None: None, "no { json": None, '{"a": "}"} {': '{"a": "}"}',
    }
    assert col(spark, list(cases), judgments.extract_json) == list(cases.values())


def test_predictions_are_held_against_the_spec(spark):
    p = spark.createDataFrame([("s", "t1", "t1", "ok"), ("s", "t2", "t1", "ok"), ("s", "t3", None, None), ("s", "t4", "t4", "ok")], "system string, task_id string, own_task_id string, status string")
    g = spark.createDataFrame([("s", "t1", "D1", "G"), ("s", "t1", "D2", "not_applicable"), ("s", "t1", "D9", "?"), ("s", "t2", "D1", "X"), ("s", "t2", "D2", "B")], "system string, task_id string, dim string, grade string")
    spec = spark.createDataFrame([(t, d, d == "D1") for t in ("t1", "t2", "t3") for d in ("D1", "D2")], "task_id string, dim string, applicable boolean")
    got = {r.task_id: r.errors for r in judgments.validate_prediction(p, g, spec).collect()}
    assert got == {"t1": [], "t2": ["task_id", "D1:unknown", "D2:not_applicable"], "t3": ["task_id", "status", "D1:missing", "D2:not_applicable"], "t4": []}


def test_secrets_of_a_log_line(spark):
    cases = {
        r'{"api-key":"a\"b","x":1}': '{"api-key":"[REDACTED]","x":1}', '{"Access_Token" : "t"}': '{"Access_Token" : "[REDACTED]"}', '{"apikey": ""}': '{"apikey": ""}', '{"secret":null,"password":0}': '{"secret":"","password":""}', '{"password":12.5}': '{"password":"[REDACTED]"}',
        '{"secret":{"a":["]",{"b":"}"}]},"token":"t"}': '{"secret":"[REDACTED]","token":"t"}', '{"authorization":["a"]}': '{"authorization":"[REDACTED]"}', "https://u@h/x?Authorization=1&a=2&token=t#f": "https://[REDACTED]@h/x?Authorization=[REDACTED]&a=2&token=[REDACTED]#f",
        "http://u:p@h/": "http://[REDACTED]@h/", "see API_KEY=abc now": "see API_KEY=[REDACTED] now", "wss://h/?key=k&signature=s": "wss://h/?key=k&signature=s", None: None,
    }
    assert col(spark, list(cases), audits.redact) == list(cases.values())


def test_promises_right_after_chinese_text(spark):
    cases = {"好的I'll keep watching": True, "好的let me keep looking": True, "I'll keep watching": True, "xI'll keep watching": False, "We will keep watchingx": False, "if it rains, I will notify you": True, "the cat": False, None: False}
    assert col(spark, list(cases), responses.is_deferred) == list(cases.values())


def test_which_queries_need_a_tail(spark):
    q = spark.createDataFrame([("s", 1, 0, "a", responses.DELEGATION), ("s", 2, 1, "in the background, async", "x"), ("s", 3, 2, "在后台做", None), ("s", 4, 3, "Own  task", None), ("s", 5, 4, "promised", None), ("s", 6, 9, "late", None), ("s", 7, 5, "early task", None)], "session string, rn long, turn long, text string, category string")
    tasks = spark.createDataFrame([("s", 1, "own task", None), ("s", 2, "Own task", None), ("s", 3, "early task", 4)], "session string, task long, question string, started_t long")
    flagged = spark.createDataFrame([("s", 5, True), ("s", 2, False)], "session string, rn long, deferred boolean")
    got = {r.rn: (r.is_async, r.tail) for r in responses.needs_async(q, flagged, responses.match_background(tasks, q), 9).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, True), 4: (True, True), 5: (True, True), 6: (False, True), 7: (False, False)}


def test_keys_of_human_labels(spark):
    docs = spark.createDataFrame([(1, '{"Human-Score": 1, "human": 2, "a": [{"专家 评分": 3}], "contains_human_labels": true, "goldRatings": 1, "人工": 1, "score": 5}'), (2, '{"scoress": 1, "Gradess": 2, "scored": 3}')], "id int, json string")
    assert {(r.id, r.key) for r in audits.forbidden_keys(docs, ["score"], "labels").collect()} == {(1, "Human-Score"), (1, "专家 评分"), (1, "goldRatings"), (1, "score")}
    assert {r.key for r in audits.forbidden_keys(docs.filter("id = 2"), ["score", "grade"], "loose").collect()} == {"scoress", "Gradess"}


def test_profile_rules(spark):
    rows = [("Up.Case-1", "m", "HTTPS://h/v1", "direct", "http"), ("a b", "m", "http://h", "direct", "http"), ("x", " ", "ftp://h", "other", "pigeon"), ("y", None, "http://u:p@h", None, "http"), ("z", "m", "http://h", "direct", "http"), ("z", "m", "http://h", "direct", "http")]
    got = sorted(tuple(r) for r in audits.validate_profiles(spark.createDataFrame(rows, "id string, model string, base_url string, route string, transport string"), ["direct"], ["http"]).collect())
    assert got == [("a b", "id"), ("x", "base_url"), ("x", "model"), ("x", "route"), ("x", "transport"), ("y", "credentials"), ("y", "model"), ("y", "route"), ("z", "repeated")]


def test_attribution_is_that_of_the_rule_for_every_pair(spark):
    import hashlib
    import random

    def same(a):
        return "".join((a or "").split())

    def belongs(x, q, following):
        t, event, sha, prompt, frame = x
        rn, turn, q_event, text, at = q
        next_at, next_turn = (following[4], following[1]) if following else (None, None)
        if event is not None and q_event is not None:
            return event == q_event
        if sha is not None:
            return sha == hashlib.sha256(text.encode()).hexdigest()
        if same(prompt):
            return same(prompt) == same(text)
        if frame is not None and at is not None:
            return frame >= at - 0.001 and (next_at is None or frame < next_at - 0.001)
        return t is not None and turn is not None and t >= turn and (next_turn is None or t < next_turn)

    rng = random.Random(11)
    rounds, said, want = [], [], []
    for s in range(60):
        n = rng.randrange(5)
        wild = s % 3 == 0  # times that go back or are unknown
        turns = sorted(rng.randrange(12) for _ in range(n))
        ats = sorted(float(rng.randrange(12)) for _ in range(n)) if s % 2 else [None] * n
        if wild:
            rng.shuffle(turns)
            ats = [rng.choice([None, float(rng.randrange(12))]) for _ in range(n)]
            turns = [rng.choice([t, t, None]) for t in turns]
        qs = [(k + 1, turns[k], rng.choice([None, "e1", "e2"]), rng.choice(["a b", "c", "a  b"]), ats[k]) for k in range(n)]
        xs = [(rng.choice([None, *range(13)]), rng.choice([None, None, "e1", "e9"]), rng.choice([None, None, None, hashlib.sha256(b"c").hexdigest()]), rng.choice([None, None, "", " ab", "c"]), rng.choice([None, float(rng.randrange(13)), rng.randrange(13) - 0.001])) for _ in range(12)]
        rounds += [(s, *q) for q in qs]
        said += [(s, *x) for x in xs]
        want += [(s, q[0], x[0]) for x in xs for k, q in enumerate(qs) if belongs(x, q, qs[k + 1] if k + 1 < n else None)]
    r = spark.createDataFrame(said, "session long, t long, event_id string, query_sha256 string, prompt string, frame_s double")
    q = spark.createDataFrame(rounds, "session long, rn long, turn long, event_id string, text string, query_s double")
    got = responses.attribute_responses(r, q)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 400
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_and_acknowledgements_in_one_sweep(spark):
    from tracelode.operators import sweeps

    q = spark.createDataFrame([(1, 1, 0, 5, "a"), (1, 2, 5, 5, "b"), (1, 3, 5, 9, "c"), (1, 4, 9, None, "d"), (2, 1, 3, None, "e")], "session long, rn long, turn long, next_turn long, text string")
    r = spark.createDataFrame([(1, 0, "x"), (1, 4, "y"), (1, 5, "z"), (1, 5, "z"), (2, 2, "early"), (3, 1, "nobody")], "session long, turn long, text string")
    got = sorted((x.session, x.rn, x.t, x.text) for x in sweeps.inside_rounds(r, q).collect() if x.t is not None)
    assert got == [(1, 1, 0, "x"), (1, 1, 4, "y"), (1, 3, 5, "z"), (1, 3, 5, "z")]
    assert sorted((x.session, x.rn) for x in sweeps.inside_rounds(r, q).collect() if x.t is None) == [(1, 2), (1, 4), (2, 1)]
    a = spark.createDataFrame([(1, 10, 5.0, "t"), (1, 9, 7.0, "t"), (1, 11, 4.0, "t"), (1, 12, 9.0, None)], "session long, seq long, t_s double, text string")
    asked = spark.createDataFrame([(1, 1, 5.0, "t"), (1, 2, 5.5, "t"), (1, 3, 7.5, "t"), (1, 4, 1.0, None), (1, 5, 1.0, "u")], "session long, seq long, t_s double, text string")
    # The first in the log, not the first in time.
    assert {x.seq: x.ack_t_s for x in intervals.ack_match(asked, a).collect()} == {1: 7.0, 2: 7.0, 3: None, 4: None, 5: None}


def test_a_list_of_windows_with_an_error_is_refused(spark):
    rows = [(1, 1, "9-3 seconds", 1), (1, 2, None, 1), (1, 3, None, 1), (2, 1, "1-2", 3), (2, 2, "5-4", 3), (2, 3, "- 2", 3), (3, 1, "4-5", 1), (3, 2, None, 1)]
    got = windows.resolve_windows(spark.createDataFrame(rows, "session int, seq int, window string, listed int"), 2.0, 1).orderBy("session", "seq").collect()
    assert [(r.start_s, r.end_s, r.error) for r in got] == [(None, None, "reversed")] * 6 + [(4.0, 5.0, None), (6.0, 8.0, None)]


def test_recordings_roll_up_with_their_supervisors(spark):
    checked = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("c", False), ("c", True)], "system string, ok boolean")
    status = lambda xs, n: {r.system: (r.total, r.ok, r.status) for r in quality.verify_rollup(checked, spark.createDataFrame(xs, "system string, supervisor_status string"), n).collect()}
    got = status([("a", "complete"), ("b", "running"), ("c", "complete"), ("d", None)], 4)
    assert got == {"a": (2, 2, "complete"), "b": (1, 1, "incomplete"), "c": (2, 1, "incomplete"), "d": (0, 0, "incomplete"), None: (5, 4, "incomplete")}
    assert status([("a", "complete"), ("b", "complete")], 2)[None] == (3, 3, "complete") and status([("a", "complete"), ("b", "complete")], 4)[None] == (3, 3, "incomplete")


def test_texts_are_cut_and_normalised_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    t = spark.createDataFrame([("t", "R1: a\nR2: b", "R1: 3 R2: 5")], "task_id string, query string, query_time string")
    assert plan(tasks.query_rounds(t)).count("regexp_extract_all") == 3 and tasks.query_rounds(t).count() == 2
    said = spark.createDataFrame([("</response> hi",)], "text string")
    assert plan(said.select(responses.classify_response(F.col("text")))).count("regexp_replace") < 20


def test_medians_of_large_groups_are_exact(spark):
    import random
    import statistics

    rng = random.Random(3)
    groups = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 9) for _ in range(700)], "same": [4.25] * 501, "even": [float(x) for x in range(600)], "steps": [rng.choice([1.0, 1.0, 2.0, 1e9]) for _ in range(900)],
        "close": [1 + k * 2**-52 for k in range(400)], None: [rng.gauss(0, 1) for _ in range(333)], "small": [3.0, 1.0, 2.0, 4.0], "none": [],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("none", None), ("even", None), ("inf", float("inf"))] + [("inf", float(x)) for x in range(200)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in timeline.numeric_summary(df, ["g"], "x", 50).collect()}
    want = {r.g: r for r in timeline.numeric_summary(df, ["g"], "x").collect()}
    assert got.keys() == want.keys() and all(got[g][:4] == want[g][:4] and got[g]["max"] == want[g]["max"] for g in want)
    sizes = df.filter("g IS NULL OR g NOT IN ('inf', 'small', 'none')").groupBy("g").agg(F.count("x").alias("count"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    exact = {r.g: r.median for r in timeline.selected(df, ["g"], "x", sizes, 50).collect()}
    assert exact == {g: statistics.median(groups[g]) for g in exact} and len(exact) == 6


def test_changed_files_are_found_by_their_branches(spark, tmp_path):
    rows = [(g, f"p{i}", f"h{i}") for g in ("a", "b") for i in range(400)]
    make = lambda rs: spark.createDataFrame(rs, "g string, path string, sha256 string")
    after = [r if r != ("a", "p7", "h7") else ("a", "p7", "other") for r in rows if r != ("b", "p9", "h9")] + [("b", "q", "h"), ("c", "only", "h")]
    for name, rs in (("one", rows), ("two", after), ("again", rows[::-1])):
        audits.write_fileset(make(rs), ["g"], str(tmp_path / name))
    got = audits.changed_files(spark, str(tmp_path / "one"), str(tmp_path / "two"), ["g"])
    assert sorted(map(tuple, got.collect())) == [("a", "p7", "changed"), ("b", "p9", "gone"), ("b", "q", "new"), ("c", "only", "new")]
    read = [f for f in got.inputFiles()]
    assert 0 < len({f.split("branch=")[1].split("/")[0] for f in read if "branch=" in f}) <= 256
    assert audits.changed_files(spark, str(tmp_path / "one"), str(tmp_path / "again"), ["g"]).count() == 0
    tree = {(r.g, r.branch): r.files for r in spark.read.parquet(str(tmp_path / "one" / "tree")).collect()}
    assert tree["a", ""] == 400 and sum(n for (g, b), n in tree.items() if g == "a" and len(b) == 2) == 400


def test_crops_move_to_the_nearest_full_frame(spark):
    import random

    rng = random.Random(2)
    outs = [(s, i, float(rng.randrange(100))) for s in range(8) for i in range(6)] + [(9, 1, 5.0)]
    fulls = [(s, rng.randrange(400) / 4) for s in range(8) for _ in range(rng.randrange(1, 9))] + [(50, 1.0), (3, None)]
    got = {tuple(r) for r in sampling.crop_times(spark.createDataFrame(outs, "session long, seq long, t_s double"), spark.createDataFrame(fulls, "session long, t_s double"), 100).collect()}
    want = {(s, min((abs(f - c), f) for x, f in fulls if x == s and f is not None)[1]) for s, _, t in outs for c in (t - 0.6, t, t + 0.8) if any(x == s for x, _ in fulls)}
    assert got == want
