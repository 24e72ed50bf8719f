"""Queries over task tables, rubrics and attempt ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as G
from ..operators import rubric as U
from ..operators import tasks as T
from . import fixtures as X
from .fixtures import oracle


def _long(s, d):
    return U.rubric_long(X.anchors(s, d))


def _pool(s, d):
    """A sheet of tasks out of customers: padded cells, blank and repeated ids, some selected."""
    c = X.table(s, d, "customer")
    k = F.col("c_custkey")
    return c.select(F.when(k % 50 == 0, " ").when(k % 40 == 1, "t1").otherwise(F.concat(F.lit(" t"), k.cast("string"), F.lit("\r\n"))).alias("id"), F.col("c_mktsegment").alias("category"), F.when(k % 3 == 0, "入选").otherwise("未入选").alias("state"))


def _seconds(s, d):
    o = X.table(s, d, "orders")
    k = F.col("o_orderkey")
    cell = F.when(k % 5 == 0, "视频开始").when(k % 5 == 1, F.concat(F.col("o_totalprice").cast("string"), F.lit("s"))).when(k % 5 == 2, F.concat(F.lit("第 "), (k % 90).cast("string"), F.lit(" 秒发送"))).when(k % 5 == 3, "later").otherwise(F.concat(F.lit("  "), F.col("o_orderpriority")))
    return o.select("o_orderkey", cell.alias("cell"))


def _sheet_rounds(s, d):
    """Query and time cells with and without labels."""
    o = X.table(s, d, "orders")
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    query = F.when(k % 4 == 0, F.concat(F.lit("R1：看 "), p, F.lit(" R2: 再看 "), p)).when(k % 4 == 1, F.concat(F.lit("1. a "), p, F.lit("\n2. b"))).otherwise(p)
    time = F.when(k % 3 == 0, F.concat(F.lit("R1: "), (k % 30).cast("string"), F.lit("s R2：5秒"))).when(k % 3 == 1, "视频开始")
    return o.select(k.alias("task_id"), query.alias("query"), time.alias("query_time"))


def _json_rounds(s, d):
    o = X.table(s, d, "orders")
    k = F.col("o_orderkey")
    doc = F.when(k % 3 == 0, F.concat(F.lit('[{"id": "A", "query": "late", "time_s": '), (k % 7).cast("string"), F.lit('}, {"prompt": " early ", "query_second": 2}]'))).when(k % 3 == 1, F.lit("no json"))
    return o.select(k.alias("task_id"), doc.alias("rounds_json"), F.col("o_orderstatus").alias("query"), (F.col("o_totalprice") - 1000).alias("query_time_s"))


def _media(s, d):
    """Files out of page addresses, and tasks that name them in different ways."""
    p = X.table(s, d, "pages")
    stem = F.regexp_extract("url", r"([^/?#]+)([?#].*)?$", 1)
    files = p.select(F.concat(F.lit("v/"), F.col("page_id").cast("string"), F.lit("/"), stem).alias("path"), stem.alias("stem"))
    tasks = p.select(F.col("page_id").alias("task_id"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("📄 "), stem)).alias("label"), F.when(F.col("page_id") % 3 == 1, F.upper(stem)).otherwise(F.lit("-")).alias("scene"))
    explicit = p.filter("page_id % 10 = 0").select(F.col("page_id").alias("task_id"), F.col("url").alias("path"))
    return files, tasks, explicit


_MEDIA = """WITH st AS (SELECT page_id, url, regexp_extract(url, '([^/?#]+)([?#].*)?$', 1) AS stem FROM pages),
ix AS (SELECT lower(regexp_replace(stem, '[\\s_—–-]+', '', 'g')) AS key, min('v/' || page_id || '/' || stem) AS path, count(*) AS n FROM st GROUP BY 1)
"""


def _found(s, d):
    files, tasks, explicit = _media(s, d)
    return T.resolve_media(tasks, explicit, T.media_key_index(files))


def _report_tasks(s, d):
    return _found(s, d).withColumn("rounds", F.col("task_id") % 4)


def _rounds(s, d):
    return X.rounds(s, d).select(F.col("session").alias("task_id"), (F.col("session") * 100 + F.col("turn")).alias("seq"), F.when(F.col("session") % 3 == 0, F.concat(F.lit("again "), (F.col("turn") % 2).cast("string"))).otherwise(F.col("text")).alias("query"))


def _audio(s, d):
    e = _rounds(s, d).filter("seq % 5 != 0").select(F.sha2("query", 256).alias("query_sha256")).distinct()
    n = F.length("query_sha256").cast("long") * 10
    more = s.sql("SELECT sha2(concat('none', k), 256) AS query_sha256 FROM (SELECT explode(sequence(0, 4)) AS k)")
    return e.unionByName(more).select("query_sha256", n.alias("sample_count"), (n * 4 + F.when(F.substring("query_sha256", 1, 1) == "a", 1).otherwise(0)).alias("bytes"))


def _cells(s, d):
    """A rubric sheet out of suppliers: rows that name a dimension and rows that name none."""
    p = X.table(s, d, "supplier")
    k = F.col("s_suppkey")
    return p.select(k.alias("row"), F.when(k % 4 == 3, "note").otherwise(F.concat(F.lit("d"), (k % 4 + 1).cast("string"), F.lit(". Name "), F.col("s_name"), F.lit("\nmore"))).alias("text"), F.col("s_nationkey").alias("declared"))


def _durations(s, d):
    o = X.table(s, d, "orders")
    k = F.col("o_orderkey")
    n = lambda m: (k % m).cast("string")
    return o.select(k.alias("task_id"), F.when(k % 3 != 0, F.concat(F.lit("限时 "), n(5), F.lit(" 秒"))).alias("user_prompt"), F.concat(F.lit("计时 - "), n(4), F.lit("秒")).alias("scene"), F.concat(F.lit("R1 后 "), n(5), F.lit("s")).alias("expected_response_window"), F.when(k % 2 == 0, F.concat(F.lit("时间到/"), n(6), F.lit("秒 结束"))).alias("expected_key_information"), F.lit(None).cast("string").alias("d5_threshold"))


def _manifest(s, d):
    a, r = X.artifacts(s, d), X.recorded(s, d)
    spec = a.select(F.col("path").alias("task_id"), F.sha2(F.concat_ws("|", "path", "bytes"), 256).alias("spec_sha256"))
    n = F.col("bytes")
    dims = F.when(n % 19 == 0, F.array(*map(F.lit, ("D2", "D1", "D3", "D4", "D5")))).when(n % 23 != 0, F.array(*map(F.lit, X.DIMS)))
    own = r.select(F.col("path").alias("task_id"), F.when(F.length("path") % 3 == 0, "v2").otherwise("v1").alias("version"), (n % 11 != 0).alias("label_free"), F.sha2(F.concat_ws("|", "path", "bytes"), 256).alias("spec_sha256"), F.lit("c").alias("contract"), F.when(n % 17 != 0, "c").alias("contract_sha256"), dims.alias("dimensions"))
    return own, spec


def _manifests(s, d):
    """Every document as a manifest of its own."""
    k = F.col("doc_id")
    unless = lambda n, good, bad=None: F.when(k % n == 0, bad).otherwise(good)
    dims = F.when(k % 29 == 0, F.array(*map(F.lit, ("D1", "D2", "D3", "D5", "D4")))).otherwise(F.array(*map(F.lit, X.DIMS)))
    return X.artifacts(s, d).select(
        k.alias("manifest"), unless(11, 2, 1).alias("schema_version"), unless(12, "v2").alias("version"), unless(13, True, False).alias("label_free"), unless(15, F.col("sha256"), F.lit("x")).alias("contract_sha256"), unless(14, F.col("sha256")).alias("contract_now"), unless(16, "v2", "v1").alias("contract_version"), dims.alias("dimensions"),
        unless(17, "只对有效响应计时，无有效响应记 0。", "只对有效响应计时").alias("d3_definition"), unless(18, "响应内容正确性", "x").alias("d4_name"), unless(19, 0.0, 0.5).alias("d3_no_response_score"), unless(20, "response_content_correctness").alias("d4_scope"), unless(21, True).alias("formal_ready"), unless(22, 0, 3).alias("errors"),
        unless(23, F.col("path")).alias("workbook_sha256"), unless(24, F.col("path"), F.lit("y")).alias("workbook_now"), unless(25, 75, 74).alias("task_count"), unless(50, 75, 70).alias("tasks"),
    )


def _manifest_findings(s, d):
    """Findings of manifests as a whole (scope contract) and of their tasks."""
    whole = U.contract_check(_manifests(s, d), "v2", 75).select(F.lit("contract").alias("scope"), F.col("manifest").cast("string").alias("task_id"), "reason")
    return whole.unionByName(U.manifest_check(*_manifest(s, d), "v1").select(F.lit("task").alias("scope"), "task_id", "reason"))


def _claims(s, d):
    """Claim and finish events: some finish twice, some were never claimed or never finish."""
    e = X.table(s, d, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "claim").otherwise("finish")
    return e.select(F.col("user_id").alias("task"), (F.col("event_id") % 11).alias("request"), kind.alias("kind"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "exception").otherwise("response").alias("status"))


def _requests(s, d):
    e = X.table(s, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("look\nINPUT: "), F.lit('{"task_id": "t'), (F.col("event_id") % 75).cast("string"), F.lit('", "k": 1}'))).otherwise(F.col("props"))
    return e.select(F.col("event_id").alias("id"), text.alias("user_text"))


def _seals(s, d):
    p = X.table(s, d, "part")
    head = p.select(F.col("p_partkey").alias("ledger"), "p_name", "p_size").withColumn("identity_sha256", U.canonical_hash("p_name", "p_size"))
    head = head.withColumn("identity_sha256", F.when(F.col("ledger") % 40 == 0, F.lit("0")).otherwise(F.col("identity_sha256")))
    seals = head.filter("ledger % 30 != 1").select("ledger", F.when(F.col("ledger") % 25 == 2, F.lit("1")).otherwise(U.canonical_hash("p_name", "p_size")).alias("seal_sha256"))
    return head, seals


_N = ["url", "html"]
_ERRORS = ("HTTP 401: refused", "rpc: UNAUTHENTICATED", "API Key无效", "Invalid API key given", "bad api key invalid", "Error 403 unauthorized", "HTTP 4010", "authentication of user")


def _error():
    """Error texts with and without a marker of refused credentials."""
    said = F.get(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 8).cast("int"))
    return F.when(F.col("event_id") % 7 == 0, said).otherwise(F.col("event_type"))


QUERIES = {
    "src_sheet_table": lambda s, d: T.validate_pool(_pool(s, d), ["id", "category"], "state").groupBy("id", "duplicate").agg(F.count(F.lit(1)).alias("n")),
    "task_clean_cell": lambda s, d: _pool(s, d).select(T.clean_cell(F.col("id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")),
    "task_parse_seconds": lambda s, d: _seconds(s, d).select("o_orderkey", T.parse_seconds(F.col("cell"), 7.5).alias("seconds")),
    "task_round_label": lambda s, d: X.table(s, d, "customer").select("c_custkey", T.round_label(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" r 0"), F.col("c_nationkey").cast("string"))).otherwise(F.lower("c_mktsegment"))).alias("label")),
    "task_split_labels": lambda s, d: _sheet_rounds(s, d).select("task_id", F.transform(T.split_labels(F.col("query"), True), lambda p: F.concat_ws("=", p["label"], p["text"])).alias("p")).select("task_id", F.array_join("p", ";").alias("parts")),
    "task_query_rounds": lambda s, d: T.query_rounds(_sheet_rounds(s, d)),
    "task_alias_rounds": lambda s, d: T.normalize_rounds(_json_rounds(s, d)).select("task_id", "place", "round_id", "query", F.round("query_time_s", 2).alias("query_time_s"), "error"),
    "task_alias_fields": lambda s, d: T.normalize_task(X.table(s, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).alias("task_id"), F.col("o_orderstatus").alias("video")), {"id": ["id", "task_id"], "path": ["video"]}, ["id", "path"]).groupBy("id", "path").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_join("missing", ",")).alias("missing")),
    "task_media_dupes": lambda s, d: T.media_key_index(_media(s, d)[0]),
    "task_resolve_media": lambda s, d: _found(s, d),
    "task_duration": lambda s, d: T.resolve_duration(X.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 5).alias("stated_s"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(12.5)).alias("probed_s")), 30.0, 9000.0).select("o_orderkey", F.round("duration_s", 2).alias("duration_s")),
    "task_filter": lambda s, d: T.filter_tasks(X.table(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("category")), X.table(s, d, "lineitem").filter("l_linenumber = 3").select(F.col("l_orderkey").alias("task_id")), ["1-URGENT", "5-LOW"], 500),
    "task_subset_ordered": lambda s, d: T.select_in_order(X.table(s, d, "customer").select(F.col("c_custkey").alias("task_id"), "c_name"), X.table(s, d, "orders").filter("o_orderkey % 97 = 0").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("place")))[0],
    "task_repeat_query": lambda s, d: T.repeated_queries(_rounds(s, d)),
    "task_query_dedupe": lambda s, d: T.unique_queries(_rounds(s, d)),
    "task_report": lambda s, d: T.task_report(_report_tasks(s, d)),
    "task_gate": lambda s, d: T.task_gate(_report_tasks(s, d), 250),
    "task_audio_coverage": lambda s, d: T.audio_coverage(_rounds(s, d), _audio(s, d)),
    "rub_unpivot": lambda s, d: _long(s, d),
    "rub_threshold_alias": lambda s, d: X.table(s, d, "part").select("p_partkey", U.normalize_threshold(F.concat(F.lit("F: "), F.col("p_name"), F.lit(" P≥"), F.col("p_size").cast("string"))).alias("threshold")),
    "rub_dimensions": lambda s, d: U.rubric_dimensions(_cells(s, d)),
    "rub_headerless": lambda s, d: U.headerless_cells(X.table(s, d, "part").select(F.col("p_partkey").alias("row"), F.array(F.lit("id"), F.lit(" "), F.lit(None).cast("string")).alias("headers"), F.array(F.lit("x"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")), F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise("y")).alias("cells"))),
    "rub_missing_fields": lambda s, d: U.missing_fields(_durations(s, d), ["user_prompt", "scene", "expected_key_information", "d5_threshold"]),
    "rub_missing_rule": lambda s, d: U.missing_rule(_long(s, d)),
    "rub_missing_weight": lambda s, d: U.missing_weight(_long(s, d)),
    "rub_rule_on_na": lambda s, d: U.rule_on_na(_long(s, d)),
    "rub_weight_sum": lambda s, d: U.weight_sum(_long(s, d)).select("task_id", F.round("total", 6).alias("total")),
    "rub_duration_conflict": lambda s, d: U.duration_conflict(_durations(s, d)).select("task_id", "deadline", F.array_join(F.array_sort(F.map_keys("conflicts")), ",").alias("fields")),
    "rub_count_mismatch": lambda s, d: U.applicable_counts(s.sql("SELECT concat('D', k) AS dim, k * 400 AS declared FROM (SELECT explode(sequence(1, 5)) AS k)"), _long(s, d)),
    "rub_ready": lambda s, d: U.formal_ready(U.issues(_long(s, d))),
    "rub_canonical_hash": lambda s, d: X.table(s, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("weight")).select("p_partkey", U.canonical_hash("weight", "p_name", "p_partkey").alias("hash")),
    "rub_manifest_check": _manifest_findings,
    "lg_fold": lambda s, d: G.fold_attempts(_claims(s, d)),
    "lg_validate": lambda s, d: G.validate_ledger(X.attempts(s, d).withColumn("attempt", F.col("attempt") + F.when(F.col("task") % 70 == 3, 1).otherwise(0)), 5),
    "lg_final_ok": lambda s, d: G.final_ok(X.attempts(s, d), 5),
    "lg_exhausted": lambda s, d: G.exhausted(X.attempts(s, d), 5),
    "lg_auth_failed": lambda s, d: X.table(s, d, "events").select("event_id", G.auth_failed(_error()).alias("auth")),
    "lg_seal": lambda s, d: G.check_seal(*_seals(s, d), ["p_name", "p_size"]),
    "lg_task_of_request": lambda s, d: G.task_of_request(_requests(s, d), "INPUT:"),
}
_ROUNDS = ", rr AS (SELECT session AS task_id, session * 100 + turn AS seq, CASE WHEN session % 3 = 0 THEN 'again ' || (turn % 2) ELSE text END AS query FROM rounds)\n"
_FOUND = _MEDIA + """, t AS (SELECT page_id AS task_id, url, CASE WHEN page_id % 3 = 0 THEN nullif(lower(regexp_replace(stem, '[\\s_—–-]+', '', 'g')), '') END AS lk, CASE WHEN page_id % 3 = 1 THEN nullif(lower(regexp_replace(upper(stem), '[\\s_—–-]+', '', 'g')), '') END AS sk FROM st),
found AS (SELECT task_id, coalesce(CASE WHEN task_id % 10 = 0 THEN url END, a.path, b.path, c.path) AS path, CASE WHEN task_id % 10 = 0 THEN 'map' WHEN a.path IS NOT NULL THEN 'label' WHEN b.path IS NOT NULL THEN 'scene' WHEN c.path IS NOT NULL THEN 'id' END AS found_by
 FROM t LEFT JOIN ix a ON a.key = lk LEFT JOIN ix b ON b.key = sk LEFT JOIN ix c ON c.key = task_id::VARCHAR)
"""
_LEDGER = "SELECT stage, task, count(*) AS attempts, (count(*) <= 5 AND arg_max(status, attempt) = 'response' AND arg_max(status_code, attempt) = 200) AS ok FROM attempts GROUP BY 1, 2"
_POOLSQL = "(SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 40 = 1 THEN 't1' ELSE 't' || c_custkey END AS id, c_custkey % 3 = 0 AS chosen FROM customer)"
_SECONDS = "CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN o_totalprice WHEN 2 THEN o_orderkey % 90 WHEN 3 THEN 7.5 ELSE o_orderpriority[1:1]::DOUBLE END"
_T1 = "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 30)::DOUBLE ELSE 0.0 END"
_DOC = """SELECT o_orderkey AS task_id, 0 AS pos, 'R1' AS round_id, coalesce(o_orderstatus, '') AS query, o_totalprice - 1000 AS query_time_s FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 0, 'A', 'late', (o_orderkey % 7)::DOUBLE FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 1, 'R2', 'early', 2.0 FROM orders WHERE o_orderkey % 3 = 0"""
ORACLES = {
    "src_sheet_table": f"SELECT id, count(*) > 1 AS duplicate, count(*) AS n FROM {_POOLSQL} WHERE id IS NOT NULL AND chosen GROUP BY 1",
    "task_clean_cell": f"SELECT id, count(*) AS n FROM {_POOLSQL} GROUP BY 1",
    "task_parse_seconds": f"SELECT o_orderkey, ({_SECONDS})::DOUBLE AS seconds FROM orders",
    "task_round_label": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'R' || c_nationkey ELSE upper(c_mktsegment) END AS label FROM customer",
    "task_split_labels": "SELECT o_orderkey AS task_id, CASE o_orderkey % 4 WHEN 0 THEN 'R1=看 ' || o_orderpriority || ';R2=再看 ' || o_orderpriority WHEN 1 THEN 'R1=a ' || o_orderpriority || ';R2=b' ELSE '' END AS parts FROM orders",
    "task_query_rounds": f"""SELECT o_orderkey AS task_id, 0 AS pos, 'R1' AS round_id, CASE o_orderkey % 4 WHEN 0 THEN '看 ' || o_orderpriority WHEN 1 THEN 'a ' || o_orderpriority ELSE o_orderpriority END AS query, {_T1} AS query_time_s FROM orders
UNION ALL SELECT o_orderkey, 1, 'R2', CASE o_orderkey % 4 WHEN 0 THEN '再看 ' || o_orderpriority WHEN 1 THEN 'b' ELSE o_orderpriority END, CASE WHEN o_orderkey % 3 = 0 THEN 5.0 ELSE 0.0 END FROM orders WHERE o_orderkey % 4 < 2 OR o_orderkey % 3 = 0""",
    "task_alias_rounds": f"WITH r AS ({_DOC}) SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY query_time_s, pos) AS place, round_id, query, round(query_time_s, 2) AS query_time_s, CASE WHEN query = '' THEN 'missing text' WHEN query_time_s < 0 THEN 'invalid time' END AS error FROM r",
    "task_alias_fields": "SELECT id, path, count(*) AS n, CASE WHEN id IS NULL THEN 'id' ELSE '' END AS missing FROM (SELECT CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0 THEN o_orderkey::VARCHAR END AS id, o_orderstatus AS path FROM orders) GROUP BY 1, 2",
    "task_media_dupes": _MEDIA + "SELECT key, path, n FROM ix",
    "task_resolve_media": _FOUND + "SELECT task_id, path, found_by FROM found",
    "task_duration": "SELECT o_orderkey, round(round_even(least(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 5 END, CASE WHEN o_orderkey % 2 = 0 THEN 12.5 END, 30.0)::DOUBLE, 9000.0), 3), 2) AS duration_s FROM orders",
    "task_filter": "SELECT o_orderkey AS task_id, o_orderpriority AS category FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) ORDER BY 1 LIMIT 500",
    "task_subset_ordered": "SELECT o_custkey AS task_id, o_orderkey AS place, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 97 = 0",
    "task_repeat_query": oracle("rounds", _ROUNDS + "SELECT task_id, count(*) AS rounds, count(DISTINCT query) AS texts FROM rr GROUP BY 1 HAVING count(DISTINCT query) < count(*)"),
    "task_query_dedupe": oracle("rounds", _ROUNDS + "SELECT sha256(query) AS query_sha256, min(seq) AS seq, count(*) AS times FROM rr GROUP BY 1"),
    "task_report": _FOUND + "SELECT count(*) AS selected, count(path) AS written, count(DISTINCT path) AS unique_videos, count(*) FILTER (task_id % 4 > 1) AS multi_round, count(*) FILTER (path IS NULL) AS missing FROM found",
    "task_gate": _FOUND + "SELECT count(*) = 250 AS count_ok, count(DISTINCT task_id) = count(*) AS ids_unique, true AS ids_present, count(DISTINCT path) = count(*) AS videos_unique FROM found",
    "task_audio_coverage": oracle("rounds", _ROUNDS + """, q AS (SELECT DISTINCT sha256(query) AS query_sha256 FROM rr), e AS (SELECT DISTINCT sha256(query) AS query_sha256 FROM rr WHERE seq % 5 <> 0 UNION ALL SELECT sha256('none' || k) FROM (SELECT unnest(range(5)) AS k))
SELECT coalesce(q.query_sha256, e.query_sha256) AS query_sha256, CASE WHEN e.query_sha256 IS NULL THEN 'no_audio' WHEN q.query_sha256 IS NULL THEN 'no_query' ELSE 'size' END AS finding FROM q FULL JOIN e ON q.query_sha256 = e.query_sha256 WHERE e.query_sha256 IS NULL OR q.query_sha256 IS NULL OR e.query_sha256[1:1] = 'a'"""),
    "rub_unpivot": oracle("rubric", "SELECT task_id, dim, applicable, threshold, weight FROM rubric"),
    "rub_dimensions": """WITH r AS (SELECT s_suppkey AS row, 'D' || (s_suppkey % 4 + 1) AS dim, 'Name ' || s_name AS name, s_nationkey AS declared FROM supplier WHERE s_suppkey % 4 <> 3), g AS (SELECT dim, arg_min(name, row) AS name, arg_min(declared, row) AS declared, count(*) AS n FROM r GROUP BY 1)
SELECT 'D' || k AS dim, name, declared, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k) LEFT JOIN g ON dim = 'D' || k""",
    "rub_headerless": "SELECT p_partkey AS row, 1 AS \"column\", p_name AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 2, 'y' FROM part WHERE p_partkey % 3 <> 0",
    "rub_canonical_hash": """SELECT p_partkey, sha256('{"p_name":' || to_json(p_name) || ',"p_partkey":' || p_partkey || ',"weight":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE p_size::VARCHAR END || '}') AS hash FROM part""",
    "rub_threshold_alias": "SELECT p_partkey, 'S: ' || p_name || ' B≥' || p_size AS threshold FROM part",
    "rub_missing_fields": "SELECT o_orderkey AS task_id, 'user_prompt' AS field FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'expected_key_information' FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, 'd5_threshold' FROM orders",
    "rub_missing_rule": oracle("rubric", "SELECT task_id, dim FROM rubric WHERE applicable AND threshold = '-'"),
    "rub_missing_weight": oracle("rubric", "SELECT task_id, dim FROM rubric r WHERE applicable AND weight IS NULL AND EXISTS (SELECT 1 FROM rubric x WHERE x.task_id = r.task_id AND x.applicable AND x.weight IS NOT NULL)"),
    "rub_rule_on_na": oracle("rubric", "SELECT task_id, dim FROM rubric WHERE NOT applicable AND (weight IS NOT NULL OR threshold <> '-')"),
    "rub_weight_sum": oracle("rubric", "SELECT task_id, round(sum(weight), 6) AS total FROM rubric WHERE applicable GROUP BY 1 HAVING sum(weight) IS NOT NULL AND abs(sum(weight) - 1) > 1e-9"),
    "rub_duration_conflict": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS deadline, list_filter(['expected_key_information', 'scene'], lambda f: CASE WHEN f = 'scene' THEN o_orderkey % 4 <> o_orderkey % 5 ELSE o_orderkey % 2 = 0 AND o_orderkey % 6 <> o_orderkey % 5 END) AS fields FROM orders WHERE o_orderkey % 3 <> 0)
SELECT k AS task_id, deadline, array_to_string(fields, ',') AS fields FROM o WHERE len(fields) > 0""",
    "rub_count_mismatch": oracle("rubric", "SELECT dim, dim[2:2]::BIGINT * 400 AS declared, count(*) FILTER (applicable) AS actual FROM rubric GROUP BY 1 HAVING count(*) FILTER (applicable) <> dim[2:2]::BIGINT * 400"),
    "rub_ready": oracle("rubric", """, e AS (SELECT count(*) AS n FROM rubric r WHERE (applicable AND threshold = '-')), m AS (SELECT count(*) AS n FROM rubric r WHERE applicable AND weight IS NULL AND EXISTS (SELECT 1 FROM rubric x WHERE x.task_id = r.task_id AND x.applicable AND x.weight IS NOT NULL)),
w AS (SELECT count(*) AS n FROM rubric WHERE NOT applicable AND (weight IS NOT NULL OR threshold <> '-')), t AS (SELECT count(*) AS n FROM (SELECT task_id FROM rubric WHERE applicable GROUP BY 1 HAVING sum(weight) IS NOT NULL AND abs(sum(weight) - 1) > 1e-9))
SELECT e.n + m.n AS errors, w.n + t.n AS warnings, e.n + m.n = 0 AS ready FROM e, m, w, t"""),
    "rub_manifest_check": oracle("recorded", """, own AS (SELECT path AS task_id, CASE WHEN length(path) % 3 = 0 THEN 'v2' ELSE 'v1' END AS version, bytes, path || '|' || bytes AS h FROM recorded), spec AS (SELECT path AS task_id, path || '|' || bytes AS h FROM artifacts),
b AS (SELECT coalesce(own.task_id, spec.task_id) AS task_id, version, bytes, own.h AS oh, spec.h AS sh, count(*) OVER (PARTITION BY coalesce(own.task_id, spec.task_id)) AS n FROM own FULL JOIN spec ON own.task_id = spec.task_id)
SELECT DISTINCT 'task' AS scope, task_id, reason FROM (SELECT task_id, unnest([CASE WHEN oh IS NULL THEN 'missing_task' END, CASE WHEN sh IS NULL THEN 'unknown_task' END, CASE WHEN version <> 'v1' THEN 'version' END, CASE WHEN bytes % 11 = 0 THEN 'labels' END, CASE WHEN oh <> sh THEN 'spec_hash' END, CASE WHEN bytes % 17 = 0 THEN 'contract_hash' END,
 CASE WHEN bytes % 19 = 0 OR bytes % 23 = 0 THEN 'dimensions' END, CASE WHEN n > 1 THEN 'duplicate_task' END]) AS reason FROM b) WHERE reason IS NOT NULL
UNION ALL SELECT 'contract', doc_id::VARCHAR, reason FROM (SELECT doc_id, unnest([CASE WHEN doc_id % 11 = 0 THEN 'schema_version' END, CASE WHEN doc_id % 12 = 0 THEN 'version' END, CASE WHEN doc_id % 13 = 0 THEN 'labels' END, CASE WHEN doc_id % 14 = 0 THEN 'no_contract' END, CASE WHEN doc_id % 14 = 0 OR doc_id % 15 = 0 THEN 'contract_hash' END,
 CASE WHEN doc_id % 16 = 0 THEN 'contract_version' END, CASE WHEN doc_id % 29 = 0 THEN 'dimensions' END, CASE WHEN doc_id % 17 = 0 THEN 'd3_definition' END, CASE WHEN doc_id % 18 = 0 THEN 'd4_name' END, CASE WHEN doc_id % 19 = 0 THEN 'd3_no_response' END, CASE WHEN doc_id % 20 = 0 THEN 'd4_scope' END, CASE WHEN doc_id % 21 = 0 OR doc_id % 22 = 0 THEN 'open_errors' END,
 CASE WHEN doc_id % 23 = 0 THEN 'no_workbook' END, CASE WHEN doc_id % 23 <> 0 AND doc_id % 24 = 0 THEN 'workbook_changed' END, CASE WHEN doc_id % 50 = 0 THEN 'tasks' END, CASE WHEN doc_id % 25 = 0 THEN 'task_count' END]) AS reason FROM artifacts) WHERE reason IS NOT NULL"""),
    "lg_fold": """WITH e AS (SELECT user_id AS task, event_id % 11 AS request, event_type IN ('click', 'view') AS claim, event_id AS seq, CASE WHEN event_type = 'error' THEN 'exception' ELSE 'response' END AS status FROM events),
p AS (SELECT task, request, min(seq) FILTER (claim) AS c, count(*) FILTER (NOT claim) AS f, arg_max(status, seq) FILTER (NOT claim) AS s FROM e GROUP BY 1, 2)
SELECT task, request, row_number() OVER (PARTITION BY task ORDER BY c NULLS LAST, request) AS attempt, coalesce(s, 'claimed') AS status, CASE WHEN c IS NULL THEN 'finish_without_claim' WHEN f > 1 THEN 'finished_twice' END AS error FROM p""",
    "lg_validate": oracle("attempts", """, p AS (SELECT task, count(*) AS n FROM attempts GROUP BY 1) SELECT task, reason FROM (SELECT task, unnest([CASE WHEN n > 5 THEN 'over_budget' END, CASE WHEN task % 70 = 3 THEN 'sequence' END]) AS reason FROM p) WHERE reason IS NOT NULL"""),
    "lg_final_ok": oracle("attempts", _LEDGER),
    "lg_exhausted": oracle("attempts", f"SELECT stage, task, attempts FROM ({_LEDGER}) WHERE NOT ok AND attempts >= 5"),
    "lg_auth_failed": "SELECT event_id, event_id % 7 = 0 AND event_id % 8 IN (0, 1, 2, 3, 4, 6) AS auth FROM events",
    "lg_seal": "SELECT p_partkey AS ledger, CASE WHEN p_partkey % 40 = 0 THEN 'identity' WHEN p_partkey % 30 = 1 THEN 'no_seal' ELSE 'seal' END AS reason FROM part WHERE p_partkey % 40 = 0 OR p_partkey % 30 = 1 OR p_partkey % 25 = 2",
    "lg_task_of_request": "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 't' || (event_id % 75) END AS task_id FROM events",
}
