"""Queries over audits, manifests, releases and the profile registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as A
from . import fixtures as X
from .fixtures import oracle


def _texts(s, d):
    return X.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _stage_files(s, d):
    """Five stages of files per document; some are missing, some differ, some are extra."""
    a = X.artifacts(s, d).withColumn("k", F.explode(F.array(*map(F.lit, range(5)))))
    return a.filter((F.col("doc_id") + F.col("k")) % 23 != 0).select(F.concat(F.lit("stage"), F.col("k").cast("string")).alias("stage"), F.when((F.col("doc_id") + F.col("k")) % 37 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("task_id"), F.when(F.col("doc_id") % 29 == F.col("k"), F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))


_FILES = """, files AS (SELECT 'stage' || k AS stage, CASE WHEN (doc_id + k) % 37 = 0 THEN -doc_id - 1 ELSE doc_id END AS task_id, CASE WHEN doc_id % 29 = k THEN reverse(sha256) ELSE sha256 END AS sha256 FROM artifacts CROSS JOIN (SELECT unnest(range(5)) AS k) WHERE (doc_id + k) % 23 <> 0)
"""


def _stage_expected(s, d):
    return X.artifacts(s, d).select(F.col("doc_id").alias("task_id"), F.explode(F.array(*[F.lit(f"stage{k}") for k in range(5)])).alias("stage"))


def _records(s, d):
    """Two systems' recordings of the documents, with places."""
    r = X.artifacts(s, d).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    r = r.filter((F.col("k") != 1) | (F.col("doc_id") % 7 != 0))
    return r.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("system"), F.col("doc_id").alias("task_id"), (F.col("doc_id") + F.when(F.col("k") == 2, 2).otherwise(1)).alias("task_index"), "path", (F.col("bytes") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("bytes"))


_RECORDS = """, records AS (SELECT 's' || k AS system, doc_id AS task_id, doc_id + CASE WHEN k = 2 THEN 2 ELSE 1 END AS task_index, path, bytes + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS bytes FROM artifacts CROSS JOIN (SELECT unnest(range(3)) AS k) WHERE k <> 1 OR doc_id % 7 <> 0)
"""


def _cells(s, d):
    """Documents beside notes that hit each rule, or nearly."""
    docs = X.table(s, d, "documents")
    notes = ["see RTSP://cam", "http://10.1.2.3/x", "https://localhost:80", "sk-abcdefgh1234", "ark-abc", "http://127.0.0.1", "in /mnt/own/data", "PK-ABCDEFGH_12-4"]
    return docs.withColumn("note", F.coalesce(F.get(F.array(*map(F.lit, notes)), (F.col("doc_id") % 9).cast("int")), "text"))


def _names(s, d):
    p = X.table(s, d, "pages")
    stem = F.regexp_extract("url", r"([^/?#]+)([?#].*)?$", 1)
    return p.select((F.col("page_id") % 240).alias("id"), F.when(F.col("page_id") % 20 == 0, F.concat(F.lit("../"), stem)).otherwise(F.concat(F.col("page_id").cast("string"), F.lit("-"), stem)).alias("video"))


_NAMES = "WITH names AS (SELECT page_id % 240 AS id, CASE WHEN page_id % 20 = 0 THEN '../' || regexp_extract(url, '([^/?#]+)([?#].*)?$', 1) ELSE page_id || '-' || regexp_extract(url, '([^/?#]+)([?#].*)?$', 1) END AS video FROM pages)\n"


def _profiles(s, d):
    c = X.table(s, d, "supplier")
    k = F.col("s_suppkey")
    return c.select(F.when(k % 9 == 0, F.concat(F.lit("Bad "), k.cast("string"))).when(k % 10 == 1, "p-same").when(k % 4 == 2, F.concat(F.lit("P."), k.cast("string"))).otherwise(F.concat(F.lit("p-"), k.cast("string"))).alias("id"), F.when(k % 8 == 0, "ftp://x").when(k % 8 == 1, "https://u:p@host/v1").otherwise(F.concat(F.lit("https://host"), k.cast("string"), F.lit("/v1"))).alias("base_url"), F.when(k % 6 == 0, "pigeon").otherwise("http").alias("transport"), F.when(k % 14 == 0, " ").when(k % 15 != 0, "m").alias("model"), F.when(k % 16 == 0, "other").when(k % 2 == 0, "direct").otherwise("adapter").alias("route"), F.array(F.concat(F.lit("b"), (k % 3).cast("string")), F.concat(F.lit("a"), (k % 5).cast("string"))).alias("aliases"), F.array(F.concat(F.lit("tag"), (k % 4).cast("string"))).alias("tags"), (k % 2 == 0).alias("enabled"))


_PROFILES = """WITH profiles AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 0 THEN 'Bad ' || s_suppkey WHEN s_suppkey % 10 = 1 THEN 'p-same' WHEN s_suppkey % 4 = 2 THEN 'P.' || s_suppkey ELSE 'p-' || s_suppkey END AS id, CASE WHEN s_suppkey % 8 = 0 THEN 'ftp' WHEN s_suppkey % 8 = 1 THEN 'cred' ELSE 'ok' END AS base, s_suppkey % 6 = 0 AS bad_transport, 'tag' || (s_suppkey % 4) AS tag FROM supplier)
"""


def _json_docs(s, d):
    e = X.table(s, d, "events")
    k = F.col("event_id")
    doc = F.when(k % 3 == 0, F.concat(F.lit('{"a": {"Scores": '), k.cast("string"), F.lit('}, "list": [{"grade": 1}, {"x": 2}]}'))).when(k % 3 == 1, F.col("props")).otherwise("broken {")
    return e.select(k.alias("id"), doc.alias("json"))


def _shapes(s, d):
    e = X.table(s, d, "events")
    k = F.col("event_id")
    return e.select(k.alias("id"), F.when(k % 2 == 0, "first").otherwise("review").alias("stage"), F.when(k % 5 == 0, '{"b": 1, "a": 2}').when(k % 5 == 1, "[1]").otherwise(F.col("props")).alias("json"))


def _edges(s, d):
    o = X.table(s, d, "part")
    k = F.col("p_partkey")
    return o.select(k.alias("a"), (k * 3 + 1).alias("b")).unionByName(o.filter("p_partkey % 4 = 0").select(k.alias("a"), (k + 7).alias("b")))


def _frames(s, d, shift=0):
    a = X.artifacts(s, d)
    return a.select((F.col("doc_id") % 50).alias("task_id"), (F.floor(F.col("doc_id") / 50) + F.when(F.col("doc_id") % 31 == 0, 1).otherwise(0)).alias("index"), F.when(F.col("doc_id") % 41 != 0, F.col("bytes") / 10.0).alias("time_s"), "path", F.when(F.col("doc_id") % 43 == shift, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))


_FRAMESQL = """, fr AS (SELECT doc_id % 50 AS task_id, doc_id // 50 + CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END AS "index", CASE WHEN doc_id % 41 <> 0 THEN bytes / 10.0 END AS time_s, path, sha256, doc_id FROM artifacts)
"""


def _versions(s, d):
    o = X.table(s, d, "orders")
    return o.select((F.col("o_orderkey") % 3000).alias("system"), "o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("id"))


def _streams(s, d):
    o = X.table(s, d, "orders").select(F.col("o_orderkey").alias("path"), F.array("o_orderstatus", "o_orderpriority").alias("streams"), F.col("o_totalprice").alias("duration_s"))
    return o, o.filter("path % 50 != 0").select("path", F.when(F.col("path") % 6 == 0, F.array(F.lit("x"))).otherwise(F.reverse("streams")).alias("streams"), (F.col("duration_s") + F.when(F.col("path") % 4 == 0, 0.75).otherwise(0.25)).alias("duration_s"))


QUERIES = {
    "aud_artifact": lambda s, d: A.verify_artifacts(X.recorded(s, d), X.artifacts(s, d)),
    "aud_scope": lambda s, d: A.scope_diff(X.artifacts(s, d), X.recorded(s, d), ["path"]),
    "aud_marker_scan": lambda s, d: A.marker_scan(_texts(s, d), ["password", "AKIA", "license", "the of"]).select("id", F.array_join("markers", ",").alias("markers")),
    "aud_marker_join": lambda s, d: A.marker_join(_texts(s, d), X.table(s, d, "benchmark").select(F.col("item_id").alias("marker_id"), "text")),
    "aud_task_literal": lambda s, d: A.literal_ids(X.table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text")), X.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("known")), r"\b\d{1,5}\b"),
    "aud_forbidden_key": lambda s, d: A.forbidden_keys(_json_docs(s, d), ["score", "grade"], "loose"),
    "aud_input_shape": lambda s, d: A.input_shape(_shapes(s, d), {"first": ["k"], "review": ["a", "b"]}),
    "aud_spec_equal": lambda s, d: A.lineage(X.recorded(s, d), X.artifacts(s, d), ["path"], ["sha256"]),
    "aud_review_lineage": lambda s, d: A.lineage(X.recorded(s, d), X.artifacts(s, d), ["path"], ["bytes", "sha256"]),
    "aud_candidate_lineage": lambda s, d: A.candidate_lineage(X.artifacts(s, d).select(F.col("doc_id").alias("id"), F.array("path", "sha256", "path").alias("digests")), X.artifacts(s, d).filter("doc_id % 5 != 0").select(F.col("doc_id").alias("id"), F.explode(F.map_from_arrays(F.array(F.lit("first"), F.lit("second")), F.array(F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.col("path")), "sha256"))).alias("stage", "digest")), ["first", "second"]),
    "aud_one_version": lambda s, d: A.one_version(_versions(s, d), ["system"], ["o_orderstatus", "o_orderpriority"]),
    "aud_identity": lambda s, d: A.identity_check(_versions(s, d).withColumnRenamed("system", "n").withColumn("stage", F.col("n") % 4), s.sql("SELECT k AS stage, CASE WHEN k < 2 THEN 'O' ELSE 'F' END AS o_orderstatus, CASE WHEN k = 0 THEN '5-LOW' ELSE '1-URGENT' END AS o_orderpriority FROM (SELECT explode(sequence(0L, 2L)) AS k)"), ["o_orderstatus", "o_orderpriority"]).groupBy("stage", "field").agg(F.count(F.lit(1)).alias("n")),
    "aud_dependency_map": lambda s, d: A.map_diff(X.recorded(s, d).select("path", F.when(F.length("path") % 2 == 0, F.col("sha256")).otherwise(F.reverse("sha256")).alias("sha256")), X.artifacts(s, d).select("path", "sha256")),
    "aud_state_frozen": lambda s, d: A.frozen_fields(X.recorded(s, d).select("path", "bytes", "sha256"), X.artifacts(s, d).select("path", "bytes", F.when(F.col("bytes") % 3 == 0, F.lit(None)).otherwise(F.col("sha256")).alias("sha256")), "path", ["bytes", "sha256"]),
    "aud_fileset_hash": lambda s, d: A.fileset_hash(_stage_files(s, d).select("stage", F.col("task_id").cast("string").alias("path"), "sha256"), ["stage"]),
    "aud_import_closure": lambda s, d: A.reachable(_edges(s, d), s.sql("SELECT explode(array(0L, 5L)) AS node")),
    "aud_preflight": lambda s, d: A.preflight_check(_frames(s, d), X.artifacts(s, d).filter("doc_id % 47 != 0")),
    "aud_frames_equal": lambda s, d: A.frames_equal(_frames(s, d).filter("path != 'doc/7'"), _frames(s, d, 1), ["time_s", "path", "sha256"]),
    "aud_edge_pairs": lambda s, d: A.derived_pairs(X.artifacts(s, d).select(F.concat("path", F.lit(".jpg")).alias("path")), X.artifacts(s, d).filter("doc_id % 9 != 0").select(F.concat("path", F.lit("_edge.jpg")).alias("path")), "_edge"),
    "aud_stage_inventory": lambda s, d: A.stage_inventory(_stage_expected(s, d), _stage_files(s, d).select("stage", "task_id")),
    "aud_stage_inputs": lambda s, d: A.inputs_consistent(_stage_files(s, d), 5),
    "aud_source_roles": lambda s, d: A.source_roles(_stage_files(s, d).select(F.col("task_id").alias("path"), F.col("stage").alias("role"), "sha256")),
    "aud_reusable": lambda s, d: A.reusable(_frames(s, d).withColumn("ok", F.col("task_id") % 5 != 0), X.artifacts(s, d)),
    "aud_report": lambda s, d: A.audit_report(A.verify_artifacts(X.recorded(s, d), X.artifacts(s, d)).withColumn("stage", F.length("path") % 3)),
    "man_records": lambda s, d: A.recording_rows(_records(s, d).select("system", "task_id", F.when(F.col("task_id") % 3 == 0, 0).otherwise(F.col("bytes")).alias("bytes")), _records(s, d).select("system", "task_id", F.when(F.col("task_id") % 9 == 0, 0).otherwise(F.col("bytes") + 1).alias("size"))),
    "man_unique_pair": lambda s, d: A.pair_check(_records(s, d).select("system", (F.col("task_id") % 97).alias("task_id")), s.sql("SELECT concat('s', k) AS system FROM (SELECT explode(sequence(0, 3)) AS k)")),
    "man_index_dense": lambda s, d: A.index_dense(_records(s, d), X.artifacts(s, d).count()),
    "man_task_diff": lambda s, d: A.task_diff(_records(s, d), X.artifacts(s, d).select(F.col("doc_id").alias("task_id"))),
    "man_prompt_match": lambda s, d: A.prompt_match(X.rounds(s, d).select(F.col("session").alias("task_id"), F.col("rn").alias("place"), F.col("text").alias("query")), X.rounds(s, d).groupBy(F.col("session").alias("task_id")).agg(F.concat(F.lit("R1： "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda r: r["text"]), "\n r2: "), F.when(F.col("task_id") % 3 == 0, "!").otherwise("")).alias("prompt"))),
    "man_build": lambda s, d: A.build_manifest(_records(s, d), X.artifacts(s, d).select(F.col("doc_id").alias("task_id"), F.col("sha256").alias("spec")), X.artifacts(s, d)).select("system", "task_id", "evidence.path", "evidence.bytes", "evidence.sha256", "spec"),
    "man_index": lambda s, d: A.fileset_hash(_records(s, d).select("system", "path", F.col("bytes").cast("string").alias("sha256")), ["system"]),
    "rel_media_check": lambda s, d: A.media_check(_names(s, d), _names(s, d).filter("id % 13 != 1").select("video")),
    "rel_sensitive_scan": lambda s, d: A.sensitive_cells(_cells(s, d), "doc_id", ["text", "note", "source"], ("/mnt/own/",)),
    "rel_metadata_keys": lambda s, d: A.sensitive_metadata(_json_docs(s, d).withColumn("json", F.replace("json", F.lit("Scores"), F.lit("GPS")))),
    "rel_signature": lambda s, d: A.signature_equal(*_streams(s, d)),
    "rel_provenance": lambda s, d: A.provenance_cover(X.recorded(s, d).select("path", F.lit("own").alias("source"), F.when(F.col("bytes") % 5 != 0, "CC").otherwise(" ").alias("license")), X.artifacts(s, d).select("path")),
    "rel_redact": lambda s, d: X.table(s, d, "pages").select("page_id", A.redact(F.concat(F.lit("https://user:pw@h.example/x?token=abc&page=1 "), F.lit('{"api-key": "v\\"w", "Access_Token": 12, "secret": null, "password": {"a": [1, "]"]}, "key": "k", "n": 1} x?authorization=q&signature=s ftp://me@h '), F.col("url"))).alias("text")),
    "rel_index_rewrite": lambda s, d: A.released_index(_names(s, d), "videos/"),
    "reg_fingerprint": lambda s, d: A.profile_fingerprint(_profiles(s, d), ["base_url", "transport"]),
    "reg_validate": lambda s, d: A.validate_profiles(_profiles(s, d), ["adapter", "direct"], ["http", "ws"]),
    "reg_select": lambda s, d: A.select_profiles(_profiles(s, d), "p-12, tag:tag3, p-same, tag:tag1"),
}
QUERIES["rel_order_equal"] = lambda s, d: A.order_equal(X.table(s, d, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("id")), X.table(s, d, "orders").select(F.col("o_orderkey").alias("place"), F.when(F.col("o_orderkey") == 77, -1).otherwise(F.col("o_custkey")).alias("id")))
_VERIFY = "SELECT r.path, CASE WHEN a.path IS NULL THEN 'missing' WHEN r.bytes <> a.bytes THEN 'bytes' WHEN r.sha256 <> a.sha256 THEN 'sha256' END AS reason FROM recorded r LEFT JOIN artifacts a ON a.path = r.path"
ORACLES = {
    "aud_artifact": oracle("recorded", f"SELECT * FROM ({_VERIFY}) WHERE reason IS NOT NULL"),
    "aud_scope": oracle("recorded", "SELECT path, 'missing' AS reason FROM artifacts WHERE path NOT IN (SELECT path FROM recorded) UNION ALL SELECT path, 'unexpected' FROM recorded WHERE path NOT IN (SELECT path FROM artifacts)"),
    "aud_marker_scan": "SELECT doc_id AS id, array_to_string(list_sort(list_filter(['password', 'AKIA', 'license', 'the of'], lambda m: contains(text, m))), ',') AS markers FROM documents WHERE contains(text, 'password') OR contains(text, 'AKIA') OR contains(text, 'license') OR contains(text, 'the of')",
    "aud_marker_join": "SELECT doc_id AS id, item_id AS marker_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "aud_task_literal": "SELECT known, id FROM (SELECT page_id AS id, unnest(list_distinct(regexp_extract_all(url, '\\b\\d{1,5}\\b'))) AS known FROM pages) WHERE known IN (SELECT o_orderkey::VARCHAR FROM orders)",
    "aud_forbidden_key": "SELECT event_id AS id, '$.a.Scores' AS path, 'Scores' AS key FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, '$.list[0].grade', 'grade' FROM events WHERE event_id % 3 = 0",
    "aud_input_shape": "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'review' END AS stage, CASE WHEN event_id % 5 = 1 THEN 'not_an_object' ELSE 'keys' END AS reason FROM events WHERE event_id % 5 = 1 OR (event_id % 2 = 0 AND event_id % 5 = 0) OR (event_id % 2 = 1 AND event_id % 5 <> 0)",
    "aud_spec_equal": oracle("recorded", "SELECT path, 'no_upstream' AS reason FROM recorded WHERE path NOT IN (SELECT path FROM artifacts)"),
    "aud_review_lineage": oracle("recorded", "SELECT r.path, CASE WHEN a.path IS NULL THEN 'no_upstream' ELSE 'bytes' END AS reason FROM recorded r LEFT JOIN artifacts a ON a.path = r.path WHERE a.path IS NULL OR a.bytes <> r.bytes"),
    "aud_candidate_lineage": oracle("artifacts", "SELECT doc_id AS id, 2 AS pos, 'too_many' AS reason FROM artifacts UNION ALL SELECT doc_id, p, 'no_prediction' FROM artifacts CROSS JOIN (SELECT unnest([0, 1]) AS p) WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 0, 'digest' FROM artifacts WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0"),
    "aud_one_version": "SELECT o_orderkey % 3000 AS system, count(DISTINCT (o_orderstatus, o_orderpriority)) AS versions FROM orders GROUP BY 1 HAVING count(DISTINCT (o_orderstatus, o_orderpriority)) > 1",
    "aud_identity": "WITH p AS (SELECT (o_orderkey % 3000) % 4 AS stage, o_orderstatus, o_orderpriority FROM orders) SELECT stage, 'o_orderstatus' AS field, count(*) AS n FROM p WHERE stage = 3 OR o_orderstatus <> CASE WHEN stage < 2 THEN 'O' ELSE 'F' END GROUP BY 1 UNION ALL SELECT stage, 'o_orderpriority', count(*) FROM p WHERE stage = 3 OR o_orderpriority <> CASE WHEN stage = 0 THEN '5-LOW' ELSE '1-URGENT' END GROUP BY 1",
    "aud_dependency_map": oracle("recorded", ", d AS (SELECT path, CASE WHEN length(path) % 2 = 0 THEN sha256 ELSE reverse(sha256) END AS h FROM recorded) SELECT coalesce(d.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'gone' WHEN d.path IS NULL THEN 'undeclared' ELSE 'changed' END AS reason FROM d FULL JOIN artifacts a ON a.path = d.path WHERE a.path IS NULL OR d.path IS NULL OR d.h <> a.sha256"),
    "aud_state_frozen": oracle("recorded", "SELECT r.path, 'bytes' AS field FROM recorded r JOIN artifacts a ON a.path = r.path WHERE r.bytes <> a.bytes UNION ALL SELECT r.path, 'sha256' FROM recorded r JOIN artifacts a ON a.path = r.path WHERE a.bytes % 3 = 0"),
    "aud_fileset_hash": oracle("artifacts", _FILES + ", parts AS (SELECT stage, sha256(task_id::VARCHAR)[1:2] AS part, count(*) AS n, sha256(string_agg(task_id || '=' || sha256, chr(10) ORDER BY task_id::VARCHAR, sha256)) AS h FROM files GROUP BY 1, 2) SELECT stage, sum(n)::BIGINT AS files, sha256(string_agg(h, chr(10) ORDER BY part)) AS hash FROM parts GROUP BY 1"),
    "aud_import_closure": """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey * 3 + 1 AS b FROM part UNION ALL SELECT p_partkey, p_partkey + 7 FROM part WHERE p_partkey % 4 = 0),
r AS (SELECT unnest([0, 5])::BIGINT AS node, 0 AS depth UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY 1""",
    "aud_preflight": oracle("artifacts", _FRAMESQL + """, p AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY "index", path) - 1 AS place FROM fr)
SELECT task_id, "index", reason FROM (SELECT task_id, "index", unnest([CASE WHEN "index" <> place THEN 'index' END, CASE WHEN time_s IS NULL THEN 'time' END, CASE WHEN doc_id % 47 = 0 THEN 'gone' WHEN doc_id % 43 = 0 THEN 'changed' END]) AS reason FROM p) WHERE reason IS NOT NULL"""),
    "aud_source_roles": oracle("artifacts", _FILES + "SELECT task_id AS path, array_to_string(list_sort(list_distinct(list(stage))), ',') AS roles, count(DISTINCT sha256) = 1 AS one_hash FROM files GROUP BY 1"),
    "aud_edge_pairs": oracle("artifacts", "SELECT path || '.jpg' AS path, 'no_derived' AS reason FROM artifacts WHERE doc_id % 9 = 0"),
    "aud_stage_inventory": oracle("artifacts", _FILES + ", e AS (SELECT doc_id AS task_id, 'stage' || k AS stage FROM artifacts CROSS JOIN (SELECT unnest(range(5)) AS k)), b AS (SELECT coalesce(e.stage, f.stage) AS stage, e.task_id AS e, f.task_id AS f FROM e FULL JOIN (SELECT DISTINCT stage, task_id FROM files) f ON e.stage = f.stage AND e.task_id = f.task_id) SELECT stage, count(*) FILTER (e IS NOT NULL AND f IS NOT NULL) AS present, count(*) FILTER (f IS NULL) AS missing, count(*) FILTER (e IS NULL) AS extra, count(*) FILTER (f IS NULL OR e IS NULL) = 0 AS passes FROM b GROUP BY 1"),
    "aud_stage_inputs": oracle("artifacts", _FILES + "SELECT task_id, count(DISTINCT stage) AS stages, count(DISTINCT sha256) AS hashes FROM files GROUP BY 1 HAVING count(DISTINCT stage) <> 5 OR count(DISTINCT sha256) <> 1"),
    "aud_reusable": oracle("artifacts", _FRAMESQL + "SELECT task_id, bool_and(task_id % 5 <> 0 AND doc_id % 43 <> 0) AS reusable FROM fr GROUP BY 1"),
    "aud_report": oracle("recorded", f", f AS (SELECT *, length(path) % 3 AS stage FROM ({_VERIFY}) WHERE reason IS NOT NULL) SELECT stage, reason, count(*) AS findings FROM f GROUP BY GROUPING SETS ((stage), (reason), ())"),
    "man_records": oracle("artifacts", _RECORDS + "SELECT system, task_id, CASE WHEN task_id % 3 <> 0 AND bytes <> 0 THEN bytes WHEN task_id % 9 <> 0 THEN bytes + 1 END AS bytes FROM records"),
    "man_unique_pair": oracle("artifacts", _RECORDS + "SELECT system, task_id % 97 AS task_id, 'repeated' AS reason FROM records GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT 's3', NULL, 'missing'"),
    "man_index_dense": oracle("artifacts", _RECORDS + "SELECT system, count(*) AS rows, count(*) = any_value(n) AND count(DISTINCT task_id) = any_value(n) AND count(DISTINCT task_index) = any_value(n) AND min(task_index) = 1 AND max(task_index) = any_value(n) AS dense FROM records, (SELECT count(*) AS n FROM artifacts) GROUP BY 1"),
    "man_task_diff": oracle("artifacts", _RECORDS + "SELECT s.system, a.doc_id AS task_id, 'missing' AS reason FROM artifacts a CROSS JOIN (SELECT DISTINCT system FROM records) s WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.system = s.system AND r.task_id = a.doc_id)"),
    "man_prompt_match": oracle("rounds", "SELECT session AS task_id, session % 3 <> 0 AS matches FROM rounds GROUP BY 1"),
    "man_build": oracle("artifacts", _RECORDS + "SELECT r.system, r.task_id, r.path, r.bytes, a.sha256, a.sha256 AS spec FROM records r JOIN artifacts a ON a.doc_id = r.task_id AND a.bytes = r.bytes"),
    "man_index": oracle("artifacts", _RECORDS + ", parts AS (SELECT system, sha256(path)[1:2] AS part, count(*) AS n, sha256(string_agg(path || '=' || bytes, chr(10) ORDER BY path, bytes::VARCHAR)) AS h FROM records GROUP BY 1, 2) SELECT system, sum(n)::BIGINT AS files, sha256(string_agg(h, chr(10) ORDER BY part)) AS hash FROM parts GROUP BY 1"),
    "rel_media_check": _NAMES + """, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM names) SELECT id::VARCHAR AS item, CASE WHEN video LIKE '%/%' THEN 'not_a_name' ELSE 'repeated_id' END AS reason FROM n WHERE video LIKE '%/%' OR c > 1
UNION ALL SELECT DISTINCT video, 'missing' FROM names WHERE video NOT IN (SELECT video FROM names WHERE id % 13 <> 1)""",
    "rel_order_equal": "SELECT count(*) AS places, count(*) FILTER (o_orderkey = 77 AND o_custkey <> -1) = 0 AS equal FROM orders",
    "rel_signature": "SELECT o_orderkey AS path, o_orderkey % 50 <> 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 4 <> 0 AS equal FROM orders",
    "rel_metadata_keys": "SELECT event_id AS id, '$.a.GPS' AS path, 'GPS' AS key FROM events WHERE event_id % 3 = 0",
    "rel_provenance": oracle("recorded", "SELECT a.path, 'none' AS reason FROM artifacts a WHERE path NOT IN (SELECT path FROM recorded) UNION ALL SELECT path, CASE WHEN path NOT IN (SELECT path FROM artifacts) THEN 'no_file' ELSE 'incomplete' END FROM recorded WHERE path NOT IN (SELECT path FROM artifacts) OR bytes % 5 = 0"),
    "rel_redact": "SELECT page_id, 'https://[REDACTED]@h.example/x?token=[REDACTED]&page=1 {\"api-key\": \"[REDACTED]\", \"Access_Token\": \"[REDACTED]\", \"secret\": \"\", \"password\": \"[REDACTED]\", \"key\": \"k\", \"n\": 1} x?authorization=[REDACTED]&signature=s ftp://[REDACTED]@h ' || url AS text FROM pages",
    "rel_sensitive_scan": """WITH c AS (SELECT doc_id, text, CASE doc_id % 9 WHEN 0 THEN 'see RTSP://cam' WHEN 1 THEN 'http://10.1.2.3/x' WHEN 2 THEN 'https://localhost:80' WHEN 3 THEN 'sk-abcdefgh1234' WHEN 4 THEN 'ark-abc' WHEN 5 THEN 'http://127.0.0.1' WHEN 6 THEN 'in /mnt/own/data' WHEN 7 THEN 'PK-ABCDEFGH_12-4' ELSE text END AS note FROM documents),
r AS (SELECT *, 'rtsp://|https?://(10\\.|127\\.0\\.0\\.1|localhost)|(sk|ark|pk)-[a-z0-9_-]{12,}|/mnt/own/' AS p FROM c)
SELECT doc_id, 'text' AS "column" FROM r WHERE regexp_matches(text, p, 'i') UNION ALL SELECT doc_id, 'note' FROM r WHERE regexp_matches(note, p, 'i')""",
    "rel_index_rewrite": _NAMES + "SELECT id, 'videos/' || string_split(video, '/')[-1] AS video FROM names",
    "reg_validate": _PROFILES + "SELECT DISTINCT id, reason FROM (SELECT id, unnest([CASE WHEN id LIKE 'Bad%' THEN 'id' END, CASE base WHEN 'ftp' THEN 'base_url' WHEN 'cred' THEN 'credentials' END, CASE WHEN k % 14 = 0 OR k % 15 = 0 THEN 'model' END, CASE WHEN k % 16 = 0 THEN 'route' END, CASE WHEN bad_transport THEN 'transport' END, CASE WHEN n > 1 THEN 'repeated' END]) AS reason FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM profiles)) WHERE reason IS NOT NULL",
    "reg_fingerprint": """SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'Bad ' || s_suppkey WHEN s_suppkey % 10 = 1 THEN 'p-same' WHEN s_suppkey % 4 = 2 THEN 'P.' || s_suppkey ELSE 'p-' || s_suppkey END AS id, sha256('{"base_url":"' || CASE WHEN s_suppkey % 8 = 0 THEN 'ftp://x' WHEN s_suppkey % 8 = 1 THEN 'https://u:p@host/v1' ELSE 'https://host' || s_suppkey || '/v1' END
 || '","transport":"' || CASE WHEN s_suppkey % 6 = 0 THEN 'pigeon' ELSE 'http' END || '","aliases":["a' || (s_suppkey % 5) || '","b' || (s_suppkey % 3) || '"]}') AS fingerprint FROM supplier""",
    "aud_frames_equal": oracle("artifacts", _FRAMESQL + """, a AS (SELECT task_id, "index" AS i, time_s, path, CASE WHEN doc_id % 43 = 0 THEN reverse(sha256) ELSE sha256 END AS h FROM fr WHERE path <> 'doc/7'), b AS (SELECT task_id, "index" AS i, time_s, path, CASE WHEN doc_id % 43 = 1 THEN reverse(sha256) ELSE sha256 END AS h FROM fr)
SELECT task_id, count(*) AS frames, bool_and(coalesce(pa = pb AND ha = hb AND ta IS NOT DISTINCT FROM tb, false)) AS equal FROM (SELECT coalesce(a.task_id, b.task_id) AS task_id, a.path AS pa, b.path AS pb, a.h AS ha, b.h AS hb, a.time_s AS ta, b.time_s AS tb FROM a FULL JOIN b ON a.task_id = b.task_id AND a.i = b.i) GROUP BY 1"""),
    "reg_select": _PROFILES + "SELECT id, min(CASE WHEN id = 'p-12' THEN 0 WHEN tag = 'tag3' THEN 1 WHEN id = 'p-same' THEN 2 WHEN tag = 'tag1' THEN 3 END) AS place FROM profiles WHERE id IN ('p-12', 'p-same') OR tag IN ('tag1', 'tag3') GROUP BY 1",
}
