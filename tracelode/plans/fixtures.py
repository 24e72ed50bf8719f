"""Projections of the generic tables into the shapes that the operators take, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cluster import dealt, shares

DIMS = ("D1", "D2", "D3", "D4", "D5")
#: Spellings of markers that responses come in, beside whole texts.
SPELLED = ("</silence>\n", "\n\t", "＜／ｓｉｌｅｎｃｅ＞", "\n<silence>", "</response>\r\n", "</response> <12.5 seconds>", "</response> ok </silence>", "Error: Error code: 500", "</response> a </response> b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system, task_id, dim, grade (null: missing), applicable, category."""
    li = table(spark, sf_dir, "lineitem")
    parts = shares(li)
    rows = dealt(li.select(((F.col("l_linenumber") - 1) % 5 + 1).alias("n"), F.col("l_orderkey").alias("task_id"), "l_partkey", "l_suppkey"), parts, "task_id")
    it = rows.groupBy("n", "task_id").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("u"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("C"), (F.col("o_custkey") % 9).cast("string")).alias("category"))
    it = it.join(dealt(orders, parts, "task_id"), "task_id").withColumn("k", F.explode(F.array(*map(F.lit, range(1, 6)))))
    m = (F.col("p") + F.col("u") * F.col("k")) % 13
    grade = F.when(m <= 5, "G").when(m <= 9, "S").when(m <= 11, "B")
    applicable = (F.col("k") == 4) | ((F.col("task_id") + F.col("k")) % 4 != 0)
    return it.select(F.concat(F.lit("s"), F.col("n").cast("string")).alias("system"), "task_id", F.concat(F.lit("D"), F.col("k").cast("string")).alias("dim"), grade.alias("grade"), applicable.alias("applicable"), "category")


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, t_s (seconds since the session's first event, an hour as a second), kind, latency_ms, text."""
    ev = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.min(us).over(Window.partitionBy("user_id"))
    kind = F.when(F.col("event_type") == "click", "query").when(F.col("event_type") == "view", "output").when(F.col("event_type") == "error", "stalled").when(F.col("event_type") == "signup", "disconnect").otherwise("resume")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return ev.select(F.col("user_id").alias("session"), seq.cast("long").alias("seq"), F.bround((us - first) / 3600000000.0, 3).alias("t_s"), kind.alias("kind"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").alias("text"), "event_id")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as timed queries: session, rn, turn, next_turn, text."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select(F.col("conv_id").alias("session"), F.row_number().over(w).cast("long").alias("rn"), "turn", F.lead("turn").over(w).alias("next_turn"), "text")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as responses: session, turn, text."""
    c = table(spark, sf_dir, "conversations")
    prev = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    k = F.col("conv_id") % 4
    marked = F.concat(F.lit("</response> "), F.col("text"))
    n = (F.col("conv_id") * 3 + F.col("turn")) % 17
    spelled = F.element_at(F.array(*map(F.lit, SPELLED)), (n + 1).cast("int"))
    said = F.when((k < 3) & (n < len(SPELLED)), spelled).when((k == 0) & (n == 9), F.concat(F.lit("\n\t\u3000"), marked, F.lit("</response>\r\n"))).when(k == 0, marked)
    said = said.when(k == 1, F.lit("</silence>")).when((k == 3) & (F.col("turn") % 3 == 0), prev).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("session"), "turn", "role", said.alias("text")).filter("role = 'assistant'").drop("role")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, start_s, end_s, reason; they overlap."""
    li = table(spark, sf_dir, "lineitem")
    start = F.datediff(F.col("l_shipdate").cast("date"), F.to_date(F.lit("1992-01-01"))).cast("double")
    rows = li.select(F.col("l_orderkey").alias("session"), start.alias("start_s"), (start + F.col("l_quantity")).alias("end_s"), F.col("l_returnflag").alias("reason"))
    return dealt(rows, shares(li), "session")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stage, task, attempt, status, status_code."""
    li = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    return dealt(rows, shares(li), "l_orderkey").select((F.col("l_orderkey") % 5).alias("stage"), F.col("l_orderkey").alias("task"), n.cast("long").alias("attempt"), F.when(F.col("l_returnflag") == "R", "exception").otherwise("response").alias("status"), F.when(F.col("l_linestatus") == "F", 200).otherwise(500).alias("status_code"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they are: path, bytes, sha256."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a manifest has them: some changed, some left out, some that are not there."""
    a = artifacts(spark, sf_dir)
    own = a.filter("doc_id % 13 != 0").select("path", (F.col("bytes") + F.when(F.col("doc_id") % 17 == 0, 1).otherwise(0)).alias("bytes"), "sha256")
    extra = a.filter("doc_id % 19 = 0").select(F.concat(F.lit("doc/"), (-F.col("doc_id") - 1).cast("string")).alias("path"), F.lit(0).cast("long").alias("bytes"), "sha256")
    return own.unionByName(extra)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human and judge grades of the same items: item, dim, human, judge."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    human = F.when(F.col("quality") == 0, "B").when(F.col("toxic") == 1, "S").otherwise("G")
    judge = F.element_at(F.array(F.lit("G"), F.lit("S"), F.lit("B")), (F.col("n_chars") % 3 + 1).cast("int"))
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("item"), F.col("lang").alias("dim"), human.alias("human"), judge.alias("judge"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rubric rows: task_id, then applicable_k, threshold_k and weight_k for five dimensions."""
    p = table(spark, sf_dir, "part")
    cols = []
    for k in range(1, 6):
        cols += [F.when((F.col("p_partkey") + k) % 3 != 0, "是").otherwise("否").alias(f"applicable_{k}"), F.when((F.col("p_partkey") + k) % 7 != 0, F.col("p_name")).alias(f"threshold_{k}"), F.when((F.col("p_partkey") + 2 * k) % 5 != 0, F.col("p_size") / 50.0).alias(f"weight_{k}")]
    return p.select(F.col("p_partkey").alias("task_id"), *cols)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, position, size_class, start_s, end_s."""
    e = table(spark, sf_dir, "embeddings")
    at = (F.col("vec_id") % 50).cast("double")
    return e.select(F.floor(F.col("vec_id") / 50).alias("session"), F.col("vec_id").alias("position"), F.col("label").alias("size_class"), at.alias("start_s"), (at + 1.0).alias("end_s"))


#: The same projections for the oracle, as common table expressions in order of need.
SQL = {
    "grades": """grades AS (SELECT 's' || n AS system, it.l_orderkey AS task_id, 'D' || k AS dim,
 CASE WHEN (p + u * k) % 13 <= 5 THEN 'G' WHEN (p + u * k) % 13 <= 9 THEN 'S' WHEN (p + u * k) % 13 <= 11 THEN 'B' END AS grade,
 (k = 4 OR (it.l_orderkey + k) % 4 <> 0) AS applicable, 'C' || (o_custkey % 9) AS category
 FROM (SELECT (l_linenumber - 1) % 5 + 1 AS n, l_orderkey, min(l_partkey) AS p, min(l_suppkey) AS u FROM lineitem GROUP BY 1, 2) it
 JOIN orders ON o_orderkey = it.l_orderkey CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k))""",
    "scored": """scored AS (SELECT *, CASE WHEN NOT applicable OR NOT bool_and(grade IS NOT NULL OR NOT applicable) OVER (PARTITION BY system, task_id) THEN NULL
 WHEN grade = 'G' THEN 1.0 WHEN grade = 'S' THEN 0.5 WHEN grade = 'B' THEN 0.0 END::DOUBLE AS score FROM grades)""",
    "items": """wide AS (SELECT system, task_id, category, max(score) FILTER (dim = 'D1') AS d1, max(score) FILTER (dim = 'D2') AS d2, max(score) FILTER (dim = 'D3') AS d3,
 max(score) FILTER (dim = 'D4') AS d4, max(score) FILTER (dim = 'D5') AS d5 FROM scored GROUP BY 1, 2, 3),
items AS (SELECT system, task_id, category, d1, d2, d3, d4, d5, list_avg([least(d1, d2), d3, d4, d5]) AS score, list_avg([least(d1, d2), d4, d5]) AS score_without_d3, list_avg([d1, d2, d3, d4, d5]) AS raw_mean FROM wide)""",
    "events_": """session_events AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
 round_even((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3600000000.0::DOUBLE, 3) AS t_s,
 CASE event_type WHEN 'click' THEN 'query' WHEN 'view' THEN 'output' WHEN 'error' THEN 'stalled' WHEN 'signup' THEN 'disconnect' ELSE 'resume' END AS kind,
 value AS latency_ms, json_extract_string(props, '$.k') AS text, event_id FROM events)""",
    "rounds": """rounds AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn, text
 FROM conversations WHERE role = 'user')""",
    "responses": """responses AS (SELECT session, turn, text FROM (SELECT conv_id AS session, turn, role, CASE WHEN conv_id % 4 < 3 AND (conv_id * 3 + turn) % 17 < 9 THEN """ + "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '") + "'" for x in SPELLED) + "]" + """[(conv_id * 3 + turn) % 17 + 1]
 WHEN conv_id % 4 = 0 AND (conv_id * 3 + turn) % 17 = 9 THEN chr(10) || chr(9) || chr(12288) || '</response> ' || text || '</response>' || chr(13) || chr(10) WHEN conv_id % 4 = 0 THEN '</response> ' || text WHEN conv_id % 4 = 1 THEN '</silence>'
 WHEN conv_id % 4 = 3 AND turn % 3 = 0 THEN coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') ELSE text END AS text FROM conversations) WHERE role = 'assistant')""",
    "intervals": """intervals AS (SELECT l_orderkey AS session, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS start_s,
 date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity AS end_s, l_returnflag AS reason FROM lineitem)""",
    "attempts": """attempts AS (SELECT l_orderkey % 5 AS stage, l_orderkey AS task, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS attempt,
 CASE WHEN l_returnflag = 'R' THEN 'exception' ELSE 'response' END AS status, CASE WHEN l_linestatus = 'F' THEN 200 ELSE 500 END AS status_code FROM lineitem)""",
    "artifacts": """artifacts AS (SELECT doc_id, 'doc/' || doc_id AS path, strlen(text) AS bytes, sha256(text) AS sha256 FROM documents)""",
    "recorded": """recorded AS (SELECT path, bytes + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS bytes, sha256 FROM artifacts WHERE doc_id % 13 <> 0
 UNION ALL SELECT 'doc/' || (-doc_id - 1), 0, sha256 FROM artifacts WHERE doc_id % 19 = 0)""",
    "verdicts": """verdicts AS (SELECT doc_id AS item, lang AS dim, CASE WHEN quality = 0 THEN 'B' WHEN toxic = 1 THEN 'S' ELSE 'G' END AS human,
 CASE n_chars % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'S' ELSE 'B' END AS judge FROM documents JOIN labels USING (doc_id))""",
    "rubric": """rubric AS (SELECT p_partkey AS task_id, 'D' || k AS dim, (p_partkey + k) % 3 <> 0 AS applicable, CASE WHEN (p_partkey + 2 * k) % 5 <> 0 THEN p_size / 50.0::DOUBLE END AS weight,
 CASE WHEN (p_partkey + k) % 7 <> 0 THEN p_name ELSE '-' END AS threshold FROM part CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k))""",
    "frames": """frames AS (SELECT vec_id // 50 AS session, vec_id AS position, label AS size_class, (vec_id % 50)::DOUBLE AS start_s, (vec_id % 50)::DOUBLE + 1.0 AS end_s FROM embeddings)""",
}
_NEEDS = {"scored": ("grades",), "items": ("scored",), "recorded": ("artifacts",)}


def oracle(needs: str, body: str) -> str:
    """`body` after the expressions that it needs; further expressions may follow in `body` after a leading comma."""
    names: list[str] = []

    def add(name):
        for x in _NEEDS.get(name, ()):
            add(x)
        if name not in names:
            names.append(name)

    for name in needs.split():
        add(name)
    return "WITH " + ",\n".join(SQL[n] for n in names) + ("" if body.lstrip().startswith(",") else "\n") + body
