"""Audits: set comparisons, scans for forbidden content, lineage, provenance, manifests and release checks.

Findings are long rows. Scans run every marker in one pass over the texts; sets are compared by full outer joins.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cluster import cut


def verify_artifacts(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """path, reason: missing files, and files whose size or hash has changed. Both: path, bytes, sha256."""
    a = actual.select("path", F.col("bytes").alias("a_bytes"), F.col("sha256").alias("a_sha256"))
    reason = F.when(F.col("a_bytes").isNull(), "missing").when(F.col("bytes") != F.col("a_bytes"), "bytes").when(F.col("sha256") != F.col("a_sha256"), "sha256")
    return recorded.join(a, "path", "left").select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def scope_diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only."""
    e, a = expected.select(*keys).distinct().withColumn("e", F.lit(True)), actual.select(*keys).distinct().withColumn("a", F.lit(True))
    both = e.join(a.hint("merge"), keys, "full_outer").filter("e IS NULL OR a IS NULL")
    return both.select(*keys, F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("reason"))


def marker_scan(texts: DataFrame, markers: list[str]) -> DataFrame:
    """id and the sorted markers that its text contains; one pass for all markers of a fixed list. texts: id, text."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").contains(m), m) for m in markers]))
    return texts.select("id", F.array_sort(hits).alias("markers")).filter(F.size("markers") > 0)


#: Characters of the markers of one automaton, about a hundred bytes of memory each.
MARKER_CHARS = 2_000_000
_automata: dict[str, tuple] = {}


def _automaton(token: str, markers: list[str]):
    """The automaton of longer markers and the set of those of one character, built once in a worker; it keeps the last one only."""
    if token not in _automata:
        import ahocorasick

        _automata.clear()
        found = ahocorasick.Automaton()
        for k, m in enumerate(markers):
            if len(m) > 1:
                found.add_word(m, k)
        found.make_automaton()
        _automata[token] = found if len(found) else None, {m: k for k, m in enumerate(markers) if len(m) == 1}
    return _automata[token]


def marker_join(texts: DataFrame, markers: DataFrame) -> DataFrame:
    """(id, marker_id) of every marker of a table that a text contains, whatever stands around it. texts: id, text; markers: marker_id, text. Null texts and markers have none; an
    empty marker is in every text.

    Distinct markers become automata of bounded size, broadcast one by one; each passes over the texts where they are, all its markers at once. Only the numbers of found markers are
    joined with their ids, so markers that many texts hold are no hot key of the scan."""
    spark = texts.sparkSession
    named = cut(markers.filter("text IS NOT NULL").select("marker_id", F.col("text").alias("marker")))
    distinct = named.filter("marker != ''").select("marker").distinct()
    parts = -(-(distinct.agg(F.sum(F.length("marker"))).first()[0] or 0) // MARKER_CHARS)
    dealt = cut(distinct.withColumn("part", F.pmod(F.xxhash64("marker"), F.lit(max(parts, 1)))))
    scanned = texts.filter("text IS NOT NULL").select("id", "text")
    schema = T.StructType([scanned.schema["id"], T.StructField("marker", T.StringType())])
    out = scanned.select("id").join(named.filter("marker = ''").select("marker_id").hint("broadcast"))  # all of these, with every text
    for k in range(parts):
        listed = dealt.filter(F.col("part") == k).select("marker").toArrow().column("marker").to_pylist()
        held, token = spark.sparkContext.broadcast(listed), uuid.uuid4().hex

        def scan(batches, held=held, token=token):
            found, single = _automaton(token, held.value)
            for batch in batches:
                rows, hits = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    mine = {n for _, n in found.iter(text)} if found else set()
                    if single:
                        mine.update(single[c] for c in single.keys() & set(text))
                    rows += [i] * len(mine)
                    hits += mine
                markers = pa.array([held.value[n] for n in hits], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), markers], names=["id", "marker"])

        hits = scanned.mapInArrow(scan, schema)
        out = out.unionByName(hits.join(named.hint("shuffle_hash"), "marker").select("id", "marker_id"))
    return out


def literal_ids(texts: DataFrame, ids: DataFrame, pattern: str) -> DataFrame:
    """Known ids, word-bounded, in texts. texts: id, text; ids: known."""
    found = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("known"))
    return found.join(ids.hint("merge"), "known", "left_semi")


def json_keys(docs: DataFrame) -> DataFrame:
    """(id, path, key, value) of every key at any level of JSON documents. Each level explodes the objects and arrays of the one before, until none are left. docs: id, json."""
    level = docs.select("id", F.lit("$").alias("path"), F.try_parse_json("json").alias("v"))
    out = None
    while True:
        nested = level.lateralJoin(docs.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).filter("pos IS NOT NULL")
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        nested = cut(nested.select("id", F.concat("path", step).alias("path"), "key", F.col("value").alias("v"), F.schema_of_variant("value").rlike("^(?:OBJECT|ARRAY)").alias("deeper")))
        rows = nested.filter("key IS NOT NULL").select("id", "path", "key", F.col("v").cast("string").alias("value"))
        out = rows if out is None else out.unionByName(rows)
        level = nested.filter("deeper").select("id", "path", "v")
        if level.isEmpty():
            return out


#: Parts of the names of human labels, and the one name that only says whether there are any.
SUBJECTS, MEASURES = ("expert", "human", "gold", "groundtruth", "reference"), ("label", "score", "rating", "grade", "annotation")
SUBJECTS_ZH, MEASURES_ZH = ("人工", "专家", "金标准"), ("标签", "打分", "评分", "得分")
NO_LABEL = "containshumanlabels"


def forbidden_keys(docs: DataFrame, forbidden: list[str], mode: str = "exact") -> DataFrame:
    """Forbidden keys with their paths, at any depth. Modes: `exact`; `loose` compares lower-case letters and digits, with and without all s at the end; `labels` finds keys that name a
    human judge and a measure, in English or Chinese, besides the forbidden ones."""
    keys = json_keys(docs)
    if mode == "exact":
        hit = F.col("key").isin(*forbidden)
    elif mode == "loose":
        names = [re.sub(r"[^a-z0-9]", "", x.strip().lower()) for x in forbidden]
        key = F.regexp_replace(F.lower("key"), "[^a-z0-9]", "")
        hit = key.isin(*names) | F.regexp_replace(key, "s+$", "").isin(*names)
    else:
        key = F.regexp_replace(F.lower("key"), r"[^0-9a-z\x{4e00}-\x{9fff}]+", "")
        english = key.rlike("|".join(SUBJECTS)) & key.rlike("|".join(MEASURES))
        chinese = key.rlike("|".join(SUBJECTS_ZH)) & key.rlike("|".join(MEASURES_ZH))
        hit = (key.isin(*forbidden) | english | chinese) & (key != NO_LABEL)
    return keys.filter(hit).select("id", "path", "key")


def input_shape(docs: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Documents whose top-level keys are not exactly those of their stage. docs: id, stage, json."""
    want = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    have = F.array_sort(F.json_object_keys("json"))
    return docs.select("id", "stage", F.when(have.isNull(), "not_an_object").when(F.element_at(want, F.col("stage")).isNull(), "unknown_stage").when(have != F.element_at(want, F.col("stage")), "keys").alias("reason")).filter("reason IS NOT NULL")


def lineage(inputs: DataFrame, upstream: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields in which a stage's input differs from the upstream row it names, or the upstream is gone. Both have keys and fields."""
    up = upstream.select(*keys, F.lit(True).alias("__there"), *[F.col(f).alias(f"up_{f}") for f in fields])
    rules = [F.when(F.col("__there").isNull(), "no_upstream"), *[F.when(F.col("__there") & ~F.col(f).eqNullSafe(F.col(f"up_{f}")), f) for f in fields]]
    return inputs.join(up, keys, "left").select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("reason"))


def candidate_lineage(inputs: DataFrame, predictions: DataFrame, stages: list[str]) -> DataFrame:
    """Candidates of an input that do not stand at their stage's place or differ from its prediction. inputs: id, digests ARRAY<STRING>; predictions: id, stage, digest."""
    c = inputs.select("id", F.posexplode("digests").alias("pos", "digest")).withColumn("stage", F.get(F.array(*map(F.lit, stages)), F.col("pos")))
    p = predictions.select("id", "stage", F.col("digest").alias("up"))
    reason = F.when(F.col("stage").isNull(), "too_many").when(F.col("up").isNull(), "no_prediction").when(F.col("up") != F.col("digest"), "digest")
    return c.join(p.hint("merge"), ["id", "stage"], "left").select("id", "pos", reason.alias("reason")).filter("reason IS NOT NULL")


def one_version(rows: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """Groups whose rows do not share one version of all fields."""
    return rows.groupBy(*group).agg(F.count_distinct(F.struct(*fields)).alias("versions")).filter("versions > 1")


def identity_check(predictions: DataFrame, stages: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of a prediction that differ from its stage's identity, one row each."""
    s = stages.select("stage", *[F.col(f).alias(f"want_{f}") for f in fields])
    rules = [F.when(~F.col(f).eqNullSafe(F.col(f"want_{f}")), f) for f in fields]
    return predictions.join(s.hint("merge"), "stage", "left").select("id", "stage", F.explode(F.array_compact(F.array(*rules))).alias("field"))


def map_diff(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared against actual path-to-hash tables. Both: path, sha256."""
    both = declared.withColumnRenamed("sha256", "d").join(actual.withColumnRenamed("sha256", "a"), "path", "full_outer")
    reason = F.when(F.col("a").isNull(), "gone").when(F.col("d").isNull(), "undeclared").when(F.col("a") != F.col("d"), "changed")
    return both.select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def frozen_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Immutable fields that changed."""
    b = after.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    rules = [F.when(~F.col(f).eqNullSafe(F.col(f"new_{f}")), f) for f in fields]
    return before.join(b, key).select(key, F.explode(F.array_compact(F.array(*rules))).alias("field"))


def fileset_hash(files: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """A hash of a group's files that does not depend on their order. Files are listed in parts, by the first `digits` hex digits of the hash of their path, and the group's hash is
    that of its parts in order; no task lists more than one part. files: keys, path, sha256."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: F.concat_ws("=", f["path"], f["sha256"]))
    parts = files.groupBy(*keys, F.substring(F.sha2("path", 256), 1, digits).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(entries, "\n"), 256).alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n")
    return parts.groupBy(*keys).agg(F.sum("n").alias("files"), F.sha2(whole, 256).alias("hash"))


#: Levels of a tree of hashes, of 16 branches each; the last one's branches are folders of the stored files.
TREE_LEVELS = 2


def fileset_tree(files: DataFrame, keys: list[str], levels: int = TREE_LEVELS) -> DataFrame:
    """keys, branch, files, hash: a hash for every branch of a group's tree of files, of which the empty branch is the whole. A file hangs at the first hex digits of the hash of its path.

    The lowest branches hash their files in order, every other one the hashes of its up to 16 branches, so no task lists more than a branch. files: keys, path, sha256."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: F.concat_ws("=", f["path"], f["sha256"]))
    level = files.groupBy(*keys, F.substring(F.sha2("path", 256), 1, levels).alias("branch")).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(entries, "\n"), 256).alias("hash"))
    out = level = cut(level)
    for depth in range(levels - 1, -1, -1):
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("branch", "hash"))), lambda x: F.concat_ws("=", x["branch"], x["hash"])), "\n")
        level = level.groupBy(*keys, F.substring("branch", 1, depth).alias("upper")).agg(F.sum("files").alias("files"), F.sha2(parts, 256).alias("hash")).withColumnRenamed("upper", "branch")
        level = level.select(*keys, "branch", "files", "hash")
        out = out.unionByName(level)
    return out


def write_fileset(files: DataFrame, keys: list[str], path: str, levels: int = TREE_LEVELS) -> None:
    """The files in a folder for each lowest branch, and their tree beside them."""
    rows = files.select(*keys, "path", "sha256", F.substring(F.sha2("path", 256), 1, levels).alias("branch"))
    rows.repartition("branch").write.mode("overwrite").partitionBy("branch").parquet(f"{path}/files")
    fileset_tree(files, keys, levels).write.mode("overwrite").parquet(f"{path}/tree")


def changed_files(spark: SparkSession, before: str, after: str, keys: list[str], levels: int = TREE_LEVELS) -> DataFrame:
    """keys, path, reason (gone, new, changed) between two filesets that `write_fileset` has written.

    The trees are compared from the top, and only branches below a difference are looked at; of the files only the folders of differing lowest branches are read, a list of at most
    16 ** levels names."""
    trees = [spark.read.parquet(f"{p}/tree") for p in (before, after)]
    differ = None
    for depth in range(levels + 1):
        old, new = (t.filter(F.length("branch") == depth).select(F.struct(*keys, "branch").alias("at"), F.col("hash").alias(n)) for t, n in zip(trees, ("old", "new")))
        if differ is not None:
            upper = differ.select("up").hint("merge")
            above = F.struct(*[F.col("at")[k].alias(k) for k in keys], F.substring(F.col("at.branch"), 1, depth - 1).alias("branch"))
            old, new = (t.join(upper, above.eqNullSafe(F.col("up")), "left_semi") for t in (old, new))
        both = old.join(new.withColumnRenamed("at", "at2").hint("merge"), F.col("at").eqNullSafe(F.col("at2")), "full_outer")
        differ = cut(both.filter(~F.col("old").eqNullSafe(F.col("new"))).select(F.coalesce("at", "at2").alias("up")))
    folders = [r[0] for r in differ.select("up.branch").distinct().collect()]
    read = lambda p: spark.read.schema(spark.read.parquet(f"{p}/files").schema).parquet(f"{p}/files").filter(F.col("branch").cast("string").isin(*folders))
    lists = [read(p).select(F.struct(*keys, "path").alias(f"{n}_at"), F.col("sha256").alias(n)) for p, n in ((before, "old"), (after, "new"))]
    both = lists[0].join(lists[1].hint("merge"), F.col("old_at").eqNullSafe(F.col("new_at")), "full_outer")
    reason = F.when(F.col("new_at").isNull(), "gone").when(F.col("old_at").isNull(), "new").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    at = F.coalesce("old_at", "new_at")
    return both.select(*[at[k].alias(k) for k in keys], at["path"].alias("path"), reason.alias("reason")).filter("reason IS NOT NULL")


def _paths(edges: DataFrame, links: DataFrame) -> DataFrame:
    """node, tail, hops, succ of links (nodes with one edge out and at most one in): the last link of their path, how far it is, and where that leads. Pointers double in each round; links on a
    cycle of links have no tail and fall out."""
    steps = links.join(edges.hint("merge"), F.col("node") == F.col("a")).select("node", F.col("b").alias("succ"))
    inner = steps.join(links.select(F.col("node").alias("succ"), F.lit(True).alias("on")).hint("merge"), "succ", "left")
    rows = cut(inner.select("node", F.when(F.col("on"), F.col("succ")).otherwise(F.col("node")).alias("tail"), F.when(F.col("on"), 1).otherwise(0).cast("long").alias("hops"), F.col("on").isNull().alias("done")))
    before, left = None, rows.filter("NOT done").count()
    while left and left != before:  # on paths some links arrive in every round, on cycles none
        ahead = rows.select(F.col("node").alias("tail"), F.col("tail").alias("far"), F.col("hops").alias("more"), F.col("done").alias("over"))
        jumped = rows.filter("NOT done").join(ahead.hint("merge"), "tail").select("node", F.col("far").alias("tail"), (F.col("hops") + F.col("more")).alias("hops"), F.col("over").alias("done"))
        rows = cut(rows.filter("done").unionByName(jumped))
        before, left = left, rows.filter("NOT done").count()
    return rows.filter("done").join(steps.select(F.col("node").alias("tail"), "succ").hint("merge"), "tail").select("node", "tail", "hops", "succ")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that roots reach over edges, with the least depth. edges: a, b; roots: node. A null is no node.

    Paths without branches are one step: their links know the end after as many rounds as the logarithm of the longest path. Then the shortened graph is searched, one round for each branch
    on the way; a node goes on only when its depth has become less. At last depths are filled in along the paths that have been entered."""
    edges = cut(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    degree = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    links = degree.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out = 1 AND into <= 1").select("node")
    paths = cut(_paths(edges, cut(links)))
    jumps = paths.select("node", F.col("succ").alias("to"), (F.col("hops") + 1).alias("far"))
    others = edges.join(paths.select(F.col("node").alias("a")).hint("merge"), "a", "left_anti").select(F.col("a").alias("node"), F.col("b").alias("to"), F.lit(1).cast("long").alias("far"))
    steps = cut(jumps.unionByName(others))
    seen = cut(roots.select("node").filter("node IS NOT NULL").distinct().withColumn("depth", F.lit(0).cast("long")))
    front = seen
    while not front.isEmpty():
        reached = front.join(steps.hint("merge"), "node").groupBy(F.col("to").alias("node")).agg(F.min(F.col("depth") + F.col("far")).alias("new"))
        seen = cut(seen.join(reached.hint("merge"), "node", "full_outer").select("node", F.least("depth", "new").alias("depth"), F.coalesce(F.col("new") < F.col("depth"), F.col("depth").isNull()).alias("better")))
        front, seen = seen.filter("better").select("node", "depth"), seen.select("node", "depth")
    # A link behind an entry of its path is as deep as the best of them and the way from there; running minima along the path.
    along = paths.join(seen.hint("merge"), "node", "left")
    best = F.min(F.col("depth") + F.col("hops")).over(Window.partitionBy("tail").orderBy(F.desc("hops")))
    filled = along.select("node", (best - F.col("hops")).alias("depth")).filter("depth IS NOT NULL")
    rest = seen.join(paths.select("node").hint("merge"), "node", "left_anti")
    return rest.unionByName(filled).select("node", F.col("depth").cast("int").alias("depth"))


def preflight_check(frames: DataFrame, actual: DataFrame) -> DataFrame:
    """Findings per frame: index not dense, time not finite, path repeated, file gone or changed. frames: task_id, index, time_s, path, sha256; actual: path, sha256."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("index", "path")) - 1
    times = F.count(F.lit(1)).over(Window.partitionBy("task_id", "path"))
    rows = frames.withColumn("place", place).withColumn("times", times).join(actual.select("path", F.col("sha256").alias("now")), "path", "left")
    rules = [F.when(F.col("index") != F.col("place"), "index"), F.when(F.col("time_s").isNull() | F.isnan("time_s"), "time"), F.when(F.col("times") > 1, "path"), F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("sha256"), "changed")]
    return rows.select("task_id", "index", F.explode(F.array_compact(F.array(*rules))).alias("reason"))


def frames_equal(saved: DataFrame, rebuilt: DataFrame, fields: list[str]) -> DataFrame:
    """Per task whether saved and rebuilt frames agree in all fields at every index. Both: task_id, index, fields."""
    b = rebuilt.select("task_id", "index", F.lit(True).alias("__b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    both = saved.withColumn("__a", F.lit(True)).join(b, ["task_id", "index"], "full_outer")
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"b_{f}"))
    return both.groupBy("task_id").agg(F.count(F.lit(1)).alias("frames"), F.bool_and(same).alias("equal"))


def derived_pairs(originals: DataFrame, derived: DataFrame, suffix: str) -> DataFrame:
    """Files without a derived file, and derived files without an original; the derived name is the original's with a suffix before the extension. Both: path."""
    a = originals.select(F.col("path").alias("original"), F.regexp_replace("path", r"^(.*?)(\.[^./]*)?$", f"$1{suffix}$2").alias("key"))
    both = a.join(derived.select(F.col("path").alias("key"), F.lit(True).alias("there")), "key", "full_outer")
    return both.select(F.coalesce("original", "key").alias("path"), F.when(F.col("there").isNull(), "no_derived").when(F.col("original").isNull(), "no_original").alias("reason")).filter("reason IS NOT NULL")


def stage_inventory(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Per stage: files that should be there and are, missing and extra ones, and whether it passes. Both: stage, task_id."""
    both = expected.withColumn("e", F.lit(1)).join(files.distinct().withColumn("f", F.lit(1)).hint("merge"), ["stage", "task_id"], "full_outer")
    out = both.groupBy("stage").agg(F.count(F.col("e") + F.col("f")).alias("present"), F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"))
    return out.withColumn("passes", (F.col("missing") == 0) & (F.col("extra") == 0))


def inputs_consistent(docs: DataFrame, stages: int) -> DataFrame:
    """Tasks whose inputs are not the same over all stages. docs: task_id, stage, sha256."""
    per = docs.groupBy("task_id").agg(F.count_distinct("stage").alias("stages"), F.count_distinct("sha256").alias("hashes"))
    return per.filter((F.col("stages") != stages) | (F.col("hashes") != 1))


def source_roles(refs: DataFrame) -> DataFrame:
    """One row per path: its roles, and whether every reference expects the same hash. refs: path, role, sha256."""
    return refs.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), (F.count_distinct("sha256") == 1).alias("one_hash"))


def execution_check(attestations: DataFrame, stages: DataFrame, ledgers: DataFrame, required: list[str], fields: list[str]) -> DataFrame:
    """What is wrong with the attestation of each execution, one row a rule.

    attestations: task_id, stage, version, passed, seal_ok, own_task, identity, artifacts ARRAY<STRUCT<path, intact>>, prediction STRUCT<ok, task_id, judged_task and `fields`>,
    spec_task, spec (of the input that was kept), ledger_path, ledger_identity, attempt_count, attempts_sha256;
    stages: stage, identity, max_attempts and `fields` (what a prediction must say); ledgers: stage, task_id, path, identity, attempts, sha256, status, status_code (of the last attempt), spec (expected, or null)."""
    a = attestations.select("task_id", F.col("stage").alias("stage"), F.struct(*[c for c in attestations.columns if c != "task_id"]).alias("a"))
    w = stages.select("stage", F.struct(*[c for c in stages.columns if c != "stage"]).alias("w"))
    g = ledgers.select("stage", "task_id", F.struct(*[c for c in ledgers.columns if c not in ("stage", "task_id")]).alias("g"))
    rows = a.join(w.hint("merge"), "stage", "left").join(g.hint("merge"), ["stage", "task_id"], "left")
    c, n = F.col, F.coalesce("g.attempts", F.lit(0))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    paths = F.transform("a.artifacts", lambda x: x["path"])
    broken = {
        "seal": no(c("a.seal_ok")), "not_passed": no((c("a.version") == 1) & c("a.passed")), "stage": c("w").isNull(), "task": no(c("a.own_task") == c("task_id")),
        "identity": no(c("a.identity") == c("w.identity")), "duplicate_artifacts": F.size(F.array_distinct(paths)) != F.size(paths),
        "artifacts": no(F.size(F.array_except(F.array(*map(F.lit, required)), paths)) == 0), "changed_artifact": no(F.forall("a.artifacts", lambda x: F.coalesce(x["intact"], F.lit(False)))),
        "prediction": no(c("a.prediction.ok")), "prediction_task": no((c("a.prediction.task_id") == c("task_id")) & (c("a.prediction.judged_task") == c("task_id"))),
        **{f"prediction_{f}": ~c(f"a.prediction.{f}").eqNullSafe(c(f"w.{f}")) for f in fields},
        "input": c("a.spec").isNull(), "input_task": no(c("a.spec_task") == c("task_id")), "input_spec": c("g.spec").isNotNull() & no(c("a.spec") == c("g.spec")),
        "no_ledger": c("g").isNull(), "ledger_path": no(c("a.ledger_path") == c("g.path")), "ledger_identity": no(c("a.ledger_identity") == c("g.identity")),
        "attempt_count": no(c("a.attempt_count") == n), "attempts": no(c("a.attempts_sha256") == c("g.sha256")), "attempt_range": no(n.between(1, c("w.max_attempts"))),
        "final_attempt": no((c("g.status") == "response") & (c("g.status_code") == 200)),
    }
    return rows.select("task_id", "stage", F.explode(F.array_compact(F.array(*[F.when(cond, name) for name, cond in broken.items()]))).alias("reason"))


def reusable(previous: DataFrame, actual: DataFrame) -> DataFrame:
    """Whether an earlier result of a task holds: it was ok and all its files are unchanged. previous: task_id, ok, path, sha256; actual: path, sha256."""
    a = actual.select("path", F.col("sha256").alias("now"))
    return previous.join(a, "path", "left").groupBy("task_id").agg(F.bool_and(F.col("ok") & F.coalesce(F.col("now") == F.col("sha256"), F.lit(False))).alias("reusable"))


def audit_report(findings: DataFrame) -> DataFrame:
    """Counts by stage, by reason and in all. findings: stage, reason."""
    return findings.groupingSets([["stage"], ["reason"], []], "stage", "reason").agg(F.count(F.lit(1)).alias("findings"))


# Manifests


def recording_rows(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """Accepted results with their summaries; an empty size is none. results: system, task_id, bytes; summaries: system, task_id, size."""
    return results.join(summaries.hint("merge"), ["system", "task_id"]).withColumn("bytes", F.coalesce(F.nullif("bytes", F.lit(0)), F.nullif("size", F.lit(0)))).drop("size")


def pair_check(rows: DataFrame, systems: DataFrame) -> DataFrame:
    """Repeated (system, task), and systems on one side only. systems: system."""
    twice = rows.groupBy("system", "task_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("system", "task_id", F.lit("repeated").alias("reason"))
    diff = scope_diff(systems, rows, ["system"]).select("system", F.lit(None).cast("long").alias("task_id"), "reason")
    return twice.unionByName(diff)


def index_dense(rows: DataFrame, n: int) -> DataFrame:
    """Per system whether task_index runs exactly from 1 to n with distinct ids."""
    ok = (F.count(F.lit(1)) == n) & (F.count_distinct("task_id") == n) & (F.count_distinct("task_index") == n) & (F.min("task_index") == 1) & (F.max("task_index") == n)
    return rows.groupBy("system").agg(F.count(F.lit(1)).alias("rows"), ok.alias("dense"))


#: Systems of a campaign that are broadcast; beyond, every task meets them by a shuffle.
BROADCAST_SYSTEMS = 10_000


def task_diff(records: DataFrame, specs: DataFrame) -> DataFrame:
    """Tasks that a system lacks or has too many, against the specs: every system should have every task."""
    systems = cut(records.select("system").distinct())
    systems = systems.hint("broadcast" if systems.count() <= BROADCAST_SYSTEMS else "shuffle_replicate_nl")
    return scope_diff(specs.select("task_id").crossJoin(systems), records, ["system", "task_id"])


def prompt_match(rounds: DataFrame, specs: DataFrame) -> DataFrame:
    """Whether a task's rounds, put together, are its prompt once labels and white space are gone. rounds: task_id, place, query; specs: task_id, prompt."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?i)R\d+\s*[：:]", ""), r"(?U)\s+", "")
    said = rounds.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "query"))), lambda r: r["query"]), "").alias("said"))
    return specs.join(said, "task_id", "left").select("task_id", F.coalesce(plain(F.col("said")) == plain(F.col("prompt")), F.lit(False)).alias("matches"))


def build_manifest(records: DataFrame, specs: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows: records with their spec and their verified file. records: system, task_id, path, bytes; specs: task_id, spec; files: path, bytes, sha256."""
    f = files.select("path", F.col("bytes").alias("f_bytes"), "sha256")
    rows = records.join(specs.hint("merge"), "task_id").join(f.hint("merge"), "path").filter(F.col("bytes") == F.col("f_bytes"))
    return rows.select("system", "task_id", F.struct("path", "bytes", "sha256").alias("evidence"), "spec")


# Release


def media_check(index: DataFrame, files: DataFrame) -> DataFrame:
    """Names that are not plain base names, repeated ids, and differences between index and directory. index: id, video; files: video."""
    bad = F.when(F.col("video").rlike(r"[/\\]|^\.{1,2}$|^$"), "not_a_name").when(F.count(F.lit(1)).over(Window.partitionBy("id")) > 1, "repeated_id")
    own = index.withColumn("reason", bad).filter("reason IS NOT NULL").select(F.col("id").cast("string").alias("item"), "reason")
    return own.unionByName(scope_diff(index, files, ["video"]).select(F.col("video").alias("item"), "reason"))


def order_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two tables have the same ids in the same places. Both: place, id."""
    both = a.select("place", F.col("id").alias("x")).join(b.select("place", F.col("id").alias("y")), "place", "full_outer")
    return both.groupBy().agg(F.count(F.lit(1)).alias("places"), F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("equal"))


#: Stream addresses, private hosts, key-like tokens; keys of metadata that may tell who recorded what, where and when.
SENSITIVE = r"(?i)(?:rtsp://|https?://(?:10\.|127\.0\.0\.1|localhost)|(?:sk|ark|pk)-[A-Za-z0-9_-]{12,})"
SENSITIVE_KEYS = ("author", "comment", "copyright", "creationtime", "description", "did", "gps", "location", "lvmetainfo", "synopsis", "uid", "videoid")


def sensitive_cells(df: DataFrame, key: str, columns: list[str], private_paths: tuple[str, ...] = ()) -> DataFrame:
    """Cells with sensitive text, or with one of the paths that only the owner's machines have."""
    found = lambda c: F.col(c).cast("string").rlike("|".join([SENSITIVE, *map(re.escape, private_paths)]))
    return df.select(key, F.explode(F.array_compact(F.array(*[F.when(found(c), c) for c in columns]))).alias("column"))


def sensitive_metadata(docs: DataFrame) -> DataFrame:
    return forbidden_keys(docs, list(SENSITIVE_KEYS), "loose")


def signature_equal(before: DataFrame, after: DataFrame, tolerance_s: float = 0.5) -> DataFrame:
    """Whether streams are the same but for order and the duration but for a tolerance. Both: path, streams ARRAY<STRING>, duration_s."""
    a = after.select("path", F.array_sort("streams").alias("a_streams"), F.col("duration_s").alias("a_s"))
    same = (F.array_sort("streams") == F.col("a_streams")) & (F.abs(F.col("duration_s") - F.col("a_s")) <= tolerance_s)
    return before.join(a, "path", "left").select("path", F.coalesce(same, F.lit(False)).alias("equal"))


def provenance_cover(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Files without exactly one complete provenance row, and rows without a file. rows: path, source, license; files: path."""
    per = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.coalesce(F.trim("source"), F.lit("")) != "") & (F.coalesce(F.trim("license"), F.lit("")) != "")).alias("full"))
    both = files.select("path", F.lit(True).alias("there")).join(per, "path", "full_outer")
    reason = F.when(F.col("n").isNull(), "none").when(F.col("there").isNull(), "no_file").when(F.col("n") > 1, "several").when(F.col("full") < 1, "incomplete")
    return both.select("path", reason.alias("reason")).filter("reason IS NOT NULL")


#: Names of what a log must not show.
SECRET_KEY = "api[_-]?key|authorization|password|secret|access[_-]?token"
_TEXT = r'"(?:[^"\\]|\\.)*+"'


def redact(text: Column) -> Column:
    """Users and passwords in addresses, secret parameters and secret JSON values become [REDACTED]; a secret JSON value that is empty, null, false or zero becomes "".

    A value may be a string with escapes, a number, or a list or object (up to three levels deep)."""
    out = F.regexp_replace(text, r"(?i)(\b[a-z][a-z0-9+.-]*://)[^/?#\s@\"]+@", "$1[REDACTED]@")
    out = F.regexp_replace(out, rf"(?i)([?&](?:{SECRET_KEY}|token)=)[^&#\s\"]+", "$1[REDACTED]")
    out = F.regexp_replace(out, r"(?i)(api[_-]?key=)(?!\[REDACTED\])[^&\s\"]+", "$1[REDACTED]")
    name = rf'(?i)("(?:{SECRET_KEY})"\s*:\s*)'
    out = F.regexp_replace(out, name + r"(?:null|false|-?0(?:\.0+)?|\"\")(?=\s*[,}])", '$1""')
    inner = _TEXT
    for _ in range(3):
        inner = rf"(?:{_TEXT}|\{{(?:[^{{}}\[\]\"]|{inner})*+\}}|\[(?:[^{{}}\[\]\"]|{inner})*+\])"
    return F.regexp_replace(out, name + rf"(?!\"\")(?:{inner}|[^\"{{}}\[\],\s]+)", '$1"[REDACTED]"')


def released_index(index: DataFrame, folder: str) -> DataFrame:
    return index.select("id", F.concat(F.lit(folder.rstrip("/") + "/"), F.element_at(F.split("video", "/"), -1)).alias("video"))


# Registry


def profile_fingerprint(profiles: DataFrame, fields: list[str]) -> DataFrame:
    """SHA-256 over identity fields in order, aliases sorted. profiles: id, fields, aliases."""
    doc = F.to_json(F.struct(*fields, F.array_sort("aliases").alias("aliases")), {"ignoreNullFields": "false"})
    return profiles.select("id", F.sha2(doc, 256).alias("fingerprint"))


def validate_profiles(profiles: DataFrame, routes: list[str], transports: list[str]) -> DataFrame:
    """One row per broken rule: safe id, a model, http(s) base without credentials, known route and transport, unique id. profiles: id, model, base_url, route, transport."""
    times = F.count(F.lit(1)).over(Window.partitionBy("id"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [
        F.when(~F.coalesce(F.col("id").rlike(r"^[a-zA-Z0-9][a-zA-Z0-9_.-]*\z"), F.lit(False)), "id"),
        F.when(blank("model"), "model"),
        F.when(~F.coalesce(F.col("base_url").rlike(r"(?i)^https?://[^/\s@]+"), F.lit(False)), "base_url").when(F.col("base_url").rlike(r"(?i)^https?://[^/\s]*@"), "credentials"),
        F.when(~F.coalesce(F.col("route").isin(*routes), F.lit(False)), "route"),
        F.when(~F.col("transport").isin(*transports), "transport"),
        F.when(F.col("times") > 1, "repeated"),
    ]
    return profiles.withColumn("times", times).select("id", F.explode(F.array_compact(F.array(*rules))).alias("reason")).distinct()


def select_profiles(profiles: DataFrame, selector: str) -> DataFrame:
    """Profiles named by a comma list of ids and `tag:x`, or all enabled ones for `all`; the first mention gives the place. profiles: id, tags ARRAY<STRING>, enabled."""
    if selector.strip() == "all":
        return profiles.filter("enabled").select("id", F.lit(0).alias("place"))
    asked = profiles.select("id", "tags", F.posexplode(F.array(*[F.lit(x.strip()) for x in selector.split(",") if x.strip()])).alias("place", "want"))
    hit = (F.col("id") == F.col("want")) | (F.col("want").startswith("tag:") & F.array_contains("tags", F.substring("want", 5, 1000)))
    return asked.filter(hit).groupBy("id").agg(F.min("place").alias("place"))
