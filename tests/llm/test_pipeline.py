"""The pipeline's rows against a brute-force version of its stages."""

import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tracelode.llm import common, lattice, mixing, quality, segmentation

from .test_llm import SCHEMA, _components, awkward, near_copies


def test_stages_have_their_effect(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = common.table(spark, d, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = kept_before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [r.asDict() for r in kept.collect()]
        kept = common.written(spark, stage(spark, kept, d), "stage")
        after = [r.asDict() for r in kept.collect()]
        assert kept.columns == columns
        if name.startswith("quality"):
            score = quality.scored(spark, docs, common.table(spark, d, "labels"))
            want = {r.doc_id for r in docs.select("doc_id", score.alias("s")).filter(f"s >= {quality.THRESHOLD}").collect()}
            assert {r["doc_id"] for r in after} == want
        elif name.startswith("exact"):
            groups = collections.defaultdict(list)
            for r in before:
                groups["".join(r["text"].split())].append(r)
            assert sorted(r["doc_id"] for r in after) == sorted(min(v, key=lambda r: (-len(r["text"]), r["doc_id"]))["doc_id"] for v in groups.values())
        elif name.startswith("MinHash"):
            want = {i for (i, _, c) in _components([(r["doc_id"], r["text"]) for r in before]) if i == c}
            assert {r["doc_id"] for r in after} == want
        else:
            assert collections.Counter(r["doc_id"] for r in after) == _mixed(spark, kept_before, before)
        kept_before = kept
    out = corpus_pipeline.STAGES[-1][1](spark, kept, d)
    _segmented(out.collect(), kept.collect())
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").collect()) == collections.Counter(r.doc_id for r in out.select("doc_id").collect())


def _mixed(spark, frame, rows):
    """How often each document is taken: whole repeats of its source, and once more below the threshold of its hash that comes nearest to what is left."""
    hashes = {(r.doc_id, r.text): r.h for r in frame.withColumns({"th": common.text_key(F.col("text")), "k": F.lit(1)}).select("doc_id", "text", mixing.hash_of(0).alias("h")).collect()}
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r["source"]].append((hashes[r["doc_id"], r["text"]], size(r), r["doc_id"]))
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = {s: sum(n for _, n, _ in sources[s]) for s in order}
    goal, open_, left = {}, set(order), float(sum(total.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * total[s]}
        goal |= {s: 3.0 * total[s] for s in over} if over else {s: left * weight[s] / w for s in open_}
        left -= sum(goal[s] for s in over)
        open_ -= over or open_
    out = collections.Counter()
    for s in order:
        whole = min(3, int(goal[s] // total[s])) if total[s] else 0
        need = goal[s] - whole * total[s]
        rest = sorted(sources[s])
        upto, cut = 0, 0
        while cut < len(rest) and upto + rest[cut][1] <= need:
            upto += rest[cut][1]
            cut += 1
        # The boundary document is taken if that comes nearer; the hash has 40 bits, so at these sizes no two share the last bucket.
        cut += cut < len(rest) and need - upto > rest[cut][1] / 2
        for k, (_, _, i) in enumerate(rest):
            if n := whole + (k < cut and need > 1e-6):
                out[i] += n
    return out


def _segmented(out, docs):
    """Samples are those that the lattice draws for each text by itself, and they decode to it."""
    v = segmentation.vocabulary(segmentation.model())
    by = collections.defaultdict(dict)
    for r in out:
        by[r.doc_id][r.sample] = r
    for r in {x.doc_id: x for x in docs}.values():
        for x in by[r.doc_id].values():
            assert v.decode(x.ids) == r.text.replace(lattice.SPACE, " ") and x.n_tokens == len(x.ids) and x.log_inclusion <= 0
        assert len({tuple(x.ids) for x in by[r.doc_id].values()}) == len(by[r.doc_id]) <= segmentation.SAMPLES


def test_quality_and_mixing_stages_take_awkward_rows(spark, tmp_path):
    """Nulls in every column, and extra columns with names that the stages use inside."""
    docs = common.written(spark, spark.createDataFrame(awkward(), SCHEMA).withColumns({"h": F.lit(1), "below": F.lit(2), "upto": F.lit(3), "__note": F.lit("x"), "target": F.lit(4.0), "copies": F.lit(5), "quality": F.lit(1), "th": F.lit(6)}), "docs")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = collections.Counter(map(repr, docs.collect()))
    for name, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[3]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = collections.Counter(map(repr, out.collect()))
        most = 1 if name.startswith("quality") else 3
        assert got and all(n <= most * rows[r] for r, n in got.items())


def test_dedup_stages_keep_one_of_repeated_rows(spark, tmp_path):
    rows = awkward() + [(i, t, "en", "s", 1, None, None, None, None) for i, t in near_copies(30)]
    docs = common.written(spark, spark.createDataFrame(rows, SCHEMA), "docs")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert len(got) == len(set(got)) or all(t is None or not t.split() for (_, t), n in collections.Counter(got).items() if n > 1)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
