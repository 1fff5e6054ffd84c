"""The pipeline: each stage on what the one before it kept."""
import collections

import corpus_pipeline as P


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    n = len(before)
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        after = [r["doc_id"] for r in docs.collect()]
        assert docs.columns == columns and len(after) == len(set(after)) and set(after) <= before, name
        before = set(after)
    last = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in last} == before and 0.5 * n < len(last) < n
    whole = P.run(spark, sf).collect()
    assert collections.Counter(map(str, whole)) == collections.Counter(map(str, last))


def test_planted_cases(spark, tmp_path):
    """A toxic document, an exact copy, a passage that repeats and a benchmark item among clean documents."""
    sf = "/root/testdata/sf0.01"  # enough labels to learn from
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    passage = " ".join(f"thorn{i} eddy" for i in range(30))
    prose = lambda k: " ".join(f"onen{(i * 7919 * k) % 977} hathe" for i in range(60))
    made = [(100001, prose(3)), (100002, prose(3)), (100003, prose(5) + "\n" + passage), (100004, prose(7) + "\n" + passage + "\n" + prose(13)), (100005, prose(11) + " " + item + " " + prose(17)),
            (100006, "you st*pid 1d10t and w0rthless m.o.r.o.n are trash scum idiot pathetic")]
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in made], documents.schema)
    documents.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 100006 not in kept["toxicity"] and {100001, 100003, 100004, 100005} <= set(kept["toxicity"])
    assert passage in kept["line_dedup"][100003] and passage not in kept["line_dedup"][100004] and prose(13) in kept["line_dedup"][100004]
    assert len({100001, 100002} & set(kept["near_dedup"])) == (2 if kept["line_dedup"][100002] != kept["line_dedup"][100001] and kept["line_dedup"][100002] else 1)
    assert 100005 not in kept["decontamination"] and {100003, 100004} <= set(kept["decontamination"])
