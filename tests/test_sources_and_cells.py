"""Listings of several files, refused submissions, nested inline facts, excerpts, and members read from cells, on small fixtures."""
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import analogues as N
from tidemark.plans.outcomes import LABELS
from tidemark.sources import documents as D


def test_listing_files_are_checked_one_by_one(spark, tmp_path):
    (tmp_path / "a.txt").write_text("symbol|name\nA|x\nB|\n|no key\nFile Creation Time: 1|\n")
    (tmp_path / "b.txt").write_text("name|more|symbol\nsymbol|m|name\ny||A\nFile Creation Time: 2||\n\n")
    (tmp_path / "empty.txt").write_text("")
    rows = sorted(map(tuple, D.read_listing(spark, str(tmp_path), ["symbol", "name"]).collect()), key=str)
    assert rows == sorted([("A", "x", "DUPLICATE_SYMBOL"), ("B", None, None), (None, "no key", "MISSING_SYMBOL"), ("name", "symbol", None), ("A", "y", "DUPLICATE_SYMBOL")], key=str)
    (tmp_path / "c.txt").write_text("symbol|name\nC|z\n")
    (tmp_path / "d.txt").write_text("symbol|title\nD|z\nFile Creation Time: 3|\n")
    with pytest.raises(ValueError, match=r"(c|d)\.txt"):
        D.read_listing(spark, str(tmp_path), ["symbol", "name"])
    rows, bad = D.read_listing(spark, str(tmp_path), ["symbol", "name"], on_bad="refuse")
    assert {r["symbol"] for r in rows.collect()} == {"A", "B", None, "name"}
    assert {(r["file"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect()} == {("c.txt", "has 0 footers"), ("d.txt", "lacks the columns name")}


def test_a_listing_file_may_be_read_in_several_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("symbol|name\n" + "".join(f"S{i}|{'n' * 50}{i}\n" for i in range(4000)) + "File Creation Time: 1|\n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = D.read_listing(spark, str(tmp_path), ["symbol"])
        assert rows.count() == 4000 and rows.filter("reason is not null").count() == 0
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_bundles_as_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": [{"k": "1"}]}\n{"x": [{"k": "2"}, {"k": "3"}], "y": [{"v": 1.5}]}\n')
    b = D.read_bundle(spark, str(tmp_path), "x array<struct<k:string>>, y array<struct<v:double>>", lines=True)
    assert sorted(r["k"] for r in b["x"].collect()) == ["1", "2", "3"] and [r["v"] for r in b["y"].collect()] == [1.5]


def test_submissions_are_refused_with_a_reason(spark):
    doc = lambda kind="EX-99.1", name="<FILENAME>a.htm\n", text="<TEXT>body</TEXT>": f"<DOCUMENT>\n<TYPE>{kind}\n{name}{text}\n</DOCUMENT>\n"
    head = lambda acc="a-1", cik="0000000007", n="PUBLIC DOCUMENT COUNT: 2\n", end="</SEC-HEADER>\n": f"ACCESSION NUMBER:\t\t{acc}\n{n}\tCENTRAL INDEX KEY:\t{cik}\n{end}"
    end = "</SEC-DOCUMENT>\n"
    cases = [(head() + doc() + doc("8-K") + end, None), (head(acc="a-12") + doc() + end, "IDENTITY_MISMATCH"), (head(cik="0000000008") + doc() + end, "IDENTITY_MISMATCH"), (head(end="") + doc() + end, "IDENTITY_MISMATCH"),
             (head(n="") + doc() + end, "INCOMPLETE_SUBMISSION"), (head() + doc() + "<DOCUMENT>\n" + end, "INCOMPLETE_SUBMISSION"), (head() + doc(), "INCOMPLETE_SUBMISSION"), (head() + doc(name="") + end, "INCOMPLETE_EXHIBIT"),
             (head() + doc(text="<TEXT>cut") + end, "INCOMPLETE_EXHIBIT"), (head() + doc(name="<FILENAME>../a\n") + end, "INVALID_FILENAME"), (head() + doc("EX-10", name="") + end, None), (None, "IDENTITY_MISMATCH")]
    df = spark.createDataFrame([(i, t, "a-1", "0000000007") for i, (t, _) in enumerate(cases)], "i int, t string, a string, c string")
    found, refused = D.read_submissions(df, "t", "a", "c", keep=("i",))
    assert {r["i"]: r["reason"] for r in refused.collect()} == {i: why for i, (_, why) in enumerate(cases) if why}
    assert [tuple(r) for r in found.collect()] == [(0, 2, 2, "EX-99.1", "a.htm", "body")]


def test_inline_facts_nest_and_continue(spark):
    fact = lambda name, body, context="c", more="": f'<ix:nonNumeric {more} name="d:{name}" contextRef="{context}">{body}</ix:nonNumeric>'
    pages = [fact("A", "x " + fact("B", "<b>y</b> &lt;z&gt;") + " w"), "</ix:nonNumeric>" + fact("A", "one", more="continuedAt='k1'") + '<ix:continuation id="k2">three</ix:continuation><p><ix:continuation id="k1" continuedAt="k2"> two </ix:continuation></p>',
             "<ix:nonNumeric name='d:A' contextRef='c'>open " + fact("B", "in"), fact("A", "loop", more='continuedAt="k"') + '<ix:continuation id="k" continuedAt="k">+</ix:continuation>', fact("A", "no context", context=""), "plain 1 < 2", None, "",
             "<ix:nonNumeric name='d:A' contextRef='c'/>" + fact("B", "<!-- " + fact("C", "hidden") + " -->kept")]
    got = {}
    for r in D.inline_facts(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string"), keep=("i",)).collect():
        got.setdefault(r["i"], set()).add((r["context"], r["name"], r["value"]))
    assert got[0] == {("c", "a", "x y <z> w"), ("c", "b", "y <z>")} and got[1] == {("c", "a", "one two three")} and got[2] == {("c", "b", "in")} and got[8] == {("c", "b", "kept")}
    assert {n for _, n, _ in got[3]} == {"a"} and set(got) == {0, 1, 2, 3, 8}


def test_excerpts_hold_two_lines_on_both_sides(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a", "b", "outlook for 2024", "revenue of $5", "c", "e", "f"])], "doc string, line_no int, line string")
    got = D.outlook_excerpts(lines, ["doc"]).collect()
    assert [(r["line_no"], list(r["excerpt"])) for r in got] == [(3, ["b", "outlook for 2024", "revenue of $5", "c", "e"])]


def test_members_from_cells_equal_the_listing(spark):
    """Any number of targets, those with and without a cluster of their own, against the listing form that pairs every event with every target."""
    rng = random.Random(8)
    rows = []
    for i in range(160):
        division = rng.choice(["D", "I", "G"])
        timing, group = rng.choice(["premarket", "after_hours"]), f"{division}{rng.randint(1, 2)}"
        cluster, cutoff, late = f"k{i - i % 3 if rng.random() < 0.2 else i}", i * 3600, 20 * 3600  # a later cutoff never matures earlier
        for label in LABELS[:3]:
            rows.append((f"E{i:03d}", cluster, label, "return", timing, division, group, f"i{i % 40}", i // 4, cutoff, cutoff + late, None if rng.random() < 0.85 else "ABSENT", float(i), None))
    labels = spark.createDataFrame(rows, "event_id string, cluster_id string, label string, kind string, timing string, sic_division string, sic_major_group string, cik string, reaction_idx int, cutoff long, matures_at long, reason string, num double, flag boolean")
    labels = labels.withColumns({c: F.timestamp_seconds(F.col(c) + 1_700_000_000) for c in ("cutoff", "matures_at")}).cache()
    events = labels.filter(F.col("label") == LABELS[0])
    asked = events.select("event_id", "cluster_id", "timing", "sic_division", "sic_major_group", "cutoff").filter("event_id like '%7' or event_id > 'E140'")
    targets = asked.select(F.col("event_id").alias("target_id"), F.col("event_id").alias("target_event"), F.col("cluster_id").alias("target_cluster"), F.col("timing").alias("t_timing"), F.col("sic_division").alias("t_division"), F.col("sic_major_group").alias("t_group"), F.col("cutoff").alias("t_cutoff"))
    fresh = targets.limit(9).withColumns({"target_id": F.concat(F.lit("new"), "target_id"), "target_event": F.lit(None).cast("string"), "target_cluster": F.lit(None).cast("string"), "t_group": F.lit("none")})
    targets = targets.unionByName(fresh).cache()
    want = {(r["target_id"], r["label"], r["event_id"]): (r["distance"], r["state"]) for r in N.analogues(targets, labels).filter("exclusion is null").collect()}
    got = {(r["target_id"], r["label"], r["event_id"]): (r["distance"], r["state"]) for r in N.analogue_members(targets, labels).collect()}
    assert got == want and len({k[0] for k in got}) > 20 and {s for _, s in got.values()} == {N.FOUND, N.INSUFFICIENT}
    plan = N.analogue_members(targets, labels)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
