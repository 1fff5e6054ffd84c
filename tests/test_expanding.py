"""Two-clock sums, hot days, folds from sums per block, gated fits, Newton steps over many groups, bootstrap arrays, random rankings and grouped trees, against brute force."""
import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof as A, ranking as R
from tidemark.plans import folds as P, metrics as X, models as M, trees as TR


def seconds(df, *columns):
    return df.withColumns({c: F.timestamp_seconds(F.col(c) + 1_700_000_000) for c in columns})


@pytest.mark.parametrize("strict", [True, False])
def test_dominance_sums_against_pairs(spark, strict):
    rng = random.Random(4)
    facts = [(rng.choice("aab"), rng.randint(0, 60) * 40_000, rng.choice([None, *[rng.randint(0, 60) * 40_000] * 9]), float(rng.randint(1, 9))) for _ in range(400)]
    asks = [(rng.choice("aabz"), rng.randint(0, 60) * 40_000, rng.choice([None, *[rng.randint(0, 60) * 40_000] * 9])) for _ in range(150)]
    f = seconds(spark.createDataFrame(facts, "key string, at long, ends long, v double"), "at", "ends")
    q = seconds(spark.createDataFrame(asks, "key string, cut long, bound long"), "cut", "bound")
    got = {(r["key"], r["cut"], r["bound"]): (r["n"], r["s"]) for r in A.dominance_sums(f, q, "key", "at", "cut", "ends", "bound", {"n": F.lit(1), "s": F.col("v")}, strict).withColumns({c: F.unix_seconds(c) - 1_700_000_000 for c in ("cut", "bound")}).collect()}
    want = {}
    for key, cut, bound in asks:
        if bound is not None:
            met = [v for k, at, ends, v in facts if k == key and ends is not None and ends < bound and (at < cut if strict else at <= cut)]
            want[key, cut, bound] = (len(met), sum(met))
    assert got == want and len({b for _, _, b in want}) > 30
    plan = A.dominance_sums(f, q, "key", "at", "cut", "ends", "bound", {"n": F.lit(1)}, strict)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hot_day_spreads_over_many_tasks(spark):
    """A third of the facts stand in one (key, day); its rows must lie in more than ten partitions, with the same sums."""
    rng = random.Random(2)
    facts = [("hot", rng.randint(0, 86_000) * 1000, 1.0) for _ in range(4000)] + [(f"k{rng.randint(0, 50)}", rng.randint(0, 40 * 86_400_000), 1.0) for _ in range(8000)]
    asks = [("hot", t) for t in range(0, 86_400_000, 400_000)] + [(f"k{k}", 20 * 86_400_000) for k in range(52)]
    ms = lambda df, c: df.withColumn(c, F.timestamp_millis(F.lit(1_699_920_000_000) + F.col(c)))  # midnight
    f, q = ms(spark.createDataFrame(facts, "key string, at long, v double"), "at").cache(), ms(spark.createDataFrame(asks, "key string, cut long"), "cut").cache()
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {(r["key"], r["t"]): r["s"] for r in A.asof_sums(f, q, "key", "at", "cut", {"s": F.col("v")}).withColumn("t", F.unix_millis("cut") - 1_699_920_000_000).collect()}
        parts = R.range_partitioned(f.groupBy("key", "at").agg(F.sum("v").alias("v")), [F.col("key"), F.col("at")])
        spread = parts.filter("key = 'hot'").select("_p").distinct().count()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert spread > 10
    assert got == {(k, t): float(sum(1 for key, at, _ in facts if key == k and at <= t)) for k, t in asks}


def test_prefix_sums_carry_over_partitions(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2])) for i in range(500)]
    got = {r["i"]: r["v"] for r in R.prefix_sums(spark.createDataFrame(rows, "k string, i int, v long").repartition(5), [F.asc("i")], ["v"], ["k"]).collect()}
    run, want = collections.Counter(), {}
    for k, i, v in rows:
        run[k] += v or 0
        want[i] = run[k]
    assert got == want


def fold_table(spark, n=240, blocks=6, seed=3):
    """Rows of one target in two versions: blocks of ten days, labels known up to twenty-five days later."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        b = int(rng.integers(1, blocks + 1))
        at = b * 864_000 + int(rng.integers(0, 700_000))
        x, z = float(rng.normal()), float(rng.normal() + 1000)
        y = None if i % 17 == 0 else float(0.5 * x + 0.1 * (z - 1000) + rng.normal())
        rows.append(("t", "regression", "all" if i % 2 else "clean", f"E{i:04d}", b, blocks, at, at + int(rng.integers(0, 25)) * 86_400, y, x, z, 3.0))
    return seconds(spark.createDataFrame(rows, "target string, kind string, version string, event_id string, block int, n_blocks int, cutoff long, matures_at long, y double, a double, z double, constant double"), "cutoff", "matures_at")


def test_fold_sums_equal_the_sums_over_folds(spark):
    rows = fold_table(spark).filter("not (version = 'clean' and block in (1, 4))")
    got = {(r["version"], r["fold"]): (r["train_n"], r["test_n"], round(r["train_s"], 9), r["stage"]) for r in P.fold_sums(rows, ["version"], {"n": F.lit(1), "s": F.coalesce("y", F.lit(0.0))}).collect()}
    f = P.folds(rows).groupBy("version", "fold").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b"), F.sum(F.when(F.col("role") == "train", F.coalesce("y", F.lit(0.0))).otherwise(0.0)).alias("s"), F.max("stage").alias("stage"))
    assert got == {(r["version"], r["fold"]): (r["a"], r["b"], round(r["s"], 9), r["stage"]) for r in f.collect()} and len(got) == 10


def test_fold_two_of_a_single_block_is_no_holdout(spark):
    rows = fold_table(spark, n=30, blocks=1)
    assert {(r["fold"], r["stage"], r["train_n"], r["test_n"]) for r in P.fold_sums(rows, ["target"], {"n": F.lit(1)}).collect()} == {(2, "development", 30, 0)}
    assert {(r["fold"], r["stage"], r["role"]) for r in P.folds(rows).collect()} == {(2, "development", "train")}


def test_expanding_ridge_takes_only_labels_known_in_time(spark):
    rows = fold_table(spark)
    feats = ["a", "z", "constant"]
    entered = P.walk_forward_entry(rows)
    fits = {(r["version"], r["fold"]): r for r in M.fit_ridge_expanding(entered, feats, minimum=10).collect()}
    refused = {(r["version"], r["fold"]): r["refused"] for r in P.refused_rows(entered).collect()}
    gated = P.walk_forward(rows)
    z = M.standardize(gated, feats, ["target", "version", "fold"])
    want = {(r["version"], r["fold"]): r for r in M.fit_ridge(z, feats, ["target", "version", "fold"], minimum=10).collect()}
    late = {(r["version"], r["fold"]): r["count"] for r in gated.filter("role = 'late' and y is not null").groupBy("version", "fold").count().collect()}
    assert refused == late and sum(late.values()) > 30
    boundary = {r["fold"]: r["boundary"] for r in P.boundaries(rows).collect()}
    data = rows.collect()
    for key, w in want.items():
        g = fits[key]
        known = [r for r in data if r["version"] == key[0] and r["block"] < key[1] and r["y"] is not None and r["matures_at"] < boundary[key[1]]]
        assert g["n"] == w["n"] == len(known) and g["state"] == w["state"]
        if w["beta"] is not None:
            np.testing.assert_allclose(g["beta"], w["beta"], atol=1e-8)
            np.testing.assert_allclose(g["means"][:2], [np.mean([r["a"] for r in known]), np.mean([r["z"] for r in known])], atol=1e-9)
            assert g["deviations"][2] == 0.0 and g["beta"][3] == 0.0
    tested = M.predict_expanding(rows, M.fit_ridge_expanding(entered, feats, minimum=10), feats)
    old = {(r["event_id"], r["version"]): r["p"] for r in M.predict(z.filter("role = 'test'"), M.fit_ridge(z, feats, ["target", "version", "fold"], minimum=10), feats, ["target", "version", "fold"]).collect()}
    for r in tested.collect():
        if (r["event_id"], r["version"]) in old:
            assert r["p"] == pytest.approx(old[r["event_id"], r["version"]], abs=1e-8)


def test_paired_folds_fall_back_without_history(spark):
    rows = P.walk_forward_entry(fold_table(spark)).filter("y is not null")
    both = rows.withColumn("role", F.explode(F.array(F.lit("train"), F.lit("test")))).withColumn("seen", F.col("block") % 2 == 0)
    out = M.paired_folds(both, ["a"], "z", F.col("seen"), minimum=10).collect()
    assert len(out) == rows.filter("block >= 2").count() and all(r["baseline"] == r["challenger"] for r in out if not r["seen"])
    assert any(r["seen"] and r["baseline"] is not None and abs(r["baseline"] - r["challenger"]) > 1e-6 for r in out) and any(r["baseline"] is None for r in M.paired_folds(both, ["a"], "z", F.col("seen"), minimum=10**6).collect())


def test_newton_steps_of_many_groups_keep_the_plan_small(spark):
    """Two thousand groups at once; the table of coefficients is data, so the plan does not know how many there are."""
    n, groups = 40, 2000
    rows = spark.range(groups * n).select((F.col("id") % groups).alias("g"), F.lit("train").alias("role"), F.rand(3).alias("z_a"), F.rand(4).alias("_u"))
    rows = rows.withColumn("z_a", F.col("z_a") * 4 - 2).withColumn("y", (F.col("_u") < 1 / (1 + F.exp(-F.col("z_a")))).cast("double")).withColumn("y", F.when(F.col("g") == 7, 1.0).otherwise(F.col("y")))
    rows = rows.cache()
    fit = M.fit_logistic(rows, ["a"], ["g"], minimum_class=5)
    got = {r["g"]: r for r in fit.collect()}
    assert len(got) == groups and got[7]["state"] == "INSUFFICIENT_DATA" and got[7]["beta"] is None
    assert len(fit._jdf.queryExecution().optimizedPlan().toString()) < 2000
    for g in (0, 5, 1999):
        part = [(r["z_a"], r["y"]) for r in rows.filter(F.col("g") == g).collect()]
        x, y = np.array([[1.0, a] for a, _ in part]), np.array([v for _, v in part])
        beta = np.array(got[g]["beta"])
        assert got[g]["state"] == "FITTED" and np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - np.array([0, 1]) * beta).max() < 1e-6


def test_bootstrap_arrays_and_joins_agree(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(rng.choice("xy"), rng.randint(0, 30), f"i{rng.randint(0, 90)}", rng.gauss(0, 1)) for _ in range(600)], "g string, session int, issuer string, difference double")
    a, b = (sorted(map(tuple, X.cluster_bootstrap(d, ["g"], seed=5, replicates=300, most_clusters=most).select("g", "axis", "events", "clusters", *[F.round(c, 9) for c in ("estimate", "low_95", "high_95", "low_99", "high_99")]).collect())) for most in (1 << 20, 0))
    assert a == b and len(a) == 4


def test_random_rankings_take_k_rows_and_ask_for_2k(spark):
    rows = [("all", i, 1.0) for i in range(40)] + [("few", i, 1.0) for i in range(39)] + [("half", i, float(i % 2)) for i in range(400)]
    got = {r["g"]: r for r in X.random_precision(spark.createDataFrame(rows, "g string, event_id int, y double"), 20, ["g"], seed=1, rankings=400).collect()}
    assert set(got) == {"all", "half"} and got["all"]["random_mean"] == got["all"]["random_low"] == 1.0
    assert got["half"]["random_mean"] == pytest.approx(0.5, abs=0.02)


# ---- trees

def brute_tree(rows, y, w, depth, minimum):
    """Greedy splits over every midpoint; features in order of name."""
    n = sum(w)
    mean = sum(a * b for a, b in zip(y, w)) / n
    best = None
    if depth:
        for f in range(len(rows[0])):
            values = sorted({r[f] for r in rows})
            for a, b in zip(values, values[1:]):
                left = [i for i, r in enumerate(rows) if r[f] <= a]
                lc = sum(w[i] for i in left)
                if minimum <= lc <= n - minimum:
                    lm = sum(w[i] * y[i] for i in left) / lc
                    rm = (mean * n - lm * lc) / (n - lc)
                    gain = round(lc * (lm - mean) ** 2 + (n - lc) * (rm - mean) ** 2, 10)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, f, a / 2 + b / 2
    if best is None:
        return lambda x: mean
    _, f, t = best
    side = lambda keep: brute_tree([r for r in rows if keep(r)], [v for r, v in zip(rows, y) if keep(r)], [v for r, v in zip(rows, w) if keep(r)], depth - 1, minimum)
    left, right = side(lambda r: r[f] <= t), side(lambda r: r[f] > t)
    return lambda x: (left if x[f] <= t else right)(x)


def tree_table(spark, binary, seed=0, n=180):
    rng = random.Random(seed)
    rows = []
    for g in ("one", "two"):
        for i in range(n):
            a, b, c = rng.choice([0.0, 1.0]), round(rng.gauss(0, 1), 2), float(rng.randint(0, 5))
            score = a + b - 0.3 * c + rng.gauss(0, 0.5)
            rows.append((g, "train" if i % 3 else "test", i, float(score > 0) if binary else score, a, b, c))
    return rows, spark.createDataFrame(rows, "g string, role string, event_id int, y double, a double, b double, c double")


@pytest.mark.parametrize("binary", [True, False])
def test_grouped_trees_equal_greedy_trees(spark, binary):
    rows, df = tree_table(spark, binary)
    got = {(r["g"], r["event_id"], r["family"], r["depth"]): r["p"] for r in TR.tree_predictions(df, ["c", "a", "b"], ["g"], ("single_tree", "gradient_boosting"), depths=(1, 3), binary=binary, rounds=3, bins=1000).collect()}
    for g in ("one", "two"):
        train = [r for r in rows if r[0] == g and r[1] == "train"]
        x, y, w = [r[4:] for r in train], [r[3] for r in train], [1] * len(train)
        for depth in (1, 3):
            tree = brute_tree(x, y, w, depth, 10)
            link = (lambda s: 1 / (1 + math.exp(-s))) if binary else (lambda s: s)
            mean = sum(y) / len(y)
            start = math.log(mean / (1 - mean)) if binary else mean
            scores, grown = [start] * len(y), []
            for _ in range(3):
                t = brute_tree(x, [a - link(s) for a, s in zip(y, scores)], w, depth, 10)
                grown.append(t)
                scores = [s + 0.1 * t(v) for s, v in zip(scores, x)]
            for r in rows:
                if r[0] == g:
                    assert got[g, r[2], "single_tree", depth] == pytest.approx(tree(r[4:]), abs=1e-9)
                    assert got[g, r[2], "gradient_boosting", depth] == pytest.approx(link(start + 0.1 * sum(t(r[4:]) for t in grown)), abs=1e-9)


def test_forests_ensembles_and_quantiles(spark):
    rows, df = tree_table(spark, False, seed=5)
    p = TR.tree_predictions(df, ["a", "b", "c"], ["g"], depths=(2,), binary=False, trees=12, rounds=4, bins=16)
    got = collections.defaultdict(dict)
    for r in p.collect():
        got[r["g"], r["event_id"]][r["family"]] = r["p"]
    assert len(got) == len(rows) and all(v["equal_weight_ensemble"] == pytest.approx((v["random_forest"] + v["gradient_boosting"]) / 2) for v in got.values())
    truth = {(r[0], r[2]): r[3] for r in rows if r[1] == "test"}
    mean = np.mean([r[3] for r in rows if r[1] == "train"])
    for family in TR.FAMILIES:
        assert np.mean([(got[k][family] - y) ** 2 for k, y in truth.items()]) < 0.8 * np.mean([(mean - y) ** 2 for y in truth.values()])
    q = TR.tree_quantiles(p, ["g"]).filter("family = 'single_tree'").collect()
    assert len(q) == len(truth) and all(r["q"][0] < r["q"][1] < r["q"][2] for r in q)
    inside = np.mean([r["q"][0] <= r["y"] <= r["q"][2] for r in q])
    assert 0.6 < inside < 0.95
    again = {(r["g"], r["event_id"]): r["p"] for r in TR.tree_predictions(df.repartition(7), ["a", "b", "c"], ["g"], ("random_forest",), depths=(2,), binary=False, trees=12, bins=16).collect()}
    assert all(again[k] == pytest.approx(v["random_forest"], abs=1e-9) for k, v in got.items())
