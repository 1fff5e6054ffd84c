import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof as A, quantiles as Q, ranking as R, sets as U
from tidemark.operators.windows_join import overlaps
from tidemark.plans import cells as C, enrich as E, models as M, summaries as S

T0 = 1_700_000_000


def stamp(df, *cols):
    return df.withColumns({c: F.timestamp_seconds(F.col(c) + T0) for c in cols})


def test_asof_features_against_brute_force(spark):
    rnd = random.Random(3)
    span = 6 * 86400
    feats = []
    for i in range(400):
        e, name, a = rnd.choice("AAAB"), rnd.choice(["x", "y"]), rnd.randrange(span)
        length = rnd.choice([None, None, 5, 40, 900, 7200, 90000, 300000])
        feats.append((e, name, f"{i:04d}", float(i), a, a + rnd.randrange(100), a - rnd.randrange(3600), None if length is None else a + length, rnd.choice([None, a + rnd.randrange(5000)])))
    cuts = [(e, rnd.randrange(span)) for e in "AB" for _ in range(150)] + [(f[0], f[4]) for f in feats[:60]] + [(f[0], f[7]) for f in feats[:60] if f[7] is not None]
    f = stamp(spark.createDataFrame(feats, "security_id string, name string, revision_id string, value double, available_at long, first_seen_at long, valid_from long, valid_to long, label_available_at long"),
              "available_at", "first_seen_at", "valid_from", "valid_to", "label_available_at")
    c = stamp(spark.createDataFrame(cuts, "security_id string, cutoff long"), "cutoff")
    for mode, clock in (("historical_reconstruction", 4), ("forward_observed", None)):
        got = {(r["security_id"], r["name"], int(r["c"]) - T0): r["revision_id"] for r in A.asof_features(c, f, mode).withColumn("c", F.unix_seconds("cutoff")).collect()}
        want = {}
        for e, t in set(cuts):
            for row in feats:
                known = row[4] if clock else max(row[4], row[5])
                if row[0] == e and known <= t and row[6] <= t and (row[7] is None or t < row[7]) and (row[8] is None or row[8] <= t):
                    key = (e, row[1], t)
                    want[key] = max(want.get(key, (-1, "")), (known, row[2]))
        assert got == {k: v[1] for k, v in want.items()}


def test_asof_sums_strict_and_not(spark):
    facts = stamp(spark.createDataFrame([("k", 0, 1.0), ("k", 100, 2.0), ("k", 200000, 4.0), ("z", 5, 8.0)], "key string, at long, v double"), "at")
    asks = stamp(spark.createDataFrame([("k", 0), ("k", 100), ("k", 150), ("k", 200000), ("k", 999999), ("q", 7)], "key string, cut long"), "cut")
    for strict, want in ((False, {0: 1.0, 100: 3.0, 150: 3.0, 200000: 7.0, 999999: 7.0}), (True, {0: 0.0, 100: 1.0, 150: 3.0, 200000: 3.0, 999999: 7.0})):
        got = {(r["key"], r["c"] - T0): r["s"] for r in A.asof_sums(facts, asks, "key", "at", "cut", {"s": F.col("v")}, strict).withColumn("c", F.unix_seconds("cut")).collect()}
        assert got == {**{("k", t): v for t, v in want.items()}, ("q", 7): 0.0}


def test_injected_future_row_changes_nothing(spark):
    facts = stamp(spark.createDataFrame([("k", 10, 1.0)], "key string, at long, v double"), "at")
    asks = stamp(spark.createDataFrame([("k", 20)], "key string, cut long"), "cut")
    later = stamp(spark.createDataFrame([("k", 21, 99.0)], "key string, at long, v double"), "at")
    run = lambda f: [tuple(r) for r in A.asof_sums(f, asks, "key", "at", "cut", {"s": F.col("v")}).collect()]
    assert run(facts) == run(facts.unionByName(later))


def test_type7_quantiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 10.0)] + [("one", 5.0)], "k string, v double")
    got = {r["k"]: [round(x, 9) for x in r["q"]] for r in Q.exact_quantiles(df, ["k"], "v", (0.1, 0.5, 0.9)).collect()}
    assert got == {"a": [1.3, 3.0, 8.2], "one": [5.0, 5.0, 5.0]}


def test_quantiles_against_numpy_with_ties_and_skew(spark):
    rnd = np.random.default_rng(5)
    data = {"hot": np.round(rnd.normal(0, 1, 3000), 2), "neg": -np.abs(rnd.normal(0, 50, 57)), "flat": np.full(40, 0.25), "large": rnd.normal(0, 1e13, 500), "tiny": np.concatenate((rnd.normal(0, 1e-300, 50), [0.0, -0.0, 5e-324]))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    levels = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r["k"]: (r["n"], r["q"]) for r in Q.exact_quantiles(df, ["k"], "v", levels).collect()}
    for k, vs in data.items():
        assert got[k][0] == len(vs)
        np.testing.assert_allclose(got[k][1], np.quantile(vs, levels), rtol=1e-15, atol=1e-12)


def test_positions_and_running_totals_with_a_hot_tie(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice([0.5, 0.5, 0.5, rnd.random()]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, s double, i int").repartition(7)
    got = {r["i"]: (r["position"], r["group_n"]) for r in R.positions(df, [F.desc("s"), F.asc("i")], ["g"]).collect()}
    for g in "ab":
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == [(p, len(order)) for p in range(len(order))]
    run = {r["i"]: r["cum_i"] for r in R.running_totals(df, [F.asc("s"), F.asc("i")], ["i"]).collect()}
    total = 0
    for _, _, i in sorted(rows, key=lambda r: (r[1], r[2])):
        total += i
        assert run[i] == total


def test_average_precision_with_all_scores_tied_is_the_base_rate(spark):
    df = spark.createDataFrame([(0.3, float(i < 3), i) for i in range(10)], "p double, y double, i int")
    assert R.average_precision(df, "p", "y").first()["average_precision"] == pytest.approx(0.3)


def test_equal_bins_sizes(spark):
    df = spark.createDataFrame([(float(i % 7), f"{i:03d}") for i in range(43)], "p double, event_id string")
    sizes = [r["count"] for r in R.equal_bins(df, "p", "event_id").groupBy("bin").count().orderBy("bin").collect()]
    assert sizes == [11, 11, 11, 10]
    assert R.equal_bins(df.limit(9), "p", "event_id").filter("bin is not null").count() == 0


@pytest.mark.parametrize("n,prop,mean", [(4, "WITHHELD", "WITHHELD"), (5, "REPORTED_UNRELIABLE", "WITHHELD"), (9, "REPORTED_UNRELIABLE", "WITHHELD"), (10, "REPORTED", "REPORTED_UNRELIABLE"), (19, "REPORTED", "REPORTED_UNRELIABLE"), (20, "REPORTED", "REPORTED")])
def test_suppression_bands(spark, n, prop, mean):
    p = C.POLICY
    assert tuple(spark.range(1).select(C.band(F.lit(n), *p["proportion"]), C.band(F.lit(n), *p["mean_median"])).first()) == (prop, mean)


def test_pooling_skips_withheld_ancestors_and_uses_pooled_ones(spark):
    s = spark.createDataFrame([("all", "*", None, None, "l", 100, 0.2), ("sic_division", "D", "all", "*", "l", 10, 0.4), ("sic_major_group", "23", "sic_division", "D", "l", 3, None), ("issuer", "c", "sic_major_group", "23", "l", 10, 0.8)],
                              "level string, key string, parent_level string, parent_key string, label string, n long, value double")
    got = {r["level"]: (r["pooled"], r["toward"], r["weight_on_cell"]) for r in C.partial_pool(s).collect()}
    assert got["all"] == (None, None, None) and got["sic_division"] == (pytest.approx(0.3), "all", 0.5)
    assert got["sic_major_group"][0] is None and got["issuer"] == (pytest.approx(0.55), "sic_division", 0.5)


def test_connected_partitions_reach_a_fixed_point(spark):
    rnd = random.Random(9)
    rows = [(i, f"c{rnd.randrange(60)}", f"s{rnd.randrange(60)}", rnd.randrange(3)) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id int, cluster_id string, reaction_session string, part int")
    got = {r["event_id"]: r["part"] for r in U.connected_partitions(df).collect()}
    part = {r[0]: r[3] for r in rows}
    while True:
        new = {r[0]: max(part[o[0]] for o in rows if o[1] == r[1] or o[2] == r[2]) for r in rows}
        if new == part:
            break
        part = new
    assert got == part


@pytest.mark.parametrize("seed,n", [(1, 20), (2, 60), (3, 97)])
def test_ordered_partitions_take_whole_sessions_from_the_end(spark, seed, n):
    rnd = random.Random(seed)
    rows = [(i, f"c{rnd.randrange(3 * n)}", f"2024-01-{rnd.randrange(1, 25):02d}") for i in range(n)]
    got = {r["event_id"]: r["part"] for r in U.ordered_partitions(spark.createDataFrame(rows, "event_id int, cluster_id string, s string").withColumn("reaction_session", F.to_date("s")).drop("s")).collect()}
    minimum, sessions, part = (15 * n + 99) // 100, sorted({r[2] for r in rows}), {}
    for label in (2, 1):
        size = 0
        while sessions and size < minimum:
            day = sessions.pop()
            size += sum(r[2] == day for r in rows)
            part.update({r[0]: label for r in rows if r[2] == day})
    part = {r[0]: part.get(r[0], 0) for r in rows}
    while True:
        new = {r[0]: max(part[o[0]] for o in rows if o[1] == r[1] or o[2] == r[2]) for r in rows}
        if new == part:
            break
        part = new
    assert got == part


def test_decision_rule(spark):
    from tidemark.plans.metrics import decide
    df = spark.createDataFrame([("EVALUABLE", -0.2, -0.1, -0.05), ("EVALUABLE", -0.2, -0.1, 0.05), ("EVALUABLE", 0.1, 0.2, 0.3), ("EVALUABLE", -0.1, 0.2, 0.3), ("NO", -0.2, -0.1, -0.05), ("EVALUABLE", -0.2, -0.1, None)],
                               "state string, low double, high double, all_event_estimate double")
    assert [r[0] for r in df.select(decide()).collect()] == ["DISTINGUISHABLE_BETTER", "NOT_DISTINGUISHABLE", "DISTINGUISHABLE_WORSE", "NOT_DISTINGUISHABLE", "INSUFFICIENT_DATA", "NOT_DISTINGUISHABLE"]


def test_constant_difference_gives_a_degenerate_interval(spark):
    from tidemark.plans.metrics import cluster_bootstrap, headline
    d = spark.createDataFrame([("t", i % 5, f"i{i % 7}", 0.25) for i in range(40)], "target string, session int, issuer string, difference double")
    b = cluster_bootstrap(d, ["target"], replicates=200)
    assert all(r["low_99"] == r["high_99"] == r["estimate"] == 0.25 for r in b.collect()) and b.count() == 2
    assert headline(b, ["target"]).first()["clustering"] == "session"


def test_a_long_chain_settles(spark):
    """300 events, each sharing a cluster with the one before and a session with the one after, the latest partition at one end; null keys link nothing."""
    rows = [(i, f"c{(i + 1) // 2}", f"s{i // 2}", 2 if i == 0 else 0) for i in range(300)] + [(900, None, None, 1), (901, None, None, 0), (902, None, "s0", 0)]
    got = {r["event_id"]: r["part"] for r in U.connected_partitions(spark.createDataFrame(rows, "event_id int, cluster_id string, reaction_session string, part int")).collect()}
    assert all(got[i] == 2 for i in range(300)) and (got[900], got[901], got[902]) == (1, 0, 2)


def test_ends_in_the_year_9999(spark):
    """An end however far away answers like an open one, without a row per day."""
    day = 86400
    feats = [("A", "x", f"{i}", float(i), i * day, i * day, i * day, None, None) for i in range(3)]
    f = stamp(spark.createDataFrame(feats, "security_id string, name string, revision_id string, value double, available_at long, first_seen_at long, valid_from long, valid_to long, label_available_at long"), "available_at", "first_seen_at", "valid_from", "label_available_at")
    f = f.withColumn("valid_to", F.when(F.col("revision_id") == "1", F.timestamp_seconds(F.lit(T0 + 40 * day + 5))).otherwise(F.to_timestamp(F.lit("9999-12-31 00:00:00"))))
    asks = [0, day - 1, day, 40 * day, 40 * day + 5, 4000 * day]
    got = {r["c"] - T0: r["revision_id"] for r in A.asof_features(stamp(spark.createDataFrame([("A", a) for a in asks], "security_id string, cutoff long"), "cutoff"), f).withColumn("c", F.unix_seconds("cutoff")).collect()}
    assert got == {0: "0", day - 1: "0", day: "1", 40 * day: "2", 40 * day + 5: "2", 4000 * day: "2"}
    from tidemark.operators.asof import canonical_blocks
    for low, high in ((0, 1), (5, 5), (3, 17), (1, 2932897), (8, 16), (-7, 9)):
        blocks = spark.sql(f"SELECT {low}L a, {high}L b").select(F.explode(canonical_blocks(F.col("a"), F.col("b"))).alias("c")).select("c.*").collect()
        assert len(blocks) <= 46 and sum(2 ** r["level"] for r in blocks) == high - low
        if high - low < 100:
            assert sorted(x for r in blocks for x in range(r["block"] << r["level"], (r["block"] + 1) << r["level"])) == list(range(low, high))


def test_spans_with_far_or_open_ends(spark):
    w = spark.sql("SELECT 1 id, 'k' key, date'2024-01-05' a, date'2024-01-08' b UNION ALL SELECT 2, 'k', date'2023-01-11', date'2023-01-12' UNION ALL SELECT 3, 'j', date'9000-01-05', date'9999-12-31'")
    s = spark.sql("SELECT 'k' key, date'2024-01-08' s, date'9999-12-31' e UNION ALL SELECT 'j', date'2024-01-08', null UNION ALL SELECT 'k', null, date'2024-01-01'")
    assert sorted(r["id"] for r in overlaps(w, s, "key", ("a", "b"), ("s", "e")).collect()) == [1, 3]


def test_features_long_after_and_before_the_sessions(spark):
    from tidemark.plans import structure as S
    sessions = spark.sql("SELECT date_add(date'2024-01-01', cast(id as int)) session, cast(id as int) idx FROM range(3)")
    table = sessions.select(F.lit("a").alias("security_id"), "idx", "session", F.lit(None).cast("string").alias("why_f"), F.col("idx").cast("double").alias("f"))
    e = spark.sql("SELECT 'a' security_id, date_add(date'2024-01-01', cast(d as int)) day, d FROM (SELECT explode(array(-3, 0, 1, 2, 3, 60, 4000)) d)")
    got = {r["d"]: (r["f"], r["why_f"]) for r in S.structure_features(e, table, sessions).collect()}
    assert got == {-3: (None, "insufficient_history"), 0: (None, "insufficient_history"), 1: (0.0, None), 2: (1.0, None), 3: (2.0, None), 60: (2.0, None), 4000: (2.0, None)}


def test_thresholds_are_exact(spark):
    from tidemark.plans.outcomes import ge_pct
    rows = [(1.029999996, 1.0, False), (1.03, 1.0, True), (103.0, 100.0, True), (1.03e12, 1e12, True), (1.0299999e15, 1e15, False), (0.0103, 0.01, True), (3e-9, 1e-9, True)]
    got = [r[0] for r in spark.createDataFrame([(p, b) for p, b, _ in rows], "p double, b double").select(ge_pct(F.col("p"), F.col("b"), 3)).collect()]
    assert got == [w for _, _, w in rows]


def test_unpaired_events_blank_a_contrast(spark):
    from tidemark.plans.metrics import contrasts
    rows = [("t", "v", 1, "e1", "m", 0.3), ("t", "v", 1, "e1", "b", 0.1), ("t", "v", 2, "e2", "m", 0.3), ("t", "v", 2, "e2", "b", 0.2), ("t", "v", 2, "e3", "m", 0.9)]
    got = {r["scope"]: (r["events"], r["unpaired"], r["estimate"]) for r in contrasts(spark.createDataFrame(rows, "target string, version string, fold int, event_id string, predictor string, loss double"), [("m", "b")]).collect()}
    assert got["fold 1"] == (1, 0, pytest.approx(0.2)) and got["fold 2"] == (1, 1, None) and got["pooled"] == (2, 1, None)


def test_unscored_events_blank_their_group(spark):
    from tidemark.plans.metrics import mse_reduction, regression_metrics
    from tidemark.plans.models import ablate
    rows = [("g", 1.0, [0.0, 1.0, 2.0]), ("g", 2.0, [0.0, 1.0, 2.0]), ("h", 1.0, [0.0, 1.0, 2.0]), ("h", 3.0, None), ("i", 1.0, None)]
    got = {r["k"]: (r["n"], r["unscored"], r["mae_of_the_median"], r["mean_pinball"] is None) for r in regression_metrics(spark.createDataFrame(rows, "k string, y double, q array<double>"), ["k"]).collect()}
    assert got == {"g": (2, 0, pytest.approx(0.5), False), "h": (1, 1, None, True), "i": (0, 1, None, True)}
    rows = [("g", 1.0, 0.0, 1.0), ("h", 1.0, 0.0, 1.0), ("h", 1.0, None, None), ("h", 1.0, 0.0, None)]
    got = {r["k"]: (r["pairs"], r["unscored"], r["baseline_mse"], r["relative_reduction"]) for r in mse_reduction(spark.createDataFrame(rows, "k string, y double, baseline double, challenger double"), ["k"]).collect()}
    assert got == {"g": (1, 0, 1.0, 1.0), "h": (1, 2, None, None)}
    losses = spark.createDataFrame([("g", 1.0), ("h", 1.0), ("h", None)], "k string, loss double")
    got = {r["k"]: (r["n"], r["unscored"], r["loss_difference"]) for r in ablate(losses, {"a": ["x"]}, ["x", "z"], ["k"], lambda rows, kept: None, lambda rows, model, kept: rows).collect()}
    assert got == {"g": (1, 0, 0.0), "h": (1, 1, None)}


def test_nested_cap_needs_the_looser_prediction(spark):
    from tidemark.plans.folds import cap_nested
    loose = spark.createDataFrame([(1, 0.4), (2, 0.9)], "id int, p double")
    tight = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "id int, p double")
    run = lambda **k: {r["id"]: (r["p"], r["repaired"], r["looser_missing"]) for r in cap_nested(loose, tight, ["id"], **k).collect()}
    assert run() == {1: (0.4, True, False), 2: (0.5, False, False), 3: (None, False, True)}
    assert run(missing="keep")[3] == (0.5, False, True)


def test_character_references(spark):
    import html as H
    from tidemark.sources.documents import html_lines
    texts = ["a&mdash;b&rsquo;s &#8217;q&#x1F600; &#150; &copy &amp;amp; &unknown; &#0; &#xD800; &Eacute;t&eacute; &ngE; &", "one&nbsp;&#160; \u00a0two | x"]
    got = [r["line"] for r in html_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id int, html string"), keep=("page_id",)).orderBy("page_id").collect()]
    assert got[1] == "one two | x"
    assert got[0].split() == [w for w in H.unescape(texts[0].replace("&copy ", "COPY ")).replace("COPY", "&copy").split()]


def test_listing_rules(spark, tmp_path):
    from tidemark.sources.documents import read_listing
    f = tmp_path / "listing.txt"
    f.write_text("name|symbol\nsymbol row|symbol\nFile Creation Time: none|x\nno symbol|\nx|A\ny|A\nFile Creation Time: 0101202400:00|\n")
    got = sorted(map(tuple, read_listing(spark, str(f), ["symbol", "name"]).collect()), key=str)
    assert [(r[1], r[2]) for r in got] == [("x", "DUPLICATE_SYMBOL"), ("y", "DUPLICATE_SYMBOL"), ("symbol row", None), ("File Creation Time: none", None), ("no symbol", "MISSING_SYMBOL")]
    f.write_text("symbol|name\nA|x\n")
    with pytest.raises(ValueError):
        read_listing(spark, str(f), ["symbol", "name"])


def test_sizes_for_a_halfwidth(spark):
    from tidemark.plans.metrics import sizes_for_halfwidth
    z = 1.959963984540054

    def width(k, n):
        p = k / n
        return z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    got = {r["width"]: r["n_needed"] for r in sizes_for_halfwidth(spark).collect()}
    assert got == {w: next(n for n in range(2, 3000) if width(n // 2, n) <= w) for w in (0.10, 0.15, 0.20)}


def test_overlaps_closed_intervals(spark):
    w = spark.sql("SELECT 1 id, 'k' key, date'2024-01-05' a, date'2024-01-08' b UNION ALL SELECT 2, 'k', date'2024-01-11', date'2024-01-12' UNION ALL SELECT 3, 'z', date'2024-01-05', date'2024-01-08'")
    s = spark.sql("SELECT 'k' key, date'2024-01-08' s, date'2024-01-10' e")
    assert [r["id"] for r in overlaps(w, s, "key", ("a", "b"), ("s", "e")).collect()] == [1]


def test_name_matching_against_brute_force(spark):
    names = ["LensAR Incorporated", "LENSAR", "Acme", "Ac", "Big Acme Group", "", "Beta Corp.", "alphabeta", "Gamma LLC", "a"]
    comps = ["LENSAR", "acme inc", "beta", "gam", "Zeta", "a co"]
    norm = lambda x: __import__("re").sub(r"[,.]?\s*(inc|incorporated|corp|corporation|co|ltd|llc)\.?\s*$", "", x.strip().lower()).strip()
    want = {(n, c) for n in names for c in comps if norm(n) and norm(c) and (norm(n) in norm(c) or norm(c) in norm(n))}
    r = spark.createDataFrame([(n,) for n in names], "name string")
    c = spark.createDataFrame([(x,) for x in comps], "company string")
    assert {tuple(x) for x in E.match_names(r, c, "name", "company").select("name", "company").collect()} == want


def design(spark, n=400):
    rnd = np.random.default_rng(2)
    x = rnd.normal(0, 1, (n, 2))
    y = (rnd.random(n) < 1 / (1 + np.exp(-(0.4 + 1.1 * x[:, 0] - 0.7 * x[:, 1])))).astype(float)
    rows = [("g", "train" if i % 5 else "test", f"E{i:04d}", float(y[i]), float(x[i, 0]), float(x[i, 1]), 3.0) for i in range(n)]
    return spark.createDataFrame(rows, "k string, role string, event_id string, y double, a double, b double, constant double")


def test_logistic_gradient_vanishes_and_constant_columns_drop(spark):
    feats = ["a", "b", "constant"]
    z = M.standardize(design(spark), feats, ["k"])
    m = M.fit_logistic(z, feats, ["k"]).first()
    assert m["state"] == "FITTED" and m["iterations"] < 10
    t = z.filter("role = 'train'").select("y", *["z_" + f for f in feats]).toPandas()
    x = np.column_stack([np.ones(len(t)), t[["z_a", "z_b", "z_constant"]]])
    beta = np.array(m["beta"])
    p = 1 / (1 + np.exp(-x @ beta))
    grad = x.T @ (t["y"] - p) - np.array([0, 1, 1, 1]) * beta
    assert np.abs(grad).max() < 1e-7 and beta[3] == 0.0


def test_scores_of_a_feature_without_spread(spark):
    """Zero for a fit; for a report the quotient by zero, as SQL has it."""
    rows = spark.createDataFrame([("g", role, x, y) for role, x, y in (("train", 2.0, 1.0), ("train", 2.0, 0.0), ("test", 2.0, None), ("test", 5.0, None), ("test", 1.0, None), ("test", None, None))], "k string, role string, x double, y double")
    read = lambda **how: [str(r["z_x"]) for r in M.standardize(rows, ["x"], ["k"], **how).orderBy("role", "x").collect()]
    assert read() == ["0.0"] * 6 and read(undefined=True) == ["None", "-inf", "nan", "inf", "nan", "nan"]


def test_a_target_without_a_defined_event_has_no_lower_bound(spark):
    rows = spark.createDataFrame([("none", None), ("none", None), ("some", 1.0), ("some", 0.0)], "target string, y double").selectExpr("*", "1 reaction_idx", "'c' cik", "'premarket' timing")
    got = {r["target"]: r for r in S.target_summary(rows).collect()}
    assert (got["none"]["n_defined"], got["none"]["base_rate"], str(got["none"]["wilson_low"]), got["none"]["wilson_high"], got["none"]["bucket"]) == (0, None, "nan", 1.0, "insufficient")
    assert got["some"]["base_rate"] == 0.5 and 0 < got["some"]["wilson_low"] < 0.5 < got["some"]["wilson_high"] < 1


def test_ridge_matches_the_closed_form_and_forecasts_have_three_levels(spark):
    feats = ["a", "b"]
    z = M.standardize(design(spark), feats, ["k"])
    m = M.fit_ridge(z, feats, ["k"])
    t = z.filter("role = 'train'").select("y", "z_a", "z_b").toPandas()
    x = np.column_stack([np.ones(len(t)), t[["z_a", "z_b"]]])
    want = np.linalg.solve(x.T @ x + np.diag([0.0, 1.0, 1.0]), x.T @ t["y"])
    np.testing.assert_allclose(m.first()["beta"], want, atol=1e-9)
    q = M.quantile_forecast(z.filter("role = 'test'"), m, M.residual_quantiles(z, m, feats, ["k"]), feats, ["k"]).select("q").first()["q"]
    assert len(q) == 3 and q[0] < q[1] < q[2]


def test_failed_class_support_leaves_predictions_null(spark):
    z = M.standardize(design(spark).withColumn("y", F.lit(1.0)), ["a"], ["k"])
    m = M.fit_logistic(z, ["a"], ["k"])
    assert m.first()["state"] == "INSUFFICIENT_DATA" and M.predict(z, m, ["a"], ["k"], "logit").filter("p is not null").count() == 0


def test_permutation_keeps_the_values_and_user_predictors_never_see_labels(spark):
    d = design(spark)
    p = M.permuted(d, "a", ["k"], seed=4)
    assert sorted(r[0] for r in p.select("a").collect()) == sorted(r[0] for r in d.select("a").collect())
    assert p.count() == d.count() and p.join(d.select("event_id", F.col("a").alias("a0")), "event_id").filter("a <> a0").count() > 300

    class Peeker:
        def partial(self, train):
            return {"n": len(train), "s": train["y"].sum()}

        def finish(self, stats):
            return stats["s"] / stats["n"]

        def predict(self, model, view):
            assert "y" not in view.columns
            return [model] * len(view)

    out = M.fit_groups(d.repartition(6), Peeker(), ["k"]).collect()
    want = d.filter("role = 'train'").agg(F.avg("y")).first()[0]
    assert len(out) == 80 and all(r["p"] == pytest.approx(want) for r in out)
