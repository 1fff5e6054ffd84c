"""P11. Trees, forests and boosting for all groups of rows at once.

Groups (target, version, fold, and the settings of a fit such as its depth or the number of a tree) are keys of one table, and one aggregate per level of depth makes the histograms of
every open node of every group: per bin of a feature how many rows, their sum, and the least and largest value. The best split of a node comes from running sums over its bins. Rows
never move; where a row stands follows from its group's few nodes. Outcomes may be 0/1 or numbers: squared error serves both.
"""
import math

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.numeric import clip_rate, logit, sigmoid
from tidemark.functions.text import hash_draw
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.ranking import prefix_sums
from tidemark.runtime import written

NODE = "struct<f:int,t:double,value:double,n:double>"
DRAWS = 1 << 32


def binned(rows: DataFrame, features, keys, bins=64, keep=()) -> DataFrame:
    """keys, role, y, `keep`, `x` (the features in the order of their names) and `b` (their bins), ready for `grow`.

    Each training value of a feature is a bin of its own where the group has at most `bins` of them; otherwise bins hold about equally many rows. Features must have no nulls (see `encode`).
    """
    names, keys = sorted(features), list(keys)
    x = F.array(*[F.col(f).cast("double") for f in names])
    each = rows.filter("role = 'train' and y is not null").select(*keys, F.posexplode(x).alias("_f", "_v")).groupBy(*keys, "_f", "_v").agg(F.count(F.lit(1)).alias("_c"))
    total = each.groupBy(*keys, "_f").agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
    run = prefix_sums(each.withColumns({"_upto": F.col("_c"), "_nth": F.lit(1).cast("long")}), [F.asc("_v")], ["_upto", "_nth"], [*keys, "_f"]).join(total, [*keys, "_f"])
    bin_of = F.when(F.col("_d") <= bins, F.col("_nth") - 1).otherwise(F.floor((F.col("_upto") - F.col("_c")) * bins / F.col("_n")))
    edges = run.groupBy(*keys, "_f", bin_of.alias("_b")).agg(F.max("_v").alias("_v")).groupBy(*keys, "_f").agg(F.array_sort(F.collect_list("_v")).alias("_e")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_f", "_e"))).alias("_edges"))
    below = lambda v, f: F.size(F.filter(F.element_at("_edges", f), lambda e: e < v))
    return rows.withColumn("x", x).join(edges, keys).withColumn("b", F.transform("x", below)).select(*keys, "role", "y", *keep, "x", "b")


def _walk(nodes, x, depth):
    """The node that x reaches in at most `depth` steps."""
    at = F.lit(1)
    for _ in range(depth):
        split = F.try_element_at(nodes, at)
        right = (F.get(x, split["f"]) > split["t"]).cast("int")
        at = F.when(split["f"].isNull(), at).otherwise(at * 2 + right)
    return at


def tree_value(nodes, x, depth):
    """What a tree of at most `depth` levels says about x; a tree cut at a lesser depth is the tree grown to that depth."""
    return F.try_element_at(nodes, _walk(nodes, x, depth))["value"]


def grow(rows: DataFrame, keys, depth: int, minimum_leaf=10, y="y", weight=None, subset=None) -> DataFrame:
    """(keys, nodes): one tree per group, by least squared error, as a map from node number (root 1, children 2i and 2i + 1) to feature, threshold, mean and number of rows.

    `rows` have keys, x, b and y; `weight` counts a row several times. A split leaves `minimum_leaf` rows on both sides and gains something; of equal gains (ten digits) the first feature
    by name and then the least threshold is taken. A threshold lies midway between the neighbouring values in the node. `subset` (Column, number) draws so many features for each node by
    content hash of the Column and the node.
    """
    keys = list(keys)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    data = rows.filter(F.col(y).isNotNull()).select(*keys, "x", "b", F.col(y).cast("double").alias("_y"), w.alias("_w"), *([subset[0].alias("_s")] if subset else []))
    trees = data.groupBy(*keys).agg((F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).alias("v"), F.sum("_w").alias("n")).select(
        *keys, F.create_map(F.lit(1), F.struct(F.lit(None).cast("int").alias("f"), F.lit(None).cast("double").alias("t"), F.col("v").alias("value"), F.col("n").alias("n")).cast(NODE)).alias("nodes"))
    trees = written(trees)
    for level in range(depth):
        placed = data.join(trees, keys).withColumn("node", _walk(F.col("nodes"), F.col("x"), level)).filter(F.col("node") >= 1 << level)
        if subset:
            order = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda f: F.struct(hash_draw(DRAWS, F.col("_s"), F.col("node"), f).alias("h"), f.alias("f")))
            placed = placed.withColumn("_open", F.transform(F.slice(F.array_sort(order), 1, subset[1]), lambda s: s["f"]))
        long = placed.select(*keys, "node", "_y", "_w", *(["_open"] if subset else []), F.posexplode(F.arrays_zip("x", "b")).alias("f", "_z"))
        if subset:
            long = long.filter(F.array_contains("_open", F.col("f")))
        hist = long.groupBy(*keys, "node", "f", F.col("_z.b").alias("b")).agg(F.sum("_w").alias("c"), F.sum(F.col("_w") * F.col("_y")).alias("s"), F.min("_z.x").alias("lo"), F.max("_z.x").alias("hi"))
        line = W.partitionBy(*keys, "node", "f").orderBy("b")  # one row a bin
        run = hist.select("*", F.sum("c").over(line).alias("lc"), F.sum("s").over(line).alias("ls"), F.sum("c").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("tc"),
                          F.sum("s").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("ts"), F.lead("lo").over(line).alias("nxt"))
        rc, rs, mean = F.col("tc") - F.col("lc"), F.col("ts") - F.col("ls"), F.col("ts") / F.col("tc")
        gain = F.round(F.col("lc") * F.pow(F.col("ls") / F.col("lc") - mean, 2) + rc * F.pow(rs / rc - mean, 2), 10)
        able = run.filter((F.col("lc") >= minimum_leaf) & (rc >= minimum_leaf)).withColumn("gain", gain).filter("gain > 0")
        middle = F.col("hi") / 2 + F.col("nxt") / 2
        best = able.groupBy(*keys, "node").agg(F.max_by(F.struct("f", F.when(middle < F.col("nxt"), middle).otherwise(F.col("hi")).alias("t"), "lc", "ls", "tc", "ts"), F.struct("gain", -F.col("f"), -F.col("b"))).alias("p"))
        p = lambda c: F.col("p." + c)
        leaf = lambda at, value, n: F.struct(at.alias("node"), F.struct(F.lit(None).cast("int").alias("f"), F.lit(None).cast("double").alias("t"), value.alias("value"), n.alias("n")).cast(NODE).alias("d"))
        made = F.array(F.struct(F.col("node"), F.struct(p("f").alias("f"), p("t").alias("t"), (p("ts") / p("tc")).alias("value"), p("tc").alias("n")).cast(NODE).alias("d")),
                       leaf(F.col("node") * 2, p("ls") / p("lc"), p("lc")), leaf(F.col("node") * 2 + 1, (p("ts") - p("ls")) / (p("tc") - p("lc")), p("tc") - p("lc")))
        new = best.groupBy(*keys).agg(F.flatten(F.collect_list(made)).alias("_new"))  # a few nodes per group
        replaced = F.map_filter("nodes", lambda k, _: ~F.exists("_new", lambda e: e["node"] == k))
        trees = written(trees.join(new, keys, "left").select(*keys, F.when(F.col("_new").isNull(), F.col("nodes")).otherwise(F.map_concat(replaced, F.map_from_entries("_new"))).alias("nodes")))
    return trees


def forest(rows: DataFrame, keys, depth: int, seed: int, trees=20, minimum_leaf=10, id_col="event_id") -> DataFrame:
    """(keys, nodes): arrays of `trees` trees on rows counted as often as a draw with replacement would take them (Poisson by content hash), each node choosing among the whole root of the features."""
    numbered = rows.filter("role = 'train' and y is not null").withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    u = hash_draw(DRAWS, F.lit(seed), "_tree", id_col) / DRAWS
    cut, part, times = 0.0, math.exp(-1), F.lit(0)
    for k in range(1, 14):  # the chance of a fourteenth copy is below 2 ** -32
        cut += part
        part /= k
        times = times + (u >= cut).cast("int")
    names = rows.first()["x"] if rows.take(1) else []
    drawn = numbered.withColumn("_times", times).filter("_times > 0")
    grown = grow(drawn, [*keys, "_tree"], depth, minimum_leaf, weight="_times", subset=(F.concat_ws("|", F.lit(str(seed)), F.col("_tree").cast("string")), max(1, math.isqrt(len(names)))))
    return grown.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_tree", F.map_entries("nodes").alias("e")))), lambda s: F.map_from_entries(s["e"])).alias("nodes"))


def forest_value(nodes, x, depth):
    return F.aggregate(nodes, F.lit(0.0), lambda total, tree: total + tree_value(tree, x, depth)) / F.size(nodes)


def boosting(rows: DataFrame, keys, depth: int, binary: bool, rounds=20, rate=0.1, minimum_leaf=10) -> DataFrame:
    """(keys, start, nodes): trees fitted one after the other to what is left of the outcome; scores are logits for a binary outcome. Rows carry their score from round to round."""
    keys = list(keys)
    train = rows.filter("role = 'train' and y is not null")
    start = train.groupBy(*keys).agg(F.avg("y").alias("start"))
    if binary:
        start = start.withColumn("start", logit(clip_rate("start")))
    start = written(start)
    shape = lambda c: sigmoid(c) if binary else c
    scored, out = written(train.join(start, keys).select(*keys, "x", "b", "y", F.col("start").alias("score"))), None
    for number in range(rounds):
        grown = grow(scored.withColumn("_left", F.col("y") - shape(F.col("score"))), keys, depth, minimum_leaf, y="_left")
        part = grown.select(*keys, F.lit(number).alias("_round"), "nodes")
        out = part if out is None else out.unionByName(part)
        if number + 1 < rounds:
            scored = written(scored.join(grown, keys).withColumn("score", F.col("score") + rate * tree_value(F.col("nodes"), F.col("x"), depth)).drop("nodes"))
    listed = out.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_round", F.map_entries("nodes").alias("e")))), lambda s: F.map_from_entries(s["e"])).alias("nodes"))
    return listed.join(start, keys)


def boosting_value(start, nodes, x, depth, binary, rate=0.1):
    score = start + rate * F.aggregate(nodes, F.lit(0.0), lambda total, tree: total + tree_value(tree, x, depth))
    return sigmoid(score) if binary else score


FAMILIES = ("single_tree", "random_forest", "gradient_boosting", "equal_weight_ensemble")


def tree_predictions(rows: DataFrame, features, keys, families=FAMILIES, depths=(1, 2), binary=True, seed=17, minimum_leaf=10, trees=20, rounds=20, rate=0.1, bins=64, keep=("event_id",)) -> DataFrame:
    """Every row, training and test, with `p` of each family and depth; groups are fitted together, one row of keys each. The ensemble is the mean of forest and boosting."""
    keys = list(keys)
    data = written(binned(rows, features, keys, bins, keep))
    train = data.filter("role = 'train' and y is not null")
    need = set(families) | ({"random_forest", "gradient_boosting"} if "equal_weight_ensemble" in families else set())
    fits = {}
    if "single_tree" in need:
        fits["single_tree"] = grow(train, keys, max(depths), minimum_leaf).withColumnRenamed("nodes", "_single")
    if "random_forest" in need:  # a shallower forest is the deeper one, cut
        fits["random_forest"] = forest(data, keys, max(depths), seed, trees, minimum_leaf, keep[0]).withColumnRenamed("nodes", "_forest")
    if "gradient_boosting" in need:
        for d in depths:
            fits["gradient_boosting", d] = boosting(data, keys, d, binary, rounds, rate, minimum_leaf).select(*keys, F.col("start").alias(f"_start{d}"), F.col("nodes").alias(f"_boosted{d}"))
    out = data
    for fit in fits.values():
        out = out.join(fit, keys, "left")
    x, made = F.col("x"), []
    for d in depths:
        p = {}
        if "single_tree" in need:
            p["single_tree"] = tree_value(F.col("_single"), x, d)
        if "random_forest" in need:
            p["random_forest"] = forest_value(F.col("_forest"), x, d)
        if "gradient_boosting" in need:
            p["gradient_boosting"] = boosting_value(F.col(f"_start{d}"), F.col(f"_boosted{d}"), x, d, binary, rate)
        if "equal_weight_ensemble" in families:
            p["equal_weight_ensemble"] = (p["random_forest"] + p["gradient_boosting"]) / 2
        made += [F.struct(F.lit(f).alias("family"), F.lit(d).alias("depth"), p[f].alias("p")) for f in families]
    return out.select(*keys, "role", "y", *keep, F.inline(F.array(*made)))


def tree_quantiles(predictions: DataFrame, keys, levels=(0.1, 0.5, 0.9)) -> DataFrame:
    """Test rows of a regression with `q`: the prediction shifted by the quantiles of the training residuals of its group, family and depth."""
    by = [*keys, "family", "depth"]
    shifts = exact_quantiles(predictions.filter("role = 'train' and y is not null").withColumn("residual", F.col("y") - F.col("p")), by, "residual", levels, out="_q").drop("n")
    return predictions.filter("role = 'test'").join(shifts, by, "left").withColumn("q", F.transform("_q", lambda s: s + F.col("p"))).drop("_q")
