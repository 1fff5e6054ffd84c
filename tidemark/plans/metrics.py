"""Losses, ranking metrics, cluster bootstrap, contrasts and decision gates over a prediction table.

A prediction row is (target, version, fold, event_id, session, issuer, y, p, base_rate); quantile forecasts carry an array instead of p.
"""
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.numeric import normal_quantile, wilson_high, wilson_low
from tidemark.functions.text import hash_draw
from tidemark.operators.ranking import average_precision, equal_bins, positions, top_k
from tidemark.runtime import written

CLIP = 1e-6
BLOCKS = 64
QUANTILES = (0.1, 0.5, 0.9)


def event_brier(p, y) -> Column:
    return F.pow(F.col(p) - F.col(y), 2)


def event_log_loss(p, y, clip=CLIP) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    return F.when(F.col(y) > 0, -F.log(q)).otherwise(-F.log(1 - q))


def pinball(y: Column, forecast: Column, level: float) -> Column:
    e = y - forecast
    return F.greatest(level * e, (level - 1) * e)


def event_pinball(y, q, levels=QUANTILES) -> Column:
    return sum((pinball(F.col(y), F.element_at(q, i + 1), level) for i, level in enumerate(levels)), F.lit(0.0)) / len(levels)


def binary_metrics(preds: DataFrame, by) -> DataFrame:
    """X1, X3. Brier, log loss and the confusion counts at each row's own threshold."""
    called, pos = F.col("p") >= F.col("base_rate"), F.col("y") > 0
    g = preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(event_brier("p", "y")).alias("brier"), F.avg(event_log_loss("p", "y")).alias("log_loss"),
                               F.count_if(pos & called).alias("tp"), F.count_if(pos & ~called).alias("fn"), F.count_if(~pos & called).alias("fp"), F.count_if(~pos & ~called).alias("tn"))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return g.withColumn("fpr", rate("fp", "tn")).withColumn("fnr", rate("fn", "tp"))


def regression_metrics(preds: DataFrame, by, levels=QUANTILES) -> DataFrame:
    """X2. Pinball loss by level and on average, interval coverage, mean absolute error of the median.

    `n` counts the scored events; those without a forecast are counted as unscored, and a group with such an event has no metrics.
    """
    each = [F.avg(pinball(F.col("y"), F.element_at("q", i + 1), level)).alias(f"pinball_{int(level * 100)}") for i, level in enumerate(levels)]
    inside = (F.col("y") >= F.element_at("q", 1)) & (F.col("y") <= F.element_at("q", len(levels)))
    mid = levels.index(0.5) + 1
    scored = F.element_at("q", mid).isNotNull()  # an array of nulls is no forecast either
    g = preds.groupBy(*by).agg(F.count_if(scored).alias("n"), F.count_if(~F.coalesce(scored, F.lit(False))).alias("unscored"), F.avg(event_pinball("y", "q", levels)).alias("mean_pinball"), *each,
                               F.avg(inside.cast("double")).alias("interval_coverage"), F.avg(F.abs(F.col("y") - F.element_at("q", mid))).alias("mae_of_the_median"))
    return blank_unscored(g, [c for c in g.columns if c not in (*by, "n", "unscored")])


def blank_unscored(groups: DataFrame, metrics) -> DataFrame:
    """Groups with an unscored event keep their counts and lose their metrics."""
    return groups.withColumns({c: F.when(F.col("unscored") == 0, F.col(c)) for c in metrics})


def pooled_by_fold_and_source(preds: DataFrame, keys=("target", "version")) -> DataFrame:
    """X10. The same metrics pooled, by fold and by source, in one pass over three labelled copies of each row (GROUPING SETS)."""
    scope = F.array(*[F.struct(F.lit(s).alias("scope"), v.alias("scope_key")) for s, v in (("pooled", F.lit("*")), ("fold", F.col("fold").cast("string")), ("source", F.col("source")))])
    return binary_metrics(preds.withColumn("_s", F.explode(scope)).select("*", "_s.*"), [*keys, "scope", "scope_key"])


def reliability(preds: DataFrame, by, z=None) -> DataFrame:
    """W14. Equal-frequency bins with mean prediction, observed rate and its Wilson interval."""
    z = z or normal_quantile(0.95)
    binned = equal_bins(preds, "p", "event_id", by)
    g = binned.filter("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_prediction"), F.sum("y").alias("k"))
    return (g.withColumn("observed_rate", F.col("k") / F.col("n")).withColumn("wilson_low", wilson_low("k", "n", z)).withColumn("wilson_high", wilson_high("k", "n", z)).drop("k"))


def precision_at_k(preds: DataFrame, ks, by) -> DataFrame:
    """O3. Share of positives among the k highest scores (ties by event id); only where a group holds at least 2k rows."""
    top = top_k(preds, [F.desc("p"), F.asc("event_id")], max(ks), by)
    sizes = preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("base_rate").alias("base_rate"))
    out = top.groupBy(*by).agg(*[F.sum(F.when(F.col("rank") <= k, F.col("y"))).alias(f"s{k}") for k in ks]).join(sizes, list(by))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"s{k}") / k).alias("precision")) for k in ks])
    return out.select(*by, "n", "base_rate", F.explode(rows).alias("_r")).select(*by, "n", "base_rate", "_r.*").filter(F.col("n") >= 2 * F.col("k"))


def random_precision(preds: DataFrame, k: int, by, seed: int, rankings=1000) -> DataFrame:
    """O5. Precision at k of seeded random rankings: mean and the 2.5th and 97.5th percentiles; only where a group holds at least 2k rows, as for O3.

    Rows are numbered once by event. A ranking takes k different numbers, one a place: the place s of n draws from the s+1 numbers up to n - k + s by content hash, and takes n - k + s itself
    where an earlier place has its draw. Every set of k is equally likely, no draw is wasted, and any engine repeats it. So n + 1000k rows move, not 1000n.
    """
    keys = list(by)
    numbered = written(positions(preds.select(*keys, "event_id", "y"), [F.asc("event_id")], keys).withColumnRenamed("group_n", "_n"))
    groups = numbered.groupBy(*keys).agg(F.max("_n").alias("_n")).filter(F.col("_n") >= 2 * k)
    rankings_of = groups.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(rankings - 1))))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: hash_draw(F.col("_n") - k + s + 1, F.lit(seed), "replicate", s))
    place = lambda taken, s: F.col("_n") - k + s
    step = lambda taken, d: F.concat(taken, F.array(F.when(F.array_contains(taken, d), place(taken, F.size(taken))).otherwise(d)))
    taken = rankings_of.withColumn("position", F.explode(F.aggregate(drawn, F.array().cast("array<bigint>"), step)))
    per = taken.join(numbered.select(*keys, "position", "y"), [*keys, "position"]).groupBy(*keys, "replicate").agg((F.sum("y") / k).alias("v"))
    return per.groupBy(*keys).agg(F.avg("v").alias("random_mean"), F.percentile("v", F.lit(0.025)).alias("random_low"), F.percentile("v", F.lit(0.975)).alias("random_high"))  # `rankings` values a group


def lift(precision: DataFrame, random: DataFrame, by) -> DataFrame:
    """O4. Precision over the base rate and over a random ranking."""
    return precision.join(random, list(by), "left").withColumn("lift_over_base", F.col("precision") / F.nullif("base_rate", F.lit(0.0))).withColumn("lift_over_random", F.col("precision") / F.nullif("random_mean", F.lit(0.0)))


def pair_predictions(a: DataFrame, b: DataFrame, keys=("target", "version", "fold", "event_id")) -> DataFrame:
    """J18. Two predictors on the same events; `paired` is false where either side is missing, which a comparison refuses."""
    left = a.select(*keys, F.col("loss").alias("loss_a"), F.lit(True).alias("_a"), "session", "issuer")
    right = b.select(*keys, F.col("loss").alias("loss_b"), F.lit(True).alias("_b"))
    return (left.join(right, list(keys), "full_outer").withColumn("paired", F.col("_a").isNotNull() & F.col("_b").isNotNull())
            .withColumn("difference", F.col("loss_a") - F.col("loss_b")).drop("_a", "_b"))


MOST_CLUSTERS = 1 << 20  # clusters of all groups whose sums (16 bytes each) are sent to every executor; beyond it drawn clusters are met by a join


def cluster_bootstrap(diffs: DataFrame, by, axes=("session", "issuer"), seed=0, replicates=5000, levels=(0.95, 0.99), most_clusters=MOST_CLUSTERS) -> DataFrame:
    """X4. Percentile bootstrap of the mean difference, whole clusters drawn with replacement, on each clustering axis.

    Differences are first summed per cluster, so replicates touch clusters and not events. Every cluster row supplies one draw slot per replicate; the cluster drawn is a content hash of
    (seed, replicate, slot) modulo the number of clusters. Up to `most_clusters` clusters a task adds what its slots draw to one array of `replicates` sums per group, from the sums of all
    clusters: what is shuffled is one array a task, however many clusters there are. Beyond that the draws are rows and meet their clusters by equality, with the same answers.
    """
    keys = [*by, "axis"]
    axis = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("cluster")) for a in axes])
    sums = (diffs.withColumn("_x", F.explode(axis)).groupBy(*by, "_x.axis", "_x.cluster").agg(F.sum("difference").cast("double").alias("total"), F.count(F.lit(1)).alias("size")))
    numbered = written(positions(sums, [F.asc("cluster")], keys, out="j"))  # read as slots and as targets
    draw = _replicates_in_arrays if numbered.count() <= most_clusters else _replicates_by_join
    means = draw(numbered, keys, seed, replicates)
    cuts = [((1 - lv) / 2, 1 - (1 - lv) / 2) for lv in levels]
    bands = means.groupBy(*keys).agg(*[F.percentile("m", F.lit(c)).alias(f"{n}_{int(lv * 100)}") for lv, pair in zip(levels, cuts) for n, c in zip(("low", "high"), pair)])  # `replicates` values a group
    base = numbered.groupBy(*keys).agg((F.sum("total") / F.sum("size")).alias("estimate"), F.sum("size").alias("events"), F.count(F.lit(1)).alias("clusters"))
    return base.join(bands, keys)


def _replicates_in_arrays(numbered, keys, seed, replicates):
    """(keys, replicate, m) from additive arrays: each task sums what its own slots draw, replicate by replicate."""
    spark = numbered.sparkSession
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    held = {}
    for row in numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", "total", "size"))).alias("c")).collect():  # at most `most_clusters` numbers, checked
        held[tuple(row[k] for k in keys)] = np.array([x["total"] for x in row["c"]]), np.array([x["size"] for x in row["c"]], np.int64)
    types = {f.name: f.dataType.simpleString() for f in numbered.schema.fields}

    def add(batches):
        begun = [hashlib.md5(f"{seed}|{r}|".encode()) for r in range(replicates)]
        out = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key, slot = tuple(row[:-1]), str(row[-1]).encode()
                total, size = held[key]
                at = np.empty(replicates, np.int64)
                for r, start in enumerate(begun):
                    h = start.copy()
                    h.update(slot)
                    at[r] = int.from_bytes(h.digest()[:4], "big")
                at %= len(total)
                sums = out.setdefault(key, [np.zeros(replicates), np.zeros(replicates, np.int64)])
                sums[0] += total[at]
                sums[1] += size[at]
        for key, (total, size) in out.items():
            yield pd.DataFrame({**{k: [v] * replicates for k, v in zip(keys, key)}, "replicate": range(replicates), "total": total, "size": size})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", replicate int, total double, size long"
    slots = numbered.select(*keys, F.col("j").alias("slot")).repartition(parallel)  # few bytes and much to do with each
    return slots.mapInPandas(add, schema).groupBy(*keys, "replicate").agg((F.sum("total") / F.sum("size")).alias("m"))


def _replicates_by_join(numbered, keys, seed, replicates):
    """(keys, replicate, m) with one row per draw; replicates are dealt out in blocks before they are opened."""
    chunk = max(1, -(-replicates // BLOCKS))
    parallel = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number, or these few bytes would be coalesced into one task
    slots = (numbered.select(*keys, F.col("j").alias("slot"), "group_n", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // chunk))).alias("_block"))
             .repartition(parallel, *keys, "_block")
             .withColumn("replicate", F.explode(F.sequence(F.col("_block") * chunk, F.least(F.col("_block") * chunk + chunk, F.lit(replicates)) - 1)))
             .withColumn("j", hash_draw(F.col("group_n"), F.lit(seed), "replicate", "slot")))
    return slots.join(numbered.select(*keys, "j", "total", "size"), [*keys, "j"]).groupBy(*keys, "replicate").agg((F.sum("total") / F.sum("size")).alias("m"))


def headline(boot: DataFrame, by, level=99, order=("session", "issuer")) -> DataFrame:
    """X5. The wider interval over the clusterings, the first listed on a tie; and the outer envelope of all."""
    rank = F.lit(0)
    for i, name in enumerate(order):
        rank = F.when(F.col("axis") == name, -i).otherwise(rank)
    lo, hi = F.col(f"low_{level}"), F.col(f"high_{level}")
    best = F.max_by(F.struct("axis", lo.alias("low"), hi.alias("high")), F.struct(hi - lo, rank))
    return (boot.groupBy(*by).agg(best.alias("_b"), F.min(lo).alias("envelope_low"), F.max(hi).alias("envelope_high"), F.first("estimate").alias("estimate"))
            .select(*by, "estimate", F.col("_b.axis").alias("clustering"), "_b.low", "_b.high", "envelope_low", "envelope_high"))


def contrasts(losses: DataFrame, pairs, keys=("target", "version")) -> DataFrame:
    """X6. Mean loss of model minus baseline for each listed pair, pooled and per fold. `losses` is long: predictor, loss.

    An event that only one of the two scored is counted as unpaired, and a scope with such an event has no estimate; an event that neither scored does not belong to the pair.
    """
    wanted = F.array(*[F.struct(F.lit(a).alias("model"), F.lit(b).alias("baseline")) for a, b in pairs])
    names = sorted({x for pair in pairs for x in pair})
    wide = losses.groupBy(*keys, "fold", "event_id").agg(F.map_from_entries(F.collect_list(F.struct("predictor", "loss"))).alias("_m"))  # a few predictors per event
    rows = (wide.withColumn("_w", F.explode(wanted)).withColumn("_a", F.try_element_at("_m", F.col("_w.model"))).withColumn("_b", F.try_element_at("_m", F.col("_w.baseline"))).withColumn("d", F.col("_a") - F.col("_b")).filter("_a is not null or _b is not null")
            .withColumn("scope", F.explode(F.array(F.lit("pooled"), F.concat(F.lit("fold "), F.col("fold").cast("string"))))))
    return rows.groupBy(*keys, "_w.model", "_w.baseline", "scope").agg(F.count("d").alias("events"), F.count_if(F.col("d").isNull()).alias("unpaired"), F.when(F.count_if(F.col("d").isNull()) == 0, F.avg("d")).alias("estimate"))


BETTER, WORSE, UNCLEAR, INSUFFICIENT = "DISTINGUISHABLE_BETTER", "DISTINGUISHABLE_WORSE", "NOT_DISTINGUISHABLE", "INSUFFICIENT_DATA"


def decide(state="state", low="low", high="high", all_event="all_event_estimate") -> Column:
    """X7. Status of one target from its clean-window interval and its all-event estimate (model minus baseline: below zero is better)."""
    return (F.when(F.coalesce(F.col(state), F.lit("")) != "EVALUABLE", INSUFFICIENT).when((F.col(high) < 0) & (F.col(all_event) < 0), BETTER)
            .when((F.col(low) > 0) & (F.col(all_event) > 0), WORSE).otherwise(UNCLEAR))


# Floors and limits of promotion.
PROMOTION = {"rows": 200, "issuers": 30, "sessions": 10, "calibration": 0.1, "reduction": 0.0}


def promotion_gates(preds: DataFrame, by, floors=None) -> DataFrame:
    """X8. Support, calibration in the large and relative reduction of the Brier score against the baseline, per group of predictions; failed gates by name."""
    f = {**PROMOTION, **(floors or {})}
    g = preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("issuer").alias("issuers"), F.count_distinct("session").alias("sessions"), F.avg("p").alias("mean_prediction"), F.avg("y").alias("mean_outcome"),
                               (1 - F.avg(event_brier("p", "y")) / F.nullif(F.avg(event_brier("baseline", "y")), F.lit(0.0))).alias("reduction"))
    rules = [("support", F.col("n") >= f["rows"]), ("issuers", F.col("issuers") >= f["issuers"]), ("sessions", F.col("sessions") >= f["sessions"]),
             ("calibration", F.abs(F.col("mean_prediction") - F.col("mean_outcome")) <= f["calibration"]), ("reduction", F.col("reduction") >= f["reduction"])]
    return gates(g, rules)


def gates(df: DataFrame, rules) -> DataFrame:
    """X8, Q2. Named boolean gates; adds `failed_gates` (array) and `passed`. A gate that cannot be evaluated fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]))
    return df.withColumn("failed_gates", failed).withColumn("passed", F.size("failed_gates") == 0)


def mse_reduction(pairs: DataFrame, by) -> DataFrame:
    """X9. Mean squared errors of baseline and challenger, improvement and relative reduction. `pairs` counts the events that both scored; the others are counted as unscored, and a group with such an event has no metrics."""
    both = F.col("baseline").isNotNull() & F.col("challenger").isNotNull()
    g = pairs.groupBy(*by).agg(F.count_if(both).alias("pairs"), F.count_if(~both).alias("unscored"), F.avg(F.pow(F.col("y") - F.col("baseline"), 2)).alias("baseline_mse"), F.avg(F.pow(F.col("y") - F.col("challenger"), 2)).alias("challenger_mse"))
    g = blank_unscored(g, ["baseline_mse", "challenger_mse"])
    return g.withColumn("improvement", F.col("baseline_mse") - F.col("challenger_mse")).withColumn("relative_reduction", F.col("improvement") / F.nullif(F.when(F.col("baseline_mse") > 0, F.col("baseline_mse")), F.lit(0.0)))


def wilson_halfwidth(k, n, z) -> Column:
    return (wilson_high(k, n, z) - wilson_low(k, n, z)) / 2


def precision_plan(rates: DataFrame, ks=(10, 20, 40), z=None) -> DataFrame:
    """X11. Per base rate and k selected: fewest hits whose lower Wilson bound clears the base rate, and the precision and lift that means."""
    z = z or normal_quantile(0.95)
    grid = rates.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("hits", F.explode(F.sequence(F.lit(0), F.col("k"))))
    ok = grid.filter(wilson_low("hits", "k", z) > F.col("base_rate"))
    keys = [c for c in rates.columns]
    return ok.groupBy(*keys, "k").agg(F.min("hits").alias("hits_needed")).withColumn("precision_needed", F.col("hits_needed") / F.col("k")).withColumn("lift_needed", F.col("precision_needed") / F.nullif("base_rate", F.lit(0.0)))


# Improvements planned for, as shares of the comparator's score; multiples of the present number of events.
IMPROVEMENTS, MULTIPLES = (0.05, 0.10), (1, 2, 4, 8)


def interval_plan(df: DataFrame, improvements=IMPROVEMENTS, multiples=MULTIPLES) -> DataFrame:
    """X11. From events, half_width and comparator_score: the events at which each improvement equals the half-width, and the half-width's share of the score at multiples of the
    present events. Half-widths shrink with the square root of the events."""
    share = F.col("half_width") / F.nullif("comparator_score", F.lit(0.0))
    out = df.withColumn("half_width_share", share)
    for r in improvements:
        out = out.withColumn(f"events_for_{round(100 * r)}_percent", F.ceil(F.col("events") * F.pow(share / r, 2)))
    for m in multiples:
        out = out.withColumn(f"share_at_{m}x", share / math.sqrt(m))
    return out


def wilson_plan(sizes: DataFrame, rates=(0.1, 0.25, 0.5), z=None) -> DataFrame:
    """X11. Wilson half-width of an observed proportion at each sample size `n`; hits are rounded to even."""
    z = z or normal_quantile(0.95)
    grid = sizes.withColumn("rate", F.explode(F.array(*[F.lit(p) for p in rates])))
    return grid.withColumn("halfwidth", wilson_halfwidth(F.bround(F.col("rate") * F.col("n"), 0), F.col("n"), z))


def sizes_for_halfwidth(spark, widths=(0.10, 0.15, 0.20), most=2000, z=None) -> DataFrame:
    """X11. The smallest n whose Wilson half-width at a proportion of one half is at most each width; a grid of `most` sizes, enough for widths from 0.022 on (checked)."""
    z = z or normal_quantile(0.95)
    if z / (2 * math.sqrt(most)) > min(widths):
        raise ValueError("widen the grid of sizes")
    grid = spark.range(2, most + 1).withColumnRenamed("id", "n").withColumn("width", F.explode(F.array(*[F.lit(float(w)) for w in widths])))
    return grid.filter(wilson_halfwidth(F.floor(F.col("n") / 2), F.col("n"), z) <= F.col("width")).groupBy("width").agg(F.min("n").alias("n_needed"))


def sign_check(df: DataFrame, development="development", holdout="holdout") -> DataFrame:
    """X12. Whether the holdout estimate points the way the development estimate did; zero has no sign."""
    return (df.withColumn("comparable", F.col(development).isNotNull()).withColumn("holdout_sign", F.signum(holdout).cast("int")).withColumn("development_sign", F.signum(development).cast("int"))
            .withColumn("same_sign", F.when(F.col(development).isNotNull(), (F.signum(holdout) == F.signum(development)) & (F.col(holdout) != 0))))
