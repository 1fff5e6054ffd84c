"""Per-fold models. Spark reduces the rows of every (target, version, fold) group to sums; only k-by-k systems are ever solved in Python."""
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numeric import clip_rate, logit, sigmoid
from tidemark.operators.quantiles import exact_quantiles
from tidemark.runtime import cut_lineage, written

# Penalty, convergence and the near-constant threshold.
RIDGE_LAMBDA, NEWTON_TOLERANCE, NEWTON_MAX_ITERATIONS, ZERO_SD = 1.0, 1e-8, 100, 1e-12


def encode(train_and_test: DataFrame, features, keys) -> DataFrame:
    """P12. Missing features take the training median of their group, with a 0/1 flag per feature; 0 where a group has no training value.

    Medians are exact and split by value, so a group of any size is fine.
    """
    names = list(features)
    long = (train_and_test.filter("role = 'train'").select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in names])).alias("_v"))
            .select(*keys, "_v.f", "_v.v"))
    med = exact_quantiles(long, [*keys, "f"], "v", (0.5,)).groupBy(*keys).pivot("f", names).agg(F.first(F.element_at("q", 1)))
    med = med.withColumnsRenamed({f: "_m_" + f for f in names})
    out = train_and_test.join(med, list(keys), "left")
    out = out.withColumns({**{f + "_missing": F.when(F.col(f).isNull(), 1.0).otherwise(0.0) for f in names}})
    return out.withColumns({f: F.coalesce(F.col(f).cast("double"), F.col("_m_" + f), F.lit(0.0)) for f in names}).drop(*["_m_" + f for f in names])


def standardize(rows: DataFrame, features, keys, undefined=False) -> DataFrame:
    """P6. z_<feature> by the training mean and population deviation of the group; a near-constant feature is dropped (its z is null-free zero and `kept` says so).

    With `undefined` the z of a dropped feature is the plain quotient, for reports: by a deviation of zero NaN at the mean and infinite off it.
    """
    train = rows.filter("role = 'train' and y is not null")
    stats = train.groupBy(*keys).agg(*[F.avg(f).alias("_m_" + f) for f in features], *[F.stddev_pop(f).alias("_s_" + f) for f in features])
    out = rows.join(stats, list(keys))
    kept = lambda f: F.col("_s_" + f) > ZERO_SD * F.greatest(F.lit(1.0), F.abs("_m_" + f))
    off = lambda f: F.col(f) - F.col("_m_" + f)
    quotient = lambda f: off(f) / F.nullif("_s_" + f, F.lit(0.0))
    flat = lambda f: F.when(off(f) == 0, float("nan")).when(off(f).isNotNull(), F.signum(off(f)) * float("inf"))
    z = {"z_" + f: F.when(kept(f), quotient(f)).otherwise(F.coalesce(quotient(f), flat(f)) if undefined else 0.0) for f in features}
    return out.withColumns({**z, **{"kept_" + f: kept(f) for f in features}}).drop(*["_m_" + f for f in features], *["_s_" + f for f in features])


def gram(rows: DataFrame, features, keys, y="y"):
    """D3. Gram matrix and right-hand side of each group as sums: one partial-aggregated pass."""
    cols = [F.lit(1.0)] + [F.col("z_" + f) for f in features]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(y)).alias(f"b{i}") for i, c in enumerate(cols)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def fit_ridge(rows: DataFrame, features, keys, minimum=40) -> DataFrame:
    """P7. Ridge coefficients per group, intercept first and not penalized; the solve runs on one small row per group, where Spark put it."""
    k = len(features) + 1
    moments = gram(rows.filter("role = 'train' and y is not null"), features, keys)
    key_fields = [f for f in moments.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + ", n bigint, state string, beta array<double>"

    def solve(batches):
        for pdf in batches:
            betas, states = [], []
            for row in pdf.to_dict("records"):
                if row["n"] < minimum:
                    betas.append(None)
                    states.append("INSUFFICIENT_DATA")
                    continue
                a = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag([0.0] + [RIDGE_LAMBDA] * (k - 1))
                betas.append(np.linalg.solve(a, np.array([row[f"b{i}"] for i in range(k)])).tolist())
                states.append("FITTED")
            yield pd.DataFrame({**{f.name: pdf[f.name] for f in key_fields}, "n": pdf["n"], "state": states, "beta": betas})

    return moments.mapInPandas(solve, schema)


def linear(features, beta="beta"):
    return sum((F.element_at(beta, i + 2) * F.col("z_" + f) for i, f in enumerate(features)), F.element_at(beta, 1))


def _raw(features, y):
    """Measures of one row for `fit_ridge_expanding`: 1, x, x times x, y, x times y, of the shifted features."""
    x = [F.col("_x_" + f) for f in features]
    k = len(features)
    return {"n": F.lit(1), **{f"x{i}": c for i, c in enumerate(x)}, **{f"x{i}_{j}": x[i] * x[j] for i in range(k) for j in range(i, k)}, "y": F.col(y), **{f"xy{i}": c * F.col(y) for i, c in enumerate(x)}}


def fit_ridge_expanding(rows: DataFrame, features, keys=("target", "version"), minimum=40, train_block="entry") -> DataFrame:
    """P7 over all expanding folds at once: (keys, fold), n, state, beta for standardized features, their `means` and `deviations` (0: near-constant, dropped).

    `rows` stand once each, with block, n_blocks, y and the features of a training row; `train_block` says from which block's end a row trains (P17's gate, or `block`). Every row
    goes into the moments of one block; a fold's moments are a prefix sum over blocks, and its standardization follows from them, so no row is copied per fold. Features are shifted
    by the key's mean first, which keeps the differences of moments exact enough.
    """
    from tidemark.plans.folds import fold_sums
    keys, k = list(keys), len(features)
    known = rows.filter(F.col("y").isNotNull())
    centre = known.groupBy(*keys).agg(*[F.avg(f).alias("_c_" + f) for f in features])
    shifted = known.join(centre, keys).withColumns({"_x_" + f: F.col(f).cast("double") - F.col("_c_" + f) for f in features})
    moments = fold_sums(shifted, keys, _raw(features, "y"), train_block).join(centre, keys)
    fields = [f for f in moments.schema.fields if f.name in (*keys, "fold")]
    names = [f.name for f in fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", n bigint, state string, beta array<double>, means array<double>, deviations array<double>"

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                n = row["train_n"]
                if n < minimum:
                    out.append((n, "INSUFFICIENT_DATA", None, None, None))
                    continue
                x, y = np.array([row[f"train_x{i}"] for i in range(k)]), row["train_y"]
                xx = np.array([[row[f"train_x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                mean, centre_of = x / n, np.array([row["_c_" + f] for f in features])
                cov = xx - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 0) / n)
                kept = sd > ZERO_SD * np.maximum(1.0, np.abs(mean + centre_of))
                scale = np.where(kept, 1 / np.where(kept, sd, 1), 0.0)
                gram = np.zeros((k + 1, k + 1))
                gram[0, 0], gram[1:, 1:] = n, cov * np.outer(scale, scale) + RIDGE_LAMBDA * np.eye(k)
                right = np.concatenate([[y], scale * (np.array([row[f"train_xy{i}"] for i in range(k)]) - mean * y)])
                out.append((n, "FITTED", np.linalg.solve(gram, right).tolist(), (mean + centre_of).tolist(), np.where(kept, sd, 0.0).tolist()))
            yield pd.DataFrame({**{c: pdf[c] for c in names}, **dict(zip(("n", "state", "beta", "means", "deviations"), map(list, zip(*out)) if out else [[]] * 5))})

    return moments.mapInPandas(solve, schema)


def _expanded(features):
    """The forecast of a row joined to its fold's model (beta, means, deviations)."""
    z = lambda i, f: F.when(F.element_at("deviations", i + 1) > 0, (F.col(f) - F.element_at("means", i + 1)) / F.element_at("deviations", i + 1)).otherwise(0.0)
    return sum((F.element_at("beta", i + 2) * z(i, f) for i, f in enumerate(features)), F.element_at("beta", 1))


def predict_expanding(rows: DataFrame, models: DataFrame, features, keys=("target", "version"), out="p") -> DataFrame:
    """Every row with the prediction of its own block's fold; null, with the state, where that fold has no fit. Blocks before the first fold are left out."""
    j = rows.withColumn("fold", F.col("block")).filter("fold >= 2").join(models.select(*keys, "fold", "state", "beta", "means", "deviations"), [*keys, "fold"], "left")
    return j.withColumn(out, F.when(F.col("beta").isNotNull(), _expanded(features))).drop("beta", "means", "deviations")


def expanding_quantile_forecast(rows: DataFrame, models: DataFrame, features, keys=("target", "version"), levels=(0.1, 0.5, 0.9)) -> DataFrame:
    """P9 over expanding folds: test rows with `q`, their fitted value plus the quantiles of the training residuals of their own fold.

    `rows` stand once under each clock (`role`). Residuals differ from fold to fold, so each training row meets the models of the folds it trains, by key; the quantiles are exact.
    """
    keys = list(keys)
    fitted = models.filter("beta is not null").select(*keys, F.col("fold").alias("_fold"), "beta", "means", "deviations")
    train = rows.filter("role = 'train' and y is not null and entry is not null").join(fitted, keys).filter(F.col("_fold") > F.col("entry")).withColumn("fold", F.col("_fold"))
    residuals = exact_quantiles(train.withColumn("residual", F.col("y") - _expanded(features)), [*keys, "fold"], "residual", levels, out="residual_q").drop("n")
    test = predict_expanding(rows.filter("role = 'test'"), models, features, keys, out="_f").join(residuals, [*keys, "fold"], "left")
    return test.withColumn("q", F.when(F.col("_f").isNotNull(), F.transform("residual_q", lambda x: x + F.col("_f")))).drop("_f", "residual_q")


def paired_folds(rows: DataFrame, features, extra: str, has_history, keys=("target", "version"), minimum=40) -> DataFrame:
    """P17. Every test row with the forecasts of a ridge baseline on `features` and of a challenger that also sees `extra`, both fitted on the training rows their fold may know.

    `rows` stand once under each clock (`role` train and test) with block, n_blocks and `entry` (`folds.walk_forward_entry`), so that no label known too late enters a fit. Where `has_history` is not true the
    challenger takes the baseline's forecast. Forecasts are null where a fold has too few rows.
    """
    train, test = rows.filter("role = 'train'"), rows.filter("role = 'test'")
    for name, names in (("baseline", list(features)), ("challenger", [*features, extra])):
        test = predict_expanding(test, cut_lineage(fit_ridge_expanding(train, names, keys, minimum)), names, keys, out=name).drop("state")
    return test.withColumn("challenger", F.when(F.coalesce(has_history, F.lit(False)), F.col("challenger")).otherwise(F.col("baseline")))


def fit_logistic(rows: DataFrame, features, keys, minimum_class=10) -> DataFrame:
    """P8. Ridge-penalized logistic per group by Newton steps; every step is one grouped sum of gradients and Hessians over the design, all groups together.

    What a step knows is a table of one row per group: its coefficients, its state and how many steps it took. The design meets it by key, a step solves each group's k-by-k system where
    Spark put its sums, and the loop ends when no row of the table is live; so plans keep their size and the driver sees one number a step, however many groups there are. A group that does not converge
    stays null with MODEL_FIT_FAILED.
    """
    keys = list(keys)
    design = cut_lineage(rows.filter("role = 'train' and y is not null").select(*keys, "y", *["z_" + f for f in features]))  # read once per step
    k = len(features) + 1
    enough = F.least(F.sum("y"), F.count(F.lit(1)) - F.sum("y")) >= minimum_class
    zeros = F.array(*[F.lit(0.0)] * k)
    state = written(design.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(enough, "LIVE").otherwise("INSUFFICIENT_DATA").alias("state"), F.lit(0).alias("iterations"), F.when(enough, zeros).alias("beta")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields)
    x = [F.lit(1.0)] + [F.col("z_" + f) for f in features]
    y, p = F.col("y"), F.col("_p")
    sums = [F.sum(x[a] * (y - p)).alias(f"d{a}") for a in range(k)] + [F.sum(x[a] * x[b] * p * (1 - p)).alias(f"h{a}_{b}") for a in range(k) for b in range(a, k)]
    penalty = np.array([0.0] + [RIDGE_LAMBDA] * (k - 1))

    def move(batches):
        for pdf in batches:
            states, steps, betas = [], [], []
            for row in pdf.to_dict("records"):
                beta = np.array(row["beta"], float)
                h = np.array([[row[f"h{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)]) + np.diag(penalty)
                steps.append(row["iterations"] + 1)
                try:
                    step = np.linalg.solve(h, np.array([row[f"d{a}"] for a in range(k)]) - penalty * beta)
                except np.linalg.LinAlgError:
                    step = np.array([np.nan])
                if not np.isfinite(step).all():
                    states.append("MODEL_FIT_FAILED")
                    betas.append(None)
                    continue
                beta = beta + step
                done, last = np.abs(step).max() < NEWTON_TOLERANCE, row["iterations"] + 1 >= NEWTON_MAX_ITERATIONS
                states.append("FITTED" if done else "MODEL_FIT_FAILED" if last else "LIVE")
                betas.append(None if last and not done else beta.tolist())
            yield pd.DataFrame({**{c: pdf[c] for c in keys}, "n": pdf["n"], "state": states, "iterations": np.array(steps, np.int32), "beta": betas})

    while not (live := state.filter("state = 'LIVE'")).isEmpty():  # at most NEWTON_MAX_ITERATIONS steps leave a group live
        j = design.join(live.select(*keys, "beta"), keys).withColumn("_p", sigmoid(linear(features)))
        moved = live.join(j.groupBy(*keys).agg(*sums), keys).mapInPandas(move, schema)
        state = written(state.filter("state <> 'LIVE'").unionByName(moved))
    return state


def predict(rows: DataFrame, models: DataFrame, features, keys, link="identity", out="p") -> DataFrame:
    """P16. Test rows with their group's prediction; where the fit failed the prediction is null and the state says why. Outcomes are not read."""
    value = linear(features)
    return rows.join(models.select(*keys, "state", "beta"), list(keys), "left").withColumn(out, sigmoid(value) if link == "logit" else value).drop("beta")


def out_of_fold(rows: DataFrame, models: DataFrame, features, keys, link="identity", pool=("target", "version")) -> DataFrame:
    """P16. Test rows with prediction, the group's training base rate, and `pool_complete`: whether every fold of the pool was fitted; pooled results of other pools are blank."""
    base = rows.filter("role = 'train' and y is not null").groupBy(*keys).agg(F.avg("y").alias("base_rate"))
    whole = models.groupBy(*pool).agg(F.bool_and(F.col("state") == "FITTED").alias("pool_complete"))
    return predict(rows.filter("role = 'test'"), models, features, keys, link).join(base, list(keys), "left").join(whole, list(pool), "left")


def residual_quantiles(rows: DataFrame, models: DataFrame, features, keys, levels=(0.1, 0.5, 0.9)) -> DataFrame:
    """P9. Per group: quantiles of training residuals; a forecast is the fitted value plus each of them."""
    fitted = predict(rows.filter("role = 'train' and y is not null"), models, features, keys, out="_f").withColumn("residual", F.col("y") - F.col("_f"))
    return exact_quantiles(fitted, keys, "residual", levels, out="residual_q")


def quantile_forecast(rows: DataFrame, models: DataFrame, residuals: DataFrame, features, keys) -> DataFrame:
    return (predict(rows, models, features, keys, out="_f").join(residuals.drop("n"), list(keys), "left")
            .withColumn("q", F.transform("residual_q", lambda x: x + F.col("_f"))).drop("_f", "residual_q"))


def platt(predictions: DataFrame, keys, minimum_class=10):
    """P13. Calibrate p by a logistic on its logit, fitted on rows with role 'train'. A negative slope is flattened to the base rate; too few classes leave p raw."""
    rows = predictions.withColumn("z_logit", logit(clip_rate("p")))
    models = fit_logistic(rows, ["logit"], keys, minimum_class).select(*keys, "state", "beta")
    base = rows.filter("role = 'train' and y is not null").groupBy(*keys).agg(F.avg("y").alias("_base"))
    out = rows.join(models, list(keys), "left").join(base, list(keys), "left")
    slope = F.element_at("beta", 2)
    return (out.withColumn("calibrated", F.when(F.col("beta").isNull(), F.col("p")).when(slope < 0, F.col("_base")).otherwise(sigmoid(linear(["logit"]))))
            .withColumn("calibration", F.when(F.col("beta").isNull(), F.coalesce("state", F.lit("INSUFFICIENT_DATA"))).otherwise("CALIBRATED")).drop("beta", "_base", "z_logit", "state"))


def stump(rows: DataFrame, feature: str, keys, minimum=10) -> DataFrame:
    """P14. Best single split of a feature by reduction of squared error, both sides at least `minimum`; `threshold` is null where no split qualifies."""
    from tidemark.operators.ranking import running_totals
    train = rows.filter(F.col("role") == "train").filter(F.col("y").isNotNull() & F.col(feature).isNotNull())
    per = train.groupBy(*keys, F.col(feature).alias("x")).agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("c"))  # distinct values only
    run = running_totals(per, [F.asc("x")], ["s", "c"], keys)
    total = per.groupBy(*keys).agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    j = run.join(total, list(keys))
    left_n, left_s = F.col("cum_c"), F.col("cum_s")
    right_n, right_s = F.col("tc") - left_n, F.col("ts") - left_s
    mean = F.col("ts") / F.col("tc")
    gain = left_n * F.pow(left_s / left_n - mean, 2) + right_n * F.pow(right_s / F.nullif(right_n, F.lit(0)) - mean, 2)
    cand = j.withColumn("gain", F.when((left_n >= minimum) & (right_n >= minimum), gain)).withColumn("left_mean", left_s / left_n).withColumn("right_mean", right_s / F.nullif(right_n, F.lit(0)))
    best = cand.groupBy(*keys).agg(F.max_by(F.struct("x", "gain", "left_mean", "right_mean"), F.struct(F.coalesce("gain", F.lit(-1.0)), -F.col("x"))).alias("_b"), F.first("ts").alias("ts"), F.first("tc").alias("tc"))
    ok = F.col("_b.gain") > 0
    edge = best.select(*keys, F.when(ok, F.col("_b.x")).alias("x_left"), F.when(ok, F.col("_b.left_mean")).alias("left_mean"), F.when(ok, F.col("_b.right_mean")).alias("right_mean"), (F.col("ts") / F.col("tc")).alias("pooled"))
    nxt = per.join(edge.select(*keys, "x_left"), list(keys)).filter(F.col("x") > F.col("x_left")).groupBy(*keys).agg(F.min("x").alias("x_right"))
    return edge.join(nxt, list(keys), "left").withColumn("threshold", F.col("x_left") / 2 + F.col("x_right") / 2)


def apply_stump(rows: DataFrame, models: DataFrame, feature: str, keys) -> DataFrame:
    """The stump's prediction; rows without the feature, and groups without a split, take the pooled value and are flagged."""
    j = rows.join(models, list(keys), "left")
    fallback = F.col(feature).isNull() | F.col("threshold").isNull()
    return j.withColumn("p", F.when(fallback, F.col("pooled")).when(F.col(feature) <= F.col("threshold"), F.col("left_mean")).otherwise(F.col("right_mean"))).withColumn("fallback", fallback)


def select_config(losses: DataFrame, by) -> DataFrame:
    """P15. Least mean loss (ten digits), the first in the registered order on a tie."""
    g = losses.groupBy(*by, "config", "config_order").agg(F.round(F.avg("loss"), 10).alias("loss"))
    return g.groupBy(*by).agg(F.min_by("config", F.struct("loss", "config_order")).alias("config"), F.min("loss").alias("loss"))


def ablate(rows: DataFrame, families: dict, features, keys, fit, score) -> DataFrame:
    """P18. Refit without each family of features; mean loss of the reduced model minus the full one. `fit(rows, features)` and `score(rows, model, features)` give losses.

    An event that either model leaves without a loss is counted as unscored, and a group with such an event has no difference.
    """
    def mean_loss(kept, name):
        loss = score(rows, fit(rows, kept), kept)
        return loss.groupBy(*keys).agg(F.avg("loss").alias("loss"), F.count("loss").alias("n"), F.count_if(F.col("loss").isNull()).alias("unscored")).withColumn("family", F.lit(name))
    full = mean_loss(list(features), "none").select(*keys, F.col("loss").alias("full_loss"), F.col("unscored").alias("_full_unscored"))
    parts = [mean_loss([f for f in features if f not in set(members)], name) for name, members in families.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.join(full, list(keys)).withColumn("unscored", F.greatest("unscored", "_full_unscored")).drop("_full_unscored")
    return out.withColumn("loss_difference", F.when(F.col("unscored") == 0, F.col("loss") - F.col("full_loss")))


def permuted(rows: DataFrame, feature: str, keys, seed: int, id_col="event_id") -> DataFrame:
    """P19. The rows with one feature shuffled inside each group: values in the order of a content hash are dealt to rows in the order of their id."""
    from tidemark.functions.text import hash_draw
    from tidemark.operators.ranking import positions
    by_id = positions(rows, [F.asc(id_col)], keys, out="_k").drop("group_n", feature)
    by_hash = positions(rows.select(*keys, feature, F.col(id_col).alias("_src"), hash_draw(1 << 32, F.lit(seed), id_col).alias("_h")), [F.asc("_h"), F.asc("_src")], keys, out="_k")
    return by_id.join(by_hash.select(*keys, "_k", feature), [*keys, "_k"]).drop("_k")


def fit_groups(df: DataFrame, predictor, keys, label="y") -> DataFrame:
    """D1. A user's model per group, in a form that never needs a whole group in one place.

    `predictor.partial(train)` turns any part of a group's training rows into additive statistics (a dict of numbers); Spark adds them up per group.
    `predictor.finish(statistics)` makes the model and `predictor.predict(model, view)` scores any part of the test rows; a view never holds the label.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)
    train = df.filter(F.col("role") == "train").filter(F.col(label).isNotNull())

    def partials(batches):
        for pdf in batches:
            rows = []
            for key, part in pdf.groupby(keys, sort=False):
                rows += [(*key, name, float(value)) for name, value in predictor.partial(part).items()]
            yield pd.DataFrame(rows, columns=[*keys, "stat", "value"])

    stats = train.mapInPandas(partials, key_schema + ", stat string, value double").groupBy(*keys, "stat").agg(F.sum("value").alias("value"))
    models = stats.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("stat", "value")))).alias("_stats"))  # as many entries as the predictor has statistics
    view = df.filter(F.col("role") == "test").drop(label).join(models, keys, "left")
    columns = [c for c in view.columns if c != "_stats"]

    def scores(batches):
        for pdf in batches:
            out = []
            for _, part in pdf.groupby(keys, sort=False):
                text = part["_stats"].iloc[0]
                part = part[columns].copy()
                part["p"] = None if text is None else predictor.predict(predictor.finish(json.loads(text)), part)
                out.append(part)
            yield pd.concat(out) if out else pd.DataFrame(columns=[*columns, "p"])

    return view.mapInPandas(scores, ", ".join(f"{c} {types[c]}" for c in columns) + ", p double")
