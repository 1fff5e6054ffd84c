"""Targets, caveat versions, time blocks, walk-forward folds and the history features that may be known at each cutoff."""
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.numeric import rebase, rounded
from tidemark.operators.asof import asof_sums, dominance_sums
from tidemark.plans.outcomes import LABELS, THRESHOLDS, ge_pct

# Sufficiency floors and shrinkage strengths.
MIN_TRAIN, MIN_CLASS, MIN_REGRESSION_TEST = 40, 10, 20
PRIOR_STRENGTH, GROUP_MINIMUM, DEFAULT_RATE, CELL_MINIMUM = 10, 10, 0.5, 10
QUANTILES = (0.1, 0.5, 0.9)
# A caveat on the key also touches the labels derived from the same price.
DERIVED = {"day1_open_return": [f"gap_ge_{t}pct" for t in THRESHOLDS] + ["positive_gap_retained_half", "positive_gap_filled"],
           "day1_close_return": ["positive_gap_retained_half"],
           "day1_low_return": ["positive_gap_filled"]}

_CUSTOM = {}


def register_target(name, expression, sources, kind="binary", n_sessions=1):
    """D2. Add a named target as a Column expression over the event's label inputs; `sources` are the labels it reads."""
    _CUSTOM[name] = (kind, expression, tuple(sources), n_sessions)


def target_definitions():
    """P1. (name, kind, value as double or null, labels it reads, sessions until it matures)."""
    p, o, h, l, c = (F.col(x) for x in ("anchor_close", "open", "high", "low", "close"))
    opened, high, close, five = o / p - 1, h / p - 1, c / p - 1, F.col("close_5") / p - 1
    has5 = F.col("reason_5").isNull()
    gap = ge_pct(o, p, 0.5)
    out = [(f"gap_ge_{t}pct", "binary", ge_pct(o, p, t), (f"gap_ge_{t}pct",), 1) for t in THRESHOLDS]
    out += [(f"day1_high_ge_{t}pct", "binary", high >= t / 100.0, ("day1_high_return",), 1) for t in (10, 20, 30)]
    out += [(f"day1_close_ge_{t}pct", "binary", close >= t / 100.0, ("day1_close_return",), 1) for t in (10, 20)]
    out += [(f"extension_after_open_ge_{t}pct", "binary", rebase(high, opened) >= t / 100.0, ("day1_open_return", "day1_high_return"), 1) for t in (5, 10)]
    out += [(f"session5_close_ge_{t}pct", "binary", F.when(has5, five >= t / 100.0), ("session_5_close_return",), 5) for t in (10, 20)]
    out += [("loses_half_of_gap", "binary", F.when(gap, ~(c >= (o + p) / 2)), ("positive_gap_retained_half",), 1),
            ("full_gap_fill", "binary", F.when(gap, l <= p), ("positive_gap_filled",), 1),
            ("closes_below_open", "binary", rebase(close, opened) < 0, ("day1_open_return", "day1_close_return"), 1),
            ("day1_close_return", "regression", close, ("day1_close_return",), 1)]
    return out + [(name, kind, value, sources, n) for name, (kind, value, sources, n) in _CUSTOM.items()]


def targets(events: DataFrame, keep, only=None) -> DataFrame:
    """P1. Long table of every named target of every event; y is null where the target is undefined."""
    rows = [F.struct(F.lit(n).alias("target"), F.lit(k).alias("kind"), v.cast("double").alias("y"), F.array(*[F.lit(s) for s in src]).alias("sources"), F.lit(m).alias("n_sessions"))
            for n, k, v, src, m in target_definitions() if only is None or n in only]
    return events.select(*keep, F.explode(F.array(*rows)).alias("_t")).select(*keep, "_t.*")


def close_caveats(caveats: DataFrame) -> DataFrame:
    """V21. (event_id, label) closed under derivation; the label `all` stands for every label."""
    closure = F.lit(None).cast("array<string>")
    for label, derived in DERIVED.items():
        closure = F.when(F.col("label") == label, F.array(*[F.lit(x) for x in [label, *derived]])).otherwise(closure)
    every = F.array(*[F.lit(x) for x in LABELS])
    return caveats.select("event_id", F.explode(F.when(F.col("label") == "all", every).otherwise(F.coalesce(closure, F.array("label")))).alias("label")).distinct()


def mask_labels(labels: DataFrame, caveats: DataFrame) -> DataFrame:
    """V20. Labels a caveat names become null with reason CAVEAT."""
    marks = caveats.select("event_id", "label").distinct().withColumn("_m", F.lit(True))
    return (labels.join(marks, ["event_id", "label"], "left")
            .withColumns({"num": F.when(F.col("_m").isNull(), F.col("num")), "flag": F.when(F.col("_m").isNull(), F.col("flag")),
                          "reason": F.when(F.col("_m"), "CAVEAT").otherwise(F.col("reason"))}).drop("_m"))


def versions(rows: DataFrame, caveats: DataFrame) -> DataFrame:
    """P2. all_event keeps every target; clean_window nulls a target whose source labels carry a caveat (closed under derivation)."""
    marks = close_caveats(caveats).groupBy("event_id").agg(F.collect_set("label").alias("_marks"))  # at most sixteen per event
    clean = rows.join(marks, "event_id", "left").withColumn("y", F.when(~F.coalesce(F.arrays_overlap("sources", "_marks"), F.lit(False)), F.col("y"))).drop("_marks")
    return rows.withColumn("version", F.lit("all_event")).unionByName(clean.withColumn("version", F.lit("clean_window")))


def block_table(events: DataFrame, gap=28, session="reaction_session") -> DataFrame:
    """W5. Session to block number: a new block starts where two consecutive sessions are more than `gap` days apart. At most one row per calendar session."""
    w = W.orderBy(session)
    new = F.when(F.datediff(session, F.lag(session).over(w)) > gap, 1).otherwise(0)
    return (events.select(session).distinct().withColumn("_new", new).withColumn("block", F.sum("_new").over(w) + 1)
            .withColumn("n_blocks", F.max("block").over(W.partitionBy(F.lit(1)))).select(session, "block", "n_blocks"))


def assign_blocks(events: DataFrame, gap=28, session="reaction_session") -> DataFrame:
    return events.join(F.broadcast(block_table(events, gap, session)), session)  # bounded by the calendar


def block_slack(events: DataFrame) -> DataFrame:
    """W6. Between consecutive blocks: days from the latest label of the one to the earliest cutoff of the next. Needs block, cutoff, matures_at."""
    b = events.groupBy("block").agg(F.max("matures_at").alias("latest"), F.min("cutoff").alias("earliest"))
    w = W.orderBy("block")
    return (b.withColumn("next_cutoff", F.lead("earliest").over(w)).filter("next_cutoff is not null")
            .withColumn("slack_days", (F.unix_micros("next_cutoff") - F.unix_micros("latest")) / 86_400_000_000)
            .select("block", "slack_days", (F.col("slack_days") <= 0).alias("needs_purge")))


def folds(rows: DataFrame) -> DataFrame:
    """P3. Expanding walk-forward: each row trains every fold after its block and is tested in its own; the last block is the holdout."""
    f = rows.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("block"), F.lit(2)), F.greatest(F.col("n_blocks"), F.lit(2)))))
    return (f.withColumn("role", F.when(F.col("block") < F.col("fold"), "train").otherwise("test"))
            .withColumn("stage", F.when(F.col("fold") == F.col("n_blocks"), "holdout").otherwise("development")))


def fold_sums(rows: DataFrame, keys, measures: dict, train_block="block") -> DataFrame:
    """P3. Additive statistics of every fold without a copy of a row per fold: `train_<m>` over the blocks before it, `test_<m>` over its own, from one sum per block.

    A fold's training side is a prefix of the blocks, so its sums are running sums over blocks (one row per key and block, bounded by the calendar). `train_block` may name a column that
    lets a row in later than its own block does (`walk_forward_entry`); null never lets it in. Folds run from 2, or the key's first block, to the last block of all; fold 2 of a single
    block tests nothing and is no holdout.
    """
    keys = list(keys)
    sums = [F.sum(c).alias(m) for m, c in measures.items()]
    own = rows.groupBy(*keys, "block").agg(*sums, F.max("n_blocks").alias("n_blocks"))
    span = own.groupBy(*keys).agg(F.min("block").alias("_from"), F.greatest(F.max("n_blocks"), F.lit(2)).alias("_to"), F.max("n_blocks").alias("_blocks"))
    test = own.select(*keys, "block", *[F.col(m).alias("test_" + m) for m in measures])
    train = own if train_block == "block" else rows.filter(F.col(train_block).isNotNull()).groupBy(*keys, F.col(train_block).alias("block")).agg(*sums)
    train = train.select(*keys, "block", *[F.col(m).alias("_" + m) for m in measures])
    grid = span.withColumn("block", F.explode(F.sequence(F.lit(1), "_to"))).join(train, [*keys, "block"], "left").join(test, [*keys, "block"], "left")
    before = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = grid.select(*keys, F.col("block").alias("fold"), "_from", (F.col("block") == F.col("_blocks")).alias("_last"), *[zero(F.sum("_" + m).over(before)).alias("train_" + m) for m in measures], *[zero(F.col("test_" + m)).alias("test_" + m) for m in measures])
    return out.filter(F.col("fold") >= F.greatest(F.col("_from"), F.lit(2))).withColumn("stage", F.when(F.col("_last"), "holdout").otherwise("development")).drop("_from", "_last")


def sufficiency(rows: DataFrame) -> DataFrame:
    """P4. Per (target, version, fold): counts, state and reason under the training floors, from rows that stand once (not the copies of `folds`)."""
    binary = F.col("kind") == "binary"
    one = lambda c: c.cast("int").cast("long")
    g = fold_sums(rows, ["target", "kind", "version"], {"events": F.lit(1), "defined": one(F.col("y").isNotNull()), "positives": F.coalesce(one((F.col("y") > 0) & binary), F.lit(0))}).drop("test_events", "test_positives", "stage")
    neg = F.col("train_defined") - F.col("train_positives")
    reason = (F.when(F.col("train_events") < MIN_TRAIN, "TOO_FEW_TRAINING_EVENTS")
              .when(~binary & (F.col("train_defined") < MIN_TRAIN), "TOO_FEW_DEFINED").when(binary & (F.col("train_positives") < MIN_CLASS), "TOO_FEW_POSITIVES")
              .when(binary & (neg < MIN_CLASS), "TOO_FEW_NEGATIVES"))
    return g.withColumn("reason", reason).withColumn("state", F.when(F.col("reason").isNull(), "EVALUABLE").otherwise("INSUFFICIENT_DATA"))


def boundaries(rows: DataFrame) -> DataFrame:
    """(fold, boundary): the first cutoff tested in each fold; one row per block. Bounds what a fit of that fold may know."""
    return rows.groupBy(F.col("block").alias("fold")).agg(F.min("cutoff").alias("boundary")).filter("fold >= 2")


def walk_forward_entry(rows: DataFrame) -> DataFrame:
    """J12, P17. `entry`: the block from whose end on a row may train, the first fold after its own block that starts later than its label is known, less one; null if there is none.

    A label is known in time for a fold if it matures before the fold's first test cutoff. For a prefix-summed fit (`fold_sums`) the row then simply belongs to a later block; the folds
    in between refuse it (`refused_rows`). A row without a maturity never trains.
    """
    cuts = boundaries(rows).agg(F.array_sort(F.collect_list(F.struct("fold", "boundary"))).alias("_cuts"))  # as many as there are blocks
    last = F.greatest("n_blocks", F.lit(2))
    open_folds = F.filter("_cuts", lambda c: (c["fold"] > F.col("block")) & (c["boundary"] > F.col("matures_at")))
    first = F.array_min(F.transform(open_folds, lambda c: c["fold"]))
    # folds without a test row have no cutoff and ask for nothing: with a single block the only fold is 2
    entry = F.when(F.col("n_blocks") < 2, F.lit(1)).otherwise(first - 1)
    return rows.withColumn("_cuts", cuts.scalar()).withColumn("entry", F.when(F.col("matures_at").isNotNull() & (entry < last), entry).cast("int")).drop("_cuts")


def refused_rows(entered: DataFrame) -> DataFrame:
    """(target, version, fold, refused): training rows with an outcome that a fold refuses as `fit_label_not_mature`; a few numbers per fold, not a row per fold."""
    late = entered.filter("y is not null").groupBy("target", "version", "block", "n_blocks", "entry").agg(F.count(F.lit(1)).alias("n"))
    stop = F.coalesce(F.col("entry"), F.greatest(F.col("n_blocks"), F.lit(2)))
    late = late.filter(stop > F.col("block")).withColumn("fold", F.explode(F.sequence(F.greatest(F.col("block") + 1, F.lit(2)), stop)))
    return late.groupBy("target", "version", "fold").agg(F.sum("n").alias("refused")).withColumn("reason", F.lit("fit_label_not_mature"))


def walk_forward(rows: DataFrame) -> DataFrame:
    """P3, J12. The rows of `folds` as a fit may see them: a training row whose label is not known before the fold's first test cutoff has the role `late`, which no fit reads."""
    f = folds(rows).join(F.broadcast(boundaries(rows)), "fold", "left")
    late = (F.col("role") == "train") & F.col("boundary").isNotNull() & ~F.coalesce(F.col("matures_at") < F.col("boundary"), F.lit(False))
    return f.withColumn("role", F.when(late, "late").otherwise(F.col("role")))


def structure_audit(rows: DataFrame, history: DataFrame, cells=("timing", "sic_division"), indicators=(), gap=None, minimum=CELL_MINIMUM) -> DataFrame:
    """X13. Per (target, version, fold), before any scoring: rows with the target defined, cells below the minimum and test events that fall back on them, test events without history (own, any),
    indicators that are constant in training, and undefined opening gaps. Only whether an outcome is there is read, never its value.

    `rows` stand once, `history` holds n_own and n_all of each (event, target) as a test event. Everything is a sum per block; cells are summed by value, so a hot cell is one row a task.
    """
    keys = ["target", "version"]
    defined = rows.filter(F.col("y").isNotNull()).drop("y")
    one = lambda c: F.coalesce(c.cast("int").cast("long"), F.lit(0))
    known = defined.join(history.select("event_id", "target", "n_own", "n_all"), ["event_id", "target"], "left")
    measures = {"events": F.lit(1), "without_own": one(F.coalesce("n_own", F.lit(0)) == 0), "without_any": one(F.coalesce("n_all", F.lit(0)) == 0), **{"is_" + i: F.col(i).cast("long") for i in indicators}}
    if gap is not None:
        measures["undefined_gap"] = one(F.col(gap).isNull())
    sides = fold_sums(known, keys, measures)
    constant = F.array_compact(F.array(*[F.when(F.col("train_is_" + i).isin(0) | (F.col("train_is_" + i) == F.col("train_events")), F.lit(i)) for i in sorted(indicators)]))
    each = defined.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in cells]))).select("*", "_c.*")
    small = F.col("train_n") < minimum
    by_cell = fold_sums(each, [*keys, "cell", "value"], {"n": F.lit(1)}).groupBy(*keys, "fold", "cell").agg(F.count_if(small & (F.col("train_n") > 0)).alias("small_cells"), F.sum(F.when(small, F.col("test_n")).otherwise(0)).alias("fallbacks"))
    wide = by_cell.groupBy(*keys, "fold").agg(*[F.coalesce(F.max(F.when(F.col("cell") == c, F.col(m))), F.lit(0)).alias(f"{m}_{c}") for c in cells for m in ("small_cells", "fallbacks")])
    gaps = ["train_undefined_gap", "test_undefined_gap"] if gap is not None else []
    return (sides.join(wide, [*keys, "fold"], "left").withColumn("constant_indicators", constant)
            .select(*keys, "fold", "stage", "train_events", "test_events", "train_without_any", "test_without_any", "test_without_own", "constant_indicators", *gaps, *[c for c in wide.columns if c not in (*keys, "fold")]))


def disjointness(f: DataFrame, keys=("reaction_session", "cluster_id", "block")) -> DataFrame:
    """J13. Per fold and key: how many values appear on both sides. Must be zero."""
    both = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]
    sides = (f.withColumn("_k", F.explode(F.array(*both))).groupBy("fold", "_k.key", "_k.value")
             .agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b")))
    return sides.groupBy("fold", "key").agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"))


def maturity_slack(f: DataFrame) -> DataFrame:
    """J12. Per (target, fold): smallest slack in days between the first test cutoff and any training label, and how many training labels mature too late."""
    first = f.filter("role = 'test'").groupBy("fold").agg(F.min("cutoff").alias("boundary"))  # one row per fold
    t = f.filter("role = 'train' and y is not null").join(F.broadcast(first), "fold")
    slack = (F.unix_micros("boundary") - F.unix_micros("matures_at")) / 86_400_000_000
    return t.groupBy("target", "fold").agg(F.min(slack).alias("min_slack_days"), F.count_if(F.col("matures_at") > F.col("boundary")).alias("violations"))


def maturity_gate(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold rows a fit may see, and the training rows refused as `fit_label_not_mature`: their label is first known at or after the first test cutoff of the fold."""
    first = f.filter("role = 'test'").groupBy("fold").agg(F.min("cutoff").alias("_boundary"))  # one row per fold
    late = F.coalesce((F.col("role") == "train") & F.col("y").isNotNull() & (F.col("matures_at") >= F.col("_boundary")), F.lit(False))
    j = f.join(first, "fold", "left").withColumn("_late", late).drop("_boundary")
    return j.filter("not _late").drop("_late"), j.filter("_late").drop("_late").withColumn("reason", F.lit("fit_label_not_mature"))


def history_sums(rows: DataFrame, strict=False, outcome_end=None, boundary=None) -> DataFrame:
    """J7, J8. For every (event, target): n and total of earlier matured outcomes of its issuer, of its major group and of all events, under two clocks.

    `asked_at` is the row's own cutoff for a training row; for a test row it stops short of the first label of the test block, so that no outcome of its own block
    is ever history. A matured label implies an earlier session, so as-of sums give what pairing each event with its past would. With `outcome_end` and `boundary` (columns of
    `rows`) an outcome counts only if it also ended before the asking row's boundary, such as the first test cutoff of its fold.
    """
    if (outcome_end is None) != (boundary is None):
        raise ValueError("outcome_end and boundary go together")
    scope = F.array(*[F.struct(F.lit(s).alias("scope"), k.alias("scope_key")) for s, k in (("own", F.col("cik")), ("group", F.col("sic_major_group")), ("all", F.lit("*")))])
    exploded = rows.withColumn("_s", F.explode(scope)).select("*", "_s.scope", "_s.scope_key").drop("_s")
    keys, measures = ["target", "scope", "scope_key"], {"n": F.lit(1), "s": F.col("y")}
    facts = exploded.filter("role = 'train' and y is not null and matures_at is not null").select(*keys, "matures_at", "y", *([outcome_end] if outcome_end else []))
    asked = exploded.select("event_id", "role", *keys, "asked_at", *([boundary] if boundary else []))
    if outcome_end:
        sums = dominance_sums(facts, asked, keys, "matures_at", "asked_at", outcome_end, boundary, measures, strict)
    else:
        sums = asof_sums(facts, asked, keys, "matures_at", "asked_at", measures, strict)
    pick = lambda s, m: F.coalesce(F.max(F.when(F.col("scope") == s, F.col(m))), F.lit(0)).alias(f"{m}_{s}")
    return (asked.join(sums, [*keys, "asked_at", *([boundary] if boundary else [])], "left").groupBy("event_id", "target", "role")
            .agg(*[pick(s, m) for s in ("own", "group", "all") for m in ("n", "s")]))


def with_clocks(rows: DataFrame) -> DataFrame:
    """Each row twice: as a training row asking at its cutoff, and as a test row asking no later than just before its own block's first label."""
    first = rows.groupBy("block", "n_sessions").agg((F.min("matures_at") - F.expr("interval 1 microsecond")).alias("_cap"))  # a few rows
    both = rows.join(F.broadcast(first), ["block", "n_sessions"], "left").withColumn("role", F.explode(F.array(F.lit("train"), F.lit("test"))))
    return both.withColumn("asked_at", F.when(F.col("role") == "test", F.least("cutoff", "_cap")).otherwise(F.col("cutoff"))).drop("_cap")


def issuer_history(sums: DataFrame, m=PRIOR_STRENGTH) -> DataFrame:
    """A14, A15. Shrunken issuer rate or mean: prior from the major group when it has enough earlier events, else from all; 0.5 (rate) or null (mean) when none."""
    ratio = lambda s: F.col(f"s_{s}") / F.nullif(f"n_{s}", F.lit(0))
    prior = F.when(F.col("n_group") >= GROUP_MINIMUM, ratio("group")).when(F.col("n_all") > 0, ratio("all"))
    source = F.when(F.col("n_group") >= GROUP_MINIMUM, "sic_major_group").when(F.col("n_all") > 0, "all_earlier_events").otherwise("none_available")
    shrink = lambda p: (F.col("s_own") + m * p) / (F.col("n_own") + m)
    return (sums.withColumn("prior_source", source).withColumn("history_rate", shrink(F.coalesce(prior, F.lit(DEFAULT_RATE)))).withColumn("history_mean", shrink(prior)))


def issuer_context(sums: DataFrame, prior=10) -> DataFrame:
    """A16. Sum of own deviations from the pooled mean over (own count + prior); 0 without own history. Sums must be strict."""
    pooled = F.col("s_all") / F.nullif("n_all", F.lit(0))
    return sums.withColumn("context", F.when(F.col("n_own") > 0, (F.col("s_own") - F.col("n_own") * pooled) / (F.col("n_own") + prior)).otherwise(0.0))


def recent_analogues(rows: DataFrame, take=10, need=5) -> DataFrame:
    """W18. Mean outcome of the latest ten earlier sessions, one event of another issuer and the same timing per session; null with fewer than five.

    Per (target, timing, session) only two events can ever be chosen: the first by id, and the first of another issuer. Sessions are numbered, so an event looks
    its last ten up by equality; sessions that hold nobody but its own issuer are counted as of the cutoff and skipped over.
    """
    facts = rows.filter("y is not null and matures_at is not null")
    who = F.struct("event_id", "cik", "y")
    per_issuer = facts.groupBy("target", "timing", "reaction_idx", "cik").agg(F.min(who).alias("w"), F.max("matures_at").alias("matures_at"))
    firsts = per_issuer.groupBy("target", "timing", "reaction_idx").agg(F.min("w").alias("a"), F.max("matures_at").alias("matures_at"))
    others = (per_issuer.drop("matures_at").join(firsts.select("target", "timing", "reaction_idx", "a"), ["target", "timing", "reaction_idx"]).filter(F.col("cik") != F.col("a.cik"))
              .groupBy("target", "timing", "reaction_idx").agg(F.min("w").alias("b")))
    table = (firsts.join(others, ["target", "timing", "reaction_idx"], "left")
             .withColumn("rn", F.row_number().over(W.partitionBy("target", "timing").orderBy("reaction_idx"))))  # one row per session
    seen = asof_sums(table, rows, ["target", "timing"], "matures_at", "cutoff", {"r": F.lit(1)}, strict=True)
    sole = table.filter("b is null").select("target", "timing", F.col("a.cik").alias("cik"), "matures_at")
    alone = asof_sums(sole, rows, ["target", "timing", "cik"], "matures_at", "cutoff", {"lone": F.lit(1)}, strict=True)
    asks = (rows.select("event_id", "target", "timing", "cik", "cutoff").join(seen, ["target", "timing", "cutoff"], "left").join(alone, ["target", "timing", "cik", "cutoff"], "left").filter("r > 0")
            .withColumn("rn", F.explode(F.sequence(F.greatest(F.lit(1), F.col("r") - F.coalesce("lone", F.lit(0)) - take + 1), F.col("r")))))
    chosen = (asks.join(table.select("target", "timing", F.col("rn").cast("long").alias("rn"), "a", "b"), ["target", "timing", "rn"])
              .withColumn("pick", F.when(F.col("a.cik") != F.col("cik"), F.col("a")).otherwise(F.col("b"))).filter("pick is not null"))
    w = W.partitionBy("event_id", "target").orderBy(F.desc("rn"))
    last = chosen.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= take)
    return last.groupBy("event_id", "target").agg(F.count(F.lit(1)).alias("n_sessions_used"), F.when(F.count(F.lit(1)) >= need, F.avg("pick.y")).alias("analogue"))


def pooled_rates(f: DataFrame) -> DataFrame:
    """A13. Training rate per (target, version, fold)."""
    return f.filter("role = 'train' and y is not null").groupBy("target", "kind", "version", "fold").agg(F.count(F.lit(1)).alias("pooled_n"), F.avg("y").alias("pooled_rate"))


def cell_rates(f: DataFrame, cell: str, minimum=CELL_MINIMUM) -> DataFrame:
    """A11. Test rows with the training rate of their cell, or the pooled rate (flagged) where the cell has fewer than `minimum` defined training events."""
    keys = ["target", "version", "fold"]
    cells = f.filter("role = 'train' and y is not null").groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("cell_n"), F.avg("y").alias("cell_rate"))
    out = f.filter("role = 'test'").join(cells, [*keys, cell], "left").join(pooled_rates(f).drop("kind"), keys)
    enough = F.coalesce(F.col("cell_n"), F.lit(0)) >= minimum
    return out.withColumn("p", F.when(enough, F.col("cell_rate")).otherwise(F.col("pooled_rate"))).withColumn("fallback", ~enough)


def cell_quantiles(f: DataFrame, cell: str, minimum=CELL_MINIMUM, levels=QUANTILES) -> DataFrame:
    """A12. The same with training quantiles, exact whatever the size of a cell."""
    from tidemark.operators.quantiles import exact_quantiles
    keys = ["target", "version", "fold"]
    train = f.filter("role = 'train' and y is not null")
    cells = exact_quantiles(train, [*keys, cell], "y", levels, out="cell_q").withColumnRenamed("n", "cell_n")
    pooled = exact_quantiles(train, keys, "y", levels, out="pooled_q").withColumnRenamed("n", "pooled_n")
    out = f.filter("role = 'test'").join(cells, [*keys, cell], "left").join(pooled, keys)
    enough = F.coalesce(F.col("cell_n"), F.lit(0)) >= minimum
    return out.withColumn("q", F.when(enough, F.col("cell_q")).otherwise(F.col("pooled_q"))).withColumn("fallback", ~enough)


def bucket(positives, negatives, estimable=30, thin=10):
    """How much a target's counts can carry."""
    return F.when(F.least(positives, negatives) >= estimable, "estimable_with_wide_uncertainty").when((positives >= thin) & (negatives >= thin), "thin").otherwise("insufficient")


def cap_nested(looser: DataFrame, tighter: DataFrame, keys, p="p", missing="refuse") -> DataFrame:
    """P10. A tighter threshold is never more likely than the looser one; repairs are flagged.

    A row without a looser prediction is flagged and refused (no prediction); `missing="keep"` leaves it uncapped, for the sensitivity only.
    """
    if missing not in ("refuse", "keep"):
        raise ValueError("missing is refuse or keep")
    cap = looser.select(*keys, F.col(p).alias("_cap"))
    absent = F.col("_cap").isNull()
    alone = F.col(p) if missing == "keep" else F.lit(None).cast("double")
    return (tighter.join(cap, list(keys), "left").withColumn("repaired", F.coalesce(F.col(p) > F.col("_cap"), F.lit(False))).withColumn("looser_missing", absent)
            .withColumn(p, F.when(absent, alone).otherwise(F.least(F.col(p), F.col("_cap")))).drop("_cap"))
