"""Registered queries: targets, versions, folds, history features, baselines and metrics (P1-P5, P10, A11-A20, W5, W6, W14-W18, J7, J8, J12, J13, J18, X)."""
from pyspark.sql import Window as W, functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.oracle_views import VIEWS
from tidemark.catalog.registry import query
from tidemark.catalog.study_queries import KEEP, WILSON, study_events, study_labels
from tidemark.functions.numeric import normal_quantile, wilson_high, wilson_low
from tidemark.operators import sessions as cal
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.ranking import average_precision, terciles
from tidemark.plans import folds as P, metrics as X
from tidemark.plans.outcomes import LABELS
from tidemark.runtime import cut_lineage, shared_table

GAP = 2  # the test month has no gap of 28 days, so weeks serve as blocks
PRIMARY = ("gap_ge_3pct", "gap_ge_5pct", "day1_close_return", "extension_after_open_ge_5pct", "loses_half_of_gap")

_GE = "CAST(open AS DECIMAL(18, 6)) * 1000 >= CAST(anchor_close AS DECIMAL(18, 6)) * {}"
_T = [(f"gap_ge_{t}pct", "binary", _GE.format(1000 + 10 * t), f"gap_ge_{t}pct", 1) for t in (3, 5, 10, 15, 20, 30)]
_T += [(f"day1_high_ge_{t}pct", "binary", f"high / anchor_close - 1 >= {t / 100.0}", "day1_high_return", 1) for t in (10, 20, 30)]
_T += [(f"day1_close_ge_{t}pct", "binary", f"close / anchor_close - 1 >= {t / 100.0}", "day1_close_return", 1) for t in (10, 20)]
_T += [(f"extension_after_open_ge_{t}pct", "binary", f"(1 + (high / anchor_close - 1)) / (1 + (open / anchor_close - 1)) - 1 >= {t / 100.0}", "day1_open_return,day1_high_return", 1) for t in (5, 10)]
_T += [(f"session5_close_ge_{t}pct", "binary", f"CASE WHEN why_5 IS NULL THEN close_5 / anchor_close - 1 >= {t / 100.0} END", "session_5_close_return", 5) for t in (10, 20)]
_T += [("loses_half_of_gap", "binary", f"CASE WHEN {_GE.format(1005)} THEN NOT close >= (open + anchor_close) / 2 END", "positive_gap_retained_half", 1),
       ("full_gap_fill", "binary", f"CASE WHEN {_GE.format(1005)} THEN low <= anchor_close END", "positive_gap_filled", 1),
       ("closes_below_open", "binary", "(1 + (close / anchor_close - 1)) / (1 + (open / anchor_close - 1)) - 1 < 0", "day1_open_return,day1_close_return", 1),
       ("day1_close_return", "regression", "close / anchor_close - 1", "day1_close_return", 1)]
VIEWS["v_blocks"] = (("v_events",), f"""
SELECT reaction_session, CAST(1 + sum(nw) OVER (ORDER BY reaction_session) AS INTEGER) AS block FROM (
SELECT reaction_session, CASE WHEN reaction_session - lag(reaction_session) OVER (ORDER BY reaction_session) > {GAP} THEN 1 ELSE 0 END AS nw FROM (SELECT DISTINCT reaction_session FROM v_events))""")
VIEWS["v_targets"] = (("v_events", "v_blocks"), "SELECT t.*, b.block, (SELECT max(block) FROM v_blocks) AS n_blocks, s.close_utc + INTERVAL 1 MINUTE AS matures_at FROM (" + " UNION ALL ".join(
    f"SELECT *, '{n}' AS target, '{k}' AS knd, CAST({e} AS DOUBLE) AS y, '{src}' AS sources, {m} AS n_sessions FROM v_events" for n, k, e, src, m in _T)
    + ") t JOIN v_blocks b USING (reaction_session) LEFT JOIN v_sessions s ON s.idx = t.reaction_idx + t.n_sessions - 1")
VIEWS["v_caveats"] = (("v_events",), """
SELECT event_id, CASE event_no % 3 WHEN 0 THEN 'day1_open_return' WHEN 1 THEN 'day1_close_return' ELSE 'all' END AS label FROM v_events WHERE event_no % 5 = 0""")
_LABELS = "['" + "', '".join(LABELS) + "']"
VIEWS["v_closed"] = (("v_caveats",), f"""
SELECT DISTINCT event_id, label FROM (SELECT event_id, unnest(CASE label WHEN 'all' THEN {_LABELS}
 WHEN 'day1_open_return' THEN ['day1_open_return', 'gap_ge_3pct', 'gap_ge_5pct', 'gap_ge_10pct', 'gap_ge_15pct', 'gap_ge_20pct', 'gap_ge_30pct', 'positive_gap_retained_half', 'positive_gap_filled']
 WHEN 'day1_close_return' THEN ['day1_close_return', 'positive_gap_retained_half'] WHEN 'day1_low_return' THEN ['day1_low_return', 'positive_gap_filled'] ELSE [label] END) AS label FROM v_caveats)""")
VIEWS["v_versions"] = (("v_targets", "v_closed"), """
SELECT *, 'all_event' AS version FROM v_targets UNION ALL BY NAME
SELECT * REPLACE (CASE WHEN EXISTS (SELECT 1 FROM v_closed c WHERE c.event_id = t.event_id AND list_contains(string_split(t.sources, ','), c.label)) THEN NULL ELSE y END AS y), 'clean_window' AS version FROM v_targets t""")
VIEWS["v_folds"] = (("v_versions",), """
SELECT *, CASE WHEN block < fold THEN 'train' ELSE 'test' END AS role, CASE WHEN fold = n_blocks THEN 'holdout' ELSE 'development' END AS stage FROM (
SELECT *, unnest(generate_series(greatest(block, 2), greatest(n_blocks, 2))) AS fold FROM v_versions)""")


def caveats(events):
    n = F.col("event_no")
    return events.filter(n % 5 == 0).select("event_id", F.when(n % 3 == 0, "day1_open_return").when(n % 3 == 1, "day1_close_return").otherwise("all").alias("label"))


def target_rows(spark, sf, only=None):
    t = P.assign_blocks(P.targets(study_events(spark, sf), KEEP, only), GAP)
    return cal.label_available(t, I.calendar(spark), "reaction_idx", F.col("n_sessions")).withColumnRenamed("label_available_at", "matures_at")


def version_rows(spark, sf, only=None):
    t = target_rows(spark, sf, only)
    return P.versions(t, caveats(t.select("event_id", "event_no").distinct()))


def fold_rows(spark, sf, only=None):
    return P.folds(version_rows(spark, sf, only))


def r(c, d=9, name=None):
    return (F.round(c, d) + 0.0).alias(name or c)


@query("p01_targets", "SELECT event_id, target, knd AS kind, round(y, 9) + 0.0 AS y FROM v_targets", ["v_targets"])
def p01(spark, sf):
    return P.targets(study_events(spark, sf), ("event_id",)).select("event_id", "target", "kind", r("y"))


@query("p02_versions", "SELECT event_id, target, version, round(y, 9) + 0.0 AS y FROM v_versions", ["v_versions"])
def p02(spark, sf):
    t = target_rows(spark, sf)
    return P.versions(t, caveats(t.select("event_id", "event_no").distinct())).select("event_id", "target", "version", r("y"))


@query("v20_caveat_mask", """
SELECT l.event_id, l.label, CASE WHEN c.label IS NULL THEN round(num, 9) + 0.0 END AS num, CASE WHEN c.label IS NULL THEN flag END AS flag, CASE WHEN c.label IS NOT NULL THEN 'CAVEAT' ELSE reason END AS reason
FROM v_lab l LEFT JOIN (SELECT event_id, unnest(CASE WHEN label = 'all' THEN """ + _LABELS + """ ELSE [label] END) AS label FROM v_caveats) c USING (event_id, label)""", ["v_lab", "v_caveats"])
def v20(spark, sf):
    """Only the labels a caveat names, `all` standing for every label."""
    labels = study_labels(spark, sf)
    c = caveats(labels.select("event_id", "event_no").distinct())
    named = c.select("event_id", F.explode(F.when(F.col("label") == "all", F.array(*[F.lit(x) for x in LABELS])).otherwise(F.array("label"))).alias("label"))
    return P.mask_labels(labels, named).select("event_id", "label", r("num"), "flag", "reason")


@query("v21_caveat_closure", "SELECT event_id, label FROM v_closed", ["v_closed"])
def v21(spark, sf):
    return P.close_caveats(caveats(study_events(spark, sf)))


@query("w05_time_blocks", "SELECT e.event_id, CAST(b.block AS BIGINT) AS block FROM v_events e JOIN v_blocks b USING (reaction_session)", ["v_blocks"])
def w05(spark, sf):
    return P.assign_blocks(study_events(spark, sf), GAP).select("event_id", F.col("block").cast("bigint").alias("block"))


@query("w06_block_slack", """
SELECT * FROM (SELECT CAST(block AS BIGINT) AS block, round((epoch_us(lead(earliest) OVER (ORDER BY block)) - epoch_us(latest)) / 86400000000, 6) + 0.0 AS slack_days,
 lead(earliest) OVER (ORDER BY block) <= latest AS needs_purge
FROM (SELECT block, max(matures_at) AS latest, min(cutoff) AS earliest FROM v_targets WHERE target = 'session5_close_ge_10pct' GROUP BY 1)) WHERE slack_days IS NOT NULL""", ["v_targets"])
def w06(spark, sf):
    return P.block_slack(target_rows(spark, sf, ("session5_close_ge_10pct",))).select(F.col("block").cast("bigint").alias("block"), r("slack_days", 6), "needs_purge")


@query("p03_walk_forward_folds", "SELECT CAST(fold AS BIGINT) AS fold, stage, role, version, target, count(*) AS events, count(y) AS defined FROM v_folds GROUP BY ALL", ["v_folds"])
def p03(spark, sf):
    sides = P.fold_sums(version_rows(spark, sf), ["target", "version"], {"events": F.lit(1), "defined": F.col("y").isNotNull().cast("int").cast("long")})
    both = F.array(*[F.struct(F.lit(role).alias("role"), F.col(role + "_events").alias("events"), F.col(role + "_defined").alias("defined")) for role in ("train", "test")])
    return sides.select(F.col("fold").cast("bigint").alias("fold"), "stage", "version", "target", F.inline(both)).filter("events > 0").select("fold", "stage", "role", "version", "target", "events", "defined")


@query("p04_sufficiency", """
SELECT target, version, CAST(fold AS BIGINT) AS fold, train_events, train_defined, train_positives, test_defined, reason, CASE WHEN reason IS NULL THEN 'EVALUABLE' ELSE 'INSUFFICIENT_DATA' END AS state FROM (
SELECT *, CASE WHEN train_events < 40 THEN 'TOO_FEW_TRAINING_EVENTS' WHEN knd = 'regression' AND train_defined < 40 THEN 'TOO_FEW_DEFINED' WHEN knd = 'binary' AND train_positives < 10 THEN 'TOO_FEW_POSITIVES'
 WHEN knd = 'binary' AND train_defined - train_positives < 10 THEN 'TOO_FEW_NEGATIVES' END AS reason FROM (
SELECT target, knd, version, fold, count_if(role = 'train') AS train_events, count_if(role = 'train' AND y IS NOT NULL) AS train_defined, coalesce(count_if(role = 'train' AND y > 0 AND knd = 'binary'), 0) AS train_positives,
 count_if(role = 'test' AND y IS NOT NULL) AS test_defined FROM v_folds GROUP BY ALL))""", ["v_folds"])
def p04(spark, sf):
    return P.sufficiency(version_rows(spark, sf)).select("target", "version", F.col("fold").cast("bigint").alias("fold"), "train_events", "train_defined", "train_positives", "test_defined", "reason", "state")


@query("j13_cluster_disjointness", """
SELECT CAST(fold AS BIGINT) AS fold, key, count_if(a > 0 AND b > 0) AS shared FROM (SELECT fold, key, value, count_if(role = 'train') AS a, count_if(role = 'test') AS b FROM
(SELECT fold, role, unnest(['reaction_session', 'cluster_id', 'block']) AS key, unnest([CAST(reaction_session AS VARCHAR), cluster_id, CAST(block AS VARCHAR)]) AS value FROM v_folds WHERE version = 'all_event' AND target = 'gap_ge_3pct')
GROUP BY 1, 2, 3) GROUP BY 1, 2""", ["v_folds"])
def j13(spark, sf):
    return P.disjointness(fold_rows(spark, sf, ("gap_ge_3pct",)).filter("version = 'all_event'")).select(F.col("fold").cast("bigint").alias("fold"), "key", "shared")


@query("j12_label_maturity", """
SELECT t.target, CAST(t.fold AS BIGINT) AS fold, round(min(epoch_us(b.boundary) - epoch_us(t.matures_at)) / 86400000000, 6) + 0.0 AS min_slack_days, coalesce(count_if(t.matures_at > b.boundary), 0) AS violations
FROM v_folds t JOIN (SELECT fold, min(cutoff) AS boundary FROM v_folds WHERE role = 'test' GROUP BY 1) b USING (fold) WHERE t.role = 'train' AND t.y IS NOT NULL AND t.version = 'all_event' GROUP BY 1, 2""", ["v_folds"])
def j12(spark, sf):
    s = P.maturity_slack(fold_rows(spark, sf).filter("version = 'all_event'"))
    return s.select("target", F.col("fold").cast("bigint").alias("fold"), r("min_slack_days", 6), "violations")


# history under the two clocks, by pairing every event with its past in SQL
def hist_view(strict):
    op = "<" if strict else "<="
    return f"""
SELECT q.event_id, q.target, q.role, q.cik, count(h.event_id) FILTER (h.cik = q.cik) AS n_own, coalesce(sum(h.y) FILTER (h.cik = q.cik), 0) AS s_own, count(h.event_id) FILTER (h.sic_major_group = q.sic_major_group) AS n_group,
 coalesce(sum(h.y) FILTER (h.sic_major_group = q.sic_major_group), 0) AS s_group, count(h.event_id) AS n_all, coalesce(sum(h.y), 0) AS s_all
FROM (SELECT *, unnest(['train', 'test']) AS role FROM v_targets WHERE target IN ('gap_ge_3pct', 'gap_ge_5pct', 'day1_close_return')) q
LEFT JOIN v_targets h ON h.target = q.target AND h.y IS NOT NULL AND h.event_id <> q.event_id AND h.reaction_idx < q.reaction_idx AND h.matures_at {op} q.cutoff AND (q.role = 'train' OR h.block < q.block)
GROUP BY ALL"""


VIEWS["v_history"] = (("v_targets",), hist_view(False))
VIEWS["v_history_strict"] = (("v_targets",), hist_view(True))
R10 = "CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(38, 18)), 10) AS DOUBLE) + 0.0"
HIST = ("gap_ge_3pct", "gap_ge_5pct", "day1_close_return")


def history(spark, sf, strict=False, only=HIST):
    return P.history_sums(P.with_clocks(target_rows(spark, sf, only)), strict)


@query("j07_history_sums", "SELECT event_id, target, role, n_own, n_group, n_all, round(s_own, 6) + 0.0 AS s_own, round(s_group, 6) + 0.0 AS s_group, round(s_all, 6) + 0.0 AS s_all FROM v_history", ["v_history"])
def j07(spark, sf):
    return history(spark, sf).select("event_id", "target", "role", "n_own", "n_group", "n_all", r("s_own", 6), r("s_group", 6), r("s_all", 6))


@query("j08_history_sums_strict", "SELECT event_id, target, role, n_own, n_group, n_all, round(s_all, 6) + 0.0 AS s_all FROM v_history_strict", ["v_history_strict"])
def j08(spark, sf):
    return history(spark, sf, True).select("event_id", "target", "role", "n_own", "n_group", "n_all", r("s_all", 6))


@query("j08_fold_boundary", """
SELECT q.event_id, q.target, round(epoch_us(q.boundary) / 1000000) AS boundary_second, count(h.event_id) FILTER (h.cik = q.cik) AS n_own, count(h.event_id) FILTER (h.sic_major_group = q.sic_major_group) AS n_group, count(h.event_id) AS n_all, round(coalesce(sum(h.y), 0), 6) + 0.0 AS s_all
FROM (SELECT t.*, b.boundary FROM v_targets t JOIN (SELECT block, min(cutoff) AS boundary FROM v_targets GROUP BY 1) b USING (block) WHERE target IN ('gap_ge_3pct', 'gap_ge_5pct', 'day1_close_return')) q
LEFT JOIN v_targets h ON h.target = q.target AND h.y IS NOT NULL AND h.matures_at < q.cutoff AND h.matures_at + INTERVAL 1 HOUR * (h.event_no % 150) < q.boundary GROUP BY q.event_id, q.target, q.boundary""", ["v_targets"])
def j08_boundary(spark, sf):
    """Outcomes known before the event's cutoff that also ended before the first cutoff of its fold; an outcome ends up to six days after its label is known."""
    t = target_rows(spark, sf, HIST)
    first = t.groupBy("block").agg(F.min("cutoff").alias("boundary"))  # one row per block
    rows = t.join(first, "block").withColumns({"asked_at": F.col("cutoff"), "outcome_end": F.timestamp_micros(F.unix_micros("matures_at") + F.col("event_no") % 150 * 3_600_000_000), "role": F.lit("train")})
    sums = P.history_sums(rows, True, "outcome_end", "boundary").drop("role")
    out = sums.join(rows.select("event_id", "target", "boundary"), ["event_id", "target"])
    return out.select("event_id", "target", F.round(F.unix_micros("boundary") / 1000000).alias("boundary_second"), "n_own", "n_group", "n_all", r("s_all", 6))


RATE = """(s_own + 10 * CASE WHEN n_group >= 10 THEN s_group / n_group WHEN n_all > 0 THEN s_all / n_all ELSE {default} END) / (n_own + 10)"""


@query("a14_issuer_history_rate", f"""
SELECT event_id, target, role, CASE WHEN n_group >= 10 THEN 'sic_major_group' WHEN n_all > 0 THEN 'all_earlier_events' ELSE 'none_available' END AS prior_source, round({RATE.format(default='0.5')}, 8) AS history_rate FROM v_history WHERE target <> 'day1_close_return'""", ["v_history"])
def a14(spark, sf):
    return P.issuer_history(history(spark, sf, only=HIST[:2])).select("event_id", "target", "role", "prior_source", F.round("history_rate", 8).alias("history_rate"))


@query("a15_issuer_history_mean", f"SELECT event_id, role, round({RATE.format(default='NULL')}, 7) + 0.0 AS history_mean FROM v_history WHERE target = 'day1_close_return'", ["v_history"])
def a15(spark, sf):
    return P.issuer_history(history(spark, sf, only=HIST[2:])).select("event_id", "role", r("history_mean", 7))


@query("a16_issuer_context", """
SELECT event_id, role, round(CASE WHEN n_own > 0 THEN (s_own - n_own * (s_all / n_all)) / (n_own + 10) ELSE 0 END, 7) + 0.0 AS context FROM v_history_strict WHERE target = 'day1_close_return'""", ["v_history_strict"])
def a16(spark, sf):
    return P.issuer_context(history(spark, sf, True, HIST[2:])).select("event_id", "role", r("context", 7))


@query("w18_recent_analogues", """
SELECT event_id, target, count(*) AS n_sessions_used, CASE WHEN count(*) >= 5 THEN round(avg(y), 8) + 0.0 END AS analogue FROM (
SELECT *, row_number() OVER (PARTITION BY event_id, target ORDER BY session DESC) AS k FROM (
SELECT q.event_id, q.target, h.reaction_idx AS session, arg_min(h.y, h.event_id) AS y FROM v_targets q JOIN v_targets h ON h.target = q.target AND h.cik <> q.cik AND h.timing = q.timing AND h.reaction_idx < q.reaction_idx
 AND h.y IS NOT NULL AND h.matures_at < q.cutoff WHERE q.target IN ('gap_ge_3pct', 'day1_close_return') GROUP BY 1, 2, 3)) WHERE k <= 10 GROUP BY 1, 2""", ["v_targets"])
def w18(spark, sf):
    return P.recent_analogues(cut_lineage(target_rows(spark, sf, ("gap_ge_3pct", "day1_close_return")))).select("event_id", "target", "n_sessions_used", r("analogue", 8))


VIEWS["v_pooled"] = (("v_folds",), "SELECT target, knd, version, fold, count(*) AS pooled_n, avg(y) AS pooled_rate, list(y) AS ys FROM v_folds WHERE role = 'train' AND y IS NOT NULL GROUP BY ALL")


@query("a13_pooled_rate", "SELECT target, version, CAST(fold AS BIGINT) AS fold, pooled_n, round(pooled_rate, 8) + 0.0 AS pooled_rate FROM v_pooled", ["v_pooled"])
def a13(spark, sf):
    return P.pooled_rates(fold_rows(spark, sf)).select("target", "version", F.col("fold").cast("bigint").alias("fold"), "pooled_n", r("pooled_rate", 8))


@query("a11_cell_rate", """
SELECT f.event_id, f.target, f.version, CAST(f.fold AS BIGINT) AS fold, coalesce(c.n, 0) < 10 AS fallback, round(CASE WHEN coalesce(c.n, 0) >= 10 THEN c.m ELSE p.pooled_rate END, 8) + 0.0 AS p
FROM v_folds f JOIN v_pooled p USING (target, version, fold) LEFT JOIN (SELECT target, version, fold, sic_division, count(*) AS n, avg(y) AS m FROM v_folds WHERE role = 'train' AND y IS NOT NULL GROUP BY 1, 2, 3, 4) c USING (target, version, fold, sic_division)
WHERE f.role = 'test' AND f.target IN ('gap_ge_3pct', 'gap_ge_5pct')""", ["v_folds", "v_pooled"])
def a11(spark, sf):
    f = cut_lineage(fold_rows(spark, sf, HIST[:2]))
    return P.cell_rates(f, "sic_division").select("event_id", "target", "version", F.col("fold").cast("bigint").alias("fold"), "fallback", r("p", 8))


@query("a12_cell_quantiles", """
SELECT f.event_id, f.version, CAST(f.fold AS BIGINT) AS fold, coalesce(c.n, 0) < 10 AS fallback, round(CASE WHEN coalesce(c.n, 0) >= 10 THEN c.a ELSE p.a END, 8) + 0.0 AS q10, round(CASE WHEN coalesce(c.n, 0) >= 10 THEN c.b ELSE p.b END, 8) + 0.0 AS q50,
 round(CASE WHEN coalesce(c.n, 0) >= 10 THEN c.c ELSE p.c END, 8) + 0.0 AS q90
FROM v_folds f JOIN (SELECT version, fold, quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.9) AS c FROM v_folds WHERE target = 'day1_close_return' AND role = 'train' AND y IS NOT NULL GROUP BY 1, 2) p USING (version, fold)
LEFT JOIN (SELECT version, fold, timing, count(*) AS n, quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.9) AS c FROM v_folds WHERE target = 'day1_close_return' AND role = 'train' AND y IS NOT NULL GROUP BY 1, 2, 3) c USING (version, fold, timing)
WHERE f.role = 'test' AND f.target = 'day1_close_return'""", ["v_folds"])
def a12(spark, sf):
    f = cut_lineage(fold_rows(spark, sf, HIST[2:]))
    q = lambda i, n: (F.round(F.element_at("q", i), 8) + 0.0).alias(n)
    return P.cell_quantiles(f, "timing").select("event_id", "version", F.col("fold").cast("bigint").alias("fold"), "fallback", q(1, "q10"), q(2, "q50"), q(3, "q90"))


# ---- predictions: issuer history against the pooled rate ----
VIEWS["v_preds"] = (("v_history", "v_pooled", "v_folds"), f"""
SELECT f.target, f.version, f.fold, f.event_id, f.reaction_idx AS session, f.cik AS issuer, f.category AS source, f.y, p.pooled_rate AS base_rate, {R10.format('p.pooled_rate')} AS baseline, {R10.format(RATE.format(default='0.5'))} AS p,
 f.close / f.anchor_close - 1 AS ret
FROM v_folds f JOIN v_pooled p USING (target, version, fold) JOIN v_history h ON h.event_id = f.event_id AND h.target = f.target AND h.role = 'test'
WHERE f.role = 'test' AND f.y IS NOT NULL AND f.target IN ('gap_ge_3pct', 'gap_ge_5pct') AND f.version = 'all_event'""")


def predictions(spark, sf):
    return shared_table(spark, ("predictions", sf), lambda: build_predictions(spark, sf))


def build_predictions(spark, sf):
    t = target_rows(spark, sf, HIST[:2])
    hist = P.issuer_history(P.history_sums(P.with_clocks(t))).filter("role = 'test'").select("event_id", "target", F.round("history_rate", 10).alias("p"))
    f = P.folds(t.withColumn("version", F.lit("all_event")))
    rates = P.pooled_rates(f).select("target", "version", "fold", F.col("pooled_rate").alias("base_rate"))
    test = f.filter("role = 'test' and y is not null").join(rates, ["target", "version", "fold"]).join(hist, ["event_id", "target"])
    out = test.select("target", "version", "fold", "event_id", F.col("reaction_idx").alias("session"), F.col("cik").alias("issuer"), F.col("category").alias("source"), "y", "base_rate",
                      F.round("base_rate", 10).alias("baseline"), "p")
    return out


BRIER = "round(avg(pow(p - y, 2)), 8) + 0.0 AS brier"
LOGLOSS = "round(avg(CASE WHEN y > 0 THEN -ln(least(greatest(p, 1e-6), 1 - 1e-6)) ELSE -ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) END), 8) + 0.0 AS log_loss"
CONF = "count_if(y > 0 AND p >= base_rate) AS tp, count_if(y > 0 AND p < base_rate) AS fn, count_if(y = 0 AND p >= base_rate) AS fp, count_if(y = 0 AND p < base_rate) AS tn"


@query("x01_losses", f"SELECT target, CAST(fold AS BIGINT) AS fold, count(*) AS n, {BRIER}, {LOGLOSS} FROM v_preds GROUP BY 1, 2", ["v_preds"])
def x01(spark, sf):
    return X.binary_metrics(predictions(spark, sf), ["target", "fold"]).select("target", F.col("fold").cast("bigint").alias("fold"), "n", r("brier", 8), r("log_loss", 8))


@query("x03_confusion", f"SELECT *, round(fp / nullif(fp + tn, 0), 8) AS fpr, round(fn / nullif(fn + tp, 0), 8) AS fnr FROM (SELECT target, {CONF} FROM v_preds GROUP BY 1)", ["v_preds"])
def x03(spark, sf):
    return X.binary_metrics(predictions(spark, sf), ["target"]).select("target", "tp", "fn", "fp", "tn", F.round("fpr", 8).alias("fpr"), F.round("fnr", 8).alias("fnr"))


@query("x10_metrics_by_scope", f"""
SELECT target, scope, scope_key, count(*) AS n, {BRIER}, {LOGLOSS}, {CONF} FROM (SELECT *, unnest(['pooled', 'fold', 'source']) AS scope, unnest(['*', CAST(fold AS VARCHAR), source]) AS scope_key FROM v_preds) GROUP BY 1, 2, 3""", ["v_preds"])
def x10(spark, sf):
    return X.pooled_by_fold_and_source(predictions(spark, sf)).select("target", "scope", "scope_key", "n", r("brier", 8), r("log_loss", 8), "tp", "fn", "fp", "tn")


@query("x02_quantile_metrics", """
SELECT version, count(*) AS n, round(avg((a1 + a2 + a3) / 3), 8) AS mean_pinball, round(avg(a1), 8) AS pinball_10, round(avg(a2), 8) AS pinball_50, round(avg(a3), 8) AS pinball_90, round(avg(CASE WHEN y >= a AND y <= c THEN 1.0 ELSE 0.0 END), 8) AS interval_coverage,
 round(avg(abs(y - b)), 8) AS mae_of_the_median FROM (SELECT f.version, f.y, p.*, greatest(0.1 * (y - a), -0.9 * (y - a)) AS a1, greatest(0.5 * (y - b), -0.5 * (y - b)) AS a2, greatest(0.9 * (y - c), (0.9 - 1) * (y - c)) AS a3
FROM v_folds f JOIN (SELECT version AS v2, fold AS f2, quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.9) AS c FROM v_folds WHERE target = 'day1_close_return' AND role = 'train' AND y IS NOT NULL GROUP BY 1, 2) p ON p.v2 = f.version AND p.f2 = f.fold
WHERE f.role = 'test' AND f.target = 'day1_close_return' AND f.y IS NOT NULL) GROUP BY 1""", ["v_folds"])
def x02(spark, sf):
    f = cut_lineage(fold_rows(spark, sf, HIST[2:]))
    q = exact_quantiles(f.filter("role = 'train' and y is not null"), ["target", "version", "fold"], "y", P.QUANTILES)
    m = X.regression_metrics(f.filter("role = 'test' and y is not null").join(q.drop("n"), ["target", "version", "fold"]), ["version"])
    return m.select("version", "n", *[F.round(c, 8).alias(c) for c in ("mean_pinball", "pinball_10", "pinball_50", "pinball_90", "interval_coverage", "mae_of_the_median")])


@query("w14_reliability_bins", f"""
SELECT target, bin, n, round(mp, 8) AS mean_prediction, round(k / n, 8) AS observed_rate, {WILSON.replace(', 10)', ', 8)')} FROM (
SELECT target, bin, count(*) AS n, avg(p) AS mp, sum(y) AS k FROM (SELECT target, p, y, CASE WHEN pos < e * (s + 1) THEN pos // (s + 1) ELSE e + (pos - e * (s + 1)) // s END + 1 AS bin FROM (
 SELECT *, n // b AS s, n - (n // b) * b AS e FROM (SELECT *, least(4, n // 10) AS b FROM (SELECT target, p, y, row_number() OVER (PARTITION BY target ORDER BY p, event_id) - 1 AS pos, count(*) OVER (PARTITION BY target) AS n FROM v_preds)) WHERE b >= 1)) GROUP BY 1, 2)""", ["v_preds"])
def w14(spark, sf):
    return X.reliability(predictions(spark, sf), ["target"]).select("target", F.col("bin").cast("bigint").alias("bin"), "n", *[F.round(c, 8).alias(c) for c in ("mean_prediction", "observed_rate", "wilson_low", "wilson_high")])


@query("w15_terciles", """
SELECT target, tercile, count(*) AS events, round(avg(y), 8) AS mean_outcome FROM (SELECT target, y, ntile(3) OVER (PARTITION BY target ORDER BY p, event_id) AS tercile FROM v_preds) GROUP BY 1, 2""", ["v_preds"])
def w15(spark, sf):
    t = terciles(predictions(spark, sf), "p", "event_id", ["target"])
    return t.groupBy("target", F.col("tercile").cast("bigint").alias("tercile")).agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("y"), 8).alias("mean_outcome"))


@query("w16_average_precision", """
SELECT target, round(sum(pos / total * cp / cn), 8) AS average_precision FROM (SELECT target, pos, sum(pos) OVER (PARTITION BY target) AS total, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM
(SELECT target, p, sum(y) AS pos, count(*) AS n FROM v_preds GROUP BY 1, 2) WINDOW w AS (PARTITION BY target ORDER BY p DESC)) GROUP BY 1""", ["v_preds"])
def w16(spark, sf):
    return average_precision(predictions(spark, sf), "p", "y", ["target"]).select("target", F.round("average_precision", 8).alias("average_precision"))


@query("o03_precision_at_k", """
SELECT target, CAST(fold AS BIGINT) AS fold, n, k, round(s / k, 8) AS precision FROM (SELECT target, fold, n, k, sum(y) AS s FROM (SELECT target, fold, y, row_number() OVER (PARTITION BY target, fold ORDER BY p DESC, event_id) AS rn, count(*) OVER (PARTITION BY target, fold) AS n FROM v_preds), (VALUES (5), (10)) v(k)
WHERE rn <= k AND n >= 2 * k GROUP BY target, fold, n, k)""", ["v_preds"])
def o03(spark, sf):
    return X.precision_at_k(predictions(spark, sf), (5, 10), ["target", "fold"]).select("target", F.col("fold").cast("bigint").alias("fold"), "n", "k", F.round("precision", 8).alias("precision"))


RANDOM = """
SELECT target, avg(v) AS random_mean, quantile_cont(v, 0.025) AS random_low, quantile_cont(v, 0.975) AS random_high FROM (SELECT target, rep, sum(y) / 20 AS v FROM (
SELECT target, unnest(list_reduce(list_transform(range(20), lambda s: [CAST('0x' || md5('7|' || rep || '|' || s)[1:8] AS BIGINT) % (n - 20 + s + 1)]), lambda taken, d: list_append(taken, CASE WHEN list_contains(taken, d[1]) THEN n - 20 + len(taken) ELSE d[1] END))) AS position, rep
 FROM (SELECT target, count(*) AS n FROM v_preds GROUP BY 1), range(1000) t(rep) WHERE n >= 40)
JOIN (SELECT target, y, row_number() OVER (PARTITION BY target ORDER BY event_id) - 1 AS position FROM v_preds) USING (target, position) GROUP BY 1, 2) GROUP BY 1"""


@query("o05_random_ranking", f"SELECT target, round(random_mean, 8) AS random_mean, round(random_low, 8) AS random_low, round(random_high, 8) AS random_high FROM ({RANDOM})", ["v_preds"])
def o05(spark, sf):
    return X.random_precision(predictions(spark, sf), 20, ["target"], seed=7).select("target", *[F.round(c, 8).alias(c) for c in ("random_mean", "random_low", "random_high")])


@query("o04_lift", f"""
SELECT p.target, p.n, round(p.precision / p.base_rate, 8) AS lift_over_base, round(p.precision / r.random_mean, 8) AS lift_over_random FROM (
SELECT target, count(*) AS n, avg(base_rate) AS base_rate, sum(y) FILTER (rn <= 20) / 20 AS precision FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p DESC, event_id) AS rn FROM v_preds) GROUP BY 1) p JOIN ({RANDOM}) r USING (target) WHERE n >= 40""", ["v_preds"])
def o04(spark, sf):
    preds = predictions(spark, sf)
    out = X.lift(X.precision_at_k(preds, (20,), ["target"]), X.random_precision(preds, 20, ["target"], seed=7), ["target"])
    return out.select("target", "n", F.round("lift_over_base", 8).alias("lift_over_base"), F.round("lift_over_random", 8).alias("lift_over_random"))


def losses(preds):
    model = preds.withColumn("loss", X.event_brier("p", "y"))
    base = preds.withColumn("loss", X.event_brier("baseline", "y"))
    return model, base


@query("j18_paired_predictions", """
SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.target, b.target) AS target, a.event_id IS NOT NULL AND b.event_id IS NOT NULL AS paired, round(a.loss - b.loss, 8) + 0.0 AS difference FROM
(SELECT target, fold, event_id, pow(p - y, 2) AS loss FROM v_preds) a FULL JOIN (SELECT target, fold, event_id, pow(baseline - y, 2) AS loss FROM v_preds WHERE session % 5 <> 0) b USING (target, fold, event_id)""", ["v_preds"])
def j18(spark, sf):
    model, base = losses(predictions(spark, sf))
    return X.pair_predictions(model, base.filter("session % 5 <> 0")).select("event_id", "target", "paired", r("difference", 8))


BOOT = """
d AS (SELECT target, axis, cluster, sum(pow(p - y, 2) - pow(baseline - y, 2)) AS total, count(*) AS size FROM (SELECT *, unnest(['session', 'issuer']) AS axis, unnest([CAST(session AS VARCHAR), issuer]) AS cluster FROM v_preds) GROUP BY 1, 2, 3),
c AS (SELECT *, row_number() OVER (PARTITION BY target, axis ORDER BY cluster) - 1 AS j, count(*) OVER (PARTITION BY target, axis) AS m FROM d),
s AS (SELECT target, axis, rep, CAST('0x' || md5('11|' || rep || '|' || j)[1:8] AS BIGINT) % m AS j FROM c, range(5000) t(rep)),
b AS (SELECT s.target, s.axis, rep, sum(total) / sum(size) AS v FROM s JOIN c USING (target, axis, j) GROUP BY 1, 2, 3),
boot AS (SELECT e.*, low_95, high_95, low_99, high_99 FROM (SELECT target, axis, sum(total) / sum(size) AS estimate, CAST(sum(size) AS BIGINT) AS events, count(*) AS clusters FROM c GROUP BY 1, 2) e
 JOIN (SELECT target, axis, quantile_cont(v, 0.025) AS low_95, quantile_cont(v, 0.975) AS high_95, quantile_cont(v, 0.005) AS low_99, quantile_cont(v, 0.995) AS high_99 FROM b GROUP BY 1, 2) USING (target, axis))"""


def bootstrap(spark, sf):
    """One table of replicate bands for X4, X5 and X7."""
    def build():
        model, base = losses(predictions(spark, sf))
        return X.cluster_bootstrap(X.pair_predictions(model, base).filter("paired"), ["target"], seed=11)
    return shared_table(spark, ("bootstrap", sf), build)


@query("x04_cluster_bootstrap", f"WITH {BOOT} SELECT target, axis, events, clusters, round(estimate, 7) + 0.0 AS estimate, round(low_95, 7) + 0.0 AS low_95, round(high_95, 7) + 0.0 AS high_95, round(low_99, 7) + 0.0 AS low_99, round(high_99, 7) + 0.0 AS high_99 FROM boot", ["v_preds"])
def x04(spark, sf):
    return bootstrap(spark, sf).select("target", "axis", "events", "clusters", *[r(c, 7) for c in ("estimate", "low_95", "high_95", "low_99", "high_99")])


@query("x05_headline_interval", f"""
WITH {BOOT} SELECT target, round(any_value(estimate), 7) + 0.0 AS estimate, arg_max(axis, {{'w': high_99 - low_99, 'r': CASE WHEN axis = 'session' THEN 0 ELSE -1 END}}) AS clustering, round(min(low_99), 7) + 0.0 AS envelope_low, round(max(high_99), 7) + 0.0 AS envelope_high FROM boot GROUP BY 1""", ["v_preds"])
def x05(spark, sf):
    return X.headline(bootstrap(spark, sf), ["target"]).select("target", r("estimate", 7), "clustering", r("envelope_low", 7), r("envelope_high", 7))


@query("x06_contrasts", """
SELECT target, model, baseline, scope, count(d) AS events, count(*) - count(d) AS unpaired, CASE WHEN count(*) = count(d) THEN round(avg(d), 8) + 0.0 END AS estimate FROM (
SELECT target, 'history' AS model, 'pooled' AS baseline, pow(p - y, 2) - pow(v_preds.baseline - y, 2) AS d, unnest(['pooled', 'fold ' || fold]) AS scope FROM v_preds
UNION ALL SELECT target, 'history', 'constant', pow(p - y, 2) - pow(0.5 - y, 2), unnest(['pooled', 'fold ' || fold]) FROM v_preds) GROUP BY ALL""", ["v_preds"])
def x06(spark, sf):
    p = predictions(spark, sf)
    long = (p.withColumn("_r", F.explode(F.array(F.struct(F.lit("history").alias("predictor"), X.event_brier("p", "y").alias("loss")), F.struct(F.lit("pooled").alias("predictor"), X.event_brier("baseline", "y").alias("loss")),
                                                 F.struct(F.lit("constant").alias("predictor"), F.pow(F.lit(0.5) - F.col("y"), 2).alias("loss"))))).select("target", "version", "fold", "event_id", "_r.*"))
    return X.contrasts(long, [("history", "pooled"), ("history", "constant")]).select("target", "model", "baseline", "scope", "events", "unpaired", r("estimate", 8))


@query("x07_decision", f"""
WITH {BOOT} SELECT target, CASE WHEN events < 50 THEN 'INSUFFICIENT_DATA' WHEN max(high_99) < 0 AND any_value(estimate) < 0 THEN 'DISTINGUISHABLE_BETTER' WHEN min(low_99) > 0 AND any_value(estimate) > 0 THEN 'DISTINGUISHABLE_WORSE' ELSE 'NOT_DISTINGUISHABLE' END AS status
FROM boot GROUP BY target, events""", ["v_preds"])
def x07(spark, sf):
    b = bootstrap(spark, sf)
    h = X.headline(b, ["target"]).join(b.groupBy("target").agg(F.max("events").alias("events")), "target")
    h = h.withColumn("state", F.when(F.col("events") >= 50, "EVALUABLE").otherwise("INSUFFICIENT_DATA")).withColumn("all_event_estimate", F.col("estimate"))
    return h.select("target", X.decide(low="envelope_low", high="envelope_high").alias("status"))


@query("x08_promotion_gates", """
SELECT target, concat_ws(',', CASE WHEN n < 200 THEN 'support' END, CASE WHEN issuers < 30 THEN 'issuers' END, CASE WHEN sessions < 10 THEN 'sessions' END, CASE WHEN abs(mp - my) > 0.1 THEN 'calibration' END, CASE WHEN red < 0 OR red IS NULL THEN 'reduction' END) AS failed_gates
FROM (SELECT target, count(*) AS n, count(DISTINCT issuer) AS issuers, count(DISTINCT session) AS sessions, avg(p) AS mp, avg(y) AS my, 1 - avg(pow(p - y, 2)) / avg(pow(baseline - y, 2)) AS red FROM v_preds GROUP BY 1)""", ["v_preds"])
def x08(spark, sf):
    return X.promotion_gates(predictions(spark, sf), ["target"]).select("target", F.array_join("failed_gates", ",").alias("failed_gates"))


@query("x09_mse_reduction", """
SELECT target, CAST(fold AS BIGINT) AS fold, count(*) AS pairs, round(avg(pow(y - baseline, 2)), 8) AS baseline_mse, round(avg(pow(y - p, 2)), 8) AS challenger_mse, round((avg(pow(y - baseline, 2)) - avg(pow(y - p, 2))) / nullif(avg(pow(y - baseline, 2)), 0), 7) + 0.0 AS relative_reduction FROM v_preds GROUP BY 1, 2""", ["v_preds"])
def x09(spark, sf):
    m = X.mse_reduction(predictions(spark, sf).withColumn("challenger", F.col("p")), ["target", "fold"])
    return m.select("target", F.col("fold").cast("bigint").alias("fold"), "pairs", F.round("baseline_mse", 8).alias("baseline_mse"), F.round("challenger_mse", 8).alias("challenger_mse"), r("relative_reduction", 7))


Z = normal_quantile(0.95)
WL = f"greatest(0.0, ((h / k + {Z} * {Z} / (2 * k)) - {Z} * sqrt(h / k * (1 - h / k) / k + {Z} * {Z} / (4.0 * k * k))) / (1 + {Z} * {Z} / k))"


@query("x11_precision_plan", f"""
SELECT target, round(base_rate, 8) AS base_rate, k, min(h) AS hits_needed, round(min(h) / k, 8) AS precision_needed FROM (SELECT target, avg(y) AS base_rate FROM v_targets WHERE knd = 'binary' AND y IS NOT NULL GROUP BY 1) t, (VALUES (10), (20), (40)) v(k), range(41) r(h)
WHERE h <= k AND {WL} > base_rate GROUP BY target, base_rate, k""", ["v_targets"])
def x11(spark, sf):
    rates = target_rows(spark, sf).filter("kind = 'binary' and y is not null").groupBy("target").agg(F.avg("y").alias("base_rate"))
    return X.precision_plan(rates).select("target", F.round("base_rate", 8).alias("base_rate"), "k", F.col("hits_needed").cast("bigint").alias("hits_needed"), F.round("precision_needed", 8).alias("precision_needed"))


@query("x11_interval_plan", f"""
WITH {BOOT}, scores AS (SELECT target, avg(pow(baseline - y, 2)) AS score FROM v_preds GROUP BY 1)
SELECT target, events, round(w / score, 6) AS half_width_share, CAST(ceil(events * pow(w / score / 0.05, 2)) AS BIGINT) AS events_for_5_percent, CAST(ceil(events * pow(w / score / 0.1, 2)) AS BIGINT) AS events_for_10_percent, round(w / score / 2, 6) AS share_at_4x
FROM (SELECT target, events, (high_99 - low_99) / 2 AS w FROM boot WHERE axis = 'session') JOIN scores USING (target)""", ["v_preds"])
def x11_plan(spark, sf):
    b = bootstrap(spark, sf).filter("axis = 'session'").select("target", "events", ((F.col("high_99") - F.col("low_99")) / 2).alias("half_width"))
    score = predictions(spark, sf).groupBy("target").agg(F.avg(X.event_brier("baseline", "y")).alias("comparator_score"))
    out = X.interval_plan(b.join(score, "target"))
    return out.select("target", "events", F.round("half_width_share", 6).alias("half_width_share"), "events_for_5_percent", "events_for_10_percent", F.round("share_at_4x", 6).alias("share_at_4x"))


@query("x11_wilson_widths", f"""
SELECT target, n, rate, round((high - low) / 2, 8) AS halfwidth FROM (SELECT *, greatest(0.0, ((h / n + {Z} * {Z} / (2 * n)) - {Z} * sqrt(h / n * (1 - h / n) / n + {Z} * {Z} / (4.0 * n * n))) / (1 + {Z} * {Z} / n)) AS low,
 least(1.0, ((h / n + {Z} * {Z} / (2 * n)) + {Z} * sqrt(h / n * (1 - h / n) / n + {Z} * {Z} / (4.0 * n * n))) / (1 + {Z} * {Z} / n)) AS high FROM (
SELECT target, n, rate, round_even(rate * n, 0) AS h FROM (SELECT target, count(*) AS n FROM v_targets WHERE knd = 'binary' AND y IS NOT NULL GROUP BY 1), (VALUES (0.1), (0.25), (0.5)) v(rate)))""", ["v_targets"])
def x11_widths(spark, sf):
    sizes = target_rows(spark, sf).filter("kind = 'binary' and y is not null").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return X.wilson_plan(sizes).select("target", "n", "rate", F.round("halfwidth", 8).alias("halfwidth"))


@query("x12_sign_check", """
SELECT target, d IS NOT NULL AS comparable, CAST(sign(h) AS INTEGER) AS holdout_sign, CAST(sign(d) AS INTEGER) AS development_sign, CASE WHEN d IS NOT NULL THEN sign(h) = sign(d) AND h <> 0 END AS same_sign FROM (
SELECT target, avg(pow(p - y, 2) - pow(baseline - y, 2)) FILTER (fold < (SELECT max(fold) FROM v_preds)) AS d, avg(pow(p - y, 2) - pow(baseline - y, 2)) FILTER (fold = (SELECT max(fold) FROM v_preds)) AS h FROM v_preds GROUP BY 1)""", ["v_preds"])
def x12(spark, sf):
    p = predictions(spark, sf)
    d = X.event_brier("p", "y") - X.event_brier("baseline", "y")
    g = (p.groupBy("target", "fold").agg(F.sum(d).alias("s"), F.count(F.lit(1)).alias("n")).withColumn("last", F.max("fold").over(W.partitionBy("target"))))
    mean = lambda cond: F.sum(F.when(cond, F.col("s"))) / F.sum(F.when(cond, F.col("n")))
    e = g.groupBy("target").agg(mean(F.col("fold") < F.col("last")).alias("development"), mean(F.col("fold") == F.col("last")).alias("holdout"))
    return X.sign_check(e).select("target", "comparable", "holdout_sign", "development_sign", "same_sign")


@query("x13_structure_audit", """
SELECT CAST(f.fold AS BIGINT) AS fold, f.target, count(*) AS test_events, count_if(coalesce(c.n, 0) < 10) AS fallbacks, count_if(h.n_own = 0) AS without_own_history, count_if(h.n_all = 0) AS without_any_history
FROM v_folds f LEFT JOIN (SELECT target, fold, sic_division, count(y) AS n FROM v_folds WHERE role = 'train' AND version = 'all_event' GROUP BY 1, 2, 3) c ON c.target = f.target AND c.fold = f.fold AND c.sic_division = f.sic_division
JOIN v_history h ON h.event_id = f.event_id AND h.target = f.target AND h.role = 'test' WHERE f.role = 'test' AND f.version = 'all_event' AND f.target IN ('gap_ge_3pct', 'gap_ge_5pct') GROUP BY 1, 2""", ["v_folds", "v_history"])
def x13(spark, sf):
    """Before any scoring: small cells, fallbacks and events without history, from defined-ness alone; no outcome value is read."""
    t = cut_lineage(target_rows(spark, sf, HIST[:2]).withColumn("y", F.when(F.col("y").isNotNull(), F.lit(1.0))))
    f = P.folds(t)
    cells = f.filter("role = 'train'").groupBy("target", "fold", "sic_division").agg(F.count("y").alias("cell_n"))
    hist = P.history_sums(P.with_clocks(t)).filter("role = 'test'").select("event_id", "target", "n_own", "n_all")
    out = f.filter("role = 'test'").join(cells, ["target", "fold", "sic_division"], "left").join(hist, ["event_id", "target"])
    return out.groupBy(F.col("fold").cast("bigint").alias("fold"), "target").agg(F.count(F.lit(1)).alias("test_events"), F.count_if(F.coalesce("cell_n", F.lit(0)) < 10).alias("fallbacks"),
                                                                             F.count_if(F.col("n_own") == 0).alias("without_own_history"), F.count_if(F.col("n_all") == 0).alias("without_any_history"))


_IND = {"after_hours": "timing = 'after_hours'", "is_I": "sic_division = 'I'", "is_other": "sic_division NOT IN ('D', 'I')", "is_open": "open IS NOT NULL"}


@query("x13_before_scoring", f"""
WITH d AS (SELECT f.*, h.n_own, h.n_all, {', '.join(f"CASE WHEN f.{e} THEN 1 ELSE 0 END AS {i}" for i, e in _IND.items())} FROM v_folds f JOIN v_history h ON h.event_id = f.event_id AND h.target = f.target AND h.role = 'test' WHERE f.y IS NOT NULL AND f.target IN ('gap_ge_3pct', 'gap_ge_5pct', 'day1_close_return')),
c AS (SELECT target, version, fold, cell, value, count(*) FILTER (role = 'train') AS a, count(*) FILTER (role = 'test') AS b FROM (SELECT *, unnest(['timing', 'sic_division']) AS cell, unnest([timing, sic_division]) AS value FROM d) GROUP BY ALL),
w AS (SELECT target, version, fold, count(*) FILTER (cell = 'timing' AND a BETWEEN 1 AND 9) AS small_timing, count(*) FILTER (cell = 'sic_division' AND a BETWEEN 1 AND 9) AS small_division, coalesce(sum(b) FILTER (cell = 'timing' AND a < 10), 0) AS fall_timing, coalesce(sum(b) FILTER (cell = 'sic_division' AND a < 10), 0) AS fall_division FROM c GROUP BY 1, 2, 3)
SELECT target, version, CAST(fold AS BIGINT) AS fold, count(*) FILTER (role = 'train') AS train_events, count(*) FILTER (role = 'test') AS test_events, count(*) FILTER (role = 'train' AND n_all = 0) AS train_without_any, count(*) FILTER (role = 'test' AND n_all = 0) AS test_without_any,
 count(*) FILTER (role = 'test' AND n_own = 0) AS test_without_own, concat_ws(',', {', '.join(f"CASE WHEN coalesce(sum({i}) FILTER (role = 'train'), 0) IN (0, count(*) FILTER (role = 'train')) THEN '{i}' END" for i in sorted(_IND))}) AS constant_indicators, count(*) FILTER (role = 'train' AND event_no % 3 = 0) AS train_undefined_gap,
 count(*) FILTER (role = 'test' AND event_no % 3 = 0) AS test_undefined_gap, any_value(small_timing) AS small_timing, CAST(any_value(fall_timing) AS BIGINT) AS fall_timing, any_value(small_division) AS small_division, CAST(any_value(fall_division) AS BIGINT) AS fall_division FROM d JOIN w USING (target, version, fold) GROUP BY 1, 2, 3""", ["v_folds", "v_history"])
def x13_audit(spark, sf):
    """The library form over three targets in both versions; every third event stands for one without an opening gap."""
    t = version_rows(spark, sf, HIST).join(study_events(spark, sf).select("event_id", F.col("open").isNotNull().alias("is_open")), "event_id")
    g = F.col("sic_division")
    t = cut_lineage(t.withColumns({"after_hours": F.col("timing") == "after_hours", "is_I": g == "I", "is_other": ~g.isin("D", "I"), "gap": F.when(F.col("event_no") % 3 != 0, 1)}).withColumns({i: F.col(i).cast("int") for i in _IND}))
    hist = P.history_sums(P.with_clocks(target_rows(spark, sf, HIST))).filter("role = 'test'")
    a = P.structure_audit(t, hist, indicators=tuple(_IND), gap="gap")
    return a.select("target", "version", F.col("fold").cast("bigint").alias("fold"), "train_events", "test_events", "train_without_any", "test_without_any", "test_without_own", F.array_join("constant_indicators", ",").alias("constant_indicators"), "train_undefined_gap", "test_undefined_gap",
                    F.col("small_cells_timing").alias("small_timing"), F.col("fallbacks_timing").alias("fall_timing"), F.col("small_cells_sic_division").alias("small_division"), F.col("fallbacks_sic_division").alias("fall_division")).filter("train_events + test_events > 0")


@query("p10_nested_cap", """
SELECT b.event_id, CAST(b.fold AS BIGINT) AS fold, CASE WHEN a.p IS NOT NULL THEN round(least(b.p, a.p), 8) END AS p, coalesce(b.p > a.p, false) AS repaired, a.p IS NULL AS looser_missing FROM v_preds b LEFT JOIN v_preds a ON a.event_id = b.event_id AND a.fold = b.fold AND a.target = 'gap_ge_3pct' WHERE b.target = 'gap_ge_5pct'""", ["v_preds"])
def p10(spark, sf):
    p = predictions(spark, sf)
    out = P.cap_nested(p.filter("target = 'gap_ge_3pct'"), p.filter("target = 'gap_ge_5pct'"), ("event_id", "fold"))
    return out.select("event_id", F.col("fold").cast("bigint").alias("fold"), F.round("p", 8).alias("p"), "repaired", "looser_missing")


@query("p15_select_config", """
SELECT target, arg_min(config, {'l': loss, 'o': ord}) AS chosen FROM (SELECT target, config, ord, round(avg(pow(q - y, 2)), 10) AS loss FROM (
SELECT target, y, unnest(['history', 'pooled', 'half', 'blend']) AS config, unnest([0, 1, 2, 3]) AS ord, unnest([p, baseline, 0.5, (p + baseline) / 2]) AS q FROM v_preds) GROUP BY 1, 2, 3) GROUP BY 1""", ["v_preds"])
def p15(spark, sf):
    from tidemark.plans.models import select_config
    options = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(i).alias("config_order"), q.alias("q")) for i, (n, q) in enumerate(
        [("history", F.col("p")), ("pooled", F.col("baseline")), ("half", F.lit(0.5)), ("blend", (F.col("p") + F.col("baseline")) / 2)])])
    long = predictions(spark, sf).withColumn("_o", F.explode(options)).select("target", "y", "_o.*").withColumn("loss", F.pow(F.col("q") - F.col("y"), 2))
    return select_config(long, ["target"]).select("target", F.col("config").alias("chosen"))
