"""Registered queries: market structure, reports, sources, audits (W7-W13, W17, W20, A17-A30, L15-L18, S, Q, O6)."""
import uuid

from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.calendar_queries import CLASSIFY
from tidemark.catalog.enrich_queries import _pick, _sqlpick
from tidemark.catalog.fold_queries import GAP, caveats, fold_rows, r, target_rows
from tidemark.catalog.label_queries import outcomes
from tidemark.catalog.oracle_views import VIEWS
from tidemark.catalog.registry import ORACLES, query
from tidemark.catalog.study_queries import CELLS_AS_OF, WILSON, study_events, study_labels
from tidemark.operators import sessions as cal, validate as V
from tidemark.plans import audit as Q, cells as C, enrich as E, folds as P, structure as S, summaries as R
from tidemark.plans.outcomes import LABELS
from tidemark.runtime import cut_lineage, shared_folder
from tidemark.sources import documents as D, snapshots as N

# ---- market structure over the long bars ----
VIEWS["v_lsessions"] = (("v_long_bars",), "SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT session FROM v_long_bars)")
VIEWS["v_lactions"] = (("v_lsessions",), """
SELECT DISTINCT security_id, kind, d FROM (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS security_id, 'action' AS kind, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_orderkey % 211 = 0 AND l_linenumber = 1
 UNION ALL SELECT CAST(o_custkey % 5 AS VARCHAR), 'span', CAST(o_orderdate AS DATE) + k.k FROM orders, (VALUES (0), (1), (2), (3)) k(k) WHERE o_orderkey % 1999 = 5)""")
VIEWS["v_lgrid"] = (("v_lsessions", "v_lactions"), """
SELECT s.security_id, d.idx, d.session, b.open, b.high, b.low, CASE WHEN b.volume % 311 = 0 THEN -1.0 ELSE b.close END AS close, b.volume FROM (SELECT DISTINCT security_id FROM v_long_bars) s CROSS JOIN v_lsessions d LEFT JOIN v_long_bars b ON b.security_id = s.security_id AND b.session = d.session""")


def _why(length, fields):
    good = " AND ".join(f"{f} > 0" for f in fields)
    return f"""CASE WHEN idx + 1 < {length} THEN 'insufficient_history'
 WHEN EXISTS (SELECT 1 FROM v_lactions a WHERE a.security_id = g.security_id AND a.kind = 'span' AND a.d BETWEEN g.first_{length} AND g.session) THEN 'unverified_actions'
 WHEN EXISTS (SELECT 1 FROM v_lactions a WHERE a.security_id = g.security_id AND a.kind = 'action' AND a.d BETWEEN g.first_{length} AND g.session) THEN 'corporate_action'
 WHEN n_{length} < {length} THEN 'missing_session' WHEN NOT bool_and({good}) OVER (PARTITION BY security_id ORDER BY idx ROWS {length - 1} PRECEDING) THEN 'invalid_bar' END"""


_LEN = sorted({n for n, _ in S.STRUCTURE.values()})
_W = "PARTITION BY security_id ORDER BY idx"
VIEWS["v_structure"] = (("v_lgrid",), f"""
SELECT *, {', '.join(f'CASE WHEN why_{n} IS NULL THEN raw_{n} END AS {n}' for n in S.STRUCTURE)} FROM (
SELECT *, {', '.join(f'{_why(n, f)} AS why_{name}' for name, (n, f) in S.STRUCTURE.items())},
 close / nullif(lag(close, 5) OVER ({_W}), 0) - 1 AS raw_return_5, stddev_samp(lr) OVER ({_W} ROWS 19 PRECEDING) AS raw_rv_20, avg(tr) OVER ({_W} ROWS 13 PRECEDING) / nullif(close, 0) AS raw_atr_14_fraction,
 avg(close * volume) OVER ({_W} ROWS 19 PRECEDING) AS raw_adv_20, volume / avg(volume) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS raw_rvol_20, close / max(high) OVER ({_W} ROWS 251 PRECEDING) - 1 AS raw_distance_252_high
FROM (SELECT *, CASE WHEN close > 0 AND lag(close) OVER ({_W}) > 0 THEN ln(close / lag(close) OVER ({_W})) END AS lr, CASE WHEN lag(close) OVER ({_W}) IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER ({_W})), abs(low - lag(close) OVER ({_W}))) ELSE high - low END AS tr,
 {', '.join(f'first_value(session) OVER ({_W} ROWS {n - 1} PRECEDING) AS first_{n}, count(close) OVER ({_W} ROWS {n - 1} PRECEDING) AS n_{n}' for n in _LEN)} FROM v_lgrid) g)""")


def long_grid(spark, sf):
    b = I.long_bars(spark, sf).withColumn("close", F.when(F.col("volume") % 311 == 0, -1.0).otherwise(F.col("close")))
    sessions = S.numbered_sessions(b)
    li, o = I.table(spark, sf, "lineitem"), I.table(spark, sf, "orders")
    acts = li.filter("l_orderkey % 211 = 0 and l_linenumber = 1").select((F.col("l_suppkey") % 5).cast("string").alias("security_id"), F.to_date("l_shipdate").alias("date"))
    spans = o.filter("o_orderkey % 1999 = 5").select((F.col("o_custkey") % 5).cast("string").alias("security_id"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 3).alias("end"))
    grid = S.densify(b, sessions).join(S.action_days(acts, spans, sessions), ["security_id", "idx"], "left")
    return grid, sessions


@query("w07_w12_market_structure", "SELECT security_id, session, " + ", ".join(f"why_{n}, round({n}, 7) + 0.0 AS {n}" for n in S.STRUCTURE if n != "adv_20") + ", why_adv_20, round(adv_20, 2) AS adv_20 FROM v_structure", ["v_structure"])
def w07(spark, sf):
    t = S.structure_table(long_grid(spark, sf)[0])
    return t.select("security_id", "session", *["why_" + n for n in S.STRUCTURE], *[r(n, 7) for n in S.STRUCTURE if n != "adv_20"], F.round("adv_20", 2).alias("adv_20"))


VIEWS["v_regimes"] = (("v_lgrid",), """
SELECT session, a AS spy_return_20, wa AS why_spy_return_20, b - c AS breadth_proxy, coalesce(wb, wc) AS why_breadth_proxy FROM (
SELECT session, max(v) FILTER (security_id = '0') AS a, max(w) FILTER (security_id = '0') AS wa, max(v) FILTER (security_id = '1') AS b, max(w) FILTER (security_id = '1') AS wb, max(v) FILTER (security_id = '2') AS c, max(w) FILTER (security_id = '2') AS wc FROM (
 SELECT security_id, session, w, CASE WHEN w IS NULL THEN rr END AS v FROM (SELECT *, """ + _why(21, ("close",)) + f""" AS w FROM (SELECT *, close / nullif(lag(close, 20) OVER ({_W}), 0) - 1 AS rr, first_value(session) OVER ({_W} ROWS 20 PRECEDING) AS first_21, count(close) OVER ({_W} ROWS 20 PRECEDING) AS n_21 FROM v_lgrid) g)) GROUP BY 1)""")
REGIMES = {"spy_return_20": "0"}, {"breadth_proxy": ("1", "2")}


@query("w13_regime_features", "SELECT session, round(spy_return_20, 7) + 0.0 AS spy_return_20, why_spy_return_20, round(breadth_proxy, 7) + 0.0 AS breadth_proxy, why_breadth_proxy FROM v_regimes", ["v_regimes"])
def w13(spark, sf):
    t = S.regime_table(long_grid(spark, sf)[0], *REGIMES)
    return t.select("session", r("spy_return_20", 7), "why_spy_return_20", r("breadth_proxy", 7), "why_breadth_proxy")


VIEWS["v_lfeatures"] = (("v_structure",), """
SELECT o.o_orderkey, t.* EXCLUDE (security_id, session, idx) REPLACE (""" + ", ".join(f"CASE WHEN o.d0 IS NULL THEN 'insufficient_history' ELSE t.why_{n} END AS why_{n}" for n in S.STRUCTURE) + """) FROM (SELECT o_orderkey, CAST(o_custkey % 5 AS VARCHAR) AS sid, (SELECT max(s.session) FROM v_lsessions s WHERE s.session < CAST(o_orderdate AS DATE)) AS at FROM orders) o LEFT JOIN v_structure t ON t.security_id = o.sid AND t.session = o.at""".replace(" AS at", " AS d0").replace("o.at", "o.d0"))


def order_features(spark, sf):
    grid, sessions = long_grid(spark, sf)
    e = I.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("string").alias("security_id"), F.to_date("o_orderdate").alias("day"))
    return S.structure_features(e, S.structure_table(grid), sessions, regimes=S.regime_table(grid, *REGIMES))


VIEWS["v_lregimes"] = (("v_regimes",), """
SELECT o_orderkey, spy_return_20, CASE WHEN d0 IS NULL THEN 'insufficient_history' ELSE why_spy_return_20 END AS why_spy_return_20, breadth_proxy, CASE WHEN d0 IS NULL THEN 'insufficient_history' ELSE why_breadth_proxy END AS why_breadth_proxy
FROM (SELECT o_orderkey, (SELECT max(s.session) FROM v_lsessions s WHERE s.session < CAST(o_orderdate AS DATE)) AS d0 FROM orders) o LEFT JOIN v_regimes t ON t.session = o.d0""")


@query("l15_structure_features", "SELECT o_orderkey, round(return_5, 7) + 0.0 AS return_5, why_return_5, round(rv_20, 7) + 0.0 AS rv_20, why_rv_20, round(distance_252_high, 7) + 0.0 AS distance_252_high, why_distance_252_high, round(spy_return_20, 7) + 0.0 AS spy_return_20, why_spy_return_20, round(breadth_proxy, 7) + 0.0 AS breadth_proxy, why_breadth_proxy FROM v_lfeatures JOIN v_lregimes USING (o_orderkey)", ["v_lfeatures", "v_lregimes"])
def l15(spark, sf):
    """Each order's day as an event of one of five symbols."""
    return order_features(spark, sf).select("o_orderkey", r("return_5", 7), "why_return_5", r("rv_20", 7), "why_rv_20", r("distance_252_high", 7), "why_distance_252_high",
                                             r("spy_return_20", 7), "why_spy_return_20", r("breadth_proxy", 7), "why_breadth_proxy")


@query("a22_feature_coverage", " UNION ALL ".join(f"SELECT '{n}' AS feature, coalesce(why_{n}, 'available') AS state, count(*) AS n FROM v_structure GROUP BY 2" for n in S.STRUCTURE), ["v_structure"])
def a22(spark, sf):
    return S.feature_coverage(S.structure_table(long_grid(spark, sf)[0]), list(S.STRUCTURE))


# ---- opening prints ----
OPEN_SQL = """SELECT symbol, session, CASE WHEN suspects > 0 OR prints > 1 THEN 'ambiguous_official_open' WHEN prints = 0 THEN 'no_official_open' END AS reason, CASE WHEN suspects = 0 AND prints = 1 THEN price END AS official_open FROM (
SELECT symbol, session, count_if(correction IS NOT NULL OR NOT price > 0) AS suspects, count(DISTINCT CASE WHEN correction IS NULL AND price > 0 THEN {'a': trade_id, 'b': t, 'c': price} END) AS prints, max(CASE WHEN correction IS NULL AND price > 0 THEN price END) AS price
FROM v_prints WHERE t >= open_utc AND t < open_utc + INTERVAL 60 SECOND GROUP BY 1, 2)"""
VIEWS["v_opens"] = (("v_prints",), OPEN_SQL)


def opens(spark):
    return I.calendar(spark).sessions.select("session", "open_utc")


def official_opens(spark, sf):
    return E.official_open(I.trades(spark, sf), opens(spark), I.listings(spark, sf), ["symbol", "session"])


@query("l16_official_open", "SELECT * FROM v_opens", ["v_opens"])
def l16(spark, sf):
    return official_opens(spark, sf).select("symbol", "session", "reason", "official_open")


@query("l17_opening_gap", """
SELECT coalesce(o.reason, CASE WHEN b.close IS NULL THEN 'missing_anchor' END, 'verified_open') AS disposition, count(*) AS n, round(sum(CASE WHEN o.reason IS NULL THEN o.official_open / b.close - 1 END), 6) + 0.0 AS gap_sum
FROM v_opens o JOIN v_sessions s ON s.session = o.session LEFT JOIN v_bars b ON b.security_id = CAST(o.symbol % 10 AS VARCHAR) AND b.idx = s.idx - 1 GROUP BY 1""", ["v_opens", "v_bars"])
def l17(spark, sf):
    o = official_opens(spark, sf).withColumn("security_id", (F.col("symbol") % 10).cast("string"))
    return E.opening_gaps(o, I.bars(spark, sf), I.calendar(spark)).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("opening_gap"), 6) + 0.0).alias("gap_sum"))



@query("l17_event_openings", f"""
SELECT disposition, count(*) AS n, round(sum(CASE WHEN disposition = 'verified_open' THEN official_open / close - 1 END), 6) + 0.0 AS gap_sum FROM (
SELECT o.official_open, b.close, CASE WHEN l.exchange NOT IN ('NYSE', 'NASDAQ') THEN 'unsupported_listing' WHEN s.idx IS NULL OR e.timing IS NULL OR e.timing NOT IN ('premarket', 'after_hours') OR e.cutoff >= s.open_utc THEN 'unsupported_clock'
 WHEN a.idx IS NULL OR c.available_at > a.close_utc THEN 'anchor_identity_unverified' WHEN b.close IS NULL THEN 'missing_anchor' WHEN o.symbol IS NULL THEN 'no_official_open' ELSE coalesce(o.reason, 'verified_open') END AS disposition
FROM (SELECT n.event_id, n.user_id AS symbol, n.security_id, n.cutoff, k.timing, k.reaction_idx FROM v_news n JOIN ({CLASSIFY}) k USING (event_id)) e JOIN v_securities c USING (security_id) LEFT JOIN v_listings l ON l.symbol = e.symbol LEFT JOIN v_sessions s ON s.idx = e.reaction_idx
LEFT JOIN v_sessions a ON a.idx = s.idx - 1 LEFT JOIN v_bars b ON b.security_id = e.security_id AND b.idx = a.idx LEFT JOIN v_opens o ON o.symbol = e.symbol AND o.session = s.session) GROUP BY 1""", ["v_news", "v_days", "v_sessions", "v_listings", "v_securities", "v_bars", "v_opens"])
def l17_events(spark, sf):
    """Every event of the news table: opening gap of its reaction session or why there is none. Symbols are written as S and the user's number."""
    named = lambda df: df.withColumn("symbol", F.concat(F.lit("S"), F.col("symbol").cast("string")))
    e = cal.classify(I.news(spark, sf), "published_at", I.calendar(spark))
    known = I.securities(spark, sf).select("security_id", F.greatest("valid_from", "available_at").alias("listed_from"))
    e = named(e.withColumn("symbol", F.col("user_id"))).join(known, "security_id").select("event_id", "symbol", "security_id", "cutoff", "timing", "reaction_idx", "listed_from")
    out = E.event_openings(e, named(official_opens(spark, sf)), named(I.listings(spark, sf)), I.bars(spark, sf), I.calendar(spark))
    return out.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("opening_gap"), 6) + 0.0).alias("gap_sum"))


# ---- reports ----
@query("a17_target_summary", f"""
SELECT *, CASE WHEN least(positives, n_defined - positives) >= 30 THEN 'estimable_with_wide_uncertainty' WHEN positives >= 10 AND n_defined - positives >= 10 THEN 'thin' ELSE 'insufficient' END AS bucket FROM (
SELECT target, n AS n_defined, k AS positives, ps AS positive_sessions, pi AS positive_issuers, pp AS positives_premarket, pa AS positives_after_hours, round(k / nullif(n, 0), 8) AS base_rate, {WILSON.replace(', 10)', ', 8)')} FROM (
SELECT target, count(y) AS n, coalesce(count_if(y > 0), 0) AS k, count(DISTINCT CASE WHEN y > 0 THEN reaction_idx END) AS ps, count(DISTINCT CASE WHEN y > 0 THEN cik END) AS pi, coalesce(count_if(y > 0 AND timing = 'premarket'), 0) AS pp, coalesce(count_if(y > 0 AND timing = 'after_hours'), 0) AS pa
FROM v_targets WHERE knd = 'binary' GROUP BY 1))""", ["v_targets"])
def a17(spark, sf):
    t = R.target_summary(target_rows(spark, sf).filter("kind = 'binary'"))
    return t.select("target", "n_defined", "positives", "positive_sessions", "positive_issuers", "positives_premarket", "positives_after_hours", *[F.round(c, 8).alias(c) for c in ("base_rate", "wilson_low", "wilson_high")], "bucket")


@query("a17_target_by_block", "SELECT target, CAST(block AS BIGINT) AS block, count(y) AS defined, coalesce(count_if(y > 0), 0) AS positives FROM v_targets GROUP BY 1, 2", ["v_targets"])
def a17_blocks(spark, sf):
    return R.by_block(target_rows(spark, sf)).select("target", F.col("block").cast("bigint").alias("block"), "defined", "positives")


@query("a18_return_summary", """
SELECT label, count(*) AS n, round(avg(num), 8) + 0.0 AS mean, round(stddev_samp(num), 8) + 0.0 AS sd, round(stddev_samp(num) / sqrt(count(*)), 8) + 0.0 AS standard_error, round(quantile_cont(num, 0.1), 8) + 0.0 AS p10, round(quantile_cont(num, 0.5), 8) + 0.0 AS median, round(quantile_cont(num, 0.9), 8) + 0.0 AS p90
FROM v_lab WHERE kind = 'return' AND num IS NOT NULL GROUP BY 1""", ["v_lab"])
def a18(spark, sf):
    return R.return_summary(study_labels(spark, sf)).select("label", "n", *[r(c, 8) for c in ("mean", "sd", "standard_error", "p10", "median", "p90")])


@query("a19_dependence", """
SELECT axis, events, count(*) AS groups FROM (SELECT axis, k, count(*) AS events FROM (SELECT unnest(['session', 'issuer', 'sector']) AS axis, unnest([CAST(reaction_idx AS VARCHAR), cik, sic_major_group]) AS k FROM v_events) GROUP BY 1, 2) GROUP BY 1, 2""", ["v_events"])
def a19(spark, sf):
    return R.dependence(study_events(spark, sf))


@query("a19_two_largest_groups", "SELECT sic_major_group, n, round(n / (SELECT count(*) FROM v_events), 8) AS share FROM (SELECT sic_major_group, count(*) AS n FROM v_events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 2)", ["v_events"])
def a19_top(spark, sf):
    return R.two_largest(study_events(spark, sf)).select("sic_major_group", "n", F.round("share", 8).alias("share"))


@query("a20_dispositions", """
SELECT category AS source, count(*) AS candidates, count(DISTINCT cik) AS issuers, count_if(d = 'included') AS included, count_if(d = 'excluded') AS excluded, count_if(d = 'quarantined') AS quarantined, round(count_if(d = 'included') / count(*), 4) AS included_share
FROM (SELECT *, CASE WHEN state = 'MAPPED' THEN 'included' WHEN reason LIKE 'INELIG%' THEN 'excluded' ELSE 'quarantined' END AS d FROM v_outcomes) GROUP BY 1""", ["v_outcomes"])
def a20(spark, sf):
    o = outcomes(spark, sf).withColumn("source", F.col("category")).withColumn("disposition", F.when(F.col("state") == "MAPPED", "included").when(F.startswith("reason", F.lit("INELIG")), "excluded").otherwise("quarantined"))
    return R.dispositions(o)


@query("a21_coverage", """
SELECT dimension, value, count(*) AS screened, count_if(state = 'MAPPED') AS usable FROM (SELECT state, unnest(['issuer', 'quarter', 'category']) AS dimension, unnest([cik, year(published_at) || 'Q' || quarter(published_at), category]) AS value FROM v_outcomes) GROUP BY 1, 2""", ["v_outcomes"])
def a21(spark, sf):
    from tidemark.functions.text import quarter_label
    o = outcomes(spark, sf).withColumn("issuer", F.col("cik")).withColumn("quarter", quarter_label("published_at"))
    return R.coverage(o, ["issuer", "quarter", "category"], F.col("state") == "MAPPED")


@query("a23_support", "SELECT timing, count(*) AS rows, count(DISTINCT cik) AS issuers, count(DISTINCT reaction_idx) AS sessions FROM v_events GROUP BY 1", ["v_events"])
def a23(spark, sf):
    return R.support(study_events(spark, sf), ["timing"])


VIEWS["v_named"] = (("v_caveats",), "SELECT event_id, unnest(CASE WHEN label = 'all' THEN ['" + "', '".join(LABELS) + "'] ELSE [label] END) AS label FROM v_caveats")


def named(events):
    c = caveats(events)
    return c.select("event_id", F.explode(F.when(F.col("label") == "all", F.array(*[F.lit(x) for x in LABELS])).otherwise(F.array("label"))).alias("label"))


@query("a26_caveat_sensitivity", """
WITH x AS (SELECT l.*, coalesce(l.num, CAST(l.flag AS DOUBLE)) AS v, n.event_id IS NULL AS k1, c.event_id IS NULL AS k2, l.event_no % 5 <> 0 AS k3 FROM v_lab l LEFT JOIN v_named n USING (event_id, label) LEFT JOIN v_closed c USING (event_id, label) WHERE l.reason IS NULL),
y AS (SELECT unnest(['all', timing]) AS pool, label, kind, v, k1, k2, k3 FROM x),
b AS (SELECT pool, label, count(*) AS n_with, avg(v) AS ew, CASE WHEN kind = 'boolean' THEN CASE WHEN avg(v) > 0 AND avg(v) < 1 THEN sqrt(avg(v) * (1 - avg(v)) / count(*)) END ELSE stddev_samp(v) / sqrt(count(*)) END AS se, CASE WHEN kind <> 'boolean' THEN median(v) END AS mw FROM y GROUP BY pool, label, kind),
w AS (SELECT pool, label, 'as_recorded' AS variant, count(*) AS n, avg(v) AS e, CASE WHEN any_value(kind) <> 'boolean' THEN median(v) END AS m FROM y WHERE k1 GROUP BY 1, 2 UNION ALL SELECT pool, label, 'with_derived', count(*), avg(v), CASE WHEN any_value(kind) <> 'boolean' THEN median(v) END FROM y WHERE k2 GROUP BY 1, 2
 UNION ALL SELECT pool, label, 'events_dropped', count(*), avg(v), CASE WHEN any_value(kind) <> 'boolean' THEN median(v) END FROM y WHERE k3 GROUP BY 1, 2)
SELECT pool, label, variant, n_with, n AS n_without, round(ew, 8) + 0.0 AS estimate_with, round(e, 8) + 0.0 AS estimate_without, round((e - ew) / nullif(se, 0), 6) + 0.0 AS shift_in_standard_errors, round(mw, 8) + 0.0 AS median_with, round(m, 8) + 0.0 AS median_without FROM w JOIN b USING (pool, label)""", ["v_lab", "v_named", "v_closed"])
def a26(spark, sf):
    labels = study_labels(spark, sf)
    e = study_events(spark, sf)
    return R.sensitivity(labels, named(e), P.close_caveats(caveats(e))).select("pool", "label", "variant", "n_with", "n_without", r("estimate_with", 8), r("estimate_without", 8), r("shift_in_standard_errors", 6), r("median_with", 8), r("median_without", 8))


A26_SQL = ORACLES["a26_caveat_sensitivity"].replace("round((e - ew) / nullif(se, 0), 6) + 0.0 AS shift", "(e - ew) / nullif(se, 0) AS shift")  # rounded once, at the end


@query("a26_shift_summary", f"""
SELECT variant, count(*) AS comparisons, count_if(s >= 0.5) AS notable, count_if(s >= 1.0) AS large, round(max(s), 5) AS largest FROM (SELECT variant, abs(shift_in_standard_errors) AS s FROM ({A26_SQL})) WHERE s IS NOT NULL GROUP BY 1""")
def a26_summary(spark, sf):
    e = study_events(spark, sf)
    s = R.sensitivity(study_labels(spark, sf), named(e), P.close_caveats(caveats(e)))
    return R.shift_summary(s).select("variant", "comparisons", "notable", "large", F.round("largest", 5).alias("largest"))


@query("a27_state_changes", """
WITH b AS (SELECT level, key, label, state FROM v_stats),
d AS (SELECT level, key, label, kind, count(DISTINCT CASE WHEN reason IS NULL THEN cluster_id END) AS g FROM (SELECT c.* FROM (SELECT * FROM v_lab WHERE event_no % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY label, cluster_id ORDER BY cutoff, event_id) = 1) q,
 LATERAL (SELECT q.label, q.kind, q.reason, q.cluster_id, q.matures_at, x.level, x.key FROM (VALUES ('all', 'all_news'), ('timing', q.timing), ('sic_division', q.sic_division), ('sic_major_group', q.sic_major_group), ('issuer', q.cik)) x(level, key)) c) WHERE matures_at <= TIMESTAMP '2024-01-25' GROUP BY ALL),
a AS (SELECT level, key, label, CASE WHEN kind = 'boolean' THEN CASE WHEN g < 5 THEN 'WITHHELD' WHEN g < 10 THEN 'REPORTED_UNRELIABLE' ELSE 'REPORTED' END ELSE CASE WHEN g < 10 THEN 'WITHHELD' WHEN g < 20 THEN 'REPORTED_UNRELIABLE' ELSE 'REPORTED' END END AS state FROM d)
SELECT level, key, label, coalesce(b.state, 'ABSENT') AS state_with, coalesce(a.state, 'ABSENT') AS state_without FROM b FULL JOIN a USING (level, key, label) WHERE coalesce(b.state, 'ABSENT') <> coalesce(a.state, 'ABSENT')""", ["v_stats", "v_lab"])
def a27(spark, sf):
    from tidemark.operators.asof import dedupe_clusters
    labels = study_labels(spark, sf)
    state = lambda d: C.suppress(C.cell_stats(C.group_cells(dedupe_clusters(d, by=("label",))), I.ts(CELLS_AS_OF)))
    return R.state_changes(state(labels), state(labels.filter("event_no % 5 <> 0")))


@query("a28_action_counts", "SELECT security_id, type, count(*) AS n FROM v_actions GROUP BY 1, 2", ["v_actions"])
def a28(spark, sf):
    return E.action_counts(I.actions(spark, sf))


@query("a29_allocation_crosstab", """
SELECT tail, magnitude, count(*) AS n, count(DISTINCT cik) AS issuers, count(DISTINCT reaction_idx) AS sessions, tail <> magnitude AS discordant FROM (SELECT cik, reaction_idx, CAST(CASE WHEN (g < -0.4 OR g > 0.5) AND abs(0.1 - g) >= 0.02 THEN -sign(g) ELSE 0 END AS INTEGER) AS tail, CAST(CASE WHEN abs(g) > 0.6 THEN -sign(g) ELSE 0 END AS INTEGER) AS magnitude
 FROM (SELECT *, open / anchor_close - 1 AS g FROM v_events)) GROUP BY 1, 2""", ["v_events"])
def a29(spark, sf):
    from tidemark.functions.numeric import magnitude_flag, tail_flag
    e = study_events(spark, sf).withColumn("g", F.col("open") / F.col("anchor_close") - 1).withColumnsRenamed({"cik": "issuer", "reaction_idx": "session_no"}).withColumn("session", F.col("session_no"))
    d = e.withColumn("tail", tail_flag("g", F.lit(-0.4), F.lit(0.5), F.lit(0.1))).withColumn("magnitude", magnitude_flag("g", F.lit(0.6)))
    return R.allocation_crosstab(d, "tail", "magnitude")


@query("a30_scan_summary", """
SELECT company, kind, CASE WHEN applies THEN coalesce(n, 0) END AS results, CASE WHEN applies THEN coalesce(m, 0) END AS matched FROM (SELECT DISTINCT o_custkey AS company, k.kind, k.kind = 'trials' OR (k.kind = 'drugs') = (o_custkey % 2 = 0) AS applies FROM orders, (VALUES ('trials'), ('drugs'), ('devices')) k(kind))
LEFT JOIN (SELECT o_custkey AS company, ['trials', 'drugs', 'devices'][o_orderkey % 3 + 1] AS kind, count(*) AS n, count_if(o_orderpriority = '1-URGENT') AS m FROM orders GROUP BY 1, 2) USING (company, kind)""")
def a30(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("company"), _pick(["trials", "drugs", "devices"], F.col("o_orderkey")).alias("kind"), (F.col("o_orderpriority") == "1-URGENT").alias("matched"))
    kinds = o.select("company").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("trials", "drugs", "devices")])))
    kinds = kinds.withColumn("applies", (F.col("kind") == "trials") | ((F.col("kind") == "drugs") == (F.col("company") % 2 == 0)))
    return R.scan_summary(o, kinds)


@query("o08_first_missing_dates", """
SELECT security_id, array_to_string(list_sort(list(CAST(session AS VARCHAR)))[1:3], ',') AS first_missing FROM (SELECT g.security_id, s.session FROM (SELECT DISTINCT CAST(user_id % 400 AS VARCHAR) AS security_id FROM events) g, v_sessions s) w
ANTI JOIN (SELECT DISTINCT CAST(user_id % 400 AS VARCHAR) AS security_id, CAST(ts AS DATE) AS session FROM events) b USING (security_id, session) GROUP BY 1""", ["v_sessions"])
def o08(spark, sf):
    b = I.table(spark, sf, "events").groupBy(I.security_id(n=400).alias("security_id"), F.to_date("ts").alias("session")).agg(F.count(F.lit(1)).cast("double").alias("volume"))
    return cal.session_coverage(b, I.calendar(spark), first_n=3).filter("missing > 0").select("security_id", "first_missing")


@query("o09_latest_period", """
SELECT cik_no, arg_max(accession, {'p': filing_date - 300, 'a': -epoch_us(accepted_at), 'c': -order_no}) AS accession FROM v_filings WHERE form = '10-Q' GROUP BY 1""", ["v_filings"])
def o09(spark, sf):
    """Newest period per issuer, the earliest available filing of it."""
    f = I.filings(spark, sf).filter("form = '10-Q'")
    return E.latest_period(f, ["cik_no"], F.date_sub("filing_date", 300), F.col("accepted_at"), "accession", F.col("order_no"))


# ---- sources ----
@query("s01_bundle_scan", "SELECT s_name AS ticker, s_nationkey AS region, 'securities' AS list FROM supplier UNION ALL SELECT r_name, r_regionkey, 'providers' FROM region")
def s01(spark, sf):
    """A bundle written from two tables as JSON lines of a hundred rows each, read back in splits as typed tables."""
    folder = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    row = "array<struct<ticker:string,region:int>>"
    sec = I.table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 100)).agg(F.collect_list(F.struct(F.col("s_name").alias("ticker"), F.col("s_nationkey").cast("int").alias("region"))).alias("securities")).select("securities", F.lit(None).cast(row).alias("providers"))
    prov = I.table(spark, sf, "region").agg(F.collect_list(F.struct(F.col("r_name").alias("ticker"), F.col("r_regionkey").cast("int").alias("region"))).alias("providers")).select(F.lit(None).cast(row).alias("securities"), "providers")
    sec.unionByName(prov).write.json(folder)
    b = D.read_bundle(spark, folder, f"securities {row}, providers {row}", lines=True)
    return b["securities"].withColumn("list", F.lit("securities")).unionByName(b["providers"].withColumn("list", F.lit("providers")))


@query("s02_column_arrays", """
SELECT o_custkey, o_orderkey AS accession, o_orderstatus AS form, CASE WHEN o_custkey % 4 <> 0 THEN o_orderpriority END AS items FROM orders WHERE o_custkey % 10 <> 0""")
def s02(spark, sf):
    """Each customer's filings of a quarter as one document of parallel arrays; every tenth customer's arrays differ in length and are refused."""
    o = I.table(spark, sf, "orders").groupBy("o_custkey", F.date_trunc("quarter", "o_orderdate").alias("quarter")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("s"))
    arr = lambda f: F.transform("s", lambda x: x[f].cast("string"))
    short = lambda c: F.when(F.col("o_custkey") % 10 == 0, F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)
    doc = o.select("o_custkey", arr("o_orderkey").alias("accession"), short(arr("o_orderstatus")).alias("form"), F.when(F.col("o_custkey") % 4 != 0, arr("o_orderpriority")).alias("items"))
    good, _ = D.zip_columns(doc, ["accession", "form"], ["items"])
    return good.withColumn("accession", F.col("accession").cast("bigint"))


@query("s03_matrix_rows", "SELECT CAST(p_partkey AS VARCHAR) AS k, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS brand, p_partkey % 9 = 0 AS refused FROM part")
def s03(spark, sf):
    """Fields and rows apart, the field order differing by document; a row one value short is refused."""
    p = I.table(spark, sf, "part").withColumn("flip", F.col("p_partkey") % 2)
    row = F.when(F.col("flip") == 0, F.array("p_name", "p_brand")).otherwise(F.array("p_brand", "p_name"))
    row = F.when(F.col("p_partkey") % 9 == 0, F.slice(row, 1, 1)).otherwise(row)
    doc = p.select(F.col("p_partkey").cast("string").alias("k"), F.when(F.col("flip") == 0, F.array(F.lit("name"), F.lit("brand"))).otherwise(F.array(F.lit("brand"), F.lit("name"))).alias("fields"), F.array(row).alias("data"))
    return D.matrix_rows(doc, ["name", "brand"], keep=("k",))


@query("s04_pipe_listing", """
SELECT CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 50 = 1 THEN 'symbol' ELSE CAST(p_partkey AS VARCHAR) END AS symbol, p_name AS name, CAST(p_size AS VARCHAR) AS size,
 CASE WHEN p_partkey % 50 = 0 THEN 'MISSING_SYMBOL' WHEN p_partkey % 50 = 1 AND (SELECT count(*) FROM part WHERE p_partkey % 50 = 1) > 1 THEN 'DUPLICATE_SYMBOL' END AS reason FROM part""")
def s04(spark, sf):
    """Listing files of a thousand parts each, every other one with its columns in another order."""
    return D.read_listing(spark, listing_files(spark, sf), ["symbol", "name", "size"])


def listing_files(spark, sf, footer="true"):
    folder, k = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}", F.col("p_partkey")
    symbol = F.when(k % 50 == 0, "").when(k % 50 == 1, "symbol").otherwise(k.cast("string"))  # some without a symbol, some named like the header
    size, file = F.col("p_size").cast("string"), F.floor(k / 1000).cast("int").alias("file")
    value = F.when(F.col("file") % 2 == 0, F.concat_ws("|", size, symbol, "p_name")).otherwise(F.concat_ws("|", "p_name", size, symbol))
    p = I.table(spark, sf, "part").withColumn("file", file)
    files = p.select("file").distinct()
    edges = files.select("file", F.lit(0).alias("o"), F.when(F.col("file") % 2 == 0, "size|symbol|name").otherwise("name|size|symbol").alias("value")).unionByName(files.filter(footer).select("file", F.lit(2).alias("o"), F.lit("File Creation Time: 0101202400:00||").alias("value")))
    lines = p.select("file", F.lit(1).alias("o"), value.alias("value")).unionByName(edges)
    lines.repartition("file").sortWithinPartitions("file", "o").drop("o").write.partitionBy("file").text(folder)
    return folder


@query("s04_refused_files", """
SELECT CAST(file AS INTEGER) AS file, CASE WHEN file % 3 = 1 THEN 'has 0 footers' END AS reason, CASE WHEN file % 3 <> 1 THEN n ELSE 0 END AS rows_read FROM (SELECT p_partkey // 1000 AS file, count_if(p_partkey % 50 > 1) AS n FROM part GROUP BY 1)""")
def s04_refused(spark, sf):
    """Every third file lacks its footer and is refused by name; of the others the rows with a symbol of their own are counted, file by file."""
    rows, bad = D.read_listing(spark, listing_files(spark, sf, "file % 3 <> 1"), ["name", "symbol", "size"], key="symbol", on_bad="refuse")
    number = F.regexp_extract("file", r"/file=(\d+)/", 1).cast("int").alias("file")
    read = rows.filter(F.rlike("symbol", F.lit(r"^\d+$"))).groupBy(F.floor(F.col("symbol").try_cast("bigint") / 1000).cast("int").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    files = I.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 1000).cast("int").alias("file")).distinct()
    return files.join(bad.select(number, "reason"), "file", "left").join(read, "file", "left").select("file", "reason", F.coalesce("n", F.lit(0)).alias("rows_read"))


@query("s05_portfolio_positions", "SELECT s_suppkey, CAST(1 AS BIGINT) AS position, s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN 'X' || s_suppkey END AS isin FROM supplier UNION ALL SELECT s_suppkey, 2, 'second', 'Y' || s_suppkey FROM supplier")
def s05(spark, sf):
    s, nl = I.table(spark, sf, "supplier"), F.lit("\n")
    part = lambda name, isin: F.concat(F.lit("Item C.1. Identification of investment."), nl, F.lit("a. Name of issuer (if any)."), nl, name, nl, F.lit("ISIN"), nl, isin, nl)
    k = F.col("s_suppkey").cast("string")
    twice = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("ISIN\nAGAIN\n"))).otherwise("")
    text = F.concat(F.lit("head\n"), part(F.col("s_name"), F.concat(F.lit("X"), k)), twice, part(F.lit("second"), F.concat(F.lit("Y"), k)))
    out = D.extract_positions(s.select("s_suppkey", text.alias("text")), "text", "Item C.1. Identification of investment.", {"name": "a. Name of issuer (if any).", "isin": "ISIN"}, keep=("s_suppkey",))
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("s05_position_checks", """
SELECT s_suppkey, position, country, CASE WHEN s_suppkey % 17 = 0 AND position = 2 THEN 'MISSING_FIELD:country' WHEN s_suppkey % 11 = 0 AND position = 1 THEN 'INVALID_IDENTIFIER' WHEN s_suppkey % 13 = 0 AND s_suppkey % 11 <> 0 THEN 'DUPLICATE_IDENTIFIER' END AS reason,
 CASE WHEN s_suppkey % 17 = 0 OR s_suppkey % 11 = 0 OR s_suppkey % 13 = 0 THEN 'FAULTY_POSITIONS' END AS filing_reason
FROM (SELECT s_suppkey, n AS position, CASE WHEN s_suppkey % 17 <> 0 OR n = 1 THEN 'US' END AS country FROM supplier, (VALUES (1), (2)) v(n) WHERE s_suppkey % 19 <> 0)
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, 'NO_POSITIONS' FROM supplier WHERE s_suppkey % 19 = 0""")
def s05_checks(spark, sf):
    """Filings of two positions each, of which some lack a field, misspell or repeat an identifier, or hold no position; a second identifier stands behind each header."""
    s, k, nl = I.table(spark, sf, "supplier"), F.col("s_suppkey"), F.lit("\n")
    number = F.lpad(k.cast("string"), 9, "0")

    def part(name, isin, country):
        return F.concat_ws("\n", F.lit("Item C.1. Identification of investment."), F.lit("a. Name of issuer (if any)."), name, F.lit("c. Title of issue"), F.lit("common"), F.lit("ISIN"), isin,
                           F.lit("Item C.2. Amount of each investment."), F.lit("ISIN"), F.lit("of collateral"), country)
    first = F.concat(F.when(k % 11 == 0, "u").otherwise("U"), F.lit("S"), number, F.lit("1"))
    second = F.concat(F.lit("US"), number, F.when(k % 13 == 0, "1").otherwise("2"))
    country = lambda there: F.when(there, F.lit("Country\nUS\n")).otherwise("\n")
    text = F.when(k % 19 == 0, "no portfolio").otherwise(F.concat(F.lit("head\n"), part(F.col("s_name"), first, country(F.lit(True))), part(F.lit("second"), second, country(k % 17 != 0))))
    filings = s.select("s_suppkey", text.alias("text"))
    found = D.extract_positions(filings, "text", "Item C.1. Identification of investment.", {"name": "a. Name of issuer (if any).", "title": "c. Title of issue", "isin": "ISIN", "country": "Country"},
                                keep=("s_suppkey",), header_end="Item C.2. Amount of each investment.", whole=("country",))
    checked, judged = D.check_positions(filings, found, "s_suppkey")
    out = judged.withColumnRenamed("reason", "filing_reason").join(checked, "s_suppkey", "left")
    return out.select("s_suppkey", F.col("position").cast("int").alias("position"), "country", "reason", "filing_reason")


@query("s06_submission_exhibits", """
SELECT doc_id, 'EX-99.' || (doc_id % 2 + 1) AS form_type, 'ex' || doc_id || '.htm' AS filename, 3 AS listed, 2 AS available, length(text) AS body_length FROM documents WHERE doc_id % 3 <> 0""")
def s06(spark, sf):
    """Each document wrapped as the exhibit of a submission; every third is of another type and is left out."""
    d = I.table(spark, sf, "documents")
    k = F.col("doc_id").cast("string")
    block = lambda kind, name, body: F.concat(F.lit("<DOCUMENT>\n<TYPE>"), kind, F.lit("\n<FILENAME>"), name, F.lit("\n<TEXT>"), body, F.lit("</TEXT>\n</DOCUMENT>\n"))
    kind = F.when(F.col("doc_id") % 3 == 0, "EX-10").otherwise(F.concat(F.lit("EX-99."), (F.col("doc_id") % 2 + 1).cast("string")))
    text = F.concat(F.lit("PUBLIC DOCUMENT COUNT: 3\n</SEC-HEADER>\n"), block(F.lit("8-K"), F.lit("main.htm"), F.lit("cover")), block(kind, F.concat(F.lit("ex"), k, F.lit(".htm")), F.col("text")), F.lit("</SEC-DOCUMENT>"))
    e = D.extract_exhibits(d.select("doc_id", text.alias("sub")), "sub", keep=("doc_id",))
    return e.select("doc_id", "form_type", "filename", "listed", "available", F.length("body").cast("bigint").alias("body_length"))


@query("s06_refused_submissions", """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'IDENTITY_MISMATCH' WHEN 1 THEN 'INCOMPLETE_SUBMISSION' WHEN 2 THEN 'INCOMPLETE_EXHIBIT' WHEN 3 THEN 'INVALID_FILENAME' WHEN 4 THEN 'IDENTITY_MISMATCH' END AS reason, CASE WHEN doc_id % 7 > 4 THEN length(text) END AS body_length FROM documents""")
def s06_refused(spark, sf):
    """Submissions of one exhibit each: foreign ones, cut ones, and ones whose exhibit lacks its text or a safe name are refused with the reason."""
    k, m = F.col("doc_id").cast("string"), F.col("doc_id") % 7
    identity = F.lpad(F.when(m == 0, F.lit("1")).otherwise(k), 10, "0")
    name = F.when(m == 3, F.concat(F.lit("../ex"), k)).otherwise(F.concat(F.lit("ex"), k, F.lit(".htm")))
    header = F.concat(F.lit("ACCESSION NUMBER:\t"), F.when(m == 4, "other").otherwise(F.concat(F.lit("a-"), k)), F.lit("\nPUBLIC DOCUMENT COUNT: 1\nCENTRAL INDEX KEY: "), identity, F.lit("\n</SEC-HEADER>\n"))
    exhibit = F.concat(F.lit("<DOCUMENT>\n<TYPE>EX-99.1\n<FILENAME>"), name, F.lit("\n<TEXT>"), F.regexp_replace("text", "<", " "), F.when(m == 2, "").otherwise("</TEXT>"), F.lit("\n</DOCUMENT>\n"))
    text = F.concat(header, exhibit, F.when(m == 1, "").otherwise("</SEC-DOCUMENT>\n"))
    d = I.table(spark, sf, "documents").select("doc_id", text.alias("sub"), F.concat(F.lit("a-"), k).alias("accession"), F.lpad(k, 10, "0").alias("cik"))
    found, refused = D.read_submissions(d, "sub", "accession", "cik", keep=("doc_id",))
    return d.select("doc_id").join(refused, "doc_id", "left").join(found.select("doc_id", F.length("body").cast("bigint").alias("body_length")), "doc_id", "left")


@query("s08_inline_facts", """
SELECT page_id, 'C' || page_id AS context, 'S' || page_id || ' x&y' AS tradingsymbol, 'outer NYSE tail' AS outer_text, 'NYSE' AS securityexchangename, 'class of ' || page_id || ' goes on to its end' AS security12btitle FROM pages WHERE page_id % 5 <> 0""")
def s08_inline(spark, sf):
    """Inline facts of each page: one inside another, one continued twice in other places, comments and case as they come; every fifth page gives a fact two values and is left out."""
    k, lit = F.col("page_id").cast("string"), F.lit
    fact = lambda name, body, more="": F.concat(lit(f'<ix:nonNumeric {more} contextRef="C'), k, lit(f'" name="dei:{name}">'), body, lit("</ix:nonNumeric>"))
    twice = F.when(F.col("page_id") % 5 == 0, fact("TradingSymbol", lit("other"))).otherwise("")
    nested = F.concat(lit("<IX:NONNUMERIC contextref='C"), k, lit("' name='x:Outer_Text'>outer <!-- <ix:nonNumeric> --> "), fact("SecurityExchangeName", lit("<b>NY</b>SE")), lit("\n tail</IX:NONNUMERIC>"))
    text = F.concat(lit("<html></ix:nonNumeric><p>noise 1 < 2</p>"), fact("TradingSymbol", F.concat(lit("S"), k, lit("<span> x&amp;y</span>"))), nested, lit('<div><ix:continuation id="f1" continuedAt="f2"> goes on</ix:continuation></div>'),
                    fact("Security12bTitle", F.concat(lit("class of "), k), 'continuedAt="f1"'), twice, lit('<ix:continuation id="f2"> to its end</ix:continuation><ix:nonNumeric contextRef="C0" name="dei:never">open</html>'))
    facts = D.inline_facts(I.table(spark, sf, "pages").select("page_id", text.alias("html")), keep=("page_id",))
    return D.pivot_tag_contexts(facts, ["tradingsymbol", "outer_text", "securityexchangename", "security12btitle"], keep=("page_id",))


_HTML = "html"
for _p, _t in ((r"<(script|style|ix:hidden)\b[^>]*>.*?</(script|style|ix:hidden)\s*>", ""), (r"<!--.*?-->", ""), (r"<(br|li)\b[^>]*>", "\\n"), (r"<(td|th)\b[^>]*>", " | "), (r"</(tr|p|li|div|h1|h2|h3|h4)\s*>", "\\n"), (r"<[^>]*>", "")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', " + ("chr(10)" if _t == "\\n" else f"'{_t}'") + ", 'gis')"
for _n, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):  # those of the test pages
    _HTML = f"replace({_HTML}, '{_n}', '" + _c.replace("'", "''") + "')"
VIEWS["v_lines"] = ((), f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS line_no, line FROM (SELECT page_id, i, trim(regexp_replace(l, '\\s+', ' ', 'g'), ' |') AS line FROM (SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT page_id, string_split({_HTML}, chr(10)) AS ls FROM pages))) WHERE line <> ''""")


@query("s07_html_lines", "SELECT page_id, line_no, md5(line) AS line_md5 FROM v_lines", ["v_lines"])
def s07(spark, sf):
    return D.html_lines(I.table(spark, sf, "pages"), keep=("page_id",)).select("page_id", F.col("line_no").cast("bigint").alias("line_no"), F.md5("line").alias("line_md5"))


@query("s08_tag_contexts", r"""
SELECT page_id, context, tag, label FROM (SELECT page_id, context, max(v) FILTER (name = 'h1') AS tag, max(v) FILTER (name = 'title') AS label FROM (SELECT page_id, '/' AS context, lower(regexp_extract(h, '<(title|h1)>', 1)) AS name, trim(regexp_replace(regexp_extract(h, '>([^<]*)<', 1), '\s+', ' ', 'g')) AS v FROM
 (SELECT page_id, unnest(regexp_extract_all(html, '<(?:title|h1)>[^<]*</(?:title|h1)>')) AS h FROM pages)) GROUP BY 1, 2 HAVING count(DISTINCT v) FILTER (name = 'h1') = 1 AND count(DISTINCT v) FILTER (name = 'title') = 1)""")
def s08(spark, sf):
    """Titles and headings of pages as the two tagged facts of one context."""
    tags = D.tag_values(I.table(spark, sf, "pages"), r"()<(title|h1)>([^<]*)</(?:title|h1)>", keep=("page_id",)).withColumn("context", F.lit("/"))
    return D.pivot_tag_contexts(tags, ["h1", "title"], keep=("page_id",)).select("page_id", "context", F.col("h1").alias("tag"), F.col("title").alias("label"))


@query("s09_bars_from_pages", """
SELECT security_id AS asked, session, CASE WHEN day(session) = 3 THEN 'DUPLICATE_SESSION' WHEN security_id = '4' AND day(session) = 5 THEN 'FOREIGN_SYMBOL' END AS reason, round(close, 6) AS close FROM v_bars""", ["v_bars"])
def s09(spark, sf):
    """Bars packed into one page per symbol and month half, some sessions twice, one of them foreign."""
    b = I.bars(spark, sf)
    sym = F.when((F.col("security_id") == "4") & (F.dayofmonth("session") == 5), "other").otherwise(F.col("security_id"))
    rows = b.withColumn("_k", F.explode(F.when(F.dayofmonth("session") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    pages = rows.groupBy(F.col("security_id").alias("symbol"), (F.dayofmonth("session") > 15).alias("half")).agg(F.collect_list(F.struct(sym.alias("symbol"), "session", "open", "high", "low", "close", "volume")).alias("bars"))
    return D.bars_from_pages(pages).select("asked", "session", "reason", F.round("close", 6).alias("close"))


@query("s10_actions_from_pages", """
SELECT security_id AS symbol, type, effective_date AS date, CASE WHEN id % 3 = 0 THEN 'ex_date' WHEN id % 3 = 1 THEN 'effective_date' ELSE 'process_date' END AS date_field FROM (SELECT *, CAST(action_id[2:] AS BIGINT) AS id FROM v_actions)""", ["v_actions"])
def s10(spark, sf):
    a = I.actions(spark, sf).withColumn("id", F.substring("action_id", 2, 20).cast("bigint"))
    d = F.col("effective_date").cast("string")
    one = F.struct(F.when(F.col("id") % 3 == 0, d).alias("ex_date"), F.when(F.col("id") % 3 == 1, d).alias("effective_date"), F.lit(None).cast("string").alias("payable_date"), d.alias("process_date"))
    page = F.floor(F.col("id") / 500)  # a provider's pages hold a bounded number of actions
    pages = (a.groupBy("security_id", page.alias("page"), "type").agg(F.collect_list(one).alias("l")).groupBy(F.col("security_id").alias("symbol"), "page").agg(F.map_from_entries(F.collect_list(F.struct("type", "l"))).alias("actions")))
    return D.actions_from_pages(pages, keep=("symbol",)).select("symbol", "type", "date", "date_field")


@query("s11_observation_archive", """
SELECT sha, state, count(*) AS observations FROM (SELECT CASE WHEN doc_id % 19 = 0 THEN sha256('x') ELSE sha256(text) END AS sha, CASE WHEN doc_id % 23 = 0 THEN 'PAYLOAD_MISSING' WHEN doc_id % 19 = 0 THEN 'HASH_MISMATCH' WHEN doc_id % 17 = 0 THEN 'SIZE_MISMATCH' ELSE 'VERIFIED' END AS state FROM documents) GROUP BY 1, 2""")
def s11(spark, sf):
    d, k = I.table(spark, sf, "documents"), F.col("doc_id")
    meta = d.select(k.cast("string").alias("payload_file"), F.when(k % 19 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), (F.octet_length("text") + F.when(k % 17 == 0, 1).otherwise(0)).alias("size"), k.alias("retrieved_at"))
    payloads = d.filter(k % 23 != 0).select(k.cast("string").alias("payload_file"), F.encode("text", "UTF-8").alias("payload"))
    return D.read_archive(meta, payloads).select(F.col("sha256").alias("sha"), "state", "observations")


def _snapshot(spark, sf):
    o = outcomes(spark, sf).select("event_id", "state", "reason", F.col("timing"))
    root = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    return N.write_snapshot({"news": I.news(spark, sf), "outcomes": o}, root), root


@query("s12_snapshot_write", "SELECT state, reason, count(*) AS n FROM v_outcomes GROUP BY 1, 2", ["v_outcomes"])
def s12(spark, sf):
    """Outcomes written under the hash of their contents and read back."""
    sid, root = _snapshot(spark, sf)
    return N.read_snapshot_table(spark, root, sid, "outcomes").groupBy("state", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("s13_snapshot_verify", "SELECT * FROM (VALUES ('news', true), ('outcomes', true)) t(name, ok)")
def s13(spark, sf):
    sid, root = _snapshot(spark, sf)
    return N.verify_snapshot(spark, root, sid).select("name", "ok")


@query("s14_report_sink", "SELECT timing, count(*) AS rows, count(DISTINCT cik) AS issuers, count(DISTINCT reaction_idx) AS sessions FROM v_events GROUP BY 1", ["v_events"])
def s14(spark, sf):
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    N.write_report(R.support(study_events(spark, sf), ["timing"]), path, mode="overwrite")
    return spark.read.schema("timing string, rows bigint, issuers bigint, sessions bigint").json(path)


@query("w20_line_context", """
SELECT page_id, line_no, md5(coalesce(string_agg(line, ' ') OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '')) AS before_md5, md5(string_agg(line, ' ') OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS after_md5 FROM v_lines""", ["v_lines"])
def w20(spark, sf):
    lines = D.html_lines(I.table(spark, sf, "pages"), keep=("page_id",))
    return D.line_context(lines, ["page_id"]).select("page_id", F.col("line_no").cast("bigint").alias("line_no"), F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


@query("o06_outlook_excerpts", r"""
SELECT page_id, line_no, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, line_no) AS rn FROM (SELECT *, 2 * CAST(regexp_matches(b || ' ' || a, '\bentire\b') AS INTEGER) + CAST(contains(a, '$') AS INTEGER) + CAST(regexp_matches(line, '\b(this|from|with)\b') AS INTEGER) AS score FROM (
SELECT *, coalesce(string_agg(line, ' ') OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS b, string_agg(line, ' ') OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a FROM v_lines)
WHERE regexp_matches(line, '\b(was|that)\b') AND regexp_matches(b || ' ' || a, '\b(this|from|with)\b') AND (regexp_matches(line, '\d|e') OR contains(a, '$')))) WHERE rn <= 14""", ["v_lines"])
def o06(spark, sf):
    """The screen with words that occur in the generated pages."""
    lines = D.html_lines(I.table(spark, sf, "pages"), keep=("page_id",))
    out = D.outlook_excerpts(lines, ["page_id"], revenue=r"\b(was|that)\b", anchor=r"\b(this|from|with)\b", horizon=r"\bentire\b", figure=r"\d|e")
    return out.select("page_id", F.col("line_no").cast("bigint").alias("line_no"), "score")


# ---- audits ----
@query("w17_chain_check", """
SELECT seq, CASE WHEN prev IS NULL THEN 'FIRST' WHEN seq % 500 = 0 THEN 'BROKEN' ELSE 'LINKED' END AS state FROM (SELECT event_id AS seq, lag(event_id) OVER (ORDER BY event_id) AS prev FROM events)""")
def w17(spark, sf):
    """The events table as a log whose records carry the hash of the one before, a few of them wrong."""
    e = I.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props").alias("line"))
    before = e.select((F.col("seq") + 1).alias("seq"), F.sha2("line", 256).alias("_h"))
    log = e.join(before, "seq", "left").withColumn("previous_sha256", F.when((F.col("seq") % 500 == 0) & F.col("_h").isNotNull(), F.lit("0")).otherwise(F.col("_h"))).drop("_h")
    return Q.verify_chain(log).select("seq", "state")


@query("q01_table_digest", """
SELECT n, sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS digest FROM (SELECT count(*) AS n, sum(CAST('0x' || h[1:16] AS HUGEINT)) AS s0, sum(CAST('0x' || h[17:32] AS HUGEINT)) AS s1, sum(CAST('0x' || h[33:48] AS HUGEINT)) AS s2, sum(CAST('0x' || h[49:64] AS HUGEINT)) AS s3
FROM (SELECT sha256(CAST(o_custkey AS VARCHAR) || chr(31) || CAST(o_orderkey AS VARCHAR) || chr(31) || o_orderpriority) AS h FROM orders))""")
def q01(spark, sf):
    return N.table_digest(I.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))


@query("q02_cohort_acceptance", """
SELECT events, complete, issuers, concat_ws(',', CASE WHEN in_window <> events THEN 'all_events_in_window' END, CASE WHEN of_category <> events THEN 'category_only' END, CASE WHEN bad_sources > 0 THEN 'source_hashes' END, CASE WHEN complete < 10 THEN 'minimum_events' END, CASE WHEN issuers < 5 THEN 'minimum_issuers' END, CASE WHEN unchecked > 0 THEN 'spot_checks' END) AS failed_gates FROM (
SELECT count(*) AS events, count_if(precision <> 'day' AND CAST(published_at - INTERVAL 5 HOUR AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-29') AS in_window, count_if(category = 'earnings') AS of_category, coalesce(count_if(state = 'MAPPED' AND why_10 IS NULL), 0) AS complete,
 count(DISTINCT CASE WHEN state = 'MAPPED' AND why_10 IS NULL THEN cik END) AS issuers, count_if(event_no % 37 = 0) AS bad_sources,
 (SELECT count(*) FROM (SELECT timing, count_if(event_no % 3 = 0) AS c FROM v_events GROUP BY 1) WHERE c < 2) AS unchecked FROM v_outcomes)""", ["v_outcomes", "v_events"])
def q02(spark, sf):
    o = outcomes(spark, sf)
    complete = (F.col("state") == "MAPPED") & F.col("reason_10").isNull()
    from tidemark.functions.text import local_day
    counts = o.agg(F.count(F.lit(1)).alias("events"), F.count_if((F.col("precision") != "day") & local_day("published_at", I.ZONE).between(F.lit("2024-01-02").cast("date"), F.lit("2024-01-29").cast("date"))).alias("in_window"),
                   F.count_if(F.col("category") == "earnings").alias("of_category"), F.count_if(complete).alias("complete"), F.count_distinct(F.when(complete, F.col("cik"))).alias("issuers"),
                   F.count_if(F.rlike("cik", F.lit(r"^\d{10}$"))).alias("valid_identity"), F.lit(0).alias("bad_candidates"))
    bad = I.sources(spark, sf).agg(F.count_if(F.col("sha256") != F.sha2("text", 256)))
    checks = Q.spot_checks(reviews(spark, sf), study_events(spark, sf)).agg(F.count_if(~F.col("passed")))
    facts = counts.select("*", bad.scalar().alias("bad_sources"), checks.scalar().alias("classes_unchecked"))  # three aggregates in one row
    return Q.audit_cohort(facts, {"events": 10, "issuers": 5}).select("events", "complete", "issuers", F.array_join("failed_gates", ",").alias("failed_gates"))


@query("q02_cohort_facts", """
WITH o AS (SELECT *, precision <> 'day' AND CAST(published_at - INTERVAL 5 HOUR AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-29' AS inside, state = 'MAPPED' AND why_10 IS NULL AS whole FROM v_outcomes),
c AS (SELECT event_no AS candidate_id, CASE WHEN event_no % 11 = 1 THEN 'excluded' ELSE 'included' END AS disposition, CASE WHEN event_no % 11 = 1 AND event_no % 4 <> 1 THEN 'why' END AS reason, CASE WHEN event_no % 11 <> 1 THEN CASE WHEN event_no % 97 = 5 THEN 'nowhere' ELSE event_id END END AS event_id FROM o
 UNION ALL SELECT -event_no, 'included', NULL, event_id FROM o WHERE event_no % 50 = 7),
s AS (SELECT *, coalesce(disposition = 'included' AND event_id IN (SELECT event_id FROM o), false) AS ok FROM c)
SELECT (SELECT count(*) FROM o) AS events, (SELECT count_if(inside) FROM o) AS in_window, (SELECT count_if(inside AND whole) FROM o) AS complete, (SELECT count(DISTINCT CASE WHEN inside AND whole THEN cik END) FROM o) AS issuers, (SELECT count(*) FROM c) AS candidates,
 (SELECT count_if(NOT ok AND NOT coalesce(disposition = 'excluded' AND reason IS NOT NULL AND event_id IS NULL, false)) FROM s) AS bad_candidates, (SELECT count(*) FROM o WHERE event_id NOT IN (SELECT event_id FROM s WHERE ok)) AS unrepresented,
 (SELECT count(*) FROM (SELECT event_id FROM s WHERE ok GROUP BY 1 HAVING count(*) > 1)) AS twice, (SELECT count_if(candidate_id % 13 = 0) FROM c) AS unsourced_candidates, true AS membership_matches""", ["v_outcomes"])
def q02_facts(spark, sf):
    """Facts recomputed from events, candidates and sources: some candidates left out without a reason, some for events that are not there, some twice, some without a source."""
    o = cut_lineage(outcomes(spark, sf))
    n, e = F.col("event_no"), F.col("event_id")
    out = n % 11 == 1
    c = o.select(n.alias("candidate_id"), F.when(out, "excluded").otherwise("included").alias("disposition"), F.when(out & (n % 4 != 1), "why").alias("reason"), F.when(~out, F.when(n % 97 == 5, "nowhere").otherwise(e)).alias("event_id"))
    c = c.unionByName(o.filter(n % 50 == 7).select((-n).alias("candidate_id"), F.lit("included").alias("disposition"), F.lit(None).cast("string").alias("reason"), "event_id"))
    sources = o.select(F.concat(F.lit("text of "), n.cast("string")).alias("text")).withColumn("sha256", F.sha2("text", 256))
    c = cut_lineage(c.withColumn("source_sha256", F.sha2(F.concat(F.when(F.col("candidate_id") % 13 == 0, "lost text of ").otherwise("text of "), F.abs("candidate_id").cast("string")), 256)))
    frozen = Q.members_digest(c.repartition(3)).first()[0]
    checks = Q.spot_checks(reviews(spark, sf), study_events(spark, sf))
    f = Q.cohort_facts(o, c, sources, checks, frozen, ("2024-01-02", "2024-01-29"), I.ZONE)
    return f.select("events", "in_window", "complete", "issuers", "candidates", "bad_candidates", "unrepresented", "twice", "unsourced_candidates", "membership_matches")


def reviews(spark, sf):
    n = study_events(spark, sf)
    return n.select("event_id", F.when(F.col("event_no") % 3 == 0, F.array(F.lit("A. Reviewer"))).otherwise(F.array(F.lit(" "))).alias("reviewers"), F.lit("page 1").alias("evidence"))


@query("q03_spot_checks", "SELECT timing, count(*) AS events, count_if(event_no % 3 = 0) AS checked, count_if(event_no % 3 = 0) >= 2 AS passed FROM v_events GROUP BY 1", ["v_events"])
def q03(spark, sf):
    return Q.spot_checks(reviews(spark, sf), study_events(spark, sf))


@query("q04_review_queue", """
SELECT order_no AS candidate_id, CASE WHEN order_no % 6 = 0 THEN 'PRIMARY_SCREENED_REVIEW_REQUIRED' ELSE 'PRIMARY_REVIEW_PENDING' END AS status,
 concat_ws(',', CASE WHEN form = '8-K/A' THEN 'AMENDMENT_REVIEW_REQUIRED' END, CASE WHEN n > 1 THEN 'MULTIPLE_FILINGS_FOR_ISSUER_REVIEW_REQUIRED' END, CASE WHEN order_no % 6 = 0 THEN 'ZZ_NOTE' END) AS flags FROM (SELECT *, count(*) OVER (PARTITION BY cik_no) AS n FROM v_filings)""", ["v_filings"])
def q04(spark, sf):
    f = I.filings(spark, sf).select(F.col("order_no").alias("candidate_id"), F.col("cik_no").alias("cik"), "form")
    notes = f.filter("candidate_id % 6 = 0").select("candidate_id", F.array(F.lit("ZZ_NOTE")).alias("review_flags"))
    return Q.review_queue(f, notes).select("candidate_id", "status", F.array_join("flags", ",").alias("flags"))


@query("q05_export_audit", """
SELECT security_id, received, missing, invalid_bars, concat_ws(',', CASE WHEN received <> stated THEN 'COUNT_MISMATCH' END, CASE WHEN missing > 0 THEN 'MISSING_SESSIONS' END, CASE WHEN unexpected > 0 THEN 'UNEXPECTED_SESSIONS' END, CASE WHEN invalid_bars > 0 THEN 'INVALID_BARS' END) AS blockers FROM (
SELECT k AS security_id, count(*) AS stated, count_if(idx IS NOT NULL OR true) AS received, (SELECT count(*) FROM v_sessions) - count(idx) AS missing, count_if(idx IS NULL) AS unexpected, count_if(n % 7 = 0) AS invalid_bars
FROM (SELECT CAST(user_id % 60 AS VARCHAR) AS k, CAST(ts AS DATE) AS session, count(*) AS n FROM events GROUP BY 1, 2) LEFT JOIN v_sessions USING (session) GROUP BY 1)""", ["v_sessions"])
def q05(spark, sf):
    b = I.table(spark, sf, "events").groupBy(I.security_id(n=60).alias("security_id"), F.to_date("ts").alias("session")).agg(F.count(F.lit(1)).cast("double").alias("volume"))
    b = b.withColumns({"open": F.lit(2.0), "high": F.when(F.col("volume") % 7 == 0, 1.0).otherwise(3.0), "low": F.lit(1.0), "close": F.lit(2.0)})
    _, bad = V.validate(b, V.ohlcv_rules())
    stated = b.groupBy("security_id").agg(F.count(F.lit(1)).alias("stated"))
    out = Q.audit_export(cal.session_coverage(b, I.calendar(spark)), bad, stated)
    return out.select("security_id", "received", "missing", "invalid_bars", F.array_join("blockers", ",").alias("blockers"))


@query("q06_commitments", "SELECT event_id, CASE WHEN event_no % 9 = 0 THEN 'DIFFERS' WHEN event_no % 10 = 0 THEN 'NOT_PINNED' ELSE 'MATCHES' END AS state FROM v_events", ["v_events"])
def q06(spark, sf):
    labels = study_labels(spark, sf)
    pins = Q.check_commitments(labels, labels.select("event_id").distinct().withColumn("pinned", F.lit(""))).select("event_id", "digest").join(labels.select("event_id", "event_no").distinct(), "event_id")
    pins = pins.filter("event_no % 10 <> 0 or event_no % 9 = 0").select("event_id", F.when(F.col("event_no") % 9 == 0, "0").otherwise(F.col("digest")).alias("pinned"))
    return Q.check_commitments(labels, pins).select("event_id", "state")


@query("q07_readiness", """
SELECT version, CAST(fold AS BIGINT) AS fold, fit_rows, fit_issuers, test_rows, CASE WHEN fit_rows >= 60 AND fit_issuers >= 10 AND test_rows >= 80 THEN 'READY' ELSE 'STOP_INSUFFICIENT_SOURCE_SUPPORT' END AS decision FROM (
SELECT version, fold, count(y) FILTER (role = 'train') AS fit_rows, count(DISTINCT CASE WHEN role = 'train' AND y IS NOT NULL THEN cik END) AS fit_issuers, count(y) FILTER (role = 'test') AS test_rows FROM v_folds WHERE target = 'gap_ge_3pct' GROUP BY 1, 2)""", ["v_folds"])
def q07(spark, sf):
    f = fold_rows(spark, sf, ("gap_ge_3pct",))
    tr = (F.col("role") == "train") & F.col("y").isNotNull()
    g = f.groupBy("version", F.col("fold").cast("bigint").alias("fold")).agg(F.count_if(tr).alias("fit_rows"), F.count_distinct(F.when(tr, F.col("cik"))).alias("fit_issuers"), F.count_if((F.col("role") == "test") & F.col("y").isNotNull()).alias("test_rows"))
    return Q.readiness(g, {"fit_rows": 60, "fit_issuers": 10, "test_rows": 80}).select("version", "fold", "fit_rows", "fit_issuers", "test_rows", "decision")


@query("l18_guidance_evidence", """
SELECT rule, n FROM (SELECT count_if(o_orderkey % 11 = 0) AS CLOCK_ORDER, count_if(o_orderkey % 13 = 0) AS INVALID_RANGE, count_if(o_orderkey % 17 = 0) AS MIDPOINT_ARITHMETIC, count_if(o_orderkey % 19 = 0) AS BLOCK_DISAGREES, count_if(o_orderkey % 23 = 0) AS LISTING_UNVERIFIED FROM orders)
UNPIVOT (n FOR rule IN (CLOCK_ORDER, INVALID_RANGE, MIDPOINT_ARITHMETIC, BLOCK_DISAGREES, LISTING_UNVERIFIED))""")
def l18(spark, sf):
    """Guidance pairs derived from orders, some with a wrong clock, range, revision, block or listing."""
    o, k = I.table(spark, sf, "orders"), F.col("o_orderkey")
    p = F.col("o_totalprice")
    d = o.select(F.col("o_orderdate").alias("prior_at"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("source_at"), (F.col("o_orderdate") + F.expr("interval 90 days 1 minute")).alias("available_at"),
                 F.when(k % 11 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("interval 91 days")).alias("cutoff"), p.alias("prior_lo"), (p * 1.2).alias("prior_hi"),
                 (p * 1.1).alias("lo"), (p * F.when(k % 13 == 0, 1.0).otherwise(1.3)).alias("hi"), k.alias("k"), (k % 3).alias("block"), F.when(k % 19 == 0, -1).otherwise(k % 3).alias("fold_block"), F.when(k % 23 == 0, "NYSE").otherwise("Nasdaq GS").alias("listed"))
    d = d.withColumn("revision", (F.col("lo") + F.col("hi")) / (F.col("prior_lo") + F.col("prior_hi")) - 1 + F.when(F.col("k") % 17 == 0, 0.01).otherwise(0.0))
    return V.violation_counts(d, Q.guidance_rules())


# Stated clocks of the news events, some of them wrong; ranges by number; openings per (symbol, session), some missing or not verified.
VIEWS["v_guidance"] = (("v_news", "v_days", "v_sessions"), f"""
SELECT n.event_no, n.user_id AS symbol, n.user_id AS cik, s.session AS reaction_session, n.event_no % 5 AS block, CAST(n.event_no % 3 - 1 AS DOUBLE) * 5 AS d, 2 * (100 + n.event_no % 50) + 10 AS prior_sum,
 s.session IS NULL OR n.event_no % 31 = 0 AS SESSION_DISAGREES, k.timing IS NULL OR n.event_no % 37 = 0 AS TIMING_DISAGREES, s.session IS NULL OR n.event_no % 41 = 0 AS SCHEDULED_OPEN_DISAGREES,
 s.session IS NULL OR n.event_no % 43 = 0 AS CUTOFF_DISAGREES,
 coalesce(n.published_at + INTERVAL 1 MINUTE >= s.open_utc - INTERVAL 15 MINUTE - CASE WHEN n.event_no % 43 = 0 THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END, true) AS CLOCK_ORDER,
 n.event_no % 13 = 0 AS INVALID_RANGE, n.event_no % 17 = 0 AS MIDPOINT_ARITHMETIC, n.event_no % 19 = 0 AS BLOCK_DISAGREES, n.event_no % 23 = 0 AS LISTING_UNVERIFIED
FROM v_news n JOIN ({CLASSIFY}) k USING (event_id) LEFT JOIN v_sessions s ON s.idx = k.reaction_idx""")
GUIDANCE_RULES = "SESSION_DISAGREES TIMING_DISAGREES SCHEDULED_OPEN_DISAGREES CUTOFF_DISAGREES CLOCK_ORDER INVALID_RANGE MIDPOINT_ARITHMETIC BLOCK_DISAGREES LISTING_UNVERIFIED".split()
VIEWS["v_verified"] = (("v_guidance",), f"SELECT * FROM v_guidance WHERE NOT ({' OR '.join(GUIDANCE_RULES)})")
VIEWS["v_openings"] = (("v_verified",), "SELECT symbol, reaction_session, min(event_no) % 4 <> 0 AS ok FROM v_verified GROUP BY 1, 2 HAVING min(event_no) % 29 <> 0")
VIEWS["v_opened"] = (("v_verified", "v_openings"), "SELECT v.*, coalesce(o.ok, false) AS opened FROM v_verified v LEFT JOIN v_openings o USING (symbol, reaction_session)")


def guidance(spark, sf):
    c, k = I.calendar(spark), F.col("event_no")
    days = F.broadcast(c.sessions.select(F.col("idx").alias("reaction_idx"), "session", "open_utc"))
    e = cal.classify(I.news(spark, sf), "published_at", c).join(days, "reaction_idx", "left")
    late = lambda n: F.when(k % n == 0, F.expr("interval 1 minute")).otherwise(F.expr("interval 0 minute"))
    lo, shift = (100 + k % 50).cast("double"), (k % 3 - 1).cast("double") * 5
    e = e.select("event_no", F.col("user_id").alias("symbol"), F.col("user_id").alias("cik"), F.date_add("session", F.when(k % 31 == 0, 1).otherwise(0)).alias("reaction_session"), F.when(k % 37 == 0, "noon").otherwise(F.col("timing")).alias("timing"),
                 (F.col("open_utc") + late(41)).alias("scheduled_open_at"), (F.col("open_utc") - F.expr("interval 15 minutes") - late(43)).alias("cutoff"), (F.col("published_at") - F.expr("interval 90 days")).alias("prior_at"),
                 F.col("published_at").alias("source_at"), (F.col("published_at") + F.expr("interval 1 minute")).alias("available_at"), lo.alias("prior_lo"), (lo + 10).alias("prior_hi"),
                 (lo + shift).alias("lo"), F.when(k % 13 == 0, F.lit(0.0)).otherwise(lo + 10 + shift).alias("hi"), (k % 5).alias("block"), F.when(k % 19 == 0, -1).otherwise(k % 5).alias("fold_block"), F.when(k % 23 == 0, "NYSE").otherwise("Nasdaq GS").alias("listed"))
    return e.withColumn("revision", (F.col("lo") + F.col("hi")) / (F.col("prior_lo") + F.col("prior_hi")) - 1 + F.when(k % 17 == 0, 0.001).otherwise(0.0))


@query("l18_guidance_clocks", f"SELECT rule, n FROM (SELECT {', '.join(f'count_if({x}) AS {x}' for x in GUIDANCE_RULES)} FROM v_guidance) UNPIVOT (n FOR rule IN ({', '.join(GUIDANCE_RULES)}))", ["v_guidance"])
def l18_clocks(spark, sf):
    """How many news events break each rule, stated clocks against the calendar included."""
    d, clocks = Q.guidance_clocks(guidance(spark, sf), I.calendar(spark))
    return V.violation_counts(d, clocks + Q.guidance_rules())


def openings_of(verified):
    o = verified.groupBy("symbol", "reaction_session").agg(F.min("event_no").alias("_m")).filter("_m % 29 <> 0")
    return o.select("symbol", "reaction_session", F.when(F.col("_m") % 4 == 0, "no_official_open").otherwise("verified_open").alias("status"))


@query("l18_guidance_support", """
SELECT *, concat_ws(',', CASE WHEN disagree <> 0 THEN 'openings_match_membership' END, CASE WHEN rows < 100 THEN 'minimum_rows' END, CASE WHEN issuers < 20 THEN 'minimum_issuers' END, CASE WHEN sessions < 10 THEN 'minimum_sessions' END,
 CASE WHEN full_blocks < 3 THEN 'minimum_blocks' END, CASE WHEN raises = 0 THEN 'raises_present' END, CASE WHEN cuts = 0 THEN 'cuts_present' END) AS failed FROM (
SELECT count(*) AS screened, count_if(opened) AS rows, count(DISTINCT CASE WHEN opened THEN cik END) AS issuers, count(DISTINCT CASE WHEN opened THEN reaction_session END) AS sessions, count_if(opened AND d > 0) AS raises, count_if(opened AND d < 0) AS cuts,
 count_if(opened AND d = 0) AS unchanged, count(DISTINCT CASE WHEN opened AND d < 0 THEN cik END) AS cut_issuers, (SELECT count(*) FROM (SELECT count(*) AS n, any_value(o.ok) AS ok FROM v_verified LEFT JOIN v_openings o USING (symbol, reaction_session) GROUP BY symbol, reaction_session) WHERE n <> 1 OR ok IS NULL) AS disagree,
 count(DISTINCT CASE WHEN opened THEN block END) AS blocks, (SELECT count(*) FROM (SELECT block FROM v_opened WHERE opened GROUP BY block HAVING count(*) >= 8)) AS full_blocks FROM v_opened)""", ["v_verified", "v_openings", "v_opened"])
def l18_support(spark, sf):
    """What verified clocks, ranges and openings leave of the news events, against floors."""
    ok, _ = Q.verify_guidance(guidance(spark, sf), I.calendar(spark))
    ok = cut_lineage(ok)  # read by the openings, the membership and the blocks
    out = Q.guidance_gate(Q.guidance_support(ok, openings_of(ok), 8), {"rows": 100, "issuers": 20, "sessions": 10, "blocks": 3})
    return out.select("screened", "rows", "issuers", "sessions", "raises", "cuts", "unchanged", "cut_issuers", "disagree", "blocks", "full_blocks", F.array_join("failed_gates", ",").alias("failed"))
