"""Registered queries: validation rules (V1-V13, V23) and the event outcome (L1, L2, A1, M1, M2, J2-J6)."""
from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.registry import query
from tidemark.operators import sessions as cal, validate as V, windows_join as J
from tidemark.plans import outcomes as L


def outcomes(spark, sf, mode=V.HISTORICAL, with_ids=False):
    return L.build_outcomes(I.news(spark, sf), I.securities(spark, sf), I.bars(spark, sf), I.actions(spark, sf), I.providers(spark), I.calendar(spark),
                            I.as_of(), mode, with_ids)


def micros(c, name=None):
    return F.unix_micros(F.col(c)).alias(name or c)


OUTCOME_SQL = """
SELECT event_id, state, reason, CASE WHEN reaction_idx IS NOT NULL AND precision <> 'day' THEN timing END AS timing, CAST(CASE WHEN precision <> 'day' THEN reaction_idx END AS BIGINT) AS reaction_idx,
 CASE WHEN state = 'MAPPED' THEN round(open / anchor_close - 1, 9) + 0.0 END AS open_gap, CASE WHEN state = 'MAPPED' THEN round(close / anchor_close - 1, 9) + 0.0 END AS day1_return,
 CASE WHEN state = 'MAPPED' THEN anchor_price_id END AS anchor_price_id, why_2, why_5, why_10, why_20 FROM {view}"""


def outcome_view(o):
    mapped = F.col("state") == "MAPPED"
    ret = lambda c: F.when(mapped, F.round(F.col(c) / F.col("anchor_close") - 1, 9) + 0.0)
    return o.select("event_id", "state", "reason", "timing", F.col("reaction_idx").cast("bigint").alias("reaction_idx"), ret("open").alias("open_gap"), ret("close").alias("day1_return"),
                    F.when(mapped, F.col("anchor_price_id")).alias("anchor_price_id"), *[F.col(f"reason_{n}").alias(f"why_{n}") for n in (2, 5, 10, 20)])


@query("l01_event_outcome", OUTCOME_SQL.format(view="v_outcomes"), ["v_outcomes"])
def l01(spark, sf):
    return outcome_view(outcomes(spark, sf))


@query("l01_event_outcome_forward", OUTCOME_SQL.format(view="v_outcomes_fwd"), ["v_outcomes_fwd"])
def l01_forward(spark, sf):
    return outcome_view(outcomes(spark, sf, V.FORWARD))


LABEL_SQL = """
SELECT event_id, label, kind, round(num, 9) + 0.0 AS num, flag, reason, CASE WHEN reason IS NULL THEN epoch_us(avail) END AS label_available_at, price_ids FROM {view}"""


def label_view(o):
    return L.label_rows(o, with_ids=True).select("event_id", "label", "kind", (F.round("num", 9) + 0.0).alias("num"), "flag", "reason", micros("label_available_at"), "price_ids")


@query("l01_sixteen_labels", LABEL_SQL.format(view="v_labels"), ["v_labels"])
def l01_labels(spark, sf):
    return label_view(outcomes(spark, sf, with_ids=True))


@query("l01_sixteen_labels_forward", LABEL_SQL.format(view="v_labels_fwd"), ["v_labels_fwd"])
def l01_labels_forward(spark, sf):
    return label_view(outcomes(spark, sf, V.FORWARD, with_ids=True))


@query("l02_window_quality", """
SELECT e.security_id, CAST(e.reaction_idx AS BIGINT) AS idx, w.why_1, w.why_2, w.why_5, w.why_10, w.why_20, CASE WHEN w.why_5 IS NULL THEN round(w.close_5, 6) END AS close_5 FROM (SELECT DISTINCT security_id, reaction_idx FROM v_early WHERE early_reason IS NULL) e
JOIN (SELECT security_id, reaction_idx, min(event_id) AS rep FROM v_early WHERE early_reason IS NULL GROUP BY 1, 2) r USING (security_id, reaction_idx) JOIN v_windows w ON w.event_id = r.rep""", ["v_windows"])
def l02(spark, sf):
    """Quality of every window some event needs."""
    q = L.window_quality(L.bar_grid(I.bars(spark, sf), I.calendar(spark), I.providers(spark), I.actions(spark, sf), I.as_of()), I.calendar(spark))
    need = outcomes(spark, sf).filter("early_reason is null").select("security_id", F.col("reaction_idx").alias("idx")).distinct()
    return need.join(q, ["security_id", "idx"]).select("security_id", F.col("idx").cast("bigint").alias("idx"), *[F.col(f"reason_{n}").alias(f"why_{n}") for n in (1, 2, 5, 10, 20)], F.when(F.col("reason_5").isNull(), F.round("close_5", 6)).alias("close_5"))


@query("a01_build_report", """
SELECT 'events' AS item, count(*) AS n FROM v_outcomes UNION ALL SELECT 'mapped_day1', count_if(state = 'MAPPED') FROM v_outcomes
UNION ALL SELECT 'complete_20_session', count_if(state = 'MAPPED' AND why_20 IS NULL) FROM v_outcomes UNION ALL SELECT 'unique_issuers', count(DISTINCT CASE WHEN state = 'MAPPED' AND why_20 IS NULL THEN company_id END) FROM v_outcomes
UNION ALL SELECT 'quarantined', count_if(state <> 'MAPPED') FROM v_outcomes UNION ALL SELECT 'reason:' || reason, count(*) FROM v_outcomes WHERE reason IS NOT NULL GROUP BY 1""", ["v_outcomes"])
def a01(spark, sf):
    return L.build_report(outcomes(spark, sf))


@query("m01_returns", """
SELECT security_id, session, round(high / open - 1, 9) + 0.0 AS ret, round((1 + high / low - 1) / (1 + open / low - 1) - 1, 9) + 0.0 AS rebased FROM v_bars""", ["v_bars"])
def m01(spark, sf):
    from tidemark.functions.numeric import rebase, ret
    b = I.bars(spark, sf)
    return b.select("security_id", "session", (F.round(ret("high", "open"), 9) + 0.0).alias("ret"), (F.round(rebase(ret("high", "low"), ret("open", "low")), 9) + 0.0).alias("rebased"))


@query("m02_exact_thresholds", """
SELECT l_orderkey, l_linenumber, t.t AS pct, CAST(l_extendedprice AS DECIMAL(18, 4)) * 100 >= CAST(l_quantity * 1000 AS DECIMAL(18, 4)) * (100 + t.t) AS reached
FROM lineitem, (VALUES (3), (5), (10), (15), (20), (30)) t(t)""")
def m02(spark, sf):
    li = I.table(spark, sf, "lineitem")
    rows = F.array(*[F.struct(F.lit(t).alias("pct"), L.ge_pct(F.col("l_extendedprice"), F.col("l_quantity") * 1000, t).alias("reached")) for t in L.THRESHOLDS])
    return li.select("l_orderkey", "l_linenumber", F.explode(rows).alias("r")).select("l_orderkey", "l_linenumber", "r.pct", "r.reached")


RULE_COUNTS = "SELECT rule, n FROM (SELECT {cols} FROM {frm}) UNPIVOT (n FOR rule IN ({names}))"


def counts_sql(frm, rules):
    return RULE_COUNTS.format(cols=", ".join(f"count_if(coalesce({c}, false)) AS {n}" for n, c in rules), frm=frm, names=", ".join(n for n, _ in rules))


@query("v01_rule_engine", """
SELECT order_no, array_to_string(list_filter([CASE WHEN amount > 300000 THEN 'LARGE' END, CASE WHEN form = '8-K/A' THEN 'AMENDMENT' END, CASE WHEN items_text IS NULL THEN 'NO_ITEMS' END], lambda x: x IS NOT NULL), ',') AS violations
FROM v_filings WHERE amount > 300000 OR form = '8-K/A' OR items_text IS NULL""", ["v_filings"])
def v01(spark, sf):
    rules = [("LARGE", F.col("amount") > 300000), ("AMENDMENT", F.col("form") == "8-K/A"), ("NO_ITEMS", F.col("items_text").isNull())]
    _, rejects = V.validate(I.filings(spark, sf), rules)
    return rejects.select("order_no", F.array_join("violations", ",").alias("violations"))


@query("v02_unique_key", "SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) WHERE n > 1")
def v02(spark, sf):
    return V.check_unique(I.table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@query("v03_foreign_key", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def v03(spark, sf):
    return V.check_fk(I.table(spark, sf, "lineitem"), I.table(spark, sf, "part").filter("p_size < 25"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("v04_ohlcv_rule", counts_sql("(SELECT open, high, low, CASE WHEN volume % 7 = 0 THEN high * 1.1 ELSE close END AS close, volume - 3 AS volume FROM v_long_bars)", [
    ("NONPOSITIVE_OR_NONFINITE_PRICE", "NOT (open > 0 AND high > 0 AND low > 0 AND close > 0)"), ("NEGATIVE_VOLUME", "volume < 0"), ("INVALID_OHLC_ORDER", "NOT (low <= least(open, close) AND greatest(open, close) <= high)")]), ["v_long_bars"])
def v04(spark, sf):
    b = I.long_bars(spark, sf)
    b = b.withColumn("close", F.when(F.col("volume") % 7 == 0, F.col("high") * 1.1).otherwise(F.col("close"))).withColumn("volume", F.col("volume") - 3)
    return V.violation_counts(b, V.ohlcv_rules())


@query("v05_bar_clock", """
SELECT security_id, session, CASE WHEN s.close_utc IS NULL THEN 'NOT_A_SESSION' ELSE 'AVAILABLE_BEFORE_CLOSE' END AS violation
FROM (SELECT user_id AS security_id, CAST(ts AS DATE) AS session, max(ts) + INTERVAL 30 MINUTE AS available_at FROM events GROUP BY 1, 2) b LEFT JOIN v_sessions s USING (session)
WHERE s.close_utc IS NULL OR available_at < s.close_utc""", ["v_sessions"])
def v05(spark, sf):
    b = I.table(spark, sf, "events").groupBy(F.col("user_id").alias("security_id"), F.to_date("ts").alias("session")).agg((F.max("ts") + F.expr("interval 30 minutes")).alias("available_at"))
    return V.check_bar_clock(b, I.calendar(spark)).select("security_id", "session", "violation")


@query("v06_source_chronology", counts_sql("v_sources", [("URL_NOT_HTTPS", "NOT starts_with(url, 'https://')"), ("CHRONOLOGY_INVALID", "first_seen_at > retrieved_at"),
    ("RETRIEVED_AFTER_AS_OF", "retrieved_at > TIMESTAMP '2024-01-30 12:00:00'"), ("CHECKSUM_MISMATCH", "sha256 <> sha256(text)")]), ["v_sources"])
def v06(spark, sf):
    return V.violation_counts(I.sources(spark, sf), V.source_rules(I.as_of()))


@query("v07_evidence_in_source", "SELECT n.event_id, coalesce(contains(s.text, s.timestamp_evidence), false) AS evidence_found FROM v_news n LEFT JOIN v_sources s USING (source_id)", ["v_sources"])
def v07(spark, sf):
    return V.check_evidence(I.news(spark, sf), I.sources(spark, sf)).select("event_id", "evidence_found")


@query("v08_event_record_rules", counts_sql("""(SELECT n.*, s.timestamp_evidence AS evidence, CASE WHEN n.event_no % 8 = 0 THEN 'premarket' ELSE t.timing END AS expected, t.timing, t.reaction_idx,
  CASE WHEN n.event_no % 17 = 0 THEN ['day1_open_return', 'made_up'] ELSE ['day1_open_return'] END AS caveats FROM v_news n JOIN v_sources s ON s.source_id = n.source_id JOIN v_timed t ON t.event_id = n.event_id)""", [
    ("PRECISION_NOT_MINUTE", "precision <> 'minute'"), ("NOT_MINUTE_ALIGNED", "date_trunc('minute', published_at) <> published_at"),
    ("EVIDENCE_NOT_LOCAL_MINUTE", "strftime(published_at - INTERVAL 5 HOUR, '%H:%M') <> right(evidence, 5)"), ("SEEN_BEFORE_PUBLISHED", "first_seen_at < published_at"),
    ("TIMING_DISAGREES", "CASE WHEN reaction_idx IS NOT NULL THEN timing END IS DISTINCT FROM CASE WHEN event_no % 8 = 0 OR reaction_idx IS NOT NULL THEN expected END"),
    ("SESSION_DISAGREES", "event_no % 9 = 0"), ("UNKNOWN_CAVEAT_LABEL", "list_contains(caveats, 'made_up')")]), ["v_sources", "v_timed"])
def v08(spark, sf):
    n = cal.classify(I.news(spark, sf), "published_at", I.calendar(spark)).join(I.sources(spark, sf).select("source_id", "timestamp_evidence"), "source_id")
    n = n.join(F.broadcast(I.calendar(spark).sessions.select(F.col("idx").alias("reaction_idx"), F.col("session").alias("reaction_session"))), "reaction_idx", "left")
    n = (n.withColumn("expected_timing", F.when(F.col("event_no") % 8 == 0, "premarket").otherwise(F.col("timing")))
         .withColumn("expected_session", F.when(F.col("event_no") % 9 == 0, F.date_add(F.coalesce("reaction_session", F.to_date("published_at")), 1)).otherwise(F.col("reaction_session")))
         .withColumn("caveat_labels", F.when(F.col("event_no") % 17 == 0, F.array(F.lit("day1_open_return"), F.lit("made_up"))).otherwise(F.array(F.lit("day1_open_return"))))
         .withColumn("known_labels", F.array(*[F.lit(x) for x in L.LABELS])))
    return V.violation_counts(n, V.event_rules(I.ZONE))


@query("v09_ordered_quarantine", "SELECT coalesce(early_reason, 'none') AS reason, count(*) AS n FROM v_early GROUP BY 1", ["v_early"])
def v09(spark, sf):
    return outcomes(spark, sf).groupBy(F.coalesce("early_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("v10_publication_bounds", """
SELECT event_id, CASE WHEN precision <> 'day' THEN epoch_us(published_at) END AS pub_first, epoch_us(pub_last) AS pub_last, epoch_us(pub_available) AS pub_available FROM v_timed""", ["v_timed"])
def v10(spark, sf):
    return V.publication_bounds(I.news(spark, sf)).select("event_id", micros("pub_first"), micros("pub_last"), micros("pub_available"))


@query("v11_strict_time_parse", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN epoch_us(date_trunc('second', ts)) WHEN event_id % 4 = 2 THEN epoch_us(date_trunc('second', ts) + INTERVAL 5 HOUR) ELSE NULL END AS parsed FROM events""")
def v11(spark, sf):
    """Naive text and text without a date part are refused; an offset is applied."""
    e = I.table(spark, sf, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(F.col("event_id") % 4 == 0, iso).when(F.col("event_id") % 4 == 1, F.concat(iso, F.lit("Z")))
            .when(F.col("event_id") % 4 == 2, F.concat(iso, F.lit("-05:00"))).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("Z"))))
    return e.select("event_id", F.unix_micros(V.parse_utc(text)).alias("parsed"))


@query("v12_availability_by_mode", """
SELECT event_id, epoch_us(published_at) AS historical, epoch_us(greatest(published_at, first_seen_at)) AS forward_observed FROM v_news""", ["v_news"])
def v12(spark, sf):
    n = I.news(spark, sf)
    return n.select("event_id", F.unix_micros(V.available_at("published_at", "first_seen_at", V.HISTORICAL)).alias("historical"),
                    F.unix_micros(V.available_at("published_at", "first_seen_at", V.FORWARD)).alias("forward_observed"))


@query("v13_identity_at_release", """
SELECT n.event_id, CASE WHEN exchange NOT IN ('NASDAQ', 'NYSE', 'NYSE American') OR security_type <> 'common_stock' THEN 'INELIGIBLE_SECURITY'
 WHEN precision = 'day' THEN NULL WHEN s.available_at > published_at OR valid_from > published_at THEN 'IDENTITY_NOT_KNOWN_AT_RELEASE' WHEN pub_last >= valid_to THEN 'IDENTITY_EXPIRED' END AS reason
FROM v_timed n LEFT JOIN v_securities s USING (security_id)""", ["v_timed"])
def v13(spark, sf):
    return L.with_identity(V.publication_bounds(I.news(spark, sf)), I.securities(spark, sf)).select("event_id", V.identity_reason().alias("reason"))


@query("v23_allowlisted_view", """
SELECT order_no, CASE WHEN form IN ('8-K', '10-Q') THEN form ELSE 'OTHER' END AS form, CASE WHEN items_text IS NULL OR items_text IN ('2.02,9.01', '3.99') THEN items_text ELSE 'OTHER' END AS items_text FROM v_filings""", ["v_filings"])
def v23(spark, sf):
    return V.redact(I.filings(spark, sf), {"form": ["8-K", "10-Q"], "items_text": ["2.02,9.01", "3.99"]}, keep=["order_no"])


@query("j02_bars_at_offsets", """
SELECT t.event_id, k.k, b.price_id, round(b.close, 6) AS close FROM v_timed t CROSS JOIN (VALUES (-1), (0), (1), (4), (9), (19)) k(k)
LEFT JOIN v_bars b ON b.security_id = t.security_id AND b.idx = t.reaction_idx + k.k""", ["v_timed", "v_bars"])
def j02(spark, sf):
    t = cal.classify(I.news(spark, sf), "published_at", I.calendar(spark))
    return J.bars_at_offsets(t, I.bars(spark, sf), (-1, 0, 1, 4, 9, 19)).select("event_id", "k", "price_id", F.round("close", 6).alias("close"))


@query("j03_window_membership", """
SELECT t.event_id, s.session, b.price_id FROM v_timed t JOIN v_sessions s ON s.idx BETWEEN t.reaction_idx - 1 AND t.reaction_idx + 4 LEFT JOIN v_bars b ON b.security_id = t.security_id AND b.session = s.session""", ["v_timed", "v_bars"])
def j03(spark, sf):
    t = cal.classify(I.news(spark, sf), "published_at", I.calendar(spark))
    return J.event_window_bars(t, I.bars(spark, sf), I.calendar(spark), 5).select("event_id", "session", "price_id")


@query("j04_action_in_window", """
SELECT t.event_id FROM v_timed t JOIN v_sessions a ON a.idx = t.reaction_idx - 1 JOIN v_sessions l ON l.idx = t.reaction_idx + 4
WHERE EXISTS (SELECT 1 FROM v_actions x WHERE x.security_id = t.security_id AND x.effective_date > a.session AND x.effective_date <= l.session)""", ["v_timed", "v_actions"])
def j04(spark, sf):
    t = cal.classify(I.news(spark, sf), "published_at", I.calendar(spark))
    return J.actions_in_window(t, I.actions(spark, sf), I.calendar(spark), 5).select("event_id")


@query("j05_interval_overlap", """
SELECT e.event_id FROM events e WHERE e.event_type = 'purchase' AND EXISTS (SELECT 1 FROM events u WHERE u.event_type = 'error' AND u.event_id % 5 = 0 AND u.user_id = e.user_id
 AND CAST(u.ts AS DATE) <= CAST(e.ts AS DATE) AND CAST(u.ts AS DATE) + 2 >= CAST(e.ts AS DATE) - 4)""")
def j05(spark, sf):
    e = I.table(spark, sf, "events")
    day = F.to_date("ts")
    spans = e.filter((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).select("user_id", day.alias("start"), F.date_add(day, 2).alias("end"))
    windows = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.date_sub(day, 4).alias("first"), day.alias("last"))
    return J.overlaps(windows, spans, "user_id", ("first", "last"), ("start", "end")).select("event_id")


@query("j06_identity_as_of", """
SELECT n.event_id, s.ticker FROM v_news n LEFT JOIN v_securities s ON s.security_id = n.security_id AND s.valid_from <= n.published_at AND (s.valid_to IS NULL OR n.published_at < s.valid_to)""", ["v_news", "v_securities"])
def j06(spark, sf):
    return J.resolve_security(I.news(spark, sf), I.securities(spark, sf), "published_at").select("event_id", "ticker")
