"""Registered queries: session calendar (K)."""
from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.registry import query
from tidemark.operators import sessions as cal
from tidemark.operators.validate import publication_bounds


def micros(c):
    return F.unix_micros(F.col(c)).alias(c)


@query("k01_build_sessions", """
SELECT s.session, CAST(s.idx AS BIGINT) AS idx, epoch_us(s.open_utc) AS open_utc, epoch_us(s.close_utc) AS close_utc, count(e.ts) AS events
FROM v_sessions s LEFT JOIN events e ON e.ts >= s.open_utc AND e.ts < s.close_utc GROUP BY ALL""", ["v_sessions"])
def k01(spark, sf):
    """Sessions with their UTC bells, and how many events fell inside each: the join key is the UTC day, bells are checked after it."""
    s = I.calendar(spark).sessions
    e = I.table(spark, sf, "events").groupBy(F.date_trunc("minute", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    hits = (e.withColumn("session", F.to_date("ts")).join(F.broadcast(s), "session")
            .filter((F.col("ts") >= F.col("open_utc")) & (F.col("ts") < F.col("close_utc"))).groupBy("session").agg(F.sum("n").alias("events")))
    return s.join(hits, "session", "left").select("session", F.col("idx").cast("bigint").alias("idx"), micros("open_utc"), micros("close_utc"), F.coalesce("events", F.lit(0)).alias("events"))


@query("k02_merge_calendars", """
SELECT day, min(close) AS close, count(DISTINCT close) > 1 AS conflict, count(*) AS n_calendars
FROM (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 4001 = 0 THEN '13:00' ELSE '16:00' END AS close FROM orders) GROUP BY 1""")
def k02(spark, sf):
    o = I.table(spark, sf, "orders")
    return cal.merge_calendar_rows(o.select(F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 4001 == 0, "13:00").otherwise("16:00").alias("close")))


CLASSIFY = """
SELECT n.event_id, CASE WHEN r IS NULL THEN NULL ELSE t END AS timing, CAST(r AS BIGINT) AS reaction_idx FROM (
SELECT n.event_id, CASE WHEN d.idx IS NULL THEN 'closed' WHEN published_at = d.open_utc OR published_at = d.close_utc THEN 'bell_ambiguous'
  WHEN published_at > d.open_utc AND published_at < d.close_utc THEN 'regular' WHEN published_at < d.open_utc THEN 'premarket' ELSE 'after_hours' END AS t,
  CASE WHEN d.idx IS NOT NULL AND published_at <= d.close_utc THEN d.idx ELSE d.next_idx END AS r
FROM v_news n LEFT JOIN v_days d ON d.day = CAST(n.published_at - INTERVAL 5 HOUR AS DATE)) n"""


@query("k03_classify_instant", CLASSIFY, ["v_news", "v_days"])
def k03(spark, sf):
    out = cal.classify(I.news(spark, sf), "published_at", I.calendar(spark))
    return out.select("event_id", "timing", F.col("reaction_idx").cast("bigint").alias("reaction_idx"))


@query("k04_session_offset", f"""
SELECT c.event_id, s.session AS offset_session, CASE WHEN s.session IS NULL THEN 'CALENDAR_OUT_OF_RANGE' END AS offset_session_reason
FROM ({CLASSIFY}) c LEFT JOIN v_sessions s ON s.idx = c.reaction_idx + 4""", ["v_news", "v_days"])
def k04(spark, sf):
    out = cal.classify(I.news(spark, sf), "published_at", I.calendar(spark))
    return cal.session_offset(out, I.calendar(spark), "reaction_idx", 4).select("event_id", "offset_session", "offset_session_reason")


@query("k05_crosses_boundary", """
SELECT event_id, NOT (t0 IS NOT DISTINCT FROM t1 AND r0 IS NOT DISTINCT FROM r1) AS crosses FROM (
 SELECT event_id, max(CASE WHEN k = 0 AND r IS NOT NULL THEN t END) t0, max(CASE WHEN k = 1 AND r IS NOT NULL THEN t END) t1, max(CASE WHEN k = 0 THEN r END) r0, max(CASE WHEN k = 1 THEN r END) r1 FROM (
 SELECT event_id, k, CASE WHEN d.idx IS NULL THEN 'closed' WHEN pt = d.open_utc OR pt = d.close_utc THEN 'bell_ambiguous' WHEN pt > d.open_utc AND pt < d.close_utc THEN 'regular'
   WHEN pt < d.open_utc THEN 'premarket' ELSE 'after_hours' END AS t, CASE WHEN d.idx IS NOT NULL AND pt <= d.close_utc THEN d.idx ELSE d.next_idx END AS r
 FROM (SELECT event_id, k, CASE WHEN precision = 'day' THEN NULL WHEN k = 1 AND precision = 'minute' THEN published_at + INTERVAL 59999999 MICROSECOND ELSE published_at END AS pt
   FROM v_news, (VALUES (0), (1)) z(k)) n LEFT JOIN v_days d ON d.day = CAST(n.pt - INTERVAL 5 HOUR AS DATE)) GROUP BY 1)""", ["v_news", "v_days"])
def k05(spark, sf):
    return cal.crosses_boundary(publication_bounds(I.news(spark, sf)), "pub_first", "pub_last", I.calendar(spark)).select("event_id", "crosses")


@query("k06_event_window", f"""
SELECT c.event_id, a.session AS anchor_session, l.session AS last_session, CAST(date_trunc('month', a.session) AS DATE) AS month_start, last_day(l.session) AS month_end
FROM ({CLASSIFY}) c LEFT JOIN v_sessions a ON a.idx = c.reaction_idx - 1 LEFT JOIN v_sessions l ON l.idx = c.reaction_idx + 19""", ["v_news", "v_days"])
def k06(spark, sf):
    out = cal.classify(I.news(spark, sf), "published_at", I.calendar(spark))
    return cal.event_window(out, I.calendar(spark), "reaction_idx").select("event_id", "anchor_session", "last_session", "month_start", "month_end")


@query("k07_label_availability", f"""
SELECT c.event_id, n.n, epoch_us(s.close_utc + INTERVAL 1 MINUTE) AS label_available_at
FROM ({CLASSIFY}) c, (VALUES (1), (2), (5), (10), (20)) n(n) LEFT JOIN v_sessions s ON s.idx = c.reaction_idx + n.n - 1""", ["v_news", "v_days"])
def k07(spark, sf):
    out = cal.classify(I.news(spark, sf), "published_at", I.calendar(spark)).withColumn("n", F.explode(F.array(*[F.lit(n) for n in (1, 2, 5, 10, 20)])))
    return cal.label_available(out, I.calendar(spark), "reaction_idx", F.col("n")).select("event_id", "n", micros("label_available_at"))


@query("k08_session_coverage", """
SELECT security_id, count(want) AS expected, count(got) AS received, count_if(want IS NOT NULL AND got IS NULL) AS missing, count_if(want IS NULL) AS unexpected,
 count_if(got AND volume = 0) AS zero_volume, min(CASE WHEN got THEN session END) AS first_date, max(CASE WHEN got THEN session END) AS last_date,
 coalesce(array_to_string(list_sort(list(CAST(session AS VARCHAR)) FILTER (want IS NOT NULL AND got IS NULL))[1:20], ','), '') AS first_missing,
 coalesce(array_to_string(list_sort(list(CAST(session AS VARCHAR)) FILTER (want IS NULL))[1:20], ','), '') AS first_unexpected
FROM (SELECT g.security_id, s.session, true AS want FROM (SELECT DISTINCT CAST(user_id % 400 AS VARCHAR) AS security_id FROM events) g, v_sessions s) w
FULL JOIN (SELECT CAST(user_id % 400 AS VARCHAR) AS security_id, CAST(ts AS DATE) AS session, CAST(count(*) AS DOUBLE) AS volume, true AS got FROM events GROUP BY 1, 2) b
USING (security_id, session) GROUP BY 1""", ["v_sessions"])
def k08(spark, sf):
    """Sparse bars of 400 symbols, weekends included, against the expected grid."""
    b = (I.table(spark, sf, "events").groupBy(I.security_id(n=400).alias("security_id"), F.to_date("ts").alias("session")).agg(F.count(F.lit(1)).cast("double").alias("volume")))
    return cal.session_coverage(b, I.calendar(spark))


@query("k09_lookback_sessions", """
SELECT event_id, CAST(supported AS BIGINT) AS supported, CAST(CASE WHEN supported > 0 THEN stop - supported END AS BIGINT) AS first_idx, CAST(CASE WHEN supported > 0 THEN stop - 1 END AS BIGINT) AS last_idx FROM (
SELECT event_id, stop, CASE WHEN have >= 15 THEN 15 WHEN have >= 6 THEN 6 WHEN have >= 3 THEN 3 ELSE 0 END AS supported FROM (
SELECT event_id, stop, (SELECT count(*) FROM v_sessions s WHERE s.idx < stop AND s.idx >= stop - 15 AND s.open_utc >= vf) AS have FROM (
SELECT n.event_id, CASE WHEN user_id % 4 = 0 THEN TIMESTAMP '2024-01-10 15:00:00' WHEN user_id % 4 = 1 THEN TIMESTAMP '2024-01-06 00:00:00' ELSE TIMESTAMP '2023-01-01' END AS vf,
 CASE WHEN CAST(cutoff - INTERVAL 5 HOUR AS DATE) < DATE '2024-01-01' THEN NULL ELSE (SELECT count(*) FROM v_sessions s WHERE s.session < CAST(cutoff - INTERVAL 5 HOUR AS DATE)) END AS stop FROM v_news n)))""", ["v_news", "v_sessions"])
def k09(spark, sf):
    n = I.news(spark, sf).withColumn("valid_from", F.when(F.col("user_id") % 4 == 0, I.ts("2024-01-10 15:00:00")).when(F.col("user_id") % 4 == 1, I.ts("2024-01-06 00:00:00")).otherwise(I.ts("2023-01-01 00:00:00")))
    out = cal.lookback_sessions(n, I.calendar(spark), "cutoff", "valid_from", (3, 6, 15))
    return out.select("event_id", *[F.col(c).cast("bigint").alias(c) for c in ("supported", "first_idx", "last_idx")])


@query("k10_merge_ranges", """
SELECT security_id, CAST(min(a) AS BIGINT) AS first_idx, CAST(max(b) AS BIGINT) AS last_idx FROM (
 SELECT *, sum(CASE WHEN prev IS NULL OR a > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, max(b) OVER (PARTITION BY security_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (
   SELECT o_custkey % 50 AS security_id, o_orderkey % 3000 AS a, o_orderkey % 3000 + o_orderkey % 5 AS b FROM orders)))
GROUP BY security_id, island""")
def k10(spark, sf):
    o = I.table(spark, sf, "orders")
    spans = o.select((F.col("o_custkey") % 50).alias("security_id"), (F.col("o_orderkey") % 3000).alias("first_idx"), (F.col("o_orderkey") % 3000 + F.col("o_orderkey") % 5).alias("last_idx"))
    return cal.merge_ranges(spans, "security_id")


@query("k11_day_part", """
SELECT part, count(*) AS n FROM (SELECT CASE WHEN m < 570 THEN 'premarket' WHEN m < 960 THEN 'regular' WHEN m = 960 THEN 'closing_minute' ELSE 'after_hours' END AS part
 FROM (SELECT hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) AS m FROM events)) GROUP BY 1""")
def k11(spark, sf):
    return I.table(spark, sf, "events").groupBy(cal.day_part(F.col("ts"), I.ZONE).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("k12_daily_semantics", """
WITH r AS (SELECT CAST(user_id % 10 AS VARCHAR) AS security_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS session, value AS price, {'a': ts, 'b': event_id} AS k_at,
  CASE WHEN m < 570 THEN 'pre' WHEN m < 960 THEN 'reg' WHEN m = 960 THEN 'cm' ELSE 'ah' END AS part FROM (SELECT *, hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) AS m FROM events WHERE value > 0)),
b AS (SELECT security_id, session, arg_min(price, k_at) ao, max(price) ah, min(price) al, arg_max(price, k_at) ac, arg_min(price, k_at) FILTER (part = 'reg') ro, max(price) FILTER (part = 'reg') rh,
  min(price) FILTER (part = 'reg') rl, arg_max(price, k_at) FILTER (part = 'reg') rc, count(*) n, count_if(part = 'reg') nr, count_if(part = 'pre') np, count_if(part = 'ah') na FROM r GROUP BY 1, 2)
SELECT b.security_id, b.session, d.open = ao AS open_is_all, d.open = ro AS open_is_reg, d.high = ah AS high_is_all, d.high = rh AS high_is_reg, d.low = al AS low_is_all, d.low = rl AS low_is_reg,
 d.close = ac AS close_is_all, d.close = rc AS close_is_reg, round(nr / n, 9) AS regular_share, round(np / n, 9) AS premarket_share, round(na / n, 9) AS after_hours_share
FROM b JOIN v_bars d USING (security_id, session)""", ["v_bars"])
def k12(spark, sf):
    e = I.table(spark, sf, "events").filter("value > 0").select(I.security_id().alias("security_id"), "ts", F.col("event_id").alias("row_id"), F.col("value").alias("price"))
    return cal.daily_semantics(e, I.bars(spark, sf), I.ZONE)
