from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sessions as cal, validate as V
from tidemark.plans import outcomes as L

SPEC = {"start": "2026-01-01", "end": "2026-12-31", "timezone": "America/New_York",
        "holidays": ["2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25"],
        "early_closes": {"2026-11-27": "13:00", "2026-12-24": "13:00"}}


@pytest.fixture(scope="module")
def calendar(spark):
    return cal.Calendar(spark, SPEC)


def rows(df):
    return [tuple(r) for r in df.collect()]


def ts(text):
    return datetime.fromisoformat(text)


def test_daylight_saving_and_early_close(calendar):
    got = {str(r["session"]): (r["open_utc"], r["close_utc"]) for r in calendar.sessions.collect()}
    assert got["2026-03-06"][0] == ts("2026-03-06T14:30:00") and got["2026-03-09"][0] == ts("2026-03-09T13:30:00")
    assert got["2026-11-27"][1] == ts("2026-11-27T18:00:00")
    assert "2026-11-26" not in got and "2026-03-07" not in got


def test_day_map_names_the_next_session(calendar):
    days = {str(r["day"]): r for r in calendar.days.collect()}
    idx = {str(r["session"]): r["idx"] for r in calendar.sessions.collect()}
    assert len(days) == 365
    assert days["2026-03-07"]["idx"] is None and days["2026-03-07"]["next_idx"] == idx["2026-03-09"]
    assert days["2026-03-06"]["idx"] == idx["2026-03-06"] and days["2026-03-06"]["next_idx"] == idx["2026-03-09"]
    assert days["2026-12-31"]["next_idx"] is None and days["2026-01-01"]["next_idx"] == 0


def test_classify_bells_weekends_and_range(spark, calendar):
    times = ["2026-03-06 14:30:00", "2026-03-06 21:00:00", "2026-03-06 14:29:00", "2026-03-06 15:00:00", "2026-03-06 22:00:00", "2026-03-07 15:00:00", "2025-12-31 15:00:00", "2026-12-31 22:00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, s string").withColumn("t", F.to_timestamp("s"))
    got = [(r["timing"], r["reaction_idx"]) for r in cal.classify(df, "t", calendar).orderBy("i").collect()]
    idx = {str(r["session"]): r["idx"] for r in calendar.sessions.collect()}
    d, n = idx["2026-03-06"], idx["2026-03-09"]
    assert got == [("bell_ambiguous", d), ("bell_ambiguous", d), ("premarket", d), ("regular", d), ("after_hours", n), ("closed", n), (None, None), (None, None)]


def test_merge_calendars_conflict():
    merged = cal.merge_calendars(SPEC, dict(SPEC, start="2025-01-01", holidays=["2025-12-25"]))
    assert merged["start"] == "2025-01-01" and "2025-12-25" in merged["holidays"]
    with pytest.raises(ValueError):
        cal.merge_calendars(SPEC, dict(SPEC, early_closes={"2026-11-27": "12:00"}))


def test_strict_time_parse(spark):
    df = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("2026-01-02T03:04:05-05:00",), ("2026-01-02T03:04:05",), ("2026-01-02Z",), ("x",)], "s string")
    got = [r[0] for r in df.select(V.parse_utc("s")).collect()]
    assert got == [ts("2026-01-02T03:04:05"), ts("2026-01-02T08:04:05"), None, None, None]


def bundle(spark, calendar, drop=None, open_factor=1.10, published="2026-03-02 13:00:00"):
    """One security at 100 with a given opening gap on the reaction day and a 12% close at session 20; optionally one bar is missing."""
    sess = {r["idx"]: (r["session"], r["close_utc"]) for r in calendar.sessions.collect()}
    d0 = next(i for i, (s, _) in sess.items() if s == date(2026, 3, 2))
    bars = []
    for k in range(-1, 25):
        s, close = sess[d0 + k]
        c = 100.0 if k == -1 else 112.0 if k >= 19 else 107.0
        o = 100.0 * open_factor if k == 0 else c
        lo = 100.0 if k == 0 else min(o, c)
        if k != drop:
            bars.append((f"B{k}", "X", s, o, max(o, c), lo, c, 10.0, "P1", "sip", "raw", True, False, True, close, close))
    b = spark.createDataFrame(bars, "price_id string, security_id string, session date, open double, high double, low double, close double, volume double, provider_id string, feed string, price_basis string, "
                                    "complete boolean, halted boolean, corporate_actions_verified boolean, available_at timestamp, first_seen_at timestamp")
    n = spark.createDataFrame([("E1", "K1", "X", published, "minute")], "event_id string, cluster_id string, security_id string, p string, precision string")
    n = n.select("event_id", "cluster_id", "security_id", F.to_timestamp("p").alias("published_at"), "precision", (F.to_timestamp("p") + F.expr("interval 5 minutes")).alias("cutoff"), F.lit(True).alias("first_public_verified"),
                 F.to_timestamp("p").alias("first_seen_at"))
    s = spark.sql("SELECT 'X' security_id, 'C' company_id, 'NASDAQ' exchange, 'common_stock' security_type, timestamp'2020-01-01' valid_from, cast(null as timestamp) valid_to, timestamp'2020-01-01' available_at")
    p = spark.sql("SELECT 'P1' provider_id, 'u' terms_url, 'regular' session_scope, true research_permitted, array('sip') feeds")
    a = spark.sql("SELECT 'X' security_id, date'2020-01-01' effective_date").limit(0)
    o = L.build_outcomes(n, s, b, a, p, calendar, F.lit("2026-12-01 00:00:00").cast("timestamp"))
    return o, {r["label"]: r for r in L.label_rows(o).collect()}


def test_known_answers(spark, calendar):
    _, labels = bundle(spark, calendar)
    assert labels["day1_open_return"]["num"] == pytest.approx(0.10) and labels["session_20_close_return"]["num"] == pytest.approx(0.12)
    assert labels["positive_gap_filled"]["flag"] is True and labels["positive_gap_retained_half"]["flag"] is True
    assert len(labels) == 16 and all((r["reason"] is None) != (r["num"] is None and r["flag"] is None) for r in labels.values())


def test_threshold_is_exact_and_inclusive(spark, calendar):
    _, labels = bundle(spark, calendar, open_factor=1.03)
    assert labels["gap_ge_3pct"]["flag"] is True and labels["gap_ge_5pct"]["flag"] is False


def test_small_gap_makes_conditional_labels_absent_not_false(spark, calendar):
    _, labels = bundle(spark, calendar, open_factor=1.001)
    assert labels["positive_gap_filled"]["flag"] is None and labels["positive_gap_filled"]["reason"] == L.NO_GAP


def test_missing_session_never_shifts(spark, calendar):
    _, labels = bundle(spark, calendar, drop=3)
    assert labels["session_2_close_return"]["reason"] is None
    assert labels["session_5_close_return"]["reason"] == "MISSING_SESSION" and labels["session_20_close_return"]["num"] is None


def test_missing_anchor_and_intraday(spark, calendar):
    o, _ = bundle(spark, calendar, drop=-1)
    assert o.first()["reason"] == "MISSING_PREVIOUS_SESSION"
    o, _ = bundle(spark, calendar, published="2026-03-02 15:00:00")
    assert o.first()["reason"] == "INTRADAY_OR_BELL_REQUIRES_FINER_DATA"
    o, _ = bundle(spark, calendar, published="2026-03-02 14:29:00")  # the minute reaches up to the bell, its last instant does not
    assert o.first()["reason"] == "CUTOFF_NOT_BEFORE_REACTION_OPEN"


def test_require_raises_with_the_rule_name(spark):
    df = spark.range(3)
    with pytest.raises(Exception, match="rule broken: TOO_BIG"):
        V.require(df, [("TOO_BIG", F.col("id") > 1)]).collect()
    assert V.require(df, [("TOO_BIG", F.col("id") > 5)]).count() == 3
