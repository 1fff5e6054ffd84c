"""Trading-session calendar: everything becomes an ordinal, so that every calendar join is an equi join.

A calendar is one row per day of a configured range, so its size is bounded by the range (`MAX_DAYS`) and broadcasting it is safe.
"""
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

MAX_DAYS = 100_000
OUT_OF_RANGE = "CALENDAR_OUT_OF_RANGE"


def session_days(spec):
    """The session dates of a calendar specification, in order."""
    first, last = date.fromisoformat(spec["start"]), date.fromisoformat(spec["end"])
    if not 0 <= (last - first).days < MAX_DAYS:
        raise ValueError("calendar range must be positive and at most %d days" % MAX_DAYS)
    span = (first + timedelta(days=i) for i in range((last - first).days + 1))
    return [d for d in span if d.weekday() < 5 and d.isoformat() not in set(spec["holidays"])]


class Calendar:
    """A calendar specification as two literal tables: `sessions` (K1) and `days`, every calendar day with its next session.

    The session dates are configuration, so they enter the plan as one array literal; no window, shuffle or cross join is needed to number them.
    """

    def __init__(self, spark: SparkSession, spec):
        dates = session_days(spec)
        self.spec, self.zone = spec, spec["timezone"]
        self.first_day, self.last_day = date.fromisoformat(spec["start"]), date.fromisoformat(spec["end"])
        self.size = len(dates)
        self.last_idx = self.size - 1
        self.dates = F.array(*[F.lit(d) for d in dates])
        one = spark.sql("SELECT 1 AS one")
        self.sessions = self._clocked(one.select(F.posexplode(self.dates).alias("idx", "session")), "session").select("session", "idx", "open_utc", "close_utc")
        # session i answers for the days from the one before it up to its own eve
        n = self.size
        at = F.get(self.dates, F.col("i") - 1)
        upto = F.when(F.col("i") == n, F.lit(self.last_day)).otherwise(F.date_sub(F.get(self.dates, F.col("i")), 1))
        spans = (one.select(F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).withColumn("_own", F.when(F.col("i") > 0, at))
                 .withColumn("_from", F.coalesce("_own", F.lit(self.first_day))).withColumn("_to", upto).filter("_from <= _to"))
        days = (spans.select("i", "_own", F.explode(F.sequence("_from", "_to")).alias("day"))
                .select("day", F.when(F.col("day") == F.col("_own"), F.col("i") - 1).alias("idx"), F.when(F.col("i") < n, F.col("i")).alias("next_idx")))
        self.days = self._clocked(days, "day").select("day", "idx", *[F.when(F.col("idx").isNotNull(), F.col(c)).alias(c) for c in ("open_utc", "close_utc")], "next_idx")

    def _clocked(self, df: DataFrame, day: str) -> DataFrame:
        """UTC open and close of a session date: New York wall clock, early closes included."""
        close = F.lit("16:00")
        for early, text in self.spec["early_closes"].items():
            close = F.when(F.col(day) == F.lit(date.fromisoformat(early)), text).otherwise(close)
        wall = lambda text: F.to_utc_timestamp(F.to_timestamp(F.concat(F.col(day).cast("string"), F.lit(" "), text, F.lit(":00"))), self.zone)
        return df.withColumn("open_utc", wall(F.lit("09:30"))).withColumn("close_utc", wall(close))


def merge_calendars(*specs):
    """K2. Union of calendars: one zone, and a day may not carry two closing times."""
    zones = {s["timezone"] for s in specs}
    if len(zones) != 1:
        raise ValueError("calendars must share one time zone")
    early = {}
    for spec in specs:
        for day, close in spec["early_closes"].items():
            if early.setdefault(day, close) != close:
                raise ValueError("conflicting early close on " + day)
    return {"start": min(s["start"] for s in specs), "end": max(s["end"] for s in specs), "timezone": zones.pop(),
            "holidays": sorted({d for s in specs for d in s["holidays"]}), "early_closes": early}


def merge_calendar_rows(rows: DataFrame) -> DataFrame:
    """K2 as rows: (day, close) from many calendars to one row per day, conflicts marked."""
    return rows.groupBy("day").agg(F.min("close").alias("close"), (F.count_distinct("close") > 1).alias("conflict"),
                                   F.count(F.lit(1)).alias("n_calendars"))


def local_wall(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def classify(df: DataFrame, ts: str, calendar: Calendar, prefix: str = "") -> DataFrame:
    """K3. Timing class of an instant and the ordinal of the session that reacts to it.

    Adds `<prefix>timing` and `<prefix>reaction_idx`; both null outside the calendar, or where no later session exists.
    """
    p, zone = prefix, calendar.zone
    dim = F.broadcast(calendar.days.select(F.col("day").alias("_day"), F.col("idx").alias("_idx"), F.col("open_utc").alias("_open"),
                                  F.col("close_utc").alias("_close"), F.col("next_idx").alias("_next")))
    t, opening, close = F.col(ts), F.col("_open"), F.col("_close")
    timing = (F.when(F.col("_day").isNull(), None)
              .when(F.col("_idx").isNull(), "closed")
              .when((t == opening) | (t == close), "bell_ambiguous")
              .when((t > opening) & (t < close), "regular")
              .when(t < opening, "premarket").otherwise("after_hours"))
    same_day = F.col("_timing").isin("bell_ambiguous", "regular", "premarket")
    return (df.withColumn("_local", F.to_date(local_wall(t, zone)))
            .join(dim, F.col("_local") == F.col("_day"), "left")
            .withColumn("_timing", timing)
            .withColumn(p + "reaction_idx", F.when(same_day, F.col("_idx")).otherwise(F.col("_next")))
            .withColumn(p + "timing", F.when(F.col(p + "reaction_idx").isNotNull(), F.col("_timing")))
            .drop("_local", "_day", "_idx", "_open", "_close", "_next", "_timing"))


def session_offset(df: DataFrame, calendar: Calendar, idx: str, n: int, out: str = "offset_session") -> DataFrame:
    """K4. The session `n` ordinals away, or the reason it cannot be named."""
    dim = F.broadcast(calendar.sessions.select(F.col("idx").alias("_i"), F.col("session").alias(out)))
    return (df.join(dim, F.col(idx) + n == F.col("_i"), "left").drop("_i")
            .withColumn(out + "_reason", F.when(F.col(out).isNull(), OUT_OF_RANGE)))


def crosses_boundary(df: DataFrame, first: str, last: str, calendar: Calendar) -> DataFrame:
    """K5. Whether the first and last possible instants of a publication fall in different classes."""
    both = classify(classify(df, first, calendar), last, calendar, "last_")
    return both.withColumn("crosses", ~(F.col("timing").eqNullSafe(F.col("last_timing"))
                                        & F.col("reaction_idx").eqNullSafe(F.col("last_reaction_idx"))))


def event_window(df: DataFrame, calendar: Calendar, idx: str, n_sessions: int = 20) -> DataFrame:
    """K6. Anchor session, last required session and the whole months they span; null where the calendar is too short."""
    dim = calendar.sessions.select(F.col("idx").alias("_i"), F.col("session").alias("_s"))
    at = lambda k, name: F.broadcast(dim.select(F.col("_i").alias("_i" + name), F.col("_s").alias(name)))
    out = df
    for k, name in ((-1, "anchor_session"), (n_sessions - 1, "last_session")):
        out = out.join(at(k, name), F.col(idx) + k == F.col("_i" + name), "left").drop("_i" + name)
    return (out.withColumn("month_start", F.trunc("anchor_session", "month").cast("date"))
            .withColumn("month_end", F.last_day("last_session")))


def label_available(df: DataFrame, calendar: Calendar, idx: str, n: Column, lag_seconds: int = 60) -> DataFrame:
    """K7. A label is first known a minute after the close of the last session of its window."""
    dim = F.broadcast(calendar.sessions.select(F.col("idx").alias("_i"), F.col("close_utc").alias("_c")))
    return (df.withColumn("_last", F.col(idx) + n - 1).join(dim, F.col("_last") == F.col("_i"), "left")
            .withColumn("label_available_at", F.col("_c") + F.make_dt_interval(secs=F.lit(lag_seconds)))
            .drop("_last", "_i", "_c"))


def session_coverage(bars: DataFrame, calendar: Calendar, key: str = "security_id", first_n: int = 20) -> DataFrame:
    """K8, O8. Per symbol: expected, received, missing, zero-volume and unexpected sessions, and the first few bad dates.

    The expected grid is exploded per symbol from the calendar; a symbol has at most one row per calendar day.
    """
    have = bars.select(key, F.col("session"), "volume", F.lit(True).alias("got"))
    expected = bars.select(key).distinct().select(key, F.explode(calendar.dates).alias("session"), F.lit(True).alias("want"))
    both = expected.join(have, [key, "session"], "full_outer")
    missing = F.col("want").isNotNull() & F.col("got").isNull()
    unexpected = F.col("want").isNull()
    dates = lambda cond: F.array_join(F.slice(F.array_sort(F.collect_list(F.when(cond, F.col("session")))), 1, first_n), ",")
    return both.groupBy(key).agg(
        F.count("want").alias("expected"), F.count("got").alias("received"),
        F.count_if(missing).alias("missing"), F.count_if(unexpected).alias("unexpected"),
        F.count_if(F.col("got") & (F.col("volume") == 0)).alias("zero_volume"),
        F.min(F.when(F.col("got"), F.col("session"))).alias("first_date"), F.max(F.when(F.col("got"), F.col("session"))).alias("last_date"),
        dates(missing).alias("first_missing"), dates(unexpected).alias("first_unexpected"))


def lookback_sessions(df: DataFrame, calendar: Calendar, cutoff: str, valid_from: str, lengths) -> DataFrame:
    """K9. Ordinals of the last L sessions before the cutoff's local day inside the identity interval, for the largest supported L."""
    top, zone, size = max(lengths), calendar.zone, calendar.size
    dim = F.broadcast(calendar.days.select(F.col("day").alias("_day"), F.coalesce("idx", "next_idx", F.lit(size)).alias("_stop")))
    # valid_from to the first session whose open is at or after it, by its local day
    lows = F.broadcast(calendar.days.select(F.col("day").alias("_vday"), F.col("idx").alias("_vidx"), F.col("open_utc").alias("_vopen"), F.col("next_idx").alias("_vnext")))
    low = (F.when(F.col("_vlocal") < F.lit(calendar.first_day), 0)
           .when(F.col("_vidx").isNotNull() & (F.col("_vopen") >= F.col(valid_from)), F.col("_vidx")).otherwise(F.coalesce("_vnext", F.lit(size))))
    support = F.lit(0)
    for length in sorted(lengths):
        support = F.when(F.col("_have") >= length, length).otherwise(support)
    return (df.withColumn("_local", F.to_date(local_wall(F.col(cutoff), zone))).withColumn("_vlocal", F.to_date(local_wall(F.col(valid_from), zone)))
            .join(dim, F.col("_local") == F.col("_day"), "left").join(lows, F.col("_vlocal") == F.col("_vday"), "left")
            .withColumn("_have", F.greatest(F.lit(0), F.col("_stop") - F.greatest(low, F.col("_stop") - top, F.lit(0))))
            .withColumn("supported", support)
            .withColumn("first_idx", F.when(F.col("supported") > 0, F.col("_stop") - F.col("supported")))
            .withColumn("last_idx", F.when(F.col("supported") > 0, F.col("_stop") - 1))
            .drop("_local", "_vlocal", "_day", "_stop", "_vday", "_vidx", "_vopen", "_vnext", "_have"))


def merge_ranges(spans: DataFrame, key: str, start: str = "first_idx", end: str = "last_idx") -> DataFrame:
    """K10. Merge overlapping or adjacent session ranges per symbol.

    Identical ranges collapse first and, of ranges sharing a start, only the longest is kept, so that a symbol carries at most one row per session into the window.
    """
    w = W.partitionBy(key).orderBy(start)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    return (spans.groupBy(key, start).agg(F.max(end).alias(end))
            .withColumn("_new", F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0))
            .withColumn("_island", F.sum("_new").over(w))
            .groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island"))


def day_part(ts: Column, zone: str) -> Column:
    """K11. Part of the local day of a minute: premarket, regular, the closing minute, after hours."""
    local = local_wall(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return (F.when(minute < 570, "premarket").when(minute < 960, "regular")
            .when(minute == 960, "closing_minute").otherwise("after_hours"))


def daily_semantics(intraday: DataFrame, daily: DataFrame, zone: str, key: str = "security_id") -> DataFrame:
    """K12. Rebuild each daily bar from intraday rows, over all hours and over regular hours, and compare with the stored bar."""
    part = day_part(F.col("ts"), zone)
    rows = (intraday.withColumn("part", part).withColumn("session", F.to_date(local_wall(F.col("ts"), zone)))
            .withColumn("at", F.struct("ts", "row_id")))
    regular = F.col("part") == "regular"
    built = rows.groupBy(key, "session").agg(
        F.min_by("price", "at").alias("all_open"), F.max("price").alias("all_high"), F.min("price").alias("all_low"), F.max_by("price", "at").alias("all_close"),
        F.min_by(F.when(regular, F.col("price")), F.when(regular, F.col("at"))).alias("reg_open"),
        F.max(F.when(regular, F.col("price"))).alias("reg_high"), F.min(F.when(regular, F.col("price"))).alias("reg_low"),
        F.max_by(F.when(regular, F.col("price")), F.when(regular, F.col("at"))).alias("reg_close"),
        F.count(F.lit(1)).alias("rows"), F.count_if(regular).alias("regular_rows"),
        F.count_if(F.col("part") == "premarket").alias("premarket_rows"), F.count_if(F.col("part") == "after_hours").alias("after_hours_rows"))
    joined = built.join(daily.select(key, "session", "open", "high", "low", "close"), [key, "session"])
    flags = [(F.col(f) == F.col(f"{scope}_{f}")).alias(f"{f}_is_{scope}") for f in ("open", "high", "low", "close") for scope in ("all", "reg")]
    share = lambda c: F.round(F.col(c) / F.col("rows"), 9).alias(c.replace("_rows", "_share"))
    return joined.select(key, "session", *flags, share("regular_rows"), share("premarket_rows"), share("after_hours_rows"))
