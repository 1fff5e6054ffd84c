"""Joins between events and session windows: always an equality on (security, session ordinal) or on a day."""
from pyspark.sql import DataFrame, Window as W, functions as F


def bars_at_offsets(events: DataFrame, bars: DataFrame, ks, idx="reaction_idx") -> DataFrame:
    """J2. The bar at each session offset. A session without a bar stays missing and never shifts to the next one."""
    want = events.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("_want", F.col(idx) + F.col("k"))
    have = bars.select("security_id", F.col("idx").alias("_want"), "price_id", "session", "open", "high", "low", "close", "volume")
    return want.join(have, ["security_id", "_want"], "left").drop("_want")


def explode_windows(events: DataFrame, n: int, idx="reaction_idx", out="window_idx") -> DataFrame:
    """D4. One row per session ordinal of the window from the anchor to reaction session n."""
    return events.filter(F.col(idx).isNotNull()).withColumn(out, F.explode(F.sequence(F.col(idx) - 1, F.col(idx) + n - 1)))


def event_window_bars(events: DataFrame, bars: DataFrame, calendar, n: int) -> DataFrame:
    """J3. Every session of each event's window with its bar, if there is one."""
    dim = F.broadcast(calendar.sessions.select(F.col("idx").alias("window_idx"), "session"))
    have = bars.select("security_id", F.col("idx").alias("window_idx"), "price_id", "open", "high", "low", "close", "volume", "available_at")
    return explode_windows(events, n).join(dim, "window_idx").join(have, ["security_id", "window_idx"], "left")


def actions_in_window(events: DataFrame, actions: DataFrame, calendar, n: int) -> DataFrame:
    """J4. Events with an action after the anchor and on or before the last session of the window.

    The half-open date test is an ordinal test, and 'any action in idx..idx+n-1' is worked out once per (security, session); events then meet it by equality.
    """
    day = F.broadcast(calendar.days.select(F.col("day").alias("effective_date"), F.coalesce("idx", "next_idx").alias("at")))
    hit = (actions.join(day, "effective_date").filter("at is not null").select("security_id", "at").distinct()
           .select("security_id", F.explode(F.sequence(F.col("at") - n + 1, F.col("at"))).alias("reaction_idx")).distinct())
    return (events.filter(F.col("reaction_idx").between(1, calendar.last_idx - n + 1))
            .join(hit, ["security_id", "reaction_idx"], "left_semi"))


def overlaps(windows: DataFrame, spans: DataFrame, key: str, window, span) -> DataFrame:
    """J5. Windows touched by any span of the same key, both closed; ends may lie at any distance (null: open).

    A span touches a window if, of the spans that start by the window's last day, the latest end is not before its first day. Both sides are reduced to one row per
    (key, day) before the running maximum, so a key's rows in one task are bounded by the calendar however hot it is.
    """
    far = F.to_date(F.lit("9999-12-31"))
    starts = spans.filter(F.col(span[0]).isNotNull()).groupBy(key, F.col(span[0]).alias("_day")).agg(F.max(F.coalesce(F.col(span[1]), far)).alias("_end"))
    asked = windows.select(key, F.col(window[1]).alias("_day")).distinct()
    line = starts.unionByName(asked.withColumn("_end", F.lit(None).cast("date"))).groupBy(key, "_day").agg(F.max("_end").alias("_end"))
    reach = line.withColumn("_reach", F.max("_end").over(W.partitionBy(key).orderBy("_day").rowsBetween(W.unboundedPreceding, 0))).select(key, F.col("_day").alias(window[1]), "_reach")
    return windows.join(reach, [key, window[1]]).filter(F.col("_reach") >= F.col(window[0])).select(*windows.columns)


def resolve_security(events: DataFrame, securities: DataFrame, at: str) -> DataFrame:
    """J6. The identity row valid at an instant; validity is half-open. Identity tables hold a few rows per security."""
    s = securities.withColumnRenamed("security_id", "_sid").withColumnRenamed("available_at", "sec_available_at")
    on = (F.col("security_id") == F.col("_sid")) & (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return events.join(s, on, "left").drop("_sid")
