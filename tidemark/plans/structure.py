"""Market-structure and regime features on a gap-checked series.

Features look at the last L calendar sessions before an event's day. A symbol has one row per session, so everything is windowed once per (symbol, session) over
the dense grid, and events read the row of the session before their day by equality.
"""
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.validate import positive

# Feature -> (sessions needed, bar fields that must be positive).
STRUCTURE = {"return_5": (6, ("close",)), "rv_20": (21, ("close",)), "atr_14_fraction": (15, ("high", "low", "close")), "adv_20": (20, ("close", "volume")),
             "rvol_20": (21, ("volume",)), "distance_252_high": (252, ("high", "close"))}


def numbered_sessions(bars: DataFrame) -> DataFrame:
    """Sessions as observed over all symbols, numbered; at most one row per calendar day."""
    return bars.select("session").distinct().withColumn("idx", (F.row_number().over(W.orderBy("session")) - 1))


def densify(bars: DataFrame, sessions: DataFrame, key="security_id") -> DataFrame:
    """H1. Every (symbol, session) with its bar or nulls: ordinals are exploded per symbol up to the last session, and name their session by equality."""
    last = sessions.agg(F.max("idx")).scalar()
    grid = bars.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), last)).alias("idx")).join(F.broadcast(sessions.select("idx", "session")), "idx")  # sessions: one row per day
    return grid.join(bars, [key, "session"], "left")


def action_days(actions: DataFrame, spans: DataFrame, sessions: DataFrame, key="security_id") -> DataFrame:
    """Actions and unresolved spans as counts on session ordinals: `on_*` for days that are sessions, `before_*` for closed days, which count for windows that reach past them.

    Spans are opened into the days of the calendar they cover (an open end reaches the last session); each kind is one row per (symbol, session) after a grouping.
    """
    first, last = sessions.agg(F.min("session")).scalar(), sessions.agg(F.max("session")).scalar()
    inside = spans.select(key, F.greatest("start", first).alias("start"), F.least("end", last).alias("end")).filter("start <= end")
    days = (actions.select(key, F.col("date").alias("day"), F.lit("action").alias("kind"))
            .unionByName(inside.select(key, F.explode(F.sequence("start", "end")).alias("day"), F.lit("span").alias("kind"))).distinct())
    own = F.broadcast(sessions.select(F.col("session").alias("day"), F.col("idx").alias("own")))
    nxt = F.lead("session").over(W.orderBy("session"))
    gaps = (sessions.withColumn("_n", nxt).filter(F.datediff("_n", "session") > 1)
            .select((F.col("idx") + 1).alias("after"), F.explode(F.sequence(F.date_add("session", 1), F.date_sub("_n", 1))).alias("day")))
    placed = days.join(own, "day", "left").join(F.broadcast(gaps), "day", "left").filter("own is not null or after is not null")
    hit = lambda kind, col: F.count_if((F.col("kind") == kind) & F.col(col).isNotNull())
    return placed.groupBy(key, F.coalesce("own", "after").alias("idx")).agg(hit("action", "own").alias("on_action"), hit("action", "after").alias("before_action"), hit("span", "own").alias("on_span"), hit("span", "after").alias("before_span"))


def _reason(w, length, fields):
    frame, later = w.rowsBetween(-(length - 1), 0), w.rowsBetween(-(length - 2), 0)
    touched = lambda k: (F.sum(F.coalesce("on_" + k, F.lit(0))).over(frame) + F.sum(F.coalesce("before_" + k, F.lit(0))).over(later)) > 0
    good = F.lit(True)
    for f in fields:
        good = good & positive(f)
    return (F.when(F.col("idx") + 1 < length, "insufficient_history").when(touched("span"), "unverified_actions").when(touched("action"), "corporate_action")
            .when(F.count("close").over(frame) < length, "missing_session").when(F.sum(F.when(good, 1).otherwise(0)).over(frame) < length, "invalid_bar"))


def structure_table(grid: DataFrame, key="security_id") -> DataFrame:
    """W7 to W12. Each feature's value and unavailable reason as of the close of every (symbol, session); never a value across a gap."""
    w = W.partitionBy(key).orderBy("idx")
    prev = lambda c: F.lag(c).over(w)
    safe = lambda c: F.when(positive(c), F.col(c))
    base = grid.withColumn("_lr", F.log(safe("close") / F.nullif(F.lag(safe("close")).over(w), F.lit(0.0))))
    base = base.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev("close")), F.abs(F.col("low") - prev("close"))))
    rows = lambda a, b: w.rowsBetween(a, b)
    value = {
        "return_5": F.col("close") / F.nullif(F.lag("close", 5).over(w), F.lit(0.0)) - 1,
        "rv_20": F.stddev_samp("_lr").over(rows(-19, 0)),
        "atr_14_fraction": F.avg("_tr").over(rows(-13, 0)) / F.nullif(F.col("close"), F.lit(0.0)),
        "adv_20": F.avg(F.col("close") * F.col("volume")).over(rows(-19, 0)),
        "rvol_20": F.col("volume") / F.nullif(F.avg("volume").over(rows(-20, -1)), F.lit(0.0)),
        "distance_252_high": F.col("close") / F.nullif(F.max("high").over(rows(-251, 0)), F.lit(0.0)) - 1,
    }
    reasons = {n: _reason(w, length, fields) for n, (length, fields) in STRUCTURE.items()}
    out = base.select(key, "idx", "session", *[reasons[n].alias("why_" + n) for n in STRUCTURE], *[v.alias("_" + n) for n, v in value.items()])
    return out.select(key, "idx", "session", *["why_" + n for n in STRUCTURE], *[F.when(F.col("why_" + n).isNull(), F.col("_" + n)).alias(n) for n in STRUCTURE])


def regime_table(grid: DataFrame, singles, spreads, key="security_id", n=20) -> DataFrame:
    """W13. 20-session returns of reference symbols, and spreads of two, per session; the first leg without a value gives the reason.

    `singles` maps feature to symbol, `spreads` feature to (symbol, symbol). Symbols are a short list, so the pivot is one grouped row per session.
    """
    w = W.partitionBy(key).orderBy("idx")
    symbols = sorted({*singles.values(), *[s for pair in spreads.values() for s in pair]})
    why = _reason(w, n + 1, ("close",))
    r = (grid.filter(F.col(key).isin(symbols)).withColumn("why", why).withColumn("_v", F.col("close") / F.nullif(F.lag("close", n).over(w), F.lit(0.0)) - 1)
         .withColumn("v", F.when(F.col("why").isNull(), F.col("_v"))))
    at = lambda s, c: F.max(F.when(F.col(key) == s, F.col(c)))
    wide = r.groupBy("idx", "session").agg(*[at(s, "v").alias(f"v_{s}") for s in symbols], *[at(s, "why").alias(f"w_{s}") for s in symbols])
    cols = [F.col(f"v_{s}").alias(n) for n, s in singles.items()] + [F.col(f"w_{s}").alias("why_" + n) for n, s in singles.items()]
    cols += [(F.col(f"v_{a}") - F.col(f"v_{b}")).alias(n) for n, (a, b) in spreads.items()] + [F.coalesce(f"w_{a}", f"w_{b}").alias("why_" + n) for n, (a, b) in spreads.items()]
    return wide.select("idx", "session", *cols)


def structure_features(events: DataFrame, table: DataFrame, sessions: DataFrame, day="day", key="security_id", regimes: DataFrame = None) -> DataFrame:
    """L15. The features of each event's symbol as of the last session before its day; the grid row is met by equality on (symbol, ordinal).

    A day after the last session reads the last one, however much later it is; a day on or before the first has insufficient history. With `regimes` (`regime_table`) the levels and spreads of the
    reference symbols as of the same session come with their reasons, met by the ordinal: one row per session, bounded by the calendar.
    """
    # days between two sessions -> ordinal of the earlier one; one row per calendar day
    nxt = F.lead("session").over(W.orderBy("session"))
    spans = sessions.withColumn("_n", nxt).filter("_n is not null")
    before = spans.select(F.col("idx").alias("_between"), F.explode(F.sequence(F.date_add("session", 1), F.col("_n"))).alias(day))
    last, end = sessions.agg(F.max_by("idx", "session")).scalar(), sessions.agg(F.max("session")).scalar()
    asked = events.join(F.broadcast(before), day, "left").withColumn("_before", F.coalesce("_between", F.when(F.col(day) > end, last))).drop("_between")
    out = asked.join(table.withColumnRenamed("idx", "_before").drop("session"), [key, "_before"], "left")
    reasons = [c for c in table.columns if c.startswith("why_")]
    if regimes is not None:
        out = out.join(F.broadcast(regimes.withColumnRenamed("idx", "_before").drop("session")), "_before", "left")
        reasons += [c for c in regimes.columns if c.startswith("why_")]
    early = F.col("_before").isNull() & F.col(day).isNotNull()
    return out.withColumns({c: F.when(early, F.lit("insufficient_history")).otherwise(F.col(c)) for c in reasons}).drop("_before")


def feature_coverage(df: DataFrame, names, by=()) -> DataFrame:
    """A22. Available or the reason, counted per feature (and partition)."""
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(F.col("why_" + n), F.lit("available")).alias("state")) for n in names])
    return df.withColumn("_f", F.explode(rows)).groupBy(*by, "_f.feature", "_f.state").agg(F.count(F.lit(1)).alias("n"))
