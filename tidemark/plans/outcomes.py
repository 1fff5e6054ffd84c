"""Event outcomes: quarantine chain, anchor and the sixteen reaction labels, each with a reason when it is missing.

Window quality depends on (security, reaction session, length) and not on the event, so it is worked out once on the bar grid, which holds
at most one row per security and session; events then meet it by one equi join on (security_id, session ordinal).
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators import sessions as cal
from tidemark.operators.validate import FORWARD, HISTORICAL, available_at, first_reason, identity_reason, publication_bounds

HORIZONS = (2, 5, 10, 20)
THRESHOLDS = (3, 5, 10, 15, 20, 30)
NO_GAP = "NOT_POSITIVE_GAP_GE_0_5PCT"
RETURN_LABELS = tuple(f"day1_{f}_return" for f in ("open", "high", "low", "close")) + tuple(f"session_{n}_close_return" for n in HORIZONS)
BOOLEAN_LABELS = tuple(f"gap_ge_{t}pct" for t in THRESHOLDS) + ("positive_gap_retained_half", "positive_gap_filled")
LABELS = RETURN_LABELS + BOOLEAN_LABELS
PRICE = "decimal(33,16)"  # times a four-digit number this is the widest decimal that keeps every digit


def simple_return(x: Column, base: Column) -> Column:
    """M1."""
    return x / F.nullif(base, F.lit(0.0)) - 1


def ge_pct(price: Column, base: Column, percent) -> Column:
    """M2. price >= base * (1 + percent/100), exactly, on decimals."""
    exact = lambda c: c.cast("string").try_cast(PRICE)  # the shortest text of a double, not its binary value
    whole = lambda n: F.lit(n).cast("decimal(4,0)")
    return exact(price) * whole(1000) >= exact(base) * whole(int(round(1000 + percent * 10)))


def bar_reasons(as_of: Column):
    """Reasons one bar can give, in order; needs the provider columns joined in."""
    return [("PROVIDER_USE_UNVERIFIED", ~F.coalesce(F.col("research_permitted"), F.lit(False)) | F.col("terms_url").isNull() | (F.col("terms_url") == "")),
            ("UNDECLARED_FEED", ~F.coalesce(F.array_contains("feeds", F.col("feed")), F.lit(False))),
            ("REGULAR_SESSION_COVERAGE_UNVERIFIED", ~F.col("session_scope").eqNullSafe(F.lit("regular"))),
            ("INCOMPLETE_OR_HALTED_SESSION", ~F.col("complete") | F.col("halted") | (F.col("volume") == 0)),
            ("CORPORATE_ACTION_AUDIT_MISSING", ~F.col("corporate_actions_verified")),
            ("LABEL_NOT_MATURE", F.col("available_at") > as_of)]


def action_ordinals(actions: DataFrame, calendar) -> DataFrame:
    """Each action on the ordinal of the first session on or after its effective date: the half-open window test becomes an integer test."""
    dim = F.broadcast(calendar.days.select(F.col("day").alias("effective_date"), F.coalesce("idx", "next_idx").alias("idx")))
    return actions.join(dim, "effective_date").filter("idx is not null").groupBy("security_id", "idx").agg(F.count(F.lit(1)).alias("n_actions"))


def bar_grid(bars: DataFrame, calendar, providers: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """Every (security, session) with its bar, the bar's first fault and the number of actions falling on it."""
    grid = bars.select("security_id").distinct().select("security_id", F.posexplode(calendar.dates).alias("idx", "session"))
    judged = (bars.join(providers, "provider_id", "left")
              .withColumn("bar_reason", first_reason(bar_reasons(as_of)))
              .withColumn("feed_key", F.concat_ws("|", "provider_id", "feed", "price_basis"))
              .select("security_id", "session", "price_id", "open", "high", "low", "close", "volume", "available_at", "first_seen_at", "bar_reason", "feed_key"))
    return (grid.join(judged, ["security_id", "session"], "left")
            .join(action_ordinals(actions, calendar), ["security_id", "idx"], "left").fillna({"n_actions": 0}))


def window_quality(grid: DataFrame, calendar, lengths=(1,) + HORIZONS, mode=HISTORICAL, with_ids=False) -> DataFrame:
    """L2. For every (security, reaction ordinal) and length n: first fault of the window anchor..n, its last close and its availability.

    A security has at most one row per session, so the window partition is bounded by the calendar whatever the event skew.
    """
    w = W.partitionBy("security_id").orderBy("idx")
    known = available_at("available_at", "first_seen_at", mode)
    cols = []
    for n in lengths:
        frame, days_after = w.rowsBetween(-1, n - 1), w.rowsBetween(0, n - 1)
        feeds = (F.min("feed_key").over(frame) != F.max("feed_key").over(frame))
        reason = first_reason([
            (cal.OUT_OF_RANGE, (F.col("idx") + n - 1 > calendar.last_idx) | (F.col("idx") < 1)),
            ("MISSING_SESSION", F.count("price_id").over(frame) < n + 1),
            ("MIXED_PRICE_FEEDS", feeds)])
        cols += [F.coalesce(reason, F.first("bar_reason", ignorenulls=True).over(frame),
                            F.when(F.sum("n_actions").over(days_after) > 0, "CORPORATE_ACTION_IN_WINDOW")).alias(f"reason_{n}"),
                 F.last("close").over(frame).alias(f"close_{n}"), F.max(known).over(frame).alias(f"available_{n}")]
        if with_ids:
            cols.append(F.array_join(F.collect_list("price_id").over(frame), ",").alias(f"ids_{n}"))
    anchor = [F.lag(c).over(w).alias("anchor_" + c) for c in ("price_id", "close", "available_at", "first_seen_at", "session")]
    return grid.select("security_id", "idx", "session", "open", "high", "low", "close", *anchor, *cols)


def with_identity(events: DataFrame, securities: DataFrame) -> DataFrame:
    """J6. The identity row of each event's security."""
    s = securities.select("security_id", F.col("company_id"), F.col("exchange").alias("sec_exchange"), F.col("security_type").alias("sec_type"),
                          F.col("available_at").alias("sec_available_at"), F.col("valid_from").alias("sec_valid_from"), F.col("valid_to").alias("sec_valid_to"))
    return events.join(s, "security_id", "left")


def build_outcomes(news, securities, bars, actions, providers, calendar, as_of, mode=HISTORICAL, with_ids=False) -> DataFrame:
    """L1. One row per event: state, first quarantine reason, timing, anchor and the label inputs (wide)."""
    timed = cal.classify(cal.classify(publication_bounds(news), "pub_first", calendar), "pub_last", calendar, "last_")
    known = with_identity(timed, securities).withColumn("known_at", available_at("pub_available", "first_seen_at", mode))
    opens = F.broadcast(calendar.sessions.select(F.col("idx").alias("reaction_idx"), F.col("open_utc").alias("reaction_open")))
    quality = (window_quality(bar_grid(bars, calendar, providers, actions, as_of), calendar, mode=mode, with_ids=with_ids)
               .withColumnRenamed("idx", "reaction_idx").withColumnRenamed("session", "reaction_session"))
    cheap = first_reason([("AMBIGUOUS_PUBLICATION_TIME", F.col("pub_first").isNull()),
                          ("FIRST_PUBLIC_TIME_UNVERIFIED", ~F.col("first_public_verified")),
                          ("NEWS_NOT_AVAILABLE_AT_CUTOFF", F.col("known_at") > F.col("cutoff"))])
    timing = first_reason([
        (cal.OUT_OF_RANGE, F.col("reaction_idx").isNull() | F.col("last_reaction_idx").isNull()),
        ("PUBLICATION_INTERVAL_CROSSES_SESSION_BOUNDARY", (F.col("timing") != F.col("last_timing")) | (F.col("reaction_idx") != F.col("last_reaction_idx"))),
        ("INTRADAY_OR_BELL_REQUIRES_FINER_DATA", F.col("timing").isin("regular", "bell_ambiguous")),
        (cal.OUT_OF_RANGE, F.col("reaction_idx") < 1),
        ("CUTOFF_NOT_BEFORE_REACTION_OPEN", F.col("cutoff") >= F.col("reaction_open"))])
    early = known.join(opens, "reaction_idx", "left").withColumn("early_reason", F.coalesce(cheap, identity_reason(), timing))
    # only events that passed the cheap rules carry a join key into the bar join; the rest skip the shuffle's hot keys
    keyed = early.withColumn("_k", F.when(F.col("early_reason").isNull(), F.col("reaction_idx")))
    joined = keyed.join(quality.withColumnRenamed("reaction_idx", "_k"), ["security_id", "_k"], "left").drop("_k")
    late = first_reason([("MISSING_PREVIOUS_SESSION", F.col("anchor_price_id").isNull()),
                         ("ANCHOR_UNAVAILABLE_AT_CUTOFF", F.col("anchor_available_at") > F.col("cutoff")),
                         ("ANCHOR_NOT_OBSERVED_AT_CUTOFF", (F.col("anchor_first_seen_at") > F.col("cutoff")) if mode == FORWARD else F.lit(False))])
    reason = F.coalesce("early_reason", late, "reason_1")
    return (joined.withColumn("reason", reason).withColumn("state", F.when(F.col("reason").isNull(), "MAPPED").otherwise("QUARANTINED")))


def label_structs(with_ids=False):
    """The sixteen labels of a mapped event as an array of (label, kind, num, flag, reason, available_at)."""
    p, o, h, l, c = (F.col(x) for x in ("anchor_close", "open", "high", "low", "close"))
    none_d, none_b = F.lit(None).cast("double"), F.lit(None).cast("boolean")

    def struct(name, kind, num, flag, reason, n):
        ids = [F.col(f"ids_{n}").alias("price_ids")] if with_ids else []
        return F.struct(F.lit(name).alias("label"), F.lit(kind).alias("kind"), num.alias("num"), flag.alias("flag"), reason.alias("reason"),
                        F.when(reason.isNull(), F.col(f"available_{n}")).alias("label_available_at"), F.lit(n).alias("n_sessions"), *ids)

    ok = F.lit(None).cast("string")
    out = [struct(f"day1_{f}_return", "return", simple_return(F.col(f), p), none_b, ok, 1) for f in ("open", "high", "low", "close")]
    for n in HORIZONS:
        r = F.col(f"reason_{n}")
        out.append(struct(f"session_{n}_close_return", "return", F.when(r.isNull(), simple_return(F.col(f"close_{n}"), p)), none_b, r, n))
    out += [struct(f"gap_ge_{t}pct", "boolean", none_d, ge_pct(o, p, t), ok, 1) for t in THRESHOLDS]
    gap = ge_pct(o, p, 0.5)
    no_gap = F.when(~gap, F.lit(NO_GAP))
    out.append(struct("positive_gap_retained_half", "boolean", none_d, F.when(gap, c >= (o + p) / 2), no_gap, 1))
    out.append(struct("positive_gap_filled", "boolean", none_d, F.when(gap, l <= p), no_gap, 1))
    return F.array(*out)


def label_rows(outcomes: DataFrame, keep=("event_id",), with_ids=False) -> DataFrame:
    """The long label table of the mapped events."""
    fields = ["label", "kind", "num", "flag", "reason", "label_available_at", "n_sessions"] + (["price_ids"] if with_ids else [])
    return (outcomes.filter("state = 'MAPPED'").select(*keep, F.explode(label_structs(with_ids)).alias("_l"))
            .select(*keep, *[f"_l.{f}" for f in fields]))


def build_report(outcomes: DataFrame) -> DataFrame:
    """A1. Events, mapped, complete at 20 sessions, issuers among those, and one row per quarantine reason."""
    full = (F.col("state") == "MAPPED") & F.col("reason_20").isNull()
    totals = outcomes.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("state") == "MAPPED").alias("mapped_day1"),
                          F.count_if(full).alias("complete_20_session"), F.count_distinct(F.when(full, F.col("company_id"))).alias("unique_issuers"),
                          F.count_if(F.col("state") != "MAPPED").alias("quarantined"))
    reasons = outcomes.filter("reason is not null").groupBy(F.concat(F.lit("reason:"), "reason").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return totals.unpivot([], totals.columns, "item", "n").unionByName(reasons)
