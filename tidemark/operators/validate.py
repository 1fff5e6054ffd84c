"""Validation as data: every rule is a column expression that yields violation rows with a reason (structural faults and quarantines alike)."""
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.sessions import local_wall


def validate(df: DataFrame, rules):
    """V1. Split `df` into (ok, rejects); `rules` are (name, failing predicate). Rejects carry the array of failed names."""
    flagged = df.withColumn("violations", F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])))
    return flagged.filter(F.size("violations") == 0).drop("violations"), flagged.filter(F.size("violations") > 0)


def violation_counts(df: DataFrame, rules) -> DataFrame:
    """One row per rule with how many rows break it: one pass, one partial aggregate."""
    totals = df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules])
    return totals.unpivot([], [name for name, _ in rules], "rule", "n")


def require(df: DataFrame, rules) -> DataFrame:
    """The fail-fast form: an offending row raises with the name of its first broken rule."""
    broken = first_reason(rules)
    return df.filter(F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("rule broken: "), broken)).cast("boolean")).otherwise(F.lit(True)))


def first_reason(rules) -> Column:
    """V9. The name of the first failing rule, in the order given; null when none fails. Unknown (null) predicates do not fail."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules], F.lit(None).cast("string"))


def check_unique(df: DataFrame, keys) -> DataFrame:
    """V2. Keys that are empty, null or used more than once, by a partial-aggregated count rather than a window over each key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    empty = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.col(k).cast("string") == "") for k in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | empty)


def check_fk(child: DataFrame, parent: DataFrame, key: str, parent_key: str = None) -> DataFrame:
    """V3. Child rows without a parent."""
    return child.join(parent.select(F.col(parent_key or key).alias(key)), key, "left_anti")


def positive(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < F.lit(float("inf")))


def ohlcv_rules():
    """V4. Prices positive and finite, volume not negative, low <= open, close <= high."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return [("NONPOSITIVE_OR_NONFINITE_PRICE", ~(positive("open") & positive("high") & positive("low") & positive("close"))),
            ("NEGATIVE_VOLUME", F.col("volume").isNull() | F.isnan("volume") | (F.col("volume") < 0)),
            ("INVALID_OHLC_ORDER", ~((l <= F.least(o, c)) & (F.greatest(o, c) <= h)))]


def check_bar_clock(bars: DataFrame, calendar) -> DataFrame:
    """V5. Bars on no session, or available before their session closed."""
    dim = F.broadcast(calendar.sessions.select("session", F.col("close_utc").alias("_close")))
    return (bars.join(dim, "session", "left")
            .withColumn("violation", F.when(F.col("_close").isNull(), "NOT_A_SESSION").when(F.col("available_at") < F.col("_close"), "AVAILABLE_BEFORE_CLOSE"))
            .filter(F.col("violation").isNotNull()).drop("_close"))


def source_rules(as_of: Column):
    """V6. Observation chronology, https provenance and content checksum."""
    return [("URL_NOT_HTTPS", ~F.col("url").startswith("https://")),
            ("CHRONOLOGY_INVALID", F.col("first_seen_at") > F.col("retrieved_at")),
            ("RETRIEVED_AFTER_AS_OF", F.col("retrieved_at") > as_of),
            ("CHECKSUM_MISMATCH", F.col("sha256").isNotNull() & (F.col("sha256") != F.sha2("text", 256)))]


def check_evidence(events: DataFrame, sources: DataFrame) -> DataFrame:
    """V7. A verified event must quote a timestamp that occurs in its own source text."""
    joined = events.join(sources.select("source_id", "text", "timestamp_evidence"), "source_id", "left")
    return joined.withColumn("evidence_found", F.coalesce(F.contains("text", "timestamp_evidence"), F.lit(False)))


def event_rules(zone: str):
    """V8. Record rules of an accepted event; needs published_at, precision, timestamp_evidence, first_seen_at, timing, expected_timing,
    reaction_session, expected_session, caveat_labels, known_labels."""
    return [("PRECISION_NOT_MINUTE", F.col("precision") != "minute"),
            ("NOT_MINUTE_ALIGNED", F.date_trunc("minute", "published_at") != F.col("published_at")),
            ("EVIDENCE_NOT_LOCAL_MINUTE", F.date_format(local_wall(F.col("published_at"), zone), "HH:mm") != F.right("timestamp_evidence", F.lit(5))),
            ("SEEN_BEFORE_PUBLISHED", F.col("first_seen_at") < F.col("published_at")),
            ("TIMING_DISAGREES", ~F.col("timing").eqNullSafe(F.col("expected_timing"))),
            ("SESSION_DISAGREES", ~F.col("reaction_session").eqNullSafe(F.col("expected_session"))),
            ("UNKNOWN_CAVEAT_LABEL", F.size(F.array_except("caveat_labels", F.col("known_labels"))) > 0)]


def publication_bounds(df: DataFrame) -> DataFrame:
    """V10. First and last possible instant and conservative availability; a minute stamp is an interval, a second stamp a point."""
    minute = F.col("precision") == "minute"
    known = minute | (F.col("precision") == "second")
    step = lambda text: F.col("published_at") + F.expr(text)
    return (df.withColumn("pub_first", F.when(known, F.col("published_at")))
            .withColumn("pub_last", F.when(minute, step("interval 59.999999 seconds")).when(known, F.col("published_at")))
            .withColumn("pub_available", F.when(minute, step("interval 1 minute")).when(known, F.col("published_at"))))


STRICT_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"


def parse_utc(col) -> Column:
    """V11. A text time with an offset to a UTC timestamp; naive or malformed text gives null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.rlike(c, F.lit(STRICT_TIME)), F.try_to_timestamp(c))


HISTORICAL, FORWARD = "historical_reconstruction", "forward_observed"


def available_at(public, seen, mode: str) -> Column:
    """V12. The public time, or in forward mode the later of public and first seen."""
    if mode not in (HISTORICAL, FORWARD):
        raise ValueError("unknown availability mode")
    return F.col(public) if mode == HISTORICAL else F.greatest(public, seen)


ELIGIBLE_EXCHANGES = ("NASDAQ", "NYSE", "NYSE American")


def identity_reason() -> Column:
    """V13. Whether the identity was known and valid through the release; needs pub_first, pub_last and sec_* columns."""
    return first_reason([
        ("INELIGIBLE_SECURITY", ~F.col("sec_exchange").isin(*ELIGIBLE_EXCHANGES) | (F.col("sec_type") != "common_stock")),
        ("IDENTITY_NOT_KNOWN_AT_RELEASE", (F.col("sec_available_at") > F.col("pub_first")) | (F.col("sec_valid_from") > F.col("pub_first"))),
        ("IDENTITY_EXPIRED", F.col("pub_last") >= F.col("sec_valid_to"))])


def redact(df: DataFrame, allow: dict, keep=()) -> DataFrame:
    """V23. Keep declared columns only; a value outside a column's closed vocabulary becomes OTHER."""
    closed = [F.when(F.col(c).isNull() | F.col(c).isin(*vocabulary), F.col(c)).otherwise("OTHER").alias(c) for c, vocabulary in allow.items()]
    return df.select(*keep, *closed)
