"""Audit gates: cohort acceptance, spot checks, review queues, export audits, commitments, chains and readiness."""
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import feature_cutoff
from tidemark.operators.sessions import classify
from tidemark.operators.validate import validate
from tidemark.plans.metrics import gates


def verify_chain(log: DataFrame, seq="seq", line="line", previous="previous_sha256") -> DataFrame:
    """W17. Records whose stored hash is not the hash of the record before them. Neighbours meet by equality on the number, so the log is never one task."""
    prior = log.select((F.col(seq) + 1).alias(seq), F.sha2(line, 256).alias("_want"))
    j = log.join(prior, seq, "left")
    return j.withColumn("state", F.when(F.col("_want").isNull(), F.when(F.col(previous).isNull(), "FIRST").otherwise("PREDECESSOR_MISSING"))
                        .when(F.col("_want").eqNullSafe(F.col(previous)), "LINKED").otherwise("BROKEN")).drop("_want")


def spot_checks(reviews: DataFrame, events: DataFrame, need=2) -> DataFrame:
    """Q3. Per timing class: distinct events with evidence and at least one named reviewer; two are needed. A class without reviews counts zero."""
    named = F.filter("reviewers", lambda r: F.trim(r) != "")
    good = (F.size("reviewers") > 0) & (F.size(named) == F.size("reviewers")) & F.col("evidence").isNotNull() & (F.col("evidence") != "")
    checked = reviews.filter(good).select("event_id").distinct().withColumn("_c", F.lit(1))
    return (events.select("event_id", "timing").join(checked, "event_id", "left").groupBy("timing").agg(F.count(F.lit(1)).alias("events"), F.count("_c").alias("checked"))
            .withColumn("passed", F.col("checked") >= need))


def review_queue(ledger: DataFrame, notes: DataFrame) -> DataFrame:
    """Q4. Status and flags of every candidate: its note's flags, amendments, and issuers with several filings (counted by a grouping and joined back)."""
    several = ledger.groupBy("cik").agg(F.count(F.lit(1)).alias("_n"))
    j = ledger.join(notes.select("candidate_id", "review_flags"), "candidate_id", "left").join(several, "cik")
    flags = F.concat(F.coalesce("review_flags", F.array().cast("array<string>")), F.array_compact(F.array(
        F.when(F.col("form") == "8-K/A", "AMENDMENT_REVIEW_REQUIRED"), F.when(F.col("_n") > 1, "MULTIPLE_FILINGS_FOR_ISSUER_REVIEW_REQUIRED"))))
    return j.select("candidate_id", "cik", F.when(F.col("review_flags").isNotNull(), "PRIMARY_SCREENED_REVIEW_REQUIRED").otherwise("PRIMARY_REVIEW_PENDING").alias("status"), F.array_sort(F.array_distinct(flags)).alias("flags"))


def flag_counts(queue: DataFrame) -> DataFrame:
    return queue.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def audit_export(coverage: DataFrame, faults: DataFrame, stated: DataFrame, key="security_id") -> DataFrame:
    """Q5. Per symbol of an export: stated and received counts, coverage, invalid bars and the blockers that follow."""
    f = faults.groupBy(key).agg(F.count(F.lit(1)).alias("invalid_bars"))
    j = stated.join(coverage, key, "left").join(f, key, "left").fillna({"invalid_bars": 0, "received": 0, "missing": 0, "unexpected": 0, "zero_volume": 0})
    rules = [("COUNT_MISMATCH", F.col("received") == F.col("stated")), ("MISSING_SESSIONS", F.col("missing") == 0), ("UNEXPECTED_SESSIONS", F.col("unexpected") == 0),
             ("ZERO_VOLUME", F.col("zero_volume") == 0), ("INVALID_BARS", F.col("invalid_bars") == 0)]
    return gates(j, rules).withColumnsRenamed({"failed_gates": "blockers"})


def check_commitments(labels: DataFrame, pins: DataFrame, key="event_id") -> DataFrame:
    """Q6. Recomputed digest of an event's sixteen labels against the pinned one."""
    body = F.concat_ws("=", "label", F.coalesce(F.round("num", 10).cast("string"), F.col("flag").cast("string"), F.concat(F.lit("!"), "reason")))
    d = labels.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(body)), "\n"), 256).alias("digest"))  # sixteen labels an event
    return d.join(pins.select(key, "pinned"), key, "full_outer").withColumn("state", F.when(F.col("pinned").isNull(), "NOT_PINNED").when(F.col("digest").isNull(), "EVENT_MISSING")
                                                                       .when(F.col("digest") == F.col("pinned"), "MATCHES").otherwise("DIFFERS"))


def candidate_states(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Q2. (bad_candidates, unrepresented, twice): candidates that are not accounted for, events no included candidate stands for, and events for which several do. One row.

    A candidate is accounted for if it is included with an event of the cohort, or excluded or quarantined with a reason and without an event.
    """
    known = events.select("event_id", F.lit(True).alias("_e")).distinct()
    c = candidates.join(known, "event_id", "left")
    included = F.coalesce((F.col("disposition") == "included") & F.col("_e"), F.lit(False))
    left_out = F.coalesce(F.col("disposition").isin("excluded", "quarantined") & (F.trim(F.coalesce("reason", F.lit(""))) != "") & F.col("event_id").isNull(), F.lit(False))
    per = c.filter(included).groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"))
    represented = known.join(per, "event_id", "left").agg(F.count_if(F.col("_n").isNull()).alias("unrepresented"), F.count_if(F.col("_n") > 1).alias("twice"))
    return c.agg(F.count_if(~included & ~left_out).alias("bad_candidates"), F.count(F.lit(1)).alias("candidates")).withColumns({n: represented.select(n).scalar() for n in ("unrepresented", "twice")})


def cohort_facts(outcomes: DataFrame, candidates: DataFrame, sources: DataFrame, checks: DataFrame, membership_digest: str, window, zone: str, category="earnings", horizon="reason_10") -> DataFrame:
    """Q2. One row of counts recomputed from the tables, for `audit_cohort`: events and what holds of them, candidates, sources against their digests, unchecked timing classes, and whether the
    candidates' membership (id and source digest, in order) has the frozen digest. `window` is (first day, last day), local in `zone`.
    """
    from tidemark.functions.text import local_day
    complete = (F.col("state") == "MAPPED") & F.col(horizon).isNull()
    inside = (F.col("precision") != "day") & local_day("published_at", zone).between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date"))
    valid = F.coalesce(F.rlike("cik", F.lit(r"^\d{1,10}$")) & (F.col("cik").cast("bigint") > 0), F.lit(False))
    facts = outcomes.agg(F.count(F.lit(1)).alias("events"), F.count_if(inside).alias("in_window"), F.count_if(F.col("category") == category).alias("of_category"), F.count_if(complete & valid & inside).alias("complete"),
                         F.count_distinct(F.when(complete & valid & inside, F.lpad("cik", 10, "0"))).alias("issuers"), F.count_if(valid).alias("valid_identity"))
    bad = sources.agg(F.count_if(~F.coalesce(F.col("sha256") == F.sha2("text", 256), F.lit(False)))).scalar()
    held = sources.select(F.sha2("text", 256).alias("source_sha256"), F.lit(True).alias("_s")).distinct()
    loose = candidates.join(held, "source_sha256", "left").agg(F.count_if(F.col("_s").isNull())).scalar()
    frozen = members_digest(candidates)
    states = candidate_states(candidates, outcomes)
    return facts.withColumns({"bad_sources": bad, "unsourced_candidates": loose, "classes_unchecked": checks.agg(F.count_if(~F.col("passed"))).scalar(), "membership_matches": frozen.scalar() == F.lit(membership_digest),
                              **{n: states.select(n).scalar() for n in ("bad_candidates", "candidates", "unrepresented", "twice")}})


def members_digest(candidates: DataFrame) -> DataFrame:
    """Digest of a membership whatever its order and size: the sum of the rows' digests (first 60 bits of each) and their number, in one row."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("candidate_id").cast("string"), "source_sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return candidates.agg(F.sha2(F.concat_ws("|", F.coalesce(F.sum(row), F.lit(0)).cast("string"), F.count(F.lit(1)).cast("string")), 256))


def audit_cohort(facts: DataFrame, floors: dict) -> DataFrame:
    """Q2. Named acceptance gates over one row of recomputed counts (`cohort_facts`); a count that was not taken fails its gate only if the fact is there."""
    has = set(facts.columns)
    rules = [("events_present", F.col("events") > 0), ("candidate_accounting", F.col("bad_candidates") == 0), ("all_events_in_window", F.col("in_window") == F.col("events")),
             ("category_only", F.col("of_category") == F.col("events")), ("issuer_identity", F.col("valid_identity") == F.col("events")),
             ("source_hashes", F.col("bad_sources") == 0), ("minimum_events", F.col("complete") >= floors["events"]), ("minimum_issuers", F.col("issuers") >= floors["issuers"]),
             ("spot_checks", F.col("classes_unchecked") == 0)]
    if {"unrepresented", "twice", "candidates"} <= has:
        rules.append(("candidates_stand_for_events", (F.col("candidates") > 0) & (F.col("unrepresented") == 0) & (F.col("twice") == 0)))
    rules += [(name, cond) for name, column, cond in (("candidate_sources", "unsourced_candidates", F.col("unsourced_candidates") == 0), ("frozen_membership", "membership_matches", F.col("membership_matches"))) if column in has]
    return gates(facts, rules)


def readiness(support: DataFrame, floors: dict) -> DataFrame:
    """Q7. Per version and fold: whether training and test support could meet the floors, and the decision."""
    ok = ((F.col("fit_rows") >= floors["fit_rows"]) & (F.col("fit_issuers") >= floors["fit_issuers"]) & (F.col("test_rows") >= floors["test_rows"]))
    return support.withColumn("possible", F.coalesce(ok, F.lit(False))).withColumn("decision", F.when(F.col("possible"), "READY").otherwise("STOP_INSUFFICIENT_SOURCE_SUPPORT"))


def guidance_rules():
    """L18. Clock, range and arithmetic rules of a guidance revision; needs prior_at, source_at, available_at, cutoff, lo, hi, prior_lo, prior_hi, revision, block, fold_block, listed.

    A rule that cannot be evaluated for a null is broken.
    """
    good = lambda *cs: [F.col(c).isNotNull() & ~F.isnan(c) for c in cs]
    lo, hi, plo, phi = (F.col(c) for c in ("lo", "hi", "prior_lo", "prior_hi"))
    finite = good("lo", "hi", "prior_lo", "prior_hi")
    midpoint = (lo + hi) / F.nullif(plo + phi, F.lit(0.0)) - 1
    rules = [("CLOCK_ORDER", ~((F.col("prior_at") < F.col("source_at")) & (F.col("source_at") < F.col("available_at")) & (F.col("available_at") < F.col("cutoff")))),
            ("INVALID_RANGE", ~(finite[0] & finite[1] & finite[2] & finite[3] & (plo >= 0) & (plo <= phi) & (plo + phi > 0) & (lo >= 0) & (lo <= hi))),
            ("MIDPOINT_ARITHMETIC", F.abs(midpoint - F.col("revision")) > F.greatest(1e-12 * F.abs("revision"), 1e-12 * F.abs(midpoint), F.lit(1e-14))),
            ("BLOCK_DISAGREES", ~F.col("block").eqNullSafe(F.col("fold_block"))), ("LISTING_UNVERIFIED", ~F.contains(F.lower("listed"), F.lit("nasdaq")))]
    return [(name, F.coalesce(cond, F.lit(True))) for name, cond in rules]


def guidance_clocks(events: DataFrame, calendar, lead=15):
    """L18. (rows with the recomputed session, timing, open and cutoff of source_at, rules that the stated ones must meet); `lead` is minutes of the cutoff before the open."""
    react = calendar.sessions.select(F.col("idx").alias("_own_reaction_idx"), F.col("session").alias("_session"), F.col("open_utc").alias("_open_at"))
    d = classify(events, "source_at", calendar, "_own_").join(F.broadcast(react), "_own_reaction_idx", "left").withColumn("_cutoff_at", feature_cutoff("_open_at", lead))
    stated = {"SESSION_DISAGREES": ("reaction_session", "_session"), "TIMING_DISAGREES": ("timing", "_own_timing"), "SCHEDULED_OPEN_DISAGREES": ("scheduled_open_at", "_open_at"), "CUTOFF_DISAGREES": ("cutoff", "_cutoff_at")}
    return d, [(name, ~F.coalesce(F.col(a) == F.col(b), F.lit(False))) for name, (a, b) in stated.items()]


def verify_guidance(events: DataFrame, calendar, lead=15):
    """L18. (accepted, rejected with `violations`): guidance revisions whose stated clocks are those of the calendar and that meet every rule of `guidance_rules`."""
    d, clocks = guidance_clocks(events, calendar, lead)
    return tuple(part.drop("_own_reaction_idx", "_own_timing", "_session", "_open_at", "_cutoff_at") for part in validate(d, clocks + guidance_rules()))


def with_openings(events: DataFrame, openings: DataFrame, keys=("symbol", "reaction_session")) -> DataFrame:
    """L18. Events with `opened`: whether the one opening of their key is a verified one (false if it has none or several)."""
    o = openings.groupBy(*keys).agg((F.count(F.lit(1)) == 1).alias("_one"), F.bool_and(F.col("status") == "verified_open").alias("_ok"))
    return events.join(o, list(keys), "left").withColumn("opened", F.coalesce(F.col("_one") & F.col("_ok"), F.lit(False))).drop("_one", "_ok")


def guidance_support(events: DataFrame, openings: DataFrame, block_rows: int, keys=("symbol", "reaction_session")) -> DataFrame:
    """L18. One row: what the verified openings leave of the verified events, for `guidance_gate`.

    `screened` events; `disagree`, the keys that do not stand once on either side; of the events with a verified opening the rows, issuers, sessions, signs (raises, cuts,
    unchanged), issuers with a cut, blocks, and blocks of at least `block_rows`. `openings` has one row per key with its status.
    """
    sides = events.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_o")).unionByName(openings.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_o")))
    disagree = sides.groupBy(*keys).agg(F.sum("_e").alias("_e"), F.sum("_o").alias("_o")).agg(F.count_if((F.col("_e") != 1) | (F.col("_o") != 1)))
    joined = with_openings(events, openings, keys)
    per = guidance_blocks(joined.filter("opened"))
    up, ok = F.col("revision"), F.col("opened")
    facts = joined.agg(F.count(F.lit(1)).alias("screened"), F.count_if(ok).alias("rows"), F.count_distinct(F.when(ok, F.col("cik"))).alias("issuers"), F.count_distinct(F.when(ok, F.col(keys[1]))).alias("sessions"),
                       F.count_if(ok & (up > 0)).alias("raises"), F.count_if(ok & (up < 0)).alias("cuts"), F.count_if(ok & (up == 0)).alias("unchanged"), F.count_distinct(F.when(ok & (up < 0), F.col("cik"))).alias("cut_issuers"))
    return facts.withColumns({"disagree": disagree.scalar(), "blocks": per.agg(F.count(F.lit(1))).scalar(), "full_blocks": per.agg(F.count_if(F.col("rows") >= block_rows)).scalar()})


def guidance_blocks(verified: DataFrame) -> DataFrame:
    """L18. Rows and signs per held block."""
    return verified.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("revision") > 0).alias("raises"), F.count_if(F.col("revision") < 0).alias("cuts"))


def guidance_gate(support: DataFrame, floors: dict) -> DataFrame:
    """L18. Coverage gate over `guidance_support`; floors are rows, issuers, sessions and blocks."""
    return gates(support, [("openings_match_membership", F.col("disagree") == 0), *[("minimum_" + name, F.col(column) >= floors[name]) for name, column in (("rows", "rows"), ("issuers", "issuers"), ("sessions", "sessions"), ("blocks", "full_blocks"))],
                           ("raises_present", F.col("raises") > 0), ("cuts_present", F.col("cuts") > 0)])
