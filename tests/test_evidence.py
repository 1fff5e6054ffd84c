"""Opening prints by listing, events without an opening, guidance support, portfolio positions and trial records, on small fixtures."""
import collections
import datetime as dt
import json
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracles import rows_of
from tidemark.catalog import inputs as I
from tidemark.plans import audit as Q, enrich as E
from tidemark.sources import documents as D

OPEN = dt.datetime(2024, 1, 3, 14, 30)
TRADES = "symbol string, session date, t timestamp, price double, trade_id long, print_venue string, print_tape string, conditions array<string>, correction string"


def at(seconds):
    return OPEN + dt.timedelta(seconds=seconds)


def prints(spark, rows):
    """Rows (symbol, seconds after the open, price, id, venue, tape, conditions, correction)."""
    return spark.createDataFrame([(s, OPEN.date(), at(x), p, i, v, z, c, u) for s, x, p, i, v, z, c, u in rows], TRADES)


def test_official_open_needs_venue_and_tape_of_the_listing(spark):
    inf, q = float("inf"), ["@", "Q"]
    rows = [("A", 1, 10.0, 1, "Q", "C", q, None), ("A", 1, 10.0, 1, "Q", "C", q, None), ("A", 2, 11.0, 2, "N", "C", q, None), ("A", 2, 11.0, 3, "Q", "A", q, None), ("A", 2, 11.0, 4, "Q", "C", ["@"], None), ("A", 60, 12.0, 5, "Q", "C", q, None), ("A", -1, 12.0, 6, "Q", "C", q, None),
            ("B", 0, 20.0, 1, "N", "A", q, None), ("B", 3, 21.0, 2, "N", "A", q, None), ("C", 0, 30.0, 1, "N", "A", q, "u"), ("C", 1, 30.0, 2, "N", "A", q, None), ("D", 0, 5.0, None, "N", "A", q, None), ("E", 0, inf, 1, "N", "A", q, None),
            ("F", 0, None, 1, "N", "A", q, None), ("G", 0, 7.0, 1, "Q", "C", q, None), ("H", 5, 8.0, 1, "N", "A", q, None), ("I", 5, 8.0, 1, None, None, None, None)]
    listings = spark.createDataFrame([("A", "NASDAQ"), *[(x, "NYSE") for x in "BCDEFHI"], ("G", "OTC"), (None, "NYSE")], "symbol string, exchange string")
    opens = spark.createDataFrame([(OPEN.date(), OPEN)], "session date, open_utc timestamp")
    got = {r["symbol"]: (r["official_open"], r["reason"]) for r in E.official_open(prints(spark, rows), opens, listings, ["symbol", "session"]).collect()}
    bad = (None, "ambiguous_official_open")
    assert got == {"A": (10.0, None), "B": bad, "C": bad, "D": bad, "E": bad, "F": bad, "H": (8.0, None)}


def test_events_have_an_opening_or_the_first_reason(spark):
    c = I.calendar(spark)
    day = {r["session"]: r["idx"] for r in c.sessions.collect()}
    idx = day[OPEN.date()]
    early, late = dt.datetime(2023, 1, 1), dt.datetime(2024, 1, 3)
    cases = [("ok", "OK", "1", "premarket", idx, at(-60), early, "verified_open"), ("otc", "OTC", "1", "premarket", idx, at(-60), early, "unsupported_listing"), ("name", "lower", "1", "premarket", idx, at(-60), early, "unsupported_listing"),
             ("who", "GONE", "1", "premarket", idx, at(-60), early, "unsupported_listing"), ("timing", "OK", "1", "regular", idx, at(-60), early, "unsupported_clock"), ("cutoff", "OK", "1", "premarket", idx, OPEN, early, "unsupported_clock"),
             ("none", "OK", "1", None, None, at(-60), early, "unsupported_clock"), ("listed", "OK", "1", "premarket", idx, at(-60), late, "anchor_identity_unverified"), ("first", "OK", "1", "premarket", 0, at(-60 - 86400), early, "anchor_identity_unverified"),
             ("bar", "OK", "2", "premarket", idx, at(-60), early, "missing_anchor"), ("zero", "OK", "3", "premarket", idx, at(-60), early, "missing_anchor"), ("quiet", "QUIET", "1", "premarket", idx, at(-60), early, "no_official_open"),
             ("two", "TWO", "1", "premarket", idx, at(-60), early, "ambiguous_official_open")]
    events = spark.createDataFrame([x[:7] for x in cases], "event_id string, symbol string, security_id string, timing string, reaction_idx int, cutoff timestamp, listed_from timestamp")
    listings = spark.createDataFrame([("OK", "NYSE"), ("QUIET", "NASDAQ"), ("TWO", "NASDAQ"), ("OTC", "OTC"), ("lower", "NYSE")], "symbol string, exchange string")
    bars = spark.createDataFrame([("1", idx - 1, 10.0), ("3", idx - 1, 0.0)], "security_id string, idx int, close double")
    opens = spark.createDataFrame([("OK", OPEN.date(), 11.0, None), ("TWO", OPEN.date(), None, "ambiguous_official_open")], "symbol string, session date, official_open double, reason string")
    got = {r["event_id"]: (r["disposition"], r["opening_gap"]) for r in E.event_openings(events, opens, listings, bars, c).collect()}
    assert {k: v for k, (v, _) in got.items()} == {x[0]: x[7] for x in cases}
    assert abs(got["ok"][1] - 0.1) < 1e-12 and all(g is None for k, (_, g) in got.items() if k != "ok")


GUIDANCE = ("id int, symbol string, cik string, reaction_session date, timing string, scheduled_open_at timestamp, cutoff timestamp, prior_at timestamp, source_at timestamp, available_at timestamp, "
            "prior_lo double, prior_hi double, lo double, hi double, revision double, block int, fold_block int, listed string")


def test_guidance_is_verified_against_the_calendar(spark):
    cut, src = at(-900), at(-7200)
    good = dict(symbol="A", cik="1", reaction_session=OPEN.date(), timing="premarket", scheduled_open_at=OPEN, cutoff=cut, prior_at=src - dt.timedelta(days=90), source_at=src, available_at=src + dt.timedelta(minutes=1),
                prior_lo=10.0, prior_hi=20.0, lo=12.0, hi=21.0, revision=33.0 / 30.0 - 1, block=1, fold_block=1, listed="NASDAQ Global Select")
    minute = dt.timedelta(minutes=1)
    faults = [({}, None), (dict(reaction_session=dt.date(2024, 1, 4)), "SESSION_DISAGREES"), (dict(timing=None), "TIMING_DISAGREES"), (dict(scheduled_open_at=OPEN + minute), "SCHEDULED_OPEN_DISAGREES"), (dict(cutoff=cut - minute), "CUTOFF_DISAGREES"),
              (dict(available_at=cut), "CLOCK_ORDER"), (dict(prior_at=None), "CLOCK_ORDER"), (dict(prior_at=src), "CLOCK_ORDER"), (dict(hi=11.0, revision=23.0 / 30.0 - 1), "INVALID_RANGE"), (dict(revision=33.0 / 30.0 - 1 + 1e-9), "MIDPOINT_ARITHMETIC"), (dict(fold_block=2), "BLOCK_DISAGREES"),
              (dict(listed="NYSE"), "LISTING_UNVERIFIED"), (dict(listed=None), "LISTING_UNVERIFIED")]
    names = [x.split()[0] for x in GUIDANCE.split(", ")]
    df = spark.createDataFrame([tuple({**good, **change, "id": i}[n] for n in names) for i, (change, _) in enumerate(faults)], GUIDANCE)
    ok, bad = Q.verify_guidance(df, I.calendar(spark))
    assert [r["id"] for r in ok.collect()] == [0] and ok.columns == df.columns
    assert {r["id"]: r["violations"] for r in bad.collect()} == {i: [why] for i, (_, why) in enumerate(faults) if why}


def test_guidance_support_equals_a_count_by_hand(spark):
    rng = random.Random(5)
    events = [(f"S{rng.randrange(40)}", dt.date(2024, 1, 2 + rng.randrange(8)), str(rng.randrange(12)), rng.randrange(4), rng.choice([-0.1, 0.0, 0.2])) for _ in range(120)]
    keys = sorted({e[:2] for e in events})
    openings = [(*k, rng.choice(["verified_open", "verified_open", "no_official_open"])) for k in keys if rng.random() < 0.9] + [(*keys[0], "verified_open"), ("NEW", dt.date(2024, 1, 3), "verified_open")]
    e = spark.createDataFrame(events, "symbol string, reaction_session date, cik string, block int, revision double")
    o = spark.createDataFrame(openings, "symbol string, reaction_session date, status string")
    count, states = collections.Counter(x[:2] for x in openings), {x[:2]: x[2] for x in openings}
    left = [x for x in events if count[x[:2]] == 1 and states[x[:2]] == "verified_open"]
    stand = collections.Counter(x[:2] for x in events)
    blocks = collections.Counter(x[3] for x in left)
    want = dict(screened=120, rows=len(left), issuers=len({x[2] for x in left}), sessions=len({x[1] for x in left}), raises=sum(x[4] > 0 for x in left), cuts=sum(x[4] < 0 for x in left), unchanged=sum(x[4] == 0 for x in left),
                cut_issuers=len({x[2] for x in left if x[4] < 0}), disagree=sum(stand[k] != 1 or count[k] != 1 for k in {*stand, *count}), blocks=len(blocks), full_blocks=sum(n >= 15 for n in blocks.values()))
    support = Q.guidance_support(e, o, 15)
    assert support.first().asDict() == want
    floors = dict(rows=want["rows"], issuers=want["issuers"], sessions=want["sessions"], blocks=want["full_blocks"])
    assert Q.guidance_gate(support, floors).first()["failed_gates"] == ["openings_match_membership"]
    assert Q.guidance_gate(support, {**floors, "rows": want["rows"] + 1}).first()["failed_gates"] == ["openings_match_membership", "minimum_rows"]
    clean = e.dropDuplicates(["symbol", "reaction_session"])
    every = clean.select("symbol", "reaction_session", F.lit("verified_open").alias("status"))
    assert Q.guidance_gate(Q.guidance_support(clean, every, 1), dict(rows=1, issuers=1, sessions=1, blocks=1)).first()["passed"]
    ups = clean.filter("revision > 0")
    assert Q.guidance_gate(Q.guidance_support(ups, every.join(ups.select("symbol", "reaction_session"), ["symbol", "reaction_session"]), 1), dict(rows=1, issuers=1, sessions=1, blocks=1)).first()["failed_gates"] == ["cuts_present"]
    none = Q.guidance_gate(Q.guidance_support(e.limit(0), o.limit(0), 1), dict(rows=1, issuers=1, sessions=1, blocks=1)).first()
    assert none["rows"] == 0 and none["disagree"] == 0 and not none["passed"]


def test_positions_are_read_from_their_header_and_checked(spark):
    section = lambda name="N", isin="US0000000011", title="t", country="US": f"MARK\nIssuer\n{name}\nTitle\n{title}\nISIN\n{isin}\nEND\nISIN\nother\n" + (f"Country\n{country}\n" if country else "")
    texts = ["head\n" + section() + section("M", "US0000000029") + section("N", "US0000000003"), section() + section("M"), section(isin="us0000000011"), section(country=None), section(name="  "), "nothing", None]
    filings = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = D.extract_positions(filings, "text", "MARK", {"name": "Issuer", "title": "Title", "isin": "ISIN", "country": "Country"}, keep=("i",), header_end="END", whole=("country",))
    checked, judged = D.check_positions(filings, found, "i")
    assert {(r["i"], r["position"]): r["reason"] for r in checked.collect()} == {(0, 1): None, (0, 2): None, (0, 3): None, (1, 1): "DUPLICATE_IDENTIFIER", (1, 2): "DUPLICATE_IDENTIFIER", (2, 1): "INVALID_IDENTIFIER", (3, 1): "MISSING_FIELD:country", (4, 1): "MISSING_FIELD:name"}
    assert {r["i"]: r["reason"] for r in judged.collect()} == {0: None, **{i: "FAULTY_POSITIONS" for i in (1, 2, 3, 4)}, 5: "NO_POSITIONS", 6: "NO_POSITIONS"}
    roster = {r["name"]: [tuple(x) for x in r["securities"]] for r in D.issuer_roster(checked.filter("i = 0"), "i").collect()}
    assert roster == {"N": [("US0000000003", "t", "US"), ("US0000000011", "t", "US")], "M": [("US0000000029", "t", "US")]}


def test_trial_records_carry_notes_and_refusals(spark):
    record = lambda nct, status, phases: json.dumps({"identificationModule": {"nctId": nct, "briefTitle": "T"}, "statusModule": {"overallStatus": status}, "designModule": {"phases": phases}})
    rows = [record("N1", "SUSPENDED", ["PHASE1"]), record("N2", "RECRUITING", None), record("", "COMPLETED", []), record("N4", "NEW", ["PHASE7", "NA"]), "{}", None]
    got = E.classify_trials(spark.createDataFrame([(r,) for r in rows], "record string")).select("nct_id", "brief_title", "status_category", "status_note", "refusal").collect()
    assert [tuple(r)[2:] for r in got] == [("discontinued", "Halted; not necessarily permanently.", None), ("ongoing", None, None), ("completed", E.TRIAL_NOTES["COMPLETED"], "MISSING_TRIAL_ID"), ("unclassified", None, "UNKNOWN_PHASE"),
                                           ("unclassified", None, "MISSING_TRIAL_ID"), ("unclassified", None, "MISSING_TRIAL_ID")]
    assert got[0]["brief_title"] == "T"


def test_an_accession_may_stand_in_the_index_more_than_once(spark):
    """Every exhibit is judged once, by the index row that agrees with it, whatever other rows carry its accession."""
    a, b, c = "0000000001-24-000001", "0000000001-24-000002", "0000000001-24-000003"
    when, day, url = at(0), OPEN.date(), "https://www.sec.gov/Archives/edgar/data/1/{}/x.htm"
    pair = (2000, 1000, dt.date(2023, 12, 31), dt.date(2022, 12, 31))
    exhibits = spark.createDataFrame([(n, k, "0000000001", "8-K", "99.1", "USD", url.format(k.replace("-", "")), when, day, None, *pair) for n, k in ((1, a), (2, b), (3, c))],
                                     "event_id int, accession string, cik string, form string, exhibit string, currency string, release_url string, accepted_at timestamp, filing_date date, comparison_caveat string, current_usd int, prior_usd int, period_end date, prior_end date")
    events = spark.createDataFrame([(n, k, "0000000001", at(-60), at(7200)) for n, k in ((1, a), (2, b), (3, c))], "event_id int, accession string, cik string, published_at timestamp, deadline timestamp")
    index = [(a, "8-K", when, day), (a, "8-K", when, day), (a, "10-Q", at(60), day), (b, "8-K/A", when, day), (b, "8-K", at(60), day), (None, "8-K", when, day)]
    submissions = spark.createDataFrame(index, "accession string, form string, accepted_at timestamp, filing_date date")
    got = sorted((r["event_id"], r["reason"], r["growth"]) for r in E.exhibit_growth(exhibits, events, submissions, I.ZONE).collect())
    assert got == [(1, None, 1.0), (2, "TIMING_MISMATCH", None), (3, "TIMING_MISMATCH", None)]


def equals_its_sql(spark, tmp_path, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, str(tmp_path))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of([d[0] for d in want.description], want.fetchall())
    return got[1]


def test_filings_beyond_a_million_orders_are_told_apart(spark, tmp_path):
    """Accessions hold six digits of the order's number: 40 and 1000040 of one customer share theirs, and so do 41 and 1000041."""
    rows = spark.sql("SELECT id o_orderkey, id % 2 o_custkey, 'O' o_orderstatus, 1.0D o_totalprice, timestamp_ntz'1998-03-02' o_orderdate, '5-LOW' o_orderpriority FROM range(100) UNION ALL "
                     "SELECT id + 1000000, id % 2, 'O', 1.0D, timestamp_ntz'1998-03-02', '5-LOW' FROM range(100)")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    assert len(equals_its_sql(spark, tmp_path, "u03_reconcile", "orders")) == 2
    assert equals_its_sql(spark, tmp_path, "l11_growth_evidence", "orders")


def test_the_last_minute_ends_whatever_the_first_trade_is(spark, tmp_path):
    """The first click has no condition Q, and an earlier one stands eleven years back."""
    rows = [(n, dt.datetime(2024, 1, 3, 12), u, "click", 10.0 + n, "{}") for n, u in ((4, 1), (9, 1), (11, 1), (13, 3))] + [(8, dt.datetime(2011, 1, 3, 12), 5, "click", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert len(equals_its_sql(spark, tmp_path, "t02_stream_official_open", "events")) == 2
