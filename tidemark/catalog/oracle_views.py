"""The derived inputs of `inputs.py` in SQL, for the oracles."""

ZONE = "America/New_York"

VIEWS = {
    "v_sessions": ((), """
SELECT d AS session, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS idx,
  CAST(d AS TIMESTAMP) + INTERVAL 870 MINUTE AS open_utc,
  CAST(d AS TIMESTAMP) + CASE WHEN d = DATE '2024-01-26' THEN INTERVAL 1080 MINUTE ELSE INTERVAL 1260 MINUTE END AS close_utc
FROM (SELECT CAST(r AS DATE) AS d FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY) t(r))
WHERE isodow(d) < 6 AND d NOT IN (DATE '2024-01-01', DATE '2024-01-15')"""),
    "v_days": (("v_sessions",), """
SELECT c.d AS day, s.idx, s.open_utc, s.close_utc, (SELECT min(n.idx) FROM v_sessions n WHERE n.session > c.d) AS next_idx
FROM (SELECT CAST(r AS DATE) AS d FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY) t(r)) c LEFT JOIN v_sessions s ON s.session = c.d"""),
    "v_providers": ((), """
SELECT * FROM (VALUES ('P1', 'https://p1.example/terms', 'regular', true, ['sip']), ('P2', 'https://p2.example/terms', 'regular', false, ['sip']),
 ('P3', 'https://p3.example/terms', 'extended', true, ['sip'])) t(provider_id, terms_url, session_scope, research_permitted, feeds)"""),
    "v_bars": (("v_sessions",), """
SELECT 'B-' || security_id || '-' || strftime(session, '%Y%m%d') AS price_id, security_id, session, idx, open, high, low, close, volume,
  CASE WHEN k = 6 THEN 'P2' WHEN k = 5 THEN 'P3' ELSE 'P1' END AS provider_id, CASE WHEN h % 61 = 0 THEN 'iex' ELSE 'sip' END AS feed, 'raw' AS price_basis,
  h % 59 <> 0 AS complete, h % 83 = 0 AS halted, h % 97 <> 0 AS corporate_actions_verified, close_utc + INTERVAL 1 MINUTE AS available_at,
  close_utc + INTERVAL 1 MINUTE + to_minutes(k % 3) AS first_seen_at
FROM (SELECT b.*, s.idx, s.close_utc, CAST(b.security_id AS INTEGER) AS k, CAST(b.security_id AS INTEGER) * 31 + day(b.session) AS h
  FROM (SELECT CAST(user_id % 10 AS VARCHAR) AS security_id, CAST(ts AS DATE) AS session, arg_min(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high,
          min(value) AS low, arg_max(value, {'a': ts, 'b': event_id}) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM events WHERE value > 0 GROUP BY 1, 2) b JOIN v_sessions s USING (session))"""),
    "v_news": ((), """
SELECT 'E' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS event_id, event_id AS event_no, 'K-' || user_id || '-' || strftime(ts, '%Y%m%d') AS cluster_id,
  CAST(user_id % 10 AS VARCHAR) AS security_id, 'S' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS source_id, lpad(CAST(user_id AS VARCHAR), 10, '0') AS cik,
  lpad(CAST(100 * (1 + user_id % 90) + 11 AS VARCHAR), 4, '0') AS sic, date_trunc('minute', ts) AS published_at,
  CASE WHEN event_id % 23 = 0 THEN 'day' WHEN event_id % 7 = 0 THEN 'second' ELSE 'minute' END AS precision,
  date_trunc('minute', ts) + INTERVAL 5 MINUTE AS cutoff, event_id % 19 <> 0 AS first_public_verified,
  date_trunc('minute', ts) + to_minutes(1 + event_id % 9) AS first_seen_at, CASE WHEN event_id % 3 = 0 THEN 'earnings' ELSE 'guidance' END AS category, user_id
FROM events WHERE event_type = 'signup'"""),
    "v_sources": (("v_news",), """
SELECT source_id, event_id, timestamp_evidence, CASE WHEN event_no % 43 = 0 THEN 'http://x.example/' ELSE 'https://x.example/' END AS url, text,
  CASE WHEN event_no % 37 = 0 THEN sha256('other') ELSE sha256(text) END AS sha256, first_seen_at,
  first_seen_at + CASE WHEN event_no % 41 = 0 THEN INTERVAL (-1) MINUTE ELSE INTERVAL 1 MINUTE END AS retrieved_at
FROM (SELECT *, 'Release of ' || event_id || ' at ' || CASE WHEN event_no % 31 = 0 THEN 'noon' ELSE timestamp_evidence END || ' ET' AS text
  FROM (SELECT *, strftime(published_at - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS timestamp_evidence FROM v_news))"""),
    "v_securities": ((), """
SELECT security_id, 'C' || security_id AS company_id, 'T' || security_id AS ticker,
  CASE WHEN security_id = '7' THEN 'OTC' WHEN CAST(security_id AS INTEGER) % 2 = 0 THEN 'NASDAQ' ELSE 'NYSE' END AS exchange,
  CASE WHEN security_id = '8' THEN 'etf' ELSE 'common_stock' END AS security_type, TIMESTAMP '2023-01-01' AS valid_from,
  CASE WHEN security_id = '9' THEN TIMESTAMP '2024-01-20' END AS valid_to,
  CASE WHEN security_id = '4' THEN TIMESTAMP '2024-01-05' ELSE TIMESTAMP '2023-01-01' END AS available_at
FROM (SELECT DISTINCT CAST(user_id % 10 AS VARCHAR) AS security_id FROM events)"""),
    "v_actions": ((), """
SELECT 'A' || event_id AS action_id, CAST(user_id % 10 AS VARCHAR) AS security_id, CASE WHEN event_id % 2 = 0 THEN 'split' ELSE 'dividend' END AS type,
  CAST(ts AS DATE) AS effective_date, ts AS available_at FROM events WHERE event_type = 'error' AND event_id % 97 = 0"""),
    "v_features": ((), """
SELECT CAST(user_id % 10 AS VARCHAR) AS security_id, 'f' || (event_id % 5) AS name, lpad(CAST(event_id AS VARCHAR), 10, '0') AS revision_id, value, ts AS available_at,
  ts + to_minutes(event_id % 60) AS first_seen_at, ts - INTERVAL 1 HOUR AS valid_from, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 3 DAY END AS valid_to,
  CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 2 HOUR END AS label_available_at
FROM events WHERE event_type = 'view'"""),
    "v_long_bars": ((), """
SELECT security_id, session, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume
FROM (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS security_id, CAST(l_shipdate AS DATE) AS session, l_extendedprice / l_quantity AS price, l_quantity,
        {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice} AS k FROM lineitem WHERE isodow(l_shipdate) < 6) GROUP BY 1, 2"""),
    "v_filings": ((), """
SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS accession,
  o_custkey AS cik_no, CAST(o_orderdate AS DATE) AS filing_date,
  CASE WHEN o_orderstatus = 'F' THEN '8-K/A' WHEN o_orderkey % 7 = 0 THEN '10-Q' ELSE '8-K' END AS form,
  CASE WHEN o_orderpriority[1] = '1' THEN '2.02,9.01' WHEN o_orderpriority[1] = '2' THEN '5.02, 7.01' WHEN o_orderpriority[1] = '3' THEN '8.01,9.01'
    WHEN o_orderpriority[1] = '4' AND o_orderkey % 2 = 0 THEN 'Item 2.02 and 8.01' WHEN o_orderpriority[1] = '4' THEN '3.99' END AS items_text,
  o_orderdate + to_hours(13 + o_orderkey % 12) + to_minutes(o_orderkey % 60) AS accepted_at,
  CASE WHEN o_orderkey % 29 = 0 THEN '../bad path.htm' ELSE 'doc' || o_orderkey || '.htm' END AS primary_document, o_orderkey AS order_no, o_totalprice AS amount
FROM orders"""),
    "v_facts": ((), """
SELECT * FROM (
  WITH q AS (SELECT c_nationkey AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start, round(sum(o_totalprice), 2) AS val
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
  e AS (SELECT *, CAST(start + INTERVAL 3 MONTH AS DATE) - 1 AS "end" FROM q)
  SELECT entity, start, "end", val, 'Q-' || lpad(CAST(entity AS VARCHAR), 3, '0') || '-' || strftime("end", '%Y%m%d') AS accn, "end" + 30 AS filed, '10-Q' AS form, 'Revenues' AS tag FROM e
  UNION ALL
  SELECT entity, start, "end", round(val * 1.01, 2), 'Q-' || lpad(CAST(entity AS VARCHAR), 3, '0') || '-' || strftime(last_day("end" + INTERVAL 12 MONTH), '%Y%m%d'),
    last_day("end" + INTERVAL 12 MONTH) + 30, '10-Q', 'Revenues' FROM e WHERE entity % 3 = 0)"""),
    "v_trades": ((), """
SELECT user_id AS symbol, CAST(ts AS DATE) AS session, date_trunc('day', ts) + INTERVAL 870 MINUTE + to_seconds(event_id % 90) AS t, value AS price, event_id AS trade_id,
  CASE WHEN event_id % 5 = 0 THEN 'X' WHEN user_id % 2 = 1 THEN 'N' ELSE 'Q' END AS print_venue, CASE WHEN event_id % 7 = 0 THEN 'B' WHEN user_id % 2 = 1 THEN 'A' ELSE 'C' END AS print_tape, CASE WHEN event_id % 4 = 0 THEN ['@'] ELSE ['@', 'Q'] END AS conditions,
  CASE WHEN event_id % 53 = 0 THEN 'X' END AS correction, date_trunc('day', ts) + INTERVAL 870 MINUTE + to_seconds(event_id % 90) + to_seconds(event_id % 8) AS received_at
FROM events WHERE event_type = 'click'"""),
    "v_listings": (("v_securities",), "SELECT DISTINCT user_id AS symbol, exchange FROM events JOIN v_securities ON security_id = CAST(user_id % 10 AS VARCHAR)"),
    "v_prints": (("v_trades", "v_listings", "v_sessions"), """
SELECT t.*, open_utc FROM v_trades t JOIN v_listings USING (symbol) JOIN v_sessions USING (session)
WHERE list_contains(conditions, 'Q') AND ((exchange = 'NYSE' AND print_venue = 'N' AND print_tape = 'A') OR (exchange = 'NASDAQ' AND print_venue = 'Q' AND print_tape = 'C'))"""),
}


def with_views(body, names):
    """`body` after a WITH clause holding the named views and what they rest on, each once and in order."""
    ordered = []

    def add(name):
        if name not in ordered:
            for dep in VIEWS[name][0]:
                add(dep)
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name][1].strip()})" for name in ordered)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _window_cols(kind):
    return ", ".join(f"max({kind}) FILTER (n = {n}) AS {kind}_{n}" for n in (1, 2, 5, 10, 20))


def outcome_views(mode):
    """The event outcome chain in SQL: every event meets every bar of every window (fine at oracle size, and independent of the Spark plan)."""
    forward = mode == "forward"
    known = "greatest(pub_available, first_seen_at)" if forward else "pub_available"
    avail = "greatest(b.available_at, b.first_seen_at)" if forward else "b.available_at"
    observed = "WHEN anchor_seen > cutoff THEN 'ANCHOR_NOT_OBSERVED_AT_CUTOFF'" if forward else ""
    s = "_fwd" if forward else ""
    return {
        f"v_timed{s}": (("v_news", "v_days", "v_sessions", "v_securities"), f"""
SELECT *, {known} AS known_at FROM (
 SELECT n.*, CASE WHEN n.precision = 'minute' THEN published_at + INTERVAL 1 MINUTE WHEN n.precision = 'second' THEN published_at END AS pub_available,
  CASE WHEN n.precision = 'minute' THEN published_at + INTERVAL 59999999 MICROSECOND WHEN n.precision = 'second' THEN published_at END AS pub_last,
  d.open_utc AS d_open, d.close_utc AS d_close,
  CASE WHEN d.idx IS NULL THEN 'closed' WHEN published_at = d.open_utc OR published_at = d.close_utc THEN 'bell_ambiguous' WHEN published_at > d.open_utc AND published_at < d.close_utc THEN 'regular'
    WHEN published_at < d.open_utc THEN 'premarket' ELSE 'after_hours' END AS timing,
  CASE WHEN d.idx IS NOT NULL AND published_at <= d.close_utc THEN d.idx ELSE d.next_idx END AS reaction_idx
 FROM v_news n LEFT JOIN v_days d ON d.day = CAST(n.published_at - INTERVAL 5 HOUR AS DATE))"""),
        f"v_early{s}": ((f"v_timed{s}",), f"""
SELECT t.*, s.open_utc AS reaction_open, s.session AS reaction_session, c.company_id,
 CASE WHEN t.precision = 'day' THEN 'AMBIGUOUS_PUBLICATION_TIME' WHEN NOT first_public_verified THEN 'FIRST_PUBLIC_TIME_UNVERIFIED'
  WHEN known_at > cutoff THEN 'NEWS_NOT_AVAILABLE_AT_CUTOFF'
  WHEN c.exchange NOT IN ('NASDAQ', 'NYSE', 'NYSE American') OR c.security_type <> 'common_stock' THEN 'INELIGIBLE_SECURITY'
  WHEN c.available_at > published_at OR c.valid_from > published_at THEN 'IDENTITY_NOT_KNOWN_AT_RELEASE' WHEN pub_last >= c.valid_to THEN 'IDENTITY_EXPIRED'
  WHEN reaction_idx IS NULL THEN 'CALENDAR_OUT_OF_RANGE'
  WHEN timing <> 'bell_ambiguous' AND ((published_at < d_open AND pub_last >= d_open) OR (published_at < d_close AND pub_last >= d_close)) THEN 'PUBLICATION_INTERVAL_CROSSES_SESSION_BOUNDARY'
  WHEN timing = 'bell_ambiguous' AND pub_last > published_at THEN 'PUBLICATION_INTERVAL_CROSSES_SESSION_BOUNDARY'
  WHEN timing IN ('regular', 'bell_ambiguous') THEN 'INTRADAY_OR_BELL_REQUIRES_FINER_DATA' WHEN reaction_idx = 0 THEN 'CALENDAR_OUT_OF_RANGE'
  WHEN cutoff >= s.open_utc THEN 'CUTOFF_NOT_BEFORE_REACTION_OPEN' END AS early_reason
FROM v_timed{s} t LEFT JOIN v_sessions s ON s.idx = t.reaction_idx LEFT JOIN v_securities c ON c.security_id = t.security_id"""),
        f"v_windows{s}": ((f"v_early{s}", "v_bars", "v_providers", "v_actions"), f"""
SELECT event_id, {_window_cols('why')}, {_window_cols('close')}, {_window_cols('avail')}, {_window_cols('ids')} FROM (
 SELECT e.event_id, w.n,
  CASE WHEN e.reaction_idx + w.n - 1 > (SELECT max(idx) FROM v_sessions) THEN 'CALENDAR_OUT_OF_RANGE' WHEN count(b.price_id) < w.n + 1 THEN 'MISSING_SESSION'
   WHEN count(DISTINCT b.provider_id || b.feed) > 1 THEN 'MIXED_PRICE_FEEDS'
   ELSE coalesce(arg_min(CASE WHEN NOT p.research_permitted THEN 'PROVIDER_USE_UNVERIFIED' WHEN NOT list_contains(p.feeds, b.feed) THEN 'UNDECLARED_FEED'
      WHEN p.session_scope <> 'regular' THEN 'REGULAR_SESSION_COVERAGE_UNVERIFIED' WHEN NOT b.complete OR b.halted OR b.volume = 0 THEN 'INCOMPLETE_OR_HALTED_SESSION'
      WHEN NOT b.corporate_actions_verified THEN 'CORPORATE_ACTION_AUDIT_MISSING' WHEN b.available_at > TIMESTAMP '2024-01-30 12:00:00' THEN 'LABEL_NOT_MATURE' END, b.idx)
     FILTER (NOT p.research_permitted OR NOT list_contains(p.feeds, b.feed) OR p.session_scope <> 'regular' OR NOT b.complete OR b.halted OR b.volume = 0
        OR NOT b.corporate_actions_verified OR b.available_at > TIMESTAMP '2024-01-30 12:00:00'),
    CASE WHEN EXISTS (SELECT 1 FROM v_actions a WHERE a.security_id = e.security_id AND a.effective_date > (SELECT session FROM v_sessions x WHERE x.idx = e.reaction_idx - 1)
        AND a.effective_date <= (SELECT session FROM v_sessions x WHERE x.idx = e.reaction_idx + w.n - 1)) THEN 'CORPORATE_ACTION_IN_WINDOW' END) END AS why,
  arg_max(b.close, b.idx) AS close, max({avail}) AS avail, string_agg(b.price_id, ',' ORDER BY b.idx) AS ids
 FROM (SELECT DISTINCT security_id, reaction_idx, min(event_id) AS event_id FROM v_early{s} WHERE early_reason IS NULL GROUP BY 1, 2) e CROSS JOIN (VALUES (1), (2), (5), (10), (20)) w(n)
 LEFT JOIN v_bars b ON b.security_id = e.security_id AND b.idx BETWEEN e.reaction_idx - 1 AND e.reaction_idx + w.n - 1
 LEFT JOIN v_providers p ON p.provider_id = b.provider_id GROUP BY e.event_id, e.security_id, e.reaction_idx, w.n) GROUP BY event_id"""),
        f"v_outcomes{s}": ((f"v_windows{s}",), f"""
SELECT *, CASE WHEN reason IS NULL THEN 'MAPPED' ELSE 'QUARANTINED' END AS state FROM (
 SELECT *, CASE WHEN early_reason IS NOT NULL THEN early_reason WHEN anchor_close IS NULL THEN 'MISSING_PREVIOUS_SESSION'
   WHEN anchor_available > cutoff THEN 'ANCHOR_UNAVAILABLE_AT_CUTOFF' {observed} ELSE why_1 END AS reason
 FROM (SELECT e.*, w.* EXCLUDE (event_id), a.close AS anchor_close, a.available_at AS anchor_available, a.first_seen_at AS anchor_seen, a.price_id AS anchor_price_id, a.session AS anchor_session,
   c.open, c.high, c.low, c.close
  FROM v_early{s} e LEFT JOIN (SELECT security_id, reaction_idx, min(event_id) AS rep FROM v_early{s} WHERE early_reason IS NULL GROUP BY 1, 2) r
    ON e.early_reason IS NULL AND r.security_id = e.security_id AND r.reaction_idx = e.reaction_idx
  LEFT JOIN v_windows{s} w ON w.event_id = r.rep
  LEFT JOIN v_bars a ON e.early_reason IS NULL AND a.security_id = e.security_id AND a.idx = e.reaction_idx - 1
  LEFT JOIN v_bars c ON e.early_reason IS NULL AND c.security_id = e.security_id AND c.idx = e.reaction_idx))"""),
        f"v_labels{s}": ((f"v_outcomes{s}",), f"""
SELECT * FROM (
SELECT o.event_id, l.label, l.kind, l.n, CASE l.label WHEN 'day1_open_return' THEN open / anchor_close - 1 WHEN 'day1_high_return' THEN high / anchor_close - 1
  WHEN 'day1_low_return' THEN low / anchor_close - 1 WHEN 'day1_close_return' THEN close / anchor_close - 1
  WHEN 'session_2_close_return' THEN CASE WHEN why_2 IS NULL THEN close_2 / anchor_close - 1 END WHEN 'session_5_close_return' THEN CASE WHEN why_5 IS NULL THEN close_5 / anchor_close - 1 END
  WHEN 'session_10_close_return' THEN CASE WHEN why_10 IS NULL THEN close_10 / anchor_close - 1 END WHEN 'session_20_close_return' THEN CASE WHEN why_20 IS NULL THEN close_20 / anchor_close - 1 END END AS num,
 CASE WHEN l.label LIKE 'gap_ge%' THEN CAST(open AS DECIMAL(18, 6)) * 100 >= CAST(anchor_close AS DECIMAL(18, 6)) * (100 + CAST(regexp_extract(l.label, '(\\d+)', 1) AS INTEGER))
  WHEN l.kind = 'boolean' AND CAST(open AS DECIMAL(18, 6)) * 1000 < CAST(anchor_close AS DECIMAL(18, 6)) * 1005 THEN NULL
  WHEN l.label = 'positive_gap_retained_half' THEN close >= (open + anchor_close) / 2 WHEN l.label = 'positive_gap_filled' THEN low <= anchor_close END AS flag,
 CASE WHEN l.label LIKE 'positive%' AND CAST(open AS DECIMAL(18, 6)) * 1000 < CAST(anchor_close AS DECIMAL(18, 6)) * 1005 THEN 'NOT_POSITIVE_GAP_GE_0_5PCT'
  WHEN l.n = 2 THEN why_2 WHEN l.n = 5 THEN why_5 WHEN l.n = 10 THEN why_10 WHEN l.n = 20 THEN why_20 END AS reason,
 CASE l.n WHEN 1 THEN avail_1 WHEN 2 THEN avail_2 WHEN 5 THEN avail_5 WHEN 10 THEN avail_10 ELSE avail_20 END AS avail,
 CASE l.n WHEN 1 THEN ids_1 WHEN 2 THEN ids_2 WHEN 5 THEN ids_5 WHEN 10 THEN ids_10 ELSE ids_20 END AS price_ids
FROM v_outcomes{s} o CROSS JOIN (VALUES ('day1_open_return', 'return', 1), ('day1_high_return', 'return', 1), ('day1_low_return', 'return', 1), ('day1_close_return', 'return', 1),
 ('session_2_close_return', 'return', 2), ('session_5_close_return', 'return', 5), ('session_10_close_return', 'return', 10), ('session_20_close_return', 'return', 20),
 ('gap_ge_3pct', 'boolean', 1), ('gap_ge_5pct', 'boolean', 1), ('gap_ge_10pct', 'boolean', 1), ('gap_ge_15pct', 'boolean', 1), ('gap_ge_20pct', 'boolean', 1), ('gap_ge_30pct', 'boolean', 1),
 ('positive_gap_retained_half', 'boolean', 1), ('positive_gap_filled', 'boolean', 1)) l(label, kind, n) WHERE o.state = 'MAPPED')"""),
    }


VIEWS.update(outcome_views("historical"))
VIEWS.update(outcome_views("forward"))
