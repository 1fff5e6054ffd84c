"""Registered queries: filings, figures, names, set operations and scalar functions (F, M, V14-V22, L3-L11, J10-J19, A9, A10, U, O1, O2)."""
from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.oracle_views import VIEWS
from tidemark.catalog.registry import query
from tidemark.catalog.study_queries import study_events
from tidemark.functions import numeric as M, text as T
from tidemark.operators import asof as A, sets as U
from tidemark.plans import enrich as E


def micros(c, name=None):
    return F.unix_micros(F.col(c)).alias(name or c)


def case(col, table, default="NULL"):
    q = lambda v: "'" + v.replace("'", "''") + "'"
    return f"CASE {col} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default if default == 'NULL' else q(default)} END"


ITEMS_SQL = "list_sort(list_distinct(regexp_extract_all(coalesce(items_text, ''), '\\b(\\d\\.\\d{2})\\b', 1)))"
VIEWS["v_items"] = (("v_filings",), f"SELECT *, {ITEMS_SQL} AS items FROM v_filings")


def filings(spark, sf):
    return I.filings(spark, sf).withColumn("items", T.item_numbers("items_text"))


@query("f01_f05_identifiers", r"""
SELECT order_no, lpad(CAST(cik_no AS VARCHAR), 10, '0') AS cik, replace(accession, '-', '') AS accession_dir, array_to_string(items, ',') AS items,
 CASE WHEN order_no % 3 <> 0 THEN lpad(CAST(cik_no AS VARCHAR), 10, '0') END AS master_cik, CASE WHEN order_no % 3 <> 0 THEN accession END AS master_accession,
 trim(regexp_replace(lower(trim(nm)), '[,.]?\s*(inc|incorporated|corp|corporation|co|ltd|llc)\.?\s*$', '')) AS company
FROM (SELECT *, ' Firm ' || cik_no || CASE order_no % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Corporation' WHEN 2 THEN ' LLC ' WHEN 3 THEN ' Co' ELSE ' Partners' END AS nm FROM v_items)""", ["v_items"])
def f01_f05(spark, sf):
    d = filings(spark, sf)
    suffix = F.element_at(F.array(*[F.lit(x) for x in (", Inc.", " Corporation", " LLC ", " Co", " Partners")]), (F.col("order_no") % 5 + 1).cast("int"))
    d = d.withColumn("nm", F.concat(F.lit(" Firm "), F.col("cik_no").cast("string"), suffix))
    path = F.when(F.col("order_no") % 3 != 0, F.concat(F.lit("edgar/data/"), F.col("cik_no").cast("string"), F.lit("/"), F.col("accession"), F.lit(".txt"))).otherwise(F.concat(F.lit("other/"), F.col("accession")))
    d = d.withColumn("_m", T.split_master_name(path))
    return d.select("order_no", T.pad_cik("cik_no").alias("cik"), T.accession_dir("accession").alias("accession_dir"), F.array_join("items", ",").alias("items"), F.col("_m.cik").alias("master_cik"),
                    F.col("_m.accession").alias("master_accession"), T.norm_company("nm").alias("company"))


DIV = " ".join(f"WHEN g BETWEEN {a} AND {b} THEN '{x}'" for x, _, a, b in T.SIC_DIVISIONS)


@query("f06_f07_sectors", f"""
SELECT p_partkey, d AS division, {case('d', {x: n for x, n, _, _ in T.SIC_DIVISIONS})} AS division_name, CASE WHEN d IN ('D', 'I') THEN d WHEN d IN ('B', 'E', 'F', 'G') THEN 'other' END AS sector_group
FROM (SELECT p_partkey, CASE {DIV} END AS d FROM (SELECT p_partkey, p_partkey % 100 AS g FROM part))""")
def f06_f07(spark, sf):
    p = I.table(spark, sf, "part").withColumn("sic", F.concat(F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("11")))
    d = p.withColumn("division", T.sic_division("sic"))
    return d.select("p_partkey", "division", T.sic_division_name("division").alias("division_name"), T.sector_group("division").alias("sector_group"))


@query("f08_f09_digests", """
SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR) || chr(31) || o_orderpriority || chr(31) || o_orderstatus) AS digest, 20260101 + CAST('0x' || sha256(CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus)[1:15] AS BIGINT) AS seed,
 CAST('0x' || md5('9|' || o_orderkey)[1:8] AS BIGINT) % 97 AS draw FROM orders""")
def f08_f09(spark, sf):
    o = I.table(spark, sf, "orders")
    return o.select("o_orderkey", T.row_digest("o_orderstatus", "o_custkey", "o_orderpriority").alias("digest"), T.seed_for(20260101, "o_custkey", "o_orderstatus").alias("seed"), T.hash_draw(97, F.lit(9), "o_orderkey").alias("draw"))


@query("f10_f13_clocks", """
SELECT event_id, CAST(published_at - INTERVAL 5 HOUR AS DATE) AS day, strftime(published_at - INTERVAL 5 HOUR, '%H:%M') AS minute, CAST(year(published_at) AS VARCHAR) || 'Q' || quarter(published_at) AS quarter,
 CASE WHEN hour(published_at - INTERVAL 5 HOUR) * 60 + minute(published_at - INTERVAL 5 HOUR) < 1050 THEN epoch_us(greatest(published_at + INTERVAL 2 MINUTE, CAST(CAST(published_at AS DATE) AS TIMESTAMP) + INTERVAL 5 HOUR)) END AS filing_available,
 CASE WHEN precision = 'day' THEN epoch_us(CAST(CAST(published_at - INTERVAL 5 HOUR AS DATE) + 1 AS TIMESTAMP) + INTERVAL 5 HOUR) ELSE epoch_us(published_at + INTERVAL 1 MINUTE) END AS release_available,
 epoch_us(published_at - INTERVAL 15 MINUTE) AS feature_cutoff FROM v_news""", ["v_news"])
def f10_f13(spark, sf):
    n = I.news(spark, sf)
    us = F.unix_micros
    return n.select("event_id", T.local_day("published_at", I.ZONE).alias("day"), T.local_minute("published_at", I.ZONE).alias("minute"), T.quarter_label("published_at").alias("quarter"),
                    us(T.filing_available("published_at", F.to_date("published_at"), I.ZONE)).alias("filing_available"), us(T.release_available("published_at", "precision", I.ZONE)).alias("release_available"),
                    us(T.feature_cutoff("published_at")).alias("feature_cutoff"))


@query("f14_f15_json_arrays", """
SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k, CASE WHEN event_id % 2 = 0 THEN 'a' || event_id WHEN event_id % 3 = 0 THEN 'b' || event_id END AS value,
 CASE WHEN event_id % 2 = 0 THEN 'ex_date' WHEN event_id % 3 = 0 THEN 'payable_date' END AS field FROM events""")
def f14_f15(spark, sf):
    e = I.table(spark, sf, "events")
    n = F.col("event_id")
    d = e.withColumn("ex_date", F.when(n % 2 == 0, F.concat(F.lit("a"), n.cast("string")))).withColumn("payable_date", F.when(n % 3 == 0, F.concat(F.lit("b"), n.cast("string"))))
    return d.select("event_id", T.json_field("props", "$.k", "int").alias("k"), T.first_present("ex_date", "payable_date").alias("_f")).select("event_id", "k", "_f.value", "_f.field")


@query("m03_m07_outcomes", """
SELECT l_orderkey, l_linenumber, CASE WHEN g <> 0 THEN round(-sign(g) * ((1 + c) / (1 + g) - 1), 9) + 0.0 END AS continuation, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount - 1, 9) + 0.0 END AS growth,
 CASE WHEN l_discount > 0 THEN round(asinh(l_tax / l_discount - 1), 9) + 0.0 END AS asinh_growth, CASE WHEN g <> 0 THEN round((c - g) / abs(g) * 100, 4) + 0.0 END AS surprise_pct, round((l_quantity + l_quantity * 2) / (l_linenumber + 3) - 1, 9) + 0.0 AS revision,
 round(100 * (c - g), 8) + 0.0 AS reaction_gap, round((1 + c) / (1 + g) - 1, 9) + 0.0 AS residual, CAST(CASE WHEN (g < -0.02 OR g > 0.03) AND abs(0.001 - g) >= 0.02 THEN -sign(g) ELSE 0 END AS INTEGER) AS tail, CAST(CASE WHEN abs(g) > 0.025 THEN -sign(g) ELSE 0 END AS INTEGER) AS magnitude
FROM (SELECT *, l_discount - 0.05 AS g, l_tax - 0.04 AS c FROM lineitem)""")
def m03_m07(spark, sf):
    d = I.table(spark, sf, "lineitem").withColumn("g", F.col("l_discount") - 0.05).withColumn("c", F.col("l_tax") - 0.04)
    z = lambda x, n, k=9: (F.round(x, k) + 0.0).alias(n)
    return d.select("l_orderkey", "l_linenumber", z(M.continuation("g", "c"), "continuation"), z(M.growth("l_tax", "l_discount"), "growth"), z(M.asinh_growth("l_tax", "l_discount"), "asinh_growth"),
                    z(M.surprise_pct("c", "g"), "surprise_pct", 4), z(M.range_revision("l_quantity", F.col("l_quantity") * 2, "l_linenumber", F.lit(3)), "revision"), z(M.reaction_gap("c", "g"), "reaction_gap", 8),
                    z(M.residual_return("c", "g"), "residual"), M.tail_flag("g", F.lit(-0.02), F.lit(0.03), F.lit(0.001)).alias("tail"), M.magnitude_flag("g", F.lit(0.025)).alias("magnitude"))


@query("m08_m10_rates", """
SELECT l_orderkey, l_linenumber, round(ln(c / (1 - c)), 9) + 0.0 AS logit, CASE WHEN x >= 0 THEN round(1 / (1 + exp(-x)), 9) ELSE round(exp(x) / (1 + exp(x)), 9) END AS sigmoid, c AS clipped, round(x, 4) + 0.0 AS rounded
FROM (SELECT *, least(greatest(l_discount * 12, 0.01), 0.99) AS c, (l_quantity - 25) * 3 AS x FROM lineitem)""")
def m08_m10(spark, sf):
    d = I.table(spark, sf, "lineitem").withColumn("c", M.clip_rate(F.col("l_discount") * 12)).withColumn("x", (F.col("l_quantity") - 25) * 3)
    return d.select("l_orderkey", "l_linenumber", M.rounded(M.logit("c"), 9).alias("logit"), F.round(M.sigmoid("x"), 9).alias("sigmoid"), F.col("c").alias("clipped"), M.rounded("x", 4).alias("rounded"))


@query("v14_filing_screen", "SELECT order_no, filing_date FROM v_items WHERE filing_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND list_contains(items, '2.02')", ["v_items"])
def v14(spark, sf):
    return E.screen_filings(filings(spark, sf), "1996-01-01", "1997-06-30", "2.02").select("order_no", "filing_date")


@query("v15_filing_state", """
SELECT order_no, CASE WHEN form = '8-K/A' THEN 'AMENDMENT_REVIEW' WHEN form <> '8-K' THEN NULL WHEN items_text IS NULL THEN 'ITEMS_UNAVAILABLE' WHEN list_contains(items, '2.02') THEN 'EARNINGS_CANDIDATE' ELSE 'NOT_ITEM_2_02' END AS state FROM v_items""", ["v_items"])
def v15(spark, sf):
    return I.filings(spark, sf).select("order_no", E.filing_state().alias("state"))


@query("v16_filing_urls", """
SELECT order_no, CASE WHEN order_no % 29 = 0 THEN b || accession || '-index.html' ELSE b || primary_document END AS url, CASE WHEN order_no % 29 = 0 THEN 'REVIEW_REQUIRED' ELSE 'PARSED_SAFE' END AS document_state
FROM (SELECT *, 'https://www.sec.gov/Archives/edgar/data/' || cik_no || '/' || replace(accession, '-', '') || '/' AS b FROM v_filings)""", ["v_filings"])
def v16(spark, sf):
    return E.filing_urls(I.filings(spark, sf)).select("order_no", "url", "document_state")


@query("v17_current_reports", "SELECT order_no, array_to_string(items, ',') AS items FROM v_items WHERE form = '8-K' AND filing_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND list_has_any(items, ['7.01', '8.01'])", ["v_items"])
def v17(spark, sf):
    return E.current_reports(I.filings(spark, sf), "1996-01-01", "1999-12-31", ["7.01", "8.01"]).select("order_no", F.array_join("items", ",").alias("items"))


@query("v18_listing_state", """
SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 THEN 'EXCLUDED_TEST' WHEN p_partkey % 13 = 0 THEN 'EXCLUDED_ETF' WHEN p_partkey % 7 = 0 THEN 'EXCLUDED_EXCHANGE' WHEN p_partkey % 5 = 0 THEN 'EXCLUDED_OR_REQUIRES_TYPE_REVIEW' ELSE 'REQUIRES_IDENTITY_REVIEW' END AS state FROM part""")
def v18(spark, sf):
    k = F.col("p_partkey")
    p = I.table(spark, sf, "part").select("p_partkey", F.when(k % 31 == 0, "Y").otherwise("N").alias("test_issue"), F.when(k % 13 == 0, "Y").otherwise("N").alias("etf"), F.when(k % 7 == 0, "OTHER").otherwise("NYSE").alias("exchange"),
                                          F.when(k % 5 == 0, F.concat("p_name", F.lit(" Depositary Shares"))).otherwise(F.col("p_name")).alias("security_name"))
    return p.select("p_partkey", E.listing_state().alias("state"))


@query("v19_return_sanity", """
SELECT l_orderkey, l_linenumber, CASE WHEN g IS NULL OR g <= -1 THEN 'opening_unavailable' WHEN g = 0 THEN 'zero_opening_gap' WHEN c IS NULL OR c <= -1 THEN 'close_unavailable' END AS reason
FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN -1.5 ELSE l_discount END AS g, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_tax - CASE WHEN l_linenumber = 6 THEN 2 ELSE 0 END END AS c FROM lineitem)""")
def v19(spark, sf):
    k = F.col("l_linenumber")
    d = I.table(spark, sf, "lineitem").withColumn("gap", F.when(k == 3, None).when(k == 4, -1.5).otherwise(F.col("l_discount"))).withColumn("close_return", F.when(k == 5, None).otherwise(F.col("l_tax") - F.when(k == 6, 2).otherwise(0)))
    return d.select("l_orderkey", "l_linenumber", E.exclusion_reason().alias("reason"))


@query("v22_source_mask", """
SELECT variant, disposition, count(*) AS n FROM (SELECT v.variant, CASE WHEN event_no % 11 = 0 THEN 'hard_source_exclusion' WHEN v.variant = 'clean' AND event_no % 4 = 0 THEN 'soft_source_caveat' ELSE 'accepted' END AS disposition
FROM v_news, (VALUES ('clean'), ('all')) v(variant)) GROUP BY 1, 2""", ["v_news"])
def v22(spark, sf):
    n = I.news(spark, sf)
    masks = n.select("event_id", (F.col("event_no") % 11 == 0).alias("hard"), (F.col("event_no") % 4 == 0).alias("soft"))
    parts = [E.partition_by_mask(n, masks, clean).groupBy(F.lit(name).alias("variant"), "disposition").agg(F.count(F.lit(1)).alias("n")) for name, clean in (("clean", True), ("all", False))]
    return parts[0].unionByName(parts[1])


@query("l03_item_classification", f"""
SELECT order_no, item, {case('item', {k: v[0] for k, v in E.ITEMS.items()}, 'unclassified')} AS category, {case('item', {k: v[1] for k, v in E.ITEMS.items()})} AS subtype FROM (SELECT order_no, unnest(items) AS item FROM v_items)""", ["v_items"])
def l03(spark, sf):
    return E.classify_filings(filings(spark, sf)).select("order_no", "item", "category", "subtype")


STATUSES = list(E.TRIAL_STATUS) + ["BRAND_NEW"]
_pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
_sqlpick = lambda values, n: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{n} % {len(values)} + 1]"


@query("l04_trial_classification", f"""
SELECT 'NCT' || o_orderkey AS nct_id, st AS status, {case('st', E.TRIAL_STATUS, 'unclassified')} AS status_category, {case('st', E.TRIAL_NOTES)} AS status_note, CASE WHEN o_orderkey % 9 = 0 THEN 'UNKNOWN_PHASE' END AS refusal, CASE WHEN o_orderkey % 9 = 0 THEN 'PHASE9' ELSE '' END AS unknown_phases, o_orderpriority AS condition, 'Sponsor ' || o_custkey AS sponsor
FROM (SELECT *, {_sqlpick(STATUSES, 'o_orderkey')} AS st FROM orders)""")
def l04(spark, sf):
    """Trial records as nested JSON text, one per order."""
    o, k = I.table(spark, sf, "orders"), F.col("o_orderkey")
    record = F.to_json(F.struct(
        F.struct(F.concat(F.lit("NCT"), k.cast("string")).alias("nctId"), F.lit("t").alias("briefTitle")).alias("identificationModule"), F.struct(_pick(STATUSES, k).alias("overallStatus")).alias("statusModule"),
        F.struct(F.when(k % 9 == 0, F.array(F.lit("PHASE1"), F.lit("PHASE9"))).otherwise(F.array(F.lit("PHASE2"))).alias("phases")).alias("designModule"), F.struct(F.array("o_orderpriority").alias("conditions")).alias("conditionsModule"),
        F.struct(F.struct(F.concat(F.lit("Sponsor "), F.col("o_custkey").cast("string")).alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule")))
    t = E.classify_trials(o.select(record.alias("record")))
    return t.select("nct_id", "status", "status_category", "status_note", "refusal", F.array_join("unknown_phases", ",").alias("unknown_phases"), F.element_at("conditions", 1).alias("condition"), "sponsor")


APPS, TYPES, CLASSES, STATES = ["ANDA", "NDA", "BLA", "XX"], ["ORIG", "SUPPL", "OTHER"], list(E.SUBMISSION_CLASS) + ["UNKNOWN"], ["AP", "TA", "WD"]


@query("l05_drug_applications", f"""
SELECT pre || l_orderkey AS application_number, CASE WHEN pre LIKE 'ANDA%' THEN 'abbreviated_new_drug_application' WHEN pre = 'NDA' THEN 'new_drug_application' WHEN pre = 'BLA' THEN 'biologics_license_application' ELSE 'unclassified' END AS pathway,
 CAST(l_linenumber AS VARCHAR) AS submission_number, {case('ty', E.SUBMISSION_TYPE, 'unclassified')} AS submission_type_category, {case('cl', E.SUBMISSION_CLASS, 'unclassified')} AS submission_class_category, {case('ss', E.SUBMISSION_STATUS, 'unclassified')} AS submission_status_category
FROM (SELECT *, {_sqlpick(APPS, 'l_orderkey')} AS pre, {_sqlpick(TYPES, 'l_partkey')} AS ty, {_sqlpick(CLASSES, 'l_partkey')} AS cl, {_sqlpick(STATES, 'l_suppkey')} AS ss FROM lineitem)""")
def l05(spark, sf):
    """Applications as JSON, one per order, with one submission per line: the lines of one order are few, and are gathered before the JSON is written."""
    li = I.table(spark, sf, "lineitem")
    sub = F.struct(F.col("l_linenumber").cast("string").alias("submission_number"), _pick(TYPES, F.col("l_partkey")).alias("submission_type"), _pick(CLASSES, F.col("l_partkey")).alias("submission_class_code"),
                   _pick(STATES, F.col("l_suppkey")).alias("submission_status"), F.lit("20200101").alias("submission_status_date"))
    apps = li.groupBy("l_orderkey").agg(F.collect_list(sub).alias("submissions"))
    record = F.to_json(F.struct(F.concat(_pick(APPS, F.col("l_orderkey")), F.col("l_orderkey").cast("string")).alias("application_number"), F.lit("s").alias("sponsor_name"), "submissions"))
    return E.classify_applications(apps.select(record.alias("record"))).select("application_number", "pathway", "submission_number", "submission_type_category", "submission_class_category", "submission_status_category")


CODES = list(E.DECISION_510K) + list(E.DECISION_PMA) + ["DENG"]


@query("l06_device_records", f"""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'K' || p_partkey WHEN p_partkey % 3 = 0 THEN 'P' || p_partkey ELSE 'P' || p_partkey || '/S' || p_size END AS submission_id,
 CASE WHEN p_partkey % 2 = 0 THEN {case('code', E.DECISION_510K, 'unclassified')} ELSE {case('code', E.DECISION_PMA, 'unclassified')} END AS decision_category, {case('cls', E.DEVICE_CLASS)} AS device_class_text
FROM (SELECT *, {_sqlpick(CODES, 'p_partkey')} AS code, {_sqlpick(list(E.DEVICE_CLASS) + ['Z'], 'p_partkey')} AS cls FROM part)""")
def l06(spark, sf):
    k = F.col("p_partkey")
    p = I.table(spark, sf, "part").select("p_partkey", F.when(k % 2 == 0, "510k").otherwise("pma").alias("pathway"), F.concat(F.when(k % 2 == 0, "K").otherwise("P"), k.cast("string")).alias("number"),
                                          F.when(k % 3 != 0, F.concat(F.lit("S"), F.col("p_size").cast("string"))).alias("supplement_number"), _pick(CODES, k).alias("decision_code"), _pick(list(E.DEVICE_CLASS) + ["Z"], k).alias("device_class"))
    return E.classify_devices(p).select("p_partkey", "submission_id", "decision_category", "device_class_text")


@query("w19_first_disclosed", 'SELECT entity, tag, "end", accn, val FROM (SELECT *, row_number() OVER (PARTITION BY entity, tag, "end" ORDER BY filed, accn) AS rn FROM v_facts) WHERE rn = 1', ["v_facts"])
def w19(spark, sf):
    return E.first_disclosed(I.facts(spark, sf)).select("entity", "tag", "end", "accn", "val")


SURPRISE = """
SELECT a.*, c.val AS current_value, CASE WHEN c.val IS NOT NULL THEN p.val END AS prior_value, CASE WHEN c.val IS NULL THEN 'CURRENT_PERIOD_NOT_YET_KNOWN' WHEN p.val IS NULL THEN 'PRIOR_PERIOD_NOT_FOUND' WHEN p.val = 0 THEN 'PRIOR_PERIOD_ZERO' ELSE 'COMPUTED' END AS state,
 CASE WHEN c.val IS NOT NULL AND p.val <> 0 THEN round((c.val - p.val) / abs(p.val) * 100, 4) + 0.0 END AS surprise_pct
FROM {asks} a LEFT JOIN LATERAL (SELECT val FROM v_facts f WHERE f.entity = a.entity AND f."end" = a."end" AND f.filed <= a.known_by AND f."end" - f.start BETWEEN 80 AND 100 ORDER BY filed, accn LIMIT 1) c ON true
LEFT JOIN LATERAL (SELECT val FROM v_facts f WHERE f.entity = a.entity AND f.filed <= a.known_by AND f."end" - f.start BETWEEN 80 AND 100 AND abs(f."end" - (a."end" - 365)) <= 25 ORDER BY abs(f."end" - (a."end" - 365)), filed, accn LIMIT 1) p ON true"""


@query("l07_year_over_year", 'SELECT entity, "end", known_by, state, surprise_pct FROM (' + SURPRISE.format(asks='(SELECT DISTINCT entity, "end", "end" + k.k AS known_by FROM v_facts, (VALUES (10), (45)) k(k))') + ")", ["v_facts"])
def l07(spark, sf):
    f = I.facts(spark, sf)
    asks = f.select("entity", "tag", "end").distinct().withColumn("known_by", F.explode(F.array(F.date_add("end", 10), F.date_add("end", 45))))
    return E.yoy_surprise(asks, f).select("entity", "end", "known_by", "state", M.rounded("surprise_pct", 4).alias("surprise_pct"))


VIEWS["v_filing_surprise"] = (("v_facts",), SURPRISE.format(asks='(SELECT entity, accn, max("end") AS "end", max(filed) AS known_by FROM v_facts WHERE "end" - start BETWEEN 80 AND 100 GROUP BY 1, 2)'))


@query("l08_surprise_for_filing", 'SELECT entity, accn, "end", state, surprise_pct FROM v_filing_surprise', ["v_filing_surprise"])
def l08(spark, sf):
    return E.surprise_for_filing(I.facts(spark, sf)).select("entity", "accn", "end", "state", M.rounded("surprise_pct", 4).alias("surprise_pct"))


@query("l09_catalyst_features", f"""
SELECT i.order_no AS filing_id, i.co AS co_filed_items, coalesce(s.state, 'NOT_COMPUTED') AS surprise_state, CASE WHEN s.surprise_pct > 0 THEN 'positive' WHEN s.surprise_pct < 0 THEN 'negative' WHEN s.surprise_pct = 0 THEN 'flat' END AS surprise_direction FROM (
SELECT order_no, array_to_string(list_filter(items, lambda x: x <> '2.02'), ',') AS co FROM v_items WHERE list_contains(items, '2.02')) i
LEFT JOIN (SELECT *, row_number() OVER (ORDER BY entity, accn) * 3 AS fid FROM v_filing_surprise) s ON s.fid = i.order_no""", ["v_items", "v_filing_surprise"])
def l09(spark, sf):
    from tidemark.operators.ranking import positions
    items = E.classify_filings(filings(spark, sf)).withColumn("filing_id", F.col("order_no"))
    s = positions(E.surprise_for_filing(I.facts(spark, sf)), [F.asc("entity"), F.asc("accn")]).withColumn("filing_id", (F.col("position") + 1) * 3)
    return E.catalyst_features(items, s).select("filing_id", F.array_join("co_filed_items", ",").alias("co_filed_items"), "surprise_state", "surprise_direction")


@query("l10_comparable_revenue", """
SELECT entity, accn, CASE WHEN bad = 0 AND k = 1 THEN 'usable' ELSE 'unusable_revenue' END AS status, CASE WHEN bad = 0 AND k = 1 THEN round(cv / pv - 1, 8) + 0.0 END AS growth FROM (
SELECT entity, accn, count_if(NOT (nc = 1 AND np = 1) AND nc > 0 AND np > 0) AS bad, count(DISTINCT CASE WHEN nc = 1 AND np = 1 AND pv > 0 THEN {'a': cv, 'b': pv} END) AS k, max(CASE WHEN nc = 1 AND np = 1 AND pv > 0 THEN cv END) AS cv, max(CASE WHEN nc = 1 AND np = 1 AND pv > 0 THEN pv END) AS pv FROM (
 SELECT entity, accn, tag, count_if("end" = pe) AS nc, count_if(pe - "end" BETWEEN 340 AND 390) AS np, max(CASE WHEN "end" = pe THEN val END) AS cv, max(CASE WHEN pe - "end" BETWEEN 340 AND 390 THEN val END) AS pv FROM (
  SELECT DISTINCT f.entity, f.accn, t.tag, f.start, f."end", CASE WHEN t.tag = 'SalesRevenueNet' AND f.entity % 6 = 0 THEN f.val + 1 ELSE f.val END AS val, max(f."end") OVER (PARTITION BY f.entity, f.accn) AS pe
  FROM v_facts f, (VALUES ('Revenues'), ('SalesRevenueNet')) t(tag) WHERE f."end" - f.start + 1 BETWEEN 80 AND 100) GROUP BY 1, 2, 3) GROUP BY 1, 2)""", ["v_facts"])
def l10(spark, sf):
    f = I.facts(spark, sf)
    newest = f.groupBy("entity", "accn").agg(F.max("end").alias("period_end"))
    two = f.join(newest, ["entity", "accn"]).withColumn("tag", F.explode(F.array(F.lit("Revenues"), F.lit("SalesRevenueNet"))))
    two = two.withColumn("val", F.when((F.col("tag") == "SalesRevenueNet") & (F.col("entity") % 6 == 0), F.col("val") + 1).otherwise(F.col("val")))
    return E.revenue_growth(two).select("entity", "accn", "status", M.rounded("growth", 8).alias("growth"))


@query("j10_latest_filing_before", """
SELECT e.order_no AS event_id, b.accession FROM (SELECT order_no, cik_no, accepted_at AS published_at, accepted_at + INTERVAL 400 DAY AS deadline FROM v_filings WHERE form = '8-K') e
LEFT JOIN LATERAL (SELECT f.accession FROM v_filings f WHERE f.form = '10-Q' AND f.cik_no = e.cik_no AND f.accepted_at >= e.published_at AND f.accepted_at < e.deadline
 AND hour((f.accepted_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') * 60 + minute((f.accepted_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') < 1050
 AND greatest(f.accepted_at + INTERVAL 2 MINUTE, (CAST(f.filing_date AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') < e.deadline
 AND CAST((e.published_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) - (f.filing_date - 300) BETWEEN 0 AND 600
 ORDER BY f.filing_date - 300 DESC, greatest(f.accepted_at + INTERVAL 2 MINUTE, (CAST(f.filing_date AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'), f.accession LIMIT 1) b ON true""", ["v_filings"])
def j10(spark, sf):
    f = I.filings(spark, sf).withColumn("period_end", F.date_sub("filing_date", 300))
    e = f.filter("form = '8-K'").select(F.col("order_no").alias("event_id"), "cik_no", F.col("accepted_at").alias("published_at"), (F.col("accepted_at") + F.expr("interval 400 days")).alias("deadline"))
    return E.latest_filing_before(e, f.filter("form = '10-Q'"), "cik_no", I.ZONE, 600, bucket_days=30).select("event_id", "accession")


@query("j11_source_priority", """
SELECT order_no AS event_id, CASE WHEN order_no % 3 = 0 THEN 'wire' WHEN order_no % 4 = 0 THEN 'exhibit' WHEN order_no % 5 = 0 THEN 'filing' END AS source, CASE WHEN order_no % 3 = 0 THEN amount * 3 WHEN order_no % 4 = 0 THEN amount * 2 WHEN order_no % 5 = 0 THEN amount END AS value FROM v_filings""", ["v_filings"])
def j11(spark, sf):
    f = I.filings(spark, sf)
    src = lambda n, k: f.filter(F.col("order_no") % n == 0).select(F.col("order_no").alias("event_id"), (F.col("amount") * k).alias("value"))
    return E.prefer_sources(f.select(F.col("order_no").alias("event_id")), [("wire", src(3, 3)), ("exhibit", src(4, 2)), ("filing", src(5, 1))])


@query("l11_published_growth", """
SELECT order_no, CASE WHEN order_no % 3 = 0 AND amount > 0 THEN 'original_wire' WHEN order_no % 4 = 0 AND mins < 1050 THEN 'sec_earnings_exhibit' END AS source, CASE WHEN (order_no % 3 = 0 AND amount > 0) OR (order_no % 4 = 0 AND mins < 1050) THEN round(amount / (amount + 1000) - 1, 8) + 0.0 END AS growth
FROM (SELECT *, hour(l) * 60 + minute(l) AS mins FROM (SELECT *, (accepted_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM v_filings))""", ["v_filings"])
def l11(spark, sf):
    """Wire evidence first; else an exhibit whose filing was accepted in time on its day."""
    f = I.filings(spark, sf).withColumn("growth", M.growth("amount", F.col("amount") + 1000))
    wire = f.filter("order_no % 3 = 0").select("order_no", F.col("growth").alias("value"))
    exhibit = f.filter("order_no % 4 = 0").filter(T.filing_available("accepted_at", "filing_date", I.ZONE).isNotNull()).select("order_no", F.col("growth").alias("value"))
    out = E.prefer_sources(f.select("order_no"), [("original_wire", wire), ("sec_earnings_exhibit", exhibit)], key="order_no")
    return out.select("order_no", "source", M.rounded("value", 8).alias("growth"))


VIEWS["v_growth_evidence"] = (("v_filings",), """
SELECT *, accepted_at - INTERVAL 3 MINUTE AS published_at, CAST(((accepted_at - INTERVAL 3 MINUTE) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS pday, accepted_at + INTERVAL 6 HOUR AS deadline, hour(l) * 60 + minute(l) AS mins,
 greatest(accepted_at + INTERVAL 2 MINUTE, (filing_date::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS exhibit_at FROM (SELECT *, (accepted_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM v_filings)""")


@query("l11_growth_evidence", """
WITH p AS (SELECT *, filing_date - CAST(order_no % 140 AS INTEGER) AS period_end, filing_date - CAST(order_no % 140 AS INTEGER) - CAST(330 + order_no % 80 AS INTEGER) AS prior_end, CASE WHEN order_no % 19 = 0 THEN 0 ELSE 1000 END AS prior_usd FROM v_growth_evidence),
r AS (SELECT *, CASE WHEN NOT (pday - period_end BETWEEN 0 AND 110) THEN 'PERIOD_AGE' WHEN NOT (period_end - prior_end BETWEEN 340 AND 390) THEN 'PERIOD_DISTANCE' WHEN prior_usd <= 0 THEN 'INVALID_AMOUNTS' END AS pair FROM p)
SELECT source, coalesce(reason, 'usable') AS reason, count(*) AS n, round(sum(CASE WHEN reason IS NULL THEN (1000 + order_no % 500) / prior_usd - 1 END), 6) AS growth_sum FROM (
SELECT order_no, prior_usd, 'original_wire' AS source, CASE WHEN order_no % 11 = 0 THEN 'TIMESTAMP_MISMATCH' WHEN order_no % 13 = 0 THEN 'SOURCE_MISMATCH' WHEN order_no % 17 = 0 THEN 'NOT_AVAILABLE_IN_TIME' ELSE pair END AS reason FROM r WHERE order_no % 2 = 0
UNION ALL SELECT order_no, prior_usd, 'sec_earnings_exhibit', CASE WHEN form <> '8-K' OR order_no % 11 = 0 THEN 'IDENTITY_MISMATCH' WHEN order_no % 13 = 0 THEN 'TIMING_MISMATCH' WHEN order_no % 5 = 0 THEN 'COMPARISON_CAVEAT' WHEN mins >= 1050 OR exhibit_at >= deadline OR order_no % 17 = 0 THEN 'NOT_AVAILABLE_IN_TIME' ELSE pair END FROM r WHERE order_no % 2 = 1) GROUP BY 1, 2""", ["v_growth_evidence"])
def l11_evidence(spark, sf):
    """Wire evidence for even filings, exhibits for odd ones, with planted disagreements of every kind."""
    n, minutes = F.col("order_no"), lambda k: F.expr(f"interval {k} minutes")
    f = I.filings(spark, sf).withColumn("event_id", n).withColumn("published_at", F.col("accepted_at") - minutes(3)).withColumn("cutoff", F.col("accepted_at") + minutes(30)).withColumn("cik", F.lpad(F.col("cik_no").cast("string"), 10, "0"))
    f = f.withColumn("deadline", F.when(n % 17 == 0, F.col("published_at")).otherwise(F.col("accepted_at") + F.expr("interval 6 hours"))).withColumn("source_url", F.concat(F.lit("https://wire/"), n.cast("string")))
    events = f.select("event_id", "published_at", "cutoff", "source_url", "deadline", "accession", "cik")
    end = F.date_sub("filing_date", (n % 140).cast("int"))
    pair = [(1000 + n % 500).alias("current_usd"), F.when(n % 19 == 0, 0).otherwise(1000).alias("prior_usd"), end.alias("period_end"), F.date_sub(end, (330 + n % 80).cast("int")).alias("prior_end")]
    wire = f.filter("order_no % 2 = 0").select("event_id", F.when(n % 11 == 0, F.col("published_at") + minutes(1)).otherwise(F.col("published_at")).alias("published_at"), "cutoff", F.when(n % 13 == 0, "other").otherwise(F.col("source_url")).alias("source_url"), F.lit("GAAP").alias("basis"), *pair)
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik_no").cast("string"), F.lit("/"), F.replace(F.col("accession"), F.lit("-"), F.lit("")), F.lit("/ex991.htm"))
    exhibits = f.filter("order_no % 2 = 1").select("event_id", "accession", "cik", "form", F.when(n % 11 == 0, "10.1").otherwise("99.1").alias("exhibit"), F.lit("USD").alias("currency"), url.alias("release_url"),
                                                   F.when(n % 13 == 0, F.col("accepted_at") + minutes(1)).otherwise(F.col("accepted_at")).alias("accepted_at"), "filing_date", F.when(n % 5 == 0, "acquired business").alias("comparison_caveat"), *pair)
    out = E.wire_growth(wire, events, I.ZONE).unionByName(E.exhibit_growth(exhibits, events, f.select("accession", "form", "accepted_at", "filing_date"), I.ZONE))
    return out.groupBy("source", F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("growth"), 6).alias("growth_sum"))


@query("j14_evidence_agreement", """
SELECT event_id, CASE WHEN event_no % 10 = 0 THEN 'EVIDENCE_MISSING' WHEN event_no % 7 = 0 THEN 'DISAGREES' ELSE 'AGREES' END AS state, CASE WHEN event_no % 10 = 0 THEN NULL WHEN event_no % 7 = 0 THEN 'cutoff' ELSE '' END AS fields FROM v_news
UNION ALL SELECT 'X' || event_id, 'EVENT_MISSING', NULL FROM v_news WHERE event_no % 50 = 0""", ["v_news"])
def j14(spark, sf):
    n = I.news(spark, sf)
    ev = n.filter("event_no % 10 <> 0").select("event_id", "published_at", F.when(F.col("event_no") % 7 == 0, F.col("cutoff") + F.expr("interval 1 minute")).otherwise(F.col("cutoff")).alias("cutoff"))
    extra = n.filter("event_no % 50 = 0").select(F.concat(F.lit("X"), "event_id").alias("event_id"), "published_at", "cutoff")
    return E.join_evidence(n, ev.unionByName(extra))


@query("j15_sponsor_match", r"""
SELECT p_partkey, c.company FROM (SELECT p_partkey, trim(regexp_replace(lower(trim(p_name || ' Inc.')), '[,.]?\s*(inc|incorporated|corp|corporation|co|ltd|llc)\.?\s*$', '')) AS a FROM part) p
JOIN (SELECT company, trim(regexp_replace(lower(trim(company)), '[,.]?\s*(inc|incorporated|corp|corporation|co|ltd|llc)\.?\s*$', '')) AS b FROM (SELECT DISTINCT regexp_extract(p_name, '(\w+)$', 1) || ' Corporation' AS company FROM part)) c ON a = b OR contains(a, b) OR contains(b, a)""")
def j15(spark, sf):
    """Part names as sponsors against companies named after the last word of a part name."""
    p = I.table(spark, sf, "part")
    companies = p.select(F.concat(F.regexp_extract("p_name", r"(\w+)$", 1), F.lit(" Corporation")).alias("company")).distinct()
    records = p.select("p_partkey", F.concat("p_name", F.lit(" Inc.")).alias("name"))
    return E.match_names(records, companies, "name", "company").select("p_partkey", "company")


@query("j16_prefix_search", """
SELECT x.prefix, p.p_partkey FROM (SELECT DISTINCT p_name[1:4] || CASE WHEN p_partkey % 50 = 0 THEN 'zz' ELSE '' END AS prefix FROM part WHERE p_partkey % 10 = 0) x LEFT JOIN part p ON starts_with(lower(p.p_name), lower(x.prefix))""")
def j16(spark, sf):
    p = I.table(spark, sf, "part")
    pre = p.filter("p_partkey % 10 = 0").select(F.concat(F.substring("p_name", 1, 4), F.when(F.col("p_partkey") % 50 == 0, "zz").otherwise("")).alias("prefix")).distinct()
    return E.prefix_join(p.select("p_partkey", F.col("p_name").alias("name")), pre).select("prefix", "p_partkey")


@query("j17_near_date_exclusion", """
SELECT symbol, session, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 20 = 0 AND o.o_custkey = s.symbol AND abs(CAST(o.o_orderdate AS DATE) - s.session) <= 5) AS excluded FROM (SELECT DISTINCT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS session FROM orders) s""")
def j17(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("session"))
    return E.exclude_near(o.select("symbol", "session").distinct(), o.filter("o_orderkey % 20 = 0").select("symbol", F.col("session").alias("date")), 5)


@query("j19_source_tagging", """
SELECT event_id, CASE WHEN event_no % 17 = 0 THEN 0 WHEN event_no % 13 = 0 THEN 2 ELSE 1 END AS n_sources, CASE WHEN event_no % 17 = 0 THEN 'NO_SOURCE' WHEN event_no % 13 = 0 THEN 'SEVERAL_SOURCES' ELSE 'TAGGED' END AS state,
 CASE WHEN event_no % 17 <> 0 AND event_no % 13 <> 0 THEN category END AS source FROM v_news""", ["v_news"])
def j19(spark, sf):
    n = I.news(spark, sf)
    specs = n.filter("event_no % 17 <> 0").select("event_id", F.col("category").alias("source")).unionByName(n.filter("event_no % 17 <> 0 and event_no % 13 = 0").select("event_id", F.lit("other").alias("source")))
    return E.tag_source(n, specs).select("event_id", F.col("n_sources").cast("bigint").alias("n_sources"), "state", "source")


@query("a09_exchange_issuers", """
SELECT lpad(CAST(cik_no AS VARCHAR), 10, '0') AS cik, array_to_string(list_sort(list_distinct(list(ticker))), ',') AS tickers, array_to_string(list_sort(list_distinct(list(exchange))), ',') AS exchanges, min(name) AS name FROM (
SELECT o_custkey AS cik_no, 'T' || o_orderkey % 4 AS ticker, CASE o_orderkey % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' ELSE 'OTC' END AS exchange, o_orderpriority AS name FROM orders) WHERE exchange IN ('NYSE', 'NASDAQ') GROUP BY 1""")
def a09(spark, sf):
    k = F.col("o_orderkey")
    o = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("cik_no"), F.concat(F.lit("T"), (k % 4).cast("string")).alias("ticker"), _pick(["NYSE", "NASDAQ", "OTC"], k).alias("exchange"), F.col("o_orderpriority").alias("name"))
    return E.issuers_by_exchange(o, ["NYSE", "NASDAQ"]).select("cik", F.array_join("tickers", ",").alias("tickers"), F.array_join("exchanges", ",").alias("exchanges"), "name")


@query("a10_historical_issuer_pool", """
SELECT cik, count(*) AS filings, count_if(conflict) AS conflicts, min(name) AS first_name, count(DISTINCT name) AS n_names, max(accession) AS last_accession FROM (
SELECT o_custkey AS cik, o_orderkey // 2 AS accession, count(DISTINCT o_orderpriority) > 1 AS conflict, min(o_orderpriority) AS name FROM orders GROUP BY 1, 2) GROUP BY 1""")
def a10(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("cik"), F.floor(F.col("o_orderkey") / 2).alias("accession"), F.col("o_orderpriority").alias("name"))
    return E.issuer_pool(o)


@query("u01_merge_bundles", """
SELECT k AS security_id, max(v) - min(v) > 0 AS conflict, count(*) AS copies FROM (SELECT o_custkey AS k, 0 AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1""")
def u01(spark, sf):
    o = I.table(spark, sf, "orders")
    a = o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("security_id"), F.lit(0).alias("terms"))
    b = o.filter("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("security_id"), F.when(F.col("o_custkey") % 9 == 0, 1).otherwise(0).alias("terms"))
    return U.merge_bundles([{"securities": a}, {"securities": b}], {"securities": "security_id"})["securities"].select("security_id", "conflict", "copies")


@query("u02_union_conflict_check", """
SELECT accession, count(DISTINCT amount) > 1 AS conflict, count(*) AS copies FROM (SELECT accession, amount FROM v_filings WHERE order_no % 3 <> 0 UNION ALL SELECT accession, CASE WHEN order_no % 10 = 0 THEN amount + 1 ELSE amount END FROM v_filings WHERE order_no % 2 = 0) GROUP BY 1""", ["v_filings"])
def u02(spark, sf):
    f = I.filings(spark, sf)
    b = f.filter("order_no % 2 = 0").select("accession", F.when(F.col("order_no") % 10 == 0, F.col("amount") + 1).otherwise(F.col("amount")).alias("amount"))
    return U.union_no_conflict([f.filter("order_no % 3 <> 0").select("accession", "amount"), b], "accession").select("accession", "conflict", "copies")


@query("u03_reconcile", """
SELECT cik_no, count_if(a AND b) AS shared, count_if(a AND NOT b) AS missing, count_if(NOT a AND b) AS extra, CASE WHEN count_if(a <> b) = 0 THEN 'MATCHED' ELSE 'REVIEW_REQUIRED' END AS state FROM (SELECT cik_no, order_no % 40 <> 0 AS a, order_no % 41 <> 0 AS b FROM v_filings) WHERE a OR b GROUP BY 1""", ["v_filings"])
def u03(spark, sf):
    f = I.filings(spark, sf)
    return U.reconcile(f.filter("order_no % 40 <> 0"), f.filter("order_no % 41 <> 0"), "order_no", "cik_no")  # accessions hold six digits of the number and repeat beyond a million orders


@query("u04_candidate_accounting", """
SELECT candidate_id, event_id, state FROM (SELECT 'C' || event_no AS candidate_id, CASE WHEN event_no % 5 = 0 THEN NULL WHEN event_no % 13 = 0 THEN 'missing' ELSE event_id END AS event_id,
 CASE WHEN event_no % 5 = 0 THEN CASE WHEN event_no % 2 = 0 THEN 'ACCOUNTED' ELSE 'INVALID' END WHEN event_no % 13 = 0 THEN 'INVALID' ELSE 'REPRESENTED' END AS state FROM v_news)
UNION ALL SELECT NULL, event_id, 'EVENT_WITHOUT_CANDIDATE' FROM v_news WHERE event_no % 5 = 0 OR event_no % 13 = 0""", ["v_news"])
def u04(spark, sf):
    n = I.news(spark, sf)
    k = F.col("event_no")
    ledger = n.select(F.concat(F.lit("C"), k.cast("string")).alias("candidate_id"), F.when(k % 5 == 0, None).when(k % 13 == 0, "missing").otherwise(F.col("event_id")).alias("event_id"),
                      F.when(k % 5 == 0, "excluded").otherwise("included").alias("disposition"), F.when((k % 5 == 0) & (k % 2 == 0), "why").alias("reason"))
    return U.account_candidates(ledger, n)


@query("u05_sets_equal", "SELECT CAST(count_if(o_orderkey % 100 = 0) AS BIGINT) AS only_left, CAST(count_if(o_orderkey % 150 = 7) AS BIGINT) AS only_right FROM orders WHERE NOT (o_orderkey % 100 = 0 AND o_orderkey % 150 = 7)")
def u05(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return U.sets_equal(o.filter("o_orderkey % 150 <> 7"), o.filter("o_orderkey % 100 <> 0"))


@query("u06_needed_ranges", """
SELECT r.cik_no, r.y FROM (SELECT cik_no, year(filing_date) AS y, min(filing_date) AS range_from, max(filing_date) AS range_to FROM v_filings GROUP BY 1, 2) r
JOIN (SELECT cik_no, min(filing_date) FILTER (filing_date >= DATE '1999-01-01') AS recent_first FROM v_filings GROUP BY 1) m USING (cik_no) WHERE (recent_first IS NULL OR recent_first > DATE '1999-02-15') AND range_to >= DATE '1999-02-15'""", ["v_filings"])
def u06(spark, sf):
    f = I.filings(spark, sf)
    files = f.groupBy("cik_no", F.year("filing_date").cast("bigint").alias("y")).agg(F.min("filing_date").alias("range_from"), F.max("filing_date").alias("range_to"))
    recent = f.groupBy("cik_no").agg(F.min(F.when(F.col("filing_date") >= F.lit("1999-01-01").cast("date"), F.col("filing_date"))).alias("recent_first"))
    return U.needed_ranges(files, recent, "1999-02-15", "cik_no").select("cik_no", "y")


@query("u07_connected_partitions", """
WITH RECURSIVE d AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) || '-' || o_orderkey % 97 AS s, CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 2 WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 1 ELSE 0 END AS part FROM orders),
e AS (SELECT DISTINCT a.c AS a, b.c AS b FROM d a JOIN d b USING (s)), reach(a, b) AS (SELECT c, c FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
best AS (SELECT r.a AS c, max(m.part) AS part FROM reach r JOIN (SELECT c, max(part) AS part FROM d GROUP BY 1) m ON m.c = r.b GROUP BY 1)
SELECT best.part, count(*) AS n FROM d JOIN best USING (c) GROUP BY 1""")
def u07(spark, sf):
    """Orders as events: clusters by customer, sessions by day; whole clusters and sessions end in one partition."""
    o = I.table(spark, sf, "orders")
    d = o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("cluster_id"), F.concat_ws("-", F.to_date("o_orderdate").cast("string"), (F.col("o_orderkey") % 97).cast("string")).alias("reaction_session"),
                 F.when(F.col("o_orderdate") >= I.ts("2001-01-01 00:00:00"), 2).when(F.col("o_orderdate") >= I.ts("2000-01-01 00:00:00"), 1).otherwise(0).alias("part"))
    return U.connected_partitions(d).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("o01_hash_sample", """
SELECT cik, k AS selection_key FROM (SELECT cik, sha256('seed-1|' || cik) AS k FROM (SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik FROM orders) WHERE cik NOT IN (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') FROM orders WHERE o_orderkey % 100 = 0)) ORDER BY k, cik LIMIT 50""")
def o01(spark, sf):
    o = I.table(spark, sf, "orders").select(T.pad_cik("o_custkey").alias("cik"), "o_orderkey")
    return U.hash_sample(o.select("cik").distinct(), "cik", "seed-1", 50, o.filter("o_orderkey % 100 = 0")).select("cik", "selection_key")


@query("o02_batch_boundary", """
SELECT min(p) AS stop_position, CAST(min(c) AS BIGINT) AS cum_candidates, CAST(min(i) AS BIGINT) AS cum_issuers FROM (SELECT p, c, i FROM (SELECT row_number() OVER w AS p, sum(candidates) OVER w AS c, count_if(candidates > 0) OVER w AS i FROM
(SELECT o_custkey, sha256('s|' || o_custkey) AS k, count_if(o_orderpriority = '1-URGENT') AS candidates FROM orders GROUP BY 1) WINDOW w AS (ORDER BY k, o_custkey ROWS UNBOUNDED PRECEDING)) WHERE p % 10 = 0 AND c >= 60 AND i >= 40 ORDER BY p LIMIT 1)""")
def o02(spark, sf):
    g = I.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("candidates"))
    g = g.withColumn("k", F.sha2(F.concat_ws("|", F.lit("s"), F.col("o_custkey").cast("string")), 256))
    return U.freeze_at_boundary(g, [F.asc("k"), F.asc("o_custkey")], 10, 60, 40)
