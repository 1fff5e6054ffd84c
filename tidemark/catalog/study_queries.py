"""Registered queries: as-of joins, cluster windows, grouped base rates and analogues."""
from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.catalog.label_queries import outcomes
from tidemark.catalog.oracle_views import VIEWS
from tidemark.catalog.registry import query
from tidemark.functions.numeric import effective_n
from tidemark.operators import asof as A, sessions as cal
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.validate import FORWARD, HISTORICAL
from tidemark.plans import analogues as N, cells as C, outcomes as L
from tidemark.runtime import cut_lineage, literal_table, shared_table

CELLS_AS_OF = "2024-01-25 00:00:00"

VIEWS["v_events"] = (("v_outcomes",), """
SELECT * FROM (SELECT event_id, event_no, cluster_id, cik, sic, security_id, timing, reaction_idx, reaction_session, cutoff, category, published_at, reaction_open, open, high, low, close, anchor_close, why_2, why_5, why_10, why_20, close_5,
  CASE WHEN g BETWEEN 1 AND 9 THEN 'A' WHEN g BETWEEN 10 AND 14 THEN 'B' WHEN g BETWEEN 15 AND 17 THEN 'C' WHEN g BETWEEN 20 AND 39 THEN 'D' WHEN g BETWEEN 40 AND 49 THEN 'E' WHEN g BETWEEN 50 AND 51 THEN 'F'
   WHEN g BETWEEN 52 AND 59 THEN 'G' WHEN g BETWEEN 60 AND 67 THEN 'H' WHEN g BETWEEN 70 AND 89 THEN 'I' WHEN g BETWEEN 91 AND 99 THEN 'J' END AS sic_division, sic[1:2] AS sic_major_group
 FROM (SELECT *, CAST(sic[1:2] AS INTEGER) AS g FROM v_outcomes WHERE state = 'MAPPED')) WHERE sic_division IS NOT NULL""")
VIEWS["v_lab"] = (("v_labels", "v_events"), """
SELECT e.*, l.label, l.kind, l.num, l.flag, l.reason, l.n AS n_sessions, s.close_utc + INTERVAL 1 MINUTE AS matures_at
FROM v_labels l JOIN v_events e USING (event_id) LEFT JOIN v_sessions s ON s.idx = e.reaction_idx + l.n - 1""")


def study_events(spark, sf):
    """Mapped events with timing, sector and label inputs; events whose SIC belongs to no division are quarantined by `C.sector_quarantine`."""
    return shared_table(spark, ("events", sf), lambda: C.sector_quarantine(outcomes(spark, sf).filter("state = 'MAPPED'"))[0])


@query("v09_sector_quarantine", """
SELECT coalesce(reason, 'KEPT') AS reason, count(*) AS events FROM (SELECT CASE WHEN sic IS NULL OR NOT regexp_matches(sic, '^[0-9]{4}$') THEN 'MALFORMED_SIC' WHEN NOT (g BETWEEN 1 AND 9 OR g BETWEEN 10 AND 17 OR g BETWEEN 20 AND 67 OR g BETWEEN 70 AND 89 OR g BETWEEN 91 AND 99) THEN 'UNKNOWN_SIC_DIVISION' END AS reason
FROM (SELECT sic, TRY_CAST(sic[1:2] AS INTEGER) AS g FROM v_outcomes WHERE state = 'MAPPED')) GROUP BY 1""", ["v_outcomes"])
def v09_sectors(spark, sf):
    kept, refused = C.sector_quarantine(outcomes(spark, sf).filter("state = 'MAPPED'"))
    return kept.select(F.lit("KEPT").alias("reason")).unionByName(refused.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("events"))


KEEP = ("event_id", "event_no", "cluster_id", "cik", "sic", "security_id", "timing", "reaction_idx", "reaction_session", "cutoff", "category", "sic_division", "sic_major_group")


def study_labels(spark, sf):
    """The long label table with the instant each label, present or absent, is first known."""
    return shared_table(spark, ("labels", sf), lambda: build_labels(spark, sf))


def build_labels(spark, sf):
    rows = L.label_rows(study_events(spark, sf), keep=KEEP)
    return cal.label_available(rows.drop("label_available_at"), I.calendar(spark), "reaction_idx", F.col("n_sessions")).withColumnRenamed("label_available_at", "matures_at")


ASOF_SQL = """
SELECT security_id, name, epoch_us(cutoff) AS cutoff, arg_max(revision_id, {{'a': known, 'r': revision_id}}) AS revision_id, arg_max(value, {{'a': known, 'r': revision_id}}) AS value FROM (
SELECT q.security_id, q.cutoff, f.name, f.revision_id, f.value, {known} AS known, f.valid_from, f.valid_to, f.label_available_at
FROM (SELECT DISTINCT security_id, cutoff FROM v_news) q JOIN v_features f USING (security_id))
WHERE known <= cutoff AND valid_from <= cutoff AND (valid_to IS NULL OR cutoff < valid_to) AND (label_available_at IS NULL OR label_available_at <= cutoff) GROUP BY ALL"""


def asof_view(df):
    return df.select("security_id", "name", F.unix_micros("cutoff").alias("cutoff"), "revision_id", "value")


@query("j01_asof_features", ASOF_SQL.format(known="f.available_at"), ["v_news", "v_features"])
def j01(spark, sf):
    return asof_view(A.asof_features(I.news(spark, sf), I.features(spark, sf), HISTORICAL))


@query("j01_asof_features_forward", ASOF_SQL.format(known="greatest(f.available_at, f.first_seen_at)"), ["v_news", "v_features"])
def j01_forward(spark, sf):
    return asof_view(A.asof_features(I.news(spark, sf), I.features(spark, sf), FORWARD))


@query("w01_latest_revision", """
SELECT security_id, name, revision_id, value FROM (SELECT *, row_number() OVER (PARTITION BY security_id, name ORDER BY available_at DESC, revision_id DESC) AS rn FROM v_features) WHERE rn = 1""", ["v_features"])
def w01(spark, sf):
    return A.latest_revision(I.features(spark, sf), ["security_id", "name"]).select("security_id", "name", "revision_id", "value")


@query("w02_dedupe_clusters", "SELECT cluster_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cutoff, event_id) AS rn FROM v_news) WHERE rn = 1", ["v_news"])
def w02(spark, sf):
    return A.dedupe_clusters(I.news(spark, sf)).select("cluster_id", "event_id")


@query("a02_group_cells", """
SELECT level, key, parent_level, parent_key, count(*) AS n FROM v_events e, LATERAL (VALUES ('all', 'all_news', NULL, NULL), ('timing', timing, 'all', 'all_news'), ('sic_division', sic_division, 'all', 'all_news'),
 ('sic_major_group', sic_major_group, 'sic_division', sic_division), ('issuer', cik, 'sic_major_group', sic_major_group)) c(level, key, parent_level, parent_key) GROUP BY ALL""", ["v_events"])
def a02(spark, sf):
    return C.group_cells(study_events(spark, sf)).groupBy("level", "key", "parent_level", "parent_key").agg(F.count(F.lit(1)).alias("n"))


VIEWS["v_cells"] = (("v_lab",), f"""
SELECT d.*, c.* FROM (SELECT * FROM v_lab QUALIFY row_number() OVER (PARTITION BY label, cluster_id ORDER BY cutoff, event_id) = 1) d,
LATERAL (VALUES ('all', 'all_news', NULL, NULL), ('timing', timing, 'all', 'all_news'), ('sic_division', sic_division, 'all', 'all_news'),
 ('sic_major_group', sic_major_group, 'sic_division', sic_division), ('issuer', cik, 'sic_major_group', sic_major_group)) c(level, key, parent_level, parent_key)
WHERE matures_at <= TIMESTAMP '{CELLS_AS_OF}'""")
Z95 = 1.959963984540054
WILSON = f"""round(greatest(0.0, ((k / n + {Z95} * {Z95} / (2 * n)) - {Z95} * sqrt(k / n * (1 - k / n) / n + {Z95} * {Z95} / (4.0 * n * n))) / (1 + {Z95} * {Z95} / n)), 10) AS wilson_low,
 round(least(1.0, ((k / n + {Z95} * {Z95} / (2 * n)) + {Z95} * sqrt(k / n * (1 - k / n) / n + {Z95} * {Z95} / (4.0 * n * n))) / (1 + {Z95} * {Z95} / n)), 10) AS wilson_high"""
VIEWS["v_stats"] = (("v_cells",), f"""
SELECT *, CASE WHEN kind = 'boolean' THEN CASE WHEN gate_n < 5 THEN 'WITHHELD' WHEN gate_n < 10 THEN 'REPORTED_UNRELIABLE' ELSE 'REPORTED' END
  ELSE CASE WHEN gate_n < 10 THEN 'WITHHELD' WHEN gate_n < 20 THEN 'REPORTED_UNRELIABLE' ELSE 'REPORTED' END END AS state,
 CASE WHEN kind = 'boolean' THEN CASE WHEN gate_n >= 5 THEN round(k / n, 10) END ELSE CASE WHEN gate_n >= 10 THEN round(total / n, 10) + 0.0 END END AS value FROM (
SELECT level, key, parent_level, parent_key, label, kind, count_if(reason IS NULL) AS n, count_if(reason IS NOT NULL) AS n_absent, count(DISTINCT CASE WHEN reason IS NULL THEN cluster_id END) AS gate_n,
 CAST(coalesce(count_if(flag), 0) AS BIGINT) AS k, sum(num) AS total FROM v_cells GROUP BY ALL)""")


def matured_cells(spark, sf):
    return C.group_cells(A.dedupe_clusters(study_labels(spark, sf), by=("label",)))


@query("a03_cell_stats", """
SELECT level, key, label, n, n_absent, gate_n, k, round(CASE WHEN kind = 'boolean' THEN k ELSE total END / nullif(n, 0), 8) + 0.0 AS raw FROM v_stats""", ["v_stats"])
def a03(spark, sf):
    s = C.cell_stats(matured_cells(spark, sf), I.ts(CELLS_AS_OF))
    return s.select("level", "key", "label", "n", "n_absent", "gate_n", "k", (F.round("raw", 8) + 0.0).alias("raw"))


@query("a03_absent_reasons", "SELECT level, key, label, reason, count(*) AS n FROM v_cells WHERE reason IS NOT NULL GROUP BY ALL", ["v_cells"])
def a03_reasons(spark, sf):
    return C.absent_reasons(matured_cells(spark, sf), I.ts(CELLS_AS_OF))


@query("a03_cell_counts", """
SELECT level, key, count(*) AS events, count(DISTINCT cik) AS issuers, count(DISTINCT reaction_idx) AS reaction_sessions FROM v_cells WHERE label = 'day1_close_return' GROUP BY ALL""", ["v_cells"])
def a03_counts(spark, sf):
    one = A.dedupe_clusters(study_labels(spark, sf).filter("label = 'day1_close_return'"))
    return C.cell_counts(one, I.ts(CELLS_AS_OF))


@query("a04_wilson", f"SELECT level, key, label, k, n, {WILSON} FROM v_stats WHERE kind = 'boolean' AND n > 0", ["v_stats"])
def a04(spark, sf):
    s = C.cell_stats(matured_cells(spark, sf), I.ts(CELLS_AS_OF)).filter("kind = 'boolean' and n > 0")
    return s.select("level", "key", "label", "k", "n", F.round("wilson_low", 10).alias("wilson_low"), F.round("wilson_high", 10).alias("wilson_high"))


@query("a05_exact_quantiles", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
 round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1, 2""")
def a05(spark, sf):
    levels = C.POLICY["levels"]
    q = exact_quantiles(I.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", levels)
    return q.select("l_returnflag", "l_linestatus", "n", *[F.round(F.element_at("q", i + 1), 6).alias(f"p{int(p * 100)}") for i, p in enumerate(levels)])


@query("a05_cell_quantiles", """
SELECT level, key, label, count(DISTINCT cluster_id) AS gate_n, CASE WHEN count(DISTINCT cluster_id) >= 10 THEN round(quantile_cont(num, 0.5), 10) + 0.0 END AS median,
 CASE WHEN count(DISTINCT cluster_id) >= 20 THEN round(quantile_cont(num, 0.1), 10) + 0.0 END AS p10, CASE WHEN count(DISTINCT cluster_id) >= 20 THEN round(quantile_cont(num, 0.25), 10) + 0.0 END AS p25,
 CASE WHEN count(DISTINCT cluster_id) >= 20 THEN round(quantile_cont(num, 0.5), 10) + 0.0 END AS p50, CASE WHEN count(DISTINCT cluster_id) >= 20 THEN round(quantile_cont(num, 0.75), 10) + 0.0 END AS p75,
 CASE WHEN count(DISTINCT cluster_id) >= 20 THEN round(quantile_cont(num, 0.9), 10) + 0.0 END AS p90 FROM v_cells WHERE num IS NOT NULL GROUP BY ALL""", ["v_cells"])
def a05_cells(spark, sf):
    labels = cut_lineage(A.dedupe_clusters(study_labels(spark, sf).filter("kind = 'return'"), by=("label",)))  # read several times below
    return C.cell_quantiles(C.group_cells(labels), I.ts(CELLS_AS_OF))


@query("a06_gate_by_session", "SELECT level, key, label, count(DISTINCT reaction_idx) AS gate_n FROM v_cells WHERE reason IS NULL GROUP BY ALL", ["v_cells"])
def a06(spark, sf):
    policy = dict(C.POLICY, count_unit="reaction_session")
    return C.cell_stats(matured_cells(spark, sf), I.ts(CELLS_AS_OF), policy).filter("n > 0").select("level", "key", "label", "gate_n")


@query("a07_suppression", "SELECT level, key, label, gate_n, state, value FROM v_stats", ["v_stats"])
def a07(spark, sf):
    return C.suppress(C.cell_stats(matured_cells(spark, sf), I.ts(CELLS_AS_OF))).select("level", "key", "label", "gate_n", "state", "value")


POOL = """
WITH p0 AS (SELECT *, CAST(NULL AS DOUBLE) AS pooled, CAST(NULL AS VARCHAR) AS toward, value AS pv, CASE WHEN value IS NOT NULL THEN 'all' END AS pl FROM {stats} WHERE level = 'all'),
{steps}
SELECT {cols} FROM (SELECT * FROM p0 UNION ALL BY NAME SELECT * FROM p1 UNION ALL BY NAME SELECT * FROM p2 UNION ALL BY NAME SELECT * FROM p3)"""


def pool_sql(stats, by, cols):
    def step(i, level_filter, parent):
        on = " AND ".join(["u.key = s.parent_key", "u.label = s.label", "u.level = s.parent_level"] + [f"u.{b} = s.{b}" for b in by])
        return f"""p{i} AS (SELECT *, coalesce(pooled, value, prior) AS pv, CASE WHEN value IS NOT NULL THEN level ELSE up END AS pl FROM (
 SELECT *, CASE WHEN value IS NOT NULL AND prior IS NOT NULL THEN CAST(round(CAST(CAST((n * value + 10 * prior) / (n + 10) AS VARCHAR) AS DECIMAL(38, 18)), 10) AS DOUBLE) + 0.0 END AS pooled, CASE WHEN value IS NOT NULL AND prior IS NOT NULL THEN up END AS toward FROM (
 SELECT s.*, u.pv AS prior, u.pl AS up FROM {stats} s LEFT JOIN {parent} u ON {on} WHERE {level_filter})))"""
    steps = ",\n".join([step(1, "s.level IN ('timing', 'sic_division')", "p0"), step(2, "s.level = 'sic_major_group'", "p1"), step(3, "s.level = 'issuer'", "p2")])
    return POOL.format(stats=stats, steps=steps, cols=cols)


@query("a08_partial_pooling", pool_sql("v_stats", [], "level, key, label, n, state, value, pooled, toward, CASE WHEN pooled IS NOT NULL THEN round(n / (n + 10), 10) END AS weight_on_cell"), ["v_stats"])
def a08(spark, sf):
    t = C.partial_pool(C.suppress(C.cell_stats(matured_cells(spark, sf), I.ts(CELLS_AS_OF))))
    return t.select("level", "key", "label", "n", "state", "value", "pooled", "toward", "weight_on_cell")


@query("l12_fingerprint_table", pool_sql("v_stats", [], "level, key, parent_level, parent_key, label, n, n_absent, gate_n, k, state, value, pooled"), ["v_stats"])
def l12(spark, sf):
    t = C.fingerprint_table(study_labels(spark, sf), I.ts(CELLS_AS_OF))
    return t.select("level", "key", "parent_level", "parent_key", "label", "n", "n_absent", "gate_n", "k", "state", "value", "pooled")


VIEWS["v_tstats"] = (("v_lab",), """
SELECT *, n AS gate_n, CASE WHEN kind = 'boolean' THEN CASE WHEN n >= 5 THEN round(k / n, 10) END ELSE CASE WHEN n >= 10 THEN round(total / n, 10) + 0.0 END END AS value FROM (
SELECT t.event_id, t.level, t.key, t.parent_level, t.parent_key, x.label, x.kind, count_if(d.event_id IS NOT NULL AND d.reason IS NULL) AS n, count_if(d.event_id IS NOT NULL AND d.reason IS NOT NULL) AS n_absent,
 CAST(coalesce(count_if(d.flag), 0) AS BIGINT) AS k, coalesce(sum(d.num), 0) AS total
FROM (SELECT e.*, c.* FROM v_events e, LATERAL (VALUES ('all', 'all_news', NULL, NULL), ('timing', timing, 'all', 'all_news'), ('sic_division', sic_division, 'all', 'all_news'),
 ('sic_major_group', sic_major_group, 'sic_division', sic_division), ('issuer', cik, 'sic_major_group', sic_major_group)) c(level, key, parent_level, parent_key)) t
CROSS JOIN (SELECT DISTINCT label, kind FROM v_lab) x
LEFT JOIN (SELECT * FROM v_lab QUALIFY row_number() OVER (PARTITION BY label, cluster_id ORDER BY cutoff, event_id) = 1) d
 ON d.label = x.label AND d.cluster_id <> t.cluster_id AND d.matures_at <= t.cutoff AND CASE t.level WHEN 'all' THEN true WHEN 'timing' THEN d.timing = t.timing WHEN 'sic_division' THEN d.sic_division = t.sic_division
  WHEN 'sic_major_group' THEN d.sic_major_group = t.sic_major_group ELSE d.cik = t.cik END GROUP BY ALL)""")


@query("l13_target_fingerprint", pool_sql("v_tstats", ["event_id"], "event_id, level, key, label, n, n_absent, k, value, pooled"), ["v_tstats"])
def l13(spark, sf):
    labels = study_labels(spark, sf)
    targets = labels.filter("label = 'day1_close_return'").select("event_id", "cluster_id", "timing", "sic_division", "sic_major_group", "cik", "cutoff")
    t = C.target_fingerprint(targets, labels)
    return t.select("event_id", "level", "key", "label", "n", "n_absent", "k", "value", "pooled")


VIEWS["v_pairs"] = (("v_lab",), """
SELECT *, CASE WHEN x IS NULL AND row_number() OVER (PARTITION BY target, label, x IS NULL, cluster_id ORDER BY cutoff, event_id) > 1 THEN 'CLUSTER_ALREADY_COUNTED' ELSE x END AS x1 FROM (
SELECT t.event_id AS target, e.label, e.event_id, e.cluster_id, e.cutoff, e.kind, e.num, e.flag, e.cik, e.reaction_idx,
 CASE WHEN e.event_id = t.event_id THEN 'SELF' WHEN e.cluster_id = t.cluster_id THEN 'SAME_CLUSTER' WHEN e.matures_at IS NULL OR e.matures_at > t.cutoff THEN 'LABEL_NOT_YET_MATURED' WHEN e.reason IS NOT NULL THEN 'LABEL_ABSENT' END AS x,
 CASE WHEN e.timing = t.timing THEN 0.0 ELSE 1.0 END + CASE WHEN e.sic_major_group = t.sic_major_group THEN 0.0 WHEN e.sic_division = t.sic_division THEN 0.5 ELSE 1.0 END AS distance
FROM v_events t JOIN v_lab e ON true)""")
VIEWS["v_pool"] = (("v_pairs",), """
SELECT *, CASE WHEN n0 >= 10 THEN n0 WHEN n5 >= 10 THEN n5 ELSE n1 END AS members, CASE WHEN n0 >= 10 THEN 0.0 WHEN n5 >= 10 THEN 0.5 WHEN n1 >= 10 THEN 1.0 ELSE far END AS distance_reached,
 CASE WHEN n1 >= 10 THEN 'ANALOGUES_FOUND' ELSE 'INSUFFICIENT_ANALOGUES' END AS state FROM (
SELECT target, label, count_if(x1 IS NULL) AS eligible, count_if(x1 IS NULL AND distance <= 0) AS n0, count_if(x1 IS NULL AND distance <= 0.5) AS n5, count_if(x1 IS NULL AND distance <= 1) AS n1,
 max(CASE WHEN x1 IS NULL AND distance <= 1 THEN distance END) AS far, count_if(x1 = 'SAME_CLUSTER') AS same_cluster, count_if(x1 = 'LABEL_NOT_YET_MATURED') AS not_yet_matured, count_if(x1 = 'LABEL_ABSENT') AS label_absent,
 count_if(x1 = 'CLUSTER_ALREADY_COUNTED') AS cluster_already_counted FROM v_pairs GROUP BY 1, 2)""")


def pool(spark, sf):
    return N.pool_table(study_labels(spark, sf))


@query("j09_analogue_candidates", """
SELECT target AS event_id, label, eligible, same_cluster, not_yet_matured, label_absent, cluster_already_counted, eligible - n1 AS beyond_max_distance, n1 - members AS beyond_expansion FROM v_pool""", ["v_pool"])
def j09(spark, sf):
    return pool(spark, sf).select("event_id", "label", "eligible", "same_cluster", "not_yet_matured", "label_absent", "cluster_already_counted", "beyond_max_distance", "beyond_expansion")


@query("w04_nearest_level_expansion", "SELECT target AS event_id, label, CAST(distance_reached AS DOUBLE) AS distance_reached, members, state FROM v_pool", ["v_pool"])
def w04(spark, sf):
    return pool(spark, sf).select("event_id", "label", "distance_reached", "members", "state")


@query("a24_pool_report", """
SELECT label, count(*) AS targets, count_if(eligible >= 5) AS with_5_or_more, count_if(eligible >= 10) AS with_10_or_more, count_if(eligible >= 20) AS with_20_or_more, count_if(eligible = 0) AS with_none,
 count_if(state = 'ANALOGUES_FOUND') AS analogues_found FROM v_pool GROUP BY 1""", ["v_pool"])
def a24(spark, sf):
    return N.pool_report(pool(spark, sf))


@query("l14_members_of_all", """
SELECT p.target AS target_id, p.label, q.state, count(*) AS members, CAST(q.distance_reached AS DOUBLE) AS distance_reached, min(p.event_id) AS first_event, max(p.event_id) AS last_event, count_if(p.distance = 0) AS nearest, round(coalesce(sum(p.num), 0), 6) + 0.0 AS total
FROM v_pairs p JOIN v_pool q USING (target, label) WHERE p.x1 IS NULL AND p.distance <= q.distance_reached GROUP BY ALL""", ["v_pairs", "v_pool"])
def l14_all(spark, sf):
    """The members of every event as a target of its own, read from the cells its expansion reaches."""
    labels = study_labels(spark, sf)
    t = labels.filter("label = 'day1_close_return'").select(F.col("event_id").alias("target_id"), F.col("cluster_id").alias("target_cluster"), F.col("timing").alias("t_timing"), F.col("sic_division").alias("t_division"), F.col("sic_major_group").alias("t_group"), F.col("cutoff").alias("t_cutoff"))
    m = N.analogue_members(t, labels)
    return m.groupBy("target_id", "label", "state", "distance_reached").agg(F.count(F.lit(1)).alias("members"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count_if(F.col("distance") == 0).alias("nearest"),
                                                                            (F.round(F.coalesce(F.sum("num"), F.lit(0.0)), 6) + 0.0).alias("total"))


# New targets described by timing and sector and asked about at one moment, as an analyst would: a fixed, short list, so the answer grows with the events only.
DESCRIPTORS = [("n1", "premarket", "D", "23"), ("n2", "after_hours", "I", "73"), ("n3", "premarket", "G", "55"), ("n4", "after_hours", "A", "05")]
DESCRIPTOR_SQL = ", ".join(f"('{i}', '{t}', '{d}', '{g}')" for i, t, d, g in DESCRIPTORS)
ASKED_AT = "2024-01-24 12:00:00"

VIEWS["v_asked"] = (("v_lab",), f"""
SELECT *, CASE WHEN x1 IS NOT NULL THEN x1 WHEN distance > 1 THEN 'BEYOND_MAX_DISTANCE' WHEN distance > reached THEN 'BEYOND_EXPANSION' END AS exclusion FROM (
SELECT *, CASE WHEN n0 >= 10 THEN 0.0 WHEN n5 >= 10 THEN 0.5 ELSE far END AS reached, CASE WHEN n0 >= 10 THEN n0 WHEN n5 >= 10 THEN n5 ELSE n1 END AS gate_n FROM (
SELECT *, count_if(x1 IS NULL AND distance <= 0) OVER w AS n0, count_if(x1 IS NULL AND distance <= 0.5) OVER w AS n5, count_if(x1 IS NULL AND distance <= 1) OVER w AS n1, max(CASE WHEN x1 IS NULL AND distance <= 1 THEN distance END) OVER w AS far FROM (
SELECT *, CASE WHEN x IS NULL AND row_number() OVER (PARTITION BY target_id, label, x IS NULL, cluster_id ORDER BY cutoff, event_id) > 1 THEN 'CLUSTER_ALREADY_COUNTED' ELSE x END AS x1 FROM (
SELECT t.target_id, e.*, CASE WHEN e.matures_at IS NULL OR e.matures_at > TIMESTAMP '{ASKED_AT}' THEN 'LABEL_NOT_YET_MATURED' WHEN e.reason IS NOT NULL THEN 'LABEL_ABSENT' END AS x,
 CASE WHEN e.timing = t.timing THEN 0.0 ELSE 1.0 END + CASE WHEN e.sic_major_group = t.grp THEN 0.0 WHEN e.sic_division = t.division THEN 0.5 ELSE 1.0 END AS distance
FROM (VALUES {DESCRIPTOR_SQL}) t(target_id, timing, division, grp), v_lab e))
WINDOW w AS (PARTITION BY target_id, label)))""")


def descriptors(spark):
    return (literal_table(spark, DESCRIPTORS, "target_id string, t_timing string, t_division string, t_group string")
            .withColumn("t_cutoff", I.ts(ASKED_AT)).withColumn("target_event", F.lit(None).cast("string")).withColumn("target_cluster", F.lit(None).cast("string")))


@query("w03_first_in_cluster", "SELECT target_id, label, count_if(x1 = 'CLUSTER_ALREADY_COUNTED') AS already_counted, count_if(x1 IS NULL) AS counted FROM v_asked GROUP BY 1, 2", ["v_asked"])
def w03(spark, sf):
    c = N.candidates(descriptors(spark), study_labels(spark, sf))
    return c.groupBy("target_id", "label").agg(F.count_if(F.col("exclusion") == "CLUSTER_ALREADY_COUNTED").alias("already_counted"), F.count_if(F.col("exclusion").isNull()).alias("counted"))


@query("m09_distance", "SELECT target_id, label, event_id, CAST(distance AS DOUBLE) AS distance FROM v_asked WHERE x1 IS NULL", ["v_asked"])
def m09(spark, sf):
    return N.candidates(descriptors(spark), study_labels(spark, sf)).filter("exclusion is null").select("target_id", "label", "event_id", "distance")


@query("o07_analogue_members", "SELECT target_id, label, event_id, CAST(distance AS DOUBLE) AS distance, round(num, 9) + 0.0 AS num, flag FROM v_asked WHERE exclusion IS NULL", ["v_asked"])
def o07(spark, sf):
    rows = N.analogues(descriptors(spark), study_labels(spark, sf)).filter("exclusion is null")
    return rows.select("target_id", "label", "event_id", "distance", (F.round("num", 9) + 0.0).alias("num"), "flag").orderBy("target_id", "label", "distance", "event_id")


@query("l14_analogue_exclusions", "SELECT target_id, label, event_id, exclusion FROM v_asked WHERE exclusion IS NOT NULL", ["v_asked"])
def l14_exclusions(spark, sf):
    return N.analogues(descriptors(spark), study_labels(spark, sf)).filter("exclusion is not null").select("target_id", "label", "event_id", "exclusion")


@query("l14_analogue_summary", """
SELECT target_id, label, kind, n, gate_n, CAST(reached AS DOUBLE) AS distance_reached, issuers, reaction_sessions, CAST(n AS DOUBLE) AS effective_sample_size, CASE WHEN kind = 'boolean' THEN round(k / n, 10) END AS proportion,
 CASE WHEN kind = 'return' THEN round(mean, 8) + 0.0 END AS mean, CASE WHEN kind = 'return' THEN round(median, 10) + 0.0 END AS median, CASE WHEN kind = 'return' AND gate_n >= 20 THEN round(p10, 10) + 0.0 END AS p10
FROM (SELECT target_id, label, kind, gate_n, reached, count(*) AS n, count(DISTINCT cik) AS issuers, count(DISTINCT reaction_idx) AS reaction_sessions, count_if(flag) AS k, avg(num) AS mean, quantile_cont(num, 0.5) AS median, quantile_cont(num, 0.1) AS p10
 FROM v_asked WHERE exclusion IS NULL AND gate_n >= 10 GROUP BY ALL)""", ["v_asked"])
def l14_summary(spark, sf):
    rows = cut_lineage(N.analogues(descriptors(spark), study_labels(spark, sf)))
    return N.summarize(rows).select("target_id", "label", "kind", "n", "gate_n", "distance_reached", "issuers", "reaction_sessions", "effective_sample_size", "proportion", (F.round("mean", 8) + 0.0).alias("mean"), "median", "p10")


@query("a25_effective_sample_size", "SELECT l_returnflag, round(pow(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 4) AS kish FROM lineitem GROUP BY 1")
def a25(spark, sf):
    return I.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(effective_n("l_quantity"), 4).alias("kish"))
