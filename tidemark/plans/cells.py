"""Grouped base rates: hierarchical cells, as-of statistics, suppression and partial pooling."""
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import normal_quantile, rounded, wilson_high, wilson_low
from tidemark.functions.text import sic_division
from tidemark.operators.asof import dedupe_clusters
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.outcomes import LABELS, RETURN_LABELS
from tidemark.runtime import cut_lineage

# The reporting policy.
POLICY = {"count_unit": "event", "wilson_confidence": 0.95,
          "proportion": (5, 10), "mean_median": (10, 20), "quantiles_from": 20, "levels": (0.1, 0.25, 0.5, 0.75, 0.9),
          "prior_strength": 10, "min_members": 10, "max_distance": 1.0, "timing_mismatch": 1.0,
          "sector_mismatch": {"same_major_group": 0.0, "same_division": 0.5, "other": 1.0}}
LEVELS = ("all", "timing", "sic_division", "sic_major_group", "issuer")
REPORTED, UNRELIABLE, WITHHELD = "REPORTED", "REPORTED_UNRELIABLE", "WITHHELD"


def with_sector(events: DataFrame) -> DataFrame:
    return events.withColumn("sic_division", sic_division("sic")).withColumn("sic_major_group", F.substring("sic", 1, 2))


def sector_quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with their sector, and those whose SIC code is malformed or belongs to no division, with the reason."""
    d = with_sector(events)
    reason = F.when(~F.coalesce(F.rlike("sic", F.lit(r"^\d{4}$")), F.lit(False)), "MALFORMED_SIC").when(F.col("sic_division").isNull(), "UNKNOWN_SIC_DIVISION")
    return d.filter("sic_division is not null"), d.withColumn("reason", reason).filter("reason is not null")


def cell_keys(category: str) -> Column:
    """A2. The five (level, key, parent level, parent key) rows of an event."""
    row = lambda level, key, plevel, pkey: F.struct(F.lit(level).alias("level"), key.alias("key"), F.lit(plevel).alias("parent_level"), pkey.alias("parent_key"))
    none = F.lit(None).cast("string")
    return F.array(row("all", F.lit(category), None, none), row("timing", F.col("timing"), "all", F.lit(category)),
                   row("sic_division", F.col("sic_division"), "all", F.lit(category)),
                   row("sic_major_group", F.col("sic_major_group"), "sic_division", F.col("sic_division")),
                   row("issuer", F.col("cik"), "sic_major_group", F.col("sic_major_group")))


def group_cells(labels: DataFrame, category="all_news") -> DataFrame:
    """A2. Explode every label row into its five cells; the aggregate that follows combines on the map side, so the `all` cell is not a hot key."""
    return (labels.withColumn("_c", F.explode(cell_keys(category)))
            .select("*", "_c.level", "_c.key", "_c.parent_level", "_c.parent_key").drop("_c"))


def band(n: Column, report_from: int, unreliable_below: int = 0) -> Column:
    """A7. Suppression state of an estimate resting on n observations."""
    return F.when(n < report_from, WITHHELD).when(n < unreliable_below, UNRELIABLE).otherwise(REPORTED)


def cell_stats(cells: DataFrame, as_of: Column, policy=POLICY) -> DataFrame:
    """A3, A4, A6. Per (cell, label): present, absent, gate count, k, Wilson bounds and mean, from labels matured by `as_of` only."""
    unit = "cluster_id" if policy["count_unit"] == "event" else "reaction_idx"
    z = normal_quantile(policy["wilson_confidence"])
    present = F.col("reason").isNull()
    g = (cells.filter(F.col("matures_at") <= as_of).groupBy("level", "key", "parent_level", "parent_key", "label", "kind")
         .agg(F.count_if(present).alias("n"), F.count_if(~present).alias("n_absent"), F.count_distinct(F.when(present, F.col(unit))).alias("gate_n"),
              F.count_if(F.col("flag")).alias("k"), F.sum("num").alias("total")))
    return (g.withColumn("raw", F.when(F.col("kind") == "boolean", F.col("k") / F.nullif("n", F.lit(0))).otherwise(F.col("total") / F.nullif("n", F.lit(0))))
            .withColumn("wilson_low", F.when(F.col("kind") == "boolean", wilson_low("k", "n", z)))
            .withColumn("wilson_high", F.when(F.col("kind") == "boolean", wilson_high("k", "n", z))))


def absent_reasons(cells: DataFrame, as_of: Column) -> DataFrame:
    """A3. How often each reason left a label out of a cell."""
    return cells.filter((F.col("matures_at") <= as_of) & F.col("reason").isNotNull()).groupBy("level", "key", "label", "reason").agg(F.count(F.lit(1)).alias("n"))


def cell_counts(events: DataFrame, as_of: Column, category="all_news") -> DataFrame:
    """A3. Events, issuers and reaction sessions of every cell whose day-1 label matured by `as_of`."""
    return (group_cells(events.filter(F.col("matures_at") <= as_of), category).groupBy("level", "key")
            .agg(F.count(F.lit(1)).alias("events"), F.count_distinct("cik").alias("issuers"), F.count_distinct("reaction_idx").alias("reaction_sessions")))


def suppress(stats: DataFrame, policy=POLICY) -> DataFrame:
    """A7. Null every value whose gate count is below its reporting minimum."""
    prop, mean = policy["proportion"], policy["mean_median"]
    boolean = F.col("kind") == "boolean"
    s = stats.withColumn("state", F.when(boolean, band(F.col("gate_n"), *prop)).otherwise(band(F.col("gate_n"), *mean)))
    shown = F.col("state") != WITHHELD
    return (s.withColumn("value", F.when(shown, rounded("raw"))).withColumn("wilson_low", F.when(shown, rounded("wilson_low")))
            .withColumn("wilson_high", F.when(shown, rounded("wilson_high"))).drop("raw", "total"))


def cell_quantiles(cells: DataFrame, as_of: Column, policy=POLICY) -> DataFrame:
    """A5 with A7: median and the policy's quantiles of every return label of every cell."""
    unit = "cluster_id" if policy["count_unit"] == "event" else "reaction_idx"
    known = cells.filter((F.col("matures_at") <= as_of) & (F.col("kind") == "return") & F.col("num").isNotNull())
    keys = ["level", "key", "label"]
    q = exact_quantiles(known, keys, "num", policy["levels"])
    gates = known.groupBy(*keys).agg(F.count_distinct(unit).alias("gate_n"))
    mid = policy["levels"].index(0.5) + 1
    shown_q, shown_m = F.col("gate_n") >= policy["quantiles_from"], F.col("gate_n") >= policy["mean_median"][0]
    return (q.join(gates, keys).select(*keys, "gate_n", F.when(shown_m, rounded(F.element_at("q", mid))).alias("median"),
                                       *[F.when(shown_q, rounded(F.element_at("q", i + 1))).alias(f"p{int(p * 100)}") for i, p in enumerate(policy["levels"])]))


def _toward(n, value, prior, m) -> Column:
    return F.when(value.isNotNull() & prior.isNotNull(), rounded((n * value + m * prior) / (n + m)))


def partial_pool(stats: DataFrame, policy=POLICY) -> DataFrame:
    """A8. Shrink every reported cell toward its nearest reported ancestor; an ancestor is itself pooled first, and a withheld cell never is.

    Every cell looks up its (at most three) ancestors by equality on (level, key, label), so the recursion is a column expression over one row. The table is a
    summary, written once because it is read four times.
    """
    m = policy["prior_strength"]
    base = cut_lineage(stats)
    out = base.withColumnsRenamed({"parent_level": "l1", "parent_key": "k1"})
    for i in (1, 2, 3):
        up = base.select(F.col("level").alias(f"l{i}"), F.col("key").alias(f"k{i}"), "label", F.col("n").alias(f"n{i}"), F.col("value").alias(f"v{i}"),
                         F.col("parent_level").alias(f"l{i + 1}"), F.col("parent_key").alias(f"k{i + 1}"))
        out = out.join(up, [f"l{i}", f"k{i}", "label"], "left")
    prior, source = F.lit(None).cast("double"), F.lit(None).cast("string")
    for i in (3, 2, 1):  # from the root down
        n, v = F.col(f"n{i}"), F.col(f"v{i}")
        prior = F.coalesce(_toward(n, v, prior, m), v, prior)
        source = F.when(v.isNotNull(), F.col(f"l{i}")).otherwise(source)
    can = F.col("value").isNotNull() & prior.isNotNull()
    return (out.withColumn("pooled", _toward(F.col("n"), F.col("value"), prior, m)).withColumn("toward", F.when(can, source))
            .withColumn("weight_on_cell", F.when(can, rounded(F.col("n") / (F.col("n") + m))))
            .withColumnsRenamed({"l1": "parent_level", "k1": "parent_key"}).select(*stats.columns, "pooled", "toward", "weight_on_cell"))


def pool_chain(stats: DataFrame, by, policy=POLICY) -> DataFrame:
    """A8 for one chain of groups per target: the five levels of a (target, label) sit in one row, so one grouping does it."""
    m = policy["prior_strength"]
    names = [c for c in stats.columns if c not in (*by, "label")]
    row = F.struct(*names)
    wide = stats.groupBy(*by, "label").agg(*[F.max(F.when(F.col("level") == lv, row)).alias(lv) for lv in LEVELS])
    part = lambda lv, f: F.col(f"{lv}.{f}")
    known = {None: F.lit(None).cast("double"), "all": part("all", "value")}
    pooled = {"all": F.lit(None).cast("double")}
    for lv, parent in (("timing", "all"), ("sic_division", "all"), ("sic_major_group", "sic_division"), ("issuer", "sic_major_group")):
        pooled[lv] = _toward(part(lv, "n"), part(lv, "value"), known[parent], m)
        known[lv] = F.coalesce(pooled[lv], part(lv, "value"), known[parent])
    rows = F.array(*[F.struct(*[part(lv, c).alias(c) for c in names], pooled[lv].alias("pooled")) for lv in LEVELS])
    return wide.select(*by, "label", F.explode(rows).alias("_r")).select(*by, "label", "_r.*").filter("level is not null")


def fingerprint_table(labels: DataFrame, as_of: Column, category="all_news", policy=POLICY) -> DataFrame:
    """L12. Every cell of every label as known at `as_of`: one event per cluster, statistics, suppression, pooling."""
    kept = dedupe_clusters(labels, by=("label",))
    return partial_pool(suppress(cell_stats(group_cells(kept, category), as_of, policy), policy), policy)


def target_fingerprint(targets: DataFrame, labels: DataFrame, category="all_news", policy=POLICY) -> DataFrame:
    """L13. For every target at its own cutoff: counts, rate or mean and pooled value of each group of its chain, from earlier matured events of other clusters.

    Sums are additive, so all targets are answered by one as-of sum per (label, cell); what the target's own cluster contributed is taken off again.
    Quantiles are not additive and belong to `cell_quantiles` at one as-of time.
    """
    from tidemark.operators.asof import join_asof_sums
    kept = dedupe_clusters(labels, by=("label",))
    present = F.col("reason").isNull()
    measures = {"n": F.count_if(present), "k": F.count_if(F.col("flag")), "total": F.sum(F.coalesce("num", F.lit(0.0))), "n_absent": F.count_if(~present)}
    facts = group_cells(kept, category).withColumn("_at", F.col("matures_at")).filter("_at is not null")
    facts = (facts.groupBy("label", "level", "key", "_at").agg(*[c.alias(m) for m, c in measures.items()]))
    names = F.array(*[F.struct(F.lit(x).alias("label"), F.lit("return" if x in RETURN_LABELS else "boolean").alias("kind")) for x in LABELS])
    asks = group_cells(targets, category).withColumn("_x", F.explode(names)).select("*", "_x.label", "_x.kind").drop("_x")
    sums = join_asof_sums(asks, facts, ["label", "level", "key"], "_at", "cutoff", {m: F.col(m) for m in measures})
    own = kept.select("label", F.col("cluster_id").alias("_c"), F.col("timing").alias("_t"), F.col("sic_division").alias("_d"), F.col("sic_major_group").alias("_g"), F.col("cik").alias("_i"),
                      "reason", "flag", "num", F.col("matures_at").alias("_m"))
    same_cell = (F.when(F.col("level") == "all", F.lit(True)).when(F.col("level") == "timing", F.col("_t") == F.col("timing"))
                 .when(F.col("level") == "sic_division", F.col("_d") == F.col("sic_division")).when(F.col("level") == "sic_major_group", F.col("_g") == F.col("sic_major_group"))
                 .otherwise(F.col("_i") == F.col("cik")))
    joined = sums.join(own.withColumnRenamed("_c", "cluster_id"), ["label", "cluster_id"], "left")
    mine = F.coalesce(same_cell & (F.col("_m") <= F.col("cutoff")), F.lit(False))
    off = lambda cond, x=F.lit(1): F.when(mine & cond, x).otherwise(0)
    s = (joined.withColumn("n", F.col("n") - off(present)).withColumn("n_absent", F.col("n_absent") - off(~present))
         .withColumn("k", F.col("k") - off(F.coalesce("flag", F.lit(False)))).withColumn("total", F.col("total") - off(present, F.coalesce("num", F.lit(0.0)))))
    z = normal_quantile(policy["wilson_confidence"])
    boolean = F.col("kind") == "boolean"
    s = (s.withColumn("gate_n", F.col("n"))  # one event per cluster, so events and clusters count alike
         .withColumn("raw", F.when(boolean, F.col("k") / F.nullif("n", F.lit(0))).otherwise(F.col("total") / F.nullif("n", F.lit(0))))
         .withColumn("wilson_low", F.when(boolean, wilson_low("k", "n", z))).withColumn("wilson_high", F.when(boolean, wilson_high("k", "n", z))))
    out = s.select("event_id", "label", "kind", "level", "key", "parent_level", "parent_key", "n", "n_absent", "k", "gate_n", "raw", "total", "wilson_low", "wilson_high")
    return pool_chain(suppress(out, policy), ("event_id",), policy)
