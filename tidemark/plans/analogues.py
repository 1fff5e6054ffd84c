"""Analogue retrieval by categorical distance.

Two forms. `pool_table` answers for every event as its own target and needs only counts, so it never pairs events: counts by sector and timing are as-of sums
and the levels follow by inclusion and exclusion. `analogues` lists members and exclusions for a given set of targets, one row per (target, label, event),
which is the size of its answer.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.numeric import normal_quantile, rounded, wilson_high, wilson_low
from tidemark.operators.asof import asof_sums, dedupe_clusters
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.cells import POLICY, WITHHELD, band
from tidemark.plans.outcomes import LABELS

FOUND, INSUFFICIENT = "ANALOGUES_FOUND", "INSUFFICIENT_ANALOGUES"


def distance(t_timing, t_division, t_group, timing, division, group, policy=POLICY) -> Column:
    """M9. Timing mismatch plus sector relation."""
    s = policy["sector_mismatch"]
    sector = (F.when(group == t_group, s["same_major_group"]).when(division == t_division, s["same_division"]).otherwise(s["other"]))
    return F.round(F.when(timing == t_timing, 0.0).otherwise(policy["timing_mismatch"]) + sector, 12)


SCOPES = ("tg", "td", "t", "g", "d", "")


def _scopes():
    part = {"t": "timing", "d": "sic_division", "g": "sic_major_group"}
    return F.array(*[F.struct(F.lit(s or "all").alias("scope"), F.concat_ws("|", F.lit(s), *[F.col(part[c]) for c in s]).alias("scope_key")) for s in SCOPES])


def representatives(labels: DataFrame) -> DataFrame:
    """The one event a cluster may contribute to a label: its earliest event with the label present.

    Within one calendar a later cutoff never matures earlier, so whenever any present event of a cluster has matured, this one has.
    """
    return dedupe_clusters(labels.filter("reason is null and matures_at is not null"), by=("label",))


def pool_table(labels: DataFrame, policy=POLICY) -> DataFrame:
    """J9, W4, A24 for all events as targets at their own cutoffs: candidates, exclusions by reason, distance reached, members and state per (event, label)."""
    reps = representatives(labels).withColumn("_at", F.col("matures_at"))
    facts = reps.withColumn("_s", F.explode(_scopes())).select("label", "_s.*", "_at")
    asks = labels.select("event_id", "cluster_id", "label", "timing", "sic_division", "sic_major_group", "cutoff").withColumn("_s", F.explode(_scopes())).select("*", "_s.scope", "_s.scope_key")
    known = asof_sums(facts, asks, ["label", "scope", "scope_key"], "_at", "cutoff", {"c": F.lit(1)})
    wide = (asks.join(known, ["label", "scope", "scope_key", "cutoff"], "left").groupBy("event_id", "cluster_id", "label", "timing", "sic_division", "sic_major_group", "cutoff")
            .agg(*[F.max(F.when(F.col("scope") == (s or "all"), F.col("c"))).alias("c_" + (s or "all")) for s in SCOPES]))
    own = reps.select("label", "cluster_id", F.col("timing").alias("_t"), F.col("sic_division").alias("_d"), F.col("sic_major_group").alias("_g"), "_at")
    wide = wide.join(own, ["label", "cluster_id"], "left")
    mine = F.coalesce(F.col("_at") <= F.col("cutoff"), F.lit(False))
    same = {"t": F.col("_t") == F.col("timing"), "d": F.col("_d") == F.col("sic_division"), "g": F.col("_g") == F.col("sic_major_group")}
    for s in SCOPES:
        hit = mine
        for c in s:
            hit = hit & same[c]
        name = "c_" + (s or "all")
        wide = wide.withColumn(name, F.coalesce(name, F.lit(0)) - F.when(hit, 1).otherwise(0))
    c = lambda s: F.col("c_" + s)
    sector, miss = policy["sector_mismatch"], policy["timing_mismatch"]
    combos = [(sector["same_major_group"], c("tg")), (sector["same_division"], c("td") - c("tg")), (sector["other"], c("t") - c("td")),
              (miss + sector["same_major_group"], c("g") - c("tg")), (miss + sector["same_division"], c("d") - c("td") - c("g") + c("tg")),
              (miss + sector["other"], c("all") - c("t") - c("d") + c("td"))]
    levels = sorted({round(d, 12) for d, _ in combos if d <= policy["max_distance"]})
    upto = {v: sum((n for d, n in combos if d <= v), F.lit(0)) for v in levels}
    at = {v: sum((n for d, n in combos if round(d, 12) == v), F.lit(0)) for v in levels}
    reached, members = F.lit(None).cast("double"), upto[levels[-1]]
    for v in levels:  # not enough anywhere: the farthest level that holds anything
        reached = F.when(at[v] > 0, F.lit(v)).otherwise(reached)
    for v in reversed(levels):
        reached, members = F.when(upto[v] >= policy["min_members"], F.lit(v)).otherwise(reached), F.when(upto[v] >= policy["min_members"], upto[v]).otherwise(members)
    out = (wide.withColumn("eligible", c("all")).withColumn("within", upto[levels[-1]]).withColumn("members", members).withColumn("distance_reached", reached)
           .withColumn("state", F.when(F.col("members") >= policy["min_members"], FOUND).otherwise(INSUFFICIENT))
           .withColumn("beyond_max_distance", F.col("eligible") - F.col("within")).withColumn("beyond_expansion", F.col("within") - F.col("members")))
    # the other exclusions, again as as-of counts
    everything = labels.withColumn("_at", F.col("matures_at"))
    present = {"m": F.lit(1), "p": F.when(F.col("reason").isNull(), 1).otherwise(0)}
    by_label = asof_sums(everything, out, "label", "_at", "cutoff", present)
    by_cluster = asof_sums(everything, out, ["label", "cluster_id"], "_at", "cutoff", present).withColumnsRenamed({"m": "m_own", "p": "p_own"})
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    clusters = labels.groupBy("label", "cluster_id").agg(F.count(F.lit(1)).alias("n_cluster"))
    out = (out.join(by_label, ["label", "cutoff"], "left").join(by_cluster, ["label", "cluster_id", "cutoff"], "left").join(sizes, "label").join(clusters, ["label", "cluster_id"]))
    return (out.withColumn("same_cluster", F.col("n_cluster") - 1)
            .withColumn("not_yet_matured", F.col("n_label") - F.col("n_cluster") - (F.col("m") - F.col("m_own")))
            .withColumn("label_absent", (F.col("m") - F.col("m_own")) - (F.col("p") - F.col("p_own")))
            .withColumn("cluster_already_counted", F.col("p") - F.col("p_own") - F.col("eligible"))
            .select("event_id", "label", "eligible", "members", "distance_reached", "state", "same_cluster", "not_yet_matured", "label_absent", "cluster_already_counted",
                    "beyond_max_distance", "beyond_expansion"))


def pool_report(pool: DataFrame) -> DataFrame:
    """A24. Per label: how many targets could draw on 5, 10, 20 or no candidates, and how many found enough."""
    e = F.col("eligible")
    return pool.groupBy("label").agg(F.count(F.lit(1)).alias("targets"), F.count_if(e >= 5).alias("with_5_or_more"), F.count_if(e >= 10).alias("with_10_or_more"),
                                     F.count_if(e >= 20).alias("with_20_or_more"), F.count_if(e == 0).alias("with_none"), F.count_if(F.col("state") == FOUND).alias("analogues_found"))


def candidates(targets: DataFrame, labels: DataFrame, policy=POLICY) -> DataFrame:
    """J9, W3. Every event against each of the given targets, with the reason it may not be used; needs target_id, target_event, target_cluster, t_timing, t_division, t_group, t_cutoff."""
    asked = targets.withColumn("label", F.explode(F.array(*[F.lit(x) for x in LABELS])))
    rows = labels.join(asked, "label")  # a short list of targets, so the planner broadcasts it
    reason = (F.when(F.col("event_id") == F.col("target_event"), "SELF").when(F.col("cluster_id") == F.col("target_cluster"), "SAME_CLUSTER")
              .when(F.col("matures_at").isNull() | (F.col("matures_at") > F.col("t_cutoff")), "LABEL_NOT_YET_MATURED").when(F.col("reason").isNotNull(), "LABEL_ABSENT"))
    rows = rows.withColumn("exclusion", reason)
    first = (rows.filter("exclusion is null").groupBy("target_id", "label", "cluster_id").agg(F.min_by("event_id", F.struct("cutoff", "event_id")).alias("_first")))
    rows = rows.join(first, ["target_id", "label", "cluster_id"], "left")
    return (rows.withColumn("exclusion", F.when(F.col("exclusion").isNull() & (F.col("_first") != F.col("event_id")), "CLUSTER_ALREADY_COUNTED").otherwise(F.col("exclusion")))
            .withColumn("distance", F.when(F.col("exclusion").isNull(), distance(F.col("t_timing"), F.col("t_division"), F.col("t_group"), F.col("timing"), F.col("sic_division"), F.col("sic_major_group"), policy)))
            .drop("_first"))


def expand_to_minimum(cands: DataFrame, policy=POLICY, by=("target_id", "label")) -> DataFrame:
    """W4. Per target: the smallest distance level whose candidates reach the minimum; a level enters whole. Levels are few, so the running sum is too."""
    unit = "cluster_id" if policy["count_unit"] == "event" else "reaction_idx"
    # a gate key counts at the nearest level it appears on
    nearest = cands.filter(F.col("distance") <= policy["max_distance"]).groupBy(*by, unit).agg(F.min("distance").alias("distance"))
    levels = nearest.groupBy(*by, "distance").agg(F.count(F.lit(1)).alias("c"))
    run = F.sum("c").over(W.partitionBy(*by).orderBy("distance"))
    return (levels.withColumn("upto", run).groupBy(*by)
            .agg(F.coalesce(F.min(F.when(F.col("upto") >= policy["min_members"], F.col("distance"))), F.max("distance")).alias("distance_reached"),
                 F.coalesce(F.min(F.when(F.col("upto") >= policy["min_members"], F.col("upto"))), F.sum("c")).alias("gate_n"))
            .withColumn("state", F.when(F.col("gate_n") >= policy["min_members"], FOUND).otherwise(INSUFFICIENT)))


def analogues(targets: DataFrame, labels: DataFrame, policy=POLICY) -> DataFrame:
    """L14, O7. One row per (target, label, event): chosen as a member (exclusion null) or excluded with its reason."""
    cands = candidates(targets, labels, policy)
    reached = expand_to_minimum(cands, policy)
    d = F.col("distance")
    late = F.when(d > policy["max_distance"], "BEYOND_MAX_DISTANCE").when(d > F.col("distance_reached"), "BEYOND_EXPANSION")
    return (cands.join(reached, ["target_id", "label"], "left").withColumn("exclusion", F.coalesce("exclusion", late))
            .withColumn("state", F.coalesce("state", F.lit(INSUFFICIENT))).withColumn("gate_n", F.coalesce("gate_n", F.lit(0))))


READ = ("tg", "td", "t", "g")  # the cells an expansion can read


def cell_index(labels: DataFrame) -> DataFrame:
    """L14. An inverted index: the event each cluster may contribute to a label, once in each cell (timing with major group, timing with division, timing, major group, and the two totals)."""
    reps = representatives(labels).withColumn("_at", F.col("matures_at"))
    return reps.withColumn("_s", F.explode(_scopes())).select("*", "_s.scope", "_s.scope_key").drop("_s")


def analogue_members(targets: DataFrame, labels: DataFrame, policy=POLICY) -> DataFrame:
    """L14, W3, O7. The chosen members of any number of targets: target_id, t_cutoff, label, event_id and the event's columns, distance, distance_reached, members and state.

    Needs target_id, target_cluster, t_timing, t_division, t_group, t_cutoff. How far a target's expansion must reach follows from counts: cumulative counts of each cell as of the
    cutoff, by as-of sums. Then only the cells it reaches are read, by equality on (label, cell): at distance 0 the one of its timing and major group, at the next level that of its timing and division, at
    the last its timing's and its major group's. What moves is the answer (and what of its cells matures later), never target by event. As in `pool_table`, a cluster is stood for by its earliest event.
    """
    sector, miss, most = policy["sector_mismatch"], policy["timing_mismatch"], policy["max_distance"]
    if policy["count_unit"] != "event" or sector["same_major_group"] != 0 or not 0 < sector["same_division"] < most or sector["other"] > most or miss > most or miss + sector["same_division"] <= most:
        raise ValueError("the cells read here answer for the registered policy; use `analogues`")
    index = cell_index(labels)
    asked = targets.withColumn("label", F.explode(F.array(*[F.lit(x) for x in LABELS])))
    named = asked.withColumnsRenamed({"t_timing": "timing", "t_division": "sic_division", "t_group": "sic_major_group"})
    asks = named.withColumn("_s", F.explode(F.filter(_scopes(), lambda s: s["scope"].isin(*READ)))).select("target_id", "label", "target_cluster", "timing", "sic_division", "sic_major_group", "t_cutoff", "_s.scope", "_s.scope_key")
    known = asof_sums(index, asks, ["label", "scope", "scope_key"], "_at", "t_cutoff", {"c": F.lit(1)})
    keys = ["target_id", "label", "target_cluster", "timing", "sic_division", "sic_major_group", "t_cutoff"]
    wide = asks.join(known, ["label", "scope", "scope_key", "t_cutoff"], "left").groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("scope") == s, F.col("c"))), F.lit(0)).alias("c_" + s) for s in READ])
    own = index.filter("scope = 'all'").select("label", F.col("cluster_id").alias("target_cluster"), F.col("timing").alias("_t"), F.col("sic_division").alias("_d"), F.col("sic_major_group").alias("_g"), "_at")
    wide = wide.join(own, ["label", "target_cluster"], "left")
    mine = F.coalesce(F.col("_at") <= F.col("t_cutoff"), F.lit(False))
    same = {"t": F.col("_t") == F.col("timing"), "d": F.col("_d") == F.col("sic_division"), "g": F.col("_g") == F.col("sic_major_group")}
    for s in READ:
        hit = mine
        for c in s:
            hit = hit & F.coalesce(same[c], F.lit(False))
        wide = wide.withColumn("c_" + s, F.col("c_" + s) - hit.cast("int"))
    near, mid, far = F.col("c_tg"), F.col("c_td"), F.col("c_t") + F.col("c_g") - F.col("c_tg")
    enough = policy["min_members"]
    level = F.when(near >= enough, 0).when(mid >= enough, 1).when(far > mid, 2).when(mid > near, 1).when(near > 0, 0)
    wide = wide.withColumn("_level", level).withColumn("members", F.when(F.col("_level") == 0, near).when(F.col("_level") == 1, mid).when(F.col("_level") == 2, far).otherwise(0))
    cells = F.when(F.col("_level") == 0, F.array(F.lit("tg"))).when(F.col("_level") == 1, F.array(F.lit("td"))).otherwise(F.array(F.lit("t"), F.lit("g")))
    key = F.when(F.col("scope") == "tg", F.concat_ws("|", F.lit("tg"), "timing", "sic_major_group")).when(F.col("scope") == "td", F.concat_ws("|", F.lit("td"), "timing", "sic_division")).when(F.col("scope") == "t", F.concat_ws("|", F.lit("t"), "timing")).otherwise(F.concat_ws("|", F.lit("g"), "sic_major_group"))
    reads = wide.filter("_level is not null").withColumn("scope", F.explode(cells)).select("target_id", "label", "target_cluster", F.col("timing").alias("t_timing"), F.col("sic_division").alias("t_division"), F.col("sic_major_group").alias("t_group"), "t_cutoff", "members",
                                                                                         "_level", "scope", key.alias("scope_key"))
    found = index.join(reads, ["label", "scope", "scope_key"]).filter((F.col("_at") <= F.col("t_cutoff")) & ~F.coalesce(F.col("cluster_id") == F.col("target_cluster"), F.lit(False)))
    found = found.filter((F.col("scope") != "g") | (F.col("timing") != F.col("t_timing")))  # those of its own timing came by the other cell
    d = distance(F.col("t_timing"), F.col("t_division"), F.col("t_group"), F.col("timing"), F.col("sic_division"), F.col("sic_major_group"), policy)
    reached = F.when(F.col("_level") == 0, 0.0).when(F.col("_level") == 1, sector["same_division"]).otherwise(max(sector["other"], miss))
    return (found.withColumn("distance", d).withColumn("distance_reached", F.round(reached, 12)).withColumn("state", F.when(F.col("members") >= enough, FOUND).otherwise(INSUFFICIENT))
            .drop("scope", "scope_key", "_at", "_level"))


def summarize(rows: DataFrame, policy=POLICY) -> DataFrame:
    """L14. Summary of each found set: rate with Wilson bounds, or mean, median and quantiles, under the reporting minimums; nothing when the set falls short."""
    members = rows.filter(F.col("exclusion").isNull() & (F.col("state") == FOUND))
    keys = ["target_id", "label"]
    z = normal_quantile(policy["wilson_confidence"])
    base = members.groupBy(*keys, "kind", "gate_n", "distance_reached").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cik").alias("issuers"), F.count_distinct("reaction_idx").alias("reaction_sessions"),
        F.count_if(F.col("flag")).alias("k"), F.avg("num").alias("mean"))
    q = exact_quantiles(members.filter("kind = 'return'"), keys, "num", policy["levels"]).drop("n")
    shown_p, shown_m, shown_q = band(F.col("gate_n"), *policy["proportion"]) != WITHHELD, band(F.col("gate_n"), *policy["mean_median"]) != WITHHELD, F.col("gate_n") >= policy["quantiles_from"]
    boolean = F.col("kind") == "boolean"
    mid = policy["levels"].index(0.5) + 1
    return (base.join(q, keys, "left")
            .select(*keys, "kind", "n", "gate_n", "distance_reached", "issuers", "reaction_sessions", F.col("n").cast("double").alias("effective_sample_size"),
                    F.when(boolean & shown_p, rounded(F.col("k") / F.col("n"))).alias("proportion"), F.when(boolean & shown_p, rounded(wilson_low("k", "n", z))).alias("wilson_low"),
                    F.when(boolean & shown_p, rounded(wilson_high("k", "n", z))).alias("wilson_high"), F.when(~boolean & shown_m, rounded("mean")).alias("mean"),
                    F.when(shown_m, rounded(F.element_at("q", mid))).alias("median"), F.when(shown_q, rounded(F.element_at("q", 1))).alias("p10"),
                    F.when(shown_q, rounded(F.element_at("q", len(policy["levels"])))).alias("p90")))
