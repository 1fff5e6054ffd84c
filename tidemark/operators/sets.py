"""Set operations and reconciliation, each one grouping or one equi join."""
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.text import row_digest
from tidemark.operators.components import connected_components


def union_no_conflict(dfs, keys) -> DataFrame:
    """U1, U2. Union by name, one row per key; `conflict` marks keys that came with different contents."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = reduce(lambda a, b: a.unionByName(b), dfs)
    rest = [c for c in rows.columns if c not in keys]
    return (rows.withColumn("_d", row_digest(*rows.columns)).groupBy(*keys).agg(F.min_by(F.struct(*rest), "_d").alias("_r"), (F.min("_d") != F.max("_d")).alias("conflict"), F.count(F.lit(1)).alias("copies"))
            .select(*keys, *[f"_r.{c}" for c in rest], "conflict", "copies"))


def merge_bundles(bundles, keys: dict, stamps=()) -> dict:
    """U1. Merge bundles table by table: plain union, except tables named in `keys`, which keep one row per key and mark conflicts.

    `stamps` gives each bundle's (as_of, mode); bundles that disagree are refused.
    """
    if len(set(stamps)) > 1:
        raise ValueError(f"bundles disagree in as_of or mode: {sorted(set(map(str, stamps)))}")
    names = {n for b in bundles for n in b}
    return {n: union_no_conflict([b[n] for b in bundles if n in b], keys[n]) if n in keys else reduce(lambda a, b: a.unionByName(b), [b[n] for b in bundles if n in b]) for n in sorted(names)}


def reconcile(a: DataFrame, b: DataFrame, key: str, by: str) -> DataFrame:
    """U3. Two id sets per group: how many are missing, extra and shared, and whether they match."""
    sides = a.select(by, key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(by, key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    ids = sides.groupBy(by, key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    g = ids.groupBy(by).agg(F.count_if(F.col("_a") + F.col("_b") == 2).alias("shared"), F.count_if(F.col("_b") == 0).alias("missing"), F.count_if(F.col("_a") == 0).alias("extra"))
    return g.withColumn("state", F.when((F.col("missing") == 0) & (F.col("extra") == 0), "MATCHED").otherwise("REVIEW_REQUIRED"))


def account_candidates(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """U4. Every candidate must be included (its event exists), or left out with a reason and no event; every event is represented exactly once."""
    known = events.select("event_id").distinct().withColumn("_e", F.lit(True))
    j = ledger.join(known, "event_id", "full_outer")
    uses = j.filter("disposition = 'included' and _e").groupBy("event_id").agg(F.count(F.lit(1)).alias("_uses"))
    j = j.join(uses, "event_id", "left")
    left_out = F.col("disposition").isin("excluded", "quarantined") & F.col("reason").isNotNull() & F.col("event_id").isNull()
    state = (F.when(F.col("candidate_id").isNull(), "EVENT_WITHOUT_CANDIDATE").when((F.col("disposition") == "included") & F.col("_e") & (F.col("_uses") == 1), "REPRESENTED")
             .when((F.col("disposition") == "included") & F.col("_e"), "EVENT_USED_TWICE").when(left_out, "ACCOUNTED").otherwise("INVALID"))
    return j.withColumn("state", F.coalesce(state, F.lit("INVALID"))).select("candidate_id", "event_id", "state")


def sets_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """U5. Rows only one side has, as counts; both zero when the sets agree. Multisets are compared."""
    cols = a.columns
    sides = a.select(*cols, F.lit(1).alias("_n")).unionByName(b.select(*cols, F.lit(-1).alias("_n")))
    diff = sides.groupBy(*cols).agg(F.sum("_n").alias("d"))
    return diff.agg(F.sum(F.greatest("d", F.lit(0))).alias("only_left"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("only_right"))


def needed_ranges(files: DataFrame, recent_first: DataFrame, start, by: str) -> DataFrame:
    """U6. Continuation files that reach the screen start, where the recent rows do not already cover it."""
    s = F.lit(start).cast("date")
    return files.join(recent_first, by, "left").filter((F.col("recent_first").isNull() | (F.col("recent_first") > s)) & (F.col("range_to") >= s))


def connected_partitions(df: DataFrame, part="part", keys=("cluster_id", "reaction_session")) -> DataFrame:
    """U7. Rows linked through shared clusters or sessions all take the latest partition among them, however long the chain of links.

    Keys are the nodes of a graph and distinct rows of keys its edges, so a hot key is one node; components come from `connected_components`, which has no limit of
    rounds. A null key links nothing; a row without any key keeps its own partition.
    """
    node = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{keys.index(k)}|"), F.col(k).cast("string")))
    names = [f"_n{i}" for i in range(len(keys))]
    rows = df.withColumns({n: node(k) for n, k in zip(names, keys)}).withColumn("_node", F.coalesce(*[F.col(n) for n in names]))
    pairs = F.array(*[F.struct(F.col("_node").alias("a"), F.col(n).alias("b")) for n in names[1:]])
    found = connected_components(rows.select(F.explode(pairs).alias("_e")).select("_e.*").filter("a is not null and b is not null").distinct())
    placed = rows.join(found.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_root", F.coalesce("root", "_node"))
    top = placed.filter("_root is not null").groupBy("_root").agg(F.max(part).alias("_t"))
    return placed.join(top, "_root", "left").withColumn(part, F.coalesce("_t", part)).select(*df.columns)


def ordered_partitions(df: DataFrame, percent=15, session="reaction_session", test: DataFrame = None) -> DataFrame:
    """P5. Fit 0, select 1, calibrate 2: whole sessions from the end, at least `percent` of the rows each, then U7. At most one row per calendar session enters the window.

    `test` rows make part 3 and pull the rows that are linked to them, directly or through others, into it.
    """
    s = df.groupBy(session).agg(F.count(F.lit(1)).alias("c"))
    after = F.sum("c").over(W.orderBy(F.desc(session)).rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("c").over(W.partitionBy(F.lit(1)))
    s = s.withColumn("_after", F.coalesce(after, F.lit(0))).withColumn("_min", F.floor((total * percent + 99) / 100)).withColumn("_upto", F.col("_after") + F.col("c"))
    s = s.withColumn("_cal", F.min(F.when(F.col("_upto") >= F.col("_min"), F.col("_upto"))).over(W.partitionBy(F.lit(1))))
    in_sel = (F.col("_after") >= F.col("_cal"))
    s = s.withColumn("_sel", F.min(F.when(in_sel & (F.col("_upto") - F.col("_cal") >= F.col("_min")), F.col("_upto"))).over(W.partitionBy(F.lit(1))))
    s = s.withColumn("part", F.when(F.col("_after") < F.col("_cal"), 2).when(F.col("_after") < F.coalesce("_sel", F.lit(1 << 60)), 1).otherwise(0))
    parts = df.join(s.select(session, "part"), session)
    return connected_partitions(parts if test is None else parts.unionByName(test.withColumn("part", F.lit(3)).select(*parts.columns)))


def hash_sample(df: DataFrame, key: str, seed: str, n: int, exclude: DataFrame = None) -> DataFrame:
    """O1. The first n keys by content hash of (seed, key); `exclude` is left out first. A frame of fewer than n keys is refused."""
    d = df if exclude is None else df.join(exclude.select(key), key, "left_anti")
    held = d.count()
    if held < n:
        raise ValueError(f"the frame holds {held} keys, {n} are asked for")
    return d.withColumn("selection_key", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key)), 256)).orderBy("selection_key", key).limit(n)


def freeze_at_boundary(df: DataFrame, order, batch: int, min_c: int, min_i: int) -> DataFrame:
    """O2. First batch boundary at which cumulative candidates and cumulative issuers with candidates reach their targets; null when never.

    Rows are summed per batch of positions first, and the running totals over batches are themselves split by range.
    """
    from tidemark.operators.ranking import positions, running_totals
    p = positions(df, order)
    last = p.groupBy((F.floor(F.col("position") / batch) + 1).alias("b")).agg(F.sum("candidates").alias("c"), F.count_if(F.col("candidates") > 0).alias("i"), F.count(F.lit(1)).alias("rows"))
    run = running_totals(last, [F.asc("b")], ["c", "i"]).withColumnsRenamed({"cum_c": "cum_candidates", "cum_i": "cum_issuers"})
    ok = (F.col("rows") == batch) & (F.col("cum_candidates") >= min_c) & (F.col("cum_issuers") >= min_i)
    return run.agg(F.min(F.when(ok, F.col("b") * batch)).alias("stop_position"), F.min(F.when(ok, F.struct("b", "cum_candidates", "cum_issuers"))).alias("_s")).select("stop_position", "_s.cum_candidates", "_s.cum_issuers")
