"""Positions and running totals over a whole table or a hot group, without a single-task window.

Rows are range-partitioned on the full ordering (whose tie-break makes it unique, so a value shared by a third of the rows still splits) and written once; what
comes before a partition is one small row per partition and group in it.
"""
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.runtime import cut_lineage, written


def range_partitioned(df: DataFrame, order) -> DataFrame:
    """Rows in global order with their partition number `_p` and place in it `_i`; materialised, so every reader sees the same split."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return cut_lineage(ranged.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))


def positions(df: DataFrame, order, by=(), out="position") -> DataFrame:
    """0-based position of every row in `order` (inside its `by` group), and the group's size as `group_n`."""
    keys = list(by)
    rows = range_partitioned(df, [F.col(k) for k in keys] + list(order))
    sizes = rows.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_i").alias("_first"))  # a few rows per partition
    w = W.partitionBy(*keys).orderBy("_p")
    before = sizes.select(*keys, "_p", "_first", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(W.partitionBy(*keys)).alias("group_n"))
    return rows.join(written(before), [*keys, "_p"]).withColumn(out, F.col("_before") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_before")


def running_totals(df: DataFrame, order, measures, by=()) -> DataFrame:
    """`cum_<m>`: sum of each measure over all rows of the group up to and including this one in `order`."""
    keys = list(by)
    rows = range_partitioned(df, [F.col(k) for k in keys] + list(order))
    parts = rows.groupBy(*keys, "_p").agg(*[F.sum(m).alias("_t_" + m) for m in measures])
    w = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select(*keys, "_p", *[F.coalesce(F.sum("_t_" + m).over(w), F.lit(0)).alias("_b_" + m) for m in measures])
    inside = W.partitionBy(*keys, "_p").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    return (rows.join(written(before), [*keys, "_p"])
            .select("*", *[(F.col("_b_" + m) + F.sum(m).over(inside)).alias("cum_" + m) for m in measures]).drop("_p", "_i", *["_b_" + m for m in measures]))


def prefix_sums(df: DataFrame, order, measures, by) -> DataFrame:
    """Each measure becomes its sum over all rows of the group up to and including this one in `order` (nulls add nothing); a group of any size spreads over the range partitions.

    A key that goes on in the next partition takes the sums of those before it. Partitions are cut in the order of the keys, so only the first key of a partition can come from an
    earlier one: what is carried is at most one row a partition, small enough to broadcast whatever the data.
    """
    keys = list(by)
    rows = range_partitioned(df, [F.col(k) for k in keys] + list(order))
    parts = rows.groupBy(*keys, "_p").agg(*[F.sum(m).alias(m) for m in measures])
    w = W.partitionBy(*keys).orderBy("_p")  # one row a partition
    before = parts.select(*keys, "_p", F.row_number().over(w).alias("_nth"), *[F.sum(m).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_b_" + m) for m in measures]).filter("_nth > 1").drop("_nth")
    same = [F.col("r." + k).eqNullSafe(F.col("b." + k)) for k in [*keys, "_p"]]
    inside = W.partitionBy(*keys, "_p").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    joined = rows.alias("r").join(F.broadcast(before).alias("b"), reduce(lambda a, b: a & b, same), "left").select("r.*", *["b._b_" + m for m in measures])
    total = lambda m: F.coalesce("_b_" + m, F.lit(0)) + F.coalesce(F.sum(m).over(inside), F.lit(0))
    return joined.withColumns({m: total(m) for m in measures}).drop("_p", "_i", *["_b_" + m for m in measures])


def equal_bins(df: DataFrame, score: str, key: str, by=(), max_bins=4, per_bin=10) -> DataFrame:
    """W14. Equal-frequency bins by (score, key): min(max_bins, n // per_bin) of them, the first n mod bins one larger; `bin` is null when there are too few rows."""
    placed = positions(df, [F.col(score).asc(), F.col(key).asc()], by)
    bins = F.least(F.lit(max_bins), F.floor(F.col("group_n") / per_bin))
    return placed.withColumn("bin", _bin_of(F.col("position"), F.col("group_n"), bins)).drop("position")


def _bin_of(position, n, bins):
    safe = F.greatest(bins, F.lit(1))
    size = F.floor(n / safe)
    extra = n - size * safe
    big = extra * (size + 1)
    small = F.greatest(size, F.lit(1))
    return F.when(bins >= 1, F.when(position < big, F.floor(position / (size + 1))).otherwise(extra + F.floor((position - big) / small)) + 1)


def terciles(df: DataFrame, score: str, key: str, by=()) -> DataFrame:
    """W15."""
    placed = positions(df, [F.col(score).asc(), F.col(key).asc()], by)
    return placed.withColumn("tercile", F.when(F.col("group_n") >= 3, _bin_of(F.col("position"), F.col("group_n"), F.lit(3)))).drop("position")


def average_precision(df: DataFrame, score: str, outcome: str, by=()) -> DataFrame:
    """W16. Sum over distinct scores of recall gained times precision at the score; tied scores share a threshold, so rows are first summed per score."""
    keys = list(by)
    per = df.groupBy(*keys, score).agg(F.sum(outcome).alias("pos"), F.count(F.lit(1)).alias("n_at"))
    run = running_totals(per, [F.col(score).desc()], ["pos", "n_at"], keys)
    return (run.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n_at")).alias("_s"))
            .select(*keys, F.when(F.col("positives") > 0, F.col("_s") / F.nullif("positives", F.lit(0.0))).alias("average_precision")))


def top_k(df: DataFrame, order, k: int, by=()) -> DataFrame:
    """The first k rows of each group; Spark prunes to k rows per group and partition before the shuffle."""
    rn = F.row_number().over(W.partitionBy(*by).orderBy(*order)) if by else None
    if rn is None:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", rn).filter(F.col("rank") <= k)
