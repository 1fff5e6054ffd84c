"""Exact type-7 quantiles of groups of any size.

A built-in exact percentile keeps a whole group's values in one task. Here each round counts rows per (group, bin), finds the bins holding the wanted
order statistics and looks only inside those. A bin is a slice of an octave, numbered by sign and floor(log2|x| * 2^k), which never falls as x rises; so bins follow the
values' own scale, need no choice of unit and no clamp, and a group has at most 2^k bins for every octave its values cover.
"""
from pyspark.sql import DataFrame, Window as W, functions as F

ROUNDS = (6, 19)  # slices per octave as powers of two: about a thousand bins in the first round for values over sixteen octaves


def exact_quantiles(df: DataFrame, keys, value: str, levels, out="q") -> DataFrame:
    """A5. One row per group: n and `out`, the array of quantiles at `levels` (linear interpolation between order statistics). Null and NaN values are left out.

    `keys` must be non-null. Cost is one aggregate per round over a shrinking part of the rows.
    """
    keys = list(keys)
    levels = sorted(levels)
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)")
    rounds = ROUNDS

    def bin_of(k):
        place = F.floor(F.log2(F.abs(F.col("_x"))) * float(2 ** k)) + (1100 << k)  # above zero for every double
        return F.when(F.col("_x") > 0, place).when(F.col("_x") < 0, -place).otherwise(F.lit(0)).cast("long")

    first = rows.groupBy(*keys, bin_of(rounds[0]).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = first.groupBy(*keys).agg(F.sum("_c").alias("n"))
    asks = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p")) for i, p in enumerate(levels)])
    want = (sizes.withColumn("_a", F.explode(asks)).select(*keys, "n", "_a._i", ((F.col("n") - 1) * F.col("_a._p")).alias("_pos"))
            .withColumn("_lo", F.floor("_pos")).withColumn("_frac", F.col("_pos") - F.col("_lo"))
            .withColumn("_rank", F.explode(F.array(F.col("_lo"), F.least(F.col("_lo") + 1, F.col("n") - 1))))
            .withColumn("_which", F.when(F.col("_rank") > F.col("_lo"), 1).otherwise(0)))
    want = want.select(*keys, "n", "_i", "_frac", "_which", "_rank").distinct()

    def locate(counts, want, on, cell):
        """Which cell holds each wanted rank, and the rank left inside it."""
        run = W.partitionBy(*on).orderBy(cell).rowsBetween(W.unboundedPreceding, 0)
        spans = counts.withColumn("_to", F.sum("_c").over(run)).withColumn("_from", F.col("_to") - F.col("_c"))
        return (want.join(spans, on).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
                .withColumn("_rank", F.col("_rank") - F.col("_from")).drop("_from", "_to", "_c"))

    want = locate(first, want, keys, "_b")
    for k_prev, k in zip(rounds, rounds[1:]):
        inside = rows.withColumn("_b", bin_of(k_prev)).join(want.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
        counts = inside.groupBy(*keys, "_b", bin_of(k).alias("_b2")).agg(F.count(F.lit(1)).alias("_c"))
        want = locate(counts, want, [*keys, "_b"], "_b2").drop("_b").withColumnRenamed("_b2", "_b")
    inside = rows.withColumn("_b", bin_of(rounds[-1])).join(want.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    values = inside.groupBy(*keys, "_b", "_x").agg(F.count(F.lit(1)).alias("_c"))
    found = locate(values, want, [*keys, "_b"], "_x")
    pair = found.groupBy(*keys, "n", "_i", "_frac").agg(F.max(F.when(F.col("_which") == 0, F.col("_x"))).alias("_v0"), F.max(F.when(F.col("_which") == 1, F.col("_x"))).alias("_v1"))
    point = pair.select(*keys, "n", "_i", (F.col("_v0") + F.col("_frac") * (F.coalesce("_v1", "_v0") - F.col("_v0"))).alias("_q"))
    return (point.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_qs"))
            .select(*keys, "n", F.transform("_qs", lambda s: s["_q"]).alias(out)))
