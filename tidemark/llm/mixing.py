"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Sources get targets (weights capped by how often a word may repeat), the mix is cut into blocks of equal size, and blocks go to sources by highest quotients
target / (2k - 1). The blocks of a source go the same way to its shards, which bound what one task orders. Inside a shard documents stand in seeded order on a ring of
words, and the shard's quota is a run of blocks from a seeded place on the ring, so all blocks are equally long and at most two documents are cut.
"""
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.common import saved, word_count
from tidemark.operators.ranking import positions, running_totals


def source_targets(sources: DataFrame, most_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """Rows (source, source_size) get `src` (place by code point, null last), weight src mod cycle + 1 and target.

    Targets share the total by weight; where most_repeats times the source's size is less, the excess is reshared by weight among the rest. The fixed point is one level
    L with target = min(weight * L, most_repeats * size), found from running sums over the sources in the order in which they fill up.
    """
    ranked = positions(sources, [F.col("source").asc_nulls_last()], out="src").select("source", "source_size", "src")
    ranked = saved(ranked.withColumn("weight", (F.col("src") % cycle + 1).cast("double")).withColumn("cap", F.col("source_size") * float(most_repeats)).withColumn("fills_at", F.col("cap") / F.col("weight")))
    run = running_totals(ranked, [F.col("fills_at").asc(), F.col("src").asc()], ["cap", "weight"])
    total, weight = ranked.agg(F.sum("source_size")).scalar(), ranked.agg(F.sum("weight")).scalar()
    level = (total - (F.col("cum_cap") - F.col("cap"))) / (weight - (F.col("cum_weight") - F.col("weight")))
    first = run.withColumn("level", level).filter(F.col("level") <= F.col("fills_at")).agg(F.min_by("level", F.struct("fills_at", "src"))).scalar()
    return saved(ranked.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * first), F.lit(0.0))).drop("fills_at", "cap"))


def sainte_lague(parties: DataFrame, by, party: str, votes: str, seats: str) -> DataFrame:
    """Adds `won`: the seats of each party, by highest quotients votes / (2k - 1) inside each `by` group; ties go to the smaller party. `seats` is the group's number.

    With V votes, n parties and N seats, the divisors V / (N + n/2) and V / (N - n/2) bound every party's seats from above and below, so that only about two or three
    quotients a party are ranked, over a range partition of all groups.
    """
    keys = list(by)
    sums = parties.groupBy(*keys).agg(F.sum(votes).alias("_v"), F.count(F.lit(1)).alias("_n"))
    p = parties.join(sums, keys)
    share = lambda n: F.when(F.col("_v") > 0, F.floor(F.col(votes) / F.col("_v") * n + 0.5)).otherwise(F.lit(0)).cast("long")
    p = saved(p.withColumn("_lo", F.greatest(F.lit(0).cast("long"), share(F.col(seats) - F.col("_n") / 2) - 1)).withColumn("_hi", share(F.col(seats) + F.col("_n") / 2) + 1))
    live = p.filter((F.col("_v") > 0) & (F.col(seats) > 0) & (F.col(votes) > 0))
    asked = live.select(*keys, party, votes, F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_k")).withColumn("_q", F.col(votes) / (2 * F.col("_k") - 1))
    placed = positions(asked, [F.col("_q").desc(), F.col(party).asc()], keys, out="_at")
    left = live.groupBy(*keys).agg((F.first(seats) - F.sum("_lo")).alias("_left"))
    won = placed.join(left, keys).filter(F.col("_at") < F.col("_left")).groupBy(*keys, party).agg(F.count(F.lit(1)).alias("_more"))
    live_lo = F.when((F.col("_v") > 0) & (F.col(seats) > 0) & (F.col(votes) > 0), F.col("_lo")).otherwise(F.lit(0))
    return p.join(won, [*keys, party], "left").withColumn("won", live_lo + F.coalesce("_more", F.lit(0))).drop("_v", "_n", "_lo", "_hi", "_more")


def mix(docs: DataFrame, block_words: int = 8, shard_words: int = 1 << 16, most_repeats: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of `docs`, however often its id repeats.

    Null and empty texts have size 0 and are never taken; null ids and null sources are values like any other; an empty table gives no rows; other columns are ignored.
    Every word stands in at most `most_repeats` blocks. Same rows and seed, same result, however the rows are dealt.
    """
    sizes = saved(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("doc_id", "text").alias("_row")))  # by id and text, so that rows without an id spread over the shards too
    sources = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), most_repeats)
    blocks = sources.agg(F.ceil(F.sum("source_size") / block_words)).scalar()
    seated = sainte_lague(saved(sources.withColumns({"one": F.lit(1), "blocks": blocks})), ["one"], "src", "target", "blocks")
    seated = saved(seated.select("source", "src", "source_size", "target", F.col("won").alias("source_blocks"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("n_shards")))
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = sizes.alias("d").join(seated.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.source", "d.size", "d._row", "s.src", "s.source_size", "s.target", "s.source_blocks", "s.n_shards")
    rows = rows.withColumn("_o", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_row"), "n_shards"))
    shards = rows.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    quota = sainte_lague(shards, ["src"], "shard", "shard_size", "source_blocks")
    quota = quota.select("src", "shard", "shard_size", F.least(F.col("won"), F.floor(F.col("shard_size") * most_repeats / block_words)).alias("quota"))
    w = W.partitionBy("src", "shard").orderBy("_o", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("_end", F.sum("size").over(w)).join(quota, ["src", "shard"])
    ring, run = F.greatest(F.col("shard_size"), F.lit(1)), F.col("quota") * block_words
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "src", "shard"), F.ceil(ring / block_words)) * block_words
    placed = placed.withColumn("_full", F.floor(run / ring)).withColumn("_rest", run - F.floor(run / ring) * ring).withColumn("_from", start).withColumn("_ring", ring)
    begin, none = F.col("_end") - F.col("size"), F.lit(0)
    ahead = F.least(F.col("_end"), F.col("_from") + F.col("_rest"), F.col("_ring")) - F.greatest(begin, F.col("_from"))
    around = F.least(F.col("_end"), F.col("_from") + F.col("_rest") - F.col("_ring")) - begin
    taken = F.col("_full") * F.col("size") + F.greatest(none, ahead) + F.greatest(none, around)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
