"""Point-in-time joins that never pair the rows of one entity with each other.

Both operators cut time into buckets, so that an entity holding a third of all rows is spread over its buckets; what earlier buckets contribute
arrives as one extra row per bucket. Work grows with the rows, not with rows times rows.
"""
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.ranking import positions, prefix_sums
from tidemark.operators.validate import HISTORICAL, available_at

DAY = 86_400_000_000
GRAINS = (DAY, 1_800_000_000, 20_000_000)  # a day, half an hour, twenty seconds, in microseconds


LEVELS = 24  # blocks of up to 2^23 buckets: the longest interval of days between two timestamps needs 22


def canonical_blocks(low, high):
    """The half-open range [low, high) of whole numbers as an array of struct(level, block), block b of level k being [b * 2^k, (b + 1) * 2^k): at most two per level."""
    def at(k):
        size = F.pow(F.lit(2.0), k)
        a, b = F.ceil(low / size), F.floor(high / size)
        last = k == LEVELS - 1
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        left, right = F.when((a < b) & odd(a), F.struct(k.alias("level"), a.alias("block"))), F.when((a < b) & odd(b), F.struct(k.alias("level"), (b - 1).alias("block")))
        return F.when(last, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda x: F.when(a < b, F.struct(k.alias("level"), x.alias("block"))))).otherwise(F.array(left, right))
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at)), lambda x: x.isNotNull())


def asof_features(cutoffs: DataFrame, features: DataFrame, mode=HISTORICAL, entity="security_id", cutoff="cutoff") -> DataFrame:
    """J1. For each distinct (entity, cutoff) and feature name: the latest revision available, valid and mature at the cutoff.

    A revision is eligible during [start, end), start the latest of its availability, validity and label clocks. Of the eligible revisions the one with the
    largest (available, revision_id) wins. Each interval is assigned the coarsest grain whose buckets it spans, and there falls into three parts:
    a running maximum inside its first bucket, a reverse running maximum inside its last, and the buckets between, covered by at most two blocks per power of two, so that
    the distance of an end (9999-12-31, say) does not matter. Open-ended intervals carry over to all later buckets by a running maximum over buckets.
    """
    us = F.unix_micros
    known = available_at("available_at", "first_seen_at", mode)
    r = (features.withColumn("_known", known)
         .select(F.col(entity).alias("_e"), "name", us(F.greatest(F.col("_known"), "valid_from", F.coalesce("label_available_at", "valid_from"))).alias("_s"),
                 us(F.col("valid_to")).alias("_x"), F.struct(us(F.col("_known")).alias("available"), F.col("revision_id"), F.col("value")).alias("_r"))
         .filter("_x is null or _x > _s"))
    level = reduce(lambda acc, i: F.when(F.floor(F.col("_s") / GRAINS[i]) != F.floor(F.col("_x") / GRAINS[i]), i).otherwise(acc),
                   reversed(range(len(GRAINS))), F.lit(-1))
    width = F.element_at(F.array(*[F.lit(g) for g in GRAINS]), F.col("_g") + 1)
    r = r.withColumn("_g", F.when(F.col("_x").isNull(), 0).otherwise(level))
    tiny = r.filter("_g = -1")  # intervals shorter than the finest bucket and inside one
    r = r.filter("_g >= 0").withColumn("_w", width).withColumn("_bs", F.floor(F.col("_s") / F.col("_w"))).withColumn("_bx", F.floor(F.col("_x") / F.col("_w")))

    asks = cutoffs.select(F.col(entity).alias("_e"), us(F.col(cutoff)).alias("_t")).distinct()
    combos = r.select("_e", "name", "_g", "_w").distinct()  # only the grains an entity's features really use
    asks_b = asks.join(combos, "_e").select("_e", "name", "_g", F.floor(F.col("_t") / F.col("_w")).alias("_b"), "_t")
    none = F.lit(None).cast(r.schema["_r"].dataType)

    # what whole buckets contribute: finite intervals by the blocks of the buckets they cover, met by the asked buckets' own blocks; open ones by a running maximum over buckets
    blocks = (r.filter("_x is not null and _bx > _bs + 1").withColumn("_c", F.explode(canonical_blocks(F.col("_bs") + 1, F.col("_bx"))))
              .groupBy("_e", "name", "_g", "_c").agg(F.max("_r").alias("_full")))
    asked = asks_b.select("_e", "name", "_g", "_b").distinct()
    covered = (asked.withColumn("_c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), F.floor(F.col("_b") / F.pow(F.lit(2.0), k)).alias("block")))))
               .join(blocks, ["_e", "name", "_g", "_c"]).groupBy("_e", "name", "_g", "_b").agg(F.max("_full").alias("_full")))
    opened = r.filter("_x is null").groupBy("_e", "name", "_g", F.col("_bs").alias("_b")).agg(F.max("_r").alias("_open"))
    buckets = (covered.select("*", none.alias("_open")).unionByName(opened.select("_e", "name", "_g", "_b", none.alias("_full"), "_open"))
               .unionByName(asks_b.select("_e", "name", "_g", "_b").distinct().select("*", none.alias("_full"), none.alias("_open")))
               .groupBy("_e", "name", "_g", "_b").agg(F.max("_full").alias("_full"), F.max("_open").alias("_open")))
    before = W.partitionBy("_e", "name", "_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    base = buckets.select("_e", "name", "_g", "_b", F.greatest("_full", F.max("_open").over(before)).alias("_r")).filter("_r is not null")

    def rows(df, kind, t, rank):
        return df.select("_e", "name", "_g", "_b", t.alias("_t"), F.lit(kind).alias("_k"), rank.alias("_r"))

    line = (rows(base, 0, F.col("_b") * 0 - 1, F.col("_r"))
            .unionByName(rows(r.withColumn("_b", F.col("_bs")), 0, F.col("_s"), F.col("_r")))
            .unionByName(rows(asks_b, 1, F.col("_t"), none))
            .unionByName(rows(r.filter("_x > _bx * _w").withColumn("_b", F.col("_bx")), 2, F.col("_x"), F.col("_r"))))
    part = W.partitionBy("_e", "name", "_g", "_b")
    forward = F.max(F.when(F.col("_k") == 0, F.col("_r"))).over(part.orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0))
    backward = F.max(F.when(F.col("_k") == 2, F.col("_r"))).over(part.orderBy(F.desc("_t"), "_k").rowsBetween(W.unboundedPreceding, 0))
    found = line.withColumn("_a", forward).withColumn("_z", backward).filter("_k = 1").select("_e", "name", "_t", F.greatest("_a", "_z").alias("_r"))
    finest = GRAINS[-1]
    brief = (tiny.withColumn("_b", F.floor(F.col("_s") / finest)).alias("r")
             .join(asks.withColumn("_b", F.floor(F.col("_t") / finest)).alias("q"), ["_e", "_b"])
             .filter("_s <= _t and _t < _x").select("_e", "name", "_t", "_r"))
    return (found.unionByName(brief).groupBy("_e", "name", "_t").agg(F.max("_r").alias("_r")).filter("_r is not null")
            .select(F.col("_e").alias(entity), "name", F.timestamp_micros("_t").alias(cutoff), "_r.revision_id", "_r.value",
                    F.timestamp_micros("_r.available").alias("available_at")))


def asof_sums(facts: DataFrame, queries: DataFrame, keys, at: str, cutoff: str, measures: dict, strict=False) -> DataFrame:
    """J7. Sums over everything of the same key known by a cutoff: available at or before it, or (strict) before it.

    Facts are first summed per (key, instant), a partial aggregate, and asked for once per (key, cutoff); both stand on one line of time per key, over which sums run. The line is cut
    by ranges of (key, instant), so one key, or one day of one key, may hold any share of the rows. Returns one row per distinct (key, cutoff).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    f = facts.filter(F.col(at).isNotNull()).groupBy(*keys, F.unix_micros(F.col(at)).alias("_t")).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    q = queries.select(*keys, F.unix_micros(F.col(cutoff)).alias("_t")).distinct()
    none = [F.lit(None).cast(f.schema[m].dataType).alias(m) for m in measures]
    line = f.select(*keys, "_t", F.lit(2 if strict else 0).alias("_k"), *measures).unionByName(q.select(*keys, "_t", F.lit(1).alias("_k"), *none))
    return prefix_sums(line, [F.asc("_t"), F.asc("_k")], list(measures), keys).filter("_k = 1").select(*keys, F.timestamp_micros("_t").alias(cutoff), *measures)


def dominance_sums(facts: DataFrame, queries: DataFrame, keys, at: str, cutoff: str, ends: str, bound: str, measures: dict, strict=True) -> DataFrame:
    """J8. Sums over the facts of the same key that are known before the cutoff (`strict=False`: by it) and ended before the bound: two clocks, each with its own limit.

    Bounds are numbered per key, and a fact gets the number of the first bound after its end. The bounds up to one number are a sum of whole blocks, one for each binary digit of it, so a
    fact enters a block of every size and a query asks one block a digit; in each block the other clock is an as-of sum. No fact meets a query, and work grows with the logarithm of
    the number of bounds. Returns one row per distinct (key, cutoff, bound); queries without a bound are not answered, facts without an end never count.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    q = queries.select(*keys, cutoff, F.col(bound).alias("_y")).filter("_y is not null").distinct()
    bounds = positions(q.select(*keys, "_y").distinct(), [F.asc("_y")], keys, out="_n")
    f = facts.filter(F.col(ends).isNotNull() & F.col(at).isNotNull()).groupBy(*keys, F.col(at).alias("_a"), F.col(ends).alias("_e")).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    first = asof_sums(bounds, f, keys, "_y", "_e", {"_first": F.lit(1)})  # bounds at or before the end: the first one after it has this number
    size = bounds.groupBy(*keys).agg(F.max("group_n").alias("_size"))
    block = lambda n, k: F.floor(n / F.pow(F.lit(2.0), k)).cast("long")
    levels = F.sequence(F.lit(0), F.floor(F.log2("_size")).cast("int"))
    entered = f.join(first, [*keys, "_e"]).join(size, keys).filter(F.col("_first") < F.col("_size"))
    entered = (entered.withColumn("_l", F.explode(F.filter(levels, lambda k: block(F.col("_first"), k) % 2 == 0)))  # an even block is the last one of some bounds, an odd one never
               .withColumn("_b", block(F.col("_first"), F.col("_l"))).select(*keys, "_l", "_b", "_a", *measures))
    asked = q.join(bounds, [*keys, "_y"]).withColumn("_size", F.col("_n") + 1)
    asked = asked.withColumn("_l", F.explode(F.filter(levels, lambda k: block(F.col("_size"), k) % 2 == 1))).withColumn("_b", block(F.col("_size"), F.col("_l")) - 1).select(*keys, cutoff, "_y", "_l", "_b")
    sums = asof_sums(entered, asked, [*keys, "_l", "_b"], "_a", cutoff, {m: F.col(m) for m in measures}, strict)
    return (asked.join(sums, [*keys, "_l", "_b", cutoff], "left").groupBy(*keys, cutoff, F.col("_y").alias(bound)).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]))


def join_asof_sums(queries: DataFrame, facts: DataFrame, keys, at: str, cutoff: str, measures: dict, strict=False) -> DataFrame:
    """`asof_sums` joined back to the asking rows by equality on (key, cutoff)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return queries.join(asof_sums(facts, queries, keys, at, cutoff, measures, strict), [*keys, cutoff], "left")


def latest_revision(df: DataFrame, keys, available="available_at", revision="revision_id") -> DataFrame:
    """W1. Latest revision per key, by a partial-aggregated max over a struct instead of a sort per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(available, revision)).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, *[f"_r.{c}" for c in rest])


def dedupe_clusters(events: DataFrame, cluster="cluster_id", order=("cutoff", "event_id"), by=()) -> DataFrame:
    """W2, W3. The earliest event of every cluster (and of every `by` group): a partial-aggregated min over a struct."""
    keys = [*by, cluster]
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])
