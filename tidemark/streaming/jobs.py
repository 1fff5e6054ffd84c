"""Structured Streaming jobs: opening monitor, official opens, cluster dedupe, latest feature revisions and label release.

Every job is a function from streaming DataFrames to a streaming DataFrame (or a started query); state is bounded by a watermark, and aggregates are built in, so no
Python runs per row.
"""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.plans.enrich import opening_prints, suspect_print

LATENESS = "65 seconds"


def opening_status(open_col="open_utc", seconds=60, lag=5) -> Column:
    """Status of a qualifying print: exchange time not before the open, received 0 to `lag` seconds after it and within the opening window."""
    t, got, start = F.col("t"), F.col("received_at"), F.col(open_col)
    late = (t < start) | (got < t) | (got > start + F.make_dt_interval(secs=F.lit(seconds))) | (got > t + F.make_dt_interval(secs=F.lit(lag)))
    return F.when(late, "outside_timing_limits").otherwise("observed")


def stream_opening(trades: DataFrame, opens: DataFrame, listings: DataFrame, lateness=LATENESS) -> DataFrame:
    """T1. Counts per symbol, session and status over tumbling minutes of receipt; prints received after the opening window are not counted.

    The watermark follows the receipt clock, on which rows arrive nearly in order, so a print reported long after its exchange time is counted as outside the limits and
    not dropped as late.
    """
    q = opening_prints(trades.withWatermark("received_at", lateness), opens, listings).withColumn("status", opening_status()).filter(F.col("received_at") <= F.col("open_utc") + F.make_dt_interval(secs=F.lit(60)))
    return q.groupBy(F.window("received_at", "1 minute"), "symbol", "session", "status").agg(F.count(F.lit(1)).alias("n"))


def stream_official_open(trades: DataFrame, opens: DataFrame, listings: DataFrame, lateness=LATENESS, seconds=60) -> DataFrame:
    """T2. The unique qualifying open of each (symbol, session), emitted once, in append mode, when the watermark passes the end of the opening minute.

    Prints differ exactly when the smallest and the largest (id, time, price) differ, so two built-in aggregates hold the whole state of a key. Only prints with condition Q move
    the watermark: their filter does not read the clock, so the optimizer puts it below.
    """
    q = opening_prints(trades.withWatermark("t", lateness), opens, listings).filter((F.col("t") >= F.col("open_utc")) & (F.col("t") < F.col("open_utc") + F.make_dt_interval(secs=F.lit(seconds))))
    suspect = suspect_print()
    print_ = F.when(~suspect, F.struct("trade_id", "t", "price"))
    g = q.groupBy(F.window("t", "1 minute"), "symbol", "session").agg(F.count_if(suspect).alias("suspects"), F.min(print_).alias("_a"), F.max(print_).alias("_b"))
    reason = F.when((F.col("suspects") > 0) | (F.col("_a") != F.col("_b")), "ambiguous_official_open").when(F.col("_a").isNull(), "no_official_open")
    return g.select("symbol", "session", reason.alias("reason"), F.when(reason.isNull(), F.col("_a.price")).alias("official_open"))


def stream_dedupe(news: DataFrame, delay="2 days", time="published_at", cluster="cluster_id") -> DataFrame:
    """T3. First arrival of every cluster; a repeat within the watermark is dropped."""
    return news.withWatermark(time, delay).dropDuplicatesWithinWatermark([cluster])


def stream_latest(features: DataFrame, folder: str, checkpoint: str, keys=("security_id", "name")):
    """T4. Forward-observed feature state: each batch writes its own latest revision per key under its batch number, so a repeated batch overwrites itself."""
    def upsert(batch, batch_id):
        rest = [c for c in batch.columns if c not in keys]
        top = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("known_at", "revision_id")).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])
        top.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return features.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(d: DataFrame, keys) -> DataFrame:
    rest = [c for c in d.columns if c not in (*keys, "batch", "upto")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("known_at", "revision_id")).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def _base(spark: SparkSession, folder: str):
    """The newest compacted state and the batch it reaches to; None and -1 before the first compaction."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}-base")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None, -1
    d = spark.read.parquet(f"{folder}-base")
    upto = d.agg(F.max("upto")).first()[0]
    return (None, -1) if upto is None else (d.filter(F.col("upto") == upto).drop("upto"), upto)


def read_latest(spark: SparkSession, folder: str, keys=("security_id", "name")) -> DataFrame:
    """The current state: the latest over the compacted state and the batches after it."""
    base, upto = _base(spark, folder)
    d = spark.read.parquet(folder).filter(F.col("batch") > upto).drop("batch")
    return _latest(d if base is None else d.unionByName(base.select(*d.columns)), keys)


def compact_latest(spark: SparkSession, folder: str, keys=("security_id", "name")) -> int:
    """Fold all batches so far into one state, written whole beside them; later reads start there and prune the older batches' folders, which may then be deleted."""
    last = spark.read.parquet(folder).agg(F.max("batch")).first()[0]
    read_latest(spark, folder, keys).write.mode("overwrite").parquet(f"{folder}-base/upto={last}")
    return last


def longest_wait(calendar, sessions=1) -> int:
    """Days from an event's cutoff to the close of its reaction session n, at most, over a whole calendar; the time bound of label release. One row is read."""
    days = calendar.sessions.select("idx", "session")
    later = days.select((F.col("idx") - sessions - 1).alias("idx"), F.col("session").alias("to"))
    return (days.join(later, "idx").agg(F.max(F.datediff("to", "session"))).first()[0] or 0) + 2


def stream_labels(news: DataFrame, bars: DataFrame, bound: str, delay="1 day") -> DataFrame:
    """T5. A day-1 label is released when its reaction bar has arrived: a stream-stream join on (security, session ordinal) with a time bound and a watermark on each side.

    `bound` is how long state is kept (`longest_wait` gives what the calendar needs); labels whose bar comes later still are what `late_labels` finds.
    """
    n = news.withWatermark("cutoff", delay).select("event_id", F.col("security_id").alias("n_security"), F.col("reaction_idx").alias("n_idx"), "cutoff")
    b = bars.withWatermark("available_at", delay).select("security_id", "idx", "close", "available_at")
    on = (F.col("n_security") == F.col("security_id")) & (F.col("n_idx") == F.col("idx")) & (F.col("available_at") >= F.col("cutoff")) & (F.col("available_at") <= F.col("cutoff") + F.expr(f"interval {bound}"))
    return n.join(b, on).select("event_id", "security_id", "idx", "close", F.col("available_at").alias("label_available_at"))


def late_labels(news: DataFrame, bars: DataFrame, released: DataFrame) -> DataFrame:
    """Labels that the stream did not release because their bar came after its time bound: a batch join of what has arrived, without what is out."""
    b = bars.select("security_id", F.col("idx").alias("reaction_idx"), "close", "available_at")
    due = news.filter("reaction_idx is not null").join(b, ["security_id", "reaction_idx"]).filter("available_at >= cutoff")
    return due.join(released.select("event_id").distinct(), "event_id", "left_anti").select("event_id", "security_id", F.col("reaction_idx").alias("idx"), "close", F.col("available_at").alias("label_available_at"))


def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode="append"):
    """Drain what is available into Parquet. In update mode each batch's changed rows are kept under the batch number; the last one of a key is its value."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(batch, batch_id):
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/b{batch_id}")
        q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def last_update(spark: SparkSession, folder: str, keys) -> DataFrame:
    d = spark.read.parquet(f"{folder}/b*")
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])
