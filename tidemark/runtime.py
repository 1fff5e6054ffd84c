"""Session settings shared by every job, and lineage cuts that survive the loss of an executor."""
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def pin_session(spark: SparkSession) -> SparkSession:
    """Times are kept and printed in UTC; everything else is left to the cluster's own configuration."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    return pin_session(
        SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites of every column expression are not needed
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only where it names none (tests) is a local one made."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably, so that later branches read the same rows even if a task is run again."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as Parquet in the shared folder, read back: unlike a checkpoint its size in bytes is known to the planner, which then chooses the joins."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A few configured rows as a plan of literals: nothing is shipped or scanned, and the optimizer knows that the table is tiny."""
    from pyspark.sql import functions as F, types as T
    fields = T._parse_datatype_string(schema).fields

    def lit(value, dtype):
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value]).cast(dtype)
        return F.lit(value).cast(dtype)

    structs = [F.struct(*[lit(v, f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.sql("SELECT 1 AS one").select(F.inline(F.array(*structs)))


_WRITTEN = {}


def shared_table(spark: SparkSession, name, build) -> DataFrame:
    """An intermediate table that several queries read: built and written once per application, then read back."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = cut_lineage(build())
    return _WRITTEN[key]


def forget_shared_tables() -> None:
    """Build shared tables anew from here on (for timing)."""
    _WRITTEN.clear()
