"""Session helpers shared by tests, the benchmark and the command line."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("parapheur")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a scratch one only for a local session that names none."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="parapheur-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it again.

    Cuts the lineage like a checkpoint, but columnar and compressed: later branches read only the columns they use. A new name
    each time keeps runs apart. The table is removed when the application ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Removes the tables that ``written`` has left so far, for sessions that outlive a pipeline; results not yet stored are lost."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/tables")
    system = where.getFileSystem(context._jsc.hadoopConfiguration())
    found = len(system.listStatus(where)) if system.exists(where) else 0
    system.delete(where, True)
    return found


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input is small enough to come in fewer pieces than there are cores.

    Input of at least one scan split a core is left where it is; its size is that of its files, no plan is made for it.
    """
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * int(split) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a file or a folder of parts)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
