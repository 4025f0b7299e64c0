"""Session defaults used by the bench, the tests and interactive work.

Nothing here is needed on a cluster that already carries its own settings:
the operators only read what the session provides.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", app: str = "plansift") -> SparkSession:
    """A local session with adaptive execution, Arrow transfer and UTC time."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing, as in tests on one machine, a folder of
    this machine is made and set for the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"plansift-{os.getuid()}-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_written: list[str] = []


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage without tying the rows to one executor: a lost
    executor costs nothing but the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plansift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_settled(spark: SparkSession) -> int:
    """Delete what :func:`settle` wrote in this process; call it once results are saved."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _written:
        at = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, dealt to all cores; any other table as it is.

    Small tables come in one file that one task would read and work on alone.
    A table of many files or row groups is never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows take long to work on."""
    return spread(table(spark, sf_dir, name))


#: Rows that a side may have to be sent to all tasks.
SMALL_ROWS = 50_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``most`` rows; else as it is, for a shuffle join.

    Counting stops after ``most`` rows.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
