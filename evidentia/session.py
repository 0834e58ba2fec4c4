"""Session factory: adaptive execution, UTC, Arrow."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="evidentia-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, prefix: str) -> str:
    return f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes a core, as the plan's statistics have them, below which a table is dealt out.
LEAST_SPLIT = 1 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table over all cores, for work that costs far more than moving its rows; any other as it is.

    Small tables mostly lie in one row group, which is one task however many cores there are. What moves is LEAST_SPLIT a core
    at most; a larger table has splits enough, and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * LEAST_SPLIT else df


#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """What the operators ask of a session, for plans that run after they have returned: few rows in an Arrow batch, as texts are
    long, which bounds what executors and their Python workers hold. A lower setting stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def local_session(cores: int = 8, shuffle_partitions: int | None = None, name: str = "evidentia") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted configuration decides."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EVIDENTIA_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
