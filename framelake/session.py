"""Session helpers: a local test session, table access and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framelake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table read, dealt out by ``key`` if the files give fewer partitions than there are cores.

    For stages that spend much more time on a row than it takes to move it. Large reads pass unchanged. Only for
    plans without a shuffle: counting the partitions of others would run them.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder for stored intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting (tests, a laptop) uses a temporary folder; a cluster without it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "framelake-checkpoints"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, forget: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and return the stored rows; the files outlive any lost executor.

    A stored plan keeps the size estimate of the plan before it. The estimate of a join is a product, so over
    the rounds of an iteration it becomes a number of millions of digits; ``forget`` drops it.
    """
    spark = df.sparkSession
    shared_folder(spark)
    stored = df.checkpoint(eager=True)
    if not forget:
        return stored
    plan = stored._jdf.queryExecution()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), stored._jdf.schema(), False), spark)
