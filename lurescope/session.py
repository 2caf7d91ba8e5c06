"""Session helpers for tests, the bench and command-line use.

Library code never builds a session; it takes the caller's.  The settings
below are the ones the operators are tuned for: AQE on (runtime broadcast of
small join sides, partition coalescing, skew-join splitting), UTC session time
and Arrow for the few Python stages.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

RECOMMENDED_CONF = {
    # Partition sizing: scan splits and post-shuffle partitions of ~128 MB
    # keep tasks within executor memory at any scale; AQE coalesces small
    # shuffle partitions and splits skewed ones at runtime.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "lurescope") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.ansi.enabled", "true"))
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when it is unset a private folder is made, and only for a local
    master: on a cluster every executor would write to its own disk.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local") or \
                spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="lurescope-ckpt-", dir="/tmp")
        # the setting itself cannot change any more; Spark makes a folder of its own in this one
        spark.sparkContext.setCheckpointDir(current)
        current = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder exists, in any file system that Spark reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, if it exists, in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Whether a job's shuffle files go with the job, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the jobs started within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def releasing_shuffles(spark: SparkSession):
    """The jobs started within take their shuffle files along when they end.  Only for writes:
    a DataFrame that is executed again would have to shuffle anew."""
    return setting(spark, SHUFFLE_CLEANUP, "true")


def release_shuffles_of(df) -> None:
    """Remove the shuffle files that the rows of ``df`` were made from; only for one, such as
    a micro-batch, that nothing reads again."""
    cleaner, todo, seen = df.sparkSession._jsc.sc().cleaner(), [df._jdf.queryExecution().toRdd()], set()
    while todo and cleaner.isDefined():
        rdd = todo.pop()
        if rdd.id() in seen:
            continue
        seen.add(rdd.id())
        for k in range(rdd.dependencies().size()):
            by = rdd.dependencies().apply(k)
            if by.getClass().getName() == "org.apache.spark.ShuffleDependency":
                cleaner.get().doCleanupShuffle(by.shuffleId(), True)
            todo.append(by.rdd())


def materialize(df, name: str):
    """Write ``df`` as a parquet table below the shared checkpoint folder and
    return a scan of it.

    Used between table jobs: it cuts lineage (a lost executor re-reads the
    table instead of recomputing the upstream jobs), keeps later query plans
    small, and the scan gets column pruning and filter pushdown.
    """
    import uuid
    spark = df.sparkSession
    path = shared_path(spark, f"tables/{name}-{uuid.uuid4().hex[:12]}")
    with releasing_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
