"""What the operators need from the session: a place for cut lineage, and enough tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a temporary folder, as one machine is all it has.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="keysift-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def unmanaged_mb(spark: SparkSession) -> float:
    """Megabytes of heap for each task of an executor that runs as many as it can, of what Spark does not
    keep for caching and for its own operators."""
    sc = spark.sparkContext
    conf = sc.getConf()
    if sc.master == "local" or sc.master.startswith("local["):
        heap, tasks = sc._jvm.java.lang.Runtime.getRuntime().maxMemory() >> 20, sc.defaultParallelism
    else:
        heap = sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsMb(conf.get("spark.executor.memory", "1g"))
        # The driver is one of those listed.
        executors = max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1)
        cores = int(conf.get("spark.executor.cores", "0")) or -(-sc.defaultParallelism // executors)
        tasks = cores // int(conf.get("spark.task.cpus", "1"))
    # Spark leaves 300 MB alone before it takes its share.
    return (heap - 300) * (1 - float(conf.get("spark.memory.fraction", "0.6"))) / max(1, tasks)


def small_batches(df: DataFrame) -> None:
    """At most 1,000 rows to a Python worker at once, from now on in this session: texts can be long,
    and by default 10,000 of them would be held three times over."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= 1000:
        conf.set(key, "1000")


def spread(scan: DataFrame, partitions: int) -> DataFrame:
    """Deal the rows of a table scan evenly to at least so many partitions, by an exchange of its rows.

    The partitions of a scan say little about its rows: Spark cuts a file by size, but a row group is read
    by one task, so that most parts of a large file may be empty. Text functions cost far more than the
    exchange. Only for scans: counting the partitions of a plan with shuffles would run them.
    """
    if scan.isStreaming:
        return scan
    return scan.repartition(max(partitions, scan.rdd.getNumPartitions()))
