"""Session settings and the few cluster-facing helpers every job shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# A side is broadcast only while its statistics prove it below this many bytes.
BROADCAST_BYTE_LIMIT = 32 << 20
# Statistics count the bytes of compressed files (an index of the dictionary of 120,000 products: 2.3 MB). Short texts are taken to
# need eight times as much as a hash table, which the driver holds whole; an estimate, not a measured ratio.
PACKED_BYTE_LIMIT = BROADCAST_BYTE_LIMIT // 8


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the jobs rely on; safe to call repeatedly."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_directory(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the session's own setting comes first."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current is None:
        if not _is_local(spark):
            raise ValueError(
                "set spark.checkpoint.dir to a folder all executors share"
            )
        current = tempfile.mkdtemp(prefix="lumenmart-checkpoint-")
        context.setCheckpointDir(current)
    return current


_STAGED: list[str] = []
# called when staged tables go, so that nobody keeps a frame over deleted files
ON_DROP: list[Callable[[], None]] = []


def stage_observed(frame: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """``stage`` that also returns aggregates of the rows, taken while they are written."""
    seen = Observation()
    return stage(frame.observe(seen, *measures)), seen.get


def stage(frame: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared checkpoint folder and read it back.

    Used where a result feeds several branches or an iteration: the work is done
    once, lineage ends at files a lost executor can re-read, and the scan that
    follows prunes columns and knows its size.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_directory(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for files and stream state; ``drop_staged`` removes it."""
    path = f"{checkpoint_directory(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def drop_staged(spark: SparkSession) -> None:
    """Remove the staged tables and work folders of this process; call when results were consumed."""
    for forget in ON_DROP:
        forget()
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        target.getFileSystem(hadoop).delete(target, True)


def broadcast_if_small(frame: DataFrame, limit: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Broadcast a side whose optimized plan is known to stay below ``limit`` bytes; else leave the choice to AQE.

    Reads plan statistics only (file sizes and bounds), so no job runs here.
    """
    return F.broadcast(frame) if plan_bytes(frame) <= limit else frame


def plan_bytes(frame: DataFrame) -> int:
    """Size of a frame by its plan's statistics."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a scan of few file splits; a scan of many splits is left as is."""
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


def dealt_out(rows: DataFrame) -> DataFrame:
    """Few bytes that need much work per row, dealt out evenly over several tasks per core; AQE would join them to tasks of equal bytes."""
    session = rows.sparkSession
    return rows.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
