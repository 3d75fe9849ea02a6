"""SparkSession helpers: one place for the configs every job relies on."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folder of the stage tables of the scope that is open, if any.
_SCOPE: contextvars.ContextVar[str | None] = contextvars.ContextVar("stage_scope", default=None)

#: Rows of a fact that one task sorts and groups at a time (order lines: about 200 MB of execution memory).
ROWS_PER_TASK = 500_000

#: Records of materials (stock, master, consumption) that one task sorts and merges at a time; they are wide.
RECORDS_PER_TASK = 100_000


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "stowage") -> SparkSession:
    """Session tuned for the planner's jobs.

    AQE is on so that small data-derived sides (cost centers, histograms) are
    turned into broadcast joins at runtime only after their real size is seen,
    and so that skewed material keys get split by the skew-join rule.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    parts = shuffle_partitions or os.environ.get("STOWAGE_SHUFFLE_PARTITIONS")
    if not parts and master and master.startswith("local"):
        parts = 8
    if parts:  # otherwise the cluster's own setting holds
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    spark = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STOWAGE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parts_for(spark: SparkSession, rows: int, per_task: int | None = None) -> int | None:
    """Partitions that give each task ``per_task`` rows (of a fact, ROWS_PER_TASK); None where the session's own number suffices.

    The session's number is fixed, and coalescing (AQE) leaves as few partitions as there are cores, so the share of a
    task would grow with the fact; partitions given to ``repartition`` are kept as they are.
    """
    need = -(-rows // (per_task or ROWS_PER_TASK))
    own = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return need if need > own else None


def material_parts(spark: SparkSession, records: int) -> int | None:
    """:func:`parts_for` of the steps that sort and merge records by material."""
    return parts_for(spark, records, RECORDS_PER_TASK)


def dealt(df, parts: int | None, *keys: str):
    """``df`` in ``parts`` partitions by the keys, if given.

    Both sides of a join are dealt: a side dealt into fewer partitions than the session's would be shuffled again.
    """
    return df.repartition(parts, *keys) if parts else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when none is configured.

    On a cluster the folder must be shared storage named by ``spark.checkpoint.dir``;
    a machine-local temporary folder is used only for local masters (tests, bench).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    local = tempfile.mkdtemp(prefix="stowage-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a stage table, under the shared checkpoint folder."""
    folder = _SCOPE.get() or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def stage_scope(spark: SparkSession):
    """Stage tables written inside are removed at the end: use their results, or save them, before it."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/scope-{uuid.uuid4().hex}"
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str = "stage", bounded: bool = False):
    """Write ``df`` as parquet under the reliable checkpoint folder and continue from the copy.

    Used for reduced tables read by several branches of a plan (per-material
    consumption stats): the facts are scanned once, the lineage is cut, and the
    written table survives executor loss.  The read-back also carries real size
    statistics, so AQE can pick broadcast joins from measured sizes.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    # tables with a bound independent of the data (category, curve, plan tables) go to one file, after an exchange:
    # what computes them keeps its own parallelism
    (df.repartition(1) if bounded else df).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # with the schema known, no footer is read
