"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "mixedframe") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="mixedframe-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_staged: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, which ``drop_staged`` deletes."""
    path = os.path.join(shared_dir(spark), f"mixedframe-{label}-{uuid.uuid4().hex}")
    _staged.append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables this process staged; call it when their readers are done."""
    removed = 0
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def discard(spark: SparkSession, *what: DataFrame | str) -> None:
    """Delete staged tables (or scratch paths) that nothing will read again, as after a fit that is done."""
    for item in what:
        path = item if isinstance(item, str) else getattr(item, "staged_at", None)
        if path in _staged:
            _staged.remove(path)
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, label: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back, split into folders by ``by``.

    Used where several jobs need the same rows (folds of one cross-validation,
    both sides of a fitted neighbour search): it cuts the lineage, and a lost
    executor only costs a re-read.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    staged = df.sparkSession.read.parquet(path)
    staged.staged_at = path
    return staged
