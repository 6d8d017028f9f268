"""Session helpers: checkpoint folder, lineage cuts, a session for tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "depweave") -> SparkSession:
    """A ``local[n]`` session for tests, the bench and the command line."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DEPWEAVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named in ``spark.checkpoint.dir``.

    A private folder is made only for a local master that names none; on a cluster the
    setting is required, because a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="depweave-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; Python tasks import it there."""
    sc = spark.sparkContext
    if any(path.endswith("depweave.zip") for path in sc._python_includes):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="depweave-package-"), "depweave.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(target))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, which drops its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
    """As :func:`cut`, and the number of rows (that hold ``where``), counted in the same job."""
    seen = Observation()
    counted = F.count(F.lit(1)) if where is None else F.count_if(where)
    done = cut(df.observe(seen, counted.alias("n")))
    return done, int(seen.get.get("n", 0))


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table beside the checkpoints and read it back.

    For wide results that later questions read a few columns of; it drops the lineage as well.
    """
    target = f"{ensure_checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def keep_counted(df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
    """As :func:`keep`, and the number of rows (that hold ``where``), counted in the same job."""
    seen = Observation()
    counted = F.count(F.lit(1)) if where is None else F.count_if(where)
    kept = keep(df.observe(seen, counted.alias("n")))
    return kept, int(seen.get.get("n", 0))


# Rows of a narrow table (two keys and two numbers) that are safe to send to every executor.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a table whose counted size allows a broadcast; larger tables are left to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input: never sent whole to the driver and every executor.

    The planner judges by compressed bytes, and tables that compress well are many times larger in memory.
    """
    return df.hint("merge")


@contextmanager
def dealt(df: DataFrame, key: str, rows: int) -> Iterator[DataFrame]:
    """``df`` for a loop that joins to it by ``key``, so that no round shuffles or sorts it again.

    It is dealt by the key once and held on the executors' disks until the loop ends; a small one is broadcast.
    """
    if rows <= BROADCAST_ROWS:
        yield F.broadcast(df)
        return
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)
    try:
        yield held
    finally:
        held.unpersist()
