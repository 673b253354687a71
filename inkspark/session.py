"""Session helpers: a local session for tests, and tables written to the shared checkpoint folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkspark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.inkspark.scratch", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="inkspark-")
    spark.conf.set("spark.inkspark.scratch", base)
    return base


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they may not find it on their own path."""
    context = spark.sparkContext
    if getattr(context, "_inkspark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="inkspark-")) / "inkspark"), "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._inkspark_shipped = True


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read instead of a re-run, and a table used
    twice is computed once. The files stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def widened(scan: DataFrame) -> DataFrame:
    """A scan spread over all cores where its files are fewer than these; for work that takes long on each row. Large inputs stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
