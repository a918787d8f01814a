"""Session settings and where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pageloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


# The first two suit long expressions over rows sorted by page:
# generated methods the JVM would not compile are split per operator instead, and an aggregation per page
# streams over its sorted input rather than hashing and sorting it again. The third takes the last of repeated
# keys in a JSON object, as browsers and the standard parsers do, instead of calling the text invalid.
TUNING = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``TUNING`` where the cluster's own configuration says nothing else."""
    own = spark.sparkContext.getConf()
    for key, value in TUNING.items():
        if not own.contains(key):
            spark.conf.set(key, value)
    return spark


def take_last_keys(spark: SparkSession) -> None:
    """Set the one option that results depend on, for callers that did not ``tune`` their session."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def shuffles_for(spark: SparkSession, path: str, bytes_per_partition: int = 256 << 20) -> int:
    """The shuffle partitions for a capture table of this size, never below the session's own number.

    Compressed captures grow about fourfold as markup and again as token arrays. AQE merges partitions that turn
    out small; it cannot split an exchange that was planned too coarse.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return max(int(size * 8 / bytes_per_partition) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it.

    Only a local master without the setting gets a folder of its own; elsewhere the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="pageloom-")
    return _LOCAL


_LOCAL: str | None = None


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/pageloom-{name}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, folder: str) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage, safe against lost executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
