"""Session settings used by tests, checks and the bench."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kymora")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a session on this machine alone may do without: it gets a temporary folder, removed at exit.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
            folder = tempfile.mkdtemp(prefix="kymora-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store a shared step reliably, so that several readers do not compute it again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_OWN: list[tuple[SparkSession, str]] = []


def own_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver ends or ``remove_own`` is called."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _OWN:
        atexit.register(remove_own)
    _OWN.append((spark, path))
    return path


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Store a large step in compressed columns, which take less disk than a checkpoint's rows.

    What Parquet cannot hold (types such as intervals) goes to a checkpoint.
    """
    spark = df.sparkSession
    path = own_path(spark, kind)
    try:
        df.write.option("compression", "zstd").parquet(path)
    except AnalysisException:
        return cut_lineage(df)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Collect garbage in the driver and its JVM: Spark removes the files of shuffles that nothing refers to only then."""
    gc.collect()
    spark._jvm.System.gc()


def remove_own() -> None:
    """Remove all that was written to own paths; call it when results that come from them are written elsewhere."""
    while _OWN:
        spark, path = _OWN.pop()
        # at the end of the driver its JVM may have gone first
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    atexit.unregister(remove_own)
