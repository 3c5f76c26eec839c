"""The per-file jobs as a stream: the engine keeps track of files not yet processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_new_files(
    spark: SparkSession,
    folder: str,
    schema: str,
    job: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> StreamingQuery:
    """Run ``job`` once on every file that arrives in ``folder``; results go under ``out``.

    Each batch writes its own folder with overwrite, so a batch repeated after a
    failure replaces its first attempt.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        reader.load(folder)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
