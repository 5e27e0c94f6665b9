"""Resumable runs over a folder that keeps receiving files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from souqlytics.sources.folder import Folder


def _new_files(
    spark: SparkSession, source: str, schema: StructType, max_files: int | None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source)


def run_new_files(
    spark: SparkSession, source: str, schema: StructType,
    transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
    max_files: int | None = None,
) -> None:
    """Process every file not seen by an earlier run, then stop.

    The checkpoint remembers finished files; the file sink's commit log makes a
    batch's output visible all at once. ``transform`` has to be row-wise.
    """
    (
        transform(_new_files(spark, source, schema, max_files))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
        .awaitTermination()
    )


def run_new_batches(
    spark: SparkSession, source: str, schema: StructType,
    transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
    max_files: int | None = None,
) -> None:
    """The same for any batch transformation, such as aspect scoring with its grouping.

    Each batch of files goes to its own ``batch=<query>-<n>`` folder, where the query is named by
    its checkpoint: several sources may share a target. A batch is written aside and renamed,
    and one that is there is not written again when a broken run is repeated, so a file's rows
    are there once or not at all. The target remembers which query filled it from which source;
    a source that is there under another checkpoint (the first was lost) is refused.
    """
    folder, known = Folder(spark, target), Folder(spark, checkpoint)
    origin = Folder(spark, source).qualified()
    mine = json.loads(known.read("metadata"))["id"] if known.exists("metadata") else None
    for other in folder.names("_sources"):
        if not other.startswith(".") and other != mine and folder.read(f"_sources/{other}") == origin:
            raise ValueError(f"{target} has rows of {source} under another checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(known.read("metadata"))["id"]
        if not folder.exists(f"_sources/{query}"):
            folder.write(f"_sources/{query}", origin)
        name = f"batch={query}-{number}"
        if folder.exists(name):
            return
        aside = f"_aside/{uuid.uuid4().hex}"
        transform(batch).write.parquet(f"{folder.root}/{aside}")
        folder.rename(aside, name)

    (
        _new_files(spark, source, schema, max_files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
