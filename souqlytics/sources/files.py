"""File scans and plain writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souqlytics.registry import find_dataset
from souqlytics.sources.quoted import read_quoted

PART_ROWS = 50_000
ORDINAL = "_ordinal"


def dataset_of(path: str) -> tuple[str, str]:
    """(dataset name, suffix) of a file path."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, _, suffix = name.partition(".")
    return stem, suffix


def with_ordinal(df: DataFrame, out: str = ORDINAL) -> DataFrame:
    """Source position of every row of a fresh file scan: file, split start, running id.

    Splits of one file may land in any partition order, hence the split start in front.
    """
    return df.withColumn(
        out,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ),
    )


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, ordinal: str | None = None) -> DataFrame | None:
    """Registered dataset by file stem, all columns as text; None means "skip".

    Columns are those of the header lines, matched by name over the files of a folder. Large
    files are read by many tasks, with quoted line breaks too; ``multi_line`` off saves two
    passes over files known to have none. ``ordinal`` names a column for the place of each row.
    """
    stem, suffix = dataset_of(path)
    if find_dataset(stem) is None or suffix != "csv":
        return None
    placed = read_quoted(spark, path, ordinal or ORDINAL, multi_line)
    return placed if ordinal else placed.drop(ORDINAL)


def read_parquet(
    spark: SparkSession, path: str, columns: list[str] | None = None,
    union_by_name: bool = False, recursive: bool = False,
) -> DataFrame:
    """Folder scan, optionally with schema union, sub-folders, column choice."""
    reader = spark.read
    if union_by_name:
        reader = reader.option("mergeSchema", True)
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def write_parts(df: DataFrame, path: str, rows: int = PART_ROWS) -> None:
    """Parquet files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, non-ASCII text as is."""
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and position."""
    return with_ordinal(spark.read.text(path)).select(
        F.col("value").alias("line"), F.col(f"{ORDINAL}.file").alias("file"), ORDINAL
    )
