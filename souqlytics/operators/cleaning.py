"""Structured cleaning of the raw string tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from souqlytics.functions.dates import parse_date
from souqlytics.functions.numbers import parse_amount, parse_bool, parse_id
from souqlytics.functions.text import strip
from souqlytics.operators.ranking import exact_medians
from souqlytics.registry import find_dataset
from souqlytics.session import stage

# Texts that stand for "missing" (fixed values).
NULL_WORDS = ("nan", "None", "")


def clean_strings(df: DataFrame) -> DataFrame:
    """B01."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    trimmed = {c: strip(F.col(c)) for c in names}
    return df.withColumns(
        {c: F.when(~t.isin(*NULL_WORDS), t) for c, t in trimmed.items()}
    )


def keep_first(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The earliest row per key; rows without a key go.

    An aggregate with map-side combine rather than a window: a key with very many
    copies is thinned out before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("_row"))
        .select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def drop_copies(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One of each set of fully equal rows (the ordinal is no part of a row)."""
    if ordinal is None or ordinal not in df.columns:
        return df.dropDuplicates()
    data = [c for c in df.columns if c != ordinal]
    return df.groupBy(*data).agg(F.min(ordinal).alias(ordinal)).select(*df.columns)


def parse_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """B04."""
    return df.withColumns({c: parse_amount(F.col(c)) for c in columns})


def fill_with_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's exact median, or 0 when there is none.

    The medians are one number per column; they enter the plan as constants.
    """
    if not columns:
        return df
    medians = {r["name"]: r["median"] for r in exact_medians(df, columns).collect()}
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians.get(c, 0.0)))) for c in columns}
    )


def standardise_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """B06."""
    return df.withColumns({c: parse_date(F.col(c)) for c in columns})


def cast_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """B07."""
    return df.withColumns({c: parse_id(F.col(c)) for c in columns})


def map_booleans(df: DataFrame, columns: list[str]) -> DataFrame:
    """B08."""
    return df.withColumns({c: parse_bool(F.col(c)) for c in columns})


def null_cells(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns])


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in, out, removed and null cells on both sides, one row."""
    def totals(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.lit(side).alias("side"), null_cells(df).alias("nulls"))

    def on(side: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, value)), F.lit(0)).cast("long")

    one = F.lit(1)
    return (
        totals(before, "in")
        .unionByName(totals(after, "out"))
        .agg(
            on("in", one).alias("rows_in"),
            on("out", one).alias("rows_out"),
            on("in", F.col("nulls")).alias("nulls_in"),
            on("out", F.col("nulls")).alias("nulls_out"),
        )
        .withColumn("rows_removed", F.col("rows_in") - F.col("rows_out"))
    )


def clean(df: DataFrame, dataset: str, ordinal: str | None = None) -> DataFrame:
    """Strings, key or row dedupe, numbers, dates, ids, booleans, in this order.

    ``ordinal`` names the column with the source position; it is needed to say
    which copy is the first and is dropped afterwards. A name outside the registry
    gets the string step only.
    """
    config = find_dataset(dataset)
    out = clean_strings(df)
    if config is None:
        return out.drop(ordinal) if ordinal else out

    def present(names: tuple[str, ...]) -> list[str]:
        return [c for c in names if c in df.columns]

    if config.primary_key in df.columns:
        if ordinal is None:
            raise ValueError("keep-first on a primary key needs a source ordinal")
        out = keep_first(out, config.primary_key, ordinal)
    else:
        out = drop_copies(out, ordinal)
    if ordinal:
        out = out.drop(ordinal)
    numeric = present(config.numeric)
    if numeric:
        # Read twice below: once for the medians, once for the result.
        out = fill_with_median(stage(parse_numbers(out, numeric), dataset), numeric)
    out = standardise_dates(out, present(config.datetimes))
    out = cast_ids(out, present(config.id_columns))
    return map_booleans(out, present(config.booleans))
