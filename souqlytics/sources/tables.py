"""Publishing derived tables, KPIs and views."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

# Derived tables kept on disk (fixed names).
FEATURE_TABLES = (
    "user_features", "product_behavior", "city_features", "user_behavior_enriched",
    "comment_features", "product_master",
)


def save_tables(
    tables: Mapping[str, DataFrame], folder: str, names: Iterable[str] = FEATURE_TABLES
) -> list[str]:
    """One parquet table per name; absent tables are skipped. Returns what was written."""
    written = [n for n in names if n in tables]
    for name in written:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return written


def save_kpis(kpis: Mapping[str, Mapping[str, DataFrame] | DataFrame], folder: str) -> list[str]:
    """``kpi_<group>_<name>`` per table, ``kpi_<group>`` for a one-row group of scalars."""
    flat: dict[str, DataFrame] = {}
    for group, value in kpis.items():
        if isinstance(value, Mapping):
            flat.update({f"kpi_{group}_{name}": df for name, df in value.items()})
        else:
            flat[f"kpi_{group}"] = value
    for name, df in flat.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return list(flat)


def publish(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """(re)build a table under ``folder``, or a view when there is none."""
    if folder is None:
        df.createOrReplaceTempView(name)
        return df
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored.createOrReplaceTempView(name)
    return stored
