"""Q01-Q12: data-quality rules and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from souqlytics.registry import EVENT_TYPES


def _long(one_row: DataFrame, columns: list[str], value: str) -> DataFrame:
    """A one-row table of measures as (column_name, value) rows."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias(value)) for c in columns]
    )
    return one_row.select("*", F.inline(cells))


def null_overview(df: DataFrame) -> DataFrame:
    """Nulls and their percentage per column, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    share = F.try_divide(F.col("null_count") * 100.0, F.col("_rows"))
    return _long(counts, df.columns, "null_count").select(
        "column_name", "null_count", share.alias("null_pct")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q02: rows that repeat an earlier one in every column."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def _infinities(df: DataFrame) -> dict[str, Column]:
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return {
        f.name: F.count_if(
            F.abs(F.col(f.name)) == float("inf")
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.lit(False)
        )
        for f in numeric
    }


def infinity_counts(df: DataFrame) -> DataFrame:
    """Q03: infinite values per numeric column."""
    counts = _infinities(df)
    one_row = df.agg(*[count.alias(c) for c, count in counts.items()])
    return _long(one_row, list(counts), "infinite_count").select("column_name", "infinite_count")


# name -> (columns needed, condition of a bad row)
def _rules() -> dict[str, tuple[tuple[str, ...], Column]]:
    return {
        # Q04
        "purchase_above_view": (
            ("is_purchase", "is_view"), F.col("is_purchase") > F.col("is_view")
        ),
        # Q05
        "product_rate_range": (("Rate",), (F.col("Rate") < 0) | (F.col("Rate") > 100)),
        # Q06
        "comment_rate_range": (("rate",), (F.col("rate") < 0) | (F.col("rate") > 5)),
        # Q07
        "negative_price": (("Price",), F.col("Price") < 0),
        # Q08: a missing type is unknown, too
        "unknown_event_type": (
            ("event_type",),
            ~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)),
        ),
    }


RULE_NAMES = (
    "purchase_above_view", "product_rate_range", "comment_rate_range", "negative_price",
    "unknown_event_type",
)


def rule_violations(df: DataFrame, names: tuple[str, ...] = RULE_NAMES) -> DataFrame:
    """Q04-Q08: bad rows per rule whose columns are there (names are case-sensitive)."""
    rules = {n: r for n, r in _rules().items() if n in names and set(r[0]) <= set(df.columns)}
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, violations bigint")
    counts = df.agg(*[F.count_if(cond).alias(n) for n, (_, cond) in rules.items()])
    return _long(counts, list(rules), "violations").select(
        F.col("column_name").alias("rule"), "violations"
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Q09: including the null value."""
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.col(column).asc_nulls_last())
    )


def funnel_anomalies(master: DataFrame, n: int = 10) -> DataFrame:
    """Q10: products bought more often than viewed, the first ``n`` by id."""
    columns = [
        c for c in ("id", "title_fa", "is_view", "is_purchase", "conversion_rate")
        if c in master.columns
    ]
    return (
        master.filter(F.col("is_purchase") > F.col("is_view")).select(*columns).orderBy("id").limit(n)
    )


def spending_users(users: DataFrame) -> DataFrame:
    """Q11."""
    return users.filter(F.col("total_spend") > 0).select(
        "user_id", "total_spend", "aov", "brand_diversity", "category_diversity",
        "total_sessions", "avg_session_depth", "weekend_activity_ratio",
    )


def discussed_products(master: DataFrame) -> DataFrame:
    """Q11."""
    return master.filter(F.col("review_engagement_rate") > 0).select(
        "id", "Price", "min_price_last_month", "price_drop_ratio", "review_engagement_rate"
    )


def table_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Q12: rows, columns and an empty flag per table, over all of its files."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            (F.col("row_count") == 0).alias("is_empty"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def scan(tables: dict[str, DataFrame]) -> DataFrame:
    """All rules over all tables: (table_name, check, column_name, count).

    Per table one pass for nulls, rules and infinities, and one for duplicates.
    """
    shape = ("table_name", "check", "column_name", "count")
    parts = []
    for name, df in tables.items():
        measures = [("nulls", c, F.count_if(F.col(c).isNull())) for c in df.columns]
        measures += [
            ("rule", rule, F.count_if(bad))
            for rule, (needs, bad) in _rules().items()
            if set(needs) <= set(df.columns)
        ]
        measures += [("infinite", c, count) for c, count in _infinities(df).items()]
        one_row = df.agg(*[count.alias(f"m{i}") for i, (_, _, count) in enumerate(measures)])
        cells = F.array(
            *[
                F.struct(
                    F.lit(name).alias("table_name"), F.lit(check).alias("check"),
                    F.lit(column).alias("column_name"), F.col(f"m{i}").alias("count"),
                )
                for i, (check, column, _) in enumerate(measures)
            ]
        )
        parts.append(one_row.select(F.inline(cells)))
        parts.append(
            duplicate_rows(df).select(
                F.lit(name).alias("table_name"), F.lit("duplicates").alias("check"),
                F.lit(None).cast("string").alias("column_name"),
                F.col("duplicate_rows").alias("count"),
            )
        )
    return reduce(DataFrame.unionByName, parts).select(*shape)
