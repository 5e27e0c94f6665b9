"""KPIs over the product master, user features and the enriched log.

Top lists are ordered by the measure, unknown last, then by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souqlytics.functions.numbers import ratio
from souqlytics.registry import EVENT_TYPES

TOP = 10
CATEGORY_COLUMNS = ("category", "Category1", "Category2", "sub_category")


def _top(df: DataFrame, measure: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(measure).desc_nulls_last(), key).limit(n)


def top_products(master: DataFrame, n: int = TOP) -> DataFrame:
    """K01."""
    return _top(master, "is_purchase", "id", n)


def best_funnel_products(master: DataFrame, n: int = TOP) -> DataFrame:
    """K02."""
    staged = master.withColumns(
        {
            "view_to_cart": F.col("is_cart") / (F.col("is_view") + 1e-9),
            "cart_to_purchase": F.col("is_purchase") / (F.col("is_cart") + 1e-9),
        }
    )
    return _top(staged, "cart_to_purchase", "id", n)


def top_revenue_products(master: DataFrame, n: int = TOP) -> DataFrame:
    """K03."""
    price = "price" if "price" in master.columns else "Price"
    return _top(master.withColumn("revenue", F.col(price) * F.col("is_purchase")), "revenue", "id", n)


def most_removed_products(master: DataFrame, n: int = TOP) -> DataFrame:
    """K04."""
    return _top(master, "is_remove", "id", n)


def worst_cart_products(master: DataFrame, n: int = TOP) -> DataFrame:
    """K05."""
    return _top(master, "cart_abandon_rate", "id", n)


def high_remove_rate_products(master: DataFrame, n: int = TOP) -> DataFrame:
    """K06."""
    return _top(master, "remove_rate", "id", n)


def funnel(enriched: DataFrame) -> DataFrame:
    """One row; a rate over nothing is 0."""
    counted = enriched.agg(
        *[F.count_if(F.col("event_type") == e).alias(e) for e in EVENT_TYPES]
    )
    views, carts = F.col("view"), F.col("add_to_cart")
    removes, bought = F.col("remove_from_cart"), F.col("purchase")

    def rate(a: Column, b: Column) -> Column:
        return F.coalesce(ratio(a, b), F.lit(0.0))

    return counted.select(
        rate(carts, views).alias("view_to_cart_rate"),
        rate(bought, carts).alias("cart_to_purchase_rate"),
        rate(bought, views).alias("overall_conversion"),
        rate(carts - bought, carts).alias("cart_abandon_rate"),
        rate(removes, carts).alias("remove_rate"),
        (removes / (bought + 1)).alias("remove_to_purchase_ratio"),
    )


def heavy_users(users: DataFrame, above: int = 10) -> DataFrame:
    """K08."""
    return users.filter(F.col("is_purchase") > above)


def low_engagement_users(users: DataFrame, below: int = 5) -> DataFrame:
    """K09."""
    return users.filter(F.col("is_view") < below)


def high_conversion_users(users: DataFrame, n: int = TOP) -> DataFrame:
    """K10."""
    return _top(users, "conversion_rate", "user_id", n)


def high_remove_users(users: DataFrame, above: float = 0.5) -> DataFrame:
    """K11."""
    return users.filter(F.col("remove_rate") > above)


def retention(enriched: DataFrame) -> DataFrame:
    """Users by their number of different timestamps, one row."""
    visits = (
        enriched.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.countDistinct("timestamp").alias("visits"))
    )
    return visits.agg(
        F.count_if(F.col("visits") > 1).alias("returning_users"),
        F.count_if(F.col("visits") == 1).alias("one_time_users"),
    )


def top_categories(master: DataFrame) -> DataFrame:
    """By the first category column there is."""
    column = next((c for c in CATEGORY_COLUMNS if c in master.columns), None)
    if column is None or "is_purchase" not in master.columns:
        raise ValueError("top_categories needs a category column and is_purchase")
    return (
        master.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.coalesce(F.sum("is_purchase"), F.lit(0)).alias("is_purchase"))
        .orderBy(F.desc("is_purchase"), column)
    )


def _events_by(enriched: DataFrame, column: str, out: str) -> DataFrame:
    return (
        enriched.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("event_type").alias(out))
    )


def hourly_activity(enriched: DataFrame) -> DataFrame:
    """K14."""
    return _events_by(enriched, "hour", "hourly_activity")


def purchase_by_hour(enriched: DataFrame) -> DataFrame:
    """K15."""
    return _events_by(enriched.filter(F.col("event_type") == "purchase"), "hour", "purchase_by_hour")


def daily_trend(enriched: DataFrame) -> DataFrame:
    """By day of month."""
    return _events_by(enriched, "day", "daily_trend")


def all_kpis(tables: dict[str, DataFrame]) -> dict[str, dict[str, DataFrame] | DataFrame]:
    """Every KPI whose table and columns are there."""
    out: dict[str, dict[str, DataFrame] | DataFrame] = {}
    master = tables.get("product_master")
    if master is not None:
        have = set(master.columns)
        rules = (
            ("top_products", top_products, {"is_purchase"}),
            ("best_funnel_products", best_funnel_products, {"is_purchase", "is_cart", "is_view"}),
            ("most_removed_products", most_removed_products, {"is_remove"}),
            ("worst_cart_products", worst_cart_products, {"cart_abandon_rate"}),
            ("high_remove_rate_products", high_remove_rate_products, {"remove_rate"}),
        )
        product = {name: fn(master) for name, fn, needs in rules if needs <= have}
        if "is_purchase" in have and have & {"price", "Price"}:
            product["top_revenue_products"] = top_revenue_products(master)
        out["product"] = product
        if "is_purchase" in have and have & set(CATEGORY_COLUMNS):
            out["category"] = {"top_categories": top_categories(master)}
    users = tables.get("user_features")
    if users is not None:
        have = set(users.columns)
        rules = (
            ("heavy_users", heavy_users, "is_purchase"),
            ("low_engagement_users", low_engagement_users, "is_view"),
            ("high_conversion_users", high_conversion_users, "conversion_rate"),
            ("high_remove_users", high_remove_users, "remove_rate"),
        )
        out["user_segment"] = {name: fn(users) for name, fn, needs in rules if needs in have}
    log = tables.get("user_behavior_enriched")
    if log is not None:
        out["funnel"] = funnel(log)
        out["retention"] = retention(log)
        time = {}
        if "hour" in log.columns:
            time["hourly_activity"] = hourly_activity(log)
            time["purchase_by_hour"] = purchase_by_hour(log)
        if "day" in log.columns:
            time["daily_trend"] = daily_trend(log)
        out["time"] = time
    return out
