"""Behaviour features with fractional rates (data-frame definitions).

Rows without a group key take no part in any of these groupings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souqlytics.functions.numbers import ratio

WEEKEND = (4, 5)  # Monday is 0: Friday and Saturday
FLAGS = {
    "is_view": "view",
    "is_cart": "add_to_cart",
    "is_purchase": "purchase",
    "is_remove": "remove_from_cart",
}


def add_time_parts(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """F01."""
    ts = F.col(column).cast("timestamp")
    weekday = F.weekday(ts)
    return df.withColumns(
        {
            column: ts,
            "hour": F.hour(ts),
            "day": F.dayofmonth(ts),
            "month": F.month(ts),
            "weekday": weekday,
            "is_weekend": weekday.isin(*WEEKEND).cast("int"),
        }
    )


def add_event_flags(df: DataFrame) -> DataFrame:
    """F02."""
    return df.withColumns(
        {
            flag: F.coalesce((F.col("event_type") == event).cast("int"), F.lit(0))
            for flag, event in FLAGS.items()
        }
    )


def enrich_log(log: DataFrame) -> DataFrame:
    """F06."""
    return add_event_flags(add_time_parts(log))


def _flag_totals(enriched: DataFrame, key: str, flags: list[str], *more: Column) -> DataFrame:
    return (
        enriched.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.sum(f).alias(f) for f in flags], *more)
    )


def _per(a: str, b: str) -> Column:
    return F.col(a) / (F.col(b) + 1)


def user_totals(enriched: DataFrame, *more: Column) -> DataFrame:
    """F03; further aggregates can ride along in the same pass."""
    return _flag_totals(enriched, "user_id", list(FLAGS), *more).withColumns(
        {
            "conversion_rate": _per("is_purchase", "is_view"),
            "remove_rate": _per("is_remove", "is_cart"),
        }
    )


def product_totals(enriched: DataFrame) -> DataFrame:
    """F04."""
    views, carts, bought = F.col("is_view"), F.col("is_cart"), F.col("is_purchase")
    return _flag_totals(enriched, "product_id", list(FLAGS)).withColumns(
        {
            "conversion_rate": _per("is_purchase", "is_view"),
            "drop_off_rate": (views - bought) / (views + 1),
            "remove_rate": _per("is_remove", "is_cart"),
            "cart_abandon_rate": (carts - bought) / (carts + 1),
            "remove_to_cart_ratio": _per("is_remove", "is_cart"),
        }
    )


def city_totals(enriched: DataFrame) -> DataFrame:
    """F05."""
    return _flag_totals(enriched, "city", ["is_view", "is_purchase"])


def session_depth(enriched: DataFrame) -> DataFrame:
    """events per session and the session's earliest known user."""
    first = F.min(F.when(F.col("user_id").isNotNull(), F.struct("timestamp", "user_id")))
    return (
        enriched.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.count("event_type").alias("session_depth"), first.alias("_first"))
        .select("session_id", "session_depth", F.col("_first.user_id").alias("user_id"))
    )


def user_sessions(enriched: DataFrame) -> DataFrame:
    """a session counts for one user only."""
    return (
        session_depth(enriched)
        .filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count("session_id").alias("total_sessions"),
            F.avg("session_depth").alias("avg_session_depth"),
        )
    )


def _weekend() -> Column:
    return F.avg("is_weekend").alias("weekend_activity_ratio")


def weekend_ratio(enriched: DataFrame) -> DataFrame:
    """F09."""
    return _flag_totals(enriched, "user_id", [], _weekend())


def purchase_value(enriched: DataFrame, products: DataFrame) -> DataFrame:
    """purchases are counted per user and product before prices are joined."""
    bought = (
        enriched.filter(
            (F.col("is_purchase") == 1)
            & F.col("user_id").isNotNull()
            & F.col("product_id").isNotNull()
        )
        .groupBy("user_id", "product_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    catalogue = products.select(F.col("id").alias("product_id"), "Price", "Brand", "Category1")
    spend = F.sum(F.col("n") * F.col("Price"))
    priced = F.sum(F.when(F.col("Price").isNotNull(), F.col("n")))
    return (
        bought.join(catalogue, "product_id")
        .groupBy("user_id")
        .agg(
            F.coalesce(spend.cast("double"), F.lit(0.0)).alias("total_spend"),
            ratio(spend, priced).alias("aov"),
            F.countDistinct("Brand").alias("brand_diversity"),
            F.countDistinct("Category1").alias("category_diversity"),
        )
    )


def user_features(enriched: DataFrame, products: DataFrame) -> DataFrame:
    """totals and weekend share in one pass over the log, sessions and purchases in one
    each; all are keyed by user, so the joins reuse the aggregates' partitioning.
    """
    filled = ["total_spend", "aov", "brand_diversity", "category_diversity"]
    return (
        user_totals(enriched, _weekend())
        .join(user_sessions(enriched), "user_id", "left")
        .join(purchase_value(enriched, products), "user_id", "left")
        .fillna(0, subset=filled)
    )


def comment_features(comments: DataFrame) -> DataFrame:
    """one grouping; values that are no numbers are left out."""
    rate = F.col("rate").try_cast("double")
    likes = F.coalesce(F.col("likes").try_cast("double"), F.lit(0.0))
    dislikes = F.coalesce(F.col("dislikes").try_cast("double"), F.lit(0.0))
    rated = F.count("_rate")
    return (
        comments.filter(F.col("product_id").isNotNull())
        .select("product_id", rate.alias("_rate"), ratio(likes, dislikes + 1).alias("_likes"))
        .groupBy("product_id")
        .agg(
            F.avg("_rate").alias("avg_rate"),
            F.nullif(rated, F.lit(0)).alias("comment_count"),
            F.avg("_likes").alias("avg_like_ratio"),
            F.avg("_rate").alias("avg_sentiment"),
        )
    )


def review_engagement(comment_count: Column, views: Column) -> Column:
    """F14."""
    return F.coalesce(comment_count / (views + 1e-5), F.lit(0.0))


def price_drop(price: Column, lowest: Column) -> Column:
    """never below 0; unknown prices stay unknown."""
    drop = (lowest - price) / (price + 1e-5)
    return F.when(drop.isNotNull(), F.greatest(drop, F.lit(0.0)))


def product_master(
    products: DataFrame, behaviour: DataFrame | None = None, comments: DataFrame | None = None
) -> DataFrame:
    """Catalogue with behaviour totals and comment features."""
    out = products
    for part, suffix in ((behaviour, ""), (comments, "_comment")):
        if part is None:
            continue
        clash = {c: f"{c}_comment" for c in part.columns if suffix and c in out.columns}
        renamed = part.withColumnsRenamed(clash)
        key = clash.get("product_id", "product_id")
        out = out.join(renamed, out["id"] == renamed[key], "left")
    if {"comment_count", "is_view"} <= set(out.columns):
        out = out.withColumn(
            "review_engagement_rate", review_engagement(F.col("comment_count"), F.col("is_view"))
        )
    price = "Price" if "Price" in products.columns else "price"
    if price in products.columns and "min_price_last_month" in products.columns:
        out = out.withColumn(
            "price_drop_ratio", price_drop(F.col(price), F.col("min_price_last_month"))
        )
    return out


def feature_table(tables: dict[str, DataFrame]) -> DataFrame:
    """F16: every event with its user's and its product's features.

    Both product-side tables are joined to each other first, so the log itself is
    shuffled once per key instead of once per table.
    """
    if "user_behavior_enriched" not in tables:
        raise ValueError("feature_table needs user_behavior_enriched")
    log = tables["user_behavior_enriched"]
    taken = set(log.columns)
    out = log

    def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c != key})

    if "user_features" in tables:
        users = prefixed(tables["user_features"], "user", "user_id")
        out = out.join(users, "user_id", "left")
        taken |= set(users.columns)
    by_product = None
    if "product_behavior" in tables:
        by_product = prefixed(tables["product_behavior"], "product", "product_id")
        taken |= set(by_product.columns)
    if "product_master" in tables and "id" in tables["product_master"].columns:
        master = tables["product_master"]
        master = master.select(*[c for c in master.columns if c == "id" or c not in taken])
        if by_product is None:
            by_product = master.withColumn("product_id", F.col("id"))
        else:
            by_product = (
                by_product.join(master, by_product["product_id"] == master["id"], "full")
                .withColumn("_key", F.coalesce("product_id", "id"))
                .drop("product_id")
                .withColumnRenamed("_key", "product_id")
            )
    if by_product is not None:
        out = out.join(by_product, "product_id", "left")
    return out
