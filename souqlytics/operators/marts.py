"""The feature tables of the warehouse (SQL definitions, null keys kept).

Marts over events with user and city start from one compact table, the activity
cube (``activity``), instead of from the log: its grain already holds everything a
distinct count needs, so the log is joined to its sessions once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souqlytics.functions.numbers import ratio

WEEKEND = (4, 5)  # ISO weekdays, Monday is 1: Thursday and Friday
EVENT_OF = {
    "is_view": "view",
    "is_cart": "add_to_cart",
    "is_remove": "remove_from_cart",
    "is_purchase": "purchase",
}
CUBE = ["user_id", "session_id", "city_id", "product_id", "date", "hour"]
SENTIMENTS = ("positive", "negative", "neutral")
PCTS = ("negative_pct", "neutral_pct", "positive_pct")


def _iso_weekday(ts: Column) -> Column:
    return F.weekday(ts) + 1


def feature_behavior(logs: DataFrame) -> DataFrame:
    """G01."""
    ts = F.col("timestamp").cast("timestamp")
    weekday = _iso_weekday(ts)
    return logs.select(
        "log_id",
        F.hour(ts).alias("hour"),
        F.dayofmonth(ts).alias("day"),
        F.month(ts).alias("month"),
        weekday.alias("weekday"),
        F.coalesce(weekday.isin(*WEEKEND).cast("int"), F.lit(0)).alias("is_weekend"),
        *[
            F.coalesce((F.col("event_type") == event).cast("int"), F.lit(0)).alias(flag)
            for flag, event in EVENT_OF.items()
        ],
    )


def user_base(logs: DataFrame, sessions: DataFrame) -> DataFrame:
    """The log with its features, its session's user and its city.

    The features are computed on the log rows themselves, so no join back by
    log_id is needed.
    """
    ts = F.col("timestamp").cast("timestamp")
    weekday = _iso_weekday(ts)
    return (
        logs.select("log_id", "session_id", "product_id", "event_type", ts.alias("timestamp"))
        .join(sessions.select("session_id", "user_id", "city_id"), "session_id")
        .select(
            "user_id", "log_id", "session_id", "product_id", "city_id", "timestamp",
            F.hour(ts).alias("hour"),
            weekday.alias("weekday"),
            F.coalesce(weekday.isin(*WEEKEND).cast("int"), F.lit(0)).alias("is_weekend"),
            *[
                F.coalesce((F.col("event_type") == event).cast("int"), F.lit(0)).alias(flag)
                for flag, event in EVENT_OF.items()
            ],
        )
    )


def activity(base: DataFrame) -> DataFrame:
    """Events of a user in a session on a product within one hour, counted by type."""
    return (
        base.withColumn("date", F.to_date("timestamp"))
        .groupBy(*CUBE)
        .agg(
            F.count(F.lit(1)).alias("events"),
            *[F.sum(flag).alias(flag) for flag in EVENT_OF],
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
        )
    )


def _total(column: str, name: str) -> Column:
    return F.sum(column).alias(name)


TOTALS = (
    ("is_view", "total_views"), ("is_cart", "total_cart_adds"),
    ("is_remove", "total_removes"), ("is_purchase", "total_purchases"),
)


def _totals() -> list[Column]:
    return [_total("events", "total_events"), *[_total(c, name) for c, name in TOTALS]]


def _distinct(column: str, flag: str | None, name: str) -> Column:
    value = F.col(column) if flag is None else F.when(F.col(flag) > 0, F.col(column))
    return F.countDistinct(value).alias(name)


def event_stats(cube: DataFrame) -> DataFrame:
    """G03."""
    def share(condition: Column) -> Column:
        return ratio(F.sum(F.when(condition, F.col("events")).otherwise(0)), F.sum("events"))

    hour = F.col("hour")
    weekend = _iso_weekday(F.col("date")).isin(*WEEKEND)
    return cube.groupBy("user_id").agg(
        *_totals(),
        _distinct("session_id", None, "total_sessions"),
        _distinct("date", None, "active_days"),
        _distinct("product_id", "is_view", "unique_products_viewed"),
        _distinct("product_id", "is_purchase", "unique_products_purchased"),
        _distinct("city_id", None, "cities_visited"),
        share(weekend).alias("weekend_activity_ratio"),
        share((hour >= 6) & (hour < 12)).alias("morning_activity_ratio"),
        share((hour >= 12) & (hour < 18)).alias("afternoon_activity_ratio"),
        share((hour >= 18) & (hour < 24)).alias("evening_activity_ratio"),
        share(hour < 6).alias("night_activity_ratio"),
    )


def session_stats(cube: DataFrame) -> DataFrame:
    """G04."""
    minutes = (F.unix_micros(F.max("last_ts")) - F.unix_micros(F.min("first_ts"))) / 6e7
    per_session = cube.groupBy("user_id", "session_id").agg(
        F.sum("events").alias("n"), minutes.alias("minutes")
    )
    return per_session.groupBy("user_id").agg(
        F.avg("n").alias("avg_session_events"),
        F.max("n").alias("max_session_events"),
        F.avg("minutes").alias("avg_session_duration_minutes"),
        F.max("minutes").alias("max_session_duration_minutes"),
    )


def purchase_stats(cube: DataFrame, products: DataFrame) -> DataFrame:
    """Prices are weighted with the number of purchases in a cube row."""
    goods = products.select(F.col("id").alias("product_id"), "price", "brand_id", "category_id")
    n = F.col("is_purchase")
    spend = F.sum(n * F.col("price"))
    return (
        cube.filter(n > 0)
        .groupBy("user_id", "product_id", "date")
        .agg(F.sum("is_purchase").alias("is_purchase"))
        .join(goods, "product_id")
        .groupBy("user_id")
        .agg(
            F.sum(n).alias("purchase_frequency"),
            F.countDistinct("date").alias("purchase_days"),
            spend.cast("double").alias("total_spend"),
            ratio(spend, F.sum(F.when(F.col("price").isNotNull(), n))).alias("avg_purchase_value"),
            F.min("price").alias("min_purchase_price"),
            F.max("price").alias("max_purchase_price"),
            F.countDistinct("brand_id").alias("brand_diversity"),
            F.countDistinct("category_id").alias("category_diversity"),
        )
    )


def time_preference(cube: DataFrame) -> DataFrame:
    """Most frequent hour and ISO weekday, the smallest on ties."""
    def favourite(value: Column, name: str) -> DataFrame:
        counted = cube.groupBy("user_id", value.alias("v")).agg(F.sum("events").alias("n"))
        # At most 24 rows per user are left at this point.
        best = F.max(F.when(F.col("v").isNotNull(), F.struct("n", (-F.col("v")).alias("v"))))
        return counted.groupBy("user_id").agg(best.alias("_b")).select(
            "user_id", (-F.col("_b.v")).alias(name)
        )

    return favourite(F.col("hour"), "preferred_hour").join(
        favourite(_iso_weekday(F.col("date")), "preferred_weekday"), "user_id", "full"
    )


PURCHASE_COLUMNS = (
    "total_spend", "avg_purchase_value", "min_purchase_price", "max_purchase_price",
    "purchase_frequency", "purchase_days", "brand_diversity", "category_diversity",
)


def feature_user(cube: DataFrame, products: DataFrame) -> DataFrame:
    """Four aggregates keyed by user; the joins reuse their partitioning."""
    return (
        event_stats(cube)
        .join(session_stats(cube), "user_id", "left")
        .join(time_preference(cube), "user_id", "left")
        .join(purchase_stats(cube, products), "user_id", "left")
        .fillna(0, subset=list(PURCHASE_COLUMNS))
    )


def feature_product(cube: DataFrame, products: DataFrame) -> DataFrame:
    """All products; a product without events has zeros."""
    counted = cube.groupBy("product_id").agg(
        *_totals(),
        _distinct("user_id", "is_view", "unique_viewers"),
        _distinct("user_id", "is_cart", "unique_carters"),
        _distinct("user_id", "is_purchase", "unique_buyers"),
        _distinct("session_id", None, "total_sessions"),
    )
    drop = ratio(
        F.col("min_price_last_month") - F.col("price"), F.col("min_price_last_month")
    )
    goods = products.select(
        F.col("id").alias("product_id"), F.greatest(drop, F.lit(0.0)).alias("price_drop_ratio")
    )
    zeros = [c for c in counted.columns if c != "product_id"]
    return goods.join(counted, "product_id", "left").fillna(0, subset=zeros)


def feature_city(cube: DataFrame) -> DataFrame:
    """G09."""
    return cube.groupBy("city_id").agg(
        _distinct("user_id", None, "total_users"),
        _distinct("session_id", None, "total_sessions"),
        *_totals(),
        _distinct("product_id", "is_view", "unique_products_viewed"),
        _distinct("product_id", "is_purchase", "unique_products_purchased"),
    )


def _by_user_product(cube: DataFrame) -> DataFrame:
    flags = [F.sum(c).alias(c) for c in ("events", *EVENT_OF)]
    return cube.groupBy("user_id", "product_id").agg(*flags)


def _goods_activity(cube: DataFrame, products: DataFrame) -> DataFrame:
    """User x product counts with catalogue columns: joined after counting."""
    goods = products.select(F.col("id").alias("product_id"), "brand_id", "category_id", "price")
    return _by_user_product(cube).join(goods, "product_id")


def _reach() -> list[Column]:
    return [
        _distinct("user_id", "is_view", "unique_viewers"),
        _distinct("user_id", "is_purchase", "unique_buyers"),
    ]


def feature_category(cube: DataFrame, products: DataFrame) -> DataFrame:
    """The average price is per event."""
    price, n = F.col("price"), F.col("events")
    average = ratio(F.sum(price * n), F.sum(F.when(price.isNotNull(), n)))
    return (
        _goods_activity(cube, products)
        .groupBy("category_id")
        .agg(*_totals(), *_reach(), average.alias("avg_product_price"))
    )


def feature_brand(cube: DataFrame, products: DataFrame) -> DataFrame:
    """G11."""
    return _goods_activity(cube, products).groupBy("brand_id").agg(*_totals(), *_reach())


def feature_user_product(cube: DataFrame) -> DataFrame:
    """G12."""
    return cube.groupBy("user_id", "product_id").agg(
        _total("events", "total_events"),
        _total("is_view", "view_count"),
        _total("is_cart", "cart_count"),
        _total("is_remove", "remove_count"),
        _total("is_purchase", "purchase_count"),
        F.countDistinct("date").alias("active_days"),
        F.countDistinct("session_id").alias("session_count"),
    )


def feature_user_category(cube: DataFrame, products: DataFrame) -> DataFrame:
    """Shares of the user's own totals; users without id are left out."""
    # Unpriced purchases are unknown, other events are 0: the sum is unknown only
    # when there is nothing but unpriced purchases.
    spend = F.when(
        F.col("price").isNotNull(), F.col("is_purchase") * F.col("price")
    ).when(F.col("events") > F.col("is_purchase"), F.lit(0))
    per_category = (
        _goods_activity(cube.filter(F.col("user_id").isNotNull()), products)
        .groupBy("user_id", "category_id")
        .agg(
            _total("events", "total_events"),
            _total("is_view", "view_count"),
            _total("is_cart", "cart_count"),
            _total("is_remove", "remove_count"),
            _total("is_purchase", "purchase_count"),
            F.sum(spend).cast("double").alias("category_spend"),
        )
    )
    # a user has at most a row per category
    own = Window.partitionBy("user_id")
    return per_category.withColumns({
        "view_share": ratio(F.col("view_count"), F.sum("view_count").over(own)),
        "purchase_share": ratio(F.col("purchase_count"), F.sum("purchase_count").over(own)),
        "spend_share": ratio(F.col("category_spend"), F.sum("category_spend").over(own)),
    })


def _mentions(suffix: str) -> list[Column]:
    kind = F.lower(F.col("sentiment"))
    return [F.count_if(kind == s).alias(f"{s}{suffix}") for s in SENTIMENTS]


def _average_pcts() -> list[Column]:
    return [F.avg(c).alias(f"avg_{c}") for c in PCTS]


def feature_product_sentiment(
    products: DataFrame, comments: DataFrame, aspects: DataFrame
) -> DataFrame:
    """Comments and aspects are counted apart, then put side by side."""
    likes = F.coalesce(F.col("likes"), F.lit(0))
    dislikes = F.coalesce(F.col("dislikes"), F.lit(0))
    by_comment = comments.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("comment_count"),
        F.avg("rate").alias("avg_rate"),
        F.avg(ratio(likes, dislikes + 1)).alias("avg_like_ratio"),
        F.sum(likes).alias("total_likes"),
        F.sum(dislikes).alias("total_dislikes"),
    )
    by_aspect = (
        comments.select(F.col("id").alias("comment_id"), "product_id")
        .join(aspects, "comment_id")
        .groupBy("product_id")
        .agg(
            F.count("aspect_id").alias("total_aspect_mentions"),
            *_mentions("_aspect_mentions"),
            *_average_pcts(),
        )
    )
    total = F.col("total_aspect_mentions")
    zeros = [c for c in (*by_comment.columns, *by_aspect.columns) if c != "product_id"]
    return (
        products.select(F.col("id").alias("product_id"))
        .join(by_comment, "product_id", "left")
        .join(by_aspect, "product_id", "left")
        .withColumns(
            {
                f"{s}_aspect_ratio": ratio(
                    F.coalesce(F.col(f"{s}_aspect_mentions"), F.lit(0)), total
                )
                for s in SENTIMENTS
            }
        )
        .fillna(0, subset=zeros)
    )


def feature_product_aspect(comments: DataFrame, aspects: DataFrame) -> DataFrame:
    """G15."""
    return (
        aspects.filter(F.col("term").isNotNull())
        .join(comments.select(F.col("id").alias("comment_id"), "product_id"), "comment_id")
        .groupBy("product_id", "term")
        .agg(F.count(F.lit(1)).alias("total_mentions"), *_mentions("_mentions"), *_average_pcts())
    )


def _group_sentiment(
    key: str, products: DataFrame, comments: DataFrame, aspects: DataFrame, dedup: bool
) -> DataFrame:
    """Sentiment per catalogue key.

    By definition rating and likes count once per aspect row (a comment without
    aspects counts once). Aspects are counted per comment first, so the fan-out is a
    weight instead of rows. ``dedup`` sets that weight to 1.
    """
    counted = aspects.groupBy("comment_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("aspect_id").alias("total_aspect_mentions"),
        *_mentions("_aspect_mentions"),
    )
    weight = F.lit(1) if dedup else F.coalesce(F.col("rows"), F.lit(1))
    counts = [f"{s}_aspect_mentions" for s in ("total", *SENTIMENTS)]
    enriched = (
        comments.select("id", "product_id", "rate", "likes", "dislikes")
        .join(counted, F.col("id") == F.col("comment_id"), "left")
        .withColumn("w", weight)
    )
    per_product = enriched.groupBy("product_id").agg(
        F.count("id").alias("total_comments"),
        *[F.sum(c).alias(c) for c in counts],
        F.sum(F.col("rate") * F.col("w")).alias("rate_sum"),
        F.sum(F.when(F.col("rate").isNotNull(), F.col("w"))).alias("rate_n"),
        F.sum(F.coalesce(F.col("likes"), F.lit(0)) * F.col("w")).alias("total_likes"),
        F.sum(F.coalesce(F.col("dislikes"), F.lit(0)) * F.col("w")).alias("total_dislikes"),
    )
    summed = ["total_comments", *counts, "total_likes", "total_dislikes"]
    return (
        products.select(F.col("id").alias("product_id"), key)
        .join(per_product, "product_id", "left")
        .groupBy(key)
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed],
            ratio(F.sum("rate_sum"), F.sum("rate_n")).alias("avg_comment_rating"),
        )
    )


def feature_brand_sentiment(
    products: DataFrame, comments: DataFrame, aspects: DataFrame, dedup: bool = False
) -> DataFrame:
    """G16."""
    return _group_sentiment("brand_id", products, comments, aspects, dedup)


def feature_category_sentiment(
    products: DataFrame, comments: DataFrame, aspects: DataFrame, dedup: bool = False
) -> DataFrame:
    """G17."""
    return _group_sentiment("category_id", products, comments, aspects, dedup)


def feature_aspect(aspects: DataFrame) -> DataFrame:
    """G18."""
    return (
        aspects.filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("total_mentions"), *_mentions("_mentions"), *_average_pcts())
    )


def feature_time(behavior: DataFrame) -> DataFrame:
    """G19."""
    return behavior.groupBy("hour", F.col("weekday").alias("iso_weekday")).agg(
        F.count(F.lit(1)).alias("total_events"), *[_total(c, name) for c, name in TOTALS]
    )
