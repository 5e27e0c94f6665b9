"""KPI views over the feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqlytics.functions.numbers import pct2, ratio

# Labels (fixed values).
HERO = "Hero Product (قهرمان)"
HIGH_TRAFFIC = "High Traffic, Low Conversion (نیازمند بررسی قیمت)"
HIGH_RISK = "High Risk (فروش بالا اما به شدت ناراضی)"
NEEDS_REVIEWS = "Needs Reviews (نیازمند کمپین ثبت نظر)"
NORMAL = "Normal"
VIP = "VIP Customer"
RETURNING = "Returning Customer"
ONE_TIME = "One-Time Buyer"
WINDOW_SHOPPER = "Window Shopper (فقط بازدیدکننده)"
LOW_ENGAGEMENT = "Low Engagement"
CRITICAL = "Critical Weakness (نقطه ضعف بحرانی)"
STRENGTH = "Key Strength (نقطه قوت کلیدی)"
NEUTRAL = "Neutral"


def global_funnel(feature_time: DataFrame) -> DataFrame:
    """Abandonment here means removals per cart add."""
    totals = feature_time.agg(
        F.sum("total_views").alias("total_views"),
        F.sum("total_cart_adds").alias("total_carts"),
        F.sum("total_purchases").alias("total_purchases"),
        F.sum("total_removes").alias("total_removes"),
    )
    views, carts = F.col("total_views"), F.col("total_carts")
    bought = F.col("total_purchases")
    return totals.withColumns(
        {
            "view_to_cart_pct": pct2(carts, views),
            "cart_to_purchase_pct": pct2(bought, carts),
            "overall_conversion_pct": pct2(bought, views),
            "cart_abandonment_pct": pct2(F.col("total_removes"), carts),
        }
    )


def product_360(
    feature_product: DataFrame, products: DataFrame, sentiment: DataFrame,
    hero_revenue: float = 50_000_000, hero_positive: float = 0.7, traffic_views: int = 1000,
    traffic_purchases: int = 5, risk_negative: float = 0.5, risk_purchases: int = 10,
) -> DataFrame:
    """The first action tag that applies; unknown values never apply."""
    positive, negative = F.col("positive_aspect_ratio"), F.col("negative_aspect_ratio")
    bought, views = F.col("total_purchases"), F.col("total_views")
    revenue = bought * F.col("price")
    tag = (
        F.when((revenue > hero_revenue) & (positive > hero_positive), HERO)
        .when((views > traffic_views) & (bought < traffic_purchases), HIGH_TRAFFIC)
        .when((negative > risk_negative) & (bought > risk_purchases), HIGH_RISK)
        .when(F.col("comment_count") == 0, NEEDS_REVIEWS)
        .otherwise(NORMAL)
    )
    facts = feature_product.select("product_id", "total_views", "total_purchases")
    goods = products.select(F.col("id").alias("product_id"), "title_fa", "price")
    mood = sentiment.select(
        "product_id", "comment_count", "avg_rate", "positive_aspect_ratio", "negative_aspect_ratio"
    )
    return (
        facts.join(goods, "product_id")
        .join(mood, "product_id", "left")
        .select(
            "product_id", "title_fa", "price", "total_views", "total_purchases",
            revenue.alias("total_revenue"),
            pct2(bought, views).alias("conversion_rate"),
            F.coalesce("comment_count", F.lit(0)).alias("comment_count"),
            F.round("avg_rate", 2).alias("star_rating"),
            F.round(positive * 100, 2).alias("positive_sentiment_pct"),
            F.round((positive - negative) * 100, 2).alias("sentiment_score"),
            tag.alias("managerial_action_tag"),
        )
    )


def user_segments(
    feature_user: DataFrame, vip_purchases: int = 5, vip_spend: float = 10_000_000,
    shopper_views: int = 20,
) -> DataFrame:
    """Many purchases with a low spend fall through to low engagement."""
    bought, views = F.col("total_purchases"), F.col("total_views")
    segment = (
        F.when((bought >= vip_purchases) & (F.col("total_spend") > vip_spend), VIP)
        .when((bought > 1) & (bought < vip_purchases), RETURNING)
        .when(bought == 1, ONE_TIME)
        .when((bought == 0) & (views > shopper_views), WINDOW_SHOPPER)
        .otherwise(LOW_ENGAGEMENT)
    )
    return feature_user.select(
        "user_id", "active_days", "total_views", "total_purchases", "total_spend",
        segment.alias("user_segment"),
        pct2(bought, views).alias("user_conversion_pct"),
    )


def brand_diagnostics(
    feature_brand: DataFrame, brands: DataFrame, brand_sentiment: DataFrame
) -> DataFrame:
    """V04."""
    score = pct2(
        F.col("positive_aspect_mentions") - F.col("negative_aspect_mentions"),
        F.col("total_aspect_mentions"),
    )
    return (
        feature_brand.select("brand_id", "total_views", "total_purchases")
        .join(brands.select("brand_id", F.col("name").alias("brand_name")), "brand_id")
        .join(brand_sentiment, "brand_id", "left")
        .select(
            "brand_id", "brand_name", "total_views", "total_purchases", "total_comments",
            F.round("avg_comment_rating", 2).alias("avg_rating"),
            score.alias("brand_sentiment_score"),
        )
    )


def aspect_diagnostics(
    feature_aspect: DataFrame, min_mentions: int = 5, critical: float = 0.6, strong: float = 0.7
) -> DataFrame:
    """Aspects mentioned more than ``min_mentions`` times, most mentioned first."""
    total = F.col("total_mentions")
    bad, good = ratio(F.col("negative_mentions"), total), ratio(F.col("positive_mentions"), total)
    status = F.when(bad > critical, CRITICAL).when(good > strong, STRENGTH).otherwise(NEUTRAL)
    return (
        feature_aspect.filter(total > min_mentions)
        .select(
            F.col("term").alias("aspect_name"), "total_mentions", "positive_mentions",
            "negative_mentions",
            pct2(F.col("negative_mentions"), total).alias("negative_impact_pct"),
            status.alias("aspect_status"),
        )
        .orderBy(F.desc("total_mentions"), "aspect_name")
    )
