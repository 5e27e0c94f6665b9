"""KPIs over comments with a predicted sentiment and predicted aspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souqlytics.functions.numbers import ratio
from souqlytics.operators.aspects import ASPECT_ITEMS, CLASSES, top_class

LABELS = ("positive", "negative", "neutral")
# Product columns carried into the merged table, where present (fixed names).
PRODUCT_COLUMNS = (
    "id", "title_fa", "Brand", "Category1", "Category2", "sub_category", "Price", "price", "Rate",
    "Rate_cnt", "is_view", "is_cart", "is_purchase", "conversion_rate", "drop_off_rate",
    "avg_rate", "comment_count", "avg_like_ratio", "avg_sentiment",
)


def predictions(comments: DataFrame) -> DataFrame:
    """``aspects_json`` to ``predicted_aspects`` and ``predicted_sentiment``.

    A comment's sentiment is the class with the highest mean percentage over its
    aspects; without aspects it is unknown.
    """
    items = F.from_json("aspects_json", ASPECT_ITEMS)

    def mean(c: str) -> Column:
        total = F.aggregate("_items", F.lit(0.0), lambda acc, a: acc + a[f"{c}_pct"])
        return F.when(F.size("_items") > 0, total / F.size("_items"))

    return (
        comments.withColumn("_items", items)
        .withColumn("predicted_aspects", F.transform("_items", lambda a: a["term"]))
        .withColumn("predicted_sentiment", top_class({c: mean(c) for c in CLASSES}))
        .drop("_items")
    )


def aspect_rows(comments: DataFrame) -> DataFrame:
    """One row per comment and aspect."""
    return comments.withColumn("predicted_aspects", F.explode("predicted_aspects")).filter(
        F.col("predicted_aspects").isNotNull()
    )


def sentiment_pivot(df: DataFrame, keys: list[str], total: str = "total_comments") -> DataFrame:
    """Class percentages with two decimals, score and total per key.

    Labels outside the three classes make a group appear but count for nothing.
    """
    label = F.col("predicted_sentiment")
    known = label.isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    counted = df.filter(known).groupBy(*keys).agg(
        *[F.count_if(label == c).alias(f"_{c}") for c in LABELS]
    )
    summed = sum((F.col(f"_{c}") for c in LABELS[1:]), F.col(f"_{LABELS[0]}"))
    return (
        counted.withColumn(total, summed)
        .withColumns(
            {c: F.bround(ratio(F.col(f"_{c}"), F.col(total)) * 100, 2) for c in LABELS}
        )
        .withColumn("sentiment_score", F.bround(F.col("positive") - F.col("negative"), 2))
        .select(*keys, *LABELS, "sentiment_score", total)
    )


def top_aspect(aspects: DataFrame, out: str = "top_aspect") -> DataFrame:
    """Most frequent aspect per product, the first in text order on ties."""
    return (
        aspects.filter(F.col("product_id").isNotNull())
        .groupBy("product_id", "predicted_aspects")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .groupBy("product_id")
        .agg(F.min(F.struct((-F.col("cnt")).alias("cnt"), "predicted_aspects")).alias("_a"))
        .select("product_id", F.col("_a.predicted_aspects").alias(out))
    )


def worst_aspect(aspects: DataFrame) -> DataFrame:
    """Most frequent aspect within negative comments."""
    return top_aspect(aspects.filter(F.col("predicted_sentiment") == "negative"), "worst_aspect")


def product_kpi(comments: DataFrame) -> DataFrame:
    """J03."""
    aspects = aspect_rows(comments.select("product_id", "predicted_sentiment", "predicted_aspects"))
    return (
        sentiment_pivot(comments, ["product_id"])
        .join(top_aspect(aspects), "product_id", "left")
        .join(worst_aspect(aspects), "product_id", "left")
    )


def _catalogue_kpi(comments: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """Comments are counted per product and label before the catalogue is joined."""
    label = F.col("predicted_sentiment")
    counted = (
        comments.filter(label.isNotNull())
        .groupBy("product_id", "predicted_sentiment")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    goods = products.select(F.col("id").alias("product_id"), key).filter(F.col(key).isNotNull())
    per_key = counted.join(goods, "product_id").groupBy(key).agg(
        *[
            F.sum(F.when(label == c, F.col("n")).otherwise(0)).alias(f"_{c}")
            for c in LABELS
        ]
    )
    summed = sum((F.col(f"_{c}") for c in LABELS[1:]), F.col(f"_{LABELS[0]}"))
    return (
        per_key.withColumn("total_comments", summed)
        .withColumns(
            {c: F.bround(ratio(F.col(f"_{c}"), F.col("total_comments")) * 100, 2) for c in LABELS}
        )
        .withColumn("sentiment_score", F.bround(F.col("positive") - F.col("negative"), 2))
        .select(key, *LABELS, "sentiment_score", "total_comments")
    )


def brand_kpi(comments: DataFrame, products: DataFrame) -> DataFrame:
    """J06."""
    return _catalogue_kpi(comments, products, "Brand")


def category_kpi(comments: DataFrame, products: DataFrame) -> DataFrame:
    """J07."""
    return _catalogue_kpi(comments, products, "Category1")


def aspect_kpi(comments: DataFrame) -> DataFrame:
    """J08."""
    return sentiment_pivot(aspect_rows(comments), ["predicted_aspects"], "total_mentions")


def product_aspect_kpi(comments: DataFrame) -> DataFrame:
    """J09."""
    keys = ["product_id", "predicted_aspects"]
    return sentiment_pivot(aspect_rows(comments), keys, "total_mentions")


def _frequency(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column)
    )


def sentiment_distribution(comments: DataFrame) -> DataFrame:
    """J10."""
    return _frequency(comments, "predicted_sentiment")


def aspect_frequency(comments: DataFrame) -> DataFrame:
    """J11."""
    return _frequency(aspect_rows(comments.select("predicted_aspects")), "predicted_aspects")


def product_subset(master: DataFrame) -> DataFrame:
    """The useful columns that are there, one row per id.

    Of several rows with one id the smallest in column order is kept.
    """
    columns = [c for c in PRODUCT_COLUMNS if c in master.columns]
    rest = [c for c in columns if c != "id"]
    return (
        master.select(*columns)
        .groupBy("id")
        .agg(F.min(F.struct(*rest)).alias("_r"))
        .select("id", *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def product_master_absa(subset: DataFrame, kpi: DataFrame) -> DataFrame:
    """J13."""
    return subset.join(kpi.withColumnRenamed("product_id", "id"), "id", "left")
