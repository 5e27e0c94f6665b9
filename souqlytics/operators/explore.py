"""The tables behind the exploratory charts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that are charted, correlated and counted as stages (fixed values).
BEHAVIOUR_COLUMNS = (
    "is_view", "is_cart", "is_purchase", "is_remove", "conversion_rate", "cart_abandon_rate",
)
CORRELATED = (
    "Price", "Rate", "Rate_cnt", "is_view", "is_cart", "is_remove", "is_purchase",
    "conversion_rate", "cart_abandon_rate", "positive", "negative", "sentiment_score",
    "total_comments",
)
STAGES = (
    ("View", "is_view"), ("Add to Cart", "is_cart"), ("Purchase", "is_purchase"),
    ("Remove from Cart", "is_remove"),
)


def golden_table(absa: DataFrame, master: DataFrame) -> DataFrame:
    """Sentiment table with behaviour; behaviour columns come from the master."""
    return absa.drop(*BEHAVIOUR_COLUMNS).join(master.select("id", *BEHAVIOUR_COLUMNS), "id")


def bubble_set(golden: DataFrame, min_views: int = 20) -> DataFrame:
    """E02."""
    return golden.filter(
        (F.col("Price") > 0) & (F.col("is_view") >= min_views) & (F.col("total_comments") > 0)
    ).withColumn("sentiment_score", F.coalesce("sentiment_score", F.lit(0.0)))


def correlations(df: DataFrame, columns: tuple[str, ...] = CORRELATED) -> DataFrame:
    """Pearson r per column pair over the rows where both are known, from one pass."""
    pairs = list(combinations(columns, 2))
    both = {
        (a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs
    }
    one_row = df.agg(
        *[
            F.corr(
                F.when(both[a, b], F.col(a).cast("double")),
                F.when(both[a, b], F.col(b).cast("double")),
            ).alias(f"{a}|{b}")
            for a, b in pairs
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r"))
            for a, b in pairs
        ]
    )
    return one_row.select(F.inline(cells))


def top_brands(golden: DataFrame, n: int = 10) -> DataFrame:
    """Brands with the most products."""
    return (
        golden.filter(F.col("Brand").isNotNull())
        .groupBy("Brand")
        .agg(F.count(F.lit(1)).alias("products"))
        .orderBy(F.desc("products"), "Brand")
        .limit(n)
    )


def brand_score_quartiles(golden: DataFrame, n: int = 10) -> DataFrame:
    """Score quartiles of the top brands.

    The exact percentile keeps one counter per distinct score; scores have two
    decimals within -100..100, so that is at most 20,001 counters per brand.
    """
    quartiles = F.percentile("sentiment_score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        golden.join(top_brands(golden, n), "Brand", "left_semi")
        .groupBy("Brand")
        .agg(
            F.count("sentiment_score").alias("scored"),
            F.min("sentiment_score").alias("lowest"),
            quartiles.alias("_q"),
            F.max("sentiment_score").alias("highest"),
        )
        .select(
            "Brand", "scored", "lowest",
            *[F.col("_q")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))],
            "highest",
        )
    )


def diverging_aspects(aspect_kpi: DataFrame, n: int = 15) -> DataFrame:
    """Most mentioned aspects with their negative share signed."""
    return (
        aspect_kpi.orderBy(F.desc("total_mentions"), "predicted_aspects")
        .limit(n)
        .select(
            F.col("predicted_aspects").alias("aspect"), "total_mentions",
            (-F.col("negative")).alias("negative_signed"), "positive",
        )
    )


def funnel_stages(enriched: DataFrame) -> DataFrame:
    """Four stages in long form."""
    totals = enriched.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for _, c in STAGES])
    cells = F.array(
        *[F.struct(F.lit(s).alias("stage"), F.col(c).alias("total")) for s, c in STAGES]
    )
    return totals.select(F.inline(cells))


def hourly_trend(enriched: DataFrame) -> DataFrame:
    """E07."""
    return (
        enriched.filter(F.col("hour").isNotNull())
        .groupBy("hour")
        .agg(F.sum("is_view").alias("is_view"), F.sum("is_purchase").alias("is_purchase"))
    )
