"""One query per operator, on tables derived from the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souqlytics.functions import literals, spans, text, vectors
from souqlytics.functions.dates import parse_date
from souqlytics.functions.numbers import parse_amount, parse_bool, parse_id
from souqlytics.operators import (
    aspects, behaviour, cleaning, explore, kpi, marts, neighbours, quality, sentiment, trainprep,
    views, warehouse,
)
from souqlytics.plans import jobs
from souqlytics.session import scratch_path, stage, tune
from souqlytics.sources import files, tables
from souqlytics.sources.stored import StoredTable
from souqlytics.streaming.incremental import run_new_batches, run_new_files
from verify.standin import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        return fn

    return register


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals in a form both engines compute alike."""
    return df.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in columns})


# ---- shared inputs ------------------------------------------------------------------


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shop_log")


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return behaviour.enrich_log(log(spark, d))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalogue")


def comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wh_comment")


def master(spark: SparkSession, d: str) -> DataFrame:
    return behaviour.product_master(
        catalogue(spark, d),
        behaviour.product_totals(enriched(spark, d)),
        behaviour.comment_features(comments(spark, d)),
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    return behaviour.user_features(enriched(spark, d), catalogue(spark, d))


def cube(spark: SparkSession, d: str) -> DataFrame:
    return marts.activity(marts.user_base(log(spark, d), table(spark, d, "shop_session")))


def staged_cube(spark: SparkSession, d: str) -> DataFrame:
    """For queries with several passes over the cube: log and sessions are joined once."""
    return stage(cube(spark, d), "activity")


def goods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wh_product")


def aspect_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wh_aspect")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    both = F.filter(F.array("aspect_1", "aspect_2"), lambda a: a.isNotNull())
    return table(spark, d, "predicted").select(
        "id", "product_id", "predicted_sentiment",
        F.when(F.size(both) > 0, both).alias("predicted_aspects"),
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents, tagged by a fixed rule on their length."""
    def tag(o: Column) -> Column:
        kind = (o["end"] - o["start"]) % 5
        return (
            F.when(kind == 0, spans.TAG_B).when(kind <= 2, spans.TAG_I)
            .when(kind == 3, spans.TAG_O).otherwise(spans.TAG_IGNORE)
        )

    base = texts(spark, d).withColumnRenamed("doc_id", "comment_id")
    base = spans.once(base, text=text.collapse_spaces(F.col("text")))
    base = spans.once(base, offsets=spans.word_offsets(F.col("text")))
    return spans.once(base, tags=F.transform("offsets", tag))


def length_scorer(texts_: pd.Series, terms: pd.Series) -> np.ndarray:
    """Stands in for a model: probabilities follow from the term's length."""
    n = terms.str.len().to_numpy()
    raw = np.stack([n % 3 + 1, n % 5 + 1, n % 7 + 1], axis=1).astype("float64")
    return raw / raw.sum(axis=1, keepdims=True)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return aspects.score_pairs(aspects.comment_spans(tagged(spark, d)), length_scorer)


# ---- sources and sinks --------------------------------------------------------------


@query("s01_csv_scan")
def _(spark, d):
    raw = table(spark, d, "raw_product").drop("ordinal")
    folder = f"{scratch_path(spark, 's01')}/products.csv"
    names = list(files.find_dataset("products").columns)
    raw.select(*names).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return files.read_csv(spark, folder)


@query("s01_mixed_headers")
def _(spark, d):
    """A folder of files with two header orders, one extra column, and quoted line breaks, commas and quotes."""
    raw = table(spark, d, "catalogue").select(
        F.col("id").cast("string").alias("id"), F.concat("title_fa", F.lit(', "new"\n\n'), "Brand").alias("title_fa"),
        F.concat("Brand", F.lit(' 5"')).alias("Brand"), F.col("Category1"))
    folder = f"{scratch_path(spark, 's01-mixed')}/products.csv"
    parts = (("id % 2 = 0", ["id", "title_fa", "Brand"]), ("id % 2 = 1", ["Category1", "Brand", "id", "title_fa"]))
    for rows, names in parts:
        raw.filter(rows).select(*names).write.mode("append").option("header", True).option("escape", '"').csv(folder)
    return files.read_csv(spark, folder)


@query("b06_far_years")
def _(spark, d):
    """Dates that 64-bit nanoseconds cannot hold, kept on request."""
    day = F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, "1500").when(F.col("o_orderkey") % 3 == 1, "2300").otherwise("1999"),
        F.substring(F.col("o_orderdate").cast("string"), 5, 4), F.lit("15"))
    rows = table(spark, d, "orders").select("o_orderkey", day.alias("text"))
    return rows.select(
        "o_orderkey", F.unix_micros(parse_date(F.col("text"), nanosecond_range=False)).alias("kept"),
        F.unix_micros(parse_date(F.col("text"))).alias("near"))


@query("s03_parquet_folder_scan")
def _(spark, d):
    path = scratch_path(spark, "s03")
    files.write_parts(table(spark, d, "customer"), path)
    return files.read_parquet(spark, path)


@query("s04_schema_union_scan")
def _(spark, d):
    path = scratch_path(spark, "s04")
    customer = table(spark, d, "customer")
    customer.select("c_custkey", "c_name").write.parquet(path)
    customer.select("c_custkey", "c_acctbal").write.mode("append").parquet(path)
    return files.read_parquet(spark, path, union_by_name=True)


@query("s05_recursive_scan")
def _(spark, d):
    path = scratch_path(spark, "s05")
    table(spark, d, "supplier").write.parquet(f"{path}/a")
    table(spark, d, "supplier").write.parquet(f"{path}/b/c")
    return files.read_parquet(spark, path, recursive=True)


@query("s06_pruned_scan")
def _(spark, d):
    return files.read_parquet(spark, f"{d}/documents.parquet", ["doc_id", "lang"])


@query("s07_write_parts")
def _(spark, d):
    path = scratch_path(spark, "s07")
    files.write_parts(table(spark, d, "orders"), path, rows=500)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("total_rows"), (F.max("n") <= 500).alias("parts_fit"))


@query("s08_save_feature_tables")
def _(spark, d):
    path = scratch_path(spark, "s08")
    built = jobs.feature_tables(catalogue(spark, d), log(spark, d), comments(spark, d))
    names = tables.save_tables(built, path)
    return quality.table_report(
        {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}
    ).select("table_name", "row_count")


@query("s09_save_kpis")
def _(spark, d):
    path = scratch_path(spark, "s09")
    tables.save_kpis(kpi.all_kpis({"user_behavior_enriched": enriched(spark, d)}), path)
    return spark.read.parquet(f"{path}/kpi_time_hourly_activity.parquet")


@query("s10_json_lines_write")
def _(spark, d):
    path = scratch_path(spark, "s10")
    rows = table(spark, d, "documents").select("doc_id", "lang", "text")
    files.write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("s13_publish_view")
def _(spark, d):
    behavior = marts.feature_behavior(log(spark, d))
    tables.publish(views.global_funnel(marts.feature_time(behavior)), "published_funnel")
    return spark.table("published_funnel")


@query("s14_incremental_run")
def _(spark, d):
    root = scratch_path(spark, "s14")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    even = F.col("event_id") % 2 == 0
    for part in (even, ~even):
        rows.filter(part).write.mode("append").parquet(f"{root}/in")
        run_new_files(
            spark, f"{root}/in", rows.schema,
            lambda df: df.withColumn("event_type", F.upper("event_type")),
            f"{root}/out", f"{root}/checkpoint",
        )
    return spark.read.parquet(f"{root}/out")


@query("s14_incremental_batches")
def _(spark, d):
    """Two sources grouped into one target; the first run of each breaks and is repeated."""
    root = scratch_path(spark, "s14")
    rows = table(spark, d, "events").select("event_id", "event_type")
    odd = F.col("event_id") % 2
    for k in (0, 1):
        rows.filter(odd == k).write.parquet(f"{root}/in{k}")

        def broken(df):
            raise RuntimeError("broken on purpose")

        for transform in (broken, lambda df: df.groupBy(odd.alias("odd"), "event_type").agg(F.count(F.lit(1)).alias("n"))):
            try:
                run_new_batches(spark, f"{root}/in{k}", rows.schema, transform, f"{root}/out", f"{root}/checkpoint{k}")
            except StreamingQueryException:
                if transform is not broken:
                    raise
    return spark.read.parquet(f"{root}/out").select("odd", "event_type", "n")


# ---- structured cleaning ------------------------------------------------------------


@query("b01_clean_strings")
def _(spark, d):
    return cleaning.clean_strings(table(spark, d, "raw_product"))


@query("b02_keep_first")
def _(spark, d):
    return cleaning.keep_first(
        cleaning.clean_strings(table(spark, d, "raw_product")), "id", "ordinal"
    )


@query("b03_drop_copies")
def _(spark, d):
    return cleaning.drop_copies(log(spark, d).select("user_id", "product_id", "event_type"))


@query("b04_parse_amount")
def _(spark, d):
    return table(spark, d, "raw_product").select("ordinal", parse_amount(F.col("Price")).alias("amount"))


@query("b05_fill_median")
def _(spark, d):
    columns = ["Price", "Rate", "min_price_last_month"]
    raw = table(spark, d, "raw_product").select("ordinal", *columns)
    return cleaning.fill_with_median(cleaning.parse_numbers(raw, columns), columns)


@query("b06_dates")
def _(spark, d):
    return table(spark, d, "raw_comment").select(
        "doc_id", F.unix_micros(parse_date(F.col("created_at"))).alias("created_us")
    )


@query("b07_ids")
def _(spark, d):
    return table(spark, d, "raw_product").select("ordinal", parse_id(F.col("id")).alias("id"))


@query("b08_booleans")
def _(spark, d):
    return table(spark, d, "raw_product").select("ordinal", parse_bool(F.col("Is_Fake")).alias("is_fake"))


@query("b09_cleaning_report")
def _(spark, d):
    raw = table(spark, d, "raw_product")
    return cleaning.cleaning_report(raw.drop("ordinal"), cleaning.clean(raw, "products", "ordinal"))


@query("b10_clean_products")
def _(spark, d):
    return cleaning.clean(table(spark, d, "raw_product"), "products", "ordinal")


# ---- text ---------------------------------------------------------------------------


@query("t01_raw_text")
def _(spark, d):
    df = table(spark, d, "documents")
    return df.select("doc_id", text.raw_text(["lang", "missing", "source", "text"], df.columns).alias("raw_text"))


def _text_query(name: str, step: Callable[[Column], Column]) -> None:
    @query(name)
    def _(spark, d):
        return texts(spark, d).select("doc_id", step(F.col("text")).alias("text"))


_text_query("t02_fold_letters", text.fold_letters)
_text_query("t04_drop_urls", text.drop_urls)
_text_query("t05_drop_emails", text.drop_emails)
_text_query("t06_drop_punctuation", text.drop_punctuation)
_text_query("t07_squeeze_repeats", text.squeeze_repeats)
_text_query("t08_collapse_spaces", text.collapse_spaces)
_text_query("t09_normalize", text.normalize)


@query("t03_drop_tags")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.drop_tags(F.col("html")).alias("text"))


@query("t10_null_overview")
def _(spark, d):
    return quality.null_overview(table(spark, d, "raw_comment"))


@query("t11_words")
def _(spark, d):
    words = text.words(F.col("text"))
    return texts(spark, d).select(
        "doc_id", F.size(words).alias("n_words"), F.array_join(words, "|").alias("words")
    )


@query("t12_literal_to_json")
def _(spark, d):
    n = F.col("p_partkey") % 5
    literal = (
        F.when(n == 0, F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_type", F.lit("']")))
        .when(n == 1, F.concat(F.lit("{'1': '"), "p_name", F.lit("'}")))
        .when(n == 2, F.concat(F.lit("متن "), "p_name"))
        .when(n == 3, F.concat(F.lit(" "), F.col("p_size").cast("string")))
        .otherwise("")
    )
    return table(spark, d, "part").select(
        "p_partkey", literals.literal_to_json(literal).alias("as_json")
    )


@query("t13_aspect_term")
def _(spark, d):
    term = F.concat(F.lit("  "), F.translate("p_name", "aeiou", text.ZWNJ), F.lit("  x "))
    return table(spark, d, "part").select("p_partkey", text.aspect_term(term).alias("term"))


@query("t14_text_column")
def _(spark, d):
    df = table(spark, d, "conversations").withColumnRenamed("text", "raw_text")
    return df.select("conv_id", "turn", text.first_text_column(df.columns).alias("text"))


# ---- behaviour features -------------------------------------------------------------


@query("f01_time_parts")
def _(spark, d):
    return behaviour.add_time_parts(log(spark, d)).select(
        "log_id", "hour", "day", "month", "weekday", "is_weekend"
    )


@query("f02_event_flags")
def _(spark, d):
    return behaviour.add_event_flags(log(spark, d)).select("log_id", *behaviour.FLAGS)


@query("f03_user_totals")
def _(spark, d):
    return behaviour.user_totals(enriched(spark, d))


@query("f04_product_totals")
def _(spark, d):
    return behaviour.product_totals(enriched(spark, d))


@query("f05_city_totals")
def _(spark, d):
    return behaviour.city_totals(enriched(spark, d))


@query("f06_enriched_log")
def _(spark, d):
    return enriched(spark, d).drop("timestamp")


@query("f07_session_depth")
def _(spark, d):
    return behaviour.session_depth(enriched(spark, d))


@query("f08_user_sessions")
def _(spark, d):
    return behaviour.user_sessions(enriched(spark, d))


@query("f09_weekend_ratio")
def _(spark, d):
    return behaviour.weekend_ratio(enriched(spark, d))


@query("f10_purchase_value")
def _(spark, d):
    return behaviour.purchase_value(enriched(spark, d), catalogue(spark, d))


@query("f11_user_features")
def _(spark, d):
    return users(spark, d)


@query("f12_comment_features")
def _(spark, d):
    return r6(behaviour.comment_features(comments(spark, d)), "avg_like_ratio")


@query("f13_product_master")
def _(spark, d):
    out = master(spark, d)
    return r6(out, "avg_like_ratio").drop("review_engagement_rate", "price_drop_ratio")


@query("f14_review_engagement")
def _(spark, d):
    return master(spark, d).select("id", "review_engagement_rate")


@query("f15_price_drop")
def _(spark, d):
    return master(spark, d).select("id", "price_drop_ratio")


@query("f16_feature_table")
def _(spark, d):
    built = jobs.feature_tables(
        catalogue(spark, d), log(spark, d), comments(spark, d), stage_shared=True
    )
    return r6(behaviour.feature_table(built), "avg_like_ratio").select(
        "log_id", "user_id", "product_id", "is_view", "user_is_purchase", "user_total_spend",
        "user_avg_session_depth", "product_drop_off_rate", "Brand", "Price", "conversion_rate",
        "comment_count", "avg_like_ratio", "price_drop_ratio",
    )


@query("f17_feature_run")
def _(spark, d):
    return quality.table_report(
        jobs.feature_tables(catalogue(spark, d), log(spark, d), comments(spark, d))
    )


# ---- KPIs ---------------------------------------------------------------------------


@query("k01_top_products")
def _(spark, d):
    return kpi.top_products(master(spark, d)).select("id", "title_fa", "is_purchase")


@query("k02_best_funnel_products")
def _(spark, d):
    return kpi.best_funnel_products(master(spark, d)).select("id", "view_to_cart", "cart_to_purchase")


@query("k03_top_revenue_products")
def _(spark, d):
    return kpi.top_revenue_products(master(spark, d)).select("id", "Price", "is_purchase", "revenue")


@query("k04_most_removed_products")
def _(spark, d):
    return kpi.most_removed_products(master(spark, d)).select("id", "is_remove")


@query("k05_worst_cart_products")
def _(spark, d):
    return kpi.worst_cart_products(master(spark, d)).select("id", "cart_abandon_rate")


@query("k06_high_remove_rate_products")
def _(spark, d):
    return kpi.high_remove_rate_products(master(spark, d)).select("id", "remove_rate")


@query("k07_funnel")
def _(spark, d):
    return kpi.funnel(enriched(spark, d))


@query("k08_heavy_users")
def _(spark, d):
    return kpi.heavy_users(users(spark, d)).select("user_id", "is_purchase")


@query("k09_low_engagement_users")
def _(spark, d):
    return kpi.low_engagement_users(users(spark, d)).select("user_id", "is_view")


@query("k10_high_conversion_users")
def _(spark, d):
    return kpi.high_conversion_users(users(spark, d)).select("user_id", "conversion_rate")


@query("k11_high_remove_users")
def _(spark, d):
    return kpi.high_remove_users(users(spark, d)).select("user_id", "remove_rate")


@query("k12_retention")
def _(spark, d):
    return kpi.retention(enriched(spark, d))


@query("k13_top_categories")
def _(spark, d):
    return kpi.top_categories(master(spark, d))


@query("k14_hourly_activity")
def _(spark, d):
    return kpi.hourly_activity(enriched(spark, d))


@query("k15_purchase_by_hour")
def _(spark, d):
    return kpi.purchase_by_hour(enriched(spark, d))


@query("k16_daily_trend")
def _(spark, d):
    return kpi.daily_trend(enriched(spark, d))


@query("k17_all_kpis")
def _(spark, d):
    built = jobs.feature_tables(catalogue(spark, d), log(spark, d), comments(spark, d))
    found = kpi.all_kpis(built)
    flat = {}
    for group, value in found.items():
        parts = value.items() if isinstance(value, dict) else [("", value)]
        flat.update({f"{group}.{name}".rstrip("."): df for name, df in parts})
    return quality.table_report(flat).select("table_name", "row_count")


# ---- warehouse ----------------------------------------------------------------------


def _dims(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    raw, goods_ = log(spark, d), catalogue(spark, d)
    return {
        "users": warehouse.load_users(raw),
        "cities": warehouse.load_cities(raw),
        "brands": warehouse.load_brands(goods_),
        "categories": warehouse.load_categories(goods_),
        "sellers": warehouse.load_sellers(goods_),
    }


@query("w01_users")
def _(spark, d):
    return warehouse.load_users(log(spark, d))


@query("w02_new_keys_continue")
def _(spark, d):
    goods_ = catalogue(spark, d)
    first = warehouse.load_brands(goods_.filter(F.col("Category1") == "ECONOMY"))
    return warehouse.load_brands(goods_.withColumn("Brand", F.concat("Brand", F.lit(" "), "Category1")), first)


@query("w03_insert_ignore")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    keys = ["c_nationkey", "c_mktsegment"]
    low = rows.groupBy(*keys).agg(F.min("c_acctbal").alias("c_acctbal")).filter("c_nationkey > 9")
    high = rows.groupBy(*keys).agg(F.max("c_acctbal").alias("c_acctbal"))
    return warehouse.insert_ignore(high, low, keys)


@query("w04_upsert")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    keys = ["c_nationkey", "c_mktsegment"]
    high = rows.groupBy(*keys).agg(F.max("c_acctbal").alias("c_acctbal"))
    return warehouse.upsert(rows.filter("c_nationkey > 9"), high, keys)


@query("w05_cities")
def _(spark, d):
    return warehouse.load_cities(log(spark, d))


@query("w06_brands")
def _(spark, d):
    return warehouse.load_brands(catalogue(spark, d))


@query("w07_categories")
def _(spark, d):
    return warehouse.load_categories(catalogue(spark, d))


@query("w08_sellers")
def _(spark, d):
    return warehouse.load_sellers(catalogue(spark, d))


@query("w09_sessions")
def _(spark, d):
    t = _dims(spark, d)
    return warehouse.load_sessions(log(spark, d), t["users"], t["cities"])


@query("w10_products")
def _(spark, d):
    t = _dims(spark, d)
    raw = catalogue(spark, d).withColumn("Is_Fake", F.lit(None).cast("string"))
    return warehouse.load_products(raw, t["brands"], t["categories"], t["sellers"])


@query("w11_behavior_logs")
def _(spark, d):
    known = table(spark, d, "shop_session")
    return warehouse.load_behavior_logs(log(spark, d), known, goods(spark, d)).withColumn(
        "timestamp", F.unix_micros("timestamp")
    )


def _raw_comments(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d).select(
        F.col("id").cast("string").alias("id"), "product_id", F.lit("yes").alias("is_buyer"), "rate",
        F.col("lang").alias("recommendation_status"), "likes", "dislikes",
        F.col("source").alias("raw_text_normalized"), F.lit("2024-03-01 00:00:00").alias("created_at"),
    )


@query("w12_comments")
def _(spark, d):
    return warehouse.load_comments(_raw_comments(spark, d), goods(spark, d)).withColumn(
        "created_at", F.unix_micros("created_at")
    )


def _with_aspects_json(spark: SparkSession, d: str) -> DataFrame:
    """Comments with their aspects as JSON text, in aspect id order."""
    item = F.struct(
        "term", "sentiment", "negative_pct", "neutral_pct", "positive_pct",
        F.lit(1).cast("bigint").alias("mentions"),
    )
    per_comment = aspect_table(spark, d).groupBy(F.col("comment_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("aspect_id", item.alias("item")))).alias("a")
    )
    return (
        comments(spark, d)
        .select("id", "product_id")
        .join(per_comment, "id", "left")
        .withColumn(
            "aspects_json",
            F.coalesce(F.to_json(F.transform("a", lambda x: x["item"])), F.lit("[]")),
        )
        .drop("a")
    )


@query("w13_comment_aspects")
def _(spark, d):
    return warehouse.load_comment_aspects(_with_aspects_json(spark, d), comments(spark, d))


def _raw_embeddings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("vec_id")
    key = F.when(n % 10 == 3, "x").when(n % 10 == 4, None).otherwise(n.cast("string"))
    vector = F.when(n % 7 == 1, F.slice("embedding", 1, 10)).when(
        n % 7 != 2, F.col("embedding")
    )
    return table(spark, d, "embeddings").select(key.alias("id"), vector.alias("embedding"))


@query("w14_embeddings")
def _(spark, d):
    known = comments(spark, d)
    return warehouse.load_embeddings(_raw_embeddings(spark, d), known, dimension=64).select(
        "id", F.size("embedded_comment").alias("dimension")
    )


@query("w14_embedding_report")
def _(spark, d):
    return warehouse.embedding_load_report(_raw_embeddings(spark, d), comments(spark, d), dimension=64)


@query("w15_integrity")
def _(spark, d):
    return warehouse.integrity_report(
        {
            "sessions": table(spark, d, "shop_session"),
            "products": goods(spark, d),
            "brands": table(spark, d, "wh_brand"),
            "user_behavior_logs": log(spark, d),
            "comments": comments(spark, d),
            "comment_aspects": aspect_table(spark, d),
        }
    )


# ---- marts --------------------------------------------------------------------------


@query("g01_feature_behavior")
def _(spark, d):
    return marts.feature_behavior(log(spark, d))


@query("g02_user_base")
def _(spark, d):
    return marts.user_base(log(spark, d), table(spark, d, "shop_session")).drop("timestamp")


@query("g03_event_stats")
def _(spark, d):
    return marts.event_stats(cube(spark, d))


@query("g04_session_stats")
def _(spark, d):
    return r6(
        marts.session_stats(cube(spark, d)),
        "avg_session_duration_minutes", "max_session_duration_minutes",
    )


@query("g05_purchase_stats")
def _(spark, d):
    return marts.purchase_stats(cube(spark, d), goods(spark, d))


@query("g06_time_preference")
def _(spark, d):
    return marts.time_preference(cube(spark, d))


@query("g07_feature_user")
def _(spark, d):
    return r6(
        marts.feature_user(staged_cube(spark, d), goods(spark, d)),
        "avg_session_duration_minutes", "max_session_duration_minutes",
    )


@query("g08_feature_product")
def _(spark, d):
    return marts.feature_product(cube(spark, d), goods(spark, d))


@query("g09_feature_city")
def _(spark, d):
    return marts.feature_city(cube(spark, d))


@query("g10_feature_category")
def _(spark, d):
    return marts.feature_category(cube(spark, d), goods(spark, d))


@query("g11_feature_brand")
def _(spark, d):
    return marts.feature_brand(cube(spark, d), goods(spark, d))


@query("g12_feature_user_product")
def _(spark, d):
    return marts.feature_user_product(cube(spark, d))


@query("g13_feature_user_category")
def _(spark, d):
    return marts.feature_user_category(cube(spark, d), goods(spark, d))


def _product_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return marts.feature_product_sentiment(
        goods(spark, d), comments(spark, d), aspect_table(spark, d)
    )


@query("g14_feature_product_sentiment")
def _(spark, d):
    return r6(_product_sentiment(spark, d), "avg_like_ratio")


@query("g15_feature_product_aspect")
def _(spark, d):
    return marts.feature_product_aspect(comments(spark, d), aspect_table(spark, d))


@query("g16_feature_brand_sentiment")
def _(spark, d):
    return marts.feature_brand_sentiment(goods(spark, d), comments(spark, d), aspect_table(spark, d))


@query("g16_feature_brand_sentiment_dedup")
def _(spark, d):
    return marts.feature_brand_sentiment(
        goods(spark, d), comments(spark, d), aspect_table(spark, d), dedup=True
    )


@query("g17_feature_category_sentiment")
def _(spark, d):
    return marts.feature_category_sentiment(
        goods(spark, d), comments(spark, d), aspect_table(spark, d)
    )


@query("g18_feature_aspect")
def _(spark, d):
    return marts.feature_aspect(aspect_table(spark, d))


def _feature_time(spark: SparkSession, d: str) -> DataFrame:
    return marts.feature_time(marts.feature_behavior(log(spark, d)))


@query("g19_feature_time")
def _(spark, d):
    return _feature_time(spark, d)


# ---- views --------------------------------------------------------------------------


@query("v01_global_funnel")
def _(spark, d):
    return views.global_funnel(_feature_time(spark, d))


# Thresholds are set so that every tag and segment occurs on the driver tables.
@query("v02_product_360")
def _(spark, d):
    return views.product_360(
        marts.feature_product(cube(spark, d), goods(spark, d)), goods(spark, d),
        _product_sentiment(spark, d), hero_revenue=20_000, hero_positive=0.5, traffic_views=20,
        traffic_purchases=20, risk_negative=0.2, risk_purchases=10,
    )


@query("v03_user_segments")
def _(spark, d):
    return views.user_segments(
        marts.feature_user(staged_cube(spark, d), goods(spark, d)), vip_purchases=12, vip_spend=12_000.0,
        shopper_views=5,
    )


@query("v04_brand_diagnostics")
def _(spark, d):
    return views.brand_diagnostics(
        marts.feature_brand(cube(spark, d), goods(spark, d)), table(spark, d, "wh_brand"),
        marts.feature_brand_sentiment(goods(spark, d), comments(spark, d), aspect_table(spark, d)),
    )


@query("v05_aspect_diagnostics")
def _(spark, d):
    return views.aspect_diagnostics(
        marts.feature_aspect(aspect_table(spark, d)), critical=0.25, strong=0.6
    )


# ---- aspect scoring -----------------------------------------------------------------


@query("i01_decode_spans")
def _(spark, d):
    found = spans.decode_spans(F.col("offsets"), F.col("tags"))
    return spans.once(tagged(spark, d), s=found).select("comment_id", F.inline("s"))


@query("i02_span_terms")
def _(spark, d):
    return aspects.comment_spans(tagged(spark, d)).select("comment_id", F.inline("spans"))


@query("i03_aspect_pairs")
def _(spark, d):
    return aspects.aspect_pairs(aspects.comment_spans(tagged(spark, d))).drop("text")


@query("i04_mean_scores")
def _(spark, d):
    return r6(aspects.mean_scores(scored(spark, d)), *aspects.CLASSES)


@query("i05_top_class")
def _(spark, d):
    labelled = aspects.label_aspects(aspects.mean_scores(scored(spark, d)))
    return labelled.groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("aspects"), F.sum("mentions").alias("mentions")
    )


@query("i06_label_aspects")
def _(spark, d):
    return aspects.label_aspects(aspects.mean_scores(scored(spark, d)))


@query("i07_attach_aspects")
def _(spark, d):
    labelled = aspects.label_aspects(aspects.mean_scores(scored(spark, d)))
    base = texts(spark, d).select(F.col("doc_id").alias("id"))
    items = F.from_json("aspects_json", aspects.ASPECT_ITEMS)
    return aspects.attach_aspects(base, labelled).select(
        "id", "num_aspects", F.get(items, F.lit(0))["term"].alias("first_term"),
        F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x["mentions"]).alias("mentions"),
        F.array_join(F.transform(items, lambda x: F.concat_ws("|", x["term"], x["sentiment"], x["mentions"])), ",").alias("items"),
    )


@query("i08_score_comments")
def _(spark, d):
    base = texts(spark, d).select(F.col("doc_id").alias("id"))
    out = aspects.score_comments(base, tagged(spark, d), length_scorer)
    items = F.from_json("aspects_json", aspects.ASPECT_ITEMS)
    return out.select("id", F.inline(items)).drop("mentions")


@query("i09_scoring_hook")
def _(spark, d):
    return r6(scored(spark, d).drop("term"), *aspects.CLASSES)


# ---- sentiment KPIs -----------------------------------------------------------------


@query("j00_predictions")
def _(spark, d):
    out = sentiment.predictions(_with_aspects_json(spark, d))
    return out.select(
        "id", "predicted_sentiment", F.size(F.filter("predicted_aspects", lambda a: a.isNotNull())).alias("terms"),
        F.coalesce(F.array_join("predicted_aspects", ","), F.lit("")).alias("aspects"),
    )


@query("j01_aspect_rows")
def _(spark, d):
    return sentiment.aspect_rows(predicted(spark, d))


@query("j02_sentiment_pivot")
def _(spark, d):
    return sentiment.sentiment_pivot(predicted(spark, d), ["product_id"])


@query("j03_product_kpi")
def _(spark, d):
    return sentiment.product_kpi(predicted(spark, d))


@query("j04_top_aspect")
def _(spark, d):
    return sentiment.top_aspect(sentiment.aspect_rows(predicted(spark, d)))


@query("j05_worst_aspect")
def _(spark, d):
    return sentiment.worst_aspect(sentiment.aspect_rows(predicted(spark, d)))


@query("j06_brand_kpi")
def _(spark, d):
    return sentiment.brand_kpi(predicted(spark, d), catalogue(spark, d))


@query("j07_category_kpi")
def _(spark, d):
    return sentiment.category_kpi(predicted(spark, d), catalogue(spark, d))


@query("j08_aspect_kpi")
def _(spark, d):
    return sentiment.aspect_kpi(predicted(spark, d))


@query("j09_product_aspect_kpi")
def _(spark, d):
    return sentiment.product_aspect_kpi(predicted(spark, d))


@query("j10_sentiment_distribution")
def _(spark, d):
    return sentiment.sentiment_distribution(predicted(spark, d))


@query("j11_aspect_frequency")
def _(spark, d):
    return sentiment.aspect_frequency(predicted(spark, d))


@query("j12_product_subset")
def _(spark, d):
    return r6(sentiment.product_subset(master(spark, d)), "avg_like_ratio")


def _absa(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.product_master_absa(
        sentiment.product_subset(master(spark, d)), sentiment.product_kpi(predicted(spark, d))
    )


@query("j13_product_master_absa")
def _(spark, d):
    return r6(_absa(spark, d), "avg_like_ratio")


# ---- quality and exploration --------------------------------------------------------


@query("q01_null_overview")
def _(spark, d):
    return quality.null_overview(catalogue(spark, d))


@query("q02_duplicate_rows")
def _(spark, d):
    return quality.duplicate_rows(log(spark, d).select("user_id", "product_id", "event_type"))


@query("q03_infinity_counts")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn(
        "per_discount", F.when(F.col("l_discount") == 0, float("inf")).otherwise(1 / F.col("l_discount"))
    )
    return quality.infinity_counts(rows)


def _rule_query(name: str, rule: str, source: Callable) -> None:
    @query(name)
    def _(spark, d):
        return quality.rule_violations(source(spark, d), (rule,))


def _account_as(column: str) -> Callable:
    return lambda spark, d: table(spark, d, "customer").select(F.col("c_acctbal").alias(column))


_rule_query("q04_purchase_above_view", "purchase_above_view", master)
_rule_query("q05_product_rate_range", "product_rate_range", catalogue)
_rule_query("q06_comment_rate_range", "comment_rate_range", comments)
_rule_query("q07_negative_price", "negative_price", _account_as("Price"))
_rule_query("q08_unknown_event_type", "unknown_event_type", log)


@query("q09_value_counts")
def _(spark, d):
    return quality.value_counts(log(spark, d), "event_type")


@query("q10_funnel_anomalies")
def _(spark, d):
    return quality.funnel_anomalies(master(spark, d))


@query("q11_spending_users")
def _(spark, d):
    return quality.spending_users(users(spark, d))


@query("q11_discussed_products")
def _(spark, d):
    return quality.discussed_products(master(spark, d))


@query("q12_table_report")
def _(spark, d):
    return quality.table_report(
        {
            "log": log(spark, d), "catalogue": catalogue(spark, d), "comments": comments(spark, d),
            "nothing": log(spark, d).filter("event_type = 'none'"),
        }
    )


@query("q_scan_all_rules")
def _(spark, d):
    return quality.scan({"catalogue": catalogue(spark, d), "log": log(spark, d)})


def _golden(spark: SparkSession, d: str) -> DataFrame:
    return explore.golden_table(_absa(spark, d), master(spark, d))


@query("e01_golden_table")
def _(spark, d):
    return r6(_golden(spark, d), "avg_like_ratio")


@query("e02_bubble_set")
def _(spark, d):
    return explore.bubble_set(_golden(spark, d)).select(
        "id", "Price", "conversion_rate", "total_comments", "sentiment_score", "top_aspect"
    )


@query("e03_correlations")
def _(spark, d):
    return r6(explore.correlations(_golden(spark, d)), "r")


@query("e04_brand_score_quartiles")
def _(spark, d):
    return r6(explore.brand_score_quartiles(_golden(spark, d)), "q1", "median", "q3")


@query("e05_diverging_aspects")
def _(spark, d):
    return explore.diverging_aspects(sentiment.aspect_kpi(predicted(spark, d)))


@query("e06_funnel_stages")
def _(spark, d):
    return explore.funnel_stages(enriched(spark, d))


@query("e07_hourly_trend")
def _(spark, d):
    return explore.hourly_trend(enriched(spark, d))


# ---- labelled spans -----------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Folded document texts in pieces of twelve words, each word of over four characters as a term."""
    folded = spans.once(texts(spark, d), words=F.split(text.normalize(F.col("text")), " "))
    pieces = folded.select("doc_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("words") / 12).cast("int") - 1), lambda i: F.slice("words", i * 12 + 1, 12))).alias("piece", "words"))
    pieces = pieces.withColumn("text", F.array_join("words", " "))  # once a piece, not once a word
    rows = pieces.select("doc_id", "piece", "text", F.posexplode("words").alias("at", "term"))
    return rows.filter(F.length("term") > 4).withColumn("no", F.col("piece") * 12 + F.col("at")).select(
        "doc_id", "no", "text", "term",
        F.element_at(F.array(*[F.lit(c) for c in aspects.CLASSES]), (F.col("doc_id") % 3 + 1).cast("int"))
        .alias("polarity"),
        (F.instr("text", F.col("term")) - 1 + F.col("doc_id") % 2).cast("string").alias("from"),
        (F.instr("text", F.col("term")) - 1 + F.col("doc_id") % 2 + F.length("term"))
        .cast("string")
        .alias("to"),
    )


def _examples_json(spark: SparkSession, d: str) -> DataFrame:
    """Raw model output, wrapped and as a bare list in turn."""
    aspect = F.struct("term", F.upper("polarity").alias("polarity"))
    bad = F.struct(F.lit("no such term").alias("term"), F.lit("positive").alias("polarity"))
    per_text = _labelled(spark, d).select(
        (F.col("doc_id") * 1_000_000 + F.col("no")).alias("batch"),
        F.struct(F.col("text").alias("review_text"), F.array(aspect, bad).alias("aspects")).alias("ex"),
    )
    raw = F.when(
        F.col("batch") % 2 == 0, F.to_json(F.struct(F.array("ex").alias("examples")))
    ).otherwise(F.to_json(F.array("ex")))
    return per_text.select("batch", raw.alias("raw"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return _examples_json(spark, d).select(
        "batch", trainprep.extract_examples(F.col("raw")).alias("examples")
    )


@query("p01_valid_examples")
def _(spark, d):
    return trainprep.valid_examples(_batches(spark, d))


@query("p01_example_counts")
def _(spark, d):
    return trainprep.example_counts(_batches(spark, d))


@query("p02_extract_examples")
def _(spark, d):
    return _batches(spark, d).select("batch", F.inline("examples")).select(
        "batch", "review_text", F.size("aspects").alias("aspects")
    )


@query("p03_batch_plan")
def _(spark, d):
    part = table(spark, d, "part")
    types = part.groupBy(F.col("p_type").alias("category")).agg(
        F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("hints")
    )
    from souqlytics.operators.ranking import number_rows

    categories = number_rows(types, [F.col("category")], "no").select(
        (F.col("no") - 1).alias("pos"), "category", "hints"
    )
    return trainprep.batch_plan(spark, categories, part.count())


@query("p04_located_pairs")
def _(spark, d):
    span = spans.check_or_find(
        F.col("text"), F.col("term"), F.col("from").try_cast("int"), F.col("to").try_cast("int")
    )
    return _labelled(spark, d).select("doc_id", "term", span.alias("s")).select(
        "doc_id", "term", F.col("s.start").alias("asp_start"), F.col("s.end").alias("asp_end")
    )


def _token_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents in token-per-line form, written as text and scanned back."""
    path = scratch_path(spark, "tokens")
    mark = F.element_at(F.array(*[F.lit(m) for m in ("-1", "0", "+2", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    lines = texts(spark, d).select(
        "doc_id",
        F.transform(
            text.words(F.col("text")),
            lambda w, i: F.concat(
                i.cast("string"), F.lit("\t"), w,
                F.when(F.length(w) % 4 == 0, "\tT").otherwise(""),
            ),
        ).alias("tokens"),
        mark.alias("mark"),
    )
    whole = F.concat(
        F.lit("[id@@@"), F.col("doc_id").cast("string"), F.lit("]\n["), F.col("mark"), F.lit("]\n"),
        F.array_join("tokens", "\n"), F.lit("\n"),
    )
    lines.select(whole.alias("value")).write.text(path)
    return files.read_lines(spark, path)


@query("p05_token_line_targets")
def _(spark, d):
    found = trainprep.token_line_targets(_token_lines(spark, d))
    return found.select(
        F.md5("text").alias("text_md5"), "term", "asp_start", "asp_end", "polarity_raw"
    )


@query("p06_polarity_map")
def _(spark, d):
    found = trainprep.map_polarity(trainprep.token_line_targets(_token_lines(spark, d)))
    return found.groupBy("polarity").agg(F.count(F.lit(1)).alias("targets"))


def _json_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line per labelled text in one of the four shapes, some broken."""
    path = scratch_path(spark, "jsonl")
    n = F.col("doc_id") % 6
    asp = F.struct("term", "polarity")
    twice = F.array(asp, asp)
    ex = F.struct(F.col("text").alias("review_text"), twice.alias("aspects"))
    wrapped = F.struct(F.array(ex).alias("examples"))
    line = (
        F.when(n == 0, F.to_json(wrapped))
        .when(n == 1, F.to_json(F.struct(F.to_json(wrapped).alias("raw"), F.lit("c").alias("category"))))
        .when(n == 2, F.to_json(ex))
        .when(
            n == 3,
            F.to_json(
                F.struct(
                    F.col("text").alias("review_text"), "term", "polarity",
                    F.col("from").alias("asp_start"), F.col("to").alias("asp_end"),
                )
            ),
        )
        .when(n == 4, F.lit('{"broken": '))
        .otherwise(F.lit('{"other": 1}'))
    )
    _labelled(spark, d).select(line.alias("value")).write.text(path)
    return files.read_lines(spark, path)


@query("p07_json_line_counts")
def _(spark, d):
    return trainprep.json_line_counts(_json_lines(spark, d))


@query("p07_json_line_examples")
def _(spark, d):
    return trainprep.json_line_examples(_json_lines(spark, d)).select(
        F.md5("review_text").alias("text_md5"), "term", "polarity", "asp_start", "asp_end", "category"
    )


@query("p08_non_overlapping")
def _(spark, d):
    items = F.array(*[
        F.struct(F.col("term"), F.col("polarity"), F.lit(None).cast("string").alias("asp_start"),
                 F.lit(None).cast("string").alias("asp_end")) for _ in range(2)
    ])
    placed = trainprep.place_aspects(F.col("text"), items)
    return _labelled(spark, d).select("doc_id", F.inline(placed)).select(
        "doc_id", "term", "state", F.col("start").alias("asp_start"), F.col("end").alias("asp_end")
    )


@query("p09_realign")
def _(spark, d):
    pairs = _labelled(spark, d).select(
        "doc_id", F.concat(F.lit("<b> "), "text", F.lit(" </b>")).alias("text"), "term"
    )
    pairs = spans.once(pairs, folded=text.normalize(F.col("text")))
    start = F.instr("text", F.col("term")) - 1
    moved = spans.realign(
        F.col("text"), F.col("folded"), start, start + F.length("term"), text.normalize
    )
    return spans.once(pairs, s=moved).select("doc_id", "term", F.col("s.start").alias("asp_start"), F.col("s.end").alias("asp_end"))


@query("p10_split_rows")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return (
        trainprep.split_rows(rows, "lang").groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))
    )


@query("p10_three_parts")
def _(spark, d):
    """Row ids of train, validation and test, by a hash that SQL has too."""
    rows = table(spark, d, "documents").select("doc_id", "lang")
    order = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10)
    return trainprep.split_rows(rows, "lang", test=0.5, order=order)


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return trainprep.located_pairs(_labelled(spark, d))


@query("p11_add_extra")
def _(spark, d):
    rows = stage(_examples(spark, d), "examples")
    whole = trainprep.add_extra(rows, rows, rows.withColumn("polarity", F.lit("synthetic")))
    return whole.groupBy((F.col("polarity") == "synthetic").alias("synthetic")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("p12_label_shares")
def _(spark, d):
    return trainprep.label_shares(trainprep.add_label_ids(_labelled(spark, d)), "label_id")


@query("p13_spans_per_review")
def _(spark, d):
    return trainprep.spans_per_review(_examples(spark, d)).select(
        F.md5("review_text").alias("text_md5"), F.inline("asp_spans")
    )


def _tagged_reviews(spark: SparkSession, d: str) -> DataFrame:
    return trainprep.tagged_reviews(trainprep.spans_per_review(_examples(spark, d)))


@query("p14_tagged_reviews")
def _(spark, d):
    ones = lambda t: F.size(F.filter("tags", lambda x: x == t))
    return _tagged_reviews(spark, d).select(
        F.md5("review_text").alias("text_md5"), F.size("tags").alias("tokens"),
        ones(spans.TAG_B).alias("begins"), ones(spans.TAG_I).alias("insides"),
        F.array_join(F.transform("tags", lambda x: F.when(x == spans.TAG_B, "B").when(x == spans.TAG_I, "I").otherwise("O")), "").alias("tags"),
    )


@query("p15_class_weights")
def _(spark, d):
    return trainprep.class_weights(trainprep.add_label_ids(_labelled(spark, d)), "label_id")


def _two_taggings(spark: SparkSession, d: str) -> DataFrame:
    flip = F.transform(
        "tags", lambda t, i: F.when(i % 6 == 0, F.lit(spans.TAG_O)).otherwise(t)
    )
    return tagged(spark, d).withColumn("predicted", flip)


@query("p16_entity_scores")
def _(spark, d):
    return trainprep.entity_scores(_two_taggings(spark, d))


@query("p17_class_scores")
def _(spark, d):
    rows = table(spark, d, "labels").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("predicted")
    )
    return r6(trainprep.class_scores(rows), "f1_weighted", "f1_macro", "precision_macro", "recall_macro")


@query("p18_tag_distribution")
def _(spark, d):
    return trainprep.tag_distribution(_two_taggings(spark, d))


@query("p19_untagged_reviews")
def _(spark, d):
    return trainprep.untagged_reviews(_tagged_reviews(spark, d))


@query("p19_multi_aspect_reviews")
def _(spark, d):
    return trainprep.multi_aspect_reviews(_examples(spark, d))


# ---- vectors ------------------------------------------------------------------------


@query("x01_embedding_input")
def _(spark, d):
    return texts(spark, d).select("doc_id", vectors.embedding_input(F.col("text")).alias("text"))


@query("x02_unit_vectors")
def _(spark, d):
    return r6(
        neighbours.normalised(table(spark, d, "embeddings")).select("vec_id", F.posexplode("embedding").alias("pos", "x")),
        "x",
    )


@query("x03_vector_check")
def _(spark, d):
    return _raw_embeddings(spark, d).groupBy(
        vectors.is_valid(F.col("embedding"), 64).alias("valid")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("x04_pair_similarity")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pairs = rows.join(after, "vec_id")
    return r6(neighbours.pair_similarity(pairs, "embedding", "next"), "cosine").select("vec_id", "cosine")


def _centres(spark: SparkSession, d: str) -> DataFrame:
    """Sum vector per label: the queries are derived from the whole table."""
    summed = (
        table(spark, d, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.sum(F.col("x").cast("double")).alias("x"))
    )
    return summed.groupBy(F.col("label").cast("bigint").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector")
    )


@query("x05_top_k_cosine")
def _(spark, d):
    corpus = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return r6(neighbours.top_k_cosine(corpus, _centres(spark, d), k=10), "cosine")


def _uneven_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vector) with null ids, cut, null and zero vectors among whole ones."""
    n = F.col("vec_id")
    vector = (
        F.when(n % 13 == 1, F.slice("embedding", 1, 10)).when(n % 13 == 2, None)
        .when(n % 13 == 3, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    )
    return table(spark, d, "embeddings").select(F.when(n % 17 != 4, n).alias("id"), vector.alias("vector"))


@query("x05_cell_search")
def _(spark, d):
    """Every usable vector of the table asks for its ten nearest."""
    rows = _uneven_vectors(spark, d)
    return r6(neighbours.search_cells(neighbours.build_cells(rows), rows, k=10), "cosine")


# ---- stored tables: batches that overlap ----------------------------------------------


def _customers(spark: SparkSession, d: str, name: str) -> StoredTable:
    return StoredTable(spark, scratch_path(spark, name), "c_custkey bigint, c_acctbal double", ["c_custkey"], buckets=16)


def _balances(spark: SparkSession, d: str, rows: str, more: int) -> DataFrame:
    return table(spark, d, "customer").filter(rows).select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), (F.col("c_acctbal") + more).cast("double").alias("c_acctbal"))


@query("w03_stored_insert_ignore")
def _(spark, d):
    """Even keys first; then, twice, all keys with other values, of which only the odd ones are new."""
    t = _customers(spark, d, "ignored")
    t.insert_ignore(_balances(spark, d, "c_custkey % 2 = 0", 0))
    for _ in range(2):
        t.insert_ignore(_balances(spark, d, "true", 1))
    return t.read()


@query("w04_stored_upsert")
def _(spark, d):
    """Loads that change a third, change nothing, and change a fifth after a compaction."""
    t = _customers(spark, d, "replaced")
    t.upsert(_balances(spark, d, "c_custkey % 7 <> 0", 0))
    for _ in range(2):
        t.upsert(_balances(spark, d, "c_custkey % 3 = 0", 1))
    t.compact()
    t.upsert(_balances(spark, d, "c_custkey % 5 = 0", 2))
    return t.read()


def _batch(spark: SparkSession, d: str, second: bool) -> dict[str, DataFrame]:
    """Raw rows of one load: fractions, flags that vary, and keys that the other load has too."""
    i = F.col("id")
    price = F.concat(F.col("Price").cast("string"), F.when(i % 4 == 1, ".5").when(i % 4 == 2, ".25").otherwise(""))
    goods_ = catalogue(spark, d).withColumns({
        "Brand": F.when(i % 2 == 1, F.concat("Brand", F.lit(" new"))).otherwise(F.col("Brand")),
        "Price": price, "Is_Fake": F.when(i % 3 == 0, "yes").when(i % 3 == 1, "no"),
    })
    talk = _with_aspects_json(spark, d).select("id", "aspects_json").join(_raw_comments(spark, d).withColumn("id", F.col("id").cast("bigint")), "id")
    talk = talk.withColumn("likes", F.concat(F.col("likes").cast("string"), F.when(i % 4 == 0, ".5").otherwise("")))
    vectors_ = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    if second:
        return {
            "products": goods_.filter("id % 5 <> 0").withColumn("title_fa", F.concat(F.lit("new "), "title_fa")),
            "logs": log(spark, d),
            "comments": talk.filter("id % 5 <> 0").withColumn("dislikes", F.col("dislikes") + 1),
            "embeddings": vectors_.withColumn("embedding", F.transform("embedding", lambda x: x * 2)),
        }
    return {
        "products": goods_.filter("id % 2 = 0"), "logs": log(spark, d).filter("log_id % 3 = 0"),
        "comments": talk.filter("id % 2 = 0"), "embeddings": vectors_.filter("vec_id % 2 = 0"),
    }


@lru_cache(maxsize=4)
def _two_loads(app: str, spark: SparkSession, d: str) -> dict[str, DataFrame]:
    folder = scratch_path(spark, "warehouse")
    for second in (False, True, True):
        loaded = jobs.load_stored_warehouse(spark, folder, **_batch(spark, d, second), dimension=64)
    return loaded


def _loaded(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table after the first load, the second, and the second again."""
    return _two_loads(spark.sparkContext.applicationId, spark, d)[name]


for _name, _table in (
    ("w01_second_load", "users"), ("w05_second_load", "cities"), ("w06_second_load", "brands"), ("w07_second_load", "categories"),
    ("w09_second_load", "sessions"), ("w10_second_load", "products"), ("w13_second_load", "comment_aspects"),
):
    query(_name)(lambda spark, d, _table=_table: _loaded(spark, d, _table))


@query("w11_second_load")
def _(spark, d):
    return _loaded(spark, d, "user_behavior_logs").withColumn("timestamp", F.unix_micros("timestamp"))


@query("w12_second_load")
def _(spark, d):
    return _loaded(spark, d, "comments").withColumn("created_at", F.unix_micros("created_at"))


@query("w14_second_load")
def _(spark, d):
    return _loaded(spark, d, "comments_embedding").select("id", F.posexplode("embedded_comment").alias("pos", "x"))


@query("w11_incomplete_events")
def _(spark, d):
    """The loader variant that keeps events without type or time."""
    raw = log(spark, d).withColumns({
        "event_type": F.when(F.col("log_id") % 5 != 0, F.col("event_type")),
        "timestamp": F.when(F.col("log_id") % 7 != 0, F.col("timestamp")),
    })
    loaded = warehouse.load_behavior_logs(raw, table(spark, d, "shop_session"), goods(spark, d), require_complete=False)
    return loaded.withColumn("timestamp", F.unix_micros("timestamp"))
