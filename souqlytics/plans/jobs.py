"""The four batch jobs: clean, features + KPIs, warehouse + marts + views, aspects."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souqlytics.functions.text import normalize, raw_text
from souqlytics.operators import behaviour, explore, kpi, marts, sentiment, views, warehouse
from souqlytics.operators.aspects import Scorer, score_comments
from souqlytics.operators.cleaning import clean, cleaning_report
from souqlytics.registry import DATASETS
from souqlytics.session import stage
from souqlytics.sources.files import ORDINAL, PART_ROWS, read_csv, read_parquet, write_parts
from souqlytics.sources.stored import StoredTable
from souqlytics.sources.tables import publish, save_kpis, save_tables


def clean_table(raw: DataFrame, dataset: str, ordinal: str | None = ORDINAL) -> DataFrame:
    """B10 plus T01 and T09: a raw table with typed columns and normalised text."""
    config = DATASETS[dataset]
    out = clean(raw, dataset, ordinal)
    text = raw_text(list(config.preprocess), out.columns)
    return out.withColumn("raw_text", text).withColumn(
        "raw_text_normalized", normalize(F.col("raw_text"))
    )


def clean_job(
    spark: SparkSession, source: str, target: str, multi_line: bool = True, rows_per_file: int = PART_ROWS
) -> dict[str, DataFrame]:
    """Clean every registered CSV under ``source``; returns one report per dataset.

    Turn ``multi_line`` off for files without quoted line breaks: that saves two passes.
    """
    reports = {}
    for name, dataset in DATASETS.items():
        try:
            raw = read_csv(spark, f"{source}/{name}.csv", multi_line, ORDINAL)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        path = f"{target}/{dataset.parts_folder}"
        write_parts(clean_table(raw, name), path, rows_per_file)
        cleaned = read_parquet(spark, path).drop("raw_text", "raw_text_normalized")
        reports[name] = cleaning_report(raw.drop(ORDINAL), cleaned)
    return reports


def feature_tables(
    products: DataFrame | None, log: DataFrame | None, comments: DataFrame | None,
    stage_shared: bool = False,
) -> dict[str, DataFrame]:
    """every feature table the given inputs allow.

    ``stage_shared`` writes the per-product results that other tables are built from,
    so the log is not aggregated again for each of them.
    """
    def shared(df: DataFrame, name: str) -> DataFrame:
        return stage(df, name) if stage_shared else df

    tables: dict[str, DataFrame] = {}
    if log is not None:
        enriched = behaviour.enrich_log(log)
        tables["user_behavior_enriched"] = enriched
        tables["user_features"] = behaviour.user_totals(enriched)
        tables["product_behavior"] = shared(
            behaviour.product_totals(enriched), "product_behavior"
        )
        tables["city_features"] = behaviour.city_totals(enriched)
        if products is not None:
            tables["user_features"] = behaviour.user_features(enriched, products)
    if comments is not None:
        tables["comment_features"] = shared(
            behaviour.comment_features(comments), "comment_features"
        )
    if products is not None:
        tables["product_master"] = behaviour.product_master(
            products, tables.get("product_behavior"), tables.get("comment_features")
        )
    return tables


def feature_job(spark: SparkSession, source: str, target: str) -> dict[str, DataFrame]:
    """F17, S08, F16, K17, S09 over cleaned folders.

    Tables are written in dependency order and read back, so later ones and the KPIs
    scan finished columns instead of recomputing the log.
    """
    cleaned = {
        name: read_parquet(spark, f"{source}/{d.parts_folder}", union_by_name=True)
        for name, d in DATASETS.items()
    }
    tables = feature_tables(
        cleaned["products"], cleaned["user_behavior_logs"], cleaned["comments"], stage_shared=True
    )
    save_tables(tables, target)
    stored = {n: spark.read.parquet(f"{target}/{n}.parquet") for n in tables}
    behaviour.feature_table(stored).write.mode("overwrite").parquet(f"{target}/feature_table.parquet")
    save_kpis(kpi.all_kpis(stored), target)
    return stored


def load_warehouse(
    products: DataFrame, logs: DataFrame, comments: DataFrame,
    existing: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """W01-W13 in reference order; dimensions are staged, as facts look them up."""
    old = (existing or {}).get
    t: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame) -> None:
        t[name] = stage(df, name)

    put("users", warehouse.load_users(logs, old("users")))
    put("cities", warehouse.load_cities(logs, old("cities")))
    put("brands", warehouse.load_brands(products, old("brands")))
    put("categories", warehouse.load_categories(products, old("categories")))
    put("sellers", warehouse.load_sellers(products, old("sellers")))
    put("sessions", warehouse.load_sessions(logs, t["users"], t["cities"], old("sessions")))
    put(
        "products",
        warehouse.load_products(
            products, t["brands"], t["categories"], t["sellers"], old("products")
        ),
    )
    put(
        "user_behavior_logs",
        warehouse.load_behavior_logs(logs, t["sessions"], t["products"], old("user_behavior_logs")),
    )
    put("comments", warehouse.load_comments(comments, t["products"], old("comments")))
    if "aspects_json" in comments.columns:
        put(
            "comment_aspects",
            warehouse.load_comment_aspects(comments, t["comments"], old("comment_aspects")),
        )
    return t


def open_warehouse(spark: SparkSession, folder: str) -> dict[str, StoredTable]:
    """The stored tables of the star schema under a folder, whether or not they have rows yet."""
    return {
        name: StoredTable(spark, f"{folder}/{name}", schema, warehouse.NATURAL_KEYS[name])
        for name, schema in warehouse.SCHEMAS.items()
    }


def load_stored_warehouse(
    spark: SparkSession, folder: str, products: DataFrame, logs: DataFrame, comments: DataFrame,
    embeddings: DataFrame | None = None, require_complete: bool = True, dimension: int = warehouse.EMBEDDING_DIMENSION,
) -> dict[str, DataFrame]:
    """W01-W14 into stored tables, in reference order; returns them as they are then.

    Each table adds what is new of the batch as one load; a repeated batch adds nothing. A run
    that broke may be repeated: what is there already is left out or replaced by itself.
    ``embeddings`` is (id, embedding) of comments; ``require_complete=False`` keeps events
    without type or time.
    """
    t = open_warehouse(spark, folder)
    t["users"].insert_ignore(warehouse.user_rows(logs))
    t["cities"].add_keys(warehouse.city_rows(logs), "city_id")
    t["brands"].add_keys(warehouse.brand_rows(products), "brand_id")
    t["categories"].add_keys(warehouse.category_rows(products), "category_id")
    t["sellers"].add_keys(warehouse.seller_rows(products), "seller_id")
    t["sessions"].upsert(warehouse.session_rows(logs, t["users"].read(), t["cities"].read()))
    t["products"].upsert(
        warehouse.product_rows(products, t["brands"].read(), t["categories"].read(), t["sellers"].read())
    )
    known = t["products"].read()
    t["user_behavior_logs"].add_keys(
        warehouse.log_rows(logs, t["sessions"].read(), known, require_complete), "log_id"
    )
    t["comments"].upsert(warehouse.comment_rows(comments, known))
    if "aspects_json" in comments.columns:
        t["comment_aspects"].add_keys(warehouse.aspect_rows(comments, t["comments"].read()), "aspect_id")
    if embeddings is not None:
        t["comments_embedding"].insert_ignore(
            warehouse.embedding_rows(embeddings, t["comments"].read(), dimension).select(
                "id", F.col("embedded_comment").cast("array<double>").alias("embedded_comment"))
        )
    return {name: table.read() for name, table in t.items()}


def build_marts(tables: dict[str, DataFrame], folder: str | None = None) -> dict[str, DataFrame]:
    """Feature tables, published under ``folder`` or as views.

    The activity cube is written once; nine marts read it.
    """
    logs, sessions, products = (
        tables[n] for n in ("user_behavior_logs", "sessions", "products")
    )
    comments, aspects = tables["comments"], tables["comment_aspects"]
    cube = stage(marts.activity(marts.user_base(logs, sessions)), "activity")
    built = {
        "feature_behavior": marts.feature_behavior(logs),
        "feature_user": marts.feature_user(cube, products),
        "feature_product": marts.feature_product(cube, products),
        "feature_city": marts.feature_city(cube),
        "feature_category": marts.feature_category(cube, products),
        "feature_brand": marts.feature_brand(cube, products),
        "feature_user_product": marts.feature_user_product(cube),
        "feature_user_category": marts.feature_user_category(cube, products),
        "feature_product_sentiment": marts.feature_product_sentiment(products, comments, aspects),
        "feature_product_aspect": marts.feature_product_aspect(comments, aspects),
        "feature_brand_sentiment": marts.feature_brand_sentiment(products, comments, aspects),
        "feature_category_sentiment": marts.feature_category_sentiment(products, comments, aspects),
        "feature_aspect": marts.feature_aspect(aspects),
    }
    out = {name: publish(df, name, folder) for name, df in built.items()}
    out["feature_time"] = publish(
        marts.feature_time(out["feature_behavior"]), "feature_time", folder
    )
    return out


def build_views(tables: dict[str, DataFrame], m: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """V01-V05 as views over published marts."""
    built = {
        "global_funnel": views.global_funnel(m["feature_time"]),
        "product_360": views.product_360(
            m["feature_product"], tables["products"], m["feature_product_sentiment"]
        ),
        "user_segments": views.user_segments(m["feature_user"]),
        "brand_diagnostics": views.brand_diagnostics(
            m["feature_brand"], tables["brands"], m["feature_brand_sentiment"]
        ),
        "aspect_diagnostics": views.aspect_diagnostics(m["feature_aspect"]),
    }
    return {name: publish(df, name) for name, df in built.items()}


def aspect_job(comments: DataFrame, tagged: DataFrame, scorer: Scorer) -> DataFrame:
    """Comments with aspects and predictions."""
    return sentiment.predictions(score_comments(comments, tagged, scorer))


def aspect_kpis(comments: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """J03-J13 and the chart tables E01-E05, from comments with predictions."""
    subset = sentiment.product_subset(master)
    product = sentiment.product_kpi(comments)
    absa = sentiment.product_master_absa(subset, product)
    golden = explore.golden_table(absa, master)
    aspect = sentiment.aspect_kpi(comments)
    return {
        "product_kpi": product,
        "brand_kpi": sentiment.brand_kpi(comments, subset),
        "category_kpi": sentiment.category_kpi(comments, subset),
        "aspect_kpi": aspect,
        "product_aspect_kpi": sentiment.product_aspect_kpi(comments),
        "sentiment_distribution": sentiment.sentiment_distribution(comments),
        "aspect_frequency": sentiment.aspect_frequency(comments),
        "product_master_absa": absa,
        "golden": golden,
        "bubble_set": explore.bubble_set(golden),
        "correlations": explore.correlations(golden),
        "brand_score_quartiles": explore.brand_score_quartiles(golden),
        "diverging_aspects": explore.diverging_aspects(aspect),
    }
