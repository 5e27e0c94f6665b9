"""Star-schema loads with generated keys, insert-ignore and upsert.

Every load takes the incoming batch and the tables as they are, and returns the
table as it is to be. ``None`` as existing table means "empty".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souqlytics.functions.numbers import parse_bool, parse_id, parse_whole
from souqlytics.functions.vectors import is_valid
from souqlytics.operators.ranking import number_by_bucket

ASPECT_ITEM = (
    "array<struct<term:string,sentiment:string,negative_pct:double,neutral_pct:double,"
    "positive_pct:double,mentions:bigint>>"
)
EMBEDDING_DIMENSION = 768


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _trimmed(name: str) -> Column:
    return F.trim(F.col(name).cast("string"))


def insert_ignore(new: DataFrame, existing: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose key is there already are left out."""
    if existing is None:
        return new
    fresh = new.join(existing.select(*keys), _same(new, existing, keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(new: DataFrame, existing: DataFrame | None, keys: list[str]) -> DataFrame:
    """An incoming row replaces the row with its key.

    Of several incoming rows with one key the smallest in column order is taken.
    """
    rest = [c for c in new.columns if c not in keys]
    one = (
        new.groupBy(*keys)
        .agg(F.min(F.struct(*rest)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*new.columns)
    )
    if existing is None:
        return one
    kept = existing.join(one.select(*keys), _same(existing, one, keys), "left_anti")
    return kept.unionByName(one.select(*existing.columns))


def add_keys(
    new: DataFrame, existing: DataFrame | None, keys: list[str], id_column: str,
    id_type: str = "bigint",
) -> DataFrame:
    """New natural keys get max(existing id) + 1, 2, ... by key hash, then key."""
    fresh = new
    top = 0
    if existing is not None:
        fresh = new.join(existing.select(*keys), _same(new, existing, keys), "left_anti")
        top = existing.agg(F.max(id_column)).first()[0] or 0
    numbered = number_by_bucket(fresh, keys, "_no").withColumn(
        id_column, (F.col("_no") + F.lit(top)).cast(id_type)
    )
    numbered = numbered.select(id_column, *new.columns)
    return numbered if existing is None else existing.unionByName(numbered)


def _names(raw: DataFrame, source: str, out: str) -> DataFrame:
    name = _trimmed(source)
    return raw.select(name.alias(out)).filter(F.col(out) != "").distinct()


def user_rows(logs: DataFrame) -> DataFrame:
    new = logs.select(parse_id(F.col("user_id")).alias("user_id"))
    return new.filter(F.col("user_id").isNotNull()).distinct()


def load_users(logs: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """W01."""
    return insert_ignore(user_rows(logs), users, ["user_id"])


def city_rows(logs: DataFrame) -> DataFrame:
    return _names(logs, "city", "name")


def load_cities(logs: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """W05."""
    return add_keys(city_rows(logs), cities, ["name"], "city_id", "int")


def brand_rows(products: DataFrame) -> DataFrame:
    return _names(products, "Brand", "name")


def load_brands(products: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """W06."""
    return add_keys(brand_rows(products), brands, ["name"], "brand_id", "int")


def category_rows(products: DataFrame) -> DataFrame:
    return (
        products.filter(F.col("Category1").isNotNull())
        .select(
            _trimmed("Category1").alias("category1"),
            _trimmed("Category2").alias("category2"),
            F.nullif(_trimmed("sub_category"), F.lit("")).alias("sub_category"),
        )
        .distinct()
    )


def load_categories(products: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Nulls count as equal in the key."""
    return add_keys(category_rows(products), categories, ["category1", "category2", "sub_category"], "category_id")


def seller_rows(products: DataFrame) -> DataFrame:
    return _names(products, "Seller", "seller_title")


def load_sellers(products: DataFrame, sellers: DataFrame | None = None) -> DataFrame:
    """W08."""
    return add_keys(seller_rows(products), sellers, ["seller_title"], "seller_id", "int")


def session_rows(logs: DataFrame, users: DataFrame, cities: DataFrame) -> DataFrame:
    return (
        logs.select(
            _trimmed("session_id").alias("session_id"),
            parse_id(F.col("user_id")).alias("user_id"),
            _trimmed("city").alias("name"),
        )
        .filter(F.col("session_id") != "")
        .distinct()
        .join(users.select("user_id"), "user_id", "left_semi")
        .join(cities.select("city_id", "name"), "name", "left")
        .select("session_id", "user_id", "city_id")
        .distinct()
    )


def load_sessions(
    logs: DataFrame, users: DataFrame, cities: DataFrame, sessions: DataFrame | None = None
) -> DataFrame:
    """The user has to exist; an unknown city stays null."""
    return upsert(session_rows(logs, users, cities), sessions, ["session_id"])


def product_rows(
    raw: DataFrame, brands: DataFrame, categories: DataFrame, sellers: DataFrame
) -> DataFrame:
    src = raw.select(
        parse_id(F.col("id")).alias("id"),
        F.col("title_fa").cast("string").alias("title_fa"),
        _trimmed("Brand").alias("brand"),
        _trimmed("Category1").alias("c1"),
        _trimmed("Category2").alias("c2"),
        F.nullif(_trimmed("sub_category"), F.lit("")).alias("sub"),
        _trimmed("Seller").alias("seller"),
        parse_whole(F.col("Price")).alias("price"),
        parse_whole(F.col("min_price_last_month")).alias("min_price_last_month"),
        F.coalesce(parse_bool(F.col("Is_Fake")), F.lit(False)).alias("is_fake"),
        F.col("Rate").try_cast("double").alias("rate"),
        parse_whole(F.col("Rate_cnt")).alias("rate_cnt"),
    ).filter(F.col("id").isNotNull())
    return (
        src.join(brands, src["brand"] == brands["name"], "left")
        .join(
            categories,
            (src["c1"] == categories["category1"])
            & (src["c2"] == categories["category2"])
            & src["sub"].eqNullSafe(categories["sub_category"]),
            "left",
        )
        .join(sellers, src["seller"] == sellers["seller_title"], "left")
        .select(
            "id", "title_fa", "brand_id", "category_id", "seller_id", "price",
            "min_price_last_month", "is_fake", "rate", "rate_cnt",
        )
    )


def load_products(
    raw: DataFrame, brands: DataFrame, categories: DataFrame, sellers: DataFrame,
    products: DataFrame | None = None,
) -> DataFrame:
    """A null Category2 never finds its category; sub_category is matched null-safe."""
    return upsert(product_rows(raw, brands, categories, sellers), products, ["id"])


LOG_KEY = ["session_id", "product_id", "event_type", "timestamp"]


def log_rows(
    raw: DataFrame, sessions: DataFrame, products: DataFrame, require_complete: bool = True
) -> DataFrame:
    new = raw.select(
        _trimmed("session_id").alias("session_id"),
        parse_id(F.col("product_id")).alias("product_id"),
        F.col("event_type").cast("string").alias("event_type"),
        F.col("timestamp").try_cast("timestamp").alias("timestamp"),
    )
    needed = LOG_KEY if require_complete else ["session_id", "product_id"]
    return (
        new.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed]))
        .distinct()
        .join(sessions.select("session_id"), "session_id", "left_semi")
        .join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
        .select(*LOG_KEY)
    )


def load_behavior_logs(
    raw: DataFrame, sessions: DataFrame, products: DataFrame, logs: DataFrame | None = None,
    require_complete: bool = True,
) -> DataFrame:
    """Distinct events of known sessions and products; known events are ignored.

    ``require_complete=False`` keeps rows without type or time, as the second
    loader variant does.
    """
    return add_keys(log_rows(raw, sessions, products, require_complete), logs, LOG_KEY, "log_id")


def comment_rows(raw: DataFrame, products: DataFrame) -> DataFrame:
    new = (
        raw.select(
            parse_id(F.col("id")).alias("id"),
            parse_id(F.col("product_id")).alias("product_id"),
            parse_bool(F.col("is_buyer")).alias("is_buyer"),
            F.col("rate").try_cast("double").alias("rate"),
            F.col("recommendation_status").cast("string").alias("recommendation_status"),
            F.coalesce(parse_whole(F.col("likes")).try_cast("int"), F.lit(0)).alias("likes"),
            F.coalesce(parse_whole(F.col("dislikes")).try_cast("int"), F.lit(0)).alias("dislikes"),
            F.col("raw_text_normalized").cast("string").alias("raw_text_normalized"),
            F.col("created_at").try_cast("timestamp").alias("created_at"),
        )
        .filter(F.col("id").isNotNull() & F.col("product_id").isNotNull())
        .join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    )
    columns = [
        "id", "product_id", "is_buyer", "rate", "recommendation_status", "likes", "dislikes",
        "raw_text_normalized", "created_at",
    ]
    return new.select(*columns)


def load_comments(
    raw: DataFrame, products: DataFrame, comments: DataFrame | None = None
) -> DataFrame:
    """W12."""
    return upsert(comment_rows(raw, products), comments, ["id"])


ASPECT_KEY = ["comment_id", "pos"]


def aspect_rows(raw: DataFrame, comments: DataFrame) -> DataFrame:
    def text(field: str) -> Column:
        return F.nullif(F.trim(F.col(f"a.{field}")), F.lit(""))

    key = F.col("comment_id")
    new = (
        raw.select(parse_id(F.col("id")).alias("comment_id"), "aspects_json")
        .filter(key.isNotNull() & (F.col("aspects_json") != "[]"))
        .join(comments.select(F.col("id").alias("comment_id")), "comment_id", "left_semi")
        .select("comment_id", F.posexplode(F.from_json("aspects_json", ASPECT_ITEM)).alias("pos", "a"))
        .select(
            "comment_id",
            "pos",
            text("term").alias("term"),
            text("sentiment").alias("sentiment"),
            *[F.col(f"a.{c}").alias(c) for c in ("negative_pct", "neutral_pct", "positive_pct")],
        )
    )
    return upsert(new, None, ASPECT_KEY)


def load_comment_aspects(
    raw: DataFrame, comments: DataFrame, aspects: DataFrame | None = None
) -> DataFrame:
    """One row per item of ``aspects_json``, keyed by comment and position."""
    return add_keys(aspect_rows(raw, comments), aspects, ASPECT_KEY, "aspect_id")


def check_embeddings(raw: DataFrame, dimension: int = EMBEDDING_DIMENSION) -> DataFrame:
    """Parsed id and a verdict per incoming vector."""
    key = F.col("id").cast("string")
    parsed = F.when(F.trim(key).rlike(r"^[+-]?\d+$"), F.trim(key).try_cast("bigint"))
    return raw.select(
        parsed.alias("id"),
        F.col("embedding").alias("embedded_comment"),
        F.when(parsed.isNull(), "invalid_id")
        .when(~is_valid(F.col("embedding"), dimension), "invalid_vector")
        .otherwise("valid")
        .alias("verdict"),
    )


def embedding_rows(raw: DataFrame, comments: DataFrame, dimension: int = EMBEDDING_DIMENSION) -> DataFrame:
    return (
        check_embeddings(raw, dimension)
        .filter(F.col("verdict") == "valid")
        .groupBy("id")
        .agg(F.min("embedded_comment").alias("embedded_comment"))
        .join(comments.select("id"), "id", "left_semi")
    )


def load_embeddings(
    raw: DataFrame, comments: DataFrame, existing: DataFrame | None = None,
    dimension: int = EMBEDDING_DIMENSION,
) -> DataFrame:
    """Valid vectors of known comments; the vector stored first stays."""
    return insert_ignore(embedding_rows(raw, comments, dimension), existing, ["id"])


def embedding_load_report(
    raw: DataFrame, comments: DataFrame, existing: DataFrame | None = None,
    dimension: int = EMBEDDING_DIMENSION,
) -> DataFrame:
    """Total, valid, invalid and inserted rows, one row."""
    checked = check_embeddings(raw, dimension).select("id", "verdict")
    fresh = (
        checked.filter(F.col("verdict") == "valid")
        .select("id")
        .distinct()
        .join(comments.select("id"), "id", "left_semi")
    )
    if existing is not None:
        fresh = fresh.join(existing.select("id"), "id", "left_anti")
    rows = checked.select("verdict").unionByName(fresh.select(F.lit("inserted").alias("verdict")))

    def count(verdict: str) -> Column:
        return F.count_if(F.col("verdict") == verdict)

    return rows.agg(
        (F.count(F.lit(1)) - count("inserted")).alias("total_rows"),
        count("valid").alias("valid_rows"),
        count("invalid_id").alias("invalid_id_rows"),
        count("invalid_vector").alias("invalid_vector_rows"),
        count("inserted").alias("inserted_rows"),
    )


# Columns, keys and references of the star schema (fixed values).
SCHEMAS = {
    "users": "user_id bigint",
    "cities": "city_id int, name string",
    "brands": "brand_id int, name string",
    "categories": "category_id bigint, category1 string, category2 string, sub_category string",
    "sellers": "seller_id int, seller_title string",
    "sessions": "session_id string, user_id bigint, city_id int",
    "products": "id bigint, title_fa string, brand_id int, category_id bigint, seller_id int, price bigint, "
    "min_price_last_month bigint, is_fake boolean, rate double, rate_cnt bigint",
    "user_behavior_logs": "log_id bigint, session_id string, product_id bigint, event_type string, timestamp timestamp",
    "comments": "id bigint, product_id bigint, is_buyer boolean, rate double, recommendation_status string, likes int, "
    "dislikes int, raw_text_normalized string, created_at timestamp",
    "comment_aspects": "aspect_id bigint, comment_id bigint, pos int, term string, sentiment string, negative_pct double, "
    "neutral_pct double, positive_pct double",
    "comments_embedding": "id bigint, embedded_comment array<double>",
}
NATURAL_KEYS = {
    "users": ["user_id"], "cities": ["name"], "brands": ["name"], "categories": ["category1", "category2", "sub_category"],
    "sellers": ["seller_title"], "sessions": ["session_id"], "products": ["id"], "user_behavior_logs": LOG_KEY,
    "comments": ["id"], "comment_aspects": ASPECT_KEY, "comments_embedding": ["id"],
}
UNIQUE_KEYS = {
    "users": ["user_id"], "cities": ["name"], "sessions": ["session_id"], "brands": ["name"],
    "categories": ["category1", "category2", "sub_category"], "sellers": ["seller_title"],
    "products": ["id"], "user_behavior_logs": LOG_KEY, "comments": ["id"],
    "comments_embedding": ["id"], "comment_aspects": ["aspect_id"],
}
NOT_NULL = {
    "cities": ["name"], "brands": ["name"], "categories": ["category1"],
    "sellers": ["seller_title"], "products": ["title_fa"], "comment_aspects": ["comment_id"],
}
FOREIGN_KEYS = [
    ("sessions", "user_id", "users", "user_id"),
    ("sessions", "city_id", "cities", "city_id"),
    ("products", "brand_id", "brands", "brand_id"),
    ("products", "category_id", "categories", "category_id"),
    ("products", "seller_id", "sellers", "seller_id"),
    ("user_behavior_logs", "session_id", "sessions", "session_id"),
    ("user_behavior_logs", "product_id", "products", "id"),
    ("comments", "product_id", "products", "id"),
    ("comments_embedding", "id", "comments", "id"),
    ("comment_aspects", "comment_id", "comments", "id"),
]


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations per rule: (rule, table, column, violations)."""
    def result(df: DataFrame, rule: str, table: str, column: str) -> DataFrame:
        return df.select(
            F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"), F.col("n").cast("long").alias("violations"),
        )

    out = []
    for name, keys in UNIQUE_KEYS.items():
        if name in tables:
            groups = tables[name].groupBy(*keys).count()
            extra = groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
            out.append(result(extra, "unique", name, ",".join(keys)))
    for name, columns in NOT_NULL.items():
        for c in columns if name in tables else []:
            nulls = tables[name].agg(F.count_if(F.col(c).isNull()).alias("n"))
            out.append(result(nulls, "not_null", name, c))
    for child, column, parent, key in FOREIGN_KEYS:
        if child in tables and parent in tables:
            # keys are counted first: a hot key meets its parent as one row
            values = (
                tables[child].filter(F.col(column).isNotNull())
                .groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("_rows"))
            )
            known = tables[parent].select(F.col(key).alias("_k"))
            orphans = values.join(known, "_k", "left_anti").agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"))
            out.append(result(orphans, "foreign_key", child, column))
    return reduce(DataFrame.unionByName, out)
