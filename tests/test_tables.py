"""Operators on small tables: cleaning, ranking, loads, marts, sentiment, quality."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from souqlytics.operators import (
    behaviour, cleaning, explore, kpi, marts, neighbours, quality, sentiment, views, warehouse,
)
from souqlytics.operators.ranking import exact_medians, number_rows, running_total

LOG = "log_id long, user_id long, session_id string, product_id long, event_type string, timestamp timestamp, city string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def log(spark):
    t = lambda d, h: datetime(2024, 1, d, h)
    data = [
        # 2024-01-04 is a Thursday, 05 a Friday, 06 a Saturday
        (1, 1, "s1", 10, "view", t(4, 0), "A"), (2, 1, "s1", 10, "add_to_cart", t(4, 6), "A"),
        (3, 1, "s1", 10, "purchase", t(4, 12), "A"), (4, 2, "s1", 11, "view", t(5, 18), "A"),
        (5, 1, "s2", 11, "view", t(6, 23), None), (6, 1, "s2", 11, "purchase", t(6, 23), None),
        (7, 3, "s3", 12, None, t(7, 11), " "), (8, None, "s4", 10, "remove_from_cart", t(7, 5), "B"),
        (9, 2, "s5", 11, "signup", t(7, 17), "B"), (10, 2, "s5", 99, "purchase", t(7, 17), "B"),
    ]
    return spark.createDataFrame(data, LOG)


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(
        [(10, "p10", "X", "c1", 100, 150), (11, "p11", "Y", "c1", None, 80), (12, "p12", None, "c2", 50, 0)],
        "id long, title_fa string, Brand string, Category1 string, Price long, min_price_last_month long",
    )


def test_keep_first_and_null_keys(spark):
    df = spark.createDataFrame(
        [("7", "b", 2), ("7", "a", 1), (None, "z", 0), ("8", "c", 3)], "id string, v string, n long"
    )
    assert rows(cleaning.keep_first(df, "id", "n"), "id", "v") == [("7", "a"), ("8", "c")]


def test_clean_whole_table(spark):
    df = spark.createDataFrame(
        [
            (" 7 ", " a ", "nan", "1,200", "دارد", 0), ("7", "late copy", "x", "5", "0", 1),
            ("8.0", "None", "y", "", "maybe", 2), (None, "gone", "y", "1", "1", 3), ("9", "b", "y", "100", "no", 4),
        ],
        "id string, title_fa string, Brand string, Price string, Is_Fake string, n long",
    ).withColumn("Rate", F.lit(None).cast("string"))
    out = cleaning.clean(df, "products", "n")
    assert rows(out, "id", "title_fa", "Brand", "Price", "Rate", "Is_Fake") == [
        (7, "a", None, 1200.0, 0.0, True), (8, None, "y", 650.0, 0.0, None), (9, "b", "y", 100.0, 0.0, False),
    ]
    with pytest.raises(ValueError):
        cleaning.clean(df, "products")
    assert cleaning.clean(df, "unknown", "n").count() == 5
    report = cleaning.cleaning_report(df.drop("n"), out).first()
    assert (report.rows_in, report.rows_out, report.rows_removed) == (5, 3, 2)


def test_numbers_are_dense_with_many_copies(spark):
    df = spark.range(3000).select((F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 11)).alias("k"))
    out = [tuple(r) for r in number_rows(df, [F.col("k")], "n", unique=False).collect()]
    assert sorted(n for _, n in out) == list(range(1, 3001))
    assert [k for k, _ in sorted(out, key=lambda r: r[1])] == sorted(k for k, _ in out)


def test_running_total_and_medians(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("w"))
    got = {r.id: r.t for r in running_total(df, [F.col("id")], "w", "t").collect()}
    assert got == dict(enumerate(np.cumsum(np.arange(500) % 3)))
    values = [float(v) for v in np.random.default_rng(1).integers(0, 40, 301)]
    odd = spark.createDataFrame([(v, v if i % 2 else None) for i, v in enumerate(values)], "a double, b double")
    med = {r.name: r.median for r in exact_medians(odd, ["a", "b"]).collect()}
    assert med == {"a": np.median(values), "b": np.median(values[1::2])}


def test_two_weekends_stay_apart(log):
    fractions = dict(rows(behaviour.add_time_parts(log), "log_id", "is_weekend"))
    warehouse_rule = dict(rows(marts.feature_behavior(log), "log_id", "is_weekend"))
    assert (fractions[1], fractions[4], fractions[5]) == (0, 1, 1)
    assert (warehouse_rule[1], warehouse_rule[4], warehouse_rule[5]) == (1, 1, 0)


def test_user_features(log, products):
    enriched = behaviour.enrich_log(log)
    assert rows(behaviour.session_depth(enriched), "session_id", "session_depth", "user_id") == [
        ("s1", 4, 1), ("s2", 2, 1), ("s3", 0, 3), ("s4", 1, None), ("s5", 2, 2)
    ]
    out = behaviour.user_features(enriched, products)
    assert rows(out, "user_id", "total_sessions", "total_spend", "aov", "brand_diversity") == [
        (1, 2, 100.0, 100.0, 2), (2, 1, 0.0, 0.0, 0), (3, 1, 0.0, 0.0, 0)
    ]
    assert rows(behaviour.city_totals(enriched), "city", "is_view") == [(" ", 0), ("A", 2), ("B", 0)]


def test_price_drop_keeps_unknown(products):
    master = behaviour.product_master(products)
    got = dict(rows(master, "id", "price_drop_ratio"))
    assert got[11] is None and got[12] == 0.0 and got[10] == pytest.approx(0.5)


def test_feature_table_needs_the_log(log, products):
    with pytest.raises(ValueError):
        behaviour.feature_table({})
    enriched = behaviour.enrich_log(log)
    product = behaviour.product_totals(enriched)
    out = behaviour.feature_table({
        "user_behavior_enriched": enriched, "user_features": behaviour.user_features(enriched, products),
        "product_behavior": product, "product_master": behaviour.product_master(products, product),
    })
    assert out.count() == log.count() and len(set(out.columns)) == len(out.columns)
    assert {"user_is_view", "product_is_view", "conversion_rate", "Brand", "id"} <= set(out.columns)
    assert rows(out.filter("log_id in (1, 10)"), "log_id", "id", "product_is_purchase") == [(1, 10, 1), (10, None, 1)]


def test_kpis(log, products):
    enriched = behaviour.enrich_log(log)
    funnel = kpi.funnel(enriched).first()
    assert funnel.view_to_cart_rate == pytest.approx(1 / 3) and funnel.cart_abandon_rate == -2.0
    assert tuple(kpi.retention(enriched).first()) == (2, 1)
    nothing = kpi.funnel(enriched.filter("false")).first()
    assert nothing.view_to_cart_rate == 0.0 and nothing.remove_to_purchase_ratio == 0.0
    assert rows(kpi.hourly_activity(enriched), "hour", "hourly_activity")[1] == (11, 0)
    assert set(kpi.all_kpis({"user_behavior_enriched": enriched})) == {"funnel", "retention", "time"}


def star(spark):
    cube_log = spark.createDataFrame(
        [(1, "s1", 10, "view"), (2, "s1", 10, "purchase"), (3, "s2", 11, "view"), (4, "s3", 10, "view")],
        "log_id long, session_id string, product_id long, event_type string",
    ).withColumn("timestamp", F.lit("2024-01-05 10:00:00").cast("timestamp"))
    sessions = spark.createDataFrame([("s1", 1, 1), ("s2", 1, 2), ("s3", None, None)], "session_id string, user_id long, city_id int")
    goods = spark.createDataFrame(
        [(10, 1, 5, None, 0), (11, 1, 6, 20, 30)],
        "id long, brand_id int, category_id long, price long, min_price_last_month long",
    )
    return marts.activity(marts.user_base(cube_log, sessions)), goods


def test_marts_keep_null_groups(spark):
    cube, goods = star(spark)
    assert rows(marts.feature_city(cube), "city_id", "total_users", "total_events") == [
        (1, 1, 2), (2, 1, 1), (None, 0, 1)
    ]
    users = marts.feature_user(cube, goods)
    assert rows(users, "user_id", "total_events", "total_spend", "purchase_frequency") == [
        (1, 3, 0.0, 1), (None, 1, 0.0, 0)
    ]
    drops = dict(rows(marts.feature_product(cube, goods), "product_id", "price_drop_ratio"))
    assert drops == {10: 0.0, 11: pytest.approx(1 / 3)}
    shares = rows(
        marts.feature_user_category(cube, goods), "category_id", "category_spend", "view_share", "spend_share"
    )
    assert shares == [(5, 0.0, 0.5, None), (6, 0.0, 0.5, None)]


def test_sentiment_fan_out_and_dedup(spark):
    goods = spark.createDataFrame([(10, 1), (11, 2)], "id long, brand_id int")
    comments = spark.createDataFrame(
        [(1, 10, 5.0, 3, 0), (2, 10, 1.0, 1, 1), (3, 99, 2.0, 9, 9)],
        "id long, product_id long, rate double, likes int, dislikes int",
    )
    aspects = spark.createDataFrame(
        [(1, 1, "a", "POSITIVE"), (2, 1, "b", "negative"), (3, 1, "a", None)],
        "aspect_id long, comment_id long, term string, sentiment string",
    )
    columns = ("brand_id", "total_comments", "total_aspect_mentions", "total_likes", "avg_comment_rating")
    assert rows(marts.feature_brand_sentiment(goods, comments, aspects), *columns) == [
        (1, 2, 3, 10, 4.0), (2, 0, 0, 0, None)
    ]
    assert rows(marts.feature_brand_sentiment(goods, comments, aspects, dedup=True), *columns) == [
        (1, 2, 3, 4, 3.0), (2, 0, 0, 0, None)
    ]


def test_segments_and_tags(spark):
    users = spark.createDataFrame(
        [(1, 1, 9, 6, 2e7), (2, 1, 9, 6, 5.0), (3, 1, 9, 3, 5.0), (4, 1, 9, 1, 5.0), (5, 1, 30, 0, 0.0), (6, 1, 0, 0, 0.0)],
        "user_id long, active_days long, total_views long, total_purchases long, total_spend double",
    )
    got = dict(rows(views.user_segments(users), "user_id", "user_segment"))
    assert [got[i] for i in range(1, 7)] == [
        views.VIP, views.LOW_ENGAGEMENT, views.RETURNING, views.ONE_TIME, views.WINDOW_SHOPPER, views.LOW_ENGAGEMENT
    ]
    aspects = spark.createDataFrame(
        [("x", 5, 5, 0), ("y", 6, 1, 5), ("z", 10, 8, 1), ("w", 8, 4, 4)],
        "term string, total_mentions long, positive_mentions long, negative_mentions long",
    )
    out = [(r.aspect_name, r.aspect_status) for r in views.aspect_diagnostics(aspects).collect()]
    assert out == [("z", views.STRENGTH), ("w", views.NEUTRAL), ("y", views.CRITICAL)]


def test_loads_are_repeatable(spark, log):
    raw = log.withColumn("timestamp", F.col("timestamp").cast("string"))
    cities = warehouse.load_cities(raw)
    assert rows(cities, "city_id", "name") == [(1, "A"), (2, "B")]
    assert rows(warehouse.load_cities(raw, cities), "city_id", "name") == rows(cities, "city_id", "name")
    more = raw.withColumn("city", F.lit("AA"))
    assert rows(warehouse.load_cities(more, cities), "city_id", "name") == [(1, "A"), (2, "B"), (3, "AA")]
    users = warehouse.load_users(raw)
    sessions = warehouse.load_sessions(raw, users, cities)
    assert rows(sessions, "session_id", "user_id", "city_id") == [
        ("s1", 1, 1), ("s2", 1, None), ("s3", 3, None), ("s5", 2, 2)
    ]
    goods = spark.createDataFrame([(10,), (11,), (12,)], "id long")
    logs = warehouse.load_behavior_logs(raw, sessions, goods)
    assert logs.count() == 7
    again = warehouse.load_behavior_logs(raw, sessions, goods, logs)
    assert rows(again, "log_id", *warehouse.LOG_KEY) == rows(logs, "log_id", *warehouse.LOG_KEY)
    loose = warehouse.load_behavior_logs(raw, sessions, goods, require_complete=False)
    assert loose.count() == 8


def test_product_load_keeps_the_null_category_quirk(spark):
    raw = spark.createDataFrame(
        [("1", "t", "B ", "c", "d", "", "S", "10", None, "yes", "4", "2"), ("2", "t", "B", "c", None, "x", None, "7", "5", None, None, None)],
        "id string, title_fa string, Brand string, Category1 string, Category2 string, sub_category string, "
        "Seller string, Price string, min_price_last_month string, Is_Fake string, Rate string, Rate_cnt string",
    )
    dims = warehouse.load_brands(raw), warehouse.load_categories(raw), warehouse.load_sellers(raw)
    first = warehouse.load_products(raw, *dims)
    found = dims[1].filter("category2 = 'd'").first().category_id
    assert sorted(r.category_id for r in dims[1].collect()) == [1, 2]
    assert rows(first, "id", "brand_id", "category_id", "seller_id", "price", "is_fake") == [
        (1, 1, found, 1, 10, True), (2, 1, None, None, 7, False)
    ]
    changed = raw.withColumn("Price", F.lit("99")).filter("id = '2'")
    assert rows(warehouse.load_products(changed, *dims, first), "id", "price") == [(1, 10), (2, 99)]


def test_aspect_load(spark):
    raw = spark.createDataFrame(
        [
            ("1", '[{"term": " قیمت ", "sentiment": "negative", "negative_pct": 90.0}, {"term": "", "sentiment": "x"}]'),
            ("2", "[]"), ("3", None), ("9", '[{"term": "a"}]'),
        ],
        "id string, aspects_json string",
    )
    known = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    out = warehouse.load_comment_aspects(raw, known)
    assert rows(out, "aspect_id", "comment_id", "pos", "term", "sentiment", "negative_pct") == [
        (1, 1, 0, "قیمت", "negative", 90.0), (2, 1, 1, None, "x", None)
    ]
    again = warehouse.load_comment_aspects(raw, known.union(spark.createDataFrame([(9,)], "id long")), out)
    assert rows(again, "aspect_id", "comment_id") == [(1, 1), (2, 1), (3, 9)]


def test_embedding_load(spark):
    raw = spark.createDataFrame(
        [("1", [1.0, 2.0]), ("x", [1.0, 2.0]), (None, [1.0, 2.0]), ("2", [1.0]), ("3", None), ("4", [None, 1.0]),
         ("5", [0.0, 0.0]), ("1", [0.5, 2.0])],
        "id string, embedding array<float>",
    )
    known = spark.createDataFrame([(1,), (2,)], "id long")
    assert rows(warehouse.load_embeddings(raw, known, dimension=2), "id", "embedded_comment") == [(1, [0.5, 2.0])]
    assert tuple(warehouse.embedding_load_report(raw, known, dimension=2).first()) == (8, 3, 2, 3, 1)


def test_sentiment_pivot_edges(spark):
    df = spark.createDataFrame(
        [(1, "positive", ["a", "b"]), (1, "negative", ["a"]), (1, None, ["c"]), (2, "odd", None), (None, "positive", [])],
        "product_id long, predicted_sentiment string, predicted_aspects array<string>",
    )
    assert rows(sentiment.sentiment_pivot(df, ["product_id"]), "product_id", "positive", "sentiment_score", "total_comments") == [
        (1, 50.0, 0.0, 2), (2, None, None, 0)
    ]
    assert rows(sentiment.product_kpi(df), "product_id", "top_aspect", "worst_aspect") == [(1, "a", "a"), (2, None, None)]
    assert rows(sentiment.aspect_rows(df), "predicted_aspects") == [("a",), ("a",), ("b",), ("c",)]


def test_predictions_bridge(spark):
    df = spark.createDataFrame(
        [(1, '[{"term":"a","negative_pct":50.0,"neutral_pct":50.0,"positive_pct":0.0}]'), (2, "[]"), (3, None)],
        "id long, aspects_json string",
    )
    out = sentiment.predictions(df)
    assert rows(out, "id", "predicted_sentiment", "predicted_aspects") == [(1, "negative", ["a"]), (2, None, []), (3, None, None)]


def test_quality(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "view"), (1, 1.0, "view"), (2, float("inf"), None), (3, -1.0, "odd")], "id long, rate double, event_type string"
    )
    assert quality.duplicate_rows(df).first()[0] == 1
    assert dict(rows(quality.infinity_counts(df), "column_name", "infinite_count")) == {"id": 0, "rate": 1}
    assert dict(rows(quality.rule_violations(df), "rule", "violations")) == {
        "comment_rate_range": 2, "unknown_event_type": 2
    }
    assert quality.rule_violations(df, ("negative_price",)).count() == 0
    assert rows(quality.null_overview(df), "column_name", "null_count", "null_pct")[0] == ("event_type", 1, 25.0)


def test_exploration(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in explore.correlations(df, ("a", "b", "c")).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] == pytest.approx(1.0)


def test_top_k_matches_brute_force_with_one_and_many_cells(spark):
    rng = np.random.default_rng(3)
    corpus, queries = rng.normal(size=(200, 8)), rng.normal(size=(6, 8))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "id long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit(queries) @ unit(corpus).T), axis=1)[:, :5]
    expect = sorted((i, int(b), r + 1) for i, ids in enumerate(best) for r, b in enumerate(ids))
    for cells in (1, 9):
        out = neighbours.top_k_cosine(c.repartition(3), q, 5, cells=cells)
        assert sorted(tuple(r) for r in out.select("query_id", "id", "rank").collect()) == expect


def test_lowest_tells_copies_apart(spark):
    """Quota selection against a sort, with one row a third of all."""
    from souqlytics.operators.ranking import lowest

    rows = [("a" if i % 3 else None, 7 if i % 2 else (i * 2654435761) % 2**40 - 2**39, i * 7919 % 100_003) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, h long, tie long")
    for quotas in ({"a": 250, None: 120}, {"a": 0, None: 1}, {"a": 600, None: 300}, {}):
        got = df.filter(lowest(df, F.col("g"), ["h", "tie"], quotas)).collect()
        want = [r for g, n in quotas.items() for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])[:n]]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
