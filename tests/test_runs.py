"""Sources, sinks, incremental runs, whole jobs and the driver contract."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as driver
from souqlytics.operators import quality
from souqlytics.plans import jobs
from souqlytics.registry import DATASETS, find_dataset
from souqlytics.session import shared_dir
from souqlytics.sources import files, tables
from souqlytics.functions.literals import columns_to_json
from souqlytics.streaming.incremental import run_new_batches, run_new_files

PRODUCTS = """id,title_fa,Category1,Category2,sub_category,Brand,Seller,Price,min_price_last_month,Rate,Rate_cnt,Is_Fake
10,"گوشی, ""خوب""
دو خط",c1,d1,,B1,S1,"1,200",900,80,3,دارد
11,t,c1,,s,B2,S1,,nan,,,ندارد
10,copy,c1,d1,,B1,S1,7,7,7,7,0
"""
LOGS = """user_id,product_id,session_id,event_type,timestamp,city
1,10,s1,view,2024-01-05 10:00:00,Tehran
1,10,s1,purchase,2024-01-05 10:05:00,Tehran
1,10,s1,purchase,2024-01-05 10:05:00,Tehran
2,11,s2,add_to_cart,2024-01-06 20:00:00,
"""
COMMENTS = """id,product_id,title,body,advantages,disadvantages,rate,likes,dislikes,created_at,is_buyer,recommendation_status,seller_title,seller_code,true_to_size_rate
1,10,خوب,<b>عاللللی</b> http://x.y,"['خوب']",,5,3,0,12 فروردین 1402,true,yes,S1,1,
2,99,بد,متن,,,1,,,abc,,no,S1,1,
"""


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, body in (("products", PRODUCTS), ("user_behavior_logs", LOGS), ("comments", COMMENTS), ("other", "a\n1\n")):
        (folder / f"{name}.csv").write_text(body, encoding="utf-8")
    return str(folder)


def test_registry_and_scan_rules(spark, raw_dir):
    assert find_dataset("other") is None and set(DATASETS) == {"comments", "products", "user_behavior_logs"}
    assert files.read_csv(spark, f"{raw_dir}/other.csv") is None
    assert files.read_csv(spark, f"{raw_dir}/products.xlsx") is None
    df = files.read_csv(spark, f"{raw_dir}/products.csv")
    assert df.count() == 3 and df.first().title_fa == 'گوشی, "خوب"\nدو خط'
    with pytest.raises(AnalysisException):
        files.read_parquet(spark, f"{raw_dir}/missing")


def test_clean_then_features_then_warehouse(spark, raw_dir, tmp_path):
    cleaned, out = str(tmp_path / "clean"), str(tmp_path / "out")
    reports = jobs.clean_job(spark, raw_dir, cleaned)
    assert {n: (r.first().rows_in, r.first().rows_out) for n, r in reports.items()} == {
        "products": (3, 2), "user_behavior_logs": (4, 3), "comments": (2, 2)
    }
    comments = spark.read.parquet(f"{cleaned}/comments_parts")
    assert comments.filter("id = 1").first().raw_text_normalized == "خوب عالی خوب"
    stored = jobs.feature_job(spark, cleaned, out)
    assert set(stored) == set(tables.FEATURE_TABLES)
    wide = spark.read.parquet(f"{out}/feature_table.parquet")
    assert wide.count() == 3 and wide.filter("user_id = 1").first().user_total_spend == 1200.0
    assert spark.read.parquet(f"{out}/kpi_funnel.parquet").first().view_to_cart_rate == 1.0

    t = jobs.load_warehouse(
        spark.read.parquet(f"{cleaned}/products_parts"), spark.read.parquet(f"{cleaned}/user_behavior_logs_parts"),
        comments.withColumn("aspects_json", F.lit('[{"term":"قیمت","sentiment":"positive","positive_pct":90.0}]')),
    )
    assert {n: df.count() for n, df in t.items()} == {
        "users": 2, "cities": 1, "brands": 2, "categories": 2, "sellers": 1, "sessions": 2, "products": 2,
        "user_behavior_logs": 3, "comments": 1, "comment_aspects": 1,
    }
    again = jobs.load_warehouse(
        spark.read.parquet(f"{cleaned}/products_parts"), spark.read.parquet(f"{cleaned}/user_behavior_logs_parts"),
        comments.withColumn("aspects_json", F.lit("[]")), t,
    )
    assert {n: df.count() for n, df in again.items()} == {n: df.count() for n, df in t.items()}
    marts = jobs.build_marts(t, str(tmp_path / "marts"))
    assert len(marts) == 14 and marts["feature_user"].count() == 2
    kpis = jobs.build_views(t, marts)
    assert spark.table("user_segments").count() == 2 and kpis["global_funnel"].first().total_purchases == 1
    assert quality.scan(t).filter("check = 'duplicates' and count > 0").count() == 0


def test_resume_skips_finished_files(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.range(3).write.parquet(source)
    double = lambda df: df.select((F.col("id") * 2).alias("id"))
    schema = spark.range(1).schema
    for expect in (3, 3):
        run_new_files(spark, source, schema, double, target, checkpoint)
        assert spark.read.parquet(target).count() == expect
    spark.range(10, 12).write.mode("append").parquet(source)
    run_new_files(spark, source, schema, double, target, checkpoint)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 2, 4, 20, 22]


def test_batches_may_group(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    count = lambda df: df.groupBy("k").count()
    rows = spark.range(6).select((F.col("id") % 2).alias("k")).coalesce(1)
    for expect in ([(0, 3), (1, 3)], [(0, 3), (0, 3), (1, 3), (1, 3)]):
        rows.write.mode("append").parquet(source)
        for _ in range(2):
            run_new_batches(spark, source, rows.schema, count, target, checkpoint)
        got = spark.read.parquet(target).select("k", "count").collect()
        assert sorted(tuple(r) for r in got) == expect


def test_batches_of_two_sources_and_broken_runs(spark, tmp_path):
    target = str(tmp_path / "out")
    calls = []

    def shaky(df):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("stopped")
        return df.groupBy("k").count()

    for name, n in (("a", 4), ("b", 6)):
        spark.range(n).select(F.concat(F.lit(name), F.col("id") % 2).alias("k")).coalesce(1).write.parquet(str(tmp_path / name))
    for name in "aba":
        run = lambda name=name, check=None: run_new_batches(
            spark, str(tmp_path / name), spark.read.parquet(str(tmp_path / name)).schema, shaky, target, str(tmp_path / (check or f"check_{name}")))
        if not calls:
            with pytest.raises(Exception, match="stopped"):
                run()
        run()
    want = [("a0", 2), ("a1", 2), ("b0", 3), ("b1", 3)]
    assert sorted((r["k"], r["count"]) for r in spark.read.parquet(target).collect()) == want
    with pytest.raises(ValueError, match="another checkpoint"):
        run(check="lost")
    assert sorted((r["k"], r["count"]) for r in spark.read.parquet(target).collect()) == want


def test_columns_to_json(spark):
    df = spark.createDataFrame([("['a']", ["x", "y"])], "advantages string, disadvantages array<string>")
    assert tuple(columns_to_json(df).first()) == ('["a"]', '["x","y"]')


def test_csv_columns_in_any_order(spark, tmp_path):
    (tmp_path / "products.csv").write_text("title_fa,id,more\nt,1,z\n", encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "products.csv"))
    assert df.first().asDict() == {"title_fa": "t", "id": "1", "more": "z"}


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_driver_contract(spark):
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert driver.entry(spark).count() > 0
