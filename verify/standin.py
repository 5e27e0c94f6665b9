"""Shop tables derived from the driver tables.

Each is one SELECT in the common subset of Spark SQL and DuckDB SQL, so both sides of
a check start from the same input. Names in braces are the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# In order of dependency.
TABLES: dict[str, str] = {}

# ---- behaviour ----------------------------------------------------------------------

TABLES["shop_log"] = """
SELECT e.event_id AS log_id, e.user_id,
  CAST(e.user_id AS STRING) || '-' || CAST(CAST(e.ts AS DATE) AS STRING) AS session_id,
  CAST(substr(e.props, 7, length(e.props) - 7) AS BIGINT) AS product_id,
  CASE e.event_type WHEN 'click' THEN 'add_to_cart' WHEN 'error' THEN 'remove_from_cart'
    ELSE e.event_type END AS event_type,
  CAST(e.ts AS TIMESTAMP) AS timestamp,
  CASE WHEN n.n_nationkey = 7 THEN NULL ELSE n.n_name END AS city
FROM {events} e
LEFT JOIN {customer} c ON c.c_custkey = e.user_id
LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

TABLES["shop_session"] = """
SELECT DISTINCT l.session_id, l.user_id, n.n_nationkey AS city_id
FROM shop_log l LEFT JOIN {nation} n ON n.n_name = l.city
"""

# ---- catalogue ----------------------------------------------------------------------

TABLES["last_prices"] = """
SELECT l.l_partkey, CAST(floor(min(l.l_extendedprice / l.l_quantity)) AS BIGINT) AS lowest
FROM {lineitem} l
WHERE l.l_shipdate >= (SELECT max(l_shipdate) FROM {lineitem}) - INTERVAL '30' DAY
GROUP BY l.l_partkey
"""

TABLES["first_seller"] = """
SELECT l_partkey, min(l_suppkey) AS suppkey FROM {lineitem} GROUP BY l_partkey
"""

TABLES["catalogue"] = """
SELECT p.p_partkey AS id, p.p_name AS title_fa, p.p_brand AS Brand, p.p_type AS Category1,
  CASE WHEN p.p_size % 5 = 0 THEN NULL ELSE 'size ' || CAST(p.p_size % 5 AS STRING) END AS Category2,
  CASE WHEN p.p_partkey % 3 = 0 THEN NULL ELSE 'sub ' || CAST(p.p_partkey % 3 AS STRING) END
    AS sub_category,
  s.s_name AS Seller,
  CASE WHEN p.p_partkey % 11 = 5 THEN NULL ELSE CAST(floor(p.p_retailprice) AS BIGINT) END AS Price,
  lp.lowest AS min_price_last_month,
  CAST(p.p_partkey % 101 AS DOUBLE) AS Rate,
  CAST(p.p_partkey % 37 AS BIGINT) AS Rate_cnt
FROM {part} p
LEFT JOIN first_seller f ON f.l_partkey = p.p_partkey
LEFT JOIN {supplier} s ON s.s_suppkey = f.suppkey
LEFT JOIN last_prices lp ON lp.l_partkey = p.p_partkey
"""

TABLES["wh_product"] = """
SELECT id, title_fa, CAST(substr(Brand, 7) AS INT) AS brand_id,
  CAST(CASE Category1 WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
    WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS BIGINT) AS category_id,
  Price AS price, min_price_last_month
FROM catalogue
"""

TABLES["wh_brand"] = """
SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS brand_id, p_brand AS name FROM {part}
"""

# ---- comments and aspects -----------------------------------------------------------

TABLES["wh_comment"] = """
SELECT d.doc_id AS id, d.doc_id % 100 AS product_id,
  CAST(1 + l.quality * 3 + (1 - l.toxic) AS DOUBLE) AS rate,
  CAST(CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE d.n_chars % 17 END AS INT) AS likes,
  CAST(d.n_chars % 5 AS INT) AS dislikes, l.quality, l.toxic, d.n_chars, d.lang, d.source
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

_MOOD = """CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'positive'
    WHEN quality IS NOT NULL THEN 'neutral' WHEN n_chars % 3 = 0 THEN 'positive'
    WHEN n_chars % 3 = 1 THEN 'negative' ELSE NULL END"""

TABLES["wh_aspect"] = f"""
SELECT id * 2 AS aspect_id, id AS comment_id, source AS term, {_MOOD} AS sentiment,
  CAST(n_chars % 101 AS DOUBLE) AS negative_pct, CAST(n_chars % 53 AS DOUBLE) AS neutral_pct,
  CAST(n_chars % 67 AS DOUBLE) AS positive_pct
FROM wh_comment WHERE id % 8 <> 3
UNION ALL
SELECT id * 2 + 1, id, CASE WHEN n_chars % 13 = 0 THEN NULL ELSE lang END,
  CASE WHEN n_chars % 2 = 0 THEN 'NEUTRAL' ELSE 'positive' END,
  CAST(n_chars % 41 AS DOUBLE), CAST(n_chars % 43 AS DOUBLE), CAST(n_chars % 97 AS DOUBLE)
FROM wh_comment WHERE id % 4 <> 1 AND id % 8 <> 3
"""

# One row per comment with a predicted label; the aspects are two columns here and
# become an array on the Spark side.
TABLES["predicted"] = f"""
SELECT id, product_id, lower({_MOOD}) AS predicted_sentiment,
  CASE WHEN id % 8 <> 3 THEN source END AS aspect_1,
  CASE WHEN id % 8 <> 3 AND id % 4 <> 1 THEN lang END AS aspect_2
FROM wh_comment
"""

# ---- raw text tables ----------------------------------------------------------------

TABLES["raw_product"] = """
SELECT p_partkey * 2 AS ordinal,
  CASE p_partkey % 10 WHEN 3 THEN ' ' || CAST(p_partkey AS STRING) || ' '
    WHEN 4 THEN CAST(p_partkey AS STRING) || '.0' WHEN 9 THEN 'nan'
    ELSE CAST(p_partkey AS STRING) END AS id,
  ' ' || p_name || ' ' AS title_fa, p_type AS Category1,
  CASE WHEN p_size % 5 = 0 THEN 'None' ELSE 'size ' || CAST(p_size AS STRING) END AS Category2,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'sub' END AS sub_category, p_brand || ' ' AS Brand,
  CAST(NULL AS STRING) AS Seller,
  CASE p_partkey % 8 WHEN 0 THEN NULL
    WHEN 1 THEN CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) || ' تومان'
    WHEN 2 THEN '-' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING)
    WHEN 3 THEN translate(CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), '0123456789',
      '۰۱۲۳۴۵۶۷۸۹')
    WHEN 4 THEN 'nan' WHEN 5 THEN '1.2.3'
    ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) || '.5' END AS Price,
  CAST(NULL AS STRING) AS min_price_last_month,
  CAST(p_size AS STRING) || '%' AS Rate, CAST(p_partkey % 37 AS STRING) AS Rate_cnt,
  CASE p_partkey % 6 WHEN 0 THEN 'دارد' WHEN 1 THEN 'ندارد' WHEN 2 THEN 'Yes' WHEN 3 THEN '0'
    WHEN 4 THEN '1.0' ELSE 'maybe' END AS Is_Fake
FROM {part}
UNION ALL
SELECT p_partkey * 2 + 1, CAST(p_partkey AS STRING), 'copy', p_type, NULL, NULL, p_brand, NULL, '1',
  NULL, '2', '3', NULL
FROM {part} WHERE p_partkey % 7 = 0
"""

TABLES["raw_comment"] = """
SELECT doc_id, CAST(doc_id AS STRING) AS id,
  CASE doc_id % 8
    WHEN 0 THEN CAST(doc_id % 32 AS STRING) || ' ' || CASE (doc_id // 8) % 12 WHEN 0 THEN 'فروردین'
      WHEN 1 THEN 'اردیبهشت' WHEN 2 THEN 'خرداد' WHEN 3 THEN 'تیر' WHEN 4 THEN 'مرداد'
      WHEN 5 THEN 'شهریور' WHEN 6 THEN 'مهر' WHEN 7 THEN 'آبان' WHEN 8 THEN 'آذر' WHEN 9 THEN 'دی'
      WHEN 10 THEN 'بهمن' ELSE 'اسفند' END || ' ' || CAST(1370 + doc_id % 40 AS STRING)
    WHEN 1 THEN '30 اسفند ' || CAST(1390 + doc_id % 20 AS STRING)
    WHEN 2 THEN '2024-01-05 10:00:00'
    WHEN 3 THEN '2023-' || CAST(10 + doc_id % 5 AS STRING) || '-1' || CAST(doc_id % 10 AS STRING)
    WHEN 4 THEN 'abc' WHEN 5 THEN NULL
    WHEN 6 THEN '1402/5/7'
    ELSE '1399-12-30' END AS created_at
FROM {documents}
"""


def _for_spark(statement: str) -> str:
    """Integer division is the one operator the two dialects write differently."""
    return statement.replace("//", "DIV")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table on Spark."""
    if name in DRIVER_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    chain = ", ".join(f"{n} AS ({_for_spark(TABLES[n])})" for n in _needed(name))
    used = [t for t in DRIVER_TABLES if "{" + t + "}" in chain]
    return spark.sql(
        f"WITH {chain} SELECT * FROM {name}",
        **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used},
    )


def _needed(name: str) -> list[str]:
    """The table and everything it is built from, in order."""
    wanted = {name}
    for other in reversed(list(TABLES)):
        if other in wanted:
            wanted |= {n for n in TABLES if n != other and f" {n} " in f" {TABLES[other]} ".replace("\n", " ")}
    return [n for n in TABLES if n in wanted]


def duckdb_with(*names: str) -> str:
    """The WITH list of derived tables for the SQL side."""
    wanted: set[str] = set()
    for name in names:
        wanted |= set(_needed(name))
    chain = ",\n".join(f"{n} AS ({TABLES[n]})" for n in TABLES if n in wanted)
    for t in DRIVER_TABLES:
        chain = chain.replace("{" + t + "}", t)
    return chain
