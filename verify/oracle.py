"""SQL for DuckDB that gives the result of each registered query by another route."""

from __future__ import annotations

from verify.standin import duckdb_with

ORACLE: dict[str, str] = {}


def add(name: str, body: str, *tables: str, ctes: str = "") -> None:
    parts = [p for p in (duckdb_with(*tables) if tables else "", ctes.strip().strip(",")) if p]
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    ORACLE[name] = head + body.strip()


def big(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def dbl(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


def r6(e: str) -> str:
    return f"(floor(({e}) * 1e6 + 0.5) / 1e6)"


def _dec(e: str) -> str:
    return f"CAST(CAST(({e}) AS VARCHAR) AS DECIMAL(38,18))"


def half_up(e: str, n: int = 2) -> str:
    return f"CAST(round({_dec(e)}, {n}) AS DOUBLE)"


def half_even(e: str, n: int = 2) -> str:
    s = f"({_dec(e)} * {10 ** n})"
    f = f"floor({s})"
    up = f"CASE WHEN {s} - {f} > 0.5 OR ({s} - {f} = 0.5 AND CAST({f} AS BIGINT) % 2 <> 0) THEN 1 ELSE 0 END"
    return f"(CAST(CAST({f} AS BIGINT) + {up} AS DOUBLE) / {10 ** n})"


def share(a: str, b: str) -> str:
    return f"({dbl(a)} / nullif({dbl(b)}, 0))"


def pct2(a: str, b: str) -> str:
    return half_up(f"{share(a, b)} * 100")


# ---- sources ------------------------------------------------------------------------

RAW_COLUMNS = (
    "id", "title_fa", "Category1", "Category2", "sub_category", "Brand", "Seller", "Price",
    "min_price_last_month", "Rate", "Rate_cnt", "Is_Fake",
)
# An empty cell is a missing one.
add(
    "s01_csv_scan",
    "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in RAW_COLUMNS) + " FROM raw_product",
    "raw_product",
)
add(
    "s01_mixed_headers",
    """SELECT CAST(id AS VARCHAR) AS id, title_fa || ', "new"' || chr(10) || chr(10) || Brand AS title_fa, Brand || ' 5"' AS Brand,
      CASE WHEN id % 2 = 1 THEN Category1 END AS Category1 FROM catalogue""",
    "catalogue",
)
add(
    "b06_far_years",
    """SELECT o_orderkey, epoch_us(t) AS kept, CASE WHEN o_orderkey % 3 = 2 THEN epoch_us(t) END AS near FROM (
      SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN '1500' WHEN 1 THEN '2300' ELSE '1999' END
        || substr(CAST(o_orderdate AS VARCHAR), 5, 4) || '15' AS TIMESTAMP) AS t FROM orders)""",
)
add("s03_parquet_folder_scan", "SELECT * FROM customer")
add(
    "s04_schema_union_scan",
    """SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer
    UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer""",
)
add("s05_recursive_scan", "SELECT * FROM supplier UNION ALL SELECT * FROM supplier")
add("s06_pruned_scan", "SELECT doc_id, lang FROM documents")
add("s07_write_parts", "SELECT count(*) AS total_rows, true AS parts_fit FROM orders")
add(
    "s08_save_feature_tables",
    """SELECT 'user_features' AS table_name, count(DISTINCT user_id) AS row_count FROM shop_log
    UNION ALL SELECT 'product_behavior', count(DISTINCT product_id) FROM shop_log
    UNION ALL SELECT 'city_features', count(DISTINCT city) FROM shop_log
    UNION ALL SELECT 'user_behavior_enriched', count(*) FROM shop_log
    UNION ALL SELECT 'comment_features', count(DISTINCT product_id) FROM wh_comment
    UNION ALL SELECT 'product_master', count(*) FROM catalogue""",
    "shop_log", "wh_comment", "catalogue",
)
add("s10_json_lines_write", "SELECT doc_id, lang, text FROM documents")
add("s14_incremental_run", "SELECT event_id, user_id, upper(event_type) AS event_type FROM events")
add("s14_incremental_batches", "SELECT event_id % 2 AS odd, event_type, count(*) AS n FROM events GROUP BY ALL")

# ---- cleaning -----------------------------------------------------------------------

WS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NWS = WS.replace("[", "[^", 1)


def strip(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '^{WS}+', ''), '{WS}+$', '')"


def clean(e: str) -> str:
    return f"CASE WHEN {strip(e)} NOT IN ('nan', 'None', '') THEN {strip(e)} END"


CLEANED = "cleaned AS (SELECT ordinal, " + ", ".join(f"{clean(c)} AS {c}" for c in RAW_COLUMNS) + " FROM raw_product)"
FIRST = """first_rows AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM cleaned WHERE id IS NOT NULL)
  WHERE rn = 1)"""


def amount(e: str) -> str:
    return (
        f"TRY_CAST(regexp_replace(translate({e}, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'),"
        " '[^0-9.]', '', 'g') AS DOUBLE)"
    )


def as_id(e: str) -> str:
    whole = f"CASE WHEN {strip(e)} LIKE '%.%' THEN NULL ELSE TRY_CAST({strip(e)} AS BIGINT) END"
    d = f"TRY_CAST({strip(e)} AS DOUBLE)"
    return f"coalesce({whole}, CASE WHEN {d} = floor({d}) THEN TRY_CAST({d} AS BIGINT) END)"


def as_bool(e: str) -> str:
    return (
        f"CASE WHEN lower({strip(e)}) IN ('yes', 'true', '1', 'دارد') THEN true "
        f"WHEN lower({strip(e)}) IN ('no', 'false', '0', 'ندارد') THEN false END"
    )


add("b01_clean_strings", "SELECT * FROM cleaned", "raw_product", ctes=CLEANED)
add("b02_keep_first", "SELECT * FROM first_rows", "raw_product", ctes=f"{CLEANED}, {FIRST}")
add("b03_drop_copies", "SELECT DISTINCT user_id, product_id, event_type FROM shop_log", "shop_log")
add("b04_parse_amount", f"SELECT ordinal, {amount('Price')} AS amount FROM raw_product", "raw_product")


def filled(c: str, source: str) -> str:
    return f"coalesce({amount(c)}, (SELECT median({amount(c)}) FROM {source}), 0)"


add(
    "b05_fill_median",
    "SELECT ordinal, "
    + ", ".join(f"{filled(c, 'raw_product')} AS {c}" for c in ("Price", "Rate", "min_price_last_month"))
    + " FROM raw_product",
    "raw_product",
)
# Month names in order (fixed values).
_months = (
    "فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور",
    "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند",
)
_month_case = "CASE " + " ".join(
    f"WHEN contains(created_at, '{m}') THEN {i}" for i, m in enumerate(_months, 1)
) + " END"
_leaps = "[1, 5, 9, 13, 17, 22, 26, 30]"


def _leaps_before(y: str) -> str:
    return f"((({y}) - 1) // 33 * 8 + len(list_filter({_leaps}, lambda r: r <= (({y}) - 1) % 33)))"


add(
    "b06_dates",
    f"""SELECT doc_id, epoch_us(CASE
      WHEN created_at LIKE '20%' THEN TRY_CAST(created_at AS TIMESTAMP)
      WHEN m IS NOT NULL AND y IS NOT NULL AND d > 0 THEN
        CASE WHEN d <= CASE WHEN m <= 6 THEN 31 WHEN m <= 11 OR list_contains({_leaps}, y % 33) THEN 30
          ELSE 29 END
        THEN CAST(DATE '2024-03-20' + CAST(365 * (y - 1403) + {_leaps_before('y')} - {_leaps_before('1403')}
          + list_sum(list_slice([0, 31, 31, 31, 31, 31, 31, 30, 30, 30, 30, 30], 1, m)) + d - 1 AS INTEGER)
          AS TIMESTAMP) END
      END) AS created_us
    FROM parts""",
    "raw_comment",
    ctes=rf"""parts AS (SELECT doc_id, created_at, {_month_case} AS m,
      TRY_CAST(regexp_extract(created_at, '\b(1[34]\d\d)\b', 1) AS INTEGER) AS y,
      TRY_CAST(regexp_extract(regexp_replace(created_at, '\b1[34]\d\d\b', '', 'g'), '\b(\d\d?)\b', 1)
        AS INTEGER) AS d FROM raw_comment)""",
)
add("b07_ids", f"SELECT ordinal, {as_id('id')} AS id FROM raw_product", "raw_product")
add("b08_booleans", f"SELECT ordinal, {as_bool('Is_Fake')} AS is_fake FROM raw_product", "raw_product")

_plain = ("title_fa", "Category1", "Category2", "sub_category", "Brand", "Seller")
_numeric = ("Rate", "Rate_cnt", "Price", "min_price_last_month")
_final = (
    "final AS (SELECT " + as_id("id") + " AS id, " + ", ".join(_plain) + ", "
    + ", ".join(f"{filled(c, 'first_rows')} AS {c}" for c in _numeric)
    + f", {as_bool('Is_Fake')} AS Is_Fake FROM first_rows)"
)
add("b10_clean_products", "SELECT * FROM final", "raw_product", ctes=f"{CLEANED}, {FIRST}, {_final}")


def _nulls(columns) -> str:
    return " + ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in columns)


add(
    "b09_cleaning_report",
    f"""SELECT rows_in, rows_out, {big('nulls_in')} AS nulls_in, {big('nulls_out')} AS nulls_out,
      rows_in - rows_out AS rows_removed
    FROM (SELECT count(*) AS rows_in, {_nulls(RAW_COLUMNS)} AS nulls_in FROM raw_product),
      (SELECT count(*) AS rows_out, {_nulls(RAW_COLUMNS)} AS nulls_out FROM final)""",
    "raw_product", ctes=f"{CLEANED}, {FIRST}, {_final}",
)

# ---- text ---------------------------------------------------------------------------

FOLD = (
    "translate({e}, 'ۀكيئأإآؤ' || chr(8204) || chr(173) || chr(13) || chr(10), 'هکییاااو  ')"
)
_signs = "،؛؟«»" + "".join("\\" + c for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~") + "''"


def fold(e: str) -> str:
    return FOLD.replace("{e}", e)


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


def no_tags(e: str) -> str:
    return f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"


def no_urls(e: str) -> str:
    return f"regexp_replace({e}, 'http{NWS}+|www{NWS}+', ' ', 'g')"


def no_emails(e: str) -> str:
    return f"regexp_replace({e}, '{NWS}+@{NWS}+', ' ', 'g')"


def no_signs(e: str) -> str:
    return f"regexp_replace({e}, '[{_signs}]', ' ', 'g')"


def squeezed(source: str, column: str) -> str:
    """CTEs that shorten runs by looking at every character; result table ``squeezed``."""
    return f"""chars AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all({column}, '(?s).') AS cs FROM {source})),
    marked AS (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new
      FROM chars),
    grouped AS (SELECT doc_id, c, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
    runs AS (SELECT doc_id, g, min(c) AS c, count(*) AS n FROM grouped GROUP BY doc_id, g),
    squeezed AS (SELECT s.doc_id, coalesce(r.t, '') AS t FROM {source} s LEFT JOIN (
      SELECT doc_id, string_agg(CASE WHEN n >= 3 AND c <> chr(10) THEN c ELSE repeat(c, n) END, '' ORDER BY g)
        AS t FROM runs GROUP BY doc_id) r ON r.doc_id = s.doc_id)"""


NORM = (
    "pre AS (SELECT doc_id, " + no_signs(no_emails(no_urls(no_tags(fold("text"))))) + " AS t FROM documents),\n"
    + squeezed("pre", "t")
    + f",\nnorm AS (SELECT doc_id, {collapse('t')} AS text FROM squeezed)"
)
add(
    "t01_raw_text",
    f"SELECT doc_id, {collapse('lang || chr(32) || source || chr(32) || text')} AS raw_text FROM documents",
)
add("t02_fold_letters", f"SELECT doc_id, {fold('text')} AS text FROM documents")
add("t03_drop_tags", f"SELECT page_id, {no_tags('html')} AS text FROM pages")
add("t04_drop_urls", f"SELECT doc_id, {no_urls('text')} AS text FROM documents")
add("t05_drop_emails", f"SELECT doc_id, {no_emails('text')} AS text FROM documents")
add("t06_drop_punctuation", f"SELECT doc_id, {no_signs('text')} AS text FROM documents")
add("t07_squeeze_repeats", "SELECT doc_id, t AS text FROM squeezed", ctes=squeezed("documents", "text"))
add("t08_collapse_spaces", f"SELECT doc_id, {collapse('text')} AS text FROM documents")
add("t09_normalize", "SELECT doc_id, text FROM norm", ctes=NORM)
add(
    "t10_null_overview",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count,
        (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS null_pct FROM raw_comment"""
        for c in ("doc_id", "id", "created_at")
    ),
    "raw_comment",
)
add(
    "t11_words",
    f"""SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS INTEGER) AS n_words,
    replace(t, ' ', '|') AS words FROM (SELECT doc_id, {collapse('text')} AS t FROM documents)""",
)
add(
    "t12_literal_to_json",
    """SELECT p_partkey, CASE p_partkey % 5
      WHEN 0 THEN '["' || p_name || '", "' || p_type || '"]' WHEN 1 THEN '{"1": "' || p_name || '"}'
      WHEN 2 THEN '"متن ' || p_name || '"' WHEN 3 THEN CAST(p_size AS VARCHAR) END AS as_json FROM part""",
)
add(
    "t13_aspect_term",
    """SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '[aeiou]', '', 'g'), ' +', ' ', 'g')) || ' x'
      AS term FROM part""",
)
add("t14_text_column", "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations")

# ---- behaviour features -------------------------------------------------------------

ENRICHED = """enriched AS (SELECT *, CAST(hour(timestamp) AS INTEGER) AS hour,
    CAST(day(timestamp) AS INTEGER) AS day, CAST(month(timestamp) AS INTEGER) AS month,
    CAST(isodow(timestamp) - 1 AS INTEGER) AS weekday,
    CAST(isodow(timestamp) IN (5, 6) AS INTEGER) AS is_weekend,
    CAST(event_type = 'view' AS INTEGER) AS is_view,
    CAST(event_type = 'add_to_cart' AS INTEGER) AS is_cart,
    CAST(event_type = 'purchase' AS INTEGER) AS is_purchase,
    CAST(event_type = 'remove_from_cart' AS INTEGER) AS is_remove FROM shop_log)"""
_flags = ", ".join(f"{big(f'sum({c})')} AS {c}" for c in ("is_view", "is_cart", "is_purchase", "is_remove"))
USER_TOTALS = f"""user_totals AS (SELECT *, is_purchase / (is_view + 1) AS conversion_rate,
    is_remove / (is_cart + 1) AS remove_rate
    FROM (SELECT user_id, {_flags} FROM enriched WHERE user_id IS NOT NULL GROUP BY user_id))"""
PRODUCT_TOTALS = f"""product_totals AS (SELECT *, is_purchase / (is_view + 1) AS conversion_rate,
    (is_view - is_purchase) / (is_view + 1) AS drop_off_rate, is_remove / (is_cart + 1) AS remove_rate,
    (is_cart - is_purchase) / (is_cart + 1) AS cart_abandon_rate,
    is_remove / (is_cart + 1) AS remove_to_cart_ratio
    FROM (SELECT product_id, {_flags} FROM enriched WHERE product_id IS NOT NULL GROUP BY product_id))"""
DEPTH = """depth AS (SELECT session_id, count(event_type) AS session_depth,
    arg_min(user_id, timestamp) AS user_id FROM enriched GROUP BY session_id)"""
USER_SESSIONS = """user_sessions AS (SELECT user_id, count(*) AS total_sessions,
    avg(session_depth) AS avg_session_depth FROM depth GROUP BY user_id)"""
WEEKEND = """weekend AS (SELECT user_id, avg(is_weekend) AS weekend_activity_ratio FROM enriched GROUP BY user_id)"""
VALUE = """value AS (SELECT e.user_id, CAST(coalesce(sum(c.Price), 0) AS DOUBLE) AS total_spend,
    avg(c.Price) AS aov, count(DISTINCT c.Brand) AS brand_diversity,
    count(DISTINCT c.Category1) AS category_diversity
    FROM enriched e JOIN catalogue c ON c.id = e.product_id WHERE e.is_purchase = 1 GROUP BY e.user_id)"""
USERS = """users AS (SELECT t.*, s.total_sessions, s.avg_session_depth, w.weekend_activity_ratio,
    coalesce(v.total_spend, 0) AS total_spend, coalesce(v.aov, 0) AS aov,
    coalesce(v.brand_diversity, 0) AS brand_diversity, coalesce(v.category_diversity, 0) AS category_diversity
    FROM user_totals t LEFT JOIN user_sessions s USING (user_id) LEFT JOIN weekend w USING (user_id)
    LEFT JOIN value v USING (user_id))"""
COMMENT_FEATURES = f"""comment_features AS (SELECT product_id, avg(rate) AS avg_rate,
    nullif(count(rate), 0) AS comment_count,
    {r6('avg(coalesce(likes, 0) / (coalesce(dislikes, 0) + 1))')} AS avg_like_ratio,
    avg(rate) AS avg_sentiment FROM wh_comment GROUP BY product_id)"""
MASTER = """master AS (SELECT c.*, p.*, f.product_id AS product_id_comment, f.avg_rate, f.comment_count,
    f.avg_like_ratio, f.avg_sentiment,
    coalesce(f.comment_count / (p.is_view + 1e-5), 0) AS review_engagement_rate,
    CASE WHEN c.Price IS NOT NULL AND c.min_price_last_month IS NOT NULL THEN
      greatest((c.min_price_last_month - c.Price) / (c.Price + 1e-5), 0) END AS price_drop_ratio
    FROM catalogue c LEFT JOIN product_totals p ON p.product_id = c.id
    LEFT JOIN comment_features f ON f.product_id = c.id)"""
F_USERS = ",\n".join((ENRICHED, USER_TOTALS, DEPTH, USER_SESSIONS, WEEKEND, VALUE, USERS))
F_MASTER = ",\n".join((ENRICHED, PRODUCT_TOTALS, COMMENT_FEATURES, MASTER))


def from_log(name: str, body: str, ctes: str = ENRICHED) -> None:
    add(name, body, "shop_log", "catalogue", "wh_comment", ctes=ctes)


from_log("f01_time_parts", "SELECT log_id, hour, day, month, weekday, is_weekend FROM enriched")
from_log("f02_event_flags", "SELECT log_id, is_view, is_cart, is_purchase, is_remove FROM enriched")
from_log("f03_user_totals", "SELECT * FROM user_totals", f"{ENRICHED}, {USER_TOTALS}")
from_log("f04_product_totals", "SELECT * FROM product_totals", f"{ENRICHED}, {PRODUCT_TOTALS}")
from_log(
    "f05_city_totals",
    f"""SELECT city, {big('sum(is_view)')} AS is_view, {big('sum(is_purchase)')} AS is_purchase
    FROM enriched WHERE city IS NOT NULL GROUP BY city""",
)
from_log("f06_enriched_log", "SELECT * EXCLUDE (timestamp) FROM enriched")
from_log("f07_session_depth", "SELECT * FROM depth", f"{ENRICHED}, {DEPTH}")
from_log("f08_user_sessions", "SELECT * FROM user_sessions", f"{ENRICHED}, {DEPTH}, {USER_SESSIONS}")
from_log("f09_weekend_ratio", "SELECT * FROM weekend", f"{ENRICHED}, {WEEKEND}")
from_log("f10_purchase_value", "SELECT * FROM value", f"{ENRICHED}, {VALUE}")
from_log("f11_user_features", "SELECT * FROM users", F_USERS)
from_log("f12_comment_features", "SELECT * FROM comment_features", COMMENT_FEATURES)
from_log("f13_product_master", "SELECT * EXCLUDE (review_engagement_rate, price_drop_ratio) FROM master", F_MASTER)
from_log("f14_review_engagement", "SELECT id, review_engagement_rate FROM master", F_MASTER)
from_log("f15_price_drop", "SELECT id, price_drop_ratio FROM master", F_MASTER)
from_log(
    "f16_feature_table",
    """SELECT e.log_id, e.user_id, e.product_id, e.is_view, u.is_purchase AS user_is_purchase,
      u.total_spend AS user_total_spend, u.avg_session_depth AS user_avg_session_depth,
      p.drop_off_rate AS product_drop_off_rate, m.Brand, m.Price, m.conversion_rate, m.comment_count,
      m.avg_like_ratio, m.price_drop_ratio
    FROM enriched e LEFT JOIN users u ON u.user_id = e.user_id
    LEFT JOIN product_totals p ON p.product_id = e.product_id LEFT JOIN master m ON m.id = e.product_id""",
    ",\n".join((ENRICHED, USER_TOTALS, DEPTH, USER_SESSIONS, WEEKEND, VALUE, USERS, PRODUCT_TOTALS, COMMENT_FEATURES, MASTER)),
)
_sizes = (
    ("user_behavior_enriched", 16, "count(*)", "shop_log"),
    ("user_features", 14, "count(DISTINCT user_id)", "shop_log"),
    ("product_behavior", 10, "count(DISTINCT product_id)", "shop_log"),
    ("city_features", 3, "count(DISTINCT city)", "shop_log"),
    ("comment_features", 5, "count(DISTINCT product_id)", "wh_comment"),
    ("product_master", 28, "count(*)", "catalogue"),
)
from_log(
    "f17_feature_run",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, {rows} AS row_count, CAST({cols} AS INTEGER) AS column_count,
        false AS is_empty FROM {t}"""
        for n, cols, rows, t in _sizes
    ),
)

# ---- KPIs ---------------------------------------------------------------------------


def top(name: str, columns: str, measure: str, source: str = "master", key: str = "id") -> None:
    from_log(
        name,
        f"SELECT {columns} FROM {source} ORDER BY {measure} DESC NULLS LAST, {key} LIMIT 10",
        F_MASTER if source == "master" else F_USERS,
    )


top("k01_top_products", "id, title_fa, is_purchase", "is_purchase")
top(
    "k02_best_funnel_products",
    "id, is_cart / (is_view + 1e-9) AS view_to_cart, is_purchase / (is_cart + 1e-9) AS cart_to_purchase",
    "cart_to_purchase",
)
top("k03_top_revenue_products", "id, Price, is_purchase, Price * is_purchase AS revenue", "revenue")
top("k04_most_removed_products", "id, is_remove", "is_remove")
top("k05_worst_cart_products", "id, cart_abandon_rate", "cart_abandon_rate")
top("k06_high_remove_rate_products", "id, remove_rate", "remove_rate")
from_log(
    "k07_funnel",
    """SELECT coalesce(c / nullif(v, 0), 0) AS view_to_cart_rate, coalesce(p / nullif(c, 0), 0) AS cart_to_purchase_rate,
      coalesce(p / nullif(v, 0), 0) AS overall_conversion, coalesce((c - p) / nullif(c, 0), 0) AS cart_abandon_rate,
      coalesce(r / nullif(c, 0), 0) AS remove_rate, r / (p + 1) AS remove_to_purchase_ratio
    FROM (SELECT count(*) FILTER (WHERE event_type = 'view') AS v,
      count(*) FILTER (WHERE event_type = 'add_to_cart') AS c,
      count(*) FILTER (WHERE event_type = 'purchase') AS p,
      count(*) FILTER (WHERE event_type = 'remove_from_cart') AS r FROM shop_log)""",
)
from_log("k08_heavy_users", "SELECT user_id, is_purchase FROM users WHERE is_purchase > 10", F_USERS)
from_log("k09_low_engagement_users", "SELECT user_id, is_view FROM users WHERE is_view < 5", F_USERS)
top("k10_high_conversion_users", "user_id, conversion_rate", "conversion_rate", "users", "user_id")
from_log("k11_high_remove_users", "SELECT user_id, remove_rate FROM users WHERE remove_rate > 0.5", F_USERS)
from_log(
    "k12_retention",
    """SELECT count(*) FILTER (WHERE n > 1) AS returning_users, count(*) FILTER (WHERE n = 1) AS one_time_users
    FROM (SELECT user_id, count(DISTINCT timestamp) AS n FROM shop_log GROUP BY user_id)""",
)
from_log(
    "k13_top_categories",
    f"""SELECT Category1, {big('coalesce(sum(is_purchase), 0)')} AS is_purchase FROM master
    GROUP BY Category1 ORDER BY 2 DESC, 1""",
    F_MASTER,
)
from_log("k14_hourly_activity", "SELECT hour, count(event_type) AS hourly_activity FROM enriched GROUP BY hour")
ORACLE["s09_save_kpis"] = ORACLE["k14_hourly_activity"]
from_log(
    "k15_purchase_by_hour",
    "SELECT hour, count(*) AS purchase_by_hour FROM enriched WHERE event_type = 'purchase' GROUP BY hour",
)
from_log("k16_daily_trend", "SELECT day, count(event_type) AS daily_trend FROM enriched GROUP BY day")
_kpi_rows = {
    **{
        f"product.{n}": "SELECT least(10, count(*)) FROM master"
        for n in (
            "top_products", "best_funnel_products", "most_removed_products", "worst_cart_products",
            "high_remove_rate_products", "top_revenue_products",
        )
    },
    "category.top_categories": "SELECT count(DISTINCT Category1) FROM master",
    "user_segment.heavy_users": "SELECT count(*) FROM users WHERE is_purchase > 10",
    "user_segment.low_engagement_users": "SELECT count(*) FROM users WHERE is_view < 5",
    "user_segment.high_conversion_users": "SELECT least(10, count(*)) FROM users",
    "user_segment.high_remove_users": "SELECT count(*) FROM users WHERE remove_rate > 0.5",
    "funnel": "SELECT 1", "retention": "SELECT 1",
    "time.hourly_activity": "SELECT count(DISTINCT hour) FROM enriched",
    "time.purchase_by_hour": "SELECT count(DISTINCT hour) FROM enriched WHERE is_purchase = 1",
    "time.daily_trend": "SELECT count(DISTINCT day) FROM enriched",
}
from_log(
    "k17_all_kpis",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, {big(f'({q})')} AS row_count" for n, q in _kpi_rows.items()),
    ",\n".join((F_USERS, PRODUCT_TOTALS, COMMENT_FEATURES, MASTER)),
)

# ---- warehouse ----------------------------------------------------------------------



def by_hash(*keys: str) -> str:
    """The order generated keys are given in: bucket of the key's hash, then the key."""
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), '\\N')" for k in keys) + ")"
    return f"substr(md5({text}), 1, 3), " + ", ".join(f"{k} NULLS FIRST" for k in keys)


CITIES = f"""cities AS (SELECT CAST(row_number() OVER (ORDER BY {by_hash('name')}) AS INTEGER) AS city_id, name
    FROM (SELECT DISTINCT city AS name FROM shop_log WHERE city IS NOT NULL))"""
BRANDS = f"""brands AS (SELECT CAST(row_number() OVER (ORDER BY {by_hash('name')}) AS INTEGER) AS brand_id, name
    FROM (SELECT DISTINCT Brand AS name FROM catalogue WHERE Brand IS NOT NULL))"""
SELLERS = f"""sellers AS (SELECT CAST(row_number() OVER (ORDER BY {by_hash('seller_title')}) AS INTEGER) AS seller_id, seller_title
    FROM (SELECT DISTINCT Seller AS seller_title FROM catalogue WHERE Seller IS NOT NULL))"""
CATEGORIES = f"""categories AS (SELECT row_number() OVER (ORDER BY {by_hash('category1', 'category2', 'sub_category')}) AS category_id, category1, category2, sub_category
    FROM (SELECT DISTINCT Category1 AS category1, Category2 AS category2, sub_category FROM catalogue))"""
DIMS = ",\n".join((CITIES, BRANDS, SELLERS, CATEGORIES))


def from_raw(name: str, body: str, ctes: str = "") -> None:
    add(
        name, body, "shop_log", "shop_session", "catalogue", "wh_comment", "wh_product", "wh_aspect",
        "wh_brand", ctes=f"{DIMS}{', ' if ctes else ''}{ctes}",
    )


from_raw("w01_users", "SELECT DISTINCT user_id FROM shop_log WHERE user_id IS NOT NULL")
from_raw(
    "w02_new_keys_continue",
    f"""SELECT brand_id, name FROM old UNION ALL
    SELECT CAST(row_number() OVER (ORDER BY {by_hash('name')}) + (SELECT max(brand_id) FROM old) AS INTEGER), name
    FROM (SELECT DISTINCT Brand || ' ' || Category1 AS name FROM catalogue)""",
    f"""old AS (SELECT CAST(row_number() OVER (ORDER BY {by_hash('name')}) AS INTEGER) AS brand_id, name
    FROM (SELECT DISTINCT Brand AS name FROM catalogue WHERE Category1 = 'ECONOMY'))""",
)
for _n in ("w03_insert_ignore", "w04_upsert"):
    add(
        _n,
        """SELECT c_nationkey, c_mktsegment,
      CASE WHEN c_nationkey > 9 THEN min(c_acctbal) ELSE max(c_acctbal) END AS c_acctbal
    FROM customer GROUP BY c_nationkey, c_mktsegment""",
    )
from_raw("w05_cities", "SELECT * FROM cities")
from_raw("w06_brands", "SELECT * FROM brands")
from_raw("w07_categories", "SELECT * FROM categories")
from_raw("w08_sellers", "SELECT * FROM sellers")
from_raw(
    "w09_sessions",
    """SELECT session_id, min(user_id) AS user_id, min(city_id) AS city_id
    FROM shop_log l LEFT JOIN cities c ON c.name = l.city GROUP BY session_id""",
)
from_raw(
    "w10_products",
    """SELECT p.id, p.title_fa, b.brand_id, c.category_id, s.seller_id, p.Price AS price,
      p.min_price_last_month, false AS is_fake, p.Rate AS rate, p.Rate_cnt AS rate_cnt
    FROM catalogue p LEFT JOIN brands b ON b.name = p.Brand
    LEFT JOIN categories c ON c.category1 = p.Category1 AND c.category2 = p.Category2
      AND c.sub_category IS NOT DISTINCT FROM p.sub_category
    LEFT JOIN sellers s ON s.seller_title = p.Seller""",
)
from_raw(
    "w11_behavior_logs",
    f"""SELECT row_number() OVER (ORDER BY {by_hash('session_id', 'product_id', 'event_type', 'timestamp')}) AS log_id, *
    FROM (SELECT DISTINCT session_id, product_id, event_type, epoch_us(timestamp) AS timestamp FROM shop_log l
      WHERE product_id IN (SELECT id FROM wh_product))""",
)
from_raw(
    "w12_comments",
    """SELECT id, product_id, true AS is_buyer, rate, lang AS recommendation_status, coalesce(likes, 0) AS likes,
      coalesce(dislikes, 0) AS dislikes, source AS raw_text_normalized,
      epoch_us(TIMESTAMP '2024-03-01') AS created_at
    FROM wh_comment WHERE product_id IN (SELECT id FROM wh_product)""",
)
from_raw(
    "w13_comment_aspects",
    f"""SELECT row_number() OVER (ORDER BY {by_hash('comment_id', 'pos')}) AS aspect_id, *
    FROM (SELECT comment_id, row_number() OVER (PARTITION BY comment_id ORDER BY aspect_id)::INTEGER - 1 AS pos,
      nullif(trim(term), '') AS term, nullif(trim(sentiment), '') AS sentiment, negative_pct, neutral_pct,
      positive_pct FROM wh_aspect)""",
)
_emb = """emb AS (SELECT CASE WHEN vec_id % 10 = 3 THEN 'x' WHEN vec_id % 10 = 4 THEN NULL
      ELSE CAST(vec_id AS VARCHAR) END AS id,
    CASE WHEN vec_id % 7 = 1 THEN 10 WHEN vec_id % 7 = 2 THEN NULL ELSE len(embedding) END AS dimension
    FROM embeddings),
  verdicts AS (SELECT TRY_CAST(id AS BIGINT) AS id, coalesce(dimension = 64, false) AS fits FROM emb)"""
from_raw(
    "w14_embeddings",
    """SELECT id, CAST(64 AS INTEGER) AS dimension FROM verdicts
    WHERE id IS NOT NULL AND fits AND id IN (SELECT id FROM wh_comment)""",
    _emb,
)
from_raw(
    "w14_embedding_report",
    """SELECT count(*) AS total_rows, count(*) FILTER (WHERE id IS NOT NULL AND fits) AS valid_rows,
      count(*) FILTER (WHERE id IS NULL) AS invalid_id_rows,
      count(*) FILTER (WHERE id IS NOT NULL AND NOT fits) AS invalid_vector_rows,
      count(DISTINCT id) FILTER (WHERE fits AND id IN (SELECT id FROM wh_comment)) AS inserted_rows
    FROM verdicts""",
    _emb,
)
_uniques = (
    ("sessions", "shop_session", "session_id"), ("brands", "wh_brand", "name"), ("products", "wh_product", "id"),
    ("user_behavior_logs", "shop_log", "session_id,product_id,event_type,timestamp"),
    ("comments", "wh_comment", "id"), ("comment_aspects", "wh_aspect", "aspect_id"),
)
_not_null = (
    ("brands", "wh_brand", "name"), ("products", "wh_product", "title_fa"),
    ("comment_aspects", "wh_aspect", "comment_id"),
)
_fks = (
    ("products", "wh_product", "brand_id", "wh_brand", "brand_id"),
    ("user_behavior_logs", "shop_log", "session_id", "shop_session", "session_id"),
    ("user_behavior_logs", "shop_log", "product_id", "wh_product", "id"),
    ("comments", "wh_comment", "product_id", "wh_product", "id"),
    ("comment_aspects", "wh_aspect", "comment_id", "wh_comment", "id"),
)
from_raw(
    "w15_integrity",
    " UNION ALL ".join(
        [
            f"""SELECT 'unique' AS rule, '{n}' AS table_name, '{c}' AS column_name,
            (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {t})) AS violations"""
            for n, t, c in _uniques
        ]
        + [f"SELECT 'not_null', '{n}', '{c}', count(*) - count({c}) FROM {t}" for n, t, c in _not_null]
        + [
            f"""SELECT 'foreign_key', '{n}', '{c}', count(*) FROM {t} x
            WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{k} = x.{c})"""
            for n, t, c, p, k in _fks
        ]
    ),
)

# ---- marts and views ----------------------------------------------------------------

_kinds = (
    ("view", "is_view", "total_views"), ("add_to_cart", "is_cart", "total_cart_adds"),
    ("remove_from_cart", "is_remove", "total_removes"), ("purchase", "is_purchase", "total_purchases"),
)
BEHAVIOR = (
    """behavior AS (SELECT log_id, CAST(hour(timestamp) AS INTEGER) AS hour, CAST(day(timestamp) AS INTEGER) AS day,
    CAST(month(timestamp) AS INTEGER) AS month, CAST(isodow(timestamp) AS INTEGER) AS weekday,
    CAST(isodow(timestamp) IN (4, 5) AS INTEGER) AS is_weekend, """
    + ", ".join(f"CAST(event_type = '{k}' AS INTEGER) AS {f}" for k, f, _ in _kinds)
    + " FROM shop_log)"
)
BASE = """base AS (SELECT s.user_id, l.log_id, l.session_id, l.product_id, s.city_id, l.timestamp, l.event_type AS et,
    CAST(l.timestamp AS DATE) AS date, b.hour, b.weekday, b.is_weekend, b.is_view, b.is_cart, b.is_remove,
    b.is_purchase FROM shop_log l JOIN shop_session s ON s.session_id = l.session_id
    JOIN behavior b ON b.log_id = l.log_id)"""
TOTALS = "count(*) AS total_events, " + ", ".join(
    f"count(*) FILTER (WHERE et = '{k}') AS {n}" for k, _, n in _kinds
)


def reach(column: str, kind: str, name: str) -> str:
    return f"count(DISTINCT {column}) FILTER (WHERE et = '{kind}') AS {name}"


EVENT_STATS = f"""event_stats AS (SELECT user_id, {TOTALS}, count(DISTINCT session_id) AS total_sessions,
    count(DISTINCT date) AS active_days, {reach('product_id', 'view', 'unique_products_viewed')},
    {reach('product_id', 'purchase', 'unique_products_purchased')},
    count(DISTINCT city_id) AS cities_visited, avg(is_weekend) AS weekend_activity_ratio,
    avg(CAST(hour BETWEEN 6 AND 11 AS INTEGER)) AS morning_activity_ratio,
    avg(CAST(hour BETWEEN 12 AND 17 AS INTEGER)) AS afternoon_activity_ratio,
    avg(CAST(hour >= 18 AS INTEGER)) AS evening_activity_ratio,
    avg(CAST(hour < 6 AS INTEGER)) AS night_activity_ratio FROM base GROUP BY user_id)"""
SESSION_STATS = f"""session_stats AS (SELECT user_id, avg(n) AS avg_session_events, max(n) AS max_session_events,
    {r6('avg(minutes)')} AS avg_session_duration_minutes, {r6('max(minutes)')} AS max_session_duration_minutes
    FROM (SELECT user_id, session_id, count(*) AS n,
      (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 6e7 AS minutes FROM base GROUP BY user_id, session_id)
    GROUP BY user_id)"""
PURCHASES = """purchases AS (SELECT b.user_id, count(*) AS purchase_frequency, count(DISTINCT b.date) AS purchase_days,
    CAST(sum(p.price) AS DOUBLE) AS total_spend, avg(p.price) AS avg_purchase_value,
    min(p.price) AS min_purchase_price, max(p.price) AS max_purchase_price,
    count(DISTINCT p.brand_id) AS brand_diversity, count(DISTINCT p.category_id) AS category_diversity
    FROM base b JOIN wh_product p ON p.id = b.product_id WHERE b.et = 'purchase' GROUP BY b.user_id)"""
FAVOURITES = """favourites AS (SELECT h.user_id, h.v AS preferred_hour, w.v AS preferred_weekday FROM
    (SELECT user_id, hour AS v, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, hour) AS rn
      FROM base GROUP BY user_id, hour) h
    JOIN (SELECT user_id, weekday AS v, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, weekday)
      AS rn FROM base GROUP BY user_id, weekday) w ON w.user_id = h.user_id AND w.rn = 1 WHERE h.rn = 1)"""
_p = (
    "total_spend", "avg_purchase_value", "min_purchase_price", "max_purchase_price", "purchase_frequency",
    "purchase_days", "brand_diversity", "category_diversity",
)
FEATURE_USER = (
    "feature_user AS (SELECT e.*, s.* EXCLUDE (user_id), f.* EXCLUDE (user_id), "
    + ", ".join(f"coalesce(p.{c}, 0) AS {c}" for c in _p)
    + """ FROM event_stats e LEFT JOIN session_stats s ON s.user_id = e.user_id
    LEFT JOIN favourites f ON f.user_id = e.user_id LEFT JOIN purchases p ON p.user_id = e.user_id)"""
)
FEATURE_PRODUCT = f"""feature_product AS (SELECT p.id AS product_id,
    greatest((p.min_price_last_month - p.price) / nullif(CAST(p.min_price_last_month AS DOUBLE), 0), 0)
      AS price_drop_ratio,
    coalesce(t.total_events, 0) AS total_events, {', '.join(f'coalesce(t.{n}, 0) AS {n}' for _, _, n in _kinds)},
    coalesce(t.unique_viewers, 0) AS unique_viewers, coalesce(t.unique_carters, 0) AS unique_carters,
    coalesce(t.unique_buyers, 0) AS unique_buyers, coalesce(t.total_sessions, 0) AS total_sessions
    FROM wh_product p LEFT JOIN (SELECT product_id, {TOTALS}, {reach('user_id', 'view', 'unique_viewers')},
      {reach('user_id', 'add_to_cart', 'unique_carters')}, {reach('user_id', 'purchase', 'unique_buyers')},
      count(DISTINCT session_id) AS total_sessions FROM base GROUP BY product_id) t ON t.product_id = p.id)"""
FEATURE_BRAND = f"""feature_brand AS (SELECT p.brand_id, {TOTALS}, {reach('user_id', 'view', 'unique_viewers')},
    {reach('user_id', 'purchase', 'unique_buyers')}
    FROM base b JOIN wh_product p ON p.id = b.product_id GROUP BY p.brand_id)"""


def moods(suffix: str, alias: str = "") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE lower({alias}sentiment) = '{m}') AS {m}{suffix}"
        for m in ("positive", "negative", "neutral")
    )


AVERAGES = ", ".join(f"avg({c}) AS avg_{c}" for c in ("negative_pct", "neutral_pct", "positive_pct"))
PRODUCT_SENTIMENT = f"""product_sentiment AS (SELECT p.id AS product_id, coalesce(c.comment_count, 0) AS comment_count,
    coalesce(c.avg_rate, 0) AS avg_rate, coalesce(c.avg_like_ratio, 0) AS avg_like_ratio,
    coalesce(c.total_likes, 0) AS total_likes, coalesce(c.total_dislikes, 0) AS total_dislikes,
    {', '.join(f'coalesce(a.{m}_aspect_mentions, 0) AS {m}_aspect_mentions' for m in ('total', 'positive', 'negative', 'neutral'))},
    {', '.join(f'coalesce(a.avg_{m}_pct, 0) AS avg_{m}_pct' for m in ('positive', 'negative', 'neutral'))},
    {', '.join(f'CAST(a.{m}_aspect_mentions AS DOUBLE) / a.total_aspect_mentions AS {m}_aspect_ratio' for m in ('positive', 'negative', 'neutral'))}
    FROM wh_product p
    LEFT JOIN (SELECT product_id, count(*) AS comment_count, avg(rate) AS avg_rate,
      {r6('avg(coalesce(likes, 0) / (coalesce(dislikes, 0) + 1))')} AS avg_like_ratio,
      {big('sum(coalesce(likes, 0))')} AS total_likes, {big('sum(coalesce(dislikes, 0))')} AS total_dislikes
      FROM wh_comment GROUP BY product_id) c ON c.product_id = p.id
    LEFT JOIN (SELECT product_id, count(*) AS total_aspect_mentions, {moods('_aspect_mentions')}, {AVERAGES}
      FROM wh_comment c JOIN wh_aspect a ON a.comment_id = c.id GROUP BY product_id) a ON a.product_id = p.id)"""
FEATURE_ASPECT = f"""feature_aspect AS (SELECT term, count(*) AS total_mentions, {moods('_mentions')}, {AVERAGES}
    FROM wh_aspect WHERE term IS NOT NULL GROUP BY term)"""


def group_sentiment(key: str, name: str, dedup: bool = False) -> str:
    joined = f"""SELECT p.{key}, c.id, c.rate, c.likes, c.dislikes, a.aspect_id, a.sentiment,
      row_number() OVER (PARTITION BY c.id ORDER BY a.aspect_id) AS nth
      FROM wh_product p LEFT JOIN wh_comment c ON c.product_id = p.id LEFT JOIN wh_aspect a ON a.comment_id = c.id"""
    once = " FILTER (WHERE nth = 1)" if dedup else ""
    return f"""{name} AS (SELECT {key}, count(DISTINCT id) AS total_comments, count(aspect_id) AS total_aspect_mentions,
    {moods('_aspect_mentions')}, avg(rate){once} AS avg_comment_rating,
    {big(f"coalesce(sum(coalesce(likes, 0)){once}, 0)")} AS total_likes,
    {big(f"coalesce(sum(coalesce(dislikes, 0)){once}, 0)")} AS total_dislikes FROM ({joined}) GROUP BY {key})"""


BRAND_SENTIMENT = group_sentiment("brand_id", "brand_sentiment")
FEATURE_TIME = (
    "feature_time AS (SELECT hour, weekday AS iso_weekday, count(*) AS total_events, "
    + ", ".join(f"{big(f'sum({f})')} AS {n}" for _, f, n in _kinds)
    + " FROM behavior GROUP BY hour, weekday)"
)
G_USER = ",\n".join((BEHAVIOR, BASE, EVENT_STATS, SESSION_STATS, PURCHASES, FAVOURITES, FEATURE_USER))


def mart(name: str, body: str, ctes: str = f"{BEHAVIOR}, {BASE}") -> None:
    add(
        name, body, "shop_log", "shop_session", "wh_product", "wh_comment", "wh_aspect", "wh_brand",
        ctes=ctes,
    )


mart("g01_feature_behavior", "SELECT * FROM behavior")
mart("g02_user_base", "SELECT * EXCLUDE (timestamp, et, date) FROM base")
mart("g03_event_stats", "SELECT * FROM event_stats", G_USER)
mart("g04_session_stats", "SELECT * FROM session_stats", G_USER)
mart("g05_purchase_stats", "SELECT * FROM purchases", G_USER)
mart("g06_time_preference", "SELECT * FROM favourites", G_USER)
mart("g07_feature_user", "SELECT * FROM feature_user", G_USER)
mart("g08_feature_product", "SELECT * FROM feature_product", f"{BEHAVIOR}, {BASE}, {FEATURE_PRODUCT}")
mart(
    "g09_feature_city",
    f"""SELECT city_id, count(DISTINCT user_id) AS total_users, count(DISTINCT session_id) AS total_sessions, {TOTALS},
    {reach('product_id', 'view', 'unique_products_viewed')}, {reach('product_id', 'purchase', 'unique_products_purchased')}
    FROM base GROUP BY city_id""",
)
mart(
    "g10_feature_category",
    f"""SELECT p.category_id, {TOTALS}, {reach('user_id', 'view', 'unique_viewers')},
    {reach('user_id', 'purchase', 'unique_buyers')}, avg(p.price) AS avg_product_price
    FROM base b JOIN wh_product p ON p.id = b.product_id GROUP BY p.category_id""",
)
mart("g11_feature_brand", "SELECT * FROM feature_brand", f"{BEHAVIOR}, {BASE}, {FEATURE_BRAND}")
_counts = "count(*) AS total_events, " + ", ".join(
    f"{big(f'sum({f})')} AS {n}"
    for f, n in (("is_view", "view_count"), ("is_cart", "cart_count"), ("is_remove", "remove_count"), ("is_purchase", "purchase_count"))
)
mart(
    "g12_feature_user_product",
    f"""SELECT user_id, product_id, {_counts}, count(DISTINCT date) AS active_days,
    count(DISTINCT session_id) AS session_count FROM base GROUP BY user_id, product_id""",
)
mart(
    "g13_feature_user_category",
    f"""SELECT *, view_count / nullif(sum(view_count) OVER u, 0)::DOUBLE AS view_share,
      purchase_count / nullif(sum(purchase_count) OVER u, 0)::DOUBLE AS purchase_share,
      category_spend / nullif(sum(category_spend) OVER u, 0) AS spend_share
    FROM (SELECT b.user_id, p.category_id, {_counts},
      CAST(sum(CASE WHEN et = 'purchase' THEN p.price ELSE 0 END) AS DOUBLE) AS category_spend
      FROM base b JOIN wh_product p ON p.id = b.product_id WHERE b.user_id IS NOT NULL GROUP BY b.user_id, p.category_id)
    WINDOW u AS (PARTITION BY user_id)""",
)
mart("g14_feature_product_sentiment", "SELECT * FROM product_sentiment", PRODUCT_SENTIMENT)
mart(
    "g15_feature_product_aspect",
    f"""SELECT c.product_id, a.term, count(*) AS total_mentions, {moods('_mentions')}, {AVERAGES}
    FROM wh_comment c JOIN wh_aspect a ON a.comment_id = c.id WHERE a.term IS NOT NULL GROUP BY c.product_id, a.term""",
    "",
)
mart("g16_feature_brand_sentiment", "SELECT * FROM brand_sentiment", BRAND_SENTIMENT)
mart("g16_feature_brand_sentiment_dedup", "SELECT * FROM bs", group_sentiment("brand_id", "bs", True))
mart("g17_feature_category_sentiment", "SELECT * FROM cs", group_sentiment("category_id", "cs"))
mart("g18_feature_aspect", "SELECT * FROM feature_aspect", FEATURE_ASPECT)
mart("g19_feature_time", "SELECT * FROM feature_time", f"{BEHAVIOR}, {FEATURE_TIME}")

mart(
    "v01_global_funnel",
    f"""SELECT v AS total_views, c AS total_carts, p AS total_purchases, r AS total_removes,
      {pct2('c', 'v')} AS view_to_cart_pct, {pct2('p', 'c')} AS cart_to_purchase_pct,
      {pct2('p', 'v')} AS overall_conversion_pct, {pct2('r', 'c')} AS cart_abandonment_pct
    FROM (SELECT count(*) FILTER (WHERE event_type = 'view') AS v,
      count(*) FILTER (WHERE event_type = 'add_to_cart') AS c,
      count(*) FILTER (WHERE event_type = 'purchase') AS p,
      count(*) FILTER (WHERE event_type = 'remove_from_cart') AS r FROM shop_log)""",
    "",
)
ORACLE["s13_publish_view"] = ORACLE["v01_global_funnel"]
mart(
    "v02_product_360",
    f"""SELECT f.product_id, p.title_fa, p.price, f.total_views, f.total_purchases,
      f.total_purchases * p.price AS total_revenue, {pct2('f.total_purchases', 'f.total_views')} AS conversion_rate,
      s.comment_count, {half_up('s.avg_rate')} AS star_rating,
      {half_up('s.positive_aspect_ratio * 100')} AS positive_sentiment_pct,
      {half_up('(s.positive_aspect_ratio - s.negative_aspect_ratio) * 100')} AS sentiment_score,
      CASE WHEN f.total_purchases * p.price > 20000 AND s.positive_aspect_ratio > 0.5 THEN 'Hero Product (قهرمان)'
        WHEN f.total_views > 20 AND f.total_purchases < 20 THEN 'High Traffic, Low Conversion (نیازمند بررسی قیمت)'
        WHEN s.negative_aspect_ratio > 0.2 AND f.total_purchases > 10 THEN 'High Risk (فروش بالا اما به شدت ناراضی)'
        WHEN s.comment_count = 0 THEN 'Needs Reviews (نیازمند کمپین ثبت نظر)' ELSE 'Normal' END AS managerial_action_tag
    FROM feature_product f JOIN wh_product p ON p.id = f.product_id
    LEFT JOIN product_sentiment s ON s.product_id = f.product_id""",
    f"{BEHAVIOR}, {BASE}, {FEATURE_PRODUCT}, {PRODUCT_SENTIMENT}",
)
mart(
    "v03_user_segments",
    f"""SELECT user_id, active_days, total_views, total_purchases, total_spend,
      CASE WHEN total_purchases >= 12 AND total_spend > 12000 THEN 'VIP Customer'
        WHEN total_purchases > 1 AND total_purchases < 12 THEN 'Returning Customer'
        WHEN total_purchases = 1 THEN 'One-Time Buyer'
        WHEN total_purchases = 0 AND total_views > 5 THEN 'Window Shopper (فقط بازدیدکننده)'
        ELSE 'Low Engagement' END AS user_segment,
      {pct2('total_purchases', 'total_views')} AS user_conversion_pct FROM feature_user""",
    G_USER,
)
mart(
    "v04_brand_diagnostics",
    f"""SELECT b.brand_id, n.name AS brand_name, b.total_views, b.total_purchases, s.total_comments,
      {half_up('s.avg_comment_rating')} AS avg_rating,
      {pct2('s.positive_aspect_mentions - s.negative_aspect_mentions', 's.total_aspect_mentions')} AS brand_sentiment_score
    FROM feature_brand b JOIN wh_brand n ON n.brand_id = b.brand_id LEFT JOIN brand_sentiment s ON s.brand_id = b.brand_id""",
    f"{BEHAVIOR}, {BASE}, {FEATURE_BRAND}, {BRAND_SENTIMENT}",
)
mart(
    "v05_aspect_diagnostics",
    f"""SELECT term AS aspect_name, total_mentions, positive_mentions, negative_mentions,
      {pct2('negative_mentions', 'total_mentions')} AS negative_impact_pct,
      CASE WHEN negative_mentions / total_mentions > 0.25 THEN 'Critical Weakness (نقطه ضعف بحرانی)'
        WHEN positive_mentions / total_mentions > 0.6 THEN 'Key Strength (نقطه قوت کلیدی)' ELSE 'Neutral' END AS aspect_status
    FROM feature_aspect WHERE total_mentions > 5""",
    FEATURE_ASPECT,
)

# ---- aspect scoring -----------------------------------------------------------------

CLASSES = ("negative", "neutral", "positive")
DOCS = f"docs AS (SELECT doc_id, {collapse('text')} AS t FROM documents)"


def words_of(docs: str) -> str:
    """Words with their number (from 1) and character offsets; result table ``words``."""
    return f"""words AS (SELECT doc_id, i, w, s, s + length(w) AS e FROM (
      SELECT doc_id, i, w, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) - length(w) - 1 AS s
      FROM (SELECT doc_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i
        FROM {docs} WHERE t <> '')))"""


SPANS = f"""{DOCS},
{words_of('docs')},
tagged AS (SELECT *, CASE length(w) % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE -100 END AS tag
  FROM words),
opened AS (SELECT *, sum(CASE WHEN tag = 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM tagged),
spans AS (SELECT o.doc_id, min(s) AS s, max(e) AS e FROM opened o WHERE tag > 0 GROUP BY o.doc_id, g
  HAVING count(*) FILTER (WHERE tag = 1) = 1),
terms AS (SELECT p.doc_id AS comment_id, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end",
  substring(t, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)) AS term,
  CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY s) - 1 AS INTEGER) AS pos
  FROM spans p JOIN docs d ON d.doc_id = p.doc_id),
probs AS (SELECT comment_id, pos, term, a / (a + b + c)::DOUBLE AS negative, b / (a + b + c)::DOUBLE AS neutral,
  c / (a + b + c)::DOUBLE AS positive
  FROM (SELECT *, length(term) % 3 + 1 AS a, length(term) % 5 + 1 AS b, length(term) % 7 + 1 AS c FROM terms)),
means AS (SELECT comment_id, term, min(pos) AS pos, count(*) AS mentions, avg(negative) AS negative,
  avg(neutral) AS neutral, avg(positive) AS positive FROM probs GROUP BY comment_id, term),
labelled AS (SELECT comment_id, pos, term,
  CASE WHEN negative >= neutral AND negative >= positive THEN 'negative' WHEN neutral >= positive THEN 'neutral'
    ELSE 'positive' END AS sentiment,
  {', '.join(f"{half_even(f'{c} * 100', 1)} AS {c}_pct" for c in CLASSES)}, mentions FROM means)"""


def spans_query(name: str, body: str) -> None:
    add(name, body, ctes=SPANS)


spans_query("i01_decode_spans", 'SELECT comment_id, "start", "end" FROM terms')
spans_query("i02_span_terms", 'SELECT comment_id, "start", "end", term FROM terms')
spans_query("i03_aspect_pairs", "SELECT comment_id, pos, term FROM terms")
_rounded = ", ".join(f"{r6(c)} AS {c}" for c in CLASSES)
spans_query("i04_mean_scores", f"SELECT comment_id, term, pos, mentions, {_rounded} FROM means")
spans_query(
    "i05_top_class",
    f"SELECT sentiment, count(*) AS aspects, {big('sum(mentions)')} AS mentions FROM labelled GROUP BY sentiment",
)
spans_query("i06_label_aspects", "SELECT * FROM labelled")
spans_query(
    "i07_attach_aspects",
    f"""SELECT d.doc_id AS id, CAST(coalesce(n, 0) AS INTEGER) AS num_aspects, first_term,
      {big('coalesce(m, 0)')} AS mentions, coalesce(items, '') AS items
    FROM documents d LEFT JOIN (SELECT comment_id, count(*) AS n, arg_min(term, pos) AS first_term, sum(mentions) AS m,
        string_agg(term || '|' || sentiment || '|' || mentions, ',' ORDER BY pos) AS items
      FROM labelled GROUP BY comment_id) a ON a.comment_id = d.doc_id""",
)
spans_query(
    "i08_score_comments",
    f"SELECT comment_id AS id, term, sentiment, {', '.join(f'{c}_pct' for c in CLASSES)} FROM labelled",
)
spans_query("i09_scoring_hook", f"SELECT comment_id, pos, {_rounded} FROM probs")

# ---- sentiment KPIs -----------------------------------------------------------------

ROWS = """aspect_rows AS (SELECT id, product_id, predicted_sentiment, aspect_1 AS predicted_aspects FROM predicted
    WHERE aspect_1 IS NOT NULL
  UNION ALL SELECT id, product_id, predicted_sentiment, aspect_2 FROM predicted WHERE aspect_2 IS NOT NULL)"""


def pivot(source: str, keys: str, total: str = "total_comments") -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE predicted_sentiment = '{c}') AS {c[:3]}" for c in CLASSES)
    pct = {c: half_even(f"{c[:3]} / nullif(CAST(neg + neu + pos AS DOUBLE), 0) * 100") for c in CLASSES}
    known = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"""SELECT {keys}, positive, negative, neutral, {half_even('positive - negative')} AS sentiment_score, {total}
    FROM (SELECT {keys}, {', '.join(f'{e} AS {c}' for c, e in pct.items())}, neg + neu + pos AS {total}
      FROM (SELECT {keys}, {counts} FROM {source} WHERE predicted_sentiment IS NOT NULL AND {known} GROUP BY {keys}))"""


def favourite(name: str, where: str = "true") -> str:
    return f"""(SELECT product_id, predicted_aspects AS {name} FROM (SELECT product_id, predicted_aspects,
      row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, predicted_aspects) AS rn
      FROM aspect_rows WHERE {where} GROUP BY product_id, predicted_aspects) WHERE rn = 1)"""


TOP_ASPECT = favourite("top_aspect")
WORST_ASPECT = favourite("worst_aspect", "predicted_sentiment = 'negative'")
PRODUCT_KPI = f"""product_kpi AS (SELECT p.*, t.top_aspect, w.worst_aspect FROM ({pivot('predicted', 'product_id')}) p
    LEFT JOIN {TOP_ASPECT} t ON t.product_id = p.product_id
    LEFT JOIN {WORST_ASPECT} w ON w.product_id = p.product_id)"""
_subset = (
    "id, title_fa, Brand, Category1, Category2, sub_category, Price, Rate, Rate_cnt, is_view, is_cart, is_purchase,"
    " conversion_rate, drop_off_rate, avg_rate, comment_count, avg_like_ratio, avg_sentiment"
)
SUBSET = f"subset AS (SELECT {_subset} FROM master)"
ABSA = """absa AS (SELECT s.*, k.* EXCLUDE (product_id) FROM subset s LEFT JOIN product_kpi k ON k.product_id = s.id)"""
GOLDEN = """golden AS (SELECT a.* EXCLUDE (is_view, is_cart, is_purchase, conversion_rate), m.is_view, m.is_cart,
    m.is_purchase, m.is_remove, m.conversion_rate, m.cart_abandon_rate FROM absa a JOIN master m ON m.id = a.id)"""
J_ALL = ",\n".join((ROWS, F_MASTER, PRODUCT_KPI, SUBSET, ABSA, GOLDEN))


def mood_query(name: str, body: str, ctes: str = ROWS) -> None:
    add(name, body, "shop_log", "catalogue", "wh_comment", "predicted", "wh_aspect", ctes=ctes)


mood_query(
    "j00_predictions",
    """SELECT c.id, CASE WHEN n IS NULL THEN NULL WHEN neg >= neu AND neg >= pos THEN 'negative'
      WHEN neu >= pos THEN 'neutral' ELSE 'positive' END AS predicted_sentiment,
      CAST(coalesce(terms, 0) AS INTEGER) AS terms, coalesce(aspects, '') AS aspects
    FROM wh_comment c LEFT JOIN (SELECT comment_id, count(*) AS n, count(term) AS terms, string_agg(term, ',' ORDER BY aspect_id) AS aspects, avg(negative_pct) AS neg,
      avg(neutral_pct) AS neu, avg(positive_pct) AS pos FROM wh_aspect GROUP BY comment_id) a ON a.comment_id = c.id""",
    "",
)
mood_query("j01_aspect_rows", "SELECT * FROM aspect_rows")
mood_query("j02_sentiment_pivot", pivot("predicted", "product_id"))
mood_query("j03_product_kpi", "SELECT * FROM product_kpi", f"{ROWS}, {PRODUCT_KPI}")
mood_query("j04_top_aspect", f"SELECT * FROM {TOP_ASPECT}")
mood_query("j05_worst_aspect", f"SELECT * FROM {WORST_ASPECT}")
for _name, _key in (("j06_brand_kpi", "Brand"), ("j07_category_kpi", "Category1")):
    mood_query(
        _name, pivot("joined", _key),
        f"joined AS (SELECT p.predicted_sentiment, c.{_key} FROM predicted p LEFT JOIN catalogue c ON c.id = p.product_id)",
    )
mood_query("j08_aspect_kpi", pivot("aspect_rows", "predicted_aspects", "total_mentions"))
mood_query("j09_product_aspect_kpi", pivot("aspect_rows", "product_id, predicted_aspects", "total_mentions"))
mood_query(
    "j10_sentiment_distribution",
    """SELECT predicted_sentiment, count(*) AS count FROM predicted WHERE predicted_sentiment IS NOT NULL
    GROUP BY predicted_sentiment""",
)
mood_query(
    "j11_aspect_frequency",
    "SELECT predicted_aspects, count(*) AS count FROM aspect_rows GROUP BY predicted_aspects",
)
mood_query("j12_product_subset", "SELECT * FROM subset", J_ALL)
mood_query("j13_product_master_absa", "SELECT * FROM absa", J_ALL)

# ---- quality and exploration --------------------------------------------------------


def nulls_of(table: str, columns, head: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT {head}'{c}' AS column_name, count(*) - count({c}) AS null_count,
        (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS null_pct FROM {table}"""
        for c in columns
    )


CATALOGUE_COLUMNS = (
    "id", "title_fa", "Brand", "Category1", "Category2", "sub_category", "Seller", "Price",
    "min_price_last_month", "Rate", "Rate_cnt",
)
LOG_COLUMNS = ("log_id", "user_id", "session_id", "product_id", "event_type", "timestamp", "city")
mood_query("q01_null_overview", nulls_of("catalogue", CATALOGUE_COLUMNS), "")
mood_query(
    "q02_duplicate_rows",
    """SELECT (SELECT count(*) FROM shop_log)
      - (SELECT count(*) FROM (SELECT DISTINCT user_id, product_id, event_type FROM shop_log)) AS duplicate_rows""",
    "",
)
ORACLE["q03_infinity_counts"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {'count(*) FILTER (WHERE l_discount = 0)' if c == 'per_discount' else '0::BIGINT'}"
    " AS infinite_count FROM lineitem"
    for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "per_discount",
    )
)
ORACLE["q03_infinity_counts"] = ORACLE["q03_infinity_counts"].replace("SELECT '", "SELECT DISTINCT '").replace(
    "SELECT DISTINCT 'per_discount'", "SELECT 'per_discount'"
)


def rule_query(name: str, rule: str, condition: str, source: str, ctes: str = "") -> None:
    mood_query(name, f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {condition}) AS violations FROM {source}", ctes)


_known = "'view', 'add_to_cart', 'remove_from_cart', 'purchase'"
_unknown = f"event_type IS NULL OR event_type NOT IN ({_known})"
rule_query("q04_purchase_above_view", "purchase_above_view", "is_purchase > is_view", "master", F_MASTER)
rule_query("q05_product_rate_range", "product_rate_range", "Rate NOT BETWEEN 0 AND 100", "catalogue")
rule_query("q06_comment_rate_range", "comment_rate_range", "rate NOT BETWEEN 0 AND 5", "wh_comment")
rule_query("q07_negative_price", "negative_price", "c_acctbal < 0", "customer")
rule_query("q08_unknown_event_type", "unknown_event_type", _unknown, "shop_log")
mood_query("q09_value_counts", "SELECT event_type, count(*) AS count FROM shop_log GROUP BY event_type", "")
mood_query(
    "q10_funnel_anomalies",
    """SELECT id, title_fa, is_view, is_purchase, conversion_rate FROM master WHERE is_purchase > is_view
    ORDER BY id LIMIT 10""",
    F_MASTER,
)
mood_query(
    "q11_spending_users",
    """SELECT user_id, total_spend, aov, brand_diversity, category_diversity, total_sessions, avg_session_depth,
      weekend_activity_ratio FROM users WHERE total_spend > 0""",
    F_USERS,
)
mood_query(
    "q11_discussed_products",
    """SELECT id, Price, min_price_last_month, price_drop_ratio, review_engagement_rate FROM master
    WHERE review_engagement_rate > 0""",
    F_MASTER,
)
mood_query(
    "q12_table_report",
    """SELECT 'log' AS table_name, count(*) AS row_count, CAST(7 AS INTEGER) AS column_count, false AS is_empty FROM shop_log
    UNION ALL SELECT 'catalogue', count(*), 11, false FROM catalogue
    UNION ALL SELECT 'comments', count(*), 10, false FROM wh_comment UNION ALL SELECT 'nothing', 0, 7, true""",
    "",
)


def _scan(table: str, columns, numeric, rules) -> list[str]:
    null = "CAST(NULL AS VARCHAR)"
    name = "log" if table == "shop_log" else table
    every = ", ".join(columns)
    return (
        [f"SELECT '{name}' AS table_name, 'nulls' AS \"check\", '{c}' AS column_name, count(*) - count({c}) AS count FROM {table}" for c in columns]
        + [f"SELECT '{name}', 'duplicates', {null}, (SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT {every} FROM {table}))"]
        + [f"SELECT '{name}', 'rule', '{r}', count(*) FILTER (WHERE {cond}) FROM {table}" for r, cond in rules]
        + [f"SELECT '{name}', 'infinite', '{c}', 0" for c in numeric]
    )


mood_query(
    "q_scan_all_rules",
    " UNION ALL ".join(
        _scan(
            "catalogue", CATALOGUE_COLUMNS, ("id", "Price", "min_price_last_month", "Rate", "Rate_cnt"),
            (("product_rate_range", "Rate NOT BETWEEN 0 AND 100"), ("negative_price", "Price < 0")),
        )
        + _scan(
            "shop_log", LOG_COLUMNS, ("log_id", "user_id", "product_id"), (("unknown_event_type", _unknown),)
        )
    ),
    "",
)
mood_query("e01_golden_table", "SELECT * FROM golden", J_ALL)
mood_query(
    "e02_bubble_set",
    """SELECT id, Price, conversion_rate, total_comments, coalesce(sentiment_score, 0) AS sentiment_score, top_aspect
    FROM golden WHERE Price > 0 AND is_view >= 20 AND total_comments > 0""",
    J_ALL,
)
_corr = (
    "Price", "Rate", "Rate_cnt", "is_view", "is_cart", "is_remove", "is_purchase", "conversion_rate",
    "cart_abandon_rate", "positive", "negative", "sentiment_score", "total_comments",
)
mood_query(
    "e03_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS r FROM golden"
        for i, a in enumerate(_corr) for b in _corr[i + 1:]
    ),
    J_ALL.replace("golden AS (", "golden AS MATERIALIZED ("),
)
_q = ", ".join(
    f"{r6(f'quantile_cont(sentiment_score, {p})')} AS {n}" for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
)
mood_query(
    "e04_brand_score_quartiles",
    f"""SELECT Brand, count(sentiment_score) AS scored, min(sentiment_score) AS lowest, {_q},
      max(sentiment_score) AS highest FROM golden
    WHERE Brand IN (SELECT Brand FROM golden WHERE Brand IS NOT NULL GROUP BY Brand ORDER BY count(*) DESC, Brand LIMIT 10)
    GROUP BY Brand""",
    J_ALL,
)
mood_query(
    "e05_diverging_aspects",
    f"""SELECT predicted_aspects AS aspect, total_mentions, -negative AS negative_signed, positive
    FROM ({pivot('aspect_rows', 'predicted_aspects', 'total_mentions')})
    ORDER BY total_mentions DESC, predicted_aspects LIMIT 15""",
)
from_log(
    "e06_funnel_stages",
    f"""SELECT 'View' AS stage, {big('sum(is_view)')} AS total FROM enriched
    UNION ALL SELECT 'Add to Cart', {big('sum(is_cart)')} FROM enriched
    UNION ALL SELECT 'Purchase', {big('sum(is_purchase)')} FROM enriched
    UNION ALL SELECT 'Remove from Cart', {big('sum(is_remove)')} FROM enriched""",
)
from_log(
    "e07_hourly_trend",
    f"""SELECT hour, {big('sum(is_view)')} AS is_view, {big('sum(is_purchase)')} AS is_purchase FROM enriched
    GROUP BY hour""",
)

# ---- labelled spans -----------------------------------------------------------------

LABELLED = NORM + """,
picked AS (SELECT doc_id, w, unnest(range(0, (len(w) + 11) // 12)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM norm)),
word_pieces AS (SELECT doc_id, i, w[i * 12 + 1 : i * 12 + 12] AS ws FROM picked),
labelled AS (SELECT doc_id, no, text, term, CASE doc_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END
    AS polarity, strpos(text, term) - 1 AS place, strpos(text, term) - 1 + doc_id % 2 AS given
  FROM (SELECT doc_id, i * 12 + j - 1 AS no, array_to_string(ws, ' ') AS text, ws[j] AS term
    FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM word_pieces)) WHERE length(term) > 4),
second AS (SELECT *, CASE WHEN strpos(substring(text, place + 1 + length(term)), term) > 0
    THEN place + length(term) + strpos(substring(text, place + 1 + length(term)), term) - 1 END AS place2 FROM labelled),
located AS (SELECT doc_id, no, text, term, polarity,
    CASE WHEN substring(text, given + 1, length(term)) = term THEN given ELSE place END AS s FROM labelled)"""


def label_query(name: str, body: str, ctes: str = "") -> None:
    add(name, body, ctes=LABELLED + (",\n" + ctes if ctes else ""))


_int = "CAST({} AS INTEGER)".format
label_query(
    "p01_valid_examples",
    f"""SELECT text AS review_text, term, polarity, {_int('place')} AS asp_start, {_int('place + length(term)')} AS asp_end
    FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, no) AS rn FROM labelled) WHERE rn = 1""",
)
label_query(
    "p01_example_counts",
    "SELECT count(DISTINCT text) AS kept, count(*) AS dropped FROM labelled",
)
label_query(
    "p02_extract_examples",
    f"SELECT doc_id * 1000000 + no AS batch, text AS review_text, {_int('2')} AS aspects FROM labelled",
)
ORACLE["p03_batch_plan"] = """WITH kinds AS (SELECT p_type AS category, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS hints,
    row_number() OVER (ORDER BY p_type) - 1 AS pos FROM part GROUP BY p_type)
SELECT CAST(b AS BIGINT) AS batch, category, hints FROM range((SELECT count(*) FROM part)) r(b)
JOIN kinds ON pos = b % (SELECT count(*) FROM kinds)"""
label_query(
    "p04_located_pairs",
    f"SELECT doc_id, term, {_int('s')} AS asp_start, {_int('s + length(term)')} AS asp_end FROM located",
)
TARGETS = f"""{DOCS},
{words_of('docs')},
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM words WHERE length(w) % 4 = 0),
targets AS (SELECT r.doc_id, {_int('min(s)')} AS asp_start, {_int('max(e)')} AS asp_end,
    string_agg(w, ' ' ORDER BY i) AS term, CASE r.doc_id % 4 WHEN 0 THEN '-1' WHEN 1 THEN '0' ELSE '+2' END AS polarity_raw
  FROM runs r WHERE r.doc_id % 4 <> 3 GROUP BY r.doc_id, g)"""
add(
    "p05_token_line_targets",
    """SELECT md5(d.t) AS text_md5, term, asp_start, asp_end, polarity_raw FROM targets t
    JOIN docs d ON d.doc_id = t.doc_id""",
    ctes=TARGETS,
)
add(
    "p06_polarity_map",
    """SELECT CASE polarity_raw WHEN '-1' THEN 'negative' WHEN '0' THEN 'neutral' ELSE 'positive' END AS polarity,
      count(*) AS targets FROM targets GROUP BY 1""",
    ctes=TARGETS,
)
PLACED = """placed AS (SELECT doc_id, text, term, polarity, place AS s FROM second WHERE doc_id % 6 < 3
  UNION ALL SELECT doc_id, text, term, polarity, place2 FROM second WHERE doc_id % 6 < 3
  UNION ALL SELECT doc_id, text, term, polarity, s FROM located WHERE doc_id % 6 = 3)"""
label_query(
    "p07_json_line_examples",
    f"""SELECT md5(text) AS text_md5, term, polarity, {_int('s')} AS asp_start, {_int('s + length(term)')} AS asp_end,
      CASE WHEN doc_id % 6 = 1 THEN 'c' END AS category FROM placed WHERE s IS NOT NULL""",
    PLACED,
)
label_query(
    "p07_json_line_counts",
    """SELECT (SELECT count(*) FROM labelled) AS total_lines,
      (SELECT count(*) FROM labelled WHERE doc_id % 6 = 4) AS json_decode_fail,
      (SELECT count(*) FROM labelled WHERE doc_id % 6 = 5) AS no_matching_key,
      (SELECT count(*) FROM labelled WHERE doc_id % 6 < 4) AS total_examples, 0::BIGINT AS no_text_or_aspects,
      count(*) AS total_aspects, 0::BIGINT AS polarity_invalid, count(*) - count(s) AS term_not_found,
      count(s) AS success FROM placed""",
    PLACED,
)
label_query(
    "p08_non_overlapping",
    f"""SELECT doc_id, term, CASE WHEN s IS NULL THEN 'term_not_found' ELSE 'ok' END AS state, {_int('s')} AS asp_start,
      {_int('s + length(term)')} AS asp_end
    FROM (SELECT doc_id, term, place AS s FROM second UNION ALL SELECT doc_id, term, place2 FROM second)""",
)
label_query(
    "p09_realign",
    f"""SELECT doc_id, term, {_int('s')} AS asp_start, {_int('s + length(term)')} AS asp_end
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, no
        ORDER BY abs(s - (place + 4) / (length(text) + 9)::DOUBLE * length(text)), s) AS rn FROM hits) WHERE rn = 1""",
    """pieces AS (SELECT doc_id, no, text, term, place, unnest(string_split(text, term)) AS piece,
      generate_subscripts(string_split(text, term), 1) AS k FROM labelled),
    hits AS (SELECT doc_id, no, text, term, place, s FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, no ORDER BY k)
        + (k - 1) * length(term) AS s, max(k) OVER (PARTITION BY doc_id, no) AS last FROM pieces) WHERE k < last)""",
)
ORACLE["p10_split_rows"] = """WITH n AS (SELECT lang, count(*) AS n, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS v
  FROM documents GROUP BY lang)
SELECT lang, 'validation' AS split, v AS n FROM n WHERE v > 0 UNION ALL SELECT lang, 'train', n - v FROM n"""
ORACLE["p10_three_parts"] = """WITH h AS (SELECT doc_id, lang, substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS h FROM documents),
held AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) <= floor(count(*) OVER (PARTITION BY lang) * 0.2 + 0.5) AS out FROM h),
cut AS (SELECT *, row_number() OVER (PARTITION BY out ORDER BY h) <= floor(count(*) OVER (PARTITION BY out) * 0.5 + 0.5) AS first FROM held)
SELECT doc_id, lang, CASE WHEN NOT out THEN 'train' WHEN first THEN 'test' ELSE 'validation' END AS split FROM cut"""
label_query(
    "p11_add_extra",
    """SELECT false AS synthetic, 2 * count(*) AS n FROM labelled
    UNION ALL SELECT true, least(count(*), CAST(floor(2 * count(*) * 0.15) AS BIGINT)) FROM labelled""",
)
label_query(
    "p12_label_shares",
    f"""SELECT {_int('doc_id % 3')} AS label_id, count(*) AS count,
      count(*) / (SELECT count(*) FROM labelled)::DOUBLE AS share FROM labelled GROUP BY 1""",
)
PER_REVIEW = "per_review AS (SELECT DISTINCT text, s, s + length(term) AS e FROM located)"
label_query(
    "p13_spans_per_review",
    f"""SELECT md5(text) AS text_md5, {_int('s')} AS "start", {_int('e')} AS "end" FROM per_review""",
    PER_REVIEW,
)
TAGS = f"""{PER_REVIEW},
reviews AS (SELECT DISTINCT text AS doc_id, text AS t FROM per_review),
{words_of('reviews')},
hits AS (SELECT w.doc_id, w.i, min(p.s) AS first FROM words w JOIN per_review p ON p.text = w.doc_id AND w.s >= p.s
  AND w.e <= p.e GROUP BY w.doc_id, w.i),
tags AS (SELECT w.doc_id, w.i, CASE WHEN h.first IS NULL THEN 0 WHEN h.first = w.s THEN 1 ELSE 2 END AS tag
  FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.i = w.i)"""
label_query(
    "p14_tagged_reviews",
    f"""SELECT md5(doc_id) AS text_md5, {_int('count(*)')} AS tokens,
      {_int('count(*) FILTER (WHERE tag = 1)')} AS begins, {_int('count(*) FILTER (WHERE tag = 2)')} AS insides,
      string_agg(CASE tag WHEN 1 THEN 'B' WHEN 2 THEN 'I' ELSE 'O' END, '' ORDER BY i) AS tags
    FROM tags GROUP BY doc_id""",
    TAGS,
)
label_query(
    "p15_class_weights",
    f"""SELECT {_int('doc_id % 3')} AS label_id, count(*) AS count,
      least((SELECT count(*) FROM labelled)::DOUBLE / (count(*) * 3), 15) AS weight FROM labelled GROUP BY 1""",
)
TAGGINGS = f"""{DOCS},
{words_of('docs')},
both_tags AS (SELECT doc_id, i, tag AS t, CASE WHEN (i - 1) % 6 = 0 THEN 0 ELSE tag END AS p FROM (
  SELECT *, CASE length(w) % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE -100 END AS tag FROM words)
  WHERE tag <> -100)"""


def entity_runs(column: str) -> str:
    return f"""{column}_runs AS (SELECT doc_id, min(k) AS a, max(k) AS b FROM (
      SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM (
        SELECT *, CASE WHEN tag = 1 OR (tag = 2 AND coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY k), 0) = 0)
          THEN 1 ELSE 0 END AS begins
        FROM (SELECT doc_id, {column} AS tag, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM both_tags)))
      WHERE tag > 0 GROUP BY doc_id, g)"""


add(
    "p16_entity_scores",
    f"""SELECT hits, true_spans, predicted_spans, {share('hits', 'predicted_spans')} AS precision,
      {share('hits', 'true_spans')} AS recall,
      {share('hits', 'predicted_spans')} * {share('hits', 'true_spans')} * 2
        / ({share('hits', 'predicted_spans')} + {share('hits', 'true_spans')}) AS f1,
      {share('hits', 'predicted_spans')} * {share('hits', 'true_spans')} * 2
        / ({share('hits', 'predicted_spans')} + {share('hits', 'true_spans')}) AS f1_macro
    FROM (SELECT (SELECT count(*) FROM t_runs) AS true_spans, (SELECT count(*) FROM p_runs) AS predicted_spans,
      (SELECT count(*) FROM t_runs JOIN p_runs USING (doc_id, a, b)) AS hits)""",
    ctes=f"{TAGGINGS}, {entity_runs('t')}, {entity_runs('p')}",
)
ORACLE["p17_class_scores"] = f"""WITH x AS (SELECT quality AS t, 1 - toxic AS p FROM labels),
k AS (SELECT c, count(*) FILTER (WHERE t = c) AS support, count(*) FILTER (WHERE p = c) AS called,
  count(*) FILTER (WHERE t = c AND p = c) AS hits FROM x, (SELECT t AS c FROM x UNION SELECT p FROM x) GROUP BY c),
s AS (SELECT *, coalesce({share('hits', 'called')}, 0) AS pr, coalesce({share('hits', 'support')}, 0) AS re FROM k),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM s)
SELECT sum(hits) / sum(support)::DOUBLE AS accuracy, {r6('avg(f1)')} AS f1_macro,
  {r6('sum(f1 * support) / sum(support)')} AS f1_weighted, {r6('avg(pr)')} AS precision_macro,
  {r6('avg(re)')} AS recall_macro FROM f"""
add(
    "p18_tag_distribution",
    f"""SELECT 'true' AS kind, {_int('t')} AS tag, count(*) AS count FROM both_tags GROUP BY t
    UNION ALL SELECT 'predicted', {_int('p')}, count(*) FROM both_tags GROUP BY p""",
    ctes=TAGGINGS,
)
label_query(
    "p19_untagged_reviews",
    """SELECT count(*) FILTER (WHERE top = 0) AS without_aspect, count(*) AS reviews
    FROM (SELECT doc_id, max(tag) AS top FROM tags GROUP BY doc_id)""",
    TAGS,
)
label_query(
    "p19_multi_aspect_reviews",
    """SELECT count(*) FILTER (WHERE n > 1) AS multi_aspect, count(*) AS reviews
    FROM (SELECT text, count(DISTINCT term) AS n FROM labelled GROUP BY text)""",
)

# ---- vectors ------------------------------------------------------------------------

ORACLE["x01_embedding_input"] = "SELECT doc_id, 'passage: ' || text AS text FROM documents"
ORACLE["x02_unit_vectors"] = f"""SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, {r6('x / len')} AS x FROM (
  SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos,
    sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS len FROM embeddings)"""
ORACLE["x03_vector_check"] = """SELECT valid, count(*) AS n FROM (
  SELECT vec_id % 7 NOT IN (1, 2) AND len(embedding) = 64 AS valid FROM embeddings) GROUP BY valid"""
ORACLE["x04_pair_similarity"] = f"""SELECT a.vec_id,
  {r6('list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))')} AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
ORACLE["x05_top_k_cosine"] = f"""WITH sums AS (SELECT label, pos, sum(x) AS x FROM (
    SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos),
centres AS (SELECT label, list(x ORDER BY pos) AS v FROM sums GROUP BY label),
scored AS (SELECT CAST(label AS BIGINT) AS query_id, vec_id AS id,
  list_cosine_similarity(c.v, CAST(e.embedding AS DOUBLE[])) AS cosine FROM centres c, (SELECT vec_id, embedding FROM embeddings) e)
SELECT query_id, id, {r6('cosine')} AS cosine, {_int('rank')} AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM scored) WHERE rank <= 10"""

ORACLE["x05_cell_search"] = f"""WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 13 = 3 THEN NULL ELSE CAST(embedding AS DOUBLE[]) END AS v
  FROM embeddings WHERE vec_id % 13 NOT IN (1, 2) AND vec_id % 17 <> 4),
scored AS (SELECT q.id AS query_id, e.id, coalesce(list_cosine_similarity(q.v, e.v), 0.0) AS cosine FROM v q, v e)
SELECT query_id, id, {r6('cosine')} AS cosine, {_int('rank')} AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM scored) WHERE rank <= 10"""

# ---- stored tables --------------------------------------------------------------------

ORACLE["w03_stored_insert_ignore"] = """SELECT CAST(c_custkey AS BIGINT) AS c_custkey,
  CAST(c_acctbal + c_custkey % 2 AS DOUBLE) AS c_acctbal FROM customer"""
ORACLE["w04_stored_upsert"] = """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(c_acctbal + CASE
  WHEN c_custkey % 5 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS c_acctbal FROM customer
  WHERE c_custkey % 7 <> 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0"""


def in_two_loads(name: str, number: str, kind: str, keys: dict[str, str], source: str, first: str, second: str, more: str = "") -> str:
    """Generated keys: those of the first load come first, in either by key hash."""
    columns = ", ".join(f"{e} AS {k}" for k, e in keys.items())
    return f"""{name} AS (SELECT CAST(row_number() OVER (ORDER BY late, {by_hash(*keys)}) AS {kind}) AS {number}, {', '.join(keys)}
  FROM (SELECT {', '.join(keys)}, min(late) AS late FROM (
    SELECT {columns}, 0 AS late FROM {source} WHERE {first} {more} UNION ALL SELECT {columns}, 1 FROM {source} WHERE {second} {more})
  GROUP BY ALL))"""


_two = ",\n".join((
    """goods2 AS (SELECT * REPLACE (CASE WHEN id % 2 = 1 THEN Brand || ' new' ELSE Brand END AS Brand,
    Price + CASE WHEN id % 4 = 1 THEN Price % 2 ELSE 0 END AS Price,
    CASE WHEN id % 5 <> 0 THEN 'new ' ELSE '' END || title_fa AS title_fa), id % 3 = 0 AS fake FROM catalogue)""",
    in_two_loads("cities2", "city_id", "INTEGER", {"name": "city"}, "shop_log", "log_id % 3 = 0", "true", "AND city IS NOT NULL"),
    in_two_loads("brands2", "brand_id", "INTEGER", {"name": "Brand"}, "goods2", "id % 2 = 0", "id % 5 <> 0", "AND Brand IS NOT NULL"),
    in_two_loads("sellers2", "seller_id", "INTEGER", {"seller_title": "Seller"}, "goods2", "id % 2 = 0", "id % 5 <> 0", "AND Seller IS NOT NULL"),
    in_two_loads("categories2", "category_id", "BIGINT", {"category1": "Category1", "category2": "Category2", "sub_category": "sub_category"},
                 "goods2", "id % 2 = 0", "id % 5 <> 0"),
    """products2 AS (SELECT p.id, p.title_fa, b.brand_id, c.category_id, s.seller_id, p.Price AS price, p.min_price_last_month,
    p.fake AS is_fake, p.Rate AS rate, p.Rate_cnt AS rate_cnt FROM goods2 p LEFT JOIN brands2 b ON b.name = p.Brand
    LEFT JOIN categories2 c ON c.category1 = p.Category1 AND c.category2 = p.Category2 AND c.sub_category IS NOT DISTINCT FROM p.sub_category
    LEFT JOIN sellers2 s ON s.seller_title = p.Seller WHERE p.id % 2 = 0 OR p.id % 5 <> 0)""",
    """sold1 AS (SELECT id FROM goods2 WHERE id % 2 = 0)""",
    """comments2 AS (SELECT id, product_id, true AS is_buyer, rate, lang AS recommendation_status,
    CAST(coalesce(likes + CASE WHEN id % 4 = 0 THEN likes % 2 ELSE 0 END, 0) AS INTEGER) AS likes,
    CAST(coalesce(dislikes + CASE WHEN id % 5 <> 0 THEN 1 ELSE 0 END, 0) AS INTEGER) AS dislikes, source AS raw_text_normalized,
    epoch_us(TIMESTAMP '2024-03-01') AS created_at FROM wh_comment
    WHERE (id % 2 = 0 AND product_id IN (SELECT id FROM sold1)) OR (id % 5 <> 0 AND product_id IN (SELECT id FROM products2)))""",
))


def from_two_loads(name: str, body: str, ctes: str = "") -> None:
    from_raw(name, body, f"{_two}{', ' if ctes else ''}{ctes}")


from_two_loads("w01_second_load", "SELECT DISTINCT user_id FROM shop_log WHERE user_id IS NOT NULL")
from_two_loads("w05_second_load", "SELECT * FROM cities2")
from_two_loads("w06_second_load", "SELECT * FROM brands2")
from_two_loads("w07_second_load", "SELECT * FROM categories2")
from_two_loads(
    "w09_second_load",
    """SELECT session_id, min(user_id) AS user_id, min(city_id) AS city_id
    FROM shop_log l LEFT JOIN cities2 c ON c.name = l.city GROUP BY session_id""",
)
from_two_loads("w10_second_load", "SELECT * FROM products2")
from_two_loads(
    "w11_second_load", "SELECT * FROM logs2",
    in_two_loads(
        "logs2", "log_id", "BIGINT",
        {"session_id": "session_id", "product_id": "product_id", "event_type": "event_type", "timestamp": "epoch_us(timestamp)"},
        "shop_log", "log_id % 3 = 0 AND product_id IN (SELECT id FROM sold1)", "product_id IN (SELECT id FROM products2)"),
)
from_two_loads("w12_second_load", "SELECT * FROM comments2")
_place = "CAST(row_number() OVER (PARTITION BY comment_id ORDER BY aspect_id) AS INTEGER) - 1"
from_two_loads(
    "w13_second_load",
    """SELECT k.aspect_id, k.comment_id, k.pos, nullif(trim(a.term), '') AS term, nullif(trim(a.sentiment), '') AS sentiment,
      a.negative_pct, a.neutral_pct, a.positive_pct FROM aspects2 k JOIN places a ON a.comment_id = k.comment_id AND a.pos = k.pos""",
    f"""places AS (SELECT *, {_place} AS pos FROM wh_aspect),
  """ + in_two_loads(
        "aspects2", "aspect_id", "BIGINT", {"comment_id": "comment_id", "pos": "pos"}, "places",
        "comment_id % 2 = 0 AND comment_id IN (SELECT id FROM wh_comment WHERE product_id IN (SELECT id FROM sold1))",
        "comment_id % 5 <> 0 AND comment_id IN (SELECT id FROM comments2)"),
)
from_two_loads(
    "w14_second_load",
    """SELECT vec_id AS id, CAST(pos - 1 AS INTEGER) AS pos, x FROM (
      SELECT vec_id, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * CASE WHEN first THEN 1 ELSE 2 END)) AS x,
        generate_subscripts(embedding, 1) AS pos
      FROM (SELECT *, vec_id % 2 = 0 AND vec_id IN (SELECT id FROM wh_comment WHERE id % 2 = 0 AND product_id IN (SELECT id FROM sold1)) AS first
        FROM embeddings) WHERE vec_id IN (SELECT id FROM comments2))""",
)
from_raw(
    "w11_incomplete_events",
    f"""SELECT row_number() OVER (ORDER BY {by_hash('session_id', 'product_id', 'event_type', 'timestamp')}) AS log_id, *
    FROM (SELECT DISTINCT session_id, product_id, CASE WHEN log_id % 5 <> 0 THEN event_type END AS event_type,
      CASE WHEN log_id % 7 <> 0 THEN epoch_us(timestamp) END AS timestamp FROM shop_log
      WHERE product_id IN (SELECT id FROM wh_product))""",
)
