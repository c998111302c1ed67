"""One DuckDB statement per registered query, over the plain star tables.

Every statement starts with the tables it needs, each a common table expression, and ends with the
question. The SQL deliberately takes the direct route (full windows, plain NTILE, distinct counts)
so that it checks the distributed versions rather than repeating them.
"""

from __future__ import annotations

NUMERIC = "DECIMAL(38, 9)"


def _money(expr: str, digits: int = 4) -> str:
    return f"CAST(ROUND({expr}, {digits}) AS DOUBLE)"


def _ratio(top: str, bottom: str, digits: int, scale: int = 1) -> str:
    return f"ROUND({scale}.0 * CAST({top} AS DOUBLE) / NULLIF(CAST({bottom} AS DOUBLE), 0), {digits})"


def _int(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


LINES = """
lines AS (
  SELECT
    CASE WHEN o_orderkey % 50 = 0 OR o_custkey % 75 = 6 THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS invoice,
    CASE WHEN l_partkey % 100 = 0 OR o_custkey % 75 = 5 THEN 'POST'
         WHEN l_partkey % 100 = 33 THEN 'DOT'
         WHEN l_partkey % 100 = 66 THEN 'M'
         ELSE lpad(CAST(l_partkey AS VARCHAR), greatest(5, length(CAST(l_partkey AS VARCHAR)))::INTEGER, '0')
              || CASE WHEN l_partkey % 3 = 0 THEN 'A' ELSE '' END
    END AS stock_code,
    CASE WHEN o_orderkey % 250 = 0 THEN NULL
         WHEN o_orderkey % 251 = 0 THEN '  '
         WHEN l_linenumber = 7 THEN upper(p_name)
         ELSE p_name END AS description,
    CAST(CASE WHEN o_orderkey % 50 = 0 OR o_custkey % 75 = 6 OR (l_orderkey * 7 + l_linenumber) % 300 = 0
              THEN -l_quantity ELSE l_quantity END AS BIGINT) AS quantity,
    CAST(o_orderdate AS TIMESTAMP) AS invoice_date,
    CASE WHEN (l_orderkey + l_partkey) % 170 = 0 THEN CAST(0 AS DOUBLE)
         ELSE floor(l_extendedprice / l_quantity * 100) / CAST(100 AS DOUBLE) END AS price,
    CASE WHEN o_orderkey % 4 = 3 THEN NULL
         ELSE CASE WHEN o_custkey % 75 = 7 THEN 'X' ELSE '' END || CAST(o_custkey AS VARCHAR) || '.0' END AS source_id,
    CASE WHEN o_orderkey % 500 = 1 THEN '' ELSE n_name END AS country,
    l_orderkey * 10 + l_linenumber AS source_row
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""

SHEETS = """
sheets AS (
  SELECT 'A' AS sheet, * FROM lines WHERE invoice_date < TIMESTAMP '1998-07-01'
  UNION ALL
  SELECT 'B' AS sheet, * REPLACE (
    CASE WHEN invoice_date < TIMESTAMP '1998-07-01' THEN description || ' (2)' ELSE description END AS description)
  FROM lines WHERE invoice_date >= TIMESTAMP '1998-06-01'
)"""

RAW = """
landed AS (
  SELECT * EXCLUDE (source_id), regexp_replace(nullif(trim(source_id), ''), '[.]0$', '') AS customer_id FROM sheets
),
raw AS (
  SELECT invoice, stock_code, description, quantity, invoice_date, price, customer_id, country,
         'lineitem.parquet' AS _source_file, sheet AS _source_sheet, source_row AS _source_row,
         TIMESTAMP '2001-08-02 00:00:00' AS _loaded_at,
         md5(invoice || '|' || stock_code || '|' || quantity || '|' || strftime(invoice_date, '%Y-%m-%d %H:%M:%S')
             || '|' || printf('%.4f', price) || '|' || coalesce(customer_id, '')) AS _record_hash
  FROM landed
)"""

KEPT = """
kept AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (
        PARTITION BY _record_hash
        ORDER BY _source_sheet, _source_row, _source_file, description NULLS FIRST, country NULLS FIRST,
                 price NULLS FIRST) AS place
    FROM raw) AS ranked
  WHERE place = 1
)"""

STG = f"""
flags AS (
  SELECT *, left(invoice, 1) = 'C' AS is_cancellation, quantity <= 0 AS is_return_or_zero,
         price <= 0 AS is_nonpositive_price, TRY_CAST(left(stock_code, 5) AS BIGINT) IS NULL AS is_service_line,
         customer_id IS NOT NULL AS has_customer
  FROM kept
),
stg AS (
  SELECT _record_hash AS line_sk, invoice AS invoice_no, stock_code,
         CASE WHEN trim(coalesce(description, '')) = '' THEN 'UNKNOWN' ELSE trim(description) END AS description,
         quantity, CAST(price AS {NUMERIC}) AS unit_price, CAST(quantity * price AS {NUMERIC}) AS line_revenue,
         invoice_date AS invoice_ts, CAST(invoice_date AS DATE) AS invoice_date,
         TRY_CAST(customer_id AS BIGINT) AS customer_id,
         CASE WHEN trim(coalesce(country, '')) = '' THEN 'Unspecified' ELSE trim(country) END AS country,
         is_cancellation, is_return_or_zero, is_nonpositive_price, is_service_line, has_customer,
         has_customer AND NOT (is_cancellation OR is_return_or_zero OR is_nonpositive_price OR is_service_line)
           AS is_valid_sale,
         _source_file AS source_file, _loaded_at AS loaded_at
  FROM flags
)"""


def _dim_customer(name: str = "dim_customer", condition: str = "TRUE") -> str:
    return f"""
{name}_lines AS (SELECT * FROM stg WHERE customer_id IS NOT NULL AND {condition}),
{name}_country AS (
  SELECT customer_id, country,
         row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, country) AS place
  FROM {name}_lines GROUP BY customer_id, country
),
{name}_value AS (
  SELECT customer_id,
         min(invoice_date) FILTER (WHERE NOT is_service_line) AS first_purchase_date,
         max(invoice_date) FILTER (WHERE NOT is_service_line) AS last_purchase_date,
         count(DISTINCT invoice_no) FILTER (WHERE NOT is_service_line) AS lifetime_orders,
         coalesce(sum(line_revenue) FILTER (WHERE NOT is_service_line), 0) AS lifetime_net_revenue
  FROM {name}_lines GROUP BY customer_id
),
{name} AS (
  SELECT md5(CAST(v.customer_id AS VARCHAR)) AS customer_sk, v.customer_id, c.country AS primary_country,
         v.first_purchase_date, v.last_purchase_date, v.lifetime_orders, v.lifetime_net_revenue
  FROM {name}_value v JOIN {name}_country c ON c.customer_id = v.customer_id AND c.place = 1
)"""


DIM_CUSTOMER = _dim_customer()

DIM_PRODUCT = """
product_text AS (
  SELECT stock_code, description,
         row_number() OVER (PARTITION BY stock_code ORDER BY count(*) DESC, description) AS place
  FROM stg WHERE description <> 'UNKNOWN' GROUP BY stock_code, description
),
dim_product AS (
  SELECT md5(s.stock_code) AS product_sk, s.stock_code, coalesce(max(t.description), 'UNKNOWN') AS description,
         bool_or(s.is_service_line) AS is_service_line,
         min(s.invoice_date) AS first_seen_date, max(s.invoice_date) AS last_seen_date
  FROM stg s LEFT JOIN product_text t ON t.stock_code = s.stock_code AND t.place = 1
  GROUP BY s.stock_code
)"""

FCT_SALES = """
fct_sales AS (
  SELECT line_sk, invoice_no, md5(CAST(customer_id AS VARCHAR)) AS customer_sk, md5(stock_code) AS product_sk,
         invoice_date, invoice_ts, quantity, unit_price, line_revenue, is_cancellation, is_service_line, has_customer
  FROM stg
)"""

FCT_ORDERS = """
fct_orders AS (
  SELECT invoice_no, max(md5(CAST(customer_id AS VARCHAR))) AS customer_sk, min(invoice_date) AS invoice_date,
         min(invoice_ts) AS invoice_ts, min(country) AS country, count(*) AS n_lines,
         CAST(sum(quantity) AS BIGINT) AS n_units, sum(line_revenue) AS order_revenue,
         bool_or(is_cancellation) AS is_cancellation
  FROM stg GROUP BY invoice_no
)"""


def _rfm(name: str = "rfm", customers: str = "dim_customer", as_of: str | None = None) -> str:
    day = as_of or f"(SELECT max(last_purchase_date) + 1 FROM {customers})"
    return f"""
{name}_buyers AS (
  SELECT customer_sk, customer_id, primary_country, {day} - last_purchase_date AS recency_days,
         lifetime_orders AS frequency, lifetime_net_revenue AS monetary
  FROM {customers} WHERE lifetime_orders > 0 AND lifetime_net_revenue > 0
),
{name}_scores AS (
  SELECT *, 6 - ntile(5) OVER (ORDER BY recency_days, customer_sk) AS r,
         ntile(5) OVER (ORDER BY frequency, customer_sk) AS f, ntile(5) OVER (ORDER BY monetary, customer_sk) AS m
  FROM {name}_buyers
),
{name} AS (
  SELECT *, CASE WHEN r IN (4, 5) THEN CASE WHEN f < 3 THEN 'New / Promising' WHEN f = 3 THEN 'Loyal'
                                            ELSE 'Champions' END
                 WHEN r = 3 THEN CASE WHEN f < 3 THEN 'Potential Loyalist' ELSE 'Loyal' END
                 WHEN r = 2 THEN CASE WHEN f < 3 THEN 'Hibernating' ELSE 'At Risk' END
                 ELSE CASE WHEN f < 3 THEN 'Lost' WHEN f = 3 THEN 'At Risk' ELSE 'Cannot Lose Them' END
            END AS segment
  FROM {name}_scores
)"""


RFM = _rfm()

_TO_RAW = [LINES, SHEETS, RAW]
_TO_STG = [*_TO_RAW, KEPT, STG]
_TO_SALES = [*_TO_STG, FCT_SALES]
_TO_ORDERS = [*_TO_STG, FCT_ORDERS]
_TO_CUSTOMER = [*_TO_STG, DIM_CUSTOMER]
_TO_RFM = [*_TO_CUSTOMER, RFM]
_ALL = [*_TO_STG, DIM_CUSTOMER, DIM_PRODUCT, FCT_SALES, FCT_ORDERS, RFM]


def _statement(tables: list[str], question: str) -> str:
    """``question`` may open with ``,`` to add tables of its own."""
    return "WITH " + ",".join(tables) + "\n" + question.strip()


STATEMENTS: dict[str, str] = {}

# ----------------------------------------------------------------- landing and staging

STATEMENTS["ingest_raw"] = _statement(_TO_RAW, "SELECT * FROM raw")

# Sheets from files: every 997th source row has a timestamp that is none.
_FILES = [
    LINES,
    SHEETS.replace("sheets AS", "whole AS"),
    """
sheets AS (
  SELECT * REPLACE (CASE WHEN source_row % 997 = 0 THEN NULL ELSE invoice_date END AS invoice_date) FROM whole
)""",
    RAW.replace("strftime(invoice_date, '%Y-%m-%d %H:%M:%S')", "coalesce(strftime(invoice_date, '%Y-%m-%d %H:%M:%S'), '')"),
]
STATEMENTS["ingest_parquet_sheets"] = _statement(_FILES, "SELECT * EXCLUDE (_source_file, _source_row) FROM raw")
# An empty CSV field is NULL.
STATEMENTS["ingest_csv_sheets"] = _statement(
    _FILES,
    "SELECT * EXCLUDE (_source_file, _source_row) REPLACE (nullif(country, '') AS country) FROM raw",
)

# Every fifth source row has a line break in its text; the text is no part of the hash.
STATEMENTS["ingest_multiline_sheets"] = _statement(
    [
        _FILES[0],
        _FILES[1],
        _FILES[2].replace(
            " AS invoice_date)",
            " AS invoice_date, CASE WHEN source_row % 5 = 0 THEN replace(description, ' ', chr(10)) ELSE description END AS description)",
        ),
        _FILES[3],
    ],
    "SELECT * EXCLUDE (_source_file, _source_row) REPLACE (nullif(country, '') AS country) FROM raw",
)

STATEMENTS["clean_customer_id"] = _statement(
    [LINES, SHEETS],
    """
SELECT source_id, CASE WHEN right(source_id, 2) = '.0' THEN left(source_id, length(source_id) - 2)
                       ELSE source_id END AS customer_id, count(*) AS n_lines
FROM sheets GROUP BY source_id""",
)

STATEMENTS["record_hash"] = _statement(_TO_RAW, "SELECT _source_sheet, _source_row, _record_hash FROM raw")

STATEMENTS["dedup_lines"] = _statement(
    [*_TO_RAW, KEPT], "SELECT _record_hash, _source_sheet, _source_row, description FROM kept"
)

STATEMENTS["stg_lines"] = _statement(
    _TO_STG,
    f"""
SELECT * REPLACE ({_money('unit_price')} AS unit_price, {_money('line_revenue')} AS line_revenue) FROM stg""",
)

STATEMENTS["line_flags"] = _statement(
    _TO_STG,
    f"""
SELECT is_cancellation, is_return_or_zero, is_nonpositive_price, is_service_line, has_customer, is_valid_sale,
       count(*) AS n_lines, {_money('sum(line_revenue)')} AS revenue
FROM stg GROUP BY ALL""",
)

# ----------------------------------------------------------------- models

STATEMENTS["dim_customer"] = _statement(
    _TO_CUSTOMER,
    f"SELECT * REPLACE ({_money('lifetime_net_revenue')} AS lifetime_net_revenue) FROM dim_customer",
)

STATEMENTS["dim_product"] = _statement([*_TO_STG, DIM_PRODUCT], "SELECT * FROM dim_product")

STATEMENTS["fct_sales"] = _statement(
    _TO_SALES,
    f"""
SELECT * REPLACE ({_money('unit_price')} AS unit_price, {_money('line_revenue')} AS line_revenue) FROM fct_sales""",
)

STATEMENTS["fct_orders"] = _statement(
    _TO_ORDERS, f"SELECT * REPLACE ({_money('order_revenue')} AS order_revenue) FROM fct_orders"
)

_RFM_COLUMNS = f"""customer_sk, customer_id, primary_country, {_int('recency_days')} AS recency_days,
       {_int('frequency')} AS frequency, {_money('monetary')} AS monetary,
       {_int('r')} AS r, {_int('f')} AS f, {_int('m')} AS m, segment"""

STATEMENTS["rfm"] = _statement(_TO_RFM, f"SELECT {_RFM_COLUMNS} FROM rfm")

# ----------------------------------------------------------------- questions

STATEMENTS["q1_top_customers"] = _statement(
    _TO_CUSTOMER,
    f"""
SELECT customer_id, primary_country, lifetime_orders, {_money('lifetime_net_revenue', 2)} AS net_revenue_gbp
FROM dim_customer ORDER BY lifetime_net_revenue DESC, customer_id LIMIT 10""",
)

STATEMENTS["q2_monthly_revenue"] = _statement(
    _TO_SALES,
    f"""
SELECT strftime(invoice_date, '%Y-%m') AS month, count(DISTINCT invoice_no) AS orders,
       count(DISTINCT customer_sk) AS active_customers, {_money('sum(line_revenue)', 2)} AS net_revenue_gbp
FROM fct_sales WHERE NOT is_service_line GROUP BY 1""",
)

STATEMENTS["monthly_trend"] = _statement(
    _TO_SALES,
    f"""
SELECT strftime(invoice_date, '%Y-%m') AS month, {_money('sum(line_revenue)')} AS net_revenue
FROM fct_sales WHERE NOT is_service_line GROUP BY 1""",
)

STATEMENTS["q3_outlier_orders"] = _statement(
    _TO_ORDERS,
    f"""
SELECT invoice_no, customer_sk, invoice_date, {_money('order_revenue', 2)} AS order_revenue_gbp, z_score
FROM (
  SELECT *, (CAST(order_revenue AS DOUBLE) - avg(CAST(order_revenue AS DOUBLE)) OVER ())
            / nullif(stddev_samp(CAST(order_revenue AS DOUBLE)) OVER (), 0) AS z,
         round(z, 2) AS z_score
  FROM fct_orders WHERE order_revenue > 0 AND NOT is_cancellation) AS scored
WHERE z > 3 ORDER BY z_score DESC, invoice_no LIMIT 20""",
)

STATEMENTS["q4_country_revenue"] = _statement(
    _TO_ORDERS,
    f"""
SELECT country, count(DISTINCT invoice_no) AS orders, count(DISTINCT customer_sk) AS customers,
       {_money('sum(order_revenue)', 2)} AS net_revenue_gbp,
       {_ratio('sum(order_revenue)', '(SELECT sum(order_revenue) FROM fct_orders WHERE NOT is_cancellation)', 2, 100)}
         AS pct_of_total
FROM fct_orders WHERE NOT is_cancellation GROUP BY country ORDER BY net_revenue_gbp DESC, country LIMIT 15""",
)

STATEMENTS["geo_top_k"] = _statement(
    _TO_ORDERS,
    f"""
SELECT country, count(DISTINCT invoice_no) AS orders, {_money('sum(order_revenue)', 0)} AS net_revenue
FROM fct_orders WHERE NOT is_cancellation GROUP BY country ORDER BY net_revenue DESC, country LIMIT 12""",
)

STATEMENTS["q5_top_products"] = _statement(
    [*_TO_STG, DIM_PRODUCT, FCT_SALES],
    f"""
, period AS (
  SELECT p.description, f.line_revenue FROM fct_sales f JOIN dim_product p ON p.product_sk = f.product_sk
  WHERE f.invoice_date >= DATE '2001-01-01' AND NOT f.is_service_line)
SELECT description, {_money('sum(line_revenue)', 2)} AS net_revenue_gbp,
       {_ratio('sum(line_revenue)', '(SELECT sum(line_revenue) FROM period)', 2, 100)} AS pct_of_period_revenue
FROM period GROUP BY description ORDER BY net_revenue_gbp DESC, description LIMIT 10""",
)

STATEMENTS["top_products_all_time"] = _statement(
    [*_TO_STG, DIM_PRODUCT, FCT_SALES],
    f"""
SELECT p.description, {_money('sum(f.line_revenue)', 0)} AS net_revenue
FROM fct_sales f JOIN dim_product p ON p.product_sk = f.product_sk
WHERE NOT f.is_service_line GROUP BY p.description ORDER BY net_revenue DESC, p.description LIMIT 10""",
)

_SEGMENT_AVERAGES = f"""{_ratio('sum(recency_days)', 'count(*)', 0)} AS avg_recency_days,
       {_ratio('sum(frequency)', 'count(*)', 1)} AS avg_orders"""

STATEMENTS["rfm_segments"] = _statement(
    _TO_RFM,
    f"""
SELECT segment, count(*) AS customers, {_SEGMENT_AVERAGES},
       {_ratio('sum(monetary)', 'count(*)', 0)} AS avg_net_revenue,
       {_money('sum(monetary)', 0)} AS total_net_revenue,
       {_ratio('sum(monetary)', '(SELECT sum(monetary) FROM rfm)', 1, 100)} AS pct_revenue
FROM rfm GROUP BY segment""",
)

STATEMENTS["explorer_segments"] = _statement(
    _TO_RFM,
    f"""
SELECT segment, count(*) AS customers, {_money('sum(monetary)', 0)} AS net_revenue, {_SEGMENT_AVERAGES}
FROM rfm GROUP BY segment""",
)

STATEMENTS["headline_totals"] = _statement(
    _ALL,
    f"""
SELECT (SELECT max(last_purchase_date) FROM dim_customer) AS as_of_last_purchase,
       (SELECT count(*) FROM dim_customer) AS known_customers,
       (SELECT count(*) FROM rfm) AS purchasing_customers,
       {_money('sum(line_revenue)', 0)} AS net_product_revenue,
       {_money('sum(line_revenue) FILTER (WHERE has_customer)', 0)} AS attributable_revenue,
       {_money('sum(line_revenue) FILTER (WHERE NOT has_customer)', 0)} AS guest_revenue
FROM fct_sales WHERE NOT is_service_line""",
)

STATEMENTS["repeat_rate"] = _statement(
    _TO_CUSTOMER,
    f"""
SELECT count(*) AS buyers, count(*) FILTER (WHERE lifetime_orders >= 2) AS repeat_buyers,
       {_ratio('count(*) FILTER (WHERE lifetime_orders >= 2)', 'count(*)', 1, 100)} AS repeat_rate_pct
FROM dim_customer WHERE lifetime_orders > 0""",
)

STATEMENTS["pareto_top20"] = _statement(
    _TO_RFM,
    f"""
SELECT {_ratio('sum(monetary) FILTER (WHERE fifth = 1)', 'sum(monetary)', 1, 100)} AS top20pct_revenue_share
FROM (SELECT monetary, ntile(5) OVER (ORDER BY monetary DESC, customer_sk) AS fifth FROM rfm) AS ranked""",
)

_TARGETED = "segment IN ('At Risk', 'Cannot Lose Them')"

STATEMENTS["winback_target"] = _statement(
    _TO_RFM,
    f"""
SELECT count(*) AS customers, {_ratio('sum(monetary)', 'count(*)', 0)} AS avg_net_revenue,
       {_money('sum(monetary)', 0)} AS total_hist_revenue, {_SEGMENT_AVERAGES}
FROM rfm WHERE {_TARGETED}""",
)

STATEMENTS["kpi_row"] = _statement(
    _ALL,
    f"""
SELECT (SELECT count(*) FROM dim_customer) AS customers,
       (SELECT count(*) FROM fct_orders WHERE NOT is_cancellation) AS orders,
       (SELECT {_money('sum(line_revenue)')} FROM fct_sales WHERE NOT is_service_line) AS net_revenue""",
)

STATEMENTS["order_count_distribution"] = _statement(
    _TO_CUSTOMER,
    f"""
SELECT lifetime_orders, count(*) AS customers,
       {_ratio('count(*)', '(SELECT count(*) FROM dim_customer WHERE lifetime_orders > 0)', 2, 100)} AS pct_of_buyers
FROM dim_customer WHERE lifetime_orders > 0 GROUP BY lifetime_orders""",
)

# ----------------------------------------------------------------- data quality

STATEMENTS["dq_assertions"] = _statement(
    _ALL,
    """
, numbers AS (
  SELECT 'staging rows equal distinct raw lines' AS "check", (SELECT count(*) FROM stg) AS observed,
         (SELECT count(DISTINCT _record_hash) FROM raw) AS expected
  UNION ALL SELECT 'fct_sales rows equal staging rows', (SELECT count(*) FROM fct_sales), (SELECT count(*) FROM stg)
  UNION ALL SELECT 'fct_sales has no NULL product_sk', (SELECT count(*) FROM fct_sales WHERE product_sk IS NULL), 0
  UNION ALL SELECT 'dim_customer.customer_sk is unique', (SELECT count(*) FROM dim_customer),
                   (SELECT count(DISTINCT customer_sk) FROM dim_customer)
  UNION ALL SELECT 'fct_sales products exist in dim_product',
                   (SELECT count(*) FROM fct_sales f WHERE NOT EXISTS
                      (SELECT 1 FROM dim_product p WHERE p.product_sk = f.product_sk)), 0
  UNION ALL SELECT 'fct_sales customers exist in dim_customer',
                   (SELECT count(*) FROM fct_sales f WHERE customer_sk IS NOT NULL AND NOT EXISTS
                      (SELECT 1 FROM dim_customer c WHERE c.customer_sk = f.customer_sk)), 0)
SELECT "check", observed, expected, observed = expected AS passed FROM numbers""",
)

# Guarded columns (fixed values).
_NOT_NULL = {
    "stg": ["line_sk", "invoice_no", "stock_code", "is_service_line", "has_customer", "is_valid_sale"],
    "dim_customer": ["customer_sk", "customer_id"],
    "dim_product": ["product_sk", "stock_code", "is_service_line"],
    "fct_sales": ["line_sk", "product_sk"],
    "fct_orders": ["invoice_no"],
}
_UNIQUE = {
    "stg": ["line_sk"],
    "dim_customer": ["customer_sk", "customer_id"],
    "dim_product": ["product_sk", "stock_code"],
    "fct_sales": ["line_sk"],
    "fct_orders": ["invoice_no"],
}


def _per_column(guarded: dict[str, list[str]], row: str) -> str:
    return " UNION ALL ".join(row.format(t=t, c=c) for t, columns in guarded.items() for c in columns)


STATEMENTS["dq_not_null"] = _statement(
    _ALL,
    "SELECT *, nulls = 0 AS passed FROM ("
    + _per_column(
        _NOT_NULL,
        "SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS nulls FROM {t}",
    )
    + ") AS counted",
)

STATEMENTS["dq_unique"] = _statement(
    _ALL,
    "SELECT *, repeated = 0 AS passed FROM ("
    + _per_column(
        _UNIQUE,
        "SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS repeated FROM "
        "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1) AS copies",
    )
    + ") AS counted",
)

STATEMENTS["dq_relationships"] = _statement(
    _ALL,
    """
SELECT *, orphans = 0 AS passed FROM (
  SELECT 'fct_sales' AS child, 'dim_product' AS parent, 'product_sk' AS "key", count(*) AS orphans
  FROM fct_sales f LEFT JOIN dim_product p ON p.product_sk = f.product_sk
  WHERE f.product_sk IS NOT NULL AND p.product_sk IS NULL
  UNION ALL
  SELECT 'fct_sales', 'dim_customer', 'customer_sk', count(*)
  FROM fct_sales f LEFT JOIN dim_customer c ON c.customer_sk = f.customer_sk
  WHERE f.customer_sk IS NOT NULL AND c.customer_sk IS NULL) AS counted""",
)

STATEMENTS["dq_freshness"] = _statement(
    _TO_RAW,
    """
SELECT max_loaded_at, age_hours,
       CASE WHEN age_hours <= 36 THEN 'pass' WHEN age_hours <= 72 THEN 'warn' ELSE 'error' END AS status
FROM (SELECT max(_loaded_at) AS max_loaded_at,
             round(date_diff('second', max(_loaded_at), TIMESTAMP '2001-08-03 18:00:00') / 3600.0, 2)::DOUBLE AS age_hours
      FROM raw) AS aged""",
)

_LOADS_BY = f"""
loads AS (
  SELECT {{}} AS load, count(*) AS n_rows,
         count(*) FILTER (WHERE customer_id IS NULL) AS n_null_ids,
         sum(CAST(quantity * price AS {NUMERIC})) AS revenue, max(CAST(invoice_date AS DATE)) AS max_invoice_date
  FROM raw GROUP BY 1
)"""
_LOADS = _LOADS_BY.format("strftime(invoice_date, '%Y-%m')")

_VOLUME = """
SELECT load, n_rows, round(mean, 2) AS baseline_rows, in_band, max_invoice_date, advanced,
       in_band AND advanced AS passed
FROM (
  SELECT *, coalesce(n_rows BETWEEN 0.5 * mean AND 1.5 * mean, TRUE) AS in_band,
         coalesce(max_invoice_date > before, TRUE) AS advanced
  FROM (SELECT *, avg(n_rows) OVER (ORDER BY load ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS mean,
               max(max_invoice_date) OVER (ORDER BY load ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM loads) AS trailed) AS judged"""

STATEMENTS["dq_volume"] = _statement([*_TO_RAW, _LOADS], _VOLUME)
STATEMENTS["dq_volume_by_sheet"] = _statement([*_TO_RAW, _LOADS_BY.format("_source_sheet")], _VOLUME)

STATEMENTS["dq_null_rate"] = _statement(
    _TO_RAW,
    "SELECT *, abs(observed - expected) <= tolerance AS passed FROM ("
    + " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, {_ratio(f'count(*) FILTER (WHERE {defect})', 'count(*)', 6)} AS observed, "
        f"CAST({usual} AS DOUBLE) AS expected, CAST({stray} AS DOUBLE) AS tolerance FROM raw"
        for metric, defect, usual, stray in [
            ("null_customer_id", "customer_id IS NULL", 0.23, 0.05),
            ("null_price", "price IS NULL", 0, 0),
            ("null_quantity", "quantity IS NULL", 0, 0),
            ("nonpositive_price", "price <= 0", 0.006, 0.005),
            ("nonpositive_quantity", "quantity <= 0", 0.022, 0.02),
        ]
    )
    + ") AS rates",
)

STATEMENTS["dq_metric_anomaly"] = _statement(
    [*_TO_RAW, _LOADS],
    """
, metrics AS (
  SELECT 'n_rows' AS metric, load, CAST(n_rows AS DOUBLE) AS v FROM loads
  UNION ALL SELECT 'null_id_rate', load, CAST(n_null_ids AS DOUBLE) / n_rows FROM loads
  UNION ALL SELECT 'revenue', load, CAST(revenue AS DOUBLE) FROM loads)
SELECT metric, load, round(v, 4) AS value, z_score, coalesce(abs(z_score) > 3, FALSE) AS anomalous
FROM (SELECT *, round((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 2) AS z_score FROM metrics
      WINDOW w AS (PARTITION BY metric ORDER BY load ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS scored""",
)

STATEMENTS["dq_load_history"] = _statement(
    _TO_RAW,
    """
, years AS (
  SELECT strftime(invoice_date, '%Y') AS load, CAST(count(*) AS DOUBLE) AS n,
         CAST(count(*) FILTER (WHERE customer_id IS NULL) AS DOUBLE) AS no_id,
         CAST(count(*) FILTER (WHERE price <= 0) AS DOUBLE) AS no_price,
         CAST(sum(CAST(quantity * price AS DECIMAL(38, 9))) AS DOUBLE) AS revenue
  FROM raw GROUP BY 1),
metrics AS (
  SELECT load, 'n_rows' AS metric, n AS v FROM years
  UNION ALL SELECT load, 'null_id_rate', no_id / n FROM years
  UNION ALL SELECT load, 'nonpositive_price_rate', no_price / n FROM years
  UNION ALL SELECT load, 'revenue', revenue FROM years),
scored AS (
  SELECT *, count(v) OVER w AS known, (v - avg(v) OVER w) AS off, stddev_samp(v) OVER w AS sd FROM metrics
  WINDOW w AS (PARTITION BY metric ORDER BY load ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT load, metric, round(v, 4) AS value, CASE WHEN known >= 2 THEN round(off / nullif(sd, 0), 2) END AS z_score,
       coalesce(known >= 2 AND (abs(off / nullif(sd, 0)) > 3 OR (sd = 0 AND off <> 0)), FALSE) AS anomalous
FROM scored""",
)

_KIND = """CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
              WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'timestamp' END"""

STATEMENTS["dq_schema_drift"] = _statement(
    _TO_RAW,
    f"""
, changed AS (
  SELECT quantity, * EXCLUDE (quantity, price, country), CAST(price AS VARCHAR) AS price, upper(country) AS region FROM raw),
one AS (SELECT row_number() OVER () AS at, column_name AS c, {_KIND} AS kind FROM (DESCRIBE SELECT * FROM raw)),
two AS (SELECT row_number() OVER () AS at, column_name AS c, {_KIND} AS kind FROM (DESCRIBE SELECT * FROM changed)),
compared AS (
  SELECT '2' AS load, c, one.at AS was_at, one.kind AS was, two.at AS is_at, two.kind AS is_now FROM one FULL JOIN two USING (c)
  UNION ALL
  SELECT '3', c, two.at, two.kind, one.at, one.kind FROM one FULL JOIN two USING (c)),
shared AS (
  SELECT load, c, row_number() OVER (PARTITION BY load ORDER BY was_at) AS was_nth,
         row_number() OVER (PARTITION BY load ORDER BY is_at) AS is_nth
  FROM compared WHERE was IS NOT NULL AND is_now IS NOT NULL)
SELECT load, c AS column_name, 'added as ' || is_now AS problem FROM compared WHERE was IS NULL
UNION ALL SELECT load, c, 'missing, was ' || was FROM compared WHERE is_now IS NULL
UNION ALL SELECT load, c, 'type ' || was || ' became ' || is_now FROM compared WHERE was <> is_now
UNION ALL SELECT load, c, 'place ' || was_nth || ' became ' || is_nth FROM shared WHERE was_nth <> is_nth""",
)

STATEMENTS["dq_schema_contract"] = _statement(
    _ALL,
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, {_int(columns)} AS n_columns, count(*) AS n_rows, '' AS problems, "
        f"TRUE AS passed FROM {table}"
        for table, columns in [
            ("raw", 13),
            ("stg", 19),
            ("dim_customer", 7),
            ("dim_product", 6),
            ("fct_sales", 12),
            ("fct_orders", 9),
            ("rfm", 10),
        ]
    ),
)

STATEMENTS["dq_profile"] = _statement(
    _TO_RAW,
    """
SELECT count(*) FILTER (WHERE customer_id IS NULL) AS null_customer_id,
       count(*) FILTER (WHERE invoice LIKE 'C%') AS cancellations,
       count(*) FILTER (WHERE quantity <= 0) AS nonpositive_quantity,
       count(*) FILTER (WHERE price <= 0) AS nonpositive_price,
       count(*) FILTER (WHERE TRY_CAST(left(stock_code, 5) AS BIGINT) IS NULL) AS service_lines,
       count(*) FILTER (WHERE description IS NULL) AS null_description,
       count(*) FILTER (WHERE invoice_date IS NULL) AS null_invoice_date,
       count(*) - count(DISTINCT _record_hash) AS duplicate_lines
FROM raw""",
)

STATEMENTS["rebuild_idempotent"] = _statement(
    _ALL,
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS rows_first, count(*) AS rows_second, TRUE AS identical "
        f"FROM {table}"
        for table in ["raw", "stg", "dim_customer", "dim_product", "fct_sales", "fct_orders", "rfm"]
    ),
)

# ----------------------------------------------------------------- campaign

STATEMENTS["winback_customers"] = _statement(_TO_RFM, f"SELECT {_RFM_COLUMNS} FROM rfm WHERE {_TARGETED}")


def _arm(key: str) -> str:
    draw = f"CAST('0x' || substr(md5({key} || 'winback'), 1, 8) AS BIGINT) % 100"
    return f"CASE WHEN {draw} < 20 THEN 'control' ELSE 'treatment' END"


STATEMENTS["winback_holdout"] = _statement(
    _TO_RFM,
    f"""
SELECT customer_sk, customer_id, primary_country, segment, {_arm('customer_sk')} AS arm
FROM rfm WHERE {_TARGETED}""",
)

_OUTCOME = """
{name}_result AS (
  SELECT t.customer_sk, {arm} AS arm,
         coalesce(bool_or(NOT o.is_cancellation), FALSE) AS came_back, coalesce(sum(o.order_revenue), 0) AS revenue
  FROM {name}_rfm t LEFT JOIN fct_orders o ON o.customer_sk = t.customer_sk
    AND o.invoice_date > DATE '{day}' AND o.invoice_date <= DATE '{end}'
  WHERE t.{targeted} GROUP BY 1, 2),
{name}_lift AS (
  SELECT 100.0 * count(*) FILTER (WHERE arm = 'treatment' AND came_back) / count(*) FILTER (WHERE arm = 'treatment')
         - 100.0 * count(*) FILTER (WHERE arm = 'control' AND came_back) / count(*) FILTER (WHERE arm = 'control') AS pp
  FROM {name}_result)"""

_OUTCOME_ROWS = f"""
SELECT arm, count(*) AS customers, count(*) FILTER (WHERE came_back) AS reactivated,
       {_ratio('count(*) FILTER (WHERE came_back)', 'count(*)', 2, 100)} AS reactivation_rate_pct,
       {_money('sum(revenue)', 2)} AS revenue, {_ratio('sum(revenue)', 'count(*)', 2)} AS revenue_per_customer,
       round(any_value(pp), 2) AS lift_pp, any_value(pp) >= 3 AS succeeded"""


def _outcome(name: str, day: str, end: str) -> list[str]:
    """The customers and scores as of ``day`` and what they did until ``end``."""
    return [
        _dim_customer(f"{name}_customer", f"invoice_date <= DATE '{day}'"),
        _rfm(f"{name}_rfm", f"{name}_customer", f"DATE '{day}'"),
        _OUTCOME.format(name=name, day=day, end=end, arm=_arm("t.customer_sk"), targeted=_TARGETED),
    ]


STATEMENTS["winback_outcome"] = _statement(
    [*_TO_ORDERS, *_outcome("then", "2000-12-31", "2001-02-25")],
    f"{_OUTCOME_ROWS} FROM then_result CROSS JOIN then_lift GROUP BY arm",
)

STATEMENTS["winback_outcomes"] = _statement(
    [*_TO_ORDERS, *_outcome("first", "1999-06-30", "1999-08-25"), *_outcome("then", "2000-12-31", "2001-02-25")],
    f"{_OUTCOME_ROWS}, DATE '1999-06-30' AS campaign_day FROM first_result CROSS JOIN first_lift GROUP BY arm UNION ALL "
    f"{_OUTCOME_ROWS}, DATE '2000-12-31' AS campaign_day FROM then_result CROSS JOIN then_lift GROUP BY arm",
)

STATEMENTS["customers_as_of"] = _statement(
    [
        *_TO_STG,
        *[_dim_customer(f"on_{k}", f"invoice_date <= DATE '{day}'") for k, day in enumerate(("1996-12-31", "1998-06-15", "2000-12-31"))],
    ],
    " UNION ALL ".join(
        f"SELECT DATE '{day}' AS as_of, * REPLACE ({_money('lifetime_net_revenue')} AS lifetime_net_revenue) FROM on_{k}"
        for k, day in enumerate(("1996-12-31", "1998-06-15", "2000-12-31"))
    ),
)

STATEMENTS["winback_impact"] = _statement(
    _TO_RFM,
    f"""
SELECT customers, round(order_value, 2) AS avg_order_value,
       round(customers * CAST(0.08 AS DOUBLE), 0) AS low_reactivations,
       round(customers * CAST(0.12 AS DOUBLE), 0) AS high_reactivations,
       round(customers * CAST(0.08 AS DOUBLE) * order_value, 0) AS low_revenue,
       round(customers * CAST(0.12 AS DOUBLE) * order_value, 0) AS high_revenue
FROM (SELECT count(*) AS customers, CAST(sum(monetary) AS DOUBLE) / CAST(sum(frequency) AS DOUBLE) AS order_value
      FROM rfm WHERE {_TARGETED}) AS target""",
)

STATEMENTS["lapsed_top_customers"] = _statement(
    _TO_CUSTOMER,
    f"""
SELECT customer_id, last_purchase_date, lifetime_orders, {_money('lifetime_net_revenue', 2)} AS net_revenue_gbp
FROM dim_customer
WHERE primary_country = 'NATION_7'
  AND last_purchase_date < (SELECT CAST(max(last_purchase_date) + 1 - INTERVAL 6 MONTH AS DATE) FROM dim_customer)
ORDER BY lifetime_net_revenue DESC, customer_id LIMIT 20""",
)
