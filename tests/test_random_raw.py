"""Random, skewed and dirty raw lines: every model and question against SQL over the same lines."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from __spark_entry__ import SALES_START, comparable
from oracle import statements as sql
from tests.compare import difference
from tests.helpers import raw_frame
from tillroll.plans import analytics, quality, rfm
from tillroll.plans.warehouse import Warehouse

RAW_FILE = "\nraw AS (SELECT * FROM landed_file)"
REPLACED = "".join([sql.LINES, ",", sql.SHEETS, ",", sql.RAW])

QUESTIONS = {
    "stg_lines": lambda w: w["stg"],
    "dim_customer": lambda w: w["dim_customer"],
    "dim_product": lambda w: w["dim_product"],
    "fct_sales": lambda w: w["fct_sales"],
    "fct_orders": lambda w: w["fct_orders"],
    "rfm": lambda w: w["rfm"],
    "q1_top_customers": lambda w: analytics.q1_top_customers(w["dim_customer"]),
    "q2_monthly_revenue": lambda w: analytics.q2_monthly_revenue(w["fct_sales"]),
    "q3_outlier_orders": lambda w: analytics.q3_outlier_orders(w["fct_orders"]),
    "q4_country_revenue": lambda w: analytics.q4_country_revenue(w["fct_orders"]),
    "q5_top_products": lambda w: analytics.q5_top_products(w["fct_sales"], w["dim_product"], SALES_START),
    "rfm_segments": lambda w: rfm.rfm_segments(w["rfm"]),
    "pareto_top20": lambda w: rfm.pareto_top20(w["rfm"]),
    "headline_totals": lambda w: rfm.headline_totals(w["dim_customer"], w["rfm"], w["fct_sales"]),
    "dq_assertions": quality.dq_assertions,
    "dq_relationships": quality.dq_relationships,
    "dq_profile": lambda w: quality.dq_profile(w["raw"]),
}


def random_lines(seed: int, n: int) -> list[dict]:
    """A third of the lines copies one line, a third belongs to one customer, order and product."""
    rng = random.Random(seed)
    lines = []
    for i in range(n):
        line = {
            "_source_sheet": rng.choice("AB"),
            "_source_row": i + 2,
            "description": rng.choice(["LAMP", "lamp", " MUG ", "", None, "UNKNOWN", "BOWL"]),
            "country": rng.choice(["France", "Spain", "", None, "Eire"]),
        }
        if i % 3:
            hot = i % 3 == 2
            line |= {
                "invoice": "500" if hot else rng.choice(["C", ""]) * (i % 2) + str(rng.randrange(n // 4)),
                "stock_code": "85123A" if hot else rng.choice(["11111", "22222B", "POST", "M", "333", None]),
                "quantity": rng.choice([1, 2, 12, -3, 0, None]),
                "price": rng.choice([0.0, 1.25, 2.55, 49.99, -1.0]),
                "customer_id": "13085" if hot else rng.choice([None, "X1", *map(str, range(n // 9))]),
                "invoice_date": datetime(2001, 1, 1) + timedelta(minutes=rng.randrange(-300_000, 300_000)),
            }
        lines.append(line)
    return lines


@pytest.fixture(scope="module", params=[1, 2])
def built(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "lines")
    raw_frame(spark, *random_lines(request.param, 600)).repartition(5).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW landed_file AS SELECT * FROM read_parquet('{path}/*.parquet')")
    con.execute("SET TimeZone = 'UTC'")
    return Warehouse.over(spark.read.parquet(path)), con


@pytest.mark.parametrize("name", sorted(QUESTIONS))
def test_matches_sql(built, name):
    warehouse, con = built
    statement = sql.STATEMENTS[name]
    assert REPLACED in statement
    statement = statement.replace(REPLACED, RAW_FILE).replace(
        "_loaded_at AS loaded_at", "CAST(_loaded_at AT TIME ZONE 'UTC' AS TIMESTAMP) AS loaded_at"
    )
    assert difference(comparable(QUESTIONS[name](warehouse)), con, statement) == ""
