from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal
from hashlib import md5

from pyspark.sql import functions as F

from tests.helpers import DAY, raw_frame
from tillroll.plans import analytics, marts
from tillroll.plans.staging import dedup_lines, stg_lines


def sk(value) -> str:
    return md5(str(value).encode()).hexdigest()


def build(spark, *changes):
    stg = stg_lines(raw_frame(spark, *changes)).cache()
    return stg, marts.order_parts(stg)


def test_dedup_keeps_the_earliest_source_row(spark):
    raw = raw_frame(
        spark,
        {"_source_sheet": "B", "_source_row": 1, "description": "from B"},
        {"_source_sheet": "A", "_source_row": 9, "description": "late in A", "country": "Spain"},
        {"_source_sheet": "A", "_source_row": 3, "description": "first in A"},
        {"quantity": 2},
    )
    kept = dedup_lines(raw).filter("quantity = 1").collect()
    assert [r.description for r in kept] == ["first in A"]
    assert dedup_lines(raw).count() == 2


def test_dedup_does_not_depend_on_input_order(spark):
    """Copies that share sheet and row number, as the files of one sheet do."""
    raw = raw_frame(
        spark,
        {"_source_row": 2, "_source_file": "q", "description": "a"},
        {"_source_row": 2, "_source_file": "p", "description": "b", "price": 1.00004},
        {"_source_row": 2, "_source_file": "p", "description": "b", "price": 1.0},
    ).coalesce(1)
    for order in (F.col("_source_file"), F.desc("_source_file"), F.desc("price"), F.rand(5)):
        (row,) = stg_lines(raw.sortWithinPartitions(order)).collect()
        assert (row.source_file, row.description, row.unit_price) == ("p", "b", 1)


def test_dedup_trims_copies_before_the_shuffle(spark):
    plan = dedup_lines(raw_frame(spark, {}))._jdf.queryExecution().executedPlan().toString()
    final, exchange, partial = (plan.index(w) for w in ("1, Final", "Exchange", "1, Partial"))
    assert final < exchange < partial


def test_flags_are_three_valued(spark):
    stg, _ = build(spark, {"quantity": None}, {"invoice": "C2", "quantity": None}, {"invoice": "3"})
    rows = {r.invoice_no: r for r in stg.collect()}
    assert rows["1"].is_return_or_zero is None and rows["1"].is_valid_sale is None
    assert rows["1"].line_revenue is None
    assert rows["C2"].is_valid_sale is False
    assert rows["3"].is_valid_sale is True


def test_non_numeric_customer(spark):
    """Such a line has a customer, but no key, and the customer is not in the dimension."""
    stg, parts = build(spark, {"customer_id": "X12"}, {"customer_id": None, "invoice": "2"})
    rows = {r.invoice_no: r for r in stg.collect()}
    assert rows["1"].has_customer and rows["1"].customer_id is None
    assert not rows["2"].has_customer
    assert [r.customer_sk for r in marts.fct_sales(stg).collect()] == [None, None]
    assert marts.dim_customer(parts).count() == 0


def test_customer_dimension(spark):
    _, parts = build(
        spark,
        {"invoice": "1", "country": "Spain", "price": 5.0},
        {"invoice": "1", "country": "France", "stock_code": "11111"},
        {"invoice": "C2", "country": "France", "quantity": -1, "invoice_date": DAY + timedelta(days=2)},
        {"invoice": "3", "country": "Spain", "stock_code": "POST", "price": 99.0},
        {"invoice": None, "country": "Italy", "stock_code": "22222"},
        {"customer_id": "8", "stock_code": "POST", "invoice": "9"},
    )
    rows = {r.customer_id: r for r in marts.dim_customer(parts).collect()}
    seven = rows[7]
    assert seven.customer_sk == sk(7)
    assert seven.primary_country == "France"  # two lines each for France and Spain: lowest name
    assert seven.lifetime_orders == 2  # cancellation counts, service-only and missing invoices do not
    assert seven.lifetime_net_revenue == Decimal("6.0")
    assert (seven.first_purchase_date, seven.last_purchase_date) == (date(2011, 1, 5), date(2011, 1, 7))
    eight = rows[8]
    assert (eight.lifetime_orders, eight.lifetime_net_revenue, eight.first_purchase_date) == (0, 0, None)


def test_invoice_split_over_countries_counts_once(spark):
    _, parts = build(spark, {"country": "Spain"}, {"country": "France", "quantity": 4})
    assert marts.dim_customer(parts).first().lifetime_orders == 1
    order = marts.fct_orders(parts).collect()
    assert len(order) == 1 and order[0].country == "France" and order[0].n_units == 5


def test_product_dimension(spark):
    stg, _ = build(
        spark,
        {"description": "b", "quantity": 1},
        {"description": "a", "quantity": 2},
        {"description": None, "quantity": 3},
        {"description": " ", "quantity": 4},
        {"description": "UNKNOWN", "quantity": 5},
        {"stock_code": "POST", "description": None},
        {"stock_code": None, "description": "no code"},
    )
    rows = {r.stock_code: r for r in marts.dim_product(stg).collect()}
    assert rows["85123A"].description == "a"
    assert rows["POST"].description == "UNKNOWN" and rows["POST"].is_service_line
    assert rows[None].description == "UNKNOWN" and rows[None].product_sk is None


def test_orders(spark):
    _, parts = build(
        spark,
        {"invoice": "C1", "quantity": -2, "price": 3.0, "customer_id": None},
        {"invoice": "C1", "quantity": -1, "price": 3.0, "invoice_date": DAY - timedelta(days=1)},
    )
    order = marts.fct_orders(parts).first()
    assert order.is_cancellation and order.n_lines == 2 and order.n_units == -3
    assert order.order_revenue == Decimal("-9")
    assert order.customer_sk == sk(7)
    assert order.invoice_ts == datetime(2011, 1, 4, 10, 30) and order.invoice_date == date(2011, 1, 4)


def test_order_outliers_need_spread(spark):
    """One order has no deviation, equal orders a zero one: nothing stands out, nothing fails."""
    _, parts = build(spark, {})
    assert analytics.q3_outlier_orders(marts.fct_orders(parts)).count() == 0
    _, parts = build(spark, {}, {"invoice": "2"})
    assert analytics.q3_outlier_orders(marts.fct_orders(parts)).count() == 0


def test_order_outliers_are_large_ones(spark):
    usual = [{"invoice": str(i), "price": 10.0 + i % 3} for i in range(30)]
    _, parts = build(spark, *usual, {"invoice": "big", "price": 900.0}, {"invoice": "C9", "price": 5000.0})
    found = analytics.q3_outlier_orders(marts.fct_orders(parts)).collect()
    assert [r.invoice_no for r in found] == ["big"]
    assert found[0].z_score > 3


def test_shared_descriptions_merge(spark):
    stg, _ = build(
        spark,
        {"stock_code": "11111", "description": "LAMP"},
        {"stock_code": "22222", "description": "LAMP", "price": 3.0},
        {"stock_code": "33333", "description": "OLD", "invoice_date": datetime(2010, 1, 1)},
    )
    top = analytics.q5_top_products(marts.fct_sales(stg), marts.dim_product(stg), date(2011, 1, 1)).collect()
    assert [(r.description, r.net_revenue_gbp, r.pct_of_period_revenue) for r in top] == [
        ("LAMP", Decimal("4.00"), 100.0)
    ]


def test_empty_input(spark):
    stg, parts = build(spark)
    assert stg.count() == 0
    assert marts.dim_customer(parts).count() == 0
    assert marts.fct_orders(parts).count() == 0
    assert marts.dim_product(stg).count() == 0
    assert analytics.q4_country_revenue(marts.fct_orders(parts)).count() == 0


def test_countries_count_orders_and_customers(spark):
    _, parts = build(
        spark,
        {"invoice": "1"},
        {"invoice": "2"},
        {"invoice": "3", "customer_id": None, "price": 2.0},
        {"invoice": "4", "country": "", "stock_code": "POST", "price": 12.0},
        {"invoice": "C5", "quantity": -1},
    )
    rows = analytics.q4_country_revenue(marts.fct_orders(parts)).collect()
    assert [(r.country, r.orders, r.customers, r.pct_of_total) for r in rows] == [
        ("Unspecified", 1, 1, 75.0),
        ("France", 3, 1, 25.0),
    ]
    assert analytics.geo_top_k(marts.fct_orders(parts), k=1).select(F.col("country")).first()[0] == "Unspecified"
