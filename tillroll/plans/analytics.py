"""Commercial questions over the marts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tillroll.functions.columns import month, ratio
from tillroll.operators.shares import total_of, with_share

OUTLIER_Z = 3


def q1_top_customers(dim_customer: DataFrame, k: int = 10) -> DataFrame:
    """Customers by lifetime net revenue."""
    top = dim_customer.orderBy(F.desc("lifetime_net_revenue"), "customer_id").limit(k)
    return top.select(
        "customer_id",
        "primary_country",
        "lifetime_orders",
        F.round("lifetime_net_revenue", 2).alias("net_revenue_gbp"),
    )


def _product_sales(fct_sales: DataFrame) -> DataFrame:
    return fct_sales.filter(~F.col("is_service_line"))


def q2_monthly_revenue(fct_sales: DataFrame) -> DataFrame:
    """Orders, active customers and net product revenue per month.

    Lines collapse to (day, invoice, customer) first, so the exact distinct counts copy order-grain
    rows instead of lines and days are named by month after the collapse.
    """
    orders = (
        _product_sales(fct_sales)
        .groupBy("invoice_date", "invoice_no", "customer_sk")
        .agg(F.sum("line_revenue").alias("revenue"))
    )
    months = orders.groupBy(month(F.col("invoice_date")).alias("month")).agg(
        F.count_distinct("invoice_no").alias("orders"),
        F.count_distinct("customer_sk").alias("active_customers"),
        F.round(F.sum("revenue"), 2).alias("net_revenue_gbp"),
    )
    return months.orderBy("month")


def monthly_trend(fct_sales: DataFrame) -> DataFrame:
    """Net product revenue per month, unrounded. Days are summed before they are named by month."""
    days = _product_sales(fct_sales).groupBy("invoice_date").agg(F.sum("line_revenue").alias("_revenue"))
    by_month = days.groupBy(month(F.col("invoice_date")).alias("month"))
    return by_month.agg(F.sum("_revenue").alias("net_revenue")).orderBy("month")


def q3_outlier_orders(fct_orders: DataFrame, k: int = 20) -> DataFrame:
    """Unusually large orders: more than three standard deviations above the mean positive order."""
    orders = _standing_orders(fct_orders).filter(F.col("order_revenue") > 0)
    value = F.col("order_revenue").cast("double")
    spread = orders.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))).scalar()
    z = F.try_divide(value - spread.getField("mean"), spread.getField("sd"))
    return (
        orders.withColumn("_z", z)
        .filter(F.col("_z") > OUTLIER_Z)
        .select(
            "invoice_no",
            "customer_sk",
            "invoice_date",
            F.round("order_revenue", 2).alias("order_revenue_gbp"),
            F.round("_z", 2).alias("z_score"),
        )
        .orderBy(F.desc("z_score"), "invoice_no")
        .limit(k)
    )


def _standing_orders(fct_orders: DataFrame) -> DataFrame:
    return fct_orders.filter(~F.col("is_cancellation"))


def _country_totals(fct_orders: DataFrame) -> DataFrame:
    """Orders, customers and exact revenue of the non-cancelled orders per country.

    Orders are already one row per invoice, so counting them needs no distinct; only customers are
    collapsed first, per (country, customer), which also spreads a dominant country.
    """
    pairs = (
        _standing_orders(fct_orders)
        .groupBy("country", "customer_sk")
        .agg(F.count("invoice_no").alias("n"), F.sum("order_revenue").alias("revenue"))
    )
    return pairs.groupBy("country").agg(
        F.sum("n").alias("orders"),
        F.count("customer_sk").alias("customers"),
        F.sum("revenue").alias("_revenue"),
    )


def q4_country_revenue(fct_orders: DataFrame, k: int = 15) -> DataFrame:
    """Ship-to countries by revenue (service lines included), with their share of all revenue."""
    total = total_of(_standing_orders(fct_orders), "order_revenue")
    shared = with_share(_country_totals(fct_orders), "_revenue", total, "pct_of_total", 2)
    ranked = shared.withColumn("net_revenue_gbp", F.round("_revenue", 2))
    top = ranked.orderBy(F.desc("net_revenue_gbp"), "country").limit(k)
    return top.select("country", "orders", "customers", "net_revenue_gbp", "pct_of_total")


def geo_top_k(fct_orders: DataFrame, k: int = 12) -> DataFrame:
    """Ship-to countries by revenue, as the explorer and the dashboard show them."""
    totals = (
        _standing_orders(fct_orders)
        .groupBy("country")
        .agg(F.count("invoice_no").alias("orders"), F.round(F.sum("order_revenue"), 0).alias("net_revenue"))
    )
    return totals.orderBy(F.desc("net_revenue"), "country").limit(k)


def _description_totals(fct_sales: DataFrame, dim_product: DataFrame, start: date | None) -> DataFrame:
    """Exact net product revenue per description; codes that share a text are added up.

    Lines are summed per product before the join, so a best-seller meets the dimension as one row.
    """
    lines = _product_sales(fct_sales)
    if start is not None:
        lines = lines.filter(F.col("invoice_date") >= F.lit(start))
    products = lines.groupBy("product_sk").agg(F.sum("line_revenue").alias("_revenue"))
    described = products.join(dim_product.select("product_sk", "description"), "product_sk")
    return described.groupBy("description").agg(F.sum("_revenue").alias("_revenue"))


def q5_top_products(
    fct_sales: DataFrame, dim_product: DataFrame, start_date: date, k: int = 10
) -> DataFrame:
    """Best-selling descriptions since ``start_date`` and their share of that period's revenue."""
    totals = _description_totals(fct_sales, dim_product, start_date)
    shared = with_share(totals, "_revenue", total_of(totals, "_revenue"), "pct_of_period_revenue", 2)
    ranked = shared.withColumn("net_revenue_gbp", F.round("_revenue", 2))
    top = ranked.orderBy(F.desc("net_revenue_gbp"), "description").limit(k)
    return top.select("description", "net_revenue_gbp", "pct_of_period_revenue")


def top_products_all_time(fct_sales: DataFrame, dim_product: DataFrame, k: int = 10) -> DataFrame:
    totals = _description_totals(fct_sales, dim_product, start=None)
    rounded = totals.select("description", F.round("_revenue", 0).alias("net_revenue"))
    return rounded.orderBy(F.desc("net_revenue"), "description").limit(k)


def kpi_row(dim_customer: DataFrame, fct_orders: DataFrame, fct_sales: DataFrame) -> DataFrame:
    """Known customers, non-cancelled orders and net product revenue, in one row."""
    orders = _standing_orders(fct_orders).agg(F.count("*"))
    return (
        _product_sales(fct_sales)
        .agg(F.sum("line_revenue").alias("net_revenue"))
        .select(
            dim_customer.agg(F.count("*")).scalar().alias("customers"),
            orders.scalar().alias("orders"),
            "net_revenue",
        )
    )


def order_count_distribution(dim_customer: DataFrame) -> DataFrame:
    """How many customers placed how many orders."""
    buyers = dim_customer.filter("lifetime_orders > 0")
    counted = buyers.groupBy("lifetime_orders").agg(F.count("*").alias("customers"))
    share = ratio(F.col("customers"), buyers.agg(F.count("*")).scalar(), 2, scale=100)
    return counted.withColumn("pct_of_buyers", share).orderBy("lifetime_orders")
