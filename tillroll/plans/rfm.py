"""Recency, frequency and monetary scores, segments and what is read off them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.columns import ratio
from tillroll.operators.ntile import in_first_tile, with_tiles
from tillroll.operators.shares import total_of, with_share
from tillroll.schemas import MONEY, conform

TILES = 5

# Segment names (fixed values).
CHAMPIONS = "Champions"
LOYAL = "Loyal"
NEW = "New / Promising"
POTENTIAL = "Potential Loyalist"
AT_RISK = "At Risk"
HIBERNATING = "Hibernating"
CANNOT_LOSE = "Cannot Lose Them"
LOST = "Lost"

WINBACK_SEGMENTS = [AT_RISK, CANNOT_LOSE]


def as_of_date(dim_customer: DataFrame, as_of: date | None = None) -> Column:
    """The given day, or the day after the last purchase of all."""
    if as_of is not None:
        return F.lit(as_of)
    return dim_customer.agg(F.date_add(F.max("last_purchase_date"), 1)).scalar()


def segment_of(r: Column, f: Column) -> Column:
    """The segment grid: one row of the grid per recency score, split by frequency score."""
    recent = F.when(f >= 4, CHAMPIONS).when(f == 3, LOYAL).otherwise(NEW)
    middling = F.when(f >= 3, LOYAL).otherwise(POTENTIAL)
    lapsing = F.when(f >= 3, AT_RISK).otherwise(HIBERNATING)
    gone = F.when(f >= 4, CANNOT_LOSE).when(f == 3, AT_RISK).otherwise(LOST)
    return F.when(r >= 4, recent).when(r == 3, middling).when(r == 2, lapsing).otherwise(gone)


def rfm(dim_customer: DataFrame, as_of: date | None = None) -> DataFrame:
    """Scores of every customer with at least one order and positive net revenue.

    ``as_of`` only moves the day recency counts from; for scores as they stood on an earlier day,
    build ``dim_customer`` from the lines up to that day.
    """
    last_day = F.col("last_purchase_date")
    buyers = dim_customer.filter((F.col("lifetime_orders") > 0) & (F.col("lifetime_net_revenue") > 0)).select(
        "customer_sk",
        "customer_id",
        "primary_country",
        F.datediff(as_of_date(dim_customer, as_of), last_day).cast("bigint").alias("recency_days"),
        F.col("lifetime_orders").alias("frequency"),
        F.col("lifetime_net_revenue").alias("monetary"),
    )
    keys = {"r": F.col("recency_days"), "f": F.col("frequency"), "m": F.col("monetary")}
    scored = with_tiles(buyers, keys, tie="customer_sk", tiles=TILES).withColumn("r", TILES + 1 - F.col("r"))
    return conform(scored.withColumn("segment", segment_of(F.col("r"), F.col("f"))), "rfm")


def rfm_segments(rfm: DataFrame) -> DataFrame:
    groups = rfm.groupBy("segment").agg(
        F.count("*").alias("customers"),
        ratio(F.sum("recency_days"), F.count("recency_days"), 0).alias("avg_recency_days"),
        ratio(F.sum("frequency"), F.count("frequency"), 1).alias("avg_orders"),
        ratio(F.sum("monetary"), F.count("monetary"), 0).alias("avg_net_revenue"),
        F.sum("monetary").alias("_revenue"),
    )
    shared = with_share(groups, "_revenue", total_of(rfm, "monetary"), "pct_revenue", 1)
    return (
        shared.withColumn("total_net_revenue", F.round("_revenue", 0))
        .select(
            "segment",
            "customers",
            "avg_recency_days",
            "avg_orders",
            "avg_net_revenue",
            "total_net_revenue",
            "pct_revenue",
        )
        .orderBy(F.desc("total_net_revenue"), "segment")
    )


def explorer_segments(rfm: DataFrame) -> DataFrame:
    """The segment table as the explorer shows it."""
    return rfm_segments(rfm).select(
        "segment",
        "customers",
        F.col("total_net_revenue").alias("net_revenue"),
        "avg_recency_days",
        "avg_orders",
    )


def headline_totals(dim_customer: DataFrame, rfm: DataFrame, fct_sales: DataFrame) -> DataFrame:
    """Customer counts and net product revenue, split into attributable and guest, in one row."""
    revenue, known = F.col("line_revenue"), F.col("has_customer")
    sales = fct_sales.filter(~F.col("is_service_line")).agg(
        F.round(F.sum(revenue), 0).alias("net_product_revenue"),
        F.round(F.sum(F.when(known, revenue)), 0).alias("attributable_revenue"),
        F.round(F.sum(F.when(~known, revenue)), 0).alias("guest_revenue"),
    )
    return sales.select(
        dim_customer.agg(F.max("last_purchase_date")).scalar().alias("as_of_last_purchase"),
        dim_customer.agg(F.count("*")).scalar().alias("known_customers"),
        rfm.agg(F.count("*")).scalar().alias("purchasing_customers"),
        "net_product_revenue",
        "attributable_revenue",
        "guest_revenue",
    )


def repeat_rate(dim_customer: DataFrame) -> DataFrame:
    """Share of customers with any order who placed at least two."""
    counts = dim_customer.filter("lifetime_orders > 0").agg(
        F.count("*").alias("buyers"), F.count_if(F.col("lifetime_orders") >= 2).alias("repeat_buyers")
    )
    rate = ratio(F.col("repeat_buyers"), F.col("buyers"), 1, scale=100)
    return counts.withColumn("repeat_rate_pct", rate)


def pareto_top20(rfm: DataFrame) -> DataFrame:
    """Revenue share of the fifth of the customers who spend most."""
    in_top = in_first_tile(rfm, -F.col("monetary"), tie="customer_sk", tiles=TILES)
    top = F.sum(F.when(in_top, F.col("monetary")).otherwise(F.lit(0).cast(MONEY)))
    return rfm.agg(ratio(top, F.sum("monetary"), 1, scale=100).alias("top20pct_revenue_share"))


def winback_customers(rfm: DataFrame) -> DataFrame:
    """The win-back target list: proven buyers who stopped coming."""
    return rfm.filter(F.col("segment").isin(WINBACK_SEGMENTS))


def winback_target(rfm: DataFrame) -> DataFrame:
    """Size and averages of the win-back target, in one row."""
    return winback_customers(rfm).agg(
        F.count("*").alias("customers"),
        ratio(F.sum("monetary"), F.count("monetary"), 0).alias("avg_net_revenue"),
        F.round(F.sum("monetary"), 0).alias("total_hist_revenue"),
        ratio(F.sum("recency_days"), F.count("recency_days"), 0).alias("avg_recency_days"),
        ratio(F.sum("frequency"), F.count("frequency"), 1).alias("avg_orders"),
    )
