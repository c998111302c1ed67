"""Win-back campaign: target list, holdout, outcome and expected impact."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.columns import ratio
from tillroll.plans.marts import dim_customer, dim_customer_as_of
from tillroll.plans.rfm import as_of_date, rfm, winback_customers
from tillroll.sources.scratch import hold

# Campaign terms (fixed values).
HOLDOUT_PCT = 20
OUTCOME_DAYS = 56
LOW_REACTIVATION_PCT = 8
HIGH_REACTIVATION_PCT = 12
SUCCESS_LIFT_PP = 3.0
SALT = "winback"


def holdout_arm(key: Column, salt: str = SALT, control_pct: int = HOLDOUT_PCT) -> Column:
    """``control`` for a fixed pseudo-random share of the keys; the same key always gets the same arm."""
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(draw < control_pct, "control").otherwise("treatment")


def winback_holdout(rfm: DataFrame, salt: str = SALT, control_pct: int = HOLDOUT_PCT) -> DataFrame:
    """The target list with the arm of each customer."""
    arm = holdout_arm(F.col("customer_sk"), salt, control_pct)
    return winback_customers(rfm).select(
        "customer_sk", "customer_id", "primary_country", "segment", arm.alias("arm")
    )


def scores_on(parts: DataFrame, as_of: date) -> DataFrame:
    """RFM as it stood on ``as_of``: later lines do not exist yet. ``parts`` are the order parts."""
    customers = hold(dim_customer(parts.filter(F.col("invoice_date") <= F.lit(as_of))), "customers-then")
    return hold(rfm(customers, as_of), "scores-then")


def winback_outcome(
    scores: DataFrame, fct_orders: DataFrame, as_of: date, days: int = OUTCOME_DAYS
) -> DataFrame:
    """Reactivation and revenue of each arm in the ``days`` after ``as_of``.

    A customer is reactivated by an order that is not a cancellation; revenue nets cancellations.
    Later orders are summed per customer before they meet the target list.
    """
    day = F.col("invoice_date")
    window = (day > F.lit(as_of)) & (day <= F.lit(as_of + timedelta(days=days)))
    later = (
        fct_orders.filter(window & F.col("customer_sk").isNotNull())
        .groupBy("customer_sk")
        .agg(
            F.max(~F.col("is_cancellation")).alias("came_back"),
            F.sum("order_revenue").alias("revenue"),
        )
    )
    arms = (
        winback_holdout(scores)
        .join(later, "customer_sk", "left")
        .groupBy("arm")
        .agg(
            F.count("*").alias("customers"),
            F.count_if(F.col("came_back")).alias("reactivated"),
            F.coalesce(F.sum("revenue"), F.lit(0)).alias("_revenue"),
        )
    )

    def arm_rate(arm: str) -> Column:
        chosen = F.col("arm") == arm
        came_back = F.sum(F.when(chosen, F.col("reactivated"))).cast("double")
        return F.try_divide(came_back * 100.0, F.sum(F.when(chosen, F.col("customers"))).cast("double"))

    lift = arms.agg(arm_rate("treatment") - arm_rate("control")).scalar()
    return arms.select(
        "arm",
        "customers",
        "reactivated",
        ratio(F.col("reactivated"), F.col("customers"), 2, scale=100).alias("reactivation_rate_pct"),
        F.round("_revenue", 2).alias("revenue"),
        ratio(F.col("_revenue"), F.col("customers"), 2).alias("revenue_per_customer"),
        F.round(lift, 2).alias("lift_pp"),
        (lift >= SUCCESS_LIFT_PP).alias("succeeded"),
    )


def outcome(tables, as_of: date, days: int = OUTCOME_DAYS) -> DataFrame:
    """:func:`winback_outcome` of stored tables: lines up to ``as_of`` and orders of the days after it are read."""
    scores = scores_on(tables.between("order_parts", None, as_of), as_of)
    later = tables.between("fct_orders", as_of + timedelta(days=1), as_of + timedelta(days=days))
    return winback_outcome(scores, later, as_of, days)


def outcomes(tables, days: list[date], length: int = OUTCOME_DAYS) -> DataFrame:
    """:func:`winback_outcome` of campaigns that began on each of ``days``, with the day as ``campaign_day``.

    The customers of all days come from one pass over the orders (:func:`dim_customer_as_of`), written once.
    """
    states = hold(dim_customer_as_of(tables.between("order_parts", None, max(days)), days), "customers-as-of", "as_of")
    results = []
    for day in sorted(set(days)):
        customers = states.filter(F.col("as_of") == F.lit(day)).drop("as_of")
        later = tables.between("fct_orders", day + timedelta(days=1), day + timedelta(days=length))
        scores = hold(rfm(customers, day), "scores-then")
        results.append(winback_outcome(scores, later, day, length).withColumn("campaign_day", F.lit(day)))
    return reduce(DataFrame.unionByName, results)


def winback_impact(
    rfm: DataFrame, low_pct: int = LOW_REACTIVATION_PCT, high_pct: int = HIGH_REACTIVATION_PCT
) -> DataFrame:
    """Expected reactivations and one-order revenue at a low and a high reactivation rate."""
    target = winback_customers(rfm).agg(
        F.count("*").alias("customers"),
        F.sum("monetary").cast("double").alias("_revenue"),
        F.sum("frequency").cast("double").alias("_orders"),
    )
    order_value = F.try_divide(F.col("_revenue"), F.col("_orders"))

    def back(pct: int) -> Column:
        return F.col("customers") * (pct / 100.0)

    return target.select(
        "customers",
        F.round(order_value, 2).alias("avg_order_value"),
        F.round(back(low_pct), 0).alias("low_reactivations"),
        F.round(back(high_pct), 0).alias("high_reactivations"),
        F.round(back(low_pct) * order_value, 0).alias("low_revenue"),
        F.round(back(high_pct) * order_value, 0).alias("high_revenue"),
    )


def lapsed_top_customers(
    dim_customer: DataFrame, country: str, months: int = 6, k: int = 20, as_of: date | None = None
) -> DataFrame:
    """The biggest spenders of a country who have been silent for ``months`` months."""
    silent = F.col("last_purchase_date") < F.add_months(as_of_date(dim_customer, as_of), -months)
    return (
        dim_customer.filter((F.col("primary_country") == country) & silent)
        .orderBy(F.desc("lifetime_net_revenue"), "customer_id")
        .limit(k)
        .select(
            "customer_id",
            "last_purchase_date",
            "lifetime_orders",
            F.round("lifetime_net_revenue", 2).alias("net_revenue_gbp"),
        )
    )
