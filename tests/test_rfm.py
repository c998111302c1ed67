from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tests.helpers import raw_frame
from tillroll.plans import campaign, marts, rfm
from tillroll.plans.staging import stg_lines
from tillroll.plans.warehouse import Warehouse
from tillroll.schemas import MONEY

# The expected segment of every (recency, frequency) score (fixed values).
GRID = {
    5: ["New / Promising", "New / Promising", "Loyal", "Champions", "Champions"],
    4: ["New / Promising", "New / Promising", "Loyal", "Champions", "Champions"],
    3: ["Potential Loyalist", "Potential Loyalist", "Loyal", "Loyal", "Loyal"],
    2: ["Hibernating", "Hibernating", "At Risk", "At Risk", "At Risk"],
    1: ["Lost", "Lost", "At Risk", "Cannot Lose Them", "Cannot Lose Them"],
}


def test_segment_grid(spark):
    cells = spark.range(25).select((F.col("id") % 5 + 1).alias("r"), F.expr("id div 5 + 1").alias("f"))
    rows = cells.withColumn("segment", rfm.segment_of(F.col("r"), F.col("f"))).collect()
    assert {(c.r, c.f): c.segment for c in rows} == {(r, f + 1): GRID[r][f] for r in GRID for f in range(5)}


def customers(spark, rows):
    schema = "customer_id bigint, last_purchase_date date, lifetime_orders bigint, revenue double"
    return spark.createDataFrame(rows, schema).select(
        F.md5(F.col("customer_id").cast("string")).alias("customer_sk"),
        "customer_id",
        F.lit("France").alias("primary_country"),
        F.col("last_purchase_date").alias("first_purchase_date"),
        "last_purchase_date",
        "lifetime_orders",
        F.col("revenue").cast(MONEY).alias("lifetime_net_revenue"),
    )


def test_scores(spark):
    day = date(2011, 12, 9)
    dim = customers(
        spark,
        [(i, day - timedelta(days=10 * i), 10 - i, 100.0 * (i + 1)) for i in range(5)]
        + [(90, day, 3, 0.0), (91, day, 3, -5.0), (92, None, 0, 0.0)],
    )
    rows = {r.customer_id: r for r in rfm.rfm(dim).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]
    assert [(rows[i].recency_days, rows[i].r, rows[i].f, rows[i].m) for i in range(5)] == [
        (10 * i + 1, 5 - i, 5 - i, i + 1) for i in range(5)
    ]
    fixed = rfm.rfm(dim, as_of=date(2011, 12, 31)).orderBy("customer_id").first()
    assert fixed.recency_days == 22


def test_repeat_rate_ignores_the_sign_of_revenue(spark):
    day = date(2011, 1, 1)
    dim = customers(spark, [(1, day, 1, 5.0), (2, day, 2, -5.0), (3, day, 3, 5.0), (4, None, 0, 0.0)])
    row = rfm.repeat_rate(dim).first()
    assert (row.buyers, row.repeat_buyers, row.repeat_rate_pct) == (3, 2, 66.7)
    assert rfm.repeat_rate(dim.limit(0)).first().repeat_rate_pct is None


def test_pareto(spark):
    day = date(2011, 1, 1)
    dim = customers(spark, [(i, day, 1, 10.0) for i in range(9)] + [(9, day, 1, 910.0)])
    assert rfm.pareto_top20(rfm.rfm(dim)).first()[0] == 92.0


def test_holdout_is_stable_and_near_its_share(spark):
    keys = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("sk"))
    arms = keys.withColumn("arm", campaign.holdout_arm(F.col("sk")))
    control = arms.filter("arm = 'control'")
    assert 3_700 < control.count() < 4_300
    assert control.exceptAll(
        keys.repartition(7).withColumn("arm", campaign.holdout_arm(F.col("sk"))).filter("arm = 'control'")
    ).isEmpty()
    assert keys.filter(campaign.holdout_arm(F.col("sk"), control_pct=0) == "control").isEmpty()


def test_scores_on_a_day_do_not_see_later_lines(spark):
    raw = raw_frame(
        spark,
        {"invoice": "1", "invoice_date": datetime(2010, 6, 1), "price": 5.0},
        {"invoice": "2", "invoice_date": datetime(2011, 6, 1), "price": 50.0},
    )
    parts = marts.order_parts(stg_lines(raw))
    row = campaign.scores_on(parts, date(2010, 12, 31)).first()
    assert (row.frequency, row.monetary, row.recency_days) == (1, 5, 213)


def test_outcome(spark):
    day = date(2011, 1, 31)
    scores = spark.range(300).select(
        F.md5(F.col("id").cast("string")).alias("customer_sk"),
        F.col("id").alias("customer_id"),
        F.lit("France").alias("primary_country"),
        F.lit("At Risk").alias("segment"),
    )
    arms = {r.customer_sk: r.arm for r in campaign.winback_holdout(scores).collect()}
    treated = [k for k, arm in arms.items() if arm == "treatment"]
    control = [k for k, arm in arms.items() if arm == "control"]
    orders = spark.createDataFrame(
        [(k, date(2011, 2, 10), 10.0, False) for k in treated[:50]]
        + [(treated[0], date(2011, 2, 11), -4.0, True)]
        + [(treated[60], date(2011, 2, 11), -4.0, True)]  # a cancellation is no return
        + [(treated[61], date(2011, 5, 1), 99.0, False), (treated[62], day, 99.0, False)]  # outside the window
        + [(control[0], date(2011, 3, 28), 7.0, False), (None, date(2011, 2, 10), 1.0, False)],
        "customer_sk string, invoice_date date, revenue double, is_cancellation boolean",
    ).withColumn("order_revenue", F.col("revenue").cast(MONEY))
    rows = {r.arm: r for r in campaign.winback_outcome(scores, orders, day).collect()}
    assert (rows["treatment"].customers, rows["treatment"].reactivated) == (len(treated), 50)
    assert (rows["control"].customers, rows["control"].reactivated) == (len(control), 1)
    assert rows["treatment"].revenue == 492 and rows["control"].revenue == 7
    lift = 100 * 50 / len(treated) - 100 / len(control)
    assert rows["control"].lift_pp == round(lift, 2) and rows["control"].succeeded


def test_customers_as_of_many_days_are_those_of_a_rebuild_for_each(spark):
    """Random orders over two years, cancellations, service lines and changes of country among them."""
    draw = random.Random(11)
    first = datetime(2010, 1, 1)
    changes = []
    for k in range(400):
        invoice = draw.randrange(120)
        changes.append(
            {
                "invoice": ("C" if draw.random() < 0.1 else "") + str(invoice),
                "stock_code": draw.choice(["85123A", "84029G", "POST"]),
                "customer_id": draw.choice([None, "7", "8", "9", "10", "11", "x"]),
                "country": draw.choice(["France", "Spain", "Italy"]),
                "quantity": draw.randrange(-2, 6),
                # An invoice may go on for days.
                "invoice_date": first + timedelta(days=invoice * 6 + draw.randrange(20)),
                "price": float(draw.randrange(9)),
            }
        )
    tables = Warehouse.over(raw_frame(spark, *changes))
    days = [date(2009, 6, 1), *[date(2010, 1, 1) + timedelta(days=draw.randrange(760)) for _ in range(12)]]
    got = marts.dim_customer_as_of(tables["order_parts"], days)
    for day in sorted(set(days)):
        rebuilt = marts.dim_customer(tables["order_parts"].filter(F.col("invoice_date") <= F.lit(day)))
        mine = got.filter(F.col("as_of") == F.lit(day)).drop("as_of")
        assert sorted(map(str, mine.collect())) == sorted(map(str, rebuilt.collect())), day
