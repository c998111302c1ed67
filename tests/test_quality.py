"""Checks must fail on bad tables, not only pass on good ones."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.helpers import LOADED_AT, raw_frame
from tillroll.plans import quality
from tillroll.plans.warehouse import Warehouse


GOOD = ({}, {"invoice": "2", "customer_id": "8"}, {"invoice": "3", "customer_id": None})


def warehouse(spark, *changes):
    return dict(Warehouse.over(raw_frame(spark, *changes)).items())


def scans_of_staging(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("/stg-")


def test_checks_after_a_build_do_not_read_staging(spark):
    """What the write counted, and the roll-up of keys, say the same as passes over the tables."""
    tables = Warehouse.over(raw_frame(spark, *GOOD, {"invoice": "9", "stock_code": None}))
    plain = dict(tables.items())
    for check in (quality.dq_assertions, quality.dq_not_null, quality.dq_relationships, quality.dq_schema_contract):
        observed, passes = check(tables), check(plain)
        assert scans_of_staging(observed) == 0
        assert sorted(map(str, observed.collect())) == sorted(map(str, passes.collect()))




def failed(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect() if not r.passed)


def test_assertions(spark):
    tables = warehouse(spark, *GOOD)
    assert failed(quality.dq_assertions(tables), "check") == []
    tables["dim_customer"] = tables["dim_customer"].filter("customer_id = 7")
    tables["dim_product"] = tables["dim_product"].limit(0)
    tables["stg"] = tables["stg"].unionByName(tables["stg"])
    bad = quality.dq_assertions(tables)
    assert failed(bad, "check", "observed", "expected") == [
        ("fct_sales customers exist in dim_customer", 1, 0),
        ("fct_sales products exist in dim_product", 3, 0),
        ("fct_sales rows equal staging rows", 3, 6),
        ("staging rows equal distinct raw lines", 6, 3),
    ]
    tables["dim_customer"] = tables["dim_customer"].unionByName(tables["dim_customer"])
    assert ("dim_customer.customer_sk is unique",) in failed(quality.dq_assertions(tables), "check")


def test_null_product_keys_are_orphans(spark):
    """One line without a stock code has no product; a guest line without a customer is fine."""
    tables = warehouse(spark, *GOOD, {"invoice": "9", "stock_code": None})
    tables["dim_product"] = tables["dim_product"].filter("stock_code IS NOT NULL")
    assert failed(quality.dq_assertions(tables), "check", "observed") == [
        ("fct_sales has no NULL product_sk", 1),
        ("fct_sales products exist in dim_product", 1),
    ]
    assert failed(quality.dq_relationships(tables), "parent") == []


def test_fingerprint_sees_where_nulls_are(spark):
    one, two = (spark.createDataFrame([row], "a string, b string") for row in ((None, "a"), ("a", None)))
    assert quality.fingerprint(one).first() != quality.fingerprint(two).first()
    assert quality.fingerprint(one).first() == quality.fingerprint(one.repartition(3)).first()


def test_not_null_unique_relationships(spark):
    tables = warehouse(spark, *GOOD)
    assert failed(quality.dq_not_null(tables), "column_name") == []
    assert failed(quality.dq_unique(tables), "column_name") == []
    assert failed(quality.dq_relationships(tables), "parent") == []
    tables["fct_sales"] = tables["fct_sales"].withColumn("product_sk", F.lit(None).cast("string"))
    tables["fct_orders"] = tables["fct_orders"].withColumn("invoice_no", F.lit("1"))
    tables["dim_customer"] = tables["dim_customer"].limit(0)
    assert failed(quality.dq_not_null(tables), "table_name", "column_name", "nulls") == [
        ("fct_sales", "product_sk", 3)
    ]
    assert failed(quality.dq_unique(tables), "table_name", "column_name", "repeated") == [
        ("fct_orders", "invoice_no", 1)
    ]
    assert failed(quality.dq_relationships(tables), "parent", "orphans") == [("dim_customer", 2)]


def test_freshness(spark):
    raw = raw_frame(spark, {}, {"_loaded_at": LOADED_AT - timedelta(days=9)})

    def status(hours):
        return quality.dq_freshness(raw, LOADED_AT + timedelta(hours=hours)).first().status

    assert [status(h) for h in (0, 36, 36.5, 72, 72.5)] == ["pass", "pass", "warn", "warn", "error"]
    assert quality.dq_freshness(raw.limit(0), LOADED_AT).first().status == "error"


def monthly(spark, counts, **changes):
    """``counts[i]`` lines in month ``i + 1`` of 2011."""
    lines = [
        {"invoice_date": datetime(2011, m + 1, d % 28 + 1), "invoice": f"{m}-{d}", **changes}
        for m, n in enumerate(counts)
        for d in range(n)
    ]
    return raw_frame(spark, *lines)


def test_volume(spark):
    rows = {r.load: r for r in quality.dq_volume(monthly(spark, [10, 11, 9, 30, 10])).collect()}
    assert [rows[f"2011-0{m}"].passed for m in range(1, 6)] == [True, True, True, False, True]
    assert rows["2011-04"].baseline_rows == 10.0
    assert all(r.advanced for r in rows.values())


def test_a_load_that_stands_still_fails(spark):
    """The second load repeats the last day of the first, the third goes back."""
    days = {0: 5, 1: 5, 2: 3, 3: 9}
    raw = raw_frame(
        spark,
        *[{"_loaded_at": LOADED_AT + timedelta(days=k), "invoice_date": datetime(2011, 1, d)} for k, d in days.items()],
    )
    rows = quality.dq_volume(raw, load=F.col("_loaded_at")).orderBy("load").collect()
    assert [r.advanced for r in rows] == [True, False, False, True]
    assert [r.passed for r in rows] == [True, False, False, True]


def test_null_rate(spark):
    raw = raw_frame(spark, *([{}] * 77), *([{"customer_id": None}] * 22), {"price": None, "quantity": -1})
    rows = {r.metric: r for r in quality.dq_null_rate(raw).collect()}
    assert rows["null_customer_id"].observed == 0.22 and rows["null_customer_id"].passed
    assert rows["null_price"].observed == 0.01 and not rows["null_price"].passed
    assert rows["nonpositive_quantity"].passed


def test_metric_anomaly(spark):
    found = quality.dq_metric_anomaly(monthly(spark, [10, 11, 9, 10, 11, 60]))
    odd = {(r.metric, r.load) for r in found.filter("anomalous").collect()}
    assert odd == {("n_rows", "2011-06"), ("revenue", "2011-06")}


def test_schema_contract(spark):
    tables = warehouse(spark, *GOOD)
    assert failed(quality.dq_schema_contract(tables), "table_name") == []
    tables["stg"] = tables["stg"].drop("country").withColumn("quantity", F.col("quantity").cast("int"))
    assert failed(quality.dq_schema_contract(tables), "table_name", "problems") == [
        ("stg", "missing column country (string); column quantity is int, expected bigint")
    ]


def test_profile(spark):
    row = quality.dq_profile(
        raw_frame(
            spark,
            {},
            {},
            {},
            {"customer_id": None, "description": None},
            {"invoice": "C9", "quantity": -1},
            {"price": 0.0, "stock_code": "DOT", "invoice_date": None},
        )
    ).first()
    assert row.asDict() == {
        "null_customer_id": 1,
        "cancellations": 1,
        "nonpositive_quantity": 1,
        "nonpositive_price": 1,
        "service_lines": 1,
        "null_description": 1,
        "null_invoice_date": 1,
        "duplicate_lines": 2,
    }


def test_rebuild_notices_a_changed_value(spark):
    tables = warehouse(spark, *GOOD)
    changed = dict(tables, stg=tables["stg"].withColumn("quantity", F.col("quantity") + 1))
    rows = {r.table_name: r.identical for r in quality.rebuild_idempotent(tables, changed).collect()}
    assert rows.pop("stg") is False and all(rows.values())
