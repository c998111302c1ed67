from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillroll.functions.columns import (
    clean_customer_id,
    is_cancellation,
    is_service_code,
    money,
    ratio,
    record_hash,
    surrogate_key,
    text_or,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, expected",
    [
        ("13085.0", "13085"),
        (" 13085.0\t", "13085"),
        ("13085", "13085"),
        ("1.0.0", "1.0"),
        ("X7.0", "X7"),
        ("130.05", "130.05"),
        (".0", ""),
        ("", None),
        ("  \n", None),
        (None, None),
    ],
)
def test_clean_customer_id(spark, text, expected):
    assert one(spark, clean_customer_id(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(
    "code, service",
    [
        ("85123A", False),
        ("POST", True),
        ("M", True),
        ("BANK CHARGES", True),
        ("gift_0001_20", True),
        ("TEST001", True),
        ("123", False),  # shorter integers count as products
        ("+1234", False),
        (" 1234", False),
        ("", True),
        ("12.50", True),
        ("1e3", True),
        ("0x1F", True),
        (None, True),
    ],
)
def test_service_codes(spark, code, service):
    assert one(spark, is_service_code(F.lit(code).cast("string"))) is service


def test_cancellation_is_case_sensitive(spark):
    assert one(spark, is_cancellation(F.lit("C489449"))) is True
    assert one(spark, is_cancellation(F.lit("c489449"))) is False
    assert one(spark, is_cancellation(F.lit(None).cast("string"))) is None


def test_text_defaults(spark):
    assert one(spark, text_or(F.lit("  lamp "), "UNKNOWN")) == "lamp"
    assert one(spark, text_or(F.lit("   "), "UNKNOWN")) == "UNKNOWN"
    assert one(spark, text_or(F.lit(None).cast("string"), "UNKNOWN")) == "UNKNOWN"


def hash_of(spark, invoice, stock, quantity, when, price, customer):
    return one(
        spark,
        record_hash(
            F.lit(invoice).cast("string"),
            F.lit(stock).cast("string"),
            F.lit(quantity).cast("bigint"),
            F.lit(when).cast("timestamp_ntz"),
            F.lit(price).cast("double"),
            F.lit(customer).cast("string"),
        ),
    )


@pytest.mark.parametrize("price", [0.0, 2.1, 2.55, 11062.06, -11062.06, 0.001, 1e6, 1234567.8901, -0.00001, -0.00004, 0.00001, -0.00009])
def test_record_hash_text(spark, price):
    expected = f"489434|85048|12|2009-12-01 07:45:00|{price:.4f}|13085"
    digest = hash_of(spark, "489434", "85048", 12, datetime(2009, 12, 1, 7, 45), price, "13085")
    assert digest == hashlib.md5(expected.encode()).hexdigest()


def test_record_hash_of_a_tie_rounds_up(spark):
    """The decided text of a price whose fifth and last decimal is 5 (printf would give 2.6757)."""
    expected = hashlib.md5(b"1|2|3||2.6758|").hexdigest()
    assert hash_of(spark, "1", "2", 3, None, 2.67575, None) == expected


def test_record_hash_of_missing_parts(spark):
    expected = hashlib.md5(b"489434|85048||||").hexdigest()
    assert hash_of(spark, "489434", "85048", None, None, None, None) == expected
    assert hash_of(spark, "489434", "85048", None, None, float("nan"), None) == expected


def test_surrogate_key_is_stable(spark):
    assert one(spark, surrogate_key(F.lit(13085))) == hashlib.md5(b"13085").hexdigest()
    assert one(spark, surrogate_key(F.lit(None).cast("bigint"))) is None


def test_money_has_nine_decimals(spark):
    assert str(one(spark, money(F.lit(0.1) * 3))) == "0.300000000"


def test_ratio_of_zero(spark):
    assert one(spark, ratio(F.lit(1), F.lit(0), 1)) is None
    assert one(spark, ratio(F.lit(1), F.lit(3), 1, scale=100)) == 33.3
