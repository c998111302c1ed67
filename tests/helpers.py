"""Small literal frames for the rule tests."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.functions.columns import record_hash
from tillroll.schemas import CONTRACTS, conform

LOADED_AT = datetime(2011, 12, 10, tzinfo=timezone.utc)
DAY = datetime(2011, 1, 5, 10, 30)

_DEFAULTS = {
    "invoice": "1",
    "stock_code": "85123A",
    "description": "LAMP",
    "quantity": 1,
    "invoice_date": DAY,
    "price": 1.0,
    "customer_id": "7",
    "country": "France",
    "_source_file": "f",
    "_source_sheet": "A",
    "_loaded_at": LOADED_AT,
}


def raw_frame(spark: SparkSession, *changes: dict) -> DataFrame:
    """Raw lines that differ from a plain sale by ``changes``; rows are numbered from 2."""
    names = [c for c in CONTRACTS["raw"].names if c != "_record_hash"]
    rows = [{**_DEFAULTS, "_source_row": i + 2, **change} for i, change in enumerate(changes)]
    schema = CONTRACTS["raw"].__class__([f for f in CONTRACTS["raw"].fields if f.name != "_record_hash"])
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    line = ["invoice", "stock_code", "quantity", "invoice_date", "price", "customer_id"]
    return conform(df.withColumn("_record_hash", record_hash(*[F.col(c) for c in line])), "raw")
