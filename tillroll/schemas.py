"""Table contracts: column names, types and physical layout of every warehouse table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

MONEY = DecimalType(38, 9)

_STR, _INT, _BOOL = StringType(), LongType(), BooleanType()
_DATE, _LOCAL, _INSTANT = DateType(), TimestampNTZType(), TimestampType()


def _table(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


# Column headings of a source sheet and the names they land under (fixed values).
SHEET_COLUMNS = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "price",
    "Customer ID": "customer_id",
    "Country": "country",
}

# Types a column of a source sheet may have; CSV fields are text and typed on landing (fixed values).
_TEXT = ("string",)
_WHOLE = ("tinyint", "smallint", "int", "bigint")
SHEET_TYPES: dict[str, tuple[str, ...]] = {
    "Invoice": _TEXT,
    "StockCode": _TEXT,
    "Description": _TEXT,
    "Quantity": (*_TEXT, *_WHOLE),
    "InvoiceDate": (*_TEXT, "date", "timestamp", "timestamp_ntz"),
    "Price": (*_TEXT, "float", "double"),
    "Customer ID": (*_TEXT, *_WHOLE, "float", "double"),
    "Country": _TEXT,
}

RAW = _table(
    invoice=_STR,
    stock_code=_STR,
    description=_STR,
    quantity=_INT,
    invoice_date=_LOCAL,
    price=DoubleType(),
    customer_id=_STR,
    country=_STR,
    _source_file=_STR,
    _source_sheet=_STR,
    _source_row=_INT,
    _loaded_at=_INSTANT,
    _record_hash=_STR,
)

STG = _table(
    line_sk=_STR,
    invoice_no=_STR,
    stock_code=_STR,
    description=_STR,
    quantity=_INT,
    unit_price=MONEY,
    line_revenue=MONEY,
    invoice_ts=_LOCAL,
    invoice_date=_DATE,
    customer_id=_INT,
    country=_STR,
    is_cancellation=_BOOL,
    is_return_or_zero=_BOOL,
    is_nonpositive_price=_BOOL,
    is_service_line=_BOOL,
    has_customer=_BOOL,
    is_valid_sale=_BOOL,
    source_file=_STR,
    loaded_at=_INSTANT,
)

DIM_CUSTOMER = _table(
    customer_sk=_STR,
    customer_id=_INT,
    primary_country=_STR,
    first_purchase_date=_DATE,
    last_purchase_date=_DATE,
    lifetime_orders=_INT,
    lifetime_net_revenue=MONEY,
)

DIM_PRODUCT = _table(
    product_sk=_STR,
    stock_code=_STR,
    description=_STR,
    is_service_line=_BOOL,
    first_seen_date=_DATE,
    last_seen_date=_DATE,
)

FCT_SALES = _table(
    line_sk=_STR,
    invoice_no=_STR,
    customer_sk=_STR,
    product_sk=_STR,
    invoice_date=_DATE,
    invoice_ts=_LOCAL,
    quantity=_INT,
    unit_price=MONEY,
    line_revenue=MONEY,
    is_cancellation=_BOOL,
    is_service_line=_BOOL,
    has_customer=_BOOL,
)

FCT_ORDERS = _table(
    invoice_no=_STR,
    customer_sk=_STR,
    invoice_date=_DATE,
    invoice_ts=_LOCAL,
    country=_STR,
    n_lines=_INT,
    n_units=_INT,
    order_revenue=MONEY,
    is_cancellation=_BOOL,
)

RFM = _table(
    customer_sk=_STR,
    customer_id=_INT,
    primary_country=_STR,
    recency_days=_INT,
    frequency=_INT,
    monetary=MONEY,
    r=_INT,
    f=_INT,
    m=_INT,
    segment=_STR,
)

CONTRACTS: dict[str, StructType] = {
    "raw": RAW,
    "stg": STG,
    "dim_customer": DIM_CUSTOMER,
    "dim_product": DIM_PRODUCT,
    "fct_sales": FCT_SALES,
    "fct_orders": FCT_ORDERS,
    "rfm": RFM,
}

# Physical layout: day-partitioned tables and the columns rows are clustered by (fixed values).
# Raw keeps a timestamp, so its partition day is a derived column of the files.
RAW_DAY = "invoice_day"
PARTITION_DAY = {
    "raw": RAW_DAY,
    "stg": "invoice_date",
    "fct_sales": "invoice_date",
    "fct_orders": "invoice_date",
}
CLUSTER_BY = {
    "raw": ["invoice", "stock_code"],
    "stg": ["customer_id", "stock_code"],
    "dim_customer": ["customer_sk"],
    "dim_product": ["product_sk"],
    "fct_sales": ["customer_sk", "product_sk"],
    "fct_orders": ["customer_sk"],
}


class ContractError(ValueError):
    """A table does not have the columns and types its contract declares."""


def contract_problems(actual: StructType, expected: StructType) -> list[str]:
    """Every added, missing or re-typed column, as readable text."""
    have = {f.name: f.dataType for f in actual.fields}
    repeated = sorted({n for n in actual.names if actual.names.count(n) > 1})
    want = {f.name: f.dataType for f in expected.fields}
    problems = [f"repeated column {c}" for c in repeated]
    problems += [f"missing column {c} ({t.simpleString()})" for c, t in want.items() if c not in have]
    problems += [f"unexpected column {c} ({t.simpleString()})" for c, t in have.items() if c not in want]
    problems += [
        f"column {c} is {have[c].simpleString()}, expected {t.simpleString()}"
        for c, t in want.items()
        if c in have and have[c] != t
    ]
    return problems


def sheet_problems(actual: StructType) -> list[str]:
    """Every added, missing, repeated or re-typed column of a source sheet, as readable text."""
    kinds = {f.name: f.dataType.simpleString() for f in actual.fields}
    problems = [f"repeated column {c}" for c in sorted(kinds) if actual.names.count(c) > 1]
    problems += [f"missing column {c}" for c in SHEET_TYPES if c not in kinds]
    problems += [f"unexpected column {c} ({t})" for c, t in kinds.items() if c not in SHEET_TYPES]
    problems += [
        f"column {c} is {t}, expected one of {', '.join(SHEET_TYPES[c])}"
        for c, t in kinds.items()
        if c in SHEET_TYPES and t not in SHEET_TYPES[c]
    ]
    return problems


def require_contract(df: DataFrame, name: str) -> DataFrame:
    """Return ``df`` in contract column order, or raise :class:`ContractError`."""
    problems = contract_problems(df.schema, CONTRACTS[name])
    if problems:
        raise ContractError(f"{name}: " + "; ".join(problems))
    return df.select(*CONTRACTS[name].names)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast the contract's columns (what a typed warehouse load does)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CONTRACTS[name].fields])
