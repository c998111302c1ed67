"""Column builders for cleaning, keys, flags and money."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tillroll.schemas import MONEY

# Characters stripped around a customer id: every Unicode white-space character (fixed values).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed values of the staging rules.
UNKNOWN_DESCRIPTION = "UNKNOWN"
UNSPECIFIED_COUNTRY = "Unspecified"
CANCELLATION_PREFIX = "C"
PRODUCT_CODE_DIGITS = 5


def clean_customer_id(value: Column) -> Column:
    """Stripped id text without one trailing ``.0``; blank and NULL become NULL."""
    text = F.btrim(value.cast("string"), F.lit(WHITESPACE))
    without_fraction = F.substring(text, F.lit(1), F.length(text) - 2)
    return F.when(text == "", None).when(text.endswith(".0"), without_fraction).otherwise(text)


def text_or(value: Column, default: str) -> Column:
    """Trimmed text, or ``default`` where it is NULL or blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def record_hash(
    invoice: Column,
    stock_code: Column,
    quantity: Column,
    invoice_date: Column,
    price: Column,
    customer_id: Column,
) -> Column:
    """MD5 of the natural line. Description and country are not part of it.

    The price enters with four decimals, rounded half up from its shortest decimal text by a decimal
    cast, which is much cheaper per row than a printf format. The texts agree but for a price whose
    fifth and last decimal is 5: printf rounds the binary value, which may lie below the tie. A negative
    price that rounds to zero keeps its sign as in printf. NULL parts enter as empty text.
    """
    rounded = price.try_cast("decimal(38,4)").cast("string")
    price_text = F.when((price < 0) & (rounded == "0.0000"), F.lit("-0.0000")).otherwise(rounded)
    parts = [
        invoice,
        stock_code,
        quantity.cast("string"),
        invoice_date.cast("string"),
        price_text,
        customer_id,
    ]
    return F.md5(F.concat_ws("|", *[F.coalesce(part, F.lit("")) for part in parts]))


# The columns of a raw line that tell it from others, as they enter its hash (fixed values).
NATURAL_LINE = ["invoice", "stock_code", "quantity", "invoice_date", "price", "customer_id"]


def line_hash() -> Column:
    """:func:`record_hash` of a raw line."""
    return record_hash(*[F.col(c) for c in NATURAL_LINE])


def line_place() -> list[Column]:
    """Day, invoice and a number, which lines of equal :func:`line_hash` share.

    The parts of a hashed text are told apart by its bars. Where a part holds one, other parts could give the
    same text; such a line has neither day nor invoice, and its number is that of its hash.
    """
    texts = [F.col(c) for c in ("invoice", "stock_code", "customer_id")]
    unclear = reduce(Column.__or__, [F.coalesce(text.contains("|"), F.lit(False)) for text in texts])
    invoice, stock_code, customer_id = [F.coalesce(text, F.lit("")) for text in texts]
    number = F.xxhash64(invoice, stock_code, F.col("quantity"), F.col("invoice_date"), customer_id)
    return [
        F.when(~unclear, F.to_date("invoice_date")),
        F.when(~unclear, invoice),
        F.when(unclear, F.xxhash64(line_hash())).otherwise(number),
    ]


def surrogate_key(natural_key: Column) -> Column:
    """Lower-case hex MD5 of the natural key's text; NULL stays NULL."""
    return F.md5(natural_key.cast("string"))


def is_cancellation(invoice: Column) -> Column:
    return invoice.startswith(CANCELLATION_PREFIX)


def is_service_code(stock_code: Column) -> Column:
    """True unless the code starts with an integer; NULL codes count as service."""
    return F.substring(stock_code, 1, PRODUCT_CODE_DIGITS).try_cast("bigint").isNull()


def money(value: Column) -> Column:
    return value.cast(MONEY)


def ratio(numerator: Column, denominator: Column, digits: int, scale: int = 1) -> Column:
    """``scale * numerator / denominator`` rounded; NULL on a zero denominator.

    Both sides are exact sums or counts, so the result does not depend on row order.
    """
    quotient = F.try_divide(F.lit(float(scale)) * numerator.cast("double"), denominator.cast("double"))
    return F.round(quotient, digits)


def most_frequent(value: Column, count: Column, where: Column) -> Column:
    """Aggregate over pre-counted rows: the value with the highest count, lowest value on ties."""
    return F.min(F.when(where, F.struct((-count).alias("rank"), value.alias("value")))).getField("value")


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
