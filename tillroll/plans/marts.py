"""Dimensions and facts, each computed from staging.

Every aggregation runs in two steps: lines are first combined per (key, value), which collapses most
of them before the shuffle and spreads a hot key over its values, and only those groups are brought
together per key. Extremes of strings are taken of their codes (:mod:`tillroll.operators.codes`), so all
are hash aggregations.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from tillroll.functions.columns import UNKNOWN_DESCRIPTION, most_frequent, surrogate_key
from tillroll.operators.codes import (
    decoded,
    dictionary,
    encoded,
    greatest_by_hash,
    most_frequent_code,
    numbered,
)
from tillroll.schemas import CONTRACTS, conform


def order_parts(stg: DataFrame) -> DataFrame:
    """Staging rolled up to what an order consists of: the shared input of the customer dimension
    and the order fact, so that lines are shuffled once for both.

    One row per (invoice, day, customer, country, product-or-service). All running values are
    fixed-width, which keeps this a hash aggregation.
    """
    return stg.groupBy("invoice_no", "invoice_date", "customer_id", "country", "is_service_line").agg(
        F.min("invoice_ts").alias("invoice_ts"),
        F.count("*").alias("n_lines"),
        F.sum("quantity").alias("n_units"),
        F.sum("line_revenue").alias("revenue"),
        F.max("is_cancellation").alias("is_cancellation"),
    )


def countries(parts: DataFrame) -> DataFrame:
    """Every country and its code; a written table."""
    return dictionary(parts, "country")


def dim_customer(parts: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """One row per numeric customer id; purchase figures cover product lines only.

    ``codes`` are the :func:`countries` of ``parts``; without them they are written first.

    Grouping sets add up each (customer, invoice) and each (customer, country) pair in one pass, so
    the distinct orders and the modal country need neither a second scan nor a join. Customers seen
    only on service lines keep zero orders and revenue and NULL dates.
    """
    codes = countries(parts) if codes is None else codes
    product = ~F.col("is_service_line")
    pairs = (
        encoded(parts.filter(F.col("customer_id").isNotNull()), codes, "country")
        .groupingSets(
            [["customer_id", "invoice_no"], ["customer_id", "country_code"]],
            "customer_id",
            "invoice_no",
            "country_code",
        )
        .agg(
            (F.grouping("country_code") == 1).alias("per_invoice"),
            F.sum("n_lines").alias("n_lines"),
            F.max(product).alias("has_product"),
            F.min(F.when(product, F.col("invoice_date"))).alias("first_date"),
            F.max(F.when(product, F.col("invoice_date"))).alias("last_date"),
            F.sum(F.when(product, F.col("revenue"))).alias("revenue"),
        )
    )
    per_invoice = F.col("per_invoice")
    bought = per_invoice & F.col("invoice_no").isNotNull() & F.col("has_product")
    customers = pairs.groupBy("customer_id").agg(
        most_frequent_code(F.col("country_code"), F.col("n_lines"), where=~per_invoice).alias("country_code"),
        F.min("first_date").alias("first_purchase_date"),
        F.max("last_date").alias("last_purchase_date"),
        F.count_if(bought).alias("lifetime_orders"),
        F.coalesce(F.sum(F.when(per_invoice, F.col("revenue"))), F.lit(0)).alias("lifetime_net_revenue"),
    )
    named = decoded(customers, codes, "country").withColumnRenamed("country", "primary_country")
    return conform(named.withColumn("customer_sk", surrogate_key(F.col("customer_id"))), "dim_customer")


def dim_customer_as_of(parts: DataFrame, days: list[date]) -> DataFrame:
    """:func:`dim_customer` as it stood at the end of each of ``days``, with the day as ``as_of``.

    One pass for all days: what changes between one day and the next is added up per customer and country,
    the lines of a country stand for all days up to its next change, and running sums carry the rest on. Lines
    after the last day and lines without a day take no part.

    Order parts are moved by order, so a hot customer is spread, then as one row per customer, country and day,
    of which a customer has few; from there on all is worked out where the rows of a customer lie.
    """
    days = sorted(set(days))
    ends = F.array(*[F.lit(d) for d in days])
    # The first of the days that has seen a line.
    slot = F.size(F.filter(ends, lambda d: d < F.col("invoice_date")))
    product = ~F.col("is_service_line")
    seen = (
        parts.filter(F.col("customer_id").isNotNull() & (F.col("invoice_date") <= F.lit(days[-1])))
        .select(
            "customer_id",
            "invoice_no",
            "country",
            slot.alias("slot"),
            "n_lines",
            # No part without a day is left, so a part has one here if it is of products.
            F.when(product, F.col("invoice_date")).alias("day"),
            F.when(product, F.col("revenue")).alias("revenue"),
        )
        .repartition("customer_id", "invoice_no")
    )
    # An invoice counts as an order from the first day that has seen a product line of it.
    in_order = Window.partitionBy("customer_id", "invoice_no").orderBy(F.asc_nulls_last("day"))
    opens = (F.row_number().over(in_order) == 1) & F.col("day").isNotNull() & F.col("invoice_no").isNotNull()
    changes = (
        seen.withColumn("opens", opens)
        .groupBy("customer_id", "country", "slot")
        .agg(
            F.sum("n_lines").alias("n_lines"),
            F.count_if("opens").alias("orders"),
            F.min("day").alias("first_date"),
            F.max("day").alias("last_date"),
            F.sum("revenue").alias("revenue"),
        )
        .repartition("customer_id")
    )
    per_country = Window.partitionBy("customer_id", "country").orderBy("slot")
    carried = changes.select(
        "*",
        F.sum("n_lines").over(per_country).alias("lines_so_far"),
        F.lead("slot", 1, len(days)).over(per_country).alias("_next"),
    ).withColumn("on", F.explode(F.sequence("slot", F.col("_next") - 1)))
    new = F.col("on") == F.col("slot")
    per_day = carried.groupBy("customer_id", "on").agg(
        most_frequent(F.col("country"), F.col("lines_so_far"), where=F.lit(True)).alias("primary_country"),
        F.sum(F.when(new, F.col("orders"))).alias("orders"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum(F.when(new, F.col("revenue"))).alias("revenue"),
    )
    so_far = Window.partitionBy("customer_id").orderBy("on")
    customers = per_day.select(
        ends[F.col("on")].alias("as_of"),
        surrogate_key(F.col("customer_id")).alias("customer_sk"),
        "customer_id",
        "primary_country",
        F.min("first_date").over(so_far).alias("first_purchase_date"),
        F.max("last_date").over(so_far).alias("last_purchase_date"),
        F.coalesce(F.sum("orders").over(so_far), F.lit(0)).alias("lifetime_orders"),
        F.coalesce(F.sum("revenue").over(so_far), F.lit(0)).alias("lifetime_net_revenue"),
    )
    columns = CONTRACTS["dim_customer"].fields
    return customers.select("as_of", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])


def product_texts(stg: DataFrame) -> DataFrame:
    """Every stock code with each of its texts, and codes in the order of the texts; a written table."""
    texts = stg.groupBy("stock_code", "description").agg(
        F.count("*").alias("n_lines"),
        F.max("is_service_line").alias("is_service_line"),
        F.min("invoice_date").alias("first_date"),
        F.max("invoice_date").alias("last_date"),
    )
    return numbered(texts, "description")


def dim_product(stg: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per stock code, described by its most frequent real text.

    ``texts`` are the :func:`product_texts` of ``stg``; without them they are written first.
    """
    texts = product_texts(stg) if texts is None else texts
    real_text = F.col("stock_code").isNotNull() & (F.col("description") != UNKNOWN_DESCRIPTION)
    modal_text = most_frequent_code(F.col("description_code"), F.col("n_lines"), where=real_text)
    products = texts.groupBy("stock_code").agg(
        modal_text.alias("description_code"),
        F.max("is_service_line").alias("is_service_line"),
        F.min("first_date").alias("first_seen_date"),
        F.max("last_date").alias("last_seen_date"),
    )
    described = decoded(products, texts.select("description_code", "description"), "description")
    named = described.withColumn("description", F.coalesce("description", F.lit(UNKNOWN_DESCRIPTION)))
    return conform(named.withColumn("product_sk", surrogate_key(F.col("stock_code"))), "dim_product")


def fct_sales(stg: DataFrame) -> DataFrame:
    """Every line with its foreign keys. Keys are hashes, so no dimension has to be joined."""
    keyed = stg.withColumns(
        {
            # Guests, and ids that are not numbers, have a NULL customer_id and so a NULL key.
            "customer_sk": surrogate_key(F.col("customer_id")),
            "product_sk": surrogate_key(F.col("stock_code")),
        }
    )
    return conform(keyed, "fct_sales")


def line_keys(sales: DataFrame) -> DataFrame:
    """How many lines have each product key and each customer key, NULL included: one pass over the fact.

    Whether keys are there and have a row in their dimension is told from these counts alone.
    """
    pairs = sales.groupingSets([["product_sk"], ["customer_sk"]], "product_sk", "customer_sk").agg(
        (F.grouping("product_sk") == 0).alias("_product"), F.count("*").alias("n_lines")
    )
    return pairs.select(
        F.when(F.col("_product"), "product_sk").otherwise("customer_sk").alias("key_column"),
        F.when(F.col("_product"), F.col("product_sk")).otherwise(F.col("customer_sk")).alias("key"),
        "n_lines",
    )


def fct_orders(parts: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """One row per invoice.

    ``codes`` are the :func:`countries` of ``parts``; without them they are written first.
    """
    codes = countries(parts) if codes is None else codes
    customer = F.col("customer_id")
    orders = encoded(parts, codes, "country").groupBy("invoice_no").agg(
        greatest_by_hash(customer, surrogate_key(customer)).alias("customer_id"),
        F.min("invoice_date").alias("invoice_date"),
        F.min("invoice_ts").alias("invoice_ts"),
        F.min("country_code").alias("country_code"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("n_units").alias("n_units"),
        F.sum("revenue").alias("order_revenue"),
        F.max("is_cancellation").alias("is_cancellation"),
    )
    keyed = decoded(orders, codes, "country").withColumn("customer_sk", surrogate_key(F.col("customer_id")))
    return conform(keyed, "fct_orders")
