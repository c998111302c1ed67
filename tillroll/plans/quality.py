"""Data-quality checks. Each returns result rows; none stops the pipeline by itself."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.functions.columns import is_cancellation, is_service_code, month, ratio
from tillroll.operators.orphans import orphan_rows
from tillroll.plans import marts
from tillroll.schemas import CONTRACTS, contract_problems
from tillroll.sources.scratch import shuffles_removed

Tables = Mapping[str, DataFrame]

# Columns that may not be NULL, columns that may not repeat, and foreign keys (fixed values).
NOT_NULL = {
    "stg": ["line_sk", "invoice_no", "stock_code", "is_service_line", "has_customer", "is_valid_sale"],
    "dim_customer": ["customer_sk", "customer_id"],
    "dim_product": ["product_sk", "stock_code", "is_service_line"],
    "fct_sales": ["line_sk", "product_sk"],
    "fct_orders": ["invoice_no"],
}
UNIQUE = {
    "stg": ["line_sk"],
    "dim_customer": ["customer_sk", "customer_id"],
    "dim_product": ["product_sk", "stock_code"],
    "fct_sales": ["line_sk"],
    "fct_orders": ["invoice_no"],
}
# (child, parent, key); NULL keys, such as a guest's, are exempt.
RELATIONSHIPS = [
    ("fct_sales", "dim_product", "product_sk"),
    ("fct_sales", "dim_customer", "customer_sk"),
]

# Freshness limits in hours (fixed values).
WARN_AFTER_HOURS = 36
ERROR_AFTER_HOURS = 72

# Usual share of raw lines with each defect, and how far it may stray (fixed values).
USUAL_RATES = {
    "null_customer_id": (0.23, 0.05),
    "null_price": (0.0, 0.0),
    "null_quantity": (0.0, 0.0),
    "nonpositive_price": (0.006, 0.005),
    "nonpositive_quantity": (0.022, 0.02),
}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _number(df: DataFrame, value: Column) -> Column:
    """One aggregate of ``df`` as a scalar subquery."""
    return df.agg(value).scalar()


def _rows_of(tables: Tables, name: str) -> DataFrame:
    """The row count of a table, as one row: from what was counted when it was written, if it was."""
    if hasattr(tables, "row_count"):
        counted = F.lit(tables.row_count(name)).cast("bigint")
        return tables[name].sparkSession.range(1).select(counted.alias("n"))
    return tables[name].agg(F.count("*").alias("n"))


def _line_keys(tables: Tables) -> DataFrame:
    """Lines per key of the fact; tables that are held or published have them rolled up."""
    return tables["line_keys"] if hasattr(tables, "figure_rows") else marts.line_keys(tables["fct_sales"])


def _lines_with(keys: DataFrame, column: str, condition: Column | bool = True) -> DataFrame:
    chosen = keys.filter((F.col("key_column") == column) & F.lit(condition))
    return chosen.agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n"))


def _orphan_lines(keys: DataFrame, parent: DataFrame, column: str, null_is_orphan: bool = False) -> DataFrame:
    """Lines whose key no row of ``parent`` has; NULL keys are exempt unless ``null_is_orphan``."""
    own = keys.filter(F.col("key_column") == column).select(F.col("key").alias(column), "n_lines")
    own = own if null_is_orphan else own.filter(F.col(column).isNotNull())
    lost = own.join(parent.select(column), column, "left_anti")
    return lost.agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("orphans"))


def dq_assertions(tables: Tables) -> DataFrame:
    """The six build assertions: grain, keys and referential integrity.

    Counts that were taken while tables were written, and the roll-up of the fact's keys, answer all but
    two of them; those read the hashes of the raw lines and the keys of the customers.
    """
    raw, customers, keys = tables["raw"], tables["dim_customer"], _line_keys(tables)
    no_key = F.col("key").isNull()
    zero = F.lit(0).cast("bigint")

    def check(name: str, observed: DataFrame, expected: Column) -> DataFrame:
        """``observed`` is a one-row, one-column frame."""
        value = F.col(observed.columns[0]).cast("bigint")
        row = observed.select(F.lit(name).alias("check"), value.alias("observed"), expected.alias("expected"))
        return row.withColumn("passed", F.col("observed") == F.col("expected"))

    return _union(
        [
            check(
                "staging rows equal distinct raw lines",
                _rows_of(tables, "stg"),
                _number(raw, F.count_distinct(F.unhex("_record_hash"))),
            ),
            check(
                "fct_sales rows equal staging rows",
                _lines_with(keys, "product_sk"),
                _rows_of(tables, "stg").scalar(),
            ),
            check("fct_sales has no NULL product_sk", _lines_with(keys, "product_sk", no_key), zero),
            check(
                "dim_customer.customer_sk is unique",
                _rows_of(tables, "dim_customer"),
                _number(customers, F.count_distinct("customer_sk")),
            ),
            check(
                "fct_sales products exist in dim_product",
                _orphan_lines(keys, tables["dim_product"], "product_sk", null_is_orphan=True),
                zero,
            ),
            check("fct_sales customers exist in dim_customer", _orphan_lines(keys, customers, "customer_sk"), zero),
        ]
    )


def dq_not_null(tables: Tables, columns: Mapping[str, list[str]] = NOT_NULL) -> DataFrame:
    """NULLs per guarded column, as counted when the tables were written; else one pass per table."""

    def table_rows(name: str, guarded: list[str]) -> DataFrame:
        counts = tables[name].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in guarded])
        return counts.unpivot([], guarded, "column_name", "nulls").withColumn("table_name", F.lit(name))

    if hasattr(tables, "figure_rows"):
        wanted = [(F.col("table_name") == name) & F.col("column_name").isin(guarded) for name, guarded in columns.items()]
        rows = tables.figure_rows().filter(reduce(Column.__or__, wanted))
    else:
        rows = _union([table_rows(name, guarded) for name, guarded in columns.items()])
    return rows.select("table_name", "column_name", "nulls", (F.col("nulls") == 0).alias("passed"))


def dq_unique(tables: Tables, columns: Mapping[str, list[str]] = UNIQUE) -> DataFrame:
    """How many non-NULL values occur more than once, per guarded column."""

    def column_row(name: str, column: str) -> DataFrame:
        values = tables[name].filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        return values.agg(F.count_if(F.col("n") > 1).alias("repeated")).select(
            F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "repeated"
        )

    rows = _union([column_row(name, c) for name, guarded in columns.items() for c in guarded])
    return rows.withColumn("passed", F.col("repeated") == 0)


def dq_relationships(tables: Tables, keys: list[tuple[str, str, str]] = RELATIONSHIPS) -> DataFrame:
    """Child rows whose key has no parent row; the fact's keys are counted once for all of its parents."""

    def orphans(child: str, parent: str, key: str) -> DataFrame:
        if child == "fct_sales" and key in ("product_sk", "customer_sk"):
            return _orphan_lines(_line_keys(tables), tables[parent], key)
        return orphan_rows(tables[child], tables[parent], key)

    rows = _union(
        [
            orphans(child, parent, key).select(
                F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.lit(key).alias("key"), "orphans"
            )
            for child, parent, key in keys
        ]
    )
    return rows.withColumn("passed", F.col("orphans") == 0)


def dq_freshness(
    raw: DataFrame,
    now: datetime,
    warn_hours: int = WARN_AFTER_HOURS,
    error_hours: int = ERROR_AFTER_HOURS,
) -> DataFrame:
    """Age of the newest load at ``now`` (an aware datetime) and what it means."""
    loaded = raw.agg(F.max("_loaded_at").alias("max_loaded_at"))
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("max_loaded_at")) / 3600.0
    aged = loaded.withColumn("age_hours", F.round(age, 2))
    stale = F.col("max_loaded_at").isNull() | (F.col("age_hours") > error_hours)
    status = F.when(stale, "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass")
    return aged.withColumn("status", status)


def _per_load(raw: DataFrame, load: Column | None = None) -> DataFrame:
    """Row count, missing ids, exact revenue and last day of each load; without ``load`` an invoice month.

    Loads are few, months at most a few hundred, so the trailing windows below run over as many rows.
    """
    key = month(F.col("invoice_date")) if load is None else load
    return raw.groupBy(key.alias("load")).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("customer_id").isNull()).alias("n_null_ids"),
        F.sum((F.col("quantity") * F.col("price")).cast("decimal(38,9)")).alias("revenue"),
        F.max(F.col("invoice_date").cast("date")).alias("max_invoice_date"),
    )


def dq_volume(
    raw: DataFrame, trailing: int = 6, tolerance: float = 0.5, load: Column | None = None
) -> DataFrame:
    """Is each load's row count within a band around the trailing mean, and does its last day advance?

    ``load`` tells loads apart and orders them, such as ``_loaded_at`` or ``_source_sheet``; invoice months,
    the default, advance by their nature. The first load has nothing to compare with and passes.
    """
    by_load = Window.orderBy("load")
    baseline = by_load.rowsBetween(-trailing, -1)
    mean = F.sum("n_rows").over(baseline) / F.count("n_rows").over(baseline)
    checked = (
        _per_load(raw, load)
        .select("load", "n_rows", "max_invoice_date")
        .withColumn("_mean", F.when(F.count("n_rows").over(baseline) > 0, mean))
        .withColumn("_before", F.max("max_invoice_date").over(by_load.rowsBetween(Window.unboundedPreceding, -1)))
    )
    strays = F.abs(F.col("n_rows") - F.col("_mean")) > F.lit(tolerance) * F.col("_mean")
    return checked.select(
        "load",
        "n_rows",
        F.round("_mean", 2).alias("baseline_rows"),
        F.coalesce(~strays, F.lit(True)).alias("in_band"),
        "max_invoice_date",
        F.coalesce(F.col("max_invoice_date") > F.col("_before"), F.lit(True)).alias("advanced"),
    ).withColumn("passed", F.col("in_band") & F.col("advanced"))


def dq_null_rate(raw: DataFrame, rates: Mapping[str, tuple[float, float]] = USUAL_RATES) -> DataFrame:
    """Observed share of each defect against its usual share; one pass over raw."""
    defects = {
        "null_customer_id": F.col("customer_id").isNull(),
        "null_price": F.col("price").isNull(),
        "null_quantity": F.col("quantity").isNull(),
        "nonpositive_price": F.col("price") <= 0,
        "nonpositive_quantity": F.col("quantity") <= 0,
    }
    shares = raw.agg(*[ratio(F.count_if(defects[d]), F.count("*"), 6).alias(d) for d in rates])
    rows = [
        F.struct(
            F.lit(d).alias("metric"),
            F.col(d).alias("observed"),
            F.lit(float(usual)).alias("expected"),
            F.lit(float(stray)).alias("tolerance"),
        )
        for d, (usual, stray) in rates.items()
    ]
    return shares.select(F.inline(F.array(*rows))).withColumn(
        "passed", F.abs(F.col("observed") - F.col("expected")) <= F.col("tolerance")
    )


def dq_metric_anomaly(
    raw: DataFrame, trailing: int = 6, z_limit: float = 3.0, load: Column | None = None
) -> DataFrame:
    """Z-score of each load's row count, missing-id rate and revenue against the trailing loads.

    ``load`` tells loads apart and orders them; without it a load is an invoice month.
    """
    rate = F.try_divide(F.col("n_null_ids").cast("double"), F.col("n_rows").cast("double"))
    metrics = _per_load(raw, load).select(
        "load",
        F.col("n_rows").cast("double").alias("n_rows"),
        rate.alias("null_id_rate"),
        F.col("revenue").cast("double").alias("revenue"),
    )
    long = metrics.unpivot(["load"], ["n_rows", "null_id_rate", "revenue"], "metric", "value")
    baseline = Window.partitionBy("metric").orderBy("load").rowsBetween(-trailing, -1)
    scored = long.withColumn("_mean", F.avg("value").over(baseline)).withColumn(
        "_sd", F.stddev_samp("value").over(baseline)
    )
    z = F.round(F.try_divide(F.col("value") - F.col("_mean"), F.col("_sd")), 2)
    return scored.select(
        "metric",
        "load",
        F.round("value", 4).alias("value"),
        z.alias("z_score"),
        F.coalesce(F.abs(z) > z_limit, F.lit(False)).alias("anomalous"),
    )


def dq_schema_contract(tables: Tables, contracts=CONTRACTS) -> DataFrame:
    """One row per table: its rows, its deviations from the contract, and whether it has none.

    :func:`tillroll.schemas.require_contract` is the variant that fails the load.
    """

    def table_row(name: str) -> DataFrame:
        problems = contract_problems(tables[name].schema, contracts[name])
        return _rows_of(tables, name).select(
            F.lit(name).alias("table_name"),
            F.lit(len(contracts[name])).cast("bigint").alias("n_columns"),
            F.col("n").alias("n_rows"),
            F.lit("; ".join(problems)).alias("problems"),
            F.lit(not problems).alias("passed"),
        )

    return _union([table_row(name) for name in tables if name in contracts])


def dq_profile(raw: DataFrame) -> DataFrame:
    """Counts of each kind of messy raw line. Only the copies need a shuffle, of the hash alone."""
    copies = raw.groupBy("_record_hash").agg((F.count("*") - 1).alias("extra"))
    return raw.agg(
        F.count_if(F.col("customer_id").isNull()).alias("null_customer_id"),
        F.count_if(is_cancellation(F.col("invoice"))).alias("cancellations"),
        F.count_if(F.col("quantity") <= 0).alias("nonpositive_quantity"),
        F.count_if(F.col("price") <= 0).alias("nonpositive_price"),
        F.count_if(is_service_code(F.col("stock_code"))).alias("service_lines"),
        F.count_if(F.col("description").isNull()).alias("null_description"),
        F.count_if(F.col("invoice_date").isNull()).alias("null_invoice_date"),
    ).select("*", copies.agg(F.coalesce(F.sum("extra"), F.lit(0))).scalar().alias("duplicate_lines"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free content hash, as one row.

    The hash skips NULLs, so which values are NULL is hashed with them.
    """
    values = [F.col(c) for c in df.columns]
    digest = F.xxhash64(*[v.isNull() for v in values], *values).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(digest).alias("digest"))


def rebuild_idempotent(first: Tables, second: Tables | Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """Do two builds from the same raw lines hold the same rows?

    The second is read when called, one table after the other and each once, so it may be deleted on the way.
    """
    again = {}
    for name, table in second.items() if isinstance(second, Mapping) else second:
        with shuffles_removed(table.sparkSession):
            again[name] = fingerprint(table).first()

    def table_row(name: str) -> DataFrame:
        return fingerprint(first[name]).select(
            F.lit(name).alias("table_name"),
            F.col("n_rows").alias("rows_first"),
            F.lit(again[name]["n_rows"]).cast("bigint").alias("rows_second"),
            F.col("digest").eqNullSafe(F.lit(again[name]["digest"]).cast("decimal(38, 0)")).alias("identical"),
        )

    return _union([table_row(name) for name in first])
