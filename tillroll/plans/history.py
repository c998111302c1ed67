"""What each load looked like, kept from run to run, and how loads compare with those before them.

History tables have a folder per load. Recording a load writes its folder and no other, so a load that runs
again replaces its own rows, and loads can be recorded side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tillroll.sources.sheets import Sheet

METRICS_SCHEMA = "metric string, value double, load string"
COLUMNS_SCHEMA = "position int, column_name string, data_type string, nullable boolean, load string"

# Loads that a z-score needs before it says anything.
LEAST_LOADS = 2


def load_metrics(raw: DataFrame, load: Column) -> DataFrame:
    """(metric, value, load) of every load in ``raw``; ``load`` names the load of a line."""
    number = F.count("*").cast("double")

    def share(condition: Column) -> Column:
        return F.try_divide(F.count_if(condition).cast("double"), number)

    per_load = raw.groupBy(load.cast("string").alias("load")).agg(
        number.alias("n_rows"),
        share(F.col("customer_id").isNull()).alias("null_id_rate"),
        share(F.col("price") <= 0).alias("nonpositive_price_rate"),
        F.sum((F.col("quantity") * F.col("price")).cast("decimal(38,9)")).cast("double").alias("revenue"),
    )
    names = [c for c in per_load.columns if c != "load"]
    return per_load.unpivot(["load"], names, "metric", "value").select("metric", "value", "load")


def landed_columns(spark: SparkSession, schema: StructType, load: str) -> DataFrame:
    """(position, column_name, data_type, nullable, load) of what one load brought, as it came."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable, load) for k, f in enumerate(schema.fields, 1)]
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def record(rows: DataFrame, path: str) -> None:
    """Add the loads in ``rows`` to the history at ``path``; a load that is there already is replaced."""
    writer = rows.repartition("load").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("load").parquet(path)


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The history at ``path``."""
    return spark.read.schema(schema).parquet(path)


def load_anomalies(history: DataFrame, trailing: int = 6, z_limit: float = 3.0) -> DataFrame:
    """Z-score of each metric of each recorded load against the ``trailing`` loads before it.

    Loads go by name, such as a date or a time. A value that differs from a metric that never varied before
    is anomalous without a z-score; the first LEAST_LOADS loads have nothing to compare with.
    """
    baseline = Window.partitionBy("metric").orderBy("load").rowsBetween(-trailing, -1)
    scored = history.select(
        "load",
        "metric",
        "value",
        F.count("value").over(baseline).alias("_known"),
        F.avg("value").over(baseline).alias("_mean"),
        F.stddev_samp("value").over(baseline).alias("_sd"),
    )
    off = F.col("value") - F.col("_mean")
    z = F.when(F.col("_known") >= LEAST_LOADS, F.try_divide(off, F.col("_sd")))
    level = (F.col("_known") >= LEAST_LOADS) & (F.col("_sd") == 0) & (off != 0)
    return scored.select(
        "load",
        "metric",
        F.round("value", 4).alias("value"),
        F.round(z, 2).alias("z_score"),
        F.coalesce((F.abs(z) > z_limit) | level, F.lit(False)).alias("anomalous"),
    )


def schema_drift(history: DataFrame) -> DataFrame:
    """(load, column_name, problem): what each recorded load changed against the load before it.

    Columns are matched by name; a column can be added, missing, of another type, at another place among
    the columns both have, or newly nullable. No rows for a load that changed nothing.
    """
    loads = history.select("load").distinct()
    # One row per load.
    pairs = loads.select("load", F.lag("load").over(Window.orderBy("load")).alias("before")).filter("before IS NOT NULL")
    now = history.join(pairs, "load").select("load", "before", "column_name", F.struct("position", "data_type", "nullable").alias("now"))
    then = history.select(F.col("load").alias("before"), "column_name", F.struct("position", "data_type", "nullable").alias("then"))
    then = then.join(pairs, "before").select("load", "before", "column_name", "then")
    both = now.join(then, ["load", "before", "column_name"], "full_outer")
    shared = F.col("now").isNotNull() & F.col("then").isNotNull()
    # Where a column stands among those both loads have.
    among = Window.partitionBy("load").orderBy
    placed = both.select(
        "*",
        F.sum(shared.cast("int")).over(among(F.asc_nulls_last("now.position"))).alias("_now"),
        F.sum(shared.cast("int")).over(among(F.asc_nulls_last("then.position"))).alias("_then"),
    )
    kinds = F.concat(F.lit("type "), F.col("then.data_type"), F.lit(" became "), F.col("now.data_type"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("then").isNull(), F.concat(F.lit("added as "), F.col("now.data_type"))),
            F.when(F.col("now").isNull(), F.concat(F.lit("missing, was "), F.col("then.data_type"))),
            F.when(shared & (F.col("now.data_type") != F.col("then.data_type")), kinds),
            F.when(
                shared & (F.col("_now") != F.col("_then")),
                F.format_string("place %d became %d", F.col("_then"), F.col("_now")),
            ),
            F.when(shared & F.col("now.nullable") & ~F.col("then.nullable"), F.lit("nullable now")),
        )
    )
    return placed.select("load", "column_name", F.explode(problems).alias("problem"))


def record_load(raw: DataFrame, sheets: list[Sheet], load: str, path: str) -> dict[str, DataFrame]:
    """Record a load's figures and the columns of its sheets below ``path``; what stands out against the past.

    ``raw`` is the landed table. Recording the same load again replaces it.
    """
    spark = raw.sparkSession
    record(load_metrics(raw, F.lit(load)), f"{path}/metrics")
    found = {"load_history": load_anomalies(recorded(spark, f"{path}/metrics", METRICS_SCHEMA))}
    for sheet in sheets:
        folder = f"{path}/columns-{sheet.name}"
        record(landed_columns(spark, sheet.frame.schema, load), folder)
        found[f"schema_drift_{sheet.name}"] = schema_drift(recorded(spark, folder, COLUMNS_SCHEMA))
    return found
