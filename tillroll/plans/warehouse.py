"""Builds the tables in dependency order and publishes them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import date, datetime
from threading import RLock

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.functions.columns import line_hash
from tillroll.plans import analytics, campaign, marts, quality, rfm as scoring, staging
from tillroll.schemas import CONTRACTS, require_contract
from tillroll.sources import layout
from tillroll.sources.observed import Figures, counted, scanned
from tillroll.sources.scratch import hold, hold_buckets, release
from tillroll.sources.sinks import read_table_files, save_table, write_table_files

# Every model and the tables it is built from, in build order.
MODELS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "stg": (("raw",), staging.stg_lines),
    "order_parts": (("stg",), marts.order_parts),
    "countries": (("order_parts",), marts.countries),
    "product_texts": (("stg",), marts.product_texts),
    "dim_customer": (("order_parts", "countries"), marts.dim_customer),
    "dim_product": (("stg", "product_texts"), marts.dim_product),
    "fct_sales": (("stg",), marts.fct_sales),
    "line_keys": (("fct_sales",), marts.line_keys),
    "fct_orders": (("order_parts", "countries"), marts.fct_orders),
    "rfm": (("dim_customer",), scoring.rfm),
}

# Intermediate roll-ups, not part of the published schema.
INTERNAL = {"order_parts", "countries", "product_texts", "line_keys"}
TABLES = ["raw", *[name for name in MODELS if name not in INTERNAL]]

# Their models return a written table.
WRITTEN = {"countries", "product_texts"}

# Pure per-row projections: reading their parent again is cheaper than a second copy of every line.
VIEWS = {"fct_sales"}


# Held tables whose keys are compared with each other, and the key they are dealt into buckets by.
BUCKETED = {"line_keys": "key", "dim_customer": "customer_sk", "dim_product": "product_sk"}

# Held tables have a folder per month: a day of a few thousand lines would not fill a file.
GRAIN = "month"


class Warehouse(Mapping[str, DataFrame]):
    """The tables of one raw load, each built on first use and written once.

    Staging has many consumers, so it, the roll-ups and the marts are written to shared storage instead of
    being recomputed; ``fct_sales`` stays a view over staging. Dated tables have a folder per period of
    ``grain`` ("day", "month", "year", or None for none), so that :meth:`between` opens only what a date
    range touches. The dimensions and the fact's keys lie in ``buckets`` by key (as many as the session has
    shuffle partitions, if not given), so references are checked without moving them. Row and NULL counts
    are taken while a table is written (:meth:`figures`).
    """

    def __init__(
        self,
        raw: Callable[[], DataFrame],
        grain: str | None = GRAIN,
        buckets: int | None = None,
        unwritten: frozenset[str] = frozenset(),
    ):
        self._raw = raw
        self._grain = grain
        self._buckets = buckets
        self._unwritten = unwritten
        self._built: dict[str, DataFrame] = {}
        self._figures: dict[str, Figures] = {}
        self._given: set[str] = set()
        self._lock = RLock()

    @classmethod
    def over(cls, raw: DataFrame) -> Warehouse:
        """The tables of a raw table that has already landed."""
        warehouse = cls(lambda: raw)
        warehouse._built["raw"] = require_contract(raw, "raw")
        warehouse._given.add("raw")
        return warehouse

    def again(self) -> Warehouse:
        """A second, independent build from the same source, to be read once: tables that none is built from are
        not written."""
        parents = {parent for needed, _ in MODELS.values() for parent in needed}
        return Warehouse(self._raw, self._grain, self._buckets, frozenset(MODELS) - parents - VIEWS)

    def in_turn(self) -> Iterator[tuple[str, DataFrame]]:
        """The names and tables in build order, each to be read before the next is asked for.

        A table is deleted as soon as no later one is built from it, so that all never lie there at once.
        """
        needed = set(TABLES)
        for name in reversed(MODELS):
            if name in needed:
                needed |= _sources(name)
        turns = [name for name in ("raw", *MODELS) if name in needed]
        for k, name in enumerate(turns):
            table = self[name]
            if name in TABLES:
                yield name, table
            later = set().union(*map(_sources, turns[k + 1 :]))
            for done in set(turns[: k + 1]) - later:
                self._delete(done)

    def close(self) -> None:
        """Delete the tables from shared storage; they must not be read any more."""
        with self._lock:
            for name in [*self._built]:
                self._delete(name)

    def _delete(self, name: str) -> None:
        with self._lock:
            table = self._built.pop(name, None)
            if table is not None and name not in VIEWS | self._unwritten | self._given:
                release(table)

    def __getitem__(self, name: str) -> DataFrame:
        return self._whole(name).drop(layout.PERIOD)

    def between(self, name: str, first: date | None = None, last: date | None = None) -> DataFrame:
        """The rows of a dated table from ``first`` to ``last``, both included."""
        if name in VIEWS:
            parents, model = MODELS[name]
            return model(*[self.between(parent, first, last) for parent in parents])
        if not self._in_folders(name) or name in self._unwritten:
            return _day_range(self[name], name, first, last)
        return layout.between(self._whole(name), name, self._grain, first, last).drop(layout.PERIOD)

    def figures(self, name: str) -> Figures:
        """Row and NULL counts of a table, as they were when it was written.

        A view's keys are counted by its roll-up of keys; its other columns are its parent's.
        """
        with self._lock:
            self[name]
            if name in self._given | self._unwritten:
                self._figures.setdefault(name, scanned(self[name]))
            if name not in self._figures:
                parent = self.figures(MODELS[name][0][0])
                lines = F.sum("n_lines")
                of_keys = self["line_keys"].groupBy("key_column").agg(
                    lines.alias("n_rows"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n_lines"))), F.lit(0)).alias("nulls")
                )
                keys = {r["key_column"]: r for r in of_keys.collect()}
                rows = keys["product_sk"]["n_rows"] if keys else 0
                nulls = {c: keys[c]["nulls"] if c in keys else parent.nulls.get(c, 0) for c in self[name].columns}
                self._figures[name] = Figures(rows, nulls)
            return self._figures[name]

    def row_count(self, name: str) -> int:
        """Rows of a table, as they were when it was written; a view, which is per row, has those of its parent."""
        return self.figures(MODELS[name][0][0] if name in VIEWS else name).rows

    def figure_rows(self) -> DataFrame:
        """(table_name, column_name, n_rows, nulls) of every table, a written table."""
        with self._lock:
            if "figures" not in self._built:
                figures = {name: self.figures(name) for name in TABLES}
                self._built["figures"] = _figure_rows(self["raw"].sparkSession, figures)
            return self._built["figures"]

    def _in_folders(self, name: str) -> bool:
        return self._grain is not None and layout.in_folders(name) and name not in VIEWS

    def _whole(self, name: str) -> DataFrame:
        """The table with the column of its folders."""
        with self._lock:
            if name not in self._built:
                self._built[name] = self._build(name)
            return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def _build(self, name: str) -> DataFrame:
        if name == "raw":
            return self._held_raw(require_contract(self._raw(), "raw"))
        parents, model = MODELS[name]
        table = model(*[self[parent] for parent in parents])
        return table if name in VIEWS | WRITTEN | self._unwritten else self._held(name, table)

    def _held_raw(self, raw: DataFrame) -> DataFrame:
        """The raw lines, held without hashes that follow from the other columns; those are worked out on reading."""
        given = F.when(~F.col("_record_hash").eqNullSafe(line_hash()), F.struct(F.col("_record_hash").alias("hash")))
        held, figures = counted(raw.withColumn("_given", given).drop("_record_hash"), "raw", hold)
        again = F.when(F.col("_given").isNull(), line_hash()).otherwise(F.col("_given.hash"))
        lines = held.withColumn("_record_hash", again).drop("_given")
        nulls = {c: n for c, n in figures.nulls.items() if c != "_given"} | {"_record_hash": 0}
        all_follow = figures.nulls["_given"] == figures.rows
        self._figures["raw"] = Figures(figures.rows, nulls) if all_follow else scanned(lines)
        return lines

    def _held(self, name: str, table: DataFrame) -> DataFrame:
        if name in BUCKETED:
            key = BUCKETED[name]
            n = self._buckets or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            written, self._figures[name] = counted(
                table.repartition(n, key), name, lambda df, label: hold_buckets(df, label, key, n)
            )
            return written
        if not self._in_folders(name):
            written, self._figures[name] = counted(table, name, hold)
            return written
        arranged = layout.with_period(table, name, self._grain)
        written, self._figures[name] = counted(arranged, name, lambda df, label: hold(df, label, layout.PERIOD))
        return written


class Published(Mapping[str, DataFrame]):
    """Tables that were written for others to read, with the counts taken on the way.

    Dated tables have a folder per day, so a date range opens those of its days.
    """

    def __init__(self, tables: dict[str, DataFrame], figures: dict[str, Figures]):
        self._tables = tables
        self._figures = figures
        self._figure_rows: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def between(self, name: str, first: date | None = None, last: date | None = None) -> DataFrame:
        """The rows of a dated table from ``first`` to ``last``, both included."""
        return _day_range(self[name], name, first, last)

    def row_count(self, name: str) -> int:
        """Rows of a table, as they were when it was written."""
        return self._figures[name].rows

    def figure_rows(self) -> DataFrame:
        """(table_name, column_name, n_rows, nulls) of every table, as they were when it was written."""
        if self._figure_rows is None:
            self._figure_rows = _figure_rows(self["raw"].sparkSession, self._figures)
        return self._figure_rows


def _sources(name: str) -> set[str]:
    """The tables that a model reads when it is built; of a view also those that it is made of."""
    parents = set(MODELS[name][0]) if name in MODELS else set()
    return parents.union(*[_sources(parent) for parent in parents & VIEWS])


def _day_range(table: DataFrame, name: str, first: date | None, last: date | None) -> DataFrame:
    day = F.col(layout.day_column(name))
    table = table if first is None else table.filter(day >= F.lit(first))
    return table if last is None else table.filter(day <= F.lit(last))


def _figure_rows(spark: SparkSession, figures: Mapping[str, Figures]) -> DataFrame:
    rows = [(name, c, f.rows, n) for name, f in figures.items() for c, n in f.nulls.items() if c != layout.PERIOD]
    schema = "table_name string, column_name string, n_rows bigint, nulls bigint"
    return hold(spark.createDataFrame(rows, schema).coalesce(1), "figures")


def publish_files(raw: DataFrame, path: str) -> Published:
    """Write every table under ``path``, replacing what is there; models read their written parent."""
    spark = raw.sparkSession

    def publish(name: str, table: DataFrame) -> tuple[DataFrame, Figures]:
        figures = write_table_files(table, name, f"{path}/{name}")
        return read_table_files(spark, name, f"{path}/{name}"), figures

    return _publish(raw, publish)


def publish_catalog(raw: DataFrame, database: str, staging_as_view: bool = False) -> Published:
    """Save every table in ``database``; staging may stay a temporary view instead of a table.

    A view is counted by a pass of its own.
    """
    spark = raw.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def publish(name: str, table: DataFrame) -> tuple[DataFrame, Figures]:
        if name == "stg" and staging_as_view:
            table.createOrReplaceTempView("stg")
            return table, scanned(table)
        figures = save_table(table, name, database)
        return spark.table(f"{database}.{name}").select(*CONTRACTS[name].names), figures

    return _publish(raw, publish)


def _publish(raw: DataFrame, publish: Callable[[str, DataFrame], tuple[DataFrame, Figures]]) -> Published:
    tables, figures = {}, {}
    tables["raw"], figures["raw"] = publish("raw", require_contract(raw, "raw"))
    for name, (parents, model) in MODELS.items():
        table = model(*[tables[parent] for parent in parents])
        if name in INTERNAL:
            tables[name] = table if name in WRITTEN else hold(table, name)
        else:
            tables[name], figures[name] = publish(name, table)
    return Published(tables, figures)


def analysis(
    tables: Warehouse | Published, start_date: date, campaign_day: date | None = None, country: str | None = None
) -> dict[str, DataFrame]:
    """Every result set of a run by name; ``start_date`` opens the best-seller period.

    ``campaign_day`` adds what came of a win-back campaign that began on it, ``country`` the lapsed big
    spenders there.
    """
    customers, products = tables["dim_customer"], tables["dim_product"]
    sales, orders, rfm = tables["fct_sales"], tables["fct_orders"], tables["rfm"]
    asked = {}
    if campaign_day is not None:
        asked["winback_outcome"] = campaign.outcome(tables, campaign_day)
    if country is not None:
        asked["lapsed_top_customers"] = campaign.lapsed_top_customers(customers, country)
    return asked | {
        # questions
        "top_customers": analytics.q1_top_customers(customers),
        "monthly_revenue": analytics.q2_monthly_revenue(sales),
        "outlier_orders": analytics.q3_outlier_orders(orders),
        "country_revenue": analytics.q4_country_revenue(orders),
        "top_products": analytics.q5_top_products(tables.between("fct_sales", start_date), products, start_date),
        "segments": scoring.rfm_segments(rfm),
        "totals": scoring.headline_totals(customers, rfm, sales),
        "repeat": scoring.repeat_rate(customers),
        "pareto": scoring.pareto_top20(rfm),
        "winback_target": scoring.winback_target(rfm),
        # explorer
        "kpi": analytics.kpi_row(customers, orders, sales),
        "monthly_trend": analytics.monthly_trend(sales),
        "explorer_segments": scoring.explorer_segments(rfm),
        "top_products_all_time": analytics.top_products_all_time(sales, products),
        "geography": analytics.geo_top_k(orders),
        "order_counts": analytics.order_count_distribution(customers),
        # campaign
        "winback_customers": campaign.winback_holdout(rfm),
        "winback_impact": campaign.winback_impact(rfm),
    }


def checks(tables: Mapping[str, DataFrame], now: datetime) -> dict[str, DataFrame]:
    """The checks a run must pass, by name. All have ``passed``; freshness only fails on an error."""
    fresh = quality.dq_freshness(tables["raw"], now)
    return {
        "assertions": quality.dq_assertions(tables),
        "not_null": quality.dq_not_null(tables),
        "unique": quality.dq_unique(tables),
        "relationships": quality.dq_relationships(tables),
        "schema": quality.dq_schema_contract(tables),
        "freshness": fresh.withColumn("passed", F.col("status") != "error"),
    }


def monitors(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Figures to watch, by name: they report what is unusual and stop nothing."""
    raw = tables["raw"]
    return {
        "volume": quality.dq_volume(raw),
        "null_rate": quality.dq_null_rate(raw),
        "anomaly": quality.dq_metric_anomaly(raw),
        "profile": quality.dq_profile(raw),
    }
