"""What large tables cost: lines are moved once, and what follows from other columns is not stored."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import date, datetime
from pathlib import Path
from time import sleep

from pyspark.sql import functions as F

from tests.helpers import raw_frame
from tillroll.functions.columns import line_place
from tillroll.operators.dedup import frequent
from tillroll.plans import marts
from tillroll.plans.quality import dq_schema_contract, rebuild_idempotent
from tillroll.plans.staging import dedup_lines, stg_lines
from tillroll.plans.warehouse import TABLES, Warehouse
from tillroll.sources import layout
from tillroll.sources.scratch import hold, hold_buckets, release
from tillroll.sources.sheets import read_csv_sheet


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def no_broadcast_by_size(spark):
    """As with tables too large for Spark to broadcast by itself."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def test_staging_moves_lines_once_and_without_their_hash(spark):
    arranged = plan(layout.with_period(stg_lines(raw_frame(spark, {})), "stg", "month"))
    assert arranged.count("Exchange") == 1
    assert "AS _record_hash" in arranged.split("Exchange")[0]


def test_staging_keeps_the_rows_of_dedup(spark):
    """Copies over sheets, texts that only a bar tells apart, missing parts, bad days, prices of equal text."""
    raw = raw_frame(
        spark,
        {"_source_sheet": "B"},
        {"description": "kept"},
        {"invoice": "1|2", "stock_code": "3"},
        {"invoice": "1", "stock_code": "2|3"},
        {"invoice": "1", "stock_code": "2", "quantity": 3},
        {"customer_id": None},
        {"customer_id": ""},
        {"invoice": None, "invoice_date": None, "quantity": None},
        {"invoice": "", "invoice_date": None, "quantity": None},
        {"invoice": "|", "customer_id": None, "invoice_date": None},
        {"price": 1.00004},
        {"invoice_date": datetime(2011, 2, 5)},
    )
    kept = sorted((r._record_hash, r._source_file, r.description) for r in dedup_lines(raw).collect())
    staged = sorted((r.line_sk, r.source_file, r.description) for r in stg_lines(raw).collect())
    assert staged == kept and len(kept) == 7


def test_copies_of_frequent_lines_are_trimmed_before_the_shuffle(spark):
    """Nine thousand copies of a line travel as one row a task; of the other lines none is lost."""
    copies = raw_frame(spark, {}).crossJoin(spark.range(9000)).withColumn("_source_row", F.col("id") + 2).drop("id")
    others = raw_frame(spark, *[{"invoice": str(i)} for i in range(2, 302)])
    raw = copies.unionByName(others).repartition(4)
    assert len(frequent(raw, line_place()[-1])) == 1
    assert "1, Partial" in plan(stg_lines(raw)).split("rangepartitioning")[1]
    staged = stg_lines(raw)
    assert staged.count() == staged.select("line_sk").distinct().count() == 301


def test_raw_is_held_without_hashes_that_follow(spark):
    raw = raw_frame(spark, {}, {"invoice": "2"})
    tables = Warehouse(lambda: raw)
    assert sorted(map(tuple, tables["raw"].collect())) == sorted(map(tuple, raw.collect()))
    held = spark.read.parquet(tables["raw"].inputFiles()[0].rsplit("/", 1)[0])
    assert "_record_hash" not in held.columns and held.filter("_given is not null").count() == 0
    assert tables.figures("raw").rows == 2 and tables.figures("raw").nulls["_record_hash"] == 0


def test_other_hashes_are_held(spark):
    raw = raw_frame(spark, {}, {"invoice": "2"}, {"invoice": "3"}).withColumn(
        "_record_hash", F.when(F.col("invoice") == "1", "own").when(F.col("invoice") == "3", F.col("_record_hash"))
    )
    tables = Warehouse(lambda: raw)
    assert sorted(map(str, tables["raw"].collect())) == sorted(map(str, raw.collect()))
    assert tables.figures("raw").nulls["_record_hash"] == 1


def test_numbering_csv_lines_moves_no_lines(spark, tmp_path):
    """The join with the few rows about file blocks is no shuffle of lines, however many lines there are."""
    head = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
    (tmp_path / "a.csv").write_text(head + "1,2,LAMP,3,2011-01-01 00:00:00,4.0,5.0,France\n")
    with no_broadcast_by_size(spark):
        for multiline in (False, True):
            frame = read_csv_sheet(spark, str(tmp_path), "A", multiline).frame
            assert "SortMergeJoin" not in plan(frame)
            assert frame.count() == 1


def test_a_second_build_writes_only_what_others_are_built_from(spark):
    raw = raw_frame(spark, {}, {"invoice": "2", "customer_id": "8"})
    first = Warehouse(lambda: raw)
    second = first.again()
    assert all(r.identical for r in rebuild_idempotent({name: first[name] for name in TABLES}, second).collect())
    assert {name for name in TABLES if "Exchange" in plan(second[name])} >= {"dim_product", "fct_orders"}
    assert second.figures("fct_orders").rows == first.figures("fct_orders").rows
    second.close()


def test_a_second_build_in_turn_keeps_what_is_still_read(spark):
    raw = raw_frame(spark, {}, {"invoice": "2", "customer_id": "8"})
    first = Warehouse(lambda: raw)
    second = first.again()
    files, there = {}, {}

    def watched():
        for name, table in second.in_turn():
            files[name] = Path(table.inputFiles()[0].removeprefix("file:"))
            there[name] = {other for other, file in files.items() if file.exists()}
            yield name, table

    rows = rebuild_idempotent({name: first[name] for name in TABLES}, watched()).collect()
    assert [r.table_name for r in rows] == TABLES and all(r.identical and r.rows_first == r.rows_second for r in rows)
    assert set(files) == set(TABLES) and "raw" in there["stg"]
    assert "raw" not in there["dim_customer"] and "stg" in there["fct_sales"] and "stg" not in there["rfm"]
    assert not any(file.exists() for file in files.values())
    assert first["stg"].count() == 2


def test_a_held_table_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffles():
        names = map(str, (blocks.getAllBlocks().apply(k) for k in range(blocks.getAllBlocks().size())))
        return {name for name in names if name.startswith("shuffle_")}

    before, switch = shuffles(), spark.conf.get(key)
    groups = spark.range(1000).groupBy((F.col("id") % 10).alias("key")).agg(F.count("*").alias("n"))
    held = [hold(groups, "groups"), hold_buckets(groups.repartition(4, "key"), "groups", "key", 4)]
    for _ in range(50):
        if not shuffles() - before:
            break
        sleep(0.1)
    assert not shuffles() - before
    assert [table.count() for table in held] == [10, 10] and spark.conf.get(key) == switch
    for table in held:
        release(table)


def test_customers_of_many_days_move_orders_twice_and_changes_once(spark):
    """Past days, however many, take no join and no shuffle of their own."""
    parts = Warehouse.over(raw_frame(spark, {}, {"invoice": "2", "country": "Spain"}))["order_parts"]
    with no_broadcast_by_size(spark):
        steps = plan(marts.dim_customer_as_of(parts, [date(2010, 1, 1), date(2011, 2, 1), date(2011, 3, 1)]))
    assert steps.count("Exchange") == 3 and "Join" not in steps


def test_schema_contract_counts_rows_without_the_roll_up_of_keys(spark):
    raw = raw_frame(spark, {}, {"invoice": "2", "customer_id": None}, {"_source_sheet": "B"})
    tables = Warehouse(lambda: raw)
    rows = {r.table_name: r.n_rows for r in dq_schema_contract(tables).collect()}
    assert "line_keys" not in tables._built
    assert rows == {name: table.count() for name, table in tables.items()}


def test_orders_travel_with_keys_of_bytes(spark):
    tables = Warehouse.over(raw_frame(spark, {}, {"invoice": "2", "customer_id": None}, {"invoice": "3"}))
    orders = marts.fct_orders(tables["order_parts"], tables["countries"])
    arranged = layout.with_period(orders, "fct_orders", "month")
    assert "unhex" in plan(arranged).split("REBALANCE")[1]
    kept = sorted(map(str, arranged.drop(layout.PERIOD).select(*orders.columns).collect()))
    assert kept == sorted(map(str, orders.collect()))
