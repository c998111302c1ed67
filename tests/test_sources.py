from __future__ import annotations

import csv
import json
import random
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.helpers import LOADED_AT, raw_frame
from tillroll.__main__ import main
from tillroll.plans import quality
from tillroll.plans.warehouse import TABLES, Warehouse, checks, publish_catalog, publish_files
from tillroll.schemas import CONTRACTS, ContractError, require_contract
from tillroll.sources.scratch import scratch_root
from tillroll.sources.sheets import land, read_csv_sheet, read_parquet_sheet
from tillroll.sources.sinks import current_path, read_table_files, write_metrics, write_parquet, write_table_files

HEADINGS = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]


def write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(HEADINGS)
        writer.writerows(rows)


def line(i: int, **changes) -> list:
    row = {
        "Invoice": f"{i}",
        "StockCode": "85123A",
        "Description": f'say "hi", é {i}',
        "Quantity": 2,
        "InvoiceDate": "2010-12-01 08:26:00",
        "Price": 2.55,
        "Customer ID": "17850.0",
        "Country": "France",
    }
    row.update(changes)
    return [row[h] for h in HEADINGS]


def test_csv_sheets_land(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [line(1), line(2, InvoiceDate="not a date"), line(3, **{"Customer ID": " "})])
    write_csv(tmp_path / "b.csv", [line(4, Invoice="C489449", Quantity=-1)])
    sheets = [read_csv_sheet(spark, str(tmp_path / f"{s}.csv"), s.upper()) for s in "ab"]
    raw = land(sheets, LOADED_AT)
    require_contract(raw, "raw")
    rows = {r.invoice: r for r in raw.collect()}
    assert rows["1"].description == 'say "hi", é 1'
    assert rows["1"].invoice_date == datetime(2010, 12, 1, 8, 26)
    assert rows["1"].customer_id == "17850" and rows["3"].customer_id is None
    assert rows["2"].invoice_date is None
    assert (rows["3"]._source_file, rows["3"]._source_sheet, rows["3"]._source_row) == ("a.csv", "A", 4)
    assert (rows["C489449"]._source_sheet, rows["C489449"]._source_row) == ("B", 2)
    assert rows["C489449"].quantity == -1
    assert raw.select(F.count_distinct("_loaded_at")).first()[0] == 1


def test_bad_number_fails_the_load(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [line(1, Quantity="many")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        land([read_csv_sheet(spark, str(tmp_path / "a.csv"), "A")], LOADED_AT).collect()


@pytest.mark.parametrize(
    "text",
    [
        "1,85123A,x,2,2010-12-01 08:26:00,2.55,17850.0,France,surplus,more",
        "1,85123A,x",
        '1,85123A,"never closed,2,2010-12-01 08:26:00,2.55,17850.0,France',
        '1,85123A,x,2,2010-12-01 08:26:00,2.55,17850.0,"broken\nacross lines"',
    ],
    ids=["long", "short", "open quote", "line break"],
)
def test_broken_lines_fail_the_load(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(",".join(HEADINGS) + "\n" + text + "\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|open quote"):
        read_csv_sheet(spark, str(tmp_path / "a.csv"), "A")


@pytest.mark.parametrize(
    "headings",
    [[*HEADINGS, "Extra"], HEADINGS[:-1], [HEADINGS[1], HEADINGS[0], *HEADINGS[2:]], [h.lower() for h in HEADINGS]],
    ids=["added", "missing", "order", "spelling"],
)
def test_other_headings_fail_the_load(spark, tmp_path, headings):
    write_csv(tmp_path / "a.csv", [line(1)])
    (tmp_path / "b.csv").write_text(",".join(headings) + "\n")
    with pytest.raises(Exception, match="headings are|MALFORMED_RECORD"):
        read_csv_sheet(spark, str(tmp_path), "A")


def test_blank_lines_are_counted_but_hold_no_row(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [line(1), [], line(2), [], []])
    rows = read_csv_sheet(spark, str(tmp_path / "a.csv"), "A").frame.collect()
    assert sorted((r.Invoice, r.SourceRow) for r in rows) == [("1", 2), ("2", 4)]


def test_line_breaks_in_fields_need_multiline(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [line(1, Description="two\nlines"), line(2)])
    rows = read_csv_sheet(spark, str(tmp_path / "a.csv"), "A", multiline=True).frame.collect()
    assert sorted((r.Invoice, r.Description, r.SourceRow) for r in rows) == [
        ("1", "two\nlines", 2),
        ("2", 'say "hi", é 2', 3),
    ]
    (tmp_path / "b.csv").write_text(",".join(HEADINGS) + "\n1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_csv_sheet(spark, str(tmp_path / "b.csv"), "B", multiline=True).frame.collect()
    (tmp_path / "c.csv").write_text(",".join(HEADINGS) + '\n1,2,"3\n')
    with pytest.raises(ContractError, match="open quote"):
        read_csv_sheet(spark, str(tmp_path / "c.csv"), "C", multiline=True)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_across_splits(spark, tmp_path, end):
    """Random quoted files, cut at every few bytes, hold the rows a reader of the whole file finds."""
    draw = random.Random(len(end))
    marks = ["a", "b c", "\n", "\n\n", '"', '""', ",", "", "é", ";", '"\n"', "x\n,y"]
    written = {}
    for name in ("p.csv", "q.csv"):
        rows = []
        for i in range(60):
            text = "".join(draw.choices(marks, k=draw.randrange(6)))
            rows.append(line(i, Description=f"t{text}t", Country=draw.choice(["France", "two\nlines", 'q"q'])))
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            out.write(",".join(HEADINGS) + end)
            for k, row in enumerate(rows):
                csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL if k % 3 else csv.QUOTE_MINIMAL).writerow(row)
                out.write(end if k % 7 == 0 else "")
        written |= {(name, i + 2): (row[2], row[7]) for i, row in enumerate(rows)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for cut in ("97", "700", "64k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        try:
            sheet = read_csv_sheet(spark, str(tmp_path), "A", multiline=True).frame
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert {(r.SourceFile, r.SourceRow): (r.Description, r.Country) for r in sheet.collect()} == written


SHEET = (
    "Invoice string, StockCode string, Description string, Quantity int, InvoiceDate string, "
    "Price double, `Customer ID` string, Country string"
)


def test_parquet_contract(spark, tmp_path):
    good = spark.createDataFrame([tuple(line(1))], SHEET)
    changed = {
        "unexpected column Extra": good.withColumn("Extra", F.lit(1)),
        "missing column Country": good.drop("Country"),
        "column Price is boolean": good.withColumn("Price", F.lit(True)),
    }
    for k, (problem, bad) in enumerate(changed.items()):
        bad.write.parquet(str(tmp_path / f"bad{k}"))
        with pytest.raises(ContractError, match=problem):
            read_parquet_sheet(spark, str(tmp_path / f"bad{k}"), "A")
    # One file of many is enough.
    good.write.parquet(str(tmp_path / "mixed"))
    good.withColumn("Extra", F.lit(1)).write.mode("append").parquet(str(tmp_path / "mixed"))
    with pytest.raises(ContractError, match="unexpected column Extra"):
        read_parquet_sheet(spark, str(tmp_path / "mixed"), "A")


def test_csv_rows_are_numbered_across_splits(spark, tmp_path):
    """Many small splits of several files, read in any order, still number each file's rows from 2."""
    for name, n in [("p.csv", 900), ("q.csv", 350)]:
        write_csv(tmp_path / name, [line(i, Description="x" * (i % 40)) for i in range(n)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        sheet = read_csv_sheet(spark, str(tmp_path), "A").frame
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    off = sheet.filter(F.col("SourceRow") != F.col("Invoice").cast("bigint") + 2)
    assert (sheet.count(), off.count()) == (1250, 0)


def test_parquet_sheets_land(spark, tmp_path):
    rows = [tuple(line(i)) for i in range(5)]
    schema = (
        "Invoice string, StockCode string, Description string, Quantity int, InvoiceDate string, "
        "Price double, `Customer ID` string, Country string"
    )
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "sheet"))
    raw = land([read_parquet_sheet(spark, str(tmp_path / "sheet"), "A")], LOADED_AT)
    assert sorted((r.invoice, r._source_row) for r in raw.collect()) == [(f"{i}", i + 2) for i in range(5)]


def test_same_line_from_csv_and_parquet_hashes_alike(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [line(1)])
    from_csv = land([read_csv_sheet(spark, str(tmp_path / "a.csv"), "A")], LOADED_AT).first()
    schema = (
        "Invoice string, StockCode string, Description string, Quantity bigint, InvoiceDate timestamp_ntz, "
        "Price double, `Customer ID` string, Country string"
    )
    typed = line(1)
    typed[4] = datetime(2010, 12, 1, 8, 26)
    spark.createDataFrame([tuple(typed)], schema).write.parquet(str(tmp_path / "sheet"))
    from_parquet = land([read_parquet_sheet(spark, str(tmp_path / "sheet"), "A")], LOADED_AT).first()
    assert from_csv._record_hash == from_parquet._record_hash


def test_contract_is_enforced(spark):
    raw = raw_frame(spark, {})
    with pytest.raises(ContractError, match="missing column country"):
        require_contract(raw.drop("country"), "raw")
    with pytest.raises(ContractError, match="unexpected column extra"):
        require_contract(raw.withColumn("extra", F.lit(1)), "raw")
    with pytest.raises(ContractError, match="repeated column country"):
        require_contract(raw.select("*", F.lit("x").alias("country")), "raw")
    with pytest.raises(ContractError, match="quantity is int, expected bigint"):
        require_contract(raw.withColumn("quantity", F.col("quantity").cast("int")), "raw")


def test_write_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    write_parquet(spark.range(5), path)
    write_parquet(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_days_that_are_gone_are_replaced_too(spark, tmp_path):
    """Also where the session's default is to keep the days that a write does not touch."""
    one, two = raw_frame(spark, {}), raw_frame(spark, {"invoice_date": datetime(2011, 2, 1)})
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for raw in (one, two):
            write_table_files(raw, "raw", str(tmp_path / "raw"))
            publish_catalog(raw, "tillroll_replace")
        assert read_table_files(spark, "raw", str(tmp_path / "raw")).count() == 1
        assert spark.table("tillroll_replace.raw").count() == spark.table("tillroll_replace.fct_sales").count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
        spark.sql("DROP DATABASE IF EXISTS tillroll_replace CASCADE")


def test_null_metrics_are_written(spark, tmp_path):
    write_metrics({"m": spark.sql("SELECT 1 AS n, CAST(NULL AS DOUBLE) AS guest_revenue")}, str(tmp_path))
    text = next((tmp_path / "m").glob("*.json")).read_text()
    assert json.loads(text) == {"n": 1, "guest_revenue": None}


def test_hot_day_is_split_over_files(spark, tmp_path):
    """Nearly all rows share a day: its folder holds several files, and no day loses rows."""
    hot = raw_frame(spark, {}).crossJoin(spark.range(60_000)).withColumn("_source_row", F.col("id")).drop("id")
    raw = hot.withColumn("_record_hash", F.md5(F.col("_source_row").cast("string"))).repartition(8)
    raw = raw.unionByName(raw_frame(spark, {"invoice_date": datetime(2010, 5, 1)}, {"invoice_date": None}))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        write_table_files(raw, "raw", str(tmp_path / "raw"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    version = Path(current_path(spark, str(tmp_path / "raw")))
    folders = {f.name: len(list(f.glob("*.parquet"))) for f in version.glob("invoice_day=*")}
    assert folders["invoice_day=2011-01-05"] > 2
    assert folders["invoice_day=2010-05-01"] == 1
    back = read_table_files(spark, "raw", str(tmp_path / "raw"))
    assert back.schema == CONTRACTS["raw"] and back.count() == 60_002


def small_raw(spark):
    return raw_frame(
        spark,
        {},
        {},
        {"invoice": "2", "customer_id": "8", "price": 4.0, "invoice_date": datetime(2011, 3, 1)},
        {"invoice": "3", "customer_id": None, "stock_code": "POST"},
        {"invoice": "C4", "quantity": -1},
    )


def test_publish_files_twice_is_idempotent(spark, tmp_path):
    raw = small_raw(spark)
    first = publish_files(raw, str(tmp_path / "one"))
    assert list(first) == TABLES
    assert all(quality.dq_assertions(first).toPandas().passed)
    again = publish_files(raw, str(tmp_path / "two"))
    assert all(r.identical for r in quality.rebuild_idempotent(first, again).collect())
    replaced = publish_files(raw, str(tmp_path / "one"))
    assert replaced["stg"].count() == 4
    for name, table in replaced.items():
        assert table.schema == CONTRACTS[name]


def test_published_days_are_pruned(spark, tmp_path):
    sales = publish_files(small_raw(spark), str(tmp_path))["fct_sales"]
    march = sales.filter(F.col("invoice_date") >= F.lit(date(2011, 3, 1)))
    plan = march._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(invoice_date" in plan
    assert march.count() == 1


def test_publish_catalog_with_staging_view(spark):
    raw = small_raw(spark)
    for as_view in (False, True):
        tables = publish_catalog(raw, "tillroll_test", staging_as_view=as_view)
        assert tables["stg"].count() == 4 and tables["rfm"].count() == 1
        assert spark.table("tillroll_test.fct_orders").count() == 4
    assert spark.table("stg").count() == 4
    spark.sql("DROP DATABASE tillroll_test CASCADE")


def test_whole_run(spark, tmp_path):
    """The command line lands sheets, publishes tables, writes the results and reports the checks."""
    write_csv(tmp_path / "a.csv", [line(1), line(1), line(2, **{"Customer ID": "8"})])
    write_csv(tmp_path / "b.csv", [line(3, StockCode="POST", **{"Customer ID": ""})])
    sheets = [f"A={tmp_path}/a.csv", f"B={tmp_path}/b.csv"]
    asked = ["--campaign-day", "2010-12-31", "--lapsed-country", "France", "--load", "one"]
    for _ in range(2):
        assert main([*sheets, "--out", str(tmp_path / "out"), "--start-date", "2010-01-01", *asked]) == 0
    assert read_table_files(spark, "fct_sales", str(tmp_path / "out" / "fct_sales")).count() == 3

    def document(name, folder="analysis"):
        parts = sorted((tmp_path / "out" / folder / name).glob("*.json"))
        return [json.loads(text) for part in parts for text in part.read_text().splitlines()]

    assert document("totals")[0]["known_customers"] == 2
    assert document("monthly_revenue")[0] | {"orders": 2, "net_revenue_gbp": 10.2} == document("monthly_revenue")[0]
    for name in ("assertions", "not_null", "unique", "relationships", "freshness"):
        assert document(name, "checks") and all(check["passed"] for check in document(name, "checks"))
    assert document("profile")[0]["duplicate_lines"] == 1
    assert {c["arm"] for c in document("winback_customers")} <= {"control", "treatment"}
    assert document("kpi")[0]["customers"] == 2 and document("geography")[0]["country"] == "France"
    assert len(document("top_customers")) == 2
    assert all(check["passed"] for check in document("schema", "checks")) and len(document("schema", "checks")) == 7
    assert {(r["load"], r["metric"]): r["value"] for r in document("load_history")}["one", "n_rows"] == 4
    assert document("schema_drift_A") == [] and (tmp_path / "out" / "history" / "metrics" / "load=one").exists()
    assert document("winback_outcome") == [] and document("lapsed_top_customers") == []


@pytest.mark.parametrize("passed, code", [(False, 2), (True, 0)])
def test_a_failed_check_sets_the_exit_code(spark, tmp_path, monkeypatch, passed, code):
    write_csv(tmp_path / "a.csv", [line(1)])
    result = spark.range(1).select(F.lit("a check").alias("check"), F.lit(passed).alias("passed"))
    monkeypatch.setattr("tillroll.__main__.checks", lambda tables, now: {"unique": result})
    monkeypatch.setattr("tillroll.__main__.analysis", lambda *_: {})
    out = str(tmp_path / "out")
    assert main([f"A={tmp_path}/a.csv", "--out", out, "--start-date", "2010-01-01"]) == code


def test_a_late_load_only_warns(spark):
    tables = {"raw": raw_frame(spark, {})}
    with pytest.MonkeyPatch.context() as patch:
        for name in ("dq_assertions", "dq_not_null", "dq_unique", "dq_relationships"):
            patch.setattr(quality, name, lambda _: None)
        passed = [checks(tables, LOADED_AT + timedelta(hours=h))["freshness"].first().passed for h in (1, 40, 80)]
    assert passed == [True, True, False]


def test_closed_warehouse_leaves_no_files(spark):
    warehouse = Warehouse(lambda: small_raw(spark))
    kept = {name: warehouse[name] for name in ("raw", "stg", "fct_sales")}
    folder = Path(kept["stg"].inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists()
    given = Warehouse.over(kept["raw"])
    given["stg"].count()
    given.close()
    assert kept["raw"].count() == 5  # what was handed in stays
    warehouse.close()
    assert not folder.exists()


def test_scratch_follows_the_session(spark):
    class Session:
        def __init__(self, **settings):
            self.conf = self
            self.settings = settings

        def get(self, key, default=None):
            return self.settings.get(key.replace(".", "_"), default)

    assert scratch_root(Session(spark_checkpoint_dir="hdfs://c/shared/")) == "hdfs://c/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session(spark_master="yarn", spark_app_id="x"))


def test_loaded_at_is_an_instant(spark):
    assert raw_frame(spark, {}).select(F.unix_timestamp("_loaded_at")).first()[0] == LOADED_AT.timestamp()
    assert LOADED_AT.tzinfo is timezone.utc
