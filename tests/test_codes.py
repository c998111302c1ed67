"""Codes in place of strings, and tables that lie in buckets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tillroll.functions.columns import most_frequent, surrogate_key
from tillroll.operators import codes
from tillroll.plans import quality
from tillroll.plans.warehouse import Warehouse
from tillroll.sources.scratch import hold_buckets, release

SF_DIR = "/root/testdata/sf0.001"
WORDS = ["", " ", "A", "a", "Z", "z", "é", "Österreich", "漢字", "🙂", "a\x00", "ab", "Ab", "United Kingdom", None]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_rise_with_the_strings(spark):
    rows = [(w,) for w in WORDS * 7] + [(f"w{k}",) for k in range(500)]
    words = spark.createDataFrame(rows, "word string").repartition(13)
    known = codes.dictionary(words, "word")
    assert known.count() == 500 + len(WORDS) - 1
    assert known.orderBy("word").collect() == known.orderBy("word_code").collect()
    back = codes.decoded(codes.encoded(words, known, "word"), known, "word")
    assert back.groupBy("word").count().exceptAll(words.groupBy("word").count()).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_extremes_of_codes_are_those_of_strings(spark, seed):
    draw = random.Random(seed)
    rows = [
        (min(draw.randrange(40), draw.randrange(40)), draw.choice(WORDS), draw.choice([1, 1, 2, 10**17]),
         draw.choice([None, 0, -1, 2**63 - 1, -(2**63), *range(9)]))
        for _ in range(900)
    ]
    df = spark.createDataFrame(rows, "k bigint, word string, n bigint, id bigint").repartition(7)
    where = F.col("n") > 1
    plain = df.groupBy("k").agg(
        F.min("word").alias("least"),
        most_frequent(F.col("word"), F.col("n"), where=where).alias("mode"),
        F.max(surrogate_key(F.col("id"))).alias("key"),
    )
    known = codes.dictionary(df, "word")
    coded = codes.encoded(df, known, "word").groupBy("k").agg(
        F.min("word_code").alias("word_code"),
        codes.most_frequent_code(F.col("word_code"), F.col("n"), where=where).alias("mode_code"),
        codes.greatest_by_hash(F.col("id"), surrogate_key(F.col("id"))).alias("id"),
    )
    assert "SortAggregate" in plan_of(plain) and "SortAggregate" not in plan_of(coded)
    named = codes.decoded(coded, known, "word").withColumnRenamed("word", "least")
    named = codes.decoded(named, known.toDF("mode", "mode_code"), "mode")
    got = named.select("k", "least", "mode", surrogate_key(F.col("id")).alias("key"))
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)


@pytest.mark.parametrize("name", ["fct_orders", "dim_customer", "dim_product"])
def test_models_do_not_sort_for_text_extremes(spark, name):
    from tillroll.plans.warehouse import MODELS

    tables = registry.warehouse(spark, SF_DIR)
    parents, model = MODELS[name]
    assert "SortAggregate" not in plan_of(model(*[tables[p] for p in parents]))


def test_references_are_checked_where_keys_lie(spark):
    tables = registry.warehouse(spark, SF_DIR)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = quality.dq_relationships(tables)
        unique = quality.dq_unique(tables, {"dim_customer": ["customer_sk"], "dim_product": ["product_sk"]})
        assert "hashpartitioning" not in plan_of(checked) + plan_of(unique)
        assert "hashpartitioning" in plan_of(quality.dq_unique(tables, {"dim_customer": ["customer_id"]}))
        assert all(r["passed"] for r in checked.collect() + unique.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lost_and_repeated_keys_in_buckets_are_found(spark):
    def keys(n):
        return spark.range(n).select(F.md5(F.col("id").cast("string")).alias("product_sk"))

    child = keys(50).select(F.lit("product_sk").alias("key_column"), F.col("product_sk").alias("key"), F.lit(3).alias("n_lines"))
    child = hold_buckets(child.repartition(5, "key"), "keys", "key", 5)
    parent = keys(40).unionAll(keys(2))
    parent = hold_buckets(parent.repartition(5, "product_sk"), "parent", "product_sk", 5)
    tables = {"dim_product": parent}
    assert quality._orphan_lines(child, parent, "product_sk").collect()[0]["orphans"] == 30
    (row,) = quality.dq_unique(tables, {"dim_product": ["product_sk"]}).collect()
    assert (row["repeated"], row["passed"]) == (2, False)
    for table in (child, parent):
        release(table)


def test_closing_removes_the_entries_of_buckets(spark):
    def entries():
        return {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}

    before = entries()
    tables = Warehouse.over(registry.warehouse(spark, SF_DIR)["raw"])
    assert tables["dim_customer"].count() > 0 and tables["line_keys"].count() > 0
    assert len(entries() - before) == 2
    tables.close()
    assert entries() == before
