from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.frames import doc, empty, frame, messy
from tillroll.llm import sharding
from tillroll.llm.queries import QUERIES


def check_layout(rows, shards):
    per_shard = Counter(r["shard"] for r in rows)
    counts = [per_shard.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_every_row_has_one_place(spark, shards):
    docs = messy(spark)
    rows = sharding.shuffled_shards(docs, shards).collect()
    check_layout(rows, shards)
    assert Counter((r["doc_id"], r["text"], r["a.b"]) for r in rows) == Counter(
        (r["doc_id"], r["text"], r["a.b"]) for r in docs.collect()
    )
    assert all(r["size"] == 8 + len((r["text"] or "").encode()) for r in rows)


def test_many_buckets_and_a_repeated_id(spark):
    docs = frame(spark, [doc(k if k < 600 else 7, f"text {k}") for k in range(900)])
    rows = sharding.shuffled_shards(docs, 5, bucket_bytes=1500).collect()
    check_layout(rows, 5)
    assert sorted(r["text"] for r in rows) == sorted(f"text {k}" for k in range(900))
    placed = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] != 7]
    assert placed != sorted(placed)
    # The rows of the heavy id are spread over the shards like all others.
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 5


def test_same_seed_same_order(spark):
    docs = frame(spark, [doc(k, f"text {k}") for k in range(300)])

    def order(seed, parts):
        rows = sharding.shuffled_shards(docs.repartition(parts), 3, seed=seed).collect()
        return [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]

    assert order(1, 2) == order(1, 5) != order(2, 2)


def test_empty_table(spark):
    result = sharding.shuffled_shards(empty(spark))
    assert result.collect() == [] and {"size", "shard", "slot"} <= set(result.columns)


def test_fisher_yates_is_uniform(spark):
    """Every one of the six orders of three rows turns up about equally often over seeds."""
    import pyarrow as pa

    table = pa.table({"_row": [{"k": k} for k in range(3)], "_size": [1] * 3, "_bucket": [0] * 3, "_id": [0, 1, 2], "_order": [0, 0, 0]})
    orders = Counter(
        tuple(r["k"] for r in sharding._fisher_yates(seed)((pa.scalar(0),), table)["_row"].to_pylist()) for seed in range(600)
    )
    assert len(orders) == 6 and min(orders.values()) > 60


def test_text_size_is_in_bytes(spark):
    assert spark.createDataFrame([("é漢",)], "text string").select(F.octet_length("text")).first()[0] == 5


def test_registered_result_column_by_column(spark):
    sf_dir = "/root/testdata/sf0.001"
    documents = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_sharding"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    check_layout(rows, 24)
    for r in rows:
        text = documents[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)
    assert {r["shard"] for r in rows} == set(range(24))
