"""Each stage against a brute-force version on the smallest tables, then the whole run."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.frames import empty, messy
from tests.llm.test_decontaminate import plain
from tests.llm.test_mixing import targets_by_hand, words
from tests.llm.test_simhash import folders, groups_by_hand, slow_simhash
from tillroll.llm import quality
from tillroll.llm.common import id_remainder
from tillroll.sources.scratch import hold

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = hold(stage(spark, docs, SF_DIR), "test-" + name)
        found[name] = docs
    return found


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_columns(results):
    names = list(results)
    assert names[1:] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(results[n].columns == COLUMNS for n in names[:-1])
    assert results["sharding"].columns == [*COLUMNS, "size", "shard", "slot"]


def test_quality_against_ridge_in_one_piece(spark, results):
    documents = results["documents"]
    labelled = documents.join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").filter(id_remainder(documents["doc_id"], 3) != 1)
    rows = [(quality.statistics(r["text"].encode()), r["quality"]) for r in labelled.collect()]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = quality.fourier(x, center, scale)
    weights = np.linalg.solve(z.T @ z + (quality.RIDGE * len(z) + 1e-9) * np.eye(z.shape[1]), z.T @ y)
    kept = set(ids(results["quality"]))
    raw = {
        r["doc_id"]: float((quality.fourier(np.array([quality.statistics(r["text"].encode())]), center, scale) @ weights)[0])
        for r in documents.collect()
    }
    # Calibration is one threshold on the raw score.
    assert max(raw[d] for d in raw if d not in kept) <= min(raw[d] for d in kept) + 1e-3
    assert 0.5 < len(kept) / len(raw) < 1


def test_near_duplicates(results):
    prints = {r["doc_id"]: slow_simhash(r["text"]) for r in results["quality"].collect()}
    kept = sorted(set(groups_by_hand(prints).values()))
    assert ids(results["near_duplicates"]) == kept
    assert len(kept) < len(prints)


def test_decontamination(spark, results):
    items = [" ".join(plain(r["text"])) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = [
        r["doc_id"]
        for r in results["near_duplicates"].collect()
        if not any(f" {item} " in f" {' '.join(plain(r['text']))} " for item in items)
    ]
    assert ids(results["decontamination"]) == sorted(clean)


def test_mixing(results):
    before, copies = results["decontamination"].collect(), Counter(ids(results["mixing"]))
    sizes = Counter()
    for r in before:
        sizes[r["source"]] += words(r["text"])
    target = targets_by_hand(dict(sizes))
    for r in before:
        rate = target[r["source"]] / sizes[r["source"]]
        assert int(rate + 1e-9) <= copies[r["doc_id"]] <= int(rate + 1e-9) + 1
    assert set(copies) <= {r["doc_id"] for r in before}


def test_sharding(results):
    rows = results["sharding"].collect()
    assert ids(results["sharding"]) == ids(results["mixing"])
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())


def test_run_is_its_stages(spark, results):
    place = lambda rows: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows.collect())
    assert place(corpus_pipeline.run(spark, SF_DIR)) == place(results["sharding"])


def test_a_run_leaves_its_result_and_little_else(spark):
    before = folders(spark)
    rows = corpus_pipeline.run(spark, SF_DIR)
    left = folders(spark) - before
    assert {name.rsplit("-", 1)[0] for name in left} == {"sharding"}
    assert rows.count() == len(rows.collect()) > 0


@pytest.mark.parametrize("k", range(5))
def test_stages_take_messy_and_empty_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = messy(spark)
    result = stage(spark, docs, SF_DIR)
    if name != "sharding":
        assert result.columns == docs.columns
    assert result.count() <= 3 * docs.count()
    assert stage(spark, empty(spark), SF_DIR).count() == 0
