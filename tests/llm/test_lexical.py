from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from tests.llm.frames import LONG, PROSE, doc, empty, frame, messy
from tillroll.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs: list[tuple], items: list[tuple], best: int = 10) -> list[tuple]:
    """The definition, document by document, in whole numbers of any size."""
    of_doc = [TERM.findall((text or "").translate(LOWER)) for _, text in docs]
    n, length = sum(1 for t in of_doc if t), sum(map(len, of_doc))
    holding: dict[str, int] = {}
    for found in of_doc:
        for term in set(found):
            holding[term] = holding.get(term, 0) + 1
    rows = []
    for item_id, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        scored = []
        for (doc_id, _), found in zip(docs, of_doc):
            if not found:
                continue
            m = 100 - 75 + 75 * len(found) * n // length
            score = 0
            for term in asked:
                tf = found.count(term) if term in holding else 0
                if tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * holding[term] + 1)))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:best], 1):
            rows.append((item_id, rank, None if none else doc_id, -score))
    return sorted(rows, key=str)


def searched(spark, docs, items, best: int = 10) -> list[tuple]:
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in lexical.search(docs, items, best).collect()), key=str)


def pairs(docs) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


ITEMS = [
    (1, "Lazy dog, QUICK fox; fox!"),
    (2, "word5x1 word7x3 tie"),
    (3, None),
    (4, ""),
    (5, "no id repeated row"),
    (5, "no id repeated row"),
    (None, "ünïcödé STRASSE straße σισυφοσ 漢字"),
    (7, "nothing_of-this xyzzy"),
]


def test_messy_rows(spark):
    docs = messy(spark)
    assert searched(spark, docs, ITEMS) == brute(pairs(docs), ITEMS)


def test_ties_and_copies_at_the_cut(spark):
    docs = frame(spark, [doc(k, "same words here") for k in range(300, 0, -1)] + [doc(400, "same words here too")])
    got = searched(spark, docs.repartition(7), [(1, "same words")])
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(1, 11))
    assert got == brute(pairs(docs), [(1, "same words")])


def test_random_corpus_in_small_tiles(spark, monkeypatch):
    random.seed(3)
    words = [f"w{k}" for k in range(60)]

    def text(longest: int) -> str:
        return " ".join(random.choices(words, weights=[60 - k for k in range(60)], k=random.randint(0, longest)))

    docs = frame(spark, [doc(random.randint(0, 90), text(40)) for _ in range(150)])
    items = [(k, text(30)) for k in range(25)]
    monkeypatch.setattr(lexical, "ITEM_TILE", 4)
    monkeypatch.setattr(lexical, "TERM_TILE", 5)
    assert searched(spark, docs, items, 4) == brute(pairs(docs), items, 4)


def test_groups_of_items(spark, monkeypatch):
    docs = messy(spark)
    monkeypatch.setattr(lexical, "GROUP_BYTES", 120)
    assert searched(spark, docs, ITEMS) == brute(pairs(docs), ITEMS)


def test_no_sum_of_a_term_tile_passes_the_exact_whole_numbers():
    most = lexical.MOST_WEIGHT
    items = [{0: 5, 1: most, 2: 3 * most + 7}, {1: 1, 2: most - 1, 3: 0}]
    tiles = lexical.term_tiles(items)
    total: dict[tuple[int, int], int] = {}
    for tile in tiles:
        sums = np.zeros(len(items), object)
        for row, col, value in zip(tile.rows, tile.cols, tile.weights):
            sums[row] += int(value)
            key = (row, int(tile.terms[col]))
            total[key] = total.get(key, 0) + int(value)
        assert max(sums) * lexical.MOST_IMPACT < 1 << 53
    assert total == {(row, t): w for row, of_item in enumerate(items) for t, w in of_item.items() if w}


def test_a_weight_over_the_bound_scores_the_same():
    vocabulary = [b"a", b"b"]
    weights = [{0: 2 * lexical.MOST_WEIGHT + 12_345, 1: 9}]
    model = lexical.Model(vocabulary, 1, [(0, 1, lexical.term_tiles(weights))], 10, 100)
    docs, words, times = np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([3, 1, 2])
    ((_, total),) = list(lexical.scores(model, docs, words, times, np.array([4, 2])))
    m = [100 - 75 + 75 * n * 10 // 100 for n in (4, 2)]

    def impact(tf: int, doc: int) -> int:
        return 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])

    assert total.tolist() == [[weights[0][0] * impact(3, 0) + 9 * impact(1, 0), 9 * impact(2, 1)]]


def test_long_texts_are_cut_between_terms(monkeypatch):
    whole = [t for piece in lexical.terms(LONG.encode()) for t in piece]
    monkeypatch.setattr(lexical, "PIECE_BYTES", 100)
    assert [t for piece in lexical.terms(LONG.encode()) for t in piece] == whole == LONG.encode().split()
    assert list(lexical.terms(b"x" * 1_000)) == [[b"x" * 1_000]]


def test_empty_tables(spark):
    assert searched(spark, empty(spark), ITEMS) == []
    assert searched(spark, messy(spark), []) == []
    assert searched(spark, frame(spark, [doc(1, None), doc(2, " ,.")]), [(1, PROSE)]) == []


@pytest.mark.parametrize("best", [1, 3])
def test_number_of_results(spark, best):
    docs = messy(spark)
    assert searched(spark, docs, ITEMS, best) == brute(pairs(docs), ITEMS, best)
