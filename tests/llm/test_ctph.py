from __future__ import annotations

import hashlib
import random
import time

from hypothesis import given, settings, strategies as st

from tests.llm.frames import empty, messy
from tillroll.llm import ctph
from tillroll.llm.queries import QUERIES


def expected(rows):
    texts = [t or "" for _, t in rows]
    for k, (doc_id, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        n = len(text) // 4
        changed = (text[: len(text) - n] + after[:n]).encode()
        own, new, other = (ctph.fingerprint(x) for x in (text.encode(), changed, after.encode()))
        yield doc_id, len(text), hashlib.sha256(changed).hexdigest(), own, new, ctph.likeness(own, new), ctph.likeness(own, other)


def test_query_against_one_by_one(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("doc_id", "text")
    got = QUERIES["op10_ctph"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == list(expected([tuple(r) for r in documents.collect()]))


def test_messy_rows(spark):
    rows = messy(spark).collect()
    got = ctph.fingerprints(messy(spark)).collect()
    assert len(got) == len(rows)
    own = sorted((str(r["doc_id"]), len(r["text"] or ""), ctph.fingerprint((r["text"] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_chars"], r["fingerprint"]) for r in got) == own


def test_a_single_document_follows_itself(spark):
    one = spark.createDataFrame([(5, "abcdefgh" * 50)], "doc_id bigint, text string")
    assert [tuple(r) for r in ctph.fingerprints(one).collect()] == list(expected([(5, "abcdefgh" * 50)]))


def test_empty_table(spark):
    assert ctph.fingerprints(empty(spark)).collect() == []


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=70), st.text("abcd", max_size=70))
def test_edit_distance(a, b):
    assert ctph.edit_distance(a, b) == table_distance(a, b)


def slow_hash(data, at):
    total = 0
    for k in range(ctph.WINDOW):
        j = at - (ctph.WINDOW - 1) + k
        value = int(ctph._SPREAD[data[j]]) if j >= 0 else 0
        total = (total + value * ctph._WEIGHTS[k]) % (1 << 32)
    return total ^ total >> 15


def test_chunks_by_a_hash_of_the_last_bytes(monkeypatch):
    data = bytes(random.Random(1).randrange(256) for _ in range(3000))
    size = int(ctph.fingerprint(data).split(":")[0])
    ends = [k + 1 for k in range(len(data)) if slow_hash(data, k) % size == size - 1]
    assert ctph._triggers(data, size)[0].tolist() == ends and len(ends) < ctph.LONGEST
    assert size == 3 or len(ctph._triggers(data, size // 2)[0]) >= ctph.LONGEST
    whole = ctph.fingerprint(data)
    monkeypatch.setattr(ctph, "BLOCK_BYTES", 100)  # blocks make no difference
    assert ctph.fingerprint(data) == whole


def test_likeness_falls_with_changes():
    draw = random.Random(2)
    text = bytes(draw.choice(b"abcdefghij ") for _ in range(5000))
    print_ = ctph.fingerprint(text)
    small, large = text[:2500] + b"!" + text[2500:], text[:2500] + bytes(reversed(text[2500:]))
    other = bytes(draw.choice(b"abcdefghij ") for _ in range(5000))
    marks = [ctph.likeness(print_, ctph.fingerprint(x)) for x in (text, small, large, other)]
    assert marks[0] == 1 > marks[1] > 0.9 > marks[2] > 0.3 > marks[3] == 0
    assert ctph.fingerprint(b"a" * 100_000).count(":") == 2 and ctph.fingerprint(b"") == "3::"
    # Twice the text has twice the chunk size, and can still be compared.
    assert ctph.likeness(print_, ctph.fingerprint(text + other)) > 0


def test_repeated_lines_keep_their_chunks():
    draw = random.Random(4)
    after = "".join(draw.choice("abcdefghij ") for _ in range(20_000))
    marks = []
    for repeats in (64, 70, 100, 400):
        for _ in range(15):
            line = "".join(draw.choice("abcdefghijklmnop ") for _ in range(draw.choice([40, 75, 200]))) + "\n"
            text = line * repeats
            own, new = (ctph.fingerprint(t.encode()) for t in (text, ctph.edited(text, after)))
            assert len(own.split(":")[1]) >= ctph.LONGEST
            marks.append(ctph.likeness(own, new))
    # Sizes chosen for a text and its edit may still be too far apart to compare.
    assert max(marks) < 1 and sum(m > 0.3 for m in marks) >= 0.8 * len(marks)


def test_different_short_texts_are_not_alike():
    prints = [ctph.fingerprint(f"{k:04d}".encode()) for k in range(600)]
    assert len(set(prints)) == 600
    assert max(ctph.likeness(a, b) for k, a in enumerate(prints) for b in prints[:k]) < 1
    assert ctph.likeness(prints[5], ctph.fingerprint(b"0005")) == 1


def test_signatures_are_bounded():
    """Long texts that repeat one line, two lines, two lines in any order, or a few letters."""
    draw = random.Random(12)
    one, two = ("".join(draw.choice("abcdefghijklmnop ") for _ in range(n)) + "\n" for n in (70, 90))
    texts = [one * 60_000, (one + two) * 30_000, "ab " * 700_000, "".join(draw.choice((one, two)) for _ in range(40_000))]
    after = "".join(draw.choice("abcdefghij ") for _ in range(200_000))
    for text in texts:
        begun = time.perf_counter()
        own, again, new = (ctph.fingerprint(t.encode()) for t in (text, text, ctph.edited(text, after)))
        marks = [ctph.likeness(own, x) for x in (again, new)]
        assert max(map(len, (*own.split(":")[1:], *new.split(":")[1:]))) <= ctph.MOST_CHUNKS * ctph.LETTERS_OF_FEW
        assert marks[0] == 1 and own == again and own != new
        assert time.perf_counter() - begun < 60


def test_folding_keeps_what_does_not_repeat():
    import numpy as np

    sums = np.array([1, 2, 3] * 1000 + [7, 8, 9] + [5] * 5000 + [4], np.uint32)
    short = ctph._shortened(sums).tolist()
    assert len(short) <= ctph.MOST_CHUNKS and short[:3] == [1, 2, 3] and short[-1] == 4
    at = short.index(7)
    assert short[at : at + 3] == [7, 8, 9] and set(short[at + 3 : -1]) == {5}
    # Stretches keep their shares of the whole.
    assert 0.4 < at / 3000 / ((len(short) - at) / 5000) < 2.5
