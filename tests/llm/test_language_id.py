from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.frames import LONG, doc, empty, frame, messy
from tillroll.llm import language_id
from tillroll.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_documents_are_recognised(spark):
    got = QUERIES["op2_language_id"](spark, SF_DIR)
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(truth, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in unseen]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_messy_rows(spark):
    rows = [doc(100 + k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("el gato y el perro", "es"), ("kissa ja koira", "fi")] * 12)]
    docs = frame(spark, rows).unionAll(messy(spark))
    got = language_id.identify(docs).collect()
    assert len(got) == docs.count()
    blank = {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)}
    assert blank == {"und"}
    assert {r["lang_pred"] for r in got} == {"und", "en", "de", "fr", "es", "fi"}
    assert all(r["held_out"] is False for r in got if r["doc_id"] is None)


def test_no_labels_and_empty_table(spark):
    got = language_id.identify(frame(spark, [doc(1, "some words", None), doc(2, LONG, None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert language_id.identify(empty(spark)).collect() == []
    one = language_id.identify(frame(spark, [doc(k, "only one language", "xx") for k in range(9)])).collect()
    assert {r["lang_pred"] for r in one} == {"xx"}


def test_held_out_labels_are_not_learned(spark):
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    rest = [k for k in range(400) if k not in held]
    rows = [doc(k, "zzz qqq zzz", "hidden") for k in held] + [doc(k, "aaa bbb aaa" if k % 2 else "ccc ddd", "ab"[k % 2]) for k in rest]
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, rows)).collect()} == {"a", "b"}


def test_features_do_not_depend_on_blocks(monkeypatch):
    text = "Ünd straße 42 été " * 500
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "BLOCK_BYTES", 64)
    assert np.allclose(whole, language_id.features(text))


def test_svm_separates():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) > 0.1, 1.0, -1.0)
    weights = language_id.linear_svm(x, y)
    assert np.mean(np.sign(language_id._margin(x, weights)) == y) > 0.95


def test_registered_result_is_that_of_a_fit_in_one_piece(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    order = F.xxhash64(F.lit(language_id.SEED), "doc_id", "text").alias("order")
    rows = docs.select("doc_id", "text", "lang", order).collect()
    known = [
        r for r in rows
        if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and any(c.isalpha() for c in r["text"] or "")
    ]
    langs = sorted({r["lang"] for r in known})
    each = min(language_id.ROWS_PER_LANGUAGE, language_id.ROWS_IN_ALL // len(langs))
    sample = []
    for lang in langs:
        unlike = {r["order"]: r for r in known if r["lang"] == lang}
        sample += [unlike[key] for key in sorted(unlike)[:each]]
    x = np.array([language_id.features(r["text"]) for r in sample], dtype=np.float32)
    model = language_id.train(x, [r["lang"] for r in sample])
    names, chances = model.predict(np.array([language_id.features(r["text"] or "") for r in rows]))
    expected = {
        r["doc_id"]: (name, chance) if any(c.isalpha() for c in r["text"] or "") else ("und", 1.0)
        for r, name, chance in zip(rows, names, chances)
    }
    got = QUERIES["op2_language_id"](spark, SF_DIR).collect()
    assert len(got) == len(expected)
    for r in got:
        name, chance = expected[r["doc_id"]]
        assert r["lang_pred"] == name and abs(r["score"] - chance) < 1e-4


def invented(n: int, seed: int = 5) -> list[list[str]]:
    """Words of ``n`` languages, each with syllables of its own."""
    draw = np.random.default_rng(seed)
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    return [["".join(draw.choice(letters, 4)) for _ in range(12)] for _ in range(n)]


def test_many_unknown_languages_share_learned_families():
    draw = np.random.default_rng(6)
    words = invented(100)
    langs = [f"x{k}" for k in range(100) for _ in range(12)]
    texts = [" ".join(draw.choice(words[int(lang[1:])], 30)) for lang in langs]
    x = np.array([language_id.features(t) for t in texts])
    fresh = np.arange(len(langs)) % 12 >= 8
    model = language_id.train(x[~fresh], [lang for lang, f in zip(langs, fresh) if not f])
    assert sorted(lang for group in model.languages.values() for lang in group) == sorted(set(langs))
    assert max(map(len, model.languages.values())) <= language_id.FAMILY_SIZE < len(model.languages) * 4
    assert len(model.languages) <= 100 // (language_id.FAMILY_SIZE // 2)
    names, _ = model.predict(x[fresh])
    assert np.mean([a == b for a, b in zip(names, np.array(langs)[fresh])]) > 0.9


def test_thousands_of_languages_have_a_bound(spark, monkeypatch):
    """5,000 codes: the sample stays within its bound, and every row has a learned language."""
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 40)
    words = invented(5000)
    rows = [doc(4 * k, " ".join(w), f"x{k}") for k, w in enumerate(words)]
    rows += [doc(50_000 + k, " ".join(words[k % 20]), f"x{k % 20}") for k in range(400)]
    docs = frame(spark, rows)
    sizes = []
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda x, langs: sizes.append((len(langs), set(langs))) or train(x, langs))
    got = language_id.identify(docs).collect()
    assert len(got) == docs.count()
    (size, learned), = sizes
    assert size <= 40 * language_id.ROWS_IN_ALL // 40 and len(learned) == 40
    # The languages with most rows are among them, and are told apart.
    assert {f"x{k}" for k in range(20)} <= learned
    assert {r["lang_pred"] for r in got} <= learned
    truth = {r[0]: r[2] for r in rows[5000:]}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]) > 0.95
