from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import tokenizers
from hypothesis import given, settings, strategies as st

from tests.llm.frames import empty, messy
from tillroll.llm import token_files
from tillroll.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = tokenizers.Tokenizer.from_file(PATH)


def ids_of(text: str) -> list[int]:
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(
    st.one_of(
        st.text(max_size=60),
        st.lists(
            st.one_of(
                st.text("abcABCñÑéÉß.,'!&$*0123456789-", max_size=8),
                st.sampled_from(["don't", "it's.", "<|endoftext|>", "é", "İz", "ŉ", "ﬁ", "Σς", "..", ",.", "a.,", "ª"]),
            ),
            max_size=12,
        ).map(" ".join),
    )
)
def test_word_by_word_ids_are_those_of_the_whole_text(text):
    encode, width = token_files.encoder(PATH)
    assert np.frombuffer(encode(text.encode("utf-8", "replace")), f"<u{width}").tolist() == ids_of(
        text.encode("utf-8", "replace").decode()
    )


def test_other_tokenizers_see_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, width = token_files.encoder(path)
    text = "Two  words,\n and  spaces"
    expected = tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text.encode()), f"<u{width}").tolist() == expected


def test_files_hold_every_row_in_order(spark, tmp_path):
    docs = messy(spark)
    manifest, dictionary = token_files.write_tokens(docs, PATH, folder=str(tmp_path))
    got = token_files.read_tokens(manifest, dictionary).collect()
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])] == [
        row[:2] for row in rows
    ]
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    arrays = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got}
    for known, doc_id, text in rows:
        ids = np.array([*ids_of(text), 2], "<u4")
        assert (doc_id if known else None, len(ids), zlib.crc32(ids.tobytes())) in arrays


def test_one_document_is_read_by_the_index(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"document number {k} " * (k % 5)) for k in range(300)], "doc_id bigint, text string")
    manifest, dictionary = token_files.write_tokens(docs.coalesce(1), PATH, folder=str(tmp_path))
    first = min(manifest.collect(), key=lambda r: r["part"])
    assert token_files.read_document(first["path"], 4, dictionary).tolist() == [*ids_of("document number 4 " * 4), 2]
    assert all(Path(r["path"]).stat().st_size > 0 for r in manifest.collect())


def test_empty_table(spark):
    manifest, dictionary = token_files.write_tokens(empty(spark), PATH)
    assert token_files.read_tokens(manifest, dictionary).collect() == []


def test_a_file_of_another_dictionary_is_refused(spark, tmp_path):
    import pytest

    manifest, dictionary = token_files.write_tokens(messy(spark), PATH, folder=str(tmp_path))
    with pytest.raises(ValueError):
        token_files.read_document(manifest.first()["path"], 0, dictionary + b"x")


def test_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS_KEPT", 50)
    words = token_files.WordIds(WHOLE, 2)
    texts = [f"w{k}" for k in range(200)] + ["漢字仮名" * 300 + str(k) for k in range(20)] + ["x" * 70 + "!"]
    for text in texts:
        assert np.frombuffer(words[text.encode()], "<u2").tolist() == ids_of(text)
        assert len(words) <= 50 and all(len(w) <= token_files.REMEMBERED_WORD for w in words)


def test_query_is_the_whole_tokenizer(spark):
    """Every registered figure, in doc_id order, against the library over whole texts."""
    sf_dir = "/root/testdata/sf0.001"
    start, expected = 0, []
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    for doc_id, text in documents.collect():
        ids = np.array([*ids_of(text or ""), 2], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = QUERIES["op1_token_files"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
