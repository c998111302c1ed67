"""Byte-level BPE encoding and decoding of whole texts.

Within a word the adjacent pairs are the leaves of a segment tree that keeps, in every node, the least of
(rank of the merge, place of the pair) below it. The root is the leftmost merge of the lowest rank; a merge
changes three leaves, so a word of n bytes takes n log n steps however long it is.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import column

# How byte-level tokenizers cut a text into words (fixed value): contractions, letters, numbers and other
# marks, each with a space before them, then white space.
WORDS = "'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
# What letters, numbers and white space are, among the first 256 characters and among all (fixed values).
LATIN = {"letter": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "number": "0-9\xb2\xb3\xb9\xbc-\xbe", "space": "\t-\r \x85\xa0"}
ALL = {"letter": r"\p{L}", "number": r"\p{N}", "space": r"\t-\r\x85\p{Z}"}

# A leaf holds rank << PLACE_BITS | place; the value of a pair that cannot merge is above all of them.
PLACE_BITS = 32
PLACE = (1 << PLACE_BITS) - 1
NO_MERGE = (1 << 63) - 1
# What is left of a symbol that went into the one before it.
GONE = -1
# Words from this length on keep their tree in packed arrays.
PACKED_FROM = 4096

# Words that are remembered: short ones, up to so many bytes of them and their ids; then the memory starts anew.
REMEMBERED_WORD = 64
REMEMBERED_BYTES = 128 << 20
# Long texts are cut into words piece by piece, and rows leave a task in batches of about so many bytes.
PIECE_CHARS = 1 << 20
BATCH_BYTES = 16 << 20


def merged(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``symbols`` after all merges; ``merges`` gives rank and new symbol of a pair."""
    n = len(symbols)
    if n < 2:
        return symbols
    known = merges.get
    leaves = 1 << (n - 2).bit_length()
    packed_ints = (lambda values: array("q", values)) if n >= PACKED_FROM else list
    tree = packed_ints([NO_MERGE]) * (2 * leaves)
    for place in range(n - 1):
        found = known((symbols[place], symbols[place + 1]))
        if found:
            tree[leaves + place] = found[0] << PLACE_BITS | place
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    if tree[1] == NO_MERGE:
        return symbols
    symbols = packed_ints(symbols)
    after = packed_ints(range(1, n + 1))
    before = packed_ints(range(-1, n - 1))
    while (least := tree[1]) != NO_MERGE:
        place = least & PLACE
        second = after[place]
        symbols[place] = known((symbols[place], symbols[second]))[1]
        symbols[second] = GONE
        follower = after[second]
        after[place] = follower
        changed = [(place, follower)]
        if follower < n:
            before[follower] = place
            changed.append((second, n))
        if before[place] >= 0:
            changed.append((before[place], place))
        for left, right in changed:
            found = known((symbols[left], symbols[right])) if right < n else None
            node = leaves + left
            tree[node] = found[0] << PLACE_BITS | left if found else NO_MERGE
            while node > 1:
                node >>= 1
                low, high = tree[2 * node], tree[2 * node + 1]
                if high < low:
                    low = high
                if tree[node] == low:
                    break
                tree[node] = low
    return [s for s in symbols if s != GONE]


@functools.lru_cache(maxsize=1)
def _newer_letters() -> tuple[Callable, Callable]:
    """A search for letters and numbers that the tokenizers' tables of characters do not have yet, and how to
    cut texts with them. Both libraries know more characters with every version; the tokenizers' count."""
    cut = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    newer: list[list[int]] = []
    for code in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))):
        if unicodedata.category(code) == "Cn" and len(cut("a" + code)) + len(cut("1" + code)) != 3:
            if newer and newer[-1][1] == ord(code) - 1:
                newer[-1][1] += 1
            else:
                newer.append([ord(code), ord(code)])
    if not newer:
        return (lambda text: None), regex.compile(WORDS.format(**ALL)).findall
    chars = "".join(f"{chr(first)}-{chr(last)}" for first, last in newer)
    letter, number = (f"[{ALL[kind]}--[{chars}]]" for kind in ("letter", "number"))
    pattern = WORDS.format(letter=letter, number=number, space=ALL["space"])
    return regex.compile(f"[{chars}]").search, regex.compile("(?V1)" + pattern).findall


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if it shows, else the next free one."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _WordIds(dict):
    """Serialized ids of words, worked out when first asked for."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.bytes = 0

    def __missing__(self, word: str) -> bytes:
        ids = serial(merged([self.bpe.of_byte[b] for b in word.encode()], self.bpe.merges))
        if len(word) <= REMEMBERED_WORD:
            if self.bytes > REMEMBERED_BYTES:
                self.clear()
                self.bytes = 0
            self[word] = ids
            self.bytes += len(word) + len(ids) + 200
        return ids


def serial(ids: list[int]) -> bytes:
    """``ids`` as little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Bpe:
    """A byte-level BPE vocabulary of the ``tokenizers`` file format, with its own encoder and decoder.

    Vocabularies with a normalizer, dropout, affixes or added tokens that take in their surroundings are
    refused, as they follow other rules. Truncation, padding and what is added around a text play no part.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = (
            spec["normalizer"] is None
            and cut.get("type") == "ByteLevel"
            and not cut["add_prefix_space"]
            and cut.get("use_regex", True)
            and not any(
                model.get(k)
                for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
            )
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        letters = _byte_letters()
        vocab = model["vocab"]
        if not plain or any(letter not in vocab for letter in letters):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.of_byte = {byte: vocab[letter] for letter, byte in letters.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {
            i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            for token, i in self.added.items()
        }
        self.words = _WordIds(self)
        self._latin = re.compile(WORDS.format(**LATIN)).findall
        self._all = regex.compile(WORDS.format(**ALL)).findall
        # Of added tokens that begin at one place the longest is taken.
        longest = sorted(self.added, key=len, reverse=True)
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else None

    def cut(self, text: str) -> list[str]:
        """The words of ``text``."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            has_newer, without_newer = _newer_letters()
            return without_newer(text) if has_newer(text) else self._all(text)
        return self._latin(text)

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, serialized; added tokens in it are themselves."""
        parts = self.cut_added(text) if self.cut_added else [text]
        ids: list[bytes] = []
        for nth, part in enumerate(parts):
            if nth % 2:
                ids.append(serial([self.added[part]]))
            else:
                for piece in _pieces(part):
                    ids.append(b"".join(map(self.words.__getitem__, self.cut(piece))))
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """The text of serialized ``ids``; bytes that are no UTF-8 become replacement characters."""
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


def _pieces(text: str) -> Iterator[str]:
    """``text`` in parts of about PIECE_CHARS, cut where no word can lie across: before a space behind a letter."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        end = text.find(" ", start + PIECE_CHARS)
        while end > 0 and not text[end - 1].isalnum():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """The vocabulary of a file, loaded once per worker."""
    return Bpe(path)


def _batches(rows: Iterator[tuple[object, bytes, int]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows (…, size) as record batches of about BATCH_BYTES."""
    waiting: list[tuple] = []
    held = 0
    for *row, size in rows:
        waiting.append(tuple(row))
        held += size
        if held >= BATCH_BYTES:
            yield _batch(waiting, names, kinds)
            waiting, held = [], 0
    if waiting:
        yield _batch(waiting, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _encoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path).encode

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    ids = encode(text.as_py() or "")
                    yield doc_id.as_py(), ids, len(ids)

        yield from _batches(rows(), ["doc_id", "ids"], [pa.int64(), pa.binary()])

    return run


def _decoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(path).decode

        def rows():
            for batch in batches:
                for doc_id, ids in zip(batch.column(0), batch.column(1)):
                    raw = ids.as_py()
                    text = decode(raw)
                    yield doc_id.as_py(), raw, text, len(raw) + 4 * len(text)

        yield from _batches(rows(), ["doc_id", "ids", "decoded"], [pa.int64(), pa.binary(), pa.string()])

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: its whole text as little-endian unsigned 32-bit ids.

    ``path`` is a vocabulary file that every executor has. Null and empty texts have no ids. Repeated rows
    are rows of their own, a null doc_id stays null. Other columns are ignored; an empty table gives no
    rows. Nothing is shuffled.
    """
    rows = docs.select(column("doc_id").cast("bigint").alias("doc_id"), column("text").alias("text"))
    return rows.mapInArrow(_encoder(path), "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows that ``encode_documents`` made with the same vocabulary; null ids are empty.

    An id that the vocabulary does not have fails the task.
    """
    rows = encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(_decoder(path), "doc_id bigint, ids binary, decoded string")
