"""Token-id files: documents compressed one by one with a shared dictionary.

Layout of a file, little-endian: MAGIC, bytes per id (1 byte), hash of the dictionary (8 bytes), then one
Zstandard frame per document, then the index (per document: id or 0, whether there is an id, offset of
its frame, bytes of its frame, number of tokens), then the index's offset, the number of documents and
MAGIC. A reader that wants one document reads the end, the index and one frame.
"""

from __future__ import annotations

import functools
import json
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tokenizers
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillroll.llm.common import column
from tillroll.llm.files import create, new_folder, open_file, sample, train_dictionary
from tillroll.sources.scratch import hold

MAGIC = b"TKZ1"
END_ID = 2
HEAD = "<4sBQ"
TAIL = "<QQ4s"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("tokens", "<u4")])
READ_ROWS = 2048

# Words one worker remembers the ids of, and how long they may be; beyond it the memory starts anew. A text
# without spaces is one word, which is not worth remembering.
WORDS_KEPT = 500_000
REMEMBERED_WORD = 64

# Marks that may stand behind a word: ASCII, neither letters, digits nor white space (fixed values).
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds(dict):
    """Serialized ids of words, worked out when first asked for.

    For a tokenizer that splits at white space and lower-cases character by character, the ids of a text
    are those of its words, one after the other; invented or rare words are few against all words. A word
    of simple letters is one piece for the model, and marks behind it are another.
    """

    def __init__(self, tokenizer: tokenizers.Tokenizer, width: int):
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.kind = {2: "H", 4: "I"}[width]
        spell = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # Letters below U+0250 have one form in NFC; these are the characters the model spells them with.
        self.spelling = {c: spell(chr(c))[0][0] for c in range(0x80, 0x250) if chr(c).isalpha()}

    def piece(self, stem: bytes) -> str | None:
        """What a word of simple letters is to the model; None if only the whole tokenizer can tell."""
        if stem.isalpha():  # ASCII letters
            return stem.lower().decode()
        text = stem.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "ɐ":
            lower = text.lower()
            if lower.isalpha() and max(lower) < "ɐ":
                return lower.translate(self.spelling)
        return None

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(MARKS)
        piece = self.piece(stem) if stem else None
        if piece is None:
            ids = self.whole(word.decode("utf-8", "replace"))
        else:
            ids = self.serial([t.id for t in self.model.tokenize(piece)])
            if len(stem) < len(word):
                ids += self[word[len(stem) :]]
        if len(word) <= REMEMBERED_WORD:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return self.serial(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def serial(self, ids: list[int]) -> bytes:
        numbers = array(self.kind, ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return numbers.tobytes()


def _word_by_word(tokenizer: tokenizers.Tokenizer) -> bool:
    """Whether the tokenizer drops white space before it splits into letters, digits and the rest."""
    spec = json.loads(tokenizer.to_str())
    steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = [s["type"] for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    plain_tokens = all(not (t["lstrip"] or t["rstrip"] or " " in t["content"]) for t in spec["added_tokens"])
    return (
        plain_tokens
        and steps == ["NFC", "Replace", "Lowercase"]
        and cuts == ["Split", "ByteLevel"]
        and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]
        # Fixed value: the pattern for which words of letters, with or without marks behind, are cut as above.
        == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
    )


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> tuple[Callable[[bytes], bytes], int]:
    """Turns UTF-8 text into serialized ids; and the bytes per id, 2 if the vocabulary allows."""
    tokenizer = tokenizers.Tokenizer.from_file(path)
    width = 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    words = WordIds(tokenizer, width)
    if not _word_by_word(tokenizer):
        return lambda text: words.whole(text.decode("utf-8", "replace")), width

    def encode(text: bytes) -> bytes:
        return b"".join(map(words.__getitem__, text.split()))

    return encode, width


def _writer(folder: str, tokenizer_path: str, end_id: int, dictionary: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder(tokenizer_path)
        end = end_id.to_bytes(width, "little")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=3, dict_data=shared).compress
        address = out = None
        index: list[tuple] = []
        at = struct.calcsize(HEAD)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if out is None:
                    address, out = create(folder, ".tkz")
                    out.write(struct.pack(HEAD, MAGIC, width, xxhash.xxh64_intdigest(dictionary)))
                ids = encode(text.as_py()) + end
                frame = compress(ids)
                out.write(frame)
                key = doc_id.as_py()
                index.append((key or 0, key is not None, at, len(frame), len(ids) // width))
                at += len(frame)
        if out is None:
            return
        rows = np.array(index, dtype=INDEX)
        out.write(rows.tobytes())
        out.write(struct.pack(TAIL, at, len(rows), MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict(
            {
                "path": [address],
                "part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                "docs": pa.array([len(rows)], pa.int64()),
                "tokens": pa.array([int(rows["tokens"].sum(dtype=np.int64))], pa.int64()),
            }
        )

    return write


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, folder: str | None = None
) -> tuple[DataFrame, bytes]:
    """Encode ``docs`` and write their ids, ascending by doc_id, to files in ``folder``.

    Returns the manifest (path, part, docs, tokens; parts are in doc_id order) and the dictionary, which
    is also written beside the files. The dictionary is trained on the id arrays of at most SAMPLE_DOCS
    documents of at most SAMPLE_DOC_BYTES each (``files``), chosen by a hash; every document is written.

    Null text is empty: its array holds the end id alone. Null ids come first; rows of one id go by a hash
    of their text, and identical rows, which nothing tells apart, may stand in either order. Rows of a
    repeated id can be split over files. Other columns are ignored; an empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    text = F.coalesce(column("text"), F.lit("")).cast("binary")
    encode, width = encoder(tokenizer_path)
    end = end_id.to_bytes(width, "little")
    arrays = [encode(t) + end for t in sample(docs, column("doc_id"), column("text"))]
    dictionary = train_dictionary(arrays)
    rows = docs.select(
        column("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(column("text")).alias("hash"),
        F.monotonically_increasing_id().alias("nth"),
    )
    placed = rows.repartitionByRange("doc_id", "hash", "nth").sortWithinPartitions("doc_id", "hash", "nth")
    written = placed.select("doc_id", "text").mapInArrow(
        _writer(folder, tokenizer_path, end_id, dictionary), "path string, part bigint, docs bigint, tokens bigint"
    )
    return hold(written, "token-files"), dictionary


def read_document(path: str, position: int, dictionary: bytes) -> np.ndarray:
    """The ids of one document of a file, found by the index."""
    with open_file(path) as source:
        rows, width = _index(source, dictionary)
        row = rows[position]
        source.seek(int(row["offset"]))
        frame = source.read(int(row["bytes"]))
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=shared).decompress(frame), f"<u{width}").astype("<u4")


def _index(source: pa.NativeFile, dictionary: bytes) -> tuple[np.ndarray, int]:
    magic, width, digest = struct.unpack(HEAD, source.read(struct.calcsize(HEAD)))
    if magic != MAGIC or digest != xxhash.xxh64_intdigest(dictionary):
        raise ValueError("not a token file of this dictionary")
    source.seek(source.size() - struct.calcsize(TAIL))
    at, n, magic = struct.unpack(TAIL, source.read(struct.calcsize(TAIL)))
    if magic != MAGIC:
        raise ValueError("a token file that was cut off")
    source.seek(at)
    return np.frombuffer(source.read(n * INDEX.itemsize), INDEX), width


def _reader(dictionary: bytes):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_file(path) as source:
                    rows, width = _index(source, dictionary)
                    for k in range(0, len(rows), READ_ROWS):
                        block = rows[k : k + READ_ROWS]
                        crcs = []
                        for row in block:
                            source.seek(int(row["offset"]))
                            ids = np.frombuffer(decompress(source.read(int(row["bytes"]))), f"<u{width}")
                            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        tokens = block["tokens"].astype(np.int64)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(block["doc_id"], mask=block["has_id"] == 0),
                                "start": pa.array(start + np.cumsum(tokens) - tokens),
                                "n_tokens": pa.array(tokens),
                                "ids_crc32": pa.array(np.array(crcs, dtype=np.int64)),
                            }
                        )
                        start += int(tokens.sum())

    return read


def read_tokens(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """What the files hold, one row per document: doc_id, start, n_tokens, ids_crc32."""
    # One row per file: few even for very large inputs.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    spread = starts.repartition(_parallelism(manifest.sparkSession), "path")
    return spread.mapInArrow(_reader(dictionary), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
