"""Benchmark decontamination by template windows with consistent slots."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tillroll.llm.common import column, packed, unpacked
from tillroll.sources.scratch import hold

WINDOW_WORDS = 6
LEAST_WORDS = 5
# Offsets of one occurrence may shift by so many words from window to window: longer values, inserted words.
MOST_SHIFT = 4
LEAST_LITERAL = 0.5
RUN_WORDS = 13
ITEM_SHARE = 0.8
FILTER_BITS = 1 << 24
# What a worker remembers: so many words of so many bytes at most.
WORDS_KEPT = 300_000
REMEMBERED_WORD = 64
OUT_ROWS = 4096
# Documents are looked at in tiles of about so many bytes; a longer one is a tile of its own.
TILE_BYTES = 1 << 19

# Words that stand for numbers and units (fixed values).
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs oz "
    "pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent % "
    "degree degrees °c °f mph kmh w kw v j n pa hz"
).split()

NUMBER, QUANTITY, NAME = "<number>", "<quantity>", "<name>"
IS_NUMBER, IS_UNIT, IS_CAPITAL, ENDS, EMPTY, IS_AMOUNT, IS_NUMBER_WORD = 1, 2, 4, 8, 16, 32, 64
_DIGITS = re.compile(r"[+-]?\d[\d.,:/]*\Z")
_AMOUNT = re.compile(r"[+-]?\d[\d.,]*([^\W\d_]+|%|°[cf])\Z")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_units, _numbers = frozenset(UNITS), frozenset(NUMBER_WORDS)


def _hash(word: bytes) -> int:
    """56 bits, so that a word's hash and its kind fit one number."""
    return xxhash.xxh64_intdigest(word) >> 8


class Words(dict):
    """Hash and kind of each word, packed into one number, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core = core_of(text)
        lower = core.lower()
        kind = ENDS if text.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":") else 0
        amount = _AMOUNT.match(lower)
        if not core:
            kind |= EMPTY
        elif lower in _numbers:
            kind |= IS_NUMBER | IS_NUMBER_WORD
        elif _DIGITS.match(core):
            kind |= IS_NUMBER
        elif amount and amount[1] in _units:
            kind |= IS_AMOUNT
        elif lower in _units:
            kind |= IS_UNIT
        elif len(core) > 1 and core[0].isupper() and not core.isupper():
            kind |= IS_CAPITAL
        value = _hash(lower.encode()) << 8 | kind
        if len(word) <= REMEMBERED_WORD:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = value
        return value


def core_of(text: str) -> str:
    return _EDGES.sub("", text)


def _window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(values) - n + 1)
    total = np.full(m, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + values[k : k + m]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def _held(marks: np.ndarray, n: int) -> np.ndarray:
    """How many words of every window are marked."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[n:] - total[: max(0, len(total) - n)]


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts in one form: word by word, or with a placeholder for each value."""

    hashes: np.ndarray
    slot: np.ndarray  # the type of a placeholder, 0 for a word
    first: np.ndarray  # the token's first word
    end: np.ndarray  # the word behind its last
    text: np.ndarray  # which text it is of

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every ``n`` tokens in a row, and whether they are of one text and say enough."""
        count = max(0, len(self.hashes) - n + 1)
        one_text = self.text[:count] == self.text[n - 1 : n - 1 + count]
        return _window_hashes(self.hashes, n), one_text & (n - _held(self.slot > 0, n) >= LEAST_LITERAL * n)


class Template:
    """The canonical words of some texts: punctuation apart, lower case.

    A number is digits or a run of number words, a quantity a number with its unit, attached or behind it,
    a name a run of capitalised words that do not begin a sentence. Each is one value of one placeholder,
    however many words it has. ``forms`` are the tokens with placeholders for all values, for numbers and
    quantities only, and without any.
    """

    TYPES = (None, NUMBER, QUANTITY, NAME)

    def __init__(self, texts: list[bytes], words: Words):
        of_text = [t.split() for t in texts]
        all_words = list(chain.from_iterable(of_text))
        packed_words = np.fromiter(map(words.__getitem__, all_words), np.uint64, len(all_words))
        text = np.repeat(np.arange(len(texts)), [len(w) for w in of_text])
        kinds = (packed_words & np.uint64(255)).astype(np.uint8)
        real = np.flatnonzero(kinds & EMPTY == 0)
        ended = np.concatenate([[0], np.cumsum(kinds & ENDS > 0)])
        self.words = [all_words[k] for k in real] if len(real) != len(all_words) else all_words
        self.text = text[real]
        self.literal = packed_words[real] >> np.uint64(8)
        kinds = kinds[real]
        same_text = np.zeros(len(real), bool)
        same_text[1:] = self.text[1:] == self.text[:-1]
        # A sentence begins behind a mark that ends one, whether it stands alone or at a word.
        self.begins = ~same_text
        self.begins[1:] |= ended[real[1:]] > ended[real[:-1]]
        number = kinds & IS_NUMBER > 0
        behind = np.zeros(len(real), bool)
        behind[1:] = number[:-1] & same_text[1:]
        self.unit = (kinds & IS_UNIT > 0) & behind
        self.amount = kinds & IS_AMOUNT > 0
        self.name = (kinds & IS_CAPITAL > 0) & ~self.begins
        self.goes_on = self.unit | (behind & (kinds & IS_NUMBER_WORD > 0))
        self.number = number
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def name_runs(self) -> np.ndarray:
        runs = np.zeros(len(self.name), bool)
        runs[1:] = self.name[1:] & self.name[:-1] & (self.text[1:] == self.text[:-1])
        return runs

    def forms(self) -> list[Tokens]:
        n = len(self.literal)
        places = np.arange(n)
        value = self.number | self.unit | self.amount
        found = [Tokens(self.literal, np.zeros(n, np.int8), places, places + 1, self.text)]
        if value.any():
            found.append(self._tokens(value, self.goes_on))
        if self.name.any():
            found.append(self._tokens(value | self.name, self.goes_on | self.name_runs()))
        return found

    def _tokens(self, slots: np.ndarray, goes_on: np.ndarray) -> Tokens:
        first = np.flatnonzero(~goes_on)
        end = np.append(first[1:], len(self.literal))
        quantity = np.add.reduceat((self.unit | self.amount).astype(np.int32), first) > 0
        kind = np.where(quantity, 2, np.where(self.number[first], 1, 3)).astype(np.int8)
        kind = np.where(slots[first], kind, 0)
        hashes = np.where(kind > 0, _TYPE_HASHES[kind], self.literal[first])
        return Tokens(hashes, kind, first, end, self.text[first])

    def slots(self, tokens: Tokens, at: int, n: int) -> list[str]:
        """The values in the placeholders of a window, each with its type in front."""
        return [
            self.TYPES[tokens.slot[k]]
            + " ".join(core_of(w.decode("utf-8", "replace")).lower() for w in self.words[tokens.first[k] : tokens.end[k]])
            for k in range(at, at + n)
            if tokens.slot[k]
        ]

    def whole_sentences(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from a place are one sentence or several, whole."""
        closes = np.append(self.begins[1:], True)
        count = max(0, len(self.literal) - n + 1)
        return self.begins[:count] & closes[n - 1 : n - 1 + count]


_TYPE_HASHES = np.array([0, *[_hash(t.encode()) for t in Template.TYPES[1:]]], np.uint64)


_WINDOW = "id bigint, hash bigint, window bigint, at bigint, span int, n int, words bigint, slots array<string>"
_SCHEMA = pa.schema(
    {
        "id": pa.int64(),
        "hash": pa.int64(),
        "window": pa.int64(),
        "at": pa.int64(),
        "span": pa.int32(),
        "n": pa.int32(),
        "words": pa.int64(),
        "slots": pa.list_(pa.string()),
    }
)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _found(template: Template, lengths: list[int] | None, wanted: np.ndarray | None) -> Iterator[tuple]:
    """(text, window, at, span, n, slots) of the windows of a tile; ``wanted`` is a bit filter.

    Without ``lengths`` a text is an item, and its windows are WINDOW_WORDS tokens or all it has.
    """
    for form, tokens in enumerate(template.forms()):
        own = lengths if lengths is not None else [min(WINDOW_WORDS, len(tokens.hashes))]
        for n in own:
            if n < 1 or n > len(tokens.hashes) or (form and n < LEAST_WORDS):
                continue
            windows, counts = tokens.windows(n)
            if n < LEAST_WORDS:
                counts &= template.whole_sentences(n)
            if wanted is not None:
                bits = windows & np.uint64(64 * len(wanted) - 1)
                counts &= wanted[bits >> np.uint64(6)] >> (bits & np.uint64(63)) & np.uint64(1) > 0
            for at in np.flatnonzero(counts).tolist():
                text = int(tokens.text[at])
                first, end = int(tokens.first[at]), int(tokens.end[at + n - 1])
                slots = template.slots(tokens, at, n) if form else []
                yield text, windows[at].astype(np.int64).item(), first - int(template.bounds[text]), end - first, n, slots


def _tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows (id, hash, text) in tiles of about ``most`` bytes of text."""
    tile, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns):
            key, digest, text = (value.as_py() for value in row)
            tile.append((key, digest, text))
            size += len(text)
            if size >= most:
                yield tile
                tile, size = [], 0
    if tile:
        yield tile


def _cutter(lengths: list[int] | None, wanted: np.ndarray | None):
    """Windows of the texts; without ``lengths`` each text is an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = Words(), []
        for tile in _tiles(batches, TILE_BYTES if lengths is not None else 0):
            template = Template([text for _, _, text in tile], words)
            for text, window, at, span, n, slots in _found(template, lengths, wanted):
                key, digest, _ = tile[text]
                count = int(template.bounds[text + 1] - template.bounds[text])
                rows.append((key, digest, window, at, span, n, count, slots))
                if len(rows) >= OUT_ROWS:
                    yield _rows(rows)
                    rows = []
        if rows:
            yield _rows(rows)

    return run


def _texts(df: DataFrame, id_name: str) -> DataFrame:
    return df.select(
        column(id_name).cast("bigint").alias("id"),
        F.xxhash64(column("text")).alias("hash"),
        F.coalesce(column("text"), F.lit("")).cast("binary").alias("text"),
    )


def _filter_bits(windows: DataFrame) -> np.ndarray:
    """A bit set of all benchmark windows: 2 MB at any size of the benchmark."""
    bit = F.col("window").bitwiseAND(FILTER_BITS - 1)
    places = windows.select(F.shiftright(bit, 6).alias("place"), bit.bitwiseAND(63).cast("int").alias("bit")).distinct()
    one = F.expr("shiftleft(CAST(1 AS BIGINT), bit)")
    found = places.groupBy("place").agg(F.bit_or(one).alias("bits")).collect()
    wanted = np.zeros(FILTER_BITS // 64, np.uint64)
    for place, bits in found:
        wanted[place] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return wanted


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item, literally or with other numbers, names and units.

    Columns: _id, _hash (doc_id and text hash of the document), item_id, item_words, covered_words and
    changed_slots, how many slot values differ from the item's; the best occurrence per document and item.

    Windows of WINDOW_WORDS tokens (a shorter item is one window) are joined by hash, in three forms: with
    placeholders for numbers, quantities and names, for numbers and quantities, and word for word, so that a
    literal copy always matches. Windows with less than LEAST_LITERAL literal tokens say too little. An item
    under LEAST_WORDS words is found where it is a whole sentence, or several, word for word.

    Windows of a document and an item are one occurrence if they have the same offset, or if offsets shift
    by MOST_SHIFT words at most from one to the next, as values of other lengths and inserted words make
    them. An occurrence counts if its slots are consistent, each value of the item standing for one value of
    the document and the other way round, and if it covers RUN_WORDS words or ITEM_SHARE of the item.

    A bit filter of fixed size, summed up in Spark from all benchmark windows, keeps windows of documents
    that can't match out of the shuffle; if the benchmark outgrows it, more of them pass and the join
    still decides. Null texts are empty and match nothing; null ids are ids like any other; copies and
    repeated rows each have their rows; empty tables give no rows; other columns are ignored.

    Occurrences are judged once per class of passages (:func:`_matches`), then given to the documents.
    """
    met, members, names = _matches(docs, benchmark)
    best = F.struct(F.col("covered_words"), (-F.col("changed_slots")).alias("unchanged"))
    return (
        _leaking(met)
        .join(members, "class")
        .join(names, "item_hash")
        .groupBy(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "item_id", "item_words")
        .agg(F.max(best).alias("best"))
        .select(
            "_id",
            "_hash",
            "item_id",
            "item_words",
            F.col("best.covered_words").cast("bigint").alias("covered_words"),
            (-F.col("best.unchanged")).cast("bigint").alias("changed_slots"),
        )
    )


def _matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched windows per class of passages and item text; the documents of each class; the ids of each item text.

    A passage is a run of a document's benchmark windows, cut where two are further apart than those of any
    one occurrence can be. Passages with the same windows and slots at the same distances are a class, so an
    opening sentence that many items and many documents share is compared once with each item, and copies
    of a document or of an item are compared once.
    """
    items = hold(_texts(benchmark, "item_id").mapInArrow(_cutter(None, None), _WINDOW).distinct(), "leak-items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())
    longest = items.agg(F.coalesce(F.max("words"), F.lit(0))).scalar()
    found = _texts(docs, "doc_id").mapInArrow(_cutter(lengths, _filter_bits(items)), _WINDOW)
    wanted = (
        found.select("id", "hash", "window", "at", "slots")
        .distinct()
        .join(items.select("window").distinct(), "window", "left_semi")
    )
    # Windows next to each other in an occurrence differ by a shift of their offsets and by less than an item.
    of_text = Window.partitionBy("id", "hash").orderBy("at")
    gap = F.col("at") - F.lag("at").over(of_text)
    begins = F.when(F.coalesce(gap > MOST_SHIFT + longest, F.lit(True)), F.col("at"))
    passages = wanted.withColumn("_begins", begins).withColumn("begin", F.max("_begins").over(of_text))
    passages = passages.withColumn("at", F.col("at") - F.col("begin"))
    whole = Window.partitionBy("id", "hash", "begin")
    digests = [F.hex(F.bit_xor(F.xxhash64(F.lit(k), "window", "at", "slots")).over(whole)) for k in (1, 2)]
    passages = passages.withColumn("class", F.concat_ws(" ", *digests, F.count("*").over(whole)))
    passages = hold(passages.select("id", "hash", "class", "window", "at", "slots"), "leak-passages")

    left = passages.select("class", "window", "at", "slots").distinct()
    right = items.select(
        F.col("hash").alias("item_hash"),
        "window",
        F.col("at").alias("item_at"),
        "span",
        F.col("words").alias("item_words"),
        F.col("slots").alias("item_slots"),
    ).distinct()
    met = left.join(right, "window").filter(F.size("slots") == F.size("item_slots")).withColumn(
        "offset", F.col("at") - F.col("item_at")
    )
    met = hold(met.select(*_PAIR, "item_words", "item_at", "span", "slots", "item_slots", "offset"), "leak-matches")
    members = passages.select("class", "id", "hash").distinct()
    return met, members, items.select(F.col("hash").alias("item_hash"), F.col("id").alias("item_id")).distinct()


def _leaking(met: DataFrame) -> DataFrame:
    """(_PAIR, item_words, covered_words, changed_slots) of the occurrences that count."""
    in_order = Window.partitionBy(*_PAIR).orderBy("offset")
    shifted = F.col("offset") - F.lag("offset").over(in_order) > MOST_SHIFT
    # Rows of one offset share a place in the order, so they share the sum.
    near = (
        met.withColumn("_new", F.coalesce(shifted, F.lit(True)).cast("int"))
        .withColumn("place", F.concat(F.lit("near "), F.sum("_new").over(in_order)))
        .drop("_new")
    )
    same = met.withColumn("place", F.concat(F.lit("at "), F.col("offset")))
    judged = _judged(hold(same.unionByName(near), "leak-occurrences"))
    enough = (F.col("covered_words") >= RUN_WORDS) | (F.col("covered_words") >= ITEM_SHARE * F.col("item_words"))
    return judged.filter(F.col("consistent") & enough).select(*_PAIR, "item_words", "covered_words", "changed_slots")


_PAIR = ["class", "item_hash"]


def _judged(met: DataFrame) -> DataFrame:
    """Covered words, consistency and changed slots of each occurrence (_PAIR, place) of matched windows."""
    occurrence = [*_PAIR, "place"]
    # A place counts once, however many forms of its window match.
    places = met.groupBy(*occurrence, "item_words", "item_at").agg(F.max(F.col("item_at") + F.col("span")).alias("end"))
    before = Window.partitionBy(*occurrence).orderBy("item_at").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest(F.col("item_at"), F.coalesce(F.max("end").over(before), F.col("item_at")))
    covered = (
        places.withColumn("gained", F.greatest(F.lit(0), F.col("end") - begin))
        .groupBy(*occurrence, "item_words")
        .agg(F.sum("gained").alias("covered_words"))
    )
    values = (
        met.select(*occurrence, F.explode(F.arrays_zip("item_slots", "slots")).alias("pair"))
        .select(*occurrence, F.col("pair.item_slots").alias("theirs"), F.col("pair.slots").alias("ours"))
        .distinct()
    )
    slots = values.groupBy(*occurrence).agg(
        F.count("*").alias("pairs"),
        F.countDistinct("theirs").alias("theirs"),
        F.countDistinct("ours").alias("ours"),
        F.count_if(F.col("theirs") != F.col("ours")).alias("changed"),
    )
    pairs = F.coalesce("pairs", F.lit(0))
    consistent = (pairs == F.coalesce("theirs", F.lit(0))) & (pairs == F.coalesce("ours", F.lit(0)))
    return covered.join(slots, occurrence, "left").select(
        *occurrence,
        "item_words",
        "covered_words",
        consistent.alias("consistent"),
        F.coalesce("changed", F.lit(0)).alias("changed_slots"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    met, members, _ = _matches(docs, benchmark)
    bad = members.join(_leaking(met).select("class").distinct(), "class", "left_semi")
    bad = hold(bad.select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct(), "leak-documents")
    rows = docs.select(
        packed(docs), column("doc_id").cast("bigint").alias("_doc"), F.xxhash64(column("text")).alias("_text")
    )
    held = rows["_doc"].eqNullSafe(bad["_id"]) & (rows["_text"] == bad["_hash"])
    return rows.join(bad, held, "left_anti").select(*unpacked(docs.columns, {}))
