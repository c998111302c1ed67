"""Small frames with everything that is awkward: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # Names that operators use for what they add or compute.
    "size string, shard string, slot string, target string, copies string, score string, hash string, "
    "`id` string, `window` string, _id string, _hash string, `a.b` string"
)
EXTRA = ("size", "shard", "slot", "target", "copies", "score", "hash", "id", "window", "_id", "_hash", "a.b")

LONG = " ".join(f"word{k % 997}x{k % 13}" for k in range(60_000))
PROSE = "The quick brown fox jumps over the lazy dog while nine small birds sing in the old apple tree near the river bank"


def doc(doc_id: int | None, text: str | None, lang: str | None = "en", source: str | None = "a") -> tuple:
    return (doc_id, text, lang, source, None if text is None else len(text), *[f"mine {k}" for k in range(len(EXTRA))])


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def messy(spark: SparkSession) -> DataFrame:
    return frame(
        spark,
        [
            doc(1, PROSE),
            doc(2, PROSE, source="b"),
            doc(3, None, None, None),
            doc(4, ""),
            doc(5, " \t\n"),
            doc(6, LONG, source=None),
            doc(7, "Ünïcödé   Straße ΣΊΣΥΦΟΣ 漢字 🙂", None),
            doc(8, "tie", source="b"),
            doc(8, "other text of the same id", source="b"),
            doc(9, "repeated row"),
            doc(9, "repeated row"),
            doc(9, "repeated row"),
            doc(None, "no id"),
            doc(None, "no id"),
            doc(None, None, None, None),
        ],
    )


def empty(spark: SparkSession) -> DataFrame:
    return frame(spark, [])
