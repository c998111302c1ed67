"""Language identification: the family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from tillroll.llm.common import column, id_remainder
from tillroll.sources.scratch import hold

UNKNOWN = "und"
DIMENSIONS = 4096
SEED = 2
# Bounds of the rows learned from: per language, of all languages together unless each needs LEAST_ROWS, and
# how many languages are learned.
ROWS_PER_LANGUAGE = 400
ROWS_IN_ALL = 4000
LEAST_ROWS = 16
MOST_LANGUAGES = 256
SPREAD = 64
EPOCHS = 12
COST = 1.0

# So many languages without a known family are a family each; of more, at most this many form one.
FAMILY_SIZE = 16

# Families of language codes (fixed values).
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he am mt",
    "indo-aryan": "hi ur bn mr ne pa gu",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv mg",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def _halved(names: list[str], means: np.ndarray) -> list[list[str]]:
    """``names`` cut in halves along the leading direction of their means, until each group is small."""
    if len(names) <= FAMILY_SIZE:
        return [names]
    spread = means - means.mean(axis=0)
    order = np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")
    halves = np.array_split(order, 2)
    return [group for half in halves for group in _halved([names[k] for k in half], means[half])]


def families(x: np.ndarray, langs: np.ndarray) -> dict[str, str]:
    """Family of each of ``langs``: by its code, or for many unknown codes by the likeness of their features."""
    found = {lang: _FAMILY_OF.get(lang, lang) for lang in sorted(set(langs.tolist()))}
    unknown = [lang for lang in found if lang not in _FAMILY_OF]
    if len(unknown) > FAMILY_SIZE:
        means = np.array([x[langs == lang].mean(axis=0) for lang in unknown])
        for group in _halved(unknown, means):
            found |= {lang: f"like {group[0]}" for lang in group}
    return found


_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_TO_SPACE = bytes.maketrans(_NOT_LETTERS, b" " * len(_NOT_LETTERS))
BLOCK_BYTES = 1 << 20


def _place(order: int, grams: np.ndarray) -> np.ndarray:
    return (grams + np.uint32(order << 24)) * np.uint32(0x9E3779B1) >> np.uint32(32 - 12)


_SPACE = _place(1, np.array([32], np.uint32))


def features(text: str) -> np.ndarray:
    """Hashed counts of one to three bytes of the lower-cased letters, as square roots of unit length.

    Whole texts are read in blocks that overlap by two bytes.
    """
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_TO_SPACE) + b" ", np.uint8)
    counts = np.zeros(DIMENSIONS)
    for start in range(0, len(data), BLOCK_BYTES):
        block = data[max(0, start - 2) : start + BLOCK_BYTES].astype(np.uint32)
        fresh = min(start, 2)
        pair = block[:-1] << np.uint32(8) | block[1:]
        triple = pair[:-1] << np.uint32(8) | block[2:]
        for order, grams in ((1, block[fresh:]), (2, pair[max(0, fresh - 1) :]), (3, triple)):
            counts += np.bincount(_place(order, grams), minlength=DIMENSIONS)
    counts[_SPACE] = 0  # spaces alone say nothing
    root = np.sqrt(counts)
    return (root / max(1e-9, math.sqrt(float(root @ root)))).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of an L1-loss linear SVM by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    norms = (x * x).sum(axis=1)
    draw = np.random.default_rng(SEED)
    # The rarer side weighs as much as the other.
    cost = COST * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    for _ in range(EPOCHS):
        for i in draw.permutation(len(x)):
            gradient = y[i] * (x[i] @ weights) - 1
            step = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                weights += step * y[i] * x[i]
    return weights


def _margin(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return x @ weights[:-1] + weights[-1]


def _chosen(x: np.ndarray, names: list[str], machines: dict[tuple[str, str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the class with most votes of the one-versus-one machines (ties by margin), and its chance."""
    votes, margins = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    likely = np.ones((len(x), len(names)))
    for (a, b), weights in machines.items():
        i, j, margin = names.index(a), names.index(b), _margin(x, weights)
        votes[:, i] += margin >= 0
        votes[:, j] += margin < 0
        margins[:, i] += margin
        margins[:, j] -= margin
        chance = 1 / (1 + np.exp(-3 * np.clip(margin, -20, 20)))
        likely[:, i] = np.minimum(likely[:, i], chance)
        likely[:, j] = np.minimum(likely[:, j], 1 - chance)
    best = np.argmax(votes + 1e-3 * np.tanh(margins), axis=1)
    return best, likely[np.arange(len(x)), best]


@dataclass(frozen=True)
class Model:
    """Machines between families, and within each family between its languages."""

    languages: dict[str, list[str]] = field(default_factory=dict)
    between: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    within: dict[str, dict[tuple[str, str], np.ndarray]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        families = sorted(self.languages)
        which, likely = _chosen(x, families, self.between)
        names: list[str] = [UNKNOWN] * len(x)
        for k, name in enumerate(families):
            rows = np.flatnonzero(which == k)
            if len(rows):
                best, closer = _chosen(x[rows], self.languages[name], self.within[name])
                likely[rows] *= closer
                for row, b in zip(rows, best):
                    names[row] = self.languages[name][b]
        return names, likely


def _machines(x: np.ndarray, names: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
    found = {}
    for a, b in combinations(sorted(set(names.tolist())), 2):
        rows = (names == a) | (names == b)
        found[a, b] = linear_svm(x[rows], np.where(names[rows] == a, 1.0, -1.0))
    return found


def train(x: np.ndarray, langs: list[str]) -> Model:
    langs_of = np.array(langs, dtype=object)
    family_of = families(x, langs_of)
    families_of = np.array([family_of[lang] for lang in langs], dtype=object)
    languages = {f: sorted(set(langs_of[families_of == f].tolist())) for f in set(families_of.tolist())}
    within = {f: _machines(x[families_of == f], langs_of[families_of == f]) for f in languages}
    return Model(languages, _machines(x, families_of), within)


@F.arrow_udf(ArrayType(FloatType()))
def _features_of(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float32()))


def learnable(doc_id: Column) -> Column:
    """Learning takes ids whose crc32 is not 2 modulo 4; the others are held out."""
    return id_remainder(doc_id, 4) != 2


def fit(docs: DataFrame) -> Model:
    """A model from the text and non-null lang of ``docs``.

    Learned from a bounded sample: per language the ROWS_PER_LANGUAGE rows with the least hash of id and
    text (fewer if there are very many languages), texts with a letter only, whole texts. A language with
    a third of all rows is trimmed to the bound in each task, then in each of SPREAD parts of it, so that
    the last choice sees a fixed number of rows. Of more than MOST_LANGUAGES languages those with most rows
    in the sample are learned, equal ones by code, so what reaches the driver has a fixed bound.
    """
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"),
        column("text").alias("text"),
        F.xxhash64(F.lit(SEED), column("doc_id"), column("text")).alias("order"),
    ).filter(has_letter(F.col("text")))

    def least(frame: DataFrame, *group: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*group).orderBy("order"))
        return frame.withColumn("nth", nth).filter(F.col("nth") <= ROWS_PER_LANGUAGE)

    # Narrow first: which hashes are chosen; only their texts are looked at again.
    hashes = rows.select("lang", "order", F.pmod("order", F.lit(SPREAD)).alias("part"))
    chosen = hold(least(least(hashes, "lang", "part"), "lang"), "language-rows")
    most = chosen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    langs = hold(most.select("lang"), "language-codes")
    n = langs.count()
    if not n:
        return Model()
    each = min(ROWS_PER_LANGUAGE, max(LEAST_ROWS, ROWS_IN_ALL // n))
    keys = chosen.join(langs, "lang").filter(F.col("nth") <= each).select("lang", "order").distinct()
    texts = rows.join(hold(keys, "language-keys"), ["lang", "order"]).dropDuplicates(["lang", "order"])
    learned = texts.select("lang", "order", _features_of("text").alias("x")).orderBy("lang", "order").collect()
    return train(np.array([r["x"] for r in learned], dtype=np.float32), [r["lang"] for r in learned])


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def predictions(text: Column, model: Model) -> Column:
    """(lang, score) of each text."""

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        names: list[str] = []
        likely: list[float] = []
        for k in range(0, len(texts), 256):
            x = np.array([features(t.as_py()) for t in texts[k : k + 256]])
            found, chances = model.predict(x)
            names += found
            likely += chances.tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(likely, pa.float64())], ["lang", "score"])

    return predict(F.coalesce(text, F.lit("")))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``, learned from those not held out.

    Null texts and texts without a letter are ``und`` with score 1; if no language is known all are, with
    score 0. Predictions see the text only. Null ids are not held out; repeated ids are rows of their own;
    an empty table gives no rows; other columns are ignored.
    """
    model = fit(docs.filter(learnable(column("doc_id"))))
    rows = docs.select(
        column("doc_id").cast("bigint").alias("doc_id"),
        (~learnable(column("doc_id"))).alias("held_out"),
        has_letter(column("text")).alias("_letters"),
        predictions(column("text"), model).alias("_found"),
    )
    return rows.select(
        "doc_id",
        "held_out",
        F.when(F.col("_letters"), F.col("_found.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_letters"), F.col("_found.score")).otherwise(1.0).alias("score"),
    )
