"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = sigmoid(threshold_k - score). All thresholds share one score: the mean, over a text's words, of the
weights of the word's features. Features are hashes of the lower-cased word, of its first four bytes and of the multiset
of symbols in it, and marks for a word that repeats the one before and for one with two capitals. Each feature enters
scaled by how far the grades of the texts that hold it lie from the mean, shrunk towards 0 where few do; so rare strong
signs need few ratings.

The fit uses a bounded sample of rated texts (SAMPLE); scoring covers every whole text and is a map without shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.llm.bytetext import Kit, Words, alnum_bytes, lowered, mix, nonspace_bytes, prefix_sums, slices, string_view

#: Most rated texts that a fit uses: those whose ids' hashes come first.
SAMPLE = 8000
#: Bits of a feature's number; bytes of a word's head; texts that shrink a feature's scale to half.
BITS, HEAD, SHRINK = 18, 4, 5.0
#: Factor on the mean, passes over the sample, first step and penalty of the fit: fixed values.
GAIN, PASSES, STEP, PENALTY = 20.0, 120, 0.5, 1e-3


@dataclass
class Model:
    """Weights by feature number and ascending thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def to_bytes(self) -> bytes:
        return np.concatenate([self.thresholds, self.weights]).astype("<f8").tobytes()

    @staticmethod
    def of(data: bytes, grades: int) -> Model:
        x = np.frombuffer(data, "<f8")
        return Model(x[grades - 1 :], x[: grades - 1])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def features(kit: Kit, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature number, words of each row) of a piece; a feature comes once for each word that has it."""
    table, alnum, symbol = kit.codes[lowered()], alnum_bytes(), nonspace_bytes() & ~alnum_bytes()
    plain, words = Words(raw, at, alnum), Words(raw, at, nonspace_bytes())
    powers = kit.word.to(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = prefix_sums(table[raw] * powers.up[: len(raw)])
        row, long = plain.row_of_word(), plain.end - plain.start > HEAD
        start = plain.start[long]
        whole = mix((sums[plain.end] - sums[plain.start]) * powers.down[plain.start] + np.uint64(1))
        head = mix((sums[start + HEAD] - sums[start]) * powers.down[start] + np.uint64(2))
        signs = prefix_sums(np.where(symbol[raw], kit.codes[raw], np.uint64(0)))
        signs = signs[words.end] - signs[words.start]
    row_of = words.row_of_word()
    hashed = words.hashes(kit)
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (row_of[1:] == row_of[:-1])
    capitals = prefix_sums(((raw >= 65) & (raw < 91)).astype(np.int32))
    loud = capitals[words.end] - capitals[words.start] >= 2
    top = np.uint64(64 - BITS)
    number = lambda h: (h >> top).astype(np.int64)
    fixed = number(mix(np.array([3, 4], np.uint64)))
    rows = np.concatenate([row, row[long], row_of[signs != 0], row_of[again], row_of[loud]])
    cols = np.concatenate([number(whole), number(head), number(mix(signs[signs != 0] + np.uint64(5))), np.full(again.sum(), fixed[0]), np.full(loud.sum(), fixed[1])])
    return rows, cols, words.counts


def fit_arrays(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, grades: int) -> Model:
    """The model of a sparse matrix (row, column, value) and a grade for each row, by AdaGrad over all rows at once."""
    n, size = len(grade), 1 << BITS
    weights, thresholds = np.zeros(size), np.linspace(-2.0, -1.0, grades - 1)
    if not n:
        return Model(weights, np.full(grades - 1, -40.0))
    scale = np.bincount(cols, (grade - grade.mean())[rows], size) / (np.bincount(cols, minlength=size) + SHRINK)
    x = values * scale[cols]
    seen, seen_t = np.full(size, 1e-8), np.full(grades - 1, 1e-8)
    low, high = np.maximum(grade - 1, 0), np.minimum(grade, grades - 2)
    for _ in range(PASSES):
        score = np.bincount(rows, weights[cols] * x, n)
        a = np.where(grade == 0, 0.0, _sigmoid(thresholds[low] - score))
        b = np.where(grade == grades - 1, 1.0, _sigmoid(thresholds[high] - score))
        p = np.maximum(b - a, 1e-9)
        da, db = np.where(grade == 0, 0.0, a * (1 - a)) / p, np.where(grade == grades - 1, 0.0, b * (1 - b)) / p
        step = np.bincount(cols, ((db - da) / n)[rows] * x, size) + PENALTY * weights / n
        seen += step * step
        weights = weights - STEP * step / np.sqrt(seen)
        step_t = np.array([da[grade == k + 1].sum() - db[grade == k].sum() for k in range(grades - 1)]) / n
        seen_t += step_t * step_t
        thresholds = np.maximum.accumulate(thresholds - 0.3 * STEP * step_t / np.sqrt(seen_t))
    return Model(weights * scale, thresholds)


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE) -> Model:
    """The model of at most `sample` rated texts.

    ratings has a row (id, grade) for a text, grade from 0 to grades - 1; rows with a null id or grade are left out, of
    several for an id the lowest counts. Of several texts of an id one counts, chosen by their features alone, so the model
    doesn't depend on the order of rows. Without any rated text the model gives every text the highest grade. One task
    fits; a text gives it at most 2**BITS features, so its memory is bounded by `sample`.
    """
    chosen = (
        ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
        .dropna()
        .groupBy("id")
        .agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )

    def collect(batches):
        kit = Kit()
        for batch in slices(batches):
            rows, cols, words = features(kit, *string_view(batch.column(1)))
            key, count = np.unique(rows << BITS | cols, return_counts=True)
            row, col = key >> BITS, (key & (1 << BITS) - 1).astype("<i4")
            value = (GAIN * count / np.maximum(words, 1)[row]).astype("<f4")
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            spans = list(zip(ends[:-1], ends[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([col[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([value[a:b].tobytes() for a, b in spans], pa.binary())],
                ["id", "grade", "cols", "vals"],
            )

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "cols", "vals"]).drop_duplicates("id")
        cols = [np.frombuffer(x, "<i4") for x in pdf["cols"]]
        rows = np.repeat(np.arange(len(cols)), [len(x) for x in cols])
        vals = np.concatenate([np.frombuffer(x, "<f4") for x in pdf["vals"]])
        model = fit_arrays(rows, np.concatenate(cols), vals.astype(np.float64), pdf["grade"].to_numpy(np.int64), grades)
        return pd.DataFrame({"model": [model.to_bytes()]})

    # the sample is bounded by `sample` rows of two numbers, so it may go to every task
    rated = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "grade")
    kind = dict(rated.dtypes)["id"]
    found = rated.mapInArrow(collect, f"id {kind}, grade int, cols binary, vals binary").withColumn("sample", F.lit("all")).groupBy("sample").applyInPandas(train, "model binary").collect()
    return Model.of(bytes(found[0]["model"]), grades) if found else fit_arrays(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int), grades)


def graded(docs: DataFrame, model: Model, text_col: str = "text"):
    """A column for docs: struct<expected: double, tail: double> of the text.

    expected is the mean grade, tail the probability of the highest one. Null and empty texts have a score of 0 and
    what the thresholds make of it.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected: double, tail: double>")
    def grade(texts: pa.Array) -> pa.Array:
        kit, weights, thresholds = Kit(), held.value.weights, held.value.thresholds
        out = []
        for piece in slices([pa.RecordBatch.from_arrays([texts, texts], ["a", "b"])] if len(texts) else []):
            rows, cols, words = features(kit, *string_view(piece.column(1)))
            out.append(GAIN * np.bincount(rows, weights[cols], piece.num_rows) / np.maximum(words, 1))
        score = np.concatenate(out) if out else np.zeros(0)
        above = 1 - _sigmoid(thresholds[None, :] - score[:, None])
        return pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(above[:, -1])], ["expected", "tail"])

    return grade(F.col(text_col).cast("string"))


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels table: 0 toxic, 1 of low quality, 2 neither."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


#: Texts with at least this probability of the highest grade are selected.
SELECT = 0.5
