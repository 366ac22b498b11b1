"""Toxicity as ordinal regression with a cumulative link.

P(grade >= k) is the logistic function of w.x - t_k: weights w are shared by all grades, and only the
thresholds t_1 <= t_2 <= ... tell grades apart. x has a 1 for every hashed feature of a text: its words
and their first four and six bytes, lower-cased. The model is fitted on a bounded sample of graded rows
(`rows_per_grade` of each grade, those with the smallest hashes of their ids) on features that a
chi-squared test ties to toxicity; it then scores every whole text.

Defined results: null and empty texts and texts without a known feature get the severity of no feature;
without graded rows, or with one grade alone, nothing is rejected and severity is that grade (or 0);
graded rows with nulls, or without a document, are ignored; an id that is graded twice takes its larger
grade; empty tables give empty results. Columns named severity, grade or rejected are replaced and all
others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, words

HEADS = (4, 6)
ROWS_PER_GRADE = 3000
#: Chi-squared that a feature needs, and training texts it must be in.
LEAST_CHI2, LEAST_TEXTS = 15.0, 3
#: How much commoner a feature must be in toxic texts than in others.
LEAST_RATIO = 5
#: Distinct toxic cues from which a toxic training text counts as severe.
SEVERE_CUES = 4


@dataclass
class Model:
    features: np.ndarray  # hashes with a weight, ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; as many as there are grades above the lowest
    grades: list[int]

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) by text and k."""
        return _logistic(score[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, features, each text's offsets among them) with repeats."""
    for row, stop, data, ends in words.chunks(texts):
        whole, _, _, at, *heads = words.word_hashes(data, ends, words.ALNUM, HEADS)
        hashed = np.stack([whole, *(words.mix(h + np.uint64(i + 1)) for i, h in enumerate(heads))], 1)
        yield row, stop, hashed.ravel(), at * hashed.shape[1]


def _cues(rows: np.ndarray, column: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each feature (by its column) is tied to toxicity, by chi-squared (1 degree of freedom) and by how much commoner it is."""
    n, positive = len(toxic), toxic.sum()
    seen = np.bincount(column).astype(float)
    both = np.bincount(column, weights=toxic[rows].astype(float), minlength=len(seen))
    cross = both * n - seen * positive
    below = seen * (n - seen) * positive * (n - positive)
    chi2 = np.divide(n * cross**2, below, out=np.zeros(len(seen)), where=below > 0)
    told = both * (n - positive) >= LEAST_RATIO * (seen - both) * positive
    return told & (chi2 >= LEAST_CHI2) & (seen >= LEAST_TEXTS)


def fit(rows: np.ndarray, features: np.ndarray, grade: np.ndarray, steps: int = 400, l2: float = 1e-4) -> Model:
    """rows, features: the distinct features of each training text; grade: integers."""
    grades = sorted({*grade.tolist()})
    if len(grades) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), grades or [0])
    level = np.searchsorted(grades, grade)
    names, column = np.unique(features, return_inverse=True)
    chosen = np.flatnonzero(_cues(rows, column, level > 0))
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    rows, col = rows[place[column] >= 0], place[column][place[column] >= 0]
    k, n = len(grades) - 1, len(grade)
    above = level[:, None] >= np.arange(1, k + 1)[None, :]
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    w, t = np.zeros(len(chosen)), np.log((1 - share) / share)
    moment = [np.zeros(len(w) + k), np.zeros(len(w) + k)]
    at = np.arange(n)
    for step in range(1, steps + 1):
        score = np.bincount(rows, weights=w[col], minlength=n)
        p = np.concatenate([np.ones((n, 1)), _logistic(score[:, None] - t[None, :]), np.zeros((n, 1))], 1)
        slope = p * (1 - p)
        mass = np.maximum(p[at, level] - p[at, level + 1], 1e-9)
        by_score = -(slope[at, level] - slope[at, level + 1]) / mass / n
        by_threshold = np.zeros(k + 2)
        np.add.at(by_threshold, level, slope[at, level] / mass / n)
        np.add.at(by_threshold, level + 1, -slope[at, level + 1] / mass / n)
        gradient = np.concatenate([np.bincount(col, weights=by_score[rows], minlength=len(w)) + l2 * w, by_threshold[1:-1]])
        moment[0] = 0.9 * moment[0] + 0.1 * gradient
        moment[1] = 0.99 * moment[1] + 0.01 * gradient**2
        move = 0.1 * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[: len(w)], np.sort(t - move[len(w) :])
    return Model(names[chosen], w, t, grades)


def graded(rows: np.ndarray, features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Severity grades for texts labelled 0 or 1: toxic ones with SEVERE_CUES distinct cues (of each kind) or more get 2."""
    column = np.unique(features, return_inverse=True)[1]
    cue = _cues(rows, column, toxic > 0)
    cues = np.bincount(rows, weights=cue[column].astype(float), minlength=len(toxic))
    return np.where(toxic > 0, 1 + (cues >= SEVERE_CUES * (1 + len(HEADS))), 0)


def sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, rows_per_grade: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features (rows, features) and labels of the bounded training sample."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("__graded")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    chosen = None
    for (grade,) in known.select("__label").distinct().orderBy("__label").collect():  # a few
        some = known.where(F.col("__label") == grade).orderBy(F.xxhash64("__graded"), "__graded").limit(rows_per_grade)
        chosen = some if chosen is None else chosen.unionAll(some)
    if chosen is None:
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int)
    # Bounded: rows_per_grade ids of each grade.
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__graded"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, values, at in _features(batch.column(2)):
                values, to = words.distinct_sorted(values, at)
                held = [values[a:b].tobytes() for a, b in zip(to[:-1], to[1:])]
                ids, label = (batch.column(i).slice(row, stop - row) for i in range(2))
                yield pa.RecordBatch.from_arrays([ids, label, pa.array(held, pa.binary())], ["doc", "label", "features"])

    found = rows.select(F.xxhash64("__doc"), "__label", "__text").mapInArrow(storage.tidy(task), "doc long, label int, features binary").toArrow()
    order = np.lexsort((found["doc"].to_numpy(),)) if found.num_rows else np.zeros(0, int)
    held = [np.frombuffer(x, np.uint64) for x in found["features"].to_pylist()]
    held, label = [held[i] for i in order], found["label"].to_numpy()[order].astype(int)
    owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
    features = np.concatenate([*held, np.zeros(0, np.uint64)])
    del found, held
    # Features of too few texts can have no weight; most are.
    kept = np.sort(features)
    first = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]])) if len(kept) else np.zeros(0, int)
    kept = kept[first[np.diff(np.append(first, len(kept))) >= LEAST_TEXTS]]
    at = np.minimum(np.searchsorted(kept, features), max(len(kept) - 1, 0))
    common = kept[at] == features if len(kept) else np.zeros(len(features), bool)
    return owner[common].astype(int), features[common], label


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", rows_per_grade: int = ROWS_PER_GRADE) -> Model:
    """Fit severity grades. A label of 0 and 1 alone is first turned into the grades 0, 1 and 2 by `graded`."""
    rows, features, label = sample(docs, labels, label, doc_id, text, rows_per_grade)
    if {*label.tolist()} == {0, 1}:
        label = graded(rows, features, label)
    model = fit(rows, features, label)
    del rows, features
    storage.settle()
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with severity (the expected grade), grade (the likeliest) and rejected (a grade above the lowest is likelier than not)."""
    new = ["severity", "grade", "rejected"]
    storage.small_batches(docs.sparkSession)
    docs = docs.drop(*new)
    index = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the training sample at most

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        low = np.zeros(1 << 16, bool)  # nearly all features end here
        low[(m.features & np.uint64(0xFFFF)).astype(int)] = True
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for row, stop, values, at in _features(batch.column(index)):
                here = np.flatnonzero(low[(values & np.uint64(0xFFFF)).astype(int)])
                column = np.searchsorted(m.features, values[here])
                column[column == len(m.features)] = 0
                hit = m.features[column] == values[here] if len(m.features) else np.zeros(0, bool)
                owner = np.searchsorted(at, here[hit], "right") - 1
                pairs = np.unique(owner * len(m.features) + column[hit])
                if len(pairs):
                    total[row:stop] = np.bincount(pairs // len(m.features), weights=m.weights[pairs % len(m.features)], minlength=stop - row)
            above = m.at_least(total)
            edges = np.concatenate([np.ones((len(total), 1)), above, np.zeros((len(total), 1))], 1)
            chance = edges[:, :-1] - edges[:, 1:]
            grades = np.array(m.grades)
            rejected = above[:, 0] >= 0.5 if above.shape[1] else np.zeros(len(total), bool)
            extra = [pa.array(chance @ grades.astype(float)), pa.array(grades[chance.argmax(1)].astype(np.int32)), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(storage.tidy(task), f"{fields}, severity double, grade int, rejected boolean")
