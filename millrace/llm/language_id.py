"""Language identification by unigrams of pieces, summed over all segmentations.

A fixed public vocabulary of byte pieces holds every single byte, so any word can be cut into pieces in many ways. Each
language gives every piece a probability; a word's probability is the sum over all its segmentations of the product of their
pieces, found by the forward algorithm. A text's score in a language is the sum of the logarithms over all its words, as no
piece of the vocabulary spans a blank. The probabilities are fitted by expectation and maximisation: expected uses of pieces,
by the forward and backward sums of the words of a sample of texts of each language, counted in tasks and added up by Spark.

Words are runs of letters, digits and bytes beyond ASCII, lower-cased, with one blank before; longer ones than UNIT - 1 bytes count as
several. What reaches the driver is a number for each language and piece. Fitting reads about ROWS_PER_LANGUAGE whole texts
of each language (all, where there are fewer), drawn by a hash of the id; prediction reads every text whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, words

ROWS_PER_LANGUAGE = 1000
ROUNDS = 3
#: Bytes of a word with its blank.
UNIT = 24
#: Uses that every piece is given in every language beside those that were met.
SMOOTHING = 0.1
#: Words whose scores a task keeps, and those that are summed at once.
KNOWN, AT_ONCE = 200_000, 1 << 14
UNKNOWN = "und"
_LOW = np.uint64((1 << 20) - 1)
_up, _down = words._grown(UNIT + 1)


def load_pieces(path: str) -> list[bytes]:
    """The pieces of a file of lines of base64 and rank, up to UNIT bytes; with every single byte."""
    with open(path, "rb") as f:
        held = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    held |= {bytes([b]) for b in range(256)}
    return sorted(p for p in held if len(p) <= UNIT)


def _matrix(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, units), np.int64, len(units))
    flat = np.frombuffer(b"".join(u.ljust(UNIT, b"\0") for u in units), np.uint8).reshape(-1, UNIT)
    return flat, size


def _sums(flat: np.ndarray) -> np.ndarray:
    total = np.zeros((len(flat), UNIT + 1), np.uint64)
    np.cumsum(words._LETTER[flat] * _up[:UNIT], 1, out=total[:, 1:])
    return total


def _span(total: np.ndarray, start: int, stop: int) -> np.ndarray:
    return words.mix((total[:, stop] - total[:, start]) * _down[start])


@dataclass
class Model:
    languages: list[str]
    hashes: np.ndarray  # of the pieces, ascending
    chance: np.ndarray  # language x piece

    @cached_property
    def low(self) -> np.ndarray:
        """Whether some piece's hash ends so: most spans end here."""
        out = np.zeros(int(_LOW) + 1, bool)
        out[(self.hashes & _LOW).astype(np.int64)] = True
        return out

    @classmethod
    def even(cls, languages: list[str], pieces: list[bytes]) -> Model:
        hashes = np.empty(len(pieces), np.uint64)
        for n in range(1, UNIT + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            if own:
                hashes[own] = _span(_sums(_matrix([pieces[i] for i in own])[0]), 0, n)
        return cls(languages, np.sort(hashes), np.full((len(languages), len(pieces)), 1 / len(pieces)))

    def find(self, total: np.ndarray, start: int, stop: int) -> np.ndarray:
        """The piece each unit has from start to stop, or -1."""
        h = _span(total, start, stop)
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.low[(h & _LOW).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[maybe])
        at[at == len(self.hashes)] = 0
        out[maybe] = np.where(self.hashes[at] == h[maybe], at, -1)
        return out

    def forward(self, units: list[bytes], found: dict | None = None) -> np.ndarray:
        """language x unit x end: the sum over all segmentations of the first so many bytes. found keeps (start, stop) -> (units, pieces)."""
        flat, size = _matrix(units)
        total = _sums(flat)
        alpha = np.zeros((len(self.languages), len(units), UNIT + 1))
        alpha[:, :, 0] = 1
        for stop in range(1, int(size.max(initial=0)) + 1):
            there = np.flatnonzero(size >= stop)
            own = total[there]
            for start in range(stop):
                at = self.find(own, start, stop)
                hit = np.flatnonzero(at >= 0)
                if len(hit):
                    who, piece = there[hit], at[hit]
                    alpha[:, who, stop] += alpha[:, who, start] * self.chance[:, piece]
                    if found is not None:
                        found[start, stop] = who, piece
        return alpha

    def log_chance(self, units: list[bytes]) -> np.ndarray:
        """unit x language."""
        alpha = self.forward(units)
        size = np.fromiter(map(len, units), np.int64, len(units))
        return np.log(alpha[:, np.arange(len(units)), size]).T

    def expected(self, units: list[bytes], language: int, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in units that occur so many times in a language."""
        own, found = Model([self.languages[language]], self.hashes, self.chance[language : language + 1]), {}
        alpha = own.forward(units, found)[0]
        size = np.fromiter(map(len, units), np.int64, len(units))
        beta = np.zeros_like(alpha)
        beta[np.arange(len(units)), size] = times / alpha[np.arange(len(units)), size]
        uses = np.zeros(len(self.hashes))
        for start, stop in sorted(found, key=lambda s: (-s[1], -s[0])):
            who, piece = found[start, stop]
            share = own.chance[0, piece] * beta[who, stop]
            beta[who, start] += share
            uses += np.bincount(piece, alpha[who, start] * share, len(uses))
        return uses


def units_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of the distinct words, these, the number of each word among them, each text's offsets)."""
    for row, stop, data, ends in words.chunks(texts):
        starts, stops, _ = words.word_spans(data, ends, words.ALNUM[1])
        many = -(-(stops - starts) // (UNIT - 1))
        begin = np.repeat(starts, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * (UNIT - 1)
        finish = np.minimum(begin + UNIT - 1, np.repeat(stops, many))
        hashes, first, which = np.unique(words.span_hashes(data, begin, finish), return_index=True, return_inverse=True)
        raw = data.tobytes()
        distinct = [b" " + raw[a:b] for a, b in zip(begin[first].tolist(), finish[first].tolist())]
        yield row, stop, hashes, distinct, which, np.searchsorted(begin, ends)


def sample(labelled: DataFrame, doc_id: str, text: str, lang: str, rows_per_language: int) -> DataFrame:
    """language and text of about so many rows of each language, drawn by a hash of the id; all, if there are fewer."""
    rows = labelled.select(F.col(lang).alias("language"), F.col(text).alias("text"), F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)).alias("draw")).where("language is not null")
    counts = rows.groupBy("language").count().select("language", (F.lit(float(rows_per_language << 20)) / F.col("count")).alias("most"))
    drawn = rows.join(F.broadcast(counts), "language").where("draw < most and text is not null")  # a row for each language
    return drawn.select("language", F.lower("text").alias("text"))


def train(labelled: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit each language's piece probabilities on labelled texts; rows without a text or a language teach nothing."""
    spark = labelled.sparkSession
    storage.small_batches(spark)
    counted = pa.schema([("language", pa.string()), ("unit", pa.binary()), ("times", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for row, stop, _, distinct, which, at in units_of(batch.column(1)):
                owner = np.repeat(np.arange(stop - row), np.diff(at))
                label, own = np.unique(names[row:stop].astype(str), return_inverse=True)
                both, times = np.unique(own[owner] * len(distinct) + which, return_counts=True)
                said = label[both // max(1, len(distinct))].tolist()
                yield pa.RecordBatch.from_pydict({"language": said, "unit": [distinct[i] for i in (both % max(1, len(distinct))).tolist()], "times": times}, counted)

    drawn = sample(labelled, doc_id, text, lang, rows_per_language)
    folder = storage.scratch(spark, "language")
    held = drawn.mapInArrow(storage.tidy(count), "language string, unit binary, times long").groupBy("language", "unit").agg(F.sum("times").alias("times"))
    # Spread again: sums of a sample are few bytes, but each word takes some time.
    held = storage.save(held.repartition(spark.sparkContext.defaultParallelism), folder)
    languages = sorted(r["language"] for r in held.select("language").distinct().collect())
    model = Model.even(languages, load_pieces(vocabulary))
    for _ in range(ROUNDS if languages else 0):
        model = _fitted(held, model)
    storage.remove(spark, folder)
    return model


def _fitted(held: DataFrame, model: Model) -> Model:
    """One round: the expected uses of pieces under model, as probabilities."""
    shared = held.sparkSession.sparkContext.broadcast(model)  # languages x pieces
    schema = pa.schema([("language", pa.int32()), ("piece", pa.int32()), ("uses", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros(m.chance.shape)
        for batch in batches:
            names = np.array([m.languages.index(x) for x in batch.column(0).to_pylist()])
            units, times = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for i in np.unique(names).tolist():
                own = np.flatnonzero(names == i)
                total[i] += m.expected([units[k] for k in own.tolist()], i, times[own])
        language, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(language.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[language, piece])], schema=schema)

    each = held.mapInArrow(storage.tidy(task), "language int, piece int, uses double").groupBy("language", "piece").agg(F.sum("uses").alias("uses")).toArrow()
    uses = np.full(model.chance.shape, SMOOTHING)
    uses[each["language"].to_numpy(), each["piece"].to_numpy()] += each["uses"].to_numpy()
    shared.unpersist()
    return Model(model.languages, model.hashes, uses / uses.sum(1, keepdims=True))


class _Known:
    """Scores of words that a task has met, by their hashes."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(self.model.languages)))

    def of(self, hashes: np.ndarray, units: list[bytes]) -> np.ndarray:
        """unit x language; hashes are ascending and distinct."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        new = np.flatnonzero(self.hashes[at] != hashes) if len(self.hashes) else np.arange(len(hashes))
        out = np.empty((len(hashes), len(self.model.languages)))
        if len(self.hashes):
            out[:] = self.scores[at]
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            out[some] = self.model.log_chance([units[k] for k in some.tolist()])
        if len(self.hashes) + len(new) > KNOWN:
            self.forget()
        room = new[:KNOWN]
        order = np.argsort(np.concatenate([self.hashes, hashes[room]]), kind="stable")
        self.hashes = np.concatenate([self.hashes, hashes[room]])[order]
        self.scores = np.concatenate([self.scores, out[room]])[order]
        return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred (the likeliest language; of equals the first by name) and score (how likely it is beside the others).

    Texts that are null or have no letter, and all texts if no language was learned, are UNKNOWN with score 0. Texts without a
    word have the same chance in all languages. Columns of these names are replaced.
    """
    storage.small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*kept, F.lower(text).alias("__text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    n = len(kept)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = _Known(m)
        for batch in batches:
            total = np.zeros((batch.num_rows, len(m.languages)))
            if m.languages:
                for row, stop, hashes, distinct, which, at in units_of(batch.column(n)):
                    if not len(which):
                        continue
                    score = known.of(hashes, distinct)[which]
                    run = np.concatenate([np.zeros((1, score.shape[1])), np.cumsum(score, 0)])
                    total[row:stop] = run[at[1:]] - run[at[:-1]]
                best = total.argmax(1)
                chance = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            else:
                best, chance = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            said = batch.column(n + 1).to_numpy(zero_copy_only=False) & bool(m.languages)
            names = [m.languages[i] if s else UNKNOWN for i, s in zip(best.tolist(), said.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(names, pa.string()), pa.array(np.where(said, chance, 0.0))], [*kept, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return inner.mapInArrow(storage.tidy(task), f"{fields}, lang_pred string, score double")
