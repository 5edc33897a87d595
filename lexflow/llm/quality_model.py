"""Document quality by regularised quadratic discriminants over transformed text statistics.

One pass over the whole texts gives a fixed vector of statistics for each document. Each class's count, mean
and second moments are sums over its labelled training rows (a bounded number of them, by a hash of their ids),
added up by Spark, so two rows reach the driver. Covariances are shrunk towards their class's diagonal, the pooled covariance and a floor;
their Cholesky factors are kept, and a score compares the classes' Mahalanobis log densities.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexflow.llm.arrow_text import LOWER, slices, task
from lexflow.llm.common import stored

#: Labelled rows that a fit uses at most, those with the least hashes of their ids; so many ids are broadcast.
TRAIN = 100_000

FEATURES = ("words", "word_chars", "marks", "bars", "shouts", "upper", "digits", "stutter", "distinct", "short", "stops", "lines")

_MARK, _UPPER, _DIGIT, _HIGH = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in "#*$%&<>"]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_HIGH[128:192] = True  # continuation bytes


def _per(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[bounds]).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; a null text is an empty one, whose rates are zero."""
    out = []
    for _, w in slices(texts):
        n, data, b = w.counts.astype(float), w.data, w.bounds
        many = np.maximum(n, 1)
        h = w.hashes(seed=3, fold=LOWER)
        owner = w.owners()
        same = np.zeros(len(h), bool)
        if len(h) > 1:
            same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((h, owner))
        new = np.ones(len(h), bool)
        if len(h) > 1:
            new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        letters = _per(~_HIGH[data], b)
        length = w.ends - w.starts
        rate = lambda x: np.log(0.02 + x / (many + 8))
        out.append(
            np.stack(
                [
                    np.log(n + 20),
                    np.log1p((_per(length, w.first) + 50) / (n + 10)),
                    rate(_per(_MARK[data], b)),
                    rate(_per(data == ord("|"), b)),
                    rate(_per(data == ord("!"), b)),
                    np.log(0.05 + _per(_UPPER[data], b) / (letters + 40)),
                    rate(_per(_DIGIT[data], b)),
                    rate(_per(same, w.first)),
                    np.log((_per(new, w.first) + 8) / (n + 8) ** 0.85),
                    (_per(length <= 3, w.first) + 3) / (n + 8),
                    rate(_per(data == ord("."), b)),
                    rate(_per(data == 10, b)),
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


class Discriminant:
    """Quadratic discriminant of class 1 against class 0, fitted from sums."""

    def __init__(self, counts, sums, squares, *, shrink: float, pool: float, floor: float, prior: float | None):
        d = len(FEATURES)
        self.known = bool(counts[0] > 1 and counts[1] > 1)
        if not self.known:
            total = counts[0] + counts[1]
            self.rest = float(np.log((counts[1] + 1) / (counts[0] + 1))) if total else 0.0
            return
        means = [s / n for n, s in zip(counts, sums, strict=True)]
        own = [q / n - np.outer(m, m) for n, m, q in zip(counts, means, squares, strict=True)]
        pooled = (own[0] * counts[0] + own[1] * counts[1]) / (counts[0] + counts[1])
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        self.classes = []
        for m, c in zip(means, own, strict=True):
            c = (1 - pool) * c + pool * pooled
            c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + floor * np.diag(scale**2) + 1e-9 * np.eye(d)
            factor = np.linalg.cholesky(c)
            self.classes.append((m, np.linalg.inv(factor), -np.log(np.diag(factor)).sum()))
        share = counts[1] / (counts[0] + counts[1]) if prior is None else prior
        self.rest = float(np.log(share / (1 - share)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 1 / (1 + np.exp(-self.rest)))
        density = [n - 0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) for m, inv, n in self.classes]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.rest, -500, 500)))


@task
def _measure(batches):
    for batch in batches:
        x = statistics(batch.column(1))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics x of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, "doc_id long, x array<double>")


def remainder(doc_id, folds: int = 3):
    return F.crc32(doc_id.cast("string")) % folds


def marks_of(labels: DataFrame, held: int = 1, train: int = TRAIN) -> DataFrame:
    """doc_id, quality of at most train labelled rows whose crc32(doc_id) mod 3 isn't held; ids with labels that differ have none."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != held))
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    return marks.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train)


def fitted(features: DataFrame, marks: DataFrame, *, shrink: float = 0.05, pool: float = 0.0, floor: float = 0.1, prior: float | None = None) -> Discriminant:
    """The model of classes 0 and 1, from the rows of features that marks has.

    Spark adds the sums up in any order, so scores of two runs may differ in their last digits.
    """
    d = len(FEATURES)
    rows = features.join(F.broadcast(marks), "doc_id").select("quality", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("quality").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs])
    counts, means, squares = [0, 0], [np.zeros(d), np.zeros(d)], [np.zeros((d, d)), np.zeros((d, d))]
    for row in sums.collect():  # a row for each class
        k = row["quality"]
        counts[k] = row["n"]
        means[k] = np.array([row[f"s{i}"] for i in range(d)])
        for i, j in pairs:
            squares[k][i, j] = squares[k][j, i] = row[f"q{i}_{j}"]
    return Discriminant(counts, means, squares, shrink=shrink, pool=pool, floor=floor, prior=prior)


def _score(model: Discriminant):
    @task
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, *, held: int = 1, train: int = TRAIN, **parameters) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    score is the model's probability of label 1, predicted is 1 where it is at least 0.5, held_out marks rows
    that no fit uses; a fit uses train labelled rows at most. Defined cases: a null text is an empty one and has
    a score; a row without doc_id is scored, with held_out null; rows that repeat a labelled doc_id all count;
    labels that are null, contradict one another or are of other rows aren't used; without two
    labelled rows of each class every score is the classes' smoothed share; no rows give no rows; other columns of docs and
    labels play no part.
    """
    features = stored(measured(docs), "quality-features")
    model = fitted(features, marks_of(labels, held, train), **parameters)
    scored = features.mapInArrow(_score(model), "doc_id long, score double, predicted int")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == held).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, *, held: int = 1, train: int = TRAIN, **parameters) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns, without a shuffle of texts.

    Only rows that the fit uses are measured for it. Null and empty texts, repeated rows, contradicting labels, missing ids
    and empty tables: as for quality_scores; a row is kept if its score there is 0.5 or more. Columns of any
    name are carried along.
    """
    marks = stored(marks_of(labels, held, train), "quality-marks", 1000)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks.select("doc_id")), "doc_id", "left_semi")
    model = fitted(measured(some), marks, **parameters)
    at, names = docs.columns.index("text"), docs.schema

    @task
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics(batch.column(at))) >= 0.5))

    return docs.mapInArrow(run, names)
