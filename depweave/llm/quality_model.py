"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.session import keep, ship_package

FOLDS = 5
FEATURES = 13
FREQUENCIES = 192
RIDGE = 1.0
# Labelled rows that a fit uses, about; more are sampled by a hash of their id.
TRAIN_ROWS = 400_000
# Tasks that sum the normal equations; each sends one matrix to the driver.
PARTS = 16
# Steps of the ridge score that the calibration tells apart.
STEPS = 500
THRESHOLD = 0.3


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; zeros for a text without words."""
    raw = (text or "").encode()
    items = raw.split()
    n = len(items)
    if not n:
        return np.zeros(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    size = max(1, len(raw) - counts[9:14].sum() - counts[32])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(items, items[1:]))
    return np.array(
        [
            np.log1p(n), size / n, counts[65:91].sum() / max(1, letters), counts[48:58].sum() / size,
            counts[[35, 36, 37, 38, 42]].sum() / size, counts[[124, 60, 62, 91, 93, 123, 125]].sum() / size,
            counts[33] / size, counts[[44, 46]].sum() / size, len(set(items)) / n, (len(pairs) + 1) / n,
            1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(max(map(len, items))),
        ]
    )


@dataclass
class Model:
    """What a fit leaves: a few tens of kilobytes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FREQUENCIES + 1))
    steps: np.ndarray = field(default_factory=lambda: np.zeros(1))
    levels: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Features whose products approximate a Gaussian kernel of the scaled statistics."""
        rng = np.random.default_rng(17)
        directions = rng.normal(size=(FEATURES, FREQUENCIES)) / np.sqrt(FEATURES)
        shifts = rng.uniform(0, 2 * np.pi, FREQUENCIES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        out = np.cos(z @ directions + shifts) * np.sqrt(2 / FREQUENCIES)
        return np.hstack([out, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(x) @ self.weights, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.levels)


def isotonic(x: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over sorted steps: positions and non-decreasing shares."""
    pools: list[list[float]] = []
    for at, n, g in zip(x, total, good):
        pools.append([at * n, n, g])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    where = np.array([p[0] / p[1] for p in pools])
    return where, np.array([p[2] / p[1] for p in pools])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"]
        )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("x").to_pylist(), float).reshape(-1, FEATURES)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo five, is zero."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _normal_sums(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FREQUENCIES + 1, FREQUENCIES + 1)), np.zeros(FREQUENCIES + 1)
        for batch in batches:
            z = model.fourier(_matrix(batch))
            a += z.T @ z
            b += z.T @ batch.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"]
        )

    return run


def _raw_scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(model.raw(_matrix(batch)), pa.float64()), batch.column("y")], names=["raw", "y"]
            )

    return run


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """Id and statistics of each row, from its whole text."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_described, "doc_id long, x array<double>")


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """Learn from the statistics of documents (:func:`described`) and ``labels`` (doc_id, quality).

    Held-out rows and rows without a label are not used. If there are more than ``TRAIN_ROWS``, a
    hash of the id picks about so many. Seven tenths fit the ridge weights: each partition sums its
    normal equations, and ``PARTS`` matrices reach the driver. The rest calibrates: counts by step
    of the score, at most ``STEPS`` + 1 rows, are pooled to a rising curve. Without usable labels
    every score is one half.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").cast("double").alias("y"))
    n = usable.count()
    if n > TRAIN_ROWS:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < (TRAIN_ROWS << 20) // n)
    train = keep(
        rows.join(usable, "doc_id").select(
            "x", "y", (F.pmod(F.xxhash64("doc_id", F.lit("role")), F.lit(10)) < 3).alias("calibrate")
        )
    )
    x = F.col("x")
    moments = train.agg(
        *[F.avg(x[i]) for i in range(FEATURES)], *[F.stddev_pop(x[i]) for i in range(FEATURES)]
    ).first()
    if moments[0] is None:
        return Model(np.zeros(FEATURES), np.ones(FEATURES))
    scale = np.array(moments[FEATURES:], float)
    model = Model(np.array(moments[:FEATURES], float), np.where(scale > 1e-9, scale, 1.0))
    sums = train.where(~F.col("calibrate")).coalesce(PARTS).mapInArrow(_normal_sums(model), "a binary, b binary").collect()
    size = FREQUENCIES + 1
    a = sum((np.frombuffer(r["a"]).reshape(size, size) for r in sums), RIDGE * np.eye(size))
    b = sum((np.frombuffer(r["b"]) for r in sums), np.zeros(size))
    model.weights = np.linalg.solve(a, b)
    step = F.round(F.col("raw") * STEPS)
    counts = train.where("calibrate").select("x", "y").mapInArrow(_raw_scores(model), "raw double, y double").groupBy(
        step.alias("step")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).orderBy("step").collect()
    if counts:
        model.steps, model.levels = isotonic(
            np.array([r["step"] / STEPS for r in counts]), np.array([r["n"] for r in counts], float),
            np.array([r["good"] for r in counts], float),
        )
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of described rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def score_text(model: Model):
    """A column function from text to score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = [statistics(t) for t in texts]
        return pd.Series(model.score(np.array(rows).reshape(-1, FEATURES)), dtype=float)

    return score


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query. Statistics are written once, for the fit and the scores.

    Null and empty texts are scored like others. Repeated rows give repeated results; a null id is
    never held out.
    """
    rows = keep(described(docs))
    return scored(rows, fit(rows, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    score = score_text(fit(described(docs), labels))
    return docs.where(score(F.col("text")) >= THRESHOLD)
