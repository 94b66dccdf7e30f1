"""Ordinal quality model: hashed-text weights shared by all grades, with ordered thresholds (cumulative links)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import text_bytes

BUCKETS = 1 << 16
# Labelled rows that the model is fitted on at most, the smallest hashes of their ids.
TRAIN_ROWS = 8_000
MIN_ROWS = 8  # of training rows that must hold a feature
PENALTY = 2e-3
ROUNDS = 400
KEEP_TAIL = 0.5
GRADES = 3

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
# Shares of a text that are features of their own, after the hashed buckets.
SHAPES = ("upper", "symbol", "repeat", "top")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the different tokens of a whole text (letters lower-cased, sign runs as they are); shape shares."""
    tokens = _TOKEN.findall(text)
    counts = Counter(tokens)
    buckets = {xxhash.xxh32_intdigest(t.lower().encode()) % BUCKETS for t in counts}
    n = max(1, len(tokens))
    upper = sum(c for t, c in counts.items() if len(t) > 1 and t.isupper())
    symbol = sum(c for t, c in counts.items() if not t[0].isalnum() and t not in (".", ",", ".,"))
    repeat = sum(map(eq, tokens, tokens[1:]))
    top = counts.most_common(1)[0][1] if counts else 0
    shares = np.array([upper / n, symbol / n, repeat / n, top / n if n >= 20 else 0.0])
    return np.fromiter(sorted(buckets), dtype=np.int32, count=len(buckets)), shares


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(threshold[k] - score)."""

    weights: np.ndarray  # per bucket
    shape_weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str) -> float:
        buckets, shares = features(text)
        return float(self.weights[buckets].sum() + shares @ self.shape_weights)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one column each."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = GRADES) -> OrdinalModel:
    """Accelerated proximal gradient on the cumulative-link likelihood with an L1 penalty on the shared weights.

    Features are weighted by rarity, so one telling word counts in a long text too. Without rows all grades are equally
    likely and scores are zero. Thresholds keep their order as steps between them are exponentials.
    """
    n, width = len(rows), BUCKETS + len(SHAPES)
    start = np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1))
    if n == 0:
        return OrdinalModel(np.zeros(BUCKETS), np.zeros(len(SHAPES)), start)
    held = np.bincount(np.concatenate([b for b, _ in rows]), minlength=BUCKETS)
    rarity = np.where(held >= MIN_ROWS, np.log(n / np.maximum(held, 1)), 0.0)
    shape_scale = 4.0
    scale = np.concatenate([rarity, np.full(len(SHAPES), shape_scale)])
    shape_columns = np.arange(BUCKETS, width)
    columns = np.concatenate([np.concatenate([b, shape_columns]) for b, _ in rows])
    values = np.concatenate([np.concatenate([np.ones(len(b)), s]) for b, s in rows]) * scale[columns]
    row_of = np.repeat(np.arange(n), [len(b) + len(SHAPES) for b, _ in rows])
    used = values != 0
    columns, values, row_of = columns[used], values[used], row_of[used]
    def parts(theta: np.ndarray) -> np.ndarray:
        return np.concatenate([[-np.inf], theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))]), [np.inf]])

    def gradient(w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eta = np.bincount(row_of, weights=values * w[columns], minlength=n)
        bounds = parts(theta)
        high, low = _sigmoid(bounds[grades + 1] - eta), _sigmoid(bounds[grades] - eta)
        prob = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / prob / n, low * (1 - low) / prob / n
        g_w = np.bincount(columns, weights=values * (d_high - d_low)[row_of], minlength=width)
        g_bound = np.bincount(grades, weights=-d_high, minlength=n_grades)[:-1]
        g_bound = g_bound + np.bincount(grades, weights=d_low, minlength=n_grades)[1:]
        later = np.cumsum(g_bound[::-1])[::-1]
        return g_w, np.concatenate([[later[0]], later[1:] * np.exp(theta[1:])])

    # The curvature of the loss is at most that of its quadratic bound; power steps find its largest eigenvalue.
    v = np.ones(width)
    top = 1.0
    for _ in range(12):
        u = np.bincount(row_of, weights=values * v[columns], minlength=n)
        v = np.bincount(columns, weights=values * (u / n)[row_of], minlength=width)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1.0 / (0.5 * top + 1e-9)
    theta = np.concatenate([[start[0]], np.log(np.diff(start))])
    w = np.zeros(width)
    ahead_w, ahead_t, momentum = w, theta, 1.0
    for _ in range(ROUNDS):
        g_w, g_t = gradient(ahead_w, ahead_t)
        moved = ahead_w - step * g_w
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_t = ahead_t - min(step, 1.0) * g_t
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead_w = new_w + (momentum - 1) / after * (new_w - w)
        ahead_t = new_t + (momentum - 1) / after * (new_t - theta)
        w, theta, momentum = new_w, new_t, after
    w = w * scale
    return OrdinalModel(w[:BUCKETS], w[BUCKETS:], parts(theta)[1:-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    grade: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    train_rows: int = TRAIN_ROWS,
) -> OrdinalModel:
    """Fit on the ``train_rows`` labelled documents of the smallest id hashes. Rows without id or grade are not used.

    ``grade`` is an integer column over ``labels``, 0 the worst. Only hashed features of the sample reach the driver.
    """
    graded = labels.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).dropna()
    sample = graded.orderBy(F.xxhash64("id"), "id", "grade").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.decode(errors="replace")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([b.tobytes() for b, _ in found], pa.binary()),
                    pa.array([s.tolist() for _, s in found], pa.list_(pa.float64())),
                ],
                names=["id", "grade", "buckets", "shares"],
            )

    # train_rows bounds the sample, so it may be sent everywhere instead of shuffling all texts.
    labelled = texts.join(F.broadcast(sample), "id").select(F.col("id").cast("long"), "grade", "body")
    table = labelled.mapInArrow(run, "id long, grade int, buckets binary, shares array<double>").toArrow()
    rows = sorted(rows_of_table(table))
    return fit_ordinal(
        [(np.frombuffer(b, dtype=np.int32), np.array(s)) for _, _, b, s in rows],
        np.array([g for _, g, _, _ in rows], dtype=np.int64),
    )


def rows_of_table(table: pa.Table) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in table.columns), strict=True)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``expected_grade``, ``tail``: probability of the best grade, ``grade``, ``keep``) per row of ``docs``.

    The expected grade is the sum of all tail probabilities; ``grade`` counts those of at least a half. ``keep`` is a
    tail of at least KEEP_TAIL. Missing and empty texts have the score 0. Repeated rows give equal rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([shipped.value.score(x.decode(errors="replace")) for x in batch.column(1).to_pylist()])
            tails = shipped.value.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(tails.sum(axis=1)),
                    pa.array(tails[:, -1]),
                    pa.array((tails >= 0.5).sum(axis=1).astype(np.int32)),
                    pa.array(tails[:, -1] >= KEEP_TAIL),
                ],
                names=["doc_id", "expected_grade", "tail", "grade", "keep"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return picked.mapInArrow(run, "doc_id long, expected_grade double, tail double, grade int, keep boolean")


def kept(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose probability of the best grade is at least KEEP_TAIL."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            scores = np.array([shipped.value.score(x or "") for x in texts])
            yield batch.filter(pa.array(shipped.value.tails(scores)[:, -1] >= KEEP_TAIL))

    return docs.mapInArrow(run, docs.schema)


def rating() -> Column:
    """Grades of the ``labels`` table: toxic 0, low quality 1, good 2."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
