"""Operator 2, quality classifier: co-training of two views of a document.

The text view sees what is written (shares of kinds of characters, repetition of
words and lines); the metadata view sees language, source and length as they are given
on the page.  Each is a logistic regression.  In each of ``ROUNDS`` rounds both are
trained on the labelled documents and on the pseudo-labels that the other view gave,
and each gives the other its most confident judgements of a pool without labels.

A fifth of the labelled documents is kept out: on it each view is calibrated
(Platt scaling) and a last regression learns how much to trust each calibrated view.
This combination scores all documents.

Learning uses at most ``LABELLED`` labelled and ``POOL`` other documents, by hash of the
key, one row a key (parameters of ``fit``); scoring reads whole texts of all documents and shuffles
nothing.

Rows: a null text counts as empty; null metadata are a value of their own; labels that
are null or contradict each other evenly are left out; a null key has no label.  Without
labels of both kinds every document scores 0.5 and is kept.  Repeated rows score alike;
an empty table gives an empty result.  The input's columns are kept in ``row``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from merchantlens.llm.frames import carried
from merchantlens.llm.sample import bounded

LABELLED, POOL = 12_000, 12_000
ROUNDS = 3
#: A pseudo-label needs this calibrated probability, and each round takes the best of each kind.
CONFIDENT, EACH = 0.95, 1_000
CUT = 0.5
SOURCES, LANGS = 64, 16
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_DIGITS, _HIGH = slice(48, 58), slice(128, 256)


def text_view(text: str) -> list[float]:
    """Numbers about a whole text."""
    data = text.encode()
    kinds = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = max(1, len(data))
    upper, lower, high = (int(kinds[s].sum()) for s in (_UPPER, _LOWER, _HIGH))
    digits, space = int(kinds[_DIGITS].sum()), int(kinds[32] + kinds[9:14].sum())
    marks = len(data) - upper - lower - high - digits - space
    words, lines = text.split(), text.split("\n")
    counts = Counter(words)
    most = max(counts.values(), default=0)
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        upper / size,
        lower / size,
        high / size,
        digits / size,
        space / size,
        marks / size,
        (kinds[33] + kinds[63]) / size,
        (kinds[46] + kinds[44]) / size,
        len(counts) / max(1, len(words)),
        np.log1p(len(counts)) / max(1.0, np.log1p(len(words))),
        most / max(1, len(words)),
        sum(map(len, counts)) / max(1, len(counts)),
        len(set(lines)) / len(lines),
        (len(lines) - 1) / max(1, len(words)),
    ]


def meta_view(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """Numbers about a document's metadata: hashed names and the length."""
    out = [0.0] * (LANGS + SOURCES + 3)
    out[zlib.crc32(lang.encode()) % LANGS if lang is not None else -3] = 1.0
    out[LANGS + zlib.crc32(source.encode()) % SOURCES if source is not None else -2] = 1.0
    out[-1] = float(np.log1p(max(0.0, n_chars))) if n_chars is not None else 0.0
    return out


@dataclass
class Logistic:
    """A regression on standardised numbers and, where asked, their squares."""

    squares: bool
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        parts = [z, z**2] if self.squares else [z]
        return np.concatenate([*parts, np.ones((len(z), 1))], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        """Newton's method; both kinds weigh alike."""
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._inputs(x)
        weight = np.where(y > 0.5, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = sigmoid(z @ w)
            slope = z.T @ (weight * (p - y)) + ridge * w
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._inputs(x) @ self.weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    text: Logistic
    meta: Logistic
    calibrations: tuple[Logistic, Logistic]
    combination: Logistic

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The calibrated log odds of each view."""
        return tuple(
            calibration(view(x)[:, None])
            for view, calibration, x in zip(
                (self.text, self.meta), self.calibrations, (text, meta), strict=True
            )
        )

    def __call__(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """The probability of good quality, and that of each view."""
        views = self.views(text, meta)
        return tuple(map(sigmoid, (self.combination(np.stack(views, axis=1)), *views)))


def _both(y: np.ndarray) -> bool:
    return len(y) > 0 and 0 < y.mean() < 1


def co_train(
    text: np.ndarray,
    meta: np.ndarray,
    y: np.ndarray,
    keep_out: np.ndarray,
    pool_text: np.ndarray,
    pool_meta: np.ndarray,
    rounds: int = ROUNDS,
) -> Model | None:
    """The model, or None if there are not both kinds of labels in both parts."""
    if not (_both(y[~keep_out]) and _both(y[keep_out])):
        return None
    views, pools = (text, meta), (pool_text, pool_meta)
    given = [np.full(len(pool_text), np.nan), np.full(len(pool_text), np.nan)]  # to each view
    for n in range(rounds + 1):
        fitted, calibrated = [], []
        for view, x in enumerate(views):
            told = ~np.isnan(given[view])
            all_x = np.concatenate([x[~keep_out], pools[view][told]])
            all_y = np.concatenate([y[~keep_out], given[view][told]])
            fitted.append(Logistic(squares=view == 0).fit(all_x, all_y))
            platt = Logistic(squares=False).fit(fitted[-1](x[keep_out])[:, None], y[keep_out])
            calibrated.append(platt)
        if n == rounds or not len(pool_text):
            break
        for view in (0, 1):
            p = sigmoid(calibrated[view](fitted[view](pools[view])[:, None]))
            other = given[1 - view]
            for kind, sure in ((1.0, p), (0.0, 1 - p)):
                order = np.argsort(-sure, kind="stable")
                order = order[np.isnan(other[order]) & (sure[order] >= CONFIDENT)]
                other[order[:EACH]] = kind
    model = Model(*fitted, tuple(calibrated), Logistic(squares=False))
    model.combination.fit(np.stack(model.views(text[keep_out], meta[keep_out]), axis=1), y[keep_out])
    return model


_VIEWS = "text array<double>, meta array<double>"


def _batch_views(batch: pa.RecordBatch) -> tuple[list, list]:
    text = [text_view(t or "") for t in batch.column("text").to_pylist()]
    names = ("lang", "source", "n_chars")
    meta = [meta_view(*row) for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True)]
    return text, meta


def _inputs(docs: DataFrame, text: str) -> list:
    return [
        F.col(text).cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("double").alias("n_chars"),
    ]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    labelled: int = LABELLED,
    pool: int = POOL,
) -> Model | None:
    """A model learned from ``labels`` (key, 0 or 1) and a pool of other documents."""
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    votes = votes.groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("y")).where("y <> 0.5")
    chosen = bounded(votes, "key", labelled, salt=23).select("key", F.round("y").alias("y"))
    keyed = docs.select(F.col(key).alias("key"), *_inputs(docs, text))
    told = keyed.join(F.broadcast(chosen), "key")  # at most ``labelled`` keys
    others = bounded(keyed.where("key IS NOT NULL"), "key", pool, salt=29, rows=docs.count())
    others = others.join(F.broadcast(chosen), "key", "left_anti").withColumn("y", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = _batch_views(batch)
            columns = [batch.column("key"), batch.column("y"), *map(pa.array, views)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "y", "text", "meta"])

    schema = carried(keyed, "key", new=f"y double, {_VIEWS}")
    viewed = told.unionByName(others).mapInArrow(run, schema)
    # A key counts once, however many rows have it.
    once = viewed.groupBy("key").agg(F.min(F.struct("y", "text", "meta")).alias("row"))
    rows = once.select("key", "row.*").collect()
    rows.sort(key=lambda row: (str(row.key), tuple(row.text)))
    if not rows:
        return None
    y = np.array([np.nan if row.y is None else row.y for row in rows])
    text_x, meta_x = np.array([row.text for row in rows]), np.array([row.meta for row in rows])
    known = ~np.isnan(y)
    folds = np.array([zlib.crc32(str(row.key).encode()) % 5 == 0 for row in rows])
    return co_train(
        text_x[known], meta_x[known], y[known], folds[known], text_x[~known], meta_x[~known]
    )


def score(docs: DataFrame, model: Model | None, text: str = "text", cut: float = CUT) -> DataFrame:
    """``row`` (the input's columns), ``score``, ``p_text``, ``p_meta`` and ``keep``."""
    names = ["score", "p_text", "p_meta"]
    rows = docs.select(F.struct("*").alias("row"), *_inputs(docs, text))
    if model is None:
        rows = rows.select("row", *[F.lit(0.5).alias(name) for name in names])
        return rows.withColumn("keep", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = model(*map(np.array, _batch_views(batch)))
                columns = [batch.column("row"), *map(pa.array, found)]
                yield pa.RecordBatch.from_arrays(columns, ["row", *names])

    schema = carried(rows, "row", new="score double, p_text double, p_meta double")
    return rows.mapInArrow(run, schema).withColumn("keep", F.col("score") >= cut)
