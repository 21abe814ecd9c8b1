"""Operator 6, language ID: a byte convolutional network, trained in numpy.

Bytes are embedded; filters of 2, 3 and 4 bytes slide over a window of ``WINDOW``
bytes; each filter's largest response goes through a softmax.  A text is the mean of
its windows' distributions.  Windows cover the whole text; the last is padded with the
byte 0, whose embedding is zero.

The network learns from windows of at most ``PER_LANG`` labelled texts a language and
``TEXTS`` in all, chosen by hash of the key (these bounds are the parameters of
``fit``).  For scoring the filters are tabulated by pairs of bytes, so a window
costs five look-ups a byte.

Rows: a null text or one without a letter is ``und`` with score 0, and so is every
text if there is nothing to learn from.  Long texts are scored in slices of bounded
memory.  A null key is not held out and is never learned from.  Ties go to the language
that sorts first.  An empty table gives an empty result.  The input's columns are kept
in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from merchantlens.llm.frames import carried
from merchantlens.llm.sample import by_hash, share_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
PER_LANG, TEXTS = 400, 4_000
WINDOWS_PER_TEXT = 4
EPOCHS, BATCH, RATE = 5, 64, 0.01
UNKNOWN = "und"
#: Windows scored at a time.
SLICE = 512
_LETTER = regex.compile(r"\p{L}")


def held_out(key: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows(data: bytes) -> np.ndarray:
    """The windows that cover a text, one a row."""
    padded = data.ljust(-(-len(data) // WINDOW) * WINDOW, b"\0")
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, WINDOW)


@dataclass
class Network:
    langs: list[str]
    weights: dict[str, np.ndarray]

    def __post_init__(self):
        self._tables = None

    def __getstate__(self):
        return {"langs": self.langs, "weights": self.weights, "_tables": None}

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width the responses by two bytes (or one) at an offset."""
        if self._tables is None:
            embedding, self._tables = self.weights["embedding"], []
            for width in WIDTHS:
                filters = self.weights[f"filters{width}"]
                alone = [(embedding @ filters[at]).astype(np.float32) for at in range(width)]
                made = []
                for at in range(0, width - 1, 2):
                    pair = (alone[at][:, None] + alone[at + 1][None]).reshape(65536, FILTERS)
                    made.append((at, pair))
                if width % 2:
                    made.append((width - 1, alone[-1]))
                self._tables.append(made)
        return self._tables

    def scores(self, found: np.ndarray) -> np.ndarray:
        """The distribution over languages of each window."""
        out = np.empty((len(found), len(self.langs)))
        for start in range(0, len(found), SLICE):
            part = found[start : start + SLICE].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            largest = []
            for width, tables in zip(WIDTHS, self.tables(), strict=True):
                places = WINDOW - width + 1
                response = 0
                for at, table in tables:
                    codes = pairs if len(table) == 65536 else part
                    response = response + np.take(table, codes[:, at : at + places], axis=0)
                largest.append(response.max(axis=1))
            hidden = np.maximum(np.concatenate(largest, axis=1) + self.weights["bias"], 0)
            out[start : start + SLICE] = _softmax(hidden @ self.weights["dense"] + self.weights["out"])
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(found: np.ndarray, lang: np.ndarray, langs: list[str], epochs: int = EPOCHS) -> Network:
    """Adam on the cross entropy of windows; ``lang`` holds places in ``langs``."""
    rng = np.random.default_rng(0)
    size = FILTERS * len(WIDTHS)
    weights = {"embedding": rng.normal(0, 0.5, (256, EMBEDDING))}
    weights |= {
        f"filters{w}": rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS
    }
    weights |= {"bias": np.zeros(size), "dense": rng.normal(0, size**-0.5, (size, len(langs)))}
    weights["out"] = np.zeros(len(langs))
    weights["embedding"][0] = 0
    moments = {name: [np.zeros_like(w), np.zeros_like(w)] for name, w in weights.items()}
    step, batches = 0, max(1, len(found) // BATCH)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(found)), batches):
            step += 1
            for name, slope in _slopes(weights, found[rows], lang[rows]).items():
                m, v = moments[name]
                m += 0.1 * (slope - m)
                v += 0.001 * (slope**2 - v)
                size_ = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                weights[name] -= size_ * m / (np.sqrt(v) + 1e-8)
            weights["embedding"][0] = 0
    return Network(langs, weights)


def _slopes(weights: dict, found: np.ndarray, lang: np.ndarray) -> dict[str, np.ndarray]:
    n, each = len(found), np.arange(len(found))[:, None]
    embedded = weights["embedding"][found]
    kept, largest = [], []
    for width in WIDTHS:
        places = WINDOW - width + 1
        filters = weights[f"filters{width}"]
        response = sum(embedded[:, at : at + places] @ filters[at] for at in range(width))
        best = response.argmax(axis=1)
        kept.append(best)
        largest.append(np.take_along_axis(response, best[:, None], axis=1)[:, 0])
    raw = np.concatenate(largest, axis=1) + weights["bias"]
    hidden = np.maximum(raw, 0)
    error = _softmax(hidden @ weights["dense"] + weights["out"])
    error[np.arange(n), lang] -= 1
    error /= n
    back = (error @ weights["dense"].T) * (raw > 0)
    slopes = {"dense": hidden.T @ error, "out": error.sum(axis=0), "bias": back.sum(axis=0)}
    of_embedding = np.zeros_like(weights["embedding"])
    for k, (width, best) in enumerate(zip(WIDTHS, kept, strict=True)):
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        filters = weights[f"filters{width}"]
        slope = np.empty_like(filters)
        for at in range(width):
            slope[at] = np.einsum("nfe,nf->ef", embedded[each, best + at], part)
            np.add.at(of_embedding, found[each, best + at], part[:, :, None] * filters[at].T)
        slopes[f"filters{width}"] = slope
    return slopes | {"embedding": of_embedding}


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_lang: int = PER_LANG,
    texts: int = TEXTS,
) -> Network | None:
    """A network learned from labelled texts outside the held-out fold; None without any."""
    known = docs.where(
        F.col(key).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(key)) & F.col(text).rlike(r"\p{L}")
    ).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # Counts of the languages, the most frequent first: a bounded number of rows.
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(texts // 10).collect()
    per_lang = min(per_lang, texts // max(1, len(counts)))
    chosen = F.lit(False)
    for row in counts:
        chosen = chosen | (
            (F.col("lang") == row.lang) & by_hash(F.col("key"), share_of(per_lang, row["count"]), 17)
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key_, text_, lang_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                all_ = windows(text_.encode())
                for n in np.linspace(0, len(all_) - 1, WINDOWS_PER_TEXT).round().astype(int):
                    rows.append((str(key_), lang_, all_[n].tobytes()))
            if rows:
                names = ["key", "lang", "window"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    sample = known.where(chosen).limit(texts).mapInArrow(cut, "key string, lang string, window binary")
    rows = sorted((r.lang, r.key, bytes(r.window)) for r in sample.distinct().collect())
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    found = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    return train(found, np.array([langs.index(r[0]) for r in rows]), langs)


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``row`` (the input's columns), ``lang_pred`` and ``score``."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    if network is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _of_texts(network, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())],
                ["row", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, carried(rows, "row", new="lang_pred string, score double"))


def _of_texts(network: Network, texts: pa.Array) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    held, size, waiting = [], 0, []

    def flush() -> None:
        nonlocal size
        if waiting:
            got = network.scores(np.concatenate(waiting))
            end = np.cumsum([len(w) for w in waiting])
            sums = np.add.reduceat(got, np.concatenate([[0], end[:-1]]), axis=0)
            for n, at in enumerate(held):
                total[at] = total.get(at, 0) + sums[n]
        held.clear()
        waiting.clear()
        size = 0

    total: dict[int, np.ndarray] = {}
    for n in range(len(texts)):
        text = texts[n].as_py()
        if text is None or not _LETTER.search(text):
            continue
        all_ = windows(text.encode())
        for start in range(0, len(all_), 4 * SLICE):
            part = all_[start : start + 4 * SLICE]
            held.append(n)
            waiting.append(part)
            size += len(part)
            if size >= 4 * SLICE:
                flush()
    flush()
    for n in range(len(texts)):
        if n not in total:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        share = total[n] / total[n].sum()
        best = int(share.argmax())
        langs.append(network.langs[best])
        scores.append(float(min(1.0, share[best])))
    return langs, scores
