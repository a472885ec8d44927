"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own and its neighbours' features; a document's raw share is the sum of its
lines' marginal probabilities of being good, from forward-backward, weighted by line length; a logistic curve turns the
share into the probability of the label 1. Labels are known by document only, so lines start with their document's
label, and those of bad documents are then re-labelled by the fitted field, twice; at least half of a bad document's
text stays bad. The field is fitted on a bounded sample (`per_class` labelled documents of each class, texts of over
`most_lines` lines left out of the fit); every whole text is scored.

Edge cases: a null text counts as empty; an empty text is one empty line and gets a score; texts and lines of any
length are scored whole; equal texts get equal scores; with labels of only one class, or none, every score is the
share of label 1 among them (0.5 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapoint.llm import learning
from terrapoint.llm.common import trim, trimmed

_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_MARKS, _SYMBOLS = b".,;:?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"
_HIGH = bytes(range(128, 256))
OWN = 16
WIDTH = 3 * OWN + 1


def line_features(line: str) -> list[float]:
    raw = line.encode("utf-8", "replace")
    size = len(raw)
    if not size or not (words := line.split()):
        return [0.0, 1.0] + [0.0] * (OWN - 2)
    without = lambda chars: size - len(raw.translate(None, chars))
    upper, lower = without(_UPPER), without(_LOWER)
    n, distinct = len(words), len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(size) / 8,
        0.0,
        upper / (upper + lower) if upper + lower else 0.0,
        without(_DIGITS) / size,
        4 * without(_SYMBOLS) / size,
        4 * raw.count(b"!") / size,
        4 * without(_MARKS) / size,
        raw.count(b" ") / size,
        without(_HIGH) / size,
        np.log(distinct) / np.log(n) if n > 1 else 1.0,
        distinct / n,
        same / n,
        min(3.0, size / n / 8),
        2 * raw.count(b" | ") / n,
        1.0 if raw.rstrip()[-1:] in (b".", b"?", b'"', b":") else 0.0,
        np.log1p(n) / 8,
    ]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, each line's with its neighbours' and a constant; the lines' lengths as weights)."""
    lines = (text or "").split("\n")
    own = np.array([line_features(x) for x in lines], dtype=np.float32)
    edge = np.zeros((1, OWN), dtype=np.float32)
    x = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(own), 1), dtype=np.float32)])
    weights = np.array([len(s) for s in lines], dtype=np.float64)
    return x, weights if weights.sum() else np.ones(len(lines))


class Field:
    """Two states, 0 bad and 1 good: w scores good against bad by line, `move` scores neighbouring states."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.w, self.move = np.zeros(WIDTH), np.zeros((2, 2))

    def marginals(self, x: np.ndarray, sizes: np.ndarray, pairs: bool = False):
        """P(good) of each line, for documents whose lines follow one another in x; with pairs, also the expected
        counts of neighbouring states and the log of the partition function of all documents."""
        emit = ((x - self.mean) / self.scale) @ self.w
        order = np.argsort(-sizes, kind="stable")
        at, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        e = np.zeros((len(emit), 2))
        e[:, 1] = emit
        forward, backward = np.empty_like(e), np.zeros_like(e)
        steps = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # documents of over t lines
        forward[at] = e[at]
        for t in range(1, steps):
            here = at[: alive[t]] + t
            before = forward[here - 1]
            for j in (0, 1):
                forward[here, j] = np.logaddexp(before[:, 0] + self.move[0, j], before[:, 1] + self.move[1, j]) + e[here, j]
        for t in range(steps - 2, -1, -1):
            here = at[: alive[t + 1]] + t
            after = backward[here + 1] + e[here + 1]
            for i in (0, 1):
                backward[here, i] = np.logaddexp(after[:, 0] + self.move[i, 0], after[:, 1] + self.move[i, 1])
        both = forward + backward
        z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - z)
        if not pairs:
            return good
        inner = np.ones(len(e), dtype=bool)
        inner[at] = False
        i = np.nonzero(inner)[0]
        counts = np.array([[np.exp(forward[i - 1, a] + self.move[a, b] + e[i, b] + backward[i, b] - z[i]).sum() for b in (0, 1)] for a in (0, 1)])
        return good, counts, z[at].sum()

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> None:
        """Maximum penalised conditional likelihood by Adam. y: 0 or 1 of each line."""
        starts = np.zeros(len(x), dtype=bool)
        starts[np.cumsum(sizes) - sizes] = True
        i = np.nonzero(~starts)[0]
        seen = np.array([[((y[i - 1] == a) & (y[i] == b)).sum() for b in (0, 1)] for a in (0, 1)], dtype=np.float64)
        scaled = (x - self.mean) / self.scale
        theta = np.append(self.w, self.move.ravel())
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            self.w, self.move = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
            good, counts, _ = self.marginals(x, sizes, pairs=True)
            g = np.append(scaled.T @ (good - y), (counts - seen).ravel()) / len(x) + penalty * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.move = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)


def shares(good: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities, by document."""
    at = np.cumsum(sizes) - sizes
    return np.add.reduceat(good * weights, at) / np.add.reduceat(weights, at) if len(sizes) else np.empty(0)


def learn(x: np.ndarray, weights: np.ndarray, sizes: np.ndarray, y: np.ndarray, totals: dict[int, int], relabel: int = 2) -> tuple[Field, float, float]:
    """The field and its curve (a, b), from lines of documents with the labels y."""
    scale = x.std(axis=0).astype(np.float64)
    scale[scale < 1e-6] = 1.0
    mean = x.mean(axis=0).astype(np.float64)
    mean[-1], scale[-1] = 0.0, 1.0
    field, owner = Field(mean, scale), np.repeat(np.arange(len(sizes)), sizes)
    lines = y[owner].copy()
    for turn in range(relabel + 1):
        field.fit(x, sizes, lines)
        if turn == relabel:
            break
        good = field.marginals(x, sizes)
        lines = y[owner].copy()
        for d in np.nonzero(y == 0)[0]:
            here = np.nonzero(owner == d)[0] if len(sizes) < 2 else np.arange(sizes[:d].sum(), sizes[: d + 1].sum())
            worst = here[np.argsort(good[here], kind="stable")]
            before = np.cumsum(weights[worst]) - weights[worst]
            lines[here] = good[here] > 0.5
            lines[worst[before < 0.5 * weights[here].sum()]] = 0
    got = np.bincount(y, minlength=2)
    by_class = np.array([totals.get(c, 0) / max(1, got[c]) for c in (0, 1)])
    a, b = learning.calibrated(shares(field.marginals(x, sizes), weights, sizes), y, by_class[y])
    return field, a, b


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = 1500, most_lines: int = 400):
    """(field, a, b), or the constant score where the labels allow no fit. learn_from: condition on doc_id."""
    sample, totals = learning.sampled(docs, learning.clean_labels(labels, "quality", learn_from), per_class, "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [document_features(t) + (d, y) for d, t, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if t.count("\n") < most_lines]
            yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())], ["doc_id", "y", "x", "w"])

    rows = sample.mapInArrow(run, "doc_id long, y int, x binary, w binary").orderBy("doc_id", "w").collect()  # 2 * per_class at most
    if len({r["y"] for r in rows}) < 2:
        n = sum(totals.values())
        return totals.get(1, 0) / n if n else 0.5
    x = np.vstack([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in rows])
    weights = np.concatenate([np.frombuffer(r["w"]) for r in rows])
    sizes = np.array([len(r["w"]) // 8 for r in rows])
    return learn(x, weights, sizes, np.array([r["y"] for r in rows]), totals)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score and good_share of every row of docs (which has doc_id and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [document_features(t) for t in part.column(1).to_pylist()]
                x, weights = np.vstack([f[0] for f in found]), np.concatenate([f[1] for f in found])
                sizes = np.array([len(f[0]) for f in found])
                if isinstance(model, float):
                    good = np.full(len(x), model)
                    p = share = np.full(len(sizes), model)
                else:
                    field, a, b = model
                    good = field.marginals(x, sizes)
                    share = shares(good, weights, sizes)
                    p = 1 / (1 + np.exp(-np.clip(a * share + b, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(share)], ["doc_id", "score", "good_share"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(trimmed(run), "doc_id long, score double, good_share double")


def mark(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """docs with one more column, quality_keep: whether the score reaches the threshold. All columns stay."""
    held = model

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def keep(texts):
        import pandas as pd

        out: list[bool] = []
        for at in range(0, len(texts), 256):
            found = [document_features(t) for t in texts.iloc[at : at + 256]]
            sizes = np.array([len(f[0]) for f in found])
            if isinstance(held, float):
                out += [held >= threshold] * len(found)
                continue
            field, a, b = held
            share = shares(field.marginals(np.vstack([f[0] for f in found]), sizes), np.concatenate([f[1] for f in found]), sizes)
            out += list(1 / (1 + np.exp(-np.clip(a * share + b, -40, 40))) >= threshold)
        trim()
        return pd.Series(out, dtype="bool")

    return docs.withColumn("quality_keep", keep(F.col("text").cast("string")))
