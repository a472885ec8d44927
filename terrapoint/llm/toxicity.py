"""Toxicity by logistic regression with a counterfactual penalty on identity terms.

A text's features are the words and word beginnings (three to five letters) that occur in it. The `vocabulary` features
that tell the classes apart best (chi-square over the sample) carry weights. Sentences of the sample that hold an
identity term are copied with the term swapped for the next one of its group, and the squared change of their score is
a part of the loss, so that the mention of a group moves the score little, whichever class its sentences happened to be
in; terms that occur always belong to the vocabulary. The groups of terms are a parameter, one for each language; the
corpus adds one of its own: its most frequent words that both classes use evenly stand where group names stand, between
the words that carry the meaning, and their swaps keep the score from resting on the beginnings of such words. Every
sentence of the sample that holds a term gives a pair; equal changes are summed before they reach the driver.
Fitted on `per_class` labelled documents of each class; every whole text is scored.

Edge cases: a null text counts as empty; an empty text has no features and gets the score of the bias alone; texts and
words of any length are scored whole; equal texts get equal scores; with labels of only one class, or none, every score
is the share of label 1 among them (0 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapoint.llm import learning
from terrapoint.llm.common import staged

#: Identity terms by language, a parameter. Fixed values.
IDENTITY_TERMS = {
    "en": (
        "african", "american", "arab", "asian", "black", "buddhist", "catholic", "chinese", "christian", "deaf", "disabled",
        "european", "female", "gay", "hindu", "hispanic", "immigrant", "indian", "japanese", "jewish", "latino", "lesbian",
        "male", "men", "mexican", "muslim", "old", "protestant", "refugee", "russian", "transgender", "white", "women", "young",
    ),
    "de": ("afrikaner", "alte", "araber", "asiaten", "ausländer", "behinderte", "christen", "frauen", "juden", "jüdisch", "katholisch", "lesbisch", "männer", "muslime", "muslimisch", "schwarze", "schwul", "türken"),
    "es": ("africanos", "ancianos", "árabes", "asiáticos", "católicos", "cristianos", "gitanos", "homosexuales", "hombres", "inmigrantes", "judíos", "lesbianas", "mujeres", "musulmanes", "negros"),
    "fr": ("africains", "arabes", "asiatiques", "catholiques", "chrétiens", "femmes", "handicapés", "hommes", "homosexuels", "immigrés", "juifs", "lesbiennes", "musulmans", "noirs", "vieux"),
}
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")
_PREFIXES = (3, 4, 5)
_KEPT_WORDS = 300_000
#: One feature in a thousand reaches this by chance.
LEAST_CHI_SQUARE = 10.83


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in _PREFIXES if len(word) > n)]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Scorer:
    """Weights by feature. A word's total effect depends on the features a text already has, so texts are scored by
    the set of their known features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}
        self.pairs, self.change = 0, 0.0

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def found(self, text: str) -> set[str]:
        words = words_of(text)
        known = self.known
        if len(known) > _KEPT_WORDS:
            known.clear()
        for w in [w for w in words if w not in known]:
            known[w] = [f for f in features_of(w) if f in self.weights]
        out: set[str] = set()
        for hit in filter(None, map(known.__getitem__, words)):
            out.update(hit)
        return out

    def logit(self, text: str) -> float:
        return self.bias + sum(self.weights[f] for f in sorted(self.found(text)))


def swapped(text: str, groups: list[tuple[str, ...]]) -> list[tuple[str, str]]:
    """(sentence, the same with its terms swapped for the next of their group), for sentences that have any."""
    following: dict[str, str] = {}
    for terms in groups:
        for term, other in zip(terms, terms[1:] + terms[:1], strict=True):
            following.setdefault(term, other)
    out = []
    for sentence in _SENTENCE.split((text or "").lower()):
        if any(w in following for w in _WORD.findall(sentence)):
            out.append((sentence, _WORD.sub(lambda m: following.get(m[0], m[0]), sentence)))
    return out


def solve(x: np.ndarray, y: np.ndarray, sample_weights: np.ndarray, change: np.ndarray, fairness: float, penalty: float = 5e-5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias. change: the features' matrix by which w @ change @ w is the mean squared change of the score."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), np.float32(0)
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    share = (sample_weights / sample_weights.sum()).astype(np.float32)
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        d = share * (p - y)
        g = x.T @ d + penalty * w + fairness * (change @ w)
        full = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full * full
        step = 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), np.float32(b - step[-1])
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = 3000, vocabulary: int = 1500, terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS, even_terms: int = 40, fairness: float = 10.0):
    """A Scorer, or the constant score where the labels allow no fit. learn_from: condition on doc_id. even_terms: words
    that the corpus adds to the terms. The scorer's `pairs` and `change` are the number of swapped sentences and the
    root of the mean squared change of their logit."""
    sample, totals = learning.sampled(docs, learning.clean_labels(labels, "toxic", learn_from), per_class, "toxic-sample")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = sorted({f for w in words_of(text) for f in features_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], ["f", "y"])

    classes = {int(r["y"]): int(r["n"]) for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        n = sum(totals.values())
        return totals.get(1, 0) / n if n else 0.0
    counts = sample.mapInArrow(spread, "f string, y int").groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    pos, neg = float(classes[1]), float(classes[0])
    a, b = F.col("a"), F.col("b")
    cross = a * (neg - b) - b * (pos - a)
    chi = cross * cross * (pos + neg) / (F.lit(pos * neg) * (a + b) * (F.lit(pos + neg) - a - b + 1e-9))
    counts = staged(counts.where(a + b >= 3).select("f", "a", "b", F.round(chi, 9).alias("chi")), "toxic-counts")
    best = counts.where(F.col("chi") >= LEAST_CHI_SQUARE).orderBy(F.desc("chi"), "f").limit(vocabulary).select("f").collect()
    even = counts.where((F.col("chi") < 0.5) & ~F.col("f").endswith("*") & (F.length("f") >= 4)).orderBy(F.desc(a + b), "f").limit(even_terms).select("f").collect()
    # A group's terms are swapped around a ring of those that occur, so that none can take up what another loses.
    listed = sorted({t for g in terms.values() for t in g})
    there = {r["f"] for r in counts.where(F.col("f").isin(listed)).select("f").collect()}
    rings = [[t for t in g if t in there] for g in terms.values()]
    groups = [tuple(ring) if len(ring) > 1 else g for ring, g in zip(rings, terms.values(), strict=True)] + [tuple(r["f"] for r in even)]
    names = sorted({r["f"] for r in best} | there)
    number = {f: i for i, f in enumerate(names)}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = Scorer(dict.fromkeys(number, 0.0), 0.0)
        ids = lambda text: {number[f] for f in shape.found(text)}
        for batch in batches:
            out: list[tuple] = []
            for doc, text, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out.append((doc, y, sorted(ids(text)), []))
                for before, after in swapped(text, groups):
                    own, other = ids(before), ids(after)
                    out.append((None, -1, sorted(own - other), sorted(other - own)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.list_(pa.int32())) for k in (2, 3))], ["doc_id", "y", "own", "other"])

    rows = staged(sample.mapInArrow(rows_of, "doc_id long, y int, own array<int>, other array<int>"), "toxic-rows")
    texts = rows.where("y >= 0").select("doc_id", "y", "own").orderBy("doc_id", "y", F.col("own").cast("string")).collect()  # bounded by the sample
    x = np.zeros((len(texts), len(names)), dtype=np.float32)
    for i, r in enumerate(texts):
        x[i, r["own"]] = 1
    # The pairs' changes, summed over pairs of features: (vocabulary + terms)^2 rows at most come to the driver.
    signed = lambda c, v: F.transform(c, lambda f: F.struct(f.alias("f"), F.lit(v).alias("v")))
    swaps = rows.where("y < 0").groupBy("own", "other").agg(F.count(F.lit(1)).alias("n")).select("n", F.concat(signed("own", -1), signed("other", 1)).alias("c"))
    crossed = swaps.select("n", "c", F.explode("c").alias("a")).select("n", "a", F.explode("c").alias("b"))
    sums = crossed.groupBy(F.col("a.f").alias("i"), F.col("b.f").alias("j")).agg(F.sum(F.col("n") * F.col("a.v") * F.col("b.v")).cast("double").alias("s")).toArrow()
    pairs = swaps.agg(F.sum("n")).first()[0] or 0
    change = np.zeros((len(names), len(names)), dtype=np.float32)
    change[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("s").to_numpy() / max(pairs, 1)
    y = np.array([r["y"] for r in texts])
    by_class = np.array([totals[c] / classes[c] for c in (0, 1)])
    w, bias = solve(x, y, by_class[y], change, fairness)
    scorer = Scorer({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-4}, bias)
    scorer.pairs, scorer.change = int(pairs), float(np.sqrt(max(0.0, w @ change @ w)))
    return scorer


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row of docs (which has doc_id and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            logits = np.array([0.0 if isinstance(model, float) else model.logit(t) for t in texts])
            p = np.full(len(texts), model) if isinstance(model, float) else 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")
