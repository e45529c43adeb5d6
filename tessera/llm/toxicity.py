"""Toxicity by classifier chains.

Categories are predicted in a fixed order. Each is a logistic regression over the words of a text and over the
probabilities of the categories before it; those are, in training, out-of-fold predictions, so that a later model
sees what earlier models say of texts they haven't learned from. The categories come from label columns; with the
labels at hand these are `low_quality` (quality is 0) and then `toxic`.

A text's words are its distinct runs of letters, digits and non-ASCII characters, A-Z lower-cased, and as one more word
each mark of MARKS that it has at least once for four words. Of these a model uses at most FEATURES, chosen by how much they tell of its category. The model is fitted on the driver on at most
SAMPLE_ROWS labelled texts, those with the smallest hashes of their ids; it is a list of words with weights, of
bounded size, and scores every whole text.

Null and empty texts have no words and get the models' intercepts. Null ids and labels aren't learned from; of
contradicting labels the largest counts, of repeated ids one text. Rows are scored alone: repeated rows alike. Extra columns
are dropped; an empty table gives an empty table. Without labels of both kinds a category's probability is its rate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

SAMPLE_ROWS, FEATURES, FOLDS, LEAST = 6000, 150, 5, 4
CHAIN = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


MARKS = b"#*$%&|<>!?"


def words_of(text: str | None) -> set[bytes]:
    raw = (text or "").encode()
    words = raw.translate(_CLEAN).split()
    often = max(1, len(words) // 4)
    return set(words) | {b"%c" % m for m in MARKS if raw.count(m) >= often}


def _logistic(rows: np.ndarray, cols: np.ndarray, n: int, width: int, dense: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 60) -> np.ndarray:
    """Weights of `width` sparse binary features (rows, cols), of dense columns and an intercept, by Newton's method."""
    full = np.zeros((n, width + dense.shape[1] + 1))
    full[rows, cols] = 1
    full[:, width:-1] = dense
    full[:, -1] = 1
    w = np.zeros(full.shape[1])
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w[-1] = math.log(rate / (1 - rate))
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (p - y) + ridge * w
        hessian = (full * (p * (1 - p))[:, None]).T @ full + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass(frozen=True)
class Link:
    """One category's model: weights of words, of the log odds of earlier categories, and an intercept."""

    words: dict[bytes, float]
    before: tuple[float, ...]
    intercept: float

    def log_odds(self, words: set[bytes], earlier: list[float]) -> float:
        known = self.words
        total = self.intercept + sum(w * x for w, x in zip(self.before, earlier, strict=True))
        return total + sum(known[w] for w in words & known.keys())


def fit_link(sets: list[set[bytes]], y: np.ndarray, earlier: np.ndarray) -> Link:
    """A category's model from texts' word sets, labels, and the earlier categories' log odds (a column each)."""
    n, pos = len(sets), int(y.sum())
    if not n or pos in (0, n):
        rate = (pos + 0.5) / (n + 1) if n else 0.5
        return Link({}, (0.0,) * earlier.shape[1], math.log(rate / (1 - rate)))
    with_, all_ = {}, {}
    for s, label in zip(sets, y, strict=True):
        for w in s:
            all_[w] = all_.get(w, 0) + 1
            if label:
                with_[w] = with_.get(w, 0) + 1
    # words that tell most: signed root of the likelihood ratio
    rate, score = pos / n, {}
    for w, c in all_.items():
        if c >= LEAST:
            a = with_.get(w, 0)
            q = (a + rate) / (c + 1)
            score[w] = c * (q * math.log(q / rate) + (1 - q) * math.log((1 - q) / (1 - rate)))
    chosen = sorted(score, key=lambda w: (-score[w], w))[:FEATURES]
    number = {w: i for i, w in enumerate(chosen)}
    pairs = [(i, number[w]) for i, s in enumerate(sets) for w in s & number.keys()]
    rows, cols = np.array(pairs, np.int64).reshape(-1, 2).T
    w = _logistic(rows, cols, n, len(chosen), earlier, y.astype(float))
    k = len(chosen)
    return Link(dict(zip(chosen, w[:k].tolist(), strict=True)), tuple(w[k:-1].tolist()), float(w[-1]))


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    links: tuple[Link, ...]
    bounds: tuple[float, ...]

    def probabilities(self, words: set[bytes]) -> list[float]:
        earlier, out = [], []
        for link in self.links:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, link.log_odds(words, earlier)))))
            out.append(p)
            earlier.append(math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4))))
        return out


def _bound(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which most is right, by the F measure on out-of-fold predictions."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    f[:-1][p[order][1:] == p[order][:-1]] = 0
    at = int(np.argmax(f))
    low = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + low) / 2)


def fit_chain(sets: list[set[bytes]], labels: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """Models in the labels' order; folds gives each text's fold for out-of-fold predictions."""
    earlier = np.zeros((len(sets), 0))
    links, bounds = [], []
    for y in labels.values():
        out = np.zeros(len(sets))
        for fold in np.unique(folds):
            inside, outside = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            link = fit_link([sets[i] for i in inside], y[inside], earlier[inside])
            out[outside] = [1 / (1 + math.exp(-max(-30.0, min(30.0, link.log_odds(sets[i], list(earlier[i])))))) for i in outside]
        links.append(fit_link(sets, y, earlier))
        bounds.append(_bound(out, y))
        earlier = np.column_stack([earlier, _logit(out)])
    return Chain(tuple(labels), tuple(links), tuple(bounds))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chain=None, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> Chain:
    """A chain over `chain` (category: condition on the labels), from at most sample_rows labelled texts."""
    chain = chain or CHAIN
    key = F.col(f"`{id_col}`")
    marks = [F.expr(c).cast("int").alias(f"\u0001{i}") for i, c in enumerate(chain.values())]
    label = labels.select(key.cast("long").alias("\u0001id"), *marks).dropna()
    label = label.groupBy("\u0001id").agg(*[F.max(f"\u0001{i}").alias(f"\u0001{i}") for i in range(len(chain))])
    label = label.orderBy(F.xxhash64("\u0001id"), "\u0001id").limit(sample_rows)
    some = docs.select(key.cast("long").alias("\u0001id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    some = some.join(F.broadcast(label), "\u0001id")  # sample_rows rows at most

    def distinct(batches):
        for batch in batches:
            sets = [b" ".join(sorted(words_of(t))) for t in batch.column("text").to_pylist()]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sets, pa.binary())], names=[*names, "words"])

    names = ["\u0001id", *[f"\u0001{i}" for i in range(len(chain))]]
    schema = f"`\u0001id` long, {', '.join(f'`{n}` int' for n in names[1:])}, words binary"
    got = {}
    for r in some.select(*names, "text").mapInArrow(distinct, schema).toLocalIterator():
        got[r[0]] = min(got[r[0]], tuple(r)[1:]) if r[0] in got else tuple(r)[1:]
    ids = sorted(got)
    sets = [set(bytes(got[i][-1]).split()) for i in ids]
    y = {c: np.array([got[i][k] == 1 for i in ids], bool) for k, c in enumerate(chain)}
    fold = np.array([(i * 2654435761 >> 7) % folds for i in ids], np.int64)
    return fit_chain(sets, y, fold)


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, p_<category>..., <category>...): probabilities, and whether they reach the category's bound."""
    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("\u0001text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            p = np.array([chain.probabilities(words_of(t)) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(chain.names))
            cols = [pa.array(p[:, k]) for k in range(p.shape[1])]
            cols += [pa.array(p[:, k] >= chain.bounds[k]) for k in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, *[f"p_{n}" for n in chain.names], *chain.names])

    schema = ", ".join([f"`{id_col}` {kind}", *[f"p_{n} double" for n in chain.names], *[f"{n} boolean" for n in chain.names]])
    return source.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, load(spark, sf_dir, "labels")))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
