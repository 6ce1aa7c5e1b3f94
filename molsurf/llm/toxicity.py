"""Toxicity by classifier chains.

Categories are predicted one after another; each linear model reads the text's
features and the probabilities of the categories before it. While training,
those probabilities come out of fold: a text's are predicted by models, on
features chosen and scaled, that have not seen it or its labels. The final models
are then fit on all training texts, and each category's threshold is the one of
best F1 over the out-of-fold probabilities.

Features: words, and word beginnings of 4, 5 and 6 bytes, that tell a category's
texts from the others by their document frequencies; and, for low quality only,
a few shares of character kinds. Texts are read whole.

The chain takes any categories with 0/1 labels. The labels table names quality
and toxic, so the chain of op3_toxicity is low_quality (quality 0), then toxic
(toxic 1). Rows with other labels or none are not trained on.

Training reads a bounded sample: at most ``SAMPLE`` labelled texts of least hash
(ties: id, then text), repeated ids and texts included, and of them as many as
``SAMPLE_BYTES`` hold; one task of an executor fits the chain. Null and empty texts have
no features and are toxic with the models' probability of nothing, which is low.
Without texts of both labels nothing is toxic. Repeated rows are scored alike. All
columns stay but those named p_<category>, which are the result's own.
"""

from __future__ import annotations

import pickle
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitted, released, table

SAMPLE, TELLING, FOLDS = 6000, 200, 3
#: Bytes of the training texts; the text that passes it is the last.
SAMPLE_BYTES = 1 << 25
CATEGORIES = ("low_quality", "toxic")
#: Categories that read the shares of character kinds too.
BY_SHARES = ("low_quality",)
STEMS = (4, 5, 6)
SHARES = 5
#: ASCII other than digits and letters separates words; A-Z become a-z.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
KINDS = {"upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "mark": b"!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~", "line": b"\n"}


def stems(word: bytes) -> list[bytes]:
    return [word[:n] + b"*" for n in STEMS if len(word) > n]


def shares(text: bytes) -> list[float]:
    n = max(1, len(text))
    kinds = [(len(text) - len(text.translate(None, own))) / n for own in KINDS.values()]
    words = text.split()
    return [*kinds, len(set(words)) / max(1, len(words))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 8) -> np.ndarray:
    """Weights, bias last, by Newton's method."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        d = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += d
        if np.abs(d).max() < 1e-4:
            break
    return w


@dataclass
class Chain:
    #: word or stem -> feature
    index: dict[bytes, int]
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def features(self, texts: list[bytes], kept: dict[bytes, tuple[int, ...]] | None = None) -> np.ndarray:
        """[text, feature]: log(1 + places) of telling words, then shares."""
        out = np.zeros((len(texts), len(self.index) + SHARES))
        kept = {} if kept is None else kept
        for i, t in enumerate(texts):
            words = Counter(t.translate(WORDS).split())
            for w in set(words).difference(kept):
                kept[w] = tuple(k for s in (w, *stems(w)) if (k := self.index.get(s)) is not None)
            for w, n in words.items():
                for k in kept[w]:
                    out[i, k] += n
            out[i, len(self.index) :] = shares(t)
            if len(kept) > 100_000:
                kept.clear()
        out[:, : len(self.index)] = np.log1p(out[:, : len(self.index)])
        return out * self.scale

    def predict(self, x: np.ndarray) -> np.ndarray:
        seen = x
        for name, w in self.weights.items():
            p = sigmoid(given(seen, len(self.index), name) @ w[:-1] + w[-1])
            seen = np.hstack((seen, p[:, None]))
        return seen[:, x.shape[1] :]


def given(x: np.ndarray, words: int, category: str) -> np.ndarray:
    """What a category's model reads: without shares, but for those that are told by them."""
    if category in BY_SHARES:
        return x
    x = x.copy()
    x[:, words : words + SHARES] = 0
    return x


class Counts:
    """Words and stems of the training texts: one row for each text and token, with its places."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        of: dict[bytes, list[int]] = {}
        rows, tokens, places = array("i"), array("i"), array("i")
        for i, t in enumerate(texts):
            for w, n in Counter(t.translate(WORDS).split()).items():
                if w not in of:
                    of[w] = [number.setdefault(s, len(number)) for s in (w, *stems(w))]
                own = of[w]
                rows.extend([i] * len(own))
                tokens.extend(own)
                places.extend([n] * len(own))
        self.names = list(number)
        del of, number
        key, at = np.unique(np.array(rows, np.int64) << 32 | np.array(tokens, np.int64), return_inverse=True)
        self.row, self.token = key >> 32, key & 0xFFFFFFFF
        self.places = np.bincount(at, places, len(key))
        self.shares = np.array([shares(t) for t in texts]).reshape(-1, SHARES)

    def telling(self, train: np.ndarray, y: np.ndarray, most: int) -> list[int]:
        """The tokens whose document frequencies in the training texts (a mask) tell those of the group y best."""
        own = train[self.row]
        every = np.bincount(self.token[own], minlength=len(self.names))
        inside = np.bincount(self.token[own & y[self.row]], minlength=len(self.names))
        n, m = int((train & y).sum()), int((train & ~y).sum())
        ratio = np.log((inside + 0.5) / (n + 1)) - np.log((every - inside + 0.5) / (m + 1))
        found = np.flatnonzero((inside >= (max(3, n // 400) if n > 60 else 2)) & (ratio > 1.5))
        gain = ratio[found] * np.sqrt(inside[found])
        return sorted(found.tolist(), key=dict(zip(found.tolist(), gain.tolist())).get, reverse=True)[:most]

    def chain(self, train: np.ndarray, labels: dict[str, np.ndarray]) -> tuple[Chain, np.ndarray]:
        """A chain without models, fit on the training texts, and all texts' features under it."""
        chosen = list(dict.fromkeys(k for y in labels.values() for k in self.telling(train, y, TELLING)))
        place = np.full(len(self.names), -1)
        place[chosen] = np.arange(len(chosen))
        at = place[self.token]
        x = np.zeros((len(train), len(chosen) + SHARES))
        x[self.row[at >= 0], at[at >= 0]] = np.log1p(self.places[at >= 0])
        x[:, len(chosen) :] = self.shares
        scale = 1 / np.maximum(x[train].std(0), 0.05)
        return Chain({self.names[k]: i for i, k in enumerate(chosen)}, scale), x * scale


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between neighbouring probabilities among those of best F1."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    f1 = 2 * np.cumsum(y) / (np.arange(len(y)) + 1 + y.sum())
    below = np.append(p[1:], 0.0)
    f1[p == below] = 0  # equal probabilities are not parted
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(p[best] - below[best])]
    return float((p[k] + below[k]) / 2)


def fit(texts: list[bytes], labels: dict[str, np.ndarray], folds: int = FOLDS) -> tuple[Chain, dict[str, np.ndarray]]:
    """The chain over the categories (name -> mask of the texts), and the out-of-fold probabilities of its training texts."""
    labels = {name: np.asarray(y, bool) for name, y in labels.items()}
    counts = Counts(texts)
    every = np.ones(len(texts), bool)
    fold = np.arange(len(texts)) % folds
    parts = [(fold == k, *counts.chain(fold != k, labels)) for k in range(folds) if (fold == k).any() and (fold != k).any()]
    chain, x = counts.chain(every, labels)
    out = np.zeros((len(texts), 0))
    for name, y in labels.items():
        p = np.zeros(len(texts))
        for held, own, own_x in parts:
            seen = given(np.hstack((own_x, out)), len(own.index), name)
            w = logistic(seen[~held], y[~held].astype(float))
            p[held] = sigmoid(seen[held] @ w[:-1] + w[-1])
        chain.weights[name] = logistic(given(np.hstack((x, out)), len(chain.index), name), y.astype(float))
        chain.thresholds[name] = best_threshold(p, y.astype(float)) if y.any() else 1.0
        out = np.hstack((out, p[:, None]))
    return chain, dict(zip(labels, out.T))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Chain | None:
    """Fit on a bounded sample of the labelled documents, on an executor."""
    known = labels.where("doc_id is not null and toxic in (0, 1) and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")  # the broadcast has at most ``sample`` rows
    rows = met.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "text").limit(sample).select("text", "quality", "toxic", "h", "doc_id")  # ids may repeat

    def learn(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        texts, quality, toxic, held = [], [], [], 0
        for b in batches:
            for t, q, x in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held < most:
                    texts.append(t)
                    quality.append(q)
                    toxic.append(x)
                    held += len(t)
        if len(set(toxic)) < 2:
            return None
        chain = fit(texts, {"low_quality": np.array(quality) == 0, "toxic": np.array(toxic) == 1})[0]
        return pickle.dumps((chain.index, chain.scale, chain.weights, chain.thresholds))

    model = fitted(rows, ["h", "doc_id", "text"], learn)
    return Chain(*pickle.loads(model)) if model else None


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """All columns of docs, then p_<category> of each category."""
    names = [f"p_{c}" for c in (chain.weights if chain else CATEGORIES)]
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name not in names]
    schema = ", ".join([f"`{n}` {t}" for n, t in fields] + [f"{n} double" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            texts = b.column(b.schema.names.index("text")).cast(pa.binary())
            p = np.zeros((b.num_rows, len(names)))
            for i in range(0, b.num_rows if chain else 0, 500):
                p[i : i + 500] = chain.predict(chain.features([t or b"" for t in texts.slice(i, 500).to_pylist()], kept))
            cols = [b.column(b.schema.names.index(n)) for n, _ in fields]
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, np.ascontiguousarray(p.T))], names=[n for n, _ in fields] + names)

    return docs.select(*[n for n, _ in fields]).mapInArrow(lambda batches: released(run(batches)), schema)


def is_toxic(chain: Chain | None) -> Column:
    """Of scored rows: whether the probability reaches the chain's threshold."""
    return F.col("p_toxic") >= F.lit(chain.thresholds["toxic"] if chain else 2.0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    chain = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).select("doc_id", *[f"p_{c}" for c in CATEGORIES], is_toxic(chain).alias("toxic"))
