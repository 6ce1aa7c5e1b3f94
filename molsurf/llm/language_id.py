"""Language of words and texts by a linear-chain conditional random field.

Words are lower-cased runs of letters. A word's emission scores sum the learned
weights of its character 2- to 4-grams with word bounds (those that hold a bound
are its affixes), and of its entry in a lexicon of the training words. Learned
transitions join neighbouring words; forward-backward gives each word's
marginals, so code-switched texts get labels word by word. A text's language
is that of the largest mean marginal.

A chain is a whole text. Forward-backward runs over pieces of ``PIECE`` words side
by side and is exact all the same: the product of a piece's step matrices carries
the messages across it, so each piece starts from what the pieces before and
after it say. Of a long text, only messages between its pieces are held.

Training reads a bounded sample, whole texts of it: about ``PER_LANG`` texts of
each language, at most, those of least hash, and of them as many as ``SAMPLE_BYTES``
characters hold; one task of an executor fits the model. Half of the training chains are
spliced, in turn, from segments of two texts, which is where transitions between
languages are learned. The lexicon has the words that the sample repeats.

A null text, and one without letters, is ``und`` with score 0. With nothing to
learn from, every text is ``und``. Repeated rows are labelled alike; rows without
doc_id are labelled, not held out, and so may be learned from. All columns stay but ``lang_pred`` and
``score``, which are the result's own.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitted, released, table

PER_LANG, PIECE, STEPS, SEGMENTS = 500, 64, 40, 4
#: Characters of a language's training texts; the text that passes it is the last.
SAMPLE_BYTES = 1 << 23
#: Pieces that are worked on at a time.
ABREAST = 2048
ORDERS, BUCKETS = (2, 3, 4), 1 << 16
#: ASCII other than letters separates words.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words whose scores a worker keeps at a time; words of a batch scored together.
KEPT, TOGETHER = 150_000, 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode(errors="replace").translate(LETTERS).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of the words, bounds included."""
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    space = b == 32
    own = np.cumsum(space) - 1
    ends = np.append(np.flatnonzero(space)[1:], len(b))[own]
    owner, bucket = [], []
    for k, n in enumerate(ORDERS):
        h = np.zeros(max(0, len(b) - n + 1), np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + b[j : len(b) - n + 1 + j] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        ok = np.arange(len(h)) + n - 1 <= ends[: len(h)]
        owner.append(own[: len(h)][ok])
        bucket.append(((h[ok] >> np.uint64(48)) + np.uint64(k * BUCKETS)).astype(np.int64))
    return np.concatenate(owner), np.concatenate(bucket)


class Crf:
    def __init__(self, labels: list[str], lexicon: dict[bytes, int]):
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((len(ORDERS) * BUCKETS + len(lexicon), len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)), np.float32)

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        owner, bucket = grams(words)
        known = [(i, k) for i, w in enumerate(words) if (k := self.lexicon.get(w)) is not None]
        a = np.array(known, np.int64).reshape(-1, 2)
        return np.concatenate((owner, a[:, 0])), np.concatenate((bucket, a[:, 1] + len(ORDERS) * BUCKETS))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        owner, feature = self.features(words)
        return np.stack([np.bincount(owner, self.weights[feature, k], len(words)) for k in range(len(self.labels))], 1).astype(np.float32)

    def sweep(self, scores: np.ndarray, code: np.ndarray, sizes: np.ndarray, pairs: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Exact forward-backward over chains of the given sizes, whose words end to end are the rows code of scores.

        Yields (positions among the words, marginals there, sum of the marginals of neighbouring pairs or None), a part of the words at a time.
        """
        t = np.exp(self.moves.astype(np.float64)).astype(np.float32)
        n_labels = t.shape[0]
        pieces = -(-sizes // PIECE)
        ends = np.cumsum(pieces)
        chain = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(chain)) - (ends - pieces)[chain]
        first = (np.cumsum(sizes) - sizes)[chain] + nth * PIECE
        length = np.minimum(PIECE, sizes[chain] - nth * PIECE)
        groups = []
        for lo, hi in ((1, 16), (17, 48), (49, PIECE)):  # padding costs, so pieces of like length go together
            own = np.flatnonzero((length >= lo) & (length <= hi))
            groups += [(own[i : i + ABREAST], hi) for i in range(0, len(own), ABREAST)]

        def potentials(own: np.ndarray, hi: int) -> tuple[np.ndarray, np.ndarray]:
            at = first[own, None] + np.arange(hi)
            there = np.arange(hi) < length[own, None]
            e = scores[code[np.where(there, at, 0)]]
            return np.exp(e - e.max(2, keepdims=True)), there

        across = np.empty((len(chain), n_labels, n_labels), np.float32)
        several = pieces[chain] > 1
        for own, hi in groups:
            own = own[several[own]]
            if not len(own):
                continue
            p, there = potentials(own, hi)
            m = np.tile(np.eye(n_labels, dtype=np.float32), (len(own), 1, 1))
            start = nth[own] == 0
            for k in range(p.shape[1]):
                new = (m.reshape(-1, n_labels) @ t).reshape(m.shape) * p[:, k, None, :]
                if k == 0:
                    new[start] = p[start, 0, None, :]  # a chain's first word follows nothing
                new /= new.max((1, 2), keepdims=True)
                m = new if there[:, k].all() else np.where(there[:, k, None, None], new, m)
            across[own] = m
        enter = np.ones((len(chain), n_labels), np.float32)  # before each piece, from the left
        leave = np.ones((len(chain), n_labels), np.float32)  # after each piece, from the right
        begin = ends - pieces
        order = np.argsort(-pieces, kind="stable")
        many = pieces[order]
        for j in range(1, int(pieces.max(initial=0))):
            live = order[: np.searchsorted(-many, -j, side="left")]  # chains of more than j pieces
            k = begin[live] + j
            v = np.einsum("ni,nij->nj", enter[k - 1], across[k - 1])
            enter[k] = v / v.sum(1, keepdims=True)
            k = ends[live] - j
            v = np.einsum("nij,nj->ni", across[k], leave[k])
            leave[k - 1] = v / v.sum(1, keepdims=True)
        for own, hi in groups:
            p, there = potentials(own, hi)
            fwd, bwd = np.empty_like(p), np.empty_like(p)
            start = nth[own] == 0
            a = enter[own]
            for k in range(p.shape[1]):
                a = (a @ t) * p[:, k]
                if k == 0:
                    a[start] = p[start, 0]
                a /= a.sum(1, keepdims=True)
                fwd[:, k] = a
            b = leave[own]
            for k in range(p.shape[1] - 1, -1, -1):
                bwd[:, k] = b
                new = (b * p[:, k]) @ t.T
                new /= new.sum(1, keepdims=True)
                b = np.where(there[:, k, None], new, b)
            m = fwd * bwd
            m /= m.sum(2, keepdims=True)
            x = None
            if pairs:
                before = np.concatenate((enter[own, None], fwd[:, :-1]), 1)
                after = p * bwd
                z = ((before @ t) * after).sum(2)
                valid = there.copy()
                valid[start, 0] = False
                x = t * np.einsum("pki,pkj->ij", before * np.where(valid, 1 / z, 0)[..., None], after)
            yield (first[own, None] + np.arange(hi))[there], m[there], x

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """[word, label] of one text."""
        out = np.empty((len(words), len(self.labels)))
        if words:
            for at, m, _ in self.sweep(self.emissions(words), np.arange(len(words)), np.array([len(words)])):
                out[at] = m
        return out

    def fit(self, chains: list[list[bytes]], gold: list[np.ndarray], steps: int = STEPS) -> Crf:
        """Full-batch Adam on the conditional likelihood of whole chains."""
        number: dict[bytes, int] = {}
        code = np.array([number.setdefault(w, len(number)) for c in chains for w in c], np.int64)
        sizes = np.array([len(c) for c in chains], np.int64)
        y = np.concatenate(gold)
        n_labels, rows = len(self.labels), len(self.weights)
        owner, feature = self.features(list(number))
        want = np.bincount(code * n_labels + y, minlength=len(number) * n_labels).reshape(-1, n_labels)
        inner = np.ones(len(y), bool)
        inner[np.cumsum(sizes) - sizes] = False
        want_moves = np.zeros_like(self.moves)
        np.add.at(want_moves, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
        state = [np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros_like(self.moves), np.zeros_like(self.moves)]
        for step in range(1, steps + 1):
            by_word = np.stack([np.bincount(owner, self.weights[feature, k], len(number)) for k in range(n_labels)], 1).astype(np.float32)
            have, moved = np.zeros((len(number), n_labels)), np.zeros((n_labels, n_labels))
            for at, m, x in self.sweep(by_word, code, sizes, pairs=True):
                have += np.stack([np.bincount(code[at], m[:, k], len(number)) for k in range(n_labels)], 1)
                moved += x
            off = have - want
            g = np.stack([np.bincount(feature, off[owner, k], rows) for k in range(n_labels)], 1) / len(y) + 1e-6 * self.weights
            gm = (moved - want_moves) / len(y) + 1e-4 * self.moves
            for param, grad, (v, s) in ((self.weights, g, state[:2]), (self.moves, gm, state[2:])):
                v += 0.1 * (grad - v)
                s += 0.01 * (grad * grad - s)
                param -= (0.05 * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-10)).astype(np.float32)
        return self


def spliced(a: list[bytes], b: list[bytes], y: int, z: int, rng: np.random.Generator) -> tuple[list[bytes], np.ndarray]:
    """Segments of both texts in turn, every word once."""
    n = int(rng.integers(1, SEGMENTS + 1))
    words, gold = [], []
    for k in range(n):
        for own, label in ((a, y), (b, z)):
            part = own[len(own) * k // n : len(own) * (k + 1) // n]
            words += part
            gold += [label] * len(part)
    return words, np.array(gold, np.int64)


def sample_of(docs: DataFrame, per_lang: int) -> DataFrame | None:
    """(lang, text, h, doc_id): at least per_lang texts of least hash of each language, or all it has, and not many more."""
    known = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per label of the model
    if not counts:
        return None
    # some more than needed, by the hash's share, so no language is ordered as a whole
    rates = docs.sparkSession.createDataFrame([(lang, 1.5 * per_lang / n + 1e-9 if n > 2 * per_lang else 2.0) for lang, n in counts.items()], "_lang string, _rate double")
    hashed = known.select("lang", "text", F.xxhash64("doc_id").alias("h"), "doc_id")
    some = hashed.join(F.broadcast(rates), F.col("lang") == F.col("_lang")).where(F.col("h") / 2.0**64 + 0.5 < F.col("_rate")).drop("_lang", "_rate")
    some = some.orderBy("h", "doc_id", "text").limit(2 * per_lang * len(counts))  # whatever ids repeat
    got = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    for lang, n in counts.items():
        if got.get(lang, 0) < min(n, per_lang):  # ids that repeat share their hash, so all or none of them were taken
            least = hashed.where(F.col("lang") == lang).orderBy("h", "doc_id", "text").limit(per_lang)
            some = some.where(F.col("lang") != lang).unionByName(least)
    return some


ORDER = ["lang", "h", "doc_id", "text"]


def gathered(rows: Iterator[tuple[str, str]], per_lang: int, most: int = SAMPLE_BYTES) -> dict[str, list[list[bytes]]]:
    """The words of the first per_lang texts of each language, up to about ``most`` bytes of them, from (lang, text) in order."""
    texts: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for lang, text in rows:
        own = texts.setdefault(lang, [])
        if len(own) < per_lang and held.get(lang, 0) < most:
            own.append(text)
            held[lang] = held.get(lang, 0) + len(text)
    out = {lang: [w for t in own if (w := words_of(t))] for lang, own in texts.items()}
    return {lang: own for lang, own in sorted(out.items()) if own}


def sampled(docs: DataFrame, per_lang: int) -> dict[str, list[list[bytes]]]:
    """What training would read, here."""
    rows = sample_of(docs, per_lang)
    return gathered(((r["lang"], r["text"]) for r in rows.orderBy(*ORDER).toLocalIterator()), per_lang) if rows is not None else {}


def fit_sample(sample: dict[str, list[list[bytes]]]) -> Crf:
    labels = list(sample)
    counts = Counter(w for own in sample.values() for t in own for w in t)
    model = Crf(labels, {w: k for k, w in enumerate(sorted(w for w, n in counts.items() if n > 1))})
    rng = np.random.default_rng(7)
    data = [(k, words) for k, lang in enumerate(labels) for words in sample[lang]]
    data = [data[k] for k in rng.permutation(len(data))]
    chains, gold = [], []
    third = len(data) // 3  # a third of the texts stand alone; two thirds go in pairs, so chains are half and half
    for k, words in data[:third]:
        chains.append(words)
        gold.append(np.full(len(words), k))
    rest = data[third:]
    for (k, words), (j, other) in zip(rest[::2], rest[1::2]):
        c, y = spliced(words, other, k, j, rng)
        chains.append(c)
        gold.append(y)
    if len(rest) % 2:
        chains.append(rest[-1][1])
        gold.append(np.full(len(rest[-1][1]), rest[-1][0]))
    return model.fit(chains, gold)


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Crf | None:
    """Fit on a bounded sample of (doc_id, text, lang), on an executor."""
    rows = sample_of(docs, per_lang)

    def fit(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        sample = gathered((pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), per_lang)
        if not sample:
            return None
        m = fit_sample(sample)
        return pickle.dumps((m.labels, list(m.lexicon), m.weights, m.moves))

    model = rows is not None and fitted(rows.select("lang", "text", "h", "doc_id"), ORDER, fit)
    if not model:
        return None
    labels, words, weights, moves = pickle.loads(model)
    out = Crf(labels, {w: k for k, w in enumerate(words)})
    out.weights, out.moves = weights, moves
    return out


class Labeller:
    """A worker's view of the model: scores of known words are kept."""

    def __init__(self, model: Crf):
        self.model = model
        self.place: dict[bytes, int] = {}
        self.scores = np.empty((0, len(model.labels)), np.float32)

    def codes(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.place)
        if len(self.place) + len(new) > KEPT:
            self.place, self.scores, new = {}, self.scores[:0], set(words)
        if new:
            new = list(new)
            self.place.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate((self.scores, self.model.emissions(new)))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def means(self, texts: list[list[bytes]]) -> np.ndarray:
        """[text, label]: mean marginals over all words of each text with words."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        code = self.codes([w for t in texts for w in t])
        text = np.repeat(np.arange(len(texts)), sizes)
        out = np.zeros((len(texts), self.scores.shape[1]))
        for at, m, _ in self.model.sweep(self.scores, code, sizes):
            out += np.stack([np.bincount(text[at], m[:, k], len(texts)) for k in range(m.shape[1])], 1)
        return out / sizes[:, None]


def has_letter(words: list[bytes]) -> bool:
    return any(w[0] < 128 for w in words) or any(any(map(str.isalpha, w.decode(errors="replace"))) for w in words)


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """All columns of docs, then lang_pred and score."""
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name not in ("lang_pred", "score")]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", lang_pred string, score double"
    names = [n for n, _ in fields] + ["lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model and Labeller(model)
        for b in batches:
            texts = b.column(b.schema.names.index("text"))
            lang, score = ["und"] * b.num_rows, [0.0] * b.num_rows

            def flush(held: list[tuple[int, list[bytes]]]) -> None:
                if held:
                    m = own.means([w for _, w in held])
                    for (i, _), k, s in zip(held, m.argmax(1).tolist(), m.max(1).tolist()):
                        lang[i], score[i] = own.model.labels[k], min(1.0, max(0.0, s))

            held, n = [], 0
            for i, t in enumerate(texts if own else ()):
                w = words_of(t.as_py())
                if w and has_letter(w):
                    held.append((i, w))
                    n += len(w)
                if n >= TOGETHER:
                    flush(held)
                    held, n = [], 0
            flush(held)
            cols = [b.column(b.schema.names.index(x)) for x, _ in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    return docs.select(*[n for n, _ in fields]).mapInArrow(lambda batches: released(run(batches)), schema)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


#: Texts below this score are in no learned language.
LEAST_SCORE = 0.35


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    held_out = is_held_out(F.col("doc_id"))
    out = predict(docs.drop("lang"), train(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
