"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its different words, trimmed of punctuation, and their beginnings of four and
five letters, so inflected forms meet. Each is hashed to one of ``BUCKETS`` features. The machine adds
a weight per term and, through a short factor vector per term, a weight for every pair of terms, so
two words can say together what neither says alone. The pairwise part is divided by the number of
terms. A logistic curve on texts that were kept aside turns the sum into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import arrow_batch, blobs, fit_logistic, id_remainder, sigmoid
from logsift.llm.compression_quality import labelled_sample, score, texts_of

BUCKETS = 1 << 18
FACTORS = 4
PREFIXES = (4, 5)
#: Bound of the training sample: texts per class.
TEXTS = 20_000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.1, 3e-3
HELD_OUT = (5, 0)
THRESHOLD = 0.5
PUNCTUATION = b".,;:!?\"'()[]{}*#&%$-_"
MEMO = 300_000  # words whose terms a task remembers


class Terms:
    """Hashed terms of texts, with a memory of bounded size for words seen before."""

    def __init__(self):
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def _of_word(self, word: bytes) -> tuple[int, ...]:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        bare = word.strip(PUNCTUATION)
        letters = bare.decode("utf-8", "ignore")
        found = [xxhash.xxh64_intdigest(bare) % BUCKETS] if bare else []
        for n in PREFIXES:
            if len(letters) > n:
                found.append(xxhash.xxh64_intdigest(letters[:n].encode(), n) % BUCKETS)
        self.memo[word] = terms = tuple(found)
        return terms

    def of(self, text: bytes) -> np.ndarray:
        found: set[int] = set()
        memo = self.memo
        for word in set(text.lower().split()):
            found.update(memo.get(word) or self._of_word(word))
        return np.fromiter(found, dtype=np.int32, count=len(found))


@dataclass
class FactorizationMachine:
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, FACTORS), np.float32))
    slope: float = 1.0
    intercept: float = 0.0

    def raw(self, terms: np.ndarray) -> float:
        if not len(terms):
            return self.bias
        own = self.factors[terms]
        total = own.sum(axis=0)
        pairs = 0.5 * float((total * total).sum() - (own * own).sum()) / len(terms)
        return self.bias + float(self.weights[terms].sum()) + pairs

    def score(self, text: bytes) -> float:
        if not hasattr(self, "terms"):
            self.terms = Terms()
        return sigmoid(self.slope * self.raw(self.terms.of(text)) + self.intercept)


def fit(terms: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> FactorizationMachine:
    """Adagrad on the logistic loss in small batches."""
    rng = np.random.default_rng(seed)
    model = FactorizationMachine()
    w = model.weights
    v = model.factors
    v += (rng.standard_normal(v.shape) * 0.01).astype(np.float32)
    w_seen = np.full(BUCKETS, 1e-6, np.float32)
    v_seen = np.full(v.shape, 1e-6, np.float32)
    ones = float(labels.sum())
    model.bias = float(np.log((ones + 1) / (len(labels) - ones + 1)))
    full = np.array([i for i, t in enumerate(terms) if len(t)], dtype=np.int64)
    for _ in range(EPOCHS):
        rng.shuffle(full)
        for at in range(0, len(full), BATCH):
            ids = full[at : at + BATCH]
            sizes = np.array([len(terms[i]) for i in ids])
            flat = np.concatenate([terms[i] for i in ids])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            text = np.repeat(np.arange(len(ids)), sizes)
            own = v[flat]
            total = np.add.reduceat(own, starts, axis=0)
            square = np.add.reduceat(own * own, starts, axis=0)
            z = model.bias + np.add.reduceat(w[flat], starts)
            z = z + 0.5 * (total * total - square).sum(axis=1) / sizes
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[ids]).astype(np.float32)
            used, place = np.unique(flat, return_inverse=True)
            step = np.bincount(place, error[text], len(used)) / len(ids) + DECAY * w[used]
            w_seen[used] += (step * step).astype(np.float32)
            w[used] -= (RATE * step / np.sqrt(w_seen[used])).astype(np.float32)
            pull = (error / sizes)[text][:, None] * (total[text] - own)
            for j in range(FACTORS):
                step = np.bincount(place, pull[:, j], len(used)) / len(ids) + DECAY * v[used, j]
                v_seen[used, j] += (step * step).astype(np.float32)
                v[used, j] -= (RATE * step / np.sqrt(v_seen[used, j])).astype(np.float32)
            model.bias -= 0.02 * float(error.mean())
    return model


def _shuffled(rows: pa.Table) -> list[int]:
    """An order by hash of the rows that does not depend on how Spark delivered them."""
    keys = [
        (xxhash.xxh64_intdigest(i), i, xxhash.xxh64_intdigest(t.as_buffer()))
        for i, t in zip(rows.column("id").to_pylist(), rows.column("terms"), strict=True)
    ]
    return sorted(range(len(keys)), key=keys.__getitem__)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out: tuple[int, int] = HELD_OUT,
) -> FactorizationMachine:
    """A machine fitted on a bounded sample of labelled rows that are not held out.

    The sample is the first ``TEXTS`` ids per class by hash; tasks turn its texts into hashed terms
    and only those reach the driver. A fifth of the sample fits the curve. Without labelled rows
    every score is 1/2; with one class only it is that class's smoothed share.
    """
    usable = id_remainder(F.col(id_col), held_out[0]) != held_out[1]
    sample = labelled_sample(labels, id_col, label_col, usable, TEXTS)
    schema = pa.schema([("id", pa.string()), ("label", pa.int32()), ("terms", pa.binary())])

    def hashed(batches):
        terms = Terms()
        for batch in batches:
            found = [np.sort(terms.of(text)).astype("<i4").tobytes() for text in blobs(batch.column(2))]
            yield arrow_batch(schema, id=batch.column(0), label=batch.column(1), terms=found)

    texts = texts_of(docs, sample, id_col, text_col)
    texts = texts.select(F.col("__id").cast("string"), F.col("label").cast("int"), "text")
    rows = texts.mapInArrow(hashed, "id string, label int, terms binary").toArrow()
    rows = rows.take(pa.array(_shuffled(rows), pa.int64()))
    y = rows.column("label").to_numpy().astype(float)
    x = [np.frombuffer(t.as_buffer(), dtype="<i4") for t in rows.column("terms")]
    if not len(y) or not 0 < y.sum() < len(y):
        return FactorizationMachine(slope=0.0, intercept=fit_logistic(np.zeros(len(y)), y)[1])
    aside = np.arange(len(y)) % 5 == 0
    model = fit([t for t, a in zip(x, aside, strict=True) if not a], y[~aside])
    raw = np.array([model.raw(t) for t, a in zip(x, aside, strict=True) if a])
    model.slope, model.intercept = fit_logistic(raw, y[aside])
    shares = labels.filter(usable & F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()
    count = {r[label_col]: r["count"] for r in shares}
    if model.slope and count.get(0) and count.get(1):
        # the sample holds the classes in other shares than the labelled rows do
        own = y[aside].sum()
        model.intercept += float(np.log(count[1] / count[0]) - np.log(own / (len(y[aside]) - own)))
    return model


__all__ = ["FactorizationMachine", "Terms", "fit", "score", "train"]
