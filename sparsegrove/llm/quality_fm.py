"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct lower-cased words, hashed, weighted by the roots of their counts and
scaled to length 1, and one-hot bins of its structure (shares of capitals, symbols, pipes, repeats and so on)
and metadata that the text itself gives (length, lines, share of non-ASCII bytes).  The machine's score

    bias + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

takes time linear in the features.  It is trained on the driver with Adagrad on a sample of at most
``TRAIN_ROWS`` labelled rows of each class, drawn by hash, whose weights restore the classes' shares.

Labels, language, source and id never enter a score.  Null and empty texts score by their bins alone.  With
labels of one class only, or none, every score is that class's share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch, blocks, lowered, need, on_workers, per_text, raw
from .quality_rules import RULES, statistics
from .toxicity import training_rows

TRAIN_ROWS = 2500
#: Bytes of text whose features are taken at once while learning.
TRAIN_BLOCK = 1 << 18
WORD_BITS = 15
FACTORS = 8
BINS = 12
#: Ends of the bins of a share in thousandths.
SHARE_ENDS = np.array([1, 10, 30, 60, 100, 170, 250, 350, 500, 700, 900])

SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Feature ids, values and documents (flat) of a block of texts, and the number of texts."""
    n_docs = len(offsets) - 1
    words = Words(lowered(data), offsets)
    bucket = (words.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique((words.doc.astype(np.int64) << WORD_BITS) | bucket, return_counts=True)
    doc, index, value = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1), np.sqrt(count)
    length = np.sqrt(np.bincount(doc, weights=value * value, minlength=n_docs))
    value = value / np.maximum(length[doc], 1e-12)
    found = statistics(data, offsets)
    size = np.diff(offsets)
    n = found["n_words"]
    stats = [np.searchsorted(SHARE_ENDS, found[r], side="right") for r in RULES]
    stats += [np.searchsorted(SHARE_ENDS, 1000 * per_text(f, offsets) // np.maximum(size, 1), side="right") for f in ((data - 48) < 10, data >= 128, data == 10)]
    stats += [np.minimum(np.log2(n + 1).astype(np.int64), BINS - 1), np.minimum(found["word_chars"] // np.maximum(n, 1), BINS - 1), np.minimum(np.log2(per_text(data == 10, offsets) + 1).astype(np.int64), BINS - 1)]
    own = np.stack([(1 << WORD_BITS) + k * BINS + s for k, s in enumerate(stats)], axis=1)
    k = own.shape[1]
    all_docs = np.concatenate([doc, np.repeat(np.arange(n_docs), k)])
    return np.concatenate([index, own.ravel()]), np.concatenate([value, np.full(n_docs * k, 1.0)]), all_docs, n_docs


SIZE = (1 << WORD_BITS) + (len(RULES) + 6) * BINS


class Machine:
    """bias; w: (features,); v: (features, factors)."""

    def __init__(self, seed: int = 0, factors: int = FACTORS):
        self.bias = 0.0
        self.w = np.zeros(SIZE)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (SIZE, factors))
        self.share: float | None = None

    def raw_scores(self, index: np.ndarray, value: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic curve, and the sums over v (documents, factors)."""
        out = self.bias + np.bincount(doc, weights=self.w[index] * value, minlength=n_docs)
        sums = np.empty((n_docs, self.v.shape[1]))
        for f in range(self.v.shape[1]):
            x = self.v[index, f] * value
            sums[:, f] = np.bincount(doc, weights=x, minlength=n_docs)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(doc, weights=x * x, minlength=n_docs))
        return out, sums

    def scores(self, *block) -> np.ndarray:
        if self.share is not None:
            return np.full(block[3], self.share)
        return 1 / (1 + np.exp(-np.clip(self.raw_scores(*block)[0], -40, 40)))

    def fit(self, index: np.ndarray, value: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 2e-4, size: int = 128, seed: int = 0) -> Machine:
        first = np.searchsorted(doc, np.arange(len(label) + 1))
        random = np.random.default_rng(seed)
        gw, gv, gb = np.full(SIZE, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        share = float(np.average(label, weights=weight))
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            for rows in np.array_split(random.permutation(len(label)), max(1, len(label) // size)):
                sizes = first[rows + 1] - first[rows]
                at = np.repeat(first[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                d, i, x = np.repeat(np.arange(len(rows)), sizes), index[at], value[at]
                out, sums = self.raw_scores(i, x, d, len(rows))
                over = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - label[rows]) * weight[rows] / len(rows)
                each = over[d] * x
                used, where = np.unique(i, return_inverse=True)
                g = np.bincount(where, weights=each) + decay * self.w[used]
                gw[used] += g * g
                self.w[used] -= rate * g / np.sqrt(gw[used])
                for f in range(self.v.shape[1]):
                    own = self.v[i, f]
                    g = np.bincount(where, weights=each * (sums[d, f] - own * x)) + decay * self.v[used, f]
                    gv[used, f] += g * g
                    self.v[used, f] -= rate * g / np.sqrt(gv[used, f])
                b = float(over.sum())
                gb += b * b
                self.bias -= rate * b / gb**0.5
        return self


def learn(texts: pa.Array, label: np.ndarray, shares: dict[int, int] | None = None, seed: int = 0) -> Machine:
    """A machine from texts and labels; ``shares``: how many rows of each label the sample stands for."""
    out = Machine(seed)
    if not len(label) or label.min() == label.max():
        out.share = float(label.mean()) if len(label) else 0.5
        return out
    parts, base = [], 0
    for lo, hi in blocks(texts, TRAIN_BLOCK):  # small blocks and short integers: the driver holds them
        i, x, d, n = features(*raw(texts.slice(lo, hi - lo)))
        order = np.argsort(d, kind="stable")
        parts.append((i[order].astype(np.int32), x[order], (d[order] + base).astype(np.int32)))
        base += n
    index, value, doc = (np.concatenate(x) for x in zip(*parts))
    del parts
    counts = {v: max(int((label == v).sum()), 1) for v in (0, 1)}
    stands = shares or counts
    weight = np.where(label == 1, stands[1] / counts[1], stands[0] / counts[0])
    out.fit(index, value, doc, label.astype(float), weight / weight.mean(), seed=seed)
    out.w, out.v = out.w.astype(np.float32), out.v.astype(np.float32)
    return out


def fit(documents: DataFrame, labels: DataFrame, keep=None) -> Machine:
    keep = F.lit(True) if keep is None else keep
    rows = training_rows(documents, labels, "quality", keep, {0: TRAIN_ROWS, 1: TRAIN_ROWS})
    if not rows.num_rows:
        return learn(pa.array([], pa.string()), np.zeros(0))
    all_rows = {x["quality"]: x["n"] for x in need(labels, doc_id="long", quality="int").where(keep).where("quality IN (0, 1)").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    return learn(rows["text"].combine_chunks(), rows["quality"].to_numpy(), {v: all_rows.get(v, 1) for v in (0, 1)})


def score_batches(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in blocks(b.column(1)):
            scores = machine.scores(*features(*raw(b.column(1).slice(lo, hi - lo))))
            yield batch(SCHEMA, b.column(0).slice(lo, hi - lo), scores)


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every whole text; no shuffle."""
    return need(documents, doc_id="long", text="string").mapInArrow(on_workers(__name__, "score_batches", machine), "doc_id long, score double")


def filter_batches(batches: Iterator[pa.RecordBatch], machine: Machine, column: int, cutoff: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column(column)
        for lo, hi in blocks(text):
            keep = machine.scores(*features(*raw(text.slice(lo, hi - lo)))) >= cutoff
            yield b.slice(lo, hi - lo).filter(pa.array(keep))


def keep_good(documents: DataFrame, machine: Machine, cutoff: float) -> DataFrame:
    """The rows of ``documents`` that score ``cutoff`` or more, with all their columns; no shuffle."""
    return documents.mapInArrow(on_workers(__name__, "filter_batches", machine, documents.columns.index("text"), cutoff), documents.schema)
