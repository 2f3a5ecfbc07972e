"""Toxic spans by a linear-chain CRF; marginals add up to a document's score.

Training, on the driver, from a bounded sample of labelled documents (``TOXIC_ROWS`` toxic and ``CLEAN_ROWS``
others, those with the smallest hashes of their ids):

1. Labelled tokens: a token of a toxic document is toxic if its word, or a prefix of it, occurs in several
   toxic documents of the sample and (almost) never in the others; all other tokens are not.
2. The chain learns from windows around toxic tokens and from windows of clean documents.  Features are the
   hashed lower-cased word, its prefixes, suffix and shape.
3. A logistic curve over the strongest marginal and the sum of the strong ones is fitted on the documents.

Decoding: marginals by forward and backward messages, of all tokens of a block at once.  With two labels a message
is one number, the log odds, and passing it on shrinks any difference between two messages by a factor below 1
that the transitions give.  So every message starts from nought and is passed on until what the start may have
left is below ``TOLERANCE`` (or through the longest text, which is the plain recursion): marginals are those of
the whole chain but for that.  The score of a document grows with its marginals; the spans are the runs of tokens
more likely toxic than not, in code points.

Labels, language, source and id never enter a score.  Null and empty texts get the score of a document
without any suspicious token.  Without a toxic (or clean) label the score is the sample's share of toxic rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Words, batch, blocks, lowered, mix, need, on_workers, prefix_hashes, range_hashes, raw, shared_checkpoint
from .crf import Chain

TOXIC_ROWS, CLEAN_ROWS = 1500, 2500
#: Of the sample: windows around at most so many toxic tokens, and around as many others or three times the toxic ones.
TOXIC_TOKENS = 4000
#: Bytes of text that a sample of labelled rows holds at most; by rising hash, rows that no longer fit go.
SAMPLE_BYTES = 32 << 20
#: Bytes of the longest text that trains.
TEXT_BYTES = 1 << 19
BITS = 18
PREFIXES = (3, 4, 5, 6)
#: Marginals below it count as it.
LEAST = 1e-4
#: Of log odds: what an unfinished message may be off by.
TOLERANCE = 1e-5
WINDOW = 5
#: Words whose emissions a Python worker remembers (about 40 bytes each).
REMEMBERED = 1_000_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_spans", pa.int32()), ("spans", pa.string())])
COLUMNS = "doc_id long, score double, n_spans int, spans string"


class Tokens:
    """Words without the signs around them, and their hashed features (tokens, kinds)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.words = data, Words(data, offsets)
        start, end = self.words.start.copy(), self.words.end.copy()
        letter = np.ones(256, np.bool_)
        letter[:48] = letter[58:65] = letter[91:97] = letter[123:128] = False
        solid = letter[data]
        if len(start):
            # the first and the last solid byte of each word; a word without one stays its last or first byte
            at = np.flatnonzero(solid)
            ahead = np.append(at, len(data))[np.searchsorted(at, start)]
            start = np.minimum(ahead, end - 1)
            behind = np.append(-1, at)[np.searchsorted(at, end)]
            end = np.maximum(behind, start) + 1
        self.start, self.end, self.doc = start, end, self.words.doc

    def names(self, rows=slice(None), only: int | None = None) -> Iterator[np.ndarray]:
        """64-bit names of the word, its prefixes (0 if it is no longer than that), suffix and shape, one kind at a time.

        only: the word (0) or a prefix (1 and on), alone.
        """
        low = lowered(self.data)
        sums = prefix_hashes(low)
        start, end = self.start[rows], self.end[rows]
        if not only:
            yield range_hashes(low, start, end, sums)
        for kind, n in enumerate(PREFIXES, 1):
            if only not in (None, kind):
                continue
            longer = end - start > n
            yield np.where(longer, mix(range_hashes(low, start, np.minimum(start + n, end), sums), n), np.uint64(0))
        if only is not None:
            return
        yield mix(range_hashes(low, np.maximum(start, end - 4), end, sums), 99)
        del low, sums
        upper = np.concatenate([[0], np.cumsum((self.data - 65) < 26, dtype=np.int32)])
        digit = np.concatenate([[0], np.cumsum((self.data - 48) < 10, dtype=np.int32)])
        caps, digits, size = upper[end] - upper[start], digit[end] - digit[start], end - start
        shape = np.minimum(size, 9) * 8 + np.where(caps == 0, 0, np.where(caps == size, 2, 1)) * 2 + (digits > 0)
        yield mix(shape.astype(np.uint64), 101)

    def features(self, rows=slice(None)) -> np.ndarray:
        return np.stack([(mix(x, k) >> np.uint64(64 - BITS)).astype(np.int32) for k, x in enumerate(self.names(rows))], axis=1)

    def own(self) -> np.ndarray:
        """A name of the word as it is written, which settles all its features."""
        out = range_hashes(self.data, self.start, self.end)
        return np.where(out == 0, np.uint64(1), out)


class Toxicity:
    """A fitted model: chain, logistic curve, and the score where there was nothing to learn from."""

    def __init__(self, chain: Chain | None, curve: tuple[float, float, float], share: float):
        self.chain, self.curve, self.share = chain, curve, share
        self.memo: Memo | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def emissions(self, tokens: Tokens) -> np.ndarray:
        """Each distinct word's emissions are summed once and remembered (up to ``REMEMBERED`` words)."""
        if self.memo is None or self.memo.used > REMEMBERED:
            self.memo, self.known = Memo(), np.zeros((1 << 15, 2), np.float32)
        names = tokens.own()
        entry = self.memo.find(names)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, first = np.unique(names[missing], return_index=True)
            found = self.chain.emissions(tokens.features(missing[first]))
            at = self.memo.add(new)
            while self.memo.used > len(self.known):
                self.known = np.concatenate([self.known, self.known])
            self.known[at] = found
            entry[missing] = self.memo.find(names[missing])
        return self.known[entry]

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Of each token the chance of being toxic, given its whole text."""
        if self.chain is None or not len(tokens.start):
            return np.zeros(len(tokens.start))
        emit, chain, first = self.emissions(tokens), self.chain, tokens.words.first
        odds = (emit[:, 1] - emit[:, 0]).astype(np.float32)
        opens = first[:-1][np.diff(first) > 0]
        closes = first[1:][np.diff(first) > 0] - 1
        longest = int(tokens.words.counts.max())
        forth = self.messages(odds, chain.step, opens, chain.begin[1] - chain.begin[0], longest)
        back = self.messages(odds[::-1], chain.step.T, len(odds) - 1 - closes, chain.end[1] - chain.end[0], longest)[::-1]
        return 1 / (1 + np.exp(-(odds + forth + back).astype(np.float64)))

    @staticmethod
    def messages(odds: np.ndarray, step: np.ndarray, opens: np.ndarray, begin: float, longest: int) -> np.ndarray:
        """The log odds that each token gets from the tokens before it."""
        turn = abs(float(step[0, 0] + step[1, 1] - step[0, 1] - step[1, 0]))  # how far apart two messages can be
        shrink = float(np.tanh(turn / 4))
        rounds = longest if shrink >= 1 else int(np.ceil(np.log(TOLERANCE / max(turn, TOLERANCE)) / np.log(max(shrink, 1e-9)))) + 1
        low = float(step[0, 1] - step[0, 0])
        # with f the odds of the last token: log((s01 + s11 f) / (s00 + s10 f))
        up, down = np.float32(step[1, 1] - step[0, 1]), np.float32(step[1, 0] - step[0, 0])
        out = np.zeros(len(odds), np.float32)
        out[opens] = begin
        for _ in range(min(rounds, longest)):
            f = odds + out
            new = np.float32(low) + np.logaddexp(np.float32(0), f + up) - np.logaddexp(np.float32(0), f + down)
            out[1:] = new[:-1]
            out[opens] = begin
        return out

    def summary(self, p: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each document the strongest marginal (as a clipped logit) and the log of the sum of the strong ones."""
        top = np.full(n_docs, LEAST)
        np.maximum.at(top, doc, np.clip(p, LEAST, 1 - LEAST))
        strong = np.bincount(doc, weights=p * (p > 0.5), minlength=n_docs)
        return np.log(top / (1 - top)), np.log1p(strong)

    def scores(self, p: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        if self.chain is None:
            return np.full(n_docs, self.share)
        a, b, c = self.curve
        x, y = self.summary(p, doc, n_docs)
        return 1 / (1 + np.exp(-(a + b * x + c * y)))


def mined(parts: list[Tokens], doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens of the parts count as toxic, from documents' labels: by word or prefix.  doc: each token's document."""
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    out = np.zeros(len(doc), np.bool_)
    for kind in range(len(PREFIXES) + 1):
        if kind and PREFIXES[kind - 1] < 4:
            continue
        names = np.concatenate([next(t.names(only=kind)) for t in parts])
        order = np.lexsort((doc, names))
        n, d = names[order], doc[order]
        one = np.ones(len(n), np.bool_)
        one[1:] = (n[1:] != n[:-1]) | (d[1:] != d[:-1])  # a document counts once for a name
        starts = np.flatnonzero(np.append(True, n[1:] != n[:-1])) if len(n) else np.zeros(0, np.int64)
        if not len(starts):
            continue
        dirty = np.add.reduceat((one & toxic[d]).astype(np.int64), starts)
        clean = np.add.reduceat((one & ~toxic[d]).astype(np.int64), starts)
        # a name counts if it is far likelier in toxic documents and hardly met in the others
        odds = np.log((dirty + 0.1) / n_toxic) - np.log((clean + 0.1) / n_clean)
        good = (dirty >= 3) & (odds > 3.5) & (clean * 20 <= dirty) & (n[starts] != 0)
        hit = np.repeat(good, np.diff(np.append(starts, len(n))))
        out[order[hit]] = True
    return out & toxic[doc]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -4, 4)
    return w


def learn(texts: pa.Array, toxic: np.ndarray, seed: int = 0) -> Toxicity:
    """A model from texts and their labels (0 or 1)."""
    toxic = np.asarray(toxic).astype(np.bool_)
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not toxic.any() or toxic.all():
        return Toxicity(None, (0.0, 0.0, 0.0), share)
    # block by block: whole arrays over all the sample's bytes would weigh on the driver
    spans = list(blocks(texts))
    parts = [Tokens(*raw(texts.slice(lo, hi - lo))) for lo, hi in spans]
    bases = np.cumsum([0, *(len(t.start) for t in parts)])
    doc = np.concatenate([t.doc + lo for t, (lo, _) in zip(parts, spans)])
    first = np.append(np.concatenate([t.words.first[:-1] + base for t, base in zip(parts, bases)]), bases[-1])
    gold = mined(parts, doc, toxic)
    random = np.random.default_rng(seed)
    centres = random.permutation(np.flatnonzero(gold))[:TOXIC_TOKENS]
    others = random.permutation(np.flatnonzero(~toxic[doc]))[: max(TOXIC_TOKENS, 3 * len(centres))]
    if not len(centres):
        return Toxicity(None, (0.0, 0.0, 0.0), share)
    c = np.concatenate([centres, others])
    lo = np.maximum(c - WINDOW, first[doc[c]])
    sizes = np.minimum(c + WINDOW + 1, first[doc[c] + 1]) - lo
    live = np.arange(2 * WINDOW + 1) < sizes[:, None]
    index = np.where(live, lo[:, None] + np.arange(2 * WINDOW + 1), lo[:, None])
    used, place = np.unique(index, return_inverse=True)
    cuts = np.searchsorted(used, bases)
    features = np.concatenate([t.features(used[a:b] - base) for t, base, a, b in zip(parts, bases, cuts, cuts[1:])])
    chain = Chain(1 << BITS, 2)
    chain.fit(features[place.reshape(index.shape)], gold[index].astype(np.int64) * live, live, epochs=8, size=2048, seed=seed)
    model = Toxicity(chain, (0.0, 1.0, 0.0), share)
    x, y = model.summary(np.concatenate([model.marginals(t) for t in parts]), doc, len(toxic))
    model.curve = tuple(float(v) for v in logistic(np.column_stack([x, y]), toxic.astype(float)))
    return model


def score_batches(batches: Iterator[pa.RecordBatch], model: Toxicity) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in blocks(b.column(1)):
            data, offsets = raw(b.column(1).slice(lo, hi - lo))
            tokens = Tokens(data, offsets)
            p = model.marginals(tokens)
            scores = model.scores(p, tokens.doc, hi - lo)
            found = np.flatnonzero(p > 0.5)
            spans: list[list[str]] = [[] for _ in range(hi - lo)]
            if len(found):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                new = np.ones(len(found), np.bool_)
                new[1:] = (np.diff(found) > 1) | (tokens.doc[found[1:]] != tokens.doc[found[:-1]])
                starts = np.flatnonzero(new)
                lasts = np.append(starts[1:], len(found)) - 1
                for s, e in zip(found[starts], found[lasts]):
                    d = tokens.doc[s]
                    zero = chars[offsets[d]]
                    spans[d].append(f"{chars[tokens.start[s]] - zero}:{chars[tokens.end[e]] - zero}")
            yield batch(SCHEMA, b.column(0).slice(lo, hi - lo), scores, np.array([len(x) for x in spans], np.int32), [",".join(x) for x in spans])


def fitting(sizes: np.ndarray, most: int) -> np.ndarray:
    """Which texts of these sizes make up a sample of ``most`` bytes: each in turn that still fits and isn't too long."""
    inside, held = np.zeros(len(sizes), np.bool_), 0
    for k, n in enumerate(sizes.tolist()):
        if n <= TEXT_BYTES and held + n <= most:
            inside[k], held = True, held + n
    return inside


def training_rows(documents: DataFrame, labels: DataFrame, label: str, keep, most: dict[int, int]) -> pa.Table:
    """(doc_id, text, label) of at most ``most[v]`` labelled documents of each value v, by the hash of their ids.

    ``keep``: a condition on doc_id.  Only ids travel before the limit; the join broadcasts at most the sum
    of ``most`` ids.  An id of several rows gives one, its smallest text.  Texts of more than ``TEXT_BYTES`` don't
    train; by rising hash, a row stays if its text and those that stay before it hold at most ``SAMPLE_BYTES``, so
    one long text leaves the others their place.
    """
    ids = need(labels, doc_id="long", **{label: "int"}).where(F.col("doc_id").isNotNull()).where(keep)
    ids = ids.groupBy("doc_id").agg(F.max(label).alias(label))  # a repeated label counts once
    parts = [ids.where(F.col(label) == v).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(n) for v, n in most.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionAll(p)
    texts = need(documents, doc_id="long", text="string")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), F.first(label).alias(label))
    found = shared_checkpoint(found)
    sizes = found.select("doc_id", F.octet_length("text").cast("long").alias("n"), F.xxhash64("doc_id", F.lit(7)).alias("h")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    inside = fitting(sizes["n"].to_numpy(), SAMPLE_BYTES)
    if not inside.all():
        found = found.where(F.col("doc_id").isin(sizes["doc_id"].to_numpy()[inside].tolist()))
    return found.select("doc_id", "text", label).toArrow().sort_by([("doc_id", "ascending")])


def held_out(of: int, remainder: int):
    """crc32 of the id's text, modulo ``of``, is ``remainder``."""
    return F.crc32(F.col("doc_id").cast("string")) % of == remainder


def fit(documents: DataFrame, labels: DataFrame, keep=None) -> Toxicity:
    rows = training_rows(documents, labels, "toxic", F.lit(True) if keep is None else keep, {1: TOXIC_ROWS, 0: CLEAN_ROWS})
    if not rows.num_rows:
        return Toxicity(None, (0.0, 0.0, 0.0), 0.0)
    return learn(rows["text"].combine_chunks(), rows["toxic"].to_numpy())


def score(documents: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score, n_spans and spans (start:end in code points) of every whole text; no shuffle."""
    return need(documents, doc_id="long", text="string").mapInArrow(on_workers(__name__, "score_batches", model), COLUMNS)
