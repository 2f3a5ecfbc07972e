"""Training of a sparse encoder on triplets: batches by length, gradients summed by Spark, checkpoints, best by moving average.

The encoder gives a text's hashed word b, of tf occurrences, the weight a(b) = log(1 + log(1 + tf) * relu(w(b))): one
trained number a word, shared by queries and documents.  A triplet's scores are inner products of such vectors.

An epoch deals the triplets into batches of about as many tokens: triplets of like length (powers of two) share a
batch, so batches of long texts hold fewer.  Steps follow each other, so batches that come one after the other form a chunk
of at most ``CHUNK_TOKENS`` tokens.  Chunks are written once an epoch, a folder each, which are listed once, and a chunk is
one job of one task, which holds its rows, takes its steps in order and hands back the state.  A batch of more tokens is a
chunk of its own, and its step one job of many tasks: each turns its rows into sums of derivatives by word, at most one row
a word, and the driver adds them up.  A step is AdamW's, with linear warm-up and decay of the rate; the weights whose
moving average of the loss is lowest are kept.

Derivatives travel as whole numbers (units of 2**-32), whose sums don't depend on the order of tasks.  So a run that is
resumed from a checkpoint, or repeated on another number of executors, gives the same weights to the last bit.

Rows with a null text in a triplet count it as empty.  Triplets of empty texts have scores of 0 and no derivatives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.remote import on_workers
from ..functions.text import search_tokens
from .index import scratch
from .training import pick_key

UNIT = 2.0**32
ROLES = ("query", "positive", "negative")
#: Tokens of a chunk, about (lists of four bytes each); tokens whose derivatives are worked out at once.
CHUNK_TOKENS, PART_TOKENS = 1 << 22, 1 << 18


@dataclass(frozen=True)
class Settings:
    """dim: hashed words; batch_tokens: tokens of a batch, about; loss: a name of LOSSES; flops_query, flops_document:
    largest weights of the FLOPS regularisers, reached quadratically after flops_steps; save_every: steps between checkpoints."""

    dim: int = 1 << 14
    batch_tokens: int = 1 << 18
    epochs: int = 1
    rate: float = 0.05
    warm_up: int = 5
    decay: float = 0.01
    loss: str = "pairwise_nll"
    flops_query: float = 0.0
    flops_document: float = 0.0
    flops_steps: int = 20
    keep: float = 0.99
    save_every: int = 10
    seed: str = "0"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def nll(pos, neg, t_pos, t_neg):
    g = -sigmoid(neg - pos)
    return softplus(neg - pos), g, -g


def mse(pos, neg, t_pos, t_neg):
    away = (pos - neg) - (t_pos - t_neg)
    return away**2, 2 * away, -2 * away


def kl(pos, neg, t_pos, t_neg):
    t, g = sigmoid(t_pos - t_neg), sigmoid(pos - neg) - sigmoid(t_pos - t_neg)
    own = np.where(t > 0, t * np.log(np.maximum(t, 1e-300)), 0) + np.where(t < 1, (1 - t) * np.log(np.maximum(1 - t, 1e-300)), 0)
    return own + t * softplus(neg - pos) + (1 - t) * softplus(pos - neg), g, -g


def bce(pos, neg, t_pos, t_neg):
    return softplus(-pos) + softplus(neg), -sigmoid(-pos), sigmoid(neg)


#: Value of a loss and its derivatives by both scores.
LOSSES = {"pairwise_nll": nll, "margin_mse": mse, "kl_divergence": kl, "bce": bce}


def hashed(text: Column, dim: int) -> Column:
    """The words of a text as numbers below ``dim``, repeats kept."""
    return F.transform(search_tokens(F.coalesce(text, F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))


def examples(triplets: DataFrame, dim: int) -> DataFrame:
    """(query, positive, negative: hashed words; t_pos, t_neg: teacher's scores or 0; key, tokens) of triplets of texts."""
    teacher = [(F.coalesce(F.col(c), F.lit(0.0)) if c in triplets.columns else F.lit(0.0)).cast("double").alias(c) for c in ("t_pos", "t_neg")]
    rows = triplets.select(*(hashed(F.col(c), dim).alias(c) for c in ROLES), *teacher)
    rows = rows.withColumns({"key": F.xxhash64(*ROLES), "tokens": F.size("query") + F.size("positive") + F.size("negative")})
    # sorted once here, so that no step sorts to count; the key is of the words in their order
    return rows.withColumns({role: F.sort_array(role) for role in ROLES})


def batches(rows: DataFrame, batch_tokens: int, seed: str) -> DataFrame:
    """``rows`` with the number of their batch: by length, then by hash.

    Lengths are told apart by powers of two, so their counts, some thirty rows, go through the driver.
    """
    width = F.floor(F.log2(F.greatest("tokens", F.lit(1)))).cast("int")
    counts = {r["width"]: r["tokens"] for r in rows.groupBy(width.alias("width")).agg(F.sum("tokens").alias("tokens")).orderBy("width").collect()}
    numbers = {w: max(1, -(-tokens // batch_tokens)) for w, tokens in counts.items()}
    first = dict(zip(numbers, np.cumsum([0, *numbers.values()])[:-1].tolist()))
    batch = F.lit(0)
    for w, n in numbers.items():
        batch = F.when(width == w, F.lit(first[w]) + F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n)).cast("int")).otherwise(batch)
    return rows.withColumn("batch", batch.cast("int"))


# one task's part of a step


def vectors(column, weights: np.ndarray):
    """Of a column of hashed words: keys (row * dim + word, sorted), words, values and derivatives by the word's weight."""
    dim = len(weights)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    keys = row * dim + lists.flatten().to_numpy(zero_copy_only=False)
    keys = keys if (keys[1:] >= keys[:-1]).all() else np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, tf = keys[first], np.diff(first, append=len(keys))
    word, scale = keys % dim, np.log1p(tf)
    w = weights[word]
    x = scale * np.maximum(w, 0)
    return keys, word, np.log1p(x), np.where(w > 0, scale / (1 + x), 0.0)


def whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


def summed(word: np.ndarray, x: np.ndarray, dim: int) -> np.ndarray:
    """By word the sum of ``whole(x)``; doubles hold it exactly while no sum can reach 2**53."""
    units = np.rint(x * UNIT)
    if np.abs(units).sum() < 2**52:
        return np.bincount(word, units, dim).astype(np.int64)
    out = np.zeros(dim, np.int64)
    np.add.at(out, word, units.astype(np.int64))
    return out


def shared(keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two sorted arrays without repeats hold the same keys."""
    other = np.minimum(np.searchsorted(others, keys), max(len(others) - 1, 0))
    at = np.flatnonzero(others[other] == keys) if len(others) else np.zeros(0, np.int64)
    return at, other[at]


def derivatives(rows, weights: np.ndarray, loss: str):
    """Sums over the rows, in units: the loss, by word the derivative, and activations and their derivatives of both sides."""
    dim = len(weights)
    sums = np.zeros((5, dim), np.int64)
    n = rows.num_rows
    sides = {role: vectors(rows.column(k), weights) for k, role in enumerate(ROLES)}
    meets, scores = {}, {}
    for role in ROLES[1:]:
        at, other = shared(sides["query"][0], sides[role][0])
        meets[role] = at, other
        scores[role] = np.bincount(sides["query"][0][at] // dim, sides["query"][2][at] * sides[role][2][other], n)
    value, by_pos, by_neg = LOSSES[loss](scores["positive"], scores["negative"], *(rows.column(k).to_numpy() for k in (3, 4)))
    for role, by in (("positive", by_pos), ("negative", by_neg)):
        at, other = meets[role]
        own, there = sides["query"], sides[role]
        slope = by[own[0][at] // dim] * (own[3][at] * there[2][other] + own[2][at] * there[3][other])
        sums[0] += summed(own[1][at], slope, dim)
    for role, side in sides.items():
        place = 1 if role == "query" else 3
        sums[place] += summed(side[1], side[2], dim)
        sums[place + 1] += summed(side[1], side[3], dim)
    return int(whole(value).sum()), sums


SUMS = "word int, gradient long, query long, query_slope long, document long, document_slope long"


def parts(rows):
    """``rows`` in slices of about ``PART_TOKENS`` tokens, one row at least."""
    ends = np.cumsum(sum(np.diff(rows.column(k).offsets.to_numpy()) for k in range(len(ROLES))))
    start = 0
    while start < rows.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_TOKENS, side="right")))
        yield rows.slice(start, stop - start)
        start = stop


def gradient_batches(data, weights: np.ndarray, loss: str):
    """The sums of one task's rows by word; word -1 has the loss and the number of rows."""
    total, value, n = np.zeros((5, len(weights)), np.int64), 0, 0
    for rows in data:
        for part in parts(rows):
            own, sums = derivatives(part, weights, loss)
            value, n = value + own, n + part.num_rows
            total += sums
    words = np.flatnonzero(total.any(axis=0))
    columns = [np.append(words, -1), np.append(total[0, words], value), np.append(total[1, words], n), *(np.append(total[k, words], 0) for k in (2, 3, 4))]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], [c.split(" ")[0] for c in SUMS.split(", ")])


STATE = "step long, best_step long, average double, best_average double, losses array<double>, weights array<double>, first array<double>, second array<double>, best array<double>"


def chunk_batches(data, state: State, order: list[int], steps: int, settings: Settings):
    """The state after the steps of one task's rows (batch, query, ...), batches in the order given; losses are the chunk's own."""
    held: dict[int, list] = {batch: [] for batch in order}
    for rows in data:
        number = rows.column(0).to_numpy()
        by = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(np.diff(number[by], prepend=-1))
        for low, high in zip(cuts, np.append(cuts[1:], len(by))):
            held[int(number[by[low]])].append(pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(by[low:high])) for c in range(1, 6)], rows.schema.names[1:6]))
    if not any(held.values()):  # a part without rows of the chunk
        return
    known = len(state.losses)
    for batch in order:
        value, n, total = 0, 0, np.zeros((5, settings.dim), np.int64)
        for rows in held.pop(batch):
            for part in parts(rows):
                own, sums = derivatives(part, state.weights, settings.loss)
                value, n = value + own, n + part.num_rows
                total += sums
        advance(state, value, n, total, steps, settings)
    out = {"step": state.step, "best_step": state.best_step, "average": state.average, "best_average": state.best_average, "losses": state.losses[known:], **{c: getattr(state, c) for c in ("weights", "first", "second", "best")}}
    kinds = [pa.int64()] * 2 + [pa.float64()] * 2 + [pa.list_(pa.float64())] * 5
    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(out.values(), kinds)], list(out))


# the loop


class State:
    """Weights, AdamW's moments, what the run has seen so far, and the best weights."""

    def __init__(self, dim: int):
        self.step, self.losses, self.average, self.best_average, self.best_step = 0, [], None, math.inf, 0
        self.weights, self.first, self.second = np.ones(dim), np.zeros(dim), np.zeros(dim)
        self.best = self.weights.copy()

    def seen(self, loss: float, keep: float) -> None:
        """A step's loss, of the weights as they are before its update."""
        self.losses.append(loss)
        self.average = loss if self.average is None else keep * self.average + (1 - keep) * loss
        if self.average < self.best_average:
            self.best_average, self.best_step, self.best = self.average, self.step, self.weights.copy()

    def update(self, gradient: np.ndarray, rate: float, decay: float, b1: float = 0.9, b2: float = 0.999) -> None:
        self.step += 1
        self.first = b1 * self.first + (1 - b1) * gradient
        self.second = b2 * self.second + (1 - b2) * gradient**2
        move = (self.first / (1 - b1**self.step)) / (np.sqrt(self.second / (1 - b2**self.step)) + 1e-8)
        self.weights = self.weights - rate * (move + decay * self.weights)

    def save(self, spark: SparkSession, folder: str) -> None:
        """One file in a folder of its own, which appears whole or not at all."""
        n = len(self.weights)
        table = pa.table({
            "word": np.arange(n), "weight": self.weights, "first": self.first, "second": self.second, "best": self.best,
            "average": np.full(n, self.average), "best_average": np.full(n, self.best_average), "best_step": np.full(n, self.best_step),
            "losses": pa.array([self.losses] + [None] * (n - 1), pa.list_(pa.float64())),
        })
        spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{folder}/step={self.step}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, dim: int) -> State | None:
        """The latest state in a folder; None without one."""
        from pyspark.errors import AnalysisException

        try:
            saved = spark.read.parquet(folder)
        except AnalysisException:  # no such folder, or none complete
            return None
        step = saved.agg(F.max("step")).first()[0]
        if step is None:
            return None
        rows = saved.where(F.col("step") == step).toArrow().sort_by("word")
        state = cls(dim)
        state.step, state.losses = int(step), rows["losses"][0].as_py()
        state.weights, state.first, state.second, state.best = (rows[c].to_numpy().copy() for c in ("weight", "first", "second", "best"))
        state.average, state.best_average, state.best_step = (rows[c][0].as_py() for c in ("average", "best_average", "best_step"))
        return state


def rate_at(step: int, steps: int, settings: Settings) -> float:
    """Linear warm-up, then linear decay to 0 at the end."""
    if step < settings.warm_up:
        return settings.rate * (step + 1) / settings.warm_up
    return settings.rate * max(0.0, (steps - step) / max(1, steps - settings.warm_up))


def train(triplets: DataFrame, settings: Settings = Settings(), folder: str | None = None, stop_after: int | None = None) -> State:
    """The state after all steps, or after ``stop_after`` of them.

    triplets: (query, positive, negative[, t_pos, t_neg]).  folder: where checkpoints go, on storage that all share; a
    run that finds one there goes on from it.
    """
    spark = triplets.sparkSession
    state = (State.load(spark, folder, settings.dim) if folder else None) or State(settings.dim)
    written = scratch(spark)
    examples(triplets, settings.dim).write.parquet(f"{written}/examples")
    rows = spark.read.parquet(f"{written}/examples")
    dealt = [batches(rows, settings.batch_tokens, f"{settings.seed}/{epoch}") for epoch in range(settings.epochs)]
    numbers = [{r["batch"]: r["tokens"] for r in d.groupBy("batch").agg(F.sum("tokens").alias("tokens")).collect()} for d in dealt]
    steps = sum(map(len, numbers))
    stop = steps if stop_after is None else min(steps, stop_after)
    done = 0
    for epoch, tokens in enumerate(numbers):
        order = np.random.default_rng([epoch, *settings.seed.encode()]).permutation(sorted(tokens)).tolist()
        # a resumed run is past some of them
        left = order[max(0, state.step - done) : max(0, stop - done)]
        done += len(order)
        if not left:
            continue
        chunks = in_chunks(left, tokens, state.step, settings.save_every if folder else 0)
        numbered = spark.createDataFrame([(batch, k) for k, own in enumerate(chunks) for batch in own], "batch int, chunk int")
        own_rows = dealt[epoch].join(F.broadcast(numbered), "batch").select("chunk", "batch", *ROLES, "t_pos", "t_neg", "tokens")
        own_rows.repartition("chunk").write.partitionBy("chunk").parquet(f"{written}/epoch={epoch}")
        chunk_rows = spark.read.schema(own_rows.schema).parquet(f"{written}/epoch={epoch}")
        for k, own in enumerate(chunks):
            mine = chunk_rows.where(F.col("chunk") == k)
            if sum(tokens[batch] for batch in own) > CHUNK_TOKENS:
                step(mine, state, steps, settings)
            else:
                take_steps(mine, state, own, steps, settings)
            if folder and state.step % settings.save_every == 0:
                state.save(spark, folder)
    if folder and state.step % settings.save_every:
        state.save(spark, folder)
    return state


def in_chunks(order: list[int], tokens: dict[int, int], step: int, save_every: int) -> list[list[int]]:
    """Batches in their order, as many as ``CHUNK_TOKENS`` hold, one at least; a chunk ends where a checkpoint is due."""
    chunks: list[list[int]] = []
    held = 0
    for k, batch in enumerate(order):
        if not chunks or held + tokens[batch] > CHUNK_TOKENS or (save_every and (step + k) % save_every == 0):
            chunks.append([])
            held = 0
        chunks[-1].append(batch)
        held += tokens[batch]
    return chunks


def take_steps(rows: DataFrame, state: State, order: list[int], steps: int, settings: Settings) -> None:
    """The updates of a chunk's batches, by one task."""
    start = State(len(state.weights))
    start.__dict__ |= {**state.__dict__, "losses": []}  # losses so far stay here
    own = rows.select("batch", *ROLES, "t_pos", "t_neg").coalesce(1).mapInArrow(on_workers(rows.sparkSession, __name__, "chunk_batches", start, order, steps, settings), STATE)
    found = own.toArrow()
    for c in ("step", "best_step", "average", "best_average"):
        setattr(state, c, found[c][0].as_py())
    state.losses += found["losses"][0].as_py()
    for c in ("weights", "first", "second", "best"):
        setattr(state, c, found[c][0].values.to_numpy().copy())


def step(rows: DataFrame, state: State, steps: int, settings: Settings) -> None:
    """One update from a batch's rows, by as many tasks as they have parts."""
    found = rows.select(*ROLES, "t_pos", "t_neg").mapInArrow(on_workers(rows.sparkSession, __name__, "gradient_batches", state.weights, settings.loss), SUMS)
    names = [c.split(" ")[0] for c in SUMS.split(", ")][1:]
    rows_of_words = found.toArrow()  # of each task of the batch a row a word at most
    sums = np.zeros((len(names), len(state.weights) + 1), np.int64)
    for own, c in zip(sums, names):
        np.add.at(own, rows_of_words["word"].to_numpy() + 1, rows_of_words[c].to_numpy())
    advance(state, int(sums[0, 0]), int(sums[1, 0]), sums[:, 1:], steps, settings)


def advance(state: State, value: int, n: int, sums: np.ndarray, steps: int, settings: Settings) -> None:
    """One update from a batch's sums: its loss in units, its rows, and by word the five sums of ``derivatives``."""
    n = max(n, 1)
    loss = value / UNIT / n
    gradient, query, query_slope, document, document_slope = sums / UNIT / n
    quadratic = min(1.0, state.step / settings.flops_steps) ** 2
    for most, mean, slope, sides in ((settings.flops_query, query, query_slope, 1), (settings.flops_document, document, document_slope, 2)):
        # the square of a word's mean activation over the batch's texts
        loss += most * quadratic * float(np.sum((mean / sides) ** 2))
        gradient = gradient + most * quadratic * 2 * (mean / sides) * (slope / sides)
    state.seen(loss, settings.keep)
    state.update(gradient, rate_at(state.step, steps, settings), settings.decay)


def encode(texts: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, weight): sparse vectors of texts under trained weights; terms are hashed words.

    The weights are broadcast: a row a word, ``dim`` of them.
    """
    spark, dim = texts.sparkSession, len(weights)
    known = spark.createDataFrame(pa.table({"term": pa.array(np.arange(dim), pa.int32()), "w": np.maximum(weights, 0)}))
    words = texts.select(key, F.explode(hashed(F.col(text), dim)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.log1p(F.log1p(F.col("tf")) * F.col("w"))
    return words.join(F.broadcast(known), "term").select(key, "term", weight.alias("weight")).where("weight > 0")


def history(spark: SparkSession, state: State, keep: float = 0.99) -> DataFrame:
    """(step, loss, average, best) of a run: the losses are one number a step."""
    average, rows = None, []
    for k, loss in enumerate(state.losses):
        average = loss if average is None else keep * average + (1 - keep) * loss
        rows.append((k, loss, average, k == state.best_step))
    return spark.createDataFrame(rows, "step int, loss double, average double, best boolean")
