"""Optimal transport between the token vectors of two texts, tokens weighed by idf, with a proved tolerance.

A text is a distribution over its distinct tokens (occurrences times idf, scaled to 1); moving mass from one token to
another costs the distance of their unit vectors.  The least cost is approached by entropic scaling, its potentials taken up into the plan every few rounds, in
padded batches of like size: the strength of the entropy halves whenever the plan's margins are near those wanted, and
goes on from the potentials found.  After every few rounds two exact bounds are taken.  Rounding the plan to the margins gives a
transport that exists, so its cost is no less than the least; potentials made feasible give a value that is no greater.  A pair
is done when the two differ by ``TOLERANCE`` or less, or after ``LOOKS`` looks; their difference is returned beside the cost.

Memory: a pair needs a few matrices of its distinct tokens on one side times those on the other; a worker holds the vectors
of the distinct tokens of ``PART_TOKENS`` at most (of one pair, if that has more), each once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.remote import on_workers

TOLERANCE = 1e-3
#: Cells of a padded batch; a larger pair is a batch of its own.
CELLS = 1 << 18
#: Tokens of the pairs that a worker holds at once, and the vectors of their distinct ones.
PART_TOKENS = 1 << 17
#: Rounds between two looks at the bounds, and looks at most.
ROUNDS, LOOKS = 100, 250


def softmin(x: np.ndarray, axis: int) -> np.ndarray:
    low = x.min(axis=axis, keepdims=True)
    return (low.squeeze(axis) - np.log(np.exp(low - x).sum(axis=axis)))


def feasible(cost: np.ndarray, f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of potentials that no cell's cost is below: none is more than the least transport."""
    g = np.where(b > 0, (cost - f[:, :, None] + np.where(a > 0, 0, np.inf)[:, :, None]).min(axis=1), 0)
    f = np.where(a > 0, (cost - g[:, None, :] + np.where(b > 0, 0, np.inf)[:, None, :]).min(axis=2), 0)
    return (a * f).sum(1) + (b * g).sum(1)


def rounded(plan: np.ndarray, cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of transports between a and b near the plans: rows and columns scaled down, what is missing dealt in proportion."""
    rows = plan.sum(2)
    plan = plan * np.minimum(1, np.divide(a, rows, out=np.ones_like(a), where=rows > 0))[:, :, None]
    columns = plan.sum(1)
    plan = plan * np.minimum(1, np.divide(b, columns, out=np.ones_like(b), where=columns > 0))[:, None, :]
    short_a, short_b = np.maximum(a - plan.sum(2), 0), np.maximum(b - plan.sum(1), 0)
    left = short_a.sum(1)
    scale = np.divide(1, left, out=np.zeros_like(left), where=left > 0)
    return (plan * cost).sum((1, 2)) + np.einsum("bi,bij,bj,b->b", short_a, cost, short_b, scale)


def transport(cost: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Costs of transports for each (m, n) matrix of a batch, and how far at most each is from the least one.

    a (batch, m), b (batch, n): masses that add up to 1; cells without mass are padding.
    """
    n = len(cost)
    cost = cost * (a > 0)[:, :, None] * (b > 0)[:, None, :]
    best, low = np.full(n, np.inf), np.full(n, -np.inf)
    with np.errstate(divide="ignore"):
        log_a, log_b = np.log(a), np.log(b)
    f, g = np.zeros_like(a), np.zeros_like(b)
    strength = np.maximum(cost.max((1, 2)), 1e-12)
    live = np.arange(n)
    largest = strength.copy()
    for _ in range(LOOKS):
        c, e = cost[live], strength[live][:, None, None]
        la, lb, fl, gl = log_a[live], log_b[live], f[live], g[live]
        # once in the log domain, which is safe at any strength; then by scaling that plan, which takes products alone
        fl = np.where(a[live] > 0, e[:, 0] * softmin((c - gl[:, None, :]) / e - lb[:, None, :], 2), 0)
        gl = np.where(b[live] > 0, e[:, 0] * softmin((c - fl[:, :, None]) / e - la[:, :, None], 1), 0)
        plan = np.exp((fl[:, :, None] + gl[:, None, :] - c) / e + la[:, :, None] + lb[:, None, :])
        u, v = np.ones_like(fl), np.ones_like(gl)
        for _ in range(ROUNDS):
            u = np.where(a[live] > 0, a[live] / np.maximum((plan @ v[:, :, None])[:, :, 0], 1e-300), 1)
            v = np.where(b[live] > 0, b[live] / np.maximum((u[:, None, :] @ plan)[:, 0], 1e-300), 1)
        fl, gl = fl + e[:, 0] * np.log(u), gl + e[:, 0] * np.log(v)
        f[live], g[live] = fl, gl
        plan = u[:, :, None] * plan * v[:, None, :]
        best[live] = np.minimum(best[live], rounded(plan, c, a[live], b[live]))
        low[live] = np.maximum(low[live], feasible(c, fl, a[live], b[live]))
        away = np.abs(plan.sum(2) - a[live]).sum(1) * largest[live]
        strength[live] = np.where(away < tolerance / 4, strength[live] / 2, strength[live])
        live = live[best[live] - low[live] > tolerance]
        if not len(live):
            break
    return best, np.maximum(best - low, 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * unit(x) @ unit(y).T, 0))


def parts(batches, tokens: int):
    """Slices of the batches with about so many tokens on both sides."""
    for rows in batches:
        ends = np.cumsum(sum(pc.list_value_length(rows.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 3)))
        start = 0
        while start < rows.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + tokens, side="right")))
            yield rows.slice(start, stop - start)
            start = stop


def mover_batches(batches, factory: Callable, tolerance: float):
    encoder = factory()
    for rows in parts(batches, PART_TOKENS):
        sides = []
        for tokens, masses in ((1, 2), (3, 4)):
            lists = rows.column(tokens)
            flat = lists.flatten().dictionary_encode()
            vectors = np.asarray(encoder(flat.dictionary.to_pylist()), float) if len(flat) else np.zeros((0, 1))
            at, code = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0], flat.indices.to_numpy(zero_copy_only=False)
            mass = rows.column(masses).flatten().to_numpy(zero_copy_only=False)
            sides.append([(vectors, code[lo:hi], mass[lo:hi]) for lo, hi in zip(at, at[1:])])
        costs, gaps = np.full(rows.num_rows, np.nan), np.zeros(rows.num_rows)
        sizes = [(max(len(x[2]), len(y[2])), k) for k, (x, y) in enumerate(zip(*sides)) if len(x[2]) and len(y[2])]
        group: list[int] = []
        for size, k in sorted(sizes, reverse=True) + [(0, -1)]:
            widest = max((len(sides[s][j][2]) for j in group for s in (0, 1)), default=0)
            if group and (k < 0 or (len(group) + 1) * max(widest, size) ** 2 > CELLS):
                m, n = (max(len(sides[s][j][2]) for j in group) for s in (0, 1))
                cost, a, b = np.zeros((len(group), m, n)), np.zeros((len(group), m)), np.zeros((len(group), n))
                for r, j in enumerate(group):
                    (x, left, p), (y, right, q) = sides[0][j], sides[1][j]
                    cost[r, : len(p), : len(q)], a[r, : len(p)], b[r, : len(q)] = distances(x[left], y[right]), p, q
                costs[group], gaps[group] = transport(cost, a, b, tolerance)
                group = []
            group.append(k)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(costs, from_pandas=True), pa.array(gaps)], ["doc_id", "cost", "gap"])


def idf_weights(texts: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, idf) of the distinct tokens of each row's array: log((n + 1) / (df + 1))."""
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    df = texts.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def masses(rows: DataFrame, side: str) -> DataFrame:
    """(doc_id, tokens, masses) of the arrays of one side: distinct tokens by occurrences times idf over this side's corpus.

    A text whose tokens all have an idf of 0 counts them alike.
    """
    idf = idf_weights(rows, side)
    each = rows.select("doc_id", F.explode(side).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    weighed = each.join(idf, "token").select("doc_id", F.struct("token", (F.col("tf") * F.col("idf")).alias("w"), F.col("tf").cast("double").alias("tf")).alias("t"))
    lists = weighed.groupBy("doc_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    total = lambda of: F.aggregate("t", F.lit(0.0), lambda s, t: s + t[of])
    mass = F.when(total("w") > 0, F.transform("t", lambda t: t["w"] / total("w"))).otherwise(F.transform("t", lambda t: t["tf"] / total("tf")))
    # tokens of an idf of 0 carry nothing and go
    both = F.filter(F.arrays_zip(F.transform("t", lambda t: t["token"]).alias("token"), mass.alias("mass")), lambda z: z["mass"] > 0)
    return lists.select("doc_id", both.alias("z")).select("doc_id", F.col("z.token").alias(f"{side}_tokens"), F.col("z.mass").alias(f"{side}_masses"))


def mover_scores(rows: DataFrame, factory: Callable, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, score, cost, gap) of (doc_id, prediction, target: arrays of tokens), one row a document.

    cost: of moving one side's idf-weighted tokens onto the other's, at most ``gap`` above the least; score: 1 / (1 +
    cost).  factory: makes an encoder of tokens, one vector each.  A text without tokens scores 0 and has no cost.
    """
    empty = F.array().cast("array<string>"), F.array().cast("array<double>")
    own = rows.select("doc_id").join(masses(rows, "prediction"), "doc_id", "left").join(masses(rows, "target"), "doc_id", "left")
    columns = [F.coalesce(c, empty[k % 2]).alias(c) for k, c in enumerate(("prediction_tokens", "prediction_masses", "target_tokens", "target_masses"))]
    kind = rows.schema["doc_id"].dataType.simpleString()
    # the matrices are the work, not the rows: all cores share them
    dealt = own.select("doc_id", *columns).repartition(rows.sparkSession.sparkContext.defaultParallelism, "doc_id")
    found = dealt.mapInArrow(on_workers(rows.sparkSession, __name__, "mover_batches", factory, tolerance), f"doc_id {kind}, cost double, gap double")
    return found.select("doc_id", F.coalesce(1 / (1 + F.col("cost")), F.lit(0.0)).alias("score"), "cost", "gap")


def trigram_encoder(dimensions: int = 64) -> Callable:
    """Signed hashes of a token's character trigrams: an encoder of tokens that needs no model."""
    from hashlib import blake2b

    def encode(tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), dimensions))
        for i, t in enumerate(tokens):
            padded = f"<{t}>"
            for k in range(max(1, len(padded) - 2)):
                h = int.from_bytes(blake2b(padded[k : k + 3].encode(), digest_size=8).digest(), "little")
                out[i, h % dimensions] += 1 if h >> 63 else -1
        return out

    return encode
