"""Exact maximum coverage under a budget by branch and bound with Lagrangian bounds, subtrees dealt to tasks.

Spark first shrinks the instance: documents with the same phrases become one of their number, phrases with the same
documents become the cheapest of them (the smallest name of equal ones).  What is left fits each task up to
``MOST_POSTINGS`` postings.  A larger one is an error, or stays with Spark if the caller wants that (``large``): each job counts, for the open nodes of the best bounds,
what every phrase would add to what they cover, and no task holds more than a batch of documents and ``MOST_SUMS`` sums.
There a node's bound is what it covers and what the budget buys of these gains, one in part; gains only fall
as phrases are taken.  The driver keeps names, costs and nodes, not postings.

A node has phrases taken and phrases barred.  Its bound relaxes "a document counts only if a phrase of it is taken" by a
price for each document: documents count for their weight less their price, phrases for the prices of their
documents, as many as the budget holds, one of them in part.  Steps along the subgradient lower it; children begin with their parent's prices.
The driver opens nodes until there are a few for each task, and each task searches its own, depth first, from the greedy cover's value on.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.remote import on_workers
from .phrases import checkpointed

MOST_POSTINGS = 1_000_000
#: Sums (nodes times phrases) and nodes that one job of the search by Spark holds at once.
MOST_SUMS, MOST_NODES = 1 << 21, 128
#: Nodes dealt to each core, and steps along the subgradient at the root and below.
NODES_A_CORE, FIRST_STEPS, STEPS = 4, 60, 8


@dataclass
class Instance:
    """names, costs: of phrases; their documents are docs[first[p]:first[p + 1]]; weights: of documents."""

    names: list[str]
    costs: np.ndarray
    first: np.ndarray
    docs: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.phrase = np.repeat(np.arange(len(self.names)), np.diff(self.first))

    def own(self, p: int) -> np.ndarray:
        return self.docs[self.first[p] : self.first[p + 1]]

    def values(self, prices: np.ndarray) -> np.ndarray:
        """Each phrase's sum of its documents' prices."""
        return np.bincount(self.phrase, prices[self.docs], len(self.names))


class Node:
    """Phrases taken and barred, what that leaves, and prices."""

    def __init__(self, at: Instance, budget: float, taken=(), barred=(), prices: np.ndarray | None = None):
        self.at, self.taken, self.barred = at, tuple(taken), tuple(barred)
        self.free = np.ones(len(at.names), np.bool_)
        self.free[[*self.taken, *self.barred]] = False
        self.open = np.ones(len(at.weights), np.bool_)
        for p in self.taken:
            self.open[at.own(p)] = False
        self.covered = int(at.weights[~self.open].sum())
        self.left = budget - float(at.costs[list(self.taken)].sum())
        self.free &= at.costs <= self.left
        self.weights = np.where(self.open, at.weights, 0).astype(float)
        self.prices = np.minimum(self.weights, self.weights if prices is None else prices)

    def chosen(self, prices: np.ndarray) -> tuple[float, np.ndarray, int]:
        """The most that the budget's phrases are worth, the share taken of each, and the free phrase worth most."""
        values = np.where(self.free, self.at.values(prices), 0)
        share = np.zeros(len(values))
        order = np.argsort(-values / self.at.costs, kind="stable")
        order = order[values[order] > 0]
        spent = np.cumsum(self.at.costs[order])
        whole = int(np.searchsorted(spent, self.left, side="right"))
        share[order[:whole]] = 1
        if whole < len(order):
            share[order[whole]] = (self.left - (spent[whole - 1] if whole else 0)) / self.at.costs[order[whole]]
        return float(values @ share), share, int(order[0]) if len(order) else -1

    def bound(self, steps: int, goal: int) -> tuple[float, int]:
        """The lowest bound found, and the phrase to branch on (-1: none is worth anything); stops at one of ``goal`` or less."""
        best, prices, branch = np.inf, self.prices, -1
        scale = 1.0
        for _ in range(steps):
            worth, share, top = self.chosen(prices)
            value = self.covered + worth + float((self.weights - prices).sum())
            if value < best - 1e-9:
                best, self.prices, branch = value, prices, top
            else:
                scale /= 2
            if best < goal + 1 - 1e-6 or top < 0:
                break
            slope = np.bincount(self.at.docs, share[self.at.phrase], len(self.weights)) - 1
            slope[~self.open] = 0
            size = float(slope @ slope)
            if size == 0:
                break
            prices = np.clip(prices - scale * max(value - goal, 1) / size * slope, 0, self.weights)
        return best, branch

    def children(self, p: int) -> list[Node]:
        budget = self.left + float(self.at.costs[list(self.taken)].sum())
        return [Node(self.at, budget, self.taken, (*self.barred, p), self.prices), Node(self.at, budget, (*self.taken, p), self.barred, self.prices)]


def greedy(at: Instance, budget: float) -> tuple[int, tuple[int, ...]]:
    """The better of the cover by most new weight a cost and the best single phrase."""
    node = Node(at, budget)
    while True:
        gains = np.where(node.free, at.values(node.weights), 0) / at.costs
        if not len(gains) or gains.max() <= 0:
            break
        node = Node(at, budget, (*node.taken, int(gains.argmax())), node.barred)
    alone = np.where(at.costs <= budget, at.values(at.weights.astype(float)), 0)
    if len(alone) and alone.max() > node.covered:
        return int(alone.max()), (int(alone.argmax()),)
    return node.covered, node.taken


def solve(nodes: list[Node], best: int, chosen: tuple[int, ...] | None) -> tuple[int, tuple[int, ...] | None, int]:
    """The best cover below the nodes that is better than ``best``, and how many nodes that took."""
    stack, seen = list(nodes), 0
    while stack:
        node = stack.pop()
        seen += 1
        if node.covered > best:
            best, chosen = node.covered, node.taken
        bound, branch = node.bound(STEPS if node.taken or node.barred else FIRST_STEPS, best)
        if branch >= 0 and bound >= best + 1 - 1e-6:  # covers are whole numbers
            stack += node.children(branch)
    return best, chosen, seen


def open_nodes(root: Node, best: int, chosen: tuple[int, ...], n: int) -> tuple[list[Node], int, tuple[int, ...]]:
    """Up to about n nodes whose subtrees hold all covers that are better than the best one here."""
    level = [root]
    while level and len(level) < n:
        below = []
        for node in level:
            if node.covered > best:
                best, chosen = node.covered, node.taken
            bound, branch = node.bound(STEPS if node.taken or node.barred else FIRST_STEPS, best)
            if branch >= 0 and bound >= best + 1 - 1e-6:
                below += node.children(branch)
        level = below
    return level, best, chosen


def search_batches(batches, at: Instance, budget: float, best: int):
    for rows in batches:
        for taken, barred in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            value, chosen, seen = solve([Node(at, budget, taken, barred)], best, None)
            best = max(best, value)
            yield pa.RecordBatch.from_arrays([pa.array([value], pa.int64()), pa.array([chosen], pa.list_(pa.int32())), pa.array([seen], pa.int64())], ["value", "chosen", "nodes"])


def reduced(occurrences: DataFrame, costs: DataFrame | None) -> tuple[DataFrame, int]:
    """(phrase, cost, doc_id, weight) of the shrunk instance, and its postings: costs are positive, 1 without a table."""
    rows = occurrences.select("phrase", F.col("doc_id").cast("long").alias("doc_id")).where("phrase IS NOT NULL AND doc_id IS NOT NULL").distinct()
    # phrases with the same documents: a set is named by its size and the sums of two hashes of its members
    named = lambda by, of: rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64(F.lit(s), of).cast("decimal(38,0)")).alias(f"h{s}") for s in (1, 2)))
    priced = named("phrase", "doc_id")
    priced = priced.withColumn("cost", F.lit(1.0)) if costs is None else priced.join(costs.select("phrase", F.col("cost").cast("double").alias("cost")), "phrase").where("cost > 0")
    keep = priced.groupBy("n", "h1", "h2").agg(F.min(F.struct("cost", "phrase")).alias("x")).select("x.phrase", "x.cost")
    rows = checkpointed(rows.join(keep, "phrase"))
    alike = named("doc_id", "phrase").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("weight"))
    left = checkpointed(rows.join(alike.select("doc_id", "weight"), "doc_id"))
    return left, left.count()


def instance(left: DataFrame, n: int) -> Instance:
    found = left.select("phrase", "cost", "doc_id", "weight").toArrow().sort_by([("phrase", "ascending"), ("doc_id", "ascending")])
    names, at = np.unique(np.array(found["phrase"].to_pylist(), object), return_index=True) if n else (np.zeros(0, object), np.zeros(0, np.int64))
    _, one, docs = np.unique(found["doc_id"].to_numpy(), return_index=True, return_inverse=True)
    return Instance(names.tolist(), found["cost"].to_numpy()[at], np.append(at, n), docs, found["weight"].to_numpy()[one])


def exact_cover(occurrences: DataFrame, budget: float, costs: DataFrame | None = None, large: bool = False) -> DataFrame:
    """(phrase, cost, covered): phrases within the budget that together occur in the most documents, ``covered`` of them.

    occurrences: (phrase, doc_id); costs: (phrase, cost), without it each costs 1.  Of covers that are as good one comes back.
    large: whether instances that no task holds are searched by Spark, a job for each ``MOST_NODES`` nodes.
    """
    spark = occurrences.sparkSession
    left, n = reduced(occurrences, costs)
    if n > MOST_POSTINGS:
        if not large:
            raise ValueError(f"exact coverage: {n} postings are left of at most {MOST_POSTINGS}; greedy_cover takes any number")
        return large_cover(left, budget)
    at = instance(left, n)
    best, chosen = greedy(at, budget)
    cores = spark.sparkContext.defaultParallelism
    nodes, best, chosen = open_nodes(Node(at, budget), best, chosen, NODES_A_CORE * cores)
    if nodes:
        table = pa.table({"taken": pa.array([n.taken for n in nodes], pa.list_(pa.int32())), "barred": pa.array([n.barred for n in nodes], pa.list_(pa.int32()))})
        dealt = spark.createDataFrame(table).repartition(min(len(nodes), NODES_A_CORE * cores))
        found = dealt.mapInArrow(on_workers(spark, __name__, "search_batches", at, budget, best), "value long, chosen array<int>, nodes long")
        top = found.where("chosen IS NOT NULL").orderBy(F.desc("value"), "chosen").first()
        if top is not None and top["value"] > best:
            best, chosen = top["value"], tuple(top["chosen"])
    return spark.createDataFrame([(at.names[p], float(at.costs[p]), best) for p in sorted(chosen)], "phrase string, cost double, covered long")


# instances that no task holds


def gain_batches(batches, nodes: list[tuple[int, ...]], n: int):
    """Sums of one task's documents (phrases, weight): by node what it covers, and by node and phrase what that would add."""
    covered, gains = np.zeros(len(nodes), np.int64), np.zeros((len(nodes), n), np.int64)
    for rows in batches:
        lists, weight = rows.column(0), rows.column(1).to_numpy()
        phrase = lists.flatten().to_numpy()
        doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
        for k, taken in enumerate(nodes):
            left = weight.copy()
            left[doc[np.isin(phrase, taken)]] = 0
            covered[k] += weight.sum() - left.sum()
            gains[k] += np.bincount(phrase, left[doc], n).astype(np.int64)
    node, phrase = np.nonzero(gains)
    columns = np.append(np.arange(len(nodes)), node), np.append(np.full(len(nodes), -1), phrase), np.append(covered, gains[node, phrase])
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["node", "phrase", "n"])


def node_gains(texts: DataFrame, nodes: list[tuple[int, ...]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """What each node covers, and by node and phrase what that would add."""
    found = texts.mapInArrow(on_workers(texts.sparkSession, __name__, "gain_batches", nodes, n), "node int, phrase int, n long")
    sums = found.groupBy("node", "phrase").agg(F.sum("n").alias("n")).toArrow()
    node, phrase, value = (sums[c].to_numpy() for c in ("node", "phrase", "n"))
    covered, gains = np.zeros(len(nodes), np.int64), np.zeros((len(nodes), n), np.int64)
    own = phrase < 0
    covered[node[own]] = value[own]
    gains[node[~own], phrase[~own]] = value[~own]
    return covered, gains


def most_worth(gains: np.ndarray, costs: np.ndarray, left: float) -> float:
    """The most that a budget buys of gains, the last one in part."""
    order = np.argsort(-gains / costs, kind="stable")
    spent = np.cumsum(costs[order])
    whole = int(np.searchsorted(spent, left, side="right"))
    value = float(gains[order[:whole]].sum())
    return value + (float(gains[order[whole]]) * (left - (spent[whole - 1] if whole else 0)) / costs[order[whole]] if whole < len(order) else 0)


def large_cover(left: DataFrame, budget: float) -> DataFrame:
    """``exact_cover`` of a shrunk instance (phrase, cost, doc_id, weight) that stays with Spark."""
    spark = left.sparkSession
    names = left.groupBy("phrase").agg(F.min("cost").alias("cost")).toArrow().sort_by("phrase")
    phrases, costs = names["phrase"].to_pylist(), names["cost"].to_numpy()
    numbers = spark.createDataFrame(pa.table({"phrase": names["phrase"], "number": pa.array(np.arange(len(phrases)), pa.int32())}))
    texts = checkpointed(left.join(numbers, "phrase").groupBy("doc_id").agg(F.collect_list("number").alias("phrases"), F.first("weight").alias("weight")).select("phrases", "weight"))
    best, chosen, count = 0, (), 0
    # (-bound, its number, phrases taken, phrases barred)
    heap: list[tuple] = [(-np.inf, count, (), frozenset())]
    while heap:
        nodes = []
        while heap and len(nodes) < max(1, min(MOST_NODES, MOST_SUMS // max(len(phrases), 1))):
            bound, _, taken, barred = heapq.heappop(heap)
            if -bound >= best + 1 - 1e-6:  # covers are whole numbers
                nodes.append((taken, barred))
        if not nodes:
            break
        for (taken, barred), covered, gains in zip(nodes, *node_gains(texts, [t for t, _ in nodes], len(phrases))):
            money = budget - float(costs[list(taken)].sum())
            if covered > best:
                best, chosen = int(covered), taken
            gains[[*taken, *barred]] = 0
            free = np.flatnonzero((gains > 0) & (costs <= money))
            # children take one of the free phrases each and bar those before it, so no set is met twice
            free = free[np.argsort(-gains[free] / costs[free], kind="stable")]
            if not len(free):
                continue
            top = int(free[np.argmax(gains[free])])
            if covered + gains[top] > best:
                best, chosen = int(covered + gains[top]), (*taken, top)
            for j, p in enumerate(free.tolist()):
                bound = covered + gains[p] + most_worth(gains[free[j + 1 :]], costs[free[j + 1 :]], money - costs[p])
                if covered + most_worth(gains[free[j:]], costs[free[j:]], money) < best + 1 - 1e-6:
                    break
                if bound >= best + 1 - 1e-6:
                    count += 1
                    heapq.heappush(heap, (-bound, count, (*taken, p), barred | set(free[:j].tolist())))
    return spark.createDataFrame([(phrases[p], float(costs[p]), best) for p in sorted(chosen)], "phrase string, cost double, covered long")
