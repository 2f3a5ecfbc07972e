"""Exact coverage against enumeration, and the greedy cover within its proved share of it."""

import math
from itertools import combinations

import numpy as np
import pytest

from sparsegrove.operators import max_cover, phrases


def instance(seed, n_phrases=12, n_docs=40):
    r = np.random.default_rng(seed)
    return {f"p{k:02}": set(r.choice(n_docs, int(r.integers(1, 12)), replace=False).tolist()) for k in range(n_phrases)}


def frame(spark, sets):
    return spark.createDataFrame([(p, int(d)) for p, own in sets.items() for d in own], "phrase string, doc_id long")


def best(sets, budget, costs):
    return max((len(set().union(*(sets[p] for p in c))) for n in range(len(sets) + 1) for c in combinations(sets, n) if sum(costs[p] for p in c) <= budget), default=0)


@pytest.mark.parametrize("seed,k", [(0, 3), (1, 4), (2, 1), (3, 12)])
def test_cover_equals_enumeration(spark, seed, k):
    sets = instance(seed)
    sets["p97"], sets["p98"] = sets["p00"], sets["p00"]  # the same documents
    got = max_cover.exact_cover(frame(spark, sets), k).collect()
    want = best(sets, k, dict.fromkeys(sets, 1))
    assert len(got) <= k and {r["covered"] for r in got} == {want}
    assert len(set().union(*(sets[r["phrase"]] for r in got))) == want
    greedy = phrases.greedy_cover(frame(spark, sets), k).agg({"gain": "sum"}).first()[0]
    assert (1 - 1 / math.e) * want <= greedy <= want


@pytest.mark.parametrize("seed,budget,priced", [(0, 3, False), (1, 4, False), (2, 1, False), (5, 7, True), (6, 9, True)])
def test_instances_that_no_task_holds(spark, monkeypatch, seed, budget, priced):
    monkeypatch.setattr(max_cover, "MOST_POSTINGS", 10)
    monkeypatch.setattr(max_cover, "MOST_NODES", 5)
    sets = instance(seed)
    costs = {p: 1.0 + k % 4 if priced else 1.0 for k, p in enumerate(sets)}
    table = spark.createDataFrame(list(costs.items()), "phrase string, cost double") if priced else None
    got = max_cover.exact_cover(frame(spark, sets), budget, table, large=True).collect()
    want = best(sets, budget, costs)
    assert {r["covered"] for r in got} == {want} == {len(set().union(*(sets[r["phrase"]] for r in got)))}
    assert sum(costs[r["phrase"]] for r in got) <= budget


def test_costs_and_a_budget(spark):
    sets = instance(5)
    costs = {p: 1.0 + k % 4 for k, p in enumerate(sets)}
    table = spark.createDataFrame(list(costs.items()), "phrase string, cost double")
    got = max_cover.exact_cover(frame(spark, sets), 7, table).collect()
    assert {r["covered"] for r in got} == {best(sets, 7, costs)} and sum(r["cost"] for r in got) <= 7


def test_greedy_falls_short_where_the_search_does_not(spark):
    """Two phrases cover all; the greedy first takes a third that overlaps both."""
    sets = {"left": set(range(0, 8)), "right": set(range(8, 16)), "bait": set(range(3, 13))}
    assert {r["phrase"] for r in max_cover.exact_cover(frame(spark, sets), 2).collect()} == {"left", "right"}


def test_bounds_hold_and_prune():
    """Each node's bound is no less than the best cover below it; the search opens far fewer nodes than there are covers."""
    sets = instance(8, 26, 120)
    docs = [sorted(own) for own in sets.values()]
    at = max_cover.Instance(list(sets), np.ones(26), np.concatenate([[0], np.cumsum([len(d) for d in docs])]), np.concatenate(docs), np.ones(120, np.int64))
    want = max(len(set().union(*(sets[p] for p in c))) for c in combinations(sets, 4))
    value, _, seen = max_cover.solve([max_cover.Node(at, 4)], 0, None)
    assert value == want and seen < 2000  # of 14,950 covers
    for taken in ((0,), (3, 7), (1, 2, 5)):
        below = max(len(set().union(*(sets[f"p{p:02}"] for p in (*taken, *c)))) for c in combinations([p for p in range(26) if p not in taken], 4 - len(taken)))
        assert max_cover.Node(at, 4, taken).bound(20, 0)[0] >= below - 1e-6


def test_empty_and_too_large(spark, monkeypatch):
    assert max_cover.exact_cover(frame(spark, {"a": {1}}).limit(0), 3).collect() == []
    assert max_cover.exact_cover(frame(spark, {"a": {1}}), 0).collect() == []
    monkeypatch.setattr(max_cover, "MOST_POSTINGS", 3)
    with pytest.raises(ValueError, match="postings"):
        max_cover.exact_cover(frame(spark, instance(0)), 3)
