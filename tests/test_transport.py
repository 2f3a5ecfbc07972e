"""Optimal transport against all assignments of equal portions, and its bounds."""

from itertools import permutations

import numpy as np
import pytest

from sparsegrove.operators import transport as T


def least(cost, a, b, portions):
    """The least cost when masses are whole numbers of portions: all assignments of one side's portions to the other's."""
    rows = [i for i, m in enumerate(a) for _ in range(round(m * portions))]
    columns = [j for j, m in enumerate(b) for _ in range(round(m * portions))]
    return min(sum(cost[i, j] for i, j in zip(rows, p)) for p in set(permutations(columns))) / portions


@pytest.mark.parametrize("tolerance", [1e-2, 1e-4])
def test_costs_equal_brute_force(tolerance):
    r = np.random.default_rng(0)
    cases = []
    for _ in range(25):
        m, n, portions = int(r.integers(1, 5)), int(r.integers(1, 5)), 6
        a, b = (np.bincount(r.integers(0, k, portions), minlength=k) / portions for k in (m, n))
        cases.append((T.distances(r.standard_normal((m, 3)), r.standard_normal((n, 3))), a, b, portions))
    cost, a, b = np.zeros((25, 4, 4)), np.zeros((25, 4)), np.zeros((25, 4))
    for k, (c, x, y, _) in enumerate(cases):
        cost[k, : len(x), : len(y)], a[k, : len(x)], b[k, : len(y)] = c, x, y
    got, gap = T.transport(cost, a, b, tolerance)
    want = np.array([least(*case) for case in cases])
    assert (gap <= tolerance).all() and (got >= want - 1e-9).all() and (got - want <= gap + 1e-9).all()


def test_larger_pairs_reach_the_tolerance():
    r = np.random.default_rng(1)
    a, b = r.random((3, 60)), r.random((3, 45))
    cost = np.stack([T.distances(r.standard_normal((60, 8)), r.standard_normal((45, 8))) for _ in range(3)])
    got, gap = T.transport(cost, a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True))
    assert (gap <= T.TOLERANCE).all() and (got > 0).all()
    same, _ = T.transport(T.distances(np.eye(4), np.eye(4))[None], np.full((1, 4), 0.25), np.full((1, 4), 0.25))
    assert same[0] <= T.TOLERANCE


def test_scores_of_rows(spark):
    rows = spark.createDataFrame([(1, ["graph", "search"], ["graph", "search"]), (2, ["graph"], ["soup", "spoon"]), (3, [], ["soup"]), (4, None, None), (5, ["graphs", "search", "search"], ["graph", "search"])], "doc_id long, prediction array<string>, target array<string>")
    got = {r["doc_id"]: r for r in T.mover_scores(rows, T.trigram_encoder).collect()}
    assert got[1]["score"] > 0.998 and got[1]["score"] > got[5]["score"] > got[2]["score"] > 0
    assert got[3]["score"] == got[4]["score"] == 0 and got[3]["cost"] is None and len(got) == 5
    assert all(r["gap"] <= T.TOLERANCE for r in got.values())


def test_idf_weighs_rare_tokens_more(spark):
    rows = spark.createDataFrame([(k, ["the", f"w{k}"], ["the"]) for k in range(5)], "doc_id long, prediction array<string>, target array<string>")
    mass = {r["doc_id"]: dict(zip(r["prediction_tokens"], r["prediction_masses"])) for r in T.masses(rows, "prediction").collect()}
    assert mass[2] == {"w2": 1.0}  # a token of all texts carries nothing
    assert {r["token"]: round(r["idf"], 6) for r in T.idf_weights(rows, "prediction").collect()}["w1"] == round(float(np.log(3)), 6)


def test_a_worker_encodes_few_tokens_at_once(monkeypatch):
    import pyarrow as pa

    from sparsegrove.operators import transport

    seen, encode = [], transport.trigram_encoder()
    factory = lambda: lambda tokens: (seen.append(len(tokens)), encode(tokens))[1]
    words = [[f"w{10 * k + j}" for j in range(10)] for k in range(40)]
    lists, mass = pa.array(words), pa.array([[0.1] * 10] * 40)
    rows = pa.record_batch([pa.array(range(40)), lists, mass, pa.array(words[::-1]), mass], names=["doc_id", "a", "b", "c", "d"])
    whole = pa.Table.from_batches(transport.mover_batches([rows], factory, 1e-3))
    assert max(seen) == 400
    seen.clear()
    monkeypatch.setattr(transport, "PART_TOKENS", 100)
    some = pa.Table.from_batches(transport.mover_batches([rows], factory, 1e-3))
    assert max(seen) <= 50 and some["doc_id"].to_pylist() == list(range(40))
    assert np.allclose(some["cost"].to_numpy(), whole["cost"].to_numpy(), atol=1e-9)
