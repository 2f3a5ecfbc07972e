"""Whitening, line deduplication and lexical search against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from sparsegrove.llm import lexical_search, line_dedup, whitening

LONG = "shared line number {} of more than forty code points"


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common or common[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_texts():
    r = np.random.default_rng(3)
    rows = []
    for i in range(60):
        lines = [f"own line {i} {j} " + "x" * int(r.integers(0, 60)) for j in range(int(r.integers(0, 6)))]
        for s in range(8):
            if r.random() < (0.05, 0.08, 0.1, 0.2, 0.5, 0.9, 0.07, 0.3)[s]:
                lines.insert(int(r.integers(0, len(lines) + 1)), " \t" * int(r.integers(0, 2)) + (LONG.format(s).upper() if r.random() < 0.3 else LONG.format(s)) + "\r" * int(r.integers(0, 2)))
        rows.append((i, "\n".join(lines) + "\n" * int(r.integers(0, 3))))
    rows += [(60, None), (61, ""), (62, "\n\n"), (7, LONG.format(5)), (7, LONG.format(5)), (None, LONG.format(5) + "\nmy own"), (None, None), (63, "É" * 39), (64, ("É" * 39 + "\n") * 5), (65, "short\n" * 50_000 + LONG.format(4))]
    return rows + [(70 + i, "y" * 39 + ("z" if i < 4 else "") + "\n" + "ÀÉ" * 20 + chr(0x85)) for i in range(6)]


@pytest.mark.parametrize("hot_keys", [line_dedup.HOT_KEYS, 3])
def test_lines_against_brute_force(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot_keys)
    rows = line_texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in line_dedup.dedup_lines(frame).collect()]
    assert sorted(got, key=repr) == brute_lines(rows)


def test_lines_carry_columns_of_any_name(spark):
    rows = [(i, LONG.format(0), "row", "b") for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, row string, `a.b` string").withColumnRenamed("row", "positions")
    got = line_dedup.dedup_documents(frame)
    assert got.columns == frame.columns and [r["doc_id"] for r in got.where("text <> ''").collect()] == [5]
    assert line_dedup.dedup_documents(frame.limit(0)).collect() == [] == line_dedup.dedup_lines(frame.limit(0)).collect()


def brute_search(documents, items, k=50):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    docs = [(i, Counter(terms(t))) for i, t in documents if i is not None and terms(t)]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def search_tables():
    r = np.random.default_rng(5)
    words = [f"w{j}" for j in range(300)] + ["Été", "ñandú", "日本"]
    ps = 1 / np.arange(1, len(words) + 1)
    ps /= ps.sum()
    documents = [(int(i), ", ".join(r.choice(words, int(r.integers(1, 40)), p=ps))) for i in r.permutation(700)]
    documents += [(800 + i, "W1 tie w2") for i in range(90)] + [(5, documents[0][1])] * 2 + [(None, "w1 w2"), (901, None), (902, ""), (903, "_ - ."), (904, "w3 " * 60_000)]
    items = [(f"q{j}", " ".join(r.choice(words, int(r.integers(1, 12))))) for j in range(30)]
    return documents, items + [("q3", "w1 w77"), ("tie", "tie"), ("none", None), (None, "w1"), ("odd", "_ ABC-xyz"), ("upper", "W5 w5 W5")]


@pytest.mark.parametrize("fanout,block", [(16, 1 << 15), (2, 40)])
def test_search_against_brute_force(spark, monkeypatch, fanout, block):
    """Whole answers at two shapes of the tree, with one or several blocks of queries."""
    monkeypatch.setattr(lexical_search, "FANOUT", fanout)
    monkeypatch.setattr(lexical_search, "SEGMENT", fanout**3)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    documents, items = search_tables()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in documents], "doc_id long, text string, terms string, n int")
    got = lexical_search.search(lexical_search.index_documents(docs), spark.createDataFrame(items, "item_id string, text string"), 20)
    assert sorted(map(tuple, got.collect())) == brute_search(documents, items, 20)


def test_search_opens_few_nodes_and_ties_in_order():
    n = lexical_search.SEGMENT
    r = np.random.default_rng(0)
    impact = r.integers(1, 1000, n)
    top = np.sort(r.choice(200, 40, replace=False))
    impact[top] = 5000
    segment = lexical_search.Segment(np.arange(n) * 3, np.arange(n), np.zeros(n, np.int64), impact, 2)
    best = []
    segment.search(np.array([0, 1]), np.array([7, 9]), 10, best)
    assert sorted((-s, -i) for s, i in best) == [(-35000, int(d) * 3) for d in top[:10]]
    assert segment.opened < n // lexical_search.FANOUT / 4


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.where("false"))):
        assert lexical_search.search(lexical_search.index_documents(d), i).collect() == []


def vectors(spark, data):
    return spark.createDataFrame([(k, v, "clash") for k, v in data], "vec_id long, embedding array<double>, x string")


@pytest.mark.parametrize("first,most", [(16, 512), (4, 8)])
def test_whitening_against_dense_eigenvectors(spark, first, most):
    r = np.random.default_rng(2)
    data = (r.standard_normal((300, 24)) * np.linspace(3, 0.4, 24) + 5).tolist()
    rows = [(k, v) for k, v in enumerate(data)] + [(3, data[3]), (None, data[4]), (500, None), (501, [float("nan")] * 24), (502, [float("inf")] + [0.0] * 23), (503, [None] + [0.0] * 23), (504, []), (505, [1.0])]
    got = whitening.whiten(vectors(spark, rows), 4, first=first, most=most).collect()
    x = np.floor(1024 * np.array(data + [data[3], data[4]])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    e, v = np.linalg.eigh((x - sums / n).T @ (x - sums / n) / n)
    e, v = e[::-1][:4], v[:, ::-1][:, :4]
    want = (x - sums / n) @ v / np.sqrt(e)
    assert len(got) == 4 * n and {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-9 for r in got)
    ids = [*range(300), 3, None]
    away = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    mine = {}
    for g in got:
        mine.setdefault(g["component"], []).append((g["vec_id"], g["deviation"], g["whitened"], g["explained"]))
    for c in range(1, 5):
        own = sorted(mine[c], key=lambda t: (t[0] is None, t[0], t[2]))
        ref = sorted(zip(ids, away, want[:, c - 1].tolist()), key=lambda t: (t[0] is None, t[0], t[2]))
        sign = np.sign(own[0][2] * ref[0][2])
        assert [(a, b) for a, b, *_ in own] == [(a, b) for a, b, _ in ref]
        assert np.allclose([t[2] for t in own], sign * np.array([t[2] for t in ref]), atol=1e-8)
        assert abs(own[0][3] / (e[c - 1] / np.trace((x - sums / n).T @ (x - sums / n) / n)) - 1) < 1e-9


def test_subspace_iteration_certifies_what_it_returns():
    """Flat spectra in a space wider than the largest block: the filter takes over, residuals hold."""
    r = np.random.default_rng(4)
    q = np.linalg.qr(r.standard_normal((120, 120)))[0]
    e = np.linspace(10, 1, 120)
    a = (q * e) @ q.T
    passes = []
    values, found, residuals = whitening.subspace_iteration(lambda b: passes.append(1) or a @ b, 120, 5, first=10, most=20)
    assert residuals.max() <= whitening.TOLERANCE and np.allclose(values, e[:5], rtol=1e-12)
    assert np.allclose(np.abs(np.einsum("ij,ij->j", q[:, :5], found)), 1, atol=1e-10) and len(passes) < 200


def test_whitening_of_flat_huge_and_empty_tables(spark):
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])]).limit(0)).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()  # one direction alone varies
    assert [(r["component"], r["deviation"], round(abs(r["whitened"]), 9)) for r in got] == [(1, 2048**2, 1.0)] * 2
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [0.0, 0.0])])).collect()
    assert {r["deviation"] for r in huge} == {None}


def test_deviations_are_exact_up_to_the_last_bit():
    x = np.array([[100_000 + v] for v in (0, 3037000499, 3037000500)], np.int64)
    assert whitening.deviations(x, 1, np.array([100_000])).to_pylist() == [0, 3037000499**2, None]
