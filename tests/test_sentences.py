"""The learnt sentence splitter on a small corpus whose boundaries are known."""

import math

import numpy as np
import pytest

from sparsegrove.operators import sentences as S


def corpus(n=400, seed=0):
    """(texts, sentences of each): abbreviations inside sentences, numbers tied to "no.", sentences opened by few words."""
    r = np.random.default_rng(seed)
    nouns = [f"{a}{b}" for a in ("grap", "ind", "phra", "tok", "vect", "quer", "rank", "terr") for b in ("ha", "exo", "sem", "ena")]
    texts, parts = [], []
    for _ in range(n):
        own = []
        for _ in range(int(r.integers(2, 6))):
            words = [str(w) for w in r.choice(nouns, int(r.integers(4, 9)))]
            if r.random() < 0.4:
                words[1:1] = [str(r.choice(["approx.", "dr.", "e.g.", "fig."])), str(r.choice(nouns)).capitalize() if r.random() < 0.5 else str(r.choice(nouns))]
            if r.random() < 0.3:
                words[2:2] = ["no.", str(int(r.integers(1, 99)))]
            own.append(f"{r.choice(['The', 'However', 'We'])} {' '.join(words)}{r.choice(['.', '.', '.', '!', '?'])}")
        texts.append(" ".join(own))
        parts.append(own)
    return texts, parts


@pytest.fixture(scope="module")
def tables(spark):
    texts, _ = corpus()
    return S.learn(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_tables_are_learnt(tables):
    found = {r[0] for r in tables.abbreviations.collect()}
    assert {"approx", "dr", "e.g", "fig", "no"} <= found and not any(t.startswith(("grap", "rank")) for t in found)
    assert {"the", "however", "we"} <= {r[0] for r in tables.starters.collect()}


def test_splits_unseen_texts(spark, tables):
    texts, parts = corpus(80, seed=7)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in S.split(rows, tables).orderBy("doc_id", "sentence").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["text"]
    right = sum(got[k] == own for k, own in enumerate(parts))
    assert right >= 0.97 * len(parts)


def test_lines_ellipses_and_odd_texts(spark, tables):
    texts = {1: "  The graph.\nwe rank\n\nit", 2: None, 3: "", 4: " \n ", 5: "The token... The vector... and more", 6: "One", 7: "The dr. Terrha ranks 5. The graph é. “We” rank (e.g. tokens.) We end."}
    got = {}
    for r in S.split(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tables).orderBy("doc_id", "sentence").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["text"]
    assert got == {1: ["The graph.", "we rank", "it"], 5: ["The token...", "The vector... and more"], 6: ["One"], 7: ["The dr. Terrha ranks 5.", "The graph é.", "“We” rank (e.g. tokens.)", "We end."]}


def test_scores_against_the_formula(spark):
    rows = spark.createDataFrame([("dr", 9, 1), ("end", 5, 40), ("the", 0, 200), ("e.g", 3, 0), ("5", 4, 4)], "type string, n_stop long, n_plain long")
    n, stops = 266, 21
    got = {r["type"]: r["score"] for r in S.abbreviation_scores(rows).collect()}
    assert set(got) == {"dr", "end", "e.g"}
    for t, a, b in (("dr", 9, 1), ("end", 5, 40), ("e.g", 3, 0)):
        p = stops / n
        ratio = -2 * (a * math.log(p) + b * math.log(1 - p) - a * math.log(0.99) - b * math.log(0.01))
        letters = len(t.replace(".", ""))
        assert got[t] == pytest.approx(ratio * math.exp(-letters) * (t.count(".") + 1) * letters**-b)


def test_equal_words_are_looked_at_once(spark):
    texts = spark.createDataFrame([(1, "Dr. Low  ate no. 5.\nDr. Low left. " * 50), (2, ""), (3, None), (4, " \n ")], "doc_id long, text string")
    rows = S.words(texts)
    assert rows.count() == 6 and {(r["type"], r["stop"]): r["times"] for r in rows.collect()}[("dr", True)] == 100
    pairs = {(r["type"], r["next_type"]): r["pairs"] for r in S.stop_pairs(texts).collect()}
    assert pairs == {("dr", "low"): 100, ("no", "##number##"): 50, ("left", "dr"): 49}
