"""Inputs that once lost rows or text, took quadratic time or crashed."""

import time

import numpy as np
import pytest

from sparsegrove.llm import html_extract, ngram_join, pii, toxicity


def test_one_long_text_leaves_the_sample_its_others():
    inside = toxicity.fitting(np.array([8000] + [40] * 200), 5000)
    assert not inside[0] and inside.sum() == 125  # 125 texts of 40 bytes are 5000
    assert toxicity.fitting(np.array([], np.int64), 10).tolist() == []


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</ul>" * 20_000, "<y><div>" + "<x>" * 20_000 + "</y>" * 20_000, "<ul>" + "<li><div>" * 10_000 + "</li>" * 20_000, "<table>" + "<i><td>" * 20_000])
def test_stray_tags_take_linear_time(page):
    began = time.time()
    html_extract.parse(page)
    assert time.time() - began < 5


def test_pages_of_little_structure_keep_their_text():
    model = html_extract.learn()
    pages = {"words without any tag, " * 40: ("words without any tag, " * 40).strip(), "<p>hi": "hi", "<html><body>In a body alone, some words.</body></html>": "In a body alone, some words.", "<html><body><p>A short one.</p></body></html>": "A short one."}
    assert html_extract.extract(list(pages), model) == list(pages.values())
    short = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1><p>Short text.</article><footer>Imprint and such</footer></body></html>"
    assert html_extract.extract([short], model) == ["Title of it\n\nShort text."]


def test_best_labels_of_small_trees_against_all_labellings():
    from itertools import product

    r = np.random.default_rng(1)
    allowed = {(a, b) for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))}
    for page in ("<div><p>a</p><ul><li>b<li>c</ul></div><p>d", "<div><div><div>x</div></div></div>", "t", "<p>a<p>b<p>c<p>d"):
        nodes = html_extract.parse(page)
        for _ in range(10):
            logp = np.log(r.dirichlet([1, 1, 1], len(nodes)))
            ways = [w for w in product(range(3), repeat=len(nodes)) if all(x.parent is None or (w[x.parent.number], w[x.number]) in allowed for x in nodes)]
            best = max(ways, key=lambda w: sum(logp[k, s] for k, s in enumerate(w)))
            assert html_extract.decode(nodes, logp) == list(best)


def test_many_addresses_take_linear_time():
    tagger = pii.Tagger(pii.learn())
    times = []
    for n in (4_000, 16_000):
        text = " ".join(f"write to user{k}@example.org or" for k in range(n))
        began = time.time()
        base, _ = pii.found([text], tagger)
        times.append(time.time() - began)
        assert len(base[0]["email"]) == n
    assert times[1] < 8 * times[0] + 2


def test_taken_meets_what_overlaps():
    taken = pii.Taken({"email": [(10, 20)], "card": [(12, 40), (50, 52)], "ip": [], "phone": []})
    assert [taken.meets(a, b) for a, b in ((0, 10), (0, 11), (25, 30), (40, 50), (51, 60), (52, 60))] == [False, True, True, False, True, False]
    assert not pii.Taken({}).meets(0, 5)


@pytest.mark.parametrize("nulls", [True, False])
def test_one_of_each_with_any_column_names(spark, nulls):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 5, "x", 1), (2, text, 6, "y", 2), (3, "other words", 7, "z", 3)] + ([(None, "null id", 8, None, 4), (None, text, 9, None, 5)] if nulls else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string, _set int, `a.b` string, win_id int")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["_set"] for r in kept.collect()) == ([5, 7, 8] if nulls else [5, 7])
