"""The tagger against all sequences of tags, and on held-out sentences of a small grammar."""

from itertools import product

import numpy as np
import pytest

from sparsegrove.operators import tagging


def sentences(n, seed):
    """Sentences of a grammar in which "-s" words are nouns or verbs by what stands before them."""
    r = np.random.default_rng(seed)
    stems = [a + b for a in ("gra", "so", "ti", "bel", "mor", "ka") for b in ("ph", "lin", "rk", "stem", "vo")]
    out = []
    for _ in range(n):
        own = []
        for role in ("subject", "verb", "object"):
            if role == "verb":
                own.append((str(r.choice(stems)) + "s", "VB"))
                continue
            own.append((str(r.choice(["the", "a"])), "DT"))
            if r.random() < 0.5:
                own.append((str(r.choice(stems)) + "ous", "JJ"))
            own.append((str(r.choice(stems)) + ("s" if r.random() < 0.5 else "er"), "NN"))
        if r.random() < 0.3:
            own += [("in", "IN"), (str(int(r.integers(1000))), "CD")]
        out.append(([w for w, _ in own], [t for _, t in own]))
    return out


@pytest.fixture(scope="module")
def tagger(spark):
    return tagging.learn(spark.createDataFrame(sentences(400, 0), "tokens array<string>, tags array<string>"))


def test_tags_of_unseen_sentences(spark, tagger):
    held = sentences(150, 9)
    rows = spark.createDataFrame([(k, w) for k, (w, _) in enumerate(held)] + [(900, []), (901, None), (902, [None, "zzz"])], "doc_id long, tokens array<string>")
    got = {r["doc_id"]: r["tags"] for r in tagging.tag(rows, tagger).collect()}
    right = sum(a == b for k, (_, tags) in enumerate(held) for a, b in zip(got[k], tags))
    assert right / sum(len(t) for _, t in held) > 0.97 and len(got) == 153
    assert got[900] == [] and got[901] == [] and len(got[902]) == 2
    # the same word after a determiner and after a noun
    ambiguous = spark.createDataFrame([(1, ["the", "graphs", "graphs", "the", "solins"])], "doc_id long, tokens array<string>")
    assert tagging.tag(ambiguous, tagger).first()["tags"] == ["DT", "NN", "VB", "DT", "NN"]


def test_decoding_equals_all_sequences():
    r = np.random.default_rng(1)
    for _ in range(20):
        tags, m = 3, 5
        model = tagging.Tagger(list("abc"), r.standard_normal(tags), r.standard_normal((tags, tags)), {}, {}, np.zeros((0, tags)), np.zeros(tags))
        emissions = r.standard_normal((4, m, tags))
        sizes = np.array([5, 1, 3, 4])
        got = model.decode(emissions, np.arange(m) < sizes[:, None])
        for k, n in enumerate(sizes):
            value = lambda s: model.start[s[0]] + sum(emissions[k, i, t] for i, t in enumerate(s)) + sum(model.pairs[a, b] for a, b in zip(s, s[1:]))  # noqa: E731, B023
            assert value(tuple(got[k, :n])) == pytest.approx(max(value(s) for s in product(range(tags), repeat=int(n))))


def test_bounded_and_empty_models(spark):
    rows = spark.createDataFrame(sentences(50, 3), "tokens array<string>, tags array<string>")
    small = tagging.learn(rows, 10)
    assert len(small.words) == 10 and len(small.known) == 10 + len(small.endings)
    empty = tagging.learn(rows.limit(0))
    assert empty.tags == [] and tagging.tag(spark.createDataFrame([(1, ["a"])], "doc_id long, tokens array<string>"), empty).first()["tags"] == [None]
