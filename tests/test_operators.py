"""Hand-computed fixtures and properties of the retrieval and keyphrase operators."""

import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparsegrove.functions.stem import stem
from sparsegrove.functions.text import blank_spans, from_positions, indel_ratio, search_tokens
from sparsegrove.operators import evaluation, overlap, phrases, retrieval, sparse, training


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_quantile_pruning_is_strict(spark):
    df = spark.createDataFrame([(1, "t", 1.0), (2, "t", 2.0), (3, "t", 4.0), (4, "t", 9.0), (1, "alone", 5.0)], "doc_id long, term string, weight double")
    assert rows(sparse.prune_by_quantile(df, 0.75), "doc_id", "term") == [(4, "t")]
    assert rows(sparse.prune_by_value(df, 0.04), "doc_id") == [(1,), (4,)]
    assert rows(sparse.top_terms(df, 1), "doc_id", "term") == [(1, "alone"), (2, "t"), (3, "t"), (4, "t")]


def test_merges(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y z", 2.0)], "doc_id long, term string, weight double")
    b = spark.createDataFrame([(1, "x", 3.0), (1, "y z", 1.0)], "doc_id long, term string, weight double")
    assert rows(sparse.merge_max(a, b), "term", "weight") == [("x", 3.0), ("y z", 2.0)]
    assert rows(sparse.merge_sum(a, b), "term", "weight") == [("x", 4.0), ("y z", 3.0)]
    assert rows(sparse.merge_phrases(a, b, F.instr("term", " ") > 0), "term", "weight") == [("x", 1.0), ("y z", 1.0)]


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (3, "c", 4)], "doc_id long, term string, tf long")
    got = {(d, t): w for d, t, w in rows(retrieval.bm25_impacts(df), "doc_id", "term", "weight")}
    idf = math.log((3 - 2 + 0.5) / 2.5 + 1)
    assert got[1, "a"] == int(100 * idf * 2 * 1.9 / (2 + 0.9 * (0.6 + 0.4 * 3 / (8 / 3))))


def test_measures(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (9, 1, 1)], "query_id long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (2, 21, 1), (3, 30, 1)], "query_id long, doc_id long, rel int")
    got = evaluation.evaluate(run, rel, 10).first()
    ndcg = (2 / math.log2(3)) / (2 + 1 / math.log2(3))
    assert got["ndcg"] == round(ndcg / 2, 5) and got["mrr"] == 0.25 and got["mrr_all"] == round(0.5 / 3, 5)


def test_max_sim(spark):
    q = spark.createDataFrame([(1, 0, "a", 2.0), (1, 0, "b", 1.0), (1, 1, "a", 1.0)], "query_id long, pos int, term string, weight double")
    d = spark.createDataFrame([(5, 0, "a", 1.0), (5, 1, "a", 2.0), (5, 1, "b", 1.0)], "doc_id long, pos int, term string, weight double")
    assert rows(retrieval.max_sim(q, d), "score") == [(7.0,)]


def test_preferences(spark):
    pairs = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 1, 0.1), (1, 1, 3, 0.5), (1, 3, 1, 0.5), (1, 2, 3, 0.2), (1, 3, 2, 0.8)], "query_id long, a long, b long, s double")
    assert rows(retrieval.preference_scores(pairs), "doc_id", "score") == [(1, 1.5), (2, 0.0), (3, 1.5)]


def test_greedy_cover_lazy_equals_distributed(spark, monkeypatch):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    df = spark.createDataFrame([(p, d) for p, docs in {"b": [1, 2, 3], "a": [1, 2, 3], "c": [4, 5], "d": [6], "e": [1, 6]}.items() for d in docs], "phrase string, doc_id long")
    lazy = rows(phrases.greedy_cover(df, 5), "step", "phrase", "gain")
    assert lazy == [(1, "a", 3), (2, "c", 2), (3, "d", 1)]
    monkeypatch.setattr(phrases, "DRIVER_POSTINGS", 0)
    assert rows(phrases.greedy_cover(df, 5), "step", "phrase", "gain") == lazy


def test_greedy_cover_writes_its_documents_once(spark, monkeypatch):
    monkeypatch.setattr(phrases, "DRIVER_POSTINGS", 0)
    written, keep = [], phrases.checkpointed
    monkeypatch.setattr(phrases, "checkpointed", lambda rows: written.append(1) or keep(rows))
    df = spark.createDataFrame([(f"p{d % 7 + j}", d) for d in range(40) for j in range(3)] + [(None, 1), ("p1", None)], "phrase string, doc_id long")
    assert sum(r["gain"] for r in phrases.greedy_cover(df, 5).collect()) == 40 and len(written) == 1


def test_keyphrase_measures(spark):
    df = spark.createDataFrame([(1, ["a", "x", "b"], ["a", "b"]), (2, [], ["a"]), (3, ["q"], [])], "doc_id long, predictions array<string>, targets array<string>")
    got = {r["doc_id"]: r for r in phrases.document_measures(df, 5).collect()}
    assert got[1]["precision"] == 0.4 and got[1]["recall"] == 1.0 and got[2]["f1"] == 0 and got[3]["recall"] == 0
    m = {r["doc_id"]: r["k"] for r in phrases.document_measures(df, "G").collect()}
    assert m == {1: 3, 2: 1, 3: 1}


def test_gap_groups(spark):
    df = spark.createDataFrame([("p", 10, 13), ("p", 14, 17), ("p", 60, 63)], "paper string, s int, e int")
    assert rows(training.gap_groups(df, "paper", "s", "e", 5), "s", "group") == [(10, 0), (14, 0), (60, 1)]
    assert rows(training.gap_groups(df, "paper", "s", "e", 5, keep_last=False), "s") == [(10,), (14,)]
    one = df.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("x"))
    assert [[tuple(s) for s in g] for g in one.select(training.group_in_row(F.col("x"))).first()[0]] == [[(10, 13), (14, 17)], [(60, 63)]]


def test_interval_join(spark):
    p = spark.createDataFrame([("k", 5), ("k", 25), ("k", 30)], "key string, at int")
    i = spark.createDataFrame([("k", 0, 10), ("k", 20, 30)], "key string, s int, e int")
    assert rows(training.interval_join(p, i, "at", "s", "e", "key", 8), "at", "s") == [(5, 0), (25, 20)]


def test_text(spark):
    df = spark.createDataFrame([("Ab, (cd) [1]. ", {"w": [0, 3], "x": [1]})], "t string, m map<string,array<int>>")
    got = df.select(search_tokens(F.col("t")), from_positions(F.col("m")), blank_spans(F.col("t"), F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"))))).first()
    assert got[0] == ["ab", "cd", "1"] and got[1] == "w x  w" and got[2] == "  , (cd) [1]. "


def test_stems():
    expected = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "adjustment": "adjust", "controll": "control", "roll": "roll"}
    assert {w: stem(w) for w in expected} == expected


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_indel_ratio(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    expected = 200.0 * table[-1, -1] / (len(a) + len(b)) if a or b else 100.0
    assert abs(indel_ratio(a, b) - expected) < 1e-9


def test_overlap_by_hand(spark):
    df = spark.createDataFrame([(1, ["neural net", "graph"], ["neural net model", "tree"]), (2, [], ["x"]), (3, ["a", "a"], ["a"]), (4, None, ["x"])], "id long, p array<string>, t array<string>")
    p, t = F.col("p"), F.col("t")
    got = {r["id"]: r for r in df.select("id", overlap.set_measures(p, t).alias("s"), overlap.loose_measures(p, t).alias("l"), overlap.rouge(p, t, 1).alias("r1"), overlap.rouge(p, t, 2).alias("r2"), overlap.diversity(p).alias("d"), overlap.meteor(p, t).alias("m"), overlap.self_bleu(p).alias("b")).collect()}
    assert tuple(got[1]["s"]) == (0.0, 0.0, 0.0) and tuple(got[3]["s"]) == (1.0, 1.0, 1.0)
    assert tuple(got[1]["l"]) == (0.5, 0.5, 0.5, 0.5)
    assert got[1]["r1"]["p"] == 2 / 3 and got[1]["r1"]["r"] == 0.5 and got[1]["r2"]["p"] == 0.5
    assert tuple(got[2]["d"]) == (0.0, 0.0, 1.0) and tuple(got[3]["d"]) == (0.5, 0.5, 0.5)
    assert got[2]["m"] == got[4]["m"] == got[2]["b"] == got[4]["b"] == 0.0 and tuple(got[4]["s"]) == (0.0, 0.0, 0.0)
    f, chunks = (2 / 3) * 0.5 / (0.9 * 2 / 3 + 0.1 * 0.5), 1
    assert math.isclose(got[1]["m"], f * (1 - 0.5 * (chunks / 2) ** 3))


def test_bleu_by_hand():
    same = "a b c d".split()
    assert math.isclose(overlap.bleu([same], same), 1.0) and overlap.bleu([["x"]], same) == 0.0
    want = (3 / 4 * 2 / 3 * 1 / 2) ** (1 / 3)
    assert math.isclose(overlap.bleu([["a", "b", "c", "e"]], same), want)
    assert math.isclose(overlap.bleu([["a", "b", "c", "d", "e"]], same), math.exp(1 - 5 / 4))
    assert overlap.meteor_of(["running"], ["runs"]) == 0.5


def test_noun_phrases_against_brute_force(spark):
    r = random.Random(11)
    kinds = {"NN": "N", "NNS": "N", "JJ": "J", "CD": "C"}
    docs = [(k, [r.choice(["a", "B", "b", "c-d", "e", "7", "a", "b", "."]) for _ in range(n)], [r.choice(["NN", "NNS", "JJ", "CD", "VB"][: r.choice([3, 5])]) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 9, 40, 60, 300, 400])]
    counts = {"a b": 3, "b a": 3, "B b a": 3, "a a": 1, "b b c-d": 9, "c-d 7": 0}
    want = set()
    for k, tokens, tags in docs:
        seen = set()
        for pos, m in enumerate(re.finditer("[NJ]+[NC]|N", "".join(kinds.get(t, "O") for t in tags))):
            run = tokens[m.start() : m.end()]
            if len(run) < 2 or "." in run:
                continue
            if len(run) > 3:
                parts = [" ".join(run[i : i + n]) for n in (2, 3) for i in range(len(run) - n + 1)]
                run = max((p for p in parts if counts.get(p)), key=counts.get, default="").split()
            phrase = " ".join(run)
            if phrase and phrase not in seen:
                seen.add(phrase)
                want.add((k, pos, phrase.lower()))
    odd = [(100, None, None), (101, ["a", None, "b"], ["NN", "NN"]), (102, ["a", "b"], None)]
    schema = "doc_id long, tokens array<string>, tags array<string>"
    known = spark.createDataFrame(list(counts.items()), "phrase string, n long")
    got = phrases.noun_phrases(spark.createDataFrame(docs + odd, schema), known, 2, 3).collect()
    assert {tuple(x) for x in got if x["doc_id"] < 100} == want and len(want) > 20
    assert {x["doc_id"] for x in got if x["doc_id"] >= 100} <= {101}
    assert phrases.noun_phrases(spark.createDataFrame([], schema)).count() == 0


def test_a_groups_references_are_no_rows(spark, monkeypatch):
    """In blocks of a few ids the best reference is that of all pairs, and each paper hands on a row a block."""
    from pyspark.sql import functions as F

    from sparsegrove.operators import triplets
    from sparsegrove.operators.training import pick_key

    monkeypatch.setattr(triplets, "BLOCK_IDS", 7)
    docs = spark.createDataFrame([("ab"[d % 2] if d < 60 else None if d == 60 else "alone", d) for d in range(62)], "source string, doc_id long")
    papers = docs.withColumnRenamed("doc_id", "paper")
    pairs = papers.join(docs, "source").where("paper <> doc_id").withColumn("k", pick_key(F.col("paper"), F.col("doc_id")))
    want = {r["paper"]: r["d"] for r in pairs.groupBy("paper").agg(F.min(F.struct("k", "doc_id"))["doc_id"].alias("d")).collect()}
    found = triplets.reference_in_group(papers, docs, "source")
    assert {r["paper"]: r["doc_id"] for r in found.collect()} == want and len(want) == 60


def test_smallest_hashes_of_pairs_are_those_of_hashlib():
    import hashlib
    import random

    from sparsegrove.functions import md5

    r = random.Random(5)
    for left, right in (
        ([str(r.randrange(10**7)).encode() for _ in range(40)], [str(r.randrange(10 ** r.randrange(1, 8))).encode() for _ in range(300)]),
        (["é" * k for k in range(30)], ["x" * k for k in range(40)] + ["é", "éé"]),
        (["7"], ["7"]),
    ):
        left, right = ([x.encode() if isinstance(x, str) else x for x in side] for side in (left, right))
        key = lambda a, b: hashlib.md5(b"0|" + a + b"|" + b).hexdigest()
        want = [min(((key(a, b), right.index(b)) for b in right if b != a), default=None) for a in left]
        assert [w and w[0] for w in want] == [g and g[0] for g in md5.smallest(left, right, b"0")]
        assert all(g is None or right[g[1]] == right[w[1]] for w, g in zip(want, md5.smallest(left, right, b"0")))


def test_negatives_pair_no_row_with_a_row(spark):
    from sparsegrove.operators import triplets

    members = spark.createDataFrame([(1, g, 10 * g + k) for g in range(4) for k in range(3)] + [(2, 9, 1), (2, 9, 2)], "paper long, group long, doc_id long")
    chosen = members.select("paper", "group").distinct()
    found = triplets.negatives_outside(chosen, members.select("paper", "doc_id"), members)
    got = {(r["paper"], r["group"]): r["negative"] for r in found.collect()}
    key = lambda g, d: __import__("hashlib").md5(f"0|{g}|{d}".encode()).hexdigest()
    assert got == {(1, g): min((10 * h + k for h in range(4) for k in range(3) if h != g), key=lambda d: key(g, d)) for g in range(4)}
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()  # groups times references, less the groups' own


def exchanges(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_postings_are_counted_where_the_texts_lie(spark):
    rows = [(k, f"a b a c{k % 3} " * (k % 4)) for k in range(30)] + [(30, None), (31, "")]
    for extra in ([], [(3, "a z"), (None, "a"), (None, "a")]):  # ids that repeat are one text
        texts = spark.createDataFrame(rows + extra, "doc_id long, text string")
        found = retrieval.postings(texts, search_tokens(F.col("text")))
        want = {}
        for k, text in rows + extra:
            for w in (text or "").split():
                want[k, w] = want.get((k, w), 0) + 1
        got = [((r["doc_id"], r["term"]), r["tf"]) for r in found.collect()]
        assert dict(got) == want and len(got) == len(want) and (exchanges(found) > 0) == bool(extra)


def test_weights_of_wanted_terms_alone(spark):
    posts = spark.createDataFrame([(d, f"t{(d * j) % 7}{j}", j + 1) for d in range(20) for j in range(4)], "doc_id long, term string, tf long")
    wanted = spark.createDataFrame([("t00",), ("t31",), ("none",)], "term string")
    every = {(r["doc_id"], r["term"]): r["weight"] for r in retrieval.bm25_impacts(posts).collect()}
    some = {(r["doc_id"], r["term"]): r["weight"] for r in retrieval.bm25_impacts(posts, wanted=wanted).collect()}
    assert some and some == {k: v for k, v in every.items() if k[1] in ("t00", "t31")}


def test_distinct_ngrams_do_not_shuffle(spark):
    rows = [(1, "a b a b".split()), (2, "a b".split()), (3, ["a"]), (4, None)]
    texts = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    found = phrases.distinct_ngrams(texts, 2)
    assert sorted(map(tuple, found.collect())) == [(1, "a b"), (1, "b a"), (2, "a b")] and exchanges(found) == 0
    again = phrases.distinct_ngrams(texts.unionAll(texts.where("doc_id = 2")), 2)
    assert sorted(map(tuple, again.collect())) == [(1, "a b"), (1, "b a"), (2, "a b")]


def test_texts_are_not_copied_for_each_word(spark):
    docs = spark.createDataFrame([(1, "xx one longest two yy"), (2, "one other two"), (None, "one longest two")], "doc_id long, text string")
    found = retrieval.contained_in(spark.createDataFrame([(7, "one longest two")], "query_id long, text string"), docs)
    assert sorted(map(tuple, found.collect()), key=str) == [(7, 1), (7, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan  # what holds a word is known before texts are met


def test_positions_of_phrases_equal_those_of_one(spark):
    from sparsegrove.functions.text import position_score, position_scores

    rows = spark.createDataFrame([("bathe cat \n the cat\x0bsat", ["the cat", "cat", "none", "", "sat"]), (None, ["a"]), ("", ["a"])], "text string, phrases array<string>")
    many = [list(r[0]) for r in rows.select(position_scores()("text", "phrases")).collect()]
    one = [list(r[0]) for r in rows.select(F.transform("phrases", lambda p: position_score(F.col("text"), p))).collect()]
    assert all(math.isclose(a, b, rel_tol=1e-12) for x, y in zip(many, one, strict=True) for a, b in zip(x, y, strict=True)) and [len(x) for x in many] == [5, 1, 1]


def test_a_text_meets_the_list_of_its_terms(spark):
    from sparsegrove.operators import keyphrases

    vectors = spark.createDataFrame([(1, "ab", 1.0), (1, "zz", 2.0), (2, "zz", 3.0), (3, "ab", 1.0)], "doc_id long, term string, weight double")
    texts = spark.createDataFrame([(1, "x AB y"), (2, None), (3, "none"), (3, "twice")], "doc_id long, text string")
    found = keyphrases.absent_scores(vectors, texts, spark.createDataFrame([("ab",), ("zz",)], "phrase string"))
    assert sorted(map(tuple, found.collect())) == [(1, "zz", 2.0), (3, "ab", 1.0), (3, "ab", 1.0)]
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


def test_merged_vectors_are_dealt_by_their_number(spark, monkeypatch):
    a = spark.range(300).selectExpr("id % 50 AS doc_id", "id AS term", "CAST(id AS DOUBLE) AS weight")
    monkeypatch.setattr(sparse, "PART_ROWS", 20)
    found = sparse.merge_max(a, a.selectExpr("doc_id", "term + 1 AS term", "weight + 5 AS weight"))
    assert found.rdd.getNumPartitions() == 31 and found.count() == 600  # a term lies in one document each


def test_co_occurrence_equals_brute_force_by_every_way(spark, monkeypatch):
    """Rare items, items of many pairs and large groups go different ways and give the same ranks; a null item is one too."""
    r = random.Random(4)
    members = [(g, r.choice([1, 1, 1, 2, 2, *range(3, 30), None])) for g in [*range(60), None] for _ in range(r.randint(1, 8))]
    n = {}
    for g, a in members:
        for h, b in members:
            if g == h and g is not None:
                n[a, b] = n.get((a, b), 0) + 1
    want = []
    for item in {a for a, _ in n}:
        best = sorted(((-c, b is None, b or 0, b) for (a, b), c in n.items() if a == item))[:4]
        want += [(item, b, -c, i) for i, (c, _, _, b) in enumerate(best, 1)]
    df = spark.createDataFrame(members, "g long, item long")
    key = lambda x: tuple((v is None, v or 0) for v in x)
    for most, large in ((1 << 20, 4096), (20, 4096), (20, 3)):
        monkeypatch.setattr(training, "PART_PAIRS", most)
        monkeypatch.setattr(training, "LARGE_GROUP", large)
        found = training.co_occurring(df, "g", "item", 4)
        assert sorted((tuple(x) for x in found.select("item", "other", "n", "rank").collect()), key=key) == sorted(want, key=key)


def test_co_occurring_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Parts grow with the pairs: each task ranks about so many, whatever the session's number of shuffle partitions."""
    monkeypatch.setattr(training, "PART_PAIRS", 100)
    df = spark.range(4000).select((F.col("id") % 1000).alias("g"), F.col("id").alias("item"))
    assert training.co_occurring(df, "g", "item", 2).rdd.getNumPartitions() >= 160


def dense_brute(queries, docs, k, digits):
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) + 1e-9) for x in v]
    out = []
    for q, v in queries:
        scores = [(None if w is None or None in w or len(w) != len(v) else sum(a * b for a, b in zip(unit(v), unit(w))), d) for d, w in docs]
        scores = [(None if s is None else round(s, digits), d) for s, d in scores]
        best = sorted((s is None, -(s or 0), d) for s, d in scores)[:k]
        out += [(q, d, None if none else -s, i) for i, (none, s, d) in enumerate(best, 1)]
    return sorted(out, key=lambda x: (x[0], x[3]))


def test_dense_search_hands_on_k_a_task_and_keeps_ties_and_nulls(spark, monkeypatch):
    """Copies tie by id in and between tasks, odd vectors come last, and no pair of all documents is a row."""
    monkeypatch.setattr(retrieval, "PAIRS_AT_ONCE", 64)
    r = np.random.default_rng(3)
    base = [[float(x) for x in r.integers(-3, 4, 5)] for _ in range(30)]
    docs = [(int(d), base[d % 30]) for d in r.permutation(300)] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0]), (1002, [1.0, 2.0]), (1003, [0.0] * 5)]
    queries = [(f"q{i}", [float(x) for x in r.integers(-3, 4, 5)]) for i in range(6)]
    q, d = spark.createDataFrame(queries, "query_id string, v array<double>"), spark.createDataFrame(docs, "doc_id long, v array<double>").repartition(3)
    for k in (1, 7, 400):
        found = retrieval.dense_search(q, d, k, digits=8)
        got = sorted((tuple(x) for x in found.select("query_id", "doc_id", "score", "rank").collect()), key=lambda x: (x[0], x[3]))
        assert got == dense_brute(queries, docs, k, 8)
    assert "CartesianProduct" not in (plan := retrieval.dense_search(q, d, 7)._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)  # the way of many queries
    many = retrieval.dense_search(q, d.where("doc_id < 1000"), 7, digits=8)
    assert sorted((tuple(x) for x in many.select("query_id", "doc_id", "score", "rank").collect()), key=lambda x: (x[0], x[3])) == dense_brute(queries, docs[:300], 7, 8)


def test_half_up_rounds_as_spark(spark):
    x = np.array([0.5, 1.5, -2.5, 0.125, 0.000000005, 1.005, 2.675, -0.0, np.nan, np.inf, 123456789.987654325, 1e300])
    for digits in (0, 2, 8):
        want = [r["x"] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", digits).alias("x")).orderBy("i").collect()]
        np.testing.assert_array_equal(retrieval.half_up(x, digits), want)
