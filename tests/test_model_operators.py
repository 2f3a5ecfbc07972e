"""Keyphrase, triplet, port and file operators on small rows with known answers."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegrove.functions import text as T
from sparsegrove.operators import evaluation as E
from sparsegrove.operators import keyphrases as K
from sparsegrove.operators import losses as L
from sparsegrove.operators import ports as M
from sparsegrove.operators import triplets as N
from sparsegrove.sources import files as S


def test_normalised_and_split(spark):
    rows = spark.createDataFrame([(1, ["deep", "neural", "networks", "learning"], ["Neural-Networks", "neural network", "(deep)", "", "graphs"], ["deep", "neural networks", "deep"]), (2, [], [], [])], "doc_id long, source array<string>, predictions array<string>, targets array<string>")
    got = {r["doc_id"]: r for r in K.prepared(K.normalised(rows, "source", "predictions", "targets")).collect()}
    assert got[1]["predictions"][0] == "neural network" and got[1]["repeated_predictions"] == 1 and got[1]["repeated_targets"] == 1
    split = {(r["doc_id"][0], r["doc_id"][1]): r for r in K.split_by_source(K.prepared(K.normalised(rows, "source", "predictions", "targets"))).collect()}
    assert split[1, "present"]["predictions"] == ["neural network", "deep"] and split[1, "absent"]["targets"] == [] and len(split) == 6
    valid = spark.createDataFrame([("a b", 1), ("a <unk>", 0), (",", 0), (". x", 0), ("", 0)], "p string, good int")
    assert all(r["v"] == bool(r["good"]) for r in valid.select("good", K.valid_phrase(F.col("p")).alias("v")).collect())
    scores = K.exact_scores(K.prepared(K.normalised(rows, "source", "predictions", "targets"), valid_only=True), [2])
    own = next(r for r in scores.collect() if r["doc_id"] == 1 and r["subset"] == "present")
    assert own["precision"] == own["recall"] == 1.0
    assert set(K.MEASURES) == {"exact", "approximate", "set", "rouge", "diversity"} and all(K.measure(n, rows).count() for n in K.MEASURES)


def test_alpha_ndcg_against_every_order(spark):
    from itertools import permutations

    r = np.random.default_rng(3)
    rows = [(k, ["".join(r.choice(list("ab"), r.integers(1, 4))) for _ in range(r.integers(0, 5))], ["".join(r.choice(list("ab"), r.integers(1, 3))) for _ in range(r.integers(0, 4))]) for k in range(40)]
    got = {x["doc_id"]: x["m"] for x in spark.createDataFrame(rows, "doc_id long, p array<string>, t array<string>").select("doc_id", K.alpha_ndcg(3)("p", "t").alias("m")).collect()}
    for k, p, t in rows:
        hit = lambda a, b: float(a in b or b in a)

        def dcg(order):
            seen, out = {b: 0 for b in range(len(t))}, 0.0
            for j, i in enumerate(order[:3]):
                for b in seen:
                    out += hit(p[i], t[b]) * 0.5 ** seen[b] / np.log2(j + 2)
                for b in seen:
                    seen[b] += hit(p[i], t[b])
            return out

        best = max((dcg(o) for o in permutations(range(len(p)))), default=0)
        if best:
            assert got[k] >= dcg(range(len(p))) / best - 1e-9  # the greedy ideal is never above the best order
        else:
            assert got[k] == 0


def test_rouge_l():
    def slow(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (r.choice(list("abcd"), r.integers(0, 20)).tolist() for _ in range(2))
        assert K.common_subsequence(a, b) == slow(a, b)


def test_annotated_papers(spark):
    text = "Title here. Abstract text. Cites A, B and later C."
    note = {"title": json.dumps([{"start": 0, "end": 10}]), "abstract": json.dumps([{"start": 12, "end": 26}]),
            "bibentry": json.dumps([{"start": 1, "end": 2, "attributes": {"id": f"b{i}", "matched_paper_id": 100 + i}} for i in range(3)] + [{"start": 1, "end": 2, "attributes": {"id": "b9"}}]),
            "bibref": json.dumps([{"start": s, "end": s + 1, "attributes": {"ref_id": f"b{i}"}} for i, s in ((0, 33), (1, 36), (2, 48), (9, 40))])}
    rows = spark.createDataFrame([(7, (text, (note["title"], note["abstract"], note["bibentry"], note["bibref"]))), (8, ("x", (None, None, None, None)))], "corpusid long, content struct<text:string,annotations:struct<title:string,abstract:string,bibentry:string,bibref:string>>")
    got = {r["paper"]: r for r in N.annotated_papers(rows).collect()}
    assert got[7]["title"] == "Title here" and got[7]["abstract"] == "Abstract text."
    assert got[7]["groups"] == [[100, 101], [102]] and got[7]["references"] == [100, 101, 102]
    assert got[8]["groups"] == [] and got[8]["title"] == ""


def test_fetch_in_batches(spark):
    ids, known = spark.range(1230).withColumnRenamed("id", "doc_id"), spark.range(30).withColumnRenamed("id", "doc_id")

    def request(batch):
        assert len(batch) <= 100
        return [{"doc_id": i, "title": f"t{i}"} if i % 10 else None for i in batch]

    got = N.fetch(N.to_fetch(ids, known), "doc_id long, title string", request, 100).collect()
    assert len(got) == 1080 and all(r["title"] == f"t{r['doc_id']}" for r in got)


def test_ports(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["red apple", "green apple", "blue sea", None, ""])], "doc_id long, text string")
    vectors = M.encode(docs, M.get_encoder("hashed"))
    got = {r["doc_id"]: np.array(r["v"]) for r in vectors.collect()}
    assert len(got) == 5 and got[0] @ got[1] > got[0] @ got[2] and not got[3].any()
    with pytest.raises(KeyError):
        M.get_encoder("none")
    queries = spark.createDataFrame([(9, "red apple")], "query_id long, query string")
    run = spark.createDataFrame([(9, k, float(k), k + 1) for k in range(3)], "query_id long, doc_id long, score double, rank int")

    def scorer():
        return lambda pairs: np.array([len(set(q.split()) & set(t.split())) for q, t in pairs], float)

    best = M.rerank_runs({"x": run}, queries, docs, scorer, 2)["x"].orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in best] == [(0, 2.0), (1, 1.0)]

    def judge():
        return lambda rows: np.array([len(set(q.split()) & set(a.split())) - len(set(q.split()) & set(b.split())) for q, a, b in rows], float)

    won = {r["doc_id"]: r["score"] for r in M.prompt_preferences(run, queries, docs, judge).collect()}
    assert won[0] > won[1] > won[2] and abs(won[0] - 2.001) < 1e-9

    def tokens():
        words = {}
        return lambda texts: [np.array([np.eye(50)[words.setdefault(w, len(words))] for w in t.split()]).reshape(-1, 50) for t in texts]

    rows = spark.createDataFrame([(1, "a b c", "a b d d"), (2, "", "x"), (3, "a", "a")], "doc_id long, prediction string, target string")
    got = {r["doc_id"]: r for r in M.token_match_measures(rows, tokens, size=1).collect()}
    assert abs(got[1]["precision"] - 2 / 3) < 1e-9 and got[1]["recall"] == 0.5 and got[2]["f1"] == 0 and got[3]["f1"] == 1
    asked = M.questions(spark.createDataFrame([(1, "p", "s"), (2, "", "s")], "doc_id long, phrases string, source string"), {"fit": "does {phrases} fit {source}?", "good": "is {source} good?"})
    scores = {(r["doc_id"], r["aspect"]): r["score"] for r in M.judged_aspects(asked, lambda: lambda qs: np.array([[1.0, 0.0] if "fit" in q else [0.0, 0.0] for q in qs])).collect()}
    assert abs(scores[1, "fit"] - 1 / (1 + np.exp(-1))) < 1e-9 and scores[2, "fit"] == 0 and scores[2, "good"] == 0.5
    pooled = spark.createDataFrame([([[1.0, 4.0], [3.0, 2.0]],), ([],)], "t array<array<double>>").select(*(M.pool_tokens(F.col("t"), h).alias(h) for h in ("mean", "max", "cls"))).collect()
    assert pooled[0] == ([2.0, 3.0], [3.0, 4.0], [1.0, 4.0]) and pooled[1] == (None, None, None)
    masked = spark.createDataFrame([("An apple and an APPLE.", "apple"), ("none", "apple"), ("a.b a.b", "a.b")], "t string, p string").select(M.mask_occurrence(F.col("t"), F.col("p")).alias("m")).collect()
    assert masked[0]["m"] in ("An [MASK] and an APPLE.", "An apple and an [MASK].") and masked[1]["m"] is None and masked[2]["m"] in ("[MASK] a.b", "a.b [MASK]")


def test_named_measures():
    assert E.named("ndcg_cut_10") == ("ndcg", 10) and E.named("recall_100") == ("recall", 100) and E.named("MRR@10") == ("rr", 10) and E.named("map") == ("ap", E.WHOLE)
    with pytest.raises(ValueError):
        E.named("unknown_3")
    with pytest.raises(ValueError):
        E.check_grades("ndcg_cut_10", binary=True)
    E.check_grades("recall_10", binary=True)


def test_early_stopping_of_a_loss(spark):
    rows = spark.createDataFrame([("r", k, v) for k, v in enumerate([3.0, 2.0, 2.5, 2.4, 1.0])], "run string, step int, value double")
    got = [(r["better"], r["best_step"], r["stop"]) for r in L.early_stopping(rows, 2, "min").orderBy("step").collect()]
    assert got == [(True, 0, False), (True, 1, False), (False, 1, False), (False, 1, True), (True, 4, False)]


def test_file_formats(spark, tmp_path):
    for year in ("91", "92"):
        (tmp_path / "arx" / year / "deep").mkdir(parents=True)
        (tmp_path / "arx" / year / "deep" / "a.jsonl").write_text(json.dumps({"paper_id": year}) + "\n")
    got = S.year_folders(spark, f"{tmp_path}/arx", ["91", "92"], "paper_id string").collect()
    assert sorted(map(tuple, got)) == [("91", "91"), ("92", "92")]
    with gzip.open(tmp_path / "s.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps({"corpusid": k}) for k in range(20)))
    shards = S.paper_shards(spark, f"{tmp_path}/s.jsonl.gz", "corpusid long", 4)
    assert shards.count() == 20 and shards.rdd.getNumPartitions() == 4
    rows = spark.createDataFrame([(1, "Deep Nets", "on graphs", "deep nets; Graphs;; robots")], "id long, title string, abstract string, keywords string")
    kp = S.benchmark(rows, "semicolon").first()
    assert kp["present"] == ["deep nets", "graphs"] and kp["absent"] == ["robots"]
    assert S.union_benchmarks({"a": S.benchmark(rows, "semicolon"), "b": S.benchmark(rows, "semicolon")}).count() == 2
    assert S.document_text(spark.createDataFrame([(1, bytearray("é".encode("latin-1")), "u")], "doc_id long, body binary, url string")).first()["text"] == "é u"
    (tmp_path / "q.json").write_text(json.dumps({"1": ["a", "b"], "2": ["c"]}))
    (tmp_path / "q1.json").write_text(json.dumps({"1": "a"}))
    assert S.query_lists(spark, f"{tmp_path}/q.json").count() == 3 and S.query_lists(spark, f"{tmp_path}/q1.json").first()["query"] == "a"
    run = spark.createDataFrame([("q", "d1", 2.0), ("q", "d2", 1.0)], "query_id string, doc_id string, score double")
    S.write_run(run, f"{tmp_path}/run")
    assert sorted(map(tuple, S.read_run(spark, f"{tmp_path}/run").collect())) == sorted(map(tuple, run.collect()))
    terms, corpus = spark.createDataFrame([("a", 1, 0.5)], "term string, df long, idf double"), spark.createDataFrame([(3, 2.0)], "n_docs long, avg_len double")
    S.write_corpus_statistics(terms, corpus, f"{tmp_path}/bm25")
    back = S.read_corpus_statistics(spark, f"{tmp_path}/bm25")
    assert back[0].collect() == terms.collect() and back[1].collect() == corpus.collect()
    vectors = spark.createDataFrame([(1, 5, 2.0), (1, 3, 1.0), (2, 3, 4.0)], "doc_id long, term long, weight double")
    assert sorted(map(tuple, S.from_compressed(S.compressed_rows(vectors)).collect())) == sorted(map(tuple, vectors.collect()))
    S.write_performance(spark.createDataFrame([("x", "map", 0.5)], "dataset string, measure string, value double"), f"{tmp_path}/perf")
    assert json.loads(next((tmp_path / "perf").glob("*.json")).read_text()) == {"dataset": "x", "measures": {"map": 0.5}}
    assert S.missing_shards(spark.createDataFrame([("a",), ("b",)], "shard string"), spark.createDataFrame([("a",)], "shard string")).collect()[0]["shard"] == "b"


def test_small_functions(spark):
    row = spark.createDataFrame([("(Deep) of a,", {"x_a": "1", "b": "2"}, "neural nets", 40_000)], "t string, m map<string,string>, p string, n int")
    got = row.select(T.long_tokens(F.col("t")).alias("t"), T.without_prefix(F.col("m"), "x_").alias("w"), T.with_prefix(F.col("m"), "x_").alias("k"), T.rename_keys(F.col("m"), {"b": "c"}).alias("r"), T.multi_word(F.col("p"), F.col("n"), 30_522).alias("many"), T.at_most_words(F.col("p"), 1).alias("few")).first()
    assert (got["t"], got["w"], got["k"], got["r"], got["many"], got["few"]) == (["deep"], {"b": "2"}, {"a": "1"}, {"x_a": "1", "c": "2"}, True, False)
    assert N.metadata_text is not None


def test_collections_keep_digits_at_the_ends(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("7\t0 zero 0\t 1 one 1 \nx\n")
    assert [tuple(r) for r in S.collection(spark, f"{tmp_path}/c.tsv").collect()] == [("7", "0 zero 0 1 one 1")]


def test_semantic_measures_in_blocks(spark, monkeypatch):
    """Sides that several tasks share give what one block gives; phrases without a vector match only themselves."""
    r = np.random.default_rng(2)
    lists = [(1, [f"w{k}" for k in range(40)] + ["none", "w1"], [f"w{k}" for k in range(30, 90)] + ["none", "other"]), (2, ["w1"], []), (3, ["w5"], ["w6"])]
    rows = spark.createDataFrame(lists, "doc_id long, predictions array<string>, targets array<string>")
    table = {f"w{k}": r.normal(size=4) for k in range(90)}
    vectors = spark.createDataFrame([(p, v.tolist()) for p, v in table.items()], "phrase string, v array<double>")

    def similar(a, b):
        return 1.0 if a == b else float(table[a] @ table[b] / np.linalg.norm(table[a]) / np.linalg.norm(table[b])) if a in table and b in table else 0.0

    def mean(own, other):
        best = [max((similar(a, b) for b in set(other)), default=0.0) for a in set(own)]
        return sum(x for x in best if x > 0.2) / max(len(best), 1)

    monkeypatch.setattr(M, "SIDE_BLOCK", 9)
    plain = M.semantic_measures(rows, vectors, 0.2)
    assert "FlatMapCoGroupsInArrow" in plain._jdf.queryExecution().toString()
    got = {x["doc_id"]: x for x in plain.collect()}
    for k, p, t in lists:
        assert abs(got[k]["precision"] - mean(p, t)) < 1e-6 and abs(got[k]["recall"] - mean(t, p)) < 1e-6, k
