"""Malformed input and round trips of the file formats."""

from sparsegrove.sources import files


def test_tsv(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("q\tp\tn\nonly\ttwo\na\tb\tc\td\n q2 \tp2\tn2\n")
    rows, faulty = files.tsv(spark, str(tmp_path / "t.tsv"), "query", "pos", "neg")
    assert sorted(map(tuple, rows.collect())) == [("q", "p", "n"), ("q2", "p2", "n2")] and faulty.first()["n"] == 2
    assert sorted(map(tuple, files.collection(spark, str(tmp_path / "t.tsv")).collect())) == [("a", "b c d"), ("only", "two"), ("q", "p n"), ("q2", "p2 n2")]


def test_json_and_qrels(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "1", "title": "t", "text": "x"}\n{broken\n{"id": "2", "text": "y"}\n')
    assert sorted(map(tuple, files.corpus_jsonl(spark, str(tmp_path / "c.jsonl")).collect())) == [("1", "t", "x"), ("2", "", "y")]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\t2\t1\n")
    assert list(map(tuple, files.qrels_tsv(spark, str(tmp_path / "q.tsv")).collect())) == [("1", "2", 1)]
    (tmp_path / "r.txt").write_text("1 Q0 7 1 3.5 tag\n1 Q0 8 2 3.0 tag\nbad\n")
    assert list(map(tuple, files.trec_run(spark, str(tmp_path / "r.txt"), 1).collect())) == [("1", "7", 1, 3.5)]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb"), (2, None)], "x long, y string")
    files.write_tsv(df, str(tmp_path / "out"))
    back, faulty = files.tsv(spark, str(tmp_path / "out"), "x", "y")
    assert sorted(map(tuple, back.collect())) == [("1", "a b"), ("2", "")] and faulty.first()["n"] == 0
    files.write_vectors(spark.createDataFrame([(1, "t", 3), (1, "s", 2)], "doc_id long, term string, weight long"), str(tmp_path / "v"))
    row = spark.read.schema("id string, vector map<string,int>").json(str(tmp_path / "v")).first()
    assert row["vector"] == {"t": 3, "s": 2}


def test_more_formats(spark, tmp_path):
    at = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert list(map(tuple, files.trec_qrels(spark, at("q", "1 0 7 2\nbad\n")).collect())) == [("1", "7", 2)]
    rows, faulty = files.distillation_tsv(spark, at("d", "q\tp\tn\t1.5\tx\nq\tp\n"))
    assert list(map(tuple, rows.collect())) == [("q", "p", "n", 1.5, None)] and faulty.first()["n"] == 1
    scores = files.score_json(spark, at("s", '{"1": {"a": 2.0, "b": 3.0, "c": 3.0}, "2": {"a": 1.0}}'))
    assert {(r["query_id"], r["doc_id"]) for r in scores.where("rank <= 2").collect()} == {("1", "b"), ("1", "c"), ("2", "a")}
    qrels = spark.createDataFrame([("1", "b", 1), ("2", "a", 1)], "query_id string, doc_id string, rel int")
    assert {r["query_id"] for r in files.teacher_scores(scores, qrels, 2).collect()} == {"1"}
    assert sorted(map(tuple, files.phrase_postings(spark, at("p", '{"x": ["1", "2", "1"], "y": []}')).collect())) == [("x", "1"), ("x", "2")]
    good, bad = files.tolerant_jsonl(spark, at("t", '{"a": 1}\n{"a": \n'), "a int")
    assert [r["a"] for r in good.collect()] == [1] and bad.first()["n"] == 1
    asked = files.judged_queries(spark, at("j", '{"_id": "1", "text": "x"}\n{"_id": "9", "text": "y"}\n'), qrels)
    assert list(map(tuple, asked.collect())) == [("1", "x")]
    files.write_repeated_terms(spark.createDataFrame([(1, "t", 2), (1, "s", 1)], "doc_id long, term string, weight long"), str(tmp_path / "o"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["1\ts t t"]
    for _ in range(2):
        files.append_chunk(qrels, str(tmp_path / "c"), 3)
    assert spark.read.json(str(tmp_path / "c")).where("chunk = 3").count() == 2
