"""The training loop: derivatives, batches, resumed runs, and that the loss falls on triplets of texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsegrove.operators import encoder_training as T
from sparsegrove.operators import index, retrieval


def some_rows(n=9, dim=32, seed=0):
    r = np.random.default_rng(seed)
    lists = [[r.integers(0, dim, int(r.integers(0, 12))).astype(np.int32) for _ in range(n)] for _ in range(3)]
    return pa.record_batch([*(pa.array(x, pa.list_(pa.int32())) for x in lists), pa.array(r.standard_normal(n)), pa.array(r.standard_normal(n))], names=["query", "positive", "negative", "t_pos", "t_neg"])


@pytest.mark.parametrize("loss", sorted(T.LOSSES))
def test_derivatives_equal_differences(loss):
    rows, w = some_rows(), np.random.default_rng(1).standard_normal(32) + 0.7
    value, sums = T.derivatives(rows, w, loss)
    for word in range(0, 32, 3):
        if abs(w[word]) < 1e-3:
            continue
        up, down = w.copy(), w.copy()
        up[word] += 1e-5
        down[word] -= 1e-5
        slope = (T.derivatives(rows, up, loss)[0] - T.derivatives(rows, down, loss)[0]) / T.UNIT / 2e-5
        assert slope == pytest.approx(sums[0][word] / T.UNIT, abs=1e-3)


def test_sums_do_not_depend_on_the_split():
    rows, w = some_rows(40), np.ones(32)
    whole = next(T.gradient_batches([rows], w, "pairwise_nll")).to_pydict()
    parts = [next(T.gradient_batches([rows.slice(a, b)], w, "pairwise_nll")).to_pydict() for a, b in ((0, 7), (7, 30), (37, 3))]
    sums = {}
    for p in parts:
        for k, word in enumerate(p["word"]):
            sums[word] = sums.get(word, np.zeros(5, np.int64)) + np.array([p[c][k] for c in ("gradient", "query", "query_slope", "document", "document_slope")])
    assert {w: tuple(s) for w, s in sums.items()} == {word: tuple(whole[c][k] for c in ("gradient", "query", "query_slope", "document", "document_slope")) for k, word in enumerate(whole["word"])}


def triplets(spark, n=240):
    r = np.random.default_rng(3)
    noise = [f"common{k}" for k in range(12)]
    rows = []
    for k in range(n):
        topic = [f"topic{(k + s) % 40}" for s in range(2)]
        text = lambda own: " ".join(r.permutation([*own, *r.choice(noise, int(r.integers(6, 40)))]))
        rows.append((text(topic), text(topic), text([f"topic{(k + 17) % 40}"])))
    return spark.createDataFrame(rows + [(None, "a", "b"), ("", "", "")], "query string, positive string, negative string")


def test_batches_hold_like_lengths(spark):
    rows = T.examples(triplets(spark), 256)
    dealt = T.batches(rows, 500, "s").cache()
    by = dealt.groupBy("batch").agg(F.min("tokens").alias("lo"), F.max("tokens").alias("hi"), F.sum("tokens").alias("n")).collect()
    assert all(r["hi"] < 2 * max(r["lo"], 1) for r in by) and dealt.count() == 242 and len(by) > 10
    again = T.batches(rows, 500, "s")
    assert again.exceptAll(dealt).count() == 0 and T.batches(rows, 500, "t").exceptAll(dealt).count() > 0


def test_loss_falls_and_a_resumed_run_equals_a_whole_one(spark, tmp_path):
    settings = T.Settings(dim=512, batch_tokens=3000, epochs=2, rate=0.2, warm_up=2, flops_query=1e-3, flops_document=1e-3, save_every=2, keep=0.8)
    data = triplets(spark)
    whole = T.train(data, settings)
    assert whole.step == len(whole.losses) > 8 and np.mean(whole.losses[-4:]) < 0.7 * np.mean(whole.losses[:4])
    folder = str(tmp_path / "ck")
    T.train(data, settings, folder, stop_after=3)
    part = T.State.load(spark, folder, 512)
    assert part.step == 3
    resumed = T.train(data.repartition(3), settings, folder)
    assert resumed.losses == whole.losses and np.array_equal(resumed.weights, whole.weights) and np.array_equal(resumed.best, whole.best)
    assert (resumed.best_step, resumed.best_average) == (whole.best_step, whole.best_average)
    assert [r["step"] for r in T.history(spark, whole, 0.8).where("best").collect()] == [whole.best_step]
    # words that tell topics apart weigh more than those that all texts share
    word = lambda w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(512))).first()[0]
    assert np.mean([whole.weights[word(f"topic{k}")] for k in range(40)]) > np.mean([whole.weights[word(f"common{k}")] for k in range(12)])


def test_trained_vectors_are_searched_from_the_index(spark):
    weights = np.ones(1 << 10)
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple plum"), (3, None)], "doc_id long, text string")
    vectors = T.encode(docs, weights)
    assert vectors.where("doc_id = 2").agg(F.max("weight")).first()[0] == pytest.approx(np.log1p(np.log1p(2)))
    asked = T.encode(spark.createDataFrame([("q", "plum")], "query_id string, text string"), weights, "query_id")
    assert [r["doc_id"] for r in retrieval.indexed_search(index.written(vectors), asked, 5).collect()] == [2]


def test_a_step_is_one_job_of_one_stage(spark, tmp_path):
    T.batches(T.examples(triplets(spark), 256), 1 << 20, "s").coalesce(2).write.parquet(str(tmp_path / "rows"))
    rows, state, context = spark.read.parquet(str(tmp_path / "rows")), T.State(256), spark.sparkContext
    context.setJobGroup("one step", "one step")
    T.step(rows, state, 1, T.Settings(dim=256))
    context.setLocalProperty("spark.jobGroup.id", None)
    jobs = context.statusTracker().getJobIdsForGroup("one step")
    assert state.step == 1 and len(jobs) == 1 and len(context.statusTracker().getJobInfo(jobs[0]).stageIds) == 1


def test_steps_that_follow_each_other_share_a_job(spark, tmp_path, monkeypatch):
    settings = T.Settings(dim=256, batch_tokens=800, epochs=2)
    data, context = triplets(spark), spark.sparkContext
    context.setJobGroup("chunks", "chunks")
    together = T.train(data, settings)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert together.step > 30 and len(context.statusTracker().getJobIdsForGroup("chunks")) < together.step
    # batches too large for a chunk take a job of many tasks each, and give the same weights to the last bit
    monkeypatch.setattr(T, "CHUNK_TOKENS", 0)
    apart = T.train(data, settings)
    assert apart.losses == together.losses and np.array_equal(apart.weights, together.weights) and np.array_equal(apart.best, together.best)
    assert T.in_chunks([3, 1, 2], {1: 5, 2: 5, 3: 5}, 0, 2) == [[3], [1], [2]]
