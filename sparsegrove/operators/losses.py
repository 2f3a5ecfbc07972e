"""Losses of batches and lists of scores, regularisers, sampling with teachers, early stopping: evaluation as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .training import log_sum_exp, pick_key

#: Sums of in-batch losses: (score column, with the hard negative's score or 0 in its place, weight, scaled).
PHRASE_LOSSES: dict[str, list[tuple[str, bool, float, bool]]] = {
    "v1": [("score", False, 1.0, False), ("score_tokens", True, 0.1, False)],
    "v1_1": [("score", False, 1.0, False), ("score_tokens", True, 1.0, False)],
    "v2": [("score_phrases", False, 1.0, False), ("score_tokens", True, 1.0, False)],
    "v2_1": [("score_phrases", False, 0.1, False), ("score_tokens", True, 1.0, False)],
    "v2_2": [("score_phrases", False, 2.0, False), ("score_tokens", True, 1.0, False)],
    "v3": [("score_phrases", False, 1.0, True), ("score_tokens", True, 1.0, True)],
    "v4": [("score_phrases", True, 1.0, False), ("score_tokens", True, 1.0, False)],
    "no_hard_negative": [("score", False, 1.0, False)],
    "max_sim_mix": [("score_tokens", True, 1.0, False), ("score", True, 0.1, False)],
}


def in_batch_loss(own: DataFrame, negatives: DataFrame, column: str, hard: bool, scaled: bool = False) -> DataFrame:
    """One row (value): the mean over (batch, i) of -log softmax of the score at i = j among row i and its negative.

    own: (batch, i, j, scores); negatives: (batch, i, scores), one row each.  Without ``hard`` a 0 stands for the
    negative's score.  scaled: scores count times the column scale.  The sums are kept around each row's largest
    score, in one aggregation by (batch, i).  Rows without their own score are left out.
    """
    factor = F.col("scale") if scaled else F.lit(1.0)
    neg = negatives.select("batch", "i", (F.col(column) * factor if hard else F.lit(0.0)).alias("_neg"))
    rows = own.select("batch", "i", "j", (F.col(column) * factor).alias("_s")).join(neg, ["batch", "i"])
    lists = rows.groupBy("batch", "i").agg(F.collect_list("_s").alias("s"), F.max(F.when(F.col("i") == F.col("j"), F.col("_s"))).alias("own"), F.max("_neg").alias("neg"))
    loss = log_sum_exp(F.concat("s", F.array("neg"))) - F.col("own")
    return lists.where("own IS NOT NULL").agg(F.avg(loss).alias("value"))


def phrase_losses(own: DataFrame, negatives: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(loss, value) of the named weighted sums of in-batch losses."""
    out = None
    for name in PHRASE_LOSSES if names is None else names:
        total = None
        for column, hard, weight, scaled in PHRASE_LOSSES[name]:
            part = in_batch_loss(own, negatives, column, hard, scaled).select((F.lit(weight) * F.col("value")).alias("value"))
            total = part if total is None else total.unionAll(part)
        row = total.agg(F.sum("value").alias("value")).select(F.lit(name).alias("loss"), "value")
        out = row if out is None else out.unionAll(row)
    return out


def distillation_losses(lists: DataFrame, weights: tuple[float, float, float] = (0.01, 0.05, 0.99)) -> DataFrame:
    """One row (contrastive, mse_margin, kldiv, total) of (scores, teacher): arrays, the positive first.

    contrastive: -log softmax of the first score; mse_margin: the mean squared difference of all margins of
    students and teachers; kldiv: of the teacher's softmax from the student's.
    """
    n = F.size("scores")
    # the margins' squares need no pairs: with x = student - teacher, the mean of (x_a - x_b)^2 is 2 (mean x^2 - mean(x)^2)
    x = F.zip_with("scores", "teacher", lambda s, t: s - t)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    mse = 2 * (mean(F.transform(x, lambda v: v * v)) - F.pow(mean(x), 2))
    ls, lt = log_sum_exp(F.col("scores")), log_sum_exp(F.col("teacher"))
    rows = lists.withColumns({"_ls": ls, "_lt": lt})
    kl = F.aggregate(F.zip_with("scores", "teacher", lambda s, t: F.exp(t - F.col("_lt")) * ((t - F.col("_lt")) - (s - F.col("_ls")))), F.lit(0.0), lambda s, v: s + v)
    out = rows.agg(F.avg(F.col("_ls") - F.element_at("scores", 1)).alias("contrastive"), F.avg(mse).alias("mse_margin"), F.avg(kl).alias("kldiv"))
    total = sum(F.lit(w) * F.col(c) for w, c in zip(weights, ("contrastive", "mse_margin", "kldiv")))
    return out.withColumn("total", total)


def regularisers(vectors: DataFrame) -> DataFrame:
    """(batch, flops, l1, anti_zero) of (batch, doc_id, term, weight).

    flops: the sum over terms of the squared mean absolute weight; l1: the mean sum of absolute weights;
    anti_zero: one over the squared sum of all weights.
    """
    n = vectors.groupBy("batch").agg(F.countDistinct("doc_id").alias("n"))
    terms = vectors.groupBy("batch", "term").agg(F.sum(F.abs("weight")).alias("a"), F.sum("weight").alias("s"))
    rows = terms.join(n, "batch")
    return rows.groupBy("batch").agg(F.sum(F.pow(F.col("a") / F.col("n"), 2)).alias("flops"), (F.sum("a") / F.first("n")).alias("l1"), (1 / F.pow(F.sum("s"), 2)).alias("anti_zero"))


def teacher_samples(positives: DataFrame, scores: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """(query_id, positive, positive_score, negative, negative_score): a positive and up to n negatives a query, by hash.

    positives: (query_id, doc_id); scores: (query_id, doc_id, score).  A positive without a score gets the best
    score of its query.
    """
    best = scores.groupBy("query_id").agg(F.max("score").alias("best"))
    order = Window.partitionBy("query_id").orderBy(pick_key(F.col("query_id"), F.col("doc_id"), seed=seed), "doc_id")
    one = positives.select("query_id", "doc_id").distinct().withColumn("_r", F.row_number().over(order)).where("_r = 1")
    one = one.join(scores, ["query_id", "doc_id"], "left").join(best, "query_id").select("query_id", F.col("doc_id").alias("positive"), F.coalesce("score", "best").alias("positive_score"))
    rest = scores.join(positives, ["query_id", "doc_id"], "left_anti").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return one.join(rest.select("query_id", F.col("doc_id").alias("negative"), F.col("score").alias("negative_score")), "query_id")


def validation_split(rows: DataFrame, item: str, share: float, seed: str = "0") -> DataFrame:
    """``rows`` with validation: whether the row's hash falls into the first ``share`` (in 256ths, rounded up)."""
    first = f"{min(255, -(-int(share * 25600) // 100)):02x}"
    return rows.withColumn("validation", F.substring(pick_key(F.col(item), seed=seed), 1, 2) < first)


def early_stopping(values: DataFrame, patience: int, mode: str = "max") -> DataFrame:
    """(run, step, value) with better, best_step and stop: no better value for ``patience`` steps."""
    order = Window.partitionBy("run").orderBy("step")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sofar, value = (F.max("value"), F.col("value")) if mode == "max" else (F.max(-F.col("value")), -F.col("value"))
    better = F.coalesce(value > sofar.over(before), F.lit(True))
    rows = values.withColumn("better", better)
    rows = rows.withColumn("best_step", F.max(F.when(F.col("better"), F.col("step"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.withColumn("stop", F.col("step") - F.col("best_step") >= patience)
