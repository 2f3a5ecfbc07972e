"""Retrieval measures of a run (query_id, doc_id, rank) against judgements (query_id, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run of judged queries with rel (0 where unjudged)."""
    queries = qrels.select("query_id").distinct()
    return run.join(queries, "query_id", "left_semi").join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """NDCG, AP, recall, precision, reciprocal rank and capped recall at k of each query in run and judgements."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = qrels.where("rel > 0").withColumn("i", F.row_number().over(order)).groupBy("query_id").agg(
        F.sum(F.when(F.col("i") <= k, F.col("rel") / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("ideal"), F.count(F.lit(1)).alias("n_rel")
    )
    rows = judged(run, qrels).where(F.col("rank") <= k)
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("hit", (F.col("rel") > 0).cast("int")).withColumn("seen", F.sum("hit").over(before))
    sums = rows.groupBy("query_id").agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("hit").alias("hits"), F.sum(F.col("hit") * F.col("seen") / F.col("rank")).alias("ap"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")
    )
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.join(ideal, "query_id", "left").select(
        "query_id", part(F.col("dcg"), F.col("ideal")).alias("ndcg"), part(F.col("ap"), F.col("n_rel")).alias("ap"), part(F.col("hits"), F.col("n_rel")).alias("recall"),
        (F.col("hits") / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), part(F.col("hits"), F.least(F.lit(k), F.col("n_rel"))).alias("r_cap"),
    )


def evaluate(run: DataFrame, qrels: DataFrame, k: int, digits: int = 5) -> DataFrame:
    """One row of means over queries in run and judgements; mrr also over all judged queries (mrr_all)."""
    rows = per_query(run, qrels, k)
    n = qrels.select(F.countDistinct("query_id").alias("n"))
    means = rows.agg(*(F.round(F.avg(c), digits).alias(n) for c, n in (("ndcg", "ndcg"), ("ap", "map"), ("recall", "recall"), ("precision", "precision"), ("rr", "mrr"), ("r_cap", "r_cap"))), F.sum("rr").alias("rr"))
    return means.crossJoin(F.broadcast(n)).select("ndcg", "map", "recall", "precision", "mrr", "r_cap", F.round(F.col("rr") / F.col("n"), digits).alias("mrr_all"))


def without_self(run: DataFrame) -> DataFrame:
    return run.where("query_id <> doc_id")


def cut(run: DataFrame, k: int) -> DataFrame:
    return run.where(F.col("rank") <= k)


def at_depths(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, ndcg, ap, recall, precision, rr, r_cap) of every depth, from one pass over run and judgements."""
    depths = F.explode(F.lit(sorted(set(ks)))).alias("k")
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    best = qrels.where("rel > 0").withColumn("i", F.row_number().over(order)).select("query_id", "rel", "i", depths)
    ideal = best.groupBy("query_id", "k").agg(F.sum(F.when(F.col("i") <= F.col("k"), F.col("rel") / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("ideal"), F.count(F.lit(1)).alias("n_rel"))
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = judged(run, qrels).where(F.col("rank") <= max(ks)).withColumn("hit", (F.col("rel") > 0).cast("int")).withColumn("seen", F.sum("hit").over(before))
    inside = F.col("rank") <= F.col("k")
    own = rows.select("*", depths)
    sums = own.groupBy("query_id", "k").agg(
        F.sum(F.when(inside, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias("hits"),
        F.sum(F.when(inside, F.col("hit") * F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"), F.min(F.when(inside & (F.col("hit") == 1), F.col("rank"))).alias("first"),
    )
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.join(ideal, ["query_id", "k"], "left").select(
        "query_id", "k", part(F.col("dcg"), F.col("ideal")).alias("ndcg"), part(F.col("ap"), F.col("n_rel")).alias("ap"), part(F.col("hits"), F.col("n_rel")).alias("recall"),
        (F.col("hits") / F.col("k")).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), part(F.col("hits"), F.least("k", "n_rel")).alias("r_cap"),
    )


def evaluate_at(run: DataFrame, qrels: DataFrame, ks: list[int], digits: int = 5) -> DataFrame:
    """(k, ndcg, map, recall, precision, mrr, r_cap): means over queries in run and judgements."""
    names = (("ndcg", "ndcg"), ("ap", "map"), ("recall", "recall"), ("precision", "precision"), ("rr", "mrr"), ("r_cap", "r_cap"))
    return at_depths(run, qrels, ks).groupBy("k").agg(*(F.round(F.avg(c), digits).alias(n) for c, n in names))


#: Named measures: column, and whether a depth follows the name.
NAMED = {"ndcg_cut": "ndcg", "map_cut": "ap", "recall": "recall", "P": "precision", "recip_rank": "rr", "mrr": "rr", "r_cap": "r_cap"}
#: Deeper than any run's list.
WHOLE = 1_000_000


def named(name: str) -> tuple[str, int]:
    """(column, depth) of a name like ``ndcg_cut_10``, ``recall_100``, ``MRR@10`` or ``map``; without a depth the whole list counts."""
    kind, _, depth = name.replace("@", "_").rpartition("_") if name.replace("@", "_").rpartition("_")[2].isdigit() else (name, "", "")
    column = {"map": "ap", "ndcg": "ndcg", "MRR": "rr"}.get(kind) or NAMED.get(kind)
    if column is None:
        raise ValueError(f"no measure is called {name}")
    return column, int(depth) if depth else WHOLE


def measures(run: DataFrame, qrels: DataFrame, names: list[str]) -> DataFrame:
    """(measure, value): means of named measures over queries in run and judgements; 0 where there is no such query."""
    wanted = {n: named(n) for n in names}
    rows = at_depths(run, qrels, [k for _, k in wanted.values()])
    sums = [F.coalesce(F.avg(F.when(F.col("k") == k, F.col(c))), F.lit(0.0)).alias(n) for n, (c, k) in wanted.items()]
    one = rows.agg(*sums)
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(f"`{n}`").alias("value")) for n in names))).alias("x")).select("x.*")


def evaluate_datasets(runs: dict[str, DataFrame], qrels: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(dataset, measure, value) of several runs."""
    out = None
    for dataset, run in runs.items():
        own = measures(run, qrels[dataset], names).select(F.lit(dataset).alias("dataset"), "measure", "value")
        out = own if out is None else out.unionAll(own)
    return out


def check_grades(name: str, binary: bool) -> None:
    """Graded judgements are for NDCG, binary ones for the others."""
    if binary == name.startswith("ndcg"):
        raise ValueError(f"{name} needs {'graded' if binary else 'binary'} judgements")


def own_document_measures(run: DataFrame, own: DataFrame, ks: list[int], queries: DataFrame | None = None) -> DataFrame:
    """(k, recall, mrr): whether a query's own document is among its first k hits; at 1 all hits that tie with the best count.

    run: (query_id, doc_id, score); own: (query_id, own_id), of which each is asked for.
    """
    by = Window.partitionBy("query_id").orderBy(F.desc("score"))
    rows = run.withColumn("tied", F.rank().over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "doc_id")))
    hit = own.join(rows.withColumnRenamed("doc_id", "own_id"), ["query_id", "own_id"], "left").select("query_id", "tied", "place", F.explode(F.lit(sorted(set(ks)))).alias("k"))
    found = F.when(F.col("k") == 1, F.col("tied") == 1).otherwise(F.col("place") <= F.col("k"))
    found = F.coalesce(found, F.lit(False))
    return hit.groupBy("k").agg(F.avg(found.cast("double")).alias("recall"), F.avg(F.when(found, F.when(F.col("k") == 1, 1.0).otherwise(1 / F.col("place"))).otherwise(0.0)).alias("mrr"))


def staged_measures(runs: dict[str, DataFrame], own: DataFrame, ks: list[int]) -> DataFrame:
    """(stage, k, recall, mrr) of the runs of several stages (sparse, dense, reranked) by the queries' own documents."""
    out = None
    for stage, run in runs.items():
        rows = own_document_measures(run, own, ks).select(F.lit(stage).alias("stage"), "k", "recall", "mrr")
        out = rows if out is None else out.unionAll(rows)
    return out


def drop_from(rows: DataFrame, name: str, value: str, base: str) -> DataFrame:
    """``rows`` with drop: by how many percent a value is below that of the row called ``base``."""
    whole = rows.where(F.col(name) == base).select(F.col(value).alias("_base"))
    return rows.crossJoin(F.broadcast(whole)).withColumn("drop", 100 * (F.col("_base") - F.col(value)) / F.col("_base")).drop("_base")


def errors(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (rmse, mae) of two columns."""
    return rows.agg(F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2))).alias("rmse"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"))


def expansion_popularity(vectors: DataFrame, own: DataFrame, least: float = 50) -> DataFrame:
    """(term, n): in how many documents a term of this weight or more is not one of the document's own terms."""
    rows = vectors.where(F.col("weight") >= least).join(own.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_anti")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
