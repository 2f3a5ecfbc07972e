"""Training triplets (query, positive, negative) from citations, labels, search logs and lists of phrases.

Every random choice is a seeded hash order, so the same rows give the same triplets on any cluster and a lost
task gives them again.  Long rows (one a member) take the place of nested lists: a paper with very many
references spreads over tasks like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.md5 import smallest_batches
from ..functions.remote import on_workers
from .phrases import checkpointed
from .training import group_in_row, pick_key


def first_by_hash(rows: DataFrame, by: list[str], n: int, *keys: str, seed: str = "0") -> DataFrame:
    """The n rows of each group with the smallest hashes of ``keys``, with their place (from 1) as _place."""
    order = Window.partitionBy(*by).orderBy(pick_key(*map(F.col, keys), seed=seed), *keys)
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)


def negatives_outside(chosen: DataFrame, references: DataFrame, members: DataFrame, seed: str = "0") -> DataFrame:
    """``chosen`` (paper, group, ...) with negative: the paper's reference of the smallest hash that the group doesn't hold.

    Groups whose paper has no other reference are left out.  A group meets its paper's references in blocks of
    ``BLOCK_IDS`` and hands on the best of each, so no pair of a group and a reference is a row.
    """
    refs = references.groupBy("paper").agg(F.collect_set("doc_id").alias("_ids")).where(F.size("_ids") > 0)
    starts = F.sequence(F.lit(0), F.size("_ids") - 1, F.lit(BLOCK_IDS))
    refs = refs.select("paper", F.explode(F.transform(starts, lambda at: F.slice("_ids", at + 1, BLOCK_IDS))).alias("_ids"))
    inside = members.groupBy("paper", "group").agg(F.collect_set("doc_id").alias("_own"))
    groups = chosen.select("paper", "group").distinct().join(inside, ["paper", "group"], "left").join(refs, "paper")
    others = F.when(F.col("_own").isNull(), F.col("_ids")).otherwise(F.array_except("_ids", "_own"))
    best = F.array_min(F.transform(others, lambda d: F.struct(pick_key(F.col("group"), d, seed=seed).alias("k"), d.alias("d"))))
    found = groups.select("paper", "group", best.alias("_best")).where("_best IS NOT NULL").groupBy("paper", "group").agg(F.min("_best")["d"].alias("negative"))
    return chosen.join(found, ["paper", "group"])


def co_citation_triplets(members: DataFrame, references: DataFrame, groups: int = 5, seed: str = "0") -> DataFrame:
    """(paper, group, query, positive, negative): of at most ``groups`` groups a paper two members, and a reference outside.

    members: (paper, group, doc_id); references: (paper, doc_id).  Groups of one member are left out.
    """
    rows = members.select("paper", "group", "doc_id").distinct()
    large = rows.groupBy("paper", "group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    some = first_by_hash(large, ["paper"], groups, "paper", "group", seed=seed).select("paper", "group")
    two = first_by_hash(rows.join(some, ["paper", "group"]), ["paper", "group"], 2, "group", "doc_id", seed=seed)
    pairs = two.groupBy("paper", "group").agg(F.max(F.when(F.col("_place") == 1, F.col("doc_id"))).alias("query"), F.max(F.when(F.col("_place") == 2, F.col("doc_id"))).alias("positive"))
    return negatives_outside(pairs, references, rows, seed).select("paper", "group", "query", "positive", "negative")


def group_pair_triplets(members: DataFrame, references: DataFrame, pairs: int = 8, seed: str = "0") -> DataFrame:
    """Up to ``pairs`` unordered pairs of each group, all with the group's negative.

    Only the first members by hash that can make so many pairs are paired, so a large group isn't expanded.
    """
    rows = members.select("paper", "group", "doc_id").distinct()
    # the pairs of m members number m (m - 1) / 2; the least m with enough of them
    m = next(k for k in range(2, pairs + 3) if k * (k - 1) // 2 >= pairs)
    some = first_by_hash(rows, ["paper", "group"], m, "group", "doc_id", seed=seed).drop("_place")
    a, b = some.withColumnRenamed("doc_id", "query"), some.withColumnRenamed("doc_id", "positive")
    both = a.join(b, ["paper", "group"]).where("query < positive")
    both = first_by_hash(both, ["paper", "group"], pairs, "group", "query", "positive", seed=seed).drop("_place")
    return negatives_outside(both, references, rows, seed).select("paper", "group", "query", "positive", "negative")


def context_triplets(contexts: DataFrame, references: DataFrame, most: int = 5, seed: str = "0") -> DataFrame:
    """(paper, group, query, positive, negative): a citing sentence, a cited paper and a reference not cited there.

    contexts: (paper, group, text, doc_id), one row for each cited paper; at most ``most`` contexts a paper.
    """
    rows = contexts.select("paper", "group", "text", "doc_id").distinct()
    some = first_by_hash(rows.select("paper", "group").distinct(), ["paper"], most, "paper", "group", seed=seed).select("paper", "group")
    one = first_by_hash(rows.join(some, ["paper", "group"]), ["paper", "group"], 1, "group", "doc_id", seed=seed)
    pairs = one.select("paper", "group", F.col("text").alias("query"), F.col("doc_id").alias("positive"))
    return negatives_outside(pairs, references, rows, seed).select("paper", "group", "query", "positive", "negative")


def title_triplets(papers: DataFrame, references: DataFrame, seed: str = "0") -> DataFrame:
    """(paper, query, positive, negative): title, abstract and the abstract of a reference.  papers: (paper, title, abstract)."""
    whole = papers.where("title <> '' AND abstract <> ''")
    texts = whole.select(F.col("paper").alias("doc_id"), F.col("abstract").alias("negative"))
    refs = references.select("paper", "doc_id").distinct().where("paper <> doc_id").join(texts.select("doc_id"), "doc_id", "left_semi")
    key = F.struct(pick_key(F.col("paper"), F.col("doc_id"), seed=seed).alias("k"), F.col("doc_id").alias("d"))
    best = refs.groupBy("paper").agg(F.min(key)["d"].alias("doc_id"))
    rows = whole.join(best, "paper").join(texts, "doc_id")
    return rows.select("paper", F.col("title").alias("query"), F.col("abstract").alias("positive"), "negative")


#: Ids of a block that one row is compared with; ids up to which blocks are broadcast; papers of a block.
BLOCK_IDS, BROADCAST_IDS, BLOCK_PAPERS = 4096, 4_000_000, 512


def in_blocks(rows: DataFrame, by: list[str], key: str, size: int, name: str) -> DataFrame:
    """(by, name): the keys of each group in lists of about ``size``."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
    return rows.join(F.broadcast(sizes), by).groupBy(*by, F.pmod(F.xxhash64(key), F.col("_n")).alias("_block")).agg(F.collect_list(key).alias(name)).drop("_block")


def reference_in_group(papers: DataFrame, documents: DataFrame, *by: str, seed: str = "0") -> DataFrame:
    """(paper, doc_id): of the other documents with the same ``by`` the one of the smallest hash of both ids.

    The hash is of the pair, so all pairs of a group are looked at, but none becomes a row: blocks of papers meet blocks
    of ids, thousands of hashes are worked out at once (``functions.md5``), and a paper hands on the best of each block.
    """
    spark = papers.sparkSession
    ids, own = (rows.select(*by, key).where(F.col(key).isNotNull()).distinct().transform(checkpointed) for rows, key in ((documents, "doc_id"), (papers, "paper")))
    blocks = in_blocks(ids, list(by), "doc_id", BLOCK_IDS, "_ids")
    blocks = F.broadcast(blocks) if ids.count() <= BROADCAST_IDS else blocks
    dealt = in_blocks(own, list(by), "paper", BLOCK_PAPERS, "_papers").repartition(spark.sparkContext.defaultParallelism * 4)
    pairs = dealt.join(blocks, list(by)).select("_papers", F.col("_papers").cast("array<string>").alias("_left"), "_ids", F.col("_ids").cast("array<string>").alias("_right"))
    kinds = own.schema["paper"].dataType.simpleString(), ids.schema["doc_id"].dataType.simpleString()
    best = pairs.mapInArrow(on_workers(spark, smallest_batches.__module__, "smallest_batches", seed), f"paper {kinds[0]}, k string, doc_id {kinds[1]}")
    return best.groupBy("paper").agg(F.min(F.struct("k", "doc_id"))["doc_id"].alias("doc_id"))


def ring(rows: DataFrame, item: str, digits: int = 2, seed: str = "0") -> DataFrame:
    """``rows`` with next: the row after each one in a seeded hash order, cyclic within buckets of the hash's first hex digits.

    A derangement but for buckets of one row, whose next is null.  More digits, smaller windows.
    """
    own = rows.withColumn("_key", pick_key(F.col(item), seed=seed)).withColumn("_bucket", F.substring("_key", 1, digits))
    order = Window.partitionBy("_bucket").orderBy("_key", item)
    whole = F.struct(*rows.columns)
    after = F.coalesce(F.lead(whole).over(order), F.first(whole).over(order))
    alone = F.count(F.lit(1)).over(Window.partitionBy("_bucket")) == 1
    return own.withColumn("next", F.when(~alone, after)).drop("_key", "_bucket")


def keyphrase_triplets(documents: DataFrame, digits: int = 2, seed: str = "0") -> DataFrame:
    """(doc_id, query, positive, negative): a document's phrases joined by commas, its text and another one's.

    documents: (doc_id, phrases, text); documents without phrases are left out.
    """
    rows = ring(documents.where(F.size("phrases") > 0).select("doc_id", "phrases", "text"), "doc_id", digits, seed).where("next IS NOT NULL")
    return rows.select("doc_id", F.array_join("phrases", ", ").alias("query"), F.col("text").alias("positive"), F.col("next.text").alias("negative"))


def label_triplets(documents: DataFrame, digits: int = 2, seed: str = "0") -> DataFrame:
    """(doc_id, query, positive, negative): the labels that the negative doesn't have, in order, joined by commas.

    documents: (doc_id, labels, text).  Pairs without such a label are left out.
    """
    rows = ring(documents.select("doc_id", "labels", "text"), "doc_id", digits, seed).where("next IS NOT NULL")
    own = F.array_sort(F.array_except("labels", F.col("next.labels")))
    return rows.where(F.size(own) > 0).select("doc_id", F.array_join(own, ", ").alias("query"), F.col("text").alias("positive"), F.col("next.text").alias("negative"))


def search_log_triplets(log: DataFrame, seed: str = "0") -> DataFrame:
    """(query, positive, negative): every candidate with a score above 0, each with one of those that score 0.

    log: (query, doc_id, score).  The k-th positive by hash gets the k-th negative, beginning anew after the last.
    """
    rows = log.select("query", "doc_id", "score").distinct()
    place = F.row_number().over(Window.partitionBy("query").orderBy(pick_key(F.col("query"), F.col("doc_id"), seed=seed), "doc_id"))
    good = rows.where("score > 0").withColumn("_p", place - 1).select("query", F.col("doc_id").alias("positive"), "_p")
    bad = rows.where("score = 0").withColumn("_n", place - 1).select("query", F.col("doc_id").alias("negative"), "_n")
    count = bad.groupBy("query").agg(F.count(F.lit(1)).alias("_of"))
    return good.join(count, "query").withColumn("_n", F.col("_p") % F.col("_of")).join(bad, ["query", "_n"]).select("query", "positive", "negative")


def combine(sources: dict[str, DataFrame], caps: dict[str, int | None], *keys: str, seed: str = "0") -> DataFrame:
    """Rows of all sources with kind and order_key: of each at most its cap, by hash; sorted by order_key they are shuffled.

    A cap is a top-n over hashes, which each task prunes before rows travel; without one a source stays whole.
    """
    out = None
    for kind, rows in sources.items():
        own = rows.withColumn("kind", F.lit(kind))
        own = own.withColumn("order_key", pick_key(F.lit(kind), *map(F.col, keys), seed=seed))
        cap = caps.get(kind)
        own = own if cap is None else own.orderBy("order_key", *keys).limit(cap)
        out = own if out is None else out.unionByName(own)
    return out


def augment_queries(queries: DataFrame, related: DataFrame, least: float = 0.2, most: int = 5) -> DataFrame:
    """(query, augmented): a query and its best related phrases, joined by commas; without any it stays as it is.

    related: (query, phrase, score).
    """
    order = Window.partitionBy("query").orderBy(F.desc("score"), "phrase")
    best = related.where(F.col("score") >= least).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most)
    lists = best.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "phrase"))), lambda x: x["phrase"]).alias("phrases"))
    rows = queries.select("query").distinct().join(lists, "query", "left")
    return rows.select("query", F.concat_ws(", ", F.array(F.col("query")), F.coalesce("phrases", F.array().cast("array<string>"))).alias("augmented"))


def to_fetch(ids: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id) still to be fetched: distinct ids without those that are known."""
    return ids.select("doc_id").where("doc_id IS NOT NULL").distinct().join(known.select("doc_id").distinct(), "doc_id", "left_anti")


def fetch(ids: DataFrame, schema: str, request: Callable[[list], list[dict]], size: int = 500) -> DataFrame:
    """Rows that ``request`` gives for the ids, asked for in batches of ``size``; an id it doesn't know gives none.

    ``request`` is the port to a service (or a local store); it runs on the executors, one batch after the other.
    """
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).fieldNames()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for part in parts:
            held += part["doc_id"].tolist()
            while len(held) >= size:
                now, held = held[:size], held[size:]
                yield pd.DataFrame([r for r in request(now) if r], columns=names)
        if held:
            yield pd.DataFrame([r for r in request(held) if r], columns=names)

    return ids.select("doc_id").mapInPandas(run, schema)


def metadata_text(title: Column, abstract: Column, only_title: bool = False) -> Column:
    """Title, a blank and abstract; either alone where the other is missing; null without both."""
    title, abstract = F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(abstract), F.lit(""))
    if only_title:
        return title
    return F.nullif(F.concat_ws(" ", title, abstract), F.lit(""))


def with_fields(papers: DataFrame, wanted: list[str], fields: str = "fields") -> DataFrame:
    """Papers with any of the wanted fields of study."""
    return papers.where(F.arrays_overlap(fields, F.lit(wanted)))


#: Annotations of a paper: JSON within JSON.
SPAN, ENTRY = "array<struct<start:int,end:int>>", "array<struct<start:int,end:int,attributes:struct<id:string,ref_id:string,matched_paper_id:bigint>>>"


def annotated_papers(papers: DataFrame, gap: int = 5, keep_last: bool = True) -> DataFrame:
    """(paper, title, abstract, groups, references) of (corpusid, content).

    content: text and annotations (title, abstract, bibentry, bibref), each a JSON text of spans.  References are
    the papers that bibliography entries were matched with; a group holds those cited closely one after the other.
    """
    note = lambda name, kind: F.from_json(F.col(f"content.annotations.{name}"), kind)
    rows = papers.select(F.col("corpusid").alias("paper"), F.col("content.text").alias("text"), note("title", SPAN).alias("t"), note("abstract", SPAN).alias("a"), note("bibentry", ENTRY).alias("entries"), note("bibref", ENTRY).alias("refs"))
    cut = lambda spans: F.coalesce(F.array_join(F.transform(spans, lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])), " "), F.lit(""))
    matched = F.filter(F.coalesce("entries", F.array().cast(ENTRY)), lambda e: e["attributes"]["matched_paper_id"].isNotNull() & e["attributes"]["id"].isNotNull())
    ids = F.map_from_entries(F.array_distinct(F.transform(matched, lambda e: F.struct(e["attributes"]["id"], e["attributes"]["matched_paper_id"]))))
    rows = rows.withColumns({"title": cut(F.col("t")), "abstract": cut(F.col("a")), "ids": ids})
    known = F.filter(F.coalesce("refs", F.array().cast(ENTRY)), lambda r: F.map_contains_key(F.col("ids"), r["attributes"]["ref_id"]) & r["attributes"]["ref_id"].isNotNull())
    rows = rows.withColumn("cited", F.array_sort(F.transform(known, lambda r: F.struct(r["start"], r["end"], F.try_element_at(F.col("ids"), r["attributes"]["ref_id"]).alias("id")))))
    spans = group_in_row(F.transform("cited", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))), gap, keep_last)
    inside = lambda g: F.array_distinct(F.transform(F.filter("cited", lambda c: F.array_contains(F.transform(g, lambda s: s["start"]), c["start"])), lambda c: c["id"]))
    return rows.select("paper", "title", "abstract", F.transform(spans, inside).alias("groups"), F.array_distinct(F.transform("cited", lambda c: c["id"])).alias("references"))
