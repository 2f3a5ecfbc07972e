"""Phrase vocabularies, keyphrases and their measures."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Postings (phrase, document) up to which greedy cover runs on the driver.
DRIVER_POSTINGS = 5_000_000


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a blank; shifted copies are zipped, so the tokens are worked out n times, not once a run."""
    size = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    out = F.slice(tokens, 1, size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, size), lambda a, b: F.concat_ws(" ", a, b))
    return out


def distinct_ngrams(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, phrase): the distinct runs of n tokens of (doc_id, tokens).

    Runs are made distinct in their row; only rows that share a doc_id shuffle theirs.
    """
    found = lambda rows: rows.select("doc_id", F.explode(F.array_distinct(ngrams(F.col("tokens"), n))).alias("phrase"))
    repeated = checkpointed(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    if repeated.isEmpty():
        return found(texts)
    same = texts["doc_id"].eqNullSafe(repeated["doc_id"])
    return found(texts.join(repeated, same, "left_anti")).unionAll(found(texts.join(repeated, same, "left_semi")).distinct())


def candidates(tokens: Column, stopwords: Column, longest: int = 5, least_chars: int = 3) -> Column:
    """Distinct runs of words between stop words, of at most ``longest`` words and at least ``least_chars`` signs."""
    marked = F.transform(tokens, lambda t: F.when(F.array_contains(stopwords, t), F.lit("\x00")).otherwise(t))
    runs = F.transform(F.split(F.array_join(marked, " "), "\x00"), lambda r: F.trim(r))
    return F.array_distinct(F.filter(runs, lambda r: (F.length(r) >= least_chars) & (F.size(F.split(r, " ")) <= longest)))


def tag_runs(tokens: Column, tags: Column) -> Column:
    """The noun phrases of tagged tokens, each an array of tokens, in order.

    Leftmost and longest: nouns (NN...) or adjectives (JJ...) before a noun or a number (CD), or one noun.  Missing tags
    are of no kind.  One letter stands for a token, so the pattern runs once over a string as long as the text has
    tokens and no expression rereads what is before a token.
    """
    letter = lambda t: F.when(F.startswith(t, F.lit("NN")), "N").when(F.startswith(t, F.lit("JJ")), "J").when(t == "CD", "C").otherwise("O")
    marked = F.regexp_replace(F.array_join(F.transform(F.slice(tags, 1, F.size(tokens)), letter), ""), "([NJ]+[NC]|N)", "<$1>")
    # a run's first letter becomes B, its further ones I
    places = F.transform(F.split(marked, "[<>]"), lambda part, i: F.when(i % 2 == 1, F.concat(F.lit("B"), F.repeat(F.lit("I"), F.length(part) - 1))).otherwise(F.repeat(F.lit("O"), F.length(part))))
    clean = F.transform(tokens, lambda t: F.translate(F.coalesce(t, F.lit("")), "\x01\x02", ""))
    put = F.zip_with(clean, F.split(F.array_join(places, ""), ""), lambda t, at: F.when(at == "B", F.concat(F.lit("\x02"), t)).when(at == "I", F.concat(F.lit("\x01"), t)).otherwise(F.lit("\x02")))
    return F.transform(F.filter(F.split(F.array_join(put, ""), "\x02"), lambda r: r != ""), lambda r: F.split(r, "\x01"))


#: Signs that are no word of a phrase, fixed values.
SIGNS = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def noun_phrases(rows: DataFrame, counts: DataFrame | None = None, shortest: int = 2, longest: int = 5) -> DataFrame:
    """(doc_id, pos, phrase) of (doc_id, tokens, tags): a document's noun phrases of ``shortest`` tokens at least, lower-cased.

    Runs that hold a sign go.  Of a longer run than ``longest`` the part of 2 to ``longest`` tokens stays that is most
    frequent in ``counts`` (phrase, n), ties to the shorter and then the earlier part; without counts, or without
    a part that they have, the run goes.  Each spelling counts once a document, at its first place, so two
    spellings may give the same lower-cased phrase twice.  Tags come from the caller's tagger; null tokens or tags give none.
    """
    runs = rows.select("doc_id", F.posexplode(tag_runs(F.col("tokens"), F.col("tags"))).alias("pos", "run"))
    runs = runs.where(F.size("run") >= shortest).where(~F.exists("run", lambda t: F.contains(F.lit(SIGNS), t)))
    found = runs.where(F.size("run") <= longest).select("doc_id", "pos", F.array_join("run", " ").alias("phrase"))
    if counts is not None:
        wide = runs.where(F.size("run") > longest)
        numbered = lambda n: F.transform(ngrams(F.col("run"), n), lambda p, at: F.struct(p.alias("phrase"), F.lit(n).alias("_n"), at.alias("_at")))
        each = [numbered(n) for n in range(2, longest + 1)]
        parts = wide.select("doc_id", "pos", F.explode(F.concat(*each)).alias("_p")).select("doc_id", "pos", "_p.*")
        known = parts.join(counts.select("phrase", F.col("n").alias("_count")).where("n > 0"), "phrase")
        best = known.groupBy("doc_id", "pos").agg(F.max_by("phrase", F.struct("_count", -F.col("_n"), -F.col("_at"))).alias("phrase"))
        found = found.unionByName(best)
    return found.groupBy("doc_id", "phrase").agg(F.min("pos").alias("pos")).select("doc_id", "pos", F.lower("phrase").alias("phrase"))


def candidate_scores(cands: DataFrame, vectors: DataFrame, penalty: float = -0.25) -> DataFrame:
    """(doc_id, phrase, score): the sum of the weights of a phrase's words over (n - penalty)."""
    words = cands.select("doc_id", "phrase", F.split("phrase", " ").alias("w")).select("doc_id", "phrase", F.size("w").alias("n"), F.explode("w").alias("term"))
    joined = words.join(vectors, ["doc_id", "term"], "left")
    return joined.groupBy("doc_id", "phrase").agg((F.sum(F.coalesce("weight", F.lit(0.0))) / (F.first("n") - F.lit(penalty))).alias("score"))


def present_scores(scores: DataFrame, counts: DataFrame, positions: DataFrame) -> DataFrame:
    """score * count^1.5 * position score."""
    return scores.join(counts, ["doc_id", "phrase"]).join(positions, ["doc_id", "phrase"]).select("doc_id", "phrase", (F.col("score") * F.pow("n", F.lit(1.5)) * F.col("position")).alias("score"))


def vocabulary(occurrences: DataFrame, least: int, base: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """(phrase, n): phrases that occur often enough (in rows, or in distinct documents) and are not in the base."""
    rows = occurrences.select("phrase", "doc_id")
    out = (rows.distinct() if distinct else rows).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return out if base is None else out.join(base.select("phrase").distinct(), "phrase", "left_anti")


def frequent_but_not_in(counts: DataFrame, n: int, other: DataFrame) -> DataFrame:
    """(phrase, n, rank): the n most frequent phrases of (phrase, n), ties to the smaller, that another vocabulary lacks.

    The first n are taken by a limit, which sorts parts before it merges them; only they are numbered.
    """
    first = counts.orderBy(F.desc("n"), "phrase").limit(n)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "phrase")))
    return ranked.join(other.select("phrase").distinct(), "phrase", "left_anti")


WORD_PATTERN = r"^([a-zA-Z]+-)*[a-zA-Z]+((\s|-)[0-9]+){0,1}$"


def valid_word(word: Column) -> Column:
    return (F.length(word) > 1) & word.rlike(WORD_PATTERN)


def without_parts_of(phrases: DataFrame, base: DataFrame) -> DataFrame:
    """Phrases that no base phrase equals or contains; the base is meant to be a small dictionary."""
    b = base.select(F.col("phrase").alias("_b"))
    return phrases.join(b, F.instr(F.col("_b"), F.col("phrase")) > 0, "left_anti")


def without_earlier_parts(phrases: DataFrame) -> DataFrame:
    """Of (phrase, rank): phrases that contain no phrase of a smaller rank.

    A phrase's parts (its distinct runs of signs, for phrases are short) meet the phrases by equality.
    """
    size = F.length("phrase")
    parts = phrases.select("phrase", "rank", F.explode(F.sequence(F.lit(1), size)).alias("_i")).select("phrase", "rank", "_i", F.explode(F.sequence(F.lit(1), size - F.col("_i") + 1)).alias("_n"))
    parts = parts.select("phrase", "rank", F.substring("phrase", F.col("_i"), F.col("_n")).alias("_b")).distinct()
    held = parts.join(phrases.select(F.col("phrase").alias("_b"), F.col("rank").alias("_r")), "_b").where("_r < rank").select("phrase", "rank").distinct()
    return phrases.join(held, ["phrase", "rank"], "left_anti")


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` cut off from their lineage, in the session's checkpoint folder; one is set only where none is named."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(rows.sparkSession.conf.get("spark.checkpoint.dir", None) or "spark-warehouse/checkpoints")
    return rows.checkpoint()


#: Phrases up to which coverage broadcasts the chosen ones, some 100 MB.
CHOSEN_PHRASES = 1_000_000


def coverage(occurrences: DataFrame, chosen: DataFrame) -> DataFrame:
    """The share of the documents that hold a chosen phrase; those are counted, and broadcast where they are not too many."""
    all_docs = occurrences.agg(F.countDistinct("doc_id").alias("n"))
    known = checkpointed(chosen.select("phrase"))
    known = F.broadcast(known) if known.count() <= CHOSEN_PHRASES else known
    return occurrences.join(known, "phrase", "left_semi").agg(F.countDistinct("doc_id").alias("c")).crossJoin(all_docs).select((F.col("c") / F.col("n")).alias("coverage"))


def greedy_cover(occurrences: DataFrame, k: int) -> DataFrame:
    """(step, phrase, gain): k phrases, each with the most documents not yet covered, ties to the smaller phrase.

    Each document's phrases are written once.  Distinct postings up to ``DRIVER_POSTINGS`` (counted first) run on the
    driver with a lazy heap; beyond that each pick is a distributed count over the documents that hold none of the
    phrases picked before, which rewrites nothing.
    """
    spark = occurrences.sparkSession
    rows = occurrences.select("phrase", F.col("doc_id").cast("long").alias("doc_id")).where("phrase IS NOT NULL AND doc_id IS NOT NULL")
    schema = "step int, phrase string, gain long"
    texts = checkpointed(rows.groupBy("doc_id").agg(F.collect_set("phrase").alias("phrases")))
    postings = texts.agg(F.sum(F.size("phrases"))).first()[0] or 0
    if postings <= DRIVER_POSTINGS:
        found = texts.select("doc_id", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.collect_list("doc_id").alias("docs")).toArrow()
        phrases = found["phrase"].to_pylist()
        docs = [np.unique(d.values.to_numpy()) for d in found["docs"]]
        names, flat = np.unique(np.concatenate(docs) if docs else np.zeros(0, np.int64), return_inverse=True)
        cuts = np.cumsum([len(d) for d in docs])[:-1] if docs else []
        places = np.split(flat, cuts) if docs else []
        covered = np.zeros(len(names), np.bool_)
        heap = [(-len(p), phrases[i], i) for i, p in enumerate(places)]
        heapq.heapify(heap)
        out: list[tuple[int, str, int]] = []
        while heap and len(out) < k:
            stale, phrase, i = heapq.heappop(heap)
            gain = int((~covered[places[i]]).sum())
            if not gain:
                continue
            if heap and (-gain, phrase) > heap[0][:2]:
                heapq.heappush(heap, (-gain, phrase, i))
                continue
            covered[places[i]] = True
            out.append((len(out) + 1, phrase, gain))
        return spark.createDataFrame(out, schema)
    picks: list[tuple[int, str, int]] = []
    for step in range(1, k + 1):
        left = texts.where(~F.arrays_overlap("phrases", F.array(*(F.lit(p) for _, p, _ in picks)))) if picks else texts
        best = left.select(F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "phrase").first()
        if best is None:
            break
        picks.append((step, best["phrase"], best["n"]))
    return spark.createDataFrame(picks, schema)


def matches(predictions: Column, targets: Column) -> Column:
    """1 or 0 for each prediction: whether it is a target."""
    return F.transform(predictions, lambda p: F.array_contains(targets, p).cast("int"))


def loose_matches(predictions: Column, targets: Column) -> Column:
    """Whether a prediction contains a target or is contained in one."""
    return F.transform(predictions, lambda p: F.exists(targets, lambda t: (F.instr(t, p) > 0) | (F.instr(p, t) > 0)).cast("int"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _dcg(rel: Column, k: Column) -> Column:
    return _sum(F.transform(F.slice(rel, 1, k), lambda r, i: r / F.log2(i + 2)))


def _precisions(rel: Column) -> Column:
    """The sum over hits of the precision at their places, in one pass."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("seen"), F.lit(0.0).alias("total"))
    step = lambda s, x: F.struct((s["i"] + 1).alias("i"), (s["seen"] + x).alias("seen"), (s["total"] + x * (s["seen"] + x) / (s["i"] + 1)).alias("total"))
    return F.aggregate(rel, start, step, lambda s: s["total"])


def document_measures(pairs: DataFrame, k: int | str) -> DataFrame:
    """Of (doc_id, predictions, targets), both distinct in order: precision, recall, f1, ndcg, ap at k.

    k: a number, or "M" (as many as predicted), "O" (as many as targets), "G" (the greater).  Precision divides
    by k even if fewer are predicted; the ideal order of NDCG is the list's own.
    """
    return document_measures_at(pairs, [k]).drop("cut")


def document_measures_at(pairs: DataFrame, ks: list[int | str]) -> DataFrame:
    """``document_measures`` at several k, a row each with its name in ``cut``; predictions meet targets once."""
    n_p, n_t = F.size("predictions"), F.size("targets")
    at = lambda k: {"M": n_p, "O": n_t, "G": F.greatest(n_p, n_t)}.get(k, F.lit(k)) if isinstance(k, str) else F.lit(int(k))
    cuts = F.array(*(F.struct(F.lit(str(k)).alias("cut"), at(k).cast("int").alias("k")) for k in ks))
    met = pairs.select("doc_id", matches(F.col("predictions"), F.col("targets")).alias("rel"), n_t.alias("n_targets"), cuts.alias("cuts"))
    rows = met.select("doc_id", "rel", "n_targets", F.explode("cuts").alias("x")).select("doc_id", "rel", "n_targets", "x.cut", "x.k")
    first = F.slice("rel", 1, F.greatest(F.col("k"), F.lit(0)))
    rows = rows.withColumn("hits", _sum(first))
    p, r = _ratio(F.col("hits"), F.col("k")), _ratio(F.col("hits"), F.col("n_targets"))
    ap = _ratio(_precisions(first), F.col("n_targets"))
    ndcg = _ratio(_dcg(F.col("rel"), F.col("k")), _dcg(F.sort_array("rel", asc=False), F.col("k")))
    return rows.select("doc_id", "cut", "k", "hits", "n_targets", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), ndcg.alias("ndcg"), ap.alias("ap"))


def corpus_measures(documents: DataFrame) -> DataFrame:
    """Macro and micro precision, recall and F1 of document measures, and the means of ndcg and ap."""
    d = documents.agg(F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"), _ratio(F.sum("hits"), F.sum("k")).alias("micro_p"), _ratio(F.sum("hits"), F.sum("n_targets")).alias("micro_r"), F.avg("ndcg").alias("ndcg"), F.avg("ap").alias("map"))
    f1 = lambda a, b: _ratio(2 * F.col(a) * F.col(b), F.col(a) + F.col(b))
    return d.select("macro_p", "macro_r", f1("macro_p", "macro_r").alias("macro_f1"), "micro_p", "micro_r", f1("micro_p", "micro_r").alias("micro_f1"), "ndcg", "map")


def present(source: Column, phrase: Column) -> Column:
    """Whether a phrase's words occur in a row in the source's words."""
    n = F.size(phrase)
    return (n > 0) & (F.size(source) >= n) & F.exists(F.when(F.size(source) >= n, F.sequence(F.lit(0), F.size(source) - n)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(source, i + 1, n) == phrase)


def alpha_dcg(pairs: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """(doc_id, alpha_dcg): a prediction's gain for a target shrinks with each earlier one that contains it."""
    p = pairs.select("doc_id", "targets", F.posexplode("predictions").alias("pos", "pred")).where(F.col("pos") < k)
    t = p.select("doc_id", "pos", "pred", F.explode("targets").alias("target")).withColumn("hit", ((F.instr("pred", F.col("target")) > 0) | (F.instr("target", F.col("pred")) > 0)).cast("int"))
    before = Window.partitionBy("doc_id", "target").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    gain = t.withColumn("seen", F.coalesce(F.sum("hit").over(before), F.lit(0))).withColumn("gain", F.col("hit") * F.pow(F.lit(1 - alpha), F.col("seen")))
    return gain.groupBy("doc_id").agg(F.sum(F.col("gain") / F.log2(F.col("pos") + 2)).alias("alpha_dcg"))


def diversity(pairs: DataFrame) -> DataFrame:
    """Shares of distinct phrases and of distinct words among predictions."""
    words = F.flatten(F.transform("predictions", lambda p: F.split(p, " ")))
    return pairs.select("doc_id", _ratio(F.size(F.array_distinct("predictions")), F.size("predictions")).alias("unique_phrases"), _ratio(F.size(F.array_distinct(words)), F.size(words)).alias("unique_words"))
