"""Quality rules whose cutoffs are chosen under a guarantee: few good documents are rejected.

``text_statistics`` computes word and line statistics of whole texts in numpy.  Each rule rejects a document
whose statistic exceeds a cutoff.  The cutoffs are not set by hand.  For each stratum (by number of words) the
labelled documents are split by a hash of their texts:

1. The design part orders the steps: a step tightens one rule to its next cutoff.  The next step is always the
   one whose rule rejects the smallest share of the design part's good documents there (then the most bad ones).
   Steps that reject no labelled bad document are taken together with the rule's next one that does.
2. The holdout part tests them in that order (fixed-sequence testing).  A step is certified while the exact
   one-sided binomial (Clopper-Pearson) upper bound on the share of good documents that all rules of the steps
   so far reject together stays within ``limit``; the first step that isn't ends the sequence.  The order comes
   from other documents, so a sequence needs no further correction; the strata share ``delta`` (Bonferroni).

So with confidence 1 - delta no stratum loses more than ``limit`` of its good documents.  At the defaults a
stratum needs 408 good texts in its holdout part for a first step, if none of them is rejected; with fewer its
rules never reject.

Counts come from all labelled documents by aggregations; what reaches the driver is one row for each stratum,
rule and value (in thousandths), and one for each stratum and step.  Copies of a text count once: they aren't
independent.  Near copies count each, so where labels hold many of them the bound is somewhat optimistic.

Null and empty texts have no words: all statistics are 0 (and base_failed holds, by n_words < 50).  Repeated
rows are judged one by one.  Columns beyond those needed are ignored.  Without labels no rule is certified.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batch, blocks, lowered, mix, need, on_workers, per_text, prefix_hashes, range_hashes, raw, shared_checkpoint, windows

#: Share of a stratum's good documents that all rules together may reject, and the chance that this fails.
LIMIT, DELTA = 0.01, 0.05
#: Upper ends of the strata by number of words.
STRATA = (200, 800)
#: Rules and their cutoffs from the mildest to the strictest: shares in thousandths of words (or characters, lines).
CUTOFFS = tuple(range(950, 0, -25))
#: One text in so many goes to the design part.
DESIGN = 4
RULES = ("symbol_share", "upper_share", "pipe_share", "repeat_share", "dup_line_share", "top_word_share", "bang_share")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), *((c, pa.int32()) for c in RULES), ("text_name", pa.int64())])
COLUMNS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} int" for c in RULES) + ", text_name long"


#: Signs that count as symbols.
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def first_seen(doc: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item the place of the first one of its text with the same name, and how many there are."""
    key = mix(names ^ mix(doc.astype(np.uint64), 3), 5)
    order = np.argsort(key)
    sorted_key = key[order]
    starts = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    first, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    if len(key):
        first[order] = np.repeat(np.minimum.reduceat(order, starts), sizes)
        count[order] = np.repeat(sizes, sizes)
    return first, count


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the rules' statistics (thousandths) of a block of texts."""
    n_docs = len(offsets) - 1
    words = Words(data, offsets)
    start, end, doc, counts = words.start, words.end, words.doc, words.counts
    chars = per_text(words.solid & ((data & 0xC0) != 0x80), offsets)
    symbol = SYMBOL[data]
    n_symbols = per_text(symbol, offsets)
    upper = per_text((data - 65) < 26, offsets)
    lower = per_text((data - 97) < 26, offsets)
    sums = prefix_hashes(data)
    # lines with a word, and those equal to an earlier one of their text
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets[:-1], breaks, breaks + 1]))
    cuts = cuts[cuts < len(data)]
    line_start = cuts[data[cuts] != 10] if len(cuts) else cuts
    nexts = np.concatenate([breaks, offsets[1:]])
    nexts.sort()
    line_end = nexts[np.searchsorted(nexts, line_start, side="right")] if len(line_start) else line_start
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    first, _ = first_seen(line_doc, range_hashes(data, line_start, line_end, sums))
    dup_lines = np.bincount(line_doc[first != np.arange(len(first))], minlength=n_docs)
    n_lines = np.bincount(line_doc, minlength=n_docs)
    # words in 3-word windows that the text holds twice
    names = range_hashes(data, start, end, sums)
    found, at = windows(names, doc, 3)
    _, often = first_seen(doc[at], found)
    twice = at[often > 1]
    covered = np.zeros(len(names), np.bool_)
    for k in range(3):
        covered[twice + k] = True
    n_repeat = np.bincount(doc[covered], minlength=n_docs)
    _, same = first_seen(doc, range_hashes(lowered(data), start, end))
    top = np.ones(n_docs, np.int64)  # occurrences of the most frequent word; beyond the first they are repeats
    np.maximum.at(top, doc, same)
    marked = np.unique(np.searchsorted(start, np.flatnonzero(symbol), side="right") - 1)
    n_marked = np.bincount(doc[marked], minlength=n_docs)
    last = data[np.maximum(end - 1, 0)] if len(end) else data[:0]
    bangs = np.bincount(doc[last == 33], minlength=n_docs)
    pipes = np.bincount(doc[(end - start == 1) & (last == 124)], minlength=n_docs)
    share = lambda a, b: (1000 * a // np.maximum(b, 1)).astype(np.int32)
    return {
        "n_words": counts, "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat,
        "symbol_share": share(n_marked, counts), "upper_share": share(upper, upper + lower), "pipe_share": share(2 * pipes, counts), "repeat_share": share(n_repeat, counts),
        "dup_line_share": share(dup_lines, n_lines), "top_word_share": share(top - 1, counts), "bang_share": share(bangs, counts),
        "text_name": range_hashes(data, offsets[:-1], offsets[1:], sums).view(np.int64),
    }


def statistic_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in blocks(b.column(1)):
            found = statistics(*raw(b.column(1).slice(lo, hi - lo)))
            yield batch(SCHEMA, b.column(0).slice(lo, hi - lo), *(found[c].astype(np.int64) for c in BASE), *(found[c] for c in RULES), found["text_name"])


def text_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, the rules' statistics and the text's 64-bit name of every whole text; no shuffle."""
    return need(documents, doc_id="long", text="string").mapInArrow(on_workers(__name__, "statistic_batches"), COLUMNS)


def beta_below(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_below(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out, m = d, 0
    while m < 10_000:
        m += 1
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) * out / a


def binomial_upper(x: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound: the largest p with P(at most x of n) >= delta, a quantile of a beta distribution."""
    if x >= n:
        return 1.0
    lo, hi = x / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if beta_below(mid, x + 1, n - x) <= 1 - delta:
            lo = mid
        else:
            hi = mid
    return hi


def stratum(column: str = "n_words"):
    out = F.lit(len(STRATA))
    for k, top in reversed(list(enumerate(STRATA))):
        out = F.when(F.col(column) <= top, k).otherwise(out)
    return out


Steps = list[tuple[str, int]]


def ordered_steps(design: dict[str, dict[int, tuple[int, int]]], good: int, limit: float) -> Steps:
    """The order of (rule, cutoff) from the design part: for each rule and cutoff how many good and bad documents it rejects.

    Cutoffs that reject more than ``limit`` of the good ones by themselves are left out.
    """
    ways = {}
    for rule, counts in design.items():
        way, last = [], 0
        for cutoff in CUTOFFS:
            lost, caught = counts.get(cutoff, (0, 0))
            if lost > limit * good:
                break
            if caught > last:
                way.append((lost, -caught, cutoff))
                last = caught
        ways[rule] = way[::-1]
    out: Steps = []
    while any(ways.values()):
        rule = min((r for r in ways if ways[r]), key=lambda r: (ways[r][-1][0], ways[r][-1][1], RULES.index(r)))
        out.append((rule, ways[rule].pop()[2]))
    return out


def certified(steps: Steps, rejected: dict[int, int], good: int, limit: float = LIMIT, delta: float = DELTA / (len(STRATA) + 1)) -> dict[str, int]:
    """The strictest certified cutoff of each rule of a stratum.

    rejected: of the holdout's good documents, how many each step is the first to reject; good: of how many.
    """
    out, lost = {}, 0
    for k, (rule, cutoff) in enumerate(steps):
        lost += rejected.get(k, 0)
        if not good or lost > limit * good or binomial_upper(lost, good, delta) > limit:
            break  # what comes later is not tested
        out[rule] = cutoff
    return out


#: Stands for no step.
NONE = 1 << 30


def step_table(spark: SparkSession, steps: dict[int, Steps]) -> DataFrame:
    """(stratum, a column per rule): by a statistic from 0 to 1000 the first step of that rule that it exceeds, or NONE."""
    columns = {"stratum": pa.array(sorted(steps), pa.int32())}
    for rule in RULES:
        lists = []
        for k in sorted(steps):
            own = np.full(1001, NONE, np.int64)
            for i, (r, cutoff) in reversed(list(enumerate(steps[k]))):
                if r == rule:
                    own[cutoff + 1 :] = np.minimum(own[cutoff + 1 :], i)
            lists.append(own)
        columns[f"{rule}_step"] = pa.array(lists, pa.list_(pa.int64()))
    return spark.createDataFrame(pa.table(columns))


def first_steps(rows: DataFrame, steps: dict[int, Steps]) -> DataFrame:
    """``rows`` with the first step of its stratum that rejects a document, null if none does (``step``).

    The table has a row a stratum, so it is broadcast.
    """
    if not steps:
        return rows.withColumn("step", F.lit(None).cast("long"))
    looked = rows.join(F.broadcast(step_table(rows.sparkSession, steps)), "stratum", "left")
    own = [F.coalesce(F.element_at(f"{r}_step", F.least(F.greatest(F.col(r), F.lit(0)), F.lit(1000)) + 1), F.lit(NONE)) for r in RULES]
    return looked.withColumn("step", F.nullif(F.least(*own), F.lit(NONE))).drop(*(f"{r}_step" for r in RULES))


def rejected_counts(rows: DataFrame) -> dict[int, dict[str, dict[int, tuple[int, int]]]]:
    """By stratum, rule and cutoff how many good and bad documents are rejected.

    A document is a row a rule, counted by value: what reaches the driver is a histogram of each stratum and rule.
    """
    values = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.least(F.col(r), F.lit(1000)).alias("value")) for r in RULES)))
    bars = rows.select("stratum", "quality", values.alias("x")).groupBy("stratum", "x.rule", "x.value").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")).collect()
    sums: dict[tuple[int, str], np.ndarray] = {}
    for r in bars:
        sums.setdefault((r["stratum"], r["rule"]), np.zeros((2, 1002), np.int64))[:, max(r["value"], 0)] += r["good"], r["bad"]
    out: dict[int, dict[str, dict[int, tuple[int, int]]]] = {}
    for (k, rule), own in sums.items():
        above = own[:, ::-1].cumsum(axis=1)[:, ::-1]  # at v: of a value of v or more
        out.setdefault(k, {})[rule] = {c: (int(above[0, c + 1]), int(above[1, c + 1])) for c in CUTOFFS}
    return out


def fit_cutoffs(statistics: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> dict[tuple[int, str], int]:
    """Cutoffs (stratum, rule) from all documents that ``labels`` (doc_id, quality) marks; a text marked both ways is bad."""
    marked = need(labels, doc_id="long", quality="int").where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    kinds = F.first("n_words").alias("n_words"), *(F.first(r).alias(r) for r in RULES)
    rows = statistics.join(marked, "doc_id").groupBy("text_name").agg(F.min("quality").alias("quality"), *kinds)
    rows = shared_checkpoint(rows.withColumns({"stratum": stratum(), "design": F.pmod(F.xxhash64("text_name", F.lit(11)), F.lit(DESIGN)) == 0}))
    counts = rejected_counts(rows.where("design"))
    good = {r["stratum"]: r["n"] for r in rows.where("design AND quality = 1").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = {k: ordered_steps(own, good.get(k, 0), limit) for k, own in counts.items()}
    held = first_steps(rows.where("NOT design AND quality = 1"), steps).groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n")).collect() if steps else []
    out = {}
    for k, own in steps.items():
        mine = {x["step"]: x["n"] for x in held if x["stratum"] == k}
        for rule, cutoff in certified(own, mine, sum(mine.values()), limit, delta / (len(STRATA) + 1)).items():
            out[k, rule] = cutoff
    return out


def judge(statistics: DataFrame, cutoffs: dict[tuple[int, str], int]) -> DataFrame:
    """``statistics`` with base_failed, kept and the rules that reject (failed_rules)."""
    words = F.col("n_words")
    base_failed = (words < 50) | (100 * F.col("n_repeat_words") > 50 * words)
    own = stratum()
    failed = [F.when((own == s) & (F.col(r) > c), F.lit(r)) for (s, r), c in sorted(cutoffs.items())]
    rules = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return statistics.withColumns({"base_failed": base_failed, "failed_rules": F.array_join(rules, ",")}).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def apply_rules(documents: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """Every document's statistics, verdict and failing rules.

    Texts are read once: the short statistics are checkpointed, then joined with the labels and judged.
    """
    found = shared_checkpoint(text_statistics(documents))
    return judge(found, fit_cutoffs(found, labels, limit, delta))
