"""Overlap and diversity measures of predicted phrases against target phrases, on array columns.

All but METEOR and self-BLEU are built-in expressions of one row; those two are Arrow-batched functions of one
row's arrays.  A null or empty side scores 0.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.stem import stem
from .phrases import loose_matches, matches, ngrams

#: Fixed values of the measures: METEOR's parameters, and what stands for no match in a smoothed BLEU.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
EPSILON = 0.1


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def _count(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda s, x: s + x)


def words(phrases: Column) -> Column:
    return F.filter(F.split(F.array_join(phrases, " "), " "), lambda w: w != "")


def set_measures(predictions: Column, targets: Column) -> Column:
    """struct(precision, recall, f1) of the two sets."""
    hits = F.size(F.array_intersect(predictions, targets))
    p, r = _share(hits, F.size(F.array_distinct(predictions))), _share(hits, F.size(F.array_distinct(targets)))
    return F.struct(p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def loose_measures(predictions: Column, targets: Column) -> Column:
    """struct(r_precision, precision, recall, f1); phrases match where one contains the other.

    R-precision looks at as many predictions as there are targets and divides by the number of targets.
    """
    found = loose_matches(predictions, targets)
    p, r = _share(_count(found), F.size(predictions)), _share(_count(loose_matches(targets, predictions)), F.size(targets))
    first = _share(_count(F.slice(found, 1, F.greatest(F.size(targets), F.lit(0)))), F.size(targets))
    return F.struct(first.alias("r_precision"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def rouge(predictions: Column, targets: Column, n: int) -> Column:
    """struct(p, r, f) of the distinct runs of n words in the joined phrases; f has 1e-8 added below the line."""
    a, b = (F.array_distinct(ngrams(words(x), n)) for x in (predictions, targets))
    hits = F.size(F.array_intersect(a, b))
    p, r = _share(hits, F.size(a)), _share(hits, F.size(b))
    return F.struct(p.alias("p"), r.alias("r"), (2 * p * r / (p + r + 1e-8)).alias("f"))


def exact_share(predictions: Column, targets: Column) -> Column:
    return _share(_count(matches(predictions, targets)), F.size(predictions))


def diversity(predictions: Column) -> Column:
    """struct(unique_phrases, unique_words, repeated_words): shares of distinct phrases and words, and the rest."""
    all_words = words(predictions)
    unique = _share(F.size(F.array_distinct(all_words)), F.size(all_words))
    return F.struct(_share(F.size(F.array_distinct(predictions)), F.size(predictions)).alias("unique_phrases"), unique.alias("unique_words"), (1 - unique).alias("repeated_words"))


def _runs(tokens: list[str], size: int) -> Counter:
    return Counter(tuple(tokens[k : k + size]) for k in range(len(tokens) - size + 1))


def _smoothed(counts: list[tuple[int, int]], near: int, length: int) -> float:
    """BLEU of (matching runs, runs) of each size; a small count where none match, 0 where no word does."""
    if not counts[0][0]:
        return 0.0
    total = 0.0
    for hits, n in counts:
        total += math.log((hits or EPSILON) / max(1, n)) / len(counts)
    return math.exp(total + min(0.0, 1 - near / length))


def bleu(references: list[list[str]], hypothesis: list[str], n: int = 3) -> float:
    """Sentence BLEU with equal weights for runs of 1 to n words and a small count where none match."""
    if not hypothesis or not references:
        return 0.0
    counts = []
    for size in range(1, n + 1):
        own, most = _runs(hypothesis, size), Counter()
        for r in references:
            most |= _runs(r, size)
        counts.append((sum((own & most).values()), sum(own.values())))
    near = min((abs(len(r) - len(hypothesis)), len(r)) for r in references)[1]
    return _smoothed(counts, near, len(hypothesis))


def self_bleu_of(phrases: list[str], n: int = 3) -> float:
    """The mean BLEU of each phrase against the others; 0 for one phrase or none.

    Of each run its two highest counts and the holder of the first are kept, so a phrase's others are not gone
    through again.
    """
    tokens = [p.split() for p in phrases if p is not None]
    if len(tokens) < 2:
        return 0.0
    counts: list[list[tuple[int, int]]] = [[] for _ in tokens]
    for size in range(1, n + 1):
        own, top = [_runs(t, size) for t in tokens], {}
        for k, runs in enumerate(own):
            for run, m in runs.items():
                first, at, second = top.get(run, (0, -1, 0))
                if m > first:
                    top[run] = (m, k, first)
                elif m > second:
                    top[run] = (first, at, m)
        for k, runs in enumerate(own):
            hits = sum(min(m, top[run][2] if top[run][1] == k else top[run][0]) for run, m in runs.items())
            counts[k].append((hits, sum(runs.values())))
    lengths = Counter(map(len, tokens))
    near = {x: min((abs(y - x), y) for y, many in lengths.items() if y != x or many > 1)[1] for x in lengths}
    return sum(_smoothed(c, near[len(t)], len(t)) for t, c in zip(tokens, counts, strict=True)) / len(tokens)


def meteor_of(predicted: list[str], target: list[str]) -> float:
    """METEOR of two word lists: words align where they or their stems are equal, exact ones first, from the end."""
    left, right, pairs = list(enumerate(predicted)), list(enumerate(target)), []
    for key in (str.lower, lambda w: stem(w.lower())):
        places: dict[str, list[int]] = {}
        for k, (_, w) in enumerate(right):
            places.setdefault(key(w), []).append(k)
        gone, rest = set(), []
        for at, w in reversed(left):
            if places.get(key(w)):
                k = places[key(w)].pop()
                gone.add(k)
                pairs.append((at, right[k][0]))
            else:
                rest.append((at, w))
        left, right = rest[::-1], [x for k, x in enumerate(right) if k not in gone]
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:], strict=False))
    p, r = len(pairs) / len(predicted), len(pairs) / len(target)
    return p * r / (ALPHA * p + (1 - ALPHA) * r) * (1 - GAMMA * (chunks / len(pairs)) ** BETA)


def self_bleu(predictions: Column, n: int = 3) -> Column:
    @F.pandas_udf("double")
    def score(lists: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None else self_bleu_of(list(x), n) for x in lists], dtype="float64")

    return score(predictions)


def meteor(predictions: Column, targets: Column) -> Column:
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None or y is None else meteor_of(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score(words(predictions), words(targets))
