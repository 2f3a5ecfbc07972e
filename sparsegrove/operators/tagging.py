"""A part-of-speech tagger: a hidden Markov model counted by Spark from a labelled table, decoded by Viterbi in batches.

Counts of tags, pairs of tags and (word, tag) are aggregations.  What the model keeps of them is bounded: pairs of
tags, the ``MOST_WORDS`` most frequent words, and the ``MOST_ENDINGS`` most frequent endings of up to ``LONGEST`` letters, which
stand for words that it doesn't know (the longest ending that it has; without one the tags of words seen once).  It travels to the executors
in the function's closure, and each text is tagged whole, where it lies.

Null and empty texts have no tags.  Ties go to the tag that comes first by name.  A model of an empty table gives no
token a tag (null).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.remote import on_workers

MOST_WORDS, MOST_ENDINGS, LONGEST = 100_000, 20_000, 4
#: What is added to each count of a pair of tags, and to each of a word's or ending's tags in proportion to how frequent the tag is.
ADDED = 0.1
#: Cells (texts times tokens) that are decoded at once; a longer text is a batch of its own.
CELLS = 1 << 16


@dataclass
class Tagger:
    """tags; start (tags), pairs (tags, tags): log probabilities; words, endings: rows of ``known``, (n, tags) log weights; other."""

    tags: list[str]
    start: np.ndarray
    pairs: np.ndarray
    words: dict[str, int]
    endings: dict[str, int]
    known: np.ndarray
    other: np.ndarray

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Log of how much more likely each token is under a tag than at all, up to a constant of the token."""
        out = np.empty((len(tokens), len(self.tags)))
        for i, token in enumerate(tokens):
            row = self.words.get(token, -1)
            for n in range(min(LONGEST, len(token)), 0, -1):
                if row >= 0:
                    break
                row = self.endings.get(token[-n:].lower(), -1)
            out[i] = self.known[row] if row >= 0 else self.other
        return out

    def decode(self, emissions: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The likeliest tags (texts, tokens) of padded (texts, tokens, tags); ``live``: which cells hold a token, from the left."""
        n, m, t = emissions.shape
        back = np.zeros((n, m, t), np.int16)
        score = self.start + emissions[:, 0]
        for k in range(1, m):
            ways = score[:, :, None] + self.pairs
            back[:, k] = ways.argmax(1)
            score = np.where(live[:, k, None], ways.max(1) + emissions[:, k], score)
        out = np.zeros((n, m), np.int64)
        last = live.sum(1) - 1
        at = score.argmax(1)
        for k in range(m - 1, -1, -1):
            at = np.where(k < last, back[np.arange(n), min(k + 1, m - 1), at], at) if k + 1 < m else at
            out[:, k] = at
        return out


def learn(labelled: DataFrame, most_words: int = MOST_WORDS) -> Tagger:
    """A tagger from (tokens, tags), arrays of one length; tokens beyond the shorter one, and null ones, don't count."""
    both = labelled.select(F.filter(F.arrays_zip(F.col("tokens").alias("token"), F.col("tags").alias("tag")), lambda z: z["token"].isNotNull() & z["tag"].isNotNull()).alias("z")).where("size(z) > 0")
    rows = both.select(F.explode("z").alias("z")).select("z.token", "z.tag")
    counts = {r["tag"]: r["n"] for r in rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    tags = sorted(counts)
    place = {t: k for k, t in enumerate(tags)}
    share = np.array([counts[t] for t in tags], float)
    share /= max(share.sum(), 1)
    follow = F.transform(F.slice("z", F.lit(2), F.size("z")), lambda z, i: F.struct(F.col("z")[i]["tag"].alias("a"), z["tag"].alias("b")))
    first = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.col("z")[0]["tag"].alias("b")))
    pairs = np.full((len(tags) + 1, len(tags)), ADDED)
    for r in both.select(F.explode(F.concat(first, follow)).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect():
        pairs[place[r["a"]] if r["a"] is not None else len(tags), place[r["b"]]] += r["n"]
    pairs = np.log(pairs / pairs.sum(1, keepdims=True)) if tags else np.zeros((1, 0))

    def table(names: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
        top = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)
        found = names.join(F.broadcast(top.select("name")), "name").groupBy("name", "tag").agg(F.count(F.lit(1)).alias("n")).toArrow()
        keys = found["name"].combine_chunks().dictionary_encode()
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        out = np.zeros((len(keys.dictionary), len(tags)))
        out[keys.indices.to_numpy(), [place[t] for t in found["tag"].to_pylist()]] = found["n"].to_numpy()
        return keys.dictionary.to_pylist(), out

    words, of_words = table(rows.select(F.col("token").alias("name"), "tag"), most_words)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("token"))), lambda n: F.lower(F.right("token", n)))
    endings, of_endings = table(rows.where("token <> ''").select(F.explode(ends).alias("name"), "tag"), MOST_ENDINGS)
    seen = np.vstack([of_words, of_endings]) if tags else np.zeros((0, 0))
    # P(tag | word) / P(tag), which is P(word | tag) up to a constant of the word
    weight = lambda x: np.log((x + ADDED * share) / (x.sum(-1, keepdims=True) + ADDED) / share)
    rare = of_words[of_words.sum(1) == 1].sum(0) if len(of_words) else np.zeros(len(tags))
    return Tagger(tags, pairs[-1], pairs[:-1], {w: k for k, w in enumerate(words)}, {e: len(words) + k for k, e in enumerate(endings)}, weight(seen), weight(rare))


def tag_batches(batches, tagger: Tagger):
    for rows in batches:
        lists = [[t or "" for t in own or []] for own in rows.column(1).to_pylist()]
        out: list[list[str | None]] = [[None] * len(own) for own in lists]
        order = sorted((k for k, own in enumerate(lists) if own), key=lambda k: len(lists[k])) if tagger.tags else []
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop + 1 - start) * len(lists[order[stop]]) <= CELLS:
                stop += 1
            group = order[start:stop]
            sizes = np.array([len(lists[k]) for k in group])
            live = np.arange(sizes.max()) < sizes[:, None]
            emissions = np.zeros((*live.shape, len(tagger.tags)))
            emissions[live] = tagger.emissions([t for k in group for t in lists[k]])
            for k, own in zip(group, tagger.decode(emissions, live)):
                out[k] = [tagger.tags[t] for t in own[: len(lists[k])]]
            start = stop
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.list_(pa.string()))], ["doc_id", "tokens", "tags"])


def tag(texts: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, tokens, tags) of (doc_id, tokens): what ``phrases.noun_phrases`` takes."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "tokens").mapInArrow(on_workers(texts.sparkSession, __name__, "tag_batches", tagger), f"doc_id {kind}, tokens array<string>, tags array<string>")
