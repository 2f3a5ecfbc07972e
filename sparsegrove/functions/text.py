"""Text functions as column expressions; only what no built-in can say is an Arrow UDF."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, a fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip_punctuation(text: Column) -> Column:
    return F.btrim(text, F.lit(PUNCTUATION))


def clean_title(title: Column) -> Column:
    """Lower case, outer blanks and punctuation gone."""
    return strip_punctuation(F.trim(F.lower(title)))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def keep_length_et_al(text: Column) -> Column:
    return F.replace(text, F.lit("et al."), F.lit("et al "))


def blank_spans(text: Column, spans: Column) -> Column:
    """Spaces over each span (struct of start and end, from 0, end exclusive); the length stays."""
    return F.aggregate(spans, text, lambda t, s: F.overlay(t, F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))


def simple_tokens(text: Column, lower: bool = True) -> Column:
    """Split on hyphens, commas, parentheses and white space."""
    return F.filter(F.split(F.lower(text) if lower else text, r"[-,()\s]+"), lambda t: t != "")


#: White space of ``\\s``, and what parts tokens: any run of punctuation and white space that holds white space.
_BLANKS = " \t\n\x0b\f\r"
_PUNCT_CLASS = re.escape(PUNCTUATION).replace("\\ ", " ")
#: Letters fail at the first look; a run is tried from its first sign alone, so long runs take linear time.
_BETWEEN = rf"(?=[{_PUNCT_CLASS}\s])(?<![{_PUNCT_CLASS}])[{_PUNCT_CLASS}]*+\s[{_PUNCT_CLASS}\s]*+"


def search_tokens(text: Column, stopwords: Column | None = None) -> Column:
    """Lower case, white space, outer punctuation gone, no empty or stop words.

    Punctuation at the ends of a token touches white space or the text's ends, so one split at the runs between
    tokens does it; no function of elements runs.
    """
    trimmed = F.btrim(F.lower(text), F.lit(PUNCTUATION + _BLANKS))
    words = F.when(trimmed != "", F.split(trimmed, _BETWEEN)).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))
    return words if stopwords is None else F.filter(words, lambda t: ~F.array_contains(stopwords, t))


def without_stopwords(text: Column, stopwords: Column) -> Column:
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: ~F.array_contains(stopwords, F.lower(w))), " ")


def first_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def clean_keyphrase(phrase: Column) -> Column:
    """Outer blanks, word-piece marks, and blanks inside ``[ digit ]`` gone."""
    return F.replace(F.replace(F.trim(phrase), F.lit(" ##"), F.lit("")), F.lit("[ digit ]"), F.lit("[digit]"))


def split_source(source: Column) -> Column:
    """Title and context of ``title [sep] context``."""
    parts = F.split(source, r"\[sep\]")
    return F.struct(F.trim(parts[0]).alias("title"), F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("context"))


def anonymise(text: Column) -> Column:
    """Lower case, ASCII only, urls, addresses and numbers of telephones replaced by their kinds."""
    text = F.regexp_replace(F.lower(text), r"https?://\S+|www\.\S+", "<url>")
    text = F.regexp_replace(text, r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "<email>")
    text = F.regexp_replace(text, r"\+?\(?[0-9]{2,4}\)?[ -]?[0-9]{3}[ -]?[0-9]{3,5}", "<phone>")
    return F.trim(collapse(F.regexp_replace(text, r"[^\x00-\x7F]", "")))


def term_key(term: Column) -> Column:
    return F.replace(term, F.lit(" "), F.lit("-"))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def unescape_query(text: Column) -> Column:
    return F.translate(text, "\n\t", "")


def from_positions(positions: Column) -> Column:
    """Text of a map from words to their positions; a position without a word is an empty one."""
    pairs = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    last = F.array_max(F.transform(pairs, lambda x: x["p"]))
    by_place = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["p"], x["w"])))
    return F.array_join(F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.coalesce(F.try_element_at(by_place, i), F.lit(""))), " ")


def source_text(title: Column, abstract: Column) -> Column:
    """``title . abstract``, as sources of keyphrase sets are written; nulls are empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" . "), F.coalesce(abstract, F.lit("")))


def position_score(text: Column, phrase: Column) -> Column:
    """1 + 1 / log2(words before the phrase + 2); 1 where it is absent."""
    at = F.instr(text, phrase)
    before = F.size(F.filter(F.split(F.substring(text, F.lit(1), at - 1), r"\s+"), lambda w: w != ""))
    return F.when(at > 0, 1 + 1 / F.log2(before + 2)).otherwise(F.lit(1.0))


#: Words between the white space of ``\\s``.
_WORD = re.compile(rf"[^{_BLANKS}]+")


def position_scores():
    """An Arrow UDF of (text, phrases): ``position_score`` of each of a text's phrases, its words counted once."""

    @F.pandas_udf("array<double>")
    def scores(texts: pd.Series, phrases: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, phrases, strict=True):
            starts = [m.start() for m in _WORD.finditer(text or "")]
            places = [-1 if text is None else text.find(p) for p in own]
            out.append([1.0 if at < 0 else 1 + 1 / (math.log(bisect_left(starts, at) + 2) / math.log(2)) for at in places])
        return pd.Series(out)

    return scores


def fuzzy_ratio(name_a: str = "a", name_b: str = "b"):
    """An Arrow UDF: 100 * 2 * longest common subsequence / total length (100 for two empty texts, null for a null one)."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


def indel_ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    # the subsequence's length, a bit for each letter of a (Hyyro's recurrence)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = (~row & full).bit_count()
    return 200.0 * common / (len(a) + len(b))


_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?=\s|$)|\n|$|[.!?])", re.S)


def sentence_spans():
    """An Arrow UDF: (start, end) of sentences, split after . ! ? before white space, and at line ends."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: [{"start": m.start(), "end": m.end()} for m in _SENTENCE.finditer(x or "") if m[0].strip()])

    return spans


def timestamp_text(at: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(at, pattern)


def id_part(name: Column, separator: str, place: int) -> Column:
    """The part of an id at a place (from 1, from the end if negative) between separators; empty beyond the last."""
    return F.split_part(name, F.lit(separator), F.lit(place))


def without_prefix(entries: Column, prefix: str) -> Column:
    """A map without the keys that begin with the prefix."""
    return F.map_filter(entries, lambda k, v: ~F.startswith(k, F.lit(prefix)))


def with_prefix(entries: Column, prefix: str) -> Column:
    """The entries whose keys begin with the prefix, which goes."""
    kept = F.map_filter(entries, lambda k, v: F.startswith(k, F.lit(prefix)))
    return F.transform_keys(kept, lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def rename_keys(entries: Column, names: dict[str, str]) -> Column:
    """A map with some keys renamed."""
    if not names:
        return entries
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.transform_keys(entries, lambda k, v: F.coalesce(F.try_element_at(table, k), k))


def slices(rows, n: int, order: str, key: str | None = None):
    """``rows`` with slice: n contiguous parts of like size (of each key's rows) in order, from 1; the first ones are the larger."""
    from pyspark.sql import Window

    by = Window.orderBy(order) if key is None else Window.partitionBy(key).orderBy(order)
    return rows.withColumn("slice", F.ntile(n).over(by))


def long_tokens(text: Column, least: int = 3) -> Column:
    """Blank-separated tokens without outer punctuation, of ``least`` signs or more."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), strip_punctuation), lambda t: F.length(t) >= least)


def multi_word(term: Column, number: Column, first: int) -> Column:
    """Whether a vocabulary entry is one of the added phrases (from this number on) and has several words."""
    return F.contains(term, F.lit(" ")) & (number >= first)


def at_most_words(phrase: Column, n: int = 3) -> Column:
    return F.size(simple_tokens(phrase)) <= n


def word_pieces(path: str):
    """An Arrow UDF: token texts of a public tokenizer's file, read once a Python worker."""

    @F.pandas_udf("array<string>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for t in texts:
            found = tokenizer.encode_batch(t.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([x.tokens for x in found])

    return pieces
