"""Sentence boundaries learnt from a corpus without labels, and the splitter that uses them.

After Kiss and Strunk (2006): a word type is an abbreviation if a full stop follows it more often than chance allows, by
a log-likelihood ratio that is scaled for short types, inner stops and occurrences without a stop.  Knowing these,
two further tables are learnt: words that open sentences more often than chance, and pairs of a word with a full stop and
the next word that belong together ("no. 5").

Counts are aggregations by word type or pair, which Spark combines before it shuffles, so that a frequent word is no hot key.  A text
is cut into tokens with the white space behind them, in its row; only tokens that may end a sentence leave it,
meet the learnt tables, and come back as positions.

Null and empty texts have no sentences.  Rows that repeat a doc_id are one document in ``split``: give each row an id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .phrases import checkpointed
from .retrieval import bounded

ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: What stands around a word and is no part of it.
LEADING, TRAILING = "^[\"'(\\[“‘«]+", "[\"')\\],;:!?”’»]+$"


@dataclass
class Boundaries:
    """abbreviations: (type); starters: (type); collocations: (type, next)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def core(token: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "\\s+$", ""), TRAILING, ""), LEADING, ""))


def has_stop(word: Column) -> Column:
    return word.endswith(".") & ~word.endswith("..")


def word_type(word: Column) -> Column:
    """Without its full stop; all numbers are one type."""
    bare = F.regexp_replace(word, "\\.$", "")
    return F.when(bare.rlike("^[-+]?[0-9][0-9.,]*$"), "##number##").otherwise(bare)


def cut(text: Column) -> Column:
    """The tokens of a text, each with the white space behind it."""
    return F.regexp_extract_all(text, F.lit("\\S+\\s*"), F.lit(0))


def with_next(texts: DataFrame) -> DataFrame:
    """(doc_id, at, token, next) of each token; the last has no next."""
    tokens = texts.where(F.col("text").rlike("\\S")).select("doc_id", cut(F.col("text")).alias("tokens"))
    both = F.arrays_zip(F.col("tokens").alias("token"), F.slice("tokens", F.lit(2), F.size("tokens")).alias("next"))
    return tokens.select("doc_id", F.posexplode(both).alias("at", "z")).select("doc_id", "at", "z.token", "z.next")


def words(texts: DataFrame) -> DataFrame:
    """(type, stop, times) of the tokens that hold more than signs around words.

    Equal tokens are counted before they are looked at: a corpus has far fewer of them than occurrences.
    """
    tokens = texts.select(F.explode(F.split(F.col("text"), "\\s+")).alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    rows = tokens.select(core(F.col("token")).alias("word"), "times")
    return rows.select(word_type(F.col("word")).alias("type"), has_stop(F.col("word")).alias("stop"), "times").where("type <> ''")


def stop_pairs(texts: DataFrame) -> DataFrame:
    """(type, next_type, pairs): words with a full stop and the word behind each in its line, counted before they are looked at."""
    rows = with_next(texts).where(F.contains("token", F.lit(".")) & F.col("next").isNotNull())
    bare = lambda c: F.regexp_replace(c, "\\s+$", "")
    same = rows.where(~F.contains("token", F.lit("\n"))).select(bare("token").alias("token"), bare("next").alias("next")).groupBy("token", "next").agg(F.count(F.lit(1)).alias("times"))
    word = same.select(core(F.col("token")).alias("word"), core(F.col("next")).alias("next"), "times").where(has_stop(F.col("word")))
    typed = word.select(word_type(F.col("word")).alias("type"), word_type(F.col("next")).alias("next_type"), "times").where("type <> '' AND next_type <> ''")
    return typed.groupBy("type", "next_type").agg(F.sum("times").alias("pairs"))


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.log(y))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """(type, n_stop, n_plain, score) of types with a letter that a stop follows, from (type, n_stop, n_plain) of all."""
    total = counts.agg(F.sum(F.col("n_stop") + F.col("n_plain")).alias("n"), F.sum("n_stop").alias("stops"))
    chance = F.col("stops") / F.col("n")
    occurrences = F.col("n_stop") + F.col("n_plain")
    null = xlogy(F.col("n_stop"), chance) + xlogy(occurrences - F.col("n_stop"), 1 - chance)
    other = F.col("n_stop") * F.log(F.lit(0.99)) + (occurrences - F.col("n_stop")) * F.log(F.lit(0.01))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    ratio = 2 * (other - null)
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("n_plain").cast("double"))
    rows = counts.where("n_stop > 0").where(F.col("type").rlike("[a-z]")).crossJoin(F.broadcast(total))
    return rows.select("type", "n_stop", "n_plain", score.alias("score"))


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(*(F.sum(F.when(kept, F.col("times")).otherwise(0)).alias(name) for kept, name in ((F.col("stop"), "n_stop"), (~F.col("stop"), "n_plain"))))


def likelihood(a: Column, b: Column, both: Column, n: Column) -> Column:
    """The log-likelihood ratio that b follows a (a, b and both: how often; of n) for another reason than chance."""
    p, p1, p2 = b / n, both / a, F.try_divide(b - both, n - a)
    part = lambda k, m, x: xlogy(k, x) + xlogy(m - k, 1 - x)
    return -2 * (part(both, a, p) + part(b - both, n - a, p) - part(both, a, p1) - part(b - both, n - a, F.coalesce(p2, F.lit(0.0))))


def learn(texts: DataFrame) -> Boundaries:
    """The tables of a corpus (doc_id, text)."""
    # a row a type and pair with a stop: all that the tables are made of
    counts = checkpointed(type_counts(words(texts)))
    n = counts.agg(F.sum(F.col("n_stop") + F.col("n_plain"))).first()[0] or 0
    abbreviations = checkpointed(abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION).select("type"))
    pairs = checkpointed(stop_pairs(texts))
    known = bounded(abbreviations.withColumn("abbreviation", F.lit(True)))
    marked = pairs.join(known, "type", "left").withColumn("abbreviation", F.coalesce("abbreviation", F.lit(False)) | F.col("type").rlike("^[a-z]$|^##number##$"))
    totals = counts.select("type", (F.col("n_stop") + F.col("n_plain")).alias("total"))
    breaks = marked.where("NOT abbreviation").groupBy(F.col("next_type").alias("type")).agg(F.sum("pairs").alias("opens"))
    all_breaks = breaks.agg(F.sum("opens").alias("breaks"))
    opening = breaks.join(totals, "type").crossJoin(F.broadcast(all_breaks)).where(F.col("type").rlike("[a-z]"))
    strong = likelihood(F.col("breaks"), F.col("total"), F.col("opens"), F.lit(n)) >= STARTER
    starters = opening.where(strong & (F.lit(n) * F.col("opens") > F.col("total") * F.col("breaks"))).select("type")
    tied = marked.where("abbreviation").join(totals.withColumnRenamed("total", "a"), "type").join(totals.select(F.col("type").alias("next_type"), F.col("total").alias("b")), "next_type")
    bound = likelihood(F.col("a"), F.col("b"), F.col("pairs"), F.lit(n)) >= COLLOCATION
    collocations = tied.where(bound & (F.lit(n) * F.col("pairs") > F.col("a") * F.col("b"))).select("type", F.col("next_type").alias("next"))
    return Boundaries(abbreviations, checkpointed(starters), checkpointed(collocations))


def breaks(texts: DataFrame, tables: Boundaries) -> DataFrame:
    """(doc_id, at): tokens that a sentence ends with, but for a text's last one."""
    rows = with_next(texts).where("next IS NOT NULL").where(F.col("token").rlike("[.!?\n]")).withColumn("line_end", F.contains("token", F.lit("\n")))
    rows = rows.withColumn("bare", F.regexp_replace(F.regexp_replace("token", "\\s+$", ""), "[\"')\\]”’»]+$", ""))
    may = rows.where(F.col("line_end") | F.col("bare").rlike("[.!?]$"))
    word = core(F.col("bare"))
    may = may.select("doc_id", "at", "line_end", "bare", word_type(word).alias("type"), word_type(core(F.col("next"))).alias("next"), F.regexp_replace("next", LEADING, "").rlike("^\\p{Lu}").alias("upper"))
    flag = lambda t, name: bounded(t.withColumn(name, F.lit(True)))
    marked = may.join(flag(tables.abbreviations, "abbreviation"), "type", "left").join(flag(tables.collocations, "tied"), ["type", "next"], "left").join(flag(tables.starters.withColumnRenamed("type", "next"), "opens"), "next", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    stop = F.col("bare").endswith(".")
    ellipsis = F.col("bare").endswith("..")
    single = F.col("type").rlike("^\\p{L}$|^##number##$")
    ends = (
        F.when(F.col("line_end"), True)
        .when(~stop, True)
        .when(ellipsis, F.col("upper"))
        .when(yes("tied"), False)
        .when(yes("abbreviation"), F.col("upper") & yes("opens"))
        .when(single, F.col("upper") & yes("opens") | (F.col("upper") & (F.col("type") == "##number##")))
        .otherwise(True)
    )
    return marked.where(ends).select("doc_id", "at")


def split(texts: DataFrame, tables: Boundaries) -> DataFrame:
    """(doc_id, sentence, start, end, text): sentences in order from 0, code points, end exclusive, without outer white space."""
    own = texts.where(F.col("text").rlike("\\S")).select("doc_id", "text", cut(F.col("text")).alias("tokens"))
    ends = breaks(texts, tables).groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("ends"))
    joined = own.join(ends, "doc_id", "left")
    lasts = F.concat(F.coalesce("ends", F.array().cast("array<int>")), F.array(F.size("tokens") - 1))
    joined = joined.withColumn("lasts", lasts)
    firsts = F.concat(F.array(F.lit(0)), F.transform(F.slice("lasts", F.lit(1), F.size("lasts") - 1), lambda e: e + 1))
    parts = F.transform(F.arrays_zip(firsts.alias("a"), F.col("lasts").alias("b")), lambda z: F.array_join(F.slice("tokens", z["a"] + 1, z["b"] - z["a"] + 1), ""))
    each = joined.select("doc_id", F.length(F.regexp_extract("text", "^\\s*", 0)).alias("lead"), F.posexplode(parts).alias("sentence", "whole"))
    before = F.coalesce(F.sum(F.length("whole")).over(Window.partitionBy("doc_id").orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.withColumns({"start": (F.col("lead") + before).cast("int"), "text": F.regexp_replace("whole", "\\s+$", "")})
    return placed.select("doc_id", "sentence", "start", (F.col("start") + F.length("text")).cast("int").alias("end"), "text")
