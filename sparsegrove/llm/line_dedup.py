"""Lines that many documents share: exploded, hashed, counted by distinct documents, dropped, reassembled by position.

A text is split at ``\\n``; a line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased.  Keys
of ``min_chars`` code points or more that occur in ``min_docs`` documents or more lose all their lines except in the
largest doc_id that holds them.

Three steps, all in the JVM.  (1) Each line that is long enough becomes a row of 128 bits of hash, its document and
its position; distinct documents are counted by key, which Spark first combines by (key, document) and then by key, so
a line of a third of all documents is no hot key.  (2) The rows meet the common keys again.  ``HOT_KEYS`` keys at most
can hold more than that fraction of all common lines each, so the hottest are a broadcast of proven size: their
rows are salted, the others' aren't.  (3) The positions to drop, as many as the text has lines at most, join their
document, and the other positions are put together again.  Texts are shuffled once, in step 3.

Defined cases: null text is an empty one, and has one empty line.  Rows of one doc_id are one document when documents
are counted, and each is a row of the result; null ids aren't counted as documents and never hold a line on.  Empty
tables give no rows; further columns of any name are carried along by ``dedup_documents``.  Long texts are split within
one row, and neither rows nor positions of it depend on other documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, shared_checkpoint

MIN_CHARS, MIN_DOCS = 40, 5
#: The most keys that are broadcast; each holds more than 1 / HOT_KEYS of the common lines.
HOT_KEYS = 8192
#: Tasks that share the rows of one such key.
SALTS = 64

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, version, position, a, b): each line whose key is long enough; a and b are 128 bits of its hash."""
    keys = F.transform(split_lines(F.translate("text", UPPER, LOWER)), lambda line: F.trim(line, F.lit(SPACE)))
    lines = rows.select("doc_id", "version", F.posexplode(keys).alias("position", "key")).where(F.length("key") >= min_chars)
    return lines.select("doc_id", "version", "position", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def common_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(a, b, keeper, n_lines): keys of that many documents, the largest of them, and how many lines there are."""
    counted = lines.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n_lines"))
    return counted.where(F.col("n_docs") >= min_docs).drop("n_docs")


def dropped_positions(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, version, positions): which lines go, for texts that lose any."""
    lines = line_rows(rows, min_chars)
    common = shared_checkpoint(common_keys(lines, min_docs))
    total = common.agg(F.sum("n_lines")).first()[0] or 0
    hot = F.col("n_lines") * HOT_KEYS > F.lit(total)  # fewer than HOT_KEYS keys: their lines add up to the total at most
    marked = lines.join(F.broadcast(common.where(hot).select("a", "b", F.lit(True).alias("is_hot"))), ["a", "b"], "left")
    salted = marked.withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id", "version", "position"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    held = common.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    gone = salted.join(held.select("a", "b", "salt", "keeper"), ["a", "b", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "version").agg(F.collect_set("position").alias("positions"))


def dedup(documents: DataFrame, min_chars: int, min_docs: int, carried: Column) -> DataFrame:
    """(row, doc_id, text, n_lines, n_dropped); ``row`` is what ``carried`` makes of a document."""
    # a text is named by its document and its hash, so rows of one doc_id (or of none) each keep their own positions
    rows = need(documents, doc_id="long", text="string") if carried is None else documents.select(carried.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("version", F.xxhash64("text"))
    gone = dropped_positions(rows.select("doc_id", "version", "text"), min_chars, min_docs)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"), "positions")
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left")
    split = joined.withColumn("lines", split_lines(F.col("text"))).withColumn("n_lines", F.size("lines").cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("positions"))
    text = F.when(F.col("positions").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    n_dropped = F.coalesce(F.size("positions"), F.lit(0)).cast("long")
    return split.select(*(["row"] if carried is not None else []), "doc_id", text.alias("text"), "n_lines", F.when(F.col("positions").isNull(), F.lit(0)).otherwise(n_dropped).cast("long").alias("n_dropped"))


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each row's text without common lines, its lines before, and how many went."""
    return dedup(documents, min_chars, min_docs, None)


def dedup_documents(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, all columns as they were, with their texts without common lines."""
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    cleaned = dedup(documents, min_chars, min_docs, whole)
    return cleaned.select(*(F.col("text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns))


def oracle(min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS position FROM docs),
keyed AS (SELECT *, translate(trim(line, {space}), '{UPPER}', '{LOWER}') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
judged AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""
