"""Temperature mixing of sources, realised as budgeted block permutations.  DataFrame functions only.

Weights.  A source with the share p of all tokens (words) gets a weight in proportion to p ** a.  At a = 1
sources keep their shares, at a = 0 all weigh the same.  The exponent is bisected, by ``WAYS`` parts a round,
to the target: an entropy of the weights, or a limit on how often the most repeated source is read.  Each
round is one aggregation over (source, exponent); only its ``WAYS + 1`` sums reach the driver.

Budget.  The mixture holds ``budget`` tokens; without one, as many as the source that is repeated least needs
to be read once.  A source's quota is its weight's part of the budget: so many whole epochs, and a rest.

Realisation.  A document's hash puts it into one of 256 blocks of its source and one of 256 cells of that
block.  Every epoch has its own permutation of the blocks (by a hash of seed, source, epoch and block).  A
whole epoch reads all blocks; the last, partial one reads blocks in their order while they fit in the rest,
then cells of the block that doesn't fit, then documents of the cell that doesn't fit, so the quota is
undershot by less than a document.  Windows only ever run over a source's 256 blocks, a block's 256 cells
or one cell's documents, and over token counts, never over texts; a hot source is pre-aggregated by cell.

The plan has one row a source.  It is broadcast if counted to be at most ``BROADCAST_SOURCES`` rows.

A null source is a source of its own, apart from the empty name; null and empty texts have no tokens, and a source without tokens is
read once.  Repeated rows of a document stay together.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint

WAYS = 32
ROUNDS = 9
BROADCAST_SOURCES = 10_000
SEED = "17"
#: The default limit on repetitions.
REPEATS = 4.0
WORD = r"[^\x20\x09-\x0D]+"

#: Tells the empty name from null.
SIGN = "\x01"

_NAMES = ("_source", "_tokens", "_block", "_cell", "_key")
ADDED = ("_epoch", "_block", "_tokens", "_weight", "_order", "_key")


def named_source(source: Column) -> Column:
    """The name of a source: nothing for null; the empty name and names that begin with ``SIGN`` get one more of it."""
    name = source.cast("string")
    return F.coalesce(F.when((name == "") | name.startswith(SIGN), F.concat(F.lit(SIGN), name)).otherwise(name), F.lit(""))


def keyed(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """``documents`` with _source, _tokens, _block, _cell and _key."""
    own = {c: F.col(f"`{c}`") if c in documents.columns else F.lit(None).cast("string") for c in ("doc_id", "text", "source")}
    documents = documents.select(*(own[c].alias(c) for c in own)) if documents.columns[-3:] != list(own) else documents
    name = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(own["doc_id"].cast("string"), F.lit("null"))).cast("binary"))
    return documents.withColumns({
        "_source": named_source(own["source"]),
        "_tokens": F.coalesce(F.regexp_count(own["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long"),
        "_block": F.substring(name, 1, 2), "_cell": F.substring(name, 3, 2), "_key": F.substring(name, 5, 28),
    })


def order_key(source: Column, epoch: Column, part: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), source, epoch.cast("string"), part).cast("binary"))


def exponent(sources: DataFrame, entropy: float | None, repeats: float | None, budget: float | None, rounds: int = ROUNDS) -> float:
    """The exponent for a table of (_source, tokens), all tokens above 0."""
    low, high = 0.0, 1.0
    grid = F.explode(F.sequence(F.lit(0), F.lit(WAYS)))
    total = sources.agg(F.sum("tokens")).first()[0]
    share = F.col("tokens") / F.lit(float(total or 1))
    for _ in range(rounds):
        a = F.lit(low) + F.col("way") * F.lit((high - low) / WAYS)
        rows = sources.withColumn("way", grid).withColumn("p", F.pow(share, a))
        sums = rows.groupBy("way").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"), F.max(F.col("p") / F.col("tokens")).alias("most"), F.max(F.col("tokens") / F.col("p")).alias("cover"))
        # entropy falls with the exponent, and so do repetitions
        if entropy is not None:
            over = F.log("z") - F.col("plogp") / F.col("z") > F.lit(float(entropy))
        else:
            over = F.col("most") * (F.col("cover") if budget is None else F.lit(float(budget)) / F.col("z")) > F.lit(float(repeats or REPEATS))
        last = sums.where(over).agg(F.max("way")).first()[0]
        if last is None:
            return low
        if last == WAYS:
            return high
        step = (high - low) / WAYS
        low, high = low + last * step, low + (last + 1) * step
    return high


def mixture(cells: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget: float | None = None) -> DataFrame:
    """(_source, tokens, weight, quota, whole, rest): each source's weight, quota, whole epochs and rest."""
    sources = shared_checkpoint(cells.groupBy("_source").agg(F.sum("tokens").alias("tokens")))
    full = sources.where("tokens > 0")
    a = exponent(full, entropy, repeats, budget)
    total = full.agg(F.sum("tokens")).first()[0]
    p = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))
    z, cover = full.agg(F.sum(p), F.max(F.col("tokens") / p)).first()
    amount = float(budget) if budget is not None else (cover or 0.0) * (z or 0.0)
    weight = F.when(F.col("tokens") > 0, p / F.lit(z or 1.0)).otherwise(F.lit(0.0))
    quota = F.round(weight * F.lit(amount)).cast("long")
    whole = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1)).cast("long")
    out = sources.withColumn("weight", weight).withColumn("quota", quota).withColumn("whole", whole)
    return out.withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))


def plan(documents: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget: float | None = None, seed: str = SEED) -> DataFrame:
    """One row a source: weight, whole epochs and where the partial epoch ends (block, cell and document)."""
    rows = keyed(documents, seed).select(*_NAMES)
    cells = shared_checkpoint(rows.groupBy("_source", "_block", "_cell").agg(F.sum("_tokens").alias("tokens")))
    mixed = shared_checkpoint(mixture(cells, entropy, repeats, budget))
    epoch = F.col("whole") + 1

    def boundary(parts: DataFrame, key: Column, order: list, names: tuple[str, str, str]) -> DataFrame:
        """(_source, key, part, tokens left) of the part that doesn't fit in what is left."""
        run = Window.partitionBy("_source").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow) if names[0] == "document_key" else Window.partitionBy("_source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ran = parts.withColumn("key", key).withColumn("run", F.sum("tokens").over(run))
        return ran.where("run > left AND run - tokens <= left").select("_source", F.col("key").alias(names[0]), F.col("part").alias(names[1]), (F.col("left") - F.col("run") + F.col("tokens")).alias(names[2]))

    blocks = cells.groupBy("_source", F.col("_block").alias("part")).agg(F.sum("tokens").alias("tokens"))
    blocks = blocks.join(mixed.select("_source", "whole", F.col("rest").alias("left")), "_source").where("left > 0")
    first = boundary(blocks, order_key(F.col("_source"), epoch, F.col("part"), seed), ["key", "part"], ("block_key", "block", "block_left"))
    inner = cells.join(first, "_source").where(F.col("_block") == F.col("block")).join(mixed.select("_source", "whole"), "_source")
    inner = inner.select("_source", F.col("_cell").alias("part"), "tokens", "whole", F.col("block_left").alias("left"))
    second = boundary(inner, order_key(F.col("_source"), epoch, F.concat(F.lit("cell"), F.col("part")), seed), ["key", "part"], ("cell_key", "cell", "cell_left"))
    ends = shared_checkpoint(mixed.join(first, "_source", "left").join(second, "_source", "left"))
    # documents of the one cell that doesn't fit, in the order of their hashes; equal ids stay together
    narrow = ends.select(F.col("_source"), F.col("block").alias("_block"), F.col("cell").alias("_cell"), "cell_left").where("cell IS NOT NULL")
    docs = rows.join(bounded(narrow), ["_source", "_block", "_cell"])
    ran = docs.groupBy("_source", "_key", "cell_left").agg(F.sum("_tokens").alias("tokens"))
    run = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = ran.withColumn("run", F.sum("tokens").over(run)).where("run <= cell_left").groupBy("_source").agg(F.max("_key").alias("last_key"))
    return shared_checkpoint(ends.join(last, "_source", "left").select("_source", "weight", "quota", "whole", "rest", "block_key", "block", "cell_key", "cell", "last_key"))


def bounded(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def realise(documents: DataFrame, planned: DataFrame, seed: str = SEED) -> DataFrame:
    """``documents`` with a row for each time it is read: _epoch (from 1), _block, _tokens, _weight, _order and _key.

    Sorting by (_epoch, _order, _key) gives the mixture's sequence; a hash spreads it over sources.  Columns of
    ``documents`` that are named like the plan's stay what they are; those named like the six added ones go.
    """
    own = [c for c in documents.columns if c not in ADDED]
    inner = [f"_column_{k}" for k in range(len(own))]
    taken = {c.lower(): k for k, c in enumerate(own)}
    plain = documents.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(own, inner)))
    plain = plain.withColumns({c: F.col(inner[taken[c]]) if c in taken else F.lit(None).cast("string") for c in ("doc_id", "text", "source")})
    rows = keyed(plain, seed).join(bounded(planned), "_source")
    epoch = F.col("whole") + 1
    key = order_key(F.col("_source"), epoch, F.col("_block"), seed)
    cell_key = order_key(F.col("_source"), epoch, F.concat(F.lit("cell"), F.col("_cell")), seed)
    in_cell = (F.col("_cell") == F.col("cell")) & (F.col("_key") <= F.col("last_key"))
    # equal keys can't come from two blocks, so the boundary is found by name and all before it by key
    in_block = (F.col("_block") == F.col("block")) & ((cell_key < F.col("cell_key")) & (F.col("_cell") != F.col("cell")) | in_cell)
    partial = (F.col("rest") > 0) & F.coalesce((key < F.col("block_key")) | in_block, F.lit(False))
    times = F.col("whole") + F.when(partial, 1).otherwise(0)
    copies = rows.withColumn("_times", times).where("_times > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    copies = copies.withColumns({"_order": order_key(F.col("_source"), F.col("_epoch"), F.col("_block"), seed), "_weight": F.col("weight")})
    return copies.select(*(F.col(k).alias(c) for c, k in zip(own, inner)), *ADDED)


def mix_sources(documents: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget: float | None = None, seed: str = SEED) -> DataFrame:
    """The realised mixture of ``documents`` (doc_id, text, source); see the module's text."""
    return realise(documents, plan(documents, entropy, repeats, budget, seed), seed)


def oracle(repeats: float = REPEATS, seed: str = SEED) -> str:
    """The mixture under a limit on repetitions and the covering budget, in SQL.

    There the exponent has a closed form: the smallest source is repeated (largest / smallest) ** (1 - a) times.
    """
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(CASE WHEN source = '' OR starts_with(source, chr(1)) THEN chr(1) || source ELSE source END, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens, md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
docs AS (SELECT doc_id, source, s, tokens, substr(h, 1, 2) AS block, substr(h, 3, 2) AS cell, substr(h, 5, 28) AS key FROM d),
sources AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS t FROM docs GROUP BY s),
e AS (SELECT CASE WHEN max(t) = min(t) THEN 0.0 ELSE greatest(0.0, 1 - ln({repeats}) / ln(CAST(max(t) AS DOUBLE) / min(t))) END AS a, CAST(max(t) AS DOUBLE) AS top, CAST(sum(t) AS DOUBLE) AS total FROM sources WHERE t > 0),
q AS (SELECT s, t, CASE WHEN t > 0 THEN CAST(round(t * pow(top / t, 1 - a)) AS BIGINT) ELSE 0 END AS quota, CASE WHEN t > 0 THEN pow(t / total, a) ELSE 0 END AS p FROM sources, e),
m AS (SELECT s, p / sum(p) OVER () AS weight, CASE WHEN t > 0 THEN quota // t ELSE 1 END AS whole, CASE WHEN t > 0 THEN quota % t ELSE 0 END AS rest FROM q),
b AS (SELECT s, block, sum(tokens) AS tokens, any_value(rest) AS rest, any_value(whole) AS whole, md5('{seed}|' || s || '|' || CAST(any_value(whole) + 1 AS VARCHAR) || '|' || block) AS k FROM docs JOIN m USING (s) GROUP BY s, block),
br AS (SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY k, block ROWS UNBOUNDED PRECEDING) AS run FROM b),
c AS (SELECT s, docs.block, cell, sum(docs.tokens) AS tokens, any_value(br.rest - br.run + br.tokens) AS room, md5('{seed}|' || s || '|' || CAST(any_value(whole) + 1 AS VARCHAR) || '|cell' || cell) AS k FROM docs JOIN br USING (s, block) WHERE br.run > br.rest AND br.run - br.tokens <= br.rest AND br.rest > 0 GROUP BY s, docs.block, cell),
cr AS (SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY k, cell ROWS UNBOUNDED PRECEDING) AS run FROM c),
dr AS (SELECT s, block, cell, key, any_value(cr.room - cr.run + cr.tokens) AS room, sum(docs.tokens) AS tokens FROM docs JOIN cr USING (s, block, cell) WHERE cr.run > cr.room AND cr.run - cr.tokens <= cr.room GROUP BY s, block, cell, key),
dd AS (SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY key ROWS UNBOUNDED PRECEDING) AS run FROM dr),
part AS (
  SELECT docs.doc_id, docs.s, docs.key FROM docs JOIN br USING (s, block) WHERE br.rest > 0 AND br.run <= br.rest
  UNION ALL SELECT docs.doc_id, docs.s, docs.key FROM docs JOIN cr USING (s, block, cell) WHERE cr.run <= cr.room
  UNION ALL SELECT docs.doc_id, docs.s, docs.key FROM docs JOIN dd USING (s, block, cell, key) WHERE dd.run <= dd.room),
times AS (SELECT docs.*, weight, whole + CASE WHEN p.key IS NULL THEN 0 ELSE 1 END AS n FROM docs JOIN m USING (s) LEFT JOIN (SELECT DISTINCT s, key FROM part) p ON docs.s = p.s AND docs.key = p.key)
SELECT doc_id, source, epoch, block, CAST(tokens AS BIGINT) AS tokens, round(weight, 6) AS weight, md5('{seed}|' || s || '|' || CAST(epoch AS VARCHAR) || '|' || block) AS order_key
FROM (SELECT *, unnest(range(1, n + 1)) AS epoch FROM times)
"""
