"""File formats of corpora, queries, judgements, triplets and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tsv(spark: SparkSession, path: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows with exactly these tab-separated fields, trimmed; and the number of faulty lines (one row, n)."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    good = F.size("f") == len(columns)
    return rows.where(good).select(*(F.trim(F.col("f")[k]).alias(c) for k, c in enumerate(columns))), rows.where(~good).agg(F.count(F.lit(1)).alias("n"))


def collection(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of ``id <tab> text``; further fields are joined by a blank."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 2).select(F.trim(f[0]).alias("doc_id"), F.array_join(F.transform(F.slice(f, 2, F.size(f)), lambda x: F.trim(x)), " ").alias("text"))


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) of lines with ``_id`` or ``id``; lines that are no JSON are dropped."""
    rows = spark.read.schema("_id string, id string, title string, text string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL").select(F.coalesce("_id", "id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) of a table with a header."""
    rows = spark.read.csv(path, sep="\t", header=True)
    q, d, s = rows.columns[:3]
    return rows.select(F.col(f"`{q}`").alias("query_id"), F.col(f"`{d}`").alias("doc_id"), F.col(f"`{s}`").try_cast("int").alias("rel"))


def trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) of four columns without a header."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(f) == 4).select(f[0].alias("query_id"), f[2].alias("doc_id"), f[3].try_cast("int").alias("rel"))


def distillation_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(query, positive, negative, positive_score, negative_score); and the number of faulty lines (one row, n)."""
    rows, faulty = tsv(spark, path, "query", "positive", "negative", "positive_score", "negative_score")
    return rows.withColumns({c: F.col(c).try_cast("double") for c in ("positive_score", "negative_score")}), faulty


def score_json(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of files that each hold one object of query, document and score; the best k."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("query_id", "scores"))
    rows = whole.select("query_id", F.explode("scores").alias("doc_id", "score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return rows if k is None else rows.where(F.col("rank") <= k)


def teacher_scores(scores: DataFrame, qrels: DataFrame, least: int) -> DataFrame:
    """Scores (query_id, doc_id, score) of queries with at least so many documents that are not relevant."""
    good = qrels.where("rel > 0").select("query_id", "doc_id")
    enough = scores.join(good, ["query_id", "doc_id"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return scores.join(enough.select("query_id"), "query_id", "left_semi")


def judged_queries(spark: SparkSession, path: str, qrels: DataFrame) -> DataFrame:
    """(query_id, text) of a JSON-lines file, of judged queries only."""
    return corpus_jsonl(spark, path).select(F.col("doc_id").alias("query_id"), "text").join(qrels.select("query_id"), "query_id", "left_semi")


def phrase_postings(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, doc_id) of all files of a folder that each hold one object of phrase and ids."""
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("phrase", "ids"))
    return lists.select("phrase", F.explode("ids").alias("doc_id")).distinct()


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines (also gzipped) in this schema, and the number of broken lines (one row, n)."""
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return parsed.where("_bad IS NULL").drop("_bad"), parsed.where("_bad IS NOT NULL").agg(F.count(F.lit(1)).alias("n"))


def titled_text(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of title, a blank and text, trimmed; a missing part is empty."""
    return documents.select("doc_id", F.trim(F.concat_ws(" ", "title", "text")).alias("text"))


def generated_queries(rows: DataFrame) -> DataFrame:
    """(doc_id, queries): the lower-cased queries of each document, in order."""
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.lower("query"))).alias("queries"))


def trec_run(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, rank, score) of six blank-separated columns."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(f) == 6).select(f[0].alias("query_id"), f[2].alias("doc_id"), f[3].cast("int").alias("rank"), f[4].cast("double").alias("score"))
    return rows if k is None else rows.where(F.col("rank") <= k)


def write_tsv(rows: DataFrame, path: str) -> None:
    """Columns joined by tabs; tabs and line ends inside a value become blanks."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in rows.columns]
    rows.select(F.concat_ws("\t", *clean).alias("value")).write.mode("overwrite").text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """One JSON line a document: id and vector (term to whole-number weight)."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("term").cast("string"), F.col("weight").cast("int")))))
    vectors.groupBy(F.col("doc_id").cast("string").alias("id")).agg(entries.alias("vector")).write.mode("overwrite").json(path)


def write_repeated_terms(vectors: DataFrame, path: str) -> None:
    """Lines of an id, a tab and each term as often as its whole-number weight says."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("term").cast("string").alias("term"), F.col("weight").cast("int").alias("weight"))))
    text = F.array_join(F.flatten(F.transform(entries, lambda e: F.array_repeat(e["term"], F.greatest(e["weight"], F.lit(0))))), " ")
    vectors.groupBy("doc_id").agg(text.alias("text")).select(F.concat_ws("\t", F.col("doc_id").cast("string"), "text").alias("value")).write.mode("overwrite").text(path)


def write_dense(vectors: DataFrame, path: str) -> None:
    """(doc_id, vector of floats) as Parquet."""
    vectors.select("doc_id", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)


def append_chunk(rows: DataFrame, path: str, chunk: int) -> None:
    """Rows of a chunk as JSON lines; a chunk that is written again takes the place of its earlier rows."""
    rows.write.mode("overwrite").json(f"{path}/chunk={chunk}")


def write_measures(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def document_text(rows: DataFrame) -> DataFrame:
    """(doc_id, text) of whatever columns there are: title and text, else body (bytes in ISO-8859-1) and url, else text alone."""
    has = lambda *names: all(c in rows.columns for c in names)
    if has("title", "text"):
        text = F.concat_ws(" ", "title", "text")
    elif has("body", "url"):
        body = F.decode("body", "ISO-8859-1") if dict(rows.dtypes)["body"] == "binary" else F.col("body")
        text = F.concat_ws(" ", body, "url")
    else:
        text = F.col("text")
    return rows.select("doc_id", F.trim(F.coalesce(text, F.lit(""))).alias("text"))


def paper_shards(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """Papers of gzipped JSON-lines shards.  A gzip file is one task to read, so rows are dealt anew at once if asked for."""
    rows = spark.read.schema(schema).json(path)
    return rows if partitions is None else rows.repartition(partitions)


def year_folders(spark: SparkSession, root: str, years: list[str], schema: str) -> DataFrame:
    """JSON-lines files in the named folders below a root, at any depth, with the folder each row comes from."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json([f"{root}/{y}" for y in years])
    place = F.regexp_extract(F.input_file_name(), "/(" + "|".join(years) + ")/", 1)
    return rows.withColumn("folder", place)


def keyphrase_benchmark(rows: DataFrame, key: str, title: str, abstract: str, keywords: str, separator: str = ";") -> DataFrame:
    """(doc_id, text, present, absent) of a benchmark's rows: lower-cased keywords, present where the text holds them.

    keywords: a text of keywords between separators, or an array.  The text is title, line end and abstract.
    """
    text = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(abstract), F.lit("")))
    words = F.split(F.coalesce(F.col(keywords), F.lit("")), separator) if dict(rows.dtypes)[keywords] == "string" else F.coalesce(F.col(keywords), F.array().cast("array<string>"))
    own = rows.select(F.col(key).alias("doc_id"), text.alias("text"), F.array_distinct(F.filter(F.transform(words, lambda w: F.trim(F.lower(w))), lambda w: w != "")).alias("_k"))
    inside = lambda want: F.filter("_k", lambda w: F.contains(F.lower("text"), w) == want)
    return own.select("doc_id", "text", inside(True).alias("present"), inside(False).alias("absent"))


#: Columns of benchmarks by family: (id, title, abstract, keywords, separator); a caller adds its own.
BENCHMARKS = {"semicolon": ("id", "title", "abstract", "keywords", ";"), "named": ("name", "title", "abstract", "keywords", ";"), "list": ("id", "title", "text", "keyphrases", ";"), "corpus": ("_id", "title", "text", "keywords", ",")}


def benchmark(rows: DataFrame, family: str) -> DataFrame:
    """``keyphrase_benchmark`` by a family's columns; a corpus without keywords has empty lists."""
    key, title, abstract, keywords, separator = BENCHMARKS[family]
    if keywords not in rows.columns:
        rows = rows.withColumn(keywords, F.lit(""))
    return keyphrase_benchmark(rows, key, title, abstract, keywords, separator)


def union_benchmarks(parts: dict[str, DataFrame]) -> DataFrame:
    """Benchmarks one after the other, ids prefixed by their names."""
    out = None
    for name, rows in parts.items():
        own = rows.select(F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")).alias("doc_id"), "text", "present", "absent")
        out = own if out is None else out.unionAll(own)
    return out


def query_lists(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, query) of files that each hold one object of document and query, or document and queries."""
    whole = spark.read.text(path, wholetext=True)
    lists = F.from_json("value", "map<string,array<string>>", {"mode": "PERMISSIVE"})
    single = F.transform_values(F.from_json("value", "map<string,string>"), lambda k, v: F.array(v))
    rows = whole.select(F.explode(F.when(F.forall(F.map_values(lists), lambda x: x.isNotNull()), lists).otherwise(single)).alias("doc_id", "queries"))
    return rows.select("doc_id", F.explode("queries").alias("query"))


def write_corpus_statistics(terms: DataFrame, corpus: DataFrame, path: str) -> None:
    """The state of a BM25 model: (term, df, idf) and one row (n_docs, avg_len), as Parquet."""
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def read_corpus_statistics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, term, weight) of a written index; a term without postings joins to nothing."""
    return spark.read.parquet(path)


def write_run(run: DataFrame, path: str) -> None:
    """One JSON line a query: query_id and hits (document to score)."""
    hits = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("doc_id").cast("string"), "score"))))
    run.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(hits.alias("hits")).write.mode("overwrite").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("query_id string, hits map<string,double>").json(path)
    return rows.select("query_id", F.explode("hits").alias("doc_id", "score"))


def write_performance(measures: DataFrame, path: str) -> None:
    """(dataset, measure, value) as one JSON line a dataset, measure to value."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("measure", "value"))))
    measures.groupBy("dataset").agg(entries.alias("measures")).write.mode("overwrite").json(path)


def compressed_rows(vectors: DataFrame) -> DataFrame:
    """(doc_id, indices, values): a compressed sparse row for each document, indices in order."""
    own = F.array_sort(F.collect_list(F.struct("term", "weight")))
    rows = vectors.groupBy("doc_id").agg(own.alias("x"))
    return rows.select("doc_id", F.transform("x", lambda e: e["term"]).alias("indices"), F.transform("x", lambda e: e["weight"]).alias("values"))


def from_compressed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode(F.arrays_zip(F.col("indices").alias("term"), F.col("values").alias("weight"))).alias("e")).select("doc_id", "e.*")


def missing_shards(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(shard) still to be fetched, by name."""
    return wanted.select("shard").distinct().join(present.select("shard"), "shard", "left_anti")
