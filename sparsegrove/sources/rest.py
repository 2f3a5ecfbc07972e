"""Metadata services and shard downloads: batches of ids by POST, works by GET, and a data source of listed shards.

``collect`` asks a service for the ids of a table, a batch a request, and appends what it answers to a folder; ids that
the folder has are not asked for again, so a run that was ended goes on where it stood.  Each round writes a bounded
number of ids, and its rows appear when Spark commits the round: a lost executor repeats its own batches alone.

``ShardSource`` is a Spark data source (``spark.read.format("json_shards")``): the listing at its ``url`` names the
shards, each shard is a partition, read line by line on an executor.

Requests that fail for a while (status 429 and 5xx, broken connections) are repeated with growing pauses.
"""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.remote import ship
from ..operators.phrases import checkpointed
from ..operators.triplets import fetch, to_fetch

RETRIES, PAUSE = 5, 0.5
#: Ids of one round of ``collect``.
ROUND = 1_000_000


def answer(url: str, body: bytes | None = None, headers: dict[str, str] | None = None, retries: int = RETRIES, pause: float = PAUSE, timeout: float = 60):
    """An open response; waits pause, 2 * pause, ... between attempts."""
    for attempt in range(retries + 1):
        try:
            return urllib.request.urlopen(urllib.request.Request(url, body, headers or {}), timeout=timeout)
        except urllib.error.HTTPError as e:
            if attempt == retries or (e.code != 429 and e.code < 500):
                raise
        except (urllib.error.URLError, ConnectionError):
            if attempt == retries:
                raise
        time.sleep(pause * 2**attempt)


def posted(url: str, name: str = "ids", **how) -> Callable[[list], list[dict]]:
    """A request that posts ``{name: ids}`` and gets a list, one object an id or null for an unknown one."""

    def request(ids: list) -> list[dict]:
        headers = {"Content-Type": "application/json"} | how.get("headers", {})
        with answer(url, json.dumps({name: ids}).encode(), headers, **{k: v for k, v in how.items() if k != "headers"}) as found:
            return [r for r in json.load(found) if r is not None]

    return request


def works(url: str, **how) -> Callable[[list], list[dict]]:
    """A request that gets ``url`` with ids joined by ``|`` in place of ``{ids}``, and finds a list under ``results``."""

    def request(ids: list) -> list[dict]:
        with answer(url.replace("{ids}", "|".join(map(str, ids))), **how) as found:
            return json.load(found)["results"]

    return request


def saved(spark, folder: str, schema: str) -> DataFrame:
    """What ``collect`` has in a folder; empty without one."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def collect(ids: DataFrame, folder: str, schema: str, request: Callable[[list], list[dict]], size: int = 500, most: int = ROUND) -> DataFrame:
    """All metadata (schema, with a doc_id) of the ids (doc_id), fetched as far as the folder lacks them.

    size: ids a request; most: ids a round.  An id that the service doesn't know is asked for again by a later call.
    """
    spark = ids.sparkSession
    ship(spark)
    left = checkpointed(to_fetch(ids.select("doc_id").distinct(), saved(spark, folder, schema).select("doc_id")))
    rounds = -(-left.count() // most)
    for k in range(rounds):
        own = left.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)
        fetch(own, schema, request, size).write.mode("append").parquet(folder)
    return saved(spark, folder, schema)


class Shard(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class ShardReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.url, self.names = options["url"], names
        self.how = {"retries": int(options.get("retries", RETRIES)), "pause": float(options.get("pause", PAUSE))}

    def partitions(self) -> list[Shard]:
        """The listing is a JSON list of urls, or of objects with a ``url``."""
        with answer(self.url, **self.how) as found:
            return [Shard(s["url"] if isinstance(s, dict) else s) for s in json.load(found)]

    def read(self, partition: Shard) -> Iterator[Row]:
        with answer(partition.url, **self.how) as found:
            lines = gzip.GzipFile(fileobj=found) if partition.url.endswith(".gz") else found
            for line in lines:
                try:
                    row = json.loads(line)
                except ValueError:
                    row = None
                if isinstance(row, dict):  # faulty lines are left out, as in the other readers of lines
                    yield Row(**{name: as_text(row.get(name)) for name in self.names})


def as_text(value):
    return value if value is None or isinstance(value, str) else json.dumps(value)


class ShardSource(DataSource):
    """``json_shards``: JSON lines of the shards that a listing names, as columns of text (nested values stay JSON).

    Options: url of the listing; columns, comma-separated (``doc_id,title`` if not given); retries; pause.
    """

    @classmethod
    def name(cls) -> str:
        return "json_shards"

    def columns(self) -> list[str]:
        return [c.strip() for c in self.options.get("columns", "doc_id,title").split(",")]

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self.columns())

    def reader(self, schema) -> ShardReader:
        return ShardReader(dict(self.options), [f.name for f in schema.fields])


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(ShardSource)
