"""Structured-streaming forms of counting, sessions, gap groups and content-distinct rows.

Each takes a streaming DataFrame (or a plain one: the same rows then come out at once, but for the gap groups) and
keeps state that the watermark bounds, but for ``running_gap_groups``, whose numbers go on for ever and so keep a row a key.  Rows
later than the watermark are dropped, as Spark defines it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(rows: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(start, key, n): how often each key occurs in windows of ``width``, for rows at most ``late`` behind."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def gap_sessions(rows: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): runs of rows with less than ``gap`` between one and the next."""
    return rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_texts(rows: DataFrame, time: str, text: str, late: str) -> DataFrame:
    """The first row of each text (by SHA-256) within the watermark; texts repeat only beyond it."""
    return rows.withColumn("_name", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["_name"]).drop("_name")


def moments(times: pd.Series) -> pd.Series:
    """Seconds since 1970 of times, in order."""
    times = times.sort_values()
    return pd.Series(times.to_numpy("datetime64[us]").astype("int64") / 1e6, index=times.index)


def expiring_gap_groups(rows: DataFrame, key: str, time: str, gap: float, late: str) -> DataFrame:
    """(key, at, begin): each row with the time at which its group began; a new one begins ``gap`` seconds or more after the row before.

    Named by its beginning a group needs no number, so a key's state (two times) goes when the watermark, ``late`` behind
    the latest row, has passed the end of its group: a timer of each key sees to that.  Rows of a trigger are taken in order
    of time.
    """
    kind = dict(rows.dtypes)[key]

    def update(own: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, begin = state.get if state.exists else (None, None)
        at, begins = moments(pd.concat([p["at"] for p in parts])), []
        for t in at:
            if last is None or t - last >= gap:
                begin = t
            last = t if last is None else max(last, t)
            begins.append(begin)
        state.update((float(last), float(begin)))
        state.setTimeoutTimestamp(max(int((last + gap) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        as_time = lambda x: pd.to_datetime((pd.Series(x) * 1e6).round().astype("int64").to_numpy(), unit="us")
        yield pd.DataFrame({key: [own[0]] * len(begins), "at": as_time(at.to_numpy()), "begin": as_time(begins)})

    named = rows.select(key, F.col(time).alias("at")).withWatermark("at", late)
    return named.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, at timestamp, begin timestamp", "last double, begin double", "append", "EventTimeTimeout")


def running_gap_groups(rows: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """(key, at, group): each row with the number of its group; a new one begins ``gap`` seconds or more after the row before.

    A key's state is its last time and group number.  Rows of a trigger are taken in order of time; one that comes
    late counts to the group that is open.
    """
    kind = dict(rows.dtypes)[key]

    def update(own: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, group = state.get if state.exists else (None, 0)
        times = pd.concat([p["at"] for p in parts]).sort_values()
        groups = []
        for t in times.astype("int64") / 1e9 if times.dtype.kind == "M" and times.dt.unit == "ns" else times.map(lambda x: x.timestamp()):
            if last is not None and t - last >= gap:
                group += 1
            last = t if last is None else max(last, t)
            groups.append(group)
        state.update((float(last), int(group)))
        yield pd.DataFrame({key: [own[0]] * len(groups), "at": times.to_numpy(), "group": groups})

    named = rows.select(key, F.col(time).alias("at"))
    return named.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, at timestamp, `group` long", "last double, grp long", "append", "NoTimeout")


def index_stream(vectors: DataFrame, folder: str, checkpoint: str):
    """Append a stream of (doc_id, term, weight) to an inverted index, a batch of it for each batch of the stream.

    A batch that the stream repeats after a failure replaces what it wrote before.  A document's postings arrive in one
    batch.
    """
    from ..operators import index

    return vectors.writeStream.foreachBatch(lambda rows, batch: index.write(rows, folder, batch)).option("checkpointLocation", checkpoint)
