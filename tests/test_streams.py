"""Streaming operators against the same rules on plain rows."""

import datetime as dt

import pytest

from sparsegrove.streaming import streams as S

BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROWS = [(k, BEGIN + dt.timedelta(seconds=s), f"u{k % 2}", t) for k, (s, t) in enumerate([(0, "a"), (5, "b"), (30, "a"), (31, "c"), (32, "c"), (200, "a"), (203, "d"), (400, "e")])]
SCHEMA = "id long, ts timestamp, user string, text string"


@pytest.fixture()
def stream(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.json(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in")


def run(df, mode="append"):
    name = f"t{abs(hash(df.schema.json())) % 10**8}{mode}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_window_counts(spark, stream):
    got = run(S.window_counts(stream, "ts", "user", "1 minute", "10 seconds"), "complete")
    want = S.window_counts(spark.createDataFrame(ROWS, SCHEMA), "ts", "user", "1 minute", "10 seconds").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r["n"] for r in got) == len(ROWS)


def test_sessions(spark, stream):
    got = run(S.gap_sessions(stream, "ts", "user", "20 seconds", "10 seconds"), "complete")
    want = S.gap_sessions(spark.createDataFrame(ROWS, SCHEMA), "ts", "user", "20 seconds", "10 seconds").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r["n"] for r in got) == len(ROWS)


def test_distinct_texts(stream):
    got = run(S.distinct_texts(stream, "ts", "text", "1 hour"))
    assert sorted(r["text"] for r in got) == ["a", "b", "c", "d", "e"]


def test_running_gap_groups(stream):
    got = run(S.running_gap_groups(stream, "user", "ts", 60.0))
    groups = {}
    for k, t, u, _ in ROWS:
        groups.setdefault(u, []).append(t)
    want = []
    for u, times in groups.items():
        g = 0
        for i, t in enumerate(sorted(times)):
            g += bool(i) and (t - sorted(times)[i - 1]).total_seconds() >= 60
            want.append((u, t.replace(tzinfo=None), g))
    assert sorted((r["user"], r["at"], r["group"]) for r in got) == sorted(want)


def test_gap_groups_that_expire(spark, tmp_path):
    """Files come one a trigger: groups go on across triggers, and keys whose group is over leave the state."""
    folder = f"{tmp_path}/in"
    parts = [[("a", 0), ("b", 2), ("a", 20)], [("a", 50), ("c", 55)], [("d", 400)], [("d", 405), ("a", 420)], [("e", 900)], [("e", 901)]]
    for k, own in enumerate(parts):
        rows = [(u, BEGIN + dt.timedelta(seconds=s)) for u, s in own]
        spark.createDataFrame(rows, "user string, ts timestamp").coalesce(1).write.json(f"{folder}/part={k}")
    stream = spark.readStream.schema("user string, ts timestamp, part int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(folder)
    out = S.expiring_gap_groups(stream, "user", "ts", 60.0, "10 seconds")
    q = out.writeStream.format("memory").queryName("expiring").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    seconds = lambda t: int((t - BEGIN.replace(tzinfo=None)).total_seconds())
    got = sorted((r["user"], seconds(r["at"]), seconds(r["begin"])) for r in spark.table("expiring").collect())
    assert got == [("a", 0, 0), ("a", 20, 0), ("a", 50, 0), ("a", 420, 420), ("b", 2, 2), ("c", 55, 55), ("d", 400, 400), ("d", 405, 400), ("e", 900, 900), ("e", 901, 900)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) <= 4 and held[-1] == 1  # of five keys
