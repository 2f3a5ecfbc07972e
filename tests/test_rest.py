"""Services and shards behind a stub on this machine: batches, retries, resumed runs, the data source."""

import gzip
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sparsegrove.sources import rest


@pytest.fixture()
def service():
    asked, fails = Counter(), Counter()
    sizes = []

    class Handler(BaseHTTPRequestHandler):
        def reply(self, body: bytes, status: int = 200):
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            ids = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["ids"]
            if fails["post"] > 0:
                fails["post"] -= 1
                return self.reply(b"busy", 503)
            sizes.append(len(ids))
            asked.update(ids)
            self.reply(json.dumps([None if i % 10 == 9 else {"doc_id": i, "title": f"title {i}"} for i in ids]).encode())

        def do_GET(self):
            host = f"http://127.0.0.1:{self.server.server_port}"
            if self.path == "/list":
                return self.reply(json.dumps([f"{host}/a.jsonl", {"url": f"{host}/b.jsonl.gz"}]).encode())
            if self.path == "/a.jsonl":
                return self.reply(b'{"doc_id": 1, "title": "one"}\nnot json\n{"doc_id": 2, "extra": [1]}\n')
            if self.path == "/b.jsonl.gz":
                if fails["get"] > 0:
                    fails["get"] -= 1
                    return self.reply(b"", 429)
                return self.reply(gzip.compress(b'{"doc_id": "x", "title": ["nested"]}\n'))
            if self.path.startswith("/works?ids="):
                return self.reply(json.dumps({"results": [{"doc_id": int(i), "title": "w"} for i in self.path.split("=")[1].split("%7C" if "%7C" in self.path else "|")]}).encode())
            self.reply(b"", 404)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, fails, sizes
    server.shutdown()


SCHEMA = "doc_id long, title string"


def test_collects_in_batches_and_goes_on(spark, tmp_path, service):
    url, asked, fails, sizes = service
    folder, request = str(tmp_path / "m"), rest.posted(f"{url}/batch", pause=0.01)
    fails["post"] = 3
    first = rest.collect(spark.range(40).select(rest.F.col("id").alias("doc_id")), folder, SCHEMA, request, size=7, most=15)
    assert {r["doc_id"]: r["title"] for r in first.collect()} == {i: f"title {i}" for i in range(40) if i % 10 != 9}
    assert max(sizes) <= 7 and set(asked.values()) == {1}
    again = rest.collect(spark.range(60).select(rest.F.col("id").alias("doc_id")), folder, SCHEMA, request, size=7)
    assert again.count() == again.distinct().count() == 54
    # known ids once, unknown ones (that end in 9) again
    assert all(n == (2 if i % 10 == 9 and i < 40 else 1) for i, n in asked.items())


def test_works_by_id_and_errors(spark, tmp_path, service):
    url, *_ = service
    got = rest.collect(spark.range(5).select(rest.F.col("id").alias("doc_id")), str(tmp_path / "w"), SCHEMA, rest.works(f"{url}/works?ids={{ids}}", pause=0.01), size=2)
    assert sorted(map(tuple, got.collect())) == [(i, "w") for i in range(5)]
    with pytest.raises(rest.urllib.error.HTTPError):
        rest.answer(f"{url}/nowhere", pause=0.01)


def test_shards_are_partitions_of_a_data_source(spark, service):
    url, _, fails, _ = service
    fails["get"] = 2
    rest.register(spark)
    rows = spark.read.format("json_shards").option("url", f"{url}/list").option("columns", "doc_id,title,extra").option("pause", "0.01").load()
    assert rows.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, rows.collect()), key=str) == [("1", "one", None), ("2", None, "[1]"), ("x", '["nested"]', None)]
