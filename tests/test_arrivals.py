"""Answers in order of arrival, the data source of completions, and the keyed sink across failures."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lexgauge.operators.responses import judged
from lexgauge.sources import completion_source, completions
from lexgauge.streaming.keyed_sink import KeyedSink, follow_keyed


@pytest.fixture(scope="module")
def server():
    """Answers a number of seconds late, as the text says; ``most`` is how many requests were out at once."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_POST(self):
            with self.server.lock:
                self.server.now += 1
                self.server.most = max(self.server.most, self.server.now)
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
            time.sleep(float(text))
            body = json.dumps({"choices": [{"message": {"content": f"after {text}"}, "finish_reason": "stop"}]}).encode()
            with self.server.lock:
                self.server.now -= 1
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.now = s.most = 0
    s.lock = threading.Lock()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def payload(text):
    return json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": text}]})


WAITS = ["2.5"] + ["0.05"] * 9


def test_a_slow_request_holds_no_other_back(server):
    to = completions.Server(f"http://127.0.0.1:{server.server_port}/v1", retries=0)
    server.most, began, seen = 0, time.perf_counter(), []
    taken = []

    def source():
        for i, w in enumerate(WAITS):
            taken.append(i)
            yield str(i), payload(w)

    for row in completions.answers(to, source(), pool=3):
        seen.append((row[0], time.perf_counter() - began, len(taken)))
    assert [s[0] for s in seen][-1] == "0" and sorted(s[0] for s in seen) == sorted(map(str, range(10)))
    assert max(s[1] for s in seen[:-1]) < 2 and server.most <= 3
    assert seen[0][2] == 3  # no more than the pool were taken from the source before the first answer


def test_pool_inside_tasks(spark, server):
    to = completions.Server(f"http://127.0.0.1:{server.server_port}/v1", retries=0)
    df = spark.createDataFrame([(str(i), payload(w)) for i, w in enumerate(WAITS)], "id string, payload string")
    server.most = 0
    rows = completions.complete(df, to, concurrency=1, pool=4).collect()
    assert rows[-1].id == "0" and len(rows) == 10 and all(r.ok for r in rows) and server.most <= 4


@pytest.mark.parametrize("callers", [1, 3])
def test_source_calls_the_server(spark, server, tmp_path, callers):
    completion_source.register(spark)
    path = (tmp_path / "requests").as_uri()
    spark.createDataFrame([(str(i), payload("0")) for i in range(10)], "id string, payload string").coalesce(1).write.parquet(path)
    df = spark.read.format("completions").option("requests", path).option("url", f"http://127.0.0.1:{server.server_port}/v1").option("callers", callers).option("pool", 2).load()
    assert df.rdd.getNumPartitions() == callers
    got = {r.id: r.translation_ja for r in judged(df).collect()}
    assert got == {str(i): "after 0" for i in range(10)}


def test_source_reads_stored_answers(spark, tmp_path):
    completion_source.register(spark)
    path = tmp_path / "stored"
    rows = [(str(i), None if i == 7 else json.dumps({"choices": [{"message": {"content": f"said {i}"}}]})) for i in range(700)]
    spark.createDataFrame(rows, "id string, raw_response string").repartition(5).write.parquet(path.as_uri())
    (path / "_temporary").mkdir()
    for callers in (2, 9):
        df = spark.read.format("completions").option("stored", path.as_uri()).option("callers", callers).load()
        got = {r.id: (r.ok, r.translation_ja) for r in judged(df).collect()}
        assert got == {i: (body is not None, f"said {i}" if body else "") for i, body in rows}
    with pytest.raises(Exception, match="stored answers"):
        spark.read.format("completions").load().count()


class Stop(Exception):
    pass


ROWS = "model string, id long, place long, said string"


def test_repeated_batches_write_nothing_twice(spark, tmp_path):
    """Stops between write and commit, and between commit and the stream's own record of it; then goes on."""
    source, table, log = ((tmp_path / n).as_uri() for n in ("in", "out", "log"))
    stream = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
    put = lambda rows: spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
    put([("m", 1, 1, "a"), ("m", 2, 2, "b"), ("m", 2, 3, "late")])
    fails = {0}

    def stop_once(batch):
        if batch in fails:
            fails.discard(batch)
            raise Stop(f"between write and commit of {batch}")

    sink = KeyedSink(table, ["model", "id"], ["place"], buckets=4, before_commit=stop_once)
    with pytest.raises(Exception, match="between write and commit"):
        follow_keyed(stream(), sink, log).awaitTermination()
    assert sink.read(spark) is None
    follow_keyed(stream(), sink, log).awaitTermination()
    assert sorted((r.id, r.said) for r in sink.read(spark).collect()) == [(1, "a"), (2, "b")]

    put([("m", 2, 0, "again"), ("m", 3, 1, "c"), (None, None, 1, "null")])

    class StopsAfter(KeyedSink):
        def _move(self, *a):
            super()._move(*a)
            if fails:
                raise Stop("after the commit")

    fails.add(99)
    late = StopsAfter(table, ["model", "id"], ["place"], buckets=4)
    with pytest.raises(Exception, match="after the commit"):
        follow_keyed(stream(), late, log).awaitTermination()
    fails.clear()
    follow_keyed(stream(), sink, log).awaitTermination()
    put([(None, None, 0, "null again"), ("m", 4, 1, "d")])
    follow_keyed(stream(), sink, log).awaitTermination()
    want = [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("null", None)]
    assert sorted((r.said, r.id) for r in sink.read(spark).collect()) == want
    assert sink.committed(spark) == [0, 1, 2]

    sink.compact(spark)
    assert sink.committed(spark) == [2] and sorted((r.said, r.id) for r in sink.read(spark).collect()) == want
    sink(spark.createDataFrame([("m", 9, 1, "x")], ROWS), 1)  # a batch that compaction took over is not written again
    sink(spark.createDataFrame([("m", 1, 1, "x"), ("m", 5, 1, "e")], ROWS), 3)
    assert sorted((r.said, r.id) for r in sink.read(spark).collect()) == sorted([*want, ("e", 5)], key=lambda x: x[0])
