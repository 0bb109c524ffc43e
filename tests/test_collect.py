import csv
import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lexgauge.cli import main
from lexgauge.operators.inputs import RESULT_COLUMNS, SYSTEM_PROMPT, payload
from lexgauge.plans import collect
from lexgauge.sinks.reports import corpus_lines, write_lines
from lexgauge.sources.completions import get_json

ITEMS = "id,category,subcategory,difficulty,source_en,reference_ja,protected_tokens,required_terms,evaluation_focus\r\n"


@pytest.fixture(scope="module")
def server():
    """Says the source backwards; "bad" is HTTP 400, "none" an empty answer; ``seen`` holds all requests."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def give(self, status, body, kind="application/json"):
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self.give(200, b'{"status":"ok"}') if self.path == "/health" else self.give(404, b"nothing here")

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.server.seen.append(asked)
            text = asked["messages"][1]["content"]
            if text == self.server.refuse:
                return self.give(400, "refused é".encode())
            said = "" if text == "none" else text[::-1]
            if not asked["stream"]:
                return self.give(200, json.dumps({"choices": [{"message": {"content": said}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": len(said)}, "timings": {"predicted_per_second": 12.5}}).encode())
            events = [{"choices": [{"delta": {"content": c}}]} for c in said] + [{"choices": [{"delta": {}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 4}}]
            self.give(200, ("".join(f"data: {json.dumps(e)}\n\n" for e in events) + "data: [DONE]\n\n").encode(), "text/event-stream")

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.seen, s.refuse = [], "bad"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def call(spark, server, folder, *more, rows="a,ui,s,easy,abc,r,,,f\r\nb,ui,s,easy,bad,r,,,f\r\nd,quest,s,hard,\"x\ny\",r,,,f\r\nc,quest,s,hard,none,r,,,f\r\n"):
    source = folder / "items.csv"
    source.write_text(ITEMS + rows, encoding="utf-8-sig", newline="")
    out = folder / "out" / "run_raw_results.csv"
    base = ["run", "--input", str(source), "--output", str(out), "--model-name", "m", "--api-url", f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "--warmup-count", "1", "--retries", "0"]
    return main([*base, *more], spark), out


def read(out):
    with out.open(encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f))


def test_run_writes_rows_and_metadata(spark, server, tmp_path, capsys):
    code, out = call(spark, server, tmp_path, "--save-raw-response", "--chat-template-kwargs", '{"think": false, "depth": 2}', "--stop", "END", "--top-k", "5")
    rows = {r["id"]: r for r in read(out)}
    assert code == 0 and list(next(iter(rows.values()))) == RESULT_COLUMNS and len(RESULT_COLUMNS) == 55
    a, b, c, d = (rows[k] for k in "abcd")
    assert (a["translation_ja"], a["request_success"], a["finish_reason"], a["prompt_tokens"], a["generation_tokens_per_second"], a["execution_index"], a["top_k"], a["min_p"], a["stream"], a["batch_total_time_ms"]) == ("cba", "true", "stop", "3", "12.500", "1", "5", "", "false", "")
    assert (b["request_success"], b["http_status"], b["error_type"], b["error"], b["raw_response"], b["retry_count"]) == ("false", "400", "http", "HTTP 400: refused é", "refused é", "0")
    assert (c["request_success"], c["error_type"], c["http_status"]) == ("false", "empty_response", "200")
    assert d["input_text"] == "x\ny" and d["translation_ja"] == "y\nx"
    asked = server.seen[-1]
    assert asked["chat_template_kwargs"] == {"think": False, "depth": 2} and asked["stop"] == ["END"] and asked["messages"][0]["content"] == SYSTEM_PROMPT.strip()
    meta = json.loads((out.parent / "run_metadata.json").read_text())
    assert (meta["total_items"], meta["success_count"], meta["failure_count"], meta["preflight"]["warmup_success_count"]) == (4, 2, 2, 1)
    assert meta["preflight"]["health"] == {"status": "ok"} and meta["preflight"]["models"] == {"status": 404, "error": "nothing here"}
    assert meta["system_prompt_sha256"] == a["system_prompt_hash"] == hashlib.sha256(SYSTEM_PROMPT.strip().encode()).hexdigest()
    assert meta["input_file_sha256"] == hashlib.sha256((tmp_path / "items.csv").read_bytes()).hexdigest()
    assert "success_count: 2" in capsys.readouterr().out


def test_run_resumes_retries_and_replaces(spark, server, tmp_path):
    assert call(spark, server, tmp_path, "--ids", "a, b")[0] == 0
    code, out = call(spark, server, tmp_path)
    assert code == 5 and len(read(out)) == 2
    assert call(spark, server, tmp_path, "--resume")[0] == 0
    assert [r["id"] for r in read(out)] == ["a", "b", "d", "c"] and [r["execution_index"] for r in read(out)] == ["1", "2", "1", "2"]
    assert call(spark, server, tmp_path, "--resume")[0] == 0 and len(read(out)) == 4
    assert call(spark, server, tmp_path, "--resume", "--retry-failed", "--warmup-count", "0")[0] == 6
    assert [r["id"] for r in read(out)][4:] == ["b", "c"]
    assert call(spark, server, tmp_path, "--overwrite", "--categories", "quest", "--end-index", "1")[0] == 0
    assert [r["id"] for r in read(out)] == ["d"]


def test_run_streams_in_parallel_over_batches(spark, server, tmp_path):
    rows = "".join(f"i{n},ui,s,easy,text {n},r,,,f\r\n" for n in range(40))
    code, out = call(spark, server, tmp_path, "--stream", "--concurrency", "2", "--shuffle", rows=rows)
    got = read(out)
    assert code == 0 and sorted(int(r["execution_index"]) for r in got) == list(range(1, 41)) and [r["id"] for r in got] != [f"i{n}" for n in range(40)]
    assert all(r["translation_ja"] == f"text {r['id'][1:]}"[::-1] and r["prompt_tokens"] == "4" and r["ttft_ms"] and r["raw_response"] == "" for r in got)
    times = [float(r["batch_total_time_ms"]) for r in got]
    assert times == sorted(times) and abs(float(got[-1]["requests_per_second"]) - 40 / times[-1] * 1000) < 0.1


def test_run_exit_codes(spark, server, tmp_path):
    good = "a,ui,s,easy,abc,r,,,f\r\n"
    assert call(spark, server, tmp_path, rows="a,ui,s,odd,x,r,,,f\r\n")[0] == 3
    assert call(spark, server, tmp_path, "--skip-invalid-rows", rows="a,ui,s,odd,x,r,,,f\r\n")[0] == 0
    assert call(spark, server, tmp_path, "--overwrite", "--chat-template-kwargs", "{", rows=good)[0] == 1
    assert call(spark, server, tmp_path, "--overwrite", "--concurrency", "0", rows=good)[0] == 1
    assert call(spark, server, tmp_path, "--overwrite", "--system-prompt-file", str(tmp_path / "no"), rows=good)[0] == 1
    assert call(spark, server, tmp_path, "--overwrite", "--input", str(tmp_path / "no"), rows=good)[0] == 2
    assert call(spark, server, tmp_path, "--overwrite", "--api-url", "http://127.0.0.1:9/x", rows=good)[0] == 4
    assert call(spark, server, tmp_path, "--overwrite", rows="b,ui,s,easy,bad,r,,,f\r\n")[0] == 4  # the warm-up takes the first item
    assert call(spark, server, tmp_path, "--overwrite", "--warmup-count", "0", rows="b,ui,s,easy,bad,r,,,f\r\n")[0] == 6


def test_interrupt_and_prompt_file(spark, server, tmp_path, monkeypatch):
    (tmp_path / "p.txt").write_text("﻿  Do it.\r\n", encoding="utf-8", newline="")
    assert call(spark, server, tmp_path, "--system-prompt-file", str(tmp_path / "p.txt"), rows="a,ui,s,easy,abc,r,,,f\r\n")[0] == 0
    assert server.seen[-1]["messages"][0]["content"] == "Do it."

    def stop(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr("lexgauge.cli.collect", stop)
    assert call(spark, server, tmp_path)[0] == 130


def test_payload_keeps_nested_options(spark):
    df = spark.createDataFrame([('q"é',)], "input_text string")
    got = json.loads(df.select(payload("m", "p", min_p=0.05, stop=["a", "b"], chat_template_kwargs={"x": {"y": [1, None]}, "z": True}, top_k=None)).first()[0])
    assert (got["min_p"], got["stop"], got["chat_template_kwargs"], "top_k" in got) == (0.05, ["a", "b"], {"x": {"y": [1, None]}, "z": True}, False)
    assert got["messages"][1]["content"] == 'q"é'


def test_unreachable_server_is_described():
    assert "error" in get_json("http://127.0.0.1:9/health", 1)


def test_text_file_of_lines(spark, tmp_path):
    df = spark.createDataFrame([("b", "x\ny"), ("a", " z "), ("c", None)], "id string, t string")
    assert write_lines(corpus_lines(df, "t"), tmp_path / "t.txt") == 3
    assert (tmp_path / "t.txt").read_bytes() == b"z\nx y\n\n"
    with pytest.raises(FileExistsError):
        write_lines(corpus_lines(df, "t"), tmp_path / "t.txt")
