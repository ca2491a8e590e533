"""Round trips: calls of a local server, fallbacks, timings of each document, and the report."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from textveil.operators import latency, responder, roundtrip
from textveil.sources import report
from textveil.sources import text as texts


class Service(BaseHTTPRequestHandler):
    """Says the prompt in capitals, in both wire forms; every third call fails first, and some prompts always do."""

    protocol_version = "HTTP/1.1"
    lock, calls, open_, most, seen = threading.Lock(), 0, 0, 0, []

    def do_POST(self):
        cls = Service
        with cls.lock:
            cls.calls, cls.open_ = cls.calls + 1, cls.open_ + 1
            cls.most, mine = max(cls.most, cls.open_), cls.calls
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        time.sleep(0.6 if "slow" in prompt else 0.01)
        status = 403 if "secret" in prompt else 500 if mine % 3 == 0 or "broken" in prompt else 200
        said = "{" if "garbled" in prompt else json.dumps({"content": [{"text": prompt.upper()}, {"type": "x"}]} if self.path == "/v1/messages" else {"choices": [{"message": {"content": prompt.upper()}}]})
        with cls.lock:
            cls.seen.append((self.path, body["model"], self.headers.get("x-api-key"), self.headers.get("Authorization"), self.headers["User-Agent"], body.get("max_tokens")))
            cls.open_ -= 1
        self.send_response(status)
        self.send_header("Content-Length", str(len(said)))
        self.end_headers()
        self.wfile.write(said.encode())

    def log_message(self, *args):
        pass


@pytest.fixture()
def service():
    Service.calls, Service.most, Service.seen = 0, 0, []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    yield {"m": responder.Provider("messages", url, "KEY_OF_M", True, "one"), "c": responder.Provider("chat", url + "/", "KEY_OF_C", False, "two")}
    server.shutdown()


def asked(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, prompt string, provider string").coalesce(1)
    caller = responder.Caller(F.col("provider"), pause=0.01, **options)
    return {r.doc_id: r.answer for r in caller.add(docs, F.col("prompt")).collect()}


def test_calls(spark, service):
    """Failures that may pass are tried again, so that all are answered; at most so many calls are open."""
    got = asked(spark, [(k, f"prompt {k}", "mc"[k % 2]) for k in range(60)], providers=service, keys={"m": "k1"}, at_once=4, retries=9)
    assert all(a.response == f"PROMPT {k}" and not a.fell_back and a.error is None for k, a in got.items())
    assert sum(a.attempts for a in got.values()) == Service.calls > 60 and 1 < Service.most <= 4
    assert set(Service.seen) == {("/v1/messages", "one", "k1", None, responder.AGENT, 1024), ("/v1/chat/completions", "two", None, "Bearer none", responder.AGENT, None)}


def test_fallback(spark, service):
    rows = [(1, "secret", "c"), (2, "broken", "c"), (3, "garbled", "m"), (4, "slow", "c"), (5, "x", "z"), (6, None, None), (7, "x", "m"), (8, "x", "gone")]
    known = service | {"gone": service["c"]._replace(url="http://127.0.0.1:9")}
    got = asked(spark, rows[:5], providers=known, keys={"m": "k"}, timeout=0.2, retries=1) | asked(spark, rows[5:], providers=known, keys={}, retries=1)
    assert {k: a.error for k, a in got.items()} == {1: "HTTP 403", 2: "HTTP 500", 3: "malformed answer", 4: "timeout", 5: "unknown provider", 6: None, 7: "no key", 8: "unreachable"} or got[3].error == "HTTP 500"
    assert all(a.fell_back == (k != 6) and a.response.endswith(rows[k - 1][1] or "\n") for k, a in got.items())
    assert (got[2].attempts, got[8].attempts, got[5].attempts, got[1].attempts <= 2) == (2, 2, 0, True)
    hints = spark.createDataFrame([(a.error,) for a in got.values()], "error string").where("error is not null").select(responder.hint(F.col("error"))).collect()
    assert all(h[0] for h in hints)


DOCS = [(1, "age 95, SSN 123-45-6789", "a"), (2, None, None), (3, "no one", "c")]


def test_roundtrip(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    unknown = lambda p: F.concat(p, F.lit(" [SSN_9]"))
    done = roundtrip.run(texts.named(docs), "What now?", "key", unknown)
    rows = {r.doc_id: r for r in done.collect()}
    assert rows[1].leaks == 1 and "123-45-6789" in rows[1].restored and "123-45-6789" not in rows[1].response
    assert rows[2].source == "example_1" and all(r.warnings == ["[SSN_9]"] for r in rows.values())
    assert roundtrip.warned(done).first() == (3, 3, 1)
    assert roundtrip.warned(roundtrip.run(docs.where("false"), "?", "key")).first() == (0, 0, 0)


def test_timings(spark, service):
    docs = spark.createDataFrame([(k, "long " * (k * 50), "s") for k in range(40)], "doc_id long, text string, source string")
    for respond in (lambda p: p, responder.Caller("c", service, at_once=2, retries=5, pause=0.01)):
        done = roundtrip.timed(docs, "What now?", "key", respond).cache()
        rows = roundtrip.timings(done).toPandas().pivot(index="doc_id", columns="stage", values="seconds")
        assert len(rows) == 40 and (rows[["deidentify", "response", "rehydrate"]] >= 0).all(axis=None)
        assert (abs(rows["total"] - rows["deidentify"] - rows["response"] - rows["rehydrate"]) < 1e-9).all()
        for r in latency.summary(roundtrip.timings(done)).collect():
            assert r.n == 40 and r.p50 <= r.p95 <= r.max_s
        done.unpersist()
    assert rows["response"].min() >= 0.01  # the service's own time
    assert roundtrip.timed(docs.where("false"), "?", "key").isEmpty()


def test_report(spark, tmp_path):
    docs = spark.createDataFrame(DOCS + [(k, f"call 555-846-{1000 + k}", f"s{k}") for k in range(4, 90)], "doc_id long, text string, source string").repartition(3)
    path = str(tmp_path / "report")
    for _ in range(2):  # the second one replaces the first
        got = roundtrip.write_report(roundtrip.timed(texts.named(docs), "What now?", "key"), path)
    assert (got["docs"], got["leaks"], got["total_n"]) == (89, 1, 89)
    head = (tmp_path / "report" / report.HEAD).read_text()
    listed = [line.split("[")[1].split("]")[0] for line in head.splitlines() if line[:1].isdigit()]
    assert "Documents: 89" in head and "| total | 89 |" in head and sorted(listed) == sorted(f.name for f in (tmp_path / "report").glob("part-*.md"))
    told = "".join((tmp_path / "report" / name).read_text() for name in listed)
    sources = [line[4:] for line in told.splitlines() if line.startswith("### ")]
    assert sources == ["a", "example_1", "c", *(f"s{k}" for k in range(4, 90))] and "self-check found 1" in told
    assert not list((tmp_path / "report").glob("_*"))
    assert roundtrip.write_report(roundtrip.timed(docs.where("false"), "?", "key"), path)["docs"] == 0
    with pytest.raises(Exception, match="one column of strings"):
        spark.range(3).write.format("report").mode("overwrite").save(path)


def test_report_aborts(spark, tmp_path):
    """A task that fails leaves nothing behind, and what was there stays."""
    report.write(spark.createDataFrame([(1, "kept")], "k long, t string"), str(tmp_path / "r"), "k", "t", "first")
    bad = spark.range(50).select("id", F.expr("if(id = 40, raise_error('no'), 'x')").alias("t"))
    with pytest.raises(Exception, match="no"):
        report.write(bad, str(tmp_path / "r"), "id", "t", "second")
    assert sorted(f.name for f in (tmp_path / "r").iterdir()) == ["part-00000.md", report.HEAD] and "first" in (tmp_path / "r" / report.HEAD).read_text()


def test_config(spark, tmp_path):
    roundtrip.write_config(spark, str(tmp_path / "config"), epochs=8, lora=False, best_metric=0.87, lora_config=None)
    assert '"lora_config":null' in spark.read.text(str(tmp_path / "config")).first().value


def test_timings_move_no_rows(spark):
    """Documents' stages were brought together and sorted by document; only counts by stage move now."""
    from textveil.plans.registry import QUERIES

    plan = QUERIES["roundtrip_timings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("percentile(") == 1
