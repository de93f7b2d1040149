"""Calls of a server that is busy, down or without an answer; the stored index against the plain search."""

import random
import re
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from nexuloom.operators import agent, postings, retrieval
from nexuloom.sources.services import Http, Service


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            question = unquote(self.path.rsplit("/", 1)[1])
            with s.lock:
                s.asked[question] += 1
                s.running += 1
                s.most = max(s.most, s.running)
                nth = s.asked[question]
            time.sleep(0.01)
            with s.lock:
                s.running -= 1
            code = 404 if question.startswith("none") else 500 if question.startswith("down") and not s.up else 503 if question.startswith("busy") and nth < 3 else 200
            body = f"FINAL VERDICT: {question[-1].upper()}".encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.asked, s.lock, s.running, s.most, s.up = Counter(), threading.Lock(), 0, 0, False
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def service(server, path, **more):
    return Service(Http(f"http://127.0.0.1:{server.server_address[1]}/ask/{{question}}"), str(path), wait=0.01, **more)


def test_each_question_is_asked_once(spark, server, tmp_path):
    ask = service(server, tmp_path / "replies", tasks=2, at_once=3, wave=20)
    words = [f"{kind}/{i % 25} ü?{i % 25}" for i in range(50) for kind in ("plain", "busy", "none", "down")] + [None]
    keys = spark.createDataFrame([(w,) for w in words], "key string").repartition(5)
    got = [(r["key"], r["reply"]) for r in ask(keys).collect()]
    answer = lambda w: f"FINAL VERDICT: {w[-1]}" if w and w[0] in "pb" else None
    assert Counter(got) == Counter((w, answer(w)) for w in words)
    assert {n for w, n in server.asked.items() if w[0] in "pn"} == {1} and {n for w, n in server.asked.items() if w[0] in "bd"} == {3}
    assert server.most <= 6
    before = Counter(server.asked)
    server.up = True
    more = keys.unionByName(spark.createDataFrame([("plain/new",)], "key string"))
    got = [(r["key"], r["reply"]) for r in ask(more).collect()]
    answer_up = lambda w: f"FINAL VERDICT: {w[-1].upper()}" if w and w[0] != "n" else None
    assert Counter(got) == Counter((w, answer_up(w)) for w in [*words, "plain/new"])
    asked = server.asked - before
    assert set(asked) == {"plain/new"} | {w for w in words if w and w.startswith("down")} and set(asked.values()) == {1}


def test_no_question_no_call(spark, server, tmp_path):
    ask = service(server, tmp_path / "replies")
    assert ask(spark.createDataFrame([], "key string")).collect() == []
    assert [tuple(r) for r in ask(spark.createDataFrame([(7, None)], "key int, prompt string")).collect()] == [(7, None)]
    assert not server.asked


def test_a_decision_by_calls(spark, server, tmp_path):
    classes = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    terms = spark.createDataFrame([("alpha", "s", ["A", "B"]), ("ALPHA", "s", ["A", "B"]), ("none", "s", ["C"])], "term string, sentence string, candidates array<string>")
    got = agent.decide(terms, classes, service(server, tmp_path / "replies"), "{term}")
    assert sorted((r["term"], r["class_name"]) for r in got.collect()) == [("ALPHA", "A"), ("alpha", "A"), ("none", None)]
    assert sum(server.asked.values()) == 2


def test_stored_index_like_the_plain_search(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    text = lambda n: " ".join(rnd.choices(words, weights, k=n))
    docs = [(i, text(rnd.choice((1, 5, 30, 120)))) for i in range(3000)] + [(3000 + i, "w1 w2 w3 w4") for i in range(300)] + [(4000, None), (4001, "")]
    queries = [(0, docs[7][1]), (1, "w1 w2 w3 w4"), (2, "w0"), (3, "no such word"), (4, None), (5, " ".join(words))] + [(10 + i, text(8)) for i in range(20)]
    d = spark.createDataFrame(docs, "doc long, text string").repartition(4)
    q = spark.createDataFrame(queries, "query long, text string")
    folder = str(tmp_path / "index")
    key = lambda rows: sorted((r["query"], r["rank"], r["doc"], round(r["score"], 6)) for r in rows)
    for k in (1, 10):
        report = {}
        found = postings.Index.over(d, folder=folder).search(q, k, report)
        assert key(found.collect()) == key(retrieval.bm25(d, q, k).collect())
        assert 0 < report["scored"] < report["matching"]
    assert len(list((tmp_path / "index").iterdir())) == 1
    assert postings.Index.over(d, b=0.5, folder=folder).search(q, 1).count() > 0 and len(list((tmp_path / "index").iterdir())) == 2
    empty = postings.Index.over(d.filter(F.lit(False)), folder=folder)
    assert empty.search(q, 3).count() == 0 and postings.Index.over(d, folder=folder).search(q.limit(0), 3).count() == 0


def test_entries_move_once_for_all_queries(spark, tmp_path):
    """Scores are summed where a block lies: entries are not shuffled again by query and document."""
    d = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} w{i % 13}") for i in range(700)], "doc long, text string")
    q = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 3}") for i in range(9)], "query long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for an index of any size
    try:
        found = postings.Index.over(d, folder=str(tmp_path / "index")).search(q, 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "hashpartitioning(query" in plan and "hashpartitioning(block" in plan
    assert not re.search(r"hashpartitioning\(query#\d+L?, (block#\d+L?, )?_groupingexpression", plan), plan
    key = lambda rows: sorted((r["query"], r["rank"], r["doc"], round(r["score"], 6)) for r in rows)
    assert key(found.collect()) == key(retrieval.bm25(d, q, 5).collect())
