"""The search source against a service on this machine, and the document sink with jobs that fail at every step."""

import json
import os
import signal
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillgrid.sources import documents, readers, search

ITEMS = [{"full_name": f"own/r{k}", "stargazers_count": k, "language": ["go", "python"][k % 2], "archived": k % 5 == 0, "fork": False, "pushed_at": f"2026-01-{k % 28 + 1:02d}", "size": k * 3, "license": {"spdx_id": "MIT"} if k % 2 else None, "topics": ["x"]} for k in range(95)]


@pytest.fixture(scope="module")
def service():
    seen, lock, state = [], threading.Lock(), {"limited": set(), "now": 0, "most": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            with lock:
                seen.append(asked)
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                first = (asked["q"], asked["page"]) not in state["limited"]
                state["limited"].add((asked["q"], asked["page"]))
            if asked["q"].startswith("all"):
                time.sleep(0.4)
            word, *terms = asked["q"].split(" ")
            status, headers = 200, {}
            if word == "never" or word == "once" and first:
                status, headers = 403, {"X-RateLimit-Reset": str(int(time.time()))}
            status = {"bad": 422, "down": 500}.get(word, status)
            items = [i for i in ITEMS if all(t != "language:go" or i["language"] == "go" for t in terms)]
            n, page = int(asked["per_page"]), int(asked["page"])
            body = json.dumps({"total_count": len(items), "items": items[(page - 1) * n : page * n]} if word != "list" else []).encode()
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)
            with lock:
                state["now"] -= 1

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/search", seen, state
    server.shutdown()


def plan(df):
    """The formatted plan, whose scans name the filters that they have taken."""
    q = df._jdf.queryExecution()
    return q.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_pages_equal_a_plain_read(spark, service):
    url, seen, state = service
    df = search.search(spark, url, ["all"], pages="all", perPage="10")
    rows = df.orderBy("page", "position").collect()
    assert [json.loads(r.item) for r in rows] == ITEMS and [r.page for r in rows] == [k // 10 + 1 for k in range(95)]
    assert df.rdd.getNumPartitions() == 10 and state["most"] >= 2  # a partition for each page, several at once
    assert {a["page"] for a in seen if a["q"] == "all"} == {str(p) for p in range(1, 11)} and all(a["sort"] == "updated" and a["order"] == "desc" for a in seen)


def test_filters_reach_the_service(spark, service):
    url, seen, _ = service
    seen.clear()
    df = search.search(spark, url, ["all", "other", "third"], pages="all", perPage="20").filter("query IN ('all', 'other') AND page BETWEEN 2 AND 3 AND query != 'other' AND language = 'go' AND stars >= 30")
    got = {r.full_name for r in df.collect()}
    go = [i for i in ITEMS if i["language"] == "go"]
    assert got == {i["full_name"] for i in go[20:60] if i["stargazers_count"] >= 30}
    assert {a["q"].split(" ")[0] for a in seen} <= {"all", "other"} and all("language:go" in a["q"] and "stars:>=30" in a["q"] for a in seen)
    assert not [a for a in seen if a["page"] not in ("1", "2", "3")]
    told = plan(df)
    assert "PushedFilters" in told, told
    pushed, kept = told.split("PushedFilters: ")[1].split("\n")[0], told.split("Condition : ")[1].split("\n")[0]
    assert "query" in pushed and "page" in pushed and "page" not in kept and "stars" in kept, (pushed, kept)
    one = search.search(spark, url, ["all", "other"]).filter("page = 2")
    assert one.count() == 0  # one page of each query is asked for unless more are wanted
    assert search.search(spark, url, ["all"], pages="2", perPage="10").filter("page > 1 AND page < 2").count() == 0


def test_limits_and_refusals(spark, service):
    url, seen, _ = service
    seen.clear()
    df = search.search(spark, url, ["once", "never", "bad", "down"], perPage="7", leastWait="0.05", maxWait="0.1")
    assert {(r.query, r["count"]) for r in df.groupBy("query").count().collect()} == {("once", 7)}
    asked = [a["q"] for a in seen]
    assert asked.count("once") == 2 and asked.count("never") == 3 and asked.count("bad") == 1 and asked.count("down") == 1
    for q in ("bad", "never", "list"):
        with pytest.raises(Exception, match="SearchError|is no object"):
            search.search(spark, url, [q], mode="FAILFAST", leastWait="0", maxWait="0").collect()


def test_files_in_the_service_s_place(spark, tmp_path):
    folder = tmp_path / search.answer_key("x y")
    folder.mkdir(parents=True)
    (folder / "1.json").write_text(json.dumps({"total_count": 3, "items": [{"full_name": "b/b", "stargazers_count": 5}, None, {"full_name": "a/a", "stargazers_count": None, "topics": ["t"]}]}))
    (folder / "2.json").write_text(json.dumps({"status": 200, "body": {"items": [{"full_name": "b/b", "stargazers_count": 9}]}}))
    found = search.search(spark, f"file://{tmp_path}", ["x y", "none"], pages="all", perPage="2")
    assert {(r.repo, r.stars, tuple(r.topics), r.archived, r.license) for r in search.repositories(found).collect()} == {("b/b", 5, (), False, None), ("a/a", 0, ("t",), False, None)}
    assert search.repositories(found.filter("stars > 7")).first().stars == 9


# Documents


def files(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and documents.STAGING not in p.parts}


def keyed(spark, rows):
    return spark.createDataFrame(rows, "key string, body string").repartition(4)


def put(df, root):
    documents.write_documents(df, str(root), F.col("key"), F.col("body"))


def test_documents_replace_their_own_files(spark, tmp_path):
    put(keyed(spark, [(f"m{k % 3}/t{k}.json", f"one {k}") for k in range(60)]), tmp_path)
    put(keyed(spark, [("m0/t0.json", "two é"), ("./m1//t1.json", ""), ("new.json", "x" * 100_000)]), tmp_path)
    got = files(tmp_path)
    assert got["m0/t0.json"] == "two é" and got["m1/t1.json"] == "" and len(got["new.json"]) == 100_000 and got["m2/t2.json"] == "one 2" and len(got) == 61
    put(keyed(spark, [("q", "q")]).limit(0), tmp_path)
    assert files(tmp_path) == got and not list((tmp_path / documents.STAGING).glob("*"))


@pytest.mark.parametrize("rows", [[("a", "1"), ("a", "2")], [("x/./a", "1"), ("x/a", "2")], [("../a", "1")], [("/a", "1")], [("", "1")], [(None, "1")], [("a", None)], [("_staging/a", "1")]])
def test_documents_that_cannot_be_written(spark, tmp_path, rows):
    put(keyed(spark, [("a", "old"), ("b", "old")]), tmp_path)
    with pytest.raises(Exception, match="comes twice|no key of a file|no body"):
        put(keyed(spark, [("b", "new"), *rows]), tmp_path)
    assert files(tmp_path) == {"a": "old", "b": "old"}


def test_a_killed_task_leaves_the_old_files(spark, tmp_path):
    put(keyed(spark, [(f"k{k}", "old") for k in range(40)]), tmp_path)

    @F.udf(BooleanType())
    def fatal(key):
        if key == "k17":
            os.kill(os.getpid(), signal.SIGKILL)
        return True

    rows = keyed(spark, [(f"k{k}", "new") for k in range(40)])
    dealt = rows.repartition(8, "key").select("key", F.when(fatal("key"), F.col("body")).alias("body"))
    with pytest.raises(Exception):
        dealt.write.format("documents").mode("append").save(str(tmp_path))
    assert set(files(tmp_path).values()) == {"old"} and len(files(tmp_path)) == 40
    put(rows, tmp_path)
    assert set(files(tmp_path).values()) == {"new"}
    for _ in range(20):  # what tasks of the failed job that were still running have staged is dropped, once they have ended
        documents.recover(str(tmp_path))
        if not list((tmp_path / documents.STAGING).glob("*")):
            break
        time.sleep(0.5)
    assert not list((tmp_path / documents.STAGING).glob("*")) and set(files(tmp_path).values()) == {"new"}


def staged(root, rows, attempts=2):
    writer = documents.DocumentWriter(str(root))
    return writer, [writer.write(iter([{"key": k, "body": b} for k, b in rows[n::attempts]])) for n in range(attempts)]


def test_a_driver_that_goes_while_files_are_placed(tmp_path, monkeypatch):
    rows = [(f"d/k{k}", "new") for k in range(30)]
    for k, _ in rows:
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / k).write_text("old")
    writer, messages = staged(tmp_path, rows)
    whole, calls = documents._place, []

    def breaks(*a):
        calls.append(a)
        if len(calls) > 9:
            raise OSError("gone")
        whole(*a)

    monkeypatch.setattr(documents, "_place", breaks)
    with pytest.raises(OSError):
        writer.commit(messages)
    monkeypatch.setattr(documents, "_place", whole)
    writer.abort(messages)  # Spark calls it; the job stands all the same
    assert documents.recover(str(tmp_path)) == {"finished": 1, "dropped": 0}
    assert files(tmp_path) == dict(rows) and documents.recover(str(tmp_path)) == {"finished": 0, "dropped": 0}


def test_attempts_that_do_not_count(tmp_path):
    writer, messages = staged(tmp_path, [("a", "1"), ("b", "2")])
    writer.write(iter([{"key": "a", "body": "of another attempt"}]))
    writer.commit([*messages, None])
    assert files(tmp_path) == {"a": "1", "b": "2"}
    staged(tmp_path, [("a", "lost")], 1)  # its driver goes before the journal
    assert documents.recover(str(tmp_path)) == {"finished": 0, "dropped": 1} and files(tmp_path)["a"] == "1"


def test_results_as_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "t/1", None, True)], "model_slug string, task_id string, error string, passed boolean")
    documents.write_results(rows, str(tmp_path))
    text = files(tmp_path)["a_b/t_1.json"]
    assert json.loads(text) == {"task_id": "t/1", "error": None, "passed": True} and "\n  " in text
    with pytest.raises(Exception, match="mode append"):
        rows.select(F.lit("a").alias("key"), F.lit("b").alias("body")).write.format("documents").mode("overwrite").save(str(tmp_path))


def test_task_files_are_listed_by_folder(spark, tmp_path):
    task = '{"id": "%s", "category": "logic_drift", "golden_patch": "p"}'
    for name in ["root.json", *(f"set {k % 3}/t{k}.json" for k in range(60)), "set 1/note.txt", "_own/t60.json", "set 2/deeper/t61.json"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(task % name)
    context, status = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("listing", "listing")
    found = readers.read_tasks(spark, str(tmp_path))
    context.setJobGroup("reading", "reading")
    listed = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    assert sum(listed) < 10
    assert {r.id for r in found.collect()} == {*(f"set {k % 3}/t{k}.json" for k in range(60)), "_own/t60.json"}
    assert {r.id for r in readers.read_tasks(spark, f"file://{tmp_path}/").collect()} == {r.id for r in found.collect()}
