"""The command line, the server and its tools, the watcher and session search, end to end."""

import io
import json
import time

import pytest

from corvine.__main__ import arguments, main
from corvine.operators.sessions import SessionIndex
from corvine.plans.indexer import specs
from corvine.plans.service import Engine
from corvine.sources import stores
from corvine.streaming.watch import TreeWatcher


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    top = tmp_path_factory.mktemp("trees")
    for name, body in (("alpha", "def load_order(q):\n    return q * 2\n\n\nclass Basket:\n    total = 0\n"), ("beta", "def load_order(q):\n    return region lookup\n")):
        (top / name / "src").mkdir(parents=True)
        (top / name / "src" / f"{name}.py").write_text(body * 12)
    (top / "c.toml").write_text(f'name = "x"\n[[project]]\npath = "{top}/beta"\n[[project]]\npath = "{top}/alpha"\n')
    return top


def asked(spark, trees, *calls):
    lines = [json.dumps({"jsonrpc": "2.0", "id": k, "method": m, "params": p}) for k, (m, p) in enumerate(calls)]
    framed = lines.pop()
    sink = io.StringIO()
    text = "\n".join(lines) + f"\n\nContent-Length: {len(framed)}\r\n\r\n{framed}"
    assert main(["serve", "--project", f"{trees}/alpha", "--config", f"{trees}/c.toml"], io.StringIO(text), sink, spark) == 0
    return [json.loads(x) for x in sink.getvalue().splitlines()]


def call(tool, /, **arguments):
    return "tools/call", {"name": tool, "arguments": arguments}


def test_server_end_to_end(spark, trees):
    out = asked(
        spark, trees, ("initialize", {}), ("tools/list", {}), call("search_code", query="region lookup", limit=3), call("search_symbol", name="BASK", kind="class"),
        call("get_context", file="src/alpha.py", line=1, radius=5), call("save_session_summary", summary="Chose hash joins", key_files=["a.py"]),
        call("get_session_memory", query="hash CHOSE"), call("search_code"), call("no_tool"), ("odd", {}), call("search_symbol", name="load_order"),
    )
    held = [json.loads(r["result"]["content"][0]["text"]) if "content" in r.get("result", {}) else r for r in out]
    assert held[0]["result"]["protocolVersion"] == "2024-11-05"
    assert [t["name"] for t in held[1]["result"]["tools"]] == ["search_code", "search_symbol", "get_context", "get_session_memory", "save_session_summary"]
    assert 0 < held[2]["count"] == len(held[2]["results"]) <= 3 and held[2]["results"][0]["project"] == "beta"
    assert held[2]["results"][0]["file_path"] == "src/beta.py" and held[2]["results"][0]["score"] > 0
    assert held[3]["count"] >= 1 and {r["symbol_name"] for r in held[3]["results"]} == {"Basket"}
    assert held[4]["count"] >= 1 and {r["project"] for r in held[4]["results"]} == {"alpha"}
    assert held[5]["saved"] and held[6]["results"][0]["summary"] == "Chose hash joins"
    assert held[7]["results"] == [] and "query" in held[7]["error"]
    assert held[8]["error"]["code"] == -32601 and held[9]["error"]["code"] == -32601
    assert {r["project"] for r in held[10]["results"]} == {"alpha", "beta"}


def test_status_while_indexing(spark, trees):
    engine = Engine(spark, specs([f"{trees}/alpha"]))
    engine.busy[engine.projects[0].root] = True
    assert engine.search_symbol({"name": "Basket"})["indexing_status"] == "in_progress"
    engine.busy[engine.projects[0].root] = False
    assert "indexing_status" not in engine.search_symbol({"name": "Basket"})


def test_projects_of_command_line_and_file(trees):
    found = specs([f"{trees}/alpha", f"{trees}/alpha/"], "", f"{trees}/c.toml")
    assert [p.name for p in found] == ["alpha", "beta"] and found[0].data == f"file://{trees}/alpha/.corvine"
    assert specs([f"{trees}/alpha"], "/data/x")[0].data == "file:///data/x" and specs([]) == []
    assert arguments(["index", "--project", "a", "--project", "b", "--reindex"]).project == ["a", "b"]


def test_watcher(spark, tmp_path):
    seen = []
    (tmp_path / "a.py").write_text("x")
    w = TreeWatcher(spark, str(tmp_path), lambda rows: seen.extend((r.path.rsplit("/", 1)[1], r.event, r.seq) for r in rows.collect()), 0.05, 0.05)
    assert not TreeWatcher(spark, f"{tmp_path}/none", print).start()
    assert w.start() and not w.start()
    (tmp_path / "b.py").write_text("y")
    (tmp_path / "~c.py").write_text("temporary")
    until = time.time() + 30
    while not seen and time.time() < until:
        time.sleep(0.05)
    (tmp_path / "a.py").write_text("longer")
    (tmp_path / "b.py").unlink()
    w.stop()
    w.stop()
    assert [x[:2] for x in seen] == [("b.py", "Created"), ("a.py", "Modified"), ("b.py", "Deleted")]
    assert w.start()
    w.stop()


def test_session_index(spark, tmp_path):
    s = SessionIndex(spark, f"file://{tmp_path}/vectors")
    assert s.index_session("1", "hash joins on region") and s.index_session("2", "parquet footers", ["a.py"])
    assert not s.index_session("", "x") and not s.index_session("3", "") and not s.index_session("3", "?!") and not s.index_session("1", "again")
    assert [r.id for r in s.search("region joins", 1).collect()] == ["1"] and s.search("?!").count() == 0
    kept = spark.createDataFrame([("2", "parquet footers")], "id string, summary string")
    assert [(r.id, r.summary) for r in s.search("region joins parquet", 5, kept).collect()] == [("2", "parquet footers")]


def test_a_lost_pointer_is_an_error(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    for k in range(4):
        stores.save(spark.range(k + 1), folder)
    assert stores.load(spark, folder).count() == 4
    assert len(list((tmp_path / "t").glob("snapshot-*"))) == 2  # the current one and the one before
    (tmp_path / "t" / "pointer").unlink()
    with pytest.raises(RuntimeError):
        stores.load(spark, folder)
