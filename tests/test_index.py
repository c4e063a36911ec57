from corvine.plans.indexer import Project, index
from corvine.sources import stores
from corvine.sources.files import walk
from corvine.streaming.watch import follow, relevant


def test_cold_then_warm_index(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "build").mkdir(parents=True)
    (root / "_x.py").write_text("def a():\n    return 1\n" * 20)
    (root / "b.js").write_text("function b() {\n}\n" * 30)
    (root / "build" / "c.py").write_text("def c(): pass\n")
    (root / "d.txt").write_text("no")
    assert [p.rsplit("/", 1)[1] for p in walk(str(root))] == ["_x.py", "b.js"]
    project = Project("p", str(root), f"file://{tmp_path}/data")
    first = index(spark, project)
    assert first["new"] == 2 and first["chunks"] == first["vectors"] > 0
    assert index(spark, project) == {"unchanged": 2}
    (root / "b.js").write_text("function b2() {\n  return 2\n}\n" * 30)
    (root / "_x.py").unlink()
    second = index(spark, project)
    assert second["changed"] == 1 and second["removed"] == 1
    rows = stores.load(spark, project.chunks)
    assert {r.file_path.rsplit("/", 1)[1] for r in rows.collect()} == {"b.js"}
    assert "b2" in {r.symbol_name for r in rows.collect()}


def test_session_store(spark, tmp_path):
    s = stores.SessionStore(str(tmp_path / "s"))
    assert s.load_all(spark).count() == 0
    a, b = s.save("one", ["f"], ["d"]), s.save("two")
    assert a != b
    (tmp_path / "s" / "session_bad.json").write_text("{")
    assert sorted(r.summary for r in s.load_all(spark).collect()) == ["one", "two"]
    assert s.load(spark, a).first().key_files == ["f"]
    assert s.delete(a) and not s.delete(a)


def test_import_of_a_chunk_store(spark, tmp_path):
    import json

    row = {"source_text": "x", "file_path": "a.cpp", "start_line": 1, "end_line": 2, "language": "cpp", "symbol_name": "f", "chunk_id": "0" * 16}
    (tmp_path / "c.json").write_text(json.dumps({"a": row, "b": {"file_path": "only"}}))
    got = stores.import_chunks(spark, f"file://{tmp_path}/c.json").collect()
    assert len(got) == 1 and got[0].file_content_hash == ""
    assert stores.import_chunks(spark, f"file://{tmp_path}/none.json") is None


def test_stream_equals_batch(spark, tmp_path):
    rows = [("src/a.py", "Created", 1), ("src/b.py", "Created", 2), ("src/a.py", "Deleted", 3), ("src/~t.py", "Created", 4), ("x.txt", "Created", 5)]
    spark.createDataFrame(rows, "path string, event string, seq long").coalesce(1).write.json(f"{tmp_path}/in")
    source = spark.readStream.schema("path string, event string, seq long").json(f"{tmp_path}/in")
    run = follow(relevant(source), f"file://{tmp_path}/state", lambda b: b.selectExpr("path", "seq as version"), f"{tmp_path}/cp", None)
    run.awaitTermination()
    assert [tuple(r) for r in stores.load(spark, f"file://{tmp_path}/state").collect()] == [("src/b.py", 2)]
