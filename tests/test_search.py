import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.functions import text
from corvine.functions.tokenizer import WordPiece
from corvine.operators import changes, vectors
from corvine.plans import tools
from corvine.plans.protocol import Server, kind


def make(spark, n=300, width=16, seed=2):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_exact_search_equals_brute_force(spark):
    x, df = make(spark)
    got = vectors.exact(df, df.where("id < 7").withColumnRenamed("id", "query_id"), 5).orderBy("query_id", "rank").collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(7):
        s = np.round(u @ u[q], 6)
        assert [r.id for r in got if r.query_id == q] == np.lexsort((np.arange(len(x)), -s))[:5].tolist()


@pytest.mark.parametrize("method", ["ivf", "lsh"])
def test_approximate_search_recalls(spark, method):
    x, df = make(spark, 400)
    q = df.where("id < 15").withColumnRenamed("id", "query_id")
    want = {(r.query_id, r.id) for r in vectors.exact(df, q, 5).collect()}
    unit = vectors.normalized(df, "v")
    found = vectors.ivf(unit, q, 5, 8, 5) if method == "ivf" else vectors.lsh(unit, q, 5, 16)
    assert len(want & {(r.query_id, r.id) for r in found.collect()}) >= 0.8 * len(want)


def test_add_upsert_remove(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    rows = lambda d: sorted(map(tuple, d.select("id", "v").collect()))
    assert rows(vectors.add(a, b)) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(vectors.upsert(a, b)) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(vectors.remove(a, b)) == [(1, "a")]


def test_zero_vector_has_no_direction(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id int, v array<double>")
    got = {r.id: r.u for r in df.select("id", text.l2_normalize(F.col("v")).alias("u")).collect()}
    assert got == {1: None, 2: [0.6, 0.8]}


def test_words_and_sessions(spark):
    df = spark.createDataFrame([("The CAT sat", "cat  the"), ("The cat", "dog"), ("x", "")], "t string, q string")
    assert [r[0] for r in df.select(text.contains_all_words(F.col("t"), F.col("q"))).collect()] == [True, False, True]
    s = spark.createDataFrame([("2", "one", ["f"], ["d"]), ("1", "two", [], [])], "id string, summary string, key_files array<string>, key_decisions array<string>")
    got = tools.get_session_memory([s, s.withColumn("summary", F.lit("late"))]).collect()
    assert [(r.id, r.summary) for r in got] == [("2", "one"), ("1", "two")]
    assert s.select(text.session_text(F.col("summary"), F.col("key_files"), F.col("key_decisions"))).first()[0] == "one\nKey files: f\nKey decisions: d"


def test_last_event_wins_and_deletions_go(spark):
    ev = spark.createDataFrame([("a", "Created", 1), ("a", "Deleted", 3), ("b", "Modified", 2)], "path string, event string, seq long")
    state = spark.createDataFrame([("a", 0), ("c", 0)], "path string, version long")
    now = spark.createDataFrame([("a", 3), ("b", 2)], "path string, version long")
    assert sorted(map(tuple, changes.apply_events(state, ev, now).collect())) == [("b", 2), ("c", 0)]


VOCABULARY = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hello", "int", "main", "un", "##known", "(", ")", "return"])}


def test_wordpiece():
    w = WordPiece(VOCABULARY)
    assert w.encode("Hello main()") == [2, 4, 6, 9, 10, 3]
    assert w.encode("unknown xyz") == [2, 7, 8, 1, 3]
    assert w.encode("") == [2, 3]
    assert w.encode("int main return", 4) == [2, 5, 6, 3]
    ids, mask = w.batch(["hello", "int main"])
    assert ids.tolist() == [[2, 4, 3, 0], [2, 5, 6, 3]] and mask.tolist() == [[1, 1, 1, 0], [1, 1, 1, 1]]
    assert w.decode([2, 7, 8, 1, 3, 0]) == "unknown [UNK]"


def test_protocol():
    s = Server()
    s.register("search_code", lambda a: {"results": [a["query"]]})
    import json

    ask = lambda **m: s.handle(json.dumps({"jsonrpc": "2.0", **m}))
    assert ask(id=1, method="initialize")["result"]["protocolVersion"] == "2024-11-05"
    assert ask(method="notifications/initialized") is None
    assert ask(id=2, method="tools/list")["result"]["tools"][0]["name"] == "search_code"
    assert json.loads(ask(id=3, method="tools/call", params={"name": "search_code", "arguments": {"query": "x"}})["result"]["content"][0]["text"]) == {"results": ["x"]}
    assert "error" in json.loads(ask(id=3, method="tools/call", params={"name": "search_code", "arguments": {}})["result"]["content"][0]["text"])
    assert s.handle("{")["error"]["code"] == -32700 and ask(id=4)["error"]["code"] == -32600 and ask(id=5, method="no")["error"]["code"] == -32601
    assert kind([]) == "INVALID" and kind({"method": "x"}) == "NOTIFICATION"
