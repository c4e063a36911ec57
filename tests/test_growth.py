"""Queries on chunks make them once and shuffle no texts; searches hold bounded scores."""

import contextlib
import io
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvine import queries
from corvine.functions import embed, syntax
from corvine.operators import vectors
from corvine.plans import tools

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


#: Shuffles of each query, the deal of line items among them.
SHUFFLES = {
    "c8_chunks": 1,
    "t1_search_code": 1,
    "p2_output_projection": 1,
    "t2_search_symbol_any": 3,
    "t2_search_symbol_function": 3,
    "a3_index_totals": 3,
    "t3_get_context": 3,
    "c2_regex_boundaries_java": 1,
    "p11_line_window": 3,
    "t2_search_symbol_class": 3,
    "c3_blank_boundaries": 1,
    "c6_merge": 1,
    "c2_regex_boundaries_cpp": 1,
    "c2_regex_boundaries_cs": 1,
    "c5_split": 1,
    "c2_regex_boundaries_go": 1,
    "j13_two_chunkers": 2,
    "c13_structured_blocks": 1,
    "c9_c10_definitions": 1,
    "c2_regex_boundaries_py": 1,
    "c2_regex_boundaries_rs": 1,
    "c2_regex_boundaries_rb": 1,
}


@pytest.mark.parametrize("name", SHUFFLES)
def test_files_are_chunked_once(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert len(re.findall(r"[+:]- +Exchange |[+:]- Exchange ", text)) <= SHUFFLES[name]
    assert len(re.findall("MapInArrow", text)) == 1 and not re.search("ArrowEvalPython|BatchEvalPython|lambdafunction.*rlike", text)


def test_order_does_not_chunk_again(spark):
    """A sort samples what is below it: that is what was dealt, not files to chunk."""
    text = plan(queries.QUERIES["t2_search_symbol_any"](spark, SF))
    assert text.index("rangepartitioning") < text.index("hashpartitioning(chunk_id") < text.index("MapInArrow")


def test_counts_of_words(spark):
    texts = ["The CAT the\ncat", None, "", "é_é\tÀa1\r\nx", "the\n" * 3, "!?", "\n"]
    want = [embed.HashingEmbedder().embed_text(t or "") for t in texts]
    got = embed.counted(pa.array(texts), embed.SLOTS)
    assert got.tolist() == want and got[4].tolist() == (3 * embed.counted(pa.array(["the"]), embed.SLOTS)[0]).tolist()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", embed.HashingEmbedder().unit(F.col("t")).alias("v")).orderBy("k").collect()
    assert [r.v is None for r in rows] == [False, True, True, False, False, True, True]
    assert np.allclose(rows[0].v, np.array(want[0]) / np.linalg.norm(want[0]), rtol=0, atol=1e-15)


def test_kinds_without_regard_to_ascii_case(spark):
    rows = [("DEF x",), ("claſs y",), ("STRUCT s(",), ("a(b)",), ("Function f",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(tools.of_kind(F.col("t"), "function").alias("f"), tools.of_kind(F.col("t"), "class").alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True), (True, False), (True, False)]


def test_context_of_files_is_that_of_stored_chunks(spark):
    files = queries._files(spark, SF, "py")
    chunks = queries._chunks(spark, SF).cache()
    shown = ["relation", "project", "file_path", "chunk_id", "score"]
    stored = tools.get_context(chunks, tools.embedded(chunks), "src/order_7.py", 10, 20).select(*shown).collect()
    assert stored == queries.QUERIES["t3_get_context"](spark, SF).collect() and {r.relation for r in stored} == {"local", "related"}
    assert tools.search_code(chunks, tools.embedded(chunks), "def item_2 total value lookup region").select("chunk_id", "score").collect() == queries.QUERIES["t1_search_code"](spark, SF).select("chunk_id", "score").collect()
    chunks.unpersist()
    assert files.count() > 100


def test_definitions_look_at_few_lines():
    text = "function f(q) {\n" + "  q += 1;\n" * 20000 + "}\n"
    began = time.time()
    assert syntax.definitions(text, "javascript") == [(1, 20002, "f")]
    assert len(list(syntax._some_lines("javascript").finditer(text))) == 1 and time.time() - began < 5


def test_scores_of_a_slice_are_bounded():
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(3000, 8)), rng.normal(size=(vectors.QUERY_BLOCK, 8))
    b = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(np.zeros(3000, np.int64)), pa.array(v.tolist())], ["id", "group", "v"])
    seen = []
    look = lambda x: seen.append(len(x)) or np.ones((len(q), len(x)), bool)
    list(vectors._matrix(np.arange(len(q)), q, 3, look)([b]))
    assert sum(seen) == 3000 and max(seen) * len(q) * 8 <= 8 << 20
