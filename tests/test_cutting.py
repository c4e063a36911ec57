"""Chunking by batches: nothing is shuffled, and lines are found as one at a time."""

import contextlib
import io
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corvine.functions import text
from corvine.functions.languages import EXTENSIONS, PATTERNS
from corvine.operators import chunking

WORDS = ["static", "template <class T>", "template<a(b)>", "class", "struct", "int", "foo(", "bar (", "a::b(", "x);", "{", "public", "interface", "enum", "  ", "\t", "\x0b", "\r", "def", "async", "function", "export", "const", "var", "=", "(", "func", "func f(", "(s *S)", "type", "impl", "fn", "pub", "module", ";", "&x", "List<int>", "int[]", "A?", "é", "日本", "#", ">", ","]


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_chunks_are_not_shuffled(spark):
    files = spark.createDataFrame([("a.py", "def f():\n  pass\n")], "path string, content string")
    assert not re.search("Exchange|Window|Sort", plan(chunking.chunk_files(files)))


def test_lines_that_start_blocks(spark):
    rng, rows = random.Random(7), []
    for lang, exts in EXTENSIONS.items():
        for k in range(40):
            lines = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(1, 7))) + rng.choice(["", "\r"]) for _ in range(30)]
            rows.append((f"f{k}{exts[0]}", lang, "\n".join(rng.choice(["", "", " "]) + x for x in lines)))
    want = []
    for path, lang, content in rows:
        for ln, x in enumerate(content.split("\n"), 1):
            if m := next((m for p in PATTERNS[lang] if (m := re.match(p, x.removesuffix("\r"), re.A))), None):
                want.append((path, ln, m[1]))
    files = spark.createDataFrame([(p, c) for p, _, c in rows], "path string, content string")
    got = sorted(map(tuple, chunking.boundaries(files).select("path", "ln", "symbol").collect()))
    assert got == sorted(want) and len({p.rsplit(".")[-1] for p, _, _ in got}) == len(EXTENSIONS)


@pytest.mark.parametrize("ext", ["cpp", "java", "cs"])
def test_lines_without_backtracking(spark, ext):
    """Patterns with a bracket took the third power of a line's blanks."""
    content = (" " * 4000 + "x(1);\n") * 3 + "int f(int x) {\n"
    files = spark.createDataFrame([(f"a.{ext}", content)], "path string, content string")
    began = time.time()
    assert [(r.ln, r.symbol) for r in chunking.boundaries(files).collect()] == [(4, "f")]
    assert time.time() - began < 20


def test_ids_and_hashes_as_expressions(spark):
    rows = [("é/ü.py", "def f():\r\n  return 1"), ("long/" * 50 + "a.go", "func f() {\n}\n"), ("b.txt", "one\n\n\n  \ntwo\n")]
    files = spark.createDataFrame(rows, "path string, content string")
    got = chunking.chunk_files(files).join(files, F.col("path") == F.col("file_path"))
    same = got.select((text.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line")) == F.col("chunk_id")) & (F.sha2("content", 256).substr(1, 16) == F.col("file_content_hash")))
    assert [r[0] for r in same.collect()] == [True] * 3
