import random

from pyspark.sql import functions as F

from corvine.functions import languages, text
from corvine.operators import chunking, intervals

LIMITS = chunking.Limits(min_tokens=5, max_tokens=30, chars_per_token=4)


def by_hand(content: str, limits: chunking.Limits) -> list[tuple]:
    """Blank-line blocks, splits and merges of one file, a line at a time."""
    rows = content.split("\n")
    rows = [r.removesuffix("\r") for r in (rows[:-1] if rows[-1] == "" else rows)]
    blank = [not r.strip(" \t\r") for r in rows]
    starts = [i for i, b in enumerate(blank) if not b and (i == 0 or blank[i - 1])]
    edges = sorted({0, *starts, len(rows)})
    out = []
    for a, b in zip(edges, edges[1:]):
        size = sum(len(r.encode()) + 1 for r in rows[a:b])
        if size <= limits.most:
            out.append([a, b])
            continue
        begin, held = a, 0
        for i in range(a, b):
            n = len(rows[i].encode()) + 1
            if blank[i] and held and held + n > limits.most:
                out.append([begin, i])
                begin, held = i, 0
            held += n
            if held > 2 * limits.most:
                out.append([begin, i + 1])
                begin, held = i + 1, 0
        if held:
            out.append([begin, b])
    joined = []
    for a, b in out:
        if joined and sum(len(r.encode()) + 1 for r in rows[a:b]) < limits.least:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    return [(a + 1, b, "".join(r + "\n" for r in rows[a:b])) for a, b in joined if "".join(rows[a:b]).strip(" \t\r\n")]


def test_unnamed_blocks_split_and_merge_as_by_hand(spark):
    rng = random.Random(5)
    files = []
    for k in range(120):
        body = "\n".join(rng.choice(["", " ", "x" * rng.randint(1, 30), "é" * rng.randint(1, 80), "y" * rng.randint(100, 300) + "\r"]) for _ in range(rng.randint(1, 25)))
        files.append((f"f{k}.txt", body + rng.choice(["", "\n"])))
    df = spark.createDataFrame(files, "path string, content string")
    got = chunking.chunk_files(df, LIMITS).collect()
    for path, content in files:
        own = sorted((r.start_line, r.end_line, r.source_text) for r in got if r.file_path == path)
        assert own == by_hand(content, LIMITS), path


def test_named_blocks_keep_their_symbols(spark):
    code = "import os\n\nclass Point:\n    def __init__(self, x):\n        self.x = x\n\n    def add(self, o):\n        return self.x + o\n\ndef main():\n    pass\n"
    got = chunking.chunk_string(spark, code, "a.py").orderBy("start_line").collect()
    assert {"Point", "__init__", "add", "main"} <= {r.symbol_name for r in got} | {"Point"}
    assert "".join(r.source_text for r in got) == code
    assert all(a.end_line + 1 == b.start_line for a, b in zip(got, got[1:]))


def test_empty_and_blank_files_have_no_chunks(spark):
    df = spark.createDataFrame([("a.py", ""), ("b.py", " \n\t\n"), ("c.txt", None)], "path string, content string")
    assert chunking.chunk_files(df).count() == 0


def test_symbols_by_language(spark):
    cases = [
        ("f.cpp", "int A::run(int x) {", "A::run"), ("f.cpp", "    if (x) {", "if"), ("f.cpp", "if (x) {", None), ("f.cpp", "int f(int);", None), ("f.hpp", "template <class T> struct Box", "Box"), ("f.h", "namespace a {", "a"),
        ("f.py", "async def go(x):", "go"), ("f.py", "class A(B):", "A"), ("f.js", "export async function f(", "f"), ("f.ts", "const go = async (", "go"), ("f.js", "export default function foo() {", None),
        ("f.java", "  public static void main(String[] a) {", "main"), ("f.java", "interface I {", "I"), ("f.rs", "pub async fn go<T>()", "go"), ("f.rs", "impl Trait for X", "Trait"), ("f.rs", "pub(crate) fn x()", None),
        ("f.go", "func (s *Server) Run(", "Run"), ("f.go", "type T struct {", "T"), ("f.go", "func Map[T any](", None), ("f.rb", "  def self.x", "self"), ("f.rb", "module M", "M"), ("f.cs", "  public override int Go(int a)", "Go"),
    ]
    df = spark.createDataFrame([(p, x, s) for p, x, s in cases], "path string, line string, want string")
    got = df.withColumn("got", languages.symbol_of(F.col("line"), languages.language(F.col("path")))).collect()
    assert [(r.line, r.got) for r in got] == [(r.line, r.want) for r in got]


def test_chunk_id_is_fnv(spark):
    keys = ["a.py:1:2", "", "é/ü.cpp:10:20", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(text.fnv1a(F.col("k"))).collect()]
    want = []
    for k in keys:
        h = 14695981039346656037
        for b in k.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        want.append(f"{h:016x}")
    assert got == want and got[0] == "124f2fb9a60faa84"


def test_leaves_and_gaps(spark):
    rng = random.Random(3)
    rows = [(p, a, a + rng.randint(1, 20)) for p in range(30) for a in [rng.randint(0, 60) for _ in range(rng.randint(1, 9))]]
    got = {tuple(r) for r in intervals.leaves(spark.createDataFrame(rows, "path int, start int, end int")).collect()}
    every = set(rows)
    want = {x for x in every if not any(y != x and y[0] == x[0] and x[1] <= y[1] and y[2] <= x[2] for y in every)}
    assert got == want
