"""Chunks by structure."""

import pytest

from corvine.functions.syntax import definitions
from corvine.operators.chunking import Limits, chunk_by_structure, chunk_files, compared

CASES = {
    "python": ("import os\n\n@cached\ndef a(x):\n    return x\n\nclass B:\n    def c(self):\n        pass\n", {("a", 3, 5), ("B", 7, 9), ("c", 8, 9)}),
    "cpp": ("namespace n {\nint A::run(int x)\n{\n  if (x) { return '{'; }\n  return 1; // }\n}\nint later(int);\nclass K {\n  int y;\n};\n}\n", {("n", 1, 11), ("run", 2, 6), ("K", 8, 10)}),
    "javascript": ('const f = (a) => {\n  return "}";\n};\nexport class C {\n  m() {}\n}\nfunction g() { return `{\n`; }\n', {("f", 1, 3), ("C", 4, 6), ("g", 7, 8)}),
    "typescript": ("export async function t(x: number) {\n  /* } */\n}\n", {("t", 1, 3)}),
    "java": ("public class J {\n  public int m(int a) {\n    return a;\n  }\n}\n", {("J", 1, 5), ("m", 2, 4)}),
    "rust": ("impl fmt::Display for Shape {\n  fn fmt(&self) -> i32 {\n    1\n  }\n}\npub struct S {\n  a: i32,\n}\n", {("Shape", 1, 5), ("fmt", 2, 4), ("S", 6, 8)}),
    "go": ("type T struct {\n  a int\n}\n\nfunc (t *T) Run(x int) int {\n  return x\n}\n", {("T", 1, 3), ("Run", 5, 7)}),
    "ruby": ("module M\n  class R\n    def go\n      if x\n      end\n    end\n  end\nend\n", {("M", 1, 8), ("R", 2, 7), ("go", 3, 6)}),
    "csharp": ("namespace N {\n  public class D {\n    public int E(int a) {\n      return a;\n    }\n  }\n}\n", {("D", 2, 6), ("E", 3, 5)}),
}


@pytest.mark.parametrize("lang", CASES)
def test_definitions(lang):
    text, want = CASES[lang]
    assert {(n, a, b) for a, b, n in definitions(text, lang)} == want


def test_what_cannot_be_read():
    assert definitions("def (", "python") is None and definitions("x", "unknown") is None and definitions("", "go") == []


def test_chunks_by_structure(spark):
    text = "# head\n\n" + "".join(f"class K{k}:\n    def m{k}(self):\n        return {k}\n\n" for k in range(3)) + "print(1)\n"
    rows = [("a.py", text), ("b.py", "def (\n" + "x = 1\n" * 5), ("c.xyz", "one\n\ntwo\n"), ("d.py", "")]
    files = spark.createDataFrame(rows, "path string, content string")
    limits = Limits(min_tokens=0)
    got = {(r.file_path, r.start_line, r.end_line, r.symbol_name): r.source_text for r in chunk_by_structure(files, limits).collect()}
    own = {k[1:]: t for k, t in got.items() if k[0] == "a.py"}
    # innermost definitions, and unnamed blocks around them
    assert {k for k in own if k[2]} == {(4 + 4 * k, 5 + 4 * k, f"m{k}") for k in range(3)}
    assert {k for k in own if not k[2]} == {(1, 3, ""), (6, 7, ""), (10, 11, ""), (14, 15, "")}
    lines = text.split("\n")
    assert all(t == "\n".join(lines[a - 1 : b]) + "\n" for (a, b, _), t in own.items())
    plain = {(r.file_path, r.start_line, r.end_line, r.symbol_name) for r in chunk_files(files.where("path <> 'a.py'"), limits).collect()}
    assert {k for k in got if k[0] != "a.py"} == plain
    sums = {r.path: (r.pattern_named, r.structure_named) for r in compared(files, limits).collect()}
    assert sums["a.py"] == (6, 3) and sums["c.xyz"] == (0, 0)
