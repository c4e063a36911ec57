"""Languages by extension and the lines that start a block in each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvine.functions.text import extension

#: Extensions by language (fixed values).
EXTENSIONS = {
    "cpp": [".cpp", ".cxx", ".cc", ".c", ".hpp", ".hxx", ".h"],
    "python": [".py", ".pyw"],
    "javascript": [".js", ".jsx", ".mjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "rust": [".rs"],
    "go": [".go"],
    "ruby": [".rb"],
    "csharp": [".cs"],
}
#: Extensions that a scan takes (fixed values).
SCANNED = [".cpp", ".hpp", ".h", ".c", ".cc", ".cxx", ".hxx", ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".rs", ".go", ".rb", ".cs"]
#: Folders that no scan enters unless told otherwise: generated, fetched, and the engine's own data.
PRUNED = [".git", "build", "node_modules", "__pycache__", ".vs", ".vscode", ".corvine", ".claude", "target", "dist", "out", ".idea", ".venv", "venv", "env"]
#: Patterns of lines that start a block, with its symbol as group 1 (fixed values).
_SCRIPT = [
    r"^[ \t]*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(",
    r"^[ \t]*(?:export\s+)?class\s+(\w+)",
    r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\(|function)",
]
PATTERNS = {
    "cpp": [
        r"^[ \t]*(?:(?:static|inline|virtual|explicit|constexpr|const|volatile|unsigned|signed|extern|friend|template\s*<[^>]*>)\s+)*(?:[\w:*&<>,\s]+?)\s+(\w[\w:]*)\s*\([^;]*$",
        r"^[ \t]*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(\w+)",
        r"^[ \t]*namespace\s+(\w+)",
    ],
    "python": [r"^[ \t]*(?:async\s+)?def\s+(\w+)\s*\(", r"^[ \t]*class\s+(\w+)"],
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": [
        r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*(?:[\w<>\[\],\s]+?\s+)?(\w+)\s*\([^;]*$",
        r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum)\s+(\w+)",
    ],
    "rust": [r"^[ \t]*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", r"^[ \t]*(?:pub\s+)?(?:struct|enum|trait|impl)\s+(\w+)"],
    "go": [r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(", r"^type\s+(\w+)\s+(?:struct|interface)"],
    "ruby": [r"^[ \t]*def\s+(\w+)", r"^[ \t]*class\s+(\w+)", r"^[ \t]*module\s+(\w+)"],
    "csharp": [
        r"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed)\s+)*(?:[\w<>\[\]?,\s]+?\s+)?(\w+)\s*\([^;]*$",
        r"^[ \t]*(?:(?:public|private|protected|internal|static|abstract|sealed|partial)\s+)*(?:class|struct|interface|enum)\s+(\w+)",
    ],
}

#: First letters of the words that lines by the patterns start with; bytes a line may
#: have before its first bracket; and a plainer form of the pattern with that bracket,
#: for lines without ``template`` (its name is the word before the bracket either way).
FIRST_LETTERS = {
    "cpp": ["tem", "cla", "str", "nam"],
    "python": ["asy", "def", "cla"],
    "javascript": ["exp", "asy", "fun", "cla", "con", "let", "var"],
    "java": ["pub", "pri", "pro", "sta", "fin", "abs", "cla", "int", "enu"],
    "rust": ["pub", "asy", "fn", "str", "enu", "tra", "imp"],
    "go": ["fun", "typ"],
    "ruby": ["def", "cla", "mod"],
    "csharp": ["pub", "pri", "pro", "int", "sta", "abs", "sea", "par", "cla", "str", "enu"],
}
FIRST_LETTERS["typescript"] = FIRST_LETTERS["javascript"]
BEFORE_BRACKET = {"cpp": ":*&<>,", "java": "<>[],", "csharp": "<>[]?,"}
CALLS = {
    "cpp": rb"[\w:*&<>,\s]+\s(\w[\w:]*)\s*\([^;]*$",
    "java": rb"(?:[ \t]|[\w<>\[\],\s]+\s)?(\w+)\s*\([^;]*$",
    "csharp": rb"(?:[ \t]|[\w<>\[\]?,\s]+\s)?(\w+)\s*\([^;]*$",
}


def language(path: Column) -> Column:
    """The language of a path, ``unknown`` if there is none."""
    pairs = [F.lit(x) for lang, exts in EXTENSIONS.items() for ext in exts for x in (ext, lang)]
    return F.coalesce(F.create_map(*pairs)[extension(path)], F.lit("unknown"))


def scannable(path: Column, pruned: list[str] = PRUNED) -> Column:
    """A wanted extension and no pruned folder on the way (the last part
    is the file itself)."""
    folders = F.split(path, "/")
    return extension(path).isin(SCANNED) & ~F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*map(F.lit, pruned)))


def symbol_of(line: Column, lang: Column) -> Column:
    """The symbol that a line starts a block for (by the first pattern that
    matches), null for other lines."""
    out = None
    for name, patterns in PATTERNS.items():
        found = None
        for p in patterns:
            hit = F.rlike(line, F.lit(p))
            if r"\(" in p and "|function" not in p:  # spares other lines the backtracking
                hit = F.contains(line, F.lit("(")) & hit
            symbol = F.regexp_extract(line, p, 1)
            found = F.when(hit, symbol) if found is None else found.when(hit, symbol)
        out = F.when(lang == name, found) if out is None else out.when(lang == name, found)
    return out


#: What a watcher passes over (fixed values).
UNWATCHED = [".git", "build", "node_modules", ".vs", ".vscode", "__pycache__", ".cache"]
UNWATCHED_EXTENSIONS = [".swp", ".swo", ".swn", ".tmp", ".temp", ".bak", ".orig"]


def watched(path: Column) -> Column:
    """Not in an unwatched folder, not a temporary or backup file."""
    name = F.substring_index(path, "/", -1)
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, UNWATCHED))) & ~extension(path).isin(UNWATCHED_EXTENSIONS) & ~F.startswith(name, F.lit("~")) & ~F.startswith(name, F.lit(".#")) & ~F.endswith(name, F.lit("~"))
