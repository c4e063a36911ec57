"""Scalar expressions over text, paths and vectors (all run in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MASK = 0xFFFFFFFF
#: The 64-bit FNV-1a start value in two limbs; its prime is 2**40 + 435.
_FNV_HIGH, _FNV_LOW, _FNV_LOW_PRIME = 0xCBF29CE4, 0x84222325, 435


def ascii_lower(c: Column) -> Column:
    """A-Z as a-z, nothing else (F1)."""
    return F.translate(c, UPPER, LOWER)


def contains_icase(text: Column, part: Column) -> Column:
    """Substring test without regard to ASCII case."""
    return F.contains(ascii_lower(text), ascii_lower(part))


def contains_all_words(text: Column, query: Column) -> Column:
    """P5: every word of ``query`` is a substring; true for an empty query."""
    words = F.filter(F.split(ascii_lower(query), r"\s+"), lambda w: w != "")
    low = ascii_lower(text)
    return F.forall(words, lambda w: F.contains(low, w))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """from the last dot of the base name, lower case; a name's leading dot
    starts no extension."""
    return ascii_lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1))


def relative_path(path: Column, root: Column) -> Column:
    """``path`` below ``root``, or ``path`` itself elsewhere."""
    prefix = F.concat(root, F.lit("/"))
    return F.when((root != "") & F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def is_blank(line: Column) -> Column:
    """Nothing but space, tab, carriage return and line feed."""
    return F.translate(line, " \t\r\n", "") == ""


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    """C14: bytes by ``chars_per_token``."""
    return F.floor(F.octet_length(text) / chars_per_token).cast("int")


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as 16 hexadecimal digits, folded
    over two 32-bit limbs, which no signed product overflows. For short keys."""
    code = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(F.filter(F.sequence(F.lit(0), F.octet_length(text)), lambda i: i > 0), lambda i: F.conv(F.substr(code, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))

    def step(s: Column, b: Column) -> Column:
        low = s["low"].bitwiseXOR(b)
        product = low * _FNV_LOW_PRIME
        high = s["high"] * _FNV_LOW_PRIME + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_MASK)).alias("high"), product.bitwiseAND(F.lit(_MASK)).alias("low"))

    start = F.struct(F.lit(_FNV_HIGH).cast("long").alias("high"), F.lit(_FNV_LOW).cast("long").alias("low"))
    as_hex = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.aggregate(octets, start, step, lambda s: F.concat(as_hex(s["high"]), as_hex(s["low"])))


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return fnv1a(F.concat_ws(":", path, start.cast("string"), end.cast("string")))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """a vector of length one; null where the squared length is under 1e-12."""
    own = doubles(v)
    return F.aggregate(own, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.when(s >= 1e-12, F.transform(own, lambda x: x / F.sqrt(s))))


def cosine(a: Column, b: Column) -> Column:
    """A10."""
    return dot(a, b) / (norm(a) * norm(b))


def model_stem(path: Column) -> Column:
    """base name without .onnx."""
    return F.regexp_replace(basename(path), r"\.onnx$", "")


def session_text(summary: Column, files: Column, decisions: Column) -> Column:
    """what a session is embedded by; empty parts are left out."""
    part = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n{title}: "), F.array_join(xs, ", "))).otherwise("")
    return F.concat(summary, part("Key files", files), part("Key decisions", decisions))


def session_keywords(summary: Column, files: Column, decisions: Column) -> Column:
    """what keyword recall looks into."""
    return F.concat_ws(" ", summary, files, decisions)


def size_category(octets: Column) -> Column:
    """Under 1 KB, up to 10 KB, larger."""
    return F.when(octets < 1024, "small").when(octets <= 10240, "medium").otherwise("large")


def message_kind(message: Column) -> Column:
    """by presence of id and method in a JSON message."""
    has_id, has_method = F.get_json_object(message, "$.id").isNotNull(), F.get_json_object(message, "$.method").isNotNull()
    return F.when(has_id & has_method, "REQUEST").when(has_method, "NOTIFICATION").when(has_id, "RESPONSE").otherwise("INVALID")
