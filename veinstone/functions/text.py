"""Text functions. Each takes and returns columns and stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches must equal the specification's.
TOKEN_PART = r"[A-Z]+(?=[A-Z][a-z]|(?![A-Za-z0-9]))|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
NORMAL_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]"
URL = r"https?://[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+"
PACKAGE = r"(?m)^\s*package\s+([A-Za-z0-9_.]+)\s*;?"
IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z0-9_.*]+)\s*;?"
CLASS = r"\b(?:class|interface|enum|object)\s+([A-Za-z0-9_$]+)"
METHOD = r"(?m)\b(?:public|private|protected|internal|static|final|native|synchronized|abstract|open|override|suspend|\s)+[A-Za-z0-9_<>\[\].?,\s:]+\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
NATIVE_METHOD = r"(?m)\bnative\s+(?:[A-Za-z0-9_<>\[\].]+\s+)+([A-Za-z0-9_]+)\s*\("
LOAD_LIBRARY = r'System\.loadLibrary\(\s*"([A-Za-z0-9_.-]+)"'
ERROR_LINE = r"(?i)\b(error|exception|failed|failure)\b"
WARNING_LINE = r"(?i)\bwarn(?:ing)?\b"
CALL_HEX = r"(?:bl|call)?\s*(0x[0-9a-fA-F]+)"
CALL_SYMBOL = r"\b((?:fcn|sym|sub)\.[A-Za-z0-9_.$:@+\-]+)"
CHUNK_CHARS, CHUNK_OVERLAP = 250_000, 4096


def let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Alphanumeric runs split at camel-case borders, lower-cased, in order of occurrence."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PART), F.lit(0)), F.lower)


def spaced_tokens(text: Column) -> Column:
    """The tokens as one lower-cased string, with a space before and after each."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PART), F.lit(0))
    return F.concat(F.lit(" "), F.lower(F.array_join(parts, " ")), F.lit(" "))


def contains_sequence(token_array: Column, sequence: str) -> Column:
    """Whether the token array has the words of `sequence` next to each other."""
    padded = F.concat(F.lit(" "), F.array_join(token_array, " "), F.lit(" "))
    return F.contains(padded, F.lit(f" {sequence} "))


def has_affix(token_array: Column, needle: str) -> Column:
    """Whether a longer token starts or ends with needle."""
    return F.exists(token_array, lambda t: (F.length(t) > len(needle)) & (F.startswith(t, F.lit(needle)) | F.endswith(t, F.lit(needle))))


def normalize(text: Column, max_chars: int | None = 20_000) -> Column:
    """URLs, hex and decimal numbers replaced by markers, lower-cased, tokens joined by spaces."""
    x = F.coalesce(text, F.lit(""))
    if max_chars is not None:
        x = F.substring(x, 1, max_chars)
    x = F.regexp_replace(x, r"(?U)https?://\S+", " URL ")
    x = F.regexp_replace(x, r"0x[0-9A-Fa-f]+", " HEX ")
    x = F.regexp_replace(x, r"(?U)\b\d+\b", " NUM ")
    return F.array_join(F.regexp_extract_all(F.lower(x), F.lit(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\p{IsWhite_Space}\x1C-\x1FA-Za-z0-9_]"), F.lit(0)), " ")


def extract_all(text: Column, pattern: str, group: int = 1) -> Column:
    """Distinct matches of a group, sorted; null text: none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match of a group, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Pieces of `size` characters, each led by the last `overlap` characters before it."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: F.substr(text, F.greatest(i - overlap, F.lit(0)) + 1, F.least(i, F.lit(overlap)) + size))


def lines(text: Column) -> Column:
    """Lines without their ends; a trailing newline opens no further line."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n$", ""), "\n", -1)


def matching_lines(text: Column, pattern: str) -> Column:
    """Number of lines in which the pattern occurs."""
    return F.size(F.filter(lines(text), lambda x: F.regexp_like(x, F.lit(pattern))))


def printable_strings(data: Column, least: int = 4) -> Column:
    """Runs of printable ASCII of at least `least` bytes in binary data."""
    return F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(r"[\x20-\x7e]{%d,}" % least), F.lit(0))


def magic_offsets(data: Column, magic: str, limit: int = 20, window: int = 5_000_000) -> Column:
    """Offsets of a byte pattern (it must not overlap itself) in the first `window` bytes."""
    parts = F.split(F.decode(F.substring(data, 1, window), "ISO-8859-1"), magic, -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda acc, x: acc + F.length(x)) + (k - 1) * len(magic))
    return F.when(F.size(parts) > 1, F.slice(ends, 1, limit)).otherwise(F.array().cast("array<int>"))


def contained_markers(text: Column, markers) -> Column:  # noqa: ANN001
    """Which markers occur in the lower-cased text, in the markers' order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return let(low, lambda t: F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(t, m)))


def operator_hints(strings: Column, hints) -> Column:  # noqa: ANN001
    """Hints that occur in any of the lower-cased strings, sorted."""
    low = F.transform(strings, F.lower)
    return F.array_sort(F.filter(F.array(*map(F.lit, hints)), lambda h: F.exists(low, lambda s: F.contains(s, h))))


def call_target(text: Column) -> Column:
    """The called address, else the called symbol, else null."""
    x = F.coalesce(text, F.lit(""))
    whole = F.when(F.startswith(x, F.lit("fcn.")) | F.startswith(x, F.lit("sym.")), x)
    return F.coalesce(F.nullif(F.regexp_extract(x, CALL_HEX, 1), F.lit("")), F.nullif(F.regexp_extract(x, CALL_SYMBOL, 1), F.lit("")), whole)


def mnemonic(kind: Column, code: Column) -> Column:
    """An instruction's type, else the first word of its text."""
    return F.coalesce(F.nullif(kind, F.lit("")), F.nullif(F.split(F.trim(code), r"\s+")[0], F.lit("")))


def compact(values: Column, limit: int = 50) -> Column:
    """Distinct non-empty values in order of occurrence, at most `limit`."""
    return F.slice(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), 1, limit)
