"""Text expressions that the corpus operators share, and the shared folder's helpers."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop_written, new_path, shared_dir, written

__all__ = ["ROW", "SPACE_CLASS", "ascii_lower", "crc32_mod", "drop_written", "let", "new_path", "numbered", "shared_dir", "words", "written"]

#: ASCII white space that separates words (0x20 and 0x09-0x0D), as a Java character class.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Column of row ids that numbered() adds.
ROW = "__vs_row"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; plain ASCII text takes the fast path."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def words(text: Column, splitter: str = SPACE_CLASS) -> Column:
    """The words of a text, as an array without empty strings; null text: no words."""
    parts = F.split(F.coalesce(text, F.lit("")), splitter)
    return F.filter(parts, lambda x: x != "")


def numbered(docs: DataFrame) -> DataFrame:
    """docs plus a unique id a row in ROW, written, so every read of it sees the same ids."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null id: null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
