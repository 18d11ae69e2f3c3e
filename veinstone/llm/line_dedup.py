"""Line deduplication over overlapping windows of three lines. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

WINDOW = 3
_KEY, _PRINT, _CUT = "__vs_id", "__vs_print", "__vs_cut"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame) -> DataFrame:
    """(id, print, pos, a, b): each window of three lines that is not all blank, under a 128-bit hash.

    Lines are compared without spaces at their ends. print tells rows of one id apart by their text.
    """
    rows = docs.where(F.contains("text", F.lit("\n"))).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"), F.transform(_lines(F.col("text")), lambda x: F.trim(x)).alias("l"))
    rows = rows.where(F.size("l") >= WINDOW)

    def window(i: Column) -> Column:
        parts = [F.get("l", i + k) for k in range(WINDOW)]
        blank = F.concat(*parts) == ""
        return F.when(~blank, F.struct(i.alias("pos"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(17), *parts).alias("b")))

    each = F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), window)
    return rows.select("id", "print", F.explode(each).alias("w")).where("w is not null").select("id", "print", "w.*")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(id, print, pos) of every window but the first of its kind, in order of (id, print, pos)."""
    at = F.struct("id", "print", "pos")
    first = windows.groupBy("a", "b").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # one row a hash against all windows: Spark splits the windows of a hot hash over tasks
    return windows.join(first, ["a", "b"]).where(at > F.col("first")).select("id", "print", "pos")


def _merged(starts: Column) -> Column:
    """Window starts to the disjoint spans (s, e) of covered lines, as sorted arrays (begins, ends)."""
    p = F.sort_array(starts)

    def spans(p: Column) -> Column:
        apart = lambda j: F.get(p, j) - F.get(p, j - 1) > WINDOW
        begins = F.filter(p, lambda x, j: (j == 0) | apart(j))
        lasts = F.filter(p, lambda x, j: (j == F.size(p) - 1) | apart(j + 1))
        return F.struct(begins.alias("s"), F.transform(lasts, lambda x: x + WINDOW).alias("e"))

    return let(p, spans)


def _without(lines: Column, spans: Column) -> Column:
    """The lines outside spans, as slices between them."""
    s, e = spans["s"], spans["e"]
    begins = F.concat(F.array(F.lit(0)), e)
    ends = F.concat(s, F.array(F.size(lines)))
    return F.flatten(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs, with text cut, plus __vs_cut: the number of removed lines.

    A window of three lines seen before (in an earlier document by doc_id, or earlier in the same one)
    marks its three lines; marked lines go. The first occurrence stays, save lines that a later window
    also covers. Texts of fewer than three lines, null and empty texts are unchanged. Documents with the
    same id are ordered by their text's hash, and rows alike in id and text count as one occurrence. A
    null id comes first. Tables without rows give none; further columns pass through.
    """
    cuts = repeated_windows(line_windows(docs)).groupBy("id", "print").agg(F.collect_set("pos").alias("starts"))
    cuts = cuts.select(F.col("id").alias(_KEY), F.col("print").alias(_PRINT), _merged(F.col("starts")).alias("__vs_spans"))
    own = docs.withColumn("__vs_own", F.xxhash64("text"))
    joined = own.join(cuts, own["doc_id"].eqNullSafe(cuts[_KEY]) & (own["__vs_own"] == cuts[_PRINT]), "left")
    lines, spans = _lines(F.col("text")), F.col("__vs_spans")
    text = F.when(spans.isNull(), F.col("text")).otherwise(F.array_join(let(lines, lambda x: _without(x, spans)), "\n"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    cut = F.coalesce(total(spans["e"]) - total(spans["s"]), F.lit(0))
    return joined.withColumn(_CUT, cut).withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns], _CUT)


def dedup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) per document; null text: 0 lines."""
    got = dedup_lines(docs.select("doc_id", "text", F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long").alias("n_lines")))
    return got.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.col(_CUT).cast("long").alias("n_removed"), "text")
