"""Benchmark decontamination against a broadcast hash set of test windows. DataFrame operations only.

The set is one array of 64-bit words, of the same size for any benchmark, that every scan task gets as the
value of a subquery. A window's first words are hashed to a place in it and to two bits there. Where a text
has a place with both bits, the whole window is compared with the table of windows. So the corpus is scanned
once, however large the benchmark is; a larger one only sets more bits, and more places are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, ascii_lower, let, numbered, words, written

#: What separates words: ASCII other than 0-9 and a-z after lower-casing.
SPLITTER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Words that anchor a window in the hash set, and the power of two of 64-bit words that the set has.
ANCHOR, WORDS_LOG2 = 4, 18
#: Windows up to which their table is broadcast for the comparison; a larger one is joined by shuffle.
BROADCAST_WINDOWS = 20_000
_NO_HITS = "array<struct<from:int,past:int,win:string>>"


def text_words(text: Column) -> Column:
    return words(ascii_lower(text), SPLITTER)


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(win, len, items): every run of n words of an item; an item of fewer words is one window.

    Items without words have none. Equal windows of several items are one row with their ids, sorted.
    """
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), text_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    rows = w.select("item", F.least(F.size("w"), F.lit(n)).alias("len"), F.explode(F.transform(at, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).alias("win"))
    return rows.groupBy("win", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _first(w: Column, i: Column, n: int) -> list[Column]:
    return [F.get(w, i + k) for k in range(n)]


def _place(words: list[Column]) -> Column:
    """Where in the set the first words of a window are looked up."""
    return F.hash(*words).bitwiseAND(F.lit((1 << WORDS_LOG2) - 1))


def _bits(words: list[Column]) -> Column:
    """A 64-bit word with the two bits of the first words of a window."""
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    return let(F.xxhash64(*words), lambda h: one(h).bitwiseOR(one(F.shiftrightunsigned(h, 32))))


def hash_set(windows: DataFrame) -> DataFrame:
    """(bits): one row, the array of 64-bit words with the bits of all windows."""
    w, i = F.split("win", " "), F.lit(0)
    entry = F.coalesce(*[F.when(F.least("len", F.lit(ANCHOR)) == n, F.struct(_place(_first(w, i, n)).alias("word"), _bits(_first(w, i, n)).alias("v"))) for n in range(1, ANCHOR + 1)])
    some = windows.select(entry.alias("e")).select("e.*").groupBy("word").agg(F.bit_or("v").alias("v"))
    every = windows.sparkSession.range(1 << WORDS_LOG2).join(some, F.col("id") == F.col("word"), "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    # as many rows as the set has words, whatever the benchmark
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda s: s["v"]).alias("bits"))


def _hits(w: Column, n: int, bits: Column, lens: list[int]) -> Column:
    """Structs (from, past, win) at each position whose n-word anchor is in the set, one for each length that fits."""
    # the first test is cheap and fails nearly everywhere; only where it holds are the two bits computed
    def has(i: Column) -> Column:
        words = _first(w, i, n)
        word = F.get(bits, _place(words))
        return (word != 0) & let(_bits(words), lambda b: word.bitwiseAND(b) == b)

    at = F.filter(F.sequence(F.lit(0), F.size(w) - n), has)

    def spans(i: Column) -> Column:
        every = F.array(*[F.struct(i.alias("from"), (i + k).alias("past"), F.array_join(F.slice(w, i + 1, F.lit(k)), " ").alias("win")) for k in lens])
        return F.filter(every, lambda s: s["past"] <= F.size(w))

    return F.coalesce(F.flatten(F.transform(F.when(F.size(w) >= n, at), spans)), F.array().cast(_NO_HITS))


def find_hits(docs: DataFrame, windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rid, n_words, from, past, items): where windows occur; from is null in documents without any.

    windows: as item_windows gives them, written. rid numbers the input rows.
    """
    counted = windows.groupBy("len").count().collect()  # lengths are at most the window's
    found = []
    for n in range(1, ANCHOR + 1):
        lens = sorted(r["len"] for r in counted if min(r["len"], ANCHOR) == n)
        if lens:
            found.append(_hits(F.col("w"), n, F.col("bits"), lens))
    rows = docs.select(F.col(key).alias(key), F.monotonically_increasing_id().alias("rid"), text_words(F.col("text")).alias("w"))
    if found:
        rows = rows.withColumn("bits", written(hash_set(windows), "bits").scalar())
    hits = F.concat(*found) if found else F.array().cast(_NO_HITS)
    rows = rows.select(key, "rid", F.size("w").cast("long").alias("n_words"), F.explode_outer(hits).alias("h")).select(key, "rid", "n_words", "h.from", "h.past", "h.win")
    table = windows.select("win", "len", "items")
    if sum(r["count"] for r in counted) <= BROADCAST_WINDOWS:
        table = F.broadcast(table)
    got = rows.withColumn("len", F.col("past") - F.col("from")).join(table, ["win", "len"], "left")
    ok = F.col("items").isNotNull()
    return got.select(key, "rid", "n_words", F.when(ok, F.col("from")).alias("from"), F.when(ok, F.col("past")).alias("past"), "items")


def _covered(spans: Column) -> Column:
    """Words in the union of spans (from, past), which are sorted."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        new = F.greatest(s["past"] - F.greatest(s["from"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], s["past"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.sort_array(spans), zero, add, lambda acc: acc["n"])


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) per document.

    A word inside any occurrence of a benchmark window is hit; contaminated: at least one word in twenty.
    Null or empty text: no words, not contaminated. Repeated rows get a row each; an empty benchmark hits
    nothing; items without an id hit words but are not counted; other columns are ignored.
    """
    hits = find_hits(docs, written(item_windows(benchmark), "windows"), key)
    span = F.when(F.col("from").isNotNull(), F.struct("from", "past"))
    per = hits.groupBy(key, "rid", "n_words").agg(F.collect_set(span).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("i"))
    n_hit = _covered(F.col("s"))
    return per.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents; every other row and all columns stay."""
    rows = numbered(docs)
    bad = judge(rows, benchmark, ROW).where("contaminated").select(ROW)
    return rows.join(bad, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): normalised words of each row's text without its own hit spans, joined by spaces.

    The other way to decontaminate; it keeps documents and loses their punctuation. Rows are told apart
    whatever their keys, so null and repeated keys lose nothing; null text gives an empty one.
    """
    rows = numbered(docs.select(F.col(key).alias("key"), "text"))
    hits = find_hits(rows, written(item_windows(benchmark), "windows"), ROW).where("from is not null")
    spans = hits.groupBy(ROW).agg(F.collect_set(F.struct("from", "past")).alias("spans"))
    kept = F.filter(text_words(F.col("text")), lambda x, i: ~F.coalesce(F.exists("spans", lambda s: (i >= s["from"]) & (i < s["past"])), F.lit(False)))
    return rows.join(spans, ROW, "left").select(F.col("key").alias(key), F.array_join(kept, " ").alias("text"))
