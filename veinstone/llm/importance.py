"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Words and word pairs of every whole text are hashed to a fixed number of slots. Two generative bag
models, of labelled good text and of all text, give each document a log importance weight; adding
Gumbel noise and keeping the k largest samples without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written

SLOTS = 10_000
#: Labelled good documents that the target model is fitted on, at most (those of smallest hash).
TARGET_SAMPLE = 20_000
#: Share of documents sampled (a little under the share of good ones among labels), seed, smoothing.
FRACTION, SEED, SMOOTHING = 0.8, 20, 1.0
_CACHE = 500_000


class _Hashes(dict):
    """Word to 32-bit hash, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


_hashes = _Hashes()


def slots_of(text: bytes) -> np.ndarray:
    """Slots of all words and word pairs of a text; words are ASCII-lower-cased, split at ASCII space."""
    parts = text.lower().split()
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    pairs = h[:-1] * np.uint64(0x9E3779B1) + h[1:] + np.uint64(1)
    return np.concatenate([h, pairs * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)]) % np.uint64(SLOTS)


def slot_counts(docs: DataFrame) -> np.ndarray:
    """Counts per slot of all rows of docs (text, target): row 0 all rows, row 1 the target's."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(slots_of(text.as_py() or b"").astype(np.int64), minlength=SLOTS)
                out[0] += n
                if target:
                    out[1] += n
        for k in (0, 1):
            at = np.flatnonzero(out[k])
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k), pa.int32()), "slot": pa.array(at, pa.int32()), "n": pa.array(out[k][at], pa.int64())})

    rows = docs.select(F.col("text").cast("binary"), "target").mapInArrow(count, "k int, slot int, n long")
    total = np.zeros((2, SLOTS), np.int64)
    for r in rows.groupBy("k", "slot").agg(F.sum("n").alias("n")).collect():  # 2 * SLOTS rows at most
        total[r["k"], r["slot"]] = r["n"]
    return total


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Log of the target's over the raw text's slot probability, smoothed."""
    p = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * SLOTS)
    return np.log(p[1]) - np.log(p[0])


def sortable(x: Column) -> Column:
    """A key in millionths as a long: the order that selection uses."""
    return F.round(x * 1e6).cast("long")


def kth_largest(keys: DataFrame, k: int) -> tuple[int, int]:
    """The k-th largest long of column x and how many rows equal to it belong to the top k.

    Histograms of 16 bits a pass narrow the value down: four small aggregates, at most 65536 rows each.
    """
    low, high = -(1 << 63), (1 << 63) - 1
    left = k
    for shift in (48, 32, 16, 0):
        rows = keys.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy(F.shiftright("x", shift).alias("b")).count().collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if left <= r["count"]:
                low = r["b"] << shift
                high = low + (1 << shift) - 1
                break
            left -= r["count"]
    return low, left


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key, selected) for every document.

    log_weight is the log ratio summed over the text's features. The sample has round(fraction * rows) rows: those with the largest log_weight + Gumbel noise,
    where the noise comes from a hash of the id and the seed, so a rerun selects the same rows. Ties of
    the key go to the smaller doc_id hash. Null or empty text has no features and weight 0. The target is
    text labelled quality 1 and not toxic; without such labels every ratio is 0. Repeated rows get the
    same key and a row each. The raw model counts all documents; the target model is fitted on at most
    TARGET_SAMPLE labelled documents.
    """
    ship_package(docs.sparkSession)
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0 and doc_id is not null")
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_SAMPLE).select("doc_id", F.lit(True).alias("target"))
    rows = docs.select("doc_id", "text")
    counts = slot_counts(rows.join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")))
    ratio = log_ratio(counts) if counts[1].sum() else np.zeros(SLOTS)

    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            n, w = [], []
            for t in texts:
                at = slots_of(t.as_py() or b"").astype(np.int64)
                n.append(len(at))
                w.append(float(ratio[at].sum()))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=["n", "w"])

    score.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    weigh = F.arrow_udf(score, "struct<n:bigint,w:double>")
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11)
    noise = -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))
    got = rows.select("doc_id", weigh(F.col("text").cast("binary")).alias("s")).select("doc_id", F.col("s.n").alias("n_features"), F.col("s.w").alias("log_weight"))
    got = written(got.withColumn("gumbel_key", F.col("log_weight") + noise).withColumn("x", sortable(F.col("gumbel_key"))), "weights")
    k = round(got.count() * fraction)
    if not k:
        return got.select("doc_id", "n_features", "log_weight", "gumbel_key", F.lit(False).alias("selected"))
    edge, room = kth_largest(got, k)
    # rows equal to the edge: a second exact pass over their id hashes settles which of them fit
    tie = F.xxhash64(F.lit(seed), "doc_id")
    tied = got.where(F.col("x") == edge).select(F.bitwise_not(tie).alias("x"))
    tie_edge, _ = kth_largest(tied, room)
    chosen = (F.col("x") > edge) | ((F.col("x") == edge) & (F.bitwise_not(tie) >= tie_edge))
    return got.select("doc_id", "n_features", "log_weight", "gumbel_key", chosen.alias("selected"))

