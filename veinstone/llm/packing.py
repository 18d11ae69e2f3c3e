"""Best-fit decreasing packing of token pieces into sequences, exact over the whole corpus.

Documents are tokenised and cut once, in parallel. Pieces of one length are interchangeable, so the
driver packs only the counts per length (at most `capacity` numbers, however large the corpus): a
segment tree over remaining capacities finds the tightest open bins in logarithmic time, and bins that
are alike move as one run. The executors then look every piece's rank among its length up in the plan.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import written

CAPACITY = 2048
SEPARATOR = 0
#: Words kept in a worker's cache of token ids, and the bytes that a word has at most to be kept.
CACHE_WORDS = 400_000
CACHE_BYTES = 64


#: Normalizer steps and splitting pattern of tokenizers whose texts may be cut at white space.
_STEPS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cut_at_space(form: dict) -> bool:
    """Whether a tokenizer's file says that it drops white space, lower-cases and never joins over a space."""
    normal, pre, model = form.get("normalizer") or {}, form.get("pre_tokenizer") or {}, form["model"]
    steps, parts = normal.get("normalizers", []), pre.get("pretokenizers", [])
    return (
        model.get("type") == "BPE"
        and not model.get("dropout")
        and [x["type"] for x in steps] == _STEPS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"] == {"Regex": _SPLIT}
        and parts[0]["invert"] is True
        and parts[0]["behavior"] == "Removed"
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
    )


class WordTokens(dict):
    """Token ids of a text as little-endian 32-bit bytes, as the tokenizer's own encode gives them.

    Where the tokenizer's file shows that white space always parts tokens, a text is split there, and a
    chunk's ids are computed once by the tokenizer's normalizer, pre-tokenizer and model, then kept. Texts
    that hold the string of an added token, and all texts of other tokenizers, go through encode.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        form = json.loads(self.tok.to_str())
        self.by_chunk = cut_at_space(form)
        added = form.get("added_tokens") or []
        self.by_chunk &= not any(x["normalized"] for x in added)
        self.added = [x["content"].encode() for x in added]
        self.model, self.normal, self.pre = self.tok.model, self.tok.normalizer, self.tok.pre_tokenizer

    def _ids(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters are one pre-token and stand for themselves
            ids = [t.id for t in self.model.tokenize(chunk.decode().lower())]
        elif len(chunk) > 1 and chunk[-1] in b".,!?" and chunk[-2:-1].isalnum():
            # a lone mark after a letter or digit is a pre-token of its own
            return self[chunk[:-1]] + self[chunk[-1:]]
        else:
            text = self.normal.normalize_str(chunk.decode())
            ids = [t.id for piece, _ in self.pre.pre_tokenize_str(text) for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        if len(chunk) > CACHE_BYTES:
            return self._ids(chunk)
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[chunk] = self._ids(chunk)
        return got

    def encode(self, text: bytes) -> bytes:
        if not self.by_chunk or any(x in text for x in self.added):
            return np.array(self.tok.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        # before a combining mark (U+0300 to U+037F), a letter may not be lower-cased: it is composed first
        chunks = (text if b"\xcc" in text or b"\xcd" in text else text.lower()).split()
        return b"".join([self[c] for c in chunks])


_tokens: dict[str, WordTokens] = {}


def cut_pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows (chunk, key, piece, start, length, ids_crc32, nth): whole texts as ids plus a separator, cut at capacity.

    chunk is the task that made the row and nth the piece's number among those of its length there.
    """
    fields = [("chunk", pa.int32()), ("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64())]
    schema = pa.schema(fields)
    end, step = np.array([SEPARATOR], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens.get(tokenizer_path) or _tokens.setdefault(tokenizer_path, WordTokens(tokenizer_path))
        chunk, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.encode((value.as_py() or b"")) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    rows.append((chunk, doc, piece, at // 4, n, zlib.crc32(part), seen[n]))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    given = docs.select(F.col(key).cast("long"), F.col(text).cast("binary"))
    return given.mapInArrow(run, "chunk int, key long, piece int, start long, length long, ids_crc32 long, nth long")


class CapacityTree:
    """Segment tree over remaining capacities 0..top: the smallest open capacity of at least n."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, n: int) -> int | None:
        i = n + self.size
        if self.open[i]:
            return n
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts per length.

    Returns runs (length, rank, count, each, bin, offset): pieces rank..rank+count-1 of that length go,
    `each` to a bin, into bins bin, bin+1, ... at offset, offset+length, ... Runs are as many as open
    capacities were met, a number that depends on the capacity and not on the corpus.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    tree, stock = CapacityTree(capacity), defaultdict(list)  # remaining capacity: [(first bin, bins)]
    next_bin = 0

    def put(capacity_left: int, first: int, n: int) -> None:
        if n and capacity_left:
            stock[capacity_left].append((first, n))
            tree.set(capacity_left, True)

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                fit = capacity // length
                first, bins, room = next_bin, -(-left // fit), capacity
                next_bin += bins
            else:
                first, bins = stock[room].pop()
                if not stock[room]:
                    tree.set(room, False)
            fit = room // length
            full = min(bins, left // fit)
            if full:
                runs.append((length, rank, full * fit, fit, first, capacity - room))
                put(room - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
            if full < bins and left:
                # fewer pieces left than one bin takes: they share the next bin
                runs.append((length, rank, left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            if full < bins:
                put(room, first + full, bins - full)
    return runs


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: (key, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Null or empty text: one piece with the separator only. A null key stays null, repeated rows are
    packed as often as they come, long texts are cut into full pieces first. Empty table: no rows.
    Tokenised pieces (numbers, no text) are written once; the plan that is sent to executors has a few
    thousand rows at any corpus size.
    """
    ship_package(docs.sparkSession)
    pieces = written(cut_pieces(docs, tokenizer_path, key, text, capacity), "pieces")
    # a few numbers a task: files for as many tasks as run at once, not for every shuffle partition
    per = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    per = written(per.coalesce(docs.sparkSession.sparkContext.defaultParallelism), "lengths")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(plan_counts(counts, capacity), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    # rank of each task's first piece among all pieces of that length
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(starts, ["chunk", "length"])
    at_length = runs[:, 0] * (1 << 44) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = runs[np.searchsorted(at_length, length * (1 << 44) + rank, "right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(run[:, 4] + nth // run[:, 3]), pa.array(run[:, 5] + nth % run[:, 3] * length)], names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked.select("key", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    out = rows.mapInArrow(place, "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)
