"""Language-model scores by deleted interpolation of n-gram estimates (bigram, unigram, uniform).

Maximum-likelihood estimates are mixed with weights that depend on how frequent the context is (buckets
by powers of two). The weights are learned by expectation-maximisation on the counts of a deleted block
of the training documents, estimated from the counts of the others; scores then use all training counts.

Counts grow with the corpus and are never gathered in one place. The scan cuts the corpus into chunks and
sends each chunk's distinct words and word pairs, with their counts, to ranges of the hash space; the
ranges add up and answer each chunk in the order in which it asked. A frequent word costs one entry a
chunk. Only the histogram of estimate ratios that EM works on, a table of fixed size, reaches the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .blobs import mixed, pack, unpack, word_hashes
from .common import written
from .exchange import ROW, Ranges, Row, batch, blocks_of, exchange

FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Tokens a chunk and documents a chunk at most; distinct entries a bucket of the hash space.
CHUNK, CHUNK_DOCS, BUCKET = 1 << 21, 200_000, 1 << 21
#: Histogram cells an octave of an estimate, and EM rounds.
CELLS, ROUNDS = 4, 60
#: Hash of the end of a text, which is a token, and of its start, which is only a context.
END, START = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BC2B2AE35)
_BITS = 64
_MULT = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: int | None) -> int:
    """crc32 of the id's text modulo FOLDS; a null id counts as held out."""
    return HELD_OUT if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def pair_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of (previous token, token); first marks tokens that begin a text."""
    before = np.empty_like(h)
    before[1:], before[:1] = h[:-1], START
    before[first] = START
    return mixed(before * _MULT + h)


def by_rank(counts: np.ndarray) -> np.ndarray:
    """Positions of a chunk's words, frequent ones first, ties in order."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _requests(chunk: int, ids: list, tokens: list[np.ndarray], ranges: Ranges) -> pa.RecordBatch:
    """A chunk's rows: distinct words (first part) and pairs with counts, then its token stream.

    The stream gives each token's word by its rank in the chunk, frequent words first, so that it packs
    well; the words themselves come back with their counts, and pairs follow from both.
    """
    sizes = np.array([len(t) for t in tokens], np.int64)
    folds = np.array([fold(i) for i in ids], np.int64)
    h = np.concatenate(tokens)
    tokens.clear()
    first = np.cumsum(sizes) - sizes
    train, deleted = (np.repeat(x, sizes) for x in (folds != HELD_OUT, folds == DELETED))
    rows, stream, counts = [], b"", b""
    for part in (0, 1):
        own, back = np.unique(pair_keys(h, first) if part else h, return_inverse=True)
        n = np.bincount(back[train], minlength=len(own)).astype(np.uint32)
        d = np.bincount(back[deleted], minlength=len(own)).astype(np.uint32)
        rows += [(chunk, group, pack(own[s], True), pack(n[s]), pack(d[s]), b"") for group, s in ranges.split(own, part)]
        if part == 0:
            here = np.bincount(back, minlength=len(own))
            rank = np.empty(len(own), np.uint32)
            rank[by_rank(here)] = np.arange(len(own), dtype=np.uint32)
            stream, counts = pack(rank[back]), pack(here.astype(np.uint32))
    known = [i is not None for i in ids]
    numbers = np.array([i if i is not None else 0 for i in ids], np.int64)
    rows.append((chunk, -1 - chunk, numbers.tobytes() + np.array(known, np.uint8).tobytes(), sizes.tobytes(), stream, counts))
    return batch(rows)


def scan(docs: DataFrame, key: str, text: str, ranges: Ranges) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, tokens, held = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                tokens.append(np.append(word_hashes(value.as_py()), END))
                held += len(tokens[-1])
                if held >= CHUNK or len(ids) >= CHUNK_DOCS:
                    yield _requests(chunk, ids, tokens, ranges)
                    chunk, ids, tokens, held = chunk + 1, [], [], 0
        if ids:
            yield _requests(chunk, ids, tokens, ranges)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(run, ROW)


def _numbers(row: Row, n: int) -> list[np.ndarray]:
    return [unpack(row[3], "u4"), unpack(row[4], "u4")]


def _reply(ranges: Ranges):  # noqa: ANN202
    def run(row: Row, keys: np.ndarray, sums: list[np.ndarray]) -> Row:
        """All chunks' counts in the order of the keys; words come back with them."""
        return row[0], row[1], pack(sums[0]), pack(sums[1]), row[2] if row[1] < ranges.groups else b"", b""

    return run


def _types(ranges: Ranges):  # noqa: ANN202
    def run(bucket: int, sums: list[np.ndarray]) -> Row | None:
        """How many words training has seen in a range, a row of its own chunk."""
        if bucket < ranges.groups * ranges.each:
            return -1 - bucket, bucket, np.array([(sums[0] > 0).sum()], np.int64).tobytes(), b"", b"", b""
        return None

    return run


def octave(x: np.ndarray) -> np.ndarray:
    """Histogram position of estimates: steps of 1 / CELLS octaves from 2**-60 up; 0 for an estimate of 0."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.clip(np.round((np.log2(x) + 60) * CELLS), 1, 60 * CELLS), 0).astype(np.int64)


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0).astype(np.int64)


def _assemble(groups: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        """One chunk: per token the counts of the word and of the pair, and what EM needs of deleted tokens."""
        rows = sorted(zip(*(c.to_pylist() for c in table.columns), strict=True), key=lambda r: r[1])
        schema = pa.schema([("docs", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("pairs", pa.binary()), ("cells", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("deleted", pa.int64())])
        if rows[0][0] < 0:
            return pa.Table.from_pylist([{"types": int(np.frombuffer(r[2], np.int64)[0]), "tokens": 0, "deleted": 0} for r in rows], schema=schema)
        (_, _, docs, sizes, stream, counts), *found = rows
        size = np.frombuffer(sizes, np.int64)
        ids, known = np.frombuffer(docs[: 8 * len(size)], np.int64), np.frombuffer(docs[8 * len(size) :], np.uint8)
        folds = np.array([fold(int(i) if k else None) for i, k in zip(ids, known, strict=True)])
        own = np.concatenate([unpack(r[4], "u8", True) for r in found if r[1] < groups])
        at = by_rank(unpack(counts, "u4"))[unpack(stream, "u4")]
        first = np.cumsum(size) - size
        _, back = np.unique(pair_keys(own[at], first), return_inverse=True)
        get = lambda part, k: np.concatenate([unpack(r[k], "u8") for r in found if r[1] // groups == part]).astype(np.int64)
        word, pair = get(0, 2)[at], get(1, 2)[back]
        # deleted documents: the counts of the others, for words, contexts and pairs
        gone = np.flatnonzero(np.repeat(folds == DELETED, size))
        w_gone = get(0, 3)
        w, p = word[gone] - w_gone[at[gone]], pair[gone] - get(1, 3)[back[gone]]
        del back, found, rows
        # a token's context is the one before it; a text's start counts as often as an end
        ends = np.cumsum(size) - 1
        before = np.where(np.isin(gone, first), ends[np.searchsorted(ends, gone)], gone - 1)
        c = word[before] - w_gone[at[before]]
        cell = (context_bucket(c) << 40) | (octave(p / np.maximum(c, 1)) << 20) | octave(w / 2.0**40)
        cells, n = np.unique(cell, return_counts=True)
        blob = np.stack([cells, n.astype(np.int64)]).tobytes()
        return pa.Table.from_pylist([{
            "docs": docs, "sizes": sizes, "words": pack(word.astype(np.uint64)), "pairs": pack(pair.astype(np.uint64)), "cells": blob, "types": 0,
            "tokens": int(size[folds != HELD_OUT].sum()), "deleted": int(size[folds == DELETED].sum()),
        }], schema=schema)

    return run


@dataclass
class Weights:
    """Mixture weights (pair, word, uniform) by context bucket, and the training totals."""

    by_bucket: np.ndarray
    tokens: int
    types: int

    def log10(self, word: np.ndarray, pair: np.ndarray, context: np.ndarray) -> np.ndarray:
        lam = self.by_bucket[np.minimum(context_bucket(context), len(self.by_bucket) - 1)]
        p = lam[:, 0] * pair / np.maximum(context, 1) + lam[:, 1] * word / max(1, self.tokens) + lam[:, 2] / (self.types + 1)
        return np.log10(p)


def expectation_maximisation(cells: np.ndarray, counts: np.ndarray, tokens_left: int, tokens: int, types: int, rounds: int = ROUNDS) -> Weights:
    """Weights that make the deleted tokens likeliest; a bucket without any takes the whole's, minus its pair share if unseen."""
    bucket, pair, word = cells >> 40, (cells >> 20) & 0xFFFFF, cells & 0xFFFFF
    size = lambda x: np.where(x > 0, 2.0 ** (x / CELLS - 60), 0.0)
    f = np.stack([size(pair), size(word) * 2.0**40 / max(1, tokens_left), np.full(len(cells), 1 / (types + 1))], 1)
    out = np.zeros((64, 3))

    def solve(mask: np.ndarray) -> np.ndarray:
        g, n = f[mask], counts[mask].astype(float)
        lam = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = g * lam
            share /= share.sum(1, keepdims=True)
            lam = np.maximum((share * n[:, None]).sum(0) / n.sum(), 1e-6)
            lam /= lam.sum()
        return lam

    whole = solve(np.ones(len(cells), bool)) if len(cells) else np.array([0.4, 0.5, 0.1])
    for b in range(64):
        lam = solve(bucket == b) if (bucket == b).any() else whole.copy()
        if b == 0:
            lam[0] = 0
        out[b] = lam / lam.sum()
    return Weights(out, tokens, types)


def learn(chunks: DataFrame) -> Weights:
    """Totals and mixture weights from the written chunks. The histogram has a fixed number of cells."""
    total = chunks.agg(F.sum("tokens").alias("t"), F.sum("deleted").alias("d"), F.sum("types").alias("v")).first()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                cells, n = np.frombuffer(blob, np.int64).reshape(2, -1)
                seen.update(dict(zip(cells.tolist(), n.tolist(), strict=True)))
        if seen:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = chunks.where("cells is not null").select("cells").mapInArrow(spread, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    cells, n = np.array([r["cell"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    tokens, deleted, types = (total[k] or 0 for k in ("t", "d", "v"))
    return expectation_maximisation(cells, n, tokens - deleted, tokens, types)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Documents whose crc32(id) mod 7 is 2 are held out of training; so is a null id. base_score is the
    add-one unigram log10 probability, score the interpolated one; both of all tokens, the end included.
    Null, empty and blank texts have the end token alone. Repeated rows count as often as they come and
    get a row each. Without training text every token has the uniform probability. Other columns are
    ignored; an empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    ship_package(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = Ranges(max(1, -(-size // (6 * BUCKET))), _BITS, 2)
    blocks = blocks_of(size // (6 * CHUNK) + 1, CHUNK, BUCKET, ranges)
    asked = exchange(scan(docs, key, text, ranges), ranges, blocks, _numbers, _reply(ranges), _types(ranges))
    kind = "docs binary, sizes binary, words binary, pairs binary, cells binary, types long, tokens long, deleted long"
    chunks = written(asked.groupBy("chunk").applyInArrow(_assemble(ranges.groups), kind), "chunks")
    weights = learn(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, words, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = np.frombuffer(sizes, np.int64)
                ids, known = np.frombuffer(docs[: 8 * len(size)], np.int64), np.frombuffer(docs[8 * len(size) :], np.uint8).astype(bool)
                word, pair = unpack(words, "u8").astype(np.int64), unpack(pairs, "u8").astype(np.int64)
                first = np.cumsum(size) - size
                context = np.empty_like(word)
                # a text's start is a context as often as an end is a token
                context[1:], context[first] = word[:-1], word[first + size - 1]
                add = lambda x, first=first: np.add.reduceat(x, first)
                base = np.log10((word + 1) / (weights.tokens + weights.types + 1))
                held = np.array([fold(int(i) if k else None) == HELD_OUT for i, k in zip(ids, known, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=~known), pa.array(held), pa.array(size), pa.array(add((word > 0).astype(np.int64))), pa.array(np.full(len(size), weights.tokens)), pa.array(add(base)), pa.array(add(weights.log10(word, pair, context)))],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = chunks.where("docs is not null").select("docs", "sizes", "words", "pairs")
    return rows.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", key)
