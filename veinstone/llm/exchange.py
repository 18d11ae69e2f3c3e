"""Requests of chunks to ranges of the hash space, and the answers, at a cost linear in the input.

A chunk holds sorted distinct keys with numbers. It sends a row to each of at most FAN groups of ranges;
what answers a row is the numbers' sums over all chunks, key by key. Where a group is too large for one
task, its rows are merged by blocks of chunks first, and each block asks the group's ranges in the chunks'
stead. So a chunk never makes a row for each range, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import pack, unpack
from .common import written

#: Groups of ranges at most, which is the number of rows a chunk sends.
FAN = 1024
ROW = "chunk long, bucket long, a binary, b binary, c binary, d binary"
_NAMES = ["chunk", "bucket", "a", "b", "c", "d"]
_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

#: (chunk, bucket, a, b, c, d): a holds keys; the rest is the operator's own.
Row = tuple[int, int, bytes, bytes, bytes, bytes]


def batch(rows: list[Row]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], names=_NAMES)


def _rows(table: pa.Table) -> list[Row]:
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


class Ranges:
    """`parts` key spaces of `bits` bits, each in groups of equal ranges; part p's groups follow part p - 1's."""

    def __init__(self, buckets: int, bits: int, parts: int = 1) -> None:
        self.groups = min(buckets, FAN)
        self.each = -(-buckets // self.groups)
        self.bits, self.parts = bits, parts

    def cuts(self, keys: np.ndarray, first: int, n: int, of: int) -> np.ndarray:
        """Where ranges first..first + n - 1 of `of` equal ones begin in sorted keys, and the end."""
        edges = np.array([(b << self.bits) // of for b in range(first + 1, first + n)], np.uint64)
        return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)

    def split(self, keys: np.ndarray, part: int = 0) -> list[tuple[int, slice]]:
        """(group, slice) of a chunk's sorted keys, groups without keys left out."""
        cut = self.cuts(keys, 0, self.groups, self.groups)
        return [(part * self.groups + g, slice(cut[g], cut[g + 1])) for g in np.flatnonzero(np.diff(cut)).tolist()]

    def split_group(self, group: int, keys: np.ndarray) -> list[tuple[int, slice]]:
        """(range, slice) of sorted keys of one group."""
        first = group % self.groups * self.each
        cut = self.cuts(keys, first, self.each, self.groups * self.each)
        return [(group * self.each + k, slice(cut[k], cut[k + 1])) for k in np.flatnonzero(np.diff(cut)).tolist()]


Numbers = Callable[[Row, int], list[np.ndarray]]
Reply = Callable[[Row, np.ndarray, list[np.ndarray]], "Row | None"]


def _sums(rows: list[Row], numbers: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys of each row; the distinct keys, each entry's position among them, and the sums by key."""
    keys = [unpack(r[2], "u8", True) for r in rows]
    own, back = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, own, back, [np.bincount(back, np.concatenate(n), len(own)).astype(np.uint64) for n in zip(*numbers, strict=True)]


def _answer(rows: list[Row], keys: list[np.ndarray], back: np.ndarray, sums: list[np.ndarray], reply: Reply) -> list[Row]:
    out, at = [], 0
    for row, k in zip(rows, keys, strict=True):
        here = back[at : at + len(k)]
        at += len(k)
        got = reply(row, k, [s[here] for s in sums])
        if got is not None:
            out.append(got)
    return out


def blocks_of(chunks: int, chunk: int, bucket: int, ranges: Ranges) -> int:
    """Blocks such that one holds about `bucket` entries of a group, chunks having up to `chunk` entries."""
    return max(1, -(-chunks // max(1, bucket * ranges.groups // chunk)))


def exchange(asked: DataFrame, ranges: Ranges, blocks: int, numbers: Numbers, reply: Reply, total: Callable[[int, list[np.ndarray]], Row | None] = lambda bucket, sums: None) -> DataFrame:
    """Rows (chunk, group, ...) as reply makes them from each request, its keys and their sums.

    numbers gives a request's arrays to add up (two at most, and d stays empty); total may make a further row,
    of a negative chunk, from a range's sums. Rows of a negative bucket pass unchanged. blocks: how many
    blocks the chunks are merged in where a group holds several ranges.
    """

    def add(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        if not rows or rows[0][1] < 0:
            return table
        keys, _, back, sums = _sums(rows, [numbers(r, len(unpack(r[2], "u8", True))) for r in rows])
        more = total(rows[0][1], sums)
        return pa.Table.from_batches([batch(_answer(rows, keys, back, sums, reply) + ([more] if more else []))])

    if ranges.each == 1:
        return asked.groupBy("bucket").applyInArrow(add, ROW)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """A block's requests to one group as one request a range, and the block's own rows to answer later."""
        rows = _rows(table)
        group, block = (k.as_py() for k in key)
        at = group * blocks + block
        keys, own, back, sums = _sums(rows, [numbers(r, len(unpack(r[2], "u8", True))) for r in rows])
        out = [(at, -1 - at, *r[2:5], np.int64(r[0]).tobytes()) for r in rows]
        for bucket, s in ranges.split_group(group, own):
            out.append((at, bucket, pack(own[s], True), *[pack(x[s]) for x in sums], *[b""] * (3 - len(sums))))
        return pa.Table.from_batches([batch(out)])

    def add_merged(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        if not rows or rows[0][1] < 0:
            return table
        width = len([x for x in rows[0][3:6] if x])
        keys, _, back, sums = _sums(rows, [[unpack(x, "u8") for x in r[3 : 3 + width]] for r in rows])
        out = _answer(rows, keys, back, sums, lambda r, k, s: (r[0], r[1], b"", *map(pack, s), *[b""] * (3 - len(s))))
        more = total(rows[0][1], sums)
        return pa.Table.from_batches([batch(out + ([more] if more else []))])

    def part(table: pa.Table) -> pa.Table:
        """One block and group: the sums, handed on to the requests that were merged."""
        rows = sorted(_rows(table), key=lambda r: r[1])
        if rows[0][0] < 0:  # a total
            return table
        mine = [r for r in rows if r[1] < 0]
        found = [r for r in rows if r[1] >= 0]
        width = len([x for x in found[0][3:6] if x])
        sums = [np.concatenate([unpack(r[3 + k], "u8") for r in found]) for k in range(width)]
        group = (-1 - mine[0][1]) // blocks
        own = [(int(np.frombuffer(r[5], np.int64)[0]), group, *r[2:5], b"") for r in mine]
        keys = [unpack(r[2], "u8", True) for r in own]
        back = np.unique(np.concatenate(keys), return_inverse=True)[1]
        return pa.Table.from_batches([batch(_answer(own, keys, back, sums, reply))])

    # written, for both its kinds of rows are read
    asked = written(asked, "requests")
    block = F.pmod(F.xxhash64("chunk"), F.lit(blocks))
    merged = asked.where("bucket >= 0").groupBy("bucket", block.alias("block")).applyInArrow(merge, ROW)
    answered = merged.groupBy("bucket").applyInArrow(add_merged, ROW).groupBy("chunk").applyInArrow(part, ROW)
    return answered.unionByName(asked.where("bucket < 0"))
