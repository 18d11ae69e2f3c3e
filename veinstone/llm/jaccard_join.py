"""N-gram Jaccard join with set relations used to skip work.

A document's set holds its distinct word shingles. Sets are joined when their Jaccard similarity reaches
a threshold, and the connected classes are returned. In order:

1. The scan hashes shingles in chunks of documents and sends every chunk's distinct shingles to ranges
   of the hash space, which return those that two or more documents have, with their frequency. A
   frequent shingle costs one entry a chunk.
2. Each set is ordered from rare to frequent. Two similar sets share a shingle in their prefixes, so a
   set whose prefix holds only shingles of its own has no partner and is done. The rest are active.
   Equal sets become one class.
3. Prefix shingles of active classes form index lists. In a list, one set (of least position) is the hub
   and is compared with all others. As 1 - Jaccard is a metric, a member linked to the hub goes if no set of
   the list outside the hub's class can be similar to it. What is left of a list gets a new hub.
4. After a few hubs the rest is joined by list and block: a set probes only blocks of sizes that its
   position in the list still allows, and skips the other blocks. Answers are derived from the hub's: the
   overlaps x & h and y & h that the hub's answer holds bound the overlap x & y, which decides most pairs;
   for the others the overlap follows from the few elements in which x and y differ from h alone. Only pairs
   whose sets are far from the hub are compared as a whole.

Shingles are compared by 56-bit and counted by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .blobs import mixed, pack, unpack, word_hashes
from .common import written
from .exchange import ROW, Ranges, Row, batch, blocks_of, exchange
from .graph import connected_components

SHINGLE, PERCENT = 3, 90
#: Shingles a chunk, documents a chunk at most, and distinct entries a bucket of the hash space.
CHUNK, CHUNK_DOCS, BUCKET = 1 << 20, 60_000, 1 << 20
#: Hub rounds before the block join, and the width of a size block.
HUBS, BLOCK_RATIO = 2, 1.03
_BITS, _MANY = 56, 65535
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_set(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words: all of them as one."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += mixed(h[i : len(h) - k + 1 + i]) * _MULT[i % 5] * np.uint64(2 * (i // 5) + 1)
    return np.unique(mixed(out))


def _requests(chunk: int, ids: list, sets: list[np.ndarray], prints: list[str], ranges: Ranges) -> pa.RecordBatch:
    """A chunk's rows: its distinct keys by bucket, its documents, and keys of several of its documents."""
    sizes = np.array([len(s) for s in sets], np.int64)
    keys = np.concatenate(sets) >> np.uint64(8) if len(sets) else np.zeros(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, refs = keys[order], np.repeat(np.arange(len(sets)), sizes)[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    own, many = keys[first], counts > 1
    ref = np.where(many, _MANY, refs[first] if len(first) else first).astype(np.uint16)
    rows = [(chunk, group, pack(own[s], True), pack(ref[s]), pack(counts[s][many[s]].astype(np.uint32)), b"") for group, s in ranges.split(own)]
    pass_on = -2 - 2 * chunk
    in_many = np.repeat(many, counts)
    rows.append((chunk, pass_on, pack(own[many], True), pack(refs[in_many].astype(np.uint16)), pack(counts[many].astype(np.uint32)), b""))
    known = [x is not None for x in ids]
    numbers = np.array([x if x is not None else 0 for x in ids], np.int64)
    rows.append((chunk, pass_on - 1, numbers.tobytes(), np.array(known, np.uint8).tobytes() + sizes.tobytes(), b"".join(bytes.fromhex(p) for p in prints), b""))
    return batch(rows)


def scan(docs: DataFrame, key: str, text: str, n: int, ranges: Ranges) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, sets, prints, held = TaskContext.get().partitionId() << 24, [], [], [], 0
        for part in batches:
            for doc, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                s = shingle_set(value.as_py(), n)
                ids.append(doc)
                sets.append(s)
                prints.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                held += len(s)
                if held >= CHUNK or len(ids) >= CHUNK_DOCS:
                    yield _requests(chunk, ids, sets, prints, ranges)
                    chunk, ids, sets, prints, held = chunk + 1, [], [], [], 0
        if ids:
            yield _requests(chunk, ids, sets, prints, ranges)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(run, ROW)


def _numbers(row: Row, n: int) -> list[np.ndarray]:
    out = np.ones(n, np.int64)
    out[unpack(row[3], "u2") == _MANY] = unpack(row[4], "u4")
    return [out]


def _reply(row: Row, keys: np.ndarray, sums: list[np.ndarray]) -> Row | None:
    """The keys of a request that two or more documents have, with their frequency."""
    keep = sums[0] > 1
    if not keep.any():
        return None
    return row[0], row[1], pack(keys[keep], True), pack(unpack(row[3], "u2")[keep]), pack(np.minimum(sums[0][keep], 0xFFFFFFFF).astype(np.uint32)), b""


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):  # noqa: ANN201
    """Shingles of which at least one lies in the prefix of any similar set: n - ceil(t n) + 1."""
    return n - -(-n * percent // 100) + 1


def _assemble(percent: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.columns), strict=True), key=lambda r: r[1])
        (_, _, a, b, c, _), (_, _, ma, mb, mc, _), *found = rows
        count = len(a) // 8
        ids, known = np.frombuffer(a, np.int64), np.frombuffer(b[:count], np.uint8).astype(bool)
        sizes = np.frombuffer(b[count:], np.int64)
        prints = [c[16 * i : 16 * i + 16].hex() for i in range(count)]
        key = np.concatenate([np.zeros(0, np.uint64), *(unpack(r[2], "u8", True) for r in found)])
        ref = np.concatenate([np.zeros(0, np.uint16), *(unpack(r[3], "u2") for r in found)])
        freq = np.concatenate([np.zeros(0, np.uint32), *(unpack(r[4], "u4") for r in found)])
        many_keys, many_refs, many_counts = unpack(ma, "u8", True), unpack(mb, "u2"), unpack(mc, "u4").astype(np.int64)
        many = ref == _MANY
        # every key of several documents comes back, in the order in which it was sent
        doc = np.concatenate([ref[~many], many_refs])
        freq = np.concatenate([freq[~many], np.repeat(freq[many], many_counts)])
        key = np.concatenate([key[~many], np.repeat(many_keys, many_counts)])
        order = np.lexsort((key, freq, doc))
        key, doc = key[order], doc[order]
        cut = np.searchsorted(doc, np.arange(count + 1))
        shared = np.diff(cut)
        own = sizes - shared  # shingles of no other document come first in the order
        p = prefix_length(sizes, percent)
        blobs, prefixes = [None] * count, [None] * count
        for i in np.flatnonzero((shared > 0) & (own < p)):
            ks = key[cut[i] : cut[i + 1]]
            blobs[i] = np.sort(ks).tobytes()
            prefixes[i] = ks[: p[i] - own[i]].astype(np.int64).tolist()
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=~known), "n": pa.array(sizes), "print": pa.array(prints), "own": pa.array(own),
            "keys": pa.array(blobs, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64())),
        })

    return run


def shared_sets(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(doc_id, n, print, own, keys, prefix), written: keys and prefix only for active documents.

    keys are the shingles that other documents have too, which decide every intersection; own counts the rest.
    """
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = Ranges(max(1, -(-size // (6 * BUCKET))), _BITS)
    asked = exchange(scan(docs, key, text, n, ranges), ranges, blocks_of(size // (6 * CHUNK) + 1, CHUNK, BUCKET, ranges), _numbers, _reply)
    kind = "doc_id long, n long, print string, own long, keys binary, prefix array<long>"
    return written(asked.groupBy("chunk").applyInArrow(_assemble(percent), kind), "sets")


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        both = np.concatenate([np.frombuffer(x.as_py(), "u8"), np.frombuffer(y.as_py(), "u8")])
        both.sort(kind="stable")
        out.append(int((both[1:] == both[:-1]).sum()))
    return pa.array(out, pa.int64())


def _sized(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (a > 0)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, common, distance) of distinct pairs (x, y) of class prints."""
    side = lambda c: sets.select(F.col("print").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"k_{c}"))
    both = pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "n_x", "n_y", F.arrow_udf(_common, "long")("k_x", "k_y").alias("common"))
    return both.select("x", "y", "n_x", "n_y", "common", (1 - F.col("common") / (F.col("n_x") + F.col("n_y") - F.col("common"))).alias("distance"))


def _linked(percent: int) -> Column:
    return F.col("common") * 100 >= (F.col("n_x") + F.col("n_y") - F.col("common")) * percent


def class_links(sets: DataFrame, lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (x, y) that connect the classes of sets as all similar pairs would.

    sets: (print, n, keys), a row a class; lists: (token, print, n, k, pos), k the size of keys.
    """
    slack = 1 - percent / 100 + 1e-9
    links, labels = None, None
    for _ in range(HUBS):
        lists = lists.select("token", "print", "n", "k", "pos")
        hub = lists.groupBy("token").agg(F.min(F.struct("pos", "n", "print", "k")).alias("h"), F.count("*").alias("m")).where("m > 1").select("token", F.col("h.print").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.k").alias("hub_k"))
        here = written(lists.join(hub, "token").where("print <> hub"), "lists")
        pairs = here.where(_sized(F.col("n"), F.col("hub_n"), percent)).select(F.col("hub").alias("x"), F.col("print").alias("y")).distinct()
        known = written(verify(pairs, sets), "compared")
        found = known.where(_linked(percent)).select("x", "y")
        links = written(found if links is None else links.unionByName(found), "links")
        labels = written(connected_components(links, "x", "y"), "labels")
        # distance to the hub: as measured, or at least what the sizes say; only a measured one lets a member go
        far = here.join(known.select(F.col("x").alias("hub"), F.col("y").alias("print"), "distance", "common"), ["hub", "print"], "left")
        far = far.withColumn("measured", F.col("distance").isNotNull())
        far = far.withColumn("distance", F.coalesce("distance", 1 - F.least("n", "hub_n") / F.greatest("n", "hub_n")))
        named = labels.select(F.col("node").alias("print"), F.col("component").alias("c"))
        far = far.join(named, "print", "left").join(named.select(F.col("print").alias("hub"), F.col("c").alias("hub_c")), "hub", "left")
        far = far.withColumn("out", ~F.coalesce(F.col("c") == F.col("hub_c"), F.lit(False)))
        edge = far.groupBy("token").agg(F.min(F.when(F.col("out"), F.col("distance"))).alias("near")).where("near is not null")
        left = far.join(edge, "token").where(F.col("out") | ~F.col("measured") | (F.col("distance") >= F.col("near") - slack))
        lists = written(left.select("token", "print", "n", "k", "pos", "hub", "hub_k", "common"), "lists")
    return links.unionByName(derived_links(written(block_pairs(lists, labels, percent), "pairs"), sets, percent))


def block_pairs(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x, y, sure, via) of different components that sizes, positions and the hub's answers allow.

    A set of size n at position i still has n - i shingles to share, so its partners have at most
    (n - i) (100 + t) / t - n of them, and at least t n / 100. Lists are cut into blocks of sizes; a set
    probes the blocks from its least to its greatest partner size and skips the others.

    From the hub's answers, |x & h| = a and |y & h| = b, |x & y| is at least a + b - |h| and at most
    min(a, b) + min(|x| - a, |y| - b). A pair that the upper bound rules out is no candidate; sure: the lower
    bound links it. via (hub, hub_k, a, b): both sets are like their hub, so differences from it are few.
    """
    t = F.lit(percent)
    named = labels.select(F.col("node").alias("print"), F.col("component").alias("c"))
    rows = lists.join(named, "print", "left").withColumn("c", F.coalesce("c", "print"))
    block = lambda c: F.floor(F.log(c.cast("double")) / float(np.log(BLOCK_RATIO)))
    n, left = F.col("n"), F.col("n") - F.col("pos")
    low = F.ceil(n * t / 100)
    high = F.least(n, F.floor(left * (t + 100) / t) - n)
    probe = rows.select("token", "hub", "hub_k", F.col("print").alias("x"), n.alias("n_x"), left.alias("r_x"), F.col("c").alias("c_x"), F.col("k").alias("k_x"), F.col("common").alias("a"), low.alias("low"), high.alias("high")).where("high >= low and low > 0")
    probe = probe.withColumn("block", F.explode(F.sequence(block(F.col("low")), block(F.col("high")))))
    index = rows.select("token", F.col("print").alias("y"), n.alias("n_y"), left.alias("r_y"), F.col("c").alias("c_y"), F.col("k").alias("k_y"), F.col("common").alias("b"), block(n).alias("block"))
    need = (F.col("n_x") + F.col("n_y")) * t
    ok = (F.col("c_x") != F.col("c_y")) & F.col("n_y").between(F.col("low"), F.col("high")) & (F.least("r_x", "r_y") * (t + 100) >= need)
    ok = ok & ((F.col("n_x") > F.col("n_y")) | (F.col("x") < F.col("y")))
    # a null answer (the hub was not compared with that set) bounds nothing
    most = F.least("a", "b") + F.least(F.col("k_x") - F.col("a"), F.col("k_y") - F.col("b"))
    ok = ok & (F.col("a").isNull() | F.col("b").isNull() | (most * (t + 100) >= need))
    joined = probe.join(index, (probe["token"] == index["token"]) & (probe["block"] == index["block"]) & ok)
    sure = F.coalesce((F.col("a") + F.col("b") - F.col("hub_k")) * (t + 100) >= need, F.lit(False))
    like = (F.col("hub_k") - F.col("a") <= F.col("a")) & (F.col("hub_k") - F.col("b") <= F.col("b"))
    via = F.when(like, F.struct("hub", "hub_k", "a", "b"))
    return joined.select("x", "y", "n_x", "n_y", sure.alias("sure"), via.alias("via")).groupBy("x", "y", "n_x", "n_y").agg(F.max("sure").alias("sure"), F.min("via").alias("via"))


def _differences(h: pa.Array, x: pa.Array) -> pa.Array:
    """What the hub has and the set has not, and the other way round."""
    gone, new = [], []
    for a, b in zip(h, x, strict=True):
        a, b = np.frombuffer(a.as_py(), "u8"), np.frombuffer(b.as_py(), "u8")
        gone.append(np.setdiff1d(a, b, assume_unique=True).tobytes())
        new.append(np.setdiff1d(b, a, assume_unique=True).tobytes())
    return pa.StructArray.from_arrays([pa.array(gone, pa.binary()), pa.array(new, pa.binary())], names=["gone", "new"])


def derived_overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, n_x, n_y, common) of pairs with a hub: |x & y| = a + b - |h| + |(h - x) & (h - y)| + |(x - h) & (y - h)|."""
    ends = pairs.select(F.col("via.hub").alias("hub"), F.explode(F.array("x", "y")).alias("print")).distinct()
    keys = sets.select("print", "keys")
    both = ends.join(keys, "print").join(keys.select(F.col("print").alias("hub"), F.col("keys").alias("h")), "hub")
    apart = written(both.select("hub", "print", F.arrow_udf(_differences, "struct<gone:binary,new:binary>")("h", "keys").alias("d")), "apart")
    side = lambda c: apart.select("hub", F.col("print").alias(c), F.col("d.gone").alias(f"gone_{c}"), F.col("d.new").alias(f"new_{c}"))
    got = pairs.select("x", "y", "n_x", "n_y", "via.*").join(side("x"), ["hub", "x"]).join(side("y"), ["hub", "y"])
    count = F.arrow_udf(_common, "long")
    return got.select("x", "y", "n_x", "n_y", (F.col("a") + F.col("b") - F.col("hub_k") + count("gone_x", "gone_y") + count("new_x", "new_y")).alias("common"))


def derived_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) among the pairs: by bounds, by differences from the hub, or as whole sets."""
    sure, open_ = pairs.where("sure").select("x", "y"), pairs.where("not sure")
    derived = derived_overlaps(open_.where("via is not null"), sets).where(_linked(percent)).select("x", "y")
    whole = verify(open_.where("via is null").select("x", "y"), sets).where(_linked(percent)).select("x", "y")
    return written(sure.unionByName(derived).unionByName(whole), "compared")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) per document: the smallest key reachable over similar sets.

    Sets x and y are linked when 100 |x & y| >= percent |x | y|. A text of fewer words than a shingle is
    one shingle of all its words; null, empty and blank texts have the empty set, which links with nothing.
    Repeated rows and equal sets share a component; a null key never names one, so a component of null
    keys alone has a null id. Extra columns are ignored; an empty table gives no rows.
    """
    base = shared_sets(docs, key, text, shingle, percent)
    active = base.where("keys is not null")
    sets = active.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("own").alias("own"), F.first("keys").alias("keys"), F.first("prefix").alias("prefix"))
    sets = written(sets, "classes")
    lists = sets.select("print", "n", F.posexplode("prefix").alias("i", "token"), "own").select("token", "print", "n", (F.col("n") - F.col("own")).alias("k"), (F.col("own") + F.col("i")).alias("pos"))
    links = class_links(sets.select("print", "n", "keys"), lists, percent)
    labels = connected_components(links, "x", "y")
    named = sets.select("print", "rep").join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.groupBy("component").agg(F.min("rep").alias("id"))
    named = named.join(least, "component").select("print", "id")
    out = base.select("doc_id", "n", F.when(F.col("keys").isNotNull(), F.col("print")).alias("print")).join(named, "print", "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("component_id"))

