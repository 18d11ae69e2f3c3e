"""Identifiers, fingerprints and sketches."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .text import chunks, let, normalize

SKETCH_SIZE, SHINGLE = 256, 5
_SEP = "\x1f"


def unit_id(*parts: Column) -> Column:
    """24 hex digits of the SHA-256 of the non-null parts, joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws(_SEP, *[p.cast("string") for p in parts]), 256), 1, 24)


def token_fingerprint(text: Column, max_chars: int | None = 20_000) -> Column:
    """SHA-256 of the normalised first characters; None: of the whole text."""
    return F.sha2(normalize(text, max_chars), 256)


def feature_hash(values: Column) -> Column:
    """SHA-256 of a token list, one token a line."""
    return F.sha2(F.array_join(values, "\n"), 256)


_EIGHT_BYTES = {"blake2b_64": lambda s: hashlib.blake2b(s, digest_size=8).digest(), "sha256_64": lambda s: hashlib.sha256(s).digest()[:8]}


def _sketches(size: int, shingle: int, algorithm: str):  # noqa: ANN202
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashed = _EIGHT_BYTES[algorithm]
        for parts in it:
            rows = []
            for x in parts.to_pylist():
                t = [w for w in (x or "").split(" ") if w]
                n = max(0, len(t) - shingle + 1)
                # equal shingles are hashed once; the digests' order is that of their hex digits
                each = set(map(_SEP.join, zip(*(t[i : i + n] for i in range(shingle)), strict=True)))
                least = [h.hex() for h in heapq.nsmallest(size, {hashed(s.encode("utf-8", "ignore")) for s in each})]
                rows.append({"algorithm": f"bottom_k_{algorithm}", "shingle_size": shingle, "token_count": len(t), "shingle_count": n, "retained_hash_count": len(least), "hashes": least})
            kind = pa.struct([("algorithm", pa.string()), ("shingle_size", pa.int32()), ("token_count", pa.int32()), ("shingle_count", pa.int32()), ("retained_hash_count", pa.int32()), ("hashes", pa.list_(pa.string()))])
            yield pa.array(rows, kind)

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


_SKETCH = "struct<algorithm:string,shingle_size:int,token_count:int,shingle_count:int,retained_hash_count:int,hashes:array<string>>"


def shingle_sketch(text: Column, shingle: int = SHINGLE, size: int = SKETCH_SIZE, algorithm: str = "blake2b_64", parity: bool = False) -> Column:
    """Bottom-k sketch of token shingles as a struct, hashed in Arrow batches.

    algorithm: blake2b_64, or sha256_64 (the first 8 bytes of SHA-256). parity, for sha256_64 only: cut the
    text into overlapping chunks first, which counts tokens of overlaps twice; computed natively.
    """
    if shingle < 2 or size < 1:
        raise ValueError("a shingle has two tokens or more and a sketch one hash or more")
    if algorithm not in _EIGHT_BYTES:
        raise ValueError(f"unknown algorithm {algorithm}")
    if not parity:
        ship_package(SparkSession.active())
        # the argument has no lambda: Spark does not plan Python functions over higher-order expressions of a file scan
        return F.arrow_udf(_sketches(size, shingle, algorithm), _SKETCH)(normalize(text, None))
    if algorithm != "sha256_64":
        raise ValueError("overlapping chunks are for sha256_64 only")
    toks = F.flatten(F.transform(chunks(F.coalesce(text, F.lit(""))), lambda c: F.filter(F.split(normalize(c, None), " "), lambda t: t != "")))

    def shingles(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - shingle + 1), lambda i: F.array_join(F.slice(t, i, F.lit(shingle)), _SEP))
        return F.struct(F.size(t).alias("n"), F.when(F.size(t) >= shingle, every).otherwise(F.array().cast("array<string>")).alias("s"))

    parts = let(toks, shingles)
    hashes = F.transform(parts["s"], lambda s: F.substring(F.sha2(s, 256), 1, 16))
    least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)
    return F.struct(
        F.lit(f"bottom_k_{algorithm}").alias("algorithm"), F.lit(shingle).alias("shingle_size"), parts["n"].alias("token_count"),
        F.size(parts["s"]).alias("shingle_count"), F.size(least).alias("retained_hash_count"), least.alias("hashes"),
    )


def _entropy(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for parts in it:
        out = []
        for x in parts:
            data = np.frombuffer(x.as_buffer() or b"", np.uint8) if x.is_valid else np.zeros(0, np.uint8)
            n = np.bincount(data, minlength=256)
            p = n[n > 0] / max(1, len(data))
            out.append(float(-(p * np.log2(p)).sum()) + 0.0)
        yield pa.array(out, pa.float64())


def byte_entropy(data: Column, window: int = 1_000_000) -> Column:
    """Shannon entropy in bits of the first bytes, 4 digits; no bytes: 0. Counted in Arrow batches, one pass a row."""
    ship_package(SparkSession.active())
    return F.round(F.arrow_udf(_entropy, "double")(F.substring(data, 1, window)), 4)
