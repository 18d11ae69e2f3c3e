"""Language identification: averaged hashed subword embeddings under a linear softmax.

Byte 2- to 4-grams of the lower-cased text (ASCII other than letters counts as a boundary) are hashed
to a fixed table. A document's vector is the mean of its grams' embeddings; embeddings and softmax are
trained by stochastic gradient descent in numpy on a bounded sample. A temperature fitted on held-out
sample rows turns the softmax into a calibrated score, and a score quantile gives the rejection bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import crc32_mod, written

TABLE_SIZE = 4096
WIDTH = 16
#: The bound of the training sample: documents a language, and in all. Every language has one at least. The
#: driver holds 16 KB a document, 131 MB for SAMPLE of them, twice while it trains.
SAMPLE_PER_LANG, SAMPLE = 500, 8_000
#: Share of correctly predicted calibration rows that the rejection bound may give up, and its ceiling.
REJECT_QUANTILE, REJECT_CEILING = 0.002, 0.5
UNKNOWN = "und"
FOLDS = 5
_SEGMENT = 1 << 20
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def gram_counts(text: bytes) -> np.ndarray:
    """Hashed counts of all byte 2-, 3- and 4-grams of the whole text, in bounded memory."""
    data = np.frombuffer((b" " + text + b" ").translate(_TABLE), np.uint8)
    out = np.zeros(TABLE_SIZE, np.int64)
    for at in range(0, len(data), _SEGMENT):
        back = min(at, 3)
        a = data[at - back : at + _SEGMENT].astype(np.uint32)
        h = a
        for n in (2, 3, 4):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(257) + a[n - 1 :]
            own = h[max(0, back + 1 - n) :] if back else h
            out += np.bincount((own * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20), minlength=TABLE_SIZE)
    return out


def has_letter(text: bytes) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Model:
    """labels; weights: embeddings times softmax weights, a row per table slot; bias; temperature; reject."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """(label, calibrated score, rejected); null text or no letter: und, 0, rejected."""
        if not text or not self.labels or not has_letter(text):
            return UNKNOWN, 0.0, True
        x = gram_counts(text)
        z = (x @ self.weights / max(1, x.sum()) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        score = float(p[best] / p.sum())
        return self.labels[best], score, score < self.reject


def _nll(z: np.ndarray, y: np.ndarray, t: float) -> float:
    z = z / t
    z = z - z.max(1, keepdims=True)
    return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())


def train(x: np.ndarray, langs: list[str], epochs: int = 40, rate: float = 4.0, batch: int = 32, seed: int = 7) -> Model:
    """Fit on count rows x; every fifth row is held out to calibrate. No rows: a model that rejects all."""
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((TABLE_SIZE, 0)), np.zeros(0), 1.0, 1.0)
    y = np.array([labels.index(v) for v in langs])
    x = (x / np.maximum(1, x.sum(1, keepdims=True))).astype(np.float32)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[::5], order[np.arange(len(order)) % 5 > 0]
    if not len(fit):
        fit = held
    emb = rng.normal(0, 1, (TABLE_SIZE, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        rng.shuffle(fit)
        for i in range(0, len(fit), batch):
            b = fit[i : i + batch]
            xb = x[b]
            mean = xb @ emb
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p /= len(b)
            back = p @ out.T
            out -= lr * (mean.T @ p)
            bias -= lr * p.sum(0)
            emb -= lr * 50 * (xb.T @ back)
    weights = emb @ out
    z = x[held] @ weights + bias
    temperature = min((0.05 * 1.25**k for k in range(30)), key=lambda t: _nll(z, y[held], t))
    p = np.exp((z - z.max(1, keepdims=True)) / temperature)
    right = (p.max(1) / p.sum(1))[p.argmax(1) == y[held]]
    reject = min(REJECT_CEILING, float(np.quantile(right, REJECT_QUANTILE))) if len(right) else 0.0
    return Model(labels, weights.astype(np.float64), bias.astype(np.float64), temperature, reject)


def per_lang(langs: int) -> int:
    """Rows that each of so many languages has in the sample."""
    return max(1, min(SAMPLE_PER_LANG, SAMPLE // max(1, langs)))


def sample_ids(docs: DataFrame) -> DataFrame:
    """Ids of the training sample: of every language the per_lang training documents of smallest hash.

    Ids are thinned to about twice as many by their hashes before they are ranked, so that the language of a
    third of all rows sends no more of them to one task than the others.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_mod(F.col("doc_id"), FOLDS) != 0))
    ids = written(rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct(), "ids")
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sizes.count()
    most = per_lang(langs)
    # broadcast while there are few languages, so that ids are thinned where they are read
    sizes = F.broadcast(sizes) if langs <= SAMPLE else sizes
    share = F.col("h") / F.lit(2.0**64) + 0.5
    thin = ids.join(sizes, "lang").where(share * F.col("n") <= 2 * most + 20)
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    return thin.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("doc_id", "lang")


def fit(docs: DataFrame) -> Model:
    """Train on the sample. Grams are counted on the executors; the driver gets a fixed-width row a document."""
    ship_package(docs.sparkSession)
    ids = sample_ids(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [gram_counts(t.as_py()).astype("<f4").tobytes() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "x"])

    # at most SAMPLE ids, or one a language where there are more languages
    rows = docs.select("doc_id", "lang", F.col("text").cast("binary").alias("t")).join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    got = rows.select("lang", "t").mapInArrow(count, "lang string, x binary").collect()
    got = sorted((r["lang"], bytes(r["x"])) for r in got)
    # repeated rows of a sampled id: no language takes the place of another
    most = per_lang(len({lang for lang, _ in got}))
    got = [r for _, rows in groupby(got, lambda r: r[0]) for r in islice(rows, most)]
    x, langs = np.zeros((len(got), TABLE_SIZE), np.float32), [lang for lang, _ in got]
    for row in x[::-1]:  # each document's bytes go as soon as they are copied
        row[:] = np.frombuffer(got.pop()[1], "<f4")
    return train(x, langs)


def predict(docs: DataFrame, model: Model, name: str = "language_id") -> DataFrame:
    """All columns of docs plus one struct column `name` of (lang_pred, score, rejected); only text is read."""
    ship_package(docs.sparkSession)
    kind = "struct<lang_pred:string,score:double,rejected:boolean>"

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            got = [model.predict(t) for t in texts.to_pylist()]
            cols = list(zip(*got, strict=True)) if got else [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=["lang_pred", "score", "rejected"])

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, kind)(F.col("text").cast("binary")))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every document, from its whole text.

    Null or letterless text: und with score 0, rejected. held_out is whether crc32(doc_id) mod 5 is 0; a
    null id is neither held out nor trained on. Repeated rows get a row each, further columns are ignored.
    Ties between languages go to the first in order. Without labelled rows everything is und.
    """
    model = model or fit(docs)
    got = predict(docs.select("doc_id", "text"), model, "p")
    held = F.coalesce(crc32_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "p.lang_pred", "p.score", "p.rejected")

