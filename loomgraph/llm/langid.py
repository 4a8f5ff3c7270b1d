"""Language identification by a string kernel.

Two texts are compared by the blended spectrum: the sets of byte n-grams (1 to ``orders``) that occur in
them, hashed to ``bits``-bit features, as presence. The kernel is the size of the intersection over the
geometric mean of the sizes. Nystroem landmarks (a bounded, hash-chosen sample of the learning rows)
turn it into a feature map, and kernel ridge regression, one against the rest, learns a weight for each
landmark and language. Scoring multiplies a batch's presence matrix with the landmarks' matrix and that
with the weights.

Learning takes a sample of at most ``SAMPLE`` rows, chosen by a hash of doc_id; this bound is a
parameter. Every text is scored whole.

Cases: a null text, or one without a letter, is ``und`` with score 0. Learning rows without lang are
left out; without any learning rows all predictions are ``und``. Repeated rows give repeated results. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDERS = 3
BITS = 13
SAMPLE = 3000
LANDMARKS = 192
RIDGE = 1e-3
UND = "und"


def presence(text: bytes, out: np.ndarray, orders: int = ORDERS) -> None:
    """Marks the hashed n-grams of a text, ASCII upper case as lower case, in a row of zeros."""
    codes = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    shift = np.uint32(32 - BITS)
    gram = codes
    for n in range(1, orders + 1):
        if n > 1:
            gram = gram[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if not len(gram):
            return
        out[(gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> shift] = 1


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared features of the rows of x and y over the geometric mean of their numbers."""
    norm = np.sqrt(np.outer(x.sum(1), y.sum(1)))
    return (x @ y.T) / np.maximum(norm, 1)


class Model:
    """Landmarks and their weights for each language."""

    def __init__(self, x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        rows = np.linspace(0, len(x) - 1, min(landmarks, len(x))).astype(int) if len(x) else []
        self.landmarks = x[rows]
        if not len(x):
            return
        values, vectors = np.linalg.eigh(kernel(self.landmarks, self.landmarks).astype(np.float64))
        use = values > 1e-8 * values.max()
        self.root = vectors[:, use] / np.sqrt(values[use])  # K^-1/2 of the landmarks
        phi = kernel(x, self.landmarks) @ self.root
        y = np.array([[1.0 if lang == own else -1.0 for own in self.langs] for lang in langs])
        weight = np.sqrt(len(y) / np.maximum(1, (y > 0).sum(0)))[np.argmax(y, 1)][:, None]  # evens out the languages
        a = (phi * weight).T @ phi + ridge * len(x) * np.eye(phi.shape[1])
        self.weights = (self.root @ np.linalg.solve(a, (phi * weight).T @ y)).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = kernel(x, self.landmarks) @ self.weights
        e = np.exp(3 * (margin - margin.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def _packed(batches):
    for batch in batches:
        langs, bits = batch.column(1), []
        for text in batch.column(0):
            row = np.zeros(1 << BITS, np.uint8)
            presence(text.as_py(), row)
            bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([langs, pa.array(bits, pa.binary()), batch.column(2)], ["lang", "bits", "h"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From text and lang of the rows that may be learned from, at most about ``sample`` of them."""
    able = docs.filter(~F.coalesce(_held_out(), F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = able.select("doc_id").count()
    h = F.xxhash64("doc_id", "lang")
    share = min(1.0, 1.1 * sample / max(n, 1))
    chosen = able.filter(F.pmod(h, F.lit(1_000_003)) < share * 1_000_003)
    rows = chosen.select(F.col("text").cast("binary"), "lang", h.alias("h")).mapInArrow(_packed, "lang string, bits binary, h long").orderBy("h", "lang", "bits").limit(sample).collect()
    x = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in rows], np.float32).reshape(len(rows), 1 << BITS)
    return Model(x, [r.lang for r in rows])


def _predicted(model, size: int = 256):
    def run(batches):
        own = model.value
        for batch in batches:
            names, scores = [], []
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = np.zeros((part.num_rows, 1 << BITS), np.float32)
                able = np.zeros(part.num_rows, bool)
                for i, text in enumerate(part.column(2)):
                    raw = text.as_py()
                    if raw and (raw.translate(None, _NOT_ASCII_LETTERS) or any(map(str.isalpha, raw.decode("utf-8", "replace")))):
                        able[i] = True
                        presence(raw, x[i])
                if not len(own.landmarks) or not able.any():
                    names += [UND] * part.num_rows
                    scores += [0.0] * part.num_rows
                    continue
                p = own.scores(x)
                best = p.argmax(1)
                names += [own.langs[b] if a else UND for a, b in zip(able, best, strict=True)]
                scores += [float(p[i, b]) if able[i] else 0.0 for i, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


#: All bytes but A-Z and a-z: what remains of a text without them is its ASCII letters.
_NOT_ASCII_LETTERS = bytes(c for c in range(256) if not (0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, from its text alone."""
    common.small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(_held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("binary"))
    sent = spark.sparkContext.broadcast(model)  # bounded by the number of landmarks
    return own.mapInArrow(_predicted(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(spark, docs, learn(docs))
