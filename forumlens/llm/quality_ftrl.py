"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal training.

Features are hashed 1- and 2-grams of the words and of the words' shapes (letters as
``a``/``A``, digits as ``0``, runs cut to one), with values log(1 + count) scaled to unit
length. A bounded sample of labelled texts is dealt to ``MEMBERS`` learners; each makes
follow-the-regularised-leader updates over its share, and the model is the mean of their
weights: one vector of ``BUCKETS`` numbers. Scores are sparse dot products with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from forumlens.llm.common import (batch_column, dense, doc_index, grams, hash_share, lower_bytes, mix, sigmoid,
                                  span_hashes, text_chunks, with_texts, words)

BUCKETS = 1 << 18
SAMPLE = 8000   # labelled texts, in expectation
MEMBERS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")
_SHAPE[0x80:] = ord("a")


def _shapes(buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    s = _SHAPE[buf]
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[st] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(s[keep], at[st], at[en])


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of each text, and their offsets; bucket 0 is the constant 1."""
    st, en, wo = words(buf, offs)
    keys = []
    for view, h in enumerate((span_hashes(lower_bytes(buf), st, en), _shapes(buf, st, en))):
        for n in (1, 2):
            g, go = grams(h, wo, n)
            slot = mix(g + np.uint64(4 * view + n)) % np.uint64(BUCKETS - 1) + np.uint64(1)
            keys.append((doc_index(go).astype(np.uint64) << np.uint64(32)) | slot)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    doc, slot = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    value = np.log1p(count)
    n = len(offs) - 1
    norm = np.sqrt(np.bincount(doc, value * value, n))
    return slot, value / np.maximum(norm[doc], 1e-12), np.searchsorted(doc, np.arange(n + 1))


class Ftrl:
    """FTRL-proximal for logistic loss on sparse rows."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = weight * (sigmoid(w @ x) - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def train(labelled: DataFrame, most: int = SAMPLE, texts: DataFrame | None = None) -> np.ndarray:
    """Weights from (doc_id, label) and ``texts`` (doc_id, text), which may be one table.

    About ``most`` ids are chosen, by a hash, before any text is read. Rows with a null id or
    label are left out, of an id's labels the largest counts and of its texts the smallest; a
    null text is an empty one. Without any row the weights are 0 and every score is 0.5.
    """
    texts = labelled if texts is None else texts
    rows = labelled.where("label is not null and doc_id is not null").select("doc_id", "label")
    total = rows.count()
    ids = rows.where(hash_share(F.col("doc_id"), 31, most / max(1, total))).groupBy("doc_id").agg(
        F.max(F.col("label").cast("double")).alias("label"))
    chosen = with_texts(ids, texts).select("text", "label", F.xxhash64("doc_id", F.lit(32)).alias("turn"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "label"], kind="stable")
        y, model = group["label"].to_numpy(), Ftrl(BUCKETS)
        rows = []
        for _, _, buf, offs in text_chunks(pa.array(group["text"], pa.large_string(), from_pandas=True)):
            slot, x, fo = features(buf, offs)
            rows += [(np.append(slot[a:b], 0), np.append(x[a:b], 1.0)) for a, b in zip(fo[:-1], fo[1:])]
        # Both labels weigh the same in all.
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        for _ in range(EPOCHS):
            for (at, x), label in zip(rows, y):
                model.learn(at, x, label, 0.5 / (share if label else 1 - share))
        w = model.weights()
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "w": w[at]})

    # A member's group is a share of the bounded sample.
    parts = chosen.withColumn("member", F.pmod("turn", F.lit(MEMBERS)))
    model = parts.groupBy("member").applyInPandas(learn, "slot long, w double").groupBy("slot").agg(
        (F.sum("w") / float(MEMBERS)).alias("w"))
    return dense(model, BUCKETS)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``docs[keep]`` with ``score`` in 0 to 1; null and empty texts get the constant's score.
    Texts are read whole, repeated rows are scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    def make():
        w = shared.value

        def fn(col: pa.Array) -> pa.Array:
            out = []
            for _, _, buf, offs in text_chunks(col):
                slot, x, fo = features(buf, offs)
                n = len(offs) - 1
                out.append(sigmoid(w[0] + np.bincount(np.repeat(np.arange(n), np.diff(fo)), w[slot] * x, n)))
            return pa.array(np.concatenate(out) if out else np.zeros(0))
        return fn

    return batch_column(docs, text, keep, "score", DoubleType(), make)
