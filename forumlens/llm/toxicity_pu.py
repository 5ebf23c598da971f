"""Toxicity: non-negative positive-unlabelled learning (numpy classifiers, one for each member).

Confirmed toxic texts are the positives; texts drawn without regard to labels are the
unlabelled. With class prior ``p`` and logistic loss ``l``, the risk is
``p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])``; when the second part falls below 0,
the step goes against it instead (the non-negative correction).

Features are the hashed words and word beginnings that positives hold clearly more
often than the unlabelled do. Both samples are bounded; ``MEMBERS`` classifiers, each on
all sampled positives and its share of the unlabelled, are averaged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from forumlens.llm.common import (batch_column, dense, doc_index, grams, hash_share, lower_bytes, mix, sigmoid,
                                  span_hashes, text_chunks, with_texts, words)

BUCKETS = 1 << 20
POSITIVES, UNLABELLED = 4000, 12000  # texts, in expectation
MEMBERS = 3
PREFIXES = (4, 5, 6)
LEAST_DOCS = 4    # positives that hold a feature
LEAST_LIFT = 0.7  # log ratio of its shares, as a part of the largest that the prior allows
STEPS, RATE, DECAY = 400, 0.05, 1e-3

_WORDLY = np.full(256, 0x20, np.uint8)
_WORDLY[0x30:0x3A] = np.arange(0x30, 0x3A)
_WORDLY[0x61:0x7B] = np.arange(0x61, 0x7B)
_WORDLY[0x80:] = np.arange(0x80, 0x100)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``text << 32 | bucket`` of the words (letters and digits) and word beginnings, repeats kept."""
    low = _WORDLY[lower_bytes(buf)]
    st, en, wo = words(low, offs)
    keys = []
    for k, ends in enumerate((en, *(np.minimum(en, st + n) for n in PREFIXES))):
        slot = mix(span_hashes(low, st, ends) + np.uint64(k)) % np.uint64(BUCKETS - 1) + np.uint64(1)
        keys.append((doc_index(wo).astype(np.uint64) << np.uint64(32)) | slot)
    return keys, wo


def _presence(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, each once."""
    doc, slot = [], []
    for i, _, buf, offs in text_chunks(pa.array(texts, pa.large_string(), from_pandas=True)):
        key = np.unique(np.concatenate(features(buf, offs)[0]))
        doc.append((key >> np.uint64(32)).astype(np.int64) + i)
        slot.append((key & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return np.concatenate(doc), np.concatenate(slot)


def fit(texts: pd.Series, positive: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights (bucket 0: the constant) of one classifier."""
    doc, slot = _presence(texts)
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    df_p = np.bincount(slot[positive[doc]], minlength=BUCKETS)
    df_u = np.bincount(slot[~positive[doc]], minlength=BUCKETS)
    lift = np.log((df_p + 0.5) / (n_p + 1)) - np.log((df_u + 0.5) / (n_u + 1))
    # A feature of positives alone has the log ratio log(1 / prior).
    used = np.flatnonzero((df_p >= LEAST_DOCS) & (lift >= LEAST_LIFT * np.log(1 / prior)))
    at = np.full(BUCKETS, -1)
    at[used] = np.arange(len(used))
    has = at[slot] >= 0
    doc, col = doc[has], at[slot[has]]
    x = lift[used]
    w, b = np.zeros(len(used)), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    p, u = positive, ~positive
    for step in range(1, STEPS + 1):
        f = b + np.bincount(doc, (w * x)[col], len(positive))
        s = sigmoid(f)
        # l(f) = log(1 + e^-f), so l'(f) = s - 1 and the derivative of l(-f) is s.
        negative = np.logaddexp(0, f[u]).mean() - prior * np.logaddexp(0, f[p]).mean()
        slope = np.zeros(len(positive))
        if negative >= 0:
            slope[p] = prior * (s[p] - 1) / n_p - prior * s[p] / n_p
            slope[u] = s[u] / n_u
        else:
            slope[p] = prior * s[p] / n_p
            slope[u] = -s[u] / n_u
        g = np.append(np.bincount(col, slope[doc], len(used)) * x + DECAY * w, slope.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return np.append(used, 0), np.append(w * x, b)


def train(learn: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
          prior: float | None = None, texts: DataFrame | None = None) -> np.ndarray:
    """Weights from (doc_id, label) and ``texts`` (doc_id, text), which may be one table: label 1
    marks confirmed toxic texts, and rows of any label or none are the unlabelled.

    ``prior``: the share of toxic texts; if not given, the share of 1 among the non-null
    labels. Both samples are chosen by id before any text is read. Null ids are left out,
    null texts are empty, of an id's texts the smallest counts. Without a positive or an
    unlabelled text the weights are those of the prior alone (0.5 if there is no label).
    """
    texts = learn if texts is None else texts
    rows = learn.where("doc_id is not null").select("doc_id", "label")
    n, n_1, n_known = rows.agg(F.count(F.lit(1)), F.sum((F.col("label") == 1).cast("long")), F.count("label")).first()
    if prior is None:
        prior = (n_1 or 0) / n_known if n_known else 0.5
    prior = min(max(prior, 1e-4), 0.9)
    if not n_1:
        out = np.zeros(BUCKETS)
        out[0] = np.log(prior / (1 - prior)) if n_known else 0.0
        return out
    is_pos = F.coalesce((F.col("label") == 1) & hash_share(F.col("doc_id"), 41, positives / n_1), F.lit(False))
    is_unl = hash_share(F.col("doc_id"), 42, unlabelled / n)
    ids = rows.select("doc_id", is_pos.alias("pos"), is_unl.alias("unl")).where("pos or unl").groupBy("doc_id").agg(
        F.max("pos").alias("pos"), F.max("unl").alias("unl"))
    chosen = with_texts(ids, texts)
    member = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(MEMBERS)).cast("int")
    both = chosen.where("pos").select(F.explode(F.array(*[F.lit(m) for m in range(MEMBERS)])).alias("member"), "doc_id", "text",
                                      F.lit(True).alias("positive")).unionByName(
        chosen.where("unl").select(member.alias("member"), "doc_id", "text", F.lit(False).alias("positive")))

    def learn_one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["positive", "doc_id"], kind="stable")
        positive = group["positive"].to_numpy(bool)
        if positive.all() or not positive.any():
            return pd.DataFrame({"slot": [0], "w": [np.log(prior / (1 - prior))]})
        at, w = fit(group["text"], positive, prior)
        return pd.DataFrame({"slot": at, "w": w})

    got = both.groupBy("member").applyInPandas(learn_one, "slot long, w double")
    return dense(got.groupBy("slot").agg((F.sum("w") / float(MEMBERS)).alias("w")), BUCKETS)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``docs[keep]`` with ``score`` in 0 to 1; null and empty texts get the constant's score.
    Texts are read whole, repeated rows are scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    def make():
        w = shared.value

        def fn(col: pa.Array) -> pa.Array:
            out = []
            for _, _, buf, offs in text_chunks(col):
                n = len(offs) - 1
                hit = [k[w[(k & np.uint64(0xFFFFFFFF)).astype(np.int64)] != 0] for k in features(buf, offs)[0]]
                key = np.unique(np.concatenate(hit))
                doc, slot = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                out.append(sigmoid(w[0] + np.bincount(doc, w[slot], n)))
            return pa.array(np.concatenate(out) if out else np.zeros(0))
        return fn

    return batch_column(docs, text, keep, "score", DoubleType(), make)
