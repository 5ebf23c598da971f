"""Language ID by language-bitmask n-gram filters.

Training counts byte n-grams (of the letters, lower-cased, words parted by one space) in
a bounded sample of labelled texts and keeps for each n-gram the languages in which it is
about as frequent as anywhere. A bit-sliced Bloom filter holds them: a table of fixed
size whose cells are bitmasks of languages; the AND of an n-gram's cells gives all
languages that contain it. A text gets a popcount for each language, corrected for the
filter's false positives, and the highest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from forumlens.llm.common import batch_column, hash_share, lower_bytes, mix, text_chunks

ORDERS = (3, 5)
CELLS = 1 << 23
SAMPLE = 4000  # texts a language, in expectation
SHARE = 0.25   # an n-gram belongs to the languages with this share of its highest rate
LEAST = 3      # occurrences in a language
UND = "und"

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Filter:
    langs: list[str]
    words: list[np.ndarray]  # bit-sliced cells, 63 languages each
    false_rate: np.ndarray   # by language


def letters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with one space between runs of them."""
    b = _LETTER[lower_bytes(buf)]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
    return b[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def ngrams(b: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each text, and their offsets by text."""
    m = len(b) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    g = np.full(m, np.uint64(n))
    for k in range(n):
        g = (g << np.uint64(8)) | b[k:k + m]
    ok = np.ones(len(b) + 1, bool)
    for k in range(1, n):  # not across the end of a text
        ok[np.maximum(offs[1:] - k, 0)] = False
    ok = ok[:m]
    return mix(g[ok]), np.concatenate([[0], np.cumsum(ok)])[np.minimum(offs, m)]


def sample(docs: DataFrame, learn, most: int = SAMPLE) -> DataFrame:
    """About ``most`` texts of each language, chosen by a hash of the id."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("lang").count()  # one row for each language
    share = F.lit(0.0)
    for lang, n in sorted((r["lang"], r["count"]) for r in counts.collect()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, most / n))).otherwise(share)
    return rows.where(hash_share(F.col("doc_id"), 21, share)).select("text", "lang")


def train(rows: DataFrame, cells: int = CELLS) -> Filter:
    """The filter of (text, lang); the table sent to the driver has ``cells`` cells at most."""
    langs = sorted(r["lang"] for r in rows.where("text is not null").select("lang").distinct().collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            tags = np.array([at.get(x, -1) for x in batch.column(1).to_pylist()])
            for i, _, buf, offs in text_chunks(batch.column(0)):
                b, lo = letters(buf, offs)
                for n in ORDERS:
                    g, go = ngrams(b, lo, n)
                    lang = np.repeat(tags[i:i + len(lo) - 1], np.diff(go))
                    for x in np.unique(lang[lang >= 0]):
                        u, c = np.unique(g[lang == x], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(u.view(np.int64)), pa.array(np.full(len(u), x, np.int32)),
                             pa.array(np.full(len(u), n, np.int32)), pa.array(c.astype(np.int64))],
                            ["gram", "lang", "n", "c"])

    counted = (rows.select("text", "lang").mapInArrow(count, "gram long, lang int, n int, c long")
               .groupBy("gram", "n", "lang").agg(F.sum("c").alias("c")))
    totals = {(r["lang"], r["n"]): r["c"] for r in counted.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    rate = F.lit(None).cast("double")
    for (x, n), total in sorted(totals.items()):
        rate = F.when((F.col("lang") == x) & (F.col("n") == n), F.col("c") / float(total)).otherwise(rate)
    by_gram = counted.withColumn("rate", rate).groupBy("gram").agg(
        F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate", "c")).alias("all"))  # a row a language
    kept = by_gram.select("gram", F.explode(F.filter("all", lambda s: (s["rate"] >= F.col("top") * SHARE) & (s["c"] >= LEAST)))
                          .alias("s")).select("gram", F.col("s.lang").alias("lang"))
    bit = F.expr("shiftleft(1L, lang % 63)")
    cell = F.explode(F.array(F.col("gram").bitwiseAND(cells - 1), F.shiftright("gram", 32).bitwiseAND(cells - 1)))
    table = (kept.select(F.expr("lang div 63").cast("int").alias("word"), cell.alias("cell"), bit.alias("bit"))
             .groupBy("word", "cell").agg(F.bit_or("bit").alias("mask")).toArrow())
    word, at, mask = (table.column(i).to_numpy() for i in range(3))
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    words, rates = [], np.zeros(len(langs))
    for w in range(-(-len(langs) // 63)):
        cellsw = np.zeros(cells, kind)
        cellsw[at[word == w]] = mask[word == w].astype(kind)
        words.append(cellsw)
    for x in range(len(langs)):
        rates[x] = np.mean((words[x // 63] >> kind(x % 63)) & kind(1)) ** 2
    return Filter(langs, words, rates)


def score_texts(model: Filter, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Corrected popcounts by text and language."""
    b, lo = letters(buf, offs)
    out = np.zeros((len(offs) - 1, len(model.langs)))
    cells = np.uint64(len(model.words[0]) - 1) if model.words else np.uint64(0)
    for n in ORDERS:
        g, go = ngrams(b, lo, n)
        seen = np.diff(go)
        one, two = (g & cells).astype(np.int64), ((g >> np.uint64(32)) & cells).astype(np.int64)
        for x in range(len(model.langs)):
            t = model.words[x // 63]
            if x % 63 == 0:
                masks = t[one] & t[two]
            bits = (masks >> t.dtype.type(x % 63)) & t.dtype.type(1)
            total = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            f = model.false_rate[x]
            out[:, x] += np.maximum(0, total[go[1:]] - total[go[:-1]] - f * seen) / (1 - f if f < 1 else 1)
    return out


def predict(docs: DataFrame, model: Filter, keep: list[str], text: str = "text") -> DataFrame:
    """``docs[keep]`` with lang_pred and score (the winner's share of the corrected counts).

    Null texts and texts without a letter are ``und`` with score 0, as is every text if
    nothing was learned; a text whose n-grams are all unknown gets the first language
    with score 0, and ties go to the first by code point. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def make():
        m = shared.value

        def fn(col: pa.Array) -> pa.Array:
            best, share = [], []
            for i, j, buf, offs in text_chunks(col):
                s = score_texts(m, buf, offs)
                for k, t in enumerate(col.slice(i, j - i).to_pylist()):
                    total = s[k].sum() if len(m.langs) else 0.0
                    if not m.langs or t is None or not any(map(str.isalpha, t)):
                        best.append(UND)
                        share.append(0.0)
                    else:
                        at = int(np.argmax(s[k]))
                        best.append(m.langs[at])
                        share.append(float(s[k][at] / total) if total > 0 else 0.0)
            return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(share, pa.float64())],
                                              ["lang_pred", "score"])
        return fn

    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    got = batch_column(docs, text, keep, "_lang", kind, make)
    return got.select(*keep, "_lang.lang_pred", "_lang.score")
