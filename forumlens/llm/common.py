"""Shared helpers of the training-data operators.

Text kernels work on the raw UTF-8 bytes of an Arrow string column: a batch is
cut into chunks of whole documents (about 2 MB, or one longer document), and
words, word hashes and n-grams are found for the whole chunk with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from forumlens.session import ensure_checkpoint_dir, ship_package

CHUNK_BYTES = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"

# ------------------------------------------------------------------ Spark side


def prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def hash_share(key: Column, seed: int, share: Column | float) -> Column:
    """True for about ``share`` of all keys, the same ones on every run."""
    unit = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return unit < share


def with_texts(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """``chosen`` (doc_id, ...; each id once, a bounded sample) with the text of its document.

    Only the chosen documents' texts travel. Of an id's texts the smallest counts, an id
    without one in (doc_id, text) is left out; null texts are empty.
    """
    few = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    others = [c for c in chosen.columns if c != "doc_id"]
    return few.groupBy("doc_id", *others).agg(F.min("text").alias("text"))


def unnamed(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... (no name can clash), and the new names of ``wanted``."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(w)] for w in wanted]


def batch_column(df: DataFrame, text: str, keep: list[str], out: str, kind: DataType,
                 make: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """``df[keep]`` plus column ``out``, computed batch by batch from column ``text``.

    ``make`` runs once per task and returns the function applied to each Arrow column.
    """
    cols = [f for f in df.schema.fields if f.name in keep]
    names, at = [f.name for f in cols], keep.index(text) if text in keep else None
    src = df.select(*names) if at is not None else df.select(*names, text)
    where = src.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            got = fn(b.column(where))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [got], names + [out])

    return src.mapInArrow(run, StructType([*cols, StructField(out, kind)]))


# ---------------------------------------------------------------- byte kernels

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, np.uint64(base))
            a[0] = 1
            _POW[name] = np.cumprod(a)
    return _POW["up"][:n], _POW["down"][:n]


def lower_bytes(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals to small letters, byte for byte."""
    out = LOWER[buf]
    if len(out) > 1:
        up = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][up] += 32
    return out


def text_chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null counts as empty."""
    col = col.fill_null("") if col.null_count else col
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other than white space), and per document
    the index of its first word (one more entry than documents)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = ~_WS[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    st = np.flatnonzero(w & (~before | edge[:n]))
    en = np.flatnonzero(w & (~after | edge[1:])) + 1
    return st, en, np.searchsorted(st, offs)


def span_hashes(buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal contents wherever they stand."""
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:len(buf)], out=total[1:])
    return mix((total[en] - total[st]) * down[st] + (en - st).astype(np.uint64))


def grams(h: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive items within each document, and their offsets."""
    if n == 1:
        return h, offs
    size = np.maximum(np.diff(offs) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(size)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(offs[:-1] - out[:-1], size)
    g = h[at]
    for k in range(1, n):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
    return mix(g), out


def doc_index(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def shingles(buf: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n``-word shingles of the lower-cased words; a text of fewer words has
    one shingle of all its words, a text without words has none."""
    low = lower_bytes(buf)
    st, en, wo = words(low, offs)
    h = span_hashes(low, st, en)
    g, go = grams(h, wo, n)
    short = np.flatnonzero((np.diff(wo) > 0) & (np.diff(wo) < n))
    if not len(short):
        return g, go
    extra = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        has = np.diff(wo)[short] > k
        extra[has] = extra[has] * np.uint64(0xD6E8FEB86659FD93) + h[wo[short][has] + k]
    g = np.insert(g, go[short], mix(extra + np.uint64(1)))
    size = np.diff(go)
    size[short] += 1
    return g, np.concatenate([[0], np.cumsum(size)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def dense(rows: DataFrame, size: int, dtype=np.float64) -> np.ndarray:
    """A table (slot, value) with at most ``size`` slots as one array (a model of fixed size)."""
    got = rows.toArrow()
    out = np.zeros(size, dtype)
    if got.num_rows:
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out
