"""Language identification (C12), re-aimed as a Spark job.

A character n-gram naive Bayes model learned from labelled text:

* texts are lower-cased, every run of non-letters becomes one space, and the
  1- to 3-grams of the padded text are counted inside the row (sorted run
  lengths, no shuffle);
* training: per language the counts of all its n-grams (summed by Arrow batch before the
  shuffle, so no row for each text's n-gram travels), with add-alpha smoothed
  log-probabilities, and log priors;
* scoring: profiles of up to ``IN_ROW_GRAMS`` n-grams (they are counted) go to the executors and
  each text is scored in its own row; larger ones are joined with the texts' n-grams, one
  row per n-gram with a column per language. A softmax inside the row over the (few)
  languages gives the candidates with probabilities; the top one (first on ties) is the
  detected language.

It is not number-identical to the library the reference used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from forumlens.sources.scratch import scratch

MAX_N = 3
ALPHA = 1.0
OUT_ROWS = 50_000  # of n-grams held before a batch leaves the Python job
HELD_CODES = 1 << 20  # n-grams of texts that are held before they are summed
IN_ROW_GRAMS = 1 << 20  # profiles of up to so many n-grams are sent to the executors
POINT = 21  # bits of a code point; an n-gram of up to three is one 64-bit number


def _gram_counts(text: str, max_n: int):
    """Counter of the 1..max_n character n-grams of a normalised text
    (all-blank grams skipped)."""
    from collections import Counter
    c = Counter()
    for n in range(1, max_n + 1):
        c.update(text[i:i + n] for i in range(len(text) - n + 1))
    for n in range(1, max_n + 1):
        c.pop(" " * n, None)
    return c


def _normalised(text_col: str):
    """Lower case, runs of other than letters as one space, padded with spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))),
                                                       r"[^\p{L}]+", " ")), F.lit(" "))


def gram_codes(text: str, max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a normalised text as numbers, each once, with their counts (blank ones left out)."""
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code, every, blank = point, [], 0
    for n in range(max_n):
        if n:
            code = code[:-1] | (point[n:] << (POINT * n))
        blank |= 0x20 << (POINT * n)
        every.append(code[code != blank])
    return np.unique(np.concatenate(every), return_counts=True)


def code_text(code: int) -> str:
    out = ""
    while code:
        out, code = out + chr(code & ((1 << POINT) - 1)), code >> POINT
    return out


def text_code(gram: str) -> int:
    return sum(ord(c) << (POINT * i) for i, c in enumerate(gram))


def _summed_codes(texts, max_n: int = MAX_N, held_codes: int = HELD_CODES) -> dict:
    """The n-grams of (label, text scalar) by label, as (numbers, counts). They are summed whenever the
    texts since the last time have ``held_codes`` of them, so what is held doesn't grow with the texts."""
    def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)

    by_lang, held = {}, 0
    for lang, text in texts:
        found = gram_codes(text.as_py(), max_n)
        by_lang.setdefault(lang, []).append(found)
        held += len(found[0])
        if held >= held_codes:
            by_lang, held = {k: [merged(v)] for k, v in by_lang.items()}, 0
    return {k: merged(v) for k, v in by_lang.items()}


def gram_totals(df: DataFrame, text_col: str, lang_col: str, max_n: int = MAX_N) -> DataFrame:
    """(lang_col, gram, cnt): counts of all n-grams by label, already summed over each Arrow batch."""
    from forumlens.session import ship_package
    ship_package(df.sparkSession)
    d = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias(lang_col), _normalised(text_col).alias("__t"))

    def job(batches):
        for b in batches:
            for lang, (codes, cnt) in _summed_codes(zip(b.column(0).to_pylist(), b.column(1)), max_n).items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()),
                                                  pa.array([code_text(int(c)) for c in codes], pa.string()), pa.array(cnt)],
                                                 [lang_col, "gram", "cnt"])

    return d.mapInArrow(job, f"`{lang_col}` string, gram string, cnt long")


def char_grams(df: DataFrame, text_col: str, key_cols, max_n: int = MAX_N) -> DataFrame:
    """(keys..., gram, cnt): distinct character n-grams per row with counts.

    Normalisation is JVM-side (lower-case, non-letter runs -> one space,
    padded); the n-gram counting of each whole text is a small per-row helper
    in an Arrow-batched ``mapInArrow`` (a Counter is ~10x faster than
    interpreted higher-order functions over 100k-element arrays)."""
    from forumlens.session import ship_package
    ship_package(df.sparkSession)
    from pyspark.sql import types as T

    d = df.select(*key_cols, _normalised(text_col).alias("__t"))
    key_fields = [f for f in d.schema.fields if f.name in key_cols]
    out = T.StructType(key_fields + [T.StructField("gram", T.StringType()), T.StructField("cnt", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(out)
    keys = list(key_cols)

    def rows(held, grams, cnts):
        return pa.RecordBatch.from_pydict({**held, "gram": grams, "cnt": cnts}, schema=schema)

    def job(batches):
        for b in batches:
            held, grams, cnts = {k: [] for k in keys}, [], []
            for i in range(b.num_rows):
                c = _gram_counts(b.column("__t")[i].as_py() or "", max_n)
                for k in keys:
                    held[k].extend([b.column(k)[i].as_py()] * len(c))
                grams.extend(c.keys())
                cnts.extend(c.values())
                if len(grams) >= OUT_ROWS:
                    yield rows(held, grams, cnts)
                    held, grams, cnts = {k: [] for k in keys}, [], []
            if grams:
                yield rows(held, grams, cnts)

    return d.mapInArrow(job, out)


def train_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   alpha: float = ALPHA, grams: DataFrame | None = None):
    """Profiles (lang, gram, logp) of all n-grams and per-language meta (lang, log prior,
    log-prob of an unseen gram). ``grams`` (lang, gram, cnt) may be given when
    the n-grams were already counted. Rows without a label teach nothing."""
    labelled = labelled.where(F.col(lang_col).isNotNull())
    g = grams.where(F.col(lang_col).isNotNull()) if grams is not None else gram_totals(labelled, text_col, lang_col)
    per = scratch(g.groupBy(lang_col, "gram").agg(F.sum("cnt").alias("c")), "gram-counts")
    tot = per.groupBy(lang_col).agg(F.sum("c").alias("tot"))
    vsize = per.select(F.count_distinct("gram")).scalar()
    docs = labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("nd"))
    n_docs = labelled.select(F.count(F.lit(1))).scalar()
    prof = per.join(tot, lang_col).select(
        F.col(lang_col).alias("lang"), "gram",
        F.log((F.col("c") + alpha) / (F.col("tot") + alpha * vsize)).alias("logp"))
    meta = docs.join(tot, lang_col).select(
        F.col(lang_col).alias("lang"), F.log(F.col("nd") / n_docs).alias("prior"),
        F.log(F.lit(alpha) / (F.col("tot") + alpha * vsize)).alias("unk"))
    return prof, meta


def _scores_in_row(df: DataFrame, wide: DataFrame, known: list, key_col: str, text_col: str) -> DataFrame:
    """(key, s): log-probability of each language, from profiles sent to the executors."""
    from forumlens.session import ship_package
    ship_package(df.sparkSession)
    t = wide.toArrow()  # counted by the caller
    codes = np.array([text_code(g) for g in t.column("gram").to_pylist()], np.int64)
    order = np.argsort(codes)
    logp = [t.column(f"l{i}").to_numpy().astype(float) for i in range(len(known))]
    logp = np.stack([np.where(np.isnan(x), r.unk, x) for x, r in zip(logp, known)], axis=1)[order]
    shared = df.sparkSession.sparkContext.broadcast((codes[order], logp, np.array([r.prior for r in known])))
    d = df.select(key_col, _normalised(text_col).alias("__t"))

    def job(batches):
        codes, logp, prior = shared.value
        for b in batches:
            out = np.tile(prior, (b.num_rows, 1))
            for i, text in enumerate(b.column(1).to_pylist()):
                code, cnt = gram_codes(text)
                at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                out[i] += cnt[hit] @ logp[at[hit]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], [key_col, "s"])

    return d.mapInArrow(job, StructType([d.schema[key_col], StructField("s", ArrayType(DoubleType()))]))


def detect(df: DataFrame, prof: DataFrame, meta: DataFrame, key_col: str = "doc_id",
           text_col: str = "text", grams: DataFrame | None = None) -> DataFrame:
    """Per row: lang, lang_prob and the candidate lists (by probability).
    ``grams`` (key, gram, cnt) may be given when already counted.

    The profiles become one row per n-gram with a column per language, so that every
    n-gram is joined once and a document's scores are sums; n-grams of no profile count
    for no language, those missing from one profile with its unseen-gram probability."""
    known = meta.orderBy("lang").collect()  # a row for each language
    if not known:
        none = F.lit(None)
        return df.select(key_col, none.cast("string").alias("lang"), none.cast("double").alias("lang_prob"),
                         F.array().cast("array<string>").alias("lang_lst"), F.array().cast("array<double>").alias("lang_prob_lst"))
    n = range(len(known))
    wide = prof.groupBy("gram").agg(*[F.max(F.when(F.col("lang") == r.lang, F.col("logp"))).alias(f"l{i}")
                                      for i, r in enumerate(known)])
    wide = scratch(wide, "profiles")
    if grams is None and wide.limit(IN_ROW_GRAMS + 1).count() <= IN_ROW_GRAMS:
        scores = _scores_in_row(df, wide, known, key_col, text_col)
    else:
        g = grams if grams is not None else char_grams(df, text_col, [key_col])
        sums = g.join(wide, "gram").groupBy(key_col).agg(
            *[F.sum(F.col("cnt") * F.coalesce(f"l{i}", F.lit(r.unk))).alias(f"s{i}") for i, r in enumerate(known)])
        scores = df.select(key_col).join(sums, key_col, "left").select(
            key_col, F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) + r.prior for i, r in enumerate(known)]).alias("s"))
    exps = F.transform("s", lambda x: F.exp(x - F.array_max("s")))
    weighed = scores.select(key_col, exps.alias("e")).withColumn(
        "z", F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x))
    ranked = weighed.select(key_col, F.sort_array(F.array(*[
        F.struct((-F.col("e")[i] / F.col("z")).alias("neg"), F.lit(known[i].lang).alias("lang")) for i in n])).alias("c"))
    return ranked.select(key_col, F.col("c")[0]["lang"].alias("lang"), (-F.col("c")[0]["neg"]).alias("lang_prob"),
                         F.transform("c", lambda x: x["lang"]).alias("lang_lst"),
                         F.transform("c", lambda x: -x["neg"]).alias("lang_prob_lst"))
