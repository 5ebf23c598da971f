"""Tokenization as Column expressions.

Everything here stays JVM-side: ``split`` + higher-order ``filter``; the
stop-word test is an ``IN`` list that the optimizer turns into a hash set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tokenizer splits on every character outside this class and
# keeps pieces longer than one character.
TOKEN_SPLIT = "[^a-z]"
MIN_TOKEN_LEN = 2


# Spark's public English stop-word list as the tokenizer sees it
# (words with apostrophes as their pieces of two letters or more).
STOP_WORDS = tuple("""
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very
can will just don should now ll re ve isn aren wasn weren haven hasn hadn doesn didn won wouldn shan
shouldn mustn couldn cannot could let ought would
""".split())


def default_stop_words() -> tuple[str, ...]:
    """The English stop words, without a JVM (the DuckDB oracle uses the same list)."""
    return STOP_WORDS


def tokenize(text: Column | str, to_lower_case: bool = True, stop_words=None,
             own_stop_words=None, lemma_map: Column | None = None) -> Column:
    """Lower-case, split on ``[^a-z]``, keep length > 1, drop stop words.

    ``stop_words=None`` uses :func:`default_stop_words`; pass ``()`` to keep them.
    Duplicates and order are preserved (a bag, not a set). ``lemma_map`` is an
    optional ``map<string,string>`` column (from a broadcast join) applied before
    the stop-word filter, matching the reference's lemmatize-then-filter order.
    A null text gives an empty array.
    """
    col = F.col(text) if isinstance(text, str) else text
    col = F.coalesce(col, F.lit(""))
    if to_lower_case:
        col = F.lower(col)
    toks = F.filter(F.split(col, TOKEN_SPLIT), lambda t: F.length(t) >= MIN_TOKEN_LEN)
    if lemma_map is not None:
        toks = F.transform(toks, lambda t: F.coalesce(lemma_map[t], t))
    stops = list(default_stop_words() if stop_words is None else stop_words)
    stops += list(own_stop_words or [])
    if stops:
        toks = F.filter(toks, lambda t: ~t.isin(stops))
    return toks


def with_run_lengths(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """In-row bag of words: adds ``out array<struct<token,cnt>>`` sorted by token.

    Sort once, mark run starts, take differences -- O(n log n) per document and
    no shuffle, so per-document counting never leaves the row. Each step is its
    own projected column so lambdas reference a computed array instead of
    re-evaluating the sort per element.
    """
    s, st = f"__{out}_s", f"__{out}_st"
    df = df.withColumn(s, F.array_sort(F.col(tokens)))
    sc = F.col(s)
    n = F.size(sc)
    df = df.withColumn(st, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                                    lambda i: F.when(i >= n, False).when(i == 0, True)
                                    .otherwise(sc[i] != sc[i - 1])))
    stc = F.col(st)
    m = F.size(stc)
    bag = F.when(n == 0, F.array().cast("array<struct<token:string,cnt:bigint>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))),
            lambda j: F.struct(
                sc[stc[j]].alias("token"),
                (F.when(j + 1 < m, stc[j + 1]).otherwise(n) - stc[j]).cast("bigint").alias("cnt"),
            ),
        ))
    return df.withColumn(out, bag).drop(s, st)
