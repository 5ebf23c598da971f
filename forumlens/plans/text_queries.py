"""Queries over the text path: tokens, split, dictionary, bag of words, terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.operators import phrases as PH
from forumlens.operators import vocab as V
from forumlens.plans.memo import step
from forumlens.plans.registry import register
from forumlens.plans.sqlparts import posts_cte, tokens_cte, vocab_cte, ml_tag_sql
from forumlens.sources.scratch import scratch
from forumlens.sources.tables import posts


def _tokens(spark, sf_dir):
    return V.tokens_frame(posts(spark, sf_dir))


def _written_tokens(spark, sf_dir):
    # tokens, dictionary and bag of words are steps: each is written once
    # and read by every query that needs it, and made only for those
    return step(spark, "tokens", sf_dir, lambda: scratch(_tokens(spark, sf_dir), "tokens"))


def _vocab(spark, sf_dir):
    return step(spark, "vocabulary", sf_dir, lambda: scratch(V.build_vocabulary(_written_tokens(spark, sf_dir)), "vocabulary"))


def _vocab_and_bow(spark, sf_dir):
    def build():
        toks, vocab = _written_tokens(spark, sf_dir), _vocab(spark, sf_dir)
        return toks, vocab, scratch(V.bag_of_words(toks, vocab), "bag-of-words")
    return step(spark, "vocab_and_bow", sf_dir, build)


def _phrase_table(spark, sf_dir, n):
    """The phrases of pass ``n``, learned on the training documents of the pass before."""
    def build():
        base = _written_tokens(spark, sf_dir) if n == 1 else _merged_tokens(spark, sf_dir, n - 1)
        return scratch(PH.learn_phrases(base.filter(F.col("ml_tag") == 0)), "phrases")
    return step(spark, "phrase_table", sf_dir, build, n)


def _merged_tokens(spark, sf_dir, n):
    def build():
        base = _written_tokens(spark, sf_dir) if n == 1 else _merged_tokens(spark, sf_dir, n - 1)
        return scratch(PH.apply_phrases(base, _phrase_table(spark, sf_dir, n)), "phrase-tokens")
    return step(spark, "phrase_tokens", sf_dir, build, n)


def _ext_tokens(spark, sf_dir, nr_grams):
    def build():
        tables = [_phrase_table(spark, sf_dir, n) for n in range(1, nr_grams)]
        return scratch(PH.extend_by_phrases(_written_tokens(spark, sf_dir), tables), "extended-tokens")
    return step(spark, "ext_tokens", sf_dir, build, nr_grams)


@register("token_stats", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}
SELECT ord_key, CAST(len(tokens) AS BIGINT) AS n_tokens,
       CAST(len(list_distinct(tokens)) AS BIGINT) AS n_distinct
FROM toks""")
def token_stats(spark, sf_dir):
    """D1+D3: tokens per document and distinct tokens per document."""
    t = _tokens(spark, sf_dir)
    return t.select("ord_key", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.size(F.array_distinct("tokens")).cast("bigint").alias("n_distinct"))


@register("split_tags", sql=lambda: f"""
SELECT doc_id AS post_id, {ml_tag_sql('doc_id')} AS ml_tag FROM documents""")
def split_tags(spark, sf_dir):
    """C4: deterministic train/validation/test tag per post."""
    return posts(spark, sf_dir).select("post_id", "ml_tag")


@register("vocabulary", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}, {vocab_cte()}
SELECT token, token_id, df, cf FROM vocab""")
def vocabulary(spark, sf_dir):
    """D9+D10: dictionary with ids, document and corpus frequencies."""
    return V.build_vocabulary(_tokens(spark, sf_dir)).select("token", "token_id", "df", "cf")


_BOW_SQL = """
tt_all AS (SELECT ord_key, unnest(tokens) AS token FROM toks),
dc AS (SELECT ord_key, token, count(*) AS cnt FROM tt_all GROUP BY ord_key, token),
bow AS (SELECT dc.ord_key, v.token_id, dc.token, CAST(dc.cnt AS BIGINT) AS cnt
        FROM dc JOIN vocab v ON v.token = dc.token)"""


@register("doc_bow", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}, {vocab_cte()}, {_BOW_SQL}
SELECT ord_key, token_id, token, cnt FROM bow""")
def doc_bow(spark, sf_dir):
    """D11 (flat view): one row per (document, known token) with its count."""
    _, _, bow = _vocab_and_bow(spark, sf_dir)
    return V.bow_entries(bow).select("ord_key", "token_id", "token", "cnt")


@register("corpus_terms", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}, {vocab_cte()}, {_BOW_SQL},
tot AS (SELECT token, CAST(sum(cnt) AS BIGINT) AS cnt FROM bow GROUP BY token),
top AS (SELECT * FROM tot ORDER BY cnt DESC, token LIMIT 100)
SELECT token, cnt, round(cnt / max(cnt) OVER (), 6) AS rel,
       CAST(row_number() OVER (ORDER BY cnt DESC, token) AS INTEGER) AS rank FROM top""")
def corpus_terms(spark, sf_dir):
    """The 100 most frequent known tokens of the corpus (all splits)."""
    _, _, bow = _vocab_and_bow(spark, sf_dir)
    return V.corpus_term_frequency(bow, top_n=100)


@register("doc_top_terms", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}, {vocab_cte()}, {_BOW_SQL},
r AS (SELECT ord_key, token, cnt, row_number() OVER (PARTITION BY ord_key ORDER BY cnt DESC, token) AS rank FROM bow)
SELECT ord_key, token, cnt, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def doc_top_terms(spark, sf_dir):
    """The five most frequent known tokens of every document."""
    _, _, bow = _vocab_and_bow(spark, sf_dir)
    return V.top_terms_per_doc(bow, 5).select("ord_key", "token", "cnt", "rank")


@register("vocabulary_size", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}, {vocab_cte()}
SELECT count(*) AS vocab_size FROM vocab""")
def vocabulary_size(spark, sf_dir):
    """D15."""
    return V.vocabulary_size(V.kept_tokens(_tokens(spark, sf_dir)))


# ------------------------------------------------------------------ phrases


_PHRASE_SQL = """
ptrain AS (SELECT * FROM toks WHERE ml_tag = 0),
ntot AS (SELECT sum(len(tokens)) AS n FROM ptrain),
uni AS (SELECT t, count(*) AS c FROM (SELECT unnest(tokens) AS t FROM ptrain) GROUP BY t),
pr AS (SELECT ord_key, unnest(tokens[:len(tokens) - 1]) AS a, unnest(tokens[2:]) AS b
       FROM ptrain WHERE len(tokens) >= 2),
pc AS (SELECT a, b, count(*) AS n_ab FROM pr GROUP BY a, b HAVING count(*) >= 20),
sc AS (SELECT pc.a, pc.b, pc.n_ab,
              ln((pc.n_ab / ntot.n) / ((ua.c / ntot.n) * (ub.c / ntot.n))) / (-ln(pc.n_ab / ntot.n)) AS score
       FROM pc JOIN uni ua ON ua.t = pc.a JOIN uni ub ON ub.t = pc.b CROSS JOIN ntot),
phr AS (SELECT * FROM sc WHERE score > 0.05)"""


@register("phrase_scores", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}, {_PHRASE_SQL}
SELECT a, b, CAST(n_ab AS BIGINT) AS n_ab, round(score, 6) AS score FROM phr""")
def phrase_scores(spark, sf_dir):
    """Adjacent pairs of the training documents with count >= 20 and
    normalised PMI > 0.05."""
    train = scratch(_tokens(spark, sf_dir).filter(F.col("ml_tag") == 0).select("ord_key", "tokens"), "phrase-train")
    p = PH.learn_phrases(train)
    return p.select("a", "b", "n_ab", F.round("score", 6).alias("score"))


@register("phrase_tokens", sql=lambda: f"""
WITH {posts_cte()}, {tokens_cte()}, {_PHRASE_SQL},
allpr AS (SELECT ord_key, unnest(range(len(tokens) - 1)) AS i, unnest(tokens[:len(tokens) - 1]) AS a,
                 unnest(tokens[2:]) AS b
          FROM toks WHERE len(tokens) >= 2),
flagged AS (SELECT allpr.* FROM allpr WHERE EXISTS (SELECT 1 FROM phr WHERE phr.a = allpr.a AND phr.b = allpr.b)),
runs AS (SELECT ord_key, i, i - row_number() OVER (PARTITION BY ord_key ORDER BY i) AS grp FROM flagged),
taken AS (SELECT ord_key, i FROM (SELECT *, min(i) OVER (PARTITION BY ord_key, grp) AS st FROM runs)
          WHERE (i - st) % 2 = 0),
k AS (SELECT ord_key, count(*) AS n FROM taken GROUP BY ord_key)
SELECT t.ord_key, CAST(len(t.tokens) + coalesce(k.n, 0) AS BIGINT) AS n_ext,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_phrases
FROM toks t LEFT JOIN k ON k.ord_key = t.ord_key""")
def phrase_tokens(spark, sf_dir):
    """D6 + D8 (two-word phrases): extended token count and merged phrases
    per document, phrases learned on the training split, applied to all."""
    ext = _ext_tokens(spark, sf_dir, 2)
    return ext.select("ord_key", F.size("tokens").cast("bigint").alias("n_ext"),
                      F.size(F.filter("tokens", lambda t: PH.n_joined(t) == 2)).cast("bigint").alias("n_phrases"))


def _pass_sql(source: str, n: int) -> str:
    """Pass ``n`` of the phrase chain in SQL: phrases learned on the training documents of
    ``source``, merged greedily from the left; its tokens are ``m{n}``."""
    return f"""
tr{n} AS (SELECT * FROM {source} WHERE ml_tag = 0),
ntot{n} AS (SELECT sum(len(tokens)) AS n FROM tr{n}),
uni{n} AS (SELECT t, count(*) AS c FROM (SELECT unnest(tokens) AS t FROM tr{n}) GROUP BY t),
pr{n} AS (SELECT unnest(tokens[:len(tokens) - 1]) AS a, unnest(tokens[2:]) AS b FROM tr{n} WHERE len(tokens) >= 2),
pc{n} AS (SELECT a, b, count(*) AS n_ab FROM pr{n} GROUP BY a, b HAVING count(*) >= 20),
phr{n} AS MATERIALIZED (SELECT p.a, p.b FROM pc{n} p JOIN uni{n} x ON x.t = p.a JOIN uni{n} y ON y.t = p.b CROSS JOIN ntot{n} s
  WHERE ln((p.n_ab / s.n) / ((x.c / s.n) * (y.c / s.n))) / (-ln(p.n_ab / s.n)) > 0.05),
ap{n} AS (SELECT ord_key, unnest(range(len(tokens) - 1)) AS i, unnest(tokens[:len(tokens) - 1]) AS a, unnest(tokens[2:]) AS b
          FROM {source} WHERE len(tokens) >= 2),
fl{n} AS (SELECT q.* FROM ap{n} q JOIN phr{n} h ON h.a = q.a AND h.b = q.b),
rn{n} AS (SELECT *, i - row_number() OVER (PARTITION BY ord_key ORDER BY i) AS grp FROM fl{n}),
tk{n} AS MATERIALIZED (SELECT ord_key, i, a || '_' || b AS t FROM (SELECT *, min(i) OVER (PARTITION BY ord_key, grp) AS st FROM rn{n})
         WHERE (i - st) % 2 = 0),
ex{n} AS (SELECT ord_key, unnest(range(len(tokens))) AS j, unnest(tokens) AS t FROM {source}),
mg{n} AS (SELECT e.ord_key, list(coalesce(k.t, e.t) ORDER BY e.j) AS tokens FROM ex{n} e
          LEFT JOIN tk{n} k ON k.ord_key = e.ord_key AND k.i = e.j
          WHERE NOT EXISTS (SELECT 1 FROM tk{n} s WHERE s.ord_key = e.ord_key AND s.i + 1 = e.j) GROUP BY e.ord_key),
m{n} AS MATERIALIZED (SELECT s.ord_key, s.ml_tag, coalesce(g.tokens, []) AS tokens FROM {source} s LEFT JOIN mg{n} g ON g.ord_key = s.ord_key)"""


def _extended_sql() -> str:
    """``toks``: the tokens with the two-word phrases of the first pass and the three-word ones of the second."""
    plain = tokens_cte().replace("toks AS", "plain AS", 1)

    def words(table: str, n: int) -> str:
        return f"list_filter({table}.tokens, lambda t: len(string_split(t, '_')) = {n})"
    return f"""{plain}, {_pass_sql('plain', 1)}, {_pass_sql('m1', 2)},
toks AS MATERIALIZED (SELECT p.ord_key, p.ml_tag, p.tokens || {words('m1', 2)} || {words('m2', 3)} AS tokens
                      FROM plain p JOIN m1 ON m1.ord_key = p.ord_key JOIN m2 ON m2.ord_key = p.ord_key)"""


@register("phrase_tokens_3gram", sql=lambda: f"""
WITH {posts_cte()}, {_extended_sql()}
SELECT ord_key, CAST(len(tokens) AS BIGINT) AS n_ext,
       CAST(len(list_filter(tokens, lambda t: len(string_split(t, '_')) = 2)) AS BIGINT) AS n_bigrams,
       CAST(len(list_filter(tokens, lambda t: len(string_split(t, '_')) = 3)) AS BIGINT) AS n_trigrams FROM toks""")
def phrase_tokens_3gram(spark, sf_dir):
    """D5-D8 with three-word phrases (two chained passes): per document the
    extended token count and the two- and three-word phrases appended."""
    ext = _ext_tokens(spark, sf_dir, 3)
    return ext.select("ord_key", F.size("tokens").cast("bigint").alias("n_ext"),
                      F.size(F.filter("tokens", lambda t: PH.n_joined(t) == 2)).cast("bigint").alias("n_bigrams"),
                      F.size(F.filter("tokens", lambda t: PH.n_joined(t) == 3)).cast("bigint").alias("n_trigrams"))


@register("phrase_vocabulary", sql=lambda: f"""
WITH {posts_cte()}, {_extended_sql()}, {vocab_cte()}
SELECT token, token_id, df, cf FROM vocab""")
def phrase_vocabulary(spark, sf_dir):
    """D5-D10 as configured in the demo (3-grams): dictionary over extended
    tokens of the training split."""
    ext = _ext_tokens(spark, sf_dir, 3)
    return V.build_vocabulary(ext).select("token", "token_id", "df", "cf")
