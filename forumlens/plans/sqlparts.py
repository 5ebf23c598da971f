"""Reusable DuckDB SQL fragments for the oracle queries.

They restate the engine's semantics in plain SQL so the driver can check the
Spark results independently (same parameters, same fixed values).
"""

from __future__ import annotations

from forumlens.functions.scalars import IMAGE_SUFFIXES, INTERNAL_HOST_MARK
from forumlens.functions.text import default_stop_words


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def tokens_sql(text: str = "text") -> str:
    stops = sql_list(default_stop_words())
    return (f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^a-z]'), "
            f"lambda t: length(t) >= 2 AND NOT list_contains({stops}, t))")


def ml_tag_sql(id_col: str = "doc_id", test_fraction: float = 0.15, val_fraction: float = 0.15,
               seed: int = 0) -> str:
    u = (f"(((({id_col} % 2147483648) * 1103515245 + {12345 + seed}) % 2147483648) "
         f"/ 2147483648.0)")
    t0 = repr(1.0 - test_fraction - val_fraction)
    t1 = repr(1.0 - test_fraction)
    return (f"CAST(CASE WHEN {u} < CAST({t0} AS DOUBLE) THEN 0 "
            f"WHEN {u} < CAST({t1} AS DOUBLE) THEN 1 ELSE 2 END AS INTEGER)")


def posts_cte() -> str:
    return (f"posts AS (SELECT d.doc_id AS post_id, d.doc_id AS ord_key, {ml_tag_sql('d.doc_id')} AS ml_tag, "
            f"d.text, [d.source, d.lang] AS tags, d.lang FROM documents d)")


def tokens_cte() -> str:
    return f"toks AS MATERIALIZED (SELECT post_id, ord_key, ml_tag, {tokens_sql('text')} AS tokens FROM posts)"


def vocab_cte(no_below: int = 1, no_above: float = 1.0, keep_n: int | None = None) -> str:
    limit = "" if keep_n is None else f"ORDER BY df DESC, first_doc, token LIMIT {keep_n}"
    return f"""
train AS (SELECT * FROM toks WHERE ml_tag = 0),
tt AS (SELECT ord_key, unnest(tokens) AS token FROM train),
per_tok AS (SELECT token, count(DISTINCT ord_key) AS df, count(*) AS cf, min(ord_key) AS first_doc
            FROM tt GROUP BY token),
kept AS (SELECT * FROM per_tok
         WHERE df >= {no_below} AND df <= floor(CAST({repr(float(no_above))} AS DOUBLE) * (SELECT count(*) FROM train))
         {limit}),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY first_doc, token) - 1 AS INTEGER) AS token_id,
          df, cf, first_doc FROM kept)"""


def link_type_sql(addr: str) -> str:
    img = " OR ".join(f"ends_with({addr}, '{s}')" for s in IMAGE_SUFFIXES)
    return (f"CASE WHEN {img} THEN 'img' WHEN starts_with({addr}, '/') OR "
            f"contains({addr}, '{INTERNAL_HOST_MARK}') THEN 'internal' ELSE 'std' END")


# The oracle's own anchor patterns (DuckDB regular expressions), written apart from the operator's.
ANCHOR_RE = r"(?is)<a(?:\s[^>]*)?>.*?</a>"
ANCHOR_TEXT_RE = r"(?is)^<a[^>]*>(.*)</a>$"
TAG_RE = r"<[^>]*>"
NO_HREF = "#none#"


def no_comments_sql(html: str) -> str:
    return f"regexp_replace(coalesce({html}, ''), '(?s)<!--.*?-->', '', 'g')"


def href_sql(a: str, decode) -> str:
    """The href of an anchor by its quoting: double, single or none."""
    head = r"(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*"
    forms = [head + '"([^"]*)"', head + "''([^'']*)''", head + """([^"''\\s>][^\\s>]*)"""]
    return "CASE " + " ".join(f"WHEN regexp_matches({a}, '{f}') THEN {decode(f'regexp_extract({a}, \'{f}\', 1)')}"
                              for f in forms) + f" ELSE '{NO_HREF}' END"
