"""Elements of HTML text as Column expressions.

An element is found by its opening tag and a class token, and ends where its tag's nesting closes, so
unclosed paragraphs and list items don't matter. Elements of one class are taken not to lie in each
other; comments must be gone (``uncommented``). Null text gives no elements.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of tags and comments.
ANY_TAG = r"<[^>]*>"
COMMENT = r"(?s)<!--.*?-->"


def unescape(c: Column) -> Column:
    """Common entities, as an HTML parser decodes them (other names and numbers stay)."""
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                    ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def uncommented(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), COMMENT, "")


def _opening(tag: str, cls: str | tuple | None, own_id: str | None) -> str:
    """The pattern of a tag's beginning, with a token of ``cls`` (or one of them) or with an id."""
    if own_id is not None:
        name, value = "id", re.escape(own_id)
    elif cls is not None:
        words = "|".join(re.escape(c) for c in ((cls,) if isinstance(cls, str) else cls))
        name, value = "class", rf"(?:[^>]*?\s)??(?:{words})(?:\s[^>]*?)??"
    else:
        return rf"<{tag}(?=[\s>])"
    return rf"""<{tag}\s(?=(?:[^>]*?\s)?{name}\s*=\s*(?:"{value.replace('[^>]', '[^">]')}"|'{value.replace('[^>]', "[^'>]")}'))"""


def _closed(chunk: Column, tag: str) -> Column:
    """The text up to where the first tag's nesting closes, or all of it if it never does."""
    parts = F.split(chunk, rf"(?i)</{tag}\s*>")

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.regexp_count(part, F.lit(rf"(?i)<{tag}(?=[\s>])")) - 1
        i = acc["i"] + 1
        return F.struct(i.alias("i"), depth.alias("depth"),
                        F.when((acc["stop"] == 0) & (depth <= 0), i).otherwise(acc["stop"]).alias("stop"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("stop"))
    stop = F.aggregate(parts, zero, step, lambda acc: F.when((acc["stop"] == 0) | (acc["stop"] == acc["i"]), -1).otherwise(acc["stop"]))
    return F.when(stop < 0, chunk).otherwise(F.array_join(F.slice(parts, 1, F.greatest(stop, F.lit(0))), f"</{tag}>"))


def elements(html: Column, tag: str, cls: str | tuple | None = None, own_id: str | None = None) -> Column:
    """``array<string>``: the elements of a tag (and class token, or id) in order, without their last closing tag."""
    start = _opening(tag, cls, own_id)
    chunks = F.filter(F.split(html, f"(?is)(?={start})"), lambda c: F.regexp_like(c, F.lit(f"(?is)^{start}")))
    return F.transform(chunks, lambda c: _closed(c, tag))


def first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def attribute(element: Column, name: str) -> Column:
    """An attribute of the element's own tag in double, single or no quotes; null without it."""
    pattern = rf"""(?is)^<[^\s>]+\s(?:[^>]*?\s)?{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>][^\s>]*))"""
    value = F.concat(*[F.regexp_extract(element, pattern, i) for i in (1, 2, 3)])
    return F.when(F.regexp_like(element, F.lit(pattern)), unescape(value))


def text(element: Column) -> Column:
    return unescape(F.regexp_replace(element, ANY_TAG, ""))


def pieces(element: Column) -> Column:
    """The element's pieces of text without the blanks around them, blank ones left out."""
    cut = F.transform(F.split(element, ANY_TAG), lambda t: F.regexp_replace(unescape(t), r"^\s+|\s+$", ""))
    return F.filter(cut, lambda t: t != "")


def only_text(element: Column) -> Column:
    """The text of an element that holds one piece of text and nothing beside it, else ''."""
    return unescape(F.regexp_extract(element, r"(?s)^(?:<[^>]*>)+([^<]*)(?:</[^>]*>)*$", 1))


def classes(element: Column) -> Column:
    return F.filter(F.split(attribute(element, "class"), r"\s+"), lambda c: c != "")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def time(c: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' with Z or an offset -> timestamp; anything else -> null."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss[XXX][XX][X]"))


def numbered(html: Column, tag: str, label: str) -> Column:
    """``html`` with the elements of ``tag`` emptied and given the ids label_0, label_1, ... ."""
    parts = F.split(html, rf"(?i)</{tag}\s*>")
    return F.array_join(F.transform(parts, lambda part, i: F.regexp_replace(
        part, F.lit(rf"(?is)<{tag}(\s[^>]*)?>.*$"), F.concat(F.lit(f'<{tag}$1 id="{label}_'), i.cast("string"), F.lit('">')))),
        f"</{tag}>")
