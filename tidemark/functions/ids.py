"""Identifier and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing id.
NULL_IDS = ("", "none", "nan", "null")


def canonical_id(c: Column) -> Column:
    """Trimmed text; spellings of a missing id become null."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*NULL_IDS), t)


def integer_id(c: Column) -> Column:
    """As ``canonical_id``, with ``12.0`` written ``12``. Text only, so large ids keep all digits."""
    return F.regexp_replace(canonical_id(c), r"^(-?\d+)\.0+$", "$1")


def id_aliases(c: Column) -> Column:
    """Both spellings of an id, ``u123`` and ``123``, as an array; other ids alone."""
    t = canonical_id(c)
    bare = F.regexp_replace(t, r"^u(\d+)$", "$1")
    return F.when(bare.rlike(r"^\d+$"), F.array(bare, F.concat(F.lit("u"), bare))).otherwise(F.array(t))


def clean_text(c: Column, lower: bool = True) -> Column:
    """Without URLs and mentions, white space folded."""
    t = F.regexp_replace(F.regexp_replace(c, r"https?://[^ \t\r\n]+|www\.[^ \t\r\n]+", ""), r"@[A-Za-z0-9_]+", "")
    t = F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
    return F.lower(t) if lower else t


def text_pool(c: Column, longer_than: int) -> Column:
    """Texts of a `` | `` separated pool that are strictly longer than a bound."""
    return F.filter(F.transform(F.split(c, r" \| "), lambda t: F.trim(t)), lambda t: F.length(t) > longer_than)


def post_type(original: Column, quoted: Column) -> Column:
    return F.when(original.isNull(), "common").when(quoted, "quote").otherwise("repost")


def content_node(action: Column, content: Column, row_id: Column) -> Column:
    """Likes of equal content share a node, named by a digest; other actions are nodes of their own."""
    return F.when(action == "like", F.substring(F.sha2(content, 256), 1, 24)).otherwise(row_id.cast("string"))


def circular_hours(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 24 - d)


def short_text(text: Column, most: int) -> Column:
    """On one line, and at most ``most`` characters; null stays null."""
    return F.substring(F.translate(text, "\n\r", "  "), 1, most)


def nli_score(entailment: Column, contradiction: Column) -> Column:
    """(entailment - contradiction + 1) / 2: from 0, contradicted, over one half, neutral, to 1, entailed."""
    return (entailment - contradiction + 1) / 2
