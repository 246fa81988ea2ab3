"""Keyword matching as one case-insensitive pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_pattern(words: Sequence[str], literal: bool = False, whole_word: bool = False) -> str:
    """Alternation over ``words``.

    By default each word is itself a pattern and may match inside a longer word (``EGG``
    is found in ``VEGGIE``). ``literal`` quotes the words, ``whole_word`` anchors them.
    """
    if not words:
        raise ValueError("at least one keyword is needed")
    parts = [r"\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E" if literal else w for w in words]
    body = "|".join(parts)
    # Case folding and word borders by Unicode: accented letters are letters.
    return rf"(?iuU)\b(?:{body})\b" if whole_word else f"(?iu){body}"


def matches_any(
    c: str | Column, words: Sequence[str], literal: bool = False, whole_word: bool = False
) -> Column:
    """True where the text holds any of the words; missing text is False, never NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(keyword_pattern(words, literal, whole_word)), F.lit(False))
