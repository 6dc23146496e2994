"""Words shared by the text operators: runs without the six ASCII white-space characters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_bytes(text: str | None) -> list[bytes]:
    """The same words in Python as UTF-8, with A-Z lower-cased. ``bytes.split`` knows the same six characters."""
    return text.encode().lower().split() if text else []
