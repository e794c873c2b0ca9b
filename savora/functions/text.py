"""Text column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of every script.
LETTERS = r"\p{L}"


def pieces(col: str | Column, letters: str = LETTERS) -> Column:
    """Lower-cased text cut at everything that is no letter; may hold empty strings."""
    c = F.col(col) if isinstance(col, str) else col
    return F.split(F.lower(F.coalesce(c, F.lit(""))), f"[^{letters}]+")


def tokens(col: str | Column, stop: Sequence[str] = (), min_length: int = 1, letters: str = LETTERS) -> Column:
    """Lower-cased runs of letters; null text gives an empty array."""
    kept = F.filter(pieces(col, letters), lambda x: F.length(x) >= min_length)
    if stop:
        words = list(stop)
        kept = F.filter(kept, lambda x: ~x.isin(words))
    return kept


def normalise(col: str | Column) -> Column:
    """Line breaks to blanks, characters that are neither word nor blank dropped, blanks squeezed."""
    c = F.col(col) if isinstance(col, str) else col
    flat = F.regexp_replace(c, r"[\r\n]+", " ")
    words = F.regexp_replace(flat, r"[^\p{L}\p{N}_ ]", "")
    return F.trim(F.regexp_replace(words, " +", " "))


def sentences(col: str | Column) -> Column:
    """Trimmed pieces between sentence ends or line breaks."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(F.split(c, r"[.!?\n]+"), lambda s: F.trim(s))
