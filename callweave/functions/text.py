"""Text columns: white space, folding, comparison forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def flattened(text: Column) -> Column:
    """Lower case, with each run of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def folded(text: Column) -> Column:
    """Lower case without the accents of western European letters."""
    return F.lower(F.translate(text, "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"))


def word_count(text: Column) -> Column:
    """Words parted by white space of any kind; 0 for an empty text."""
    return F.size(F.array_remove(F.split(text, "\\s+"), ""))
