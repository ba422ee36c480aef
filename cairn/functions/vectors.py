"""Vector functions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.binding import let

# The concepts of the flag embedding, one group a dimension.
CONCEPTS = (
    ("nvidia",),
    ("schneider electric",),
    ("fy2026",),
    ("fy2025",),
    ("revenue",),
    ("growth", "grew", "expansion", "organic"),
    ("margin",),
    ("data center", "data centre"),
    ("gaming",),
    ("energy management", "energy"),
    ("adjusted ebita",),
    ("organic growth", "organically"),
)


def normalize(v: Column) -> Column:
    """Length one; scaled by the largest component first, so that squares don't overflow. A zero vector stays zero."""

    def scaled(v: Column, top: Column) -> Column:
        return let(F.transform(v, lambda x: x / top), lambda s: let(F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(s, lambda x: x / n)))

    return let(v, lambda w: let(F.array_max(F.transform(w, F.abs)), lambda top: F.when(top == 0, w).otherwise(scaled(w, top))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of vectors of length one, kept within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def concept_flags(text: Column, concepts: tuple[tuple[str, ...], ...] = CONCEPTS) -> Column:
    """One flag for each concept that the text names, hyphens read as spaces; to be normalised."""
    plain = F.replace(F.lower(text), F.lit("-"), F.lit(" "))

    def flag(words: tuple[str, ...]) -> Column:
        hit = F.contains(plain, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(plain, F.lit(w))
        return hit.cast("double")

    return F.array(*(flag(words) for words in concepts))
