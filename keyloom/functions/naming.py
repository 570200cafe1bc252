"""Identifiers as words, and simple English plurals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of capitals before a capitalised word, words, capitals, digits.
WORDS = "([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+)"


def words(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(WORDS), 1)


def _ends(word: Column, *endings: str) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | word.endswith(e)
    return out


def _less(word: Column, n: int) -> Column:
    return word.substr(F.lit(1), F.greatest(F.length(word) - n, F.lit(0)))


def plural(word: Column) -> Column:
    """ies after a consonant and y, es after s, x, z, ch and sh, else s."""
    consonant_y = word.endswith("y") & (F.length(word) > 1) & ~F.substring(word, -2, 1).isin(*"aeiou")
    return F.when(word == "", word).when(consonant_y, F.concat(_less(word, 1), F.lit("ies"))).when(_ends(word, "s", "x", "z", "ch", "sh"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def singular(word: Column) -> Column:
    """y for ies, without es after a sibilant, without a single s."""
    ies = word.endswith("ies") & (F.length(word) > 3)
    return (
        F.when(ies, F.concat(_less(word, 3), F.lit("y")))
        .when(_ends(word, "ses", "ches", "shes", "xes", "zes"), _less(word, 2))
        .when(word.endswith("s") & ~word.endswith("ss"), _less(word, 1))
        .otherwise(word)
    )


def recase(name: Column, style: str) -> Column:
    """preserve, snake, camel or pascal; a name without words stays as it is."""
    if style not in ("preserve", "snake", "camel", "pascal"):
        raise ValueError(f"unknown style {style}")
    if style == "preserve":
        return name
    low = F.transform(words(name), F.lower)
    if style == "snake":
        out = F.array_join(low, "_")
    else:
        out = F.array_join(F.transform(low, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")
        if style == "camel":
            first = F.length(F.get(low, F.lit(0)))
            out = F.concat(F.get(low, F.lit(0)), out.substr(first + 1, F.length(out)))
    return F.when(F.size(low) == 0, name).otherwise(out)
