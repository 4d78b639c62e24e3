"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a maximal run outside these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_of(text: Column, others: str) -> Column:
    """Code points left when everything matching ``others`` is dropped."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't use yet (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it while the frame has it already."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def fold_add(a: Column, b: Column) -> Column:
    return a + b
