"""Column expressions shared by the operators that stay inside Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def without_white(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\t..\\r."""
    return F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " ", -1), lambda w: w != "")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: without_white(x) != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` made different from all columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
