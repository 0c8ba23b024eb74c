"""Names of columns where a caller's and an operator's own meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or with underscores before it if it is taken (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def without(keep: list[str], results: tuple[str, ...]) -> list[str]:
    """``keep`` without the names of results: a result takes the place of a kept column of its name."""
    low = {r.lower() for r in results}
    return [k for k in keep if k.lower() not in low]


def declared(df: DataFrame, keep: list[str]) -> str:
    """The kept columns' part of a schema string, with a comma after each."""
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)
