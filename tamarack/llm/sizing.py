"""Sizes that plans depend on, measured from the data, never from the machine that plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_count(docs: DataFrame, text_col: str, bytes_per_group: int) -> int:
    """Number of hash groups so that an average group holds at most bytes_per_group of text.

    One narrow aggregate (a single row comes back). The count grows with the input, so the memory a group
    needs does not.
    """
    size = F.sum(F.octet_length(F.col(text_col)).cast("long") + F.lit(64))
    total = docs.select(size.alias("b")).first()["b"] or 0
    return max(1, -(-int(total) // bytes_per_group))


def replace_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator is about to produce (its own columns win)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it: for columns that an operator needs on
    the way and drops again."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_digest(df: DataFrame) -> Column:
    """128 bits of all columns of a row; nulls, empty texts and where one value ends count."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return F.unhex(F.md5(whole.cast("binary")))
