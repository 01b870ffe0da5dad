"""DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def barrier(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns through a generator, so later filters on them do not evaluate them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, body) -> Column:
    """Bind a sub-expression once inside a larger one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_rule(rules: list[tuple[str, str]], test) -> Column:
    """Result of the first (needle, result) rule whose needle passes ``test``; null if none does.

    The rules form one constant array, so long rule lists stay small in the generated code."""
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r).alias("r")) for n, r in rules])
    return F.get(F.filter(table, lambda x: test(x["n"])), F.lit(0))["r"]


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint for a table that is counted to have at most ``rows`` rows; a larger one is left to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
