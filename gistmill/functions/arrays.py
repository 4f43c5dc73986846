"""In-row array helpers; nothing here shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once so that lambdas below it do not evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that filters and later columns read without computing it again.

    The generator keeps Spark from copying the expression into every place that uses it.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def histogram(items: Column) -> Column:
    """array<T> -> array<struct<term: T, tf: bigint>>, sorted by term, without a shuffle."""

    def runs(s: Column) -> Column:
        marked = F.transform(
            s,
            lambda x, i: F.struct(
                x.alias("term"), i.alias("at"), ((i == 0) | (x != F.get(s, i - 1))).alias("head")
            ),
        )
        return let(
            F.filter(marked, lambda e: e["head"]),
            lambda heads: F.transform(
                heads,
                lambda e, j: F.struct(
                    e["term"].alias("term"),
                    (F.coalesce(F.get(heads, j + 1)["at"], F.size(s)) - e["at"]).cast("long").alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(items), runs)


def python_list(items: Column) -> Column:
    """Text of a list of strings as Python prints it."""

    def quoted(x: Column) -> Column:
        escaped = F.replace(
            F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")
        )
        double = x.contains("'") & ~x.contains('"')
        return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))
