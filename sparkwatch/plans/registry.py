"""Query registry: one entry per operator, each a Spark callable ``(spark, sf_dir) ->
DataFrame`` plus (where the operator is SQL-expressible) an independent DuckDB twin.

Outputs are presentation-normalised for comparison: every DOUBLE column is rounded to
6 decimals (done in the query wrapper, never inside the library operators).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import bound_methods, ensure_checkpoint_dir, ship_package
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            bound_methods(spark)
            return round_doubles(fn(spark, sf_dir))
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, wrapped, oracle, (fn.__doc__ or "").strip())
        return wrapped
    return deco


def entries_text(column: str, form: str) -> Column:
    """A map column as sorted 'key=value' texts: maps have no order of their own to compare by."""
    text = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.format_string(form, e["value"]), F.lit("null")))
    return F.transform(F.array_sort(F.map_entries(column)), text).alias(column)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        elif t in ("map<string,double>",):
            cols.append(F.transform_values(f.name, lambda k, v: F.round(v, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
