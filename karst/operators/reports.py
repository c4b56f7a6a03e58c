"""Nested reports as rows of (key, value), and their comparison within tolerances."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flatten(tree: object, at: str = "") -> Iterator[tuple[str, object]]:
    """Leaves of a nested report with their dotted places; lists by [i]."""
    if isinstance(tree, dict):
        for k, v in tree.items():
            yield from flatten(v, f"{at}.{k}" if at else str(k))
    elif isinstance(tree, (list, tuple)):
        for i, v in enumerate(tree):
            yield from flatten(v, f"{at}[{i}]")
    else:
        yield at, tree


def leaves(spark: SparkSession, tree: object) -> DataFrame:
    rows = [(k, float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None, None if v is None else str(v)) for k, v in flatten(tree)]
    return spark.createDataFrame(rows, "key string, value double, text string")


def compare(old: DataFrame, new: DataFrame, absolute: float, relative: float) -> DataFrame:
    """key, old, new, verdict: full outer join of (key, value) rows; the first rule that holds."""
    both = old.select("key", F.col("value").alias("old"), F.lit(True).alias("in_old")).join(new.select("key", F.col("value").alias("new"), F.lit(True).alias("in_new")), "key", "full")
    gap = F.abs(F.col("new") - F.col("old"))
    verdict = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "removed")
        .when(F.col("old").eqNullSafe(F.col("new")), "identical")
        .when(gap <= absolute, "within absolute")
        .when(gap <= F.lit(relative) * F.abs(F.col("old")), "within relative")
        .otherwise("changed")
    )
    return both.select("key", "old", "new", verdict.alias("verdict"))


def collected(spark: SparkSession, parts: dict[str, DataFrame]) -> DataFrame:
    """key, value, text of several one-row tables as one report: the part's name, then the column."""
    tree = {}
    for name, row in parts.items():
        found = row.limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{name} is not one row")
        tree[name] = found[0].asDict(recursive=True)
    return leaves(spark, tree)
