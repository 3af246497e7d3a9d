"""Calls, imports and references between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def calls_to_entities(calls: DataFrame, entities: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Calls with the entities of the called name. ``names`` of a call are its own and its aliases' originals."""
    each = calls.withColumn(name, F.explode("names")).drop("names")
    return each.join(entities, [*keys, name])


def call_problem(positional: Column, required: Column, maximum: Column, unknown_keyword: Column, missing_keyword: Column, star: Column, kwargs: Column) -> Column:
    """The first thing wrong with a call; null if it fits or can't be told."""
    return (
        F.when(star, None)
        .when(positional < required, "too_few_positional")
        .when(positional > maximum, "too_many_positional")
        .when(kwargs, None)
        .when(unknown_keyword, "unknown_keyword")
        .when(missing_keyword, "missing_keyword")
    )


def importers(imports: DataFrame, keys: list[str]) -> DataFrame:
    """The reverse index: (module, name) -> files, counted and listed in order."""
    each = imports.select(*keys, "path", F.explode("modules").alias("module"), "names").withColumn("name", F.explode("names"))
    return each.groupBy(*keys, "module", "name").agg(F.countDistinct("path").alias("files"), F.min("path").alias("first_file"))


def dangling(references: DataFrame, base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """References to what base had and head has no more."""
    return references.join(base.select(*keys).distinct(), keys, "left_semi").join(head.select(*keys).distinct(), keys, "left_anti")


def first_reference(references: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's first reference by (path, line, kind), and how many there are."""
    return references.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n")).select(*keys, "first.*", "n")


def pair_in_order(base: DataFrame, head: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The k-th of a key on one side with the k-th on the other."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("k")
    b = base.select(*keys, F.col(order).alias("base_at"), k)
    h = head.select(*keys, F.col(order).alias("head_at"), k)
    return b.join(h, [*keys, "k"])


def permuted(base: DataFrame, head: DataFrame, keys: list[str], args: str = "args") -> DataFrame:
    """Pairs of calls with the same arguments in another order: an equi-join by the sorted list."""
    b = base.select(*keys, F.col(args).alias("base_args"), F.array_sort(args).alias("_sorted"))
    h = head.select(*keys, F.col(args).alias("head_args"), F.array_sort(args).alias("_sorted"))
    return b.join(h, [*keys, "_sorted"]).where(F.col("base_args") != F.col("head_args")).drop("_sorted")


def as_of(events: DataFrame, versions: DataFrame, key: str, at: str, start: str, end: str, value: str) -> DataFrame:
    """Each event with the version of its key that was valid at its time: the latest start wins.

    An equi-join by key with the period as residual. Events without a version stay.
    """
    v = versions.select(F.col(key).alias("_k"), F.col(start).alias("_from"), F.col(end).alias("_until"), F.col(value).alias("_value"))
    on = (F.col(key) == F.col("_k")) & (F.col("_from") <= F.col(at)) & (F.col("_until").isNull() | (F.col("_until") > F.col(at)))
    return events.join(v, on, "left").drop("_k")
