"""Differences between two snapshots of keyed content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_diff(base: DataFrame, head: DataFrame, key: str = "path", blob: str = "blob_id") -> DataFrame:
    """(key, base_blob, head_blob, status): one row for each key of either side.

    One full outer join on the key; both sides shuffle once, by it.
    """
    b, h = base.select(F.col(key), F.col(blob).alias("base_blob")), head.select(F.col(key), F.col(blob).alias("head_blob"))
    status = F.when(F.col("base_blob").isNull(), "added").when(F.col("head_blob").isNull(), "deleted").when(F.col("base_blob") != F.col("head_blob"), "modified").otherwise("unchanged")
    return b.join(h, key, "full_outer").withColumn("status", status)


def exact_renames(diff: DataFrame, key: str = "path") -> DataFrame:
    """(base_key, head_key, blob): deleted and added keys of the same content, the k-th with the k-th."""
    place = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(key))
    gone = diff.where("status = 'deleted'").select(F.col(key).alias("base_key"), F.col("base_blob").alias("blob"), place("base_blob").alias("k"))
    new = diff.where("status = 'added'").select(F.col(key).alias("head_key"), F.col("head_blob").alias("blob"), place("head_blob").alias("k"))
    return gone.join(new, ["blob", "k"]).select("base_key", "head_key", "blob")


def removed(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base whose key no row of head has."""
    return base.join(head.select(*keys).distinct(), keys, "left_anti")


def added(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    return removed(head, base, keys)
