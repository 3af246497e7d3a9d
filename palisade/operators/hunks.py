"""Hunks of changed lines and the entities that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changed_lines(hunks: DataFrame, keys: list[str], start: str = "new_start", count: str = "new_count") -> DataFrame:
    """One row for each changed line; a hunk that only deletes marks its one line."""
    return hunks.select(*keys, F.explode(F.sequence(F.col(start), F.col(start) + F.greatest(F.col(count), F.lit(1)) - 1)).alias("line")).distinct()


#: Bytes of a table's files for each piece that it is dealt out in; a task of ``overlaps`` then holds some 400 MB (q08, measured).
PIECE = 4 << 20


def pieces(table: DataFrame) -> int | None:
    """In how many pieces a table that is read from files is dealt out; None if Spark's own number does.

    Adaptive execution joins pieces up to a size in compressed bytes, of which a task
    holds twenty times as much; this number is kept.
    """
    n = -(-int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // PIECE)
    return n if n > table.sparkSession.sparkContext.defaultParallelism else None


def overlaps(hunks: DataFrame, entities: DataFrame, keys: list[str], start: str = "start", count: str = "count", parts: int | None = None) -> DataFrame:
    """Hunks with the entities that they overlap: an equi-join by file with the range as residual.

    A hunk of no lines overlaps nothing. Entities have start_line and end_line. Files
    are dealt out in ``parts`` pieces, or as Spark sees fit.
    """
    h = hunks.where(F.col(count) > 0)
    e = entities.withColumnsRenamed({k: f"_{k}" for k in keys})
    if parts:
        h, e = h.repartition(parts, *keys), e.repartition(parts, *[f"_{k}" for k in keys])
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(start) <= F.col("end_line"), F.col("start_line") <= F.col(start) + F.col(count) - 1]
    return h.join(e, on).drop(*[f"_{k}" for k in keys])


def innermost(overlap: DataFrame, hunk_keys: list[str], name: str = "qname", order: str = "entity_no") -> DataFrame:
    """(hunk keys, innermost, conflict): the least entity a hunk touches, and whether they don't nest.

    Entities are ranged by span, the longest first, ties in file order; each must
    hold the next.
    """
    span = F.col("end_line") - F.col("start_line")
    w = Window.partitionBy(*hunk_keys).orderBy(span.desc(), F.col(order))
    apart = (F.lag("start_line").over(w) > F.col("start_line")) | (F.lag("end_line").over(w) < F.col("end_line"))
    # A hunk's last row tells it all, so that no map of hunks is held.
    ranked = overlap.select(*hunk_keys, F.col(name).alias("innermost"), span.alias("_span"), F.col(order).alias("_order"), F.coalesce(apart, F.lit(False)).alias("apart"), F.row_number().over(w).alias("place"), F.lead(F.lit(True)).over(w).isNull().alias("last"))
    same = Window.partitionBy(*hunk_keys).orderBy(F.col("_span").desc(), F.col("_order")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("conflict", F.bool_or("apart").over(same)).where("last").select(*hunk_keys, "innermost", "conflict", F.col("place").cast("long").alias("touched"))


def touches(spans: Column, start: Column, count: Column) -> Column:
    """Whether a range of lines meets one of the spans; no lines meet none, nor do no spans."""
    met = F.exists(spans, lambda s: (s["start_line"] <= start + count - 1) & (s["end_line"] >= start))
    return (count > 0) & F.coalesce(met, F.lit(False))


def classify(base: Column, head: Column, new_count: Column, base_has_head: Column, head_has_base: Column, safe: Column) -> Column:
    """What a hunk does, from the innermost entities on both sides."""
    return (
        F.when(base.isNotNull() & head.isNotNull() & (base == head), "modified")
        .when(base.isNull() & head.isNotNull(), F.when(base_has_head, "modified").otherwise("added"))
        .when(base.isNotNull() & head.isNull(), F.when((new_count == 0) & head_has_base, "modified").otherwise("removed"))
        .when(base.isNull() & head.isNull() & safe, "other_text")
        .otherwise("mapping_unresolved")
    )


def last_change(changes: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key by an explicit order."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return changes.groupBy(*keys).agg(best).select(*keys, "last.*")
