"""Statistics of measured samples."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.operators.tables import settle

# Two-sided 95 % points of Student's t by degrees of freedom.
T_95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262}


def nearest_rank(column: str, q: float) -> Column:
    """The value of the nearest rank: exact, no interpolation."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def t_95(n: Column) -> Column:
    out = F.when(n < 30, 2.042).otherwise(1.96)
    for df, t in T_95.items():
        out = F.when(n == df + 1, t).otherwise(out)
    return out


def mean_ci95(df: DataFrame, keys: list[str], column: str, digits: int = 6) -> DataFrame:
    """(keys, n, mean, low, high): the mean with its 95 % interval, not below zero."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    half = F.coalesce(t_95(F.col("n")) * F.col("s") / F.sqrt("n"), F.lit(0.0))
    return g.select(*keys, "n", F.round("m", digits).alias("mean"), F.round(F.greatest(F.col("m") - half, F.lit(0.0)), digits).alias("low"), F.round(F.col("m") + half, digits).alias("high"))


def summary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Least, median, p95, p99, most, mean and deviation; valid is false with NaN or negative samples."""
    c = F.col(column)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(c).alias("least"), nearest_rank(column, 0.5).alias("median"), nearest_rank(column, 0.95).alias("p95"), nearest_rank(column, 0.99).alias("p99"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("deviation"), (~F.bool_or(F.isnan(c) | (c < 0))).alias("valid")
    )


def sufficiency(n: Column, required: Column, value: Column, limit: Column) -> Column:
    return F.when(n < required, "INSUFFICIENT_DATA").when(value <= limit, "MET").otherwise("NOT_MET")


def confusion(df: DataFrame, keys: list[str], truth: str, said: str) -> DataFrame:
    """Counts of right and wrong calls with precision and recall; of nothing, both are 1."""
    t, s = F.col(truth), F.col(said)
    g = df.groupBy(*keys).agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.round(F.col(a) / (F.col(a) + F.col(b)), 4))
    return g.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


#: So many draws are made at once; of more samples than the other, only draws near the percentile are kept.
DRAWS, FEW = 1 << 18, 2048


def bootstrap_ranks(n: int, q: float, resamples: int = 1000, seed: int = 42) -> tuple[int, int]:
    """Ranks, from 0, of the interval's two ends among n sorted samples.

    The draws are those of ``random.Random(seed).choices``, one resample after the
    other. A resample's percentile is the sample at the rank that its draw of that
    place names, so the ranks follow from n alone, and no resample is sorted.
    """
    word = random.Random(seed).getstate()[1]
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(word[:-1], dtype=np.uint32), "pos": word[-1]}}
    rng, buffer = np.random.Generator(bits), np.empty(min(n, DRAWS))
    place = max(0, -(-q * n // 1).__int__() - 1)
    # Eight deviations around the percentile; a resample that falls outside is drawn again and kept whole.
    width = 8 * (q * (1 - q) / n) ** 0.5 + 2 / n
    near = (q - width, q + width) if n > FEW else (0.0, 1.0)

    def drawn(low: float, high: float) -> float | None:
        below, kept = 0, []
        for start in range(0, n, DRAWS):
            u = rng.random(out=buffer[: min(DRAWS, n - start)])
            if low > 0:
                below += np.count_nonzero(u < low)
            kept.append(u[(u >= low) & (u < high)])
        kept = np.concatenate(kept)
        at = place - below
        return np.partition(kept, at)[at] if 0 <= at < len(kept) else None

    found = []
    for _ in range(resamples):
        before = bits.state
        u = drawn(*near)
        if u is None:
            bits.state = before
            u = drawn(0.0, 1.0)
        found.append(int(u * float(n)))
    found.sort()
    return found[int(0.025 * resamples)], found[int(0.975 * resamples) - 1]


def bootstrap_ci(q: float, resamples: int = 1000, seed: int = 42):
    """A grouped aggregate: 'low,high' of a percentile over seeded resamples, all of a group in one worker.

    For groups of any size there is ``bootstrap``. Nulls count as NaN, the greatest.
    """

    @F.pandas_udf("string")
    def run(values: pd.Series) -> str:
        own = np.sort(values.to_numpy(dtype=float, na_value=float("nan")))
        low, high = bootstrap_ranks(len(own), q, resamples, seed)
        return f"{own[low]:.6g},{own[high]:.6g}"

    return run


def bootstrap(df: DataFrame, keys: list[str], column: str, q: float, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, interval): ``bootstrap_ci`` of each group, none of which is held by one task.

    Equal values are counted first; the counts are dealt out by ranges of (keys,
    value), and each end is looked for in the one range that holds its rank.
    """

    @F.pandas_udf("array<long>")
    def ranks(n: pd.Series) -> pd.Series:
        return pd.Series([list(bootstrap_ranks(int(x), q, resamples, seed)) for x in n])

    @F.pandas_udf("string")
    def shown(low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([f"{a:.6g},{b:.6g}" for a, b in zip(low.astype(float), high.astype(float), strict=True)], dtype=object)

    value = F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))
    counts = df.groupBy(F.struct(*keys).alias("k"), value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = settle(counts.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()))
    by_part = Window.partitionBy("k").orderBy("part")
    parts = counts.groupBy("k", "part").agg(F.sum("c").alias("t")).withColumn("end", F.sum("t").over(by_part)).withColumn("start", F.col("end") - F.col("t"))
    sizes = parts.groupBy("k").agg(F.sum("t").alias("n"))
    # Groups of one size have the same ranks; each size is a task of its own as far as cores go.
    cores = df.sparkSession.sparkContext.defaultParallelism
    ends = sizes.select("n").distinct().repartition(cores).select("n", ranks.asNondeterministic()("n").alias("r"))
    wanted = sizes.join(ends, "n").select("k", F.posexplode("r").alias("which", "rank"))
    held = wanted.join(parts, "k").where("start <= rank AND rank < end").select("k", "part", "which", F.col("rank") - F.col("start") + 1)
    held = held.toDF("k", "part", "which", "left")
    upto = Window.partitionBy("k", "part", "which").orderBy("v")
    passed = counts.join(held, ["k", "part"]).withColumn("sum", F.sum("c").over(upto)).where("sum >= left")
    end = lambda i: F.min(F.when(F.col("which") == i, F.col("v")))
    both = passed.groupBy("k").agg(end(0).alias("low"), end(1).alias("high"))
    return both.select("k.*", shown("low", "high").alias("interval"))
