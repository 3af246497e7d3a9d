"""What the training-data operators share: scratch tables and column helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere here: runs of anything but these six characters.
BLANK = " \t\n\x0b\x0c\r"

_MADE: list[tuple[SparkSession, str]] = []


#: In a worker process: the operator whose cache is filled, and how to empty it.
_FILLED: dict = {}


def sole_cache(name: str, empty) -> None:
    """Empty the caches of other operators in this worker process, so that one at most is filled.

    Workers outlive stages; what several operators keep would add up.
    """
    for other in [k for k in _FILLED if k != name]:
        _FILLED.pop(other)()
    _FILLED[name] = empty


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of this machine only where Spark runs on it alone."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return at or "file://" + os.path.join(tempfile.gettempdir(), f"palisade-scratch-{os.getuid()}")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimiser real sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/palisade/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _MADE.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)
        _MADE[:] = [x for x in _MADE if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # the session is going down; the folder is scratch
                return


#: A table of fewer bytes than this for each core is dealt out anew; one of fewer than the other is left alone.
DEAL_OUT, TINY = 4 << 20, 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read; a small one, which would come in one or two pieces, spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if TINY <= size < DEAL_OUT * cores else df


def text_of(column: str | Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for an empty one."""
    return F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")


#: Up to so many keys (of some 60 bytes) are broadcast; more are joined by a shuffle.
SENT_KEYS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_key(id_col: str, text_col: str, *more: str) -> Column:
    """A text that tells documents apart: id, and two hashes of the text and further columns; nulls differ from empty texts."""
    parts = [F.col(c) for c in (text_col, *more)]
    null = F.concat(*[F.when(p.isNull(), "n").otherwise("v") for p in (F.col(id_col), *parts)])
    return F.concat_ws(":", F.col(id_col).cast("string"), null, F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts))


def without(docs: DataFrame, key: Column, bad: DataFrame) -> DataFrame:
    """docs without the rows whose key is the one column of ``bad``."""
    name = fresh(docs, "bad")
    bad = bad.select(F.col(bad.columns[0]).alias(name)).distinct()
    few = bad.limit(SENT_KEYS + 1).count() <= SENT_KEYS
    return docs.join(F.broadcast(bad) if few else bad, key == F.col(name), "left_anti")
