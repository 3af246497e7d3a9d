"""A stream of changed trees, gated batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from palisade.plans import gate
from palisade.sources.git_tree import FILES


def gate_stream(spark: SparkSession, source: str, checkpoint: str, rules: DataFrame, records: DataFrame, as_of: str, sink: Callable[[dict[str, DataFrame], int], None]) -> StreamingQuery:
    """Gate each file of tree rows that lands in a folder; the sink gets the tables and the batch's number.

    A run's rows must arrive in one file: a gate looks at whole changes. The sink
    should write under the batch's number, so that a batch that runs again replaces
    its own result.
    """

    def each(batch: DataFrame, number: int) -> None:
        runs = batch.select("run_id").distinct()
        mine = lambda t: t.join(runs, "run_id", "left_semi")
        sink(gate.gate(batch, mine(rules), mine(records), as_of), number)

    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 100).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
