"""Tables that several plans read."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, with a plan of one scan.

    The folder is the one that the cluster names in spark.checkpoint.dir; a local one
    is set only where none is.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), f"palisade-tables-{os.getuid()}"))
    return df.checkpoint()
