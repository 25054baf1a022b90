"""Frames as a stream: new files of a stored scalar table are new frames.

A frame is complete when its partition is committed, so statistics of a frame are
an aggregation over its own files; appended frames update nothing older.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.operators.fields import frame_statistics
from spindrift.sources.model import SCHEMAS


def scalar_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of (step, var, cell_id, value) files as they appear under ``path``."""
    return spark.readStream.schema(SCHEMAS["cell_scalar"]).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_statistics(stream: DataFrame) -> DataFrame:
    """Frame statistics over all files so far, for the update and complete modes; state is a row a frame and variable."""
    return frame_statistics(stream)


def watched_values(stream: DataFrame, var: str, lower: float, upper: float) -> DataFrame:
    """Rows outside a band, as they arrive; stateless."""
    return stream.where((F.col("var") == var) & ~F.col("value").between(lower, upper))


def each_frame(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``handle`` with each batch's rows; a restarted query goes on where it was."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
