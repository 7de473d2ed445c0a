"""A folder of findings watched with Structured Streaming: an extension, the engine itself is a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar import schema
from lodestar.operators.results import severity_counts


def watch_findings(spark: SparkSession, folder: str, checkpoint: str, seen: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Call ``seen(findings, batch)`` for each batch of new JSON lines of findings in ``folder``; ``once`` ends when all are read."""
    stream = spark.readStream.schema(schema.struct(schema.FINDING)).json(folder).where(F.col("code").isNotNull())
    write = stream.writeStream.foreachBatch(seen).option("checkpointLocation", checkpoint)
    return (write.trigger(availableNow=True) if once else write).start()


def counts_of(batches: dict[int, dict]) -> Callable[[DataFrame, int], None]:
    """A callback that keeps each batch's counts by severity; a batch that comes again replaces its own."""

    def keep(df: DataFrame, batch: int) -> None:
        batches[batch] = severity_counts(df).first().asDict()

    return keep
