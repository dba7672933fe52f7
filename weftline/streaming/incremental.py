"""Run a row-wise pipeline over the files that arrived since the last run."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_available(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Process everything new in `stream`, append it to `path`, and stop.

    The checkpoint records which input was done and the file sink which files
    were committed, so a restarted run neither skips nor repeats rows.
    """
    query = (
        transform(stream)
        .writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
