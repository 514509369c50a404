"""Files that keep arriving: page-level operators run on each batch; what needs a whole document waits for it in one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, glob: str = "*.pdf", per_batch: int = 1000) -> DataFrame:
    """A stream of the files that land in a folder: path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(path)


def process(stream: DataFrame, steps: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Applies ``steps`` to each batch and adds the rows to a table; a file is whole in its batch.

    Each batch goes to a folder of its own, which a repeated batch overwrites, so results come exactly once.
    """
    def write(batch: DataFrame, number: int) -> None:
        steps(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
