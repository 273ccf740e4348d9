"""Detection on a stream. It keeps no state: each text is judged by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from keysift.operators.detect import Scorer, detect


def read_text_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    files: str = "*.parquet",
    max_bytes: int = 1 << 40,
) -> DataFrame:
    """New parquet files of a folder as a stream of rows, up to ``max_bytes`` of files a batch. ``path`` may
    be a pattern, of folders and of files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return reader.option("maxBytesPerTrigger", str(max_bytes)).parquet(path)


def detect_stream(
    stream: DataFrame,
    output: str,
    checkpoint: str,
    text: str = "text",
    rules=None,
    score: Scorer | None = None,
    threshold: float = 0.7,
    available_now: bool = False,
) -> StreamingQuery:
    """Append detection results to a parquet table, each input row once across restarts.

    ``checkpoint`` must outlive the executors, like the output. With ``available_now`` the query
    ends when it has processed what is there.
    """
    detected = detect(stream, text, rules, score, threshold)
    writer = (
        detected.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
