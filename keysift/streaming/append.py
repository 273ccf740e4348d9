"""Labelled examples of a stream, appended to a JSONL table: each batch once, however often it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keysift.operators.examples import label_examples


def write_batch(batch: DataFrame, batch_id: int, path: str, stream: str) -> None:
    """Write one batch of examples to a folder of its own, named by stream and batch.

    A batch that runs again, as after a lost driver, replaces what it wrote before, whole or in part, so
    nothing is there twice. Text is written as UTF-8, not escaped.
    """
    folder = f"{path.rstrip('/')}/stream={stream}/batch={batch_id}"
    batch.select("text", "is_credential", "source").write.mode("overwrite").json(folder)


def append_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    is_credential: bool,
    name: str = "examples",
    source: str = "manual",
    text: str = "text",
    available_now: bool = False,
) -> StreamingQuery:
    """Label the texts of a stream and append them to the table at ``path``; ``read_jsonl`` reads it.

    ``path`` is a table of streams: batch appends go to another folder. Batches are numbered per
    ``checkpoint``, so a stream that starts over with a new one needs a new ``name``; several streams of
    different names may share a table.
    """
    if not name or "/" in name or "=" in name:
        raise ValueError("a stream's name is part of a path")
    labelled = label_examples(stream, is_credential, source, text)
    writer = labelled.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, path, name)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
