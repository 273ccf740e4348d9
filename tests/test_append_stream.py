"""Streaming appends: what runs again adds nothing."""

import os

import pytest

from keysift.session import scratch_path
from keysift.sources.files import read_jsonl
from keysift.streaming.append import append_stream, write_batch
from keysift.streaming.detect import read_text_stream

SCHEMA = "id long, text string"


def add_file(spark, folder, texts, start=0):
    rows = [(start + i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, path, state, **kwargs):
    query = append_stream(
        read_text_stream(spark, folder, SCHEMA), path, state, True, available_now=True, **kwargs
    )
    query.awaitTermination()


def texts_of(spark, path):
    return sorted((r.text or "") for r in read_jsonl(spark, path).collect())


def test_restart_and_replay(spark):
    folder, path, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    add_file(spark, folder, ["a", "ação 😀", ""])
    run(spark, folder, path, state, source="chat")
    run(spark, folder, path, state, source="chat")
    assert texts_of(spark, path) == ["", "a", "ação 😀"]
    add_file(spark, folder, ["b", "a"], 3)
    run(spark, folder, path, state, source="chat")
    expected = ["", "a", "a", "ação 😀", "b"]
    assert texts_of(spark, path) == expected
    rows = read_jsonl(spark, path).collect()
    assert {(r.is_credential, r.source) for r in rows} == {(True, "chat")}
    # As if the driver was lost after the last batch was written, and before that was noted.
    commits = f"{state.removeprefix('file:')}/commits"
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    assert int(last) >= 1
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    run(spark, folder, path, state, source="chat")
    assert texts_of(spark, path) == expected


def test_a_batch_replaces_itself(spark):
    path = scratch_path(spark, "out")
    batch = spark.createDataFrame([("x", True, "s"), ("y", False, "s")], "text string, is_credential boolean, source string")
    write_batch(batch.limit(1), 3, path, "one")
    write_batch(batch, 3, path, "one")
    write_batch(batch, 3, path, "two")
    write_batch(batch.limit(0), 4, path, "one")
    assert texts_of(spark, path) == ["x", "x", "y", "y"]


def test_streams_share_a_table_by_name(spark):
    folder, path = scratch_path(spark, "in"), scratch_path(spark, "out")
    add_file(spark, folder, ["a"])
    for name in ("one", "two"):
        run(spark, folder, path, scratch_path(spark, "state"), name=name)
    assert texts_of(spark, path) == ["a", "a"]
    for name in ("", "a/b", "a=b"):
        with pytest.raises(ValueError):
            append_stream(read_text_stream(spark, folder, SCHEMA), path, "x", True, name=name)
