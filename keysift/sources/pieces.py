"""Records of large files whose separator also stands inside quotes, read by many tasks.

Spark cuts a file at every separator, a line break or a comma, into pieces, and gives each task a block of
them. Whether a piece starts inside quotes depends on all that comes before it. So each block first works
out, in one pass, what it does to either answer; from these the answer at the start of every block follows
by a prefix over blocks, of which there are few; and a second pass joins the pieces of each block to
records. A record that goes on in the next block is put together from its fragments, two a block at most.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keysift.operators.keyed import stored
from keysift.sources.paths import if_found

# Blocks are broadcast with the state they start in: 40 bytes each. At 128 MB a block, 128 TB of files.
MAX_BLOCKS = 1_000_000
BLOCK = ["file", "block"]
COMPLETE, FRAGMENT = 0, 1

# Whether a piece that starts inside quotes, or outside, ends inside them.
Ends = Callable[[str, bool], bool]


def csv_ends_inside(line: str, inside: bool) -> bool:
    """Of a line of CSV. A quote opens only at the start of a field, a doubled one is part of the text, and
    what follows a closing one goes up to the next comma."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            inside, at = True, at + 2
            continue
        inside, at = False, line.find(",", at) + 1
        if not at:
            return False


_ESCAPED = re.compile(r"\\.", re.DOTALL)


def json_ends_inside(piece: str, inside: bool) -> bool:
    """Of a piece of JSON between commas: every quote that is not escaped opens or closes."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    return inside ^ (piece.count('"') % 2 == 1)


def read_pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame | None:
    """``(value, file, block)``: what stands between separators, by file and where its block starts."""
    pieces = if_found(spark.read.option("lineSep", separator).text, path)
    if pieces is None:
        return None
    return pieces.select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def file_starts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, start)``: where each file starts if all follow each other by name. No content is read."""
    found = spark.read.format("binaryFile").load(path)
    found = found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n"))
    # A row per file, so fewer than there are blocks.
    return found.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("start"))


def following(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """Pieces of several files as those of one, in order of ``file_starts``."""
    placed = pieces.join(F.broadcast(starts), "file")
    return placed.select("value", F.lit("").alias("file"), (F.col("block") + F.col("start")).alias("block"))


def _by_block(batches):
    """Of batches in the order of the file: ``(file, block)`` and its next pieces, again and again."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        columns = [batch.column(c).to_pylist() for c in batch.schema.names if c not in BLOCK]
        start = 0
        for i in range(1, len(blocks) + 1):
            if i == len(blocks) or (files[i], blocks[i]) != (files[start], blocks[start]):
                yield (files[start], blocks[start]), [c[start:i] for c in columns]
                start = i


def _effects(ends: Ends):
    """Per block: whether it ends inside quotes, from outside and from inside; and whether a record starts
    in it if it starts inside."""

    def run(batches):
        current, state = None, None

        def row():
            values = [[x] for x in (*current, *state)]
            return pa.RecordBatch.from_arrays(
                [pa.array(v) for v in values], names=[*BLOCK, "from_outside", "from_inside", "restarts"]
            )

        for key, (pieces,) in _by_block(batches):
            if key != current:
                if current is not None:
                    yield row()
                current, state = key, (False, True, False)
            a, b, restarts = state
            for piece in pieces:
                # Outside at a border: a record starts with this piece, whatever was before.
                restarts = restarts or not b
                if piece is not None:
                    a, b = ends(piece, a), ends(piece, b)
            state = (a, b, restarts)
        if current is not None:
            yield row()

    return run


def block_starts(pieces: DataFrame, ends: Ends) -> DataFrame:
    """Per block ``(file, block, inside, origin)``: whether it starts inside quotes, and in which block the
    record began that it starts in."""
    quoted = pieces.select(F.when(F.col("value").contains('"'), F.col("value")).alias("value"), *BLOCK)
    effects = quoted.mapInArrow(
        _effects(ends), "file string, block long, from_outside boolean, from_inside boolean, restarts boolean"
    )
    # A block leaves the answer as it is, turns it round, or gives one of its own.
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside").cast("int"))
    turns = F.col("from_outside") & ~F.col("from_inside")
    in_file = W.partitionBy("file").orderBy("block")
    runs = effects.withColumns({"fixed": fixed, "turns": turns.cast("int")})
    runs = runs.withColumn("run", F.count("fixed").over(in_file))
    in_run = W.partitionBy("file", "run")
    base = F.coalesce(F.max("fixed").over(in_run), F.lit(0))
    after = (base + F.sum("turns").over(in_run.orderBy("block"))) % 2 == 1
    states = runs.withColumn("after", after)
    states = states.withColumn("inside", F.lag("after", 1, False).over(in_file))
    opens = F.col("after") & (~F.col("inside") | F.col("restarts"))
    before = in_file.rowsBetween(W.unboundedPreceding, -1)
    origin = F.last(F.when(opens, F.col("block")), ignorenulls=True).over(before)
    return states.select(*BLOCK, "inside", origin.alias("origin"))


def _joined(ends: Ends, separator: str, kind: int, blank: tuple[str, ...]):
    """Records of a block but for ``blank`` ones: complete ones, or the fragments at its ends with the block
    where their record began."""
    names = ["file", "block", "place", "origin", "record"]

    def run(batches):
        current, state = None, None
        out = [[] for _ in names]

        def put(place, origin, record):
            for column, x in zip(out, (*current, place, origin, record)):
                column.append(x)

        def flushed():
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            for column in out:
                column.clear()
            return batch

        def finish():
            # What is left open goes on in the next block.
            inside, held, place, origin, started = state
            if held and kind == FRAGMENT:
                put(place, origin if not started else current[1], separator.join(held))

        for key, (pieces, starts, origins) in _by_block(batches):
            if key != current:
                if current is not None:
                    finish()
                current = key
                state = (starts[0], [], 0, origins[0], not starts[0])
            inside, held, place, origin, started = state
            for piece in pieces:
                held.append(piece)
                if '"' in piece:
                    inside = ends(piece, inside)
                if inside:
                    continue
                record = separator.join(held)
                if started and record in blank:
                    held = []
                    continue
                if started and kind == COMPLETE:
                    put(place, None, record)
                elif not started and kind == FRAGMENT:
                    put(place, origin, record)
                held, place, started = [], place + 1, True
            state = (inside, held, place, origin, started)
            if len(out[0]) >= 1000:
                yield flushed()
        if current is not None:
            finish()
        if out[0]:
            yield flushed()

    return run


def records(
    pieces: DataFrame,
    separator: str,
    ends: Ends,
    blank: tuple[str, ...] = (),
    cuts: DataFrame | None = None,
) -> DataFrame:
    """``(file, block, place, record)``: what stands between separators outside quotes, in order of block
    and place in a file. A record is in the block where it begins; if quotes stay open, the last one ends
    with its file. Records that are one of ``blank`` are left out and have no place. At the ``cuts``, the
    ``start`` of files that follow each other, a piece ends too: one inside quotes fails the job.

    Pieces are read three times: for the states, for whole records, and for those that cross blocks. The
    files must not change meanwhile, nor must Spark cut them elsewhere: an unknown block fails the job.
    """
    starts = stored(block_starts(pieces, ends), "blocks")
    if starts.count() > MAX_BLOCKS:
        raise ValueError("too many blocks: raise spark.sql.files.maxPartitionBytes")
    if cuts is not None:
        inside = starts.where("inside").join(cuts, F.col("block") == F.col("start"), "left_semi")
        if not inside.isEmpty():
            raise ValueError("a file ends inside quotes and cannot be followed by the next")
    joined = pieces.join(F.broadcast(starts), BLOCK, "left")
    unknown = F.raise_error(F.concat(F.lit("a block is cut elsewhere than before in "), "file"))
    joined = joined.select(
        "value",
        F.coalesce("inside", unknown.cast("boolean")).alias("inside"),
        "origin",
        *BLOCK,
    )
    schema = "file string, block long, place int, origin long, record string"
    complete = joined.mapInArrow(_joined(ends, separator, COMPLETE, blank), schema).drop("origin")
    fragments = joined.mapInArrow(_joined(ends, separator, FRAGMENT, blank), schema)
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "record")))
    # The first fragment has the record's place in the block where it began.
    crossing = fragments.groupBy("file", F.col("origin").alias("block")).agg(parts.alias("parts"))
    crossing = crossing.select(
        *BLOCK,
        F.col("parts")[0]["place"].alias("place"),
        F.array_join(F.col("parts.record"), separator).alias("record"),
    )
    return complete.unionByName(crossing)
