"""Labelled text from JSONL, CSV and line files, and test sets from JSON objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.functions.chars import strip
from keysift.operators.examples import EXAMPLE_SCHEMA
from keysift.operators.keyed import stored
from keysift.sources import pieces
from keysift.sources.paths import if_found

_FIELDS = "struct<text:string,is_credential:string,source:string>"
_STRICT = {"allowSingleQuotes": "false"}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """Text lines as ``(value, file)``, or None where the path does not exist."""
    lines = if_found(spark.read.text, path)
    if lines is None:
        return None
    return lines.select("value", F.col("_metadata.file_name").alias("file"))


def _parse_object(line: Column) -> Column:
    """The fields of a line that is one whole JSON object, else null.

    The JSON reader stops after the first value and ignores what follows. Wrapped once as an array
    and once as an object, no trailing text can close both.
    """
    array = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<{_FIELDS}>", _STRICT)
    member = F.from_json(F.concat(F.lit('{"v":'), line, F.lit("}")), f"v {_FIELDS}", _STRICT)
    return F.when((F.size(array) == 1) & member["v"].isNotNull(), member["v"])


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """Parse JSONL lines in column ``value``: input columns plus ``piece`` and ``entry``.

    Blank lines are skipped. A line that is not one JSON object is split wherever ``}{`` shows that
    two objects were written without a line break. ``entry`` is null for pieces that stay broken.
    """
    stripped = lines.withColumn("value", strip(F.col("value"))).where(F.col("value") != "")
    whole = stripped.withColumn("_whole", _parse_object(F.col("value")))
    glued = F.col("_whole").isNull() & F.col("value").contains("}{")
    pieces = F.when(glued, F.split("value", r"(?<=\})(?=\{)")).otherwise(F.array("value"))
    exploded = whole.withColumn("piece", F.explode(pieces))
    entry = F.coalesce(F.col("_whole"), _parse_object(F.col("piece")))
    return exploded.withColumn("entry", entry).drop("_whole").where(strip(F.col("piece")) != "")


def examples_of(parsed: DataFrame) -> DataFrame:
    """The good entries as examples; an entry without a text is not one."""
    good = parsed.where(F.col("entry.text").isNotNull())
    return good.select(
        F.col("entry.text").alias("text"),
        F.col("entry.is_credential").try_cast("boolean").alias("is_credential"),
        F.col("entry.source").alias("source"),
    )


def rejects_of(parsed: DataFrame) -> DataFrame:
    """The pieces that could not be read, as ``(file, piece)``."""
    return parsed.where(F.col("entry.text").isNull()).select("file", "piece")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Examples of one JSONL file or folder; a missing one gives an empty table."""
    lines = read_lines(spark, path)
    if lines is None:
        return spark.createDataFrame([], EXAMPLE_SCHEMA)
    return examples_of(parse_jsonl(lines))


def load_examples(
    spark: SparkSession, positives: str, negatives: str, label_from: str = "column"
) -> DataFrame:
    """Both classes as one table. The class is the ``is_credential`` field, or, where that is
    missing or ``label_from`` is ``"origin"``, decided by which of the two paths a row came from."""
    if label_from not in ("column", "origin"):
        raise ValueError("label_from must be 'column' or 'origin'")
    parts = []
    for path, origin in ((positives, True), (negatives, False)):
        examples = read_jsonl(spark, path)
        label = F.lit(origin)
        if label_from == "column":
            label = F.coalesce("is_credential", label)
        parts.append(examples.withColumn("is_credential", label))
    return parts[0].unionByName(parts[1])


def read_csv_records(spark: SparkSession, path: str, has_header: bool = False) -> DataFrame | None:
    """``(file, block, place, record)`` of CSV files, or None where the path does not exist: records as
    they stand, without empty ones, and without the first of each file if that is a header. Lines before a
    header may be empty, but not fill a whole block. Line ends are one character, inside quotes too."""
    lines = pieces.read_pieces(spark, path, "\n")
    if lines is None:
        return None
    found = pieces.records(lines, "\n", pieces.csv_ends_inside, blank=("", "\r", "\ufeff", "\ufeff\r"))
    first = (F.col("block") == 0) & (F.col("place") == 0)
    record = F.regexp_replace("record", "\\r(\n|\\z)", "$1")
    record = F.when(first, F.regexp_replace(record, "^\\x{feff}", "")).otherwise(record)
    return found.where(~first if has_header else F.lit(True)).withColumn("record", record)


def read_csv(
    spark: SparkSession,
    path: str,
    has_header: bool = True,
    text_col: int = 0,
    label_col: int = 1,
    on_bad: str = "quarantine",
    multiline: bool = True,
    whole_files: bool = False,
) -> DataFrame:
    """CSV rows as ``(text, is_credential, source, bad_label)``.

    A missing file gives an empty table. Columns go by position; rows that end before the text or the
    label are skipped. Any integer but zero is a positive. Other labels, empty ones too, fail the job
    with ``on_bad="fail"``, else the row comes with a null class and its label in ``bad_label``; see
    ``split_rejects``.

    Lines may break inside quotes, and many tasks read a large file all the same: see ``pieces``. That
    takes three passes over it. ``multiline=False`` reads data without such breaks in one;
    ``whole_files=True`` reads each file in one task and one pass, for many small ones.
    """
    if on_bad not in ("quarantine", "fail"):
        raise ValueError("on_bad must be 'quarantine' or 'fail'")
    width = max(text_col, label_col) + 1
    schema = ", ".join([*(f"c{i} STRING" for i in range(width)), "raw STRING"])
    options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": "raw"}
    if multiline and not whole_files:
        lines = read_csv_records(spark, path, has_header)
        parsed = F.from_csv("record", schema, options | {"multiLine": "true"})
        raw = None if lines is None else lines.select(parsed.alias("r")).select("r.*")
    else:
        reader = spark.read.schema(schema).options(header=has_header, multiLine=multiline, enforceSchema=True, **options)
        raw = if_found(reader.csv, path)
    if raw is None:
        return spark.createDataFrame([], f"{EXAMPLE_SCHEMA}, bad_label STRING")
    # The raw record is there for rows that are shorter or longer than the columns asked for.
    commas = F.regexp_replace(F.regexp_replace("raw", '"(?:[^"]|"")*+"', ""), "[^,]+", "")
    too_short = F.coalesce(F.length(commas) + 1 < width, F.lit(False))
    label = F.coalesce(strip(F.col(f"c{label_col}")), F.lit(""))
    is_integer = label.rlike("^[+-]?[0-9]+(_[0-9]+)*$")
    if on_bad == "fail":
        message = F.concat(F.lit("label is not an integer: "), label)
        bad = F.when(~is_integer, F.raise_error(message).cast("string"))
    else:
        bad = F.when(~is_integer, label)
    return raw.where(~too_short).select(
        F.coalesce(strip(F.col(f"c{text_col}")), F.lit("")).alias("text"),
        F.when(is_integer, label.rlike("[1-9]")).alias("is_credential"),
        F.lit("csv_import").alias("source"),
        bad.alias("bad_label"),
    )


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples with a usable label, and the quarantined rest."""
    good = rows.where(F.col("bad_label").isNull()).drop("bad_label")
    return good, rows.where(F.col("bad_label").isNotNull()).select("text", "bad_label")


def read_line_examples(spark: SparkSession, path: str, is_credential: bool) -> DataFrame:
    """One example per line that is not blank; its source is ``file:<name>``."""
    lines = read_lines(spark, path)
    if lines is None:
        return spark.createDataFrame([], EXAMPLE_SCHEMA)
    text = strip(F.col("value"))
    return lines.where(text != "").select(
        text.alias("text"),
        F.lit(is_credential).alias("is_credential"),
        F.concat(F.lit("file:"), "file").alias("source"),
    )


def read_testset(
    spark: SparkSession,
    path: str,
    multiline: bool = True,
    whole_files: bool = False,
    in_parts: bool = False,
) -> DataFrame | None:
    """Test rows ``(pos, text, label)`` of JSON objects ``{"texts": [...], "labels": [...]}``, or
    None where the path does not exist.

    Texts and labels of unequal number fail the job. A file is one object, or with ``multiline=False`` one
    object per line, which Spark can split. The object of a file may be large: many tasks read it, see
    ``testset_elements``. ``whole_files=True`` reads each file in one task, for many small ones, and takes
    any other keys beside the two; otherwise those must not hold objects or arrays of arrays. With
    ``in_parts`` all files, one after the other by name, are one object, as many tasks write a large one;
    it is cut between values.
    """
    if in_parts and (whole_files or not multiline):
        raise ValueError("an object in parts has neither whole files nor whole lines")
    if multiline and not whole_files:
        return _paired(spark, path, in_parts)
    schema = "texts ARRAY<STRING>, labels ARRAY<INT>"
    sets = if_found(spark.read.schema(schema).option("multiLine", multiline).json, path)
    if sets is None:
        return None
    zipped = F.arrays_zip("texts", "labels")
    unequal = ~F.size("texts").eqNullSafe(F.size("labels"))
    message = F.lit(UNEQUAL).cast("string")
    checked = F.when(unequal, F.array_repeat(F.element_at(zipped, 1), F.raise_error(message).cast("int")))
    rows = sets.select(F.posexplode(checked.otherwise(zipped)).alias("pos", "row"))
    return rows.select("pos", F.col("row.texts").alias("text"), F.col("row.labels").alias("label"))


UNEQUAL = "a test set has texts and labels of unequal number"
# What may stand before and after a value of an array, in a stretch of an object between two commas.
_BEFORE = r"^\s*+(\{\s*+)?+(?:(\"(?:[^\"\\]++|\\.)*+\")\s*+:\s*+)?+(\[\s*+)?+"


def _element(batches):
    """Of stretches between commas: the key that begins there, if one does, and the value as JSON."""
    import json
    import re

    import pyarrow as pa

    before = re.compile(_BEFORE, re.DOTALL)
    for batch in batches:
        keys, values = [], []
        for stretch in batch.column("record").to_pylist():
            start = before.match(stretch)
            value = stretch[start.end() :].rstrip(" \t\r\n]}")
            if value[:1] in ("{", "["):
                raise ValueError("a test set holds more than arrays of values: read it with whole_files=True")
            keys.append(json.loads(start[2]) if start[2] else None)
            values.append(value or None)
        columns = [batch.column(c) for c in ("file", "block", "place")]
        columns += [pa.array(keys, pa.string()), pa.array(values, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "place", "key", "value"])


def testset_elements(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame | None:
    """``(file, key, pos, value)``: the values of all arrays of the objects that files are, as JSON, by key
    and position. A file is cut at its commas, so many tasks read a large one; with ``in_parts`` all files
    are one.

    Positions come from counts: values are numbered within their block, blocks by a prefix over the counts
    of those before, and a position is the number since the key. Stored, as counts and values are read.
    """
    stretches = pieces.read_pieces(spark, path, ",")
    if stretches is None:
        return None
    cuts = None
    if in_parts:
        cuts = stored(pieces.file_starts(spark, path), "file-starts")
        stretches = pieces.following(stretches, cuts)
    schema = "file string, block long, place int, key string, value string"
    stretches = pieces.records(stretches, ",", pieces.json_ends_inside, cuts=cuts)
    elements = stretches.mapInArrow(_element, schema)
    elements = stored(elements, "testset")
    # The last key of a block, and how many values follow it there, or there are if it has none.
    in_block = Window.partitionBy("file", "block").orderBy("place")
    elements = elements.withColumn("nth_key", F.count("key").over(in_block))
    has_value = F.col("value").isNotNull()
    per_key = elements.groupBy("file", "block", "nth_key").agg(
        F.count("value").alias("n"), F.max("key").alias("key")
    )
    latest = per_key.groupBy("file", "block").agg(F.max_by(F.struct("key", "n"), "nth_key").alias("last"))
    in_file = Window.partitionBy("file").orderBy("block")
    carried = latest.select("file", "block", F.col("last.key").alias("last_key"), F.col("last.n").alias("n"))
    carried = carried.withColumn("run", F.count("last_key").over(in_file))
    upto = F.sum("n").over(Window.partitionBy("file", "run").orderBy("block"))
    carried = carried.withColumns({"upto": upto, "known": F.last("last_key", True).over(in_file)})
    carried = carried.select(
        "file",
        "block",
        F.lag("known").over(in_file).alias("key_before"),
        F.lag("upto", 1, 0).over(in_file).alias("n_before"),
    )
    since_key = Window.partitionBy("file", "block", "nth_key").orderBy("place")
    numbered = elements.withColumns(
        {"key": F.max("key").over(since_key), "nth": F.count("value").over(since_key) - 1}
    ).where(has_value)
    # At most one row per block, of which ``pieces`` allows so many.
    joined = numbered.join(F.broadcast(carried), ["file", "block"])
    goes_on = F.col("nth_key") == 0
    return joined.select(
        "file",
        F.when(goes_on, F.col("key_before")).otherwise(F.col("key")).alias("key"),
        (F.col("nth") + F.when(goes_on, F.col("n_before")).otherwise(0)).alias("pos"),
        "value",
    )


def _paired(spark: SparkSession, path: str, in_parts: bool) -> DataFrame | None:
    elements = testset_elements(spark, path, in_parts)
    if elements is None:
        return None
    texts = elements.where("key = 'texts'").select("file", "pos", F.col("value").alias("text"))
    labels = elements.where("key = 'labels'").select("file", "pos", F.col("value").alias("label"), F.lit(1).alias("l"))
    pairs = texts.withColumn("t", F.lit(1)).join(labels, ["file", "pos"], "full")
    alone = F.col("t").isNull() | F.col("l").isNull()
    text = F.from_json(F.concat(F.lit('{"v":'), "text", F.lit("}")), "v STRING", _STRICT)["v"]
    checked = F.when(alone, F.raise_error(F.lit(UNEQUAL)).cast("string")).otherwise(text)
    label = F.from_json(F.concat(F.lit('{"v":'), "label", F.lit("}")), "v INT", _STRICT)["v"]
    return pairs.select(F.col("pos").cast("int").alias("pos"), checked.alias("text"), label.alias("label"))


def write_split(df: DataFrame, path: str) -> None:
    """Store a split table, one folder per part."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored split, or None where the path does not exist."""
    return if_found(spark.read.parquet, path)
