"""What several operators share: words, row keys, and tables that cut lineage."""

from __future__ import annotations

import ctypes
import gc
import string
import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.session import scratch_path, small_batches  # noqa: F401

# A word, in a pattern that Java, RE2 and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder all executors share, and read back: no lineage, no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: Column) -> Column:
    """A text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by id and content, so that a repeated or missing id confuses no other row."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), whole(text)))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give memory that was freed back to the system. Workers are reused and allocators keep what earlier
    tasks have freed, which counts for an executor while its JVM needs the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def forget() -> None:
    """Drop what ``per_process`` holds, so that a worker does not carry one operator's memory into the
    tasks of the next."""
    sys.modules.pop("keysift_per_process", None)
    release()


def per_process(name: str, key: object, make: Callable[[], object]):
    """What ``make`` returns for ``key``, made once per Python worker, which runs one task after the
    other. Tasks get their functions by value, so a global of a module would not last."""
    store = sys.modules.setdefault("keysift_per_process", types.ModuleType("keysift_per_process"))
    held = vars(store).get(name)
    if held is None or held[0] != key:
        release()
        held = (key, make())
        setattr(store, name, held)
    return held[1]
