"""Token ids as ORC files, in ascending document order.

A range partition of the documents becomes one file. Its stripes hold run-length encoded integers,
each with a row index and a Bloom filter on the document id, so that readers take stripes in
parallel and a lookup skips those that cannot hold the id. Every row carries its place in its file;
the place in the whole corpus is that plus the sizes of the files before, summed from the files'
own columns.
"""

from __future__ import annotations

import array
import os
import re
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keysift.llm.common import per_process, small_batches, whole

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "10000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
FILE_SCHEMA = "doc_id long, part int, row_in_part long, start_in_part long, n_tokens long, ids array<int>"
CACHED_PIECES = 600_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with a tokenizer file, remembering what it has encoded.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    pieces between spaces and line ends, one after the other. Most pieces recur; each is encoded once.
    Most are a word of letters, perhaps with marks behind it, which are tokens of their own: such words
    need no normalizer and no splitting and go to the tokenizer's model as they are, if the tokenizer is
    found to treat letters and marks so (``_letters``). As the tokenizer lowers letters, A-Z are lowered
    first, but in texts that may hold one of its special tokens; those are encoded whole. Ids are unsigned
    32-bit integers. The memory holds ``CACHED_PIECES`` pieces and starts anew when full.
    """

    LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    WORD_AND_MARKS = re.compile(f"([{LETTERS}]+)([{re.escape(string.punctuation)}]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # One thread per worker: Spark runs as many workers as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = self._letters()
        self.known: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        """What the tokenizer gives its model for a text without special tokens."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.tokenizer.pre_tokenizer is None:
            return [text]
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _letters(self) -> dict[int, str] | None:
        """For each letter what the model gets for it; None if words cannot be told from letters alone."""
        letters = [c for c in map(chr, range(256)) if re.fullmatch(f"[{self.LETTERS}]", c)]
        table = {ord(c): "".join(self._split(c)) for c in letters}
        added = self.tokenizer.get_added_tokens_decoder().values()
        alone = all("<|" in token.content for token in added) and not self.tokenizer.truncation
        runs = all(
            self._split("".join(run)) == ["".join(table[ord(c)] for c in run)]
            for run in (letters, letters[::-1], *([c, c] for c in letters))
        )
        marks = all(
            self._split(c + mark * n) == [table[ord(c)], *self._split(mark * n)]
            for c in letters
            for mark in string.punctuation
            for n in (1, 2)
        )
        same = all(table[ord(c)] == c for c in string.ascii_lowercase)
        return table if alone and runs and marks and same else None

    def _each(self, pieces: list[str]) -> Iterator[bytes]:
        encodings = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return (array.array("I", encoding.ids).tobytes() for encoding in encodings)

    def _each_word(self, words: Iterable[str]) -> Iterator[bytes]:
        for word in words:
            found = self.model.tokenize(word if word.isascii() else word.translate(self.letters))
            yield array.array("I", [token.id for token in found]).tobytes()

    def _learn(self, pieces: list[str]) -> list[bytes]:
        known, parts = self.known, self.WORD_AND_MARKS.fullmatch
        words, marked, rest = set(), [], set()
        for piece in pieces:
            found = parts(piece) if self.letters else None
            if found is None:
                rest.add(piece)
                continue
            word, marks = found.groups()
            if word not in known:
                words.add(word)
            if marks:
                marked.append((piece, word, marks))
                if marks not in known:
                    rest.add(marks)
        known.update(zip(words, self._each_word(words)))
        known.update(zip(rest, self._each(list(rest))))
        known.update((piece, known[word] + known[marks]) for piece, word, marks in marked)
        return [known[piece] for piece in pieces]

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each."""
        special = pc.match_substring(texts, "<|")
        lowered = pc.if_else(special, texts, pc.replace_substring(pc.ascii_lower(texts), "\n", " "))
        pieces = pc.split_pattern(lowered, " ")
        if pc.any(special).as_py():
            pieces = pa.array(
                [
                    [text] if whole_text else each
                    for text, whole_text, each in zip(
                        texts.to_pylist(), special.to_pylist(), pieces.to_pylist()
                    )
                ],
                pieces.type,
            )
        words = pieces.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHED_PIECES:
            self.known = {}
        each = list(map(self.known.get, distinct))
        new = [i for i, ids in enumerate(each) if ids is None]
        for i, ids in zip(new, self._learn([distinct[i] for i in new])):
            each[i] = ids
        found = pa.array(each, pa.large_binary()).take(words.indices)
        _, offsets, ids = found.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(found) + 1] // 4
        rows = np.asarray(pieces.offsets)
        return np.frombuffer(ids, "<u4", count=ends[-1]), np.diff(ends[rows - rows[0]])


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process("encoder", path, lambda: Encoder(path))
        part, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                piece = batch.slice(first, 1000)
                ids, sizes = encoder(piece.column("text"))
                ids = np.insert(ids, np.cumsum(sizes), end_id).view("<i4")
                sizes = sizes + 1
                starts = start + np.cumsum(sizes) - sizes
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").cast(pa.int64()),
                        pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(np.arange(row, row + len(sizes))),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                    ],
                    ["doc_id", "part", "row_in_part", "start_in_part", "n_tokens", "ids"],
                )
                row += len(sizes)
                start += int(sizes.sum())

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode all texts and write them to ``path`` as ORC, ascending by id.

    A null text is empty and gives the end id alone. Null ids come last; rows of one id are ordered
    by their text, equal rows are interchangeable and all stay. Other columns are not written. An
    empty table gives files without rows. Texts are exchanged before they are encoded, so sampling the
    id ranges encodes nothing; a lost task encodes the same range again and writes the same file.
    """
    small_batches(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("text").asc()]
    ranged = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    run = _encode(tokenizer or tokenizer_path(), end_id)
    ranged.mapInArrow(run, FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: ``doc_id``, ``part``, ``row_in_part``, ``start_in_part``, ``n_tokens``, ``ids``.

    A filter on ``doc_id`` is pushed to the files' statistics and Bloom filters.
    """
    return spark.read.schema(FILE_SCHEMA).orc(path)


def with_start(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``start``, the ids of all documents before a row, to rows read from ``path``.

    Sums per file come from two integer columns of the files; the only window over everything is on
    one row per file.
    """
    sizes = read_tokens(rows.sparkSession, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part")) - F.col("n")
    starts = sizes.select("part", before.alias("part_start"))
    start = (F.col("part_start") + F.col("start_in_part")).alias("start")
    return rows.join(starts, "part").select(*rows.columns, start)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        columns = [batch.column(c) for c in ("doc_id", "part", "start_in_part", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sums, pa.int64())],
            ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"],
        )


def checksums(tokens: DataFrame) -> DataFrame:
    """Rows of ``read_tokens`` with a crc32 of the ids in place of them."""
    return tokens.mapInArrow(
        _checksums, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"
    )


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, all from the files."""
    rows = with_start(checksums(read_tokens(spark, path)), path)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
