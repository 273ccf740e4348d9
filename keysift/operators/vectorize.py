"""Character n-gram TF-IDF: fit a vocabulary table, turn texts into sparse vectors.

A text is one row, so its grams are counted where the row is, as numbers in arrays, and nothing is
regrouped by document. The only shuffle of the fit is one row per distinct gram and task. Only texts of
several pieces have their grams listed as strings, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.functions import gramcounts
from keysift.functions.grams import join_words, raw_grams, word_grams
from keysift.functions.normalize import normalize_text
from keysift.session import ensure_checkpoint_dir, small_batches

# "tfidf": the training vectoriser: normalised text, grams within words, count * idf, then unit
# length. "raw": the portable client's vectoriser: grams of the text as it is, counts to unit
# length first, then * idf.
MODES = ("tfidf", "raw")


@dataclass(frozen=True)
class VectorizerParams:
    """Settings of the vectoriser. ``min_df`` counts documents, ``max_df`` is a share of them."""

    ngram_max: int = 3
    min_df: int = 2
    max_df: float = 0.95
    max_features: int = 1500
    exact_accents: bool = True


# Texts longer than this are cut into pieces of this size, which bounds the memory of a task.
PIECE_CHARS = 250_000


def _prepared(text: Column, params: VectorizerParams, mode: str) -> Column:
    """The string whose substrings are the grams."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return text if mode == "raw" else join_words(normalize_text(text, params.exact_accents))


def _listed(
    prepared: Column, params: VectorizerParams, mode: str, piece: tuple[Column, int] | None = None
) -> Column:
    if mode == "raw":
        return raw_grams(prepared, 1, params.ngram_max, piece)
    return word_grams(prepared, params.ngram_max, piece)


def grams_of(text: Column, params: VectorizerParams, mode: str = "tfidf") -> Column:
    """All grams of a text as one array."""
    return _listed(_prepared(text, params, mode), params, mode)


def _pieces(prepared: DataFrame, size: int) -> DataFrame:
    """One row per piece of column ``prepared``, numbered in ``piece``; an empty text has one."""
    last = F.floor((F.greatest(F.length("prepared"), F.lit(1)) - 1) / size).cast("int")
    return prepared.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))


# Stands for the document itself among its grams, which are never empty.
_DOCUMENT = ""


def _corpus_counts(df: DataFrame, params: VectorizerParams, text: str, size: int) -> DataFrame:
    """``(gram, tf, df)``: occurrences, and documents with the gram; the empty gram counts documents.

    Texts of one piece are counted many at once; texts of several are listed piece by piece.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    prepared = rows.select(_prepared(F.col("text"), params, "tfidf").alias("prepared"))
    is_long = F.length("prepared") > size
    counts = _counts_of_whole(prepared.where(~is_long), params).unionByName(
        _counts_of_pieces(prepared.where(is_long), params, size)
    )
    return counts.groupBy("gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _counts_of_whole(prepared: DataFrame, params: VectorizerParams) -> DataFrame:
    """Counts ``(gram, tf, df)`` of some texts each, of which a task makes a row per distinct gram."""
    largest = params.ngram_max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in gramcounts.chunks(batch.column("prepared").to_pylist()):
                grams, tf, df = gramcounts.corpus_counts(texts, largest)
                columns = [pa.array([*grams, _DOCUMENT], pa.string())]
                columns += [pa.array([*tf.tolist(), 0], pa.int64()), pa.array([*df.tolist(), len(texts)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "tf", "df"])

    small_batches(prepared)
    return prepared.mapInArrow(run, "gram string, tf long, df long")


def _counts_of_pieces(prepared: DataFrame, params: VectorizerParams, size: int) -> DataFrame:
    """Counts ``(gram, tf, df)`` of texts of several pieces: a text is aggregated under its own number
    first, to count it once per gram."""
    pieces = _pieces(prepared.withColumn("doc", F.monotonically_increasing_id()), size)
    listed = _listed(F.col("prepared"), params, "tfidf", (F.col("piece"), size))
    marker = F.when(F.col("piece") == 0, F.array(F.lit(_DOCUMENT))).otherwise(
        F.array().cast("array<string>")
    )
    grams = pieces.select("doc", F.explode(F.concat(marker, listed)).alias("gram"))
    per_doc = grams.groupBy("doc", "gram").agg(F.count("*").alias("tf"))
    per_doc = per_doc.groupBy("gram").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    return per_doc.withColumn("tf", F.when(F.col("gram") == _DOCUMENT, 0).otherwise(F.col("tf")))


def gram_counts(
    df: DataFrame,
    params: VectorizerParams | None = None,
    text: str = "text",
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Corpus counts ``(gram, tf, df)`` of all grams."""
    counts = _corpus_counts(df, params or VectorizerParams(), text, piece_chars)
    return counts.where(F.col("gram") != _DOCUMENT)


def fit_vocabulary(df: DataFrame, params: VectorizerParams | None = None, text: str = "text") -> DataFrame:
    """The vocabulary table ``(gram, idx, df, tf, idf)``.

    Keeps grams within the document frequency bounds, of those the ``max_features`` most frequent
    (ties by gram), numbered in gram order. ``idf = ln((1 + n) / (1 + df)) + 1``.

    Like any fit this runs at once: one pass over the texts, whose counts are stored, as is the table
    that comes back.
    """
    params = params or VectorizerParams()
    ensure_checkpoint_dir(df.sparkSession)
    counts = _corpus_counts(df, params, text, PIECE_CHARS).checkpoint()
    documents = counts.where(F.col("gram") == _DOCUMENT).agg(F.sum("df")).scalar()
    kept = counts.where(
        (F.col("gram") != _DOCUMENT)
        & (F.col("df") >= params.min_df)
        & (F.col("df") <= documents * F.lit(params.max_df))
    )
    # At most max_features rows from here on, so one task may number them.
    top = kept.orderBy(F.desc("tf"), "gram").limit(params.max_features)
    numbered = top.select(
        "gram",
        (F.row_number().over(Window.orderBy("gram")) - 1).alias("idx"),
        "df",
        "tf",
        (F.log((1 + documents) / (1 + F.col("df"))) + 1).alias("idf"),
    )
    return numbered.checkpoint()


def vectorizer(vocabulary: DataFrame, mode: str = "tfidf") -> PipelineModel:
    """Pipeline from an array column ``grams`` to a sparse vector column ``features``.

    The vocabulary holds at most ``max_features`` rows and is read to the driver, as any fitted
    MLlib model is. A gram without an idf has weight 1.
    """
    rows = vocabulary.select("gram", "idf").orderBy("idx").collect()
    if not rows:
        raise ValueError("the vocabulary is empty: no gram passed the document frequency bounds")
    counts = CountVectorizerModel.from_vocabulary(
        [row.gram for row in rows], inputCol="grams", outputCol="_counts"
    )
    idf = Vectors.dense([1.0 if row.idf is None else row.idf for row in rows])
    if mode == "raw":
        unit = Normalizer(inputCol="_counts", outputCol="_unit")
        weigh = ElementwiseProduct(scalingVec=idf, inputCol="_unit", outputCol="features")
        return PipelineModel([counts, unit, weigh])
    weigh = ElementwiseProduct(scalingVec=idf, inputCol="_counts", outputCol="_weighted")
    unit = Normalizer(inputCol="_weighted", outputCol="features")
    return PipelineModel([counts, weigh, unit])


def with_features(
    df: DataFrame,
    model: PipelineModel,
    params: VectorizerParams | None = None,
    text: str = "text",
    mode: str = "tfidf",
    piece_chars: int = PIECE_CHARS,
    chars: Column | None = None,
) -> DataFrame:
    """Add or replace the vector ``features``. Grams outside the vocabulary are dropped, and a text of none, or
    a null, gets the zero vector.

    Map-only, but for texts longer than a piece: their pieces are counted one by one and summed per
    text. ``chars`` tells what is long where ``text`` is itself costly to compute: its length, or that
    of the column it comes from. On a stream every text is taken whole.
    """
    params = params or VectorizerParams()
    df = df.select(*[c for c in df.columns if c.lower() != "features"])
    if df.isStreaming:
        return _features_of_whole(df, model, params, text, mode)
    is_long = F.coalesce((F.length(text) if chars is None else chars) > piece_chars, F.lit(False))
    whole = _features_of_whole(df.where(~is_long), model, params, text, mode)
    cut = _features_of_pieces(df.where(is_long), model, params, text, mode, piece_chars)
    return whole.unionByName(cut)


def _features_of_whole(
    df: DataFrame, model: PipelineModel, params: VectorizerParams, text: str, mode: str
) -> DataFrame:
    counts, weighting = model.stages[0], PipelineModel(model.stages[1:])
    vocabulary = gramcounts.Vocabulary.of(counts.vocabulary)
    largest, words = params.ngram_max, mode != "raw"

    def counted(texts: pa.Array) -> pa.Array:
        """Per text its counts as a sparse vector."""
        found = gramcounts.counts_per_text(texts.to_pylist(), vocabulary, largest, words)
        ends, places, numbers = found
        offsets = pa.array([0, *ends.tolist()], pa.int32())
        fields = {
            "type": pa.array([0] * len(ends), pa.int8()),
            "size": pa.array([vocabulary.size] * len(ends), pa.int32()),
            "indices": pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
            "values": pa.ListArray.from_arrays(offsets, pa.array(numbers.astype(float), pa.float64())),
        }
        return pa.StructArray.from_arrays(list(fields.values()), list(fields))

    small_batches(df)
    prepared = _prepared(F.make_valid_utf8(text), params, mode)
    vector = F.arrow_udf(counted, VectorUDT())(prepared)
    return weighting.transform(df.select(F.struct("*").alias("row"), vector.alias("_counts"))).select(
        "row.*", "features"
    )


def _features_of_pieces(
    df: DataFrame, model: PipelineModel, params: VectorizerParams, text: str, mode: str, size: int
) -> DataFrame:
    counts, weighting = model.stages[0], PipelineModel(model.stages[1:])
    numbered = df.select(
        F.monotonically_increasing_id().alias("doc"),
        F.struct("*").alias("row"),
        _prepared(F.col(text), params, mode).alias("prepared"),
    )
    listed = _listed(F.col("prepared"), params, mode, (F.col("piece"), size))
    counted = counts.transform(_pieces(numbered, size).withColumn("grams", listed))
    # The row itself travels with its first piece only.
    row = F.when(F.col("piece") == 0, F.col("row"))
    summed = (
        counted.select("doc", row.alias("row"), "_counts")
        .groupBy("doc")
        .agg(F.first("row", ignorenulls=True).alias("row"), Summarizer.sum(F.col("_counts")).alias("_counts"))
    )
    return weighting.transform(summed).select("row.*", "features")


def vector_weights(df: DataFrame, keys: list[str]) -> DataFrame:
    """The non-zero entries of ``features`` as rows ``(*keys, idx, weight)``."""
    vector = F.unwrap_udt("features")

    def entry(idx: Column, weight: Column) -> Column:
        return F.struct(idx.alias("idx"), weight.alias("weight"))

    listed = F.when(
        vector["type"] == 0,
        F.transform(vector["indices"], lambda idx, i: entry(idx, F.get(vector["values"], i))),
    ).otherwise(F.transform(vector["values"], lambda weight, idx: entry(idx, weight)))
    return df.select(*keys, F.inline(listed)).where(F.col("weight") != 0)
