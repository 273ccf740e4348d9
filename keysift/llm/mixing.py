"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words: its weight's share of the mix, no more than ``limit``
times what it has, the excess shared among the others by weight. A document of a source is then
expected ``target / source_size`` times. Along a fixed order of the source's documents these
expectations are summed, one random offset is added, and a document is emitted once for every integer
boundary its interval crosses.

Documents are ordered by size class, then by a hash of their id. Neighbours are of like size, so
the words taken come far nearer the target than those of a random order.

The prefix sum needs no task that holds a source: counts per cell (source, size class, hash bucket)
give each cell its first position, and only a cell's own rows are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keysift.llm.common import WORD, fresh, stored, whole

# Contract of the mix.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def size_class(size: str) -> Column:
    """Number of bits and the three leading bits: classes ascend with size, each at most a quarter wide."""
    bits = f"length(bin({size}))"
    return F.expr(f"{bits} * 8 + shiftright({size}, greatest({bits} - 3, 0))").cast("int")


def unit_hash(text: Column) -> Column:
    """A number from 0 up to 1."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
) -> DataFrame:
    """``(source, source_size)`` to those and ``target``, one row per source.

    Weights go round by code point order of the sources, null last. With the sources ordered by how
    soon they reach their limit, ``level`` is the words per unit of weight if exactly the sources
    before are at their limit; it is largest where that is so.

    The only windows over everything are here, on one row per source.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    cap = F.col("source_size") * F.lit(float(limit))
    ranked = sizes.select(
        "source",
        "source_size",
        F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
        cap.alias("cap"),
    )
    soonest = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = soonest.rowsBetween(W.unboundedPreceding, -1)
    after = soonest.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    target = F.least("cap", F.max("level").over(W.partitionBy()) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def with_copies(
    docs: DataFrame,
    size: Column,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: str = SEED,
    content: Column | None = None,
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``size`` gives the words of a row (null: 0), ``copies`` how often the mix holds it, ``taken`` the
    words that makes. Columns of these names in ``docs`` are replaced. A null source is a source of
    its own, a null id is hashed as empty. Rows of one size class are ordered, and spread, by a hash of
    the id and of ``content``, a string that tells rows of one id or without one apart (all columns, if
    not given). Rows alike in every column may change places; those of one size class and source are
    ranked in one task.
    A source without words has target 0 and no copies; an empty table gives an empty one. Runs with
    one seed agree.
    """
    names = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c.lower() not in names]
    inner = ("key", "class", "bucket", "order", "start", "rank")
    key, cls, bucket, order, start, rank = (fresh(docs, f"mix_{n}") for n in inner)
    if content is None:
        content = F.xxhash64(*kept).cast("string")
    named = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    hashed = F.md5(F.concat_ws("|", F.lit(seed), named, content))
    rows = (
        docs.select(*kept, F.coalesce(size, F.lit(0)).cast("long").alias("size"))
        .withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")))
        .withColumn(cls, size_class("size"))
        .withColumn(order, hashed)
        .withColumn(bucket, F.substring(order, 1, 2))
    )
    cells = stored(
        rows.groupBy(key, cls, bucket).agg(
            F.first(source).alias("source"), F.count("*").alias("n"), F.sum("size").alias("words")
        ),
        "mix-cells",
    )
    classes = cells.groupBy(key, cls).agg(F.sum("n").alias("n"))
    class_start = F.sum("n").over(W.partitionBy(key).orderBy(cls)) - F.col("n")
    classes = classes.select(key, cls, class_start.alias("class_start"))
    bucket_start = F.sum("n").over(W.partitionBy(key, cls).orderBy(bucket)) - F.col("n")
    sizes = cells.groupBy(key).agg(
        F.first("source").alias("source"), F.sum("words").alias("source_size")
    )
    targets = source_targets(sizes, weights, share, limit).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias(key),
        "source_size",
        "target",
    )
    starts = (
        cells.select(key, cls, bucket, bucket_start.alias("bucket_start"))
        .join(classes, [key, cls])
        .join(targets, key)
        .select(
            key,
            cls,
            bucket,
            "source_size",
            "target",
            (F.col("class_start") + F.col("bucket_start")).alias(start),
        )
    )
    starts = stored(starts, "mix-starts")
    place_in_cell = F.row_number().over(
        W.partitionBy(key, cls, bucket).orderBy(order, doc_id, "size", F.xxhash64(*kept))
    )
    ranked = rows.join(starts, [key, cls, bucket]).withColumn(rank, place_in_cell)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit_hash(F.concat(F.lit(f"{seed}|"), F.col(key)))
    place = F.col(start) + F.col(rank)
    crossed = F.floor(offset + place * expected) - F.floor(offset + (place - 1) * expected)
    copies = F.least(crossed, F.ceil(expected)).cast("long")
    return ranked.select(
        *kept,
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, *, text: str = "text", **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the sampling emits it, columns unchanged."""
    holder = fresh(docs, "mix_row")
    packed = docs.select(
        F.struct(*docs.columns).alias(holder), *[docs[c] for c in _keys(docs, settings)], docs[text]
    )
    settings.setdefault("content", F.md5(whole(F.col(text))))
    drawn = with_copies(packed, word_count(F.col(text)), **settings).where("copies > 0")
    return drawn.select(
        F.explode(F.array_repeat(F.col(holder), F.col("copies").cast("int"))).alias(holder)
    ).select(f"{holder}.*")


def _keys(docs: DataFrame, settings: dict) -> list[str]:
    return [settings.get("doc_id", "doc_id"), settings.get("source", "source")]
