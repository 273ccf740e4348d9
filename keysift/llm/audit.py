"""Which filter removes what: every order of a few filters, from relations of failing ids.

Each filter has one table of the documents that fail it, and nothing else is read after that. For a set of
filters already applied, the documents that one more filter removes are its failing ones left-anti joined
with the failing ones of the set; those it would have removed, had they not gone before, are left-semi
joined. Sets grow by one filter a level, in the order of their letters, and all sets of a size are joined
at once: as many joins as there are filters, not one per order. Losses of labelled documents are flags,
set by left-semi joins of each failing table with the ids of the label.

Rows equal in id, text, part and label are one row with a count, and so are never gathered. A document is a
row of the table: repeated rows count each. Labels count a document as soon as one of their rows has it.
Null texts are empty, null parts are the empty part; a null id has no label and no smaller or greater id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keysift.llm.common import SPACE, stored, whole
from keysift.session import scratch_path

SYMBOLS = "#$%&*|"
SALTS = 16
KEY = ["k1", "k2"]


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions over a text that is not null: the audit's own filters A to D."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": distinct * 100 < n * 80,
        "C": upper.cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike(f"[{SYMBOLS}]"),
    }


def failing(
    docs: DataFrame,
    filters: Mapping[str, Column],
    copies: str | None = "E",
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """``(filter, doc, k1, k2, part, n)``, one table per filter, and ``(part, total)``. ``k1`` and ``k2`` name
    a row by id and text.

    ``filters`` are conditions over the columns of ``docs``; null is not failing. ``copies`` names the filter
    that a text fails if a smaller id has the same text, whether or not that is removed.
    """
    value = whole(F.col(text))
    flags = [F.coalesce(f, F.lit(False)).alias(f"f{k}") for k, f in enumerate(filters.values())]
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc"),
        F.xxhash64(value).alias("t1"),
        F.xxhash64(F.lit(1), value).alias("t2"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        *flags,
    )
    # Filters are functions of a row: rows equal in all that is kept count together from here on.
    same = ["doc", "t1", "t2", "part", *[f"f{k}" for k in range(len(flags))]]
    rows = stored(rows.groupBy(*same).agg(F.count("*").alias("n")), "audit-rows")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    failed = [F.when(F.col(f"f{k}"), F.lit(name)) for k, name in enumerate(filters)]
    if copies is not None:
        texts = rows.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        # A text of very many copies: its first id is looked up in several tasks.
        salted = texts.where("first < last").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        )
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, ["t1", "t2", "salt"], "left")
        failed.append(F.when(F.col("doc") > F.col("first"), F.lit(copies)))
    tables = rows.select(
        F.explode(F.array_compact(F.array(*failed))).alias("filter"),
        "doc",
        F.xxhash64("doc", "t1", "t2").alias("k1"),
        F.xxhash64(F.lit(1), "doc", "t1", "t2").alias("k2"),
        "part",
        "n",
    )
    path = scratch_path(docs.sparkSession, "audit-failing")
    tables.write.partitionBy("filter").parquet(path)
    schema = "doc long, k1 long, k2 long, part string, n long, filter string"
    return docs.sparkSession.read.schema(schema).parquet(path), totals


def flagged(failed: DataFrame, labels: Mapping[str, DataFrame]) -> DataFrame:
    """``failed`` with a boolean per label: whether the document's id is among those of the label."""
    for name, ids in labels.items():
        ids = ids.select(F.col(ids.columns[0]).cast("long").alias("doc")).distinct()
        hit = failed.join(ids, "doc", "left_semi").withColumn(name, F.lit(True))
        rest = failed.join(ids, "doc", "left_anti").withColumn(name, F.lit(False))
        failed = hit.unionByName(rest)
    return failed


def prefixes(failed: DataFrame, letters: str, labels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(filter, before, part, removed, <label>_lost ...)``: per filter and set of filters before it, in the
    order of letters, what it removes; and ``(filter, before, part, newly)``: of those that fail ``filter``,
    how many the last letter of ``before`` removes that the others of ``before`` let through.

    A level joins what all sets of a size let through to all filters with the failing ids of one more.
    """
    rows = failed.select("filter", F.lit("").alias("before"), *KEY, "part", "n", *labels)
    others = failed.select(F.col("filter").alias("next"), *KEY).distinct()
    by = ["filter", "before", "part"]
    measures = [F.sum("n").alias("removed")] + [
        F.sum(F.when(F.col(label), F.col("n")).otherwise(0)).alias(f"{label}_lost") for label in labels
    ]
    removed, redundant = [rows.groupBy(*by).agg(*measures)], []
    every = F.array(*[F.lit(x) for x in sorted(letters)])
    for _ in range(len(letters) - 1):
        ahead = F.filter(every, lambda x: (x != F.col("filter")) & (x > F.substring("before", -1, 1)))
        tried = rows.withColumn("next", F.explode(ahead))
        tried = tried.withColumn("before", F.concat("before", "next"))
        caught = tried.join(others, ["next", *KEY], "left_semi")
        redundant.append(caught.groupBy(*by).agg(F.sum("n").alias("newly")))
        rows = stored(tried.join(others, ["next", *KEY], "left_anti").drop("next"), "audit-prefix")
        removed.append(rows.groupBy(*by).agg(*measures))
    none = failed.limit(0).select("filter", F.lit("").alias("before"), "part", F.col("n").alias("newly"))
    return reduce(DataFrame.unionByName, removed), reduce(DataFrame.unionByName, redundant, none)


def audit(
    docs: DataFrame,
    labels: Mapping[str, DataFrame],
    filters: Mapping[str, Column],
    copies: str | None = "E",
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """Per part, order of the filters and step: ``part``, ``filter_order``, ``step``, ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, ``shapley`` and ``<label>_lost`` per label.

    Names of filters are single characters, six at most with ``copies``: there is a row for each step of
    each order. ``labels`` are tables of ids. A part without documents that fail has its rows, of zeros.
    """
    letters = "".join(filters) + (copies or "")
    if len(set(letters)) != len(filters) + bool(copies) or not 0 < len(letters) <= 6:
        raise ValueError("filters must be one to six, each named by one character of its own")
    failed, totals = failing(docs, filters, copies, doc_id, text, part)
    if labels:
        failed = stored(flagged(failed, labels), "audit-flagged")
    removed, redundant = prefixes(failed, letters, list(labels))
    orders = ["".join(order) for order in permutations(sorted(letters))]
    steps = totals.select("part", "total", F.explode(F.lit(orders)).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    earlier = F.split(F.expr("substring(filter_order, 1, step - 1)"), "")
    steps = steps.withColumns(
        {
            "filter": F.expr("substring(filter_order, step, 1)"),
            "before": F.array_join(F.array_sort(earlier), ""),
        }
    )
    sets = steps.select("part", "filter", "before").distinct()
    # What a set removes of a filter's failing ones is what its letters do, one after the other.
    growing = F.explode(F.transform(F.sequence(F.lit(1), F.length("before")), lambda k: F.substring("before", 1, k)))
    led = sets.where("before != ''").withColumn("led", growing)
    newly = redundant.withColumnRenamed("before", "led")
    summed = led.join(newly, ["part", "filter", "led"]).groupBy("part", "filter", "before")
    summed = summed.agg(F.sum("newly").alias("redundant"))
    alone = removed.where(F.length("before") == len(letters) - 1)
    alone = alone.select("part", "filter", F.col("removed").alias("unique_fails"))
    on = ["part", "filter", "before"]
    rows = steps.join(removed, on, "left").join(summed, on, "left").join(alone, ["part", "filter"], "left")
    rows = rows.na.fill(0, ["removed", "redundant", "unique_fails", *[f"{x}_lost" for x in labels]])
    so_far = F.sum("removed").over(W.partitionBy("part", "filter_order").orderBy("step"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - so_far).alias("kept"),
        "removed",
        "redundant",
        "unique_fails",
        F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"),
        *[f"{x}_lost" for x in labels],
    )
