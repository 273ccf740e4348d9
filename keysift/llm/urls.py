"""URL filters by hashed expressions.

Every rule is a host and a path prefix. A URL is expanded into the expressions a rule could have
(suffixes of its host by label, prefixes of its path), each expression is hashed, an equi-join on the
first bytes of the hash finds candidates, the whole digest confirms them, and the longest confirmed
rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import ascii_lower, stored, whole
from keysift.operators.keyed import lookup

PREFIX_HEX = 8  # four bytes of the digest
BROADCAST_RULES = 100_000
SALTS = 64

# Contract of the query: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #``, A-Z lowered; empty where there is none."""
    return ascii_lower(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #``."""
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def compile_rules(rules: DataFrame) -> DataFrame:
    """``(host, path, verdict)`` to one row per expression, with its digest and shape.

    Hosts are lowered; rows with a null are left out. Of equal rules that disagree, block wins.
    """
    host, path = ascii_lower(F.col("host")), F.col("path")
    return (
        rules.dropna(subset=["host", "path", "verdict"])
        .select(F.concat(host, path).alias("rule"), host.alias("h"), path.alias("p"), "verdict")
        .groupBy("rule", "h", "p")
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(
            F.sha2(F.concat("h", F.lit("\n"), "p"), 256).alias("digest"),
            "rule",
            "rule_verdict",
            F.size(F.split("h", r"\.", -1)).alias("labels"),
            F.length("p").alias("path_length"),
            F.length("h").alias("host_length"),
        )
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )


def expressions(host: Column, path: Column, shapes: dict[int, list[int]]) -> Column:
    """Digests of the expressions of a URL, of the given shapes: host labels to lengths of path.

    Only shapes that some rule has are spelled out, so a long URL has no more than a short one.
    """
    n_labels, n_path = F.size(F.split(host, r"\.", -1)), F.length(path)
    made = [
        F.when(
            (n_labels >= labels) & (n_path >= length),
            F.concat(
                F.substring_index(host, ".", -labels), F.lit("\n"), F.substring(path, 1, length)
            ),
        )
        for labels, lengths in sorted(shapes.items())
        for length in sorted(lengths)
    ]
    none = F.array().cast("array<string>")
    return F.array_compact(F.array(*made)) if made else none


def judge(
    pages: DataFrame,
    rules: DataFrame,
    *,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: key, url, ``host``, ``path``, ``rule``, ``verdict``.

    ``rule`` is the longest that fits, the longer host first among equals; null if none fits, and
    ``default`` decides then. A null URL, or one without ``://``, has empty host and path. Repeated
    rows come back as often as they occur, a null key is a key, other columns play no part. No rules
    or no pages are no special case.

    Each distinct host and path is judged once, with the number of its pages; verdicts are then looked
    up by the pages. A host and path with over a thousandth of all pages is looked up where the pages
    lie, so that no group of equal pages meets in one task.

    What reaches the driver is the set of shapes, a few numbers however many rules there are.
    The rules are broadcast up to ``BROADCAST_RULES`` rows, by count. Beyond, they are copied to
    ``SALTS`` salts, so that paths which share a host do not meet in one task.
    """
    compiled = stored(compile_rules(rules), "url-rules")
    n_rules = compiled.count()
    shapes: dict[int, list[int]] = {}
    for row in compiled.select("labels", "path_length").distinct().collect():
        shapes.setdefault(row.labels, []).append(row.path_length)
    parts = pages.select(
        F.col(key).alias("key"),
        F.col(url).alias("url"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    # A host has no slash, and what follows it is empty or begins with one: the two can be told apart.
    parts = parts.withColumn("spot", F.concat("host", "path"))
    spots = parts.groupBy("spot", "host", "path").agg(F.count("*").alias("pages"))
    digests = F.transform(
        expressions(F.col("host"), F.col("path"), shapes), lambda x: F.sha2(x, 256)
    )
    probes = spots.withColumn("probe", F.explode_outer(digests)).withColumn(
        "prefix", F.substring("probe", 1, PREFIX_HEX)
    )
    found = compiled.select("prefix", "digest", "rule", "rule_verdict", "host_length")
    if n_rules <= BROADCAST_RULES:
        joined = probes.join(F.broadcast(found), "prefix", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salt = F.pmod(F.xxhash64("spot", "probe"), F.lit(SALTS)).cast("int")
        joined = probes.withColumn("salt", salt).join(
            found.withColumn("salt", salts), ["prefix", "salt"], "left"
        )
    confirmed = F.when(
        F.col("probe") == F.col("digest"),
        F.struct(
            F.length("rule").alias("length"),
            "host_length",
            F.col("rule_verdict").alias("verdict"),
            "rule",
        ),
    )
    best = joined.groupBy("spot").agg(
        F.max(confirmed).alias("best"), F.first("pages").alias("pages")
    )
    judged = lookup(parts, stored(best, "url-verdicts"), "spot", "pages", F.lit(True))
    return judged.select(
        F.col("key").alias(key),
        F.col("url").alias(url),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
