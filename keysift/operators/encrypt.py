"""Authenticated encryption of flagged texts: AES-GCM, keys from a table, the key's id beside the text.

Keys are a table ``(key_id STRING, key BINARY)`` that is read where it is used: a key is never a literal
of a plan, so neither ``explain`` nor an event log shows one. The setting ``keysift.keys.path`` names the
table's place for a session. The table is small, checked to have at most ``MAX_KEYS`` rows, and broadcast.

Each text has its own random 12 bytes at the start and 16 bytes at the end that authenticate the text, the
key's id and, if asked for, columns of the row: a text moved to another row or under another key's id does
not open. Random bytes differ from run to run; what comes out of ``decrypt`` does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.operators.detect import matches_any_rule
from keysift.operators.keyed import unused
from keysift.operators.rules import as_rules, check_rules

KEYS_PATH = "keysift.keys.path"
KEY_SCHEMA = "key_id STRING, key BINARY"
MAX_KEYS = 1000
# Bytes that encryption adds to a text: the random ones and the authentication tag.
OVERHEAD = 12 + 16


def read_keys(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The key table at ``path``, or where the session's setting says."""
    path = path or spark.conf.get(KEYS_PATH, None)
    if path is None:
        raise ValueError(f"name a key table, or set {KEYS_PATH}")
    return spark.read.schema(KEY_SCHEMA).parquet(path)


def _checked(keys: DataFrame) -> DataFrame:
    """``keys`` if their ids differ and each has 16, 24 or 32 bytes. Only counts reach the driver."""
    usable = F.coalesce(F.octet_length("key").isin(16, 24, 32) & F.col("key_id").isNotNull(), F.lit(False))
    counts = keys.agg(
        F.count("*").alias("n"), F.count_distinct("key_id").alias("ids"), F.count_if(usable).alias("good")
    ).first()
    if counts.n > MAX_KEYS:
        raise ValueError(f"a key table has {MAX_KEYS} rows at most")
    if counts.ids != counts.n or counts.good != counts.n:
        raise ValueError("keys need ids that differ, and 16, 24 or 32 bytes each")
    return keys.select("key_id", "key")


def _bound(key_id: Column, bind: Sequence[str]) -> Column:
    """What is authenticated beside the text: the key's id and columns of the row, each with its length,
    so that no two rows read alike."""
    parts = [key_id, *[F.col("row")[c].cast("string") for c in bind]]
    marked = [
        F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p))
        for p in parts
    ]
    return F.encode(F.concat(*marked), "UTF-8")


def _packed(df: DataFrame) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def _seal(rows: DataFrame, keys: DataFrame, bind: Sequence[str]) -> DataFrame:
    """``rows`` of ``(row, key_id, plain)`` to those of ``(row, key_id, sealed)``; null stays null."""
    joined = rows.join(F.broadcast(keys), "key_id", "left")
    sealed = F.aes_encrypt(
        F.encode("plain", "UTF-8"),
        F.col("key"),
        F.lit("GCM"),
        F.lit("DEFAULT"),
        F.lit(b""),
        _bound(F.col("key_id"), bind),
    )
    return joined.select("row", "key_id", F.when(F.col("plain").isNotNull(), sealed).alias("sealed"))


def _open(rows: DataFrame, keys: DataFrame, bind: Sequence[str]) -> DataFrame:
    """``rows`` of ``(row, key_id, sealed)`` with ``plain``: null where the key is missing or the text, the
    key's id or a bound column is not what was sealed."""
    joined = rows.join(F.broadcast(keys), "key_id", "left")
    opened = F.try_aes_decrypt(
        F.col("sealed"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), _bound(F.col("key_id"), bind)
    )
    plain = F.when(F.octet_length("sealed") >= OVERHEAD, opened.cast("string"))
    return joined.select(*rows.columns, plain.alias("plain"))


def encrypt_flagged(
    df: DataFrame,
    keys: DataFrame,
    key_id: str,
    text: str = "text",
    rules=None,
    bind: Sequence[str] = (),
    out: str = "sealed",
) -> DataFrame:
    """Replace each text that a rule matches by null and add ``out``: a struct ``(key_id, sealed)``, null
    for all other rows. ``bind`` names columns that are authenticated with the text, such as its id; they
    must not change while the text is sealed, and not be ``text`` itself."""
    if text in bind:
        raise ValueError("the text itself cannot be bound, as it is replaced")
    keys, rules, out = _checked(keys), as_rules(rules), unused(df, out)
    check_rules(df.sparkSession, rules)
    if keys.where(F.col("key_id") == key_id).isEmpty():
        raise ValueError(f"no key has the id {key_id!r}")
    hit = F.coalesce(matches_any_rule(F.col("row")[text], rules), F.lit(False))
    marked = _packed(df).withColumn("hit", hit)
    plain = F.when(F.col("hit"), F.col("row")[text])
    rows = marked.select("row", F.when(F.col("hit"), F.lit(key_id)).alias("key_id"), plain.alias("plain"))
    sealed = _seal(rows, keys, bind)
    flagged = F.col("key_id").isNotNull()
    columns = [
        (F.when(~flagged, F.col("row")[c]) if c == text else F.col("row")[c]).alias(c) for c in df.columns
    ]
    result = F.when(flagged, F.struct("key_id", "sealed"))
    return sealed.select(*columns, result.alias(out))


def decrypt(
    df: DataFrame,
    keys: DataFrame,
    text: str = "text",
    sealed: str = "sealed",
    bind: Sequence[str] = (),
    failed: str = "failed",
) -> DataFrame:
    """Put sealed texts back and drop ``sealed``. ``failed`` tells rows that do not open: their key is
    missing, or the text, the key's id or a bound column has changed. Their text stays null."""
    keys = _checked(keys)
    rows = _packed(df)
    column = F.col("row")[sealed]
    rows = rows.select("row", column["key_id"].alias("key_id"), column["sealed"].alias("sealed"))
    opened = _open(rows, keys, bind)
    names = [c for c in df.columns if c != sealed]
    columns = [
        (F.coalesce("plain", F.col("row")[c]) if c == text else F.col("row")[c]).alias(c) for c in names
    ]
    broken = F.col("sealed").isNotNull() & F.col("plain").isNull()
    return opened.select(*columns, broken.alias(unused(df.select(*names), failed)))


def change_key(
    df: DataFrame, keys: DataFrame, key_id: str, sealed: str = "sealed", bind: Sequence[str] = ()
) -> DataFrame:
    """Seal anew, under ``key_id``, all texts that are under another key; no text is written in the clear.
    What does not open stays as it is, so that nothing is lost with a key that is missing."""
    keys = _checked(keys)
    if keys.where(F.col("key_id") == key_id).isEmpty():
        raise ValueError(f"no key has the id {key_id!r}")
    column = F.col("row")[sealed]
    rows = _packed(df).select("row", column["key_id"].alias("key_id"), column["sealed"].alias("sealed"))
    stale = F.when(F.col("key_id") != key_id, F.col("sealed"))
    opened = _open(rows.withColumn("sealed", stale), keys, bind).select("row", "plain")
    renewed = _seal(opened.withColumn("key_id", F.when(F.col("plain").isNotNull(), F.lit(key_id))), keys, bind)
    result = F.when(F.col("sealed").isNotNull(), F.struct("key_id", "sealed")).otherwise(F.col("row")[sealed])
    columns = [(result if c == sealed else F.col("row")[c]).alias(c) for c in df.columns]
    return renewed.select(*columns)
