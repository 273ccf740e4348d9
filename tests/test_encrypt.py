import pytest
from pyspark.sql import functions as F

from keysift.operators.encrypt import KEYS_PATH, MAX_KEYS, OVERHEAD, change_key, decrypt, encrypt_flagged, read_keys
from keysift.session import scratch_path
from tests.samples import FLAGGED, HARMLESS

KEYS = [("old", bytes(range(16))), ("new", bytes(range(100, 132)))]


@pytest.fixture
def keys(spark):
    path = scratch_path(spark, "keys")
    spark.createDataFrame(KEYS, "key_id string, key binary").write.parquet(path)
    spark.conf.set(KEYS_PATH, path)
    yield read_keys(spark)
    spark.conf.unset(KEYS_PATH)


def chat(spark):
    rows = list(enumerate([*FLAGGED, *HARMLESS, None, "", "password=ação😀ação😀"]))
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def plain(df):
    return {r.id: r.text for r in df.collect()}


@pytest.mark.parametrize("key_id", ["old", "new"])
@pytest.mark.parametrize("bind", [(), ("id",)])
def test_flagged_texts_open_again(spark, keys, key_id, bind):
    df = chat(spark)
    sealed = encrypt_flagged(df, keys, key_id, bind=bind)
    before = plain(df)
    flagged = {i for i, t in before.items() if t in FLAGGED or (t or "").startswith("password=")}
    stored = sealed.collect()
    assert len({bytes(r.sealed.sealed[:12]) for r in stored if r.sealed}) == len(flagged)
    for r in stored:
        if r.id in flagged:
            assert r.text is None and r.sealed.key_id == key_id
            assert len(r.sealed.sealed) == len(before[r.id].encode()) + OVERHEAD
            assert before[r.id].encode() not in bytes(r.sealed.sealed)
        else:
            assert r.sealed is None and r.text == before[r.id]
    opened = decrypt(spark.createDataFrame(stored, sealed.schema), keys, bind=bind)
    assert opened.columns == ["id", "text", "failed"]
    assert plain(opened) == before and opened.where("failed").isEmpty()


def test_what_was_changed_does_not_open(spark, keys):
    df = chat(spark).where("text IS NOT NULL AND id < 3")
    sealed = encrypt_flagged(df, keys, "new", bind=["id"])
    rows = spark.createDataFrame(sealed.collect(), sealed.schema)
    part = rows.select("id", "text", "sealed.*")

    def changed(column, value):
        renewed = part.withColumn(column, value)
        packed = renewed.select("id", "text", F.struct("key_id", "sealed").alias("sealed"))
        return [(r.text, r.failed) for r in decrypt(packed, keys, bind=["id"]).collect()]

    assert all(text and not failed for text, failed in changed("text", F.col("text")))
    head, tail = F.col("sealed").substr(1, 20), F.expr("substring(sealed, 22)")
    for column, value in [
        ("id", F.col("id") + 1),  # moved to another row
        ("key_id", F.lit("old")),  # under another key
        ("key_id", F.lit("lost")),  # a key that is not there
        ("sealed", F.concat(head, F.unhex(F.lit("ff00")), tail)),
        ("sealed", F.expr("substring(sealed, 1, 20)")),  # shorter than any sealed text
        ("sealed", F.unhex(F.lit(""))),
    ]:
        assert changed(column, value) == [(None, True)] * 3
    assert all(r.failed for r in decrypt(rows, keys, bind=[]).collect())


def test_change_of_key(spark, keys):
    df = chat(spark)
    sealed = encrypt_flagged(df, keys, "old")
    first = spark.createDataFrame(sealed.collect(), sealed.schema)
    renewed = change_key(first, keys, "new")
    assert renewed.columns == sealed.columns
    assert {r.sealed.key_id for r in renewed.collect() if r.sealed} == {"new"}
    only_new = keys.where("key_id = 'new'")
    assert plain(decrypt(renewed, only_new)) == plain(df)
    # Without the old key nothing is lost: what does not open stays under its key.
    left = change_key(first, only_new, "new")
    assert plain(decrypt(left, keys)) == plain(df)
    assert {r.sealed.key_id for r in left.collect() if r.sealed} == {"old"}
    again = change_key(first, keys, "old").collect()
    assert sorted(again, key=lambda r: r.id) == sorted(first.collect(), key=lambda r: r.id)


def test_no_key_in_a_plan(spark, keys):
    sealed = encrypt_flagged(chat(spark), keys, "new")
    for df in (sealed, decrypt(sealed, keys), change_key(sealed, keys, "old")):
        plan = df._jdf.queryExecution().toString()
        assert "aes" in plan
        for _, key in KEYS:
            assert key.hex() not in plan.lower() and str(list(key))[1:-1] not in plan


def test_key_tables_are_checked(spark, keys):
    df, schema = chat(spark), keys.schema
    for bad in ([("a", b"short")], [("a", bytes(16))] * 2, [(None, bytes(16))], [("a", None)]):
        with pytest.raises(ValueError):
            encrypt_flagged(df, spark.createDataFrame(bad, schema), "a")
    with pytest.raises(ValueError):
        many = [(str(i), bytes(16)) for i in range(MAX_KEYS + 1)]
        decrypt(df, spark.createDataFrame(many, schema))
    with pytest.raises(ValueError):
        encrypt_flagged(df, keys, "unknown")
    with pytest.raises(ValueError):
        encrypt_flagged(df, keys, "old", bind=["text"])
    spark.conf.unset(KEYS_PATH)
    with pytest.raises(ValueError):
        read_keys(spark)


def test_columns_of_any_name(spark, keys):
    names = ("row", "key", "key_id", "sealed", "plain", "hit", "failed")
    df = chat(spark).withColumns({c: F.lit(c) for c in names})
    sealed = encrypt_flagged(df, keys, "new")
    assert sealed.columns == [*df.columns, "sealed_"]
    opened = decrypt(sealed, keys, sealed="sealed_")
    assert opened.columns == [*df.columns, "failed_"]
    assert plain(opened) == plain(df)
    assert opened.select(*names).distinct().collect() == [names]
    assert encrypt_flagged(df.limit(0), keys, "new").count() == 0
