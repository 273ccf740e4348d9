import pytest
from pyspark.sql import functions as F

from checks.queries import append_stream_query, detect_stream_query
from keysift.session import spread


def test_rows_of_one_row_group_are_spread_however_often_the_file_is_cut(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(20_000).select("id", F.repeat(F.uuid(), F.lit(3)).alias("text"))
    rows.coalesce(1).write.parquet(path)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= 8
        dealt = spread(scan, 8)
        counts = [row["count"] for row in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert sum(counts) == 20_000
    assert len(counts) >= 8 and max(counts) < 20_000 / 4


@pytest.mark.parametrize("files", [0, 3])
def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, files):
    chat = spark.range(30).select(
        F.col("id").alias("conv_id"), (F.col("id") % 3).alias("turn"), F.format_string("text %d", "id").alias("text")
    )
    path = tmp_path / "conversations.parquet"
    if files:
        chat.repartition(files).write.parquet(str(path))
    else:
        chat.toPandas().to_parquet(path)
    found = detect_stream_query(spark, str(tmp_path))
    assert {row.conv_id for row in found.collect()} == set(range(30))
    appended = append_stream_query(spark, str(tmp_path))
    assert sorted(row.text for row in appended.collect()) == sorted(f"text {i}" for i in range(30))
