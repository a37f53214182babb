from pyspark.sql import functions as F

from opsmetrics import checkpoint_dir


def test_checkpoint_dir_is_kept_once_set(spark):
    first = checkpoint_dir(spark)
    assert first and checkpoint_dir(spark) == first
    df = spark.range(10).withColumn("x", F.col("id") * 2).checkpoint(eager=True)
    assert df.count() == 10


def test_cluster_settings_scale_with_cores_and_volume():
    from opsmetrics import cluster_settings

    small = cluster_settings(8)
    assert small["spark.sql.shuffle.partitions"] == "24"
    big = cluster_settings(8000, shuffle_bytes=20 * 1024**4)
    assert int(big["spark.sql.shuffle.partitions"]) == 20 * 1024**4 // (256 * 1024**2)
    assert big["spark.sql.files.maxPartitionBytes"] == str(512 * 1024**2)
