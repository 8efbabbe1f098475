from cashtrail.session import configure


def test_shuffled_partitions_merge_up_to_a_size_that_a_task_can_sort(spark):
    """64 MB of shuffled transfers became over 1 GB of sorted and hashed rows in one task."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64MB")
        assert configure(spark).conf.get(key) == "16MB"
    finally:
        spark.conf.set(key, before)
