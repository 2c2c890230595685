"""Shuffle settings that follow the input."""

from trendscope import session


def test_partitions_follow_the_input(spark):
    """More input raises the partitions that exchanges begin with; what was set is left alone where it is enough."""
    key, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "200")
    own.conf.unset(size)
    session.size_shuffles(own, 16 << 20)
    assert own.conf.get(key, None) is None
    was = own.conf.get(size)
    session.size_shuffles(own, 6 << 30)
    assert (own.conf.get(key), own.conf.get(size)) == ("384", was)
    session.size_shuffles(own, 1 << 30)
    assert own.conf.get(key) == "384"
    own.conf.set(size, "100m")
    session.size_shuffles(own, 12 << 30)
    assert (own.conf.get(key), own.conf.get(size)) == ("768", "100m")
