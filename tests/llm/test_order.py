"""Order of written files beyond five digits, and sizes of range shuffles."""

from trendscope.llm import mixing


def test_files_with_more_digits_come_later(spark, tmp_path):
    from pyspark.sql import functions as F
    names = ["part-00002-x", "part-99999-x", "part-100000-x", "part-100001-x", "part-10000-x"]
    for i, name in enumerate(names):
        spark.range(i * 10, i * 10 + 3, 1, 1).write.parquet(str(tmp_path / f"w{i}"))
        part = next((tmp_path / f"w{i}").glob("part-*.parquet"))
        (tmp_path / "t").mkdir(exist_ok=True)
        part.rename(tmp_path / "t" / f"{name}.parquet")
    rows = [r["id"] for r in mixing.in_file_order(spark.read.parquet(str(tmp_path / "t"))).collect()]
    assert rows == [i * 10 + k for i in (0, 4, 1, 2, 3) for k in range(3)]
    frame = spark.range(5).withColumn("x", F.lit(1))
    assert mixing.in_file_order(frame).columns == frame.columns


def test_range_partitions_follow_the_input(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert mixing.range_partitions(docs) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(mixing, "RANGE_BYTES", 10_000)
    assert mixing.range_partitions(docs) > 50
    monkeypatch.setattr(mixing, "MAX_RANGES", 60)
    assert mixing.range_partitions(docs) == 60
