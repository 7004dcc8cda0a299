"""The drift monitor on a stream of files."""

from pyspark.sql import functions as F

from schemaloom.streaming import drift


def test_new_atoms_are_reported(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", '{"a":1}'), ("2024-01-01 00:02:00", '{"a":"x"}'), ("2024-01-01 00:21:00", '{"a":1,"b":2}')]
    spark.createDataFrame(rows, "t string, j string").select(F.to_timestamp("t").alias("t"), "j").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, j string").parquet(str(tmp_path / "in"))
    query = drift.windowed_profile(stream, "t", "j", depth=2).writeStream.format("memory").queryName("profile").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    known = spark.createDataFrame([("", "object"), ("a", "int")], "path string, atom string")
    assert {(r.path, r.atom) for r in drift.drift(spark.table("profile"), known).collect()} == {("a", "str"), ("b", "int")}
