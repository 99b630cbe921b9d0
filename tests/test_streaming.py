from pyspark.sql import functions as F

from folioforge.streaming.extensions import first_requests, stage_counts


def run(spark, stream, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql("SELECT * FROM out").collect()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a  b", "x"), (2, "a b", "x"), (3, "c", "y")], "id long, text string, event_type string").withColumn("ts", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assert len(run(spark, first_requests(stream), "append")) == 2
    assert sorted((r["event_type"], r["events"]) for r in run(spark, stage_counts(stream), "complete")) == [("x", 2), ("y", 1)]
