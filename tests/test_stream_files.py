from pyspark.sql import functions as F

from evalscale.run_queries import _dealt, _stream


def test_a_batch_of_many_rows_is_dealt_to_as_many_files_as_the_others(spark, tmp_path):
    rows = spark.range(4000).withColumn("b", F.col("id") % 4)
    files = _dealt(rows, f"{tmp_path}/in", F.col("b"), file_rows=300)
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/in").groupBy(F.input_file_name()).count().collect()]
    assert files == 4 and len(sizes) == 16 and max(sizes) <= 300
    seen = []
    _stream(spark, f"{tmp_path}/in", files).writeStream.foreachBatch(lambda b, n: seen.append(sorted({r.b for r in b.collect()}))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == [[0], [1], [2], [3]]
