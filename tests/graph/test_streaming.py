from arcweave.streaming import edge_counts


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(1, 2, "A", "2024-01-01 00:00:10"), (1, 3, "A", "2024-01-01 00:04:00"), (2, 3, "B", "2024-01-01 00:06:00")]
    df = spark.createDataFrame(rows, "src long, dst long, type string, ts string").selectExpr("src", "dst", "type", "timestamp(ts) AS ts")
    df.write.parquet(str(tmp_path / "e"))
    stream = edge_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("edge_counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted(map(tuple, rows))
    assert key(spark.table("edge_counts").collect()) == key(edge_counts(df).collect()) and len(key(edge_counts(df).collect())) == 2
