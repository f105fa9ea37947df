from lychnos.streaming.messages import CHUNKS, message_log, run_on


def test_pieces_in_any_order_and_open_messages(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, 1, 1, "b", True), (2, 1, 0, "never", False)], CHUNKS).write.parquet(str(src / "a"))
    spark.createDataFrame([(1, 1, 0, "a", False), (3, 1, 0, None, True)], CHUNKS).write.parquet(str(src / "b"))
    stream = spark.readStream.schema(CHUNKS).parquet(str(src / "*"))
    q = message_log(stream).writeStream.outputMode("complete").format("memory").queryName("said").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.conv_id, r.text) for r in spark.table("said").collect()) == [(1, "ab"), (3, "")]

    q = run_on(spark.readStream.schema(CHUNKS).parquet(str(src / "*")), lambda b: b.select("conv_id"), str(out), str(tmp_path / "state")).start()
    q.awaitTermination()
    assert spark.read.parquet(str(out)).count() == 4
