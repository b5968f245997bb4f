from folioforge.streaming import memory


def test_memory_keeps_the_last_entries(spark, tmp_path):
    rows = [("s", k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(40)] + [("u", 0, "user", " "), ("u", 1, "user", "x")]
    spark.createDataFrame(rows, "session string, ord long, role string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, ord long, role string, text string").parquet(str(tmp_path / "in"))
    query = memory.remembered(stream).writeStream.format("memory").queryName("remembered").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.session, r.ord): r for r in spark.table("remembered").collect()}
    assert got["s", 0].n_history == 0 and got["s", 39].n_history == 30 and got["s", 39].last_query == "t38"
    assert got["u", 1].last_query is None
