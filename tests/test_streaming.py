from posemill.streaming import deliveries as D


def test_windows_and_best(spark, tmp_path):
    rows = [("a", -1.0, 1, "2025-01-01 00:00:00"), ("a", -3.0, 2, "2025-01-01 05:00:00"), ("b", None, 3, "2025-01-02 00:00:00"), ("a", -3.0, 2, "2025-01-02 01:00:00")]
    df = spark.createDataFrame(rows, "v string, score double, pose int, at string").selectExpr("v", "score", "pose", "cast(at as timestamp) at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = D.score_stream(spark, str(tmp_path / "in"), df.schema)
    for name, out, mode in (("counts", D.delivery_counts(stream, "at", ["v"]), "complete"), ("best", D.running_best(stream, ["v"], "score", ["pose"]), "complete"), ("once", D.first_deliveries(stream, ["v", "pose"], "at"), "append")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("counts").count() == 3 and spark.table("counts").where("v = 'b'").first()["n_scored"] == 0
    assert [(r["v"], r["score"], r["pose"]) for r in spark.table("best").collect()] == [("a", -3.0, 2)]
    assert spark.table("once").count() == 3
