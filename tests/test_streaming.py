from metaloom.streaming import incremental as S


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_windows_sessions_and_resume(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{m:02d}:00", "u" if i % 2 else "v", 1.0) for i, m in enumerate([0, 1, 2, 3, 30, 31, 59])]
    e = spark.createDataFrame(rows, "id long, ts string, user string, value double").selectExpr("id", "cast(ts as timestamp) ts", "user", "value")
    e.write.parquet(str(tmp_path / "in"))
    s = lambda: S.follow(spark, str(tmp_path / "in"), e.schema)
    w = run(S.windowed(s(), "ts", "1 hour", "10 minutes", None, []), "w1", "complete")
    assert sorted(r.n for r in w) == [1, 2, 4]
    assert sum(r.n for r in run(S.sessions(s(), "ts", "1 hour", "5 minutes", ["user"]), "w2", "complete")) == 7
    twice = S.follow(spark, str(tmp_path / "in"), e.schema)
    assert len(run(S.once(twice, ["user"], "ts", "1 hour"), "w3")) == 2
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    S.append_unseen(s(), out, ["id"], ck).awaitTermination()
    assert spark.read.parquet(out).count() == 7
    e.limit(3).write.mode("append").parquet(str(tmp_path / "in"))
    S.append_unseen(s(), out, ["id"], ck).awaitTermination()
    assert spark.read.parquet(out).count() == 7
