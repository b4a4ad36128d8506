from textloom.streaming.profile import first_seen, ledger_sink, running_statistics, stream_of


def test_running_statistics(spark, tmp_path):
    df = spark.createDataFrame([("en", "a b"), ("en", None), ("de", "xyz")], "lang string, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = running_statistics(stream_of(spark, str(tmp_path / "in"), df), "text", "lang")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    got = {r.lang: (r.n_rows, r.n_missing, r.chars, r.words) for r in spark.table("running").collect()}
    assert got == {"en": (2, 1, 3, 2), "de": (1, 0, 3, 1)}


def test_first_seen(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:00:00', 'A  b'), (timestamp'2024-01-01 00:01:00', 'a b'), (timestamp'2024-01-01 00:02:00', 'c') AS t(ts, text)")
    df.write.parquet(str(tmp_path / "in"))
    q = first_seen(stream_of(spark, str(tmp_path / "in"), df), "text", "ts", "1 hour").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2


def test_ledger_sink(spark, tmp_path):
    ledger_sink(str(tmp_path / "l"))(spark.createDataFrame([("e",)], "experiment_id string"), 0)
    assert spark.read.option("header", True).csv(str(tmp_path / "l")).count() == 1
