from lexispark.streaming import corpus as S


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one  two three\none two three\n1 2 3\nshort\n")
    rows = S.cleaned(S.read_lines(spark, str(tmp_path / "in")))
    S.write_parquet(rows, str(tmp_path / "all"), str(tmp_path / "c1")).awaitTermination(120)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "all")).collect()] == ["one two three"] * 2
    S.write_parquet(S.distinct(rows), str(tmp_path / "once"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 1
    counts = S.word_counts(rows).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).start()
    counts.processAllAvailable()
    counts.stop()
    assert {(r["token"], r["freq"]) for r in spark.sql("select * from counts").collect()} == {("one", 2), ("two", 2), ("three", 2)}
