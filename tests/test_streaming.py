"""Streaming windows: all lines once, a repeated batch leaves no second copy."""

from bytespan.streaming import tagging


def test_windows_of_arriving_lines(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a").write_text("x" * 200 + "\nshort\n")
    for _ in range(2):   # nothing new arrives the second time
        q = tagging.start_window_sink(tagging.stream_windows(spark, str(src)), str(out), str(tmp_path / "ck"))
        q.awaitTermination(120)
    rows = spark.read.parquet(str(out)).collect()
    assert sorted((r.win, r.n) for r in rows) == [(0, 5), (0, 150), (1, 125)]
