"""Steps found on a stream, piece by piece."""

from gaugeworks.streaming.step_detector import detect_steps, split_ready


def test_split_ready():
    assert split_ready("- Step 1: a\n- Step 2: b") == (["- Step 1: a"], "- Step 2: b")
    assert split_ready("- Step 1: a\n<Answer>: 3") == (["- Step 1: a"], "<Answer>: 3")
    assert split_ready("- Step 1: gro") == ([], "- Step 1: gro")


def test_stream_of_pieces(spark, tmp_path):
    pieces = [(1, 0, "- Step 1: one"), (2, 0, "- Step 1: x"), (1, 1, " more\n- St"), (1, 2, "ep 2: two\n<Answer>: 5"), (2, 1, "yz")]
    for k, p in enumerate(pieces):
        spark.createDataFrame([p], "generation long, seq int, piece string").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema("generation long, seq int, piece string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    query = detect_steps(stream).writeStream.format("memory").queryName("steps").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r.generation, r.step, r.text) for r in spark.table("steps").collect())
    assert got == [(1, 0, "- Step 1: one more"), (1, 1, "- Step 2: two")]
