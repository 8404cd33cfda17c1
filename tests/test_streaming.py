"""Read depth over files that arrive one after another, some of them late."""

from kinseg.operators.depth import depth_windows
from kinseg.streaming.depth import stream_depth, stream_windows

SCHEMA = "chrom string, sample_idx int, start long, flag int, mapq int, ts timestamp"


def test_counts_of_a_stream_are_those_of_all_files_in_time(spark, tmp_path):
    """Reads within the watermark count, whatever file brings them; later ones do not."""
    hour = "2024-01-01 {:02d}:30:00"
    files = [
        [("1", 0, 5, 0, 60, hour.format(1)), ("1", 1, 15, 0, 60, hour.format(1)), ("1", 0, 6, 1024, 60, hour.format(1))],
        [("1", 0, 7, 0, 60, hour.format(2)), ("2", 2, 7, 0, 60, hour.format(2))],
        [("1", 0, 8, 0, 60, hour.format(1)), ("2", 2, 3, 0, 60, hour.format(9))],  # late, but within two hours of what was seen
        [("1", 2, 9, 0, 60, hour.format(1)), ("2", 0, 1, 0, 60, hour.format(20))],  # too late
    ]
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).selectExpr("* except (ts)", "cast(ts as timestamp) AS ts")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream_depth(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 10, delay="2 hours").writeStream
        query = query.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.hour.hour, r.chrom, r.bin, r.rd0, r.rd1, r.rd2) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "1", 0, 2, 0, 0), (1, "1", 1, 0, 1, 0), (2, "1", 0, 1, 0, 0), (2, "2", 0, 0, 0, 1), (9, "2", 0, 0, 0, 1)]


def test_contigs_gone_quiet_are_given_out_without_gaps(spark, tmp_path):
    """Contigs over several files, some reads late but in time, bins without reads; equal to the batch operator on the same reads."""
    hour = "2024-01-01 {:02d}:30:00"
    reads = lambda chrom, places, at: [(chrom, i % 3, p, 0, 60, hour.format(at)) for i, p in enumerate(places)]
    files = [
        reads("1", [5, 15, 95, 6], 1) + reads("2", [501, 33], 1),
        reads("1", [7, 240], 2),
        reads("1", [8, 131], 1) + reads("2", [77], 2),  # late, but within two hours of what was seen
        reads("3", [1, 25], 10),
        reads("4", [1], 18),
        reads("4", [2], 23),
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in files:
            df = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).selectExpr("* except (ts)", "cast(ts as timestamp) AS ts")
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            made = stream_windows(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 10, delay="2 hours", quiet_ms=3 * 3_600_000)
            query = made.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    names = ["chrom", "bin", "start", "end", "rd0", "rd1", "rd2"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*names).collect())
    want = depth_windows(spark.createDataFrame([r[:5] for rows in files for r in rows], SCHEMA.rsplit(",", 1)[0]).filter("chrom <= '3'"), 10)
    assert got == sorted(tuple(r) for r in want.select(*names).collect())
    assert {r[0] for r in got} == {"1", "2", "3"} and len(got) > 70
