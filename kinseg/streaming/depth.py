"""Read depth over a stream of reads: the tumbling counts of the batch operator, with late reads bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinseg.functions.alignments import counted
from kinseg.operators.depth import SAMPLES, bin_of


def stream_counts(reads: DataFrame, window: int, time: str, delay: str, min_mapq: int) -> DataFrame:
    """window (an hour), chrom, bin, rd0..rd2."""
    counts = [F.sum(F.when(F.col("sample_idx") == i, 1).otherwise(0)).alias(c) for i, c in enumerate(SAMPLES)]
    kept = reads.filter(counted(min_mapq)).withWatermark(time, delay)
    return kept.groupBy(F.window(time, "1 hour"), "chrom", bin_of(F.col("start"), window).alias("bin")).agg(*counts)


def stream_depth(reads: DataFrame, window: int, time: str = "ts", delay: str = "1 hour", min_mapq: int = 0) -> DataFrame:
    """chrom, bin, rd0..rd2 per event-time hour of a streaming DataFrame of reads with an arrival time.

    State is one row per contig, bin and hour, dropped once the watermark passes.
    """
    hours = stream_counts(reads, window, time, delay, min_mapq)
    return hours.select(F.col("window.start").alias("hour"), "chrom", "bin", *SAMPLES)


#: Rows of a contig that are given out at a time.
GIVEN = 10_000


class ContigBins(StatefulProcessor):
    """Counts per occupied bin of one contig; once it has been quiet for `quiet` milliseconds, its bins in order without gaps."""

    def __init__(self, window: int, quiet: int):
        self.window, self.quiet = window, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "bin long", "rd0 long, rd1 long, rd2 long")
        self.ends = handle.getValueState("ends", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.ends.get()[0] if self.ends.exists() else 0
        latest = at
        for part in rows:
            for row in part.groupby("bin")[list(SAMPLES)].sum().itertuples():
                own = (int(row.Index),)
                before = self.counts.getValue(own) if self.counts.containsKey(own) else (0, 0, 0)
                self.counts.updateValue(own, tuple(int(b) + int(n) for b, n in zip(before, row[1:])))
            latest = max(latest, int(part["ms"].max()) + self.quiet)
        if latest > at:
            if at:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(latest)
            self.ends.update((latest,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = {int(k[0]): tuple(v) for k, v in self.counts.iterator()}
        first, last = min(found), max(found)
        self.counts.clear()
        self.ends.clear()
        for low in range(first, last, GIVEN):
            bins = range(low, min(low + GIVEN, last))
            counts = pd.DataFrame([found.get(b, (0, 0, 0)) for b in bins], columns=list(SAMPLES))
            places = {"chrom": key[0], "bin": bins, "start": [b * self.window + 1 for b in bins], "end": [(b + 1) * self.window for b in bins]}
            yield pd.concat([pd.DataFrame(places), counts], axis=1)

    def close(self) -> None:
        pass


def stream_windows(reads: DataFrame, window: int, time: str = "ts", delay: str = "1 hour", quiet_ms: int = 3_600_000, min_mapq: int = 0) -> DataFrame:
    """The rows of depth_windows(), in order of bins, of each contig of a streaming DataFrame that has been quiet for `quiet_ms`.

    Reads are counted per hour and bin first, in parallel over all contigs and places, so the state of a contig, a
    row per occupied bin, gets some rows per bin and hour. An event-time timer gives the contig out and clears it; reads that
    still come for it begin a stretch of their own. Needs the state store of RocksDB.
    """
    hours = stream_counts(reads, window, time, delay, min_mapq)
    rows = hours.select("chrom", "bin", *SAMPLES, F.unix_millis(F.window_time("window")).alias("ms"))
    schema = "chrom string, bin long, start long, end long, rd0 long, rd1 long, rd2 long"
    return rows.groupBy("chrom").transformWithStateInPandas(ContigBins(window, quiet_ms), schema, "Append", "EventTime")
