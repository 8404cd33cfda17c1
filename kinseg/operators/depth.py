"""Windowed read depth, GC content and mappability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinseg.functions.alignments import CONTIGS, counted
from kinseg.operators.relops import dense_bins, overlap_join

MIN_GC, MAX_GC, MAX_N = 30, 70, 10
SAMPLES = ("rd0", "rd1", "rd2")


def bin_of(position: Column, window: int) -> Column:
    return F.floor((position - 1) / window)


def depth_windows(reads: DataFrame, window: int, min_mapq: int = 0, contigs: str | None = CONTIGS) -> DataFrame:
    """chrom, bin, start, end, rd0..rd2: reads of each sample by alignment start.

    Every bin from a contig's first to before its last occupied one is there; the
    last occupied bin is not, as it only closes the one before. Counting combines
    on the map side, so a contig of any depth sends one row per bin and task.
    """
    kept = reads.filter(counted(min_mapq))
    if contigs:
        kept = kept.filter(F.col("chrom").rlike(contigs))
    counts = kept.groupBy("chrom", bin_of(F.col("start"), window).alias("bin")).agg(*(F.count_if(F.col("sample_idx") == i).alias(c) for i, c in enumerate(SAMPLES)))
    filled = dense_bins(counts, ["chrom"], "bin", dict.fromkeys(SAMPLES, 0))
    return filled.select("chrom", "bin", (F.col("bin") * window + 1).alias("start"), ((F.col("bin") + 1) * window).alias("end"), *SAMPLES)


def gc_percent(bases: Column) -> Column:
    """Whole percent of G and C; -1 with ten N or more. Lower-case bases count as neither."""
    n = lambda c: F.length(bases) - F.length(F.replace(bases, F.lit(c), F.lit("")))
    share = F.floor(100 * (n("G") + n("C")) / F.length(bases)).cast("int")
    return F.when(n("N") >= MAX_N, -1).when(F.length(bases) == 0, -1).otherwise(share)


def gc_windows(reference: DataFrame, window: int) -> DataFrame:
    """chrom, bin, gc from chunks (chrom, chunk_start, bases); a window's bases lie one to the right of its reads' positions.

    Chunks may have any length: their pieces per window are put together in order.
    """
    first = F.greatest((F.col("chunk_start") - 2).cast("long"), F.lit(0))
    last = F.col("chunk_start") + F.length("bases") - 3
    cut = reference.filter(last >= 0).withColumn("bin", F.explode(F.sequence(F.floor(first / window), F.floor(last / window))))
    begin = F.greatest(F.col("bin") * window + 2 - F.col("chunk_start"), F.lit(0))
    stop = (F.col("bin") + 1) * window + 2 - F.col("chunk_start")
    piece = F.substring("bases", (begin + 1).cast("int"), (stop - begin).cast("int"))
    parts = cut.select("chrom", "bin", F.struct("chunk_start", piece.alias("piece")).alias("p")).groupBy("chrom", "bin").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return parts.select("chrom", "bin", gc_percent(F.array_join(F.transform("ps", lambda p: p["piece"]), "")).alias("gc"))


def bin_mean_signal(signal: DataFrame, window: int, flush_last: bool = False) -> DataFrame:
    """chrom, bin, mappability: mean of a signal (chrom, start0, end0, value) over each window, uncovered bases 0.

    The last touched bin of a contig stays 0 unless flush_last.
    """
    cut = signal.filter("end0 > start0").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start0") / window), F.floor((F.col("end0") - 1) / window))))
    covered = F.least("end0", (F.col("bin") + 1) * window) - F.greatest("start0", F.col("bin") * window)
    means = cut.groupBy("chrom", "bin").agg((F.sum(F.col("value") * covered) / window).alias("mappability"))
    if flush_last:
        return means
    last = means.groupBy("chrom").agg(F.max("bin").alias("last"))
    joined = means.join(last, "chrom")
    return joined.select("chrom", "bin", F.when(F.col("bin") < F.col("last"), F.col("mappability")).otherwise(0.0).alias("mappability"))


def interval_mean_signal(calls: DataFrame, signal: DataFrame, bucket: int) -> DataFrame:
    """calls plus mappability: the signal's mean over each closed interval (chrom, start, end), uncovered bases 0."""
    place = ["chrom", "start", "end"]
    items = signal.select("chrom", (F.col("start0") + 1).alias("start"), F.col("end0").alias("end"), "value")
    met = overlap_join(calls.select(*place).distinct(), items, bucket)
    part = F.col("r_value") * (F.least("end", "r_end") - F.greatest("start", "r_start") + 1)
    sums = met.groupBy(*place).agg(F.sum(part).alias("_sum"))
    length = F.col("end") - F.col("start") + 1
    return calls.join(sums, place, "left").select(*calls.columns, (F.coalesce("_sum", F.lit(0.0)) / length).alias("mappability"))


def read_depth(reads: DataFrame, reference: DataFrame, signal: DataFrame, window: int = 200, min_mapq: int = 0) -> DataFrame:
    """The windows of all samples with GC and mappability; windows without reference bases get GC -1, without signal 0."""
    windows = depth_windows(reads, window, min_mapq)
    gc, mappable = gc_windows(reference, window), bin_mean_signal(signal.withColumn("chrom", F.regexp_replace("chrom", "^chr", "")), window)
    plain = windows.withColumn("_name", F.regexp_replace("chrom", "^chr", ""))
    joined = plain.join(gc, ["chrom", "bin"], "left").join(mappable.withColumnRenamed("chrom", "_name"), ["_name", "bin"], "left")
    return joined.select("chrom", "start", "end", *SAMPLES, F.coalesce("gc", F.lit(-1)).alias("gc"), F.coalesce("mappability", F.lit(0.0)).alias("mappability"))


def usable(windows: DataFrame, min_mappability: float = 0.0, excluded: DataFrame | None = None, bucket: int = 100_000) -> DataFrame:
    """Windows of moderate GC and enough mappability; with `excluded`, none that starts inside such an interval."""
    kept = windows.filter(F.col("gc").between(MIN_GC, MAX_GC) & (F.col("mappability") >= min_mappability))
    if excluded is None:
        return kept
    points = kept.withColumn("_end", F.col("end")).withColumn("end", F.col("start"))
    return overlap_join(points, excluded, bucket, "left_anti").withColumn("end", F.col("_end")).drop("_end")
