"""Merging depth and pair calls, and refining their breakpoints."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinseg.functions.alignments import PAIRED, SECONDARY, SUPPLEMENTARY, has, left_clipped, one_end_anchored, orientation, right_clipped, soft_clip_evidence
from kinseg.operators.alignment import contig_breakpoints, split_alignments
from kinseg.operators.assembly import contigs
from kinseg.operators.relops import Rows, merge_intervals, overlap_join, overlapping, per_group, top1
from kinseg.sources.scratch import settled

TYPES = ("type0", "type1", "type2")
MARGIN, MOST_READS, LEAST_READS = 1000, 1999, 2
Assembler = Callable[[DataFrame], DataFrame]
Aligner = Callable[[DataFrame, DataFrame], DataFrame]
CALL = "chrom string, start long, end long, type0 string, type1 string, type2 string, evidence string"


def shared_fraction() -> Column:
    """Smaller share of overlap of the closed intervals start..end and r_start..r_end."""
    overlap = F.least("end", "r_end") - F.greatest("start", "r_start") + 1
    return F.least(overlap / (F.col("end") - F.col("start") + 1), overlap / (F.col("r_end") - F.col("r_start") + 1))


def reciprocal_overlaps(pair_calls: DataFrame, depth_calls: DataFrame, share: float = 0.5, bucket: int = 1_000_000) -> DataFrame:
    """Relational merge: pair calls with a depth call overlapping both ways by more than `share` become RD:RP; depth calls so matched go; all others stay."""
    place = ["chrom", "start", "end"]
    pairs, depths = (calls.select(*place, *TYPES) for calls in (pair_calls, depth_calls))
    met = overlap_join(pairs.select(*place).distinct(), depths.select(*place).distinct(), bucket).filter(shared_fraction() > share)
    matched = met.select(*place).distinct().withColumn("_hit", F.lit(True))
    ours = pairs.join(matched, place, "left").select(*place, *TYPES, F.when(F.col("_hit"), "RD:RP").otherwise("RP").alias("evidence"))
    theirs = depths.join(met.select(*(F.col(f"r_{c}").alias(c) for c in place)).distinct(), place, "left_anti").select(*place, *TYPES, F.lit("RD").alias("evidence"))
    return ours.unionByName(theirs)


def merged_heads(calls: Rows, share: float) -> Iterator[tuple]:
    """The merge of one stretch of calls with `evidence` RP or RD, sorted by start and end.

    The first calls of either kind meet. Apart, the one that ends first is done.
    Overlapping, both are done: as one call at the pair call's place if either
    is covered by more than `share`, else as two.
    """
    start, end, kind = calls["start"], calls["end"], calls["evidence"]
    lines = {k: deque(np.flatnonzero(kind == k).tolist()) for k in ("RP", "RD")}
    evidence = dict(enumerate(kind))
    while all(lines.values()):
        heads = [line[0] for line in lines.values()]
        common = end[heads].min() - start[heads].max() + 1
        if common <= 0:
            lines[kind[min(heads, key=lambda i: end[i])]].popleft()
            continue
        if (common > share * (end[heads] - start[heads] + 1)).all():
            evidence[heads[0]] = "RD:RP"
            del evidence[heads[1]]
        for line in lines.values():
            line.popleft()
    for i, how in evidence.items():
        yield *(calls[c][i] for c in ("chrom", "start", "end", *TYPES)), how


def merge_calls(pair_calls: DataFrame, depth_calls: DataFrame, share: float = 0.5) -> DataFrame:
    """Order-dependent merge of both call sets; types need not agree and the pair call's place wins.

    Where no call of either set covers a position, all calls before it are done
    before any after it, so the stretches between such positions are merged apart from each other.
    """
    columns = ["chrom", "start", "end", *TYPES]
    name = lambda df, kind: df.select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), *columns[1:], F.lit(kind).alias("evidence"))

    both = overlapping(name(pair_calls, "RP").unionByName(name(depth_calls, "RD")), ["chrom"])
    return per_group(both, ["chrom", "island"], ["start", "end", *TYPES], lambda calls: merged_heads(calls, share), CALL)


def breakpoint_windows(calls: DataFrame, size: int = 400) -> DataFrame:
    """call_id, chrom, window (0 first, 1 last), start, end: around both ends of a long call, around all of a short one."""
    inner = outer = size // 2
    length = F.col("end") - F.col("start") + 1
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    ends = F.array(pair(F.col("start") - outer, F.col("start") + inner), pair(F.col("end") - inner, F.col("end") + outer))
    whole = F.array(pair(F.col("start") - outer, F.col("end") + outer))
    rows = calls.select("call_id", "chrom", F.posexplode(F.when(length > size, ends).otherwise(whole)).alias("window", "w"))
    return rows.select("call_id", "chrom", "window", "w.start", "w.end")


def scan_windows(windows: DataFrame) -> DataFrame:
    """Breakpoint windows of a call coalesced where they overlap: call_id, chrom, start, end, first, last."""
    runs = merge_intervals(windows, ["call_id", "chrom"])
    order = Window.partitionBy("call_id")
    return runs.withColumn("first", F.col("start") == F.min("start").over(order)).withColumn("last", F.col("start") == F.max("start").over(order))


def mode(values: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys, value, n: the commonest value of each group, of equals the one met first in order."""
    first = F.min(F.struct(*order)).alias("_first")
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"), first)
    return top1(counts, keys, [F.desc("n"), F.asc("_first")]).drop("_first")


def soft_clip_breakpoints(calls: DataFrame, reads: DataFrame, size: int = 400, bucket: int = 10_000, compat: bool = False) -> DataFrame:
    """call_id, start, end of calls whose two breakpoints are each shown by two or more clipped reads.

    Reads of samples without the event are left out. A deletion starts where right-clipped reads end in
    the first window and ends where left-clipped ones start in the last; a
    duplication the other way round (with compat its end is taken from the read's start, as once).
    """
    windows = scan_windows(breakpoint_windows(calls, size))
    types = calls.select("call_id", F.posexplode(F.array(*TYPES)).alias("sample_idx", "type")).filter("type <> 'REFERENCE'")
    sides = F.array(F.struct(F.lit("left").alias("side"), F.col("start").alias("at"), F.col("start").alias("value")), F.struct(F.lit("right").alias("side"), F.col("end").alias("at"), F.col("end").alias("value")))
    clipped = reads.filter(soft_clip_evidence(left_clipped() | right_clipped())).select("chrom", "sample_idx", "bam_ord", "ord", "start", "cigar", F.explode(sides).alias("s"))
    clipped = clipped.filter(((F.col("s.side") == "left") & left_clipped()) | ((F.col("s.side") == "right") & right_clipped()))
    points = clipped.select("chrom", "sample_idx", "bam_ord", "ord", F.col("start").alias("read_start"), "s.side", F.col("s.at").alias("start"), F.col("s.at").alias("end"))
    met = overlap_join(points, windows, bucket).withColumnRenamed("r_call_id", "call_id").hint("merge").join(types, ["call_id", "sample_idx"])
    deletion = F.col("type") == "DELETION"
    starts = F.when(deletion, (F.col("side") == "right") & F.col("r_first")).otherwise((F.col("side") == "left") & F.col("r_first"))
    ends = F.when(deletion, (F.col("side") == "left") & F.col("r_last")).otherwise((F.col("side") == "right") & F.col("r_last"))
    value = F.when(~deletion & (F.col("side") == "right"), F.col("read_start")).otherwise(F.col("start")) if compat else F.col("start")
    voted = met.select("call_id", "bam_ord", "ord", value.alias("value"), F.explode(F.array(F.when(starts, "start"), F.when(ends, "end"))).alias("edge")).filter("edge is not null")
    best = mode(voted, ["call_id", "edge"], "value", ["bam_ord", "ord"]).filter("n > 1")
    both = best.groupBy("call_id").agg(*(F.max(F.when(F.col("edge") == e, F.col("value"))).alias(e) for e in ("start", "end")))
    return both.filter("start < end")


def supporting_pairs(calls: DataFrame, reads: DataFrame, parameters: DataFrame, size: int = 400, deviation: float = 9, limit: int = 2000, bucket: int = 10_000) -> DataFrame:
    """call_id, sample_idx, bam_ord, qname, seq1, seq2: read pairs in a call's windows that are clipped, half mapped or discordant.

    Mates outside the windows are found by name. Per call and sample at most
    `limit` pairs in file order count; later files are skipped once one overflows. Secondary and supplementary
    records are no mates.
    """
    windows = breakpoint_windows(calls, size)
    reads = reads.filter(~has(SECONDARY | SUPPLEMENTARY))
    types = calls.select("call_id", F.posexplode(F.array(*TYPES)).alias("sample_idx", "type")).filter("type <> 'REFERENCE'")
    inside = overlap_join(reads, windows, bucket).filter((F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end")))
    inside = inside.withColumnRenamed("r_call_id", "call_id").hint("merge").join(types, ["call_id", "sample_idx"])
    names = inside.select("call_id", "sample_idx", "type", "qname").distinct()
    both = reads.hint("merge").join(names, ["sample_idx", "qname"]).filter(has(PAIRED)).withColumn("one", has(0x40))
    par = F.broadcast(parameters.select("sample", F.col("median").cast("int").alias("_m"), F.col("mad").cast("int").alias("_d")))
    both = both.join(par, "sample")
    shown = F.col("cigar").contains("S") | one_end_anchored()
    far = (orientation() == "FR") & (F.abs("tlen") > F.col("_m") + F.col("_d") * deviation)
    odd = F.when(F.col("type") == "DELETION", far).otherwise(orientation() == "RF")
    seq = lambda one: F.max(F.when(F.col("one") == one, F.col("seq")))
    paired = both.groupBy("call_id", "sample_idx", "bam_ord", "qname").agg(F.min("ord").alias("ord"), F.max(shown.cast("int")).alias("shown"), F.min(F.coalesce(odd, F.lit(False)).cast("int")).alias("odd"), seq(True).alias("seq1"), seq(False).alias("seq2"))
    paired = paired.filter("(shown = 1 or odd = 1) and seq1 is not null and seq2 is not null and seq1 <> seq2")
    ranked = paired.withColumn("_n", F.row_number().over(Window.partitionBy("call_id", "bam_ord").orderBy("ord", "qname")))
    full = ranked.groupBy("call_id", "bam_ord").agg(F.max("_n").alias("m")).filter(F.col("m") >= limit).groupBy("call_id").agg(F.min("bam_ord").alias("stop"))
    kept = ranked.hint("merge").join(full, "call_id", "left").filter((F.col("_n") <= limit) & (F.col("stop").isNull() | (F.col("bam_ord") <= F.col("stop"))))
    return kept.select("call_id", "sample_idx", "bam_ord", "qname", "seq1", "seq2")


def call_windows(calls: DataFrame, reference: DataFrame, size: int = 400, margin: int = MARGIN) -> DataFrame:
    """call_id, bases, origin: the reference (chunks chrom, chunk_start, bases) around each call, from position `origin` on."""
    outer = size // 2
    low, high = F.greatest(F.col("start") - outer - margin, F.lit(1)), F.col("end") + outer + margin
    wanted = calls.select("call_id", "chrom", low.alias("start"), high.alias("end"))
    chunks = reference.select("chrom", F.col("chunk_start").alias("start"), (F.col("chunk_start") + F.length("bases") - 1).alias("end"), "bases")
    met = overlap_join(wanted, chunks, 10_000)
    skip = F.greatest(F.col("start") - F.col("r_start"), F.lit(0))
    piece = F.substring("r_bases", (skip + 1).cast("int"), (F.least("end", "r_end") - F.greatest("start", "r_start") + 1).cast("int"))
    pieces = F.sort_array(F.collect_list(F.struct("r_start", piece.alias("p"))))
    return met.groupBy("call_id").agg(F.array_join(F.transform(pieces, lambda x: x["p"]), "").alias("bases"), F.min("start").alias("origin"))


def assembled_breakpoints(calls: DataFrame, pairs: DataFrame, reference: DataFrame, size: int = 400, assembler: Assembler = contigs, aligner: Aligner = split_alignments) -> DataFrame:
    """calls with evidence :BP at the breakpoints that contigs of their supporting reads show.

    A call with too few or too many reads, or without contigs, goes; one whose
    contigs align nowhere as a split stays as it was if both kinds of evidence made it. pairs: supporting_pairs().
    assembler: (call_id, seq) to (call_id, contig, seq); aligner: these and (call_id, bases) to the columns of split_alignments().
    """
    sized = pairs.groupBy("call_id").agg(F.count("*").alias("n")).filter(F.col("n").between(LEAST_READS, MOST_READS)).select("call_id")
    reads = settled(pairs.join(sized, "call_id").select("call_id", F.explode(F.array("seq1", "seq2")).alias("seq")), "supporting")
    built = settled(assembler(reads).select("call_id", "contig", "seq"), "contigs")
    named = built.select("call_id").distinct()
    windows = settled(call_windows(calls.join(named, "call_id"), reference, size), "call-windows")
    places = contig_breakpoints(calls, settled(aligner(built, windows), "contig-alignments"))
    shift = F.col("origin") - 1
    places = places.join(windows.select("call_id", "origin"), "call_id").select("call_id", (F.col("start") + shift).alias("_start"), (F.col("end") + shift).alias("_end"))
    rows = calls.join(named, "call_id").join(places, "call_id", "left")
    shown = F.col("_start").isNotNull()
    both = F.size(F.split("evidence", ":")) == 2
    edge = lambda own, new: F.when(shown, F.col(new)).otherwise(F.col(own)).cast("long").alias(own)
    evidence = F.when(shown, F.concat("evidence", F.lit(":BP"))).otherwise(F.col("evidence")).alias("evidence")
    return rows.filter(shown | both).select("chrom", edge("start", "_start"), edge("end", "_end"), *TYPES, evidence)


def refine_calls(calls: DataFrame, reads: DataFrame, reference: DataFrame, parameters: DataFrame, size: int = 400, deviation: float = 9, assembler: Assembler = contigs, aligner: Aligner = split_alignments) -> DataFrame:
    """Final calls: soft clips decide where they can, assembly and alignment of contigs where they cannot.

    Each step is written to the shared folder, so that the next one does not run it again.
    """
    numbered = settled(calls.withColumn("call_id", F.xxhash64(*calls.columns)), "merged-calls")
    clipped = settled(soft_clip_breakpoints(numbered, reads, size), "clipped-calls")
    sharp = numbered.drop("start", "end").join(clipped, "call_id").withColumn("evidence", F.concat("evidence", F.lit(":BP")))
    rest = numbered.join(clipped.select("call_id"), "call_id", "left_anti")
    built = assembled_breakpoints(rest, supporting_pairs(rest, reads, parameters, size, deviation), reference, size, assembler, aligner)
    return sharp.select("chrom", "start", "end", *TYPES, "evidence").unionByName(built)
