"""From windows to calls: contigs, joint decoding, runs, gap merging, majority states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinseg.functions import tensors
from kinseg.functions.alignments import AUTOSOMES, sv_type
from kinseg.operators.depth import interval_mean_signal
from kinseg.operators.model import emission_scores, long_depth
from kinseg.operators.relops import islands, scanned
from kinseg.sources.scratch import settled

MAX_CONTIG = 10_000_000
STATES = ("s0", "s1", "s2")


def contigs(windows: DataFrame, distance: int = 10_000, longest: int = MAX_CONTIG) -> DataFrame:
    """windows plus contig (0, 1, ... along each chrom): a new one after a gap, or where the current one got too long.

    Gaps cut first, by a scan in stretches; inside what remains only the length rule acts, and
    it needs one jump per contig. What lies between two gaps, some million slim rows at most, is one task.
    """
    cut = islands(windows.select("chrom", "start", "end"), ["chrom"], ["start"], {"_before": ("last", "start")}, F.col("end") - F.col("_before") + 1 > distance)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start", ignore_index=True)
        start, end = rows["start"].to_numpy(), rows["end"].to_numpy()
        part, number, at = np.zeros(len(rows), np.int64), 0, 0
        while at < len(rows):
            # The window after the first whose end makes the contig too long begins the next.
            stop = int(np.searchsorted(end, start[at] + longest - 1, side="right")) + 1
            part[at:stop] = number
            at, number = stop, number + 1
        return rows.assign(part=part)

    parts = cut.groupBy("chrom", "island").applyInPandas(fold, "chrom string, start long, end long, island long, part long")
    heads = parts.groupBy("chrom", "island", "part").agg(F.min("start").alias("start"))
    numbered = scanned(heads.withColumn("_one", F.lit(1)), ["chrom"], ["start"], {"contig": ("sum", "_one")}).select("chrom", "island", "part", "contig")
    named = parts.join(numbered, ["chrom", "island", "part"]).select("chrom", "start", F.col("contig").cast("long").alias("contig"))
    return windows.join(named, ["chrom", "start"])


def decode(windows: DataFrame, models: DataFrame, transition_prob: float = 1e-5, error: float = 1e-4) -> DataFrame:
    """windows (with contig) plus s0..s2: the most probable copy numbers along each contig.

    Scores of the three samples under five states come from the JVM, 15 numbers a
    window; a task decodes one contig, at most some 50,000 windows, in numpy.
    """
    scores = emission_scores(long_depth(windows), models).groupBy("chrom", "start").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", "scores"))), lambda x: x["scores"])).alias("scores"))
    rows = windows.select("chrom", "contig", "start", "end").join(scores, ["chrom", "start"])
    transition, start = tensors.joint_transition(transition_prob), tensors.start_scores(error)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start", ignore_index=True)
        each = np.array(group["scores"].tolist()).reshape(-1, 3, 5)
        joint = (each[:, 0, :, None, None] + each[:, 1, None, :, None] + each[:, 2, None, None, :]).reshape(-1, 125)
        path = tensors.viterbi(joint, transition, start)
        return group[["chrom", "contig", "start", "end"]].assign(s0=path // 25, s1=path // 5 % 5, s2=path % 5)

    return rows.groupBy("chrom", "contig").applyInPandas(run, "chrom string, contig long, start long, end long, s0 int, s1 int, s2 int")


def collapse(state: Column) -> Column:
    return F.when(state == 0, 1).when(state == 4, 3).otherwise(state)


def state_runs(states: DataFrame) -> DataFrame:
    """Adjacent windows of one contig with equal collapsed states other than all diploid: chrom, contig, start, end, s0..s2."""
    rows = states.select("chrom", "contig", "start", "end", *(collapse(F.col(s)).alias(s) for s in STATES))
    rows = rows.filter(~((F.col("s0") == 2) & (F.col("s1") == 2) & (F.col("s2") == 2)))
    prior = {"_end": ("last", "end")} | {f"_{state}": ("last", state) for state in STATES}
    differs = (F.col("start") != F.col("_end") + 1) | (F.col("s0") != F.col("_s0")) | (F.col("s1") != F.col("_s1")) | (F.col("s2") != F.col("_s2"))
    runs = islands(rows, ["chrom", "contig"], ["start"], prior, differs, "run")
    return runs.groupBy("chrom", "contig", "run", *STATES).agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "contig", "start", "end", *STATES)


def gap_clusters(runs: DataFrame, distance: int = 10_000) -> DataFrame:
    """runs plus cluster: the next run joins if at most `distance` bases lie between."""
    return islands(runs, ["chrom", "contig"], ["start"], {"_last": ("last", "end")}, F.col("start") - F.col("_last") - 1 > distance, "cluster")


def majority_states(clusters: DataFrame) -> DataFrame:
    """One row per cluster: chrom, contig, start, end, s0..s2, each sample's state by length, gaps counting as 2, ties to the lower."""
    keys = ["chrom", "contig", "cluster"]
    span = clusters.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("runs"), F.sum(F.col("end") - F.col("start") + 1).alias("covered"))
    votes = clusters.select(*keys, (F.col("end") - F.col("start") + 1).alias("votes"), F.posexplode(F.array(*STATES)).alias("sample", "state"))
    gaps = span.filter("runs > 1").select(*keys, (F.col("end") - F.col("start") + 1 - F.col("covered")).alias("votes"), F.explode(F.array(*map(F.lit, range(3)))).alias("sample"), F.lit(2).alias("state"))
    tally = votes.unionByName(gaps).groupBy(*keys, "sample", "state").agg(F.sum("votes").alias("votes"))
    best = tally.groupBy(*keys, "sample").agg(F.max_by("state", F.struct("votes", -F.col("state"))).alias("state"))
    wide = best.groupBy(*keys).agg(*(F.max(F.when(F.col("sample") == i, F.col("state"))).alias(s) for i, s in enumerate(STATES)))
    return span.join(wide, keys).select("chrom", "contig", "start", "end", *STATES)


def depth_calls(windows: DataFrame, models: DataFrame, signal: DataFrame | None = None, distance: int = 10_000, transition_prob: float = 1e-5, error: float = 1e-4, bucket: int = 1_000_000) -> DataFrame:
    """Calls from read depth, autosomes only: chrom, start, end, type0..type2, score (mappability), evidence RD."""
    autosomal = windows.filter(F.col("chrom").rlike(AUTOSOMES))
    states = settled(decode(contigs(autosomal, distance), models, transition_prob, error), "states")
    merged = majority_states(gap_clusters(state_runs(states), distance))
    return annotated(merged, signal, bucket)


def annotated(merged: DataFrame, signal: DataFrame | None, bucket: int = 1_000_000) -> DataFrame:
    """Types instead of states, mappability as score, without calls that are diploid in all samples.

    Contigs match whether or not the calls or the signal write chr before their names.
    """
    calls = merged.filter(~((F.col("s0") == 2) & (F.col("s1") == 2) & (F.col("s2") == 2)))
    typed = calls.select("chrom", "start", "end", *(sv_type(F.col(s)).alias(f"type{i}") for i, s in enumerate(STATES)))
    if signal is None:
        return typed.select("*", F.lit(0.0).alias("score"), F.lit("RD").alias("evidence"))
    plain = lambda df: df.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    scored = interval_mean_signal(plain(typed.withColumn("_name", F.col("chrom"))), plain(signal), bucket)
    return scored.select(F.col("_name").alias("chrom"), "start", "end", "type0", "type1", "type2", F.col("mappability").alias("score"), F.lit("RD").alias("evidence"))
