"""The three stages as functions from DataFrames to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinseg.operators import depth, model, pairs, refine, segment
from kinseg.sources.scratch import settled


@dataclass
class Prepared:
    windows: DataFrame
    parameters: DataFrame
    pairs: DataFrame


def preprocess(reads: DataFrame, reference: DataFrame, signal: DataFrame, window: int = 200, deviation: float = 9, min_mapping_quality: int = 0) -> Prepared:
    """Window table, insert-size parameters and discordant pairs. reads carry sample_idx: 0 father, 1 mother, 2 offspring."""
    parameters = pairs.insert_statistics(pairs.insert_sizes(reads))
    index = reads.select("sample", "sample_idx").distinct()
    found = pairs.read_pairs(pairs.discordant(reads, parameters, deviation)).join(F.broadcast(index), "sample")
    return Prepared(depth.read_depth(reads, reference, signal, window, min_mapping_quality), parameters, found)


def call(prepared: Prepared, signal: DataFrame | None = None, exclude: DataFrame | None = None, min_mappability: float = 0, min_distance: int = 10_000, transition_prob: float = 1e-5, mutation_rate: float = 1e-4, outlier: float = 0.025, least_windows: int = model.LEAST_WINDOWS, exclude_depth: bool = False) -> tuple[DataFrame, DataFrame]:
    """(depth calls, pair calls). exclude drops pairs; it drops windows too only with exclude_depth."""
    windows = settled(depth.usable(prepared.windows, min_mappability, exclude if exclude_depth else None), "windows")
    models = settled(model.depth_models(windows, outlier, least_windows), "models")
    by_depth = segment.depth_calls(windows, models, signal, min_distance, transition_prob, mutation_rate)
    rows = prepared.pairs if exclude is None else pairs.exclude_pairs(prepared.pairs, exclude)
    median, mad = pairs.maximum_parameters(prepared.parameters)
    apart = pairs.reach(median, mad)
    by_pairs = pairs.pair_calls(pairs.components(settled(rows, "pairs"), apart), apart, median, mad)
    return by_depth, by_pairs


def refined(by_depth: DataFrame, by_pairs: DataFrame, reads: DataFrame, reference: DataFrame, parameters: DataFrame, size: int = 400, deviation: float = 9, assembler: refine.Assembler = refine.contigs, aligner: refine.Aligner = refine.split_alignments) -> DataFrame:
    """Final calls: both kinds merged, then refined. Another assembler or aligner may take the place of the library's own."""
    merged = refine.merge_calls(by_pairs, by_depth)
    return refine.refine_calls(merged, reads, reference, parameters, size, deviation, assembler, aligner).orderBy("chrom", "start", "end")
